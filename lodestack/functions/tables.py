"""Table functions for SQL: ``SELECT ... FROM documents, LATERAL chunks_of(text)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators.chunks import OVERLAP, SIZE, chunk_text


def _count(name: str, given: AnalyzeArgument | None, least: int) -> None:
    """A size must be the same for all rows, so a wrong one is refused when the statement is analysed and not in a task."""
    if given is None:
        return
    if given.isTable or not given.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    if not isinstance(given.value, int) or given.value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")


@udtf
class ChunksOf:
    """(chunk_index, text): the chunks of a whole text, none if it is null or blank; ``size`` and ``overlap`` as in ``chunks.chunk``."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.isTable or text.dataType.typeName() not in ("string", "void"):
            raise ValueError("text must be a string")
        _count("size", size, 1)
        _count("overlap", overlap, 0)
        return AnalyzeResult(StructType().add("chunk_index", IntegerType()).add("text", StringType()))

    def eval(self, text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunk_text(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Make ``chunks_of`` callable from SQL."""
    spark.udtf.register("chunks_of", ChunksOf)
