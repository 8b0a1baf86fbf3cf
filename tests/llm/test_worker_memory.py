"""What workers hold between and during tasks."""

from __future__ import annotations

import random

import pytest

rng = random.Random(4)


def test_words_of_a_task_are_bounded():
    """The words remembered stay under what is asked for, but for those of one text, and the ids are the same."""
    import public_tokenizers

    from lodestack.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(20)) for _ in range(40)]
    few, all_words = bpe.Codec(path, texts=False), bpe.Codec(path, texts=False)
    most, got = 0, []
    for at in range(0, 40, 4):
        got += list(few.encode(texts[at : at + 4], 50))
        most = max(most, len(few.known))
    assert got == list(all_words.encode(texts)) and len(all_words.known) > 500
    assert most <= 200


def test_memory_is_given_back_after_a_task(monkeypatch):
    from lodestack.llm import base

    calls = []
    monkeypatch.setattr(base, "give_back", lambda: calls.append(1))
    assert list(base.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and calls == [1]

    def fails(batches):
        yield next(batches)
        raise ValueError("x")

    with pytest.raises(ValueError):
        list(base.tidy(fails)(iter([1])))
    assert calls == [1, 1]
