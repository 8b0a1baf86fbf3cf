"""Dataflows over tables: retrieval, lookups, entities, chunks, queues, stages, models, evaluation."""
