"""Document analytics on Spark: retrieval, text preparation, entity resolution, evaluation and queues."""
