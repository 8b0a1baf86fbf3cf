"""The stage queues as a stateful stream."""
