"""Errors raised on the driver."""


class RecordError(ValueError):
    """A table or one of its rows is outside the input contract."""


class GraphError(ValueError):
    """A graph, shard, manifest or weight table breaks its contract."""


class SpecMismatch(GraphError):
    """Graphs were built under a different graph contract."""
