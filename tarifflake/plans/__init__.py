from .registry import ORACLES, QUERIES, query  # noqa: F401
