"""Collects the queries of all plan modules."""

from __future__ import annotations

from . import exports, intake, ledger, library, matching, packages, pricing, scalars, streams, trips, usage  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
