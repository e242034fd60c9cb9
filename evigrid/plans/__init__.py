"""Importing this package registers every query."""

from . import (  # noqa: F401
    account_queries,
    evidence_queries,
    footprint_queries,
    geometry_queries,
    group_queries,
    pin_queries,
    search_queries,
    source_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
