"""Imports every module that registers a query."""

from linkloom.llm import (  # noqa: F401
    contamination,
    html_extract,
    line_dedup,
    neardup,
    periodic_runs,
    pieces,
    repetition,
    secret_scan,
    sharding,
    spelling_variants,
    substring_dedup,
    toxicity,
    url_filter,
)
from linkloom.llm.base import QUERIES, SQL  # noqa: F401
