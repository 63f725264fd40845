"""Strategies: relation-level plug-ins that turn articles into proposals."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from linkloom.schemas import PROPOSALS, conform
from linkloom.session import cut_lineage

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Context:
    """What a strategy may read: every article of the corpus, and which of them
    are to be analysed as sources (all when None)."""

    articles: DataFrame
    source_ids: DataFrame | None = None
    tables: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Strategy:
    id: str
    name: str
    description: str
    analyze: Callable[[Context, Mapping[str, Any]], DataFrame]
    configure: Callable[[Mapping[str, Any]], Mapping[str, Any]] | None = None


class StrategyRegistry:
    def __init__(self) -> None:
        self._strategies: dict[str, Strategy] = {}

    def register(self, strategy: Strategy) -> None:
        """Add a strategy; one with the same id is replaced in place."""
        self._strategies[strategy.id] = strategy

    def unregister(self, strategy_id: str) -> None:
        self._strategies.pop(strategy_id, None)

    def get(self, strategy_id: str) -> Strategy | None:
        return self._strategies.get(strategy_id)

    def list(self) -> list[Strategy]:
        return [*self._strategies.values()]

    def analyze_with_all(
        self, context: Context, settings: Mapping[str, Any] | None = None
    ) -> tuple[DataFrame, dict[str, str]]:
        """All proposals, and the errors of the strategies that failed.

        Plans are lazy, so each strategy is written out inside its own
        ``try``: a failing one does not lose the others' rows.
        """
        spark = context.articles.sparkSession
        rows = spark.createDataFrame([], PROPOSALS)
        errors: dict[str, str] = {}
        for strategy in self._strategies.values():
            try:
                options = dict(settings or {})
                if strategy.configure:
                    options = dict(strategy.configure(options))
                found = conform(strategy.analyze(context, options), PROPOSALS)
                rows = rows.unionByName(cut_lineage(found, f"strategy-{strategy.id}"))
            except Exception as error:  # noqa: BLE001 - isolation is the point
                log.warning("strategy %s failed: %s", strategy.id, error)
                errors[strategy.id] = str(error)
        return rows, errors
