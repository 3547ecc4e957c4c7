"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) and, where SQL can say it, its SQL."""

    def keep(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = re.sub(r"\bround\(", "0.0 + round(", sql)  # no negative zero, as in Spark
        return function

    return keep


from . import alignment_queries, array_queries, detection_queries, edit_queries, exchange_queries, image_queries, sequence_queries, table_queries  # noqa: E402,F401
