"""One query for each corpus operator, over whole tables."""

from __future__ import annotations

from datelore.llm import (  # noqa: F401
    divergence_query,
    forest_query,
    language_query,
    lengths_query,
    lines_query,
    lmscore_query,
    mixing_query,
    orderhash_query,
    periods_query,
    pieces_query,
    rotated_query,
    shards_query,
    simhash_query,
)
from datelore.llm.registry import ORACLES, QUERIES  # noqa: F401
