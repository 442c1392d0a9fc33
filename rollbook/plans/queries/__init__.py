"""Every operator as a query over the test tables, next to SQL for the same result.

Each query takes ``(spark, folder)`` and reads whole tables from the folder.
"""

from __future__ import annotations

from rollbook.plans.queries.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from rollbook.plans.queries import (  # noqa: F401
        counting,
        landing,
        matching,
        reshape,
        searching,
        snapshots,
        streams,
        upkeep,
    )

    return dict(QUERIES), dict(ORACLES)
