"""Landed registers into the archive, several at a time, each on its own."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.model import REGISTERS, register, register_catalog
from rollbook.operators import history
from rollbook.operators.quality import completeness
from rollbook.operators.stats import request_totals
from rollbook.plans.archive import Archive, iso_time, utc_now, utc_stamp
from rollbook.plans.match_store import MatchKeys
from rollbook.plans.search_index import SearchIndex
from rollbook.session import scratch


@dataclass
class Outcome:
    """What one run did for one register."""

    source: str
    ok: bool = False
    skipped: str = ""
    stamp: str = ""
    rows: int = 0
    added: int = 0
    changed: int = 0
    removed: int = 0
    unchanged: bool = False
    warnings: list[str] = field(default_factory=list)
    error: str = ""
    seconds: float = 0.0
    phases: dict[str, float] = field(default_factory=dict)
    http: tuple | None = None

    @contextmanager
    def phase(self, name: str):
        start = time.monotonic()
        try:
            yield
        finally:
            self.phases[name] = round(self.phases.get(name, 0.0) + time.monotonic() - start, 3)

    def record(self, run_id: str) -> tuple:
        return (
            run_id, self.source, self.ok, self.skipped, self.stamp, self.rows, self.added, self.changed, self.removed,
            self.unchanged, self.warnings, self.error, self.seconds, self.phases, self.http,
        )


def ingest_register(
    archive: Archive,
    source: str,
    read: Callable[[], DataFrame],
    *,
    stamp: str,
    run_id: str = "",
    now: dt.datetime | None = None,
    meta: Mapping[str, object] | None = None,
    keep_days: int | None = None,
    keep_last: int = 2,
    pages: Callable[[], DataFrame] | None = None,
    requests: Callable[[], DataFrame] | None = None,
) -> Outcome:
    """Read, archive, compare with the newest snapshot, record events, store match keys and signatures for searches, retire.

    ``read`` returns flattened rows ``ordinal, fields``.  ``pages`` returns what the landed pages report
    (:func:`rollbook.operators.quality.page_totals`); a shortfall becomes a warning of the snapshot.  ``requests`` returns
    the log of its requests, whose totals go to the run log.  Any failure ends up in
    the outcome, so that one register cannot stop the others.
    """
    out = Outcome(source, stamp=stamp)
    start = time.monotonic()
    try:
        declared = register(source)
        archive.record_missing_changes(source)
        before = archive.latest(source)
        meta = {**(meta or {}), "run_id": run_id}
        if requests is not None:
            out.http = tuple(request_totals(requests()).first())
        if pages is not None:
            with out.phase("completeness"):
                meta["warnings"] = [*(meta.get("warnings") or []), *shortfalls(pages())]
        with out.phase("write"):
            header = archive.write_snapshot(source, read(), stamp=stamp, meta=meta, captured_at=iso_time(now))
        out.rows = header["row_count"]
        out.warnings = list(header["warnings"])
        with out.phase("diff"):
            counts = archive.record_changes(source, before["stamp"] if before else "", stamp)
        out.added, out.changed, out.removed = counts["added"], counts["changed"], counts["removed"]
        out.unchanged = before is not None and not any(counts.values())
        if before and header["duplicate_keys"]:
            out.warnings.append(
                f"{header['duplicate_keys']} row(s) repeat an earlier key on {', '.join(declared.key_columns) or 'content'}"
            )
        if declared.entity_shaped:
            with out.phase("keys"):
                MatchKeys(archive).write(source, stamp)
            with out.phase("index"):
                SearchIndex(archive).write(source, stamp)
        if keep_days:
            with out.phase("retire"):
                mine = archive.catalog().filter(F.col("source") == source)
                at = F.lit(now or utc_now())
                for gone in archive.retire(history.plan_retention(mine, at, keep_days=keep_days, keep_last=keep_last)):
                    MatchKeys(archive).retire(*gone)
                    SearchIndex(archive).retire(*gone)
        out.ok = True
    except Exception as failure:  # isolation of registers is the point
        out.error = f"{type(failure).__name__}: {failure}"
    out.seconds = round(time.monotonic() - start, 3)
    return out


def shortfalls(pages: DataFrame) -> list[str]:
    """Warnings about pages that hold less than they report, or just as much as their interface hands out."""
    told = completeness(pages).where("warning is not null").collect()  # one row
    return [f"{r['warning']}: {r['collected']} collected" + (f", {r['reported']} reported" if r["reported"] is not None else "") for r in told]


def ingest(
    archive: Archive,
    readers: Mapping[str, Callable[[], DataFrame]],
    *,
    now: dt.datetime | None = None,
    force: bool = False,
    run_id: str = "",
    keep_days: int | None = None,
    keep_last: int = 2,
    meta: Mapping[str, Mapping[str, object]] | None = None,
    pages: Mapping[str, Callable[[], DataFrame]] | None = None,
    requests: Mapping[str, Callable[[], DataFrame]] | None = None,
    at_once: int = 4,
) -> list[Outcome]:
    """One run over several registers under one stamp; the run is logged.

    Registers that were archived recently, or that only answer lookups, are
    skipped with the reason.  ``at_once`` registers run side by side, each in a scheduler pool of its own, so that a
    large one does not keep the small ones waiting (with ``spark.scheduler.mode`` set to ``FAIR`` they share the cores evenly).
    """
    stamp = utc_stamp(now)
    run_id = run_id or f"{stamp}-{uuid.uuid4().hex[:6]}"
    at = F.lit(now or utc_now())
    catalog = archive.catalog()
    known = register_catalog(archive.spark, REGISTERS)
    status = {r["source"]: r for r in history.due_registers(catalog, known, at, force=force).collect()}
    newest = {r["source"]: r for r in history.nth_newest(catalog).select("source", "stamp", "row_count").collect()}

    def one(source: str, read: Callable[[], DataFrame]) -> Outcome:
        state, last = status.get(source), newest.get(source)
        if state and state["status"] != "due":
            reason = "answers lookups only" if state["status"] == "not listable" else f"archived {state['age_hours']} h ago"
            return Outcome(source, skipped=reason, stamp=last["stamp"] if last else "", rows=last["row_count"] if last else 0)
        archive.spark.sparkContext.setLocalProperty("spark.scheduler.pool", source)
        with scratch(archive.spark):
            return ingest_register(
                archive, source, read, stamp=stamp, run_id=run_id, now=now, meta=(meta or {}).get(source), keep_days=keep_days,
                keep_last=keep_last, pages=(pages or {}).get(source), requests=(requests or {}).get(source),
            )

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = [pool.submit(inheritable_thread_target(archive.spark)(one), source, read) for source, read in readers.items()]
        outcomes = [s.result() for s in started]
    if outcomes:
        archive.log_runs([o.record(run_id) for o in outcomes])
    return outcomes
