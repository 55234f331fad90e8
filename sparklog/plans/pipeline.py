"""Every layer of every source in turn, recorded step by step.

A run is rows of the table ``pipeline_steps``: one for each source and step, with its state,
time and a note (the step's counters, or what stopped it). A step that fails leaves the
source's later steps ``skipped``; other sources go on. Failures are rows of
``pipeline_errors`` too, and a text in a local file.
"""

from __future__ import annotations

import os
import time
import traceback
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import SparkSession

from sparklog.operators.bronze import ingest_to_bronze
from sparklog.operators.embed import Embedder, embed_segments
from sparklog.operators.gold import transform_to_gold
from sparklog.operators.silver import transform_to_silver
from sparklog.schemas import PIPELINE_STEPS
from sparklog.sources.config import get_source_config, list_sources
from sparklog.sources.tables import Store

ERROR_LOG = "logs/pipeline_errors.log"
DONE, FAILED, SKIPPED = "done", "failed", "skipped"


class StepRecord(NamedTuple):
    run_id: str
    at_utc: datetime
    source_id: str
    place: int
    step: str
    state: str
    seconds: float
    note: str


def layers(embedder: Embedder | None = None, config_path: str | None = None) -> dict[str, Callable]:
    """Steps by name, in order. The first takes a source's id and gives its configuration, the others take the store and that."""
    return {
        "config": lambda store, source: get_source_config(source, config_path),
        "bronze": ingest_to_bronze,
        "silver": transform_to_silver,
        "gold": transform_to_gold,
        "embed": lambda store, config: embed_segments(store, config, embedder),
    }


def walk(store: Store, run_id: str, source_id: str, steps: dict[str, Callable], on_failure: Callable[[StepRecord, Exception], None]) -> Iterator[StepRecord]:
    """One source through the steps."""
    state, subject = DONE, source_id
    for place, (step, work) in enumerate(steps.items()):
        began, at, note, error = time.monotonic(), datetime.now(timezone.utc), "", None
        if state == DONE:
            try:
                made = work(store, subject)
                subject, note = (made, "") if step == "config" else (subject, str(made))
            except Exception as e:  # noqa: BLE001  a source must not stop the others
                state, note, error = FAILED, f"{type(e).__name__}: {e}"[:2000], e
        record = StepRecord(run_id, at, source_id, place, step, state, time.monotonic() - began, note)
        if error is not None:
            on_failure(record, error)
            state = SKIPPED
        yield record


def keep_failure(store: Store, record: StepRecord, error: Exception, log_path: str | None) -> None:
    detail = "".join(traceback.format_exception(error))
    if log_path:
        os.makedirs(os.path.dirname(log_path) or ".", exist_ok=True)
        with open(log_path, "a", encoding="utf-8") as f:
            print(record.at_utc.isoformat(), f"source={record.source_id}", f"step={record.step}", f"error={error!r}", sep="\t", file=f)
            print(detail, file=f)
    row = (record.at_utc, record.source_id, record.step, repr(error)[:2000], detail[:20000])
    store.append("pipeline_errors", store.spark.createDataFrame([row], "at_utc timestamp, source_id string, step string, error string, detail string"))


def run_sources(store: Store, source_ids: Iterable[str], config_path: str | None = None, embedder: Embedder | None = None, log_path: str | None = ERROR_LOG) -> list[StepRecord]:
    run_id, steps = uuid.uuid4().hex, layers(embedder, config_path)
    failed = lambda record, error: keep_failure(store, record, error, log_path)
    records = [r for s in source_ids for r in walk(store, run_id, s, steps, failed)]
    store.append("pipeline_steps", store.spark.createDataFrame(records, PIPELINE_STEPS))
    return records


def run_all(spark: SparkSession, root: str, config_path: str | None = None, embedder: Embedder | None = None, log_path: str | None = ERROR_LOG) -> list[StepRecord]:
    return run_sources(Store(spark, root), list_sources(config_path), config_path, embedder, log_path)


def report(records: list[StepRecord]) -> str:
    """A line per step, and how the sources ended."""
    width = max((len(r.source_id) for r in records), default=0)
    lines = [f"{r.source_id:<{width}}  {r.step:<6}  {r.state:<7}  {r.seconds:8.2f} s  {' '.join(r.note.split())}".rstrip() for r in records]
    broken = sorted({r.source_id for r in records if r.state == FAILED})
    ended = f"stopped early: {', '.join(broken)}" if broken else "all sources went through"
    return "\n".join([*lines, ended if records else "no sources"])


def exit_code(records: list[StepRecord]) -> int:
    """0 only if there was something to do and all of it is done."""
    return int({r.state for r in records} != {DONE})
