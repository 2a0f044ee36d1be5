"""The review queue: enqueue, pending, resolve, history, and a console over it."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright import config, schema
from graphwright.operators import backlog
from graphwright.sources.store import PermanentStoreError, RetryableStoreError, ReviewSnapshotStore


def upsert(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with ``new`` rows replacing those of the same id; of several new rows of an id the greatest ``seq`` counts."""
    both = items.unionByName(new.withColumn("seq", F.col("seq") + (1 << 40)))
    cols = [c for c in items.columns if c != "item_id"]
    out = both.groupBy("item_id").agg(F.max(F.struct("seq", *[c for c in cols if c != "seq"])).alias("_r")).select("item_id", "_r.*")
    return out.withColumn("seq", F.pmod("seq", F.lit(1 << 40).cast("bigint"))).select(items.columns)


def item_views(items: DataFrame) -> DataFrame:
    """Adds what the JSON payload of a review case says (proposed_action, case_source, case_type, risk, case_value, trace_id); nulls for payloads that are none."""
    case = F.from_json("payload", "proposed_action string, source string, entity_type string, risk double, value double, trace_id string, snapshot_ref string", {"mode": "PERMISSIVE"})
    out = items.withColumn("_c", case)
    return out.select(*items.columns, "_c.proposed_action", F.col("_c.source").alias("case_source"), F.col("_c.entity_type").alias("case_type"), "_c.risk", F.col("_c.value").alias("case_value"), "_c.trace_id")


def pending(items: DataFrame, history: DataFrame, limit: int | None = 50) -> DataFrame:
    """Items without a decision, in order of insertion."""
    out = items.join(history.select("item_id"), "item_id", "left_anti").orderBy("seq")
    return out if limit is None else out.limit(limit)


def resolve(items: DataFrame, history: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open items, new history rows) after decisions (item_id, action, actor, at, payload); decisions on items that are not pending give no row."""
    open_ = items.join(history.select("item_id"), "item_id", "left_anti")
    hit = decisions.join(open_.select("item_id"), "item_id", "left_semi")
    return open_.join(hit.select("item_id"), "item_id", "left_anti"), hit


def edit_payload(text: str) -> dict:
    """The JSON object of an edit; anything else is refused."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("invalid edited payload: not valid JSON") from e
    if not isinstance(value, dict):
        raise ValueError("invalid edited payload: must be a JSON object")
    return value


class Queue:
    """A durable queue: items and decisions as snapshots under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.items = ReviewSnapshotStore(spark, f"{path}/items", schema.struct("review_items"))
        self.decided = ReviewSnapshotStore(spark, f"{path}/history", schema.struct("review_history"))

    def enqueue(self, new: DataFrame) -> None:
        """Add items, or replace those of the same id."""
        now = self.items.load()
        first = (now.agg(F.max("seq")).first()[0] or 0) + 1
        rows = new.select([c for c in now.columns if c != "seq"]).withColumn("seq", F.lit(first).cast("bigint") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint")))
        self.items.save(upsert(now, rows))

    def pending(self, limit: int | None = 50) -> DataFrame:
        return pending(self.items.load(), self.decided.load(), limit)

    def history(self, item_id: str) -> DataFrame:
        """Decisions on an item, oldest first."""
        return self.decided.load().filter(F.col("item_id") == item_id).orderBy("at")

    def resolve(self, item_id: str, action: str, actor: str, at: dt.datetime, payload: dict | None = None) -> None:
        """Keep a decision; an item that is not pending is a permanent error."""
        if self.pending(None).filter(F.col("item_id") == item_id).isEmpty():
            raise PermanentStoreError(f"item {item_id} is not pending")
        old = self.decided.load()
        row = self.spark.createDataFrame([(item_id, action, actor, at, json.dumps(payload) if payload is not None else None)], old.schema)
        self.decided.save(old.unionByName(row))


def _line(r) -> str:
    case = json.loads(r.payload) if r.payload and r.payload.lstrip().startswith("{") else {}
    due = r.enqueued_at + dt.timedelta(hours=config.SLA_HOURS.get(r.priority, config.SLA_HOURS["P3"])) if r.enqueued_at else None
    return f"  [{r.priority}] {r.item_id}  kind={r.kind}  proposed={case.get('proposed_action', '?')}  due={due.isoformat() if due else '-'}"


def _backlog_lines(items: DataFrame, now: dt.datetime) -> list[str]:
    sla = backlog.with_sla(items, now.isoformat(sep=" "))
    m = {(r.by, r.value): r for r in backlog.metrics(sla).collect()}
    total = m.get(("all", None))
    if total is None or not total.depth:
        return ["queue depth: 0", "backpressure: none"]
    part = lambda by: {v: r.depth for (b, v), r in sorted(m.items(), key=lambda x: str(x[0])) if b == by}
    out = [f"queue depth: {total.depth}", f"oldest item age (h): {total.max_age_hours or 0:.1f}", f"breaches: {total.breaches}", f"depth by source: {part('source')}", f"depth by entity type: {part('entity_type')}"]
    inverted = [r.item_id for r in backlog.priority_inversion(sla).select("item_id").orderBy("item_id").limit(50).collect()]
    out += [f"priority inversion: {bool(inverted)}", *([f"  waiting: {', '.join(inverted)}"] if inverted else [])]
    signals = backlog.backpressure(sla).orderBy("source").collect()
    return out + [f"  {s.source}: {s.signal} (depth={s.depth}, breaches={s.breaches})" for s in signals] if signals else [*out, "backpressure: none"]


def main(queue: Queue, args: list[str], now: dt.datetime | None = None) -> tuple[int, list[str]]:
    """``list [n]``, ``show id``, ``resolve id action actor [json]``, ``history id`` or ``backlog``: exit code and lines.

    2 says bad input, 1 that an item is missing or a store failed.
    """
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    name, rest = (args[0], args[1:]) if args else ("", [])
    least = {"list": 0, "show": 1, "resolve": 3, "history": 1, "backlog": 0}
    if name not in least or len(rest) < least[name] or (name == "list" and rest and not rest[0].isdigit()):
        return 2, ["usage: list [n] | show ID | resolve ID ACTION ACTOR [JSON] | history ID | backlog"]
    if name == "list":
        rows = queue.pending(int(rest[0]) if rest else 50).collect()
        return 0, [f"{len(rows)} pending review item(s):", *map(_line, rows)] if rows else ["no pending review items"]
    if name == "backlog":
        return 0, _backlog_lines(queue.pending(None), now)
    if name == "history":
        rows = queue.history(rest[0]).collect()
        return 0, [f"{len(rows)} decision(s) for {rest[0]}:", *[f"  {r.at.isoformat()}  {r.action}  by {r.actor}" for r in rows]] if rows else [f"no decisions recorded for {rest[0]}"]
    if name == "show":
        row = queue.pending(None).filter(F.col("item_id") == rest[0]).first()
        return (0, [f"{k}: {v}" for k, v in row.asDict().items()]) if row else (1, [f"item {rest[0]} is not pending"])
    if rest[1] not in config.REVIEW_ACTIONS:
        return 2, [f"actions: {', '.join(config.REVIEW_ACTIONS)}"]
    try:
        payload = edit_payload(rest[3]) if len(rest) > 3 else None
        if rest[1] == "EDIT" and payload is None:
            raise ValueError("an EDIT needs an edited payload")
    except ValueError as e:
        return 2, [str(e)]
    try:
        queue.resolve(rest[0], rest[1], rest[2], now, payload)
    except (RetryableStoreError, PermanentStoreError) as e:
        return 1, [f"resolve failed ({'retryable' if isinstance(e, RetryableStoreError) else 'permanent'}): {e}"]
    return 0, [f"resolved {rest[0]}: {rest[1]} by {rest[2]}"]
