"""The library as streams: sheets arriving, the usage log by day, and rates kept as keyed state."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import COLUMNS, OUT, _frame, _records, _season, apply_line
from ..operators.normalize import normalize
from ..sources.schemas import EXTRACTION


def daily_usage(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls and tokens per day (UTC) and model; rows later than ``late`` are dropped. ``calls`` has an event time ``at``."""
    return (
        calls.withWatermark("at", late)
        .groupBy(F.window("at", "1 day").alias("w"), "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
        .select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")).cast("string").alias("day"), "model", "calls", "input_tokens", "output_tokens", "cost")
    )


STATE = T.StructType([T.StructField("rows", T.StringType())])
#: Groups of rate keys that are kept as one state: a call of Python and a state row cost far more than a key does.
BUCKETS = 4096


#: Where a stream keeps its state: on the executors' disks, with a bounded part of it in memory.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def _pack(held: dict[str, list[dict]]) -> str:
    return json.dumps(list(held.items()), default=str)


def _unpack(rows: list[dict]) -> list[dict]:
    day = lambda v: v and dt.date.fromisoformat(v)
    number = lambda v: None if v is None else Decimal(v)
    kinds = {"valid_from": day, "valid_to": day, "amount": number, "change_pct": number}
    return [{c: kinds[c](r.get(c)) if c in kinds else r.get(c) for c in COLUMNS} for r in rows]


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fresh: dict[str, list[dict]] = {}
    for b in batches:
        for r in _records(b[COLUMNS]):
            fresh.setdefault(r["rate_key"], []).append(r)
    held = dict(json.loads(state.get[0])) if state.exists else {}
    out: list[dict] = []
    for rate_key, lines in fresh.items():
        rows = _unpack(held.get(rate_key, []))
        live = [r for r in rows if r["kind"] == "live"]
        past = {(r["valid_from"], r["valid_to"], _season(r["season_name"])): r for r in rows if r["kind"] == "past"}
        for r in sorted(lines, key=lambda r: (r["seq"], int(r["id"].split("-")[1]))):
            live = apply_line(live, past, r, out)
        held[rate_key] = live + list(past.values())
        out += live
    state.update((_pack(held),))
    yield _frame(out)


def rate_state(lines: DataFrame) -> DataFrame:
    """Lines (in ledger shape) of approved sheets as a stream: each trigger emits what its lines changed, the rows they
    closed and the live rates of their keys. Within a trigger lines are taken in approval order. Keys are kept in
    ``BUCKETS`` groups by their hash, and only those with new lines are worked on. Start it with the settings ``ON_DISK``: a
    library does not fit the executors' memory."""
    bucket = F.pmod(F.xxhash64("rate_key"), F.lit(BUCKETS)).cast("int")
    return lines.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def intake_stream(spark: SparkSession, folder: str, library: str, checkpoint: str, today, per_trigger: int = 1000):
    """Saved records dropped into ``folder`` become clean rows below ``library``, each content once.

    Every trigger normalizes only records whose hash is not known yet, writes rates and issues of documents without
    errors, and appends their hashes last: a trigger that is repeated after a failure overwrites its own output."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).text(folder)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[^.]*$", "")
    files = raw.select(stem.alias("document_id"), F.sha2("value", 256).alias("sha"), "value")

    def load(batch: DataFrame, batch_id: int) -> None:
        from ..session import stage

        s = batch.sparkSession
        one = batch.groupBy("sha").agg(F.min_by("document_id", "document_id").alias("document_id"), F.min_by("value", "document_id").alias("value"))
        seen = _known(s, f"{library}/hashes", batch_id)
        fresh = stage(one.join(seen, "sha", "left_anti") if seen is not None else one)
        docs = fresh.select("document_id", F.from_json("value", EXTRACTION).alias("x"))
        n = normalize(docs.filter("x.document_type is not null"), today)
        issues = stage(n.issues)
        bad = issues.filter("level = 'error'").select("document_id").distinct()
        unreadable = docs.filter("x.document_type is null").select("document_id", F.lit("error").alias("level"), F.lit("document").alias("where"), F.lit("Not a readable record").alias("message"))
        _put(n.hotel_rates.join(bad, "document_id", "left_anti"), f"{library}/hotel_rates", batch_id)
        _put(issues.unionByName(unreadable), f"{library}/issues", batch_id)
        # a document that failed may come again, so only loaded ones are remembered
        failed = bad.unionByName(unreadable.select("document_id"))
        _put(fresh.join(failed, "document_id", "left_anti").select("sha", "document_id"), f"{library}/hashes", batch_id)

    return files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _known(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    try:
        return spark.read.parquet(path).filter(F.col("batch") < batch_id).select("sha").distinct()
    except Exception as e:  # nothing loaded yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
