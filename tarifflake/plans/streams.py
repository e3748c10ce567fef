"""Streaming queries run to the end of their input; their results equal the batch ones."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history, ledger, ownership
from ..session import checkpoint_dir, settings, stage
from ..streaming import jobs
from .registry import query
from .ledger import EXACT_LIVE


def drain(stream, mode: str, spark, base: str | None = None):
    """Runs a stream over what is there now and returns its output table, written to the shared folder. With the same
    ``base`` a stream goes on where it stopped."""
    base = base or f"{checkpoint_dir(spark)}/s_{uuid.uuid4().hex[:8]}"
    out = f"{base}/out"

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query(
    "st2_daily_usage_stream",
    """select strftime(called_at, '%Y-%m-%d') as day, model, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cost) as double) as cost from b_usage group by 1, 2""",
    ["b_usage"],
)
def st2(lib):
    spark = lib.spark
    events = spark.readStream.schema(lib.events.schema).option("pathGlobFilter", "events.parquet").parquet(lib.sf_dir)
    calls = spark_view(lib, events)
    # update mode: the last row of a window is its final count
    rows = drain(jobs.daily_usage(calls), "update", spark)
    last = F.struct(F.col("batch"), F.col("calls"))
    return rows.groupBy("day", "model").agg(*[F.max_by(c, last).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost")])


def spark_view(lib, events):
    e = events.select(
        F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp").alias("at"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"), F.when(F.col("user_id") % 5 > 0, F.col("value").cast("decimal(12,4)")).alias("cost"),
    )
    return e


# pieces by day; some rows come one piece late, and a late row counts while its day has not been closed by the watermark
_PIECES = [dt.date(2024, 1, 11), dt.date(2024, 1, 21)]
_LATE_SQL = f"""arrived as (select e.*, case when ts < timestamp '{_PIECES[0]} 00:00:00' then 0 when ts < timestamp '{_PIECES[1]} 00:00:00' then 1 else 2 end + case when event_id % 400 = 7 then 1 else 0 end as piece from events e),
   marks as (select p.piece, (select max(ts) from arrived a where a.piece < p.piece) - interval 1 day as mark from (select distinct piece from arrived) p),
   counted as (select a.* from arrived a join marks m on m.piece = a.piece where m.mark is null or date_trunc('day', a.ts) + interval 1 day > m.mark)"""


@query(
    "st2_late_usage_stream",
    f"""with {_LATE_SQL} select strftime(ts, '%Y-%m-%d') as day, 'm' || (user_id % 3) as model, count(*) as calls, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as input_tokens, cast(sum(cast(floor(value * 10) as bigint)) as bigint) as output_tokens,
        cast(sum(case when user_id % 5 > 0 then cast(value as decimal(12,4)) end) as double) as cost from counted group by 1, 2""",
)
def st2_late(lib):
    """The usage of each day from events that arrive in four triggers, some of them late: those whose day is still open
    are counted, the others are refused."""
    late = F.when(F.col("event_id") % 400 == 7, 1).otherwise(0)
    piece = F.when(F.col("ts") < F.lit(dt.datetime.combine(_PIECES[0], dt.time())), 0).when(F.col("ts") < F.lit(dt.datetime.combine(_PIECES[1], dt.time())), 1).otherwise(2) + late
    arrived = lib.events.withColumn("piece", piece)
    return usage_in_triggers(lib, [arrived.filter(F.col("piece") == p).drop("piece") for p in range(4)])


def usage_in_triggers(lib, pieces):
    """Daily usage after each of ``pieces`` has arrived in a trigger of its own: the stream is stopped and started again
    from its checkpoint between them."""
    spark = lib.spark
    base = f"{checkpoint_dir(spark)}/usage_{uuid.uuid4().hex[:8]}"
    for n, piece in enumerate(pieces):
        piece.write.parquet(f"{base}/in/piece={n}")
        events = spark.readStream.schema(lib.events.schema).parquet(f"{base}/in/*")
        drain(jobs.daily_usage(spark_view(lib, events)), "update", spark, base)
    rows = spark.read.parquet(f"{base}/out")
    last = F.struct(F.col("batch"), F.col("calls"))
    return rows.groupBy("day", "model").agg(*[F.max_by(c, last).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost")])


@query(
    "st3_rate_state_stream",
    EXACT_LIVE,
    ["b_line"],
)
def st3(lib):
    """The live picture kept as streaming state, over the sheets written to a folder in approval order."""
    spark = lib.spark
    base = f"{checkpoint_dir(spark)}/lines_{uuid.uuid4().hex[:8]}"
    lines = stage(history.as_lines(ledger.loaded_lines(lib.b_line)), base)
    stream = spark.readStream.schema(lines.schema).parquet(base)
    with settings(spark, jobs.ON_DISK):
        rows = drain(jobs.rate_state(stream), "update", spark)
    live = rows.filter("kind = 'live'").repartition("rate_key")
    live = live.withColumn("newest", F.max("batch").over(Window.partitionBy("rate_key"))).filter("batch = newest")
    return ownership.joined(live)
