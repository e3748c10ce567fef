"""Usage and cost reports over the call log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.money import token_cost
from .registry import query

NOW = dt.date(2024, 1, 30)
PRICE_IN, PRICE_OUT = 3, 15
# recorded cost, else an estimate at today's prices, in ten-millionths so sums are exact
RC = "coalesce(cast(cost * 10000000 as bigint), input_tokens * 30 + output_tokens * 150)"
SINCE = "timestamp '2024-01-11 00:00:00'"


def with_cost(usage):
    est = token_cost("input_tokens", "output_tokens", 0, PRICE_IN, PRICE_OUT)
    return usage.withColumn("rcost", F.coalesce(F.col("cost").cast("decimal(24,8)"), est))


def period(usage, start):
    return with_cost(usage).filter(F.col("called_at") >= F.lit(start).cast("timestamp_ntz"))


def figures():
    return [
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("rcost"), 4).alias("cost"),
    ]


SQL_FIG = f"count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, (cast(sum({RC}) + 500 as bigint) // 1000) / 10000.0 as cost"


@query(
    "a13_usage_totals",
    f"select {SQL_FIG}, count(*) filter (not ok) as failed, (cast(sum(duration_ms) * 2 + count(*) * 100 as bigint) // (count(*) * 200)) / 10.0 as avg_seconds from b_usage where called_at >= {SINCE}",
    ["b_usage"],
)
def a13(lib):
    secs = F.sum(F.coalesce("duration_ms", F.lit(0))).cast("decimal(20,0)") / F.nullif(F.count(F.lit(1)) * 1000, F.lit(0))
    return period(lib.b_usage, dt.datetime(2024, 1, 11)).agg(*figures(), F.count_if(~F.col("ok")).alias("failed"), F.round(secs, 1).alias("avg_seconds"))


@query(
    "a14_daily_usage",
    f"""select strftime(d, '%Y-%m-%d') as day, count(u.id) as calls, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, (cast(coalesce(sum({RC}), 0) + 500 as bigint) // 1000) / 10000.0 as cost
       from (select cast(unnest(generate_series(date '2024-01-11', date '2024-02-09', interval 1 day)) as date) as d) c left join (select * from b_usage where called_at >= {SINCE}) u on cast(u.called_at as date) = c.d group by 1""",
    ["b_usage"],
)
def a14(lib):
    """Every day of the period, days without calls included."""
    return daily_usage(lib.b_usage, dt.date(2024, 1, 11), 30)


def daily_usage(usage, start, days):
    end = start + dt.timedelta(days=days - 1)
    cal = usage.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    got = period(usage, dt.datetime(start.year, start.month, start.day)).groupBy(F.to_date("called_at").alias("day")).agg(*figures())
    zero = F.lit(0)
    return cal.join(got, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(c, zero).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cost")]
    )


@query("a15_usage_by_model", f"select provider || ' · ' || model as model, {SQL_FIG} from b_usage where called_at >= {SINCE} group by 1", ["b_usage"])
def a15(lib):
    m = F.concat("provider", F.lit(" · "), "model").alias("model")
    return period(lib.b_usage, dt.datetime(2024, 1, 11)).groupBy(m).agg(*figures()).orderBy(F.desc("calls"))


@query(
    "a16_month_cost",
    f"select (cast(sum({RC}) + 500 as bigint) // 1000) / 10000.0 as cost, round(100.0 * ((cast(sum({RC}) + 500 as bigint) // 1000) / 10000.0) / 500000, 1) as budget_used_pct from b_usage where called_at >= timestamp '2024-01-01 00:00:00'",
    ["b_usage"],
)
def a16(lib):
    m = period(lib.b_usage, dt.datetime(NOW.year, NOW.month, 1)).agg(F.round(F.sum("rcost"), 4).alias("cost"))
    return m.select("cost", F.round(F.col("cost") * 100 / 500000, 1).alias("budget_used_pct"))


@query(
    "a17_monthly_usage",
    "select strftime(called_at, '%Y-%m') as month, count(*) as calls, cast(sum(input_tokens) as bigint) as tokens_in, cast(sum(output_tokens) as bigint) as tokens_out, cast(round(sum(cost), 2) as double) as cost from b_usage group by 1",
    ["b_usage"],
)
def a17u(lib):
    return lib.b_usage.groupBy(F.date_format("called_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.round(F.sum("cost"), 2).alias("cost")
    ).orderBy(F.desc("month"))


@query("w12_recent_usage", "select u.id, strftime(called_at, '%Y-%m-%d %H:%M:%S') as called_at, d.filename from b_usage u left join b_document d on d.id = u.document_id order by u.called_at desc, u.id desc limit 12", ["b_usage", "b_document"])
def w12u(lib):
    recent = lib.b_usage.select("id", "called_at", "document_id").orderBy(F.desc("called_at"), F.desc("id")).limit(12)
    d = lib.b_document.select(F.col("id").alias("document_id"), "filename")
    return recent.join(d, "document_id", "left").select("id", F.date_format("called_at", "yyyy-MM-dd HH:mm:ss").alias("called_at"), "filename")


@query(
    "c35_usage_report",
    f"""with m as (select 'month' as part, '2024-01' as label, {SQL_FIG} from b_usage where called_at >= timestamp '2024-01-01 00:00:00'), p as (select 'period' as part, '20 days' as label, {SQL_FIG} from b_usage where called_at >= {SINCE}),
       b as (select 'model' as part, provider || ' · ' || model as label, {SQL_FIG} from b_usage where called_at >= {SINCE} group by 2) select * from m union all select * from p union all select * from b""",
    ["b_usage"],
)
def c35(lib):
    u = lib.b_usage
    month = period(u, dt.datetime(2024, 1, 1)).agg(*figures()).select(F.lit("month").alias("part"), F.lit("2024-01").alias("label"), "*")
    per = period(u, dt.datetime(2024, 1, 11)).agg(*figures()).select(F.lit("period").alias("part"), F.lit("20 days").alias("label"), "*")
    model = a15(lib).select(F.lit("model").alias("part"), F.col("model").alias("label"), "calls", "input_tokens", "output_tokens", "cost")
    return month.unionByName(per).unionByName(model)
