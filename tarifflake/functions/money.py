"""Money rules: decimals throughout, half-up rounding, percent changes to one decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import col


def money(c) -> Column:
    return F.round(col(c).cast("decimal(24,6)"), 2)


def pct_change(old, new) -> Column:
    """Change in percent, one decimal; null when there is no earlier amount to compare with."""
    o, n = col(old).cast("decimal(18,4)"), col(new).cast("decimal(18,4)")
    return F.round((n - o) * 100 / F.nullif(o, F.lit(0)), 1)


def add_pct(c, pct) -> Column:
    """``c`` and a percentage of it, unrounded."""
    return col(c) * F.coalesce(col(pct), F.lit(0)) / F.lit(100)


def token_cost(tokens_in, tokens_out, cached, price_in, price_out, cache_factor="0.1") -> Column:
    """Price of one call: cached input is billed at a fraction; prices are per million tokens."""
    if price_in is None and price_out is None:
        return F.lit(None).cast("decimal(18,6)")
    tin, tout = F.coalesce(col(tokens_in), F.lit(0)), F.coalesce(col(tokens_out), F.lit(0))
    hit = F.least(F.coalesce(col(cached) if not isinstance(cached, int) else F.lit(cached), F.lit(0)), tin)
    billed = (tin - hit).cast("decimal(20,1)") + hit.cast("decimal(20,0)") * F.lit(cache_factor).cast("decimal(4,2)")
    total = billed * F.lit(str(price_in or 0)).cast("decimal(12,4)") + tout.cast("decimal(20,0)") * F.lit(
        str(price_out or 0)
    ).cast("decimal(12,4)")
    return (total / F.lit(1000000)).cast("decimal(24,8)")


def grouped_amount(c, currency, rupee_sign: str = "INR ") -> Column:
    """A whole amount with its currency: 1,33,634 style grouping for INR, thousands elsewhere."""
    whole = F.round(col(c).cast("decimal(24,6)"), 0).cast("decimal(24,0)")
    digits = F.abs(whole).cast("string")
    tail = F.right(digits, F.lit(3))
    lead = F.regexp_replace(digits, r"\d{3}$", "")
    lead = F.regexp_replace(lead, r"(?<=\d)(?=(\d{2})+$)", ",")
    indian = F.when(F.length(digits) > 3, F.concat(lead, F.lit(","), tail)).otherwise(digits)
    west = F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")
    sign = F.when(whole < 0, "-").otherwise("")
    cur = col(currency)
    return (
        F.when(col(c).isNull(), "")
        .when(cur == "INR", F.concat(F.lit(rupee_sign), sign, indian))
        .when(F.coalesce(cur, F.lit("")) != "", F.concat(cur, F.lit(" "), sign, west))
        .otherwise(F.concat(sign, west))
    )
