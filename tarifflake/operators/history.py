"""What one line does to a rate key's state, for the library as keyed stream state.

The state is the key's live rates and, of the past, one remembered row per distinct date range and season. The batch form
of the same rules is ``ownership``.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import keyed

ONE = dt.timedelta(days=1)
TERM = ["amount", "currency", "basis", "taxes_included"]
OUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # live | closed | past | change
        T.StructField("rate_key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("currency", T.StringType()),
        T.StructField("basis", T.StringType()),
        T.StructField("taxes_included", T.BooleanType()),
        T.StructField("season_name", T.StringType()),
        T.StructField("valid_from", T.DateType()),
        T.StructField("valid_to", T.DateType()),
        T.StructField("replaced_by", T.LongType()),
        T.StructField("previous_rate_id", T.StringType()),
        T.StructField("change_pct", T.DecimalType(12, 1)),
        T.StructField("change", T.StringType()),
        T.StructField("pieces", T.IntegerType()),
    ]
)
COLUMNS = OUT.fieldNames()


def _season(s) -> str:
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", (s or "").lower()).split())


def _a_year_on(d: dt.date) -> dt.date:
    return d.replace(year=d.year + 1, day=min(d.day, 28) if d.month == 2 else d.day)


def closeness(row: dict, new: dict) -> tuple | None:
    """How near an earlier row stands to a new line, as a tuple to compare: the rule that joins them (3 shared dates,
    2 the same season, ended before, 1 shared dates after a year), then what that rule prefers. None: unrelated."""

    def days(start: dt.date, end: dt.date) -> int:
        return (min(end, new["valid_to"]) - max(start, new["valid_from"])).days + 1

    newest = (row["seq"], row["id"])
    if (shared := days(row["valid_from"], row["valid_to"])) > 0:
        return (3, row["kind"] == "live", shared, *newest)
    if row["valid_to"] >= new["valid_from"]:
        return None
    if _season(row["season_name"]) and _season(row["season_name"]) == _season(new["season_name"]):
        return (2, False, row["valid_to"].toordinal(), *newest)
    again = days(_a_year_on(row["valid_from"]), _a_year_on(row["valid_to"]))
    return (1, False, again, *newest) if again > 0 else None


def stretches(row: dict, f: dt.date, t: dt.date) -> list[tuple[dt.date, dt.date]]:
    """What is left of a row's dates without f..t."""
    parts = [(row["valid_from"], min(row["valid_to"], f - ONE)), (max(row["valid_from"], t + ONE), row["valid_to"])]
    return [(a, b) for a, b in parts if a <= b]


def _terms(row: dict) -> list:
    return [row[c] for c in TERM]


def apply_line(live: list[dict], past: dict, new: dict, out: list[dict]) -> list[dict]:
    """Folds one line into a key's state; appends closed rows and the change to ``out``; returns the live rows. Rows of
    the line's own sheet are left alone."""
    f, t = new["valid_from"], new["valid_to"]
    others = [r for r in live if r["document_id"] != new["document_id"]]
    if any(_terms(r) == _terms(new) and r["valid_from"] <= f and t <= r["valid_to"] for r in others):
        out.append({**new, "kind": "change", "change": "same"})
        return live
    earlier = [*others, *(r for r in past.values() if r["document_id"] != new["document_id"])]
    score, prev = max(((c, r) for r in earlier if (c := closeness(r, new))), key=lambda x: x[0], default=(None, None))
    kind = "new"
    if prev is not None:
        moved = "extended" if _terms(prev) == _terms(new) else ("up" if new["amount"] > prev["amount"] else "down")
        kind = moved if score[0] == 3 else "new_season"
        pct = (new["amount"] - prev["amount"]) * 100 / prev["amount"] if prev["amount"] else None
        new = {**new, "previous_rate_id": prev["id"], "change_pct": None if pct is None else Decimal(pct).quantize(Decimal("0.1"), ROUND_HALF_UP)}
    kept = []
    for r in live:
        if r["document_id"] == new["document_id"] or r["valid_to"] < f or t < r["valid_from"]:
            kept.append(r)
            continue
        left = stretches(r, f, t)
        if not left:
            closed = {**r, "kind": "closed", "replaced_by": new["document_id"]}
            out.append(closed)
            past[(r["valid_from"], r["valid_to"], _season(r["season_name"]))] = {**closed, "kind": "past"}
        # the first stretch keeps the id; a second one is a numbered copy
        for i, (a, b) in enumerate(left):
            number = r["pieces"] + len(left) - 1
            own = {"id": f"{r['id']}/{number}", "pieces": 0} if i else {"pieces": number}
            kept.append({**r, "valid_from": a, "valid_to": b, **own})
    out.append({**new, "kind": "change", "change": kind})
    kept.append({**new, "kind": "live", "pieces": 0})
    return kept


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})


def _records(df: pd.DataFrame) -> list[dict]:
    def clean(v):
        return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v

    cols = {c: df[c].tolist() for c in df.columns}
    out = [{k: clean(v) for k, v in zip(cols, row, strict=True)} for row in zip(*cols.values(), strict=True)]
    for r in out:
        for c in ("document_id", "seq", "replaced_by", "pieces"):
            r[c] = None if r[c] is None else int(r[c])
        r["taxes_included"] = None if r["taxes_included"] is None else bool(r["taxes_included"])
    return out


def as_lines(lines: DataFrame) -> DataFrame:
    """Sheet lines in the shape of the ledger."""
    k = keyed(lines) if "rate_key" not in lines.columns else lines
    ident = F.concat_ws("-", F.col("document_id").cast("string"), F.col("line_no").cast("string"))
    have = {"kind": F.lit("line"), "id": ident, "root_id": ident, "seq": F.col("approval_seq"), "pieces": F.lit(0)}
    given = ["rate_key", "document_id", "season_name", "valid_from", "valid_to", *TERM]
    return k.select(*[have[f.name].cast(f.dataType).alias(f.name) if f.name in have else (F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name)) for f in OUT])
