"""User filter / sort / page DSL (F4-F11), applied with the Column API.

Fields are checked against a whitelist of output columns, values are typed
literals (never spliced into SQL text), and ``contains`` escapes ``%`` / ``_``.
Filters run after aggregation (HAVING). Paging is per key group via
``row_number`` over a partitioned window, so no page is computed on one task
for the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # "eq" | "contains" | "between"
    value: object = None
    hi: object = None

    @staticmethod
    def eq(field: str, value) -> "Filter":
        return Filter(field, "eq", value)

    @staticmethod
    def contains(field: str, value: str) -> "Filter":
        return Filter(field, "contains", value)

    @staticmethod
    def between(field: str, lo, hi) -> "Filter":
        """Inclusive; None leaves a side open."""
        return Filter(field, "between", lo, hi)

    def column(self) -> Column:
        c = F.col(self.field)
        if self.op == "eq":
            return c == F.lit(self.value)
        if self.op == "contains":
            esc = str(self.value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            return c.ilike(f"%{esc}%")
        if self.op == "between":
            sides = [c >= F.lit(self.value)] * (self.value is not None) + [c <= F.lit(self.hi)] * (self.hi is not None)
            return reduce(lambda a, b: a & b, sides, F.lit(True))
        raise ValueError(f"unknown filter op {self.op}")


def apply_filters(df: DataFrame, filters: list[Filter], allowed: set[str] | None = None) -> DataFrame:
    allowed = allowed if allowed is not None else set(df.columns)
    for f in filters:
        if f.field not in allowed:
            raise ValueError(f"unknown filter field {f.field}")
        df = df.filter(f.column())
    return df


def sort_columns(sort: list[tuple[str, str]], allowed: set[str], tie_breaker: str | None = None) -> list[Column]:
    """``[(field, 'asc'|'desc')]`` -> Columns; unknown field is an error, missing order means ASC."""
    cols = []
    for field, order in sort:
        if field not in allowed:
            raise ValueError(f"unknown sort field {field}")
        cols.append(F.col(field).desc() if (order or "asc").lower() == "desc" else F.col(field).asc())
    if tie_breaker:
        cols.append(F.col(tie_breaker).asc())
    return cols


def page(df: DataFrame, keys: list[str], order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """LIMIT/OFFSET per key group (rows ``offset+1 .. offset+limit`` in ``order``); all rows without a limit."""
    if limit is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit)).drop("_rn"))


def with_total(df: DataFrame, keys: list[str], out: str = "total_row_count") -> DataFrame:
    """``count() OVER ()`` per key group, counted map-side and joined back, so no task holds a group; without keys a
    scalar subquery."""
    if not keys:
        return df.select("*", df.agg(F.count(F.lit(1))).scalar().alias(out))
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)


def eq_filter(df: DataFrame, values: dict) -> DataFrame:
    """equality on key columns, typed literals."""
    for c, v in values.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def in_filter(df: DataFrame, col: str, values) -> DataFrame:
    """``col IN (...)``; a DataFrame of ids becomes a semi join (no driver-side list for long inputs)."""
    if isinstance(values, DataFrame):
        ids = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(ids, col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def range_filter(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """inclusive range on a timestamp / date / number column (pushed to the scan)."""
    return df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))


def one_row_for(df: DataFrame, key: str, value, defaults: dict) -> DataFrame:
    """The single-entity answer -- exactly one row for ``key = value``, defaults when there is none.

    (The service's aggregate without GROUP BY returns a row of zeros for an
    unknown seller or an empty category; a keyed aggregate returns nothing.)
    """
    spark = df.sparkSession
    probe = spark.range(1).select(F.lit(value).alias(key))
    out = probe.join(df.filter(F.col(key) == F.lit(value)), key, "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def rows_for(df: DataFrame, keys: DataFrame, defaults: dict) -> DataFrame:
    """A14 / K15 for many keys at once: a row for every distinct key of ``keys`` (its columns are the key), with
    ``defaults`` where ``df`` has none; columns without a default stay null."""
    key = keys.columns
    out = keys.distinct().join(df, key, "left")
    return out.select(*key, *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                              for c in df.columns if c not in key])
