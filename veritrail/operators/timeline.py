"""Chronological splits, purging and embargo.

Cuts fall on edges between dates, so where a row belongs follows from its date alone: everything here works
on the histogram of dates (one row per date) and compares rows with one broadcast row of bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DEFAULT_TRAIN_FRAC

KEY = "__key"
_PATTERNS = ("yyyyMMdd", "yyyy/M/d", "yyyy-M-d")


def date_key(df: DataFrame, date_col: str) -> Column:
    """The ordering key of a date column: timestamps as they are, dates as midnight, numbers and booleans as
    numbers, text parsed as ISO-8601 (null where it cannot be)."""
    kind = df.schema[date_col].dataType
    c = F.col(date_col)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return F.coalesce(c.try_cast("timestamp_ntz"), *(F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz") for p in _PATTERNS))
    return c


def date_sort_key(df: DataFrame, date_col: str) -> DataFrame:
    """df with the key; raises if a date is missing or is text that is not ISO-8601 (one aggregation)."""
    keyed = df.withColumn(KEY, date_key(df, date_col))
    bad = keyed.agg(
        F.count_if(F.col(date_col).isNull() | (F.isnan(date_col) if dict(df.dtypes)[date_col] in ("double", "float") else F.lit(False))).alias("missing"),
        F.count_if(F.col(date_col).isNotNull() & F.col(KEY).isNull()).alias("odd"),
    ).first()
    if bad["odd"]:
        raise TypeError(f"column {date_col!r} holds text that is not an ISO-8601 date")
    if bad["missing"]:
        raise ValueError(f"column {date_col!r} has missing dates")
    return keyed


def shifted(key: Column, kind: T.DataType, days: float) -> Column:
    """The key moved by days; on a numeric axis a day counts 86400e9 units (nanoseconds)."""
    if isinstance(kind, T.NumericType):
        return key + F.lit(int(days * 86_400 * 10**9))
    whole, secs = divmod(float(days) * 86_400, 86_400)
    return key + F.make_dt_interval(F.lit(int(whole)), F.lit(0), F.lit(0), F.lit(secs))


def histogram(keyed: DataFrame) -> DataFrame:
    """key, n, run_start, run_end, total: rows per date and their place in chronological order.

    The window has no partition: it runs over distinct dates, not rows.
    """
    counts = keyed.groupBy(KEY).agg(F.count("*").alias("n"))
    order = W.orderBy(KEY)
    end = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.select(KEY, "n", (end - F.col("n")).alias("run_start"), end.alias("run_end"), total.alias("total"))


def snapped(cut: Column) -> Column:
    """The nearer edge of the run that holds the cut; the start on a tie."""
    return F.when(cut - F.col("run_start") <= F.col("run_end") - cut, F.col("run_start")).otherwise(F.col("run_end"))


def split_bounds(keyed: DataFrame, train_frac: float = DEFAULT_TRAIN_FRAC) -> DataFrame:
    """One row: test_start (null if nothing is left to test) and cut (rows before it)."""
    if not 0 < train_frac < 1:
        raise ValueError(f"train_frac must lie between 0 and 1, not {train_frac}")
    hist = histogram(keyed)
    cut = F.floor(F.col("total") * F.lit(float(train_frac))).cast("long")
    inside = (cut > 0) & (cut >= F.col("run_start")) & (cut < F.col("run_end"))
    marked = hist.withColumn("at", F.max(F.when(inside, snapped(cut)).when(cut <= 0, F.lit(0))).over(W.partitionBy()))
    return marked.agg(F.min(F.when(F.col("run_start") >= F.col("at"), F.col(KEY))).alias("test_start"), F.max("at").alias("cut"))


def roles(keyed: DataFrame, bounds: DataFrame, purge_days: float = 0, embargo_days: float = 0) -> DataFrame:
    """keyed with role: train, purged, embargoed or test."""
    kind = keyed.schema[KEY].dataType
    key, start = F.col(KEY), F.col("test_start")
    before = start.isNull() | (key < start)
    purged = before & (key >= shifted(start, kind, -purge_days)) if purge_days > 0 else F.lit(False)
    held = ~before & (key < shifted(start, kind, embargo_days)) if embargo_days > 0 else F.lit(False)
    role = F.when(F.coalesce(purged, F.lit(False)), "purged").when(before, "train").when(held, "embargoed").otherwise("test")
    return keyed.crossJoin(F.broadcast(bounds.select("test_start"))).withColumn("role", role).drop("test_start")


def chronological_split(df: DataFrame, date_col: str, train_frac: float = DEFAULT_TRAIN_FRAC) -> tuple[DataFrame, DataFrame]:
    """(train, test): the earlier ``train_frac`` of the rows and the rest, never dividing a date."""
    keyed = date_sort_key(df, date_col)
    marked = roles(keyed, split_bounds(keyed, train_frac))
    return tuple(marked.where(F.col("role") == r).select(*df.columns) for r in ("train", "test"))


def apply_purge_embargo(train: DataFrame, test: DataFrame, date_col: str, purge_days: float = 0, embargo_days: float = 0) -> tuple[DataFrame, DataFrame, int, int]:
    """(train, test, n_purged, n_embargoed): leave out training rows in the ``purge_days`` before the first
    test date, and test rows in the ``embargo_days`` from it on."""
    if purge_days <= 0 and embargo_days <= 0:
        return train, test, 0, 0
    later = date_sort_key(test, date_col)
    start = later.agg(F.min(KEY).alias("test_start")).first()["test_start"]
    if start is None:
        return train, test, 0, 0
    kind = later.schema[KEY].dataType
    earlier = date_sort_key(train, date_col)
    keep_train = F.col(KEY) < shifted(F.lit(start).cast(kind), kind, -max(purge_days, 0)) if purge_days > 0 else F.lit(True)
    keep_test = F.col(KEY) >= shifted(F.lit(start).cast(kind), kind, max(embargo_days, 0)) if embargo_days > 0 else F.lit(True)
    dropped = [d.agg(F.count_if(~k).alias("n")).first()["n"] for d, k in ((earlier, keep_train), (later, keep_test))]
    return earlier.where(keep_train).select(*train.columns), later.where(keep_test).select(*test.columns), *dropped
