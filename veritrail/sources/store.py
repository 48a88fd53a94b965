"""An append-and-deduplicate keyed store in CSV, the freshest row of a key winning.

The store is a folder (or a single file) of CSV parts with a header.  A write goes to a sibling folder; then the
store is renamed to ``<path>.old``, the new one takes its place and the old one goes.  A job that dies between the
two renames leaves the rows in ``<path>.old``: whoever looks at the store next moves them back first.  So the old
rows or the new ones are always there.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
# The texts that a reload takes for missing, as they are (blanks around them make them other texts).
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


class CorruptStoreError(ValueError):
    pass


def key_text(c: Column, kind: T.DataType) -> Column:
    """A key as text: missing stays missing, whole floating numbers lose their fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
        named = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(c.cast("string"))
        return F.when(x.isNull() | F.isnan(x), None).when(whole, F.when(whole, x).cast("long").cast("string")).otherwise(named)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def with_text_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumns({k: key_text(F.col(k), df.schema[k].dataType) for k in keys})


def combine(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; a column that differs in type becomes text.  ``__seq`` orders old before new."""
    kinds = dict(old.dtypes)
    clash = [c for c, t in new.dtypes if c in kinds and kinds[c] != t]
    as_text = lambda d: d.withColumns({c: F.col(c).cast("string") for c in clash}) if clash else d
    mark = lambda d, k: d.withColumn("__seq", F.struct(F.lit(k).alias("k"), F.monotonically_increasing_id().alias("i")))
    return mark(as_text(old), 0).unionByName(mark(as_text(new), 1), allowMissingColumns=True)


def keep_last(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The last row of every key by ``order``; null keys equal each other.  An aggregation (combined
    map-side), so a hot key costs no more than its partial results."""
    order = F.col(order) if isinstance(order, str) else order
    rest = F.struct(*(F.col(c) for c in df.columns))
    last = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max_by(rest, order).alias("row"))
    return last.select("row.*")


def keep_last_ranked(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The same by a ranking window."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def dedupe_and_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return keep_last(df, keys, "__seq").drop("__seq").orderBy(*(F.col(k).asc_nulls_last() for k in keys))


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, str(path).rstrip("/"), list(keys)
        self._jvm = spark.sparkContext._jvm
        self._at = self._path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _rename(self, source, target) -> None:
        if not self._fs.rename(source, target):
            raise OSError(f"{source} cannot be moved to {target}")

    def exists(self) -> bool:
        if self._fs.exists(self._at):
            return True
        old = self._path(f"{self.path}.old")
        if not self._fs.exists(old):
            return False
        self._rename(old, self._at)  # a write died between its two renames
        return True

    def size(self) -> int:
        return self._fs.getContentSummary(self._at).getLength()

    def read(self) -> DataFrame | None:
        """The stored rows, keys as text; None if there is no store or it is empty.  Raises
        CorruptStoreError for rows with more fields than the header (too few are filled with nulls)."""
        if not self.exists() or not self.size():
            return None
        options = {"header": True, "nullValue": "", "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
        head = self.spark.read.options(**options).csv(self.path)
        names = head.columns
        wide = ", ".join([*(f"`{n}` string" for n in names), "`__extra` string"])
        data = self.spark.read.schema(wide).options(**(options | {"enforceSchema": True})).csv(self.path)
        if not data.where("`__extra` is not null").isEmpty():
            raise CorruptStoreError(f"{self.path} has rows with more fields than its header")
        text = {n: F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")) for n in names}
        return self._typed(data.select(*(text[n].alias(n) for n in names)))

    def _typed(self, df: DataFrame) -> DataFrame:
        """Columns that are no keys become numbers or booleans if every value is one."""
        rest = [c for c in df.columns if c not in self.keys]
        if not rest:
            return df
        tests = {"bigint": "^[+-]?[0-9]{1,18}$", "double": "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^-?inf$", "boolean": "^(True|False|true|false)$"}
        fits = df.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(t)), F.lit(False)).alias(f"{i}_{k}") for i, c in enumerate(rest) for k, t in tests.items())).first()
        kind = {c: next((k for k in tests if fits[f"{i}_{k}"]), "string") for i, c in enumerate(rest)}
        return df.select(*(F.col(f"`{c}`").cast(kind.get(c, "string")).alias(c) for c in df.columns))

    def quarantine(self) -> str:
        backup = f"{self.path}.corrupt-{datetime.now():%Y%m%dT%H%M%S%f}"
        self._rename(self._at, self._path(backup))
        return backup

    def write(self, df: DataFrame) -> None:
        """Write beside the store, then swap; nothing is left behind if the write fails."""
        staged, old = self._path(f"{self.path}.tmp-{datetime.now():%Y%m%dT%H%M%S%f}"), self._path(f"{self.path}.old")
        try:
            form = {"header": True, "nullValue": "", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
            df.write.options(**form).csv(staged.toString())
            self._fs.delete(self._path(f"{staged.toString()}/_SUCCESS"), False)
            if self.exists():  # from here on ``old`` is what an earlier write has replaced
                self._fs.delete(old, True)
                self._rename(self._at, old)
            self._rename(staged, self._at)
            self._fs.delete(old, True)
        except Exception:
            self._fs.delete(staged, True)
            self.exists()
            raise


def append_dedup(new_rows: DataFrame, store_path: str, dedup_cols: Sequence[str], verbose: bool = True) -> DataFrame:
    """Append rows to the store, keep the last row of every key, sort by the keys as text; returns what is
    stored now.  An empty store is rebuilt, a corrupt one is moved aside first; missing key columns raise
    before anything is written."""
    store = KeyedStore(new_rows.sparkSession, store_path, dedup_cols)
    say = log.info if verbose else log.debug
    old, broken = None, False
    try:
        old = store.read()
    except CorruptStoreError as e:
        broken = True
        log.warning("%s", e)
    if new_rows.isEmpty():
        say("no new rows for %s", store_path)
        return old if old is not None else new_rows
    columns = [*(old.columns if old is not None else []), *new_rows.columns]
    missing = [c for c in dedup_cols if c not in columns]
    if missing:
        raise ValueError(f"key columns {missing} are not among the columns {columns}")
    if broken:
        log.warning("moved to %s; rebuilding from the new rows", store.quarantine())
    keyed = lambda d: with_text_keys(d, [k for k in dedup_cols if k in d.columns])
    both = combine(keyed(old if old is not None else new_rows.limit(0)), keyed(new_rows))
    store.write(dedupe_and_sort(both, dedup_cols))
    done = store.read()
    say("wrote %s", store_path)
    return done if done is not None else new_rows.limit(0)
