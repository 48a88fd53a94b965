"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

Equal vectors of a label are one class with a count, so copies cost nothing further on.  A rotation of the
principal axes is learned from a bounded sample so that signs make balanced binary codes.  The code is cut into
stretches, each the index of a table: classes of one label that share a stretch meet in that table's bucket, and
their original vectors are compared in double precision.  A pair is counted in the first table where it meets.
Buckets of more than ``CHUNK`` classes are dealt into chunks, and every two chunks meet in a task of their own:
nothing is dropped, no task holds more than two chunks, and only sums of links and a spanning forest leave a task.

Code stretches get longer as labels get larger (more rotations are learned when the bits run out), and a longer
stretch is missed more often; so there are as many tables (``TABLES`` at least) as keep the miss of a pair at
the threshold under ``MISS``.  The count takes a bit to differ as often as the side of a random plane does,
in angle / pi of all cases; the learned bits differ less often.  Vectors of a length that no label has more than
``EXACT`` of need no codes: each label is one bucket.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows of null label,
link with nothing and are components of their own; vectors of different lengths do not meet; rows that repeat an
id, or have none, are vectors like others: they link, and carry links on.  A component is named by its smallest
id (null if it has none); ``kept`` compares null-safely.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, bounded_sample, deal, discard, fits_broadcast, hot_keys, join_hot, materialise
from .components import connected_components, merge_labels

THRESHOLD = 0.93
TABLES, CHUNK, EXACT = 10, 4_096, 512
#: Share of the pairs at the threshold that may meet in no table, by the count of ``tables_for``.
MISS = 0.01
#: Bounds on the sample that a rotation is learned from (vectors, and numbers in all), and rows that a bucket is to hold.
SAMPLE, SAMPLE_VALUES, BUCKET = 20_000, 1 << 22, 32
ROUNDS = 40
BROADCAST_BYTES = 8 << 20


def itq(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """dim x bits projection: principal axes, then the rotation that moves data closest to +-1 corners."""
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, : min(bits, x.shape[1])]
    v = x @ axes
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
    for _ in range(ROUNDS):
        a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (a @ b).T
    return axes @ r


def tables_for(stretch: int, threshold: float) -> int:
    """Tables of so many bits each in which a pair at the threshold meets at least once, but for ``MISS``."""
    met = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** stretch
    return TABLES if met >= 1 else max(TABLES, math.ceil(math.log(MISS) / math.log1p(-met)))


class Quantiser:
    def __init__(self, sample: np.ndarray, stretch: int, threshold: float = THRESHOLD):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.tables = tables_for(stretch, threshold)
        dim, need, parts = sample.shape[1], self.tables * stretch, []
        for k in range(-(-need // dim)):
            parts.append(itq(centred, dim, k))
        self.projection = np.concatenate(parts, axis=1)[:, :need]
        self.weights = 1 << np.arange(stretch, dtype=np.int64)

    def stretches(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables bucket numbers."""
        bits = ((unit - self.mean) @ self.projection) >= 0
        return bits.reshape(len(unit), self.tables, -1) @ self.weights


class OneBucket:
    """All vectors of a label meet."""

    tables = 1

    def stretches(self, unit: np.ndarray) -> np.ndarray:
        return np.zeros((len(unit), 1), dtype=np.int64)


def unit_vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors of length 1 in double precision) of the usable vectors, one length at a time."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    offsets = column.offsets.to_numpy()
    size = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = values[offsets[rows][:, None] + np.arange(dim)]
        fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
        rows, x = rows[fine], x[fine]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _quantisers(rows: DataFrame, threshold: float) -> dict[int, Quantiser | OneBucket]:
    """By the length of vectors; all samples come in one collection."""
    sizes = rows.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n"))
    dims = {r["dim"]: r for r in sizes.groupBy("dim").agg(F.max("n").alias("largest"), F.sum("n").alias("total")).where("dim > 0").collect()}
    learned = {d: r for d, r in dims.items() if r["largest"] > EXACT}
    out: dict[int, Quantiser | OneBucket] = {d: OneBucket() for d in dims}
    if not learned:
        return out
    bounds = {d: (max(2, min(SAMPLE, SAMPLE_VALUES // (d * len(learned)))), r["total"]) for d, r in learned.items()}
    picked = bounded_sample(rows.withColumn("dim", F.size("embedding")), "dim", "embedding", bounds).orderBy("dim", "h").select("embedding").toArrow()
    found: dict[int, list[np.ndarray]] = {}
    for chunk in picked.column("embedding").chunks:
        for _, x in unit_vectors(chunk):
            found.setdefault(x.shape[1], []).append(x)
    for d, parts in found.items():
        stretch = int(min(30, max(6, math.ceil(math.log2(learned[d]["largest"] / BUCKET)))))
        out[d] = Quantiser(np.concatenate(parts), stretch, threshold)
    return out


def _links_of_run(x: np.ndarray, subs: np.ndarray, t: int, a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows a x b at or above the threshold that meet in no earlier table, block by block."""
    same = len(a) == len(b) and bool((a == b).all())
    for at in range(0, len(a), 1024):
        i, j = np.nonzero(x[a[at : at + 1024]] @ x[b].T >= threshold)
        i, j = a[at + i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        if t and len(i):
            new = (subs[i, :t] != subs[j, :t]).all(axis=1)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


_KEYS = ["label", "dim", "t", "sub", "a", "b"]


def _settle(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """cid, dst (a class of the same component), n (links) of the whole runs of equal keys of a frame."""
    key = frame[_KEYS].to_numpy()
    cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(frame)]))
    vec, codes, cid, count, own = (frame[c].to_numpy() for c in ("vec", "codes", "cid", "n", "own"))
    out = []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if e - s < 2:
            continue
        x = np.frombuffer(b"".join(vec[s:e]), dtype="<f8").reshape(e - s, -1)
        subs = np.frombuffer(b"".join(codes[s:e]), dtype="<i4").reshape(e - s, -1)
        _, _, t, _, a, b = key[s]
        left = np.flatnonzero(own[s:e] == a)
        right = left if a == b else np.flatnonzero(own[s:e] == b)
        weight, links, label = count[s:e].astype(np.float64), np.zeros(e - s), np.arange(e - s)
        for i, j in _links_of_run(x, subs, t, left, right, threshold):
            links += np.bincount(i, weight[j], e - s) + np.bincount(j, weight[i], e - s)
            label = merge_labels(label, i, j)
        hit = np.flatnonzero(links)
        if len(hit):
            out.append((cid[s:e][hit], cid[s:e][label[hit]], links[hit].astype(np.int64)))
    if not out:
        return pd.DataFrame({"cid": [], "dst": [], "n": []}, dtype="int64")
    return pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("cid", "dst", "n"))})


def _meet(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted rows; a run may continue in the next batch."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame[_KEYS].to_numpy()
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and rest and (rest[-1][_KEYS].iloc[-1].to_numpy() == key[0]).all():
            rest.append(frame)
            continue
        whole = [*rest, frame.iloc[:cut]]
        rest = [frame.iloc[cut:]]
        yield _settle(pd.concat(whole, ignore_index=True), threshold)
    if rest:
        yield _settle(pd.concat(rest, ignore_index=True), threshold)


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    shared = spark.sparkContext.broadcast(_quantisers(rows.where("label is not null and embedding is not null"), threshold))

    def encode(batches):
        for batch in batches:
            label = batch.column("label")
            vec, codes, dim = [None] * len(batch), [None] * len(batch), [0] * len(batch)
            labelled = label.is_valid().to_numpy(zero_copy_only=False)
            for at, unit in unit_vectors(batch.column("embedding")):
                own = shared.value.get(unit.shape[1]) if len(at) else None
                if own is None:
                    continue
                found = own.stretches(unit).astype("<i4")
                for k, u, c in zip(at.tolist(), unit.astype("<f8"), found, strict=True):
                    if labelled[k]:
                        vec[k], codes[k], dim[k] = u.tobytes(), c.tobytes(), unit.shape[1]
            arrays = [batch.column("vec_id"), label, pa.array(dim, pa.int32()), pa.array(vec, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "vec", "codes"])

    coded = rows.mapInArrow(encode, "vec_id long, label long, dim int, vec binary, codes binary")
    digest = F.md5(F.concat("vec", F.encode(F.concat_ws(":", F.col("label").cast("string"), F.col("dim").cast("string")), "utf-8")))
    coded = materialise(coded.withColumn("digest", digest), "itq-codes", TEXTS)
    usable = coded.where("vec is not null")
    classes = usable.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("label", "dim", "vec", "codes")), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "itq-classes")

    tables = F.transform(F.sequence(F.lit(0), (F.octet_length("codes") / 4).cast("int") - 1), lambda t: F.struct(t.alias("t"), F.substring("codes", 4 * t + 1, 4).alias("sub")))
    spread = classes.select("cid", "n", "label", "dim", "vec", "codes", F.explode(tables).alias("at")).select("cid", "n", "label", "dim", "vec", "codes", "at.t", F.conv(F.hex("at.sub"), 16, 10).cast("long").alias("sub"))
    bucket = ["label", "dim", "t", "sub"]
    large = spread.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > CHUNK)
    large = materialise(large.select(*bucket, F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")), "itq-large")
    if fits_broadcast(large, 64, BROADCAST_BYTES):
        large = F.broadcast(large)
    dealt = deal(spread.join(large, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))), F.col("chunks"), "cid").drop("chunks")
    dealt = dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    met = materialise(dealt.mapInPandas(lambda frames: _meet(frames, threshold), "cid long, dst long, n long"), "itq-links")
    links = met.groupBy("cid").agg(F.sum("n").alias("links"))
    joined = connected_components(met.select(F.col("cid").alias("src"), "dst")).withColumnRenamed("node", "cid")
    named = classes.select("cid", "digest", "n", "least").join(links, "cid", "left").join(joined, "cid", "left")
    named = materialise(named.select("digest", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "itq-named")
    smallest = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "itq-smallest")
    owner = materialise(join_hot(named, smallest, "component", hot_keys(named, "component")).select("digest", "n_links", "component_id"), "itq-owner")
    discard(classes, met, named, smallest)
    some = coded.where("digest is not null").select("vec_id", "digest")
    out = join_hot(some, owner, "digest", hot_keys(some, "digest")).select("vec_id", "n_links", "component_id")
    out = out.unionByName(coded.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
