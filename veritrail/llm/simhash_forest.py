"""SimHash near-duplicates at a similarity of 0.8, where one vantage-point tree no longer prunes.

The similarity of two texts is the Jaccard similarity of their sets of five-word shingles.  Texts with equal sets
are a class.  Fingerprints only propose pairs of classes; a pair links if the sets themselves say so.

*Candidates.*  Texts of similarity 0.8 differ in about 15 of 100 fingerprint bits, unrelated ones in 50 give or
take 6; at such a radius every shard of a tree reaches every other.  So the tree (``simhash.near_edges``) finds the
closest pairs, of at most ``TREE_RADIUS`` of 64 bits, and a forest finds the rest: a class stands in one small
tree for each of ``BANDS`` keys, made of ``ROWS`` min-hashes of its shingles.  Two texts of similarity 0.8 miss all
common trees with a probability of 1 in 10,000.  Within a tree, classes are candidates at a distance of at most
``_radius`` of ``BITS`` bits: three standard deviations beyond what 0.8 gives, more for short texts, whose bits
vary more.  Small trees are searched many at a time.  A tree of more than ``SHARD`` classes has a vantage point, its
smallest id: classes near it are joined through it and not compared with each other; all others meet in chunks,
between the bounds that the triangle inequality sets.

*Verification.*  Candidate pairs make loose components.  The shingle sets of their classes are made once and meet
by component: the smallest id is compared with all others first, then any two classes that are not linked yet, so
that the links found have the closure of all pairs of a component at the similarity or above, and no other.
Components of many classes or large texts are dealt into chunks that meet two at a time.

Defined results: null texts count as empty; empty texts are a class; texts of fewer words than a shingle are one
shingle; of each group the row of the smallest id stays (a null id is the largest, of equal ids the row that is
read first); rows that repeat an id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, computed, deal, discard, fits_broadcast, hot_keys, join_hot, materialise, numbered
from .components import connected_components, merge_labels, spanning
from .simhash import SEED, majority_bits, near_edges, shingle_hashes

WORDS, SIMILARITY, TREE_RADIUS = 5, 0.8, 3
BITS, RADIUS = 256, 56
#: Sets smaller than this many shingles take a wider radius.
WIDER = ((16, BITS), (64, 72))
BANDS, ROWS = 18, 4
#: Classes of a small tree, rows of small trees in one task, classes in a chunk of a large tree.
SHARD, BUCKET, CHUNK = 1_024, 2_048, 16_384
#: Sets that are verified in one task: classes, and bytes of their shingles.
CLASSES, SET_BYTES = 4_096, 32 << 20
BROADCAST_BYTES = 32 << 20
_PRINTS = [f"f{k}" for k in range(BITS // 64)]
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_MULTIPLY, _FLIP = 2 * _MIX[0] + np.uint64(1), _MIX[1]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    return np.unique(shingle_hashes(text or "", words))


def _scramble(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sketch(h: np.ndarray) -> tuple:
    """Of a set: its digest and size, the fingerprint's 64-bit parts, the keys of the bands (none if it is empty)."""
    from xxhash import xxh3_128_hexdigest

    prints = [majority_bits(_scramble(h, k) if k else h) for k in range(BITS // 64)]
    if not len(h):
        return xxh3_128_hexdigest(b""), 0, *prints, []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[at : at + 2048, None] ^ _FLIP) * _MULTIPLY).min(axis=0))
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _scramble(key ^ rows[:, r], r + 1)
    return xxh3_128_hexdigest(h.tobytes()), len(h), *prints, key.view(np.int64).tolist()


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rid, digest, size, f0 .. f3, bands of numbered rows."""
    kinds = {"digest": "string", "size": "long", **dict.fromkeys(_PRINTS, "long"), "bands": "array<long>"}
    return computed(rows.select("rid", F.col("row.text").alias("text")), ["rid"], ["text"], lambda texts: [sketch(shingle_set(t, words)) for t in texts], kinds)


def _parts(frame: pd.DataFrame) -> np.ndarray:
    return frame[_PRINTS].to_numpy(dtype=np.int64).view(np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _radius(size: np.ndarray) -> np.ndarray:
    """The radius of pairs whose smaller set has this size."""
    return np.select([size < most for most, _ in WIDER], [r for _, r in WIDER], RADIUS)


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"src": ids[a], "dst": ids[b]})


def search_small(frame: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs within many small trees (key, rep, size, parts): rows are compared with those 1, 2, ..
    places further on; pairs that are joined already are passed over."""
    frame = frame.sort_values(["key", "rep"], kind="stable")
    key, parts, size = frame["key"].to_numpy(), _parts(frame), frame["size"].to_numpy()
    ids, node = np.unique(frame["rep"].to_numpy(), return_inverse=True)
    label, found = np.arange(len(ids)), []
    at, step = np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        new = at[label[node[at]] != label[node[at + step]]]
        near = new[_apart(parts[new], parts[new + step]) <= _radius(np.minimum(size[new], size[new + step]))]
        label, a, b = spanning(label, node[near], node[near + step])
        found.append((a, b))
    return _edges(ids, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))


def search_chunks(frame: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs between two chunks of a large tree (rep, size, parts, d: distance to the vantage point, inner:
    joined through it, own, a, b)."""
    frame = frame.sort_values(["d", "rep"], kind="stable")
    own, ids, d, size = (frame[c].to_numpy() for c in ("own", "rep", "d", "size"))
    parts = _parts(frame)
    a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
    left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
    inner = np.flatnonzero(frame["inner"].to_numpy())
    label = merge_labels(np.arange(len(ids)), inner, inner[:1].repeat(len(inner)))
    reach = d[right]
    found_a, found_b = [], []
    for at in range(0, len(left), 64):
        block = left[at : at + 64]
        widest = int(_radius(size[block]).max())
        low, high = np.searchsorted(reach, d[block[0]] - widest, "left"), np.searchsorted(reach, d[block[-1]] + widest, "right")
        other = right[low:high]
        near = _apart(parts[block, None], parts[None, other]) <= _radius(np.minimum(size[block, None], size[None, other]))
        i, j = np.nonzero(near & (label[block][:, None] != label[other][None, :]))
        label, x, y = spanning(label, block[i], other[j])
        found_a.append(x)
        found_b.append(y)
    none = np.zeros(0, dtype=np.int64)
    return _edges(ids, np.concatenate(found_a or [none]), np.concatenate(found_b or [none]))


def forest_edges(classes: DataFrame) -> DataFrame:
    """Candidate edges (src, dst) between classes (rep, size, f0 .. f3, bands) that share a band."""
    rows = classes.where("size > 0").select(F.explode("bands").alias("key"), "rep", "size", *_PRINTS)
    trees = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "forest-trees")
    if fits_broadcast(trees, 24, BROADCAST_BYTES):
        members = rows.join(F.broadcast(trees), "key")
    else:
        members = join_hot(rows, trees, "key", hot_keys(rows, "key"))
    members = materialise(members, "forest-members")

    small = members.where(F.col("n") <= SHARD)
    buckets = max(1, -(-small.count() // BUCKET))
    dealt = small.select("key", "rep", "size", *_PRINTS, F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    edges = dealt.groupBy("bucket").applyInPandas(search_small, "src long, dst long")

    large = members.where(F.col("n") > SHARD)
    vantage = materialise(large.groupBy("key").agg(F.min(F.struct("rep", "size", *_PRINTS)).alias("v")), "forest-vantage")
    if vantage.isEmpty():
        return edges
    seen = join_hot(large, vantage, "key", hot_keys(large, "key"))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"v.{c}"))) for c in _PRINTS[1:]), F.bit_count(F.col(_PRINTS[0]).bitwiseXOR(F.col(f"v.{_PRINTS[0]}"))))
    seen = seen.withColumn("d", apart.cast("long")).withColumns({"inner": F.col("d") <= RADIUS, "vantage": F.col("v.rep")}).drop("v")
    seen = materialise(seen, "forest-seen")
    tasks = deal(seen.select("key", "rep", "size", *_PRINTS, "d", "inner", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), F.col("chunks"), "rep").drop("chunks")
    found = tasks.groupBy("key", "a", "b").applyInPandas(search_chunks, "src long, dst long")
    return edges.unionAll(seen.where("inner").select(F.col("rep").alias("src"), F.col("vantage").alias("dst"))).unionAll(found)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (src, dst) between classes: of the tree of fingerprints, of equal ones, and of the forest."""
    some = classes.where("size > 0").select(F.col("f0").alias("fp"), "rep")
    plain = materialise(some.groupBy("fp").agg(F.min("rep").alias("first")), "forest-plain")
    equal = join_hot(some, plain, "fp", hot_keys(some, "fp")).where("rep <> first").select(F.col("rep").alias("src"), F.col("first").alias("dst"))
    near = materialise(near_edges(plain.select("fp"), TREE_RADIUS), "forest-near")
    src, dst = plain.select(F.col("fp").alias("src"), F.col("first").alias("a")), plain.select(F.col("fp").alias("dst"), F.col("first").alias("b"))
    near = join_hot(join_hot(near, src, "src", hot_keys(near, "src")), dst, "dst", hot_keys(near, "dst")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return near.unionAll(equal).unionAll(forest_edges(classes))


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, first: int | None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked sets, whose closure is that of all pairs of ``left`` x ``right`` at the similarity or
    above.  ``first`` is compared with all sets before."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(size)))
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(int(word.max()) + 1, dtype=bool)
    label = np.arange(len(sets))
    found_i, found_j = [], []

    def compare(i: int, others: np.ndarray) -> None:
        nonlocal label
        fits = (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])) & (label[others] != label[i])
        others = others[fits]
        if not len(others):
            return
        own = word[bounds[i] : bounds[i + 1]]
        mark[own] = True
        if 4 * len(others) < len(sets):
            shared = np.array([np.count_nonzero(mark[word[bounds[j] : bounds[j + 1]]]) for j in others], dtype=np.int64)
        else:
            shared = np.add.reduceat(mark[word], bounds[:-1], dtype=np.int64)[others]
        mark[own] = False
        alike = others[shared >= similarity * (size[i] + size[others] - shared)]
        if len(alike):
            found_i.append(np.full(len(alike), i))
            found_j.append(alike)
            label = merge_labels(label, alike, np.full(len(alike), i))

    if first is not None:
        compare(first, np.arange(len(sets)))
    same = len(left) == len(right) and bool((left == right).all())
    for k, i in enumerate(left):
        compare(int(i), right[k + 1 :] if same else right)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def _verify(table: pa.Table) -> pa.Table:
    """Links (src, dst) within the components of a task."""
    table = table.sort_by([("component", "ascending"), ("rid", "ascending")])
    rid, component, own = (table.column(c).to_numpy() for c in ("rid", "component", "own"))
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    sets = [np.frombuffer(s, dtype="<u8") for s in table.column("shingles").to_pylist()]
    cuts = np.concatenate(([0], np.flatnonzero(component[1:] != component[:-1]) + 1, [len(rid)]))
    src, dst = [], []
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        left = np.flatnonzero(own[s:e] == a)
        right = left if a == b else np.flatnonzero(own[s:e] == b)
        i, j = similar_pairs(sets[s:e], left, right, 0 if rid[s] == component[s] else None)
        src.append(rid[s:e][i])
        dst.append(rid[s:e][j])
    return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def verified_edges(rows: DataFrame, loose: DataFrame, words: int = WORDS) -> DataFrame:
    """Links between the classes of loose components (node, component), by their shingle sets."""
    loose = materialise(loose.select(F.col("node").alias("rid"), "component"), "forest-loose")
    side = F.broadcast(loose) if fits_broadcast(loose, 32, BROADCAST_BYTES) else loose
    texts = rows.select("rid", F.col("row.text").alias("text")).join(side, "rid")
    sets = materialise(computed(texts, ["rid", "component"], ["text"], lambda found: [(shingle_set(t, words).astype("<u8").tobytes(),) for t in found], {"shingles": "binary"}), "forest-sets", TEXTS)
    chunks = F.greatest(F.ceil(F.count("*") / CLASSES), F.ceil(F.sum(F.octet_length("shingles")) / SET_BYTES)).cast("int")
    large = materialise(sets.groupBy("component").agg(chunks.alias("chunks")).where("chunks > 1"), "forest-large")
    plan = F.broadcast(large) if fits_broadcast(large, 32, BROADCAST_BYTES) else large
    small = sets.join(plan, "component", "left_anti")
    size = small.agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("b")).first()
    tasks = max(1, -(-size["n"] // CLASSES), -(-(size["b"] or 0) // SET_BYTES))
    zero = F.lit(0)
    whole = small.select((-1 - F.pmod(F.xxhash64("component"), F.lit(tasks))).alias("grp"), zero.alias("a"), zero.alias("b"), zero.alias("own"), "component", "rid", "shingles")
    parts = deal(sets.join(plan, "component"), F.col("chunks"), "rid")
    # the smallest id of a component is there in every task
    count = F.col("chunks") - 1
    every = F.flatten(F.transform(F.sequence(zero, count), lambda x: F.transform(F.sequence(x, count), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    first = sets.where("rid = component").join(plan, "component").withColumn("t", F.explode(every)).select("component", "rid", "shingles", "t.a", "t.b", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int").alias("own"))
    parts = parts.where("rid <> component").select("component", "rid", "shingles", "a", "b", "own").unionByName(first)
    dealt = whole.unionByName(parts.withColumn("grp", F.col("component")))
    return dealt.groupBy("grp", "a", "b").applyInArrow(_verify, "src long, dst long")


def similar_components(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rid, component (a number that the rows of a group share) of numbered rows."""
    prints = materialise(sketches(rows, words), "forest-sketch", TEXTS)
    first = [F.first(c).alias(c) for c in ("size", *_PRINTS, "bands")]
    classes = materialise(prints.groupBy("digest").agg(F.min("rid").alias("rep"), *first), "forest-classes")
    loose = connected_components(candidate_edges(classes))
    joined = connected_components(verified_edges(rows, loose, words)).withColumnRenamed("node", "rep")
    owner = materialise(classes.select("digest", "rep").join(joined, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "forest-owner")
    keyed = prints.select("rid", "digest")
    out = materialise(join_hot(keyed, owner, "digest", hot_keys(keyed, "digest")).select("rid", "component"), "forest-components")
    discard(prints, classes, owner)
    return out


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of the rows that stay, one of each group of near-duplicates."""
    rows = numbered(docs, "forest-rows")
    groups = similar_components(rows, words)
    named = groups.join(rows.select("rid", F.col("row.doc_id").alias("id")), "rid")
    best = F.min(F.struct(F.col("id").isNull(), "id", "rid"))["rid"].alias("rid")
    stay = materialise(named.groupBy("component").agg(best).select("rid"), "forest-stay")
    gone = materialise(groups.join(stay, "rid", "left_anti").select("rid"), "forest-gone")
    side = F.broadcast(gone) if fits_broadcast(gone, 16, BROADCAST_BYTES) else gone
    return rows.join(side, "rid", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
