"""SimHash near-duplicates, searched through a vantage-point tree.

Fingerprints that are equal form a class, and only classes are compared.  A tree of vantage points,
drawn from a bounded sample, divides the classes into shards by Hamming distance; each class lives in one
shard and visits the others whose distance bounds come within the radius (the triangle inequality leaves
no other place for a partner).  A shard orders its residents by distance to a pivot, so that a visitor
meets only the band of possible partners; what it finds is reduced to a forest before it leaves.

The tree gets deeper as classes get more, to ``MAX_DEPTH`` levels (its sample is bounded); shards that are larger
than ``RESIDENTS`` or have more than ``GUESTS`` visitors are dealt over tasks, each part of the residents
meeting each part of the visitors, so no pair is lost and no task grows with the table.

Defined results: null text counts as empty (fingerprint zero, linked like any other); equal texts share a
component; repeated rows stay rows; rows link through rows whose id is null or repeated like through any other;
a component is named by its smallest id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, computed, discard, hot_keys, join_hot, materialise, text_or_empty
from .components import connected_components, merge_labels

WORDS, RADIUS, SEED = 3, 2, 42
#: Bound on the sample that vantage points come from, and classes that a shard is to hold.
SAMPLE, SHARD = 1 << 20, 1_024
MAX_DEPTH = 16
#: Residents and visitors that meet in one task.
RESIDENTS, GUESTS = 8_192, 131_072
_BLOCK = 1 << 20


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), seed)] if found else [], dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in spans), np.uint64, len(found) - words + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half the hashes (none: zero)."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included."""
    return majority_bits(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp long."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return computed(source, ["doc_id"], ["text"], lambda texts: [(fingerprint(t, words),) for t in texts], {"fp": "long"})


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Balanced binary tree over a sample; leaves are shards 0 .. 2**depth - 1.

    Node n (root 1) has children 2n (distance <= bound) and 2n + 1.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros(1 << depth, dtype=np.uint64)
        self.bound = np.full(1 << depth, 64, dtype=np.int64)
        rng = np.random.default_rng(SEED)
        held = {1: sample}
        for node in range(1, 1 << depth):
            part = held.pop(node, sample[:0])
            if len(part):
                self.point[node] = part[rng.integers(len(part))]
                d = distance(part, self.point[node]).astype(np.int64)
                self.bound[node] = int(np.sort(d)[(len(d) - 1) // 2])
                near = d <= self.bound[node]
                if near.all() and d.max() > 0:  # ties: leave the farthest outside
                    self.bound[node] = int(d.max()) - 1
                    near = d <= self.bound[node]
                held[2 * node], held[2 * node + 1] = part[near], part[~near]

    def home(self, fps: np.ndarray) -> np.ndarray:
        node = np.ones(len(fps), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (distance(fps, self.point[node]) > self.bound[node])
        return node - (1 << self.depth)

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard that may hold something within the radius."""
        row, node = np.arange(len(fps)), np.ones(len(fps), dtype=np.int64)
        for _ in range(self.depth):
            d = distance(fps[row], self.point[node]).astype(np.int64)
            near, far = d - radius <= self.bound[node], d + radius > self.bound[node]
            row, node = np.concatenate([row[near], row[far]]), np.concatenate([2 * node[near], 2 * node[far] + 1])
        return row, node - (1 << self.depth)


def _links(residents: np.ndarray, guests: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(guest, resident) positions within the radius, block by block."""
    pivot = residents[0]
    far = distance(residents, pivot)
    order = np.argsort(far, kind="stable")
    ranked, keys = residents[order], far[order]
    reach = distance(guests, pivot).astype(np.int64)
    for d in np.unique(reach):
        low, high = np.searchsorted(keys, d - radius, "left"), np.searchsorted(keys, d + radius, "right")
        if low == high:
            continue
        who = np.flatnonzero(reach == d)
        for c in range(low, high, 8192):
            band = ranked[c : min(high, c + 8192)]
            step = max(1, _BLOCK // len(band))
            for at in range(0, len(who), step):
                g, r = np.nonzero(distance(guests[who[at : at + step], None], band[None, :]) <= radius)
                if len(g):
                    yield who[at + g], order[c + r]


def _search_shard(shard: pd.DataFrame, radius: int) -> pd.DataFrame:
    """A forest (src, dst) of the links between the residents of a shard's part and all rows dealt to it."""
    shard = shard.sort_values("fp", kind="stable")
    ids, node = np.unique(shard["fp"].to_numpy(), return_inverse=True)
    fps = ids.view(np.uint64)
    own, guest = np.unique(node[shard["own"].to_numpy()]), np.unique(node[shard["guest"].to_numpy()])
    label = np.arange(len(ids))
    if len(own):
        for g, r in _links(fps[own], fps[guest], radius):
            label = merge_labels(label, guest[g], own[r])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"src": ids[moved], "dst": ids[label[moved]]})


def near_edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (src, dst) between different fingerprints (a materialised column fp, no nulls) whose closure is that
    of all pairs within the radius."""
    spark = fps.sparkSession
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / SHARD)))))
    ratio = min(1.0, min(SAMPLE, 16 << depth) / max(1, n))
    chosen = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(ratio * (1 << 30))).select("fp").limit(2 * SAMPLE)
    sample = chosen.toPandas()["fp"].to_numpy(dtype=np.int64) if depth else np.zeros(0, dtype=np.int64)
    shared = spark.sparkContext.broadcast(VantageTree(np.sort(sample.view(np.uint64)), depth))

    def place(frames):
        tree = shared.value
        for frame in frames:
            for at in range(0, len(frame), 4096):
                fps = frame["fp"].to_numpy(dtype=np.int64)[at : at + 4096]
                home = tree.home(fps.view(np.uint64))
                row, shard = tree.visits(fps.view(np.uint64), radius)
                keep = shard <= home[row]  # of two shards, the later one's classes visit
                row, shard = row[keep], shard[keep]
                yield pd.DataFrame({"shard": shard, "home": shard == home[row], "fp": fps[row]})

    placed = materialise(fps.select("fp").mapInPandas(place, "shard long, home boolean, fp long"), "simhash-placed")
    # one row a shard: at most 2 ** MAX_DEPTH
    sizes = placed.groupBy("shard").agg(F.ceil(F.count_if("home") / RESIDENTS).cast("int").alias("parts"), F.ceil(F.count("*") / GUESTS).cast("int").alias("blocks"))
    sized = placed.join(F.broadcast(sizes.where("parts > 0")), "shard")
    part, block = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    task = lambda p, b, own, guest: F.struct(p.alias("part"), b.alias("block"), own.alias("own"), guest.alias("guest"))
    # a resident is there for every block of visitors, and is a visitor itself in its own block
    stays = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: task(part, b, F.lit(True), F.lit(False)))
    visits = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: task(p, block, F.lit(False), F.lit(True)))
    dealt = sized.select("shard", "fp", F.explode(F.when(F.col("home"), F.concat(stays, visits)).otherwise(visits)).alias("t")).select("shard", "fp", "t.*")
    return dealt.groupBy("shard", "part", "block").applyInPandas(lambda f: _search_shard(f, radius), "src long, dst long")


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = materialise(fingerprints(docs, words), "simhash-fp", TEXTS)
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-class")
    joined = connected_components(near_edges(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = materialise(reps.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-component")
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    owner = materialise(join_hot(named, least, "component", hot_keys(named, "component")).select("fp", "component_id"), "simhash-owner")
    discard(reps, named, least)
    return join_hot(prints, owner, "fp", hot_keys(prints, "fp")).select("doc_id", "fp", "component_id")
