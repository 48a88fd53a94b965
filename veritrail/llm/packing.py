"""Best-fit packing of token sequences: hierarchical, with residual bins as items of later rounds.

Round 0 packs every scan partition on its own (best fit, longest first, in windows of bounded size) and
emits bins that are nearly full.  The underfull bins, a bounded number per group, become items of the
next round, where groups of ``fan_in`` neighbours are packed together; rounds go on until one group is
left.  Texts never move between machines: only piece records do, and those only for underfull bins.

Defined results: a null or empty text is one piece that holds the end token alone; a text longer than
the capacity is cut into capacity-sized pieces, the last one shorter; repeated rows are packed as often
as they occur; ids are carried exactly, null ones stay null; an empty table gives an empty result; only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, TEXTS, computed, materialise, text_or_empty, trim
from .tokens import encoder, vocabulary

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bins with at most this much room are final.
NEARLY_FULL = 16
#: Groups that are packed together in a round, and underfull bins that a group hands on; bins beyond
#: that are final too (no row is lost, only a chance to fill them further).
FAN_IN, MAX_OPEN = 16, 128
#: Pieces that are held at a time in round 0.
WINDOW = 200_000

_ITEMS = ("doc_ids", "pieces", "starts", "lengths", "crcs", "offsets")
_SCHEMA = pa.schema(
    [("grp", pa.int64()), ("sequence_id", pa.int64()), ("open", pa.bool_()), ("used", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))]
    + [(name, pa.list_(pa.int64())) for name in ("starts", "lengths", "crcs", "offsets")]
)
_BINS = (
    "grp long, sequence_id long, open boolean, used long, doc_ids array<long>, pieces array<int>, "
    "starts array<long>, lengths array<long>, crcs array<long>, offsets array<long>"
)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin.

    The bins that have room r hang in ``room[r]``; a bit set of the rooms that occur finds the
    tightest one that is large enough in a few machine operations.
    """
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    present, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        rest = present >> size
        if rest:
            r = (rest & -rest).bit_length() - 1 + size
            bin_ = room[r].pop()
            if not room[r]:
                present &= ~(1 << r)
        else:
            r, bin_ = capacity, []
            bins.append(bin_)
        bin_.append(i)
        if r > size:
            room[r - size].append(bin_)
            present |= 1 << (r - size)
    return bins


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the pieces of one document's ids."""
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def _bin_row(grp: int, number: int, is_open: bool, items: list[tuple]) -> tuple:
    offsets, at = [], 0
    for it in items:
        offsets.append(at)
        at += it[3]
    return (grp, number, is_open, at, *(list(col) for col in zip(*items, strict=True)), offsets)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _settle(packed: list[list[tuple]], grp: int, first: int, capacity: int, last: bool) -> tuple[list[tuple], list[list[tuple]]]:
    """Split bins into rows of final ones and the items of those that stay open (most room first)."""
    order = sorted(packed, key=lambda items: sum(it[3] for it in items))
    keep = 0 if last else min(MAX_OPEN, sum(capacity - sum(it[3] for it in b) > NEARLY_FULL for b in order))
    rows = [_bin_row(grp, first + k, False, items) for k, items in enumerate(order[keep:])]
    return rows, order[:keep]


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    end = end_id.to_bytes(4, "little")
    held: list[list[tuple]] = []
    waiting: list[tuple] = []
    grp = base = None

    def pack(held, waiting):
        groups = [*held, *([w] for w in waiting)]
        packed = best_fit([sum(it[3] for it in g) for g in groups], capacity)
        return [[it for k in b for it in groups[k]] for b in packed]

    for part in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
        if grp is None:
            grp = part.column("grp")[0].as_py()
            base = grp << 32
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            waiting.extend((doc_id, *p) for p in cut(code.id_bytes(text) + end, capacity))
        if len(waiting) >= WINDOW:
            rows, held = _settle(pack(held, waiting), grp, base, capacity, False)
            waiting, base = [], base + len(rows)
            yield _batch(rows)
    if grp is not None:
        rows, held = _settle(pack(held, waiting), grp, base, capacity, False)
        base += len(rows)
        rows += [_bin_row(grp, base + k, True, items) for k, items in enumerate(held)]
        for at in range(0, len(rows), 2000):
            yield _batch(rows[at : at + 2000])
    trim()


def _merge_group(table: pa.Table, level: int, capacity: int, last: bool) -> pa.Table:
    grp = table.column("grp")[0].as_py() // FAN_IN
    table = table.sort_by("sequence_id")
    groups = [list(zip(*cols, strict=True)) for cols in zip(*(table.column(name).to_pylist() for name in _ITEMS[:-1]), strict=True)]
    packed = best_fit([sum(it[3] for it in g) for g in groups], capacity)
    bins = [[it for k in b for it in groups[k]] for b in packed]
    base = (level << 56) + (grp << 32)
    rows, held = _settle(bins, grp, base, capacity, last)
    rows += [_bin_row(grp, base + len(rows) + k, True, items) for k, items in enumerate(held)]
    return pa.Table.from_batches([_batch(rows)])


def _merger(level: int, capacity: int, last: bool):
    return lambda table: _merge_group(table, level, capacity, last)


def pack_documents(docs: DataFrame, vocabulary_name: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every piece of every document in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """

    def pack(batches):
        return _pack_partition(batches, vocabulary(vocabulary_name), capacity, end_id)

    source = docs.select(F.spark_partition_id().cast("long").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    bins = materialise(source.mapInArrow(pack, _BINS), "pack-0", TEXTS)
    done, level = [bins.where("not open")], 0
    groups = bins.agg(F.max("grp").alias("top")).first()["top"]
    groups = 0 if groups is None else groups + 1
    while True:
        level, groups = level + 1, -(-groups // FAN_IN)
        last = groups <= 1
        bins = bins.where("open").groupBy(F.expr(f"grp div {FAN_IN}")).applyInArrow(_merger(level, capacity, last), _BINS)
        if last:
            done.append(bins)
            break
        bins = materialise(bins, f"pack-{level}")
        done.append(bins.where("not open"))
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    zipped = F.arrays_zip(*(F.col(c) for c in _ITEMS))
    return every.select("sequence_id", F.explode(zipped).alias("p")).select(
        F.col("p.doc_ids").alias("doc_id"),
        F.col("p.pieces").alias("piece"),
        F.col("p.starts").alias("start"),
        F.col("p.lengths").alias("length"),
        F.col("p.crcs").alias("ids_crc32"),
        "sequence_id",
        F.col("p.offsets").alias("offset"),
    )


def sequences(docs: DataFrame, placed: DataFrame, vocabulary_name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int>, doc_ids in order.

    For tables with unique ids and without null ones: the pieces are cut from the documents again and gathered per sequence.
    """

    def ids_of(texts):
        code, end = encoder(vocabulary(vocabulary_name)), end_id.to_bytes(4, "little")
        return [(code.id_bytes(t) + end,) for t in texts]

    coded = computed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), ["doc_id"], ["text"], ids_of, {"ids": "binary"})
    part = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    rows = placed.join(coded, "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    ordered = F.array_sort(F.collect_list("p"))

    def joined(every):
        return [(np.frombuffer(b"".join(parts), dtype="<u4").astype("int32").tolist(),) for parts in every]

    whole = rows.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.ids").alias("parts"))
    return computed(whole, ["sequence_id", "doc_ids"], ["parts"], joined, {"ids": "array<int>"})
