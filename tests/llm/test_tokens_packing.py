import random
import zlib
from collections import Counter

import numpy as np
from veritrail.llm import packing, token_counts
from veritrail.llm.common import scratch_path
from veritrail.llm.tokens import Encoder, encoder, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def library(text):
    return encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library():
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(0x3000), 0x4E2D, 0x1F600]] + ["'s", "'ll", "'", " ", "\n", "<|endoftext|>", "don't"] * 60
    code = Encoder(PATH)
    for _ in range(400):
        for letters in (alphabet, [c for c in alphabet if ord(c[0]) < 0x180]):
            s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert np.frombuffer(code.id_bytes(s), "<u4").tolist() == library(s), repr(s)


def test_best_fit_is_tight_and_whole():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins) and len(bins) <= 1.05 * max(-(-sum(sizes) // 100), sum(s > 50 for s in sizes))


def check_packing(docs, placed):
    rows = placed.collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(library(r.text or "") + [1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert all(v <= 4096 for v in bins.values())
    return len(bins), sum(bins.values())


def test_packing_places_every_piece_once(messy):
    n, tokens = check_packing(messy, packing.pack_documents(messy))
    assert n <= -(-tokens // 4096) + 2


def test_packing_in_many_partitions(messy):
    split = messy.repartition(40)  # three rounds
    n, tokens = check_packing(split, packing.pack_documents(split))
    assert n <= -(-tokens // 4096) + 2


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    got = packing.sequences(docs, packing.pack_documents(docs)).collect()
    flat = sorted(x for r in got for x in r.ids)
    assert flat == sorted(x for r in docs.collect() for x in [*library(r.text), 1])


def test_counts_and_cache(spark, messy, empty):
    path = scratch_path(spark, "cache")
    for _ in range(2):  # the second time everything is in the cache
        rows = token_counts.count_tokens(messy, path).collect()
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
        texts = [(r.doc_id, r.text or "") for r in messy.select("doc_id", "text").collect()]
        assert got == Counter((d, len(t.encode()), len(library(t)), len(library(t)) > 2048) for d, t in texts)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(empty).count() == 0
