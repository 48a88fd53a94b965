import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest_words import sentence
from pyspark.sql import functions as F
from veritrail.llm import components, embeddings, lines, simhash, simhash_forest
from veritrail.llm.common import numbered


def brute_components(n, link):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if link(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def naive_fingerprint(text, words=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            found, word = (found + [word] if word else found), ""
        else:
            word += c
    if not found:
        return 0
    grams = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components(spark, messy, empty):
    big = 1 << 60
    near = [(big + 1, "one two three four"), (None, "one two three four"), (-5, "one two three four"), (big + 3, None), (8, "odd text here"), (8, "another text there")]
    both = messy.select("doc_id", "text", "fp").unionByName(spark.createDataFrame([(*r, 1) for r in near], "doc_id long, text string, fp int"))
    rows = simhash.simhash_components(both).collect()
    texts = sorted((naive_fingerprint(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in both.select("doc_id", "text").collect())
    assert sorted((r.fp % (1 << 64), r.doc_id is None, r.doc_id or 0) for r in rows) == texts
    prints = [r.fp % (1 << 64) for r in rows]
    label = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {k: min((r.doc_id for r, x in zip(rows, label) if x == k and r.doc_id is not None), default=None) for k in set(label)}
    assert [r.component_id for r in rows] == [least[k] for k in label] and -5 in least.values()
    assert simhash.simhash_components(empty).count() == 0


def test_links_go_through_rows_without_an_id(spark, monkeypatch):
    prints = {"a": 0, "b": 3, "c": 15}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs.replace({k: str(v) for k, v in prints.items()}, subset=["text"]).select("doc_id", F.col("text").cast("long").alias("fp")))
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    assert {r.component_id for r in simhash.simhash_components(df).collect()} == {1}


@pytest.mark.parametrize("split", [False, True])
def test_vantage_tree_finds_every_pair(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(simhash, "RESIDENTS", 100)
        monkeypatch.setattr(simhash, "GUESTS", 300)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]).view(np.int64))
    reps = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.near_edges(reps, 2)).collect()}
    label, bits = np.arange(len(fps)), fps.view(np.uint64)
    for at in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(bits[at : at + 500, None] ^ bits[None, :]) <= 2)
        label = components.merge_labels(label, a + at, b)
    assert [got.get(int(f), int(f)) for f in fps] == fps[label].tolist()


def shingles(text, words=5):
    found = (text or "").lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def near_texts(rng):
    texts = [sentence(rng, rng.choice([3, 6, 12, 40, 240])) for _ in range(60)]
    for k in range(60):  # words replaced, here and there or often
        words = texts[k].split()
        for at in range(rng.randrange(20), len(words), rng.choice([20, 40, 80, 160])):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    base = sentence(rng, 150).split()
    for k in range(60):  # a large family
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 4, 8])):
            words[at] = f"z{k}"
        texts.append(" ".join(words))
    shared = sentence(rng, 120)  # a passage that is half of each
    return texts + [shared + " " + sentence(rng, 120) for _ in range(20)] + ["", None, " "]


@pytest.mark.parametrize("split", [False, True])
def test_forest_groups_are_those_of_all_pairs(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(simhash_forest, "SHARD", 6)
        monkeypatch.setattr(simhash_forest, "CHUNK", 16)
        monkeypatch.setattr(simhash_forest, "CLASSES", 9)
    texts = near_texts(random.Random(9))
    rows = numbered(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), "test-rows")
    got = simhash_forest.similar_components(rows).join(rows.select("rid", "row.doc_id"), "rid").collect()
    found = {r.doc_id: r.component for r in got}
    sets = [shingles(t) for t in texts]
    label = brute_components(len(texts), lambda i, j: similar(sets[i], sets[j]))
    assert len({(found[i], label[i]) for i in range(len(texts))}) == len(set(label)) == len(set(found.values())) < len(texts)


def test_one_of_each_group_stays(spark, messy, empty):
    kept = simhash_forest.keep_one(messy)
    assert kept.columns == messy.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 in ids and 106 not in ids
    assert simhash_forest.keep_one(empty).count() == 0
    a, b = "a text of some words that stays", "quite another one with the same id"
    rows = [(5, a, 1), (5, b, 2), (None, a, 3), (-(1 << 60) - 1, b, 4), (None, "no id at all but kept", 5)]
    got = simhash_forest.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert sorted(r.row for r in got) == [1, 4, 5]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and len(got) == 101


def edit(rng, s):
    k = rng.randrange(len(s))
    return rng.choice([s[:k] + s[k + 1 :], s[:k] + "é" + s[k:], s[:k] + "#" + s[k + 1 :]])


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def line_pool(rng):
    pool = [sentence(rng, rng.randint(4, 12)) for _ in range(40)] + ["", "Les.", "Lez.", " ", "a" * 19, "a" * 20, "a" * 24, "b" * 18 + "x"]
    pool += [edit(rng, p) for p in pool[:25] for _ in range(2)] + ["a" * 25, "a" * 23 + "b"]
    long = sentence(rng, 300)  # several blocks
    return pool + [long, long[:400] + "#" + long[401:], long[:64] + long[65:], long[:-1], long + "é", long[:700] + "##" + long[702:]]


@pytest.mark.parametrize("seed", [3, 8])
def test_lines_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = line_pool(rng)
    ids = [*range(60), None, None, 3, 3, -7, (1 << 60) + 1]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in ids] + [(80, None), (81, ""), (82, "Les."), (83, "Les.\nLes.")]
    docs += [docs[4], docs[60]]  # whole rows again
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = df.withColumn("rid", F.monotonically_increasing_id()).collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.rid)):
        for k, x in enumerate((r.text or "").split("\n")):
            if x:
                first.setdefault(x, (r.doc_id is not None, r.doc_id or 0, r.rid, k))
    long = {x for x in first if len(x) >= lines.EDIT_CHARS}
    lost = {x for x in long if any(first[y] < first[x] and within_one(x, y) for y in long)}
    stays = lambda r, k, x: not x or (first[x][2:] == (r.rid, k) and x not in lost)
    want = Counter((r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if stays(r, k, x))) for r in rows)
    assert Counter((r.doc_id, r.text) for r in lines.dedup_lines(df).collect()) == want and lost


def test_sql_of_lines_covers_null_and_repeated_ids(spark):
    import duckdb

    rng = random.Random(5)
    pool = line_pool(rng)
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in [*range(20), None, None, 3, 3, -7]] + [(90, None), (None, "")]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": object})
    con = duckdb.connect()
    con.register("documents", documents)
    want = Counter(con.sql(lines.ORACLE.replace("string_split(text", "string_split(text::VARCHAR")).fetchall())
    got = lines.line_digest(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_unique_lines_of_a_repeated_id_stay(spark):
    line = "the quick brown fox jumps over it"
    df = spark.createDataFrame([(1, line), (5, line.replace("fox", "fax")), (5, "a unique line that nothing is near")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(df).collect()) == ["", "a unique line that nothing is near", line]


def test_very_long_lines(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long[:70_000] + "#" + long[70_001:]), (3, long[:60_000] + "##" + long[60_002:])], "doc_id long, text string")
    assert {r.doc_id: len(r.text) for r in lines.dedup_lines(df).collect()} == {1: 120_000, 2: 0, 3: 120_000}


def test_edits_are_told(spark):
    rng = random.Random(2)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
        b = a
        for _ in range(rng.randint(0, 2)):
            b = edit(rng, b) if b else "é"
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", lines._within_one(F.col("x"), F.col("y")).alias("near")).collect()
    assert all(r.near == within_one(r.x, r.y) for r in got)


def test_lines_of_messy_tables(messy, empty):
    done = lines.dedup_lines(messy)
    assert done.columns == messy.columns and done.count() == messy.count() and lines.dedup_lines(empty).count() == 0
    assert done.where("text is null").count() == messy.where("text is null").count()


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 24))
    near = base[:80] + rng.normal(scale=0.03, size=(80, 24))
    hot = base[0] + rng.normal(scale=0.02, size=(1300, 24))  # more than two chunks of one bucket
    return np.concatenate([base, near, hot])


def linked(rows, dim):
    """vec_id, n_links, component_id, kept by comparing all rows."""
    usable = [k for k, (_, v, label) in enumerate(rows) if v is not None and label is not None and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[k][1] for k in usable])
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([rows[k][2] for k in usable])
    link = (x @ x.T >= embeddings.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    part = components.merge_labels(np.arange(len(usable)), *np.nonzero(link))
    named = {p: min((rows[k][0] for k, q in zip(usable, part) if q == p and rows[k][0] is not None), default=None) for p in set(part.tolist())}
    place = {k: n for n, k in enumerate(usable)}
    found = [(i, int(link[place[k]].sum()), named[part[place[k]]]) if k in place else (i, 0, i) for k, (i, _, _) in enumerate(rows)]
    return Counter((i, n, c, i == c) for i, n, c in found)


@pytest.mark.parametrize("chunk", [embeddings.CHUNK, 200])
def test_embeddings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    x, big = vectors(), 1 << 60
    rows = [(i, [float(v) for v in r], 1 if i % 7 else 2) for i, r in enumerate([*x, *x[5:6].repeat(50, 0)])]
    rows += [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [None] * 24, 1), (5004, [1.0, 2.0], 1), (5005, rows[3][1], None)]
    rows += [(None, rows[3][1], 1), (big + 1, rows[10][1], 1), (big + 3, rows[10][1], 1), (-5, rows[20][1], 1), (-4, rows[20][1], 1), (None, rows[21][1], 2)]
    rows += [(7, rows[100][1], 1), (None, None, None), (None, [2.0] * 24, 9), (None, [2.5] * 24, 9)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, cid int").repartition(3)
    assert Counter(tuple(r) for r in embeddings.near_duplicates(df).collect()) == linked(rows, 24)


def test_null_ids_join_components(spark):
    v = [1.0, 2.0, 3.0]
    got = embeddings.near_duplicates(spark.createDataFrame([(1, v, 1), (2, v, 1), (None, v, 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False)}


def test_rows_at_the_threshold_link(spark):
    c = embeddings.THRESHOLD
    near, far = (math.sqrt(1 - x * x) for x in (c + 1e-12, c - 1e-12))
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [c + 1e-12, near, 0.0], 1), (3, [c - 1e-12, 0.0, far], 1)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_embeddings_meet_at_every_size():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 32)) * np.linspace(1, 0.2, 32)
    x = centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 32)) * np.linspace(0.6, 0.2, 32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a = x[:1000]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = embeddings.THRESHOLD * a + np.sqrt(1 - embeddings.THRESHOLD**2) * side / np.linalg.norm(side, axis=1)[:, None]
    for stretch in (6, 11, 15, 19, 22):  # labels of up to 2,048 to 134 million vectors
        q = embeddings.Quantiser(x, stretch)
        assert (q.stretches(a) == q.stretches(b)).any(axis=1).mean() > 0.95


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
