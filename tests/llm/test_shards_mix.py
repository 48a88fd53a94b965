import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from veritrail.llm import mixing, sharding

def size():
    return F.coalesce(F.octet_length("text"), F.lit(0))


def check_shards(rows, limit):
    held = defaultdict(list)
    for r in rows:
        held[r.shard_id].append(r)
    for name, some in held.items():
        total = sum(r.n_bytes for r in some)
        assert total <= limit or len(some) == 1
        assert all((r.shard_bytes, r.shard_rows) == (total, len(some)) for r in some)
    prefixes = [n for n in held if "#" not in n]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    return held


def test_shards_split_only_where_needed(messy, empty):
    rows = sharding.assign_shards(messy.select("doc_id", "text", "h", "depth"), ["doc_id"], size(), 4_000).collect()
    assert len(rows) == messy.count()
    held = check_shards(rows, 4_000)
    totals = defaultdict(int)
    for r in rows:
        bits = bin(int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
        assert bits.startswith(r.shard_id.split("#")[0])
        for d in range(61):
            totals[bits[:d]] += r.n_bytes
    assert all(n == "" or totals[n.split("#")[0][:-1]] > 4_000 for n in held)
    assert sharding.assign_shards(empty, ["doc_id"], size()).count() == 0


def test_equal_keys_overflow_into_pages(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 500 + [(2, "y")], "doc_id long, text string").repartition(6)
    rows = sharding.assign_shards(df, ["doc_id"], size(), 1_000).collect()
    held = check_shards(rows, 1_000)
    assert len(rows) == 501 and 50 <= len(held) <= 60


def test_rows_above_the_limit_do_not_thin_out_pages(spark):
    df = spark.createDataFrame([(1, "x")] * 50 + [(1, "y" * 5_000)] + [(1, "z" * 600)] * 4, "h long, text string").repartition(3)
    rows = sharding.assign_shards(df, ["h"], size(), 1_000).collect()
    held = check_shards(rows, 1_000)
    assert len(rows) == 55 and len(held) == 6 and {r.h for r in rows} == {1}


def test_copies_follow_the_inverted_distribution(messy, empty):
    got = mixing.mix(messy, ["doc_id", "source", "copy"]).collect()
    sizes = {r["source"]: r["bytes"] for r in mixing.source_sizes(messy).collect()}
    weight = {s: b**0.5 for s, b in sizes.items() if b}
    rate = {s: w / sum(weight.values()) * sum(sizes[x] for x in weight) / sizes[s] for s, w in weight.items()}
    want = Counter()
    for r in messy.select("doc_id", "source").collect():
        s, key, n = r.source or "", "" if r.doc_id is None else str(r.doc_id), 0
        if s not in rate:
            continue
        draws = max(1, math.ceil(rate[s] / mixing.STEP))
        lam = rate[s] / draws
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"{mixing.SEED}:{key}:{j}".encode()).hexdigest()[:15], 16) / 2**60
            k, p = 0, math.exp(-lam)
            c = p
            while u >= c and k < 500:
                k += 1
                p *= lam / k
                c += p
            n += k
        want[r.doc_id, r.source] += n
    have = Counter((r[0], r[1]) for r in got)
    assert have == +want and all(r[2] == 7 for r in got)
    assert mixing.mix(empty, ["doc_id"]).count() == 0


def test_target_shares_are_met(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("source"), F.lit("x" * 50).alias("text"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    out = mixing.replicate(df, mixing.rates(mixing.source_sizes(df), weights), ["doc_id", "source"])
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    many = mixing.rates(mixing.source_sizes(df), weights, volume=400.0)  # means far above a single draw's
    few = df.where("doc_id < 60")
    total = mixing.replicate(few, many, ["doc_id", "source"]).where("source = 'small'").count()
    assert abs(total / 6 - 2000) < 150


def test_shuffle_is_the_same_whatever_the_partitions(messy):
    a = mixing.mix(messy, ["doc_id"]).select("doc_id", "copy", "shuffle_key").collect()
    b = mixing.mix(messy.repartition(7), ["doc_id"]).select("doc_id", "copy", "shuffle_key").collect()
    assert Counter(a) == Counter(b)
