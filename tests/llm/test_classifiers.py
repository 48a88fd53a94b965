import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from conftest_words import WORDS, sentence
from pyspark.sql import functions as F
from veritrail.llm import langid, toxicity
from veritrail.llm.common import bounded_sample

FOREIGN = "und der die nicht wasser brücke straße fenster garten brief papier morgen tisch silber vogel geschichte nacht über".split()


def languages(spark, n=240):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(5, 60)) if i % 2 else " ".join(rng.choice(FOREIGN) for _ in range(rng.randint(5, 60))), "en" if i % 2 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_is_told_apart(spark):
    df = languages(spark)
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 240 and held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and np.mean([not r.rejected for r in got]) > 0.95


def test_language_of_messy_tables(spark, messy, empty):
    got = langid.identify(messy).collect()
    assert len(got) == messy.count()
    by = {r.doc_id: r for r in got}
    for k in (100, 101, 102, 104):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"} and langid.identify(empty).count() == 0
    blank = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}
    kept = langid.keep_identified(messy)
    assert kept.columns == messy.columns and {100, 101, 102, 104}.isdisjoint(r.doc_id for r in kept.collect())


def test_subwords_do_not_depend_on_blocks(monkeypatch):
    text = sentence(random.Random(1), 3000)
    whole = np.bincount(np.concatenate(list(langid.subwords(text))), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "_BLOCK", 997)
    assert (np.bincount(np.concatenate(list(langid.subwords(text))), minlength=langid.BUCKETS) == whole).all()


def toxic_table(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(500):
        words = sentence(rng, rng.randint(20, 120)).split()
        bad = i % 4 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blithering", "nincompoop", "scoundrel", "wretched"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_toxic_windows_are_found_without_a_list():
    rng = random.Random(12)

    def text(bad=()):
        words = sentence(rng, rng.randint(20, 40)).split()
        for _ in range(6 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    bad = ["blithering", "nincompoop", "scoundrel", "wretched"]
    model = toxicity.train([text(bad) for _ in range(1400)] + [text() for _ in range(4200)], [1] * 1400 + [0] * 4200, 0.2)
    assert np.mean([toxicity.score(text(bad), model) >= toxicity.DECISION for _ in range(100)]) > 0.9
    assert np.mean([toxicity.score(text(), model) >= toxicity.DECISION for _ in range(200)]) < 0.02


def test_scores_follow_from_compressed_lengths():
    rng = random.Random(3)
    ordinary = [sentence(rng, 60) for _ in range(400)]
    toxic = [sentence(rng, 30) + " blithering nincompoop " + sentence(rng, 30) for _ in range(200)]
    model = toxicity.train(toxic + ordinary, [1] * 200 + [0] * 400, 0.3)
    text = sentence(rng, 50) + " nincompoop and " + sentence(rng, 50)
    assert zstandard.ZstdCompressionDict(model.ordinary).dict_id() and len(model.toxic) == 2  # trained, not plain text

    def length(window, dictionary):
        content = zstandard.ZstdCompressionDict(dictionary)
        shape = zstandard.ZstdCompressionParameters(
            window_log=21, chain_log=18, hash_log=18, search_log=5, min_match=7, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        content.precompute_compress(compression_params=shape)
        return len(zstandard.ZstdCompressor(dict_data=content, compression_params=shape).compress(window))

    words = text.lower().split()
    found = [f" {' '.join(words[k : k + toxicity.WINDOW])} ".encode() for k in range(0, len(words), toxicity.WINDOW)]
    saved = []
    for w in found:
        gains = [length(w, model.ordinary) - length(w, model.ordinary + t) for t in model.toxic]
        saved.append(min(gains) if gains[0] > 0 else gains[0])
    assert max(saved) >= 2 and toxicity.saved(found, model).tolist() == saved
    top = sorted(saved)[::-1]
    parts = [top[0], sum(top[:3]) / 3, math.log(1 + len(saved)), sum(saved) / len(saved), *(math.log(1 + sum(x >= s for x in saved)) for s in toxicity.STEPS)]
    logit = sum(a * b for a, b in zip(parts, model.weights, strict=False)) + model.weights[-1]
    assert abs(toxicity.score(text, model) - 1 / (1 + math.exp(-logit))) < 1e-9


def test_samples_are_bounded_by_text(spark):
    rows = [(None, f"text {k % 3000}", "en" if k % 2 else "de") for k in range(12_000)] + [(7, "the same text", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = bounded_sample(df, "lang", "text", {"en": (200, 9000), "de": (100, 6000)}).collect()
    assert len(got) == len({(r.lang, r.text) for r in got}) and 0 < sum(r.lang == "en" for r in got) <= 200 and 0 < sum(r.lang == "de" for r in got) <= 100
    few = bounded_sample(df, "lang", "text", {"en": (200, 9000)}, 100).collect()
    assert {r.lang for r in few} == {"en"} and sum(len(r.text) for r in few) <= 100


def test_letters_are_letters(spark):
    assert [langid.has_letter(t) for t in ("½ ² Ⅷ", "12 _!", "", None, "é", "東")] == [False, False, False, False, True, True]
    df = languages(spark).unionByName(spark.createDataFrame([(9000, "½ ² Ⅷ", "de")], "doc_id long, text string, lang string"))
    (row,) = langid.identify(df).where("doc_id = 9000").collect()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def naive_subwords(text):
    """Every run of 2 to 4 characters that holds letters only, but for an edge at either end."""
    code = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    out = Counter()
    for n in langid.GRAMS:
        for k in range(len(code) - n + 1):
            gram = code[k : k + n]
            if any(c == 0 for c in gram[1:-1]) or not (gram[0] or gram[-1]):
                continue
            h = 2166136261 + n
            for c in gram:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out[h % langid.BUCKETS] += 1
    return out


def test_predictions_equal_naive_sums():
    rng = random.Random(4)
    model = langid.LanguageModel(["a", "b", "c"], np.random.default_rng(1).normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.array([0.1, -0.2, 0.0]), 0.7, 0.4)
    for text in ["é", "x", "a1b", "Straße über ½", sentence(rng, 200), "\t".join("ab cde f".split())]:
        seen = naive_subwords(text)
        total = sum(n * model.scores[b].astype(float) for b, n in seen.items()) / max(1, sum(seen.values()))
        z = (total + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.predict(text) == (model.languages[int(p.argmax())], pytest.approx(float(p.max()), abs=1e-6), bool(p.max() < model.threshold))


def test_toxicity_of_messy_tables(spark, messy, empty):
    docs, labels = toxic_table(spark)
    both = docs.withColumn("score", F.lit(7)).unionByName(messy.where("doc_id is null or doc_id >= 100").select(F.col("doc_id") + 1000, "text", "score").toDF("doc_id", "text", "score"))
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id long, toxic int"))
    got = toxicity.score_documents(both, odd).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.score_documents(both, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.score_documents(empty.select("doc_id", "text"), labels).count() == 0


def test_words_of_fixture():
    assert not set(WORDS) & set(FOREIGN)
