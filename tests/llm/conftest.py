import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest
from conftest_words import sentence
from pyspark.sql import functions as F

CLASHING = ["n_bytes", "piece", "row", "fp", "line", "place", "score", "h", "depth", "copy", "label", "grp"]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, odd characters, clashing column names."""
    rng = random.Random(4)
    rows = [(i, "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))), "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i in range(60)]
    rows += [(100, None, "en", "s1"), (101, "", "en", None), (102, "   \n\t", "fr", "s1"), (None, "no id at all here", "en", "s1"), (None, None, None, None)]
    rows += [(103, sentence(rng, 40_000), "en", "s0"), (104, "12345 !!! ???", "en", "s0"), (105, "<|endoftext|> İstanbul 東京 don't é", "fr", "s0")]
    rows += [rows[0], rows[0], (106, rows[1][1], "en", "s9"), (107, "a" * 30_000, "en", "s0")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
