"""Language identification: averaged hashed subword embeddings with a linear softmax.

Training runs in numpy by stochastic gradient descent on a bounded sample (at most ``MAX_PER_LANGUAGE``
different texts of each language and ``MAX_SAMPLE`` in all, chosen by a hash of the texts, which are whole; the
bound is enforced before anything is collected); executors reduce a text to counts of hashed subwords first, so
what reaches the driver does not depend on the length of texts.  A temperature and a rejection threshold are
calibrated on documents that the weights were not fitted to.

Defined results: a null text, or one without a letter (``str.isalpha``), is ``und`` with score 0 and rejected;
with nothing to learn from, everything is; repeated rows get equal predictions; ids may be null, negative or
repeated and are carried exactly; empty tables give empty results.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, bounded_sample, computed, trim

UNKNOWN = "und"
#: Bounds on the training sample.
MAX_PER_LANGUAGE, MAX_SAMPLE = 800, 8_000
BUCKETS, WIDTH = 1 << 14, 16
GRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE = 10, 32, 40.0
#: Part of the sample that calibrates, and of its right predictions that must not be rejected.
CALIBRATION, KEPT = 0.2, 0.998
_BLOCK = 1 << 18


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def subwords(text: str):
    """Buckets of the subwords of a text, block by block: grams of letters, with word edges marked."""
    low = text.lower()
    for at in range(0, len(low), _BLOCK):
        # blocks overlap so that no gram is lost; a gram belongs to the block where it starts
        part = low[at : at + _BLOCK + max(GRAMS) - 1]
        lead = 1 if at == 0 else 0
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        code = np.where(_letters()[code], code, np.uint32(0))
        if lead:
            code = np.concatenate((np.zeros(1, np.uint32), code))
        if at + _BLOCK >= len(low):
            code = np.concatenate((code, np.zeros(1, np.uint32)))
        inner = code != 0
        found = []
        for n in GRAMS:
            m = min(len(code) - n + 1, _BLOCK + lead)
            if m <= 0:
                continue
            valid = inner[:m] | inner[n - 1 : n - 1 + m]
            for k in range(1, n - 1):
                valid &= inner[k : k + m]
            if n == 2:
                valid &= inner[:m] | inner[1 : 1 + m]
            at_ = np.flatnonzero(valid)
            h = np.full(len(at_), 2166136261 + n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ code[at_ + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            found.append(h & np.uint32(BUCKETS - 1))
        if found:
            yield np.concatenate(found)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages: what a subword says, embedding times output weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.scores[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return _softmax((total / max(n, 1) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = self.probabilities(text)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (buckets, counts) in enumerate(rows):
        x[i, buckets] = counts / max(1, counts.sum())
    return x


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], fold: np.ndarray) -> LanguageModel:
    """rows: (buckets, counts) per document; fold: true for those that calibrate only."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], dtype=np.int64)
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    fit = np.flatnonzero(~fold)
    steps = EPOCHS * max(1, -(-len(fit) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            pick = fit[at : at + BATCH]
            x = _dense([rows[i] for i in pick])
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            hidden = x @ embed[used]
            gap = _softmax(hidden @ out + bias)
            gap[np.arange(len(pick)), y[pick]] -= 1
            gap /= len(pick)
            back = x.T @ (gap @ out.T)
            out -= rate / 10 * (hidden.T @ gap)
            bias -= rate / 100 * gap.sum(axis=0)
            embed[used] -= rate * back
    model = LanguageModel(names, (embed @ out).astype(np.float32), bias.astype(np.float64))
    check = np.flatnonzero(fold)
    if len(check):
        z = np.concatenate([_dense([rows[i] for i in check[k : k + 256]]) @ model.scores for k in range(0, len(check), 256)]) + bias
        grid = np.geomspace(0.02, 5, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).sum()))
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[check]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], 1 - KEPT)))
    return model


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from text and lang (rows of null text or lang are left out)."""
    labelled = docs.where("text is not null and lang is not null").select("lang", "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    most = max(1, min(MAX_PER_LANGUAGE, MAX_SAMPLE // len(counts)))
    chosen = bounded_sample(labelled, "lang", "text", {k: (most, n) for k, n in counts.items()})

    def reduce(texts):
        out = []
        for text in texts:
            count = np.zeros(BUCKETS, dtype=np.int64)
            for b in subwords(text):
                count += np.bincount(b, minlength=BUCKETS)
            some = np.flatnonzero(count)
            out.append((some.astype("<i4").tobytes(), count[some].astype("<i4").tobytes()))
        return out

    sample = computed(chosen, ["h", "lang"], ["text"], reduce, {"buckets": "binary", "counts": "binary"}).toPandas().sort_values(["h", "lang"])
    sample = sample[sample["buckets"].map(len) > 0]
    if not len(sample):
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rows = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for b, c in zip(sample["buckets"], sample["counts"], strict=True)]
    fold = np.random.default_rng(3).random(len(rows)) < CALIBRATION
    if fold.all():
        fold[:] = False
    return train(rows, sample["lang"].tolist(), fold)


def predict(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of docs (``text`` is read but need not be among them) with lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(columns))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.col("text").alias("text"))
    return computed(source, names, ["text"], lambda texts: [shared.value.predict(t) for t in texts], {"lang_pred": "string", "score": "double", "rejected": "boolean"})


def held_out_column() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from the rows that are not held out."""
    model = fit(docs.where(~held_out_column()))
    out = predict(docs, model, ["doc_id"]).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is told with enough confidence, all columns as they were.

    The model learns from the ``lang`` column of the same table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def accepted(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array([not shared.value.predict(t)[2] for t in part.column("text").to_pylist()], pa.bool_()))
        trim()

    return docs.mapInArrow(accepted, docs.schema)
