"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text, others on toxic text.  A text is cut into windows of words; a
window's evidence is how many bytes shorter it gets when the toxic dictionary stands behind the ordinary one, under
the ordinary one's entropy tables.  (So what both kinds of text share costs the same on both sides, and only what
the toxic text alone has taught counts.)  A text's evidence is summed up in a few numbers, which a logistic curve,
fitted on documents that the dictionaries have not seen, turns into a score; the curve is shifted so that the best
threshold found is ``DECISION``.

Toxic documents are ordinary text for the most part, so the toxic dictionaries are trained on toxic windows alone:

* At first those windows of toxic documents that the ordinary dictionary compresses worst for their length.
* Then the toxic documents are halved.  The dictionary of one half picks the windows of the other half that it
  shortens more than all but ``FALSE`` of ordinary windows, and a new dictionary is trained on those; the halves take
  turns.  What is peculiar to single documents does not recur in the other half and drops out.
* Both halves' last dictionaries stay, and a window's evidence is the smaller of theirs.

This is done from several ``STARTS``; the dictionaries that tell the documents apart best that calibrate, stay.

The classifier is fitted on a bounded sample: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` different labelled texts of at
most ``MAX_CHARS`` characters, and ``MAX_BYTES`` of each kind, chosen by a hash of the texts; the bound is enforced
before anything is collected.  Every text is scored whole.

Defined results: null text counts as empty; empty texts get the score of a text without evidence; with no labels of
both kinds every score is 0; ids may be null, negative or repeated and are carried exactly; repeated rows get equal
scores; of several labels of an id the largest counts, a null id has none.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, computed, fits_broadcast, materialise, text_or_empty
from .langid import held_out_column

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, MAX_BYTES = 2_500, 5_000, 100_000, 20_000_000
DECISION, BETA = 0.3, 1.25
WINDOW = 8
#: Bytes of the ordinary dictionary, at most, and the (k, d) that zstandard's trainer takes for it and for toxic ones.
ORDINARY, ORDINARY_SEGMENTS, TOXIC_SEGMENTS = 2_500_000, (32, 8), (12, 8)
#: Share of ordinary windows that are as strange as the toxic windows which the first dictionary is trained on
#: (``LEAST`` windows at least), and bytes of the toxic dictionaries.
STARTS = ((0.01, 4_096), (0.01, 3_072), (0.02, 4_096), (0.01, 2_048))
#: Turns of the halves, share of ordinary windows that may pass a turn's threshold, ordinary windows that it is
#: measured on.
LEAST, TURNS, FALSE, MEASURED = 200, 8, 0.004, 60_000
#: Share of the sample that calibrates, and documents that do, at most.
CALIBRATION, MAX_CALIBRATION = 0.25, 2_000
#: Bytes saved from which a window counts, for the counting features.
STEPS = (2, 3, 5)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes = b""
    toxic: tuple[bytes, ...] = ()
    weights: tuple[float, ...] = ()


def compressor(dictionary: bytes, fine: bool = False):
    """Compresses one window; the dictionary (full, or plain text where there was too little to train on) is
    prepared once.  Matches are 7 bytes or longer, so that syllables which all texts share count little; ``fine``:
    the best parse with matches of 3 bytes, to tell how usual a window is."""
    import zstandard as z

    content = z.ZstdCompressionDict(dictionary)
    shape = z.ZstdCompressionParameters(
        window_log=21, chain_log=18, hash_log=18, search_log=5, min_match=3 if fine else 7, target_length=32, strategy=z.STRATEGY_BTOPT if fine else z.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    content.precompute_compress(compression_params=shape)
    return z.ZstdCompressor(dict_data=content, compression_params=shape).compress


_kept_compressor = functools.lru_cache(maxsize=4)(compressor)


def trained(samples: list[bytes], size: int, segments: tuple[int, int]) -> bytes:
    """A zstandard dictionary of the samples; their plain text where they are too few."""
    import zstandard

    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=segments[0], d=segments[1]).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)[-4096:] or b" " * 8


def toxic_dictionary(samples: list[bytes], size: int) -> bytes:
    """The best ``size`` bytes of a dictionary trained on the samples.  The trainer puts what scores best last, and
    cuts that end off to make room for its header; so it gets room for all, and the end is taken here."""
    return trained(samples, sum(map(len, samples)) + 2_048, TOXIC_SEGMENTS)[-size:]


def windows(text: str) -> list[bytes]:
    words = _WORD.findall(text.lower())
    return [f" {' '.join(words[k : k + WINDOW])} ".encode("utf-8", "surrogatepass") for k in range(0, len(words), WINDOW)]


def saved(found: list[bytes], model: ToxicityModel) -> np.ndarray:
    """Bytes that the toxic dictionaries save of each window; the further ones are asked where the first saves any."""
    plain, *others = (_kept_compressor(d) for d in (model.ordinary, *(model.ordinary + t for t in model.toxic)))
    out = []
    for w in found:
        before = len(plain(w))
        least = before - len(others[0](w))
        for other in others[1:]:
            if least > 0:
                least = min(least, before - len(other(w)))
        out.append(least)
    return np.array(out or [0])


def evidence(text: str, model: ToxicityModel) -> list[float]:
    """Of the bytes saved: largest, mean of the top three, log of the windows' number, mean, logs of how many reach
    each of ``STEPS``."""
    d = saved(windows(text), model)
    top = np.sort(d)[::-1][:3]
    return [float(top[0]), float(top.mean()), float(np.log1p(len(d))), float(d.mean()), *(float(np.log1p((d >= s).sum())) for s in STEPS)]


def _lengths(compress, found: list[bytes]) -> np.ndarray:
    return np.fromiter((len(compress(w)) for w in found), np.int64, len(found))


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Iterator[ToxicityModel]:
    """A pair of dictionaries, without weights, for every start."""
    rng = np.random.default_rng(5)
    usual = [w for t in ordinary for w in windows(t)]
    plain = trained(usual, ORDINARY, ORDINARY_SEGMENTS)
    measured = [usual[k] for k in rng.permutation(len(usual))[:MEASURED]]
    halves = [[w for t in toxic[k::2] for w in windows(t)] for k in (0, 1)]
    fine = compressor(plain, fine=True)
    size = lambda found: np.fromiter(map(len, found), np.float64, len(found))
    slope, base = np.polyfit(size(measured), _lengths(fine, measured), 1) if len(set(map(len, measured))) > 1 else (0.0, 0.0)
    strangeness = [_lengths(fine, h) - size(h) * slope - base for h in (measured, *halves)]
    compress = compressor(plain)
    usual_length, length = _lengths(compress, measured), [_lengths(compress, h) for h in halves]
    for first, room in STARTS:
        bar = np.quantile(strangeness[0], 1 - first) if len(measured) else 0.0
        picked = [np.argsort(-s, kind="stable")[: max(LEAST, int((s > bar).sum()))] for s in strangeness[1:]]
        for turn in range(TURNS):
            own, other = turn % 2, 1 - turn % 2
            compress = compressor(plain + toxic_dictionary([halves[own][k] for k in picked[own]], room))
            bar = max(2.0, float(np.quantile(usual_length - _lengths(compress, measured), 1 - FALSE))) if len(measured) else 2.0
            hit = np.flatnonzero(length[other] - _lengths(compress, halves[other]) >= bar)
            if 4 * len(hit) >= LEAST:
                picked[other] = hit
        yield ToxicityModel(plain, tuple(toxic_dictionary([h[k] for k in p], room) for h, p in zip(halves, picked, strict=True) if len(h)))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Ridge-penalised logistic fit (Newton steps) in raw units, its intercept moved to the prior and then
    so that the threshold of the best F measure (recall counts ``BETA`` times) lies at DECISION."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    penalty = np.array([1e-1] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        w += np.clip(np.linalg.solve(hess, z.T @ (y - p) - penalty * w), -5, 5)
    logit = z @ w
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum((weight * y)[order])
    false = np.cumsum((weight * (1 - y))[order])
    f = hits / (hits + false + BETA**2 * (weight * y).sum())
    best = int(np.argmax(f))
    low = logit[order][min(best + 1, len(order) - 1)]
    cut = (logit[order][best] + low) / 2
    raw = w[:-1] / scale
    return (*raw.tolist(), float(w[-1] - raw @ mean - cut + np.log(DECISION / (1 - DECISION))))


def _told_apart(value: np.ndarray, y: np.ndarray) -> float:
    """Share of the pairs of a toxic and another document in which the toxic one has the higher value."""
    toxic, others = value[y == 1], np.sort(value[y == 0])
    below = np.searchsorted(others, toxic, "left") + np.searchsorted(others, toxic, "right")
    return float(below.mean() / 2 / max(1, len(others))) if len(toxic) else 0.0


def train(texts: list[str], labels: list[int], prior: float) -> ToxicityModel:
    y = np.array(labels)
    rng = np.random.default_rng(11)
    fold = rng.random(len(y)) < CALIBRATION
    groups = [[texts[i] for i in np.flatnonzero((y == k) & ~fold)] for k in (1, 0)]
    if not all(any(windows(t) for t in g) for g in groups):
        return ToxicityModel()
    check = np.flatnonzero(fold)
    if len(set(y[check].tolist())) < 2:
        check = np.arange(len(y))
    check = rng.permutation(check)[:MAX_CALIBRATION]
    best, told = None, -1.0
    for model in _dictionaries(*groups):
        x = np.array([evidence(texts[i], model) for i in check])
        weights = _logistic(x, y[check], prior)
        if (now := _told_apart(x @ np.array(weights[:-1]), y[check])) > told:
            best, told = ToxicityModel(model.ordinary, model.toxic, weights), now
    return best


def score(text: str | None, model: ToxicityModel) -> float:
    if not model.weights:
        return 0.0
    logit = float(np.dot(evidence(text or "", model), model.weights[:-1]) + model.weights[-1])
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from documents that have a label (of several, the largest) and are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out_column())
    known = materialise(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    side = F.broadcast(known) if fits_broadcast(known, 16, 8 << 20) else known
    held = docs.where(F.length("text") <= MAX_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id").select("toxic", "text")
    counts = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel()
    sample = bounded_sample(held, "toxic", "text", {1: (MAX_TOXIC, counts[1]), 0: (MAX_ORDINARY, counts[0])}, MAX_BYTES).toPandas().sort_values(["toxic", "h"])
    return train(sample["text"].tolist(), sample["toxic"].tolist(), counts[1] / sum(counts.values()))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = computed(source, ["doc_id"], ["text"], lambda texts: [(score(t, shared.value),) for t in texts], {"score": "double"})
    return out.select("doc_id", held_out_column().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
