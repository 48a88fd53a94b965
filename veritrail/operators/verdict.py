"""How much of an in-sample effect survives: ordered rules over two statistics, as one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.cleaning import finite
from ..functions.student import critical
from .stats import STAT_SCHEMA, StatResult, significant


@dataclass(frozen=True)
class Rule:
    """The first rule whose condition holds decides."""

    when: Column
    verdict: str
    why: Column
    has_retention: bool = True
    flipped: bool = False


def _fixed(x: Column, digits: int) -> Column:
    """Decimal text, rounded half to even."""
    return F.format_string(f"%.{digits}f", F.coalesce(F.bround(x, digits), F.lit(float("nan"))))


def _percent(x: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.coalesce(F.bround(x * 100, 0), F.lit(float("nan")))), F.lit("%"))


def effective_df(stat: Column) -> Column:
    return F.coalesce(stat["df"], (stat["n"] - 1).cast("double"))


def rules(
    train: Column, test: Column, significance_t: float | None = None, robust: float = K.DEFAULT_ROBUST_RETENTION,
    moderate: float = K.DEFAULT_MODERATE_RETENTION, overfit: float = K.DEFAULT_OVERFIT_RETENTION,
) -> tuple[Column, list[Rule]]:
    """(retention, rules in order)."""
    strong = significant(train["t_stat"], effective_df(train), significance_t)
    holds = significant(test["t_stat"], effective_df(test), significance_t)
    kept = F.when(train["mean"] != 0, test["mean"] / F.when(train["mean"] != 0, train["mean"]))
    bound = F.lit(float(significance_t)) if significance_t is not None else critical(effective_df(train))
    test_bound = F.lit(float(significance_t)) if significance_t is not None else critical(effective_df(test))
    t_text = lambda s: _fixed(s["t_stat"], 2)
    unknown = ~finite(test["mean"]) | test["t_stat"].isNull() | F.isnan(test["t_stat"])
    opposite = ((train["mean"] > 0) & (test["mean"] < 0)) | ((train["mean"] < 0) & (test["mean"] > 0))
    say = F.concat
    return kept, [
        Rule(~strong, K.INSUFFICIENT_INSAMPLE_EDGE, say(F.lit("in-sample |t| "), t_text(train), F.lit(" is below the critical "), _fixed(bound, 2), F.lit(": there is no edge to lose")), False),
        Rule(F.coalesce(unknown, F.lit(True)), K.INSUFFICIENT_DATA, F.lit("the out-of-sample statistic cannot be computed"), False),
        Rule(opposite, K.OVERFITTED, say(F.lit("the effect changes sign: "), _fixed(train["mean"], 4), F.lit(" in sample, "), _fixed(test["mean"], 4), F.lit(" out of sample")), True, True),
        Rule(~holds & (kept < overfit), K.OVERFITTED, say(F.lit("out-of-sample |t| "), t_text(test), F.lit(" is below the critical "), _fixed(test_bound, 2), F.lit(" and only "), _percent(kept), F.lit(" of the effect is left"))),
        Rule(~holds, K.WEAK, say(F.lit("out-of-sample |t| "), t_text(test), F.lit(" is below the critical "), _fixed(test_bound, 2), F.lit(", though the effect keeps its size"))),
        Rule(kept.isNull() | F.isnan(kept), K.WEAK, F.lit("retention is undefined: the in-sample mean is zero"), False),
        Rule(kept >= robust, K.ROBUST, say(_percent(kept), F.lit(" of the effect survives and stays significant"))),
        Rule(kept >= moderate, K.MODERATE, say(F.lit("significant, with "), _percent(kept), F.lit(" of the effect left"))),
        Rule(F.lit(True), K.WEAK, say(F.lit("significant, but only "), _percent(kept), F.lit(" of the effect is left"))),
    ]


def classify(train: Column, test: Column, significance_t: float | None = None, **thresholds: float) -> Column:
    """struct<verdict, reasoning, retention_ratio, sign_flipped> of two columns of STAT_SCHEMA."""
    kept, ordered = rules(train, test, significance_t, **thresholds)
    chain = None
    for r in ordered:
        value = F.struct(
            F.lit(r.verdict).alias("verdict"), r.why.alias("reasoning"),
            (kept if r.has_retention else F.lit(None).cast("double")).alias("retention_ratio"), F.lit(r.flipped).alias("sign_flipped"),
        )
        hit = F.coalesce(r.when, F.lit(False))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def classify_overfitting(
    train: StatResult, test: StatResult, significance_t: float | None = None, robust_retention: float = K.DEFAULT_ROBUST_RETENTION,
    moderate_retention: float = K.DEFAULT_MODERATE_RETENTION, overfit_retention: float = K.DEFAULT_OVERFIT_RETENTION,
) -> tuple[str, str, float | None, bool]:
    """(verdict, reasoning, retention, sign_flipped) of two results; NaN counts as undefined."""
    spark = SparkSession.getActiveSession()
    clean = lambda x: None if x is None or x != x else float(x)
    row = lambda s: (clean(s.mean), clean(s.t_stat), int(s.n), bool(s.significant), s.n_clusters, clean(s.df))
    df = spark.createDataFrame([(row(train), row(test))], f"train struct<{_fields()}>, test struct<{_fields()}>")
    got = df.select(classify(F.col("train"), F.col("test"), significance_t, robust=robust_retention, moderate=moderate_retention, overfit=overfit_retention).alias("r")).first()["r"]
    return got["verdict"], got["reasoning"], got["retention_ratio"], got["sign_flipped"]


def _fields() -> str:
    return STAT_SCHEMA.replace(" ", ":").replace(",:", ",")
