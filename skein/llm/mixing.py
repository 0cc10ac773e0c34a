"""Mixing to target weights by soft membership, with DataFrame functions.

A classifier fitted on the labelled table gives every document a distribution over domains. Rates r >= 0 for documents are
then sought so that each domain's expected tokens, the sum of rate * tokens * posterior, match the domain's share of the
token budget: a least-squares problem, solved by projected gradient. A step moves all rates along their posteriors and
cuts them off at 0; in the domains' small space it is scaled by the second derivative of the documents that still move,
so that few steps are enough. The sums of a step are one aggregation over a narrow table; a document's rate is a fold over
the steps so far (a few constants), so no rates are written or joined.

The classifier is multinomial naive Bayes over hashed words. It is fitted on at most ``Fit.rows`` labelled documents,
chosen by hash; a document's evidence is scaled to at most ``Fit.evidence`` words, so that long documents keep soft
posteriors. Everything else covers all documents.

Cases: a null or wordless text has no tokens and gets the domains' prior as posterior; its rate follows from that. A null
id is kept. A label row without quality or toxicity counts as 0 there. With no labels, all posteriors are equal. Repeated
rows get equal rates, each its own copies. Other columns are ignored by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.names import chosen, numbered
from skein.llm.sampling import hash_sample
from skein.llm.url_filter import LOWER, UPPER
from skein.scratch import written

DOMAINS = ("good", "low", "toxic")
#: Shares of the token budget.
TARGETS = {"good": 0.9, "low": 0.08, "toxic": 0.02}
#: A share this near its target meets it.
MET = 1e-4


@dataclass(frozen=True)
class Fit:
    rows: int = 6000
    buckets: int = 1 << 14
    evidence: float = 60.0
    #: Words of the whole sample's distribution that every domain is given beforehand.
    prior: float = 300.0


@dataclass(frozen=True)
class Classifier:
    """Log prior of each domain, and for all but the first each bucket's log weight against the first."""

    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...] = field(repr=False)


def _constants(values, kind: str) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), f"array<{kind}>")


def _buckets(text: Column, buckets: int) -> Column:
    """Each word's place in the table, from 1."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(buckets).cast("long")) + 1).cast("int"))


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain: 0 good, 1 low, 2 toxic."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit(2)).when(F.coalesce("quality", F.lit(0)) == 1, F.lit(0)).otherwise(F.lit(1))
    return labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Classifier:
    sample = hash_sample(domain_of(labels), F.xxhash64("doc_id", "domain"), how.rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    words = texts.select("domain", F.explode(_buckets(F.col("text"), how.buckets)).alias("bucket"))
    counts = np.zeros((len(DOMAINS), how.buckets))
    for r in words.groupBy("domain", "bucket").count().collect():  # at most buckets * domains rows
        counts[r["domain"], r["bucket"] - 1] += r["count"]
    seen = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    rows = np.array([seen.get(k, 0) + 1.0 for k in range(len(DOMAINS))])
    usual = (counts.sum(axis=0) + 1 / how.buckets) / (counts.sum() + 1)
    log = np.log((counts + how.prior * usual) / (counts.sum(axis=1, keepdims=True) + how.prior))
    return Classifier(tuple(np.log(rows / rows.sum()).tolist()), tuple(tuple(np.round(log[k] - log[0], 6).tolist()) for k in range(1, len(DOMAINS))))


def with_posteriors(docs: DataFrame, c: Classifier, how: Fit = Fit(), text_col: str = "text") -> DataFrame:
    """``docs`` with ``_tokens`` and ``_p0``, ``_p1``, ... (a domain each)."""
    out = docs.withColumn("_b", _buckets(F.col(text_col), how.buckets)).withColumn("_tokens", F.size("_b").cast("long"))
    scale = F.least(F.lit(1.0), F.lit(how.evidence) / F.greatest(F.col("_tokens"), F.lit(1)))
    logs = {}
    for k, weights in enumerate(c.weights, 1):
        logs[f"_l{k}"] = F.lit(c.prior[k] - c.prior[0]) + scale * _summed(_constants(weights, "double"))
    out = out.withColumns(logs)
    top = F.greatest(F.lit(0.0), *[F.col(x) for x in logs])
    out = out.withColumns({"_e0": F.exp(-top)} | {f"_e{k}": F.exp(F.col(f"_l{k}") - top) for k in range(1, len(DOMAINS))})
    whole = sum((F.col(f"_e{k}") for k in range(1, len(DOMAINS))), F.col("_e0"))
    out = out.withColumns({f"_p{k}": F.col(f"_e{k}") / whole for k in range(len(DOMAINS))})
    return out.drop("_b", *logs, *[f"_e{k}" for k in range(len(DOMAINS))])


def _summed(table: Column) -> Column:
    return F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.element_at(table, b))


@dataclass(frozen=True)
class Step:
    """All rates move against ``along``, but those at 0 that the gradient, posterior . ``residual``, holds there."""

    along: np.ndarray
    residual: np.ndarray


@dataclass(frozen=True)
class Solution:
    """The steps, the domains' shares that they reach, the largest distance from a target, and whether all are met."""

    steps: list[Step]
    shares: tuple[float, ...]
    gap: float
    met: bool


def rate_after(steps: list[Step]) -> Column:
    """The rate of a row after these steps from 1: r = max(0, r - along . posterior), again and again."""
    if not steps:
        return F.lit(1.0)
    k = len(DOMAINS)
    constants = F.array(*[F.array(*[F.lit(float(x)) for x in (*s.along, *s.residual)]) for s in steps])

    def dot(s: Column, at: int) -> Column:
        return sum((F.get(s, at + i) * F.col(f"_p{i}") for i in range(1, k)), F.get(s, at) * F.col("_p0"))

    return F.aggregate(constants, F.lit(1.0), lambda r, s: F.when((r <= 0) & (dot(s, k) > 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), r - dot(s, 0))))


def solve(scored: DataFrame, targets: dict[str, float] = TARGETS, most: int = 80, close: float = 1e-6) -> "Solution":
    """Steps of the projected gradient over a table at rest with _tokens and posteriors.

    A step is kept only if it lessens the squared error. The scaled step is shortened a few times, then the plain
    gradient, short enough to descend, takes its place; the search ends when the targets are met, when neither gains (they
    cannot be met), or after ``most`` passes. The solution says what is left.
    """
    k = len(DOMAINS)
    share = np.array([targets[d] for d in DOMAINS])
    share = share / share.sum()
    p = [F.col(f"_p{i}") for i in range(k)]

    def error(steps: list[Step]) -> np.ndarray | None:
        row = scored.withColumn("_r", rate_after(steps)).agg(F.sum("_tokens"), *[F.sum(F.col("_tokens") * F.col("_r") * x) for x in p]).first()
        return np.array(row[1:]) / row[0] - share if row[0] else None

    def curve(steps: list[Step], residual: np.ndarray) -> np.ndarray:
        """Second derivative over the rows that are free to move."""
        pull = sum((F.lit(float(residual[i])) * p[i] for i in range(1, k)), F.lit(float(residual[0])) * p[0])
        free = ((F.col("_r") > 0) | (pull < 0)).cast("double")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = scored.withColumn("_r", rate_after(steps)).agg(F.sum("_tokens"), *[F.sum(F.col("_tokens") * free * p[i] * p[j]) for i, j in pairs]).first()
        out = np.zeros((k, k))
        for (i, j), value in zip(pairs, row[1:], strict=True):
            out[i, j] = out[j, i] = value / row[0]
        return out

    steps: list[Step] = []
    residual = error(steps)
    passes = 1
    while residual is not None and np.abs(residual).max() >= close and passes < most:
        bend = curve(steps, residual)
        # The ridge holds back domains that hardly any document belongs to.
        scaled = np.linalg.solve(bend + 1e-4 * np.trace(bend) * np.eye(k) + 1e-12 * np.eye(k), residual)
        plain = residual / max(np.trace(bend), 1e-9)
        for along in (scaled, scaled / 4, scaled / 16, scaled / 64, plain, plain / 8):
            trial = error([*steps, Step(along, residual)])
            passes += 1
            if trial @ trial < residual @ residual:
                break
        else:
            break
        gained = 1 - (trial @ trial) / (residual @ residual)
        steps, residual = [*steps, Step(along, residual)], trial
        passes += 1
        if gained < 1e-6:
            break
    left = np.zeros(k) if residual is None else residual
    return Solution(steps, tuple((left + share).tolist()), float(np.abs(left).max()), bool(np.abs(left).max() < max(close, MET)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, how: Fit = Fit()) -> DataFrame:
    """doc_id, tokens, a posterior for each domain, rate and copies of every row; and, the same in all rows, the largest
    distance of a domain's share from its target and whether all targets are met."""
    narrow = chosen(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = chosen(labels, "doc_id", "quality", "toxic")
    scored = written(with_posteriors(narrow, fit(narrow, labels, how), how).drop("text"), "posteriors")
    solution = solve(scored, targets)
    rated = scored.withColumn("rate", rate_after(solution.steps))
    said = [F.lit(solution.gap).alias("target_gap"), F.lit(solution.met).alias("targets_met")]
    return rated.select("doc_id", F.col("_tokens").alias("tokens"), *[F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), *said)


def copies(rate: Column, doc_id: Column) -> Column:
    """The whole part of the rate, and one more with the chance of the rest, drawn by hash."""
    drawn = F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, how: Fit = Fit()) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say. Columns of any name are returned as they came."""
    plain, of = numbered(docs)
    named = plain.withColumnsRenamed({of("doc_id"): "doc_id", of("text"): "text"})
    labels = chosen(labels, "doc_id", "quality", "toxic")
    scored = written(with_posteriors(named, fit(named, labels, how), how), "posteriors")
    rated = scored.withColumn("_n", copies(rate_after(solve(scored, targets).steps), F.col("doc_id")))
    repeated = rated.filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return repeated.select(named.columns).toDF(*docs.columns)
