"""Operator 9: document quality from a classifier's evidence and the record of its site.

A logistic model on shape features gives each document's evidence. Evidence is summed by host and by
path (integers, so that the order of rows doesn't matter). A beta prior whose strength is estimated
from the spread of hosts draws each host to the global mean, a second one each path to its host, so
that sparse sites say little and large ones speak for themselves. The posterior odds of a document are its own odds
times those of its path over the global ones. Texts are scored once, where they lie; what is kept of the rows is written with the evidence and read for the sums and the decisions.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, give_back

SYMBOLS = b"#$%&*|~^@\\{}<>=+_"
FEATURES = ("log_words", "word_length", "upper", "symbols", "exclamation", "digits", "spaces", "distinct", "repeats", "line_length", "line_distinct", "non_ascii", "stops")
MICRO = 1_000_000
#: Labelled rows that the model is fitted on at most; the smallest by a hash of doc_id.
FIT_ROWS = 20_000
#: Rows sent to Python at once; texts are long.
ARROW_ROWS = 500
#: Paths whose few numbers are sent to all tasks; more are joined by a shuffle.
BROADCAST_PATHS = 50_000


def shape(text: str | None) -> list[float]:
    """Shape features of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = max(1, len(raw)), text.split()
    k = max(1, len(words))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    lines = text.split("\n")
    return [
        float(np.log1p(len(words))), min(40.0, n / k), upper / max(1, upper + lower), sum(int(count[c]) for c in SYMBOLS) / n, int(count[33]) / n,
        int(count[48:58].sum()) / n, int(count[32]) / n, float(np.log1p(len(set(words))) / np.log1p(k)), sum(map(operator.eq, words, words[1:])) / k,
        float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), int(count[128:].sum()) / n, (int(count[46]) + int(count[63])) / n,
    ]


class Logistic:
    """Weights of standardised features and their squares, by Newton steps with a ridge."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> "Logistic":
        got = cls(x.mean(0), x.std(0) + 1e-9, np.zeros(1 + 2 * x.shape[1]))
        z = got._expand(x)
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ got.weights, -30, 30)))
            slope = z.T @ (y - p) - penalty * got.weights
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
            got.weights = got.weights + step
            if np.abs(step).max() < 1e-8:
                break
        return got

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._expand(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> Logistic:
    """The evidence model, from at most fit_rows labelled documents; rows with a null label or doc_id don't count.

    Of a doc_id with several labels, or several rows, the smallest label and features count. Without both labels the model is flat at their rate (1 if there are none).
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)

    @F.arrow_udf("array<double>")
    def shapes(text: pa.Array) -> pa.Array:
        return pa.array([shape(t.as_py()) for t in text], pa.list_(pa.float64()))

    # the broadcast side has at most fit_rows rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "quality", shapes("text").alias("x"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # a row for each doc_id, so at most fit_rows
    if rows.empty or rows.quality.nunique() < 2:
        rate = float(rows.quality.mean()) if len(rows) else 1.0
        weights = np.zeros(1 + 2 * len(FEATURES))
        weights[0] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
        return Logistic(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), weights)
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    return Logistic.fit(np.array(rows.x.tolist()), rows.quality.to_numpy(np.float64))


def evidence(model: Logistic) -> "F.Column":
    """A function of the text column: millionths of the chance that the text is good, from 1 to 999999."""

    @F.arrow_udf("long")
    def score(text: pa.Array) -> pa.Array:
        x = np.array([shape(t.as_py()) for t in text]).reshape(-1, len(FEATURES))  # one text at a time, as they may be long
        give_back()
        return pa.array(np.clip(np.rint(model(x) * MICRO), 1, MICRO - 1).astype(np.int64))

    return score


def _strength(mean: float, rows: DataFrame, centre: Column) -> float:
    """Pseudo-counts of the beta prior: by moments, from groups (n, total) around their centres (a column)."""
    rate = F.col("total") / (F.col("n") * MICRO)
    got = rows.where("n >= 2").agg(F.sum(F.col("n").cast("double")).alias("n"), F.sum(F.col("n") * (rate - centre) ** 2).alias("spread"), F.sum(F.lit(1.0)).alias("groups")).head()
    if not got["n"] or got["groups"] < 2:
        return 100.0
    noise = mean * (1 - mean) * got["groups"] / got["n"]
    between = got["spread"] / got["n"] - noise
    return 1e4 if between <= 0 else float(np.clip(mean * (1 - mean) / between - 1, 1.0, 1e4))


def judge(docs: DataFrame, model: Logistic, host: str = "source", path: Sequence[str] = ("source", "lang"), prefix: str = "q_", columns: Sequence[str] | None = None) -> DataFrame:
    """The columns of docs (or those named) with host, evidence, host_quality, path_quality and posterior (doubles but host), each named with the prefix.

    Null hosts and paths form groups of their own; null and empty texts have the evidence of an empty
    text; repeated rows count each time; an empty table stays empty. A column of docs that has the name of a new one is replaced by it.
    """
    spark = docs.sparkSession
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # own names inside, so that none can clash
    rows = docs.toDF(*inner.values())
    kept = [inner[c] for c in columns or docs.columns]
    key = F.to_json(F.struct(*[F.col(inner[c]).cast("string").alias(f"k{i}") for i, c in enumerate(path)]))
    scored = rows.select(*kept, F.col(inner[host]).cast("string").alias("host"), key.alias("path"), evidence(model)(F.col(inner["text"]).cast("string")).alias("evidence"))
    with arrow_rows(spark, ARROW_ROWS):
        scored = cut(scored)
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("total")))  # one row for each path, read several times
    all_ = paths.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("paths")).head()
    mean = (all_["total"] or 0) / (all_["n"] * MICRO) if all_["n"] else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    kappa = _strength(mean, hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("total") / MICRO + kappa * mean) / (F.col("n") + kappa)).alias("host_quality"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    kappa_path = _strength(mean, joined, F.col("host_quality"))
    sites = joined.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_quality", ((F.col("total") / MICRO + kappa_path * F.col("host_quality")) / (F.col("n") + kappa_path)).alias("path_quality"))
    if all_["paths"] <= BROADCAST_PATHS:
        sites = F.broadcast(sites)
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")

    def odds(x: Column) -> Column:
        return x / (1 - x)

    doc = F.col("evidence") / MICRO
    both = odds(doc) * odds(F.col("path_quality")) / F.lit(mean / (1 - mean))
    new = {"host": F.col("host"), "evidence": doc, "host_quality": F.col("host_quality"), "path_quality": F.col("path_quality"), "posterior": both / (1 + both)}
    taken = {f"{prefix}{n}".lower() for n in new}
    return out.select(*[F.col(inner[c]).alias(c) for c in columns or docs.columns if c.lower() not in taken], *[x.alias(f"{prefix}{n}") for n, x in new.items()])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose posterior is at least `least`, with the columns of docs.

    Nulls, empty and long texts, repeated rows and empty tables as in judge(); without labels nothing is rejected.
    """
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    judged = judge(docs, fit(docs, labels), prefix=prefix)
    return judged.where(F.col(f"{prefix}posterior") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
