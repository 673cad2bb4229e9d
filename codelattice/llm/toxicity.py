"""Operator 7: toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents and unlabelled text only. With class prior p, the risk
of a scorer is p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)]); when the second part
falls below zero, the step goes the other way on it (Kiryo et al., 2017). Features are the words of
the whole text, present or not, out of those that tell the toxic sample best from all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W\d_]+")
#: Documents that the steps of the risk take at most, the smallest by a hash of doc_id: confirmed toxic, unlabelled. All else is counted over all documents that aren't held out.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 16_000
VOCABULARY, LEAST_DOCUMENTS = 1_024, 6
#: A word is a feature if chance explains its share among the toxic with less than exp(-EVIDENCE - log of the words tried).
EVIDENCE = 0.0
#: The class prior lies between these. The first fit takes the greatest, and its scores give the prior of the second.
LEAST_PRIOR, MOST_PRIOR = 1e-4, 0.5
#: Scores before the logistic function are counted by steps of 1 / STEPS.
STEPS = 1_024
#: Scores from here on are predicted as toxic.
THRESHOLD = 0.7


def words(text: str | None) -> set[str]:
    """Distinct lower-case words of a whole text."""
    return set(WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sketch(bag: set[str]) -> str:
    """The three long words with the smallest hashes: mostly the same for copies of a text with some changes."""
    return " ".join(sorted((w for w in bag if len(w) >= 7), key=lambda w: (zlib.crc32(w.encode()), w))[:3]) or " ".join(sorted(bag))


class PuModel:
    """A linear scorer over a vocabulary."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, bias: float):
        self.index, self.weights, self.bias = {w: i for i, w in enumerate(vocabulary)}, weights, bias

    def score(self, text: str | None) -> float:
        index = self.index
        z = self.bias + float(np.sum(self.weights[sorted(index[w] for w in words(text) & index.keys())]))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit_nnpu(positive: list[list[int]], unlabelled: list[list[int]], n: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the course of the risk. positive, unlabelled: feature numbers of each document."""
    w, b, course = np.zeros(n), 0.0, []
    flat = [np.array([i for row in rows for i in row], np.int64) for rows in (positive, unlabelled)]
    owner = [np.repeat(np.arange(len(rows)), [len(r) for r in rows]) for rows in (positive, unlabelled)]
    sizes = [max(1, len(positive)), max(1, len(unlabelled))]
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = [b + np.bincount(o, weights=w[f], minlength=len(rows))[: len(rows)] for f, o, rows in zip(flat, owner, (positive, unlabelled))]
        p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z]
        loss_plus = np.logaddexp(0, -z[0]).mean() if len(z[0]) else 0.0
        loss_minus = np.logaddexp(0, z[0]).mean() if len(z[0]) else 0.0
        rest = (np.logaddexp(0, z[1]).mean() if len(z[1]) else 0.0) - prior * loss_minus
        course.append(float(prior * loss_plus + max(0.0, rest)))
        # slopes of the risk by each document's score
        if rest >= 0:
            slope = [prior * (p[0] - 1) / sizes[0] - prior * p[0] / sizes[0], p[1] / sizes[1]]
        else:
            slope = [prior * p[0] / sizes[0], -p[1] / sizes[1]]
        g = np.zeros(n + 1)
        for f, o, s in zip(flat, owner, slope):
            g[:n] += np.bincount(f, weights=s[o], minlength=n)
            g[n] += s.sum()
        g[:n] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - float(step[n])
    return w, b, course


def fit(docs: DataFrame, labels: DataFrame, seed: int = 3, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> PuModel:
    """The model, learned from documents labelled toxic that aren't held out, and from text alone.

    Words are chosen, and the class prior and the cut found, by counts over all documents that aren't held out; the steps of the risk take the toxic
    documents and a sample of the others. Labels of 0 aren't read. Rows with a null doc_id or label don't count as labelled; a doc_id
    labelled toxic anywhere is; rows that repeat a doc_id are all counted, and one in the sample; null texts are empty ones. Without
    any toxic document every text gets the same low score.
    """
    by_hash = (F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic = 1").where(~held_out(F.col("doc_id")))
    chosen = cut(known.select("doc_id").distinct().orderBy(*by_hash).limit(positive_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                bags = [words(t) for t in batch.column(0).slice(k, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([sketch(x) for x in bags]), pa.array([sorted(x) for x in bags], pa.list_(pa.string()))], ["sketch", "words"])

    # copies say little about words, so one bag stands for all with its sketch; the broadcast side has at most positive_rows numbers
    toxic = texts.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").mapInArrow(distinct_words, "sketch string, words array<string>")
    toxic = cut(toxic.groupBy("sketch").agg(F.min("words").alias("words")))
    n_pos = toxic.count()
    if not n_pos:
        return PuModel([], np.zeros(0), float(np.log(LEAST_PRIOR / (1 - LEAST_PRIOR))))
    least = min(LEAST_DOCUMENTS, max(1, n_pos // 20))
    found = {r["word"]: r["n"] for r in toxic.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}  # words of at most positive_rows texts
    candidates = sorted(found)
    rows = cut(_numbered(texts, candidates))
    n_unl, u = _documents_with(rows, len(candidates))
    p = np.array([found[w] for w in candidates], float)
    lift = (p + 1) / (n_pos + 2) * (n_unl + 2) / (u + 1)
    # the exponent of Chernoff's bound on so many toxic documents, if the word had its share among all
    gain = np.where(lift > 1, p * (np.log(lift) - 1 + 1 / lift), 0.0)
    order = [k for k in np.lexsort((np.arange(len(gain)), -gain)).tolist() if lift[k] > 1 and gain[k] > EVIDENCE + np.log(max(1, int((lift > 1).sum())))]
    place = np.full(len(candidates), -1, np.int64)
    place[order[:VOCABULARY]] = np.arange(len(order[:VOCABULARY]))
    vocabulary = [candidates[k] for k in order[:VOCABULARY]]

    others = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(*by_hash).limit(unlabelled_rows)
    sample = chosen.select("doc_id", F.lit(1).alias("positive")).unionByName(others.select("doc_id", F.lit(0).alias("positive")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.sort(_features(x, place)).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.int32()))], ["positive", "doc_id", "x"])

    drawn = rows.join(F.broadcast(sample), "doc_id").groupBy("positive", "doc_id").agg(F.min("x").alias("x")).mapInArrow(features, "positive int, doc_id long, x array<int>")
    drawn = sorted((r["positive"], r["doc_id"], r["x"]) for r in drawn.collect())  # one row for each of the sample, features only
    positive, unlabelled = [x for one, _, x in drawn if one], [x for one, _, x in drawn if not one]
    sets = cut(_feature_sets(rows, place))

    def scores(w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the toxic sample; those that documents have and how many have each, of all of them."""
        return np.array([_step(b + w[x].sum()) for x in positive]), *_distribution(sets, w, b)

    w, b, _ = fit_nnpu(positive, unlabelled, len(vocabulary), MOST_PRIOR)
    prior = max(LEAST_PRIOR, share_of_positives(*scores(w, b), MOST_PRIOR))
    w, b, _ = fit_nnpu(positive, unlabelled, len(vocabulary), prior)
    return PuModel(vocabulary, w, b + float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(*scores(w, b), prior))


def _numbered(texts: DataFrame, candidates: list[str]) -> DataFrame:
    """doc_id, sketch (hashed) and x, the numbers of the candidates that a text has (ascending, four bytes each), of each row."""
    shared = texts.sparkSession.sparkContext.broadcast(candidates)  # words of the labelled sample, so bounded by it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: k for k, w in enumerate(shared.value)}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                bags = [words(t) for t in part.column(1).to_pylist()]
                x = [np.sort(np.array([index[w] for w in bag & index.keys()], "<u4")).tobytes() for bag in bags]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(bag) for bag in bags]), pa.array(x, pa.binary())], ["doc_id", "sketch", "x"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch string, x binary").select("doc_id", F.xxhash64("sketch").alias("sketch"), "x")


def _documents_with(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """How many different sketches all documents have, and how many of these have each candidate. Tasks count; the driver gets n + 1 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            total[n] += batch.num_rows
            total[:n] += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").astype(np.int64), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    single = rows.groupBy("sketch").agg(F.min("x").alias("x")).select("x")
    out = np.zeros(n + 1, np.int64)
    for r in single.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return int(out[n]), out[:n].astype(float)


def _features(x: bytes, place: np.ndarray) -> np.ndarray:
    """The feature numbers of a text, from those of its candidates."""
    found = place[np.frombuffer(x, "<u4").astype(np.int64)]
    return found[found >= 0]


def _feature_sets(rows: DataFrame, place: np.ndarray) -> DataFrame:
    """x, n: the sets of features that documents have, and how many documents have each; added up by each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(np.sort(_features(x, place)).astype("<u4").tobytes() for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["x", "n"])

    return rows.select("x").mapInArrow(run, "x binary, n long").groupBy("x").agg(F.sum("n").alias("n"))


def _step(z: float) -> float:
    """A score before the logistic function on the grid of STEPS to one, cut at 30 as PuModel cuts it."""
    return float(np.round(np.clip(z, -30, 30) * STEPS) / STEPS)


def _distribution(sets: DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The scores that all documents have, ascending on the grid, and how many have each; at most 60 * STEPS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_step(b + w[np.frombuffer(x, "<u4").astype(np.int64)].sum()) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), batch.column(1)], ["z", "n"])

    got = sorted((r["z"], r["n"]) for r in sets.select("x", "n").mapInArrow(run, "z double, n long").groupBy("z").agg(F.sum("n").alias("n")).collect())
    return np.array([z for z, _ in got], float), np.array([n for _, n in got], float)


def _from_on(scores: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The share of documents that score at least each cut; scores ascend."""
    above = np.append(np.cumsum(weights[::-1])[::-1], 0.0)
    return above[np.searchsorted(scores, cuts)] / max(1.0, float(weights.sum()))


def share_of_positives(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, most: float, least_found: float = 0.3) -> float:
    """The class prior among the unlabelled: at any score, the unlabelled above it are at least that share of the positives above it.

    unlabelled: scores, ascending, and how many documents have each. Only scores that at least least_found of the positives reach are asked.
    """
    cuts = np.unique(positive)
    if not len(cuts):
        return most
    found, flagged = _from_on(np.sort(positive), np.ones(len(positive)), cuts), _from_on(unlabelled, weights, cuts)
    kept = (found >= least_found) & (flagged > 0)
    return float(min(most, (flagged[kept] / found[kept]).min())) if kept.any() else most


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, prior: float) -> float:
    """The score between two neighbours from which on a text counts as toxic: the least non-negative risk, of several the middle of the widest gap."""
    seen = np.unique(np.concatenate([positive, unlabelled]))
    cuts = (seen[1:] + seen[:-1]) / 2
    if not len(cuts):
        return float(seen[0]) + 1.0 if len(seen) else 0.0
    found, flagged = _from_on(np.sort(positive), np.ones(len(positive)), cuts), _from_on(unlabelled, weights, cuts)
    risk = prior * (1 - found) + np.maximum(0, flagged - prior * found)
    return float(cuts[max(np.flatnonzero(risk <= risk.min() + 1e-9), key=lambda k: seen[k + 1] - seen[k])])


def score(docs: DataFrame, model: PuModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; null and empty texts get the score of no word.

    Repeated rows are scored each; a null doc_id is kept and isn't held out; other columns are dropped.
    """

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in text], pa.float64())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
