"""Search over symbols: matching with BM25, feature vectors of names, graph context, and their fusion."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import DIMENSIONS, bucket, features, words
from ..schema import CALLS, asserted

#: Columns of the index; a phrase or a set of words may lie in any of them.
COLUMNS = ("qualified_name", "name", "file", "signature", "doc")
# The constant of reciprocal rank fusion, and how many times the limit each channel returns to it.
RRF_K, DEEPER = 60, 2
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: A query's pieces: quoted text, words (a star after them asks for a start), signs.
PIECE = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([^\W]+)|([()*:+]))')


class BadQuery(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    """Words that follow each other; `start`: the last is only a word's start. column: where, null for anywhere."""

    words: tuple[str, ...]
    start: bool = False
    column: str | None = None


def split_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def parse_query(query: str, columns: Sequence[str] = COLUMNS) -> tuple | Phrase:
    """A tree of ("and" | "or" | "not", left, right) over phrases: words next to each other are both asked for; AND, OR, NOT, "phrases", a + b, starts*, column: and brackets.

    Text that isn't a query of this kind is one phrase, so that any text is valid.
    """
    try:
        tree, rest = _either(_pieces(query), columns)
        if rest:
            raise BadQuery(query)
        return tree
    except BadQuery:
        return Phrase(split_words(query))


def _pieces(query: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(query.rstrip())
    while at < end:
        m = PIECE.match(query, at)
        if not m:
            raise BadQuery(query)
        kind = "text" if m[1] is not None else "word" if m[2] is not None else "sign"
        out.append((kind, m[1].replace('""', '"') if kind == "text" else m[m.lastindex]))
        at = m.end()
    return out


def _either(pieces: list, columns: Sequence[str]) -> tuple:
    tree, pieces = _both(pieces, columns)
    while pieces[:1] == [("word", "OR")]:
        right, pieces = _both(pieces[1:], columns)
        tree = ("or", tree, right)
    return tree, pieces


def _both(pieces: list, columns: Sequence[str]) -> tuple:
    tree, pieces = _without(pieces, columns)
    while pieces and pieces[0] not in (("word", "OR"), ("sign", ")")):
        right, pieces = _without(pieces[1:] if pieces[0] == ("word", "AND") else pieces, columns)
        tree = ("and", tree, right)
    return tree, pieces


def _without(pieces: list, columns: Sequence[str]) -> tuple:
    tree, pieces = _one(pieces, columns)
    while pieces[:1] == [("word", "NOT")]:
        right, pieces = _one(pieces[1:], columns)
        tree = ("not", tree, right)
    return tree, pieces


def _one(pieces: list, columns: Sequence[str]) -> tuple:
    if pieces[:1] == [("sign", "(")]:
        tree, pieces = _either(pieces[1:], columns)
        if pieces[:1] != [("sign", ")")]:
            raise BadQuery
        return tree, pieces[1:]
    column = None
    if len(pieces) > 1 and pieces[0][0] == "word" and pieces[1] == ("sign", ":"):
        column, pieces = pieces[0][1], pieces[2:]
        if column not in columns:
            raise BadQuery
    words: tuple[str, ...] = ()
    while True:
        if not pieces or pieces[0][0] == "sign" or pieces[0][0] == "word" and pieces[0][1] in ("AND", "OR", "NOT"):
            raise BadQuery
        words, pieces = words + split_words(pieces[0][1]), pieces[1:]
        if pieces[:1] != [("sign", "+")]:
            break
        pieces = pieces[1:]
    start = pieces[:1] == [("sign", "*")]
    return Phrase(words, start, column), pieces[start:]


def occurrences(phrase: Phrase, terms: dict[str, Column]) -> Column:
    """How often a phrase stands in the columns' terms."""
    n, total = len(phrase.words), F.lit(0)
    for name, t in terms.items():
        if n and phrase.column in (None, name):
            hit = lambda x, k: x.startswith(phrase.words[k]) if phrase.start and k == n - 1 else x == phrase.words[k]

            def begins(x: Column, i: Column, t: Column = t) -> Column:
                return reduce(lambda a, k: a & F.coalesce(hit(F.get(t, i + k), k), F.lit(False)), range(1, n), hit(x, 0))

            first = F.filter(t, lambda x, i: begins(x, i)) if n > 1 else F.filter(t, lambda x: hit(x, 0))
            total = total + F.size(first)
    return total


def phrases(tree: tuple | Phrase) -> list[Phrase]:
    """The phrases that a match may hold: all but those after NOT."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(phrases(tree[1]) + (phrases(tree[2]) if tree[0] != "not" else [])))


def match(docs: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS, key: str = "qualified_name") -> DataFrame:
    """id, score: rows that answer a query, with the BM25 score of its phrases. A query without words finds nothing. Missing columns count as empty.

    Nothing is shuffled: one pass counts rows, lengths and the rows of each phrase, a second one filters and scores.
    """
    tree = parse_query(query, columns)
    present = [c for c in columns if c in docs.columns]
    rows = docs.select(F.col(key).alias("id"), *[tokens(F.col(c)).alias(f"t_{c}") for c in present])
    terms = {c: F.col(f"t_{c}") for c in present}
    wanted = phrases(tree)

    def holds(node: tuple | Phrase) -> Column:
        if isinstance(node, Phrase):
            return occurrences(node, terms) > 0
        left, right = holds(node[1]), holds(node[2])
        return left & right if node[0] == "and" else left | right if node[0] == "or" else left & ~right

    length = reduce(lambda a, t: a + F.size(t), terms.values(), F.lit(0))
    stats = rows.agg(F.count("*").alias("n"), F.avg(length).alias("mean"), *[F.count_if(occurrences(p, terms) > 0).alias(f"df{k}") for k, p in enumerate(wanted)]).head()
    mean, score = float(stats["mean"] or 1) or 1.0, F.lit(0.0)
    for k, p in enumerate(wanted):
        tf = occurrences(p, terms)
        idf = math.log(1 + (stats["n"] - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    return rows.where(holds(tree)).select("id", score.alias("score"))


def text_search(docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id, score: the best matches, ties by id."""
    return match(docs, query).orderBy(F.desc("score"), "id").limit(limit)


def vectors(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """id, vector: a text's features counted in DIMENSIONS buckets and scaled to length 1; zeros if there are none."""
    hashed = docs.select(F.col(key).cast("string").alias("id"), F.transform(features(F.coalesce(F.col(text), F.lit(""))), bucket).alias("b"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = [np.bincount(np.asarray(b, np.int64), minlength=DIMENSIONS).astype(np.float32) for b in f["b"]]
            yield pd.DataFrame({"id": f["id"], "vector": [x / max(np.float32(np.sqrt(np.sum(x * x, dtype=np.float32))), np.float32(1e-30)) for x in v]})

    return hashed.mapInPandas(count, "id string, vector array<float>")


def word_buckets(word: str) -> list[int]:
    """The buckets of a word's features: bucket() of itself and of its trigrams."""
    padded, out = f"^{word}$", []
    for feature in (word, *(padded[i : i + 3] for i in range(len(padded) - 2))):
        out.append(reduce(lambda h, b: (h ^ b) * 0xB3 & 255, feature.encode(), 0x25))
    return out


def similar(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """rank() of vectors() of docs (id, text) by a query's vector, with no vector for a row outside its batch.

    A batch's words are hashed once each. Sums of single precision in order of dimension skip only those that the query lacks.
    """
    asked = [(k, np.float32(x)) for k, x in enumerate(vector_of(docs.sparkSession, query)) if x]
    spelled = docs.select(F.col("id").cast("string").alias("id"), words(F.coalesce("text", F.lit(""))).alias("w"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("w"), batch.num_rows
            said = lists.flatten().dictionary_encode()
            known, at = [word_buckets(w) for w in said.dictionary.to_pylist()], said.indices.to_numpy()
            sizes = np.array([len(b) for b in known], np.int64)
            repeats, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
            place = np.repeat(starts - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
            row = np.repeat(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), repeats)
            counts = np.bincount(row * DIMENSIONS + np.array([x for b in known for x in b], np.int64)[place], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)
            length = np.maximum(np.sqrt(np.sum(counts * counts, axis=1, dtype=np.float32)), np.float32(1e-30))
            total = np.zeros(n, np.float32)
            for k, x in asked:
                total += counts[:, k] / length * x
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total)], ["id", "score"])

    return spelled.mapInArrow(score, "id string, score float").where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("float"), lambda s, x: s + x)


def rank(corpus: DataFrame, query_vector: list[float], limit: int) -> DataFrame:
    """id, score: rows with a positive dot product, largest first, ties by id."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query_vector])
    return corpus.select("id", dot(F.col("vector"), q).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def lexical_docs(nodes: DataFrame) -> DataFrame:
    """id, text: what a symbol says itself."""
    return nodes.select(F.col("qualified_name").alias("id"), F.concat_ws(" ", "name", "signature", "doc").alias("text"))


def contextual_docs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, text: a symbol and the names around it by asserted calls, once for every call, in order of name."""
    calls = asserted(edges, CALLS).select("source", "target")
    names = nodes.select("qualified_name", "name")
    both = calls.select(F.col("source").alias("id"), F.col("target").alias("o")).unionByName(calls.select(F.col("target").alias("id"), F.col("source").alias("o")))
    near = both.join(names, F.col("o") == F.col("qualified_name")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("around"))
    return lexical_docs(nodes).join(near, "id", "left").select("id", F.concat_ws(" ", "text", "around").alias("text"))


def vector_of(spark, text: str) -> list[float]:
    return vectors(spark.range(1).select(F.lit("q").alias("id"), F.lit(text).alias("text"))).head()["vector"]


def vector_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return similar(lexical_docs(nodes), query, limit)


def contextual_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return similar(contextual_docs(nodes, edges), query, limit)


def fuse(*channels: DataFrame, limit: int) -> DataFrame:
    """id, score: reciprocal rank fusion of (id, score) channels, each cut to a number of rows that the limit sets."""
    ranked = None
    for c in channels:
        one = c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", (1.0 / (RRF_K + F.col("place"))).alias("part"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """id, score: text, name vectors and graph context fused."""
    deep = limit * DEEPER
    return fuse(text_search(nodes, query, deep), vector_search(nodes, query, deep), contextual_search(nodes, edges, query, deep), limit=limit)


def find_name(nodes: DataFrame, part: str, size: DataFrame, limit: int = 20) -> DataFrame:
    """qualified_name, size: names that contain a part, whatever the case, by size (node, size), then name."""
    hits = nodes.where(F.lower("qualified_name").contains(part.lower())).select("qualified_name")
    out = hits.join(size.withColumnRenamed("node", "qualified_name"), "qualified_name", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return out.orderBy(F.desc("size"), "qualified_name").limit(limit)
