"""Secrets that are harmless where they come first, against a plain scan that judges every match at its own place."""

import hashlib

import regex
from pyspark.sql import functions as F

from codelattice.llm import secrets

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TEXTS = [
    f"merged in commit {KEY} of main, and then token = \"{KEY}\" was set",
    f'token = "{KEY}" was set, merged in commit {KEY} of main',
    f"merged in commit {KEY} of main, sha1 {KEY}.",
    f"sha256: {KEY}{KEY[:24]} and then api_key = {KEY}",
    "commit " + " ".join([KEY] * 5) + f" 日本 İ {KEY[::-1]}/{KEY[:18]} secret: '{KEY}'",
    f"{KEY}", f"token={KEY}\nabcdefgh12345678 abcdefgh12345679 abcdefgh12345670 abcdefgh12345671 {KEY}", "", "nothing here",
]


def plain(spark, text, path, trees):
    """start, times, probability and hash of each secret; features by Spark, places by plain Python."""
    found = [(m[0], m.start()) for m in regex.finditer(secrets.CANDIDATE, text)]
    if not found:
        return []
    rows = [(i, v, text[max(0, at - secrets.BEFORE) : at], text[at + len(v) : at + len(v) + secrets.AFTER], path) for i, (v, at) in enumerate(found)]
    frame = spark.createDataFrame(rows, "i int, value string, before string, after string, path string")
    made = F.struct(*[x.alias(f"f{k}") for k, x in enumerate(secrets.features(*map(F.col, ("value", "before", "after", "path"))))])
    first = {}
    for r in frame.select("i", "value", made.alias("f")).select("i", "value", secrets.votes(F.col("f"), trees).alias("p")).orderBy("i").collect():
        if r["p"] >= 0.5:
            first.setdefault(r["value"], round(r["p"], 9))
    return sorted((text.index(v), text.count(v), p, hashlib.sha256(v.encode()).hexdigest()) for v, p in first.items())


def test_every_match_is_judged_at_its_own_place(spark):
    trees = secrets.train(spark)
    docs = spark.createDataFrame([(i, t, "src0") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = {i: [] for i in range(len(TEXTS))}
    for r in secrets.scan(docs, trees=trees).collect():
        got[r["doc_id"]].append((r["start"], r["times"], round(r["probability"], 9), r["sha256"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: plain(spark, t, "src0", trees) for i, t in enumerate(TEXTS)}
    assert len(got[0]) == 1 and len(got[2]) == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, trees=trees).collect()}
    assert KEY not in clean[0] and KEY not in clean[1] and clean[2] == TEXTS[2]
