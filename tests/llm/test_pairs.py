"""Links of documents and vectors, and searches, against plain versions."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codelattice.llm import collision, components, covertree, jaccard, shingles, vectors
from codelattice.llm.vectors import unit

VECTORS = "vec_id long, embedding array<double>, label int"


def union_find(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_near(rows):
    """(doc_id, set size, smallest doc_id linked) of each row."""
    sets, inverted = word_sets([t for _, t in rows]), defaultdict(list)
    pairs = []
    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in inverted[x]:
                shared[j] += 1
            inverted[x].append(k)
        pairs += [(j, k) for j, o in shared.items() if 100 * o >= 75 * (len(s) + len(sets[j]) - o)]
    root, least = union_find(len(rows), pairs), {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return [(d, len(sets[k]), least.get(root[k]) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def key(rows):
    return sorted(((d is not None, d or 0, n, c is not None, c or 0) for d, n, c in rows))


def near(docs, **options):
    return key([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(docs, **options).collect()])


@pytest.mark.parametrize("frequent", [None, 1])
def test_near_copies(real, frequent):
    assert near(real, frequent=frequent) == key(plain_near([(r["doc_id"], r["text"]) for r in real.collect()]))


def variants(seed, groups=6, copies=9):
    """Copies with some words changed, at similarities around the threshold, a passage that all share, and short texts."""
    r = np.random.default_rng(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.integers(0, 400)}" for _ in range(int(r.integers(5, 140)))]
        for _ in range(copies):
            words = list(base)
            for _ in range(int(r.integers(0, 1 + len(base) // 30))):
                words[int(r.integers(0, len(words)))] = f"new{r.integers(0, 10**6)}"
            out.append(" ".join(words) + (" " + passage if r.random() < 0.5 else ""))
    return out + ["a b c", "A b  c", "a b c d e", "a b c d e f", "x", "x", ""]


@pytest.mark.parametrize("seed,frequent", [(0, None), (1, 1), (2, 4)])
def test_near_copies_around_the_threshold(spark, seed, frequent):
    rows = list(enumerate(variants(seed)))
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent) == key(plain_near(rows))


def test_large_groups_over_many_rounds(spark, monkeypatch):
    """Each set is of two of seven passages, so that many sets share signatures and few link, and links lie beyond a group's first sets."""
    monkeypatch.setattr(jaccard, "ROUND_HUBS", (0, 1))
    monkeypatch.setattr(jaccard, "SALTS", 2)
    r = np.random.default_rng(4)
    passages = [" ".join(f"p{g}x{i}" for i in range(45)) for g in range(7)]
    texts = []
    for k in range(80):
        one, two = r.permutation(7)[:2]
        texts.append(" ".join([passages[one], passages[two], *[f"d{k}w{i}" for i in range(int(r.integers(0, 4)))]]))
    rows = list(enumerate(texts))
    expected = plain_near(rows)
    assert 10 < len({c for _, _, c in expected}) < 30
    rounds = []
    compare = jaccard.compare
    monkeypatch.setattr(jaccard, "compare", lambda *a: rounds.append(1) or compare(*a))
    assert near(spark.createDataFrame(rows, "doc_id long, text string"), frequent=4) == key(expected)
    assert len(rounds) >= 4  # two comparisons a round


def test_near_copies_take_few_shuffles(spark):
    """Each shuffle leaves files and tasks, however small the input."""
    rows = list(enumerate(variants(1, groups=3, copies=5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.sparkContext._jsc.sc().newShuffleId()
    assert near(docs, frequent=1) == key(plain_near(rows))
    assert spark.sparkContext._jsc.sc().newShuffleId() - before <= 73  # 77 once, 71 since


def test_near_copies_odd_rows(odd, nothing):
    assert near(odd) == key(plain_near([(r["doc_id"], r["text"]) for r in odd.collect()])) and near(nothing) == []
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {1, 2, 3, 5, 7} <= {r["doc_id"] for r in kept.collect()}


def test_shingles_match_words():
    texts = ["", None, "one", "a b\tc\nd  e f", " A B C D E F G ", "é ü x y z", "q r s t u v"]
    tokens, bounds = shingles.shingle_hashes(*shingles.word_hashes(pa.array(texts)))
    assert [len(set(tokens[a:b].tolist())) for a, b in zip(bounds, bounds[1:])] == [len(s) for s in word_sets(texts)]
    same, at = shingles.shingle_hashes(*shingles.word_hashes(pa.array(["A b C d e", "a B c D E", "a b c d e x"])))
    assert same[0] == same[1] == same[2] and same[3] != same[2]


def test_signatures_are_shared_by_sets_that_link():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 200))
        tokens = np.unique(r.integers(0, 1 << 52, n).astype(np.uint64))
        often = r.random(1 << 12) < r.random()
        other = np.concatenate([tokens[r.random(len(tokens)) < 0.9], r.integers(0, 1 << 52, int(r.integers(0, 1 + n // 6))).astype(np.uint64)])
        if not len(other):
            continue
        other = np.unique(other)
        both = len(np.intersect1d(tokens, other))
        if 100 * both < 75 * (len(tokens) + len(other) - both):
            continue

        def made(x):
            hot = often[(x % np.uint64(1 << 12)).astype(int)]
            order = np.lexsort((x, hot))
            return set(jaccard.signatures_of(x[order], hot[order])[0].tolist())

        assert made(tokens) & made(other)
        assert jaccard.may_link(jaccard.parity(tokens), jaccard.parity(other), 75)


def test_signatures_of_long_frequent_sets_are_few():
    r = np.random.default_rng(6)
    for n in (1_000, 20_000, 100_000):
        tokens = r.permutation(np.unique(r.integers(0, 1 << 52, n).astype(np.uint64)))
        made, _ = jaccard.signatures_of(tokens, np.ones(len(tokens), bool))
        assert len(made) <= 7 * n / 4
        for kept in (0.76, 0.9):  # the least that links, and more
            part = tokens[np.sort(r.permutation(len(tokens))[: int(kept * len(tokens))])]
            assert np.isin(made, jaccard.signatures_of(part, np.ones(len(part), bool))[0]).any()


def test_packed_sets_round_trip():
    for n in (1, 2, 1000):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 52, n).astype(np.uint64))
        assert (jaccard.unpacked(jaccard.packed(x)) == x).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (3, 7), (200, 150), (None, 5)]
    for local in (components.LOCAL_EDGES, 0):
        got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long"), local=local).collect()}
        assert got == {i: 0 for i in range(1, 41)} | {200: 150}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def cloud(seed, n=400, d=16):
    """Scattered vectors, tight groups, chains at the threshold, and exact copies."""
    r = np.random.default_rng(seed)
    x = [r.standard_normal((n, d))]
    for size, spread in ((40, 0.05), (25, 0.2), (60, 0.3)):
        x.append(r.standard_normal(d) + spread * r.standard_normal((size, d)))
    x.append(np.repeat(r.standard_normal((1, d)), 30, axis=0))
    return np.concatenate(x) * r.uniform(0.1, 9, (len(np.concatenate(x)), 1))


@pytest.mark.parametrize("seed,rows", [(0, 8192), (1, 64)])
def test_cover_trees_find_exactly_the_links(spark, seed, rows):
    x = cloud(seed)
    df = spark.createDataFrame([(7 * i - 50, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    hit = unit(x) @ unit(x).T >= 0.95
    np.fill_diagonal(hit, False)
    root = union_find(len(x), zip(*np.nonzero(hit)))
    want = [(7 * i - 50, int(hit[i].sum()), 7 * root[i] - 50, root[i] == i) for i in range(len(x))]
    got = covertree.near_pairs(df, block_rows=rows).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == want


BAD = [(1, None, 1), (2, [0.0, 0.0], None), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (None, [1.0, 1.0], 1)]


def test_cover_tree_odd_vectors(spark):
    df = spark.createDataFrame([*BAD, (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 2), (8, [2.0, 0.0], 2), (9, [1e200, 1e-200], None), (10, [0.0, 1.0], 0), (11, [1.0], 0), (12, [1.0, 0.0, 0.0], 0), (13, [3.0], 0)], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in covertree.near_pairs(df).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 12)}
    assert got == alone | {7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False), 11: (1, 11, True), 13: (1, 11, False)}
    assert covertree.near_pairs(spark.createDataFrame([], VECTORS)).count() == 0
    assert covertree.near_pairs(spark.createDataFrame(BAD[:2], VECTORS)).count() == 2


def test_search_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = unit(np.array([r["embedding"] for r in rows], float)), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in collision.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q, found in got.items():
        cosine = x @ x[int(np.flatnonzero(ids == q)[0])]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(cosine[int(np.flatnonzero(ids == v)[0])] - s) < 1e-12 for _, v, s in found)
        cosine[ids == q] = -2
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-cosine, kind="stable")[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_search_odd_vectors(spark):
    df = spark.createDataFrame([*BAD, (500, [1.0, 0.0, 0.0], 0), (501, [1.0, 0.0, 0.0, 0.0], 0), (50, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (101, [2.0, 0.0], 0), (101, [2.0, 0.0], 0), (99, [-1.0, 0.0], 0)], VECTORS)
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in collision.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 100, 1.0), (50, 2, 101, 1.0), (50, 3, 99, -1.0), (100, 1, 50, 1.0), (100, 2, 101, 1.0), (100, 3, 99, -1.0)]
    assert collision.search(spark.createDataFrame([(50, [1.0], 0)], VECTORS)).count() == 0 and collision.search(spark.createDataFrame([], VECTORS)).count() == 0


def test_search_gives_ties_to_the_smaller_id(spark):
    """Many equal vectors over several shards, some of them scaled by powers of two: the five smallest ids other than the query's own, whatever the shards."""
    r = np.random.default_rng(8)
    one, rest = r.standard_normal(23), r.standard_normal((150, 23))
    rows = [(i, (one * 2.0 ** (i % 3)).tolist() if i % 4 == 1 or i in (0, 50, 100) else rest[i % 150].tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    x, ids = unit(np.array([v for _, v, _ in rows])), np.arange(300)
    for shard_rows in (1_000, 70, 9):
        got = defaultdict(list)
        for row in collision.search(df, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[row["query_id"]].append((row["vec_id"], row["score"]))
        assert set(got) == {0, 50, 100, 150, 200, 250}
        for q, found in got.items():
            score = (x * x[q]).sum(axis=1)
            order = [i for i in np.lexsort((ids, -score)) if i != q][:5]
            if q <= 100 or shard_rows == 9:
                assert [v for v, _ in found] == order
            assert all(s == score[v] for v, s in found)


def test_distinct_rows():
    x = np.array([[1.0, 2.0], [0.0, 1.0], [1.0, 2.0], [-0.0, 1.0]])
    first, group = vectors.distinct_rows(x)
    assert len(first) == 2 and group[0] == group[2] and group[1] == group[3]
