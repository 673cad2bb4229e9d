"""Packing and wavelet shards: exact round trips against the tokenizers library, and optimal cuts against a plain search."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codelattice.llm import packing, wavelet
from codelattice.llm.queries import vocabulary
from codelattice.llm.tokens import Encoder, encoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


@functools.cache
def loaded(name):
    return Tokenizer.from_file(vocabulary(name))  # as it comes, so that added tokens in a text get their ids


def library(name, texts):
    t = loaded(name)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["", " ", "a  b", "\n\n x", "don't 's 're", "<|endoftext|> <|startoftext|>", "hello<|endoftext|>", "<|ENDOFTEXT|> x <|endoftext", "日本<|endoftext|>\n<|startoftext|>b", "a < b > c", "É́ a ́b Σας ΣΑΣ İx", "²³¼ ªº µ ÿ \x1c\x1d a\x85b\xa0c", "\x00a b\x00", "12 345 a1b2 __x_y", "日本 語　x"]


@pytest.mark.parametrize("name,spaces", [(BYTE, True), (WORD, False)])
def test_ids_are_those_of_the_library(real, name, spaces):
    texts = ODD + [r["text"] for r in real.limit(60).collect()]
    enc = Encoder(vocabulary(name), spaces)
    assert [enc(t).tolist() for t in texts] == library(name, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="latin-1"), max_size=40))
def test_ids_of_any_latin_text(text):
    assert encoder(vocabulary(WORD), False)(text).tolist() == library(WORD, [text])[0]
    assert encoder(vocabulary(BYTE), True)(text).tolist() == library(BYTE, [text])[0]


def plain_cuts(at, penalty, size):
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + size - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= size)
    return best[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=40))
def test_cuts_cost_the_least(steps):
    at, penalty = np.cumsum([0] + [s for s, _ in steps]), np.array([0.0] + [float(p) for _, p in steps])
    path = packing.best_cuts(at, penalty, 10)
    cost = sum(10 - (at[b] - at[a]) + penalty[b] for a, b in zip(path, path[1:]))
    assert path[0] == 0 and path[-1] == len(at) - 1 and cost == plain_cuts(at.tolist(), penalty.tolist(), 10)
    assert all(at[b] - at[a] <= 10 for a, b in zip(path, path[1:]))


def check_pieces(rows, docs):
    """Every id of every document in one piece, pieces gapless in sequences of at most 1024."""
    want = {}
    for doc_id, text in docs:
        ids = np.array([*library(BYTE, [text])[0], 0], "<u4")
        want.setdefault(doc_id, []).append(ids)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, pieces in by_doc.items():
        lengths = sorted(len(x) for x in want[doc_id])
        assert sum(p["length"] for p in pieces) == sum(lengths)
        for p in pieces:
            fits = [x for x in want[doc_id] if len(x) == p["doc_tokens"]]
            assert any(zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in fits)
        if len(want[doc_id]) == 1:
            spans = sorted((p["start"], p["start"] + p["length"]) for p in pieces)
            assert spans[0][0] == 0 and spans[-1][1] == lengths[0] and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in pieces])
        assert [p["offset"] for p in pieces] == [0, *ends[:-1]] and ends[-1] <= packing.SIZE


def test_packing_is_whole_and_tight(real):
    rows = packing.pack(real.coalesce(2), vocabulary(BYTE)).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in real.collect()])
    used, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert sequences <= used / packing.SIZE * 1.03 + 3


def test_packing_odd_rows(odd, nothing):
    check_pieces(packing.pack(odd, vocabulary(BYTE)).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(nothing, vocabulary(BYTE)).count() == 0


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (513, 49_407), (5_000, 300)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint16)
    w = wavelet.WaveletMatrix.of(wavelet.WaveletMatrix.build(x).row())
    assert (w.decode() == x).all()
    for i in range(0, n, max(1, n // 40)):
        v = int(x[i])
        places = np.flatnonzero(x == v)
        assert w.access(i) == v and w.count(v) == len(places) and w.count(v, i, n) == (places >= i).sum()
        assert w.select(v, len(places) - 1) == places[-1] and w.select(v, len(places)) == -1
    assert w.count(65_000) == (0 if top < 65_000 else w.count(65_000))


def test_shards_give_documents_back_in_order(spark, real, odd, nothing, tmp_path):
    for k, (docs, tokens) in enumerate([(real, 1 << 19), (real, 3_000), (odd, 2_000), (nothing, 100)]):
        bounds = wavelet.range_bounds(docs, 3)
        wavelet.write_shards(wavelet.encode(docs, vocabulary(WORD), False, 1, bounds), str(tmp_path / str(k)), len(bounds) + 1, tokens)
        got = wavelet.read_documents(spark.read.schema(wavelet.FILE_SCHEMA).parquet(str(tmp_path / str(k)))).collect()
        want = []
        for r in docs.collect():
            ids = np.array([*library(WORD, [r["text"]])[0], 1], "<u4")
            want.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((d is not None, d or 0, n, c) for d, n, c in want)
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]][: len(ordered)]
        ids = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
        assert ids == sorted(ids)
