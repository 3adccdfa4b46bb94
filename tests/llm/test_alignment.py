"""Operator 13 against both libraries and a plain merge, document by document."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm import alignment as A
from postmill.llm.bpe import byte_letters

SF = "/root/testdata/sf0.001/documents.parquet"
BYTE_OF = {c: i for i, c in enumerate(byte_letters())}


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(both, text):
    """(a ids, b ids, groups, links) by whole-text encoding and overlaps of byte ranges."""
    a, b = both
    if not text:
        return [], [], [], []
    e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    left = [(i, bytes(BYTE_OF[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
    want = (" " + text).encode()
    if b"".join(t for _, t in left) != want or b"".join(t for _, t in right) != want:
        return [], [], [], []
    spans = []
    for side in (left, right):
        at, out = 0, []
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        spans.append(out)
    groups, links, i, j, done = [], [], 0, 0, [0, 0]
    while i < len(left) and j < len(right):
        x, y = spans[0][i], spans[1][j]
        links.append((x[0], y[0]))
        i, j = i + (x[2] <= y[2]), j + (y[2] <= x[2])
        if x[2] == y[2]:
            groups.append(",".join(str(s[0]) for s in spans[0][done[0] : i]) + "|" + ",".join(str(s[0]) for s in spans[1][done[1] : j]))
            done = [i, j]
    return e.ids, ids, groups, links


def plain_rows(both, docs):
    got = [plain(both, t) for _, t in docs]
    count = Counter(x for g in got for x in g[3])
    best = {}
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, len(g[0]), len(g[1]), len(g[2]), len(g[3]), sum(count[x] == best[x[1]] for x in g[3]), sum(count[x] for x in g[3]), sha(g[2])) for (d, _), g in zip(docs, got, strict=True)), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


SIGNS = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "\xa0", " ", "　", "é", "漢字", "🙂", "'s", "'", "▁", "<0x41>", "<s>", "<|endoftext|>", "0", "12", ".", "\x00", "\x7f", " ", "ß", "Größe", "-", "\x85"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(SIGNS, max_size=14).map("".join), max_size=5))
def test_chunks_change_nothing(both, texts):
    n_a, n_b, n_groups, n_links, _, pairs, times, groups = (x.to_pylist() for x in A.worker().of(pa.array(texts, pa.string()), True))
    for k, t in enumerate(texts):
        a, b, g, links = plain(both, t)
        assert (n_a[k], n_b[k], n_groups[k], n_links[k], groups[k]) == (len(a), len(b), len(g), len(links), ";".join(g)), t
        assert dict(zip(pairs[k], times[k], strict=True)) == Counter(x << 32 | y for x, y in links)


ODD = [(1, None), (2, ""), (3, " "), (3, " "), (None, "a word"), (None, "a word"), (4, "a ▁ b"), (5, "<|endoftext|> <s> <0x0A>"), (6, "  two  spaces "), (7, "Zürich\n\nlies\t there's 漢字 🙂 x\xa0y"), (8, "word " * 30_000), (9, "漢字" * 3000)]


@pytest.mark.parametrize("frequent", [A.FREQUENT, 3])
def test_rows(spark, both, frequent):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, pair string, row int, n_a int")
    assert rows(A.align_tokens(docs, frequent=frequent)) == plain_rows(both, ODD)


def test_empty(spark):
    assert A.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert rows(A.align_tokens(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table(spark, both):
    docs = spark.read.parquet(SF)
    want = plain_rows(both, [(r["doc_id"], r["text"]) for r in docs.collect()])
    for frequent in (A.FREQUENT, 200):
        assert rows(A.align_tokens(docs, frequent=frequent)) == want


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(A, "CACHE", 3)
    aligner = A.Aligner(A.BYTE_LEVEL, A.PIECES)
    first = [x.to_pylist() for x in aligner.of(pa.array(["one two three four five", "one six"]))]
    aligner.of(pa.array(["seven"]))
    assert len(aligner.known) == 1
    assert [x.to_pylist() for x in aligner.of(pa.array(["one two three four five", "one six"]))] == first
