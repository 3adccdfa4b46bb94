"""Operator 13: two tokenizers' tokens of each text put side by side, and how often ids meet in the corpus."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.bpe import byte_letters, vocabulary_path
from postmill.llm.common import id_and_text, ragged, slices, stored, sums_by_row, utf8

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Aligned chunks that a worker keeps, and the bytes of their groups; a full cache starts anew.
CACHE, CACHE_BYTES = 400_000, 32 << 20
#: Chunks that the libraries get at once.
AT_ONCE = 20_000
#: A pair that more than one in so many rows of (document, pair) is of is frequent: so there are fewer such pairs.
FREQUENT = 10_000
#: B ids are the lower bits of a pair.
BITS = 32


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the chunks of all texts, their offsets by text, and the distinct chunks.

    A text is cut at each space that stands alone between two other signs, none of them white space, and the space
    left out. Neither tokenizer has a token across such a place, and both see each chunk behind a space again.
    """
    data, at = utf8(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64), []
    cut = np.zeros(n, bool)
    # white space beyond ASCII begins with one of four bytes; only behind the space does it matter
    plain = (data > 32) & (data != 127)
    head = plain & (data != 0xC2) & ((data < 0xE1) | (data > 0xE3))
    cut[1:-1] = (data[1:-1] == 32) & plain[:-2] & head[2:]
    first = at[:-1][at[1:] > at[:-1]]
    last = at[1:][at[1:] > at[:-1]] - 1
    cut[first] = cut[last] = False
    start = np.zeros(n + 1, bool)
    start[first] = True
    start[1:] |= cut
    moved = np.concatenate(([0], np.cumsum(~cut)))
    places = np.flatnonzero(start[:n])
    cuts = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(np.append(moved[places], moved[n]).astype(np.int32)), pa.py_buffer(data[~cut])])
    coded = cuts.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), np.searchsorted(places, at), coded.dictionary.to_pylist()


class Table:
    """Bytes of every id of a vocabulary, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.length[ids])]


class Aligned:
    """Aligned chunks as arrays: counts, whether bytes differ, and ragged runs of pairs and of groups as text."""

    def __init__(self, counts=None, bad=None, pairs=None, text=None, size=None):
        self.counts = np.zeros((4, 0), np.int64) if counts is None else counts  # A tokens, B tokens, groups, links
        self.bad = np.zeros(0, bool) if bad is None else bad
        self.pairs = np.zeros(0, np.int64) if pairs is None else pairs
        self.text = np.zeros(0, np.uint8) if text is None else text
        self.size = np.zeros(0, np.int64) if size is None else size  # of each chunk's text

    def extended(self, x: Aligned) -> Aligned:
        return Aligned(np.concatenate((self.counts, x.counts), 1), *(np.concatenate((getattr(self, k), getattr(x, k))) for k in ("bad", "pairs", "text", "size")))


def group_text(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` of each group, given how many ids of either side stand up to its end: ASCII bytes, and their number by group."""
    n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(end_b - n_b, n_a)] = a
    ids[np.arange(len(b)) + np.repeat(end_a, n_b)] = b
    last = end_a + end_b - 1
    sign[last - n_b], sign[last] = ord("|"), ord(";")
    most = len(str(int(ids.max(initial=0))))
    digits = np.ones(len(ids), np.int64)
    for k in range(1, most):
        digits += ids >= 10**k
    end = np.cumsum(digits + 1)
    text = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    text[end - 1] = sign
    for k in range(most):
        has = digits > k
        text[end[has] - 2 - k] = 48 + ids[has] // 10**k % 10
    return text, np.diff(end[last], prepend=0)


class Aligner:
    """Both tokenizers of a worker, and the chunks that it has aligned."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces))
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_table = Table([bytes(byte_of[c] for c in vocab.get(i, "")) for i in range(max(vocab) + 1)])
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError(f"{pieces} has pieces that go on behind a space")
        self.b_table = Table([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.known: dict[str, int] = {}
        self.store = Aligned()

    def encoded(self, new: list[str]) -> list[np.ndarray]:
        """Ids of all chunks by A and by B, then how many each chunk has."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in part], add_special_tokens=False)]
            for side, ids in enumerate((a, self.b.encode(part, num_threads=1))):
                n = np.fromiter(map(len, ids), np.int64, len(part))
                out[side].append(np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())))
                out[2 + side].append(n)
        return [np.concatenate(x) for x in out]

    def align(self, new: list[str]) -> Aligned:
        """The alignment of each chunk; nothing of one whose bytes differ.

        The merge by two pointers goes over all chunks at once: the sorted ends of both sides' tokens, each once, are
        its steps. A step is one link, as its bytes lie within one token of each side; where both sides end, a group does.
        """
        a, b, n_a, n_b = self.encoded(new)
        raw = [b" " + c.encode() for c in new]
        size = np.fromiter(map(len, raw), np.int64, len(new))
        good = np.ones(len(new), bool)
        for ids, n, t in ((a, n_a, self.a_table), (b, n_b, self.b_table)):
            good &= sums_by_row(t.length[ids], np.concatenate(([0], np.cumsum(n)))) == size
        of_a, of_b = np.repeat(good, n_a), np.repeat(good, n_b)
        if not good.all():
            a, b = a[of_a], b[of_b]
        text = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8)
        if ((self.a_table.joined(a) != text) | (self.b_table.joined(b) != text)).any():
            raise ValueError("tokens have other bytes than their text")  # of as many bytes: no vocabulary of these kinds does that
        n_a, n_b, size = (np.where(good, x, 0) for x in (n_a, n_b, size))
        a_end, b_end = np.cumsum(self.a_table.length[a]), np.cumsum(self.b_table.length[b])
        steps = np.union1d(a_end, b_end)
        i, j = np.searchsorted(a_end, steps), np.searchsorted(b_end, steps)
        ends = (a_end[i] == steps) & (b_end[j] == steps)
        bounds = np.concatenate(([0], np.cumsum(size)))
        step_at = np.searchsorted(steps, bounds, "right")
        group_at = np.concatenate(([0], np.cumsum(ends)))[step_at]
        written, length = group_text(a, b, i[ends] + 1, j[ends] + 1)
        return Aligned(np.stack((n_a, n_b, np.diff(group_at), np.diff(step_at))), ~good, a[i] << BITS | b[j], written, sums_by_row(length, group_at))

    def places(self, distinct: list[str]) -> np.ndarray:
        """Where in the store each chunk is, once those not seen are aligned."""
        todo = [c for c in distinct if c not in self.known]
        if self.known and (len(self.known) + len(todo) > CACHE or len(self.store.text) > CACHE_BYTES):
            self.known, self.store, todo = {}, Aligned(), distinct
        if todo:
            done = self.align(todo)
            self.known.update(zip(todo, range(len(self.store.bad), len(self.store.bad) + len(todo)), strict=True))
            self.store = self.store.extended(done)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def of(self, texts: pa.Array, groups: bool = False) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and how often each, and on demand the groups."""
        codes, at, distinct = chunks(texts)
        codes = self.places(distinct)[codes]
        store, rows = self.store, len(at) - 1
        whole = sums_by_row(store.bad[codes].astype(np.int64), at) == 0
        owner = np.repeat(np.arange(rows), np.diff(at))
        if not whole.all():
            used = whole[owner]
            codes, owner = codes[used], owner[used]
            at = np.searchsorted(owner, np.arange(rows + 1))
        n_links = store.counts[3]
        each, start = n_links[codes], np.cumsum(n_links) - n_links
        known, of_pair = np.unique(store.pairs, return_inverse=True)
        many = max(len(known), 1)
        keys, times = np.unique(np.repeat(owner, each) * many + of_pair[ragged(start[codes], each)], return_counts=True)
        cut = pa.array(np.searchsorted(keys, np.arange(rows + 1) * many).astype(np.int32))
        start, each = np.cumsum(store.size) - store.size, store.size[codes]
        written = store.text[ragged(start[codes], each)].tobytes()
        end = np.concatenate(([0], np.cumsum(each)))[at].tolist()
        written = [written[end[k] : max(end[k + 1] - 1, end[k])] for k in range(rows)]
        sha = [hashlib.sha256(t).hexdigest() if t else "" for t in written]
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (known[keys % many] if len(known) else keys, times.astype(np.int32))]
        return [*(pa.array(sums_by_row(c[codes], at)) for c in store.counts), pa.array(sha, pa.string()), *lists, *([pa.array([t.decode() for t in written], pa.string())] if groups else [])]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
_made: dict = {}


def worker(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Aligner:
    """One Aligner for each Python worker and pair of vocabularies."""
    if (byte_level, pieces) not in _made:
        _made[byte_level, pieces] = Aligner(byte_level, pieces)
    return _made[byte_level, pieces]


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]) for each document; one narrow pass.

    pairs holds the distinct linked ids as a << 32 | b and times how many links of the document each has; groups is
    the alignment itself, as the digest has it. A text that is null, empty, or not what its tokens' bytes join to has
    zeros, no pairs and '' for both digest and groups. Merged inside mapInArrow, in slices of some megabytes.
    """

    def run(batches):
        aligner = worker(byte_level, pieces)
        for part in slices(batches, "text"):
            yield pa.record_batch([part.column(0), *aligner.of(part.column(1), groups)], names=["doc_id", *NAMES, *["groups"] * groups])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema + ", groups string" * groups)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, rows, best) of rows (row, pair, times): links and rows with the pair, and whether no pair of its B id has more links."""
    counts = stored(links.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << BITS) - 1).alias("b")
    most = counts.groupBy(b_id).agg(F.max("count").alias("most"))
    return counts.select("*", b_id).join(most, "b").select("pair", "count", "rows", (F.col("count") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document.

    Rows are told by a number that is stored with them, so that null ids and repeated rows are counted one by one. A
    document has each of its pairs once with the number of its links. Those rows are joined with the counts in two
    ways: the frequent pairs, fewer than `frequent` by their definition, are broadcast; the others are shuffled, and
    none of those has more than a `frequent`-th part of the rows. All ties for a B id's highest count are best. An empty
    table gives an empty one; other columns are not read.
    """
    base = stored(aligned(docs, byte_level, pieces, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = base.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = stored(pair_counts(links), "pairs")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot, cold = (counts.filter(c).select("pair", "count", "best") for c in (F.col("rows") * frequent > total, F.col("rows") * frequent <= total))
    hot = F.broadcast(hot)
    met = [links.join(hot, "pair"), links.join(hot.select("pair"), "pair", "left_anti").join(cold, "pair")]
    sums = [x.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")) for x in met]
    sums = sums[0].unionByName(sums[1]).groupBy("row").agg(*(F.sum(k).alias(k) for k in ("n_best", "count_sum")))
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_best", "count_sum")]
    return base.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
