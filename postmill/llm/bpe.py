"""Token ids and token counts of a lower-casing BPE vocabulary with word ends.

Both work on the distinct pre-tokens of a slice of documents, which numpy cuts out of the texts' bytes: the
vocabulary's own rules never look across them, so a pre-token has the same tokens in every text. Only those not seen
before by this worker are encoded or merged.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from postmill.llm.common import LOWER, ragged, sums_by_row, utf8

VOCABULARY = "word_bpe_49k.json"
# The rules that pretokens() and Counter follow, as the vocabulary file states them.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
MODEL_RULES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
#: Entries of each of a worker's caches; a full cache starts anew.
CACHE = 200_000


def vocabulary_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of ASCII and of U+0080 to U+017F (0 space, 1 letter, 2 number, 3 other, 4 for Splitter), and the latter's lower case."""
    kinds = [(0, regex.compile(r"\s")), (1, regex.compile(r"\p{L}")), (2, regex.compile(r"\p{N}"))]
    of = lambda c: next((k for k, r in kinds if r.match(c)), 3)
    one = np.full(256, 4, np.uint8)
    one[:128] = [3 if 28 <= b < 32 else of(chr(b)) for b in range(128)]
    two, low = np.zeros(256, np.uint8), np.zeros((256, 2), np.uint8)
    for i in range(256):
        c = chr(0x80 + i)
        lower = c.lower().encode()
        two[i] = of(c) if len(lower) == 2 else 4
        low[i] = list(lower if len(lower) == 2 else c.encode())
    return one, two, low


ONE, TWO, TWO_LOW = _tables()


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For the pre-tokens of all texts: their codes, offsets by text, and the distinct ones, in lower case.

    Runs of letters, single numbers and runs of other signs, as long as a chunk between white space has neither an
    apostrophe nor "<|" nor a letter beyond U+017F; other chunks stay whole and as they are, for Splitter.
    """
    data, at = utf8(texts)
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64), []
    after = np.append(data[1:], np.uint8(0))
    kind, low = ONE[data], np.frombuffer(LOWER, np.uint8)[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC5))
    letter = ((data[lead] - 0xC2).astype(np.int64) << 6) + (after[lead] & 63)
    kind[lead] = kind[lead + 1] = TWO[letter]
    low[lead], low[lead + 1] = TWO_LOW[letter, 0], TWO_LOW[letter, 1]
    space, first = kind == 0, np.zeros(n + 1, bool)
    first[at[:-1]] = True
    first = first[:n]
    cut = first | (kind == 2)
    cut[1:] |= kind[1:] != kind[:-1]
    cut &= (data & 0xC0) != 0x80
    odd = np.flatnonzero((kind == 4) | (data == 39) | (data == 60) & (after == 124))
    if len(odd):
        chunk_start = ~space & (first | np.concatenate(([True], space[:-1])))
        chunk = np.cumsum(chunk_start)
        whole = np.zeros(int(chunk[-1]) + 1, bool)
        whole[chunk[odd]] = True
        whole = whole[chunk] & ~space
        cut = np.where(whole, chunk_start, cut)
        low = np.where(whole, data, low)
    start = np.flatnonzero(cut)
    keep = ~space[start]
    runs = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(np.append(start, n).astype(np.int32)), pa.py_buffer(low)])
    coded = runs.filter(pa.array(keep)).dictionary_encode()
    offsets = np.concatenate(([0], np.cumsum(keep)))[np.searchsorted(start, at)]
    return np.asarray(coded.indices).astype(np.int64), offsets, coded.dictionary.to_pylist()


class Splitter:
    """Splits what pretokens() leaves whole, by the vocabulary file's own normaliser and pattern.

    Files of other rules than those that pretokens() follows are refused with ValueError.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        plain = [x for x in spec["added_tokens"] if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or "<|" not in x["content"]]
        if {k: spec[k] for k in RULES} != RULES or {k: spec["model"].get(k) for k in MODEL_RULES} != MODEL_RULES or plain:
            raise ValueError(f"{path} has other rules of splitting or merging")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.spec = spec
        self.letters = byte_letters()
        self.bytes_of = str.maketrans({c: chr(b) for b, c in enumerate(self.letters)})

    def pieces(self, run: str) -> list[bytes] | None:
        """Pre-tokens of a run, in UTF-8; None for a run with a special string, which only the library handles."""
        if "'" not in run and "<|" not in run and (run.isascii() or max(run) < "ƀ" and "İ" not in run):
            return [run.encode()]
        if "<|" in run and any(s in run for s in self.special):
            return None
        t = self.tokenizer
        return [p.translate(self.bytes_of).encode("latin-1") for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(run))]


class Ids:
    """Token ids by the tokenizers library, each distinct pre-token once."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.model = self.splitter.tokenizer.model
        self.known: dict[str, list[int]] = {}

    def of_piece(self, piece: bytes) -> list[int]:
        letters = self.splitter.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in piece]))]

    def of_run(self, run: str) -> list[int]:
        pieces = self.splitter.pieces(run)
        if pieces is None:
            return self.splitter.tokenizer.encode(run, add_special_tokens=False).ids
        return self.of_piece(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in self.of_piece(p)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, int32, and their n + 1 offsets by text."""
        codes, offsets, distinct = pretokens(texts)
        known, out = self.known, []
        for run in distinct:
            got = known.get(run)
            if got is None:
                got = self.of_run(run)
                if len(known) >= CACHE:
                    known.clear()
                known[run] = got
            out.append(got)
        length = np.fromiter(map(len, out), np.int64, len(out))
        start = np.cumsum(length) - length
        flat = np.fromiter(chain.from_iterable(out), np.int32, int(length.sum()))
        lengths = length[codes]
        return flat[ragged(start[codes], lengths)], np.concatenate(([0], np.cumsum(lengths)))[offsets]


class Counter:
    """Token counts by rank-synchronous merging of ragged numpy arrays, whatever the script; the library counts runs
    with special strings only."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        model = self.splitter.spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in self.splitter.letters], np.int64)
        self.last = np.array([vocab[c + end] for c in self.splitter.letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        used = np.full(max(vocab.values()) + 1, len(pairs), np.int64)  # lowest rank that a symbol takes part in
        np.minimum.at(used, left, np.arange(len(pairs)))
        np.minimum.at(used, right, np.arange(len(pairs)))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.none = keys[order], order.astype(np.int64), len(pairs)
        self.made = made
        #: Ranks whose product may at once take part in a lower rank: those merge one occurrence at a time.
        self.single = used[made] < np.arange(len(pairs))
        self.known: dict[str, int] = {}

    def ranks(self, symbols: np.ndarray, joined: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour; `none` at ends of sequences and for unknown pairs."""
        out = np.full(len(symbols), self.none, np.int64)
        at = np.flatnonzero(joined)
        keys = symbols[at] << 32 | symbols[at + 1]
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[at] = np.where(self.keys[found] == keys, self.rank[found], self.none)
        return out

    def surviving(self, raw: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token (not empty) keeps once no pair has a rank."""
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(length) - 1
        symbols[ends] = self.last[data[ends]]
        counts, owner = length.copy(), np.repeat(np.arange(len(raw)), length)
        while len(symbols):
            joined = np.zeros(len(symbols), bool)
            joined[:-1] = owner[1:] == owner[:-1]
            rank = self.ranks(symbols, joined)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            low = np.repeat(lowest, size)
            hit = (rank == low) & (rank < self.none)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))  # a a a: every other of a run of overlapping pairs
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            keep = nth % 2 == 0
            alone = self.single[rank[at]]
            if alone.any():
                new = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                keep &= ~alone | new
            at = at[keep]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            counts -= np.bincount(owner[at], minlength=len(counts))
            active = np.repeat(lowest < self.none, size) & stay
            symbols, owner = symbols[active], owner[active]
        return counts

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        codes, offsets, distinct = pretokens(texts)
        known, each, todo = self.known, np.zeros(len(distinct), np.int64), []
        for i, run in enumerate(distinct):
            n = known.get(run)
            if n is None:
                pieces = self.splitter.pieces(run)
                if pieces is None:
                    each[i] = len(self.splitter.tokenizer.encode(run, add_special_tokens=False).ids)
                elif pieces:
                    todo.append((i, pieces))
            else:
                each[i] = n
        if todo:
            owner = np.repeat([i for i, _ in todo], [len(p) for _, p in todo])
            each += np.bincount(owner, self.surviving([p for _, x in todo for p in x]), len(distinct)).astype(np.int64)
        if len(known) + len(todo) > CACHE:
            known.clear()
        known.update((distinct[i], int(each[i])) for i, _ in todo[:CACHE])
        return sums_by_row(each[codes], offsets)


_made: dict = {}


def worker(kind: type, path: str):
    """One Ids or Counter for each Python worker and vocabulary."""
    path = vocabulary_path(path)
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
