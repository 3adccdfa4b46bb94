"""Operator 8: exact phrases and near matches of benchmark items, by a positional inverted index of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_and_text, numbered, ragged, slices, split_words, stored, without

#: Lower-cases A-Z and makes every byte that isn't of a word a space: words are [0-9a-z] and bytes from 128 on.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WINDOW = 13
#: Words of documents, and gaps, that one block of the index holds (one longer document stands alone).
BLOCK_WORDS = 1_000_000
#: Words of benchmark items that one pass looks for; more items take more passes.
PASS_WORDS = 500_000
#: A near match: so large a share of a window's words, each within so many words of its place. No place of a window
#: meets two documents, as the gap between them is a window and the slop at both its ends.
NEAR_SHARE, NEAR_SLOP = 0.8, 3
GAP = WINDOW + 2 * NEAR_SLOP

INDEX = "block long, term string, positions binary"
FOUND = "block long, place int, doc_id long, n_words long, hits array<struct<start:long,stop:long>>, items array<string>, near_items array<string>"


class Items:
    """Benchmark items as lists of term numbers, and the terms."""

    def __init__(self, rows: list[tuple]):
        codes, at, words = split_words(pa.array([t or "" for _, t in rows], pa.string()), WORDS)
        self.terms = words
        self.names = ["null" if i is None else str(i) for i, _ in rows]
        self.words = [codes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def passes(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Items]:
    """The items, in groups of about `most` words, one after the other: what driver and workers hold at once is bounded,
    the benchmark isn't."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    rows, held, some = [], 0, False
    for r in benchmark.select(F.col(id_col), F.col(text_col), (size / 5 + 1).cast("long")).orderBy(F.col(id_col)).toLocalIterator():
        if rows and held + r[2] > most:
            yield Items(rows)
            rows, held, some = [], 0, True
        rows.append((r[0], r[1]))
        held += r[2]
    if rows or not some:
        yield Items(rows)


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words of documents: for each block of documents and each term its ascending positions.

    Positions number the words of a block, with a gap between documents. Term '', which no word is, has the gap and the
    block's documents: ids, whether an id is null, and word counts, as 64-bit numbers. It knows no benchmark, so that one
    index serves any number of them. A null text has no words; an empty table gives an empty index.
    """

    def flush(block, ids, counts, found):
        facts = np.concatenate([[gap], [0 if i is None else i for i in ids], [i is None for i in ids], counts]).astype("<i8").tobytes()
        yield pa.record_batch([pa.array([block]), pa.array([""]), pa.array([facts], pa.binary())], names=["block", "term", "positions"])
        spelled = pa.concat_arrays([words for _, words in found]).dictionary_encode()
        number, before = np.asarray(spelled.indices), np.cumsum([0] + [len(words) for _, words in found])
        term = np.concatenate([number[at + codes] for at, (codes, _) in zip(before[:-1], found, strict=True)])
        if not len(term):
            return
        position = np.arange(len(term)) + np.repeat(np.arange(len(ids)) * gap, counts)
        order = np.argsort(term, kind="stable")
        sizes = np.bincount(term, minlength=len(spelled.dictionary))
        ends = np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(position[order].astype("<i4").tobytes())])
        used = pa.array(sizes > 0)  # the empty string stands among a slice's words where white space was at an end
        yield pa.record_batch([pa.array(np.full(len(sizes), block)), spelled.dictionary, lists], names=["block", "term", "positions"]).filter(used)

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids, counts, found, held = [], [], [], 0
        for part in slices(batches, "text"):
            codes, at, words = split_words(part.column(1), WORDS)
            if held and held + len(codes) + gap * part.num_rows > block_words:
                yield from flush(block, ids, np.concatenate(counts), found)
                block, ids, counts, found, held = block + 1, [], [], [], 0
            found.append((codes, words))
            ids += part.column(0).to_pylist()
            counts.append(np.diff(at))
            held += len(codes) + gap * part.num_rows
        if ids:
            yield from flush(block, ids, np.concatenate(counts), found)

    return stored(id_and_text(docs, id_col, text_col).mapInArrow(run, INDEX), "index")


def phrase_hits(positions: np.ndarray, first: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, total: int, most: int = 1 << 20, windows: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every exact occurrence of windows words[starts:starts + lengths] in a block.

    positions[first[t]:first[t + 1]] is term t's ascending list. A window's candidates are the places of its rarest term
    less that term's offset. They are intersected with the list of its next rarest term, less its offset, and so on: a
    candidate stays if a binary search of the list finds it. All windows are taken at once, about `most` candidates and
    `windows` windows at a time. A window with a term that doesn't occur has none.
    """
    none = np.zeros(0, np.int64)
    count = np.diff(first)
    # one ascending array for all lists: a search for (term, position) is one in that term's list
    lists = np.repeat(np.arange(len(count)), count) * (total + 1) + positions
    rare = np.full(len(starts), 1 << 62)
    offsets = np.arange(int(lengths.max(initial=0)))
    for k in offsets:
        rare = np.minimum(rare, np.where(k < lengths, count[words[np.minimum(starts + k, len(words) - 1)]], 1 << 62))
    live = np.flatnonzero((rare > 0) & (lengths > 0))
    found_window, found_place = [none], [none]
    ends = np.cumsum(rare[live])
    lo = 0
    while lo < len(live):
        hi = max(lo + 1, min(lo + windows, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))))
        own = live[lo:hi]
        terms = words[np.minimum(starts[own, None] + offsets, len(words) - 1)]
        order = np.argsort(np.where(offsets < lengths[own, None], count[terms], 1 << 62), axis=1, kind="stable")
        window = np.repeat(np.arange(len(own)), rare[own])
        place = positions[ragged(first[terms[np.arange(len(own)), order[:, 0]]], rare[own])] - order[window, 0]
        keep = (place >= 0) & (place + lengths[own[window]] <= total)
        window, place = window[keep], place[keep]
        for k in offsets[1:]:
            if not len(window):
                break
            at = order[window, k]
            sought = terms[window, at] * (total + 1) + place + at
            there = lists[np.minimum(np.searchsorted(lists, sought), len(lists) - 1)] == sought
            keep = there | (k >= lengths[own[window]])
            window, place = window[keep], place[keep]
        found_window.append(own[window])
        found_place.append(place)
        lo = hi
    return np.concatenate(found_window), np.concatenate(found_place)


def near_places(lists: list[np.ndarray], n: int, share: float, slop: int, span: int = 4, block: int = 5_000) -> np.ndarray:
    """Where a window of n of an item's terms nearly occurs: for some place of the window, enough terms stand within
    `slop` of theirs. One word's position for each such place of the item.

    Any such place has one of a window's spare + 1 rarest terms, so their positions lead to all; those around which too
    many terms are missing within twice the slop are left out before all places near them are tried. `span` times n
    windows are looked for at once.
    """
    spare = n - int(np.ceil(share * n))
    found = []
    for first in range(0, len(lists) - n + 1, span * n):
        own = lists[first : first + span * n + n - 1]
        windows = np.lib.stride_tricks.sliding_window_view(np.array([len(x) for x in own]), n)
        order = np.argsort(windows, axis=1, kind="stable") + np.arange(len(windows))[:, None]

        def standing(at, terms, slop, own=own):
            out = np.full((len(at), len(own)), -1, np.int64)
            for j in terms:
                if len(own[j]):
                    near = own[j][np.minimum(np.searchsorted(own[j], at + (j - slop)), len(own[j]) - 1)]
                    out[:, j] = np.where(np.abs(near - (at + j)) <= slop, near, -1)
            return out

        def windows_left(standing, terms):
            gone = np.zeros((len(standing), standing.shape[1] + 1), np.int32)
            gone[:, 1 + terms] = standing[:, terms] < 0
            gone = np.cumsum(gone, axis=1, dtype=np.int32)
            return gone[:, n:] - gone[:, :-n] <= spare

        seeds = [own[j] - j for j in np.unique(order[:, : spare + 1])]
        seeds = np.unique(np.concatenate(seeds))
        every = np.arange(len(own))
        for i in range(0, len(seeds), block):
            at = seeds[i : i + block]
            for terms in (np.unique(order[:, : spare + 3]), every):
                at = at[windows_left(standing(at, terms, 2 * slop), terms).any(axis=1)] if len(at) else at
            if len(at):
                at = np.unique(at[:, None] + np.arange(-slop, slop + 1))
                there = standing(at, every, slop)
                left = windows_left(there, every)
                for w in np.flatnonzero(left.any(axis=0)):
                    found.append(np.unique(there[left[:, w], w : w + n].max(axis=1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def search(index: DataFrame, items: Items, window: int = WINDOW, near: tuple[float, int] | None = (NEAR_SHARE, NEAR_SLOP)) -> DataFrame:
    """FOUND for each indexed document: hit word ranges (not overlapping), and items with exact or only near windows.

    An item shorter than the window is one window. `block` and `place` tell documents apart, whatever their ids.

    Only the lists of the items' terms leave the index; terms are as many as a pass has words at most. Blocks are
    searched one by one, each with its own postings; which terms are rare is told by the block.
    """
    none = np.zeros(0, np.int64)
    words = np.concatenate([np.asarray(x, np.int64) for x in items.words]) if items.words else none
    length = np.array([len(x) for x in items.words], np.int64)
    each = np.where(length > 0, np.maximum(length - window, 0) + 1, 0)
    owner = np.repeat(np.arange(len(length)), each)
    starts = ragged(np.cumsum(length) - length, each)
    lengths = np.minimum(length, window)[owner]
    needed = window + (2 * near[1] if near else 0)

    def run(key, table):
        table = table.sort_by("number")
        terms, lists = table.column("number").to_numpy(), table.column("positions").combine_chunks()
        facts = np.frombuffer(lists[0].as_buffer(), "<i8")  # number -1
        gap, (ids, null, counts) = int(facts[0]), facts[1:].reshape(3, -1)
        if gap < needed:
            raise ValueError(f"an index with gaps of {gap} words can't be searched for windows that need {needed}")
        start = np.cumsum(counts + gap) - (counts + gap)
        doc_of = lambda p: np.searchsorted(start, p, "right") - 1
        total = int(start[-1] + counts[-1]) if len(counts) else 0
        sizes = np.zeros(len(items.terms), np.int64)
        sizes[terms[1:]] = [len(x.as_buffer()) >> 2 for x in lists[1:]]
        first = np.concatenate(([0], np.cumsum(sizes)))
        positions = np.frombuffer(b"".join([x.as_buffer() for x in lists[1:]]), "<i4").astype(np.int64)
        edge = np.zeros(total + 1, np.int32)
        exact: dict[int, set] = {}
        close: dict[int, set] = {}
        which, place = phrase_hits(positions, first, words, starts, lengths, total)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + lengths[which], -1)
        for d, i in np.unique(np.stack([doc_of(place), owner[which]], 1), axis=0).tolist():
            exact.setdefault(d, set()).add(items.names[i])
        if near:
            held = np.concatenate(([0], np.cumsum(sizes[words] > 0)))  # of a window's terms, enough must occur in the block
            for i in np.unique(owner[held[starts + lengths] - held[starts] >= np.ceil(near[0] * lengths)]).tolist():
                name, own = items.names[i], items.words[i]
                if len(own):
                    lists_ = [positions[first[t] : first[t + 1]] for t in own.tolist()]
                    for d in set(doc_of(near_places(lists_, min(window, len(own)), *near)).tolist()):
                        close.setdefault(d, set()).add(name)
        hit = np.cumsum(edge[:-1]) > 0
        flat = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
        lo, hi = flat[::2], flat[1::2]
        who = doc_of(lo) if len(lo) else none
        at = np.searchsorted(who, np.arange(len(ids) + 1)).astype(np.int32)
        base = start[who] if len(lo) else none
        ranges = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], names=["start", "stop"]))
        names = lambda x, less: pa.array([sorted(x.get(d, set()) - less.get(d, set())) for d in range(len(ids))], pa.list_(pa.string()))
        return pa.table({"block": pa.array(np.full(len(ids), key[0].as_py())), "place": pa.array(np.arange(len(ids), dtype=np.int32)), "doc_id": pa.array(ids, mask=null.astype(bool)), "n_words": pa.array(counts), "hits": ranges, "items": names(exact, {}), "near_items": names(close, exact)})

    numbers = pa.table({"term": pa.concat_arrays([pa.array([""]), items.terms]), "number": pa.array(np.arange(-1, len(items.terms), dtype=np.int32))})
    own = index.join(F.broadcast(index.sparkSession.createDataFrame(numbers)), "term").select("block", "number", "positions")
    return own.groupBy("block").applyInArrow(run, FOUND)


def _merged(found: DataFrame) -> DataFrame:
    """One row for each document of several passes' rows: ranges and items united."""

    def run(batches):
        for b in batches:
            hits = []
            for ranges in b.column("hits").to_pylist():
                out: list = []
                for r in sorted((r["start"], r["stop"]) for r in ranges):
                    if out and r[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], r[1])
                    else:
                        out.append(list(r))
                hits.append([{"start": s, "stop": e} for s, e in out])
            at = b.schema.get_field_index("hits")
            yield b.set_column(at, "hits", pa.array(hits, b.schema.field(at).type))

    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "near_items")}
    rows = found.groupBy("block", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists.values())
    rows = rows.withColumns({"items": F.array_distinct("items"), "near_items": F.array_except("near_items", "items")})
    return rows.mapInArrow(run, FOUND)


def find_items(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: tuple[float, int] | None = (NEAR_SHARE, NEAR_SLOP), pass_words: int = PASS_WORDS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """FOUND for each document of build_index's index; more than pass_words words of items take more passes over it."""
    groups = passes(benchmark, item_col, item_text_col, pass_words)
    found, second = search(index, next(groups), window, near), next(groups, None)
    if second is None:
        return found
    found = stored(found, "found")
    for g in chain([second], groups):
        found = found.unionByName(stored(search(index, g, window, near), "found"))
    return _merged(found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: tuple[float, int] | None = (NEAR_SHARE, NEAR_SLOP), id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """contamination_by of an index of docs made for it."""
    index = build_index(docs, gap=window + (2 * near[1] if near else 0), id_col=id_col, text_col=text_col)
    return contamination_by(index, benchmark, window, near=near, **more)


def contamination_by(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, **more) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_items) for each document of an index.

    contaminated: hit words make 1 / share of all words at least. near_items: ids of items with a window that nearly
    occurs, and none that does. A null or wordless text has no words and isn't contaminated; an item without words
    occurs nowhere; a null item id is named 'null', and rows of one item id count as one item; a null document id stays
    null; repeated documents are judged one by one; an empty benchmark hits nothing; other columns are not read.
    """
    found = find_items(index, benchmark, window, **more)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
    out = found.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.concat_ws(",", F.array_sort("near_items")).alias("near_items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """docs without the rows that are contaminated, all columns kept. Rows are judged one by one, whatever their ids."""
    rows, row = numbered(docs, "rows")
    return without(rows, row, contamination(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, **more).filter("contaminated"))
