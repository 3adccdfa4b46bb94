"""Operator 9: near-duplicates by SuperMinHash, banding, verification on full sets, and components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.common import BROADCAST_IDS, LOWER, arrow_rows, forget, id_and_text, mix64, numbered, ragged, slices, split_words, stored, without, word_hashes
from postmill.llm.components import components

#: Slots of a signature: a prime, so that a * rank + b runs over all slots.
SLOTS = 577
#: 72 bands of 8: a pair of similarity 0.8 shares none with probability 2e-6, if a band's slots are independent.
BANDS, BAND_ROWS = 72, 8
#: Slots in the order in which bands take them. An element visits slots in even steps, so that one with a small step
#: would meet every band of consecutive slots.
DEALT = np.argsort(mix64(np.arange(1, SLOTS + 1)))
#: Sets of so many shingles at most also have buckets for themselves and for what is left without each one shingle: in
#: sets so small a band's slots aren't independent, and similar ones differ by one shingle.
SHORT = 9
#: A pair is linked if SIMILAR[1] * intersection >= SIMILAR[0] * union.
SIMILAR = (80, 100)
#: Rounds in which buckets that span components compare their members with one of them, drawn by hash.
ROUNDS = 2
#: Members of a bucket's part, whose pairs one row stands for.
CHUNK = 128
#: Rows that Python gets at once where each holds two full sets, and where each holds two such parts.
SET_ROWS, PART_ROWS = 500, 4


def shingle_sets(texts: pa.Array, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, and their offsets by text.

    A text of fewer words than `width` has its whole sequence as one shingle, one without words has none.
    """
    codes, at, words = split_words(texts, LOWER)
    hashed = word_hashes(words)
    n_words = np.diff(at)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    first = ragged(at[:-1], count)
    owner = np.repeat(np.arange(len(count)), count)
    own = n_words[owner]
    with np.errstate(over="ignore"):
        h = np.full(len(first), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(width):
            there = k < own
            word = hashed[codes[np.minimum(first + k, len(codes) - 1)]] if len(codes) else np.zeros(0, np.uint64)
            h = np.where(there, mix64(h * np.uint64(3) ^ word), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(count)))))


def super_minhash(sets: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts, slots), uint64: rank in the upper 16 bits, a random fraction below.

    Each element visits the slots in an order of its own; its value in the slot it visits at rank j lies between j and
    j + 1, so a slot that has a value needs no later rank, and a text stops when all its slots have one. Rows of texts
    without elements are all ones.
    """
    n = np.diff(at)
    texts = len(n)
    sig = np.full(texts * slots, ~np.uint64(0), np.uint64)
    open_ = np.ones(texts * slots, bool)
    left = np.where(n > 0, slots, 0)
    owner = np.repeat(np.arange(texts), n)
    step = (mix64(sets ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(slots - 1)).astype(np.int64) + 1
    slot = (mix64(sets ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(slots)).astype(np.int64)
    element, base = sets, owner * slots
    for rank in range(slots):
        if not len(element):
            break
        hit = np.flatnonzero(open_[base + slot])
        if len(hit):
            where = base[hit] + slot[hit]
            with np.errstate(over="ignore"):
                value = mix64(element[hit] + np.uint64(rank + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16) | np.uint64(rank) << np.uint64(48)
            np.minimum.at(sig, where, value)
            filled = np.unique(where)
            open_[filled] = False
            left = left - np.bincount(filled // slots, minlength=texts)
        stay = left[owner] > 0
        if not stay.all():
            element, base, owner, slot, step = element[stay], base[stay], owner[stay], slot[stay], step[stay]
        slot = slot + step
        slot -= slots * (slot >= slots)
    return sig.reshape(texts, slots)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """(texts, bands): one hash for each band of a signature, the band's number mixed in."""
    part = sig[:, DEALT[: bands * rows]].reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E37), (len(sig), bands))
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * np.uint64(5) ^ part[:, :, k])
    return h.view(np.int64)


def short_hashes(sets: np.ndarray, at: np.ndarray, similar: tuple[int, int] = SIMILAR, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of small sets, and their offsets by set: of a set without each one of its shingles, if it and the rest are
    similar enough, and of a whole set, if a set of one shingle more may be similar enough.

    Similar sets of at most `short` shingles share one if they differ by one shingle, more or another.
    """
    need, of = similar
    n = np.diff(at)
    cut = (n <= short) & (of * (n - 1) >= need * n)
    full = (n > 0) & (n < short) & (of * n >= need * (n + 1))
    own = np.repeat(np.arange(len(n)), n)
    there = cut[own]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets))))
        whole = sums[at[1:]] - sums[at[:-1]]
        less = whole[own[there]] - mix64(sets[there])
    owner = np.concatenate((np.flatnonzero(full), own[there]))
    order = np.argsort(owner, kind="stable")
    hashed = mix64(np.concatenate((whole[full], less))[order] ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return hashed.view(np.int64), np.concatenate(([0], np.cumsum(np.where(cut, n, 0) + full)))


def buckets(sets: np.ndarray, at: np.ndarray, similar: tuple[int, int] = SIMILAR) -> pa.ListArray:
    """The buckets of each set: its bands, and its short hashes if it is small. Sets that share none aren't compared."""
    bands, (more, where) = band_hashes(super_minhash(sets, at)), short_hashes(sets, at, similar)
    n = np.diff(where)
    ends = np.concatenate(([0], np.cumsum(n + BANDS)))
    flat = np.empty(int(ends[-1]), np.int64)
    flat[ragged(ends[:-1], np.full(len(n), BANDS))] = bands.ravel()
    flat[ragged(ends[:-1] + BANDS, n)] = more
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def node_ids(sets: np.ndarray, at: np.ndarray) -> list[int | None]:
    """A 64-bit digest of each set; None for an empty one."""
    raw, cut = memoryview(sets.astype("<u8", copy=False)).cast("B"), (at * 8).tolist()
    return [int.from_bytes(hashlib.blake2b(raw[i:j], digest_size=8).digest(), signed=True) if j > i else None for i, j in zip(cut[:-1], cut[1:], strict=True)]


def signatures(docs: DataFrame, width: int = 2, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, node, bands) for each row of (doc_id, text); node is null without words."""

    def run(batches):
        for part in slices(batches, "text", 2 << 20, 1500):
            sets, at = shingle_sets(part.column(1), width)
            node = node_ids(sets, at)
            yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(node, pa.int64()), buckets(sets, at, similar)], names=["doc_id", "n_shingles", "node", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items, short): packed shingle hashes, whole and their lower halves, of the texts in `wanted` (least: their ids, node), one row for each node."""
    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches):
        for part in slices(batches, "text"):
            sets, at = shingle_sets(part.column(1), width)
            raw = sets.astype("<u8", copy=False).tobytes()
            items = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(raw)])
            short = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(sets.astype("<u4").tobytes())])
            yield pa.record_batch([pa.array(node_ids(sets, at), pa.int64()), items, short], names=["node", "items", "short"])

    made = chosen.mapInArrow(run, "node long, items binary, short binary").join(F.broadcast(wanted.select("node")) if few else wanted.select("node"), "node", "left_semi")
    return stored(made.groupBy("node").agg(F.first("items").alias("items"), F.first("short").alias("short")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough."""
    need, of = similar

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = of * both >= need * (len(x) + len(y) - both)
            yield pa.record_batch([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    with arrow_rows(pairs.sparkSession, SET_ROWS):
        return stored(_with_sets(pairs, sets).mapInArrow(run, "u long, v long"), "links")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("y")), "v")
    both = one.join(sets.select(F.col("node").alias("u"), F.col("items").alias("x")), "u")
    return both.select("u", "v", "x", "y")


def _similar_sizes(a: str, b: str, similar: tuple[int, int]):
    return similar[1] * F.least(a, b) >= similar[0] * F.greatest(a, b)


def star_pairs(members: DataFrame, leaders: DataFrame, similar: tuple[int, int], each: int) -> DataFrame:
    """For each node of (bucket, node, size, root), `each` at most of its buckets' leaders (bucket, leader: struct of
    node, size, root) of other components: those that it shares most buckets with."""
    met = members.join(leaders, "bucket").filter((F.col("root") != F.col("leader.root")) & _similar_sizes("size", "leader.size", similar))
    tried = met.groupBy("node", F.col("leader.node").alias("with")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "with")
    return tried.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= each).select(F.col("node").alias("u"), F.col("with").alias("v"))


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def most_in_common(a: list[np.ndarray], b: list[np.ndarray], block: int = 20_000) -> np.ndarray:
    """(len(a), len(b)): an upper bound of each two sets' intersection, from their items' short hashes.

    Items that share a hash only add to it, so it is never too small.
    """
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (a, b)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    common = np.intersect1d(*flat)
    at = [np.minimum(np.searchsorted(common, f), max(len(common) - 1, 0)) for f in flat]
    own = [common[i] == f if len(common) else np.zeros(len(f), bool) for i, f in zip(at, flat, strict=True)]
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(common), block):
        sides, width = [], min(block, len(common) - start)
        for k, x in enumerate((a, b)):
            here = np.flatnonzero(own[k] & (at[k] >= start) & (at[k] < start + width))
            m = np.zeros((len(x), width), np.float32)
            np.add.at(m, (owner[k][here], at[k][here] - start), 1)
            sides.append(m)
        both += sides[0] @ sides[1].T
    return both


def unresolved_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """All pairs of nodes that share a bucket, lie in different components so far, and may be similar enough by an upper
    bound of their intersection.

    Of a bucket, only what lies outside its largest component is paired with all of it. Buckets of one largest component
    make a zone, in which each node stands once, however many buckets it shares; rows carry parts of zones, at most
    about CHUNK nodes each. Pairs of a zone that share no bucket are compared too.
    """
    need, of = similar
    own = rooted(members.select("bucket", "node"), roots)
    per = own.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = per.groupBy("bucket").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("zone")).filter("roots > 1").select("bucket", "zone")
    zones = own.join(main, "bucket").select("zone", "node", "root").distinct()
    sized = zones.groupBy("zone").agg(F.count("*").alias("cnt"))
    rows = zones.join(sized, "zone").join(sets.select("node", "short"), "node")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("cnt") / CHUNK)).cast("int")
    rows = rows.select("zone", (F.col("root") != F.col("zone")).alias("rest"), part.alias("part"), F.struct("node", "root", "short").alias("m"))
    parts = stored(rows.groupBy("zone", "rest", "part").agg(F.collect_list("m").alias("m")), "parts")
    a = parts.filter("rest").select("zone", F.col("part").alias("i"), F.col("m").alias("a"))
    b = parts.select("zone", "rest", F.col("part").alias("j"), F.col("m").alias("b"))
    met = a.join(b, "zone").filter("not rest or i <= j").select((F.col("rest") & (F.col("i") == F.col("j"))).alias("same"), "a", "b")

    def columns(lists, i):
        m = lists[i].values
        return np.asarray(m.field("node")), np.asarray(m.field("root")), [np.frombuffer(x, "<u4") for x in m.field("short").to_pylist()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (na, ra, xa), (nb, rb, xb) = columns(batch.column(1), i), columns(batch.column(2), i)
                both = most_in_common(xa, xb).astype(np.int64)
                total = np.array([len(x) for x in xa])[:, None] + np.array([len(x) for x in xb]) - both
                go = (ra[:, None] != rb) & (of * both >= need * total)
                if batch.column(0)[i].as_py():
                    go &= na[:, None] < nb
                x, y = np.nonzero(go)
                yield pa.record_batch([pa.array(na[x]), pa.array(nb[y])], names=["u", "v"])

    pairs = met.repartition("same", F.xxhash64("a.node", "b.node")).mapInArrow(run, "u long, v long")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def united(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))


def near_duplicates(docs: DataFrame, width: int = 2, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document: groups of linked texts.

    Texts with the same shingle set are one node. Nodes that share a band are first compared with their bucket's hub
    (the node with the fullest buckets), then, where a bucket still spans several components, with members drawn by
    hash, and at last with each other unless their short hashes rule a link out; every link is confirmed on full sets.
    Candidates have no cap.

    A null, empty or wordless text has 0 shingles and is linked with nothing; a null id has a null component and is
    kept; repeated rows are linked as copies, and rows of one id but different texts are judged one by one, under that
    id; an empty table gives no rows; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    signed = stored(signatures(docs, width, similar), "signatures")
    reps = stored(signed.filter("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "nodes")
    banded = reps.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("cnt")).filter("cnt > 1")
    members = stored(banded.join(shared, "bucket"), "members")
    sets = sets_of(docs, reps.join(members.select("node").distinct(), "node", "left_semi"), width)

    degree = members.groupBy("node").agg(F.sum("cnt").alias("degree"))
    alone = members.withColumn("root", F.col("node"))
    leader = F.struct("node", "size", "root")
    hubs = alone.join(degree, "node").groupBy("bucket").agg(F.max_by(leader, F.struct("degree", "node")).alias("leader"))
    roots = components(verified(star_pairs(alone, hubs, similar, 2), sets, similar))
    for k in range(ROUNDS):
        own = rooted(members, roots)
        drawn = own.groupBy("bucket").agg(F.min_by(leader, F.struct(F.xxhash64("bucket", "node", F.lit(k)), "node")).alias("leader"))
        roots = united(roots, verified(star_pairs(own, drawn, similar, 6), sets, similar))
    with arrow_rows(docs.sparkSession, PART_ROWS):
        rest = stored(unresolved_pairs(members, roots, sets, similar), "pairs")
    roots = united(roots, verified(rest, sets, similar))
    forget(members, sets, rest)

    least = reps.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    minima = stored(least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "minima")
    few = minima.count() <= BROADCAST_IDS  # then the nodes of one large component needn't meet
    named = least.join(F.broadcast(minima) if few else minima, "root", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **more) -> DataFrame:
    """docs with one row of each group, all columns kept: that of the smallest id, or of none where no row has one.

    Rows are grouped one by one, whatever their ids; of rows with the same id the first one stored stays.
    """
    rows, row = numbered(docs, "rows")
    groups = stored(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **more).select("doc_id", "component_id"), "groups")
    ids = rows.select(F.col(row).alias("doc_id"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")).alias("order"))
    kept = groups.join(ids, "doc_id").groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias("doc_id"))
    return without(rows, row, groups.select("doc_id").join(kept, "doc_id", "left_anti"))
