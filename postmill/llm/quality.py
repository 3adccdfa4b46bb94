"""Operator 3: perplexity under an interpolated modified Kneser-Ney model of trusted text, cut at quantiles by language.

Symbols are characters and the model is of the symbols of each word, from the space before it to the one after it; no
context spans words, but a word that repeats the one before it begins with a symbol of its own, so that repetition
costs what it is worth in trusted text. The n-grams of all documents, strings of up to five characters, are counted in
one pass, and each different one is scored once, by shuffle joins with the count tables. A document's likelihood is the
sum of its n-grams' scores: those of the most frequent ones are added up in the tasks, the others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import BROADCAST_IDS, forget, numbered, ragged, slices, split_words, stored, sums_by_row, without

ORDER = 5
#: Stands before and after each word, and begins one that repeats the one before it; neither is in a word.
SPACE, REPEAT = " ", "\t"
#: Predicted symbols of one form: longer words are cut, each piece with the context of its first symbol in front.
PIECE = 32
#: n-grams that a task holds before it hands their counts on.
TASK_GRAMS = 600_000
#: The most frequent n-grams, whose scores each task of the last pass gets (some 5 MB); those of others are joined.
HOT = 250_000
#: Bits of a symbol's number where n-grams of one slice are told apart.
WIDTH = 12
#: One in so many trusted documents sets thresholds and isn't counted.
HOLD = 8
#: A document passes up to median + SLACK * (upper quantile - median) of its language's trusted documents: with 1, up to
#: that quantile.
UPPER, SLACK = 0.99, 1.0
#: Symbols at the language's median that each document's own are averaged with.
PRIOR = 40
#: A language's quantiles are averaged with those of all languages, which weigh as much as so many held documents.
LEAST = 30

_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def forms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Codes of the word forms of each text, offsets by text, and of each form the word and whether it is a repeat."""
    codes, at, words = split_words(texts, _DIGITS)
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[at[:-1][at[:-1] < len(codes)]] = False
    both = codes.astype(np.int64) << 1 | again
    there = np.zeros(2 * len(words), bool)
    there[both] = True
    used, codes = np.flatnonzero(there), (np.cumsum(there) - 1)[both]
    return codes, at, words.take(pa.array(used >> 1)), (used & 1).astype(bool)


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes of the forms that make up each text, offsets by text, and the forms: a word with a space at either end, all
    digits as one, and REPEAT after the first space of a repeat. Of a long word each piece is a form; the first begins
    with the space, which isn't predicted, the others with the ORDER - 1 symbols before the piece."""
    codes, at, words, again = forms(texts)
    out, per = [], np.ones(len(words), np.int64)
    for i, (word, repeat) in enumerate(zip(words.to_pylist(), again.tolist(), strict=True)):
        x = f"{SPACE}{REPEAT}{word}{SPACE}" if repeat else f"{SPACE}{word}{SPACE}"
        if len(x) <= PIECE + 1:
            out.append(x)
        else:
            cut = [x[max(0, k - ORDER + 1) : k + PIECE] for k in range(1, len(x), PIECE)]
            out += cut
            per[i] = len(cut)
    if len(out) > len(words):
        start, own = np.cumsum(per) - per, per[codes]
        codes, at = ragged(start[codes], own), np.concatenate(([0], np.cumsum(own)))[at]
    return codes, at, out


def _strings(symbols: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings of the last `length` code points of each row."""
    flat = symbols[np.arange(symbols.shape[1]) >= (symbols.shape[1] - length)[:, None]]
    data = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    size = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(length)))]
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def grams(listed: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different longest n-grams of forms' predicted symbols, which of them each symbol has, and offsets by form."""
    n = np.fromiter(map(len, listed), np.int64, len(listed))
    at = np.concatenate(([0], np.cumsum(n)))
    x = np.frombuffer("".join(listed).encode("utf-32-le"), "<u4")
    kinds, number = np.unique(x, return_inverse=True)
    if len(kinds) >= 1 << WIDTH:  # too many symbols for one number: halves have fewer
        half = len(listed) // 2
        (g1, i1, a1), (g2, i2, a2) = grams(listed[:half]), grams(listed[half:])
        coded = pa.concat_arrays([g1, g2]).dictionary_encode()
        place = np.asarray(coded.indices).astype(np.int64)
        return coded.dictionary, place[np.concatenate((i1, i2 + len(g1)))], np.concatenate((a1, a2[1:] + a1[-1]))
    number = number.astype(np.int64) + 1
    place = np.arange(len(x)) - np.repeat(at[:-1], n)
    key = number.copy()
    for k in range(1, ORDER):
        key[k:] |= np.where(place[k:] >= k, number[:-k] << (WIDTH * k), 0)
    first = np.where(x[at[:-1]] == ord(SPACE), 1, ORDER - 1) if len(listed) else np.zeros(0, np.int64)
    keys, which = np.unique(key[place >= np.repeat(first, n)], return_inverse=True)
    parts = keys[:, None] >> (WIDTH * np.arange(ORDER - 1, -1, -1)) & ((1 << WIDTH) - 1)
    symbols = np.concatenate(([0], kinds))[parts]
    return _strings(symbols, (parts > 0).sum(1)), which.astype(np.int64), np.concatenate(([0], np.cumsum(n - first)))


def corpus_grams(rows: DataFrame) -> DataFrame:
    """(gram, n, trusted) of rows (text, counted): how often each longest n-gram occurs, and how often in counted rows.

    One pass over the texts; each task hands on sums.
    """

    def run(batches):
        held, size = [], 0
        settle = lambda: pa.concat_tables(held).group_by("gram").aggregate([("n", "sum"), ("trusted", "sum")]).rename_columns(["gram", "n", "trusted"])
        for part in slices(batches, "text"):
            codes, at, own = pieces(part.column(0))
            mark = np.repeat(np.asarray(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool), np.diff(at))
            found, which, where = grams(own)
            times = [np.repeat(np.bincount(c, minlength=len(own)), np.diff(where)) for c in (codes, codes[mark])]
            held.append(pa.table({"gram": found} | {k: np.bincount(which, t, len(found)).astype(np.int64) for k, t in zip(("n", "trusted"), times, strict=True)}))
            size += len(found)
            if size > TASK_GRAMS:
                held = [settle()]
                size = held[0].num_rows
                if size > TASK_GRAMS // 2:
                    yield from held[0].to_batches(50_000)
                    held, size = [], 0
        if held:
            yield from settle().to_batches(50_000)

    return rows.select("text", "counted").mapInArrow(run, "gram string, n long, trusted long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def grams_of(form: str) -> Column:
    """The longest n-gram of each predicted symbol of a form."""
    first = f"if(left({form}, 1) = '{SPACE}', 2, {ORDER})"
    return F.expr(f"transform(sequence({first}, length({form})), i -> substring({form}, greatest(1, i - {ORDER - 1}), least(i, {ORDER})))")


def discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from how often counts 1 to 4 occur."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.01), k) for k, d in ((0.99, 1 - 2 * y * n2 / n1), (1.9, 2 - 3 * y * n3 / n2), (2.9, 3 - 4 * y * n4 / n3))]


def _discount(d: list[float], n: Column) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(counts: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(gram, logp), (context, loggamma) and the log probability of an unknown symbol, of corpus_grams()' trusted counts.

    Counts of the longest n-grams are as they are, also those of shorter ones at a word's start; all others count the
    different symbols to their left. Each order is joined by context with its sums and by suffix with the order below.
    """
    top = counts.filter("trusted > 0").select("gram", F.col("trusted").alias("n"))
    levels = {ORDER: top.filter(F.length("gram") == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        ahead = levels[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels[k] = stored(top.filter(F.length("gram") == k).unionByName(ahead).groupBy("gram").agg(F.sum("n").alias("n")), f"order{k}")
    kinds = levels[1].count()
    unknown = 1.0 / (kinds + 1)
    below, all_grams, all_contexts = None, [], []
    for k in range(1, ORDER + 1):
        d = discounts({int(r["n"]): r["count"] for r in levels[k].filter("n <= 4").groupBy("n").count().collect()})
        own = levels[k].withColumn("context", F.expr(f"left(gram, {k - 1})"))
        sums = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_discount(d, F.col("n"))).alias("left"))
        own = own.join(sums, "context").withColumn("u", (F.col("n") - _discount(d, F.col("n"))) / F.col("total"))
        gamma = F.col("left") / F.col("total")
        if below is None:
            p = own.select("gram", (F.col("u") + gamma * unknown).alias("p"))
        else:
            p = own.withColumn("suffix", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix").select("gram", (F.col("u") + gamma * F.col("q")).alias("p"))
        below = stored(p, f"p{k}")
        all_grams.append(below.select("gram", F.log("p").alias("logp")))
        all_contexts.append(sums.select("context", F.log(gamma).alias("loggamma")))
    join = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(join(xs[1:]))
    return join(all_grams), stored(join(all_contexts), "contexts"), float(np.log(unknown))


def gram_scores(counts: DataFrame, model: DataFrame, contexts: DataFrame, unknown: float) -> DataFrame:
    """(gram, n, logp): log probability of the last symbol of each n-gram of the corpus after the others.

    Each n-gram and its suffixes are joined with the counted ones: the longest suffix that was counted gives the
    probability, and the contexts of the longer ones their weights; contexts that weren't counted weigh 1.
    """
    each = counts.select("gram", "n", F.explode(F.sequence(F.lit(0), F.length("gram") - 1)).alias("j"))
    each = each.select("gram", "n", "j", F.expr("substring(gram, j + 1)").alias("suffix"), F.expr("substring(gram, j + 1, length(gram) - j - 1)").alias("context"))
    each = each.join(model.withColumnRenamed("gram", "suffix"), "suffix", "left").join(contexts, "context", "left")
    hit = F.min(F.when(F.col("logp").isNotNull(), F.struct("j", "logp"))).alias("hit")
    weights = [F.sum(F.when(F.col("j") == k, F.col("loggamma"))).alias(f"w{k}") for k in range(ORDER)]
    scored = each.groupBy("gram", "n").agg(hit, *weights)
    found, total = F.coalesce("hit.j", F.lit(ORDER)), F.coalesce("hit.logp", F.lit(unknown))
    for k in range(ORDER):
        total = total + F.when(F.lit(k) < found, F.coalesce(f"w{k}", F.lit(0.0))).otherwise(0.0)
    return stored(scored.select("gram", "n", total.alias("logp")), "scores")


def perplexities(docs: DataFrame, scores: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, lang, trusted, nll, symbols) for each row of docs (row, lang, trusted, text): sums over its n-grams.

    Tasks add up the forms all of whose n-grams are among the `hot` most frequent ones. What other forms a document has
    is counted, and their n-grams are joined with the scores and added to it.
    """
    top = scores.orderBy(F.desc("n"), "gram").limit(hot).select("gram", "logp").toArrow()
    known, logp = top.column(0).combine_chunks(), np.append(top.column(1).to_numpy(), 0.0)

    def run(batches):
        for part in slices(batches, "text"):
            codes, at, own = pieces(part.column(3))
            found, which, where = grams(own)
            place = np.asarray(pc.index_in(found, known).fill_null(len(known))).astype(np.int64)[which]
            n = np.diff(where)
            rare = np.bincount(np.repeat(np.arange(len(own)), n)[place == len(known)], minlength=len(own)) > 0
            nll = np.where(rare, 0.0, -sums_by_row(logp[place], where))
            total = np.concatenate(([0.0], np.cumsum(nll[codes])))
            far = np.flatnonzero(rare[codes]) if len(codes) else np.zeros(0, np.int64)
            owner = np.searchsorted(at, far, "right") - 1
            key, times = np.unique(owner << 32 | codes[far], return_counts=True)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(key >> 32, np.arange(len(at))).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(own, pa.string()).take(pa.array(key & 0xFFFFFFFF)), pa.array(times.astype(np.int64))], names=["form", "times"]),
            )
            yield pa.record_batch([*(part.column(i) for i in range(3)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(sums_by_row(n[codes], at)), lists], names=["row", "lang", "trusted", "nll", "symbols", "rare"])

    schema = "row long, lang string, trusted boolean, nll double, symbols long, rare array<struct<form:string,times:long>>"
    first = docs.select("row", "lang", "trusted", "text").mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id())
    first = stored(first, "sums")
    rest = first.select("at", F.explode("rare").alias("r")).select("at", "r.times", F.explode(grams_of("r.form")).alias("gram")).groupBy("at", "gram").agg(F.sum("times").alias("times"))
    rest = rest.join(scores.select("gram", "logp"), "gram").groupBy("at").agg(F.sum(F.col("logp") * F.col("times")).alias("more"))
    return first.join(rest, "at", "left").select("row", "lang", "trusted", (F.col("nll") - F.coalesce("more", F.lit(0.0))).alias("nll"), "symbols")


def judge(docs: DataFrame, labels: DataFrame, upper: float = UPPER, slack: float = SLACK, hot: int = HOT, row_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang, symbols, perplexity, threshold, kept) for each document; doc_id is what row_col has.

    Trusted documents are those that `labels` gives quality 1. The model counts all of them but one in HOLD; those set,
    by language, the median and the upper quantile of the log perplexity, and from both the threshold. perplexity is
    of a document's symbols and PRIOR more at its language's median, so that a few words alone don't decide.

    A null, empty or blank text has no symbols, the median's perplexity, and is kept; a null language, or one
    without trusted documents held, goes by the quantiles of all languages, a rare one nearly so; with no trusted document all are kept; a null id is never trusted; repeated rows
    are judged one by one; other columns of either table are not read.
    """
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    few = trusted.count() <= BROADCAST_IDS
    trusted = trusted.withColumn("good", F.lit(True))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(row_col).cast("long").alias("row"), F.coalesce("text", F.lit("")).alias("text"), lang)
    rows = rows.join(F.broadcast(trusted) if few else trusted, "id", "left").withColumn("trusted", F.coalesce("good", F.lit(False)))
    hold = F.pmod(F.xxhash64("id"), F.lit(HOLD)) == 0
    rows = rows.withColumn("counted", F.col("trusted") & ~hold).withColumn("trusted", F.col("trusted") & hold)
    counts = stored(corpus_grams(rows), "grams")
    scores = gram_scores(counts, *train(counts))
    scored = stored(perplexities(rows, scores, hot), "perplexities")
    forget(counts, scores)
    own = scored.filter(F.col("trusted") & (F.col("symbols") > 0))

    def by_language(x: Column, at: float, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = [F.count("*").alias("n"), F.percentile_approx(x, at, 10_000).alias(name)]
        every = rows.agg(q[1].alias(f"{name}0"))
        own = rows.filter("lang is not null").groupBy("lang").agg(*q).crossJoin(F.broadcast(every))
        return own.select("lang", ((F.col("n") * F.col(name) + LEAST * F.col(f"{name}0")) / (F.col("n") + LEAST)).alias(name)), every

    def with_both(rows: DataFrame, quantiles: tuple[DataFrame, DataFrame]) -> DataFrame:
        return rows.join(F.broadcast(quantiles[0]), "lang", "left").crossJoin(F.broadcast(quantiles[1]))  # one row

    middle = by_language(F.col("nll") / F.col("symbols"), 0.5, "m", own)
    m = F.coalesce("m", "m0")
    x = (F.col("nll") + PRIOR * m) / (F.col("symbols") + PRIOR)
    ends = by_language(F.col("x"), upper, "u", with_both(own, middle).withColumn("x", x).select("lang", "x"))
    out, u = with_both(with_both(scored, middle), ends), F.coalesce("u", "u0")
    limit = m + slack * (u - m)
    return out.select(F.col("row").alias("doc_id"), "lang", "symbols", F.round(F.exp(x), 6).alias("perplexity"), F.round(F.exp(limit), 6).alias("threshold"), F.coalesce(x <= limit, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """docs without those that judge() rejects, all columns kept. Rows are judged one by one, whatever their ids."""
    rows, row = numbered(docs, "rows")
    return without(rows, row, judge(rows, labels, row_col=row, **more).filter("not kept"))
