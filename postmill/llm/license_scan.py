"""Operator 11: licences by votes of word k-grams for diagonals of document against template."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import id_and_text, slices, split_words, stored
from postmill.llm.decontamination import WORDS
from postmill.llm.license_texts import NOTICES, PHRASES, TEXTS

#: Words of a gram; a shorter template is one gram.
WIDTH = 3
#: Hundredths of a template's words that its span must have, of notices and of texts.
WHOLE, MOST = 100, 80
#: Diagonals are neighbours up to one in so many of a template's words apart.
SLACK = 8
#: Grams of templates that are broadcast; those of more templates are joined by a shuffle.
BROADCAST_GRAMS = 500_000


class Template(NamedTuple):
    label: str
    text: str
    share: int  # hundredths of its words that a span must have
    phrase: bool = False  # counted place by place, as a base phrase


TEMPLATES = [Template(x, t, WHOLE, True) for x, t in PHRASES] + [Template(x, t, WHOLE) for x, t in NOTICES] + [Template(x, t, MOST) for x, t in TEXTS]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


class Grams:
    """A number for each run of template words: the words' own numbers side by side, so that no two runs share one."""

    def __init__(self, templates: list[Template], width: int):
        self.words = [words_of(t.text) for t in templates]
        if not all(self.words):
            raise ValueError("a template has no words")
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.bits = len(self.number).bit_length()
        if width * self.bits > 62:
            raise ValueError(f"{len(self.number)} words of templates are too many for grams of {width}")
        self.widths = [min(width, len(w)) for w in self.words]

    def of(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """The gram that begins at each place but the last width - 1."""
        n = len(numbers) - width + 1
        out = np.zeros(max(n, 0), np.int64)
        for k in range(width if n > 0 else 0):
            out = out << self.bits | numbers[k : k + n]
        return out

    def rows(self) -> list[tuple[int, int, int]]:
        """(gram, template, place)."""
        return [(int(g), t, j) for t, (words, k) in enumerate(zip(self.words, self.widths, strict=True)) for j, g in enumerate(self.of(np.array([self.number[w] for w in words], np.int64), k))]


def document_grams(texts: pa.Array, grams: Grams) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words of each text, and the places and numbers of its grams of every width that templates have.

    Rolled over all words of the texts at once. A gram with a word that no template has can't meet one and is left out.
    """
    codes, at, words = split_words(texts, WORDS)
    numbers = np.fromiter((grams.number.get(w, 0) for w in words.to_pylist()), np.int64, len(words))[codes]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    places, found, rows = [], [], []
    for k in sorted(set(grams.widths)):
        n = max(len(numbers) - k + 1, 0)
        good = np.ones(n, bool)
        for i in range(k if n else 0):
            good &= (numbers[i : i + n] > 0) & (row[i : i + n] == row[:n])
        p = np.flatnonzero(good)
        places.append(p)
        found.append(grams.of(numbers, k)[p])
        rows.append(row[p])
    p, g, r = (np.concatenate(x) for x in (places, found, rows))
    order = np.argsort(r, kind="stable")
    p, g, r = p[order], g[order], r[order]
    bounds = pa.array(np.searchsorted(r, np.arange(len(at))).astype(np.int32))
    return np.diff(at), pa.ListArray.from_arrays(bounds, pa.array((p - at[r]).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(g))


def _covered(places: str) -> F.Column:
    """How many words the grams of a cluster cover: those of a template or, with the diagonals added, of a document."""
    return F.size(F.array_distinct(F.flatten(F.collect_list(F.expr(f"flatten(transform(js, j -> sequence({places}, {places} + width - 1)))")))))


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each document.

    Grams are joined with the templates' places; each meeting votes for its template's diagonal, the document's place less the
    template's. Neighbouring diagonals of a template become one span, as words left out or put in shift them. A span is
    verified if the words that its grams cover are enough of the template's and half its own at least. Phrases have a place
    for each diagonal with all their grams. score is 1 for a phrase, else the largest part of a template that a verified span
    has, else 0; spans has label:start:end of phrases and verified spans, by start. A null or empty text has no words and no
    labels; repeated rows and null ids are scanned one by one, by a number stored with each; other columns are not read.
    """
    grams = Grams(templates, width)

    def run(batches):
        for part in slices(batches, "text"):
            n, at, gram = document_grams(part.column(1), grams)
            yield pa.record_batch([part.column(0), pa.array(n), at, gram], names=["doc_id", "n_words", "at", "gram"])

    spark = docs.sparkSession
    base = stored(id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, at array<int>, gram array<long>").withColumn("row", F.monotonically_increasing_id()), "grams")
    places = grams.rows()
    small = F.broadcast if len(places) <= BROADCAST_GRAMS else lambda df: df
    known = small(spark.createDataFrame(places, "gram long, template int, j int"))
    about = small(spark.createDataFrame([(i, t.label, len(grams.words[i]), grams.widths[i], t.share, t.phrase) for i, t in enumerate(templates)], "template int, label string, n int, width int, share int, phrase boolean"))
    met = base.select("row", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("row", F.col("x.at").alias("at"), F.col("x.gram").alias("gram")).join(known, "gram")
    # a diagonal has each place of its template once at most
    lines = met.groupBy("row", "template", (F.col("at") - F.col("j")).alias("diagonal")).agg(F.sort_array(F.collect_list("j")).alias("js")).join(about, "template")
    phrases = lines.filter("phrase and size(js) = n - width + 1").select("row", "label", F.lit(True).alias("phrase"), F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n")).alias("end"), F.lit(1.0).alias("part"))
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_template) > F.col("n") / SLACK
    merged = lines.filter("not phrase").withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(by_template))
    spans = merged.groupBy("row", "template", "label", "n", "share", "cluster").agg(
        _covered("j").alias("of_template"), _covered("j + diagonal").alias("of_span"), F.min(F.col("diagonal") + F.element_at("js", 1)).alias("start"), F.max(F.col("diagonal") + F.element_at("js", -1) + F.col("width")).alias("end")
    )
    spans = spans.filter("100 * of_template >= share * n and 2 * of_span >= end - start").select("row", "label", F.lit(False).alias("phrase"), "start", "end", (F.col("of_template") / F.col("n")).alias("part"))
    of_base = lambda c: F.when(F.col("phrase"), F.col(c))
    found = phrases.unionByName(spans).groupBy("row").agg(
        F.count_if("phrase").alias("n_base"), F.min(of_base("start")).cast("long").alias("first_word"), F.max(of_base("start")).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(of_base("label"))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("part").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("start", "end", "label"))), lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ",").alias("spans"),
    )
    none = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "spans": ""}
    return base.select("row", "doc_id", "n_words").join(found, "row", "left").fillna(none).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
