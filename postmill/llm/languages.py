"""Operator 2: language of a text by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import id_and_text, mix64, slices, utf8

#: Buckets of hashed subwords, and the length of their embeddings.
BUCKETS, DIM = 1 << 13, 16
#: Subword lengths, in bytes, white space and word ends included.
GRAMS = (2, 3, 4)
#: The documented bound of the training sample: so many documents of each language, about, chosen by hash.
SAMPLE = 800
#: Training also sees a short run of so many bytes of each sampled document.
SHORT = 60
#: A prediction is accepted if its calibrated score reaches what gave so large a share of right ones in calibration.
PRECISION = 0.995


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords of the texts, and their offsets by text.

    Texts are lower-cased; every byte that isn't of a letter counts as a space, and runs of spaces as one.
    """
    lower = [t.lower() for t in texts.fill_null("").to_pylist()]
    data, at = utf8(pa.array(lower, pa.string()))
    letter = (data >= 128) | (data >= 97) & (data <= 122)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    starts = at[:-1][at[:-1] < len(data)]
    keep[starts] = letter[starts]
    x = np.where(letter, data, 32)[keep].astype(np.uint32)
    cut = np.concatenate(([0], np.cumsum(keep)))[at]
    reach = max(GRAMS) - 1
    x = np.insert(x, np.repeat(cut[1:], reach), 32)  # no subword looks into the next text
    own = np.ones(len(x), bool)
    own[(cut[1:, None] + reach * np.arange(len(cut) - 1)[:, None] + np.arange(reach)).ravel()] = False
    n, kinds, pad = len(x), [], np.concatenate([x, np.full(reach, 32, np.uint32)])
    for g in GRAMS:
        code = np.full(n, np.uint32(g * 0x1F123BB5 & 0xFFFFFFFF))
        for k in range(g):
            code = (code ^ pad[k : k + n]) * np.uint32(0x01000193)
        kinds.append(((code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(19))[own])
    return np.stack(kinds, 1).ravel().astype(np.int64), cut * len(GRAMS)


@dataclass
class Model:
    """Per-bucket scores of each language (embedding times softmax weights), bias, calibrated temperature and threshold."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        codes, at = features(texts)
        count = np.maximum(np.diff(at), 1)
        logits = np.empty((len(count), len(self.langs)))
        for c in range(len(self.langs)):
            total = np.concatenate(([0.0], np.cumsum(self.scores[codes, c], dtype=np.float64)))
            logits[:, c] = (total[at[1:]] - total[at[:-1]]) / count + self.bias[c]
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: The threshold of a model that learned no language: no score reaches it.
UNTRAINED = 2.0
#: Different values of lang that a model can learn; a column of more isn't one of languages.
LANGUAGES = 1000


def sample(docs: DataFrame, per_language: int, seed: int) -> DataFrame:
    """(doc_id, text, lang): about `per_language` labelled documents of each language, by a hash of their ids. A column of
    more than LANGUAGES different values is refused with ValueError."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} different values")
    if not counts:
        return docs
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return docs.filter(place < F.element_at(share, F.col("lang")))


def fit(labelled: DataFrame, per_language: int = SAMPLE, epochs: int = 12, rate: float = 20.0, seed: int = 5, precision: float = PRECISION) -> Model:
    """Trains on a bounded sample of (doc_id, text, lang) rows; nulls are left out.

    Workers turn each sampled text, whole, and a short run of it into sparse subword shares; the driver gets those
    alone (at most some thousand rows of up to BUCKETS entries) and runs minibatch stochastic gradient descent in
    numpy. A fifth of the documents, by hash, isn't trained on but sets the temperature and the rejection threshold.
    """
    rows = sample(labelled.filter("text is not null and lang is not null and doc_id is not null"), per_language, seed)

    def run(batches):
        for part in slices(batches, "text"):
            ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
            place = mix64(ids.astype(np.uint64))
            short = [t[(a := int(h % max(1, len(t) - SHORT + 1))) : a + 8 + int(h >> 40) % SHORT] for t, h in zip(texts, place.tolist(), strict=True)]
            for which, own in enumerate((texts, short)):
                codes, at = features(pa.array(own, pa.string()))
                out = [np.unique(codes[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch(
                    [part.column(0), part.column(2), pa.array([which] * len(own), pa.int32()), pa.array([k.astype("<i2").tobytes() for k, _ in out], pa.binary()), pa.array([(c / max(1, c.sum())).astype("<f4").tobytes() for _, c in out], pa.binary())],
                    names=["doc_id", "lang", "short", "keys", "shares"],
                )

    got = rows.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, short int, keys binary, shares binary").collect()
    got = sorted((r for r in got if len(r["keys"])), key=lambda r: (r["doc_id"], r["short"], r["lang"], r["keys"]))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, UNTRAINED)
    keys = [np.frombuffer(r["keys"], "<i2").astype(np.int64) for r in got]
    shares = [np.frombuffer(r["shares"], "<f4") for r in got]
    y = np.array([langs.index(r["lang"]) for r in got])
    held = np.array([int(mix64(np.array([r["doc_id"]]).astype(np.uint64))[0] >> np.uint64(50)) % 5 == 0 for r in got])
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))) / len(langs))[y]
    rng = np.random.default_rng(seed)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    for epoch in range(epochs):
        step, order = rate * (1 - epoch / epochs), rng.permutation(train)
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            mean = np.zeros((len(own), BUCKETS), np.float32)
            for i, d in enumerate(own):
                mean[i, keys[d]] = shares[d]
            hidden = mean @ emb
            g = softmax(hidden @ out + bias).astype(np.float32)
            g[np.arange(len(own)), y[own]] -= 1
            g *= (weight[own] / len(own)).astype(np.float32)[:, None]
            used = np.flatnonzero(mean.any(0))
            back = g @ out.T
            out -= step / 20 * hidden.T @ g
            bias -= step / 200 * g.sum(0)
            emb[used] -= step * (mean[:, used].T @ back)
    scores = emb @ out
    judge = np.flatnonzero(held) if held.any() else train
    logits = np.stack([shares[d] @ scores[keys[d]] for d in judge]) + bias
    right = y[judge]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = softmax(logits / temperature)
    order = np.argsort(-p.max(1), kind="stable")
    good = np.cumsum((p.argmax(1) == right)[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(good >= precision)
    threshold = float(p.max(1)[order[enough[-1]]]) if len(enough) else 1.0
    return Model(langs, scores.astype(np.float32), bias.astype(np.float64), float(temperature), threshold)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each whole text; one narrow pass.

    lang_pred is the likeliest learned language, 'und' with score 0 for a null text and one without letters; accepted
    tells whether the calibrated score reaches the model's threshold, so a caller may reject the rest.
    """

    def run(batches):
        for part in slices(batches, "text", 1 << 20):
            p = model.probabilities(part.column(1))
            texts = part.column(1).to_pylist()
            none = np.array([not any(map(str.isalpha, t)) for t in texts], bool) | (model.threshold == UNTRAINED)
            best, score = p.argmax(1), np.where(none, 0.0, p.max(1))
            yield pa.record_batch([part.column(0), pa.array(["und" if e else model.langs[i] for i, e in zip(best, none, strict=True)], pa.string()), pa.array(np.round(score, 6)), pa.array((score >= model.threshold) & ~none)], names=["doc_id", "lang_pred", "score", "accepted"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def identify(docs: DataFrame, **training) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learns from the folds that aren't held out, predicts all rows.

    Only text and lang of rows of those folds are learned from, and only text is an input of a prediction. Without a
    labelled row every prediction is 'und' with score 0, and none is accepted. Repeated rows are predicted one by one; other columns are not read.
    """
    model = fit(docs.filter(fold() != 1).select("doc_id", "text", "lang"), **training)
    return predict(docs, model).withColumn("held_out", fold() == 1).select("doc_id", "held_out", "lang_pred", "score", "accepted")
