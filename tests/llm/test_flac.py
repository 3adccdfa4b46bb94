"""Operator 1: round trips, and an independent bit-by-bit decoder."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postmill.llm import flac
from postmill.llm import media as media_module
from postmill.llm.media import encode_media, media_digests, media_features, payload, pcm_blocks, read_samples


class Reader:
    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def get(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.raw[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return v

    def signed(self, n):
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def crc(raw, poly, bits):
    c = 0
    for b in raw:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & (1 << bits) - 1
    return c


def slow_decode(raw):
    """Frames one after the other, without seek points."""
    at = 4
    while True:
        last, n = raw[at] >> 7, int.from_bytes(raw[at + 1 : at + 4])
        at += 4 + n
        if last:
            break
    out, kinds = [], set()
    while at < len(raw):
        r = Reader(raw)
        r.at = at * 8
        assert r.get(16) == 0xFFF8 and r.get(8) == 0x20 and r.get(8) == 2
        lead = r.get(8)
        while lead & 0x80 and lead & 0x40:
            r.get(8)
            lead = lead << 1 & 0xFF
        head = raw[at : r.at // 8]
        assert r.get(8) == crc(head, 7, 8)
        kind, n = r.get(8) >> 1, 576
        kinds.add(kind)
        if kind == 0:
            x = [r.signed(8)] * n
        elif kind == 1:
            x = [r.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [r.signed(8) for _ in range(order)]
            if kind >= 32:
                bits = r.get(4) + 1
                shift = r.signed(5)
                coefs = [r.signed(bits) for _ in range(order)]
            else:
                shift, coefs = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            assert r.get(2) == 0
            parts = 1 << r.get(4)
            for p in range(parts):
                k = r.get(4)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    q = 0
                    while not r.get(1):
                        q += 1
                    u = q << k | r.get(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coefs, x[::-1])) >> shift))
        r.at = (r.at + 7) // 8 * 8
        assert r.get(16) == crc(raw[at : r.at // 8 - 2], 0x8005, 16)
        out += x
        at = r.at // 8
    return np.array(out), kinds


def cases():
    rng = np.random.default_rng(1)
    walk = (np.cumsum(rng.integers(-2, 3, 5760)) % 256).astype(np.uint8)
    wave = (128 + 100 * np.sin(np.arange(2880) / 9) + rng.integers(-2, 3, 2880)).astype(np.uint8)
    text = payload("Some text, é and the like. ".encode() * 90)
    return [bytes([7]) * 576, bytes(rng.integers(0, 256, 1152).astype(np.uint8)), walk.tobytes(), wave.tobytes(), text, b"\0\xff" * 576, bytes(range(256)) * 9, bytes([0] * 575 + [255])]


def test_round_trips_and_independent_decoder():
    payloads = cases()
    streams = flac.encode(payloads)
    samples, offsets = flac.decode(streams)
    kinds = set()
    for p, s, x, at in zip(payloads, streams, samples, offsets, strict=True):
        assert (x + 128).astype(np.uint8).tobytes() == p and at.tolist() == list(range(0, len(p) + 1, 576))
        y, k = slow_decode(s)
        assert (y == x).all()
        kinds |= k
        for first, count in ((0, 10), (570, 20), (len(p) - 5, 50), (len(p), 3)):
            assert (flac.decode_range(s, first, count) == x[first : first + count]).all()
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=1500), min_size=1, max_size=4))
def test_any_bytes(texts):
    payloads = [payload(t) for t in texts]
    samples, _ = flac.decode(flac.encode(payloads))
    assert [(x + 128).astype(np.uint8).tobytes() for x in samples] == payloads


def test_long_stream_and_frame_numbers():
    p = np.random.default_rng(2).integers(90, 110, 576 * 2100).astype(np.uint8).tobytes()
    (s,) = flac.encode([p])
    assert (flac.decode([s])[0][0] + 128).astype(np.uint8).tobytes() == p
    assert (flac.decode_range(s, 576 * 2099 + 1, 4) + 128).astype(np.uint8).tobytes() == p[576 * 2099 + 1 :][:4]


def test_a_long_stream_is_cut_at_frames(monkeypatch):
    """Whatever the codec works on at once, streams and samples are the same."""
    payloads = [np.random.default_rng(3).integers(60, 120, 576 * n).astype(np.uint8).tobytes() for n in (40, 1, 7)]
    want, samples = flac.encode(payloads), flac.decode(flac.encode(payloads))
    monkeypatch.setattr(flac, "LANES", 9)
    monkeypatch.setattr(flac, "SPAN", 1500)
    assert flac.encode(payloads) == want
    got = flac.decode(want)
    assert all((a == b).all() for a, b in zip(got[0] + got[1], samples[0] + samples[1], strict=True))


def test_features_in_parts():
    x = np.random.default_rng(4).integers(-128, 128, 5000).astype(np.int8)
    y = x.astype(np.int64)
    want = f"min={y.min()};max={y.max()};sum={y.sum()};energy={(y * y).sum()};crossings={((y[1:] < 0) != (y[:-1] < 0)).sum()};variation={np.abs(np.diff(y)).sum()}"
    assert {media_module.features(x, most) for most in (1, 7, 4999, 5000, 1 << 20)} == {want}


def test_very_long_text_takes_bounded_memory():
    """A text of 24 MB: the codec's own arrays stay small, so memory is a few times the text's."""
    code = (
        "import resource, sys; from postmill.llm import flac, media; import pyarrow as pa\n"
        "t = ('some words of a long text, ' * 900000)[:24_000_000]; p = media.payload(t.encode()); s = flac.encode([p])\n"
        "x, _ = flac.decode(s); assert len(x[0]) == len(p) and media.features(x[0].astype('i1'))\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300)
    assert done.returncode == 0 and int(done.stdout) < 700, done


def test_without_seek_points_and_with_few():
    p = cases()[2]
    (s,) = flac.encode([p])
    h = flac.Header(s)
    bare = s[:4] + b"\x80" + s[5:42] + s[h.first :]
    assert (flac.decode([bare, s])[0][0] == flac.decode([s])[0][0]).all()
    points = s[46 : h.first]
    few = s[:42] + b"\x83" + (36).to_bytes(3) + points[:18] + points[18 * 6 : 18 * 7] + s[h.first :]
    assert (flac.decode([few])[0][0] == flac.decode([s])[0][0]).all()
    for first in (0, 576 * 3 + 5, 576 * 6, 576 * 8):
        assert (flac.decode_range(few, first, 700) == flac.decode([s])[0][0][first : first + 700]).all()


def test_escaped_partitions_and_wasted_bits():
    """A hand-made frame: fixed order 0, one partition with raw residuals of 5 bits, one wasted bit."""
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
    x = [(i * 7) % 31 - 15 for i in range(576)]
    for v, n in ((0xFFF82002, 32), (0, 8)):
        put(v, n)
    head = np.packbits(bits).tobytes()
    put(crc(head, 7, 8), 8)
    put(8 << 1 | 1, 8)
    put(1, 1)  # wasted: one bit
    put(0, 6)
    put(15, 4)
    put(5, 5)
    for v in x:
        put(v & 31, 5)
    put(0, -len(bits) % 8)
    frame = np.packbits(bits).tobytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2)
    (s,) = flac.encode([b"\0" * 576])
    bare = s[:4] + b"\x80" + s[5:26] + b"\0" * 16 + frame
    assert flac.decode([bare])[0][0].tolist() == [2 * v for v in x]


@pytest.mark.parametrize("where", [-1, -20, 4, 30, -100])
def test_damage_is_found(where):
    (s,) = flac.encode([cases()[4]])
    h = flac.Header(s)
    at = where if where < 0 else h.first + where if where == 4 else where
    bad = bytearray(s)
    bad[at] ^= 0x10
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode([s[: h.first + 100]])


def test_media_tables(spark):
    texts = ["", None, "a", "é" * 288, "x" * 576, "long " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(3)
    got = {r["doc_id"]: r for r in media_features(docs).collect()}
    assert len(got) == len(texts)
    media = encode_media(docs)
    blocks = pcm_blocks(media).toPandas()
    some = {r["doc_id"]: r["pcm"] for r in read_samples(media, 100, 1000).collect()}
    for i, t in enumerate(texts):
        p = payload((t or "").encode())
        assert len(p) % 576 == 0 and len(p) > 0
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        own = blocks[blocks["doc_id"] == i].sort_values("block")
        pcm = b"".join(own["pcm"])
        assert bytes(b ^ 0x80 for b in pcm) == p and own["sample_offset"].tolist() == list(range(0, len(p), 576))
        assert some[i] == pcm[100:1100]
    assert {k: got[2][k] for k in ("media_sha256", "feature")} == {k: got[6][k] for k in ("media_sha256", "feature")}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media_features(empty).count() == media_digests(encode_media(empty)).count() == 0


def test_features_come_from_stored_tables(spark, monkeypatch):
    """What is lost in the media table or in the table of blocks is noticed."""
    docs = spark.createDataFrame([(1, "some text " * 200), (2, None)], "doc_id long, text string")
    kept, lost = media_module.stored, {"media": {"media": F.expr("substring(media, 1, length(media) - 9)")}, "pcm": {"blocks": F.expr("slice(blocks, 2, 99)")}}
    names = []

    def record(df, name):
        names.append(name)
        return kept(df, name)

    monkeypatch.setattr(media_module, "stored", record)
    assert media_features(docs, 1).count() == 2 and names == ["media", "pcm", "described"]
    for bad, change in lost.items():
        monkeypatch.setattr(media_module, "stored", lambda df, name, bad=bad, change=change: kept(df, name).withColumns(change if name == bad else {}))
        with pytest.raises(Exception, match="FlacError"):
            media_features(docs).collect()
