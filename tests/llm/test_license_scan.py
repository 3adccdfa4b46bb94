"""Operator 11 against plain searches of words."""

import random

import pytest

from postmill.llm import license_scan as L
from postmill.llm.license_texts import NOTICES, PHRASES, TEXTS

SF = "/root/testdata/sf0.001/documents.parquet"


def plain_base(text):
    words = L.words_of(text or "")
    places = sorted((i, label) for label, phrase in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def plain_spans(words, templates=L.TEMPLATES, width=L.WIDTH):
    """(label, start, end, part) by comparing every gram of the document with every gram of each template."""
    out = []
    for t in templates:
        own = L.words_of(t.text)
        k = min(width, len(own))
        lines: dict[int, list[int]] = {}
        for p in range(len(words) - k + 1):
            for j in range(len(own) - k + 1):
                if words[p : p + k] == own[j : j + k]:
                    lines.setdefault(p - j, []).append(j)
        if t.phrase:
            out += [(t.label, d, d + len(own), 1.0) for d, js in lines.items() if len(js) == len(own) - k + 1]
            continue
        clusters: list[list[int]] = []
        for d in sorted(lines):
            if clusters and d - clusters[-1][-1] <= len(own) / L.SLACK:
                clusters[-1].append(d)
            else:
                clusters.append([d])
        for c in clusters:
            of_template = {j + i for d in c for j in lines[d] for i in range(k)}
            of_span = {d + j + i for d in c for j in lines[d] for i in range(k)}
            start, end = min(of_span), max(of_span) + 1
            if 100 * len(of_template) >= t.share * len(own) and 2 * len(of_span) >= end - start:
                out.append((t.label, start, end, len(of_template) / len(own)))
    return out


def plain_row(doc_id, text):
    n, n_base, first, last, base = plain_base(text)
    found = plain_spans(L.words_of(text or ""))
    spans = ",".join(f"{x}:{s}:{e}" for s, e, x in sorted({(s, e, x) for x, s, e, _ in found}))
    return (doc_id, n, n_base, first, last, base, ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0), spans)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def changed(text, rate, seed):
    """A licence as files have it: some words left out, put in or replaced."""
    r, out = random.Random(seed), []
    for w in L.words_of(text):
        x = r.random()
        if x < rate / 3:
            continue
        out += [w, "inserted"] if x < 2 * rate / 3 else ["other"] if x < rate else [w]
    return " ".join(out)


DOCS = [
    (1, None), (2, ""), (3, "...!"), (None, "the MIT license"), (None, "the MIT license"), (4, "MIT\x00License, mit-license apache  license"), (4, "MIT_License general public LICENSE x"), (5, "mit licenses, emit license, general license"),
    (6, "ＭＩＴ license é Apache\nLicense"), (7, "Licensed under CC BY-NC 4.0. " * 3), (8, "licensed under the gnu general public license version 2"), (9, "licensed under the apache license version 3 0"), (10, "permission is hereby granted " * 200), (11, "mit license " * 5000),
    *((100 + i, f"Copyright of someone. {t} More words of it.") for i, (_, t) in enumerate([*NOTICES, *TEXTS])),
    *((200 + 10 * i + k, f"before {changed(t, 0.02 * k, i)} after {'of the software ' * k}") for i, (_, t) in enumerate(TEXTS) for k in range(8)),
]


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id int, text string, label string, row int, n int")
    got = rows(L.scan_licenses(docs))
    assert got == sorted((plain_row(i, t) for i, t in DOCS), key=str)
    label = {r[0]: r[6].split(",") for r in got}
    for i, (x, _) in enumerate([*NOTICES, *TEXTS]):
        assert x in label[100 + i]
    assert all(TEXTS[i][0] in label[200 + 10 * i + k] for i in range(len(TEXTS)) for k in range(3) if len(TEXTS[i][1]) > 400)
    assert label[8] == ["gpl", "gpl-2.0"] and label[9] == ["apache"] and label[10] == [""]


def test_empty_and_other_templates(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    own = [L.Template("long", "a b c d e f", 50), L.Template("one", "q", 100, True)]
    docs = spark.createDataFrame([(1, "x a b c x q"), (2, "q q a b d e f")], "doc_id long, text string")
    assert rows(L.scan_licenses(docs, own)) == [(1, 6, 1, 5, 5, "one", "long,one", 1.0, "long:1:4,one:5:6"), (2, 7, 2, 0, 1, "one", "long,one", 1.0, "one:0:1,one:1:2,long:4:7")]
    with pytest.raises(ValueError, match="no words"):
        L.scan_licenses(docs, [L.Template("x", "..", 1)])
    with pytest.raises(ValueError, match="too many"):
        L.scan_licenses(docs, own, width=40)


def test_whole_table(spark):
    docs = spark.read.parquet(SF)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert rows(L.scan_licenses(docs)) == want
    assert any(r[6] for r in want)
