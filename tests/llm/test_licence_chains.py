"""Licence labels and scores by brute force, and libraries as tables."""

import random

import pytest

from auditlake.llm import license_scan
from auditlake.llm.license_texts import LICENSES

MIN, GAP = license_scan.MIN_MATCH, license_scan.MAX_GAP


def brute_cover(doc, template):
    """The most words of a template that a chain of its longest matches covers, by trying all chains."""
    n, m = len(doc), len(template)
    long = []  # per document end the longest suffix in the template
    for e in range(n + 1):
        best = 0
        for l in range(1, e + 1):
            if any(template[j : j + l] == doc[e - l : e] for j in range(m - l + 1)):
                best = l
            else:
                break
        long.append(best)
    matches = []
    for e in range(1, n + 1):
        l = long[e]
        if l >= MIN and (e == n or long[e + 1] != l + 1):
            matches += [(e, j + l, l) for j in range(m - l + 1) if template[j : j + l] == doc[e - l : e]]
    matches.sort()
    value = []
    for i, (e, p, l) in enumerate(matches):
        best = l
        for (d, t, _), v in zip(matches[:i], value):
            more = min(l, e - d, p - t)
            if more > 0 and d >= e - l - GAP and d < e:
                best = max(best, v + more)
        value.append(best)
    return max(value, default=0)


@pytest.mark.parametrize("seed", range(6))
def test_chains(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c", b"d"][: 2 + seed % 3]
    templates = [[rng.choice(letters) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    a = license_scan.build(templates, [])
    vocabulary = frozenset(letters)
    for _ in range(250):
        doc = [rng.choice([*letters, b"x"]) if rng.random() < 0.6 else b"" for _ in range(rng.randint(0, 14))]
        doc = [x for x in doc if x] + (rng.choice(templates)[: rng.randint(0, 9)] if rng.random() < 0.7 else []) + [rng.choice([*letters, b"x"]) for _ in range(rng.randint(0, 5))]
        got = license_scan.scan(doc, a, vocabulary)[1]
        assert {k: v[0] for k, v in got.items()} == {k: c for k, t in enumerate(templates) if (c := brute_cover(doc, t))}
        assert all(0 <= start < end <= len(doc) for _, start, end in got.values())


def test_full_texts_label_themselves(spark):
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["river", "stone", "cloud"]) for _ in range(n))
    rows = [(i, f"{noise(30)} {text} {noise(30)}") for i, (_, text) in enumerate(LICENSES)]
    torn = [(100, " ".join(w for k, w in enumerate(LICENSES[0][1].split()) if k % 12)), (101, " ".join(LICENSES[0][1].split()[:40])), (102, noise(200))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows + torn, "doc_id long, text string"))[0].collect()}
    for i, (label, text) in enumerate(LICENSES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        whole = [s for s in got[i].spans if s.label == label and s.share == 1.0]
        assert any(s.start == 30 and s.end == 30 + len(license_scan.words(text.encode())) for s in whole)
    assert "mit" in got[100].labels and 0.8 <= got[100].score <= 1 and got[102].labels == "" and got[102].score == 0


def test_a_library_as_a_table(spark, monkeypatch):
    library = spark.createDataFrame([("own", "these words are our own licence text"), ("none", None), (None, "x"), ("blank", "...")], "label string, text string")
    docs = spark.createDataFrame([(1, "see: These words are our own licence text!"), (2, "mit"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs, templates=library)[0].collect()}
    assert found == {1: ("own", 1.0), 2: ("", 0.0), 3: ("", 0.0)}
    monkeypatch.setattr(license_scan, "LIBRARY_WORDS", 5)
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, templates=library)


def test_repetitive_texts_stay_quick():
    import time

    a = license_scan.build([[b"a"] * 60], [])
    began = time.process_time()
    covered = license_scan.scan([b"a"] * 20000 + [b"x"] + [b"a", b"a", b"a", b"x"] * 3000, a, frozenset([b"a"]))[1][0][0]
    assert covered >= 60 and time.process_time() - began < 30
