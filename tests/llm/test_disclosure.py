"""Disclosing terms by brute force, what they are generalised to, and spans in linear time."""

import random
import re
import time
from math import log2

import pytest

from auditlake.llm import pii
from auditlake.llm.common import words


def brute(texts):
    """term -> whether it is generalised and to what, by the definition, all in dictionaries."""
    near, contexts, held, total = {}, {}, {}, len(texts)
    split = [set(words(t.encode())) if t else set() for t in texts]
    for n, t in enumerate(texts):
        spans = pii.base_spans(t or "")
        for e, mark, around in pii.contexts(t, spans) if spans else ():
            held.setdefault(e, set()).add(n)
            for w in around:
                near.setdefault((w, e), set()).add(n)
                contexts.setdefault((w, e), set()).add(mark)
    out = {}
    for (w, e), at in near.items():
        share = len(at) / sum(w in s for s in split)
        if len(contexts[w, e]) >= pii.SUPPORT and share >= pii.SHARE and log2(share / (len(held[e]) / total)) >= pii.BITS:
            out[w] = max(out.get(w, 0), len(held[e]))
    general = {}
    for w, h in out.items():
        fit = [w[:n] for n in range(pii.LEAST_PREFIX, len(w)) if h < pii.SHARE * sum(any(x.startswith(w[:n]) for x in s) for s in split)]
        general[w] = fit[-1] if fit else None
    return general


@pytest.mark.parametrize("block", [200_000, 1])
def test_terms_and_spans(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK_TERMS", block)
    rng = random.Random(5)
    filler = lambda k: " ".join(rng.choice(["one", "two", "three", "zephyrs", "zephyric"]) for _ in range(k))
    texts = [f"{filler(9)} Zephyrine wrote to z@x.org about {filler(9)}" for _ in range(6)]
    texts += [f"{filler(9)} Quillfeather called +1 202 555 0147{k} then {filler(3)} 10.0.0.9 ok" for k in range(5)] + [f"{filler(5)} Quillfeather 10.0.0.9 {filler(4)}" for _ in range(5)]
    texts += [filler(12) for _ in range(500)] + ["Zephyrine alone", "Quillfeather alone", None, "", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    got = {bytes(r.term): None if r.general is None else bytes(r.general) for r in pii.disclosing_terms(docs).collect()}
    assert got == want and want[b"zephyrine"] == b"zephyri" and want[b"quillfeather"] is None
    found, name = pii.find_personal_data(docs, clean=True)
    for r in found.collect():
        t = texts[r.doc_id] or ""
        base = pii.base_spans(t)
        low = t.translate({c: c + 32 for c in range(0x41, 0x5B)})
        terms = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if m[0].encode() in want and all(m.end() <= a or b <= m.start() for a, _, b in base)]
        assert [tuple(s) for s in r[name["spans"]]] == sorted([*base, *terms])
    clean = {r.doc_id: r[name["clean"]] for r in found.collect()}
    n = len(texts)
    assert clean[n - 5] == "zephyri* alone" and clean[n - 4] == " alone" and clean[n - 3] is None and clean[n - 2] == ""
    assert "<EMAIL>" in clean[0] and "Zephyrine" not in clean[0]


def test_many_spans_and_terms_are_linear():
    text = "a@b.co secret " * 40000
    began = time.process_time()
    assert len(pii.term_spans(text, pii.base_spans(text), {"secret"})) == 40000
    assert time.process_time() - began < 20


def test_words_inside_spans_are_no_terms():
    assert pii.term_spans("secret@x.org secret", pii.base_spans("secret@x.org secret"), {"secret"}) == [(13, 4, 19)]
    assert pii.term_spans("ab", [(0, 0, 1), (0, 1, 9)], {"ab"}) == []
