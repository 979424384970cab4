"""Corpus operators against brute force, SQL, exact round trips and held-out accuracy; and odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from auditlake.llm import ann, components, decontaminate, html_text, license_scan, mixing, pii, quality, simhash, token_files, url_filter
from auditlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, "lost key", "en", "s", 8), (3, "word " * 3000, "en", "s", 15000), (3, "word " * 3000, "en", "s", 15000), (4, "\n\t ", None, None, None), (5, "한국어 텍스트 é", "ko", "t", 3)]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators'."""
    d = spark.createDataFrame(ODD, DOC)
    return d.withColumns({"size": F.lit("x"), "fingerprint": F.lit("y"), "spans": F.lit(1), "score": F.lit(2), "Hits": F.lit(3), "items": F.lit(4), "labels": F.lit(5), "part": F.lit(6), "copies": F.lit(7)})


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], SF)


# 1 mixing
def test_mix_targets_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", None]), 1) for i in range(400)]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOC)).select("doc.source", "size", "source_size", "target", "taken", "copies").collect()
    sizes = {s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s) for s in ("a", "b", "c", None)}
    left, open_, target = 1.5 * sum(sizes.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5])), {}
    while True:  # water filling, one round after the other
        over = [s for s, w in open_.items() if left * w / sum(open_.values()) >= 2 * sizes[s]]
        if not over:
            break
        worst = min(over, key=lambda s: sizes[s] / open_[s])
        target[worst] = 2.0 * sizes[worst]
        left -= target[worst]
        del open_[worst]
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 30
    assert all(0 <= r.taken <= 2 * r.size for r in out) and len(out) == 400


def test_mix_odd(spark, odd):
    assert mixing.mix_sources(odd).count() == len(ODD)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(odd.where("false")).count() == 0


# 2 nearest neighbours
def brute_nearest(rows, every=20, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    return {q: [i for _, i in sorted((-float((vq * v).sum()), i) for i, v in ok if i != q)[:k]] for q, vq in ok if q % every == 0}


@pytest.mark.parametrize("exact", [True, False])
def test_nearest(spark, exact):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(12).astype(np.float32)]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [None] * 12), (2004, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute_nearest([r for r in rows if r[0] != 2004]), {}
    for r in ann.nearest(df, exact=exact).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    recall = np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want])
    assert set(got) == set(want) and recall >= (1.0 if exact else 0.9)
    if exact:
        assert got == want


def test_nearest_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(few.where("false")).count() == 0


def test_hilbert_neighbours_are_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = ann.hilbert(points, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# 3 decontamination
def brute_hits(text, items, window=10):
    w, hit, got = decontaminate.words(text.encode() if text else None), set(), set()
    for name, t in items:
        v = decontaminate.words(t.encode() if t else None)
        n = min(window, len(v))
        for s in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit |= set(range(p, p + n))
                    got.add(name)
    return len(hit), sorted(got)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(2)
    sentence = lambda n: " ".join(rng.choice(["a", "b", "the", "of"]) for _ in range(n))
    items = [(str(i), sentence(rng.choice([3, 10, 14]))) for i in range(6)] + [("x", None), ("y", "..."), (None, "a b")]
    texts = [sentence(60) + " " + rng.choice(items[:6])[1] + " " + sentence(5) for _ in range(25)] + [None, "", "A, b! THE"]
    found, name = decontaminate.decontaminate(docs(spark, *texts), spark.createDataFrame(items, "item_id string, text string"))
    for r in found.collect():
        n, got = brute_hits(r.text, [i for i in items if i[0]])
        assert (sum(b - a for a, b in r[name["hits"]]), r[name["items"]]) == (n, got)


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    found, name = decontaminate.decontaminate(odd, bench)
    assert found.where(F.size(name["hits"]) > 0).count() == 2 and found.count() == len(ODD)
    assert decontaminate.decontaminate(odd, bench.where("false"))[0].count() == len(ODD)
    assert decontaminate.decontaminate(odd.where("false"), bench)[0].count() == 0


# 4 licences
def test_automaton_finds_every_substring():
    rng = random.Random(6)
    known = [[rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(12)]
    a = license_scan.build(known, [])
    subs = {tuple(t[i:k]) for t in known for i in range(len(t)) for k in range(i + 1, len(t) + 1)}

    def accepts(s):
        at = 0
        for c in s:
            if c not in a.step[at]:
                return False
            at = a.step[at][c]
        return True

    for _ in range(3000):
        s = tuple(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        assert accepts(s) == (s in subs)


def test_licence_places(spark):
    rng = random.Random(7)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "licensed", "under", "the", "nc", "4", "0"]
    texts = [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(60)] + ["Licensed under the Apache-License, Version 2.0.", None, ""]
    out = license_scan.scan_licenses(docs(spark, *texts), drop=("lang", "source", "n_chars"))[0].collect()
    for r in out:
        w = [x.decode() for x in license_scan.words(r.text.encode() if r.text else None)]
        at = [(i, label) for i in range(len(w)) for p, label in license_scan.PHRASES if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [r.labels for r in out if r.text and "Apache" in r.text] == ["apache-2.0"]


def test_licence_odd(spark, odd):
    found, name = license_scan.scan_licenses(odd)
    assert found.count() == len(ODD) and found.where(f"`{name['score']}` != 0").count() == 0


# 5 urls
def test_url_rules(spark, monkeypatch):
    rules = [("a.com", "/x", "block"), ("com", "/", "allow"), ("b.a.com", "/x", "allow"), ("a.com", "/x", "allow"), ("", "/", "block")]
    urls = ["http://b.a.com/xyz", "http://B.A.COM/y", "http://a.com", "https://a.com/x?q", "a.com/x", None, "http://notacom/", "http://z.a.com:80/x", "http://a.com/x"]
    pages = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(urls)] + [(8, urls[8], "h", 9)], "page_id long, url string, html string, rule int")
    for most in (url_filter.BROADCAST_RULES, 0):  # broadcast and salted
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect())
        assert got == [(0, "b.a.com/x", "allow"), (1, "com/", "allow"), (2, None, "allow"), (3, "a.com/x", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, "a.com/x", "block"), (8, "a.com/x", "block")]
    assert url_filter.filter_urls(pages, spark.createDataFrame(rules[:0], "host string, path string, action string")).count() == 10
    assert url_filter.filter_urls(pages.where("false"), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


# 6 simhash
def brute_print(t):
    import xxhash

    w = (t or "").encode().translate(simhash._LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(values, radius=4):
    root = list(range(len(values)))
    for i in range(len(values)):
        for k in range(i):
            if (values[i] ^ values[k]).bit_count() <= radius:
                a, b = root[i], root[k]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprints_and_groups(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in d] + [(9001, None), (9002, ""), (9003, "  "), (9004, "two words")]
    got = {r.doc_id: (r.fingerprint & (2**64 - 1), r.component) for r in simhash.label_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute_print(t) for _, t in rows]
    ids, root = [i for i, _ in rows], roots(prints)
    least = {r: min(i for i, x in zip(ids, root) if x == r) for r in set(root)}
    assert got == {i: (p, least[r]) for i, p, r in zip(ids, prints, root)}


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_links_of_chains_and_crowds(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(200)}
    for seed in list(values)[:6]:
        v = seed
        for _ in range(30):  # chains that drift away
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    base = rng.getrandbits(64) & ~0xFF
    values = sorted(values | {base | x for x in range(64)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    got = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    for i, r in enumerate(roots(values)):
        same = [s for s, x in zip(signed, roots_of(values)) if x == r]
        assert got.get(signed[i], signed[i]) == min(same)


_ROOTS = {}


def roots_of(values):
    return _ROOTS.setdefault(tuple(values), roots(values))


def test_bit_sliced_distances():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x[100:] = x[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    planes = simhash.planes_of(x)
    for lag in (1, 63, 64, 100, 299):
        lanes = np.zeros(planes.shape[1] * 64 - 64, bool)
        lanes[: 300 - lag] = True
        got = np.unpackbits(simhash.within(planes, lag, np.packbits(lanes, bitorder="little").view(np.uint64)).view(np.uint8), bitorder="little")[: 300 - lag]
        assert (got == (np.bitwise_count(x[lag:] ^ x[: 300 - lag]) <= 4)).all()


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == [(False, None), (True, 1), (True, 3), (True, 5)]
    plain = docs(spark, "a b c d e", "x y z u v", "a b c d e", "A B c d e")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(plain).collect()) == [0, 1]
    assert simhash.drop_near_duplicates(plain.where("false")).count() == 0


# 7 html
PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav>menu</nav><div class="{c}"><header>head</header><div class="post-body"><h2>Ti&amp;tle</h2>
<p>Hello <b>wor</b>ld&nbsp;x <a href="q>r">link</a>.<p>A second paragraph that is quite long.<p class=ad>Buy now<form>name <input></form><ul><li>one<li>two</ul></div>
<div class="comments"><p>I disagree, at length, and for many more words than the article itself has, so that length alone would be misled here.</p></div></div><aside>side</aside><footer>&copy; x</footer>"""
TEXT = "Ti&tle Hello world x link. A second paragraph that is quite long. one two"


def test_html(spark):
    rows = [(i, "http://h.com/", PAGE.format(c=f"wrap-{i}"), i) for i in range(3)] + [(7, "http://h.com/", None, 1), (8, None, "", 1), (9, "http://h.com/x", "just text", 1), (9, "http://h.com/x", "just text", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(pages).collect())
    assert got == [(i, TEXT, len(TEXT)) for i in range(3)] + [(7, "", 0), (8, "", 0), (9, "just text", 9), (9, "just text", 9)]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_html_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    import html

    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", article)
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("source,text", [("<p>a<p>b", "a b"), ("<!-- x", ""), ('<div "unclosed>hi</div>', "hi"), ("< 3 & 4", "< 3 & 4"), ("<script>abc", ""), ("a<!doctype", "a")])
def test_broken_html(source, text):
    assert html_text.Page(source).main_text(None) == text


# 8 token files
def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        x = rng.integers(0, 50257, n).astype(np.uint32)
        x[rng.random(n) < 0.05] = 4_000_000_000
        p = token_files.Payload(token_files.pack(x, [n], [None]))
        assert (p.ids() == x).all() and p.present.tolist() == [0] and p.lengths.tolist() == [n]
        assert all((p.block(i) == x[i * 128 : i * 128 + 128]).all() for i in range(-(-n // 128)))


def test_encoder_is_the_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PIECES_KEPT", 50)
    monkeypatch.setattr(token_files, "PARTS_KEPT", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", "  x", "x  ", "x   y", "don't  it's''s 'll", "\x85 x\x85\x85 y", "日本 語", "<|endoftext|> a"] + ["".join(rng.choice(" \n\t'aB1,.é語\x1c ") for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for a in range(0, len(texts), 100):
        some = texts[a : a + 100]
        assert encoder.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(some, add_special_tokens=False)]


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(token_files.tokenize(odd).collect(), key=lambda r: r.start)
    at = 0
    for r, (key, text, *_) in zip(rows, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.tokenize(odd.where("false")).count() == 0


# 9 personal data
def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15])


def test_base_spans():
    rng = random.Random(1)
    assert pii.luhn("4041894974608795") and not pii.luhn("4041894974608796")
    for _ in range(20000):
        t = "".join(rng.choice("a@.12+ -_()%c9") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_disclosing_terms(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(12))
    texts = [f"{filler()} Zebulon wrote to z@x.org about {filler()}" for _ in range(6)] + [filler() for _ in range(400)] + ["Zebulon again, alone", None, ""]
    found, name = pii.find_personal_data(docs(spark, *texts), clean=True)
    rows = {r.doc_id: r for r in found.collect()}
    assert [s[1] for s in rows[0][name["spans"]]].count(0) == 1
    assert rows[406][name["spans"]] == [[0, 4, 7]] and rows[406][name["clean"]] == " again, alone"
    assert "<EMAIL>" in rows[0][name["clean"]] and rows[407][name["clean"]] is None
    assert all(rows[i][name["spans"]] == [] for i in range(6, 406))


def test_personal_data_odd(spark, odd):
    assert pii.find_personal_data(odd)[0].count() == len(ODD)
    assert pii.find_personal_data(odd.where("false"))[0].count() == 0


def test_base_digest(spark):
    got = {r.doc_id: r.base_sha256 for r in QUERIES["op9_pii"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(r.text)).encode()).hexdigest()


# 10 quality
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert np.mean([r.predicted for r in good]) >= 0.98 and np.mean([1 - r.predicted for r in bad]) >= 0.9


def test_cosines_vote_exactly():
    rng = np.random.default_rng(2)
    x, y = rng.random((60, quality.N_TERMS)).astype(np.float32), rng.integers(0, 2, 60).astype(np.float32)
    m, z = quality.Model(x, y), rng.random((7, quality.N_TERMS)).astype(np.float32)
    for v, s in zip(z, m.score(z)):
        u = ((v - m.mean) * m.scale) @ m.axes
        cos = m.vectors @ (u / np.linalg.norm(u))
        near = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0).astype(float) ** quality.SHARPNESS
        assert s == pytest.approx((w @ y[near] + 0.01 * m.prior) / (w.sum() + 0.01), abs=1e-4)


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (5, None), (None, 1), (4, 7)], "doc_id long, quality int")
    scored, name = quality.with_quality(odd, quality.fit(odd, labels))
    assert scored.count() == len(ODD) and scored.where(f"`{name}` between 0 and 1").count() == len(ODD)
    nobody, name = quality.with_quality(odd, quality.fit(odd, labels.where("false")))
    assert nobody.where(f"`{name}` = 1").count() == len(ODD)
    assert quality.with_quality(odd.where("false"), quality.fit(odd.where("false"), labels))[0].count() == 0
