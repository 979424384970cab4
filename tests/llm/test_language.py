"""Language identification: held-out accuracy, backing off, odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from auditlake.llm import language
from auditlake.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string"
SF = "/root/testdata/sf0.001"
EN = "the cat sat on the mat and the dog was there with them when she went away"
DE = "der hund und die katze sind nicht auf dem tisch wenn ich nach hause gehe"


def planted(spark, n=60):
    return spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de", "s") for i in range(n)], DOC)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op12_language"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_known_words_then_shorter_and_shorter_grams(spark):
    model = language.fit(planted(spark))
    assert set(model.rows[0]) == set((EN + " " + DE).split())
    assert model.predict("the dog the dog")[0] == "en" and model.predict("Die KATZE")[0] == "de"
    assert model.predict("xxtischxx")[0] == "de"  # unseen, of known n-grams
    assert model.predict("wennx")[0] == "de"  # ' wenn' is German's alone, ' wen' English has too
    assert model.predict("日本語")[0] in ("de", "en") and model.predict("日本語")[1] == 0.5  # letters never seen
    for text in (None, "", "12 ½ ² _ !!", "\n\t"):
        assert model.predict(text) == ("und", 0.0)
    long = "the " * 200_000 + "hund"
    assert model.predict(long)[0] == "en" and model.predict("the" * 100_000)[1] <= 1


def test_memory_of_unseen_words_is_bounded_and_changes_nothing(spark, monkeypatch):
    model = language.fit(planted(spark))
    texts = [f"hundx{chr(97 + i)} matx{chr(97 + i)}" for i in range(26)]
    one = model.predict_all(texts)
    monkeypatch.setattr(language, "REMEMBERED", 3)
    assert [model.predict(t) for t in texts] == one and len(model._unseen) <= 6


def test_only_learnable_rows_count(spark):
    """Rows that are held out, without id or without language teach nothing; repeated ids stay within the bound."""
    rows = [(i, "zzz", "xx", "s") for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1] + [(None, "zzz", "yy", "s"), (2, "zzz", None, "s")]
    other = [(7, f"{EN} q{chr(97 + i % 26)}", "en", "s") for i in range(100)]
    model = language.fit(spark.createDataFrame(rows + other, DOC), learned=10)
    assert model.languages == ["en"] and "zzz" not in model.rows[0]
    assert max(n for n in [len(model.rows[0])]) <= len(set(EN.split())) + 10
    assert language.fit(spark.createDataFrame([], DOC)).predict("the") == ("und", 0.0)


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "en", None), (None, "the cat", "en", "s"), (3, EN * 1000, "en", "s")], DOC)
    odd = odd.withColumns({"lang_pred": F.lit(1), "score": F.lit("x"), "held_out": F.lit(2)})
    model = language.fit(planted(spark))
    out, name, score = language.with_language(odd, model)
    assert (name, score) == ("_lang_pred", "_score")
    got = out.select("doc_id", name).collect()
    assert sorted((r.doc_id or -1, r[name]) for r in got) == [(-1, "en"), (1, "und"), (1, "und"), (2, "und"), (3, "en")]
    assert odd.withColumn("h", language.held_out("doc_id")).where("h is null").count() == 0
    assert language.with_language(odd.limit(0), model)[0].count() == 0


@pytest.mark.parametrize("most", [1])
def test_terms_are_bounded(spark, most):
    model = language.fit(planted(spark), most=most)
    assert all(len(ids) <= 200 for ids in model.rows)
