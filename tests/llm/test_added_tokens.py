"""Token files against an untouched tokenizer, with the added token's content in texts."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from auditlake.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_gives_the_default_ids():
    encoder, plain = token_files.Encoder(PATH, added=True), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b", "x  <|endoftext|>  ", "<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "한<|endoftext|>국"]
    texts += ["".join(rng.choice([" ", "a", "don't", "<|endoftext|>", "<|", "endoftext", "|>", "\n", "é", "1"]) for _ in range(rng.randrange(12))) for _ in range(2000)]
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert np.frombuffer(encoder.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]


def test_token_files_give_the_default_ids(spark):
    texts, plain, at = ["one", "a <|endoftext|> b", "two"], Tokenizer.from_file(PATH), 0
    rows = sorted(token_files.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, t in zip(rows, texts):
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_index_finds_a_document(spark, tmp_path):
    from pyspark.sql import functions as F

    docs, path = spark.createDataFrame([(i, f"document {i} of many") for i in range(300)] + [(None, "no key")], "doc_id long, text string"), f"file://{tmp_path}/out"
    token_files.write_token_files(docs, path)
    index = spark.read.parquet(f"{path}/index")
    rows = sorted(index.collect(), key=lambda r: r.start)
    assert sum(r.n_docs for r in rows) == 301 and rows[0].first_key == 0
    assert [r.start for r in rows] == [sum(x.n_ids for x in rows[:i]) for i in range(len(rows))]
    one = index.where("first_key <= 123 and last_key >= 123").join(spark.read.parquet(f"{path}/files").select("part", "seq", "payload"), ["part", "seq"]).first()
    p = token_files.Payload(bytes(one.payload))
    at = p.keys.tolist().index(123)
    begin = int(p.lengths[:at].sum())
    want = Tokenizer.from_file(PATH).encode("document 123 of many", add_special_tokens=False).ids + [2]
    assert p.ids()[begin : begin + int(p.lengths[at])].tolist() == want
    read = token_files.read_token_files(spark, path).where(F.col("doc_id") == 123).first()
    assert read.start == one.start + begin and read.n_tokens == len(want)


def test_slices_and_common_forms():
    encoder, plain = token_files.Encoder(PATH, added=True), Tokenizer.from_file(PATH)
    rng = random.Random(9)
    forms = ["word", "Word,", "word.", "é", "año.\nAño", "a\nb,", "a,\nb", "a\n\nb", "\nx", "x\n", "don't", "1,2", ",", "", "日本", "x" * 5000]
    texts = [" ".join(rng.choice(forms) for _ in range(rng.randrange(8))) for _ in range(3000)] + [""]
    assert encoder.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode([]) == []
