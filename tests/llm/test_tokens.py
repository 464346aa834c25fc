import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rasterweave.llm.tokens import decode, encode_corpus, encoding_of, token_sizes, vocabulary_path

ENCODING = encoding_of(vocabulary_path(), public_tokenizers.PATTERN)[0]
WORDS = ["the", " bark", "'ll", "'s", "  ", "\n\n", "　", "été", "が", "🌲", "12345", "...", "\t", "x" * 9, "don't", "\x1c", " ", "²"]


def texts():
    rng = random.Random(8)
    out = ["", None, " ", "'", "a" * 500, " " * 500, "\n" * 300 + "x", "no spaces" * 40, "'" * 200]
    for n in (5, 30, 60, 200, 400):
        out += ["".join(rng.choice(WORDS) for _ in range(n)) for _ in range(12)]
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(10_000, 512), (64, 32), (40, 12), (17, 8)])
def test_stitched_encoding_equals_the_whole(spark, chunk, overlap):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, [1]) for k, t in rows], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
    assert got == {k: ENCODING.encode_ordinary(t) if t else [] for k, t in rows}


def test_round_trip_counts_and_special_strings(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(900, "<|endoftext|> is text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ids = encode_corpus(df, "doc_id", "text", chunk=50, overlap=20)
    back = {r["doc_id"]: r["t"] for r in ids.select("doc_id", decode(F.col("ids")).alias("t")).collect()}
    assert back == {k: t or "" for k, t in rows}
    n = {r["doc_id"]: r["size"] for r in token_sizes(df, "doc_id", "text").collect()}
    lengths = {r["doc_id"]: r["n"] for r in ids.select("doc_id", F.size("ids").alias("n")).collect()}
    assert n == {k: None if t is None else lengths[k] for k, t in rows}


def test_agrees_with_the_other_library_for_the_same_vocabulary(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in filter(None, texts()):
        assert ENCODING.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_empty_table_and_string_ids(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
    df = spark.createDataFrame([("a", "bark " * 50), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"]: len(r["ids"]) for r in encode_corpus(df, "doc_id", "text", chunk=30, overlap=10).collect()} == {"a": len(ENCODING.encode_ordinary("bark " * 50)), "b": 0}


def test_a_corpus_of_long_texts(spark):
    """Texts of some 100,000 characters with the chunks of production; among them runs longer than an overlap."""
    rng = random.Random(2)
    runs = ["z" * 700, "7" * 9000, " " * 20_000, "!" * 8192, "x" * 16_384]
    rows = [(k, "".join(rng.choice(runs) if rng.random() < 0.0004 else rng.choice(WORDS) for _ in range(25_000))) for k in range(6)]
    rows += [(100 + k, r * 2 + "tail of it") for k, r in enumerate(runs)] + [(200, "a" * 8192), (201, "b" * 8193), (202, "ab " * 8192)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "doc_id", "text").collect()}
    assert got == {k: ENCODING.encode_ordinary(t) for k, t in rows}


def test_each_text_is_encoded_once(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = encode_corpus(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4 and plan.count("Exchange hashpartitioning") == 2
    sized = token_sizes(df, "doc_id", "text").filter("size > 0")
    assert sized._jdf.queryExecution().executedPlan().toString().count("InArrow") == 1
