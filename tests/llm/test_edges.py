"""Empty tables and lists, and texts of several MB, through the operators and the pipeline's stages."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhound.llm import encoding, language, packing, repetition, secrets, urlfilter
from tallyhound.llm.common import token_file

SF = "/root/testdata/sf0.001"
CAPTURES, ENTRIES = "url string, fetched_at long", "pattern string, action string, listed_at long"


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.fixture(scope="module")
def long_text():
    """4 MB of words, a repeated line and a key."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 200_000, 600_000)]
    return " ".join(words) + "\nthe same line again and again\n" * 20 + "token = abcdefghij0123456789\n"


def test_long_texts(spark, long_text):
    df = spark.createDataFrame([(1, long_text, "en", "s"), (2, "short text", "en", "s")], "doc_id long, text string, lang string, source string")
    assert len(long_text) > 3_900_000
    ids = [*Tokenizer.from_file(token_file("byte_bpe_50k.json")).encode(long_text, add_special_tokens=False).ids, 2]
    got = {r.doc_id: r for r in encoding.count_tokens(df).collect()}
    assert got[1].n_tokens == len(ids) - 1 and got[1].n_bytes == len(long_text.encode())
    pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(df).filter("doc_id = 1").collect())
    assert sum(p[2] for p in pieces) == len(ids) and all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for _, a, n, crc in pieces)
    found = {r.doc_id: r for r in repetition.repetition(df).collect()}
    assert found[1].n_words == len(long_text.split()) and found[1].n_dup_lines == 19
    spans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    key = long_text.index("token = ")
    assert [(s.start, s.end) for s in spans[1] if s.kind == "assign"] == [(key, len(long_text) - 1)] and all(s.start >= key for s in spans[1])
    assert {r.doc_id: r.lang_pred for r in language.identify(df, samples=(("en", (long_text[:5000],)), ("xx", ("zzz qqq " * 100,)))).filter("doc_id = 1").collect()} == {1: "en"}


def test_url_filter_without_captures_or_entries(spark):
    captures = spark.createDataFrame([("https://a.example/x", 5), (None, 5), ("https://a.example/x", None)], CAPTURES)
    some = spark.createDataFrame([("a.example", "block", 1), (None, "block", 1), ("b.example", "block", None)], ENTRIES)
    assert [r.blocked for r in urlfilter.filter_urls(captures, some).orderBy("url", "fetched_at").collect()].count(True) == 1
    assert [r.blocked for r in urlfilter.filter_urls(captures, some.limit(0)).collect()] == [False] * 3
    assert urlfilter.filter_urls(captures.limit(0), some).count() == 0
