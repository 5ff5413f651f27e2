"""Every stage of the corpus pipeline, on what the stage before kept, against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tallyhound.llm.common import token_file
from tests.llm.test_pairs import brute
from tests.llm.test_text_operators import brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "12 34 --", "en", "src1", 8), (902, "", None, "src1", 0), (903, docs.first().text, "en", None, 5)], docs.schema)
    docs = docs.unionByName(odd)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept[name] = (docs.collect(), (docs := spark.read.parquet(f"{tmp_path}/{k}")).collect())
    before, after = kept["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {900, 901, 902} <= gone and all(not re.search(r"[^\W\d_]", r.text or "") for r in before if r.doc_id in gone)
    before, after = kept["near_dedup"]
    want = [d for d, _, _, stays in brute([(r.doc_id, r.text) for r in before], 5, 80) if stays]
    assert sorted(r.doc_id for r in after) == sorted(want)
    before, after = kept["secret_scan"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert not brute_secrets(r.text) and r.n_chars == len(r.text) or r.text == texts[r.doc_id]
        assert brute_secrets(texts[r.doc_id]) or r.text == texts[r.doc_id] or "[SECRET]" in r.text
    before, after = kept["mix_sources"]
    words = lambda rows: Counter({s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}})
    have, taken = words(before), words(after)
    assert abs(sum(taken.values()) - 1.5 * sum(have.values())) <= max(len(r.text.split()) for r in before) and all(taken[s] <= 2 * n for s, n in have.items())
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)  # whole copies
    before, after = kept["best_fit_packing"]
    tok = Tokenizer.from_file(token_file("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        lo, hi = 0, len(ids) % 1024 or min(1024, len(ids))
        while lo < len(ids):
            want[r.doc_id, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
            lo, hi = hi, hi + 1024
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after) == want
    fill = Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
