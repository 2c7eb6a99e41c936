"""The pipeline on a small table, stage by stage against plain versions of what each decides."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.runtime import materialize

from .test_operators import copies, near_brute, table


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in copies(21) if t]
    rows += [(600, f"write to name.{rng.randrange(90)}@mail.example.com or call +1 (212) 555-0100 about the stone river tree", "en", "s0"), (601, "12345 !!", "en", "s1"), (602, None, "en", "s1")]
    docs = table(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixture", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = docs
        docs = materialize(stage(spark, docs, ""), f"test-{name}")
        out[name] = docs
        if name != "packing":
            assert docs.columns == kept.columns
    assert {r.doc_id for r in out["language"].collect()} == {r[0] for r in rows} - {601, 602}
    want = near_brute([(r[0], r[1]) for r in rows if r[0] not in (601, 602)])
    assert {r.doc_id for r in out["near_duplicates"].collect()} == {i for i, (_, c) in want.items() if c == i}
    masked = out["personal_data"].filter("doc_id = 600").first()
    assert masked.text == "write to [EMAIL] or call [PHONE] about the stone river tree" and masked.n_chars == len(masked.text)
    assert out["mixture"].filter("n_chars != length(text)").isEmpty()
    assert out["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
    assert {r.doc_id for r in out["packing"].collect()} == {r.doc_id for r in out["mixture"].collect()}
