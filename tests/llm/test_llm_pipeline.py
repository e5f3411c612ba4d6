"""The stages of the pipeline, one by one, against what brute force says they keep."""

import re

from llm_tables import FILL, OTHER

import corpus_pipeline
from forumlens.session import written


def test_stages(spark, folder, odd):
    docs = written(odd.where("doc_id is not null or text is not null"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    before = odd.collect()
    assert {r.doc_id for r in before} - ids["language_id"] >= {9_000, 9_001, 9_002, 9_020}
    assert all(re.search(r"[^\W\d_]", r.text) and r.lang for r in kept["language_id"])
    # of each group of near duplicates one stays; a row without an id stays too
    assert {9_003, 9_005, 9_007, None} <= ids["near_duplicates"] and not {9_004, 9_006, 9_008} & ids["near_duplicates"]
    assert sorted(r.text[:7] for r in kept["near_duplicates"] if r.doc_id == 9_007) == ["another", "word0 w"]
    # the shared passage is cut wherever it is, the rest of a text stays
    texts = {r.doc_id: r.text for r in kept["substring_dedup"]}
    assert texts[9_012] == f"{FILL} after" and texts[9_013] == f"Before x {OTHER}" and texts[9_014] == texts[9_011] == ""
    assert texts[9_018] == "a\x1cb 1234 !!"
    assert all(r.n_chars == len(r.text) for r in kept["substring_dedup"])
    # "two words" is an item: its document is a benchmark passage
    assert 9_005 not in ids["decontamination"] and 9_012 in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]


def test_run_equals_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
    rows = corpus_pipeline.run(spark, folder).collect()
    by = lambda rows: sorted((r.doc_id, r.start, r.length, bytes(r.tokens)) for r in rows)
    total = lambda rows: sorted({(r.doc_id, r.doc_tokens) for r in rows})
    assert total(rows) == total(docs.collect()) and len(by(rows)) > 0
