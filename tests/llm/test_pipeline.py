"""The five stages against what each promises about its own input."""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from tabulon.llm.op2_line_dedup import dedup_lines
from tabulon.llm.op3_quality import judge, model_for, trusted_ids
from tabulon.llm.op4_mixing import mix_copies
from tabulon.llm.op8_jaccard_join import jaccard_components
from tabulon.llm.textkernels import Texts

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF).cache()
        seen[name] = (at, out)
        if name != "packing":
            assert out.columns == docs.columns
        at = out
    a, b = seen["quality"]
    verdict = judge(a, model_for(a, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in verdict.filter("kept").collect()}
    a, b = seen["lines"]
    assert sorted((r.doc_id, r.text) for r in b.collect()) == sorted((r.doc_id, r.text) for r in dedup_lines(a).collect())
    a, b = seen["near_duplicates"]
    keep = {r.component_id for r in jaccard_components(a).collect()}
    assert {r.doc_id for r in b.collect()} == keep
    a, b = seen["mixing"]
    assert {r.doc_id for r in b.collect()} <= {r.doc_id for r in a.collect()}
    a, b = seen["packing"]
    assert b.filter("piece = 0").count() == a.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 int, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 1, "x") for i, t, s in rows], SCHEMA).repartition(3)


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = a + " more"
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, c, "s"), (None, d, "s"), (None, d, "t"), (None, near, "s"), (9, None, "s"), (9, None, "s"), (None, " ", "s")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), SF).collect())
    assert got == Counter([(3, a), (5, b), (7, c), (None, d), (9, None), (9, None), (None, " ")])
    assert corpus_pipeline.near_duplicates(spark, table(spark, rows).limit(0), SF).collect() == []


def test_mixing_takes_the_words_it_counts(spark):
    rows = [(i % 40, " ".join(["w"] * (1 + i % 7)), "a") for i in range(200)] + [(None, "x y z", "b") for _ in range(60)] + [(1000 + i, " ".join(["v"] * (i % 50)), None) for i in range(150)] + [(1, "one two three", "a")] * 5
    docs = table(spark, rows).cache()
    taken, got = Counter(), Counter()
    for r in mix_copies(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    for r in corpus_pipeline.mixing(spark, docs, SF).collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert got == +taken


def test_quality_counts_every_trusted_document(spark, tmp_path, monkeypatch):
    good = [f"own{i} " * 25 for i in range(30)]
    rows = [(i, t, "a") for i, t in enumerate(good)] + [(30 + i, f"other{i} " * 25, "a") for i in range(30)]
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "keep_good", lambda docs, model: model)
    model = corpus_pipeline.quality(spark, table(spark, rows), str(tmp_path))
    t = Texts(pa.array(good))
    start, end, first = t.words()
    assert (model.scores(t.hashes(start, end), first) > 0).all()  # a document left out of the counts scores below 0


def test_quality_takes_no_bounded_list_of_trusted_documents(spark, tmp_path, monkeypatch):
    rows = [(i, f"own{i} other{i % 7} " * (8 + i % 9), "a") for i in range(60)]
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows).cache()
    want = model_for(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    monkeypatch.setattr(trusted_ids, "__defaults__", (6,))
    monkeypatch.setattr(corpus_pipeline, "keep_good", lambda docs, model: model)
    got = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert (got.ratio == want.ratio).all() and got.threshold == pytest.approx(want.threshold)
