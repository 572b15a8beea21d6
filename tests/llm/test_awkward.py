"""Texts and columns that broke operators once: dense numbers, columns named like an operator's own."""

import pathlib
import re

import pytest

import corpus_pipeline
from loomline.llm import decontaminate, ngram_join, quality, secret_scan
from loomline.llm.shared import materialize, shared_dir, unused

from . import cases

LLM = pathlib.Path(decontaminate.__file__).parent
OWN = sorted({n for p in LLM.glob("*.py") for n in re.findall(r"\b__[a-z]+\b(?!__)", p.read_text())} | {"__text", "__words", "__lines"})


@pytest.mark.parametrize("sign", [",", ".", " ", ""])
def test_decontamination_takes_dense_numbers(spark, sign):
    text = sign.join(str(k % 10) for k in range(1_000_000))
    item = "the river " + "1,2,3 " * 4 + "stone light tall green walking quiet"
    docs = spark.createDataFrame([(1, text), (2, item)], "doc_id long, text string")
    marks = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_items(docs, marks).collect()] == [2]


def test_pipeline_stages_take_dense_numbers(spark, tmp_path):
    text = "the of and to in " * 20 + ",".join(str(k) for k in range(20_000)) + " " + ".".join("1" for _ in range(20_000))
    cases.frame(spark, [(1, text, "en", "s", 1, "n", None, None, 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "stone light tall green walking quiet morning paper")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        docs = materialize(stage(spark, docs, str(tmp_path)), f"{shared_dir(spark)}/{k}")
        assert docs.count() >= 1


@pytest.fixture(scope="module")
def clashing(spark):
    base = cases.frame(spark).select("doc_id", "text")
    for k, name in enumerate(OWN):
        base = base.selectExpr("*", f"{k} + coalesce(doc_id, 0) AS `{name}`")
    return base.cache()


def test_own_columns_meet_no_callers(spark, clashing):
    assert {"__row", "__bad", "__words"} <= set(OWN)
    marks = spark.createDataFrame([(7, cases.documents()[8][1])], "item_id long, text string")
    everything = {tuple(r) for r in clashing.collect()}
    for kept in (ngram_join.keep_one_of_each_class(clashing), decontaminate.remove_contaminated(clashing, marks), quality.keep_good(clashing)):
        assert kept.columns == clashing.columns
        assert {tuple(r) for r in kept.collect()} <= everything
    judged = quality.judge(clashing)
    assert {tuple(r) for r in judged.select(*clashing.columns).collect()} == everything
    masked = secret_scan.redact_documents(clashing)
    assert masked.count() == clashing.count() and masked.columns == clashing.columns


def test_unused_takes_case_for_equal(spark):
    assert unused(spark.createDataFrame([(1, 2)], "A_ int, a int"), "a") == "a__"
