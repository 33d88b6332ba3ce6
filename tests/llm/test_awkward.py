"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import op1_mixing, op2_quality, op3_secrets, op5_toxicity, op6_substring_dedup, op7_ngram_join, op8_pii, op9_line_dedup, op10_decontamination

from .util import awkward, awkward_rows, empty, rows


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (6, 1, 0), (8, 0, 1), (10, 1, 0), (None, 1, 1), (11, None, None), (13, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "nothing of this"), (2, None), (None, "one"), (3, ""), (4, "ONE")], "item_id long, text string")


def run(name, spark, docs):
    match name:
        case "op1":
            return op1_mixing.mix(docs)
        case "op2":
            return op2_quality.quality(docs, labels(spark))
        case "op3":
            return op3_secrets.scan(docs, op3_secrets.train(op3_secrets.labelled_samples(docs)))
        case "op5":
            return op5_toxicity.toxicity(docs, labels(spark))
        case "op6":
            return op6_substring_dedup.substring_dedup(docs)
        case "op7":
            return op7_ngram_join.ngram_join(docs)
        case "op8":
            return op8_pii.find_pii(docs, model=op8_pii.Tagger())
        case "op9":
            return op9_line_dedup.dedup_documents(docs)
        case "op10":
            return op10_decontamination.decontaminate(docs, benchmark(spark))


NAMES = ["op1", "op2", "op3", "op5", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_row(spark, name):
    got = [r["doc_id"] for r in rows(run(name, spark, awkward(spark)))]
    want = [r[0] for r in awkward_rows()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert rows(run(name, spark, empty(spark))) == []


def test_substrings_of_awkward_rows(spark):
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in rows(run("op6", spark, awkward(spark)))}
    assert got[1, 40] == 0 and got[2, 40] == 40 and got[None, 40] == 0
    assert got[7, 6000] == 6000 and got[6, 6000] == 0
    assert got[12, 60] == 0 and got[8, 1] == got[14, 1] == 0
    assert got[10, 80] == 40


def test_near_duplicates_of_awkward_rows(spark):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows(run("op7", spark, awkward(spark)))}
    assert got[2, 36] == 1 and got[7, 5996] == 6 and got[14, 1] == 8
    assert got[4, 0] == 4 and got[None, 36] is None


def test_lines_of_awkward_rows(spark):
    got = rows(run("op9", spark, awkward(spark)))
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert by[2, ""]["_removed"] == 1 and by[4, None]["_lines"] == 0
    assert by[15, "\n\n\n"]["_removed"] == 0
    [ten] = [r for r in got if r["doc_id"] == 10]
    assert ten["_removed"] == 1 and len(ten["text"].split("\n")) == 2
    assert set(got[0]) >= {"key", "n", "s"}


def test_contamination_of_awkward_rows(spark):
    got = {r["doc_id"]: r for r in rows(run("op10", spark, awkward(spark)))}
    assert got[8]["contaminated"] and got[8]["items"] == ["4"]
    assert not got[4]["contaminated"] and got[4]["n_words"] == 0


def test_sizes_of_awkward_rows(spark):
    got = rows(run("op1", spark, awkward(spark)))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum({r["source"]: r["source_size"] for r in got}.values()))


def test_scores_stay_in_bounds(spark):
    for name in ("op2", "op5"):
        assert all(0 <= r["score"] <= 1 for r in rows(run(name, spark, awkward(spark))))


def test_no_labels(spark):
    none = labels(spark).where("doc_id < 0")
    assert {r["score"] for r in rows(op2_quality.quality(awkward(spark), none))} == {1.0}
    assert {r["score"] for r in rows(op5_toxicity.toxicity(awkward(spark), none.withColumn("toxic", F.lit(1))))} == {0.0}
