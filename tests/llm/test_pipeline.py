"""Each stage of the pipeline against a brute-force version on what it was given, and the whole on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarrylight.llm import op2_quality
from quarrylight.llm.common import materialize

from .test_joins import components, shingles
from .util import awkward, awkward_rows, empty, prose, rows


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage was given and what it kept, by stage."""
    out, given = [], cp.documents(spark, sf_dir)
    for _, stage in cp.STAGES:
        got = materialize(stage(spark, given, sf_dir), "test-stage")
        out.append((given, got))
        given = got
    return out


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]


def test_columns_stay_until_the_last_stage(kept):
    for given, got in kept[:-1]:
        assert got.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_drops_what_the_classifier_rejects(spark, sf_dir, kept):
    given, got = kept[0]
    want = {r["doc_id"] for r in rows(op2_quality.quality(given, cp.read_table(spark, sf_dir, "labels"))) if r["predicted"] == 1}
    assert {r["doc_id"] for r in rows(got)} == want and len(want) < given.count()
    assert got.exceptAll(given).count() == 0


def test_line_stage_matches_all_pairs(kept):
    given, got = kept[1]
    seen, want = [], {}
    for r in sorted(rows(given), key=lambda r: r["doc_id"]):
        lines = []
        for line in r["text"].split("\n"):
            s = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen if 5 * len(o) >= 4 * len(s) and 5 * len(s) >= 4 * len(o)):
                lines.append(line)
            if s and s not in seen:
                seen.append(s)
        text = "\n".join(lines)
        if text == r["text"] or re.search(r"[^\x20\x09-\x0D]", text):
            want[r["doc_id"]] = (text, len(text))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows(got)} == want


def test_near_duplicate_stage_keeps_one_of_each_group(kept):
    given, got = kept[2]
    items = sorted(rows(given), key=lambda r: r["doc_id"])
    sets = [shingles(r["text"], 5) for r in items]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    root = components(len(sets), links)
    assert {r["doc_id"] for r in rows(got)} == {r["doc_id"] for i, r in enumerate(items) if root[i] == i}


def test_decontamination_stage_matches_brute_force(spark, sf_dir, kept):
    given, got = kept[3]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = set()
    for r in rows(cp.read_table(spark, sf_dir, "benchmark")):
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(max(len(w) - 12, 1))} if w else set()
    sizes, want = {len(w) for w in windows}, set()
    for r in rows(given):
        w = words(r["text"])
        hit = {j for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in rows(got)} == want and len(want) < given.count()


def test_mixing_stage_takes_all_that_is_left(kept):
    given, got = kept[4]
    assert {r["doc_id"] for r in rows(got)} == {r["doc_id"] for r in rows(given)}
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows(got))


def test_run_is_the_stages_in_turn(spark, sf_dir, kept):
    assert sorted((r["doc_id"], r["taken"]) for r in rows(cp.run(spark, sf_dir))) == sorted((r["doc_id"], r["taken"]) for r in rows(kept[4][1]))


@pytest.mark.parametrize("i", range(5))
def test_awkward_rows_and_empty_tables(spark, sf_dir, i):
    stage = cp.STAGES[i][1]
    assert rows(stage(spark, empty(spark), sf_dir)) == []
    got = stage(spark, awkward(spark), sf_dir)
    assert got.count() <= len(awkward_rows())
    if i < 4:
        assert got.columns == awkward(spark).columns
        assert got.where(F.col("text").isNull()).count() <= 1


def _shared_ids(spark, texts):
    """Each text thrice: rows without an id, rows of one id, rows with an id of their own."""
    data = [(i, t, "en", "a", len(t)) for key in (None, 7) for t in texts for i in [key]] + [(100 + n, t, "en", "a", len(t)) for n, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def test_contaminated_rows_do_not_take_rows_of_their_id(spark, sf_dir):
    item = cp.read_table(spark, sf_dir, "benchmark").where("length(text) > 80").first()["text"]
    clean = [prose(30, 900 + i) for i in range(4)]
    got = rows(cp.decontamination_stage(spark, _shared_ids(spark, [item, *clean]), sf_dir))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(i, t) for t in clean for i in (0, 7)] + [(101 + n, t) for n, t in enumerate(clean)])


def test_line_stage_decides_by_row(spark, sf_dir):
    """Row 7 of the second text repeats line 1 of document 1; the other rows of id 7, and those without one, keep theirs."""
    line = [prose(12, 950 + i) for i in range(9)]
    data = [(1, f"{line[0]}\n{line[1]}"), (7, f"{line[2]}\n{line[3]}"), (7, f"{line[4]}\n{line[1]}"), (None, f"{line[5]}\n{line[6]}"), (None, f"{line[7]}\n{line[1]}")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(1, data[0][1]), (7, data[1][1]), (7, line[4]), (None, data[3][1]), (None, line[7])]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows(cp.line_stage(spark, docs, sf_dir))) == sorted((i or 0, t) for i, t in want)


def test_near_duplicate_stage_decides_by_row(spark, sf_dir):
    texts = [prose(40, 970 + i) for i in range(3)]
    near = texts[0].rsplit(" ", 1)[0] + " changed"
    data = [(1, texts[0]), (7, near), (7, texts[1]), (None, near), (None, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows(cp.near_duplicate_stage(spark, docs, sf_dir))) == sorted([(0, texts[2]), (1, texts[0]), (7, texts[1])])
