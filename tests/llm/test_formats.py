"""Rewrite of drifted files, fill-in-the-middle and chat formatting: against plain Python, and on awkward rows."""

import datetime as dt
import hashlib
import math
import os
import re
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import op11_schema_rewrite as op11
from quarrylight.llm import op12_fill_in_middle as op12
from quarrylight.llm import op13_chat_format as op13

from .util import awkward, docs, empty, rows

RELAXED = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
NAMES = [f.name for f in op11.CLIENTS]


def files_by_hand(clients: list[dict], most_files: int) -> list[dict]:
    """What the final files should be, in one loop."""
    ordered = sorted(clients, key=lambda r: (zlib.crc32(str(r["client_id"]).encode()), r["client_id"]))
    each, out = 1 + len(ordered) // most_files, []
    for no in range(math.ceil(len(ordered) / each)):
        v = zlib.crc32(f"19:{no}".encode()) % 24
        v = 0 if v > 15 else v
        start = NAMES[:]
        if v & 1:
            start[4], start[5] = "email", "name"
        if v & 4:
            start = [c for c in start if c not in ("nation_id", "segment")]
        if v & 2:
            start = start[:1] + start[:0:-1]
        kept = []
        for r in ordered[no * each : (no + 1) * each]:
            r = dict(r)
            if v & 4:
                r |= {"nation_id": -1, "segment": "none"}
            if v & 8 and r["balance"] is not None:
                r["balance"] = struct.unpack("f", struct.pack("f", r["balance"]))[0]
            kept.append(r)

        def shown(k, x):
            if x is None:
                return "?"
            if k == "updated_at":
                return str((x - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
            return str(math.floor(1048576 * x)) if k == "balance" else str(x)

        out.append({
            "file_no": no, "version": v, "n_rows": len(kept), "n_nulls": sum(x is None for r in kept for x in r.values()), "ids_sha256": sha(",".join(str(r["client_id"]) for r in kept)),
            "rows_sha256": sha("\n".join("|".join(shown(k, r[k]) for k in NAMES) for r in kept)), "start_columns": ",".join(start), "columns": ",".join(NAMES), "rewritten": v > 0,
        })
    return out


def test_rewrite_equals_a_plain_loop(spark, sf_dir):
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    got = rows(op11.op11_schema_rewrite(spark, sf_dir).orderBy("file_no"))
    want = files_by_hand([r.asDict() for r in clients.select(*NAMES).collect()], 250)
    assert [{k: v for k, v in r.items() if k != "path"} for r in got] == want
    folder = os.path.dirname(got[0]["path"]).removeprefix("file://")
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(r["path"]) for r in got) and os.listdir(os.path.dirname(folder)) == ["files"]
    for r in got[:30]:
        schema = pq.read_schema(r["path"].removeprefix("file://"))
        assert [(f.name, f.type, f.nullable, op11.id_of(f)) for f in schema] == [(f.name, f.type, True, f.id) for f in op11.CLIENTS]
    again = rows(op11.op11_schema_rewrite(spark, sf_dir).orderBy("file_no"))
    assert [r["rows_sha256"] for r in again] == [r["rows_sha256"] for r in got] and again[0]["path"] != got[0]["path"]


SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, file_no string, _rank string"


def test_rewrite_of_awkward_rows(spark):
    at = dt.datetime(1969, 12, 31, 23, 59, 59, 999999)
    made = [(i % 7 if i else None, i, "s" * (i % 3), at, None if i % 2 else f"n|{i}", "", "x" * 100_000 if i == 5 else None, i, None, -0.5 if i else None, "x", "y") for i in range(20)]
    clients = spark.createDataFrame(made + made[:3], SCHEMA)
    got = rows(op11.drift_and_rewrite(clients, most_files=5, ranges=8).orderBy("file_no"))
    assert [r["n_rows"] for r in got] == [5, 5, 5, 5, 3]
    assert sum(r["n_nulls"] for r in got if r["version"] & 4 == 0) <= sum(x is None for r in made + made[:3] for x in r[:10])
    again = rows(op11.drift_and_rewrite(clients.repartition(3), most_files=5, ranges=3).orderBy("file_no"))
    assert [r["rows_sha256"] for r in got] == [r["rows_sha256"] for r in again]
    assert rows(op11.drift_and_rewrite(clients.limit(0))) == []


def test_one_frequent_client_is_dealt_to_many_ranges(spark):
    many = spark.range(4000).select(F.lit(1).cast("long").alias("client_id"), F.lit("same").alias("name"))
    out, n = op11.ranked(many, ["client_id"], 8)
    got = rows(out.select("_rank"))
    assert n == 4000 and sorted(r["_rank"] for r in got) == list(range(4000))
    stored = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.shiftright("_at", 33)).count()
    assert max(r["count"] for r in rows(stored)) < 1500


def test_a_rewrite_can_run_again_after_part_of_its_moves(spark, tmp_path):
    clients = spark.createDataFrame([(i, i, "s", None, "n", "e", "c", 1, "g", 1.5, "x", "y") for i in range(12)], SCHEMA).drop("file_no", "_rank")
    ordered, n = op11.ranked(clients, ["client_id"], 4)
    uri = f"file://{tmp_path}"
    started = op11.write_files(ordered.withColumn("nation_id", F.col("nation_id").cast("long")).withColumn("file_no", F.floor(F.col("_rank") / 2)), 6, op11.CLIENTS, uri)
    first = rows(op11.rewrite(started, 6, op11.CLIENTS, uri).orderBy("file_no"))
    once = rows(op11.digests(started, 6, uri).orderBy("file_no"))
    again = rows(op11.rewrite(started, 6, op11.CLIENTS, uri).orderBy("file_no"))
    assert rows(op11.digests(started, 6, uri).orderBy("file_no")) == once
    assert [r["version"] for r in first] == [r["version"] for r in again] and {r["start_columns"] for r in again} == {",".join(NAMES)}


def cut_by_hand(doc_id, text):
    text, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@RELAXED
@given(st.lists(st.text(alphabet="aB <>PSM\n\\é😀", max_size=30) | st.none(), min_size=1, max_size=25))
def test_cuts_equal_a_plain_loop_and_restore(spark, texts):
    made = op12.fill_in_middle(docs(spark, texts))
    got = rows(made.withColumn("back", op12.restored(F.col("output"), F.col("form"))))
    for r in got:
        text = texts[r["doc_id"]]
        size = lambda x: None if x is None else len(x)
        assert (r["n"], r["form"], size(r["prefix"]), size(r["middle"]), r["output"]) == cut_by_hand(r["doc_id"], text)
        assert r["back"] == (text or "")


def test_cuts_of_awkward_rows(spark):
    got = rows(op12.fill_in_middle(awkward(spark)))
    assert len(got) == awkward(spark).count() and {r["form"] for r in got if not r["output"]} == {"plain"}
    for r in got:
        assert r["form"] == "plain" or "".join((r["prefix"], r["middle"], r["suffix"])) == op12_text(spark, r)
    assert rows(op12.fill_in_middle(empty(spark))) == []
    with pytest.raises(ValueError):
        op12.Sentinels("<P>", "<P>", "<M>")


def op12_text(spark, r):
    from .util import awkward_rows

    return next(t for i, t, *_ in awkward_rows() if i == r["doc_id"] and t and len(t) == len(r["prefix"] + r["middle"] + r["suffix"]) and t.startswith(r["prefix"]))


TURN = "conv_id long, turn long, role string, text string, example string, header string, t string, w string, loss string"
_X = ("x",) * 5
_CONTROL = st.text(alphabet="ab\\#</turn>: \n", max_size=24)


@RELAXED
@given(st.lists(st.tuples(st.integers(0, 3) | st.none(), st.sampled_from(["user", "assistant", "system", None, "a: b"]), _CONTROL | st.none()), min_size=1, max_size=20))
def test_turns_and_loss_are_read_back(spark, said):
    made = op13.examples(spark.createDataFrame([(c, i, r, t, *_X) for i, (c, r, t) in enumerate(said)], TURN))
    read = rows(made.withColumns({"turns": op13.turns_of(F.col("text")), "loss": op13.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end"))}).orderBy("conv_id", "example"))
    for conv in {c for c, _, _ in said}:
        mine = [(r or "", t or "") for c, r, t in said if c == conv]
        got = [r for r in read if r["conv_id"] == conv]
        assert [(t["role"], t["text"]) for t in got[-1]["turns"]] == mine
        assert [r["loss"] for r in got if r["trained"]] == [t for r, t in mine if r == "assistant"]
        assert all(r["loss"] == "" for r in got if not r["trained"])
        ends = [i for i, (r, _) in enumerate(mine) if r == "assistant" or i == len(mine) - 1]
        assert [len(r["turns"]) for r in got] == [i + 1 for i in ends] and {r["n_examples"] for r in got} == {len(ends)}


def test_chat_of_awkward_rows(spark):
    long = "word </turn> ### " * 10_000
    turns = [(1, 0, "user", None, *_X), (1, None, "assistant", "first", *_X), (1, 0, "user", None, *_X), (None, 1, None, long, *_X), (2, 5, "assistant", "", *_X), (3, 0, "system", "\\", *_X)]
    got = {(r["conv_id"], r["example"]): r for r in rows(op13.examples(spark.createDataFrame(turns, TURN)))}
    assert set(got) == {(1, 1), (1, 2), (None, 1), (2, 1), (3, 1)}
    assert got[1, 1]["trained"] and not got[1, 2]["trained"] and got[2, 1]["loss_start"] == got[2, 1]["loss_end"]
    assert got[None, 1]["text"].count("</turn>") == 1
    assert rows(op13.examples(spark.createDataFrame([], TURN))) == []
