"""Operators on small inputs: properties that hold for any input, and cases that SQL doesn't reach."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import bm25, graph
from quarrylight.operators.bm25 import Bm25Index, search_documents
from quarrylight.operators.parse import parse_source
from quarrylight.plans import fixtures, planner, tools
from quarrylight.plans.engine import CodeIndex
from quarrylight.sources.repository import discover, scan_repository

RELAXED = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def basics(spark):
    return CodeIndex.from_table(fixtures.source_files(spark, "basics"), max_lines=5)


@pytest.fixture(scope="module")
def shop(spark):
    return CodeIndex.from_table(fixtures.source_files(spark, "shop"))


def tokens_by_rule(text: str) -> list[str]:
    out: list[str] = []

    def add(t):
        if t and out[-1] != t.lower():
            out.append(t.lower())

    for raw in re.findall(T.IDENTIFIER, text):
        out.append(raw.lower())
        for part in raw.split("."):
            if "." in raw:
                add(part)
            for word in filter(None, part.split("_")):
                if "_" in part:
                    add(word)
                cut = re.sub("([a-z0-9])([A-Z])", r"\1_\2", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", word))
                if "_" in cut:
                    for piece in filter(None, cut.split("_")):
                        add(piece)
    return out


@RELAXED
@given(st.lists(st.text(alphabet="aBcD_.9 é", max_size=24), min_size=1, max_size=20))
def test_tokenizer_follows_its_rules(spark, texts):
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in got} == {i: tokens_by_rule(t) for i, t in enumerate(texts)}


def test_null_text_has_no_tokens(spark):
    assert spark.range(1).select(T.tokenize(F.lit(None).cast("string")).alias("k")).first()["k"] == []


def test_index_and_scan_search_agree(spark):
    docs = spark.createDataFrame([(i, f"alpha{'Beta' * (i % 3)} gamma_{i % 5} delta") for i in range(40)], "id int, t string")
    asked = spark.createDataFrame([(1, "alpha gamma_3 delta delta", 7), (2, "alphaBeta", 50), (3, " ", 5)], "query_id int, query string, top_k int")
    a = Bm25Index.build(docs, "id", F.col("t")).search(asked).orderBy("query_id", "rank").collect()
    b = search_documents(docs, asked, "id", F.col("t")).orderBy("query_id", "rank").collect()
    assert a == b and len([r for r in a if r["query_id"] == 1]) == 7
    for q in (1, 2):
        mine = [r for r in a if r["query_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(x["score"] >= y["score"] for x, y in zip(mine, mine[1:], strict=False))


def test_empty_index(spark):
    none = spark.createDataFrame([], "id int, t string")
    index = Bm25Index.build(none, "id", F.col("t"))
    asked = spark.createDataFrame([(1, "x", 5)], "query_id int, query string, top_k int")
    assert len(index) == 0 and index.search(asked).count() == 0


def test_chunk_text_is_the_exact_slice(basics):
    lines = {r["file"]: r["lines"] for r in basics.modules.collect()}
    for c in basics.chunks.collect():
        assert c["text"] == "\n".join(lines[c["file"]][c["start_line"] - 1 : c["end_line"]])


def test_every_symbol_has_chunks_without_gaps(basics):
    chunks = basics.chunks.collect()
    for s in basics.symbols.collect():
        mine = sorted((c["start_line"], c["end_line"]) for c in chunks if c["symbol_id"] == s["symbol_id"])
        assert mine[0][0] == s["start_line"] and mine[-1][1] == s["end_line"]
        assert all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_long_function_is_split_after_statements(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(32))
    made = CodeIndex.from_table(spark.createDataFrame([("r", "f.py", f"def f():\n{body}\n")], "repository_id string, file string, source string"), max_lines=12).chunks
    parts = made.where("kind = 'function'").orderBy("start_line").select("start_line", "end_line", "chunk_id", "context.total_parts").collect()
    assert [tuple(p)[:2] for p in parts] == [(1, 12), (13, 24), (25, 33)] and parts[0]["chunk_id"] == "f.py::f::part_1" and parts[0]["total_parts"] == 3


def test_parser_keeps_going():
    assert parse_source("def broken(\n    pass\n", "b.py")["diagnostics"][0]["line"] == 1
    assert parse_source("x" * 10 + "(" * 5000, "deep.py")["diagnostics"]
    assert parse_source("", "e.py")["n_lines"] == 0
    kinds = {s["qualified_name"]: s["kind"] for s in parse_source("class A:\n    async def m(self):\n        def n(): pass\nasync def f(): pass\n", "k.py")["symbols"]}
    assert kinds == {"A": "class", "A.m": "async_method", "A.m.n": "function", "f": "async_function"}


def test_decorators_are_not_lines_of_the_definition():
    [s] = parse_source("@one\n@two(3)\ndef f():\n    pass\n", "d.py")["symbols"]
    assert s["decorators"] == ["one", "two(3)"] and s["start_line"] == 3


def test_invalid_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"# \xff\nx = 1\n")
    (tmp_path / "_ok.py").write_text("y = 2\n")
    got = {r["file"]: r for r in scan_repository(spark, "r", tmp_path).collect()}
    assert "�" in got["bad.py"]["source"] and got["_ok.py"]["read_error"] is None
    assert discover(tmp_path) == ["_ok.py", "bad.py"]
    with pytest.raises(ValueError):
        scan_repository(spark, "r", tmp_path / "none")


def edges(spark, pairs):
    rows = [(a, b, r, i) for i, (a, b, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "caller string, callee string, resolution string, edge_ord long")


def test_paths(spark):
    e = edges(spark, [("a", "b", "exact"), ("a", "c", "exact"), ("c", "d", "exact"), ("b", "d", "exact"), ("d", "x", "unresolved"), ("d", "a", "exact")])
    assert [(r["caller"], r["callee"]) for r in graph.find_path(e, "a", "d").collect()] == [("a", "b"), ("b", "d")]
    assert graph.find_path(e, "a", "x") is None
    assert graph.find_path(e, "a", "x", include_unresolved=True).count() == 3
    assert graph.find_path(e, "a", "a").count() == 0


def test_deep_paths_are_found(spark):
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "exact") for i in range(103)]).coalesce(1)
    assert [r["edge_ord"] for r in graph.find_path(e, "n0", "n103").collect()] == list(range(103))


def test_chain_prefers_by_role_within_the_first_ten(spark):
    calls = [("f::start", f"f::noise_{i}", "exact") for i in range(9)] + [("f::start", "f::get_db", "probable"), ("f::start", "f::save_write", "exact")]
    e = edges(spark, calls).selectExpr("'r' repository_id", "*", "'f' file", "7 line")
    nodes = spark.createDataFrame([("r", "f::start", "start", "start", "f", 1, 2)], "repository_id string, node string, name string, qualified_name string, file string, start_line int, end_line int")
    starts = spark.createDataFrame([("r", "f::start")], "repository_id string, start string")
    got = graph.greedy_chains(starts, e, nodes).orderBy("order").collect()
    assert [r["node"] for r in got] == ["f::start", "f::get_db"]  # the eleventh edge is never seen
    assert got[1]["start_line"] == 7 and got[1]["role"] == "database"


def test_chains_read_edges_and_nodes_once(spark):
    """However many hops there are, what they are followed on is made once."""
    reads = {"edges": spark.sparkContext.accumulator(0), "nodes": spark.sparkContext.accumulator(0)}

    def heard(rows, name):
        def count(batches, seen=reads[name]):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return rows.mapInArrow(count, rows.schema)

    e = edges(spark, [(f"n{i}", f"n{i + 1}", "exact") for i in range(4)]).selectExpr("'r' repository_id", "*", "'f' file", "7 line")
    nodes = spark.createDataFrame([("r", f"n{i}", f"n{i}", f"n{i}", "f", 1, 2) for i in range(5)], "repository_id string, node string, name string, qualified_name string, file string, start_line int, end_line int")
    starts = spark.createDataFrame([("r", "n0")], "repository_id string, start string")
    got = graph.greedy_chains(starts, heard(e, "edges"), heard(nodes, "nodes")).orderBy("order").collect()
    assert [r["node"] for r in got] == [f"n{i}" for i in range(5)]
    assert reads["edges"].value == 4 and reads["nodes"].value == 5


def test_hits_are_scored_in_parts_by_their_number(spark, monkeypatch):
    """Small postings that many queries multiply are still dealt to many tasks."""
    monkeypatch.setattr(bm25, "HITS", 500)
    docs = spark.range(400).select("id", F.lit("word").alias("text")).coalesce(1)
    index = Bm25Index.build(docs, "id", F.col("text"))
    asked = spark.range(20).selectExpr("id query_id", "'word' term", "10 top_k", "1L qtf").join(index.terms, "term").crossJoin(index.corpus)
    scored = bm25.score_hits(index.postings, asked, (), 1.5, 0.75, ("query_id",))
    per_task = [r["n"] for r in scored.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 8000 and len(per_task) > 10 and max(per_task) < 8000 / 4


def test_a_frequent_term_is_saved_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        docs = spark.range(0, 4000, 1, 8).select("id", F.lit("word").alias("text"))
        Bm25Index.build(docs, "id", F.col("text")).save(f"file://{tmp_path}")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(f"file://{tmp_path}/postings").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and sum(r["count"] for r in files) == 4000


def test_postings_of_chunks_are_read_from_their_table(shop):
    """They are as many as the words of all chunks: no copy of them is kept in memory."""
    assert shop.bm25_by_repository.terms.is_cached and not shop.bm25_by_repository.postings.is_cached
    assert not shop.bm25.postings.is_cached and tools.Tools(shop).keyword_search("order").count() > 0


def test_shop_investigation_is_grounded(shop):
    r = planner.investigate(shop, "shop", "Trace a create order request to the database write.")
    assert [s["role"] for s in r.chain][-1] == "database" and r.grounding == "grounded"
    assert {t["tool_name"] for t in r.trace} == {"keyword_search", "symbol_lookup", "find_callees", "get_source"}
    assert len(r.trace) <= planner.MAX_STEPS
    assert all(e["source_text"] for e in r.evidence if e["kind"] == "direct")


def test_repositories_do_not_mix(spark):
    both = CodeIndex.from_table(fixtures.source_files(spark, "shop", "rules"))
    for r in both.edges.where("resolution <> 'unresolved'").join(both.symbols.selectExpr("symbol_id callee", "repository_id other"), "callee").collect():
        assert r["repository_id"] == r["other"]


def test_definitions_have_schemas():
    assert {d["name"] for d in tools.Tools.definitions()} == set(tools.ARGUMENTS)


def test_tables_are_dropped(spark, tmp_path):
    from quarrylight.sources.tables import drop_tables, materialize

    kept = materialize(spark.range(5).toDF("x"), "t")
    assert kept.count() == 5 and drop_tables(spark)
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_settings_come_from_the_environment():
    from quarrylight.session import Settings

    s = Settings.from_env({"QUARRYLIGHT_APP_NAME": "x", "QUARRYLIGHT_SHUFFLE_PARTITIONS": "7", "QUARRYLIGHT_CHECKPOINT_DIR": "file:///c"})
    assert s.conf()["spark.sql.shuffle.partitions"] == "7" and s.conf()["spark.checkpoint.dir"] == "file:///c"
    assert "spark.master" not in Settings.from_env({}).conf()


def test_strict_matches_whole_classes(spark):
    code = "class UserService:\n    def get(self):\n        return 1\n\n\ndef f():\n    u = User()\n    return u.get()\n"
    rows = spark.createDataFrame([("r", "a.py", code)], "repository_id string, file string, source string")
    found = {strict: CodeIndex.from_table(rows, strict=strict).edges.where("callee like '%get'").first()["resolution"] for strict in (False, True)}
    assert found == {False: "exact", True: "probable"}


# --- trees, growing indexes, many questions ------------------------------------------------------------------------------------


def test_tree_reads_any_file_but_none_outside(spark, tmp_path):
    from quarrylight.sources.datasource import read_tree

    root = tmp_path / "root"
    (root / "docs").mkdir(parents=True)
    (root / "venv").mkdir()
    (root / "a.py").write_text("def f():\n    return 1\n")
    (root / "docs" / "read.md").write_text("one\ntwo\nthree\n")
    (root / "venv" / "v.py").write_text("x = 1\n")
    (root / "gone.py").symlink_to(root / "nowhere.py")
    (tmp_path / "secret.py").write_text("no\n")
    (root / "out.py").symlink_to(tmp_path / "secret.py")
    got = {r["file"]: r for r in read_tree(spark, root).collect()}
    assert set(got) == {"a.py", "gone.py", "out.py"} and got["a.py"]["source"].startswith("def")
    assert got["gone.py"]["source"] is None and got["gone.py"]["read_error"] and "outside" in got["out.py"]["read_error"]
    every = {r["file"] for r in read_tree(spark, root, all="true").collect()}
    assert every == {"a.py", "gone.py", "out.py", "docs/read.md", "venv/v.py"}
    asked = {r["file"]: r for r in read_tree(spark, root, files='["docs/read.md", "../secret.py", "/etc/hosts"]').collect()}
    assert asked["docs/read.md"]["source"] == "one\ntwo\nthree\n" and asked["../secret.py"]["source"] is None and asked["/etc/hosts"]["source"] is None

    index = CodeIndex.from_directory(spark, "r", root)
    t = tools.Tools(index)
    assert t.execute("get_source", {"file": "docs/read.md", "start_line": 2, "end_line": 9}).rows[0]["text"] == "two\nthree"
    for bad in ("../secret.py", "out.py", "docs/none.md"):
        assert not t.execute("get_source", {"file": bad, "start_line": 1, "end_line": 1}).success
    assert {r["file"] for r in index.diagnostics.collect()} == {"gone.py", "out.py"}
    assert [r["symbol_id"] for r in index.symbols_of_file("a.py").collect()] == ["a.py::f"]


def test_validation_knows_files_outside_of_the_index(spark):
    from quarrylight.operators import validate
    from quarrylight.schemas import EVIDENCE

    items = spark.createDataFrame([("e1", "direct", "read.md", 1, 2, None, "x", "text", "d"), ("e2", "direct", "none.md", 1, 2, None, "x", "text", "d")], EVIDENCE)
    none = spark.createDataFrame([], "file string, symbol_id string")
    assert {r["evidence_id"] for r in validate.issues(items, none, none).collect()} == {"e1", "e2"}
    others = spark.createDataFrame([("read.md",), ("more.md",)], "file string")
    assert [(r["evidence_id"], r["rule"]) for r in validate.issues(items, none, none, others).collect()] == [("e2", "V1")]


def test_growing_index_replaces_removes_and_merges(spark, tmp_path):
    from quarrylight.operators.bm25_store import Bm25Store
    from quarrylight.sources.tables import children

    store = Bm25Store(spark, f"file://{tmp_path}/store", fan_in=2)
    docs = lambda rows: spark.createDataFrame(rows, "id int, t string")
    asked = spark.createDataFrame([(1, "alpha beta beta", 9), (2, "gamma", 9), (3, "", 9)], "query_id int, query string, top_k int")
    hits = lambda index: [tuple(r) for r in index.search(asked).orderBy("query_id", "rank").collect()]
    assert hits(store) == []
    store.add(docs([(1, "alpha"), (2, "alpha beta"), (3, "gamma gamma")]), "id", F.col("t"))
    store.add(docs([(2, "gamma delta"), (4, ""), (None, "alpha")]), "id", F.col("t"))
    store.add(docs([(5, "beta alpha alpha"), (1, "beta")]), "id", F.col("t"))
    store.remove(spark.createDataFrame([(3,), (99,)], "id int"))
    left = docs([(1, "beta"), (2, "gamma delta"), (4, ""), (5, "beta alpha alpha")])
    assert hits(store) == hits(Bm25Index.build(left, "id", F.col("t"))) != []
    assert store.corpus().first()["n"] == 4
    store.compact()
    [one] = store.runs()
    assert hits(store) == hits(Bm25Index.build(left, "id", F.col("t")))
    store.vacuum()
    assert children(spark, f"file://{tmp_path}/store/runs") == [one.folder]
    store.add(docs([(3, "gamma")]), "id", F.col("t"))
    assert [h[2] for h in hits(store) if h[0] == 2] == [3, 2]


def test_heavy_terms_are_scored_once_for_all_queries_that_share_them(spark, monkeypatch):
    """Ties, repeated terms, queries of heavy terms alone, of light ones alone and of neither, and scopes: as scored one by one."""
    from quarrylight.operators import bm25

    rows = [(i, "ab"[i % 2], f"order endpoint w{i % 7} " + "endpoint " * (i % 3) + f"only{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "id int, r string, t string")
    texts = ["order endpoint only3", "endpoint order only59 only58", "order endpoint", "only7 w3", "order order endpoint only9", "nothing", "order endpoint only9 w2", ""]
    asked = spark.createDataFrame([(10 * k + i, "ab"[k], t, 2 + 3 * i) for i, t in enumerate(texts) for k in (0, 1)], "query_id int, r string, query string, top_k int")
    plans, plain = [], bm25.score_hits
    monkeypatch.setattr(bm25, "score_hits", lambda *a: plans.append(a[-1]) or plain(*a))

    def hits(scope, heavy):
        monkeypatch.setattr(bm25, "HEAVY", heavy)
        return [tuple(r) for r in Bm25Index.build(docs, "id", F.col("t"), scope=scope).search(asked).orderBy("query_id", "rank").collect()]

    for scope in ((), ("r",)):
        whole = hits(scope, 1_000_000)
        assert len(plans) == 1 and hits(scope, 60) == whole != []
        assert plans[1:] == [("bag",), ("query_id", "top_k", "bag")]
        plans.clear()


def test_scores_have_the_same_bits_in_any_order(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "id int, t string")
    asked = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(17)), 60)], "query_id int, query string, top_k int")
    runs = [[tuple(r) for r in Bm25Index.build(d, "id", F.col("t")).search(asked).orderBy("rank").collect()] for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.rand(3)))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 60


def test_frequent_names_are_dealt_to_blocks(spark, monkeypatch):
    from quarrylight.operators import resolve

    code = [("r", f"c{i}.py", f"class C{i}:\n    def same(self):\n        return 0\n\n\ndef dup():\n    return 1\n") for i in range(9)]
    code += [("r", "use.py", "from c3 import C3\n\n\ndef use(x):\n    y = C5()\n    y.same()\n    dup()\n    return x.same()\n"), ("r", "wide.py", "def wide(x):\n    return x.same()\n")]
    rows = spark.createDataFrame(code, "repository_id string, file string, source string")

    def edges():
        return sorted(tuple(r) for r in CodeIndex.from_table(rows).edges.select("caller", "callee", "resolution", "rule").collect())

    whole = edges()
    monkeypatch.setattr(resolve, "BLOCK", 2)
    assert edges() == whole
    rules = [e[3] for e in whole]
    assert {r: rules.count(r) for r in set(rules)} == {2: 1, 4: 1 + 9, 6: 1, 7: 9}
    assert [e[1] for e in whole if e[3] == 6] == ["c3.py::C3.same"] and [e[1] for e in whole if e[3] == 2] == ["c5.py::C5.same"]


def test_questions_together_are_answered_as_alone(spark):
    both = CodeIndex.from_table(fixtures.source_files(spark, "shop", "rules"))
    asked = [("a", "shop", "Trace the create order request to the database write."), ("b", "rules", "Explain what run does"), ("c", "shop", "Where is validate_order"), ("d", "shop", "Trace zzzunknown"), ("e", "none", "find order")]
    found = planner.investigate_all(both, spark.createDataFrame(asked, "question_id string, repository_id string, question string"))
    rows = {r["question_id"]: r for r in found.questions.collect()}
    assert {k: r["intent"] for k, r in rows.items()} == {"a": "trace", "b": "explain", "c": "find", "d": "trace", "e": "find"}
    chain = [r["symbol_name"] for r in found.chain.where("question_id = 'a'").orderBy("order").collect()]
    assert chain == ["create_order_endpoint", "place_order", "save_to_repo", "execute_write"]
    assert rows["d"]["n_calls"] == rows["e"]["n_calls"] == 1 and "No clear call chain" in rows["d"]["answer"]
    calls = found.calls.orderBy("question_id", "step").collect()
    for q in rows:
        assert [c["step"] for c in calls if c["question_id"] == q] == list(range(1, rows[q]["n_calls"] + 1))
    assert all(c["output"] for c in calls)
    alone = planner.investigate(both, "shop", asked[0][2])
    assert alone.answer == rows["a"]["answer"] and len(alone.trace) == rows["a"]["n_calls"]
    assert {e["file"] for e in alone.evidence} <= {r["file"] for r in both.of("shop").modules.collect()}
    assert both.of("shop") is both.of("shop")


def test_suites_tell_what_they_found(spark):
    from quarrylight.plans import simulate

    names = [*simulate.SUITES, "other"]
    code = [(n, f, s) for n in names for f, s in fixtures.REPOSITORIES["shop"].items()]
    index = CodeIndex.from_table(spark.createDataFrame(code, "repository_id string, file string, source string"))
    got = {(r["repository_id"], r["id"]): r for r in simulate.run_simulations(index, spark.createDataFrame([(n,) for n in names], "repository_id string")).collect()}
    assert len(got) == 5 + 3 * 4
    told = {k: (r["status"], r["actual"], r["diagnostic"]) for k, r in got.items()}
    assert told["demo_repo", "api_to_db_write"] == ("passed", "Trace complete", "Multi-hop chain traced 4 nodes (create_order_endpoint → place_order → save_to_repo → execute_write) terminating at database.")
    assert told["demo_repo", "missing_dependency"][0] in ("passed", "failed") and told["demo_repo", "missing_dependency"][1] in ("Dependency reported", "Not detected")
    assert told["demo_ecommerce", "order_creation_trace"] == ("passed", "Trace complete", "Order creation traced 4 hops terminating at database.")
    assert told["demo_ecommerce", "order_validation"][:2] == ("passed", "Validation identified")
    assert told["demo_auth", "login_trace"][2].startswith("Login traced 4 hops") or told["demo_auth", "login_trace"][2].startswith("Login handlers")
    assert told["other", "call_graph_traversal"][1] == "Edges resolved"
    assert told["other", "source_evidence_grounding"][2].startswith("Grounding status: ")
    assert all(r["name"] and r["expected"] for r in got.values())
    totals = {r["repository_id"]: r for r in simulate.summary(simulate.run_simulation(index, "other")).collect()}
    assert totals["other"]["total"] == 3


def test_blocks_of_postings_are_the_counts_of_terms(spark, monkeypatch, tmp_path):
    """Odd identifiers, texts side by side, null texts and ids that come again; a term of one block is one row; merged runs, whose
    blocks hold buried documents, are what an index of the rest has."""
    from quarrylight.operators import bm25_blocks
    from quarrylight.operators.bm25 import term_counts
    from quarrylight.operators.bm25_store import Bm25Store

    odd = ["a.b", ".c", "c.", ".", "", None, "x..y.z", "getUserName get_user HTTPServer", "Ä.b é_KK1.2", "_", "one two.three\nTHREE one", "word", "word.", "a.b a.b"]
    rows = [(f"k{i}", t) for i, t in enumerate(odd * 3)] + [("k1", ".c"), ("k1", "c"), ("k2", "more of it")]
    docs = spark.createDataFrame(rows, "k string, t string").coalesce(1)
    want = sorted(tuple(r) for r in term_counts(docs, "k", F.col("t")).select("term", "id", "tf", "dl").collect())
    for size, most in ((8 << 20, 10_000), (7, 10_000), (8 << 20, 3)):
        monkeypatch.setattr(bm25_blocks, "BLOCK_BYTES", size)
        monkeypatch.setattr(bm25_blocks, "BLOCK_DOCUMENTS", most)
        blocks = bm25_blocks.posting_blocks(docs, "k", F.col("t"))
        assert sorted(tuple(r) for r in blocks.select("term", F.inline("docs")).select("term", "id", "tf", "dl").collect()) == want

    monkeypatch.undo()
    store = Bm25Store(spark, f"file://{tmp_path}/store", fan_in=9)
    some = lambda rows: spark.createDataFrame(rows, "id int, t string").coalesce(1)
    store.add(some([(i, f"alpha w{i % 3}") for i in range(60)]), "id", F.col("t"))
    assert store.table("postings", store.runs()).where("term = 'alpha'").select("n").collect() == [(60,)]
    store.add(some([(i, "alpha beta") for i in range(5)]), "id", F.col("t"))
    store.add(some([(i, "gamma") for i in range(100, 104)]), "id", F.col("t"))
    store.remove(spark.createDataFrame([(7,), (8,), (4,)], "id int"))
    store.compact()
    held = store.table("postings", store.runs()).select("term", "n", F.inline("docs"))
    assert sorted(r["id"] for r in held.where("term = 'alpha'").collect()) == [i for i in range(60) if i not in (4, 7, 8)]
    assert {r["df"] for r in store.terms().where("term = 'alpha'").collect()} == {57} and store.corpus().first()["n"] == 61
