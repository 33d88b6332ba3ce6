"""Every named query against its SQL, on the smallest tables; and the entry module without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarrylight import catalog_queries as cq

REPO = Path(__file__).resolve().parent.parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations benchmark labels".split()


def norm(rows: list[dict]) -> list[str]:
    return sorted(repr([(k, round(v, 6) if isinstance(v, float) else v) for k, v in sorted(r.items())]) for r in rows)


def test_every_query_has_sql():
    assert set(cq.QUERIES) == set(cq.SQL) and not set(cq.QUERIES) & set(cq.GOLDENS)


@pytest.mark.parametrize("name", sorted(cq.QUERIES | cq.GOLDENS))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute((cq.SQL | cq.GOLDEN_SQL)[name])
    names = [c[0] for c in got.description]
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    assert norm([r.asDict(recursive=True) for r in (cq.QUERIES | cq.GOLDENS)[name](spark, sf_dir).collect()]) == norm(want)


def test_entry_imports_without_llm():
    """The driver may delete the subpackage and the pipeline."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('quarrylight.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert set(e.queries()) == set(e.oracle_sql()) and 'bm25_topk' in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_entry_asks_every_benchmark_text(spark, sf_dir):
    import __spark_entry__

    items = {r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {r["query_id"] for r in __spark_entry__.entry(spark).collect()} == items


def test_term_stats_of_rows_that_share_ids(spark, tmp_path, monkeypatch):
    """Statistics as SQL has them where rows share ids, or have none, and no table of postings on the way."""
    from quarrylight.operators import bm25

    rows = [(1, "a b b"), (1, "a b b"), (1, "b c d e"), (2, "a fooBar"), (None, "a z"), (None, "a z"), (None, None), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, name: made.append(df.columns) or real(df, name))
    got = {tuple(r) for r in cq.QUERIES["term_stats"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(t, df, round(x, 4)) for t, df, x in con.execute(cq.SQL["term_stats"]).fetchall()}
    assert got == want and {("a", 3), ("b", 2), ("foobar", 1)} <= {r[:2] for r in got} and not any("tf" in columns for columns in made)
