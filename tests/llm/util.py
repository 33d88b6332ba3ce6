"""Small tables with every awkward case, and comparison with DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "documents embeddings benchmark labels conversations pages".split()
#: Names that operators use inside; as extra columns they must do no harm.
CLASHING = "text_ key hash at rid mark win n s s2 ln line a b rep block sig component size p copies taken score held_out _id _gone _lines _removed _row _cut".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, seed: int) -> str:
    """n words; equal seeds give equal texts, others almost surely no common run."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    long = prose(6000, 1)
    base = prose(40, 2)
    near = base.replace(base.split()[5], "changed", 1)
    rows = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "b"), (5, "", None), (6, long, "a"), (7, long, None), (8, "one", "b"), (9, " \t\n ", "c"),
        (10, f"{prose(20, 3)}\n{base}\n{prose(20, 4)}", "c"), (11, "Ünïcödé wörter 😀 und noch mehr " * 4, "c"), (None, base, "a"), (None, prose(30, 5), None),
        (12, prose(60, 6), "a"), (12, prose(60, 6), "a"), (13, prose(60, 7), "b"), (13, prose(60, 8), "b"), (14, "one", "b"), (15, "\n\n\n", "b"),
    ]
    return [(i, t, "en", s, len(t) if t is not None else None, *("x" for _ in CLASHING)) for i, t, s in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts: list[str | None]):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in rows(df)}


def oracle(sql: str, sf_dir: str) -> list[dict]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return [dict(zip(names, r, strict=True)) for r in got.fetchall()]


def same(a: list[dict], b: list[dict]) -> bool:
    def key(r: dict) -> str:
        return repr([(k, round(v, 9) if isinstance(v, float) else v) for k, v in sorted(r.items())])

    return sorted(map(key, a)) == sorted(map(key, b))
