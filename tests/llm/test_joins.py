"""Similarity joins against all pairs."""

import random

import numpy as np
import pytest

from quarrylight.llm.components import connected_components
from quarrylight.llm.op4_embedding_dedup import embedding_dedup, plan
from quarrylight.llm.op7_ngram_join import Bands, components_sql, ngram_join, signatures_of
from quarrylight.llm.op9_line_dedup import dedup_documents

from .util import by_id, docs, oracle, prose, rows, same


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text: str, k: int) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def copies(seed: int, n: int) -> list[str]:
    """Families of texts that differ by a few words, in chains and stars, among others."""
    rng, out = random.Random(seed), []
    for f in range(n):
        words = prose(rng.choice([4, 12, 30, 80, 200]), 100 * seed + f).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            out.append(" ".join(words))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_ngram_join_finds_what_all_pairs_find(spark, k, num, den):
    texts = copies(k, 40)
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    got = by_id(ngram_join(docs(spark, texts), k, num, den))
    assert [got[i]["component_id"] for i in range(len(texts))] == components(len(texts), links)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_ngram_join_of_five_words_matches_sql(spark, sf_dir):
    found = ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert same(rows(found), oracle(f"WITH RECURSIVE {components_sql('documents', 5, 8, 10)} SELECT doc_id, n_shingles, component_id FROM comp", sf_dir))


@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10)])
def test_similar_sets_share_a_signature(num, den):
    """By the pigeonhole, for any plan: also one with segments that may differ, and sets with many empty segments."""
    rng = np.random.default_rng(3)
    bands = Bands(num, den, 400)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) >> np.uint64(int(rng.integers(0, 3)) * 8))
        b = list(a)
        while True:
            c = list(b)
            if rng.random() < 0.5:
                c.append(np.uint64(rng.integers(0, 2**63)))
            elif c:
                c.pop(int(rng.integers(len(c))))
            if not c or den * len(set(a.tolist()) & set(map(int, c))) < num * len(set(a.tolist()) | set(map(int, c))):
                break
            b = c
        b = np.unique(np.array(b, np.uint64))
        for sets in (10, 10**9):
            plans = {k: bands.allocate(k, sets) for k in range(len(bands.low))}
            assert set(signatures_of(a, bands, plans).tolist()) & set(signatures_of(b, bands, plans).tolist())


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(5)
    lines = [prose(rng.choice([1, 3, 6, 15, 40]), s) for s in range(60)]
    texts = []
    for _ in range(40):
        own = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(lines).split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "edited"
            own.append(" ".join(words) if rng.random() < 0.9 else "")
        texts.append("\n".join(own))
    seen, want = [], []
    for t in texts:
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want.append("\n".join(kept))
    got = by_id(dedup_documents(docs(spark, texts)))
    assert [got[i]["text"] for i in range(len(texts))] == want


def test_embeddings_recall_and_exactness(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    near = base[rng.integers(0, 60, 240)] + rng.normal(size=(240, 32)) * rng.choice([0.02, 0.1, 0.2], 240)[:, None]
    x = np.vstack((base, near, near[:10])).astype(np.float32)
    data = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    data += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [1.0, None], 1), (1004, x[0].tolist(), None), (1005, [], 0)]
    got = {r["vec_id"]: r for r in rows(embedding_dedup(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")))}
    y = x.astype(np.float64)
    cos = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    link = (cos >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.98 * link.sum() <= found <= link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    roots = components(len(x), zip(*np.nonzero(link), strict=True))
    assert np.mean([got[i]["component_id"] == r for i, r in enumerate(roots)]) > 0.95
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1006))


def test_more_vectors_take_more_bits():
    assert plan(10)[0] < plan(10**9)[0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(links, "a long, b long"), "t"))}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"), "t")) == []


def test_embeddings_of_awkward_rows(spark):
    """Rows without an id, repeated ids, other columns, no rows."""
    schema = "vec_id long, embedding array<float>, label int, id string, v string, h string, rep string"
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    data = [(1, v, 0), (2, v, 0), (None, v, 0), (None, w, 0), (4, w, 1), (5, v, 1)]
    got = rows(embedding_dedup(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], schema)))
    assert sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got), key=lambda r: (r[0], r[1], r[2] or 0)) == sorted([(1, 1, 1, True), (2, 1, 1, False), (0, 0, None, True), (0, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)], key=lambda r: (r[0], r[1], r[2] or 0))
    assert rows(embedding_dedup(spark.createDataFrame([], schema))) == []
