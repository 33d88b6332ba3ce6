"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, connected components.

Vectors are compared within a label (and a length). Equal vectors are one class, which stands for all its rows. In each
table a vector's bucket is the pattern of signs against that table's hyperplanes; two vectors at the threshold fall into
one bucket of `bits` signs with probability (1 - angle / pi) ** bits, and the number of tables is set so that all of them
miss such a pair with probability MISS at most. Bits grow with the logarithm of the largest label's classes, so buckets
stay of a size. A bucket is compared in tiles of at most TILE by TILE classes, however many it holds, by one product in
double precision each; a pair counts in its first common table only. A tile returns sums of links and a spanning forest,
never its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null label,
link with nothing and are their own component; rows that share an id are vectors of their own for links, and one node
for components; ids may be null only for vectors that link with nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, small_batches, sorted_groups
from .components import connected_components

THRESHOLD, MISS, BUCKET, TILE, SEED = 0.98, 1e-4, 8, 256, 4242


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for the number of classes of the largest label."""
    bits = max(8, ceil(log2(max(largest, 1) / BUCKET)))
    together = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - together))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows of id, label, v that can link: v has no null or non-finite component and isn't zero."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("id is not null and label is not null and v is not null and size(v) > 0").where(fine)


def signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds sigs: the sign pattern of each table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(min(bits, 62), dtype=np.int64)
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            sigs = np.zeros((len(v), tables), np.int64)
            lengths = v.value_lengths().to_numpy()
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                x = flat[(ends[rows] - n)[:, None] + np.arange(n)]
                if n not in planes:
                    planes[n] = np.random.default_rng(SEED).standard_normal((n, tables * bits))
                x = x / np.abs(x).max(1, keepdims=True)
                sigs[rows] = ((x @ planes[n]) > 0).reshape(len(rows), tables, bits)[:, :, : len(powers)] @ powers
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "sigs"])

    return classes.mapInArrow(work, "rep long, label string, v array<double>, m long, sigs array<long>")


def _tile(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rep, links, root) of the classes of one tile that link in it, their first common table being this one."""
    col = {c: t.column(c).combine_chunks() for c in t.column_names}
    table, i, j = (col[c][0].as_py() for c in ("table", "i", "j"))
    block, rep, m = (col[c].to_numpy() for c in ("block", "rep", "m"))
    v, sigs = (col[c].flatten().to_numpy().reshape(t.num_rows, -1) for c in ("v", "sigs"))
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(a) or not len(b):
        return None
    v = v / np.abs(v).max(1, keepdims=True)
    norm = np.sqrt((v * v).sum(1))
    link = (v[a] @ v[b].T) / norm[a][:, None] / norm[b] >= threshold
    if not link.any():
        return None
    for before in range(table):
        link &= sigs[a, before][:, None] != sigs[b, before]
    if pa.compute.count_distinct(col["label"]).as_py() > 1:
        names = np.array(col["label"].to_pylist())
        link &= names[a][:, None] == names[b]
    if i == j:
        np.fill_diagonal(link, False)
    n, root = np.zeros(t.num_rows, np.int64), rep.copy()
    np.add.at(n, a, link @ m[b])
    if i != j:
        np.add.at(n, b, link.T @ m[a])
    most = np.iinfo(np.int64).max
    while True:  # the least id goes along links until nothing changes
        new = root.copy()
        new[a] = np.minimum(new[a], np.where(link, root[b][None, :], most).min(1))
        new[b] = np.minimum(new[b], np.where(link, root[a][:, None], most).min(0))
        if (new == root).all():
            break
        root = new
    keep = n > 0
    return rep[keep], n[keep], root[keep]


def tiles(spots: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root) over all tiles. Tiles are dealt by a hash and streamed in order, one at a time."""
    keys = ["g", "dim", "table", "sig", "i", "j"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, keys):
            got = _tile(t, threshold)
            if got is not None and len(got[0]):
                yield pa.record_batch({"rep": got[0], "links": got[1], "root": got[2]})

    dealt = spots.withColumn("g", F.xxhash64("label", "dim", "table", "sig", "i", "j"))
    return dealt.repartition("g").sortWithinPartitions(*keys).mapInArrow(work, "rep long, links long, root long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = usable(rows).select("id", "label", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    classes = keyed.groupBy("label", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.min_by("v", "id").alias("v"))
    classes = materialize(classes, "op4-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold)
    reps = materialize(signed(classes.select("rep", "label", "v", "m"), bits, tables), "op4-signed")
    each = reps.select("rep", "label", F.size("v").alias("dim"), F.posexplode("sigs").alias("table", "sig"))
    buckets = each.groupBy("label", "dim", "table", "sig").agg(F.count("*").alias("k")).where("k > 1")
    spots = each.join(buckets, ["label", "dim", "table", "sig"]).withColumn("blocks", F.ceil(F.col("k") / TILE))
    spots = spots.withColumn("block", F.pmod(F.xxhash64("rep", "sig"), F.col("blocks")))
    spots = spots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    spots = spots.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "k", "blocks")
    full = spots.join(reps.select("rep", "v", "m", "sigs"), "rep")
    met = materialize(tiles(full.select("label", "dim", "table", "sig", "i", "j", "block", "rep", "v", "m", "sigs"), threshold), "op4-met")
    links = met.groupBy("rep").agg(F.sum("links").alias("far"))
    comps = connected_components(met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "op4")
    of = classes.select("label", "h", "g", "rep", "m").join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    of = of.select("label", "h", "g", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # rows without an id link with nothing, also if they equal a class
    mine = rows.select("id", "label", F.when(F.col("id").isNotNull(), F.xxhash64("v")).alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    out = mine.join(of, ["label", "h", "g"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


SQL = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
   AND len(list_filter(x, lambda c: c <> 0)) > 0),
 l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
 n AS (SELECT a, count(*) AS k FROM l GROUP BY a),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT v.vec_id, least(v.vec_id, coalesce(min(r.b), v.vec_id)) AS component_id FROM v LEFT JOIN r ON r.a = v.vec_id GROUP BY v.vec_id)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id
"""
}
