"""A BM25 index that grows: batches of documents become immutable runs, and their statistics add up.

A run has postings sorted by term, the lengths of its documents, tombstones of documents that it replaces or removes, and what it
adds to document frequencies and totals (less than nothing for what it replaces). Its postings are blocks: a term's documents among a
few thousand neighbours of the batch are one row (see `bm25_blocks`). A search reads the asked terms of all runs,
leaves out postings that a later run has buried, and adds up the statistics: the same as an index built anew of what is left.
When FAN_IN runs of one level have come together they are merged into one of the next, so there are few runs at any time.

Runs are folders with names of their own; a small manifest, written last, says which of them count. A batch or merge that
failed half-way leaves folders that nothing reads. One writer at a time; readers see the manifest they opened.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import children, delete, materialize, settle
from .bm25 import ASKED_MOST, DOCUMENT, K1, B, Bm25Index, by_term, idf, most_asked, query_terms, rank_hits, score_queries
from .bm25_blocks import blocks_of, blocks_of_postings, posting_blocks
from .chunk import dedup_first

FAN_IN = 4
_MANIFEST = "run long, level int, folder string"
#: The tables of a run; the type of id is that of the documents.
TABLES = ("postings", "documents", "dead", "terms", "totals")


@dataclass(frozen=True)
class Run:
    run: int
    level: int
    folder: str


class Bm25Store:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B, fan_in: int = FAN_IN):
        self.spark, self.path, self.k1, self.b, self.fan_in = spark, path.rstrip("/"), k1, b, fan_in

    # --- runs ---

    def runs(self) -> list[Run]:
        """What the latest manifest names; their number grows with the logarithm of that of batches."""
        versions = [int(name[2:]) for name in children(self.spark, f"{self.path}/manifest") if name.startswith("v=") and "_SUCCESS" in children(self.spark, f"{self.path}/manifest/{name}")]
        if not versions:
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={max(versions)}").collect()
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: r.run)

    def _commit(self, runs: list[Run]) -> None:
        version = 1 + max([int(n[2:]) for n in children(self.spark, f"{self.path}/manifest") if n.startswith("v=")], default=0)
        rows = self.spark.createDataFrame([(r.run, r.level, r.folder) for r in runs], _MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.path}/manifest/v={version}")

    def table(self, name: str, runs: list[Run]) -> DataFrame:
        """A table of some runs, with the number of its run."""
        out = None
        for r in runs:
            part = self.spark.read.parquet(f"{self.path}/runs/{r.folder}/{name}").withColumn("run", F.lit(r.run).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, folder: str, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            if name in ("postings", "terms"):
                rows = by_term(rows).sortWithinPartitions("term")
            rows.write.parquet(f"{self.path}/runs/{folder}/{name}")

    def _live(self, rows: DataFrame, runs: list[Run]) -> DataFrame:
        """rows: id, run and more. Those that no later run has buried."""
        dead = self.table("dead", runs).select("id", F.col("run").alias("_by"))
        return rows.join(dead, (rows["id"] == dead["id"]) & (rows["run"] < dead["_by"]), "left_anti")

    # --- writing ---

    def add(self, docs: DataFrame, id_col: str, text: Column, order: list | None = None) -> None:
        """Documents that are new, or replace those of the same id. Ids of a batch are distinct, or of each the first in an
        order counts. A null id can't be replaced and is left out."""
        if order is not None:
            docs = dedup_first(docs, [id_col], order)
        self._change(posting_blocks(docs.where(F.col(id_col).isNotNull()), id_col, text, distinct=order is not None))

    def remove(self, ids: DataFrame) -> None:
        """ids: id. Unknown ones are ignored."""
        none = ids.limit(0).select(F.lit(DOCUMENT).alias("term"), "id", *(F.lit(0).cast("long").alias(c) for c in ("tf", "dl")))
        self._change(blocks_of_postings(none), ids.select("id").distinct())

    def _change(self, blocks: DataFrame, removed: DataFrame | None = None) -> None:
        """The texts are read once, into the run's postings; what else it has comes of these."""
        runs = self.runs()
        number = 1 + max([r.run for r in runs], default=0)
        made = Run(number, 0, f"{number}-{uuid.uuid4().hex}")
        self._write(made.folder, postings=blocks)
        self._write(made.folder, documents=blocks_of(self.table("postings", [made]).where(F.col("term") == DOCUMENT)).select("id", "dl"))
        fresh = self.table("documents", [made]).select("id", "dl")
        touched = fresh.select("id") if removed is None else removed
        terms = self.table("postings", [made]).where(F.col("term") != DOCUMENT).groupBy("term").agg(F.sum("n").alias("df"))
        totals = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))
        gone = touched.limit(0)
        if runs:
            old = materialize(self._live(self.table("documents", runs), runs).join(touched, "id", "left_semi"), "replaced")
            gone = old.select("id")
            if not old.isEmpty():
                lost = blocks_of(self.table("postings", runs).where(F.col("term") != DOCUMENT)).join(old.select("id", "run"), ["id", "run"], "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
                terms = terms.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
                less = old.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("length"))
                totals = totals.unionByName(less).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        self._write(made.folder, dead=gone, terms=terms, totals=totals)
        self._commit([*runs, made])
        settle(self.spark)
        self._merge_full_levels()

    def _merge_full_levels(self) -> None:
        while True:
            runs = self.runs()
            last = [r for r in runs if r.level == runs[-1].level] if runs else []
            if len(last) < self.fan_in:
                return
            self.compact(last)

    def compact(self, some: list[Run] | None = None) -> None:
        """Merge consecutive runs, by default all, into one that takes the place of the last of them."""
        runs = self.runs()
        some = runs if some is None else some
        if len(some) < 2:
            return
        last = some[-1]
        made = Run(last.run, 1 + max(r.level for r in some), f"{last.run}-{uuid.uuid4().hex}")
        first = some[0].run == runs[0].run
        dead = self.table("dead", some).select("id").distinct()
        self._write(
            made.folder, postings=self._live_blocks(some), documents=self._live(self.table("documents", some), some).drop("run"), dead=dead.limit(0) if first else dead,
            terms=self.table("terms", some).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), totals=self.table("totals", some).agg(F.sum("n").alias("n"), F.sum("length").alias("length")),
        )
        self._commit([made if r == last else r for r in runs if r == last or r not in some])

    def _live_blocks(self, some: list[Run]) -> DataFrame:
        """The postings of some runs without what later ones of them have buried: blocks without such documents as they are."""
        blocks, documents = self.table("postings", some), self.table("documents", some)
        buried = documents.join(self._live(documents, some), ["id", "run"], "left_anti").select("id", "run")
        if buried.isEmpty():
            return blocks.drop("run")
        held = blocks_of(blocks.where(F.col("term") == DOCUMENT), "block")
        touched = materialize(held.join(buried, ["id", "run"], "left_semi").select("block", "run").distinct(), "touched")
        left = self._live(blocks_of(blocks.join(touched, ["block", "run"], "left_semi"), "block"), some)
        return blocks.join(touched, ["block", "run"], "left_anti").drop("run").unionByName(blocks_of_postings(left, "block"))

    def vacuum(self) -> None:
        """Delete runs that no reader of the latest manifest needs: merged ones and those of writes that failed."""
        kept = {r.folder for r in self.runs()}
        for folder in children(self.spark, f"{self.path}/runs"):
            if folder not in kept:
                delete(self.spark, f"{self.path}/runs/{folder}")

    # --- reading ---

    def corpus(self) -> DataFrame:
        """n, avgdl: one row."""
        runs = self.runs()
        if not runs:
            return self.spark.sql("select 0L as n, 0D as avgdl")
        return self.table("totals", runs).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).select("n", F.when(F.col("n") > 0, F.col("length") / F.col("n")).otherwise(F.lit(0.0)).alias("avgdl"))

    def terms(self, words: DataFrame | None = None) -> DataFrame:
        """term, df, idf of all runs together; words: term, distinct, if only some are wanted."""
        runs = self.runs()
        if not runs:
            return self.spark.sql("select '' as term, 0L as df, 0D as idf where false")
        rows = self.table("terms", runs)
        rows = rows if words is None else rows.join(words, "term", "left_semi")
        df = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.join(F.broadcast(self.corpus()), F.lit(True)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row

    def search(self, queries: DataFrame) -> DataFrame:
        """queries: query_id, query, top_k. As Bm25Index.search over what is left of all documents: postings meet the asked terms
        first, and only those the tombstones."""
        runs = self.runs()
        if not runs:
            return Bm25Index.build(self.spark.sql("select 0L as id, '' as text where false"), "id", F.col("text")).search(queries)
        # asked terms are known before postings are read: else these would be dealt by term before it is seen how few those are
        asked = materialize(query_terms(queries), "store-asked")
        words = asked.select("term").distinct()
        words = F.broadcast(words) if words.count() <= ASKED_MOST else words
        asked = materialize(asked.join(self.terms(words), "term").join(F.broadcast(self.corpus()), F.lit(True)), "store-asked")  # one row
        met = blocks_of(self.table("postings", runs).join(words, "term", "left_semi"))
        most = most_asked(queries)
        return rank_hits(score_queries(self._live(met, runs), asked, (), self.k1, self.b, most), most)
