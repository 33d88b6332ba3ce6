"""Benchmark decontamination on a distributed positional inverted index.

The benchmark's windows (WINDOW consecutive words of an item; all its words where it has fewer) are the test phrases.
One pass over the documents counts the benchmark's terms in them; each window's terms are ranked by that count, and only
terms that are among some window's RAREST get postings: (term, document, position), sorted by term, in the shared folder.
Postings of a window's rarest term, moved back by the term's offset, are the places where it may start; they are
intersected with the equally moved postings of its next term. What is left is verified against all words of the text,
so rank and filters decide only how much is looked at, never what is found. As a phrase, a window with a term that no document
has is left out at once. Terms travel to the workers as Bloom filters of bounded size, which may only let too much through.

Defined cases: null or empty texts have no words and are never contaminated; items without words or id make no windows;
rows that share an id are judged each by its own text, so are rows with a null id; an empty benchmark marks nothing;
columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, alphanumeric, bloom, documents, ids_of, in_bloom, keyed_texts, known_ids, list_array, materialize, read_table, runs, slices, small_batches

WINDOW, RAREST = 13, 2
#: A document is contaminated if at least one word in SHARE is hit.
SHARE = 20
_TEXT = alphanumeric()


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, n, terms): win is the hash of the window's n words, terms are theirs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, valid = known_ids(b)
            for lo, hi, buf, offsets in slices(b):
                w = Words(buf, offsets, _TEXT)
                for i in range(hi - lo):
                    h = w.hash[w.first[i] : w.first[i] + w.count[i]]
                    if len(h) and valid[lo + i]:
                        n = min(window, len(h))
                        terms = np.lib.stride_tricks.sliding_window_view(h, n)
                        yield pa.record_batch({"item_id": np.full(len(terms), ids[lo + i]), "win": runs(h, n).view(np.int64), "n": np.full(len(terms), n, np.int32), "terms": list_array(np.ascontiguousarray(terms).view(np.int64).ravel(), np.full(len(terms), n))})

    return benchmark.mapInArrow(work, "item_id long, win long, n int, terms array<long>")


def term_counts(docs: DataFrame, wanted) -> DataFrame:
    """(term, n) over all documents, of terms that pass the filter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offsets in slices(b):
                h = Words(buf, offsets, _TEXT).hash
                terms, n = np.unique(h[in_bloom(h, wanted.value)], return_counts=True)
                if len(terms):
                    yield pa.record_batch({"term": terms.view(np.int64), "n": n})

    return docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, wanted) -> DataFrame:
    """(term, rid, mark, at): where each wanted term stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids = ids_of(b, "rid")
            for lo, _, buf, offsets in slices(b):
                w = Words(buf, offsets, _TEXT)
                at = np.flatnonzero(in_bloom(w.hash, wanted.value))
                if len(at):
                    row = np.searchsorted(w.first, at, "right") - 1
                    yield pa.record_batch({"term": w.hash[at].view(np.int64), "rid": rids[row + lo], "mark": w.marks[row], "at": at - w.first[row]})

    return docs.select("rid", "text").mapInArrow(work, "term long, rid long, mark long, at long")


def _keep_wanted(spark: SparkSession, terms: DataFrame):
    return spark.sparkContext.broadcast(bloom(terms.select(F.col("term").alias("key")), terms.count()))


def inverted_index(docs: DataFrame, windows: DataFrame, rarest: int = RAREST, phrases: bool = True) -> tuple[DataFrame, DataFrame]:
    """The postings of the rarest terms of each window, and (win, rank, term, offset, n) of those terms; both materialised.
    Of windows with a term that no document has, phrases leave out all, others that term only."""
    spark = docs.sparkSession
    each = windows.dropDuplicates(["win"]).select("win", "n", F.posexplode("terms").alias("offset", "term"))
    terms = each.select("term").distinct()
    counts = term_counts(docs, _keep_wanted(spark, terms))
    ranked = each.join(counts.withColumnRenamed("n", "df"), "term", "left")
    per = Window.partitionBy("win")
    if phrases:
        ranked = ranked.withColumn("missing", F.max(F.col("df").isNull().cast("int")).over(per)).where("missing = 0")
    else:
        ranked = ranked.where("df is not null")
    ranked = ranked.withColumn("rank", F.row_number().over(per.orderBy("df", "term", "offset"))).where(F.col("rank") <= rarest)
    chosen = materialize(ranked.select("win", "rank", "term", "offset", "n"), "op10-terms")
    index = materialize(postings(docs, _keep_wanted(spark, chosen.select("term").distinct())).sortWithinPartitions("term"), "op10-postings")
    return index, chosen


def phrase_candidates(index: DataFrame, chosen: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(rid, mark, win, n, start) where the rarest terms of a window stand at its offsets."""
    first = chosen.where("rank = 1").select("term", "win", "n", "offset")
    found = index.join(first, "term").select("rid", "mark", "win", "n", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    for rank in range(2, rarest + 1):
        more = chosen.where(F.col("rank") == rank).select("win", "term", "offset")
        with_next = found.join(more, "win").withColumn("at", F.col("start") + F.col("offset"))
        met = with_next.join(index, ["term", "rid", "mark", "at"], "left_semi").select("rid", "mark", "win", "n", "start")
        short = found.where(F.col("n") < rank)  # windows of fewer words than that
        found = met.unionByName(short)
    return found


def verify(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, marks, wins, ns, starts (lists in step, or null). Each candidate is held against all its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, valid = known_ids(b)
            lists = {k: b.column(b.schema.get_field_index(k)) for k in ("marks", "wins", "ns", "starts")}
            for lo, hi, buf, offsets in slices(b):
                w = Words(buf, offsets, _TEXT)
                hit, wins = np.zeros(hi - lo, np.int64), []
                for i in range(hi - lo):
                    wins.append([])
                    if not lists["wins"][lo + i].is_valid:
                        continue
                    mark, win, ns, start = (lists[k][lo + i].values.to_numpy() for k in ("marks", "wins", "ns", "starts"))
                    h = w.hash[w.first[i] : w.first[i] + w.count[i]]
                    over = np.zeros(len(h) + 1, np.int64)
                    for n in np.unique(ns):
                        mine = (ns == n) & (mark == w.marks[i]) & (start + n <= len(h))
                        if mine.any():
                            same = runs(h, int(n))[start[mine]].view(np.int64) == win[mine]
                            at, found = start[mine][same], win[mine][same]
                            np.add.at(over, at, 1)
                            np.add.at(over, at + n, -1)
                            wins[-1] += np.unique(found).tolist()
                    hit[i] = np.count_nonzero(np.cumsum(over[:-1]))
                yield pa.record_batch({"doc_id": pa.array(ids[lo:hi], pa.int64(), mask=~valid[lo:hi]), "mark": w.marks, "n_words": w.count.astype(np.int64), "n_hit": hit, "wins": pa.array(wins, pa.list_(pa.int64()))})

    return docs.mapInArrow(work, "doc_id long, mark long, n_words long, n_hit long, wins array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted as strings), contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = keyed_texts(docs, id_col, text_col).withColumn("rid", F.coalesce("doc_id", F.xxhash64("text"), F.lit(0)))
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = materialize(test_windows(items, window), "op10-windows")
    index, chosen = inverted_index(docs, windows)
    found = phrase_candidates(index, chosen).groupBy("rid").agg(F.collect_list(F.struct("mark", "win", "n", "start")).alias("c"))
    found = found.select("rid", F.col("c.mark").alias("marks"), F.col("c.win").alias("wins"), F.col("c.n").alias("ns"), F.col("c.start").alias("starts"))
    out = materialize(verify(docs.join(found, "rid", "left").select("doc_id", "text", "marks", "wins", "ns", "starts")), "op10-verified")
    hits = out.where("n_hit > 0").select("doc_id", "mark", F.explode("wins").alias("win"))
    of = windows.select("win", "item_id").distinct()
    lists = hits.join(of, "win").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "items")
    out = out.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, within: int = 20, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first, last): of the terms of one of the item's windows that any document has, the two rarest stand at
    most `within` words apart. A window with fewer than two such terms has no pair and matches nothing."""
    small_batches(docs.sparkSession)
    docs = keyed_texts(docs, id_col, text_col).withColumn("rid", F.coalesce("doc_id", F.xxhash64("text"), F.lit(0)))
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = materialize(test_windows(items, window), "op10-windows")
    index, chosen = inverted_index(docs, windows, phrases=False)
    one, two = (chosen.where(F.col("rank") == r).select("win", F.col("term").alias(f"term{r}")) for r in (1, 2))
    a = index.join(one, F.col("term") == F.col("term1")).join(two, "win").select("win", "term2", "rid", "mark", F.col("at").alias("a"))
    # positions are dealt into blocks of `within` words, so near ones are in the same block or the next
    a = a.select("*", F.explode(F.sequence(F.floor(F.col("a") / within) - 1, F.floor(F.col("a") / within) + 1)).alias("block"))
    b = index.select(F.col("term").alias("term2"), "rid", "mark", F.col("at").alias("b"), F.floor(F.col("at") / within).alias("block"))
    near = a.join(b, ["term2", "rid", "mark", "block"]).where((F.abs(F.col("a") - F.col("b")) <= within) & (F.col("a") != F.col("b")))
    near = near.join(windows.select("win", "item_id").distinct(), "win")
    return near.select(F.col("rid").alias("doc_id"), "item_id", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("last")).distinct()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: For each document of {docs}: n_words, n_hit, items.
HITS_SQL = rf"""
 dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM {{docs}}),
 bw AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
 bk AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, p, p + least(len(w), 13) - 1) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM bw WHERE len(w) > 0)),
 lens AS (SELECT DISTINCT n FROM bk),
 dk AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)),
 occ AS (SELECT doc_id, p, bk.n, item_id FROM dk JOIN bk ON dk.k = bk.k AND dk.n = bk.n),
 hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS i FROM occ) GROUP BY doc_id),
 items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM occ GROUP BY doc_id),
 hits AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(items, []) AS items
  FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id))"""

SQL = {
    "op10_decontamination": f"""
WITH {HITS_SQL.format(docs="documents")}
SELECT doc_id, n_words, n_hit, CAST(len(items) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  (n_hit > 0 AND 20 * n_hit >= n_words) AS contaminated FROM hits
"""
}
