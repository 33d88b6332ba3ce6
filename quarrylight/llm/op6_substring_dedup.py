"""Substring dedup on a log-structured fingerprint index.

Every window of WINDOW words holds a minimizer: the ANCHOR-word run in it whose hash is least. Two equal windows have
the same minimizer at the same place, so the index needs only the anchors (about two in nine words) to find every
window that could have been seen before. Runs of the index are immutable Parquet tables of (key, first_id), dealt by
key and sorted within each file; a new batch is merge-joined with them, and what matches is only a candidate.
Candidates are verified by whole windows: the hash of all WINDOW words, from the batch and from the documents that are
in the index already, and a window counts as seen where the smallest id that holds it is smaller than the document's.
After each batch its anchors become a new run; once there are more than `max_runs`, all runs are compacted into one.

The query takes its table in BATCHES batches of ascending ids, so that runs are merge-joined, verified and compacted. Nothing
of unbounded size is broadcast: shared anchor keys go to the workers as a Bloom filter of at most BLOOM_BITS_MOST bits (a
fuller filter lets more windows through, never fewer). Exact copies of whole texts need no windows; they, and documents that
lose windows, are found by bitmaps and joins, so that no other texts are shuffled.

Defined cases: null or empty text has no words; a text of fewer than WINDOW words loses nothing; rows with a null id
lose nothing and are no one's source; rows that share an id are judged each by its own text and are not each other's
source; of equal windows (ties) those of the smallest id stay; texts of any length are read whole, a slice of documents at
a time; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, Words, bloom, documents, drop, ids_of, in_bloom, keyed_texts, known_ids, materialize, mix, new_path, runs, settle, slices, small_batches, spaced

WINDOW, ANCHOR = 13, 5
BATCHES = 3
_TEXT = spaced(lower=False)


class _Slice:
    """Words of a slice, its windows, and the anchor of each window."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(buf, offsets, _TEXT)
        self.row = np.repeat(np.arange(len(offsets) - 1), w.count)
        n = len(self.row) - WINDOW + 1
        if n <= 0:
            self.at = np.empty(0, np.int64)
            return
        whole = self.row[:n] == self.row[WINDOW - 1 :]
        self.at = np.flatnonzero(whole)
        keys = runs(w.hash, ANCHOR)
        self.anchor = (np.lib.stride_tricks.sliding_window_view(keys, WINDOW - ANCHOR + 1)[:n].argmin(1) + np.arange(n))[whole]
        self.key = keys[self.anchor]


def anchors(docs: DataFrame) -> DataFrame:
    """(key, doc_id) of every anchor, once a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ids_of(b)
            for lo, _, buf, offsets in slices(b):
                s = _Slice(buf, offsets)
                if len(s.at):
                    new = np.r_[True, s.anchor[1:] != s.anchor[:-1]]
                    yield pa.record_batch({"key": s.key[new].view(np.int64), "doc_id": ids[s.row[s.at[new]] + lo]})

    return docs.mapInArrow(work, "key long, doc_id long")


def windows(docs: DataFrame, shared) -> DataFrame:
    """(hash, doc_id, at) of the windows whose anchor passes the filter, once a document; at: the text's mark and the window's
    first word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ids_of(b)
            for lo, _, buf, offsets in slices(b):
                s = _Slice(buf, offsets)
                if not len(s.at):
                    continue
                at = s.at[in_bloom(s.key, shared.value)]
                if len(at):
                    row, hashes = s.row[at], runs(s.words.hash, WINDOW)[at]
                    once = np.unique(mix(hashes ^ mix(row.astype(np.uint64))), return_index=True)[1]  # strip() finds the others
                    at, row, hashes = at[once], row[once], hashes[once]
                    yield pa.record_batch({"hash": hashes.view(np.int64), "doc_id": ids[row + lo], "at": (s.words.marks[row] << 32) | (at - s.words.first[row])})

    return docs.mapInArrow(work, "hash long, doc_id long, at long")


def strip(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, copy (of a whole text before it), at (a list of windows seen before, or null). Returns doc_id, n_words, n_removed, kept_text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, valid = known_ids(b)
            skip = np.asarray(b.column(b.schema.get_field_index("copy")))
            seen = b.column(b.schema.get_field_index("at"))
            for lo, hi, buf, offsets in slices(b):
                w = Words(buf, offsets, _TEXT)
                removed, kept = [], []
                for i in range(hi - lo):
                    n, first = int(w.count[i]), int(w.first[i])
                    gone = np.zeros(n + 1, np.int64)
                    if skip[lo + i] and n >= WINDOW:
                        gone[0] = 1
                    elif seen[lo + i].is_valid:
                        at = seen[lo + i].values.to_numpy()
                        at = at[(at >> 32) == w.marks[i]] & 0xFFFFFFFF
                        if len(at):
                            own = runs(w.hash[first : first + n], WINDOW)
                            at = np.flatnonzero(np.isin(own, own[at]))
                        gone[at] += 1
                        ends, counts = np.unique(np.minimum(at + WINDOW, n), return_counts=True)
                        gone[ends] -= counts
                    stay = np.flatnonzero(np.cumsum(gone)[:n] == 0) + first
                    removed.append(n - len(stay))
                    kept.append(b" ".join(buf[s:e].tobytes() for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)).decode("utf-8", "replace"))
                yield pa.record_batch({"doc_id": pa.array(ids[lo:hi], pa.int64(), mask=~valid[lo:hi]), "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return docs.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_text string")


class FingerprintIndex:
    """The runs under one folder of the shared store. A run's name holds the batches it covers; a run without _SUCCESS, or one
    that a wider run covers, does not count, so a batch or a compaction that breaks off leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str, max_runs: int = 4):
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def spans(self) -> list[tuple[int, int]]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(s.getPath(), "_SUCCESS"))]
        spans = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-")]
        return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))

    def run(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema("key long, first_id long").parquet(f"{self.path}/run-{span[0]}-{span[1]}")

    def _write(self, df: DataFrame, span: tuple[int, int]) -> None:
        df.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/run-{span[0]}-{span[1]}")

    def history(self) -> DataFrame | None:
        found = [self.run(s) for s in self.spans()]
        out = found[0] if found else None
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def append(self, keys: DataFrame) -> None:
        """keys: key, first_id with one row a key."""
        n = max((b for _, b in self.spans()), default=-1) + 1
        self._write(keys, (n, n))
        if len(self.spans()) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        spans = self.spans()
        if len(spans) < 2:
            return
        self._write(self.history().groupBy("key").agg(F.min("first_id").alias("first_id")), (spans[0][0], spans[-1][1]))
        fs, path = self._fs()
        for a, b in spans:
            fs.delete(path(f"{self.path}/run-{a}-{b}"), True)

    def texts(self) -> DataFrame | None:
        """(doc_id, a, b): two hashes of each text that was taken in."""
        return self.spark.read.schema("doc_id long, a long, b long").parquet(f"{self.path}/texts-*") if self.spans() else None

    def dedup(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Judge a batch against what the index holds and against itself, then take it in. Ids of later batches are larger.

        history: the documents of earlier batches, whose windows are the proof where an anchor of theirs is met; an index that
        has taken some in can't judge without them. Returns doc_id, n_words, n_removed, kept_text."""
        spark = self.spark
        small_batches(spark)
        if history is None and self.spans():
            raise ValueError("the index has earlier batches: give their documents as history")
        docs = keyed_texts(docs, id_col, text_col)
        marks = docs.where("doc_id is not null and length(text) > 0").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
        marks = materialize(marks, "op6-marks")
        before = self.texts()
        every = marks if before is None else marks.unionByName(before)
        groups = every.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        again = marks.join(groups, ["a", "b"]).where("doc_id > least").select("doc_id")
        # an id that stands on several rows is left to the windows: its rows may differ
        twice = marks.groupBy("doc_id").count().where("count > 1").select("doc_id")
        again = materialize(again.join(twice, "doc_id", "left_anti").distinct(), "op6-copies")
        # only texts that may be copies are shuffled to find out
        may = Bitmap(again, "doc_id", bits=64).has("doc_id")
        copies = docs.where(may).join(again, "doc_id", "left_semi")
        rest = docs.where(~may).unionByName(docs.where(may).join(again, "doc_id", "left_anti"))
        known = rest.where("doc_id is not null")
        keys = materialize(anchors(known).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).sortWithinPartitions("key"), "op6-keys")
        settle(spark)
        shared = keys.where("first_id < last_id").select("key")
        if (runs_before := self.history()) is not None:
            shared = shared.union(keys.join(runs_before.hint("merge"), "key", "left_semi").select("key"))
        shared = materialize(shared.distinct(), "op6-shared")
        n_shared = shared.count()
        none = F.lit(None).cast("array<long>").alias("at")
        if n_shared:
            bits = spark.sparkContext.broadcast(bloom(shared, n_shared))
            new = windows(known, bits)
            found = new.select("hash", "doc_id")
            if history is not None:
                found = found.unionByName(windows(keyed_texts(history, id_col, text_col).where("doc_id is not null"), bits).select("hash", "doc_id"))
            first = found.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "least")
            seen = new.join(first, "hash").where("doc_id > least").groupBy("doc_id").agg(F.collect_list("at").alias("at"))
            seen = materialize(seen, "op6-seen")
            met = Bitmap(seen, "doc_id").has("doc_id")
            rest = rest.where(~met).select("*", none).unionByName(rest.where(met).join(seen, "doc_id", "left"))
        else:
            rest = rest.select("*", none)
        out = strip(rest.select("doc_id", "text", F.lit(False).alias("copy"), "at").unionByName(copies.select("doc_id", "text", F.lit(True).alias("copy"), none)))
        marks.write.mode("overwrite").parquet(f"{self.path}/texts-{max((b for _, b in self.spans()), default=-1) + 1}")
        self.append(keys.select("key", "first_id"))
        drop(marks, keys, shared)
        return out


def substring_dedup(docs: DataFrame, path: str | None = None, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A whole table, in batches of ascending ids through one index, which is fresh if no path is given."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, path or new_path(spark, "op6-index"), max_runs=1)
    docs = keyed_texts(docs, id_col, text_col)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    out = None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        earlier = None if lo is None else docs.where(F.col("doc_id") <= lo)
        own = F.lit(True) if lo is None else F.col("doc_id") > lo
        own &= F.lit(True) if hi is None else F.col("doc_id") <= hi
        found = index.dedup(docs.where(own | F.col("doc_id").isNull() if lo is None else own), earlier)
        out = found if out is None else out.unionByName(found)
    return out


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op6_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, p, list_slice(w, p, p + 12) AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13)),
first AS (SELECT key, min(doc_id) AS least FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN first USING (key) WHERE least < doc_id),
gone_list AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone_list USING (doc_id)
"""
}
