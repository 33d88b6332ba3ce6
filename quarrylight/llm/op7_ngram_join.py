"""N-gram Jaccard join by partitioning the universe of shingles.

A document is the set of its distinct shingles, as 64-bit hashes. Sizes fall into bands; sets that can reach the
similarity are in one band or in neighbours, and a pair whose smaller set is in a band differs by at most H shingles.
Under a band's scheme the universe of hashes is cut into m ranges. A segment is the part of a set in one range; if the
first x segments may differ by one shingle and the others by none, every pair that counts agrees in some segment as soon
as 2x + (m - x) > H. Segments give one signature, those that may differ one more for each shingle taken out. For each band
x is chosen by cost: rows of signatures against pairs that share a segment by chance, which the band's number of sets and
the chance of an empty segment give.

Equal sets are one class first. Signatures that classes share are found by minima alone, then each class that has one is
read again with its set. Classes are held against the least class of the bucket with which they share most, exactly;
what that links becomes components, and pairs of one bucket that are still in two components are compared in tiles of
bounded size: by sizes, by a lower bound on the difference from parity sketches, and exactly. A tile passes on the
nearest pairs of each two components, more in each round, until none was held back: no link is lost, and two groups that
a pair joins are compared no further.

Defined cases: null texts and texts without words have empty sets and link with nothing; a text with fewer words than a
shingle is one shingle of all its words; rows that share an id are one document; rows with a null id link with nothing
and have no component; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, Words, bloom, documents, ids_of, in_bloom, keyed_texts, known_ids, list_array, materialize, mix, runs, settle, slices, small_batches, sorted_groups, spaced
from .components import connected_components

_TEXT = spaced(lower=True)
TILE, NEAREST = 192, 16
_A, _B, _SEG = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    w = Words(buf, offsets, _TEXT)
    grams, out = runs(w.hash, size), []
    for first, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
        out.append(np.unique(grams[first : first + n - size + 1]) if n >= size else runs(w.hash[first : first + n], n) if n else np.empty(0, np.uint64))
    return out


def _set_hash(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(s ^ _A).sum(), mix(s + _B).sum()


class Bands:
    """Bands of sizes for a similarity of num/den or more: band k holds sizes low[k] to high[k]."""

    def __init__(self, num: int, den: int, largest: int):
        self.num, self.den = num, den
        low, high, at = [], [], 1
        while at <= largest:
            low.append(at)
            high.append(at * den // num)
            at = high[-1] + 1
        self.low, self.high = np.array(low or [1]), np.array(high or [1])

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def differ(self, k: int) -> int:
        """The most shingles by which a set of band k and one as large or larger differ if they are similar enough."""
        return int(self.high[k]) * (self.den - self.num) // self.num

    def allocate(self, k: int, n_sets: int) -> tuple[int, int, int]:
        """(segments, those of them that may differ by one shingle, slack) of least cost.

        Slack is by how many more segments agree than one. A pair whose sets agree in more segments than one of them has
        empty ones agrees in one that isn't empty, so only sets with as many empty segments as the slack need give them
        signatures; without the segments that may differ the slack is set so that about one set in a hundred does."""
        h, size = self.differ(k), float(self.high[k])
        best = None
        for x in range((h + 2) // 2 + 1):
            m, spare = max(h + 1 - 2 * x, 0) + x, 1
            empty = (1 - 1 / m) ** size
            while x == 0 and m * empty + 2.33 * sqrt(m * empty) + 0.5 >= spare:
                m, spare = m + 1, spare + 1
                empty = (1 - 1 / m) ** size
                if spare > h + 1:  # sets too sparse for it
                    m, spare, empty = h + 1, 1, (1 - 1 / (h + 1)) ** size
                    break
            rows = n_sets * (m + x * size / m)
            cost = rows + 0.05 * m * (n_sets * empty * (0.01 if spare > 1 else 1)) ** 2 / 2
            if best is None or cost < best[0]:
                best = (cost, m, x, spare)
        return best[1:]


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) * den < num * len(b) or len(b) * den < num * len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _signatures(s: np.ndarray, sums: np.ndarray, k: int, m: int, x: int, slack: int) -> np.ndarray:
    """sums: running sums of the mixed shingles, from 0."""
    cuts = np.concatenate(([0], np.searchsorted(s, _cuts(m)), [len(s)]))
    whole = sums[cuts[1:]] - sums[cuts[:-1]]
    salt = mix(np.uint64(k << 32) + np.arange(m, dtype=np.uint64) + _SEG)
    out = mix(whole + salt)
    if x:
        upto = cuts[x]
        seg = np.repeat(np.arange(x), np.diff(cuts[: x + 1]))
        return np.concatenate((out, mix(whole[seg] - (sums[1 : upto + 1] - sums[:upto]) + salt[seg])))
    full = cuts[1:] > cuts[:-1]
    return out[full] if m - np.count_nonzero(full) < slack else out


_CUTS: dict[int, np.ndarray] = {}


def _cuts(m: int) -> np.ndarray:
    if m not in _CUTS:
        _CUTS[m] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
    return _CUTS[m]


def signatures_of(s: np.ndarray, bands: Bands, plan: dict[int, tuple[int, int, int]]) -> np.ndarray:
    """Under the scheme of the set's band and of the one below."""
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s ^ _A), out=sums[1:])
    k = bands.of(len(s))
    return np.unique(np.concatenate([_signatures(s, sums, j, *plan[j]) for j in (k - 1, k) if j in plan]))


def _sketch(s: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that fall on it: sketches differ in at most as many bits as sets in shingles.
    There are at least as many bits as shingles, a power of two; half as many are the two halves' difference."""
    bits = 512
    while bits < len(s):
        bits *= 2
    odd = np.bincount((mix(s + _SEG) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketches: pa.ListArray) -> np.ndarray:
    """Sketches of one tile, all as long as the shortest."""
    each = [np.asarray(x.values).view(np.uint64) for x in sketches]
    least = min(map(len, each))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in each])


class Join:
    """One similarity join; each method is a step of it and returns a table."""

    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int):
        small_batches(docs.sparkSession)
        self.docs, self.shingle, self.num, self.den = docs, shingle, num, den

    def sets(self) -> DataFrame:
        """(doc_id, n, a, b): size and 128-bit hash of each document's set."""
        shingle = self.shingle

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, valid = known_ids(batch)
                for lo, hi, buf, offsets in slices(batch):
                    found = shingle_sets(buf, offsets, shingle)
                    ab = np.array([_set_hash(s) for s in found], np.uint64).reshape(-1, 2).view(np.int64)
                    yield pa.record_batch({"doc_id": pa.array(ids[lo:hi], pa.int64(), mask=~valid[lo:hi]), "n": np.array([len(s) for s in found], np.int64), "a": ab[:, 0], "b": ab[:, 1]})

        return self.docs.mapInArrow(work, "doc_id long, n long, a long, b long")

    def signatures(self, docs: DataFrame, bands: Bands, plan: dict) -> DataFrame:
        """(sig, doc_id)."""
        shingle = self.shingle

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = ids_of(batch)
                for lo, _, buf, offsets in slices(batch):
                    sigs = [signatures_of(s, bands, plan) if len(s) else np.empty(0, np.uint64) for s in shingle_sets(buf, offsets, shingle)]
                    each = np.concatenate(sigs)
                    if len(each):
                        yield pa.record_batch({"sig": each.view(np.int64), "doc_id": np.repeat(ids[lo : lo + len(sigs)], [len(x) for x in sigs])})

        return docs.mapInArrow(work, "sig long, doc_id long")

    def sharers(self, docs: DataFrame, bands: Bands, plan: dict, shared) -> DataFrame:
        """(doc_id, sigs, grams, sketch) of the documents with a signature that passes the filter."""
        shingle = self.shingle

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = ids_of(batch)
                for lo, _, buf, offsets in slices(batch):
                    out = []
                    for i, s in enumerate(shingle_sets(buf, offsets, shingle)):
                        if len(s):
                            sigs = signatures_of(s, bands, plan)
                            sigs = sigs[in_bloom(sigs, shared.value)]
                            if len(sigs):
                                out.append((ids[lo + i], sigs.view(np.int64), s.view(np.int64), _sketch(s)))
                    if out:
                        lists = [list_array(np.concatenate([x[j] for x in out]), np.array([len(x[j]) for x in out])) for j in (1, 2, 3)]
                        yield pa.record_batch({"doc_id": np.array([x[0] for x in out], np.int64), "sigs": lists[0], "grams": lists[1], "sketch": lists[2]})

        return docs.mapInArrow(work, "doc_id long, sigs array<long>, grams array<long>, sketch array<long>")

    def verified(self, pairs: DataFrame, sharers: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose sets are similar enough."""
        num, den = self.num, self.den

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("ga", "gb"))
                same = np.array([similar(x[i].values.to_numpy(), y[i].values.to_numpy(), num, den) for i in range(len(x))], bool)
                yield pa.record_batch({"a": ids_of(batch, "a")[same], "b": ids_of(batch, "b")[same]})

        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "op7-ends")
        grams = sharers.where(Bitmap(ends, "doc_id").has("doc_id")).select("doc_id", "grams")  # sets of others needn't be shuffled
        both = pairs.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
        return both.select("a", "b", "ga", "gb").mapInArrow(work, "a long, b long")

    def left_over(self, members: DataFrame, components: DataFrame, sharers: DataFrame, nearest: int) -> DataFrame:
        """(c, d, a, b, more): pairs of one bucket but two components that sizes and sketches let through, of each two
        components in a tile the nearest; more says that the tile has further ones."""
        num, den = self.num, self.den
        labelled = members.join(components, members.doc_id == components.node, "left").select("sig", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        mixed = labelled.groupBy("sig").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("k")).where("least < most").select("sig", F.ceil(F.col("k") / TILE).alias("blocks"))
        rows = labelled.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
        tiles = rows.select("sig", "doc_id", "c", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        tiles = tiles.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "c")
        tiles = tiles.join(sharers.select("doc_id", F.size("grams").alias("n"), "sketch"), "doc_id")

        def near(t: pa.Table) -> list[tuple]:
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            block, doc, c, n = (t.column(x).to_numpy() for x in ("block", "doc_id", "c", "n"))
            sketch = _folded(t.column("sketch").combine_chunks())
            right, found = np.flatnonzero(block == j), {}
            for r in np.flatnonzero(block == i):
                at = right[(c[right] != c[r]) & (n[right] * den >= num * n[r]) & (n[r] * den >= num * n[right])]
                if len(at):
                    far = np.bitwise_count(sketch[at] ^ sketch[r]).sum(1)
                    for q, f in zip(at.tolist(), far.tolist(), strict=True):
                        if f * (den + num) <= (den - num) * (n[r] + n[q]):
                            found.setdefault((min(c[r], c[q]), max(c[r], c[q])), set()).add((f, min(doc[r], doc[q]), max(doc[r], doc[q])))
            return [(x, y, a, b, len(pairs) > nearest) for (x, y), pairs in found.items() for _, a, b in sorted(pairs)[:nearest]]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in sorted_groups(batches, ["sig", "i", "j"]):
                if out := near(t):
                    c, d, a, b, more = zip(*out, strict=True)
                    yield pa.record_batch({"c": np.array(c, np.int64), "d": np.array(d, np.int64), "a": np.array(a, np.int64), "b": np.array(b, np.int64), "more": np.array(more)})

        dealt = tiles.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").select("sig", "i", "j", "block", "doc_id", "c", F.col("n").cast("long").alias("n"), "sketch")
        return dealt.mapInArrow(work, "c long, d long, a long, b long, more boolean")


def ngram_join(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id. Documents link at a Jaccard similarity of num / den or more."""
    spark = docs.sparkSession
    join = Join(keyed_texts(docs, id_col, text_col), shingle, num, den)
    sets = materialize(join.sets(), "op7-sets")
    known = sets.where("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")), "op7-classes")
    again = materialize(known.join(classes, ["a", "b", "n"]).where("doc_id > rep").select("doc_id", "rep"), "op7-copies")
    # an id on several rows keeps its signatures, since its rows may differ; copies that the bitmap lets through only cost time
    several = materialize(known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "op7-several")
    some = join.docs.where(Bitmap(classes.select(F.col("rep").alias("doc_id")).unionByName(several), "doc_id", bits=64).has("doc_id") & F.col("doc_id").isNotNull())
    bands = Bands(num, den, known.agg(F.max("n")).first()[0] or 1)
    low = F.array(*[F.lit(int(x)) for x in bands.low])
    per = {r["k"]: r["c"] for r in classes.select((F.size(F.filter(low, lambda x: x <= F.col("n"))) - 1).alias("k")).groupBy("k").agg(F.count("*").alias("c")).collect()}
    plan = {k: bands.allocate(k, per.get(k, 0) + per.get(k + 1, 0)) for k in {*per, *(k - 1 for k in per)} if k >= 0}
    buckets = materialize(join.signatures(some, bands, plan).groupBy("sig").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("sig", "hub"), "op7-buckets")
    links = again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(several, F.col("a") == F.col("doc_id"), "left_semi")
    if n_shared := buckets.count():
        shared = spark.sparkContext.broadcast(bloom(buckets.select(F.col("sig").alias("key")), n_shared))
        sharers = materialize(join.sharers(some, bands, plan, shared), "op7-sharers")
        settle(spark)
        members = materialize(sharers.select("doc_id", F.explode("sigs").alias("sig")).join(buckets, "sig"), "op7-members")
        votes = members.where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("k"))
        stars = votes.groupBy("doc_id").agg(F.max(F.struct("k", (-F.col("hub")).alias("h"))).alias("x")).select((-F.col("x.h")).alias("a"), F.col("doc_id").alias("b"))
        pairs = materialize(stars, "op7-stars")
        tried, nearest, more = None, NEAREST, True
        while True:
            links = materialize(links.unionByName(join.verified(pairs, sharers)), "op7-links")
            components = materialize(connected_components(links, "op7"), "op7-components")
            settle(spark)
            if not more:  # all that was left has been held against each other
                break
            tried = pairs if tried is None else tried.unionByName(pairs)
            near = materialize(join.left_over(members, components, sharers, nearest), "op7-near")
            more = bool(near.agg(F.max("more")).first()[0])
            pairs = materialize(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "op7-pairs")
            nearest *= 8
    else:
        components = materialize(connected_components(links, "op7"), "op7-components")
    of = classes.join(components, F.col("rep") == F.col("node"), "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component_id"))
    out = known.join(of, ["a", "b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), shingle=3, num=9, den=10)


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"


def components_sql(docs: str, shingle: int, num: int, den: int) -> str:
    """The CTEs up to comp(doc_id, n_shingles, component_id) over a table or CTE of documents."""
    return rf"""
 sw AS (SELECT doc_id, {_WORDS} AS w FROM {docs}),
 sg AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + least(len(w), {shingle}) - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS p FROM sw WHERE len(w) > 0)),
 sn AS (SELECT doc_id, count(*) AS n FROM sg GROUP BY doc_id),
 si AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sg x JOIN sg y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
 sl AS (SELECT a, b FROM si JOIN sn x ON x.doc_id = a JOIN sn y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n + y.n - k)),
 reach(a, b) AS (SELECT a, b FROM sl UNION SELECT r.a, l.b FROM reach r JOIN sl l ON r.b = l.a),
 comp AS (
  SELECT sw.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(sw.doc_id, coalesce(min(reach.b), sw.doc_id)) AS component_id
  FROM sw LEFT JOIN sn USING (doc_id) LEFT JOIN reach ON reach.a = sw.doc_id GROUP BY sw.doc_id)"""


SQL = {"op7_ngram_join": f"WITH RECURSIVE {components_sql('documents', 3, 9, 10)} SELECT doc_id, n_shingles, component_id FROM comp"}
