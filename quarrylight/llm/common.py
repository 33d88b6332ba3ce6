"""Shared pieces: the shared folder, materialised tables, documents in, and vectorised word hashing.

Hashes here are 64 bits wide and computed with wrapping uint64 arithmetic, a whole slice of documents at a time:
a polynomial over randomised byte values gives every word its hash from one prefix sum, and the same trick over
word hashes gives every run of words its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import delete, drop, made_in, materialize, new_path, settle  # noqa: F401  operators take them from here

#: Records that cross to Python at once; a slice of SLICE_BYTES of them is worked on at a time.
BATCH_ROWS = 512
SLICE_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: rows here are whole documents."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names that other columns can't clash with."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(v).alias(k) for k, v in more.items()))


def fresh(docs: DataFrame, name: str) -> str:
    """name, or with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_sample(texts: DataFrame, n: int, most_chars: int = 20_000) -> DataFrame:
    """About n of the texts of 1 to most_chars characters, those whose hash is least. Only hashes are gathered to find the
    limit; texts that are equal come together."""
    fit = texts.select("text", F.xxhash64("text").alias("h")).where(f"length(text) between 1 and {most_chars}")
    limit = fit.select("h").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return fit.where(F.col("h") <= F.lit(limit).cast("long")).select("text").distinct()


# --- bitmaps as subqueries, in DataFrame operations ----------------------------------------------------------------------

BITS_LEAST, BITS_MOST = 1 << 20, 1 << 27


class Bitmap:
    """Which keys may be in a table: each sets one of some bits a key, up to 2^27 (16 MB) and beyond that fewer a key, so that
    it lets more through, never less. It is a scalar subquery: plans only name it, and executors get it once."""

    def __init__(self, keys: DataFrame, *columns: str, bits: int = 8):
        self.size = BITS_LEAST
        while self.size < min(bits * keys.count(), BITS_MOST):
            self.size *= 2
        at = F.xxhash64(*columns).bitwiseAND(self.size - 1)
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("v"))
        every = keys.sparkSession.range(self.size // 64).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
        parts = every.groupBy(F.floor(F.col("w") / 1024).alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("x"))
        whole = parts.groupBy().agg(F.sort_array(F.collect_list(F.struct("b", F.transform("x", lambda x: x["v"]).alias("x")))).alias("p"))
        self.table = materialize(whole.select(F.flatten(F.transform("p", lambda p: p["x"])).alias("t")), "bits")

    def has(self, *key: Column | str) -> Column:
        at = F.xxhash64(*key).bitwiseAND(self.size - 1)
        return F.getbit(F.get(self.table.scalar(), F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1


# --- words -----------------------------------------------------------------------------------------------------------

_ODD = np.uint64(1)


def _odd(x: int) -> int:
    return (x | 1) & 0xFFFFFFFFFFFFFFFF


class Alphabet:
    """Which bytes belong to words, what each counts as, and two independent hashes of words."""

    def __init__(self, word_byte: np.ndarray, lower: bool, seed: int):
        rng = np.random.default_rng(seed)
        self.word_byte = word_byte
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _ODD
        if lower:
            self.value[65:91] = self.value[97:123]
        self.base = _odd(int(rng.integers(1, 2**62)) * 2)
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        self.up = powers(self.base, n)
        self.down = powers(pow(self.base, -1, 1 << 64), n)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self._powers(max(n, 2 * len(self.up)))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spaced(lower: bool) -> Alphabet:
    """Words are runs of anything but space, tab, newline, VT, FF and CR."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return Alphabet(word, lower, 7)


def alphanumeric() -> Alphabet:
    """Words are runs of ASCII letters and digits and of anything outside ASCII, A-Z as a-z."""
    word = np.zeros(256, bool)
    word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return Alphabet(word, True, 11)


class Words:
    """The words of a slice of documents: start and end byte, hash, for each document its range of words, and a mark of 31
    bits of its text that tells apart rows that share an id."""

    __slots__ = ("buf", "start", "end", "hash", "first", "count", "marks")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, alphabet: Alphabet):
        self.buf = buf
        n = len(buf)
        inside = alphabet.word_byte[buf]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edge] = inside[edge]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        alphabet.reach(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(alphabet.value[buf] * alphabet.up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * alphabet.down[self.start])
        sums = (total[offsets[1:]] - total[offsets[:-1]]) * alphabet.down[offsets[:-1]]
        self.marks = (mix(sums + np.diff(offsets).astype(np.uint64)) >> np.uint64(33)).astype(np.int64)
        bounds = np.searchsorted(self.start, offsets)
        self.first = bounds[:-1]
        self.count = np.diff(bounds)


_CHAIN = _odd(0x9E3779B97F4A7C15)
_UP, _DOWN = powers(_CHAIN, 1 << 14), powers(pow(_CHAIN, -1, 1 << 64), 1 << 14)


def runs(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of every run of n consecutive word hashes; run i starts at word i (document ends are the caller's)."""
    global _UP, _DOWN
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    if len(_UP) < len(hashes) + 1:
        _UP, _DOWN = powers(_CHAIN, 2 * len(hashes)), powers(pow(_CHAIN, -1, 1 << 64), 2 * len(hashes))
    h = mix(hashes + np.uint64(salt)) if salt else hashes
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * _UP[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * _DOWN[: len(h) - n + 1])


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about `size` bytes of text: first row, end row, bytes, offsets of rows in them. Null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    bounds = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))


def known_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index("doc_id"))
    return np.asarray(col.fill_null(-1)), np.asarray(col.is_valid())


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal integer keys of at least two rows, from rows that come sorted by them; one group is held at a time."""
    rest = None
    for batch in _then_none(batches):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not rest.num_rows:
            continue
        new = np.zeros(rest.num_rows - 1, bool)
        for k in keys:
            new |= np.diff(rest.column(k).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()] + ([rest.num_rows] if batch is None else [])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                yield rest.slice(lo, hi - lo)
        rest = rest.slice(cuts[-1])


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


# --- Bloom filters of bounded size -------------------------------------------------------------------------------------

BLOOM_BITS_LEAST, BLOOM_BITS_MOST, PIECE_BITS = 1 << 23, 1 << 28, 1 << 19


def _bits(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(np.uint64) ^ np.uint64(0x51ED270B35A1C9E7))
    return (h % np.uint64(n)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(n)).astype(np.int64)


def bloom(keys: DataFrame, n_keys: int) -> np.ndarray:
    """A Bloom filter of column key, built where the keys are and joined piece by piece; its size is bounded."""
    n = BLOOM_BITS_LEAST
    while n < min(32 * n_keys, BLOOM_BITS_MOST):
        n *= 2

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(n // 8, np.uint8)
        for b in batches:
            for at in _bits(ids_of(b, "key"), n):
                np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        packed = packed.reshape(-1, PIECE_BITS // 8)
        for i in np.flatnonzero(packed.any(1)):
            yield pa.record_batch({"piece": np.array([i]), "bits": pa.array([packed[i].tobytes()], pa.binary())})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(PIECE_BITS // 8, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(n // 8, np.uint8)
    spread = keys.select("key").mapInArrow(pieces, "piece long, bits binary")
    for r in spread.groupBy("piece").applyInArrow(merge, "piece long, bits binary").collect():  # n / PIECE_BITS rows at most
        out[r["piece"] * (PIECE_BITS // 8) : (r["piece"] + 1) * (PIECE_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bloom(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _bits(keys, len(bits) * 8):
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return found
