"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document.

FILTERS learned filters of WIDTH bytes slide over every byte. As a byte is one of 256 symbols, a filter is WIDTH tables
of 256 weights, and its output a sum of table entries. Outputs are max-pooled over pieces of PIECE bytes; a chunk is two
neighbouring pieces, so each chunk overlaps the next by half and the last bytes are in one as the first are. A second,
fixed bank compares each byte with the one p before it (p up to LAGS) and keeps the highest share of equal bytes of a
piece: text that repeats itself shows there whatever its words are. Chunk features, rectified, are averaged and maximised
over the document and weighed into one probability. Filters, biases and weights are trained together by back-propagation
through the pools (Adam, cross-entropy, classes weighed equally and then shifted back to their shares).

Training rows: at most SAMPLE labelled documents of each class outside the held-out fold, chosen by a hash of their id,
each whole; the model is a few tables of fixed size and travels to the workers by broadcast.

Defined cases: null and empty texts are one zero byte and have that byte's score; rows with a null id are scored and not
held out; labels, lang, source and ids are no inputs; repeated rows score alike; without a label of either class every
score is the share of label 1 among the labels (1 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed_texts, known_ids, read_table, slices, small_batches

WIDTH, FILTERS, PIECE, LAGS = 6, 12, 512, 24
SAMPLE, EPOCHS, RATE, BATCH, SEED = 1200, 14, 0.02, 32, 5
CUT, FOLDS, FOLD = 0.7, 4, 2
#: Bytes that are convolved at a time.
SCORED = 1 << 18


class Pieces:
    """Bytes of some documents, each followed by zeros, with the starts of their pieces."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        room = np.maximum(sizes, 1)
        first = np.concatenate(([0], np.cumsum(room + WIDTH)))[:-1]
        self.bytes = np.zeros(int((room + WIDTH).sum()), np.uint8)
        self.bytes[np.arange(len(buf)) + np.repeat(first - offsets[:-1], sizes)] = buf
        self.count = -(-room // PIECE)
        self.doc = np.repeat(np.arange(len(sizes)), self.count)
        at = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.start = first[self.doc] + at * PIECE
        self.size = np.minimum(PIECE, room[self.doc] - at * PIECE)


def _convolve(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    n = len(x) - WIDTH + 1
    out = tables[0].take(x[:n], axis=0)
    for j in range(1, WIDTH):
        out += tables[j].take(x[j : j + n], axis=0)
    return out


def _repeats(p: Pieces) -> np.ndarray:
    """For each piece the highest share of bytes that equal the byte some lag before."""
    x, n = p.bytes, len(p.doc)
    bounds = np.stack((p.start, p.start + p.size), 1).ravel()
    best = np.zeros(n, np.float32)
    for lag in range(2, LAGS + 1):
        same = np.zeros(len(x) + 1, np.uint8)
        same[lag:-1] = x[lag:] == x[:-lag]
        best = np.maximum(best, np.add.reduceat(same, bounds, dtype=np.int32)[::2] / p.size)
    return best[:, None].astype(np.float32)


def _pool(p: Pieces, out: np.ndarray) -> np.ndarray:
    bounds = np.stack((p.start, p.start + p.size), 1).ravel()
    bounds[-1] = min(bounds[-1], len(out) - 1)
    return np.maximum.reduceat(out, bounds, axis=0)[::2]


def _chunks(p: Pieces, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the larger of it and the next of its document, and which that is."""
    after = np.arange(len(v)) + 1
    ends = np.cumsum(p.count) - 1
    after[ends] = ends
    ends = ends[p.count > 1]
    later = v[after] > v
    return np.where(later, v[after], v), later


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = FILTERS + 1
        self.p = {"tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(n, np.float32), "w": rng.normal(0, 0.3, 2 * n).astype(np.float32), "b": np.zeros(1, np.float32)}
        self.shift = 0.0

    def _features(self, p: Pieces, pooled: np.ndarray) -> tuple:
        v, later = _chunks(p, pooled)
        h = np.maximum(v + self.p["bias"], 0)
        firsts = np.cumsum(p.count) - p.count
        mean = np.add.reduceat(h, firsts, axis=0) / p.count[:, None]
        top = np.maximum.reduceat(h, firsts, axis=0)
        return h, later, mean, top, np.hstack((mean, top)) @ self.p["w"] + self.p["b"][0]

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p = Pieces(buf, offsets)
        pooled = np.hstack((_pool(p, _convolve(p.bytes, self.p["tables"])), _repeats(p)))
        return 1 / (1 + np.exp(-(self._features(p, pooled)[-1].astype(np.float64) + self.shift)))

    def gradient(self, p: Pieces, repeats: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        out = _convolve(p.bytes, self.p["tables"])
        pooled = np.hstack((_pool(p, out), repeats))
        h, later, mean, top, z = self._features(p, pooled)
        dz = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
        n = FILTERS + 1
        g = {"w": np.hstack((mean, top)).T @ dz, "b": np.array([dz.sum()], np.float32)}
        dh = (dz / p.count)[p.doc][:, None] * self.p["w"][:n]
        dh += np.where(h == top[p.doc], dz[p.doc][:, None] * self.p["w"][n:], 0)
        dh *= h > 0
        g["bias"] = dh.sum(0)
        pieces, filters = np.nonzero(dh[:, :FILTERS])
        of = pieces + later[pieces, filters]
        g["tables"] = np.zeros_like(self.p["tables"])
        grads = dh[pieces, filters]
        # the byte where each piece's maximum is
        code, where = np.unique(of * FILTERS + filters, return_inverse=True)
        at = np.empty(len(code), np.int64)
        for i, c in enumerate(code):
            k, f = divmod(int(c), FILTERS)
            at[i] = p.start[k] + int(out[p.start[k] : p.start[k] + p.size[k], f].argmax())
        for j in range(WIDTH):
            np.add.at(g["tables"][j], (p.bytes[at[where] + j], filters), grads)
        return g

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        share = y.mean()
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, ready = 0, {}
        total = epochs * -(-len(texts) // BATCH)
        mixed = np.random.default_rng(seed).permutation(len(texts))
        batches = [mixed[i : i + BATCH] for i in range(0, len(mixed), BATCH)]
        for _ in range(epochs):
            for i in rng.permutation(len(batches)):
                if i not in ready:
                    own = [texts[t] for t in batches[i]]
                    p = Pieces(np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in own]))).astype(np.int64))
                    ready[i] = p, _repeats(p)
                p, repeats = ready[i]
                g = self.gradient(p, repeats, y[batches[i]], weight[batches[i]])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.shift = float(np.log(share / (1 - share)))
        return self


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.share)


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int) -> tuple[list[bytes], np.ndarray]:
    """At most per_class labelled texts of each class outside the fold, by a hash of the id: the bounded training rows.
    Of several labels or texts of an id the least counts."""
    fit = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", folds, fold)).groupBy("doc_id").agg(F.min("y").alias("y"))
    some = None
    for y in (0, 1):
        part = fit.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    some = docs.sparkSession.createDataFrame(some.collect(), "doc_id long, y int")  # 2 * per_class rows at most
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = sorted(((r["doc_id"], r["text"].encode("utf-8", "replace"), r["y"]) for r in rows.toLocalIterator()), key=lambda r: r[0])
    return [r[1] for r in got], np.array([r[2] for r in got], np.float64)


def fit_quality(docs: DataFrame, labels: DataFrame):
    texts, y = labelled_sample(docs, labels, "quality", FOLDS, FOLD, SAMPLE)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 1.0)
    return Network().train(texts, y)


def score_texts(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, valid = known_ids(b)
            for lo, hi, buf, offsets in slices(b, size=SCORED):
                yield pa.record_batch({"doc_id": pa.array(ids[lo:hi], pa.int64(), mask=~valid[lo:hi]), "score": shared.value.score(buf, offsets)})

    return docs.mapInArrow(work, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    docs = keyed_texts(docs, id_col, text_col)
    out = score_texts(docs, fit_quality(docs, labels))
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text is predicted good; nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(keyed_texts(docs, id_col, text_col), labels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [shared.value.score(buf, offsets) >= CUT for _, _, buf, offsets in slices(b, text_col, SCORED)]
            if good:
                yield b.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(work, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
