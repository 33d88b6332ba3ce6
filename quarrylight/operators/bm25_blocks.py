"""Postings in blocks: the documents of one term among some neighbouring documents are one row.

A block is made where its texts are, by sorting its tokens' numbers, so what is dealt by term later are a block's distinct terms and
not each document's. Its size is bounded in bytes and documents, and so are the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spelled
from ..sources.tables import materialize
from .bm25 import DOCUMENT, term_counts

BLOCK_BYTES, BLOCK_DOCUMENTS = 8 << 20, 10_000
_KEPT = np.zeros(256, bool)
_KEPT[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def posting_blocks(docs: DataFrame, id_col: str, text: Column, distinct: bool = False) -> DataFrame:
    """(term, block, n, docs: id, tf, dl) of every term of the documents, and rows of DOCUMENT with all of a block. Where ids are not
    known to be distinct, rows of one id and length are one document, as term_counts has it."""
    of_id = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"term string, block long, n long, docs array<struct<id:{of_id},tf:bigint,dl:bigint>>"
    made = lambda rows: rows.select(F.col(id_col).alias("id"), spelled(text).alias("text")).mapInArrow(_blocks, schema)
    if distinct:
        return made(docs)
    key = F.col(id_col)
    again = materialize(docs.groupBy(key.alias("_again")).count().where("count > 1").select("_again"), "ids-again")
    if again.isEmpty():
        return made(docs)
    same = key == F.col("_again")
    return made(docs.join(again, same, "left_anti")).unionByName(blocks_of_postings(term_counts(docs.join(again, same, "left_semi"), id_col, text)))


def blocks_of_postings(postings: DataFrame, block: str | None = None) -> DataFrame:
    """Postings (term, id, tf, dl) as blocks: those of a named block together, else each alone."""
    doc = F.struct("id", "tf", "dl")
    if block is None:
        return postings.select("term", F.xxhash64("id").alias("block"), F.lit(1).cast("long").alias("n"), F.array(doc).alias("docs"))
    return postings.groupBy("term", F.col(block).alias("block")).agg(F.count("*").alias("n"), F.collect_list(doc).alias("docs"))


def blocks_of(blocks: DataFrame, *more: str) -> DataFrame:
    """The postings of blocks with their run: (term, run, more, id, tf, dl)."""
    return blocks.select("term", "run", *more, F.inline("docs"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, rows = [], 0, 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):  # no more than a block at once, but for one text that is longer
            to = int(np.searchsorted(ends, ends[at] + BLOCK_BYTES - size, "right")) - 1
            to = min(to, at + BLOCK_DOCUMENTS - rows, len(texts))
            if to > at or not held:
                to = max(to, at + 1)
                held.append((batch.column(0).slice(at, to - at), texts.slice(at, to - at)))
                size, rows, at = size + int(ends[to] - ends[at]), rows + to - at, to
            if at < len(texts):
                yield _block(held)
                held, size, rows = [], 0, 0
    if held:
        yield _block(held)


def _block(held: list[tuple[pa.Array, pa.Array]]) -> pa.RecordBatch:
    ids, texts = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    n = len(ids)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _KEPT[buf]
    edge = np.zeros(len(buf) + 1, bool)  # between texts
    edge[offsets] = True
    dots = np.flatnonzero(buf == 0x2E)
    dots = dots[~edge[dots] & ~edge[dots + 1]]
    inside[dots[inside[dots - 1] & inside[dots + 1]]] = True  # the new ones are no neighbours of dots that count: two dots part
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - start, out=bounds[1:])
    tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(_LOWER[buf[inside]])).dictionary_encode()
    dl = np.diff(np.searchsorted(start, offsets))
    keys, tf = np.unique(tokens.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
    terms = len(tokens.dictionary)
    docs = np.concatenate([keys % n, np.arange(n)])
    lists = np.append(np.searchsorted(keys, np.arange(terms + 1) * n), len(docs)).astype(np.int32)
    struct = pa.StructArray.from_arrays([ids.take(pa.array(docs)), pa.array(np.concatenate([tf, np.ones(n, np.int64)])), pa.array(dl[docs])], ["id", "tf", "dl"])
    names = pa.concat_arrays([tokens.dictionary.cast(pa.string()), pa.array([DOCUMENT])])
    block = np.full(terms + 1, crc32(str(ids[0].as_py()).encode()), np.int64)
    return pa.record_batch({"term": names, "block": block, "n": np.diff(lists).astype(np.int64), "docs": pa.ListArray.from_arrays(pa.array(lists), struct)})
