"""Structure-aware chunks: one of each module and class, one or more of each function, with their context."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import format_import, line_slice, module_name
from ..schemas import CHUNK_COLUMNS, CONTEXT
from .parse import OPENING, heads, modules

MAX_LINES = 100
_METHODS = ("method", "async_method")


_PARTS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))


@F.arrow_udf(_PARTS)
def split_lines(start: pa.Array, end: pa.Array, stmt_ends: pa.Array, body: pa.Array, most: pa.Array) -> pa.Array:
    """Parts (start, end, text) of a function longer than `most` lines, cut after statements of its body; a statement is never cut.
    Without statements the parts are blocks of `most` lines. One pass over the statements and the lines of the body."""
    out = []
    for first, z, ends, text, n in zip(start.to_pylist(), end.to_pylist(), stmt_ends, body, most.to_pylist(), strict=True):
        spans, a, last, lines = [], first, first, text.as_py().split("\n")
        for e in ends.as_py():
            if e - a + 1 > n and last > a:
                spans.append((a, last))
                a = last + 1
            last = e
        if len(ends):
            spans.append((a, z))
        else:
            spans = [(s, min(s + n - 1, z)) for s in range(a, max(a, z) + 1, n)]
        out.append([{"start": s, "end": e, "text": "\n".join(lines[s - first : e - first + 1])} for s, e in spans])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))


def block_lines(start: Column, end: Column, most: int) -> Column:
    """Blocks (start, end) of `most` lines."""
    return F.transform(F.sequence(start, F.greatest(start, end), F.lit(most)), lambda s: F.struct(s.alias("start"), F.least(s + most - 1, end).alias("end")))


def _context(**fields: Column) -> Column:
    names = [f.split(":", 1) for f in CONTEXT[len("struct<") : -1].split(", ")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names]).cast(CONTEXT)


def build_chunks(parsed: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """parsed: what parse_files returns. One row a chunk, in the order of files and definitions by chunk_ord."""
    files = heads(parsed)
    if max_lines > OPENING:  # more lines than the first row of a file has
        files = files.drop("opening").join(modules(parsed).select("repository_id", "file", F.col("lines").alias("opening")), ["repository_id", "file"])
    imports = F.transform("imports", lambda i: format_import(i["module"], i["name"], i["alias"]))
    last = F.least(F.greatest(F.col("n_lines"), F.lit(1)), F.lit(max_lines))
    module = files.select(
        "repository_id", F.concat("file", F.lit("::module")).alias("chunk_id"), "file", F.concat("file", F.lit("::module")).alias("symbol_id"), module_name(F.col("file")).alias("symbol"),
        F.lit("module").alias("kind"), F.lit(1).alias("start_line"), last.alias("end_line"), line_slice(F.col("opening"), F.lit(1), last).alias("text"),
        _context(module=module_name(F.col("file")), docstring=F.col("module_docstring"), imports=imports, total_lines=F.col("n_lines")).alias("context"),
        F.array("file_ord", F.lit(-1), F.lit(0)).alias("chunk_ord"),
    )

    each = parsed.select("repository_id", "file_ord", F.inline("symbols"))  # what is around a definition came with it
    name = module_name(F.col("file"))
    classes = each.where("kind = 'class'").select(
        "repository_id", F.col("symbol_id").alias("chunk_id"), "file", "symbol_id", F.col("name").alias("symbol"), F.lit("class").alias("kind"), "start_line", "end_line", F.col("body").alias("text"),
        _context(module=name, signature=F.col("signature"), docstring=F.col("docstring"), methods=F.col("methods"), decorators=F.col("decorators"), relevant_imports=F.col("relevant")).alias("context"),
        F.array("file_ord", "sym_ord", F.lit(0)).alias("chunk_ord"),
    )

    long = F.col("end_line") - F.col("start_line") + 1 > max_lines
    calls = each.where("kind <> 'class'")
    short = calls.where(~long).select("*", F.lit(False).alias("is_split"), F.lit(1).alias("n_parts"), F.lit(0).alias("at"), F.struct(F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("body").alias("text")).alias("span"))
    split = calls.where(long).withColumn("parts", split_lines("start_line", "end_line", "stmt_ends", "body", F.lit(max_lines))).drop("body", "stmt_ends")
    split = split.select("*", F.lit(True).alias("is_split"), F.size("parts").alias("n_parts"), F.posexplode("parts").alias("at", "span")).drop("parts")
    part = F.when(F.col("is_split"), F.col("at") + 1)
    calls = short.drop("body", "stmt_ends").unionByName(split)
    functions = calls.select(
        "repository_id", F.when(F.col("is_split"), F.concat("symbol_id", F.lit("::part_"), (F.col("at") + 1).cast("string"))).otherwise(F.col("symbol_id")).alias("chunk_id"), "file", "symbol_id", F.col("name").alias("symbol"),
        F.when(F.col("kind").isin(*_METHODS), F.lit("method")).otherwise(F.lit("function")).alias("kind"), F.col("span.start").alias("start_line"), F.col("span.end").alias("end_line"),
        F.col("span.text").alias("text"),
        _context(module=name, containing_class=F.col("class_name"), signature=F.col("signature"), docstring=F.col("docstring"), decorators=F.col("decorators"), is_async=F.col("is_async"), relevant_imports=F.col("relevant"), part=part, total_parts=F.when(F.col("is_split"), F.col("n_parts")), is_split=F.when(F.col("is_split"), F.lit(True))).alias("context"),
        F.array("file_ord", "sym_ord", F.col("at")).alias("chunk_ord"),
    )
    return module.unionByName(classes).unionByName(functions).select(*CHUNK_COLUMNS)


def first_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id).orderBy("chunk_ord").limit(1)


def chunks_of_symbol(chunks: DataFrame, symbol_id: str) -> DataFrame:
    return chunks.where(F.col("symbol_id") == symbol_id).orderBy("chunk_ord")


def chunks_of_file(chunks: DataFrame, file: str) -> DataFrame:
    return chunks.where(F.col("file") == file).orderBy("chunk_ord")


def chunks_of_kind(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.where(F.col("kind") == kind).orderBy("chunk_ord")


def dedup_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
