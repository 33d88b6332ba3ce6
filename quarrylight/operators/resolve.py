"""Call sites to call edges: rules from the surest on, each over what the ones before it left open.

Rules of calls by name: 1 the caller itself; 2 a function or class of the file; 3 an import; 4 any of that name in the
repository; 9 none. Of calls of an attribute: 1 a method of the caller's class (self); 2 of the class that the receiver was
made from; 3 of a class of the file; 4 of an imported class; 5 the only method of that name; 6 those whose class an import
names; 7 all of that name; 9 none. Other calls: 9. Rule 2 and 6 compare classes as substrings of qualified names; strict
asks for a whole component.

What a file decides alone (1, 2, and 1 and 3 of attributes) comes with the parsed call. Imports are joins with tables of unique
keys. Only sites that are still open meet the candidates of their name, whose number is known before: candidates are dealt to blocks of BLOCK, and a site goes to as many blocks as there are, so
that no task has to take all candidates of a frequent name, and what is shuffled stays far below the edges that come of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDGE_COLUMNS
from ..sources.tables import materialize

_METHODS = ("method", "async_method")
_CALLABLES = ("function", "async_function", "class")
_SITE = ["repository_id", "file", "call_ord"]
_NONE = 9
#: Candidates of one name that meet its sites in one place.
BLOCK = 1000


def module_keys(files: DataFrame) -> DataFrame:
    """files: repository_id, file, file_ord. (repository_id, key, file) of each name that an import may call a file: its
    path, its dotted path, and every dotted ending of that. Whole names win, then the first file."""
    return best_keys(keys_of_files(files, "file_ord"))


def best_keys(keys: DataFrame) -> DataFrame:
    """keys: repository_id, key, partial, file, file_ord. Of equal whole names the last file stands, of endings the first."""
    whole = F.col("partial") == 0
    best = keys.groupBy("repository_id", "key").agg(F.max_by(F.when(whole, F.col("file")), F.when(whole, F.col("file_ord"))).alias("w"), F.min_by("file", "file_ord").alias("e"))
    return best.select("repository_id", "key", F.coalesce("w", "e").alias("file"))


def keys_of_files(files: DataFrame, *more: str) -> DataFrame:
    """(repository_id, file, more, key, partial) of every name that an import may call a file; partial: 1 for an ending."""
    dotted = F.translate(F.regexp_replace(F.translate("file", "\\", "/"), r"\.py$", ""), "/", ".")
    parts = F.split(dotted, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"), (i > 1).cast("int").alias("partial")))
    return files.select("repository_id", "file", *more, F.inline(F.concat(F.array(F.struct(F.col("file").alias("key"), F.lit(0).alias("partial"))), ends)))


def import_key() -> Column:
    """The name by which an import calls a file."""
    return F.when(F.coalesce("module", F.lit("")) != "", F.col("module")).otherwise(F.col("name"))


def local_name() -> Column:
    return F.coalesce(F.nullif("alias", F.lit("")), F.col("name"))


def imported_symbols(imports: DataFrame, keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repository_id, file, local, symbol columns): what a local name stands for. The first import of the name that leads
    somewhere decides; one of a module itself leads to no symbol and ends the search."""
    from_module = F.coalesce("module", F.lit("")) != ""
    each = imports.select("repository_id", "file", "imp_ord", local_name().alias("local"), F.col("name").alias("wanted"), from_module.alias("from_module"), import_key().alias("key"))
    each = each.join(keys.withColumnRenamed("file", "target"), ["repository_id", "key"])
    first = _first(symbols, ["repository_id", "file", "name"], ["sym_ord"])
    found = first.select("repository_id", F.col("file").alias("target"), F.col("name").alias("wanted"), F.col("symbol_id").alias("sym_id"), F.col("name").alias("sym_name"), F.col("kind").alias("sym_kind"), F.lit(True).alias("found"))
    each = each.join(found, ["repository_id", "target", "wanted"], "left").where(~F.col("from_module") | F.col("found"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("repository_id", "file", "local").orderBy("imp_ord"))).where("n = 1 and from_module")
    return first.select("repository_id", "file", "local", "sym_id", "sym_name", "sym_kind", F.col("target").alias("sym_file"))


def _first(rows: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    by = [F.col(c).desc() if last else F.col(c) for c in order]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_n = 1").drop("_n")


def _named(name: Column, strict: bool, part: Column) -> Column:
    return F.array_contains(F.split(name, r"\."), part) if strict else F.contains(name, part)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """The edges of all repositories, one row a callee; edge_ord orders them by file, call and candidate."""
    edges = resolve_sites(calls, symbols, imports, module_keys(files), strict)
    place = lambda f: F.coalesce(F.col(f"rank.{f}"), F.lit(0))
    order = F.array(F.col("file_ord"), F.col("call_ord"), place("file_ord"), place("sym_ord"))
    return edges.withColumn("edge_ord", order).select(*EDGE_COLUMNS, "rule")


def _expand(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """sites: repository_id, name, method, blocks. Each with every candidate, block by block."""
    each = sites.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.join(candidates, ["repository_id", "name", "method", "block"]).drop("block", "blocks")


def resolve_sites(calls: DataFrame, symbols: DataFrame, imports: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """The edges' columns but edge_ord, and file_ord, call_ord, rule and rank: the place of the callee among several, by file_ord (of
    any type that has an order) and sym_ord, else null. symbols may be those alone whose names the calls or their files' imports
    have; keys those that the imports have."""
    symbols = symbols.withColumn("rank", F.struct("file_ord", "sym_ord"))
    no_rank = F.lit(None).cast(dict(symbols.dtypes)["rank"])
    payload = [*_SITE, "file_ord", "caller", "line", "call_expr"]
    c = F.col

    def out(found: DataFrame, rule: Column, resolution: str, callee: Column, rank: Column = no_rank) -> DataFrame:
        return found.select(*payload, rule.cast("int").alias("rule"), callee.alias("callee"), F.lit(resolution).alias("resolution"), rank.alias("rank"))

    settled = (c("here_rule") == 1) | ((c("func_kind") == "name") & (c("here_rule") == 2))
    edges = [out(calls.where(settled), c("here_rule"), "exact", c("here"))]
    edges.append(out(calls.where("func_kind = 'other'"), F.lit(_NONE), "unresolved", c("raw")))
    open_ = calls.where(~F.coalesce(settled, F.lit(False)) & (c("func_kind") != "other")).select(*payload, "func_kind", "name", "receiver", "raw", "local_type", "here_rule", "here")

    # what an import says: of the name, or of the receiver and then its class's method
    open_ = open_.withColumn("local", F.when(c("func_kind") == "name", c("name")).otherwise(c("receiver")))
    open_ = open_.join(imported_symbols(imports, keys, symbols), ["repository_id", "file", "local"], "left")
    last = F.row_number().over(Window.partitionBy("repository_id", "file", "qualified_name").orderBy(c("rank").desc()))
    by_qname = symbols.withColumn("n", last).where("n = 1").select("repository_id", c("file").alias("sym_file"), c("qualified_name").alias("t_qname"), c("symbol_id").alias("there"))
    of_class = F.when((c("func_kind") == "attr") & (c("sym_kind") == "class"), F.concat_ws(".", "sym_name", "name"))
    nothing = F.concat(F.lit("::"), c("call_ord").cast("string"))  # no name; calls without one must not meet in one place
    open_ = open_.withColumns({"t_qname": F.coalesce(of_class, nothing), "sym_file": F.coalesce("sym_file", "file")}).join(by_qname, ["repository_id", "sym_file", "t_qname"], "left")

    # candidates by name, and how many there are
    by = ["repository_id", "name", "method"]
    named = symbols.where(c("kind").isin(*_CALLABLES, *_METHODS)).select("repository_id", "name", c("kind").isin(*_METHODS).alias("method"), c("symbol_id").alias("callee"), "qualified_name", "rank")
    blocks = (1 + F.floor(F.count("*").over(Window.partitionBy(*by)) / BLOCK)).cast("int")
    named = named.withColumn("blocks", blocks)
    candidates = named.withColumn("block", F.pmod(F.xxhash64("callee"), c("blocks")).cast("int")).drop("blocks")
    counts = named.groupBy(*by).agg(F.count("*").alias("k"), F.max("blocks").alias("blocks"), F.min("callee").alias("only"))
    open_ = open_.withColumn("method", c("func_kind") == "attr").join(counts, by, "left")
    by_name = F.when(c("sym_id").isNotNull(), 3).when(c("k").isNotNull(), 4)
    by_attr = F.when(c("here_rule") == 3, 3).when(c("there").isNotNull(), 4).when(c("k") == 1, 5).when(c("k") > 1, 6)
    open_ = open_.withColumn("rule", F.coalesce(F.when(c("func_kind") == "name", by_name).otherwise(by_attr), F.lit(_NONE)))
    open_ = open_.select(*payload, "func_kind", "method", "name", "raw", "local_type", "here", "sym_id", "there", "k", "blocks", "only", "rule")
    open_ = materialize(open_, "open-calls")
    is_typed = c("method") & c("local_type").isNotNull() & c("k").isNotNull()
    kinds = {(r["func_kind"], r["rule"], r["typed"]) for r in open_.select("func_kind", "rule", F.coalesce(is_typed, F.lit(False)).alias("typed")).distinct().collect()}  # a row a rule

    if any(typed for _, _, typed in kinds):  # the types of receivers meet the methods of a name once each
        asked = open_.where(is_typed).select(*by, "local_type", "blocks").distinct()
        fit = _expand(asked, candidates).where(_named(c("qualified_name"), strict, c("local_type")))
        fit = fit.groupBy(*by, "local_type").agg(F.min(F.struct("rank", "callee")).alias("t")).select(*by, "local_type", c("t.callee").alias("typed"))
        open_ = open_.join(fit, [*by, "local_type"], "left").withColumn("rule", F.when(c("typed").isNotNull(), 2).otherwise(c("rule")))
        edges.append(out(open_.where("typed is not null"), F.lit(2), "exact", c("typed")))
        open_ = open_.where("typed is null")
    one = F.when(c("func_kind") == "name", c("sym_id")).when(c("rule") == 3, c("here")).otherwise(c("there"))
    edges.append(out(open_.where("rule = 3 or (rule = 4 and method)"), c("rule"), "exact", one))
    edges.append(out(open_.where("rule = 5"), c("rule"), "probable", c("only")))
    edges.append(out(open_.where(f"rule = {_NONE}"), c("rule"), "unresolved", F.when(c("method"), c("raw")).otherwise(c("name"))))
    if ("name", 4, False) in kinds:
        edges.append(out(_expand(open_.where("rule = 4 and not method"), candidates), F.lit(4), "probable", c("callee"), c("rank")))
    if any(kind == "attr" and rule == 6 for kind, rule, _ in kinds):  # several methods: those that the file's imports fit, or all; once a file and name
        several = open_.where("rule = 6")
        of_file = ["repository_id", "file", "name", "method"]
        locals_ = imports.groupBy("repository_id", "file").agg(F.collect_set(local_name()).alias("locals"))
        pairs = _expand(several.select(*of_file, "blocks").distinct().join(locals_, ["repository_id", "file"], "left"), candidates)
        pairs = pairs.withColumn("fits", F.coalesce(F.exists("locals", lambda x: _named(c("qualified_name"), strict, x)), F.lit(False)).cast("int"))
        pairs = pairs.withColumn("any", F.max("fits").over(Window.partitionBy(*of_file))).where("fits = any").select(*of_file, "callee", "rank", "fits")
        edges.append(out(several.join(pairs, of_file), F.when(c("fits") == 1, 6).otherwise(7), "probable", c("callee"), c("rank")))
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    return every
