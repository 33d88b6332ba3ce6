"""BM25 over any documents: an inverted index as tables, and search of any number of queries in one job.

The postings are dealt and sorted by term when they are saved (a frequent one in parts), so a search prunes files by the query's terms. Scores come
from an equi-join of query terms with postings, which are dealt by document first where the asked terms are few enough to be
broadcast; a query's hits are ranked by a window that keeps k rows a query. Parts of a score are added as whole numbers of
2^-46, about the precision of a double of that size: sums have the same bits in any order, so ranks need no rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.tables import materialize
from .chunk import dedup_first

K1, B, TOP_K = 1.5, 0.75, 10
#: Parts of scores are counted in units of 1 / UNIT.
UNIT = float(1 << 46)
#: So many asked terms at most are broadcast; each is a row of under a hundred bytes.
ASKED_MOST = 200_000
#: Documents are dealt so that a task scores about so many hits, however many there are: what it holds does not grow with them.
HITS = 1_000_000
#: A term of several queries is heavy if its hits of all of them are more than these.
HEAVY = 1_000_000
#: Stands for a document itself among its terms; no token is empty.
DOCUMENT = ""


def weighted_text(symbol: Column, text: Column, context: Column | None = None, compat: bool = True) -> Column:
    """Symbol and signature count twice. With compat a context whose docstring is null says 'None', and imports of modules
    count only by their text; otherwise a null docstring says nothing."""
    empty = F.lit("")

    def of(field: str) -> Column:
        return F.coalesce(context[field], empty) if context is not None else empty

    docstring = F.coalesce(context["docstring"], F.lit("None") if compat else empty) if context is not None else empty
    imports = F.array_join(F.coalesce(context["relevant_imports"], F.array().cast("array<string>")), " ") if context is not None else empty
    name = F.coalesce(symbol, empty)
    return F.concat_ws(" ", name, name, of("signature"), of("signature"), of("containing_class"), of("module"), docstring, imports, F.coalesce(text, empty))


def score(tf: Column, dl: Column, idf: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    ratio = F.when(avgdl > 0, dl / avgdl).otherwise(F.lit(1.0))
    return idf * ((tf * (k1 + 1)) / (tf + k1 * (1 - b + b * ratio)))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(docs: DataFrame, id_col: str, text: Column, scope: tuple[str, ...] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(scope, id, dl, term, tf) of every term of each document, or of the wanted ones (term), and a row a document whose term is
    DOCUMENT; all from one pass over the texts. Counting is combined before its shuffle."""
    tokens = docs.select(*scope, F.col(id_col).alias("id"), tokenize(text).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    each = tokens.select(*scope, "id", "dl", F.explode(F.array_append("tokens", F.lit(DOCUMENT))).alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").union(wanted.sparkSession.range(1).select(F.lit(DOCUMENT))).distinct(), "term", "left_semi")
    return each.groupBy(*scope, "id", "dl", "term").agg(F.count("*").alias("tf"))


def statistics(counts: DataFrame, scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, document frequencies (scope, term, df) and corpora (scope, n, avgdl) of term counts."""
    documents, postings = counts.where(F.col("term") == DOCUMENT), counts.where(F.col("term") != DOCUMENT)
    corpus = documents.groupBy(*scope).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return postings.select(*scope, "term", "id", "tf", "dl"), postings.groupBy(*scope, "term").agg(F.count("*").alias("df")), corpus


def term_statistics(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, df, idf) of all documents, without postings: each row gives its distinct terms, and what is shuffled are counts by term.
    Only rows whose id others have are compared: those of one id and length are one document with the terms of all of them."""
    key, n = F.col(id_col), F.broadcast(docs.agg(F.count("*").alias("n")))  # one row
    again = materialize(docs.groupBy(key.alias("again")).count().where("count > 1").select("again"), "ids-again")
    each = lambda rows, *of: rows.select(*of, F.explode(F.array_distinct(tokenize(text))).alias("term"))
    if again.isEmpty():
        terms = each(docs)
    else:
        same = key.eqNullSafe(F.col("again"))
        shared = docs.join(again, same, "left_semi")
        shared = each(shared, key.alias("id"), F.size(tokenize(text)).alias("dl")).distinct().select("term")
        terms = each(docs.join(again, same, "left_anti")).unionByName(shared)
    return terms.groupBy("term").agg(F.count("*").alias("df")).join(n, F.lit(True)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(queries: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """queries: query_id, query, top_k and scope. (query_id, scope, top_k, term, qtf): a term that is asked twice counts twice."""
    each = queries.where("top_k > 0").select("query_id", *scope, "top_k", F.explode(tokenize(F.col("query"))).alias("term"))
    return each.groupBy("query_id", *scope, "top_k", "term").agg(F.count("*").alias("qtf"))


def with_corpus(rows: DataFrame, corpus: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return rows.join(corpus, list(scope)) if scope else rows.join(F.broadcast(corpus), F.lit(True))  # one row


def score_hits(postings: DataFrame, asked: DataFrame, scope: tuple[str, ...], k1: float, b: float, by: tuple[str, ...]) -> DataFrame:
    """asked: query_terms with df, idf and avgdl. (by, id, s) of each document that has a term of them."""
    keys = [*scope, "term"]
    asked = materialize(asked, "asked")
    n, n_hits = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    # what a posting scores is the same for all queries and worked out once, before they multiply it
    terms, of_query = asked.select(*keys, "idf", "avgdl").distinct(), asked.select(*by, *keys, "qtf")
    part = F.rint(score(F.col("tf"), F.col("dl"), F.col("idf"), F.col("avgdl"), k1, b) * UNIT).cast("long")
    scored = lambda terms: postings.join(terms, keys).select(*keys, "id", part.alias("part"))
    if n <= ASKED_MOST:
        # postings of asked terms are dealt by document before queries multiply them, so that scores add up where they are; how many
        # hits come of them is known, but not to adaptive execution, which would deal them by their own size
        parts = max(asked.sparkSession.sparkContext.defaultParallelism, -(-n_hits // HITS))
        hits = scored(F.broadcast(terms)).repartition(parts, "id").join(F.broadcast(of_query), keys)
    else:
        hits = scored(terms).join(of_query, keys)
    return hits.groupBy(*by, "id").agg(F.sum(F.col("part") * F.col("qtf")).alias("s"))


def score_queries(postings: DataFrame, asked: DataFrame, scope: tuple[str, ...], k1: float, b: float, most: int) -> DataFrame:
    """asked: query_terms with df, idf and avgdl. (query_id, top_k, id, s) of the best documents of each query, `most` at least.

    What heavy terms score is the same for all queries that have the same ones, so it is added up once for each such bag. All
    parts of scores are above zero: a document without a light term of a query is among its best only if it is among those of
    the bag, and any other is met by its light terms, which are few, and is given what the bag scores it. Where bags repeat less than
    twice on average nothing is shared, and queries are scored whole."""
    keys, query = [*scope, "term"], ["query_id", "top_k"]
    asked = materialize(asked, "asked")
    heavy = asked.groupBy(*keys, "df").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * F.col("df") > HEAVY))
    heavy = materialize(heavy.select(*keys, F.lit(True).alias("heavy")), "heavy")
    if heavy.isEmpty():
        return score_hits(postings, asked, scope, k1, b, tuple(query))
    own = F.collect_list(F.when(F.col("heavy"), F.struct("term", "qtf"))).over(Window.partitionBy(*query, *scope))
    asked = asked.join(heavy, keys, "left").withColumn("bag", F.sha2(F.to_json(F.struct(*scope, F.sort_array(own).alias("terms"))), 256))
    asked = materialize(asked, "bags")
    owners = materialize(asked.select(*query, "bag").distinct(), "owners")
    n, bags = owners.agg(F.count("*"), F.count_distinct("bag")).first()
    if n < 2 * bags:
        return score_hits(postings, asked, scope, k1, b, tuple(query))
    shared = asked.where("heavy").select(*keys, "bag", "qtf", "df", "idf", "avgdl").distinct()
    of_bags = materialize(score_hits(postings, shared, scope, k1, b, ("bag",)), "of-bags")
    first = F.row_number().over(Window.partitionBy("bag").orderBy(F.col("s").desc(), "id"))
    best = of_bags.withColumn("rank", first).where(F.col("rank") <= F.lit(most)).drop("rank")
    best = F.broadcast(best) if bags * most <= ASKED_MOST else best
    met = score_hits(postings, asked.where("heavy is null"), scope, k1, b, (*query, "bag")).join(of_bags.withColumnRenamed("s", "more"), ["bag", "id"], "left")
    met = met.select(*query, "id", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"))
    return met.unionByName(owners.join(best, "bag").select(*query, "id", "s")).groupBy(*query, "id").agg(F.max("s").alias("s"))


def by_term(rows: DataFrame) -> DataFrame:
    """Rows dealt by term; those of a frequent term are several parts, so that no task sorts all of them."""
    return rows.hint("rebalance", "term")


def rank_hits(scored: DataFrame, most: int) -> DataFrame:
    """scored: query_id, top_k, id, s (in units). The best top_k of each query, equal scores by id. No top_k is over most:
    as a literal it lets every task keep so many hits a query before they are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.lit(most))
    return ranked.where(F.col("rank") <= F.col("top_k")).select("query_id", "rank", "id", F.round(F.col("s") / UNIT, 4).alias("score"))


def most_asked(queries: DataFrame) -> int:
    return queries.agg(F.max("top_k")).first()[0] or 0


@dataclass
class Bm25Index:
    """postings: term, id, tf, dl; terms: term, df, idf; corpus: n, avgdl (one row). With a scope (columns that lead each of
    them) its values have statistics of their own, and each query searches one value."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    k1: float = K1
    b: float = B
    scope: tuple[str, ...] = ()

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column, k1: float = K1, b: float = B, order: list | None = None, scope: tuple[str, ...] = ()) -> Bm25Index:
        """With order, only the first document of an id counts. Texts are read once, into a table of term counts."""
        if order is not None:
            docs = dedup_first(docs, [id_col], order)
        return cls.of_counts(materialize(term_counts(docs, id_col, text, scope), "term-counts"), k1, b, scope)

    @classmethod
    def of_counts(cls, counts: DataFrame, k1: float = K1, b: float = B, scope: tuple[str, ...] = ()) -> Bm25Index:
        postings, df, corpus = statistics(counts, scope)
        terms = with_corpus(df, corpus, scope).select(*scope, "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
        return cls(postings, terms, corpus, k1, b, scope)

    def search(self, queries: DataFrame) -> DataFrame:
        """queries: query_id, query, top_k and the scope. Returns query_id, rank, id, score (4 places); blank queries have no hits.
        The few asked terms meet their statistics first, so that postings are joined once."""
        asked = with_corpus(query_terms(queries, self.scope).join(self.terms, [*self.scope, "term"]), self.corpus, self.scope)
        most = most_asked(queries)
        return rank_hits(score_queries(self.postings, asked, self.scope, self.k1, self.b, most), most)

    def cache(self, postings: bool = True) -> Bm25Index:
        """postings: False where they come of a written table, which is as good to read as a copy in memory."""
        for df in (*([self.postings] if postings else []), self.terms, self.corpus):
            df.cache()
        return self

    def unpersist(self) -> None:
        for df in (self.postings, self.terms, self.corpus):
            df.unpersist()

    def save(self, path: str) -> None:
        path = path.rstrip("/")
        by_term(self.postings).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        by_term(self.terms).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.withColumns({"k1": F.lit(self.k1), "b": F.lit(self.b)}).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        path = path.rstrip("/")
        corpus = spark.read.parquet(f"{path}/corpus")
        k1, b = corpus.select(F.coalesce(F.max("k1"), F.lit(K1)), F.coalesce(F.max("b"), F.lit(B))).first()
        scope = tuple(c for c in corpus.columns if c not in ("n", "avgdl", "k1", "b"))
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), corpus.select(*scope, "n", "avgdl"), k1, b, scope)

    def __len__(self) -> int:
        return self.corpus.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def search_documents(docs: DataFrame, queries: DataFrame, id_col: str, text: Column, k1: float = K1, b: float = B) -> DataFrame:
    """The same as build and search for documents that are searched once: postings of other terms than the queries' are
    never made. The terms that are asked for are a table, so that any number of them can meet the tokens in one join."""
    wanted = materialize(query_terms(queries).select("term").distinct(), "bm25-wanted")
    return Bm25Index.of_counts(materialize(term_counts(docs, id_col, text, wanted=wanted), "bm25-met"), k1, b).search(queries)
