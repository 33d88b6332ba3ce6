"""Mixing sources to target weights by Pivotal dependent rounding, in DataFrame operations only.

Each document of a source should be taken target / source_size times: its whole copies are certain, the fraction is
rounded. Fractions meet in pairs; words move between the two, at random and without bias, until one of them is a whole
copy or none, so each meeting settles one document and keeps the source's words exactly. Documents are dealt by a hash
into blocks of about BLOCK, each block folds its pairs and leaves one residual, residuals are dealt again, and so on up a
tree until each source has one, whose fraction is rounded by itself. No source has to fit into a task, however many of
the rows are its own; random choices come from a hash of the two ids, so reruns agree.

Targets: sources by code point (null last) weigh WEIGHTS in turn and share all words; a target stops at MOST times its
source's words and the excess is reshared by weight. That is water-filling: target = min(cap, level * weight), and the
level is found with running sums over the sources in the order of cap / weight.

Defined cases: null texts have no words; documents without words are returned and nothing is taken of them; a null source
is a source; repeated rows are rounded each by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

WEIGHTS = (5, 2, 1)
MOST, BLOCK, SEED = 3, 64, 17
#: Most words of a document of the second and later tiers.
TIERS = (2048, 512, 128, 32)

_PAIR = """
aggregate(slice(xs, 2, greatest(size(xs) - 1, 0)),
  named_struct('r', xs[0], 'done', cast(array() as array<struct<id:bigint,size:bigint,add:int>>)),
  (acc, b) -> transform(array(named_struct('a', acc.r, 'b', b,
      'up', least((1 - acc.r.p) * acc.r.size, b.p * b.size), 'down', least(acc.r.p * acc.r.size, (1 - b.p) * b.size),
      'u', pmod(xxhash64({seed}, acc.r.id, b.id, acc.r.size), 9007199254740992) / 9007199254740992D)),
    t -> case
      when t.up + t.down > 0 and t.u * (t.up + t.down) < t.down then
        if(t.up >= (1 - t.a.p) * t.a.size,
          named_struct('r', named_struct('id', t.b.id, 'size', t.b.size, 'p', greatest(t.b.p - t.up / t.b.size, 0D)), 'done', array_append(acc.done, named_struct('id', t.a.id, 'size', t.a.size, 'add', 1))),
          named_struct('r', named_struct('id', t.a.id, 'size', t.a.size, 'p', least(t.a.p + t.up / t.a.size, 1D)), 'done', array_append(acc.done, named_struct('id', t.b.id, 'size', t.b.size, 'add', 0))))
      else
        if(t.down >= t.a.p * t.a.size,
          named_struct('r', named_struct('id', t.b.id, 'size', t.b.size, 'p', least(t.b.p + t.down / t.b.size, 1D)), 'done', array_append(acc.done, named_struct('id', t.a.id, 'size', t.a.size, 'add', 0))),
          named_struct('r', named_struct('id', t.a.id, 'size', t.a.size, 'p', greatest(t.a.p - t.down / t.a.size, 0D)), 'done', array_append(acc.done, named_struct('id', t.b.id, 'size', t.b.size, 'add', 1))))
      end)[0])
"""


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, size. Returns one row a source: source, n, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "turn")
    every = Window.partitionBy()
    turn = (F.row_number().over(by_name) - 1).alias("turn")
    per = per.select("*", turn).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("turn") % len(WEIGHTS) + 1))
    per = per.withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum(F.col("source_size") * 1.0).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source in that order that its cap doesn't stop sets the level of all the others
    per = per.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "turn", "level"))).over(every)["level"])
    return per.select("source", "n", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def _reduce(rows: DataFrame, n: int, seed: int, name: str) -> DataFrame:
    """rows: source, n (of the source), doc_id, size, p. Returns source, doc_id, size, add: the fractions rounded up the tree."""
    settled, left, level = None, rows, 0
    while True:
        blocks = F.ceil(F.col("n") / BLOCK)
        dealt = left.select("source", blocks.alias("n"), F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), blocks).alias("block"), F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.col("doc_id").alias("id"), "size", "p").alias("x"))
        folded = dealt.groupBy("source", "n", "block").agg(F.sort_array(F.collect_list("x")).alias("ys")).withColumn("xs", F.expr("transform(ys, y -> named_struct('id', y.id, 'size', y.size, 'p', y.p))"))
        folded = materialize(folded.select("source", "n", F.expr(_PAIR.format(seed=seed + 1000 + level)).alias("s")), f"{name}-level{level}")
        done = folded.select(F.inline("s.done"), "source").select("source", F.col("id").alias("doc_id"), "size", "add")
        settled = done if settled is None else settled.unionByName(done)
        left = folded.select("source", "n", F.col("s.r.id").alias("doc_id"), F.col("s.r.size").alias("size"), F.col("s.r.p").alias("p"))
        n, level = -(-n // BLOCK), level + 1
        if n <= 1:
            break
    u = F.pmod(F.xxhash64(F.lit(seed + 5000), "doc_id", "source"), F.lit(1 << 53)) / float(1 << 53)
    return settled.unionByName(left.select("source", "doc_id", "size", F.when(u < F.col("p"), 1).otherwise(0).alias("add")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken.

    Long documents are rounded first. The words by which a tier of sizes misses its share go into the fraction of the next
    smaller tier, so what a source misses at the end is at most a short document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    tier = F.lit(0)
    for least in TIERS:
        tier = tier + (F.col("size") <= least).cast("int")
    rows = materialize(rows.withColumn("tier", tier), "op1-sizes")
    per = materialize(targets(rows), "op1-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    tiers = rows.where("size > 0").groupBy("source", "tier").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    tiers = materialize(tiers.withColumnRenamed("source", "_s").join(per.drop("n"), F.col("_s").eqNullSafe(F.col("source"))).select("source", "tier", "words", "n", (share - F.floor(share)).alias("p")), "op1-tiers")
    most = {r["tier"]: r["n"] for r in tiers.groupBy("tier").agg(F.max("n").alias("n")).collect()}
    settled, carry = rows.where("size = 0").select("source", "doc_id", "size", F.lit(0).alias("add")), None
    for t in sorted(most):
        plan = tiers.where(F.col("tier") == t).select("source", "n", "words", "p")
        plan = plan.withColumn("mass", F.col("p") * F.col("words"))
        if carry is not None:  # sources that have nothing in this tier keep theirs
            c = carry.select(F.col("source").alias("_c"), "over")
            both = plan.join(c, F.col("source").eqNullSafe(F.col("_c")), "full")
            plan = both.select(F.when(F.col("n").isNull(), F.col("_c")).otherwise(F.col("source")).alias("source"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("words", F.lit(0)).alias("words"), "p", (F.coalesce("mass", F.lit(0.0)) + F.coalesce("over", F.lit(0.0))).alias("mass"))
        # a target at its cap or below one copy leaves nothing to round: p = 0 stays so
        q = F.when((F.col("words") > 0) & (F.col("p") > 0), F.least(F.greatest(F.col("mass") / F.col("words"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        plan = materialize(plan.withColumn("q", q), f"op1-plan{t}")
        mine = rows.where((F.col("tier") == t) & (F.col("size") > 0)).withColumnRenamed("source", "_s").join(plan.where("n > 0"), F.col("_s").eqNullSafe(F.col("source"))).select("source", "n", "doc_id", "size", F.col("q").alias("p"))
        got = materialize(_reduce(mine, most[t], seed + 100 * t, f"op1-tier{t}"), f"op1-settled{t}")
        settled = settled.unionByName(got)
        sums = got.groupBy("source").agg(F.sum(F.col("add") * F.col("size")).alias("got")).withColumnRenamed("source", "_g")
        carry = materialize(plan.join(sums, F.col("source").eqNullSafe(F.col("_g")), "left").select("source", (F.col("mass") - F.coalesce("got", F.lit(0))).alias("over")), f"op1-carry{t}")
    out = settled.withColumnRenamed("source", "_s").join(per, F.col("_s").eqNullSafe(F.col("source")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(share) + F.col("add"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
