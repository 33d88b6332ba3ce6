"""Line dedup as an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Words are ordered by rarity: hashed into BUCKETS counters over all lines, they rank by the
quarter of an octave of their counter, then by hash. In that order two sets of sizes n and m that overlap in o words have
H = n + m - 2 o words of only one of them, and these part at most H of the gaps between their common words: of the first
(RUN - 1) (H + 1) + 1 common words RUN stand side by side in both sets, within that many and n - o more words of each. So the
prefix of a line is that long, and its postings are the runs of RUN neighbours in it (of sets so small that they may not have
so many common words, also shorter runs, down to the single words of the usual prefix). A run of three words is shared by
chance far more rarely than a word, which a corpus of any size has in a fixed share of its lines, or than a pair, of which
growing corpora share ever more. Lengths, the places where sets meet (positional filter) and a sketch of 128 parities, which
differ in at most as many bits as the sets in words, leave out more; candidates are verified on whole sets. A line goes if a
line before it (by document id, then by line) is as similar as that or equal; lines are judged on the input, not on what is
left.

Equal sets are one class before anything is joined, by minima that are combined before they are shuffled, so a line that
a third of all documents share is one row. Of each posting the class with most equal lines (of those the first) is its
hub, again by combined minima; every line is held against the nearest of its hubs, which settles most lines of a group of near
copies in one comparison each, and all of postings with two classes. Only lines that stay
are joined with all earlier lines of their postings; the nearest is tried first, then the others. Bitmaps (subqueries; they may
only let too much through) keep what can't matter out of shuffles.

Defined cases: lines end at newlines; a line without words is never removed and matches nothing; lines may be of any length;
null text has no lines and stays null; rows with a null id keep their lines and match nothing; rows that share an id are one
document in the order of lines, so equal lines at one place of them are not before each other; of equal lines (ties) the
first stays; an empty table gives an empty result; other columns are not read by line_dedup, and dedup_documents returns
them unchanged (but for columns that have the names of its two counts, which the counts replace).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bitmap, documents, drop, fresh, materialize, settle

NUM, DEN = 4, 5
BUCKETS = 1 << 16
#: Neighbours that make a posting.
RUN = 3
#: xxhash64 of the empty string.
_EMPTY = -7444071767201028348


def _blank(line: Column) -> Column:
    """Spaces for the other characters that part words."""
    others = [F.contains(line, F.lit(c)) for c in "\t\x0b\x0c\r"]
    return F.when(others[0] | others[1] | others[2] | others[3], F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)


def _words(line: Column) -> Column:
    """Words of a line, as 64-bit hashes, each once."""
    return F.array_remove(F.array_distinct(F.transform(F.split(_blank(line), " "), lambda w: F.xxhash64(w))), _EMPTY)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ln, line)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("ln", "line"))


def rarity(docs: DataFrame, text_col: str = "text") -> str:
    """Quarters of an octave of each of BUCKETS counters over all words, with commas between; words are hashed to counters."""
    at = F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int")
    lines = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line"))
    counts = lines.select(F.explode(F.split(_blank(F.col("line")), " ")).alias("w")).groupBy(at.alias("at")).count()
    ranks = ["0"] * BUCKETS
    for r in counts.select("at", F.least(F.floor(F.log2("count") * 4), F.lit(126)).alias("r")).collect():  # BUCKETS rows at most
        ranks[r["at"]] = str(r["r"])
    return ",".join(ranks)


def _ranked(line: Column, ranks: str) -> Column:
    """Words of a line, each once, by rarity: the rank in the highest bits, the hash below it. One lambda, and what follows it
    on arrays without nulls, stays in generated code."""
    table = F.split(F.lit(ranks), ",").cast("array<bigint>")  # folded into one literal; lambdas may hold no subquery

    def place(w: Column) -> Column:
        rank = F.coalesce(F.get(table, F.xxhash64(w).bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8))

    empty = int(ranks.split(",")[_EMPTY & (BUCKETS - 1)]) << 56 | (_EMPTY & (1 << 64) - 1) >> 8
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(F.split(_blank(line), " "), place), F.lit(empty).cast("long"))))


def _least_other(n: Column, num: int, den: int) -> Column:
    """The least size that may be similar to n."""
    return F.ceil(n * num / F.lit(den)).cast("long")


def _prefix_length(n: Column, num: int, den: int) -> Column:
    """(n - o) + (RUN - 1) (H + 1) + 1 at its most, which it has for the least partner; all words where runs don't do."""
    m = _least_other(n, num, den)
    if (2 * RUN - 1) * num <= (RUN - 1) * (num + den):
        return n
    most = F.floor((RUN * (num + den) * n + (RUN - 1) * (num + den) * m - (2 * RUN - 1) * num * (n + m)) / F.lit(num + den)) + RUN
    return F.least(n.cast("long"), most).cast("int")


def _runs_may_fail(n: Column | int, m: Column | int, run: int, num: int, den: int) -> Column | bool:
    """Whether similar sets of these sizes may have too few common words, (run - 1) (H + 1) + 1, for a run to be certain."""
    return (n + m) * (run * num - (run - 1) * den) < run * (num + den)


def _size(lnn: str) -> Column:
    return F.col(lnn).bitwiseAND(0xFFFFFFFF)


def _line(lnn: str) -> Column:
    return F.shiftright(lnn, 32).cast("int")


def _before(d1: str, l1: str, d2: str, l2: str) -> Column:
    """The second place is before the first."""
    return (F.col(d2) < F.col(d1)) | ((F.col(d2) == F.col(d1)) & (F.col(l2) < F.col(l1)))


def postings(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, pos, prior, doc_id, lnn, low, high, rank): runs of neighbours in prefixes with the word before them, and shorter
    runs, down to single words, of sets so small that longer ones don't do."""
    kept = ["doc_id", "lnn", "low", "high", "rank"]
    some = classes.where(F.size("prefix") > 0).withColumn("rank", _rank())
    n = _size("lnn")
    m = _least_other(n, num, den)
    least = -(-num // (den - num))  # of sets that are similar to others
    out = None
    for run in range(RUN, 0, -1):
        before = F.concat(F.array(F.lit(None).cast("int")), F.col("prefix")).alias("c")
        words = F.arrays_zip(*(F.expr(f"slice(prefix, {i}, size(prefix))").alias(f"w{i}") for i in range(1, run + 1)), before)
        zipped = some.select(*kept, F.posexplode(words).alias("pos", "z")).where(f"z.w{run} is not null")
        sig = F.xxhash64(*(f"z.w{i}" for i in range(1, run + 1)))
        found = zipped.select(sig.alias("sig"), "pos", F.col("z.c").alias("prior"), *kept)
        out = found if out is None else out.unionByName(found)
        if not _runs_may_fail(least, -(-num * least // den), run, num, den):
            break
        some = some.where(_runs_may_fail(n, m, run, num, den))
    return out


def _rank() -> Column:
    """Which class is the hub of a posting, the least of it: that with most equal lines, then the first. Ids or lines that
    don't fit into the bits take their turn by a hash; classes of equal rank are hubs together."""
    ln = F.shiftright("lnn", 32)
    fits = (F.col("doc_id") >= 0) & (F.col("doc_id") < 1 << 35) & (ln < 1 << 16)
    place = F.when(fits, F.shiftleft("doc_id", 16).bitwiseOR(ln)).otherwise(F.xxhash64("doc_id", "lnn").bitwiseAND((1 << 51) - 1))
    return F.shiftleft(4095 - F.least("times", F.lit(4095)), 51).bitwiseOR(place)


def _apart(i: str, j: str) -> Column:
    """At most as many as the sets differ in words."""
    low, high = (F.col(f"{c}{i}").bitwiseXOR(F.col(f"{c}{j}")) for c in ("low", "high"))
    return F.bit_count(low.bitwiseXOR(high)) + F.bit_count(high)


def _near(n1: Column, n2: Column, apart: Column, num: int, den: int) -> Column:
    """What lengths and sketches let through."""
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (apart * (num + den) <= (n1 + n2) * (den - num))


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ln) of the lines that go."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    ranked = lines_of(docs).select("doc_id", "ln", _ranked(F.col("line"), rarity(docs)).alias("k"))
    n = F.size("k")
    prefix = F.when(n * (den - num) >= num, F.transform(F.slice("k", F.lit(1), _prefix_length(n, num, den)), lambda x: F.hash(x))).otherwise(F.array().cast("array<int>"))
    # parities of all words, and of those with a set seventh bit: together 128
    low, high = (F.expr(f"aggregate(k, 0L, (acc, x) -> acc ^ shiftleft({bit}, cast(x & 63 as int)))") for bit in ("1L", "shiftright(x, 6) & 1L"))
    every = materialize(ranked.select("doc_id", F.expr("shiftleft(cast(ln as bigint), 32) | size(k)").alias("lnn"), F.xxhash64("k").alias("s"), F.xxhash64(F.lit(1), "k").alias("s2"), low.alias("low"), high.alias("high"), prefix.alias("prefix")), "op9-wide")
    wide = every.where(_size("lnn") > 0)
    classes = wide.groupBy("s", "s2").agg(F.min(F.struct("doc_id", "lnn")).alias("at"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("low", "high", "prefix")))
    classes = materialize(classes.select("s", "s2", "at.doc_id", "at.lnn", "times", "low", "high", "prefix"), "op9-classes")
    lines = materialize(wide.select("doc_id", "lnn", "s", "s2"), "op9-lines")
    drop(every)
    shared, first = _shared(classes, num, den)
    # what follows reads postings; of classes only their places are needed any more
    classes, given = materialize(classes.select("s", "s2", "doc_id", "lnn", "times"), "op9-firsts"), classes
    drop(given)
    pairs = materialize(_with_hubs(shared, first, num, den), "op9-hubs")
    more = _of_more(shared, first)
    drop(first)
    nearest = materialize(_nearest(pairs), "op9-nearest")
    settle(docs.sparkSession)
    dead = _similar(docs, nearest, num, den)
    rest = pairs.unionByName(_met(more, dead, num, den))
    rest = rest.join(dead, ["d1", "l1"], "left_anti").join(nearest, ["d1", "l1", "d2", "l2"], "left_anti")
    rest = materialize(rest.groupBy("d1", "l1", "d2", "l2").agg(F.min("apart").alias("apart")), "op9-rest")
    drop(shared, pairs, nearest)
    nearest = materialize(_nearest(rest), "op9-nearest")
    if not nearest.isEmpty():
        dead = materialize(dead.unionByName(_similar(docs, nearest, num, den)), "op9-dead")
        others = materialize(rest.drop("apart").join(dead, ["d1", "l1"], "left_anti").join(nearest, ["d1", "l1", "d2", "l2"], "left_anti"), "op9-others")
        if not others.isEmpty():
            dead = materialize(dead.unionByName(_similar(docs, others, num, den)), "op9-dead")
    marked = classes.join(dead, (F.col("doc_id") == F.col("d1")) & (_line("lnn") == F.col("l1")), "left").where("times > 1 or d1 is not null").select("s", "s2", F.struct("doc_id", "lnn").alias("at"), F.col("d1").isNotNull().alias("all"))
    return lines.join(marked, ["s", "s2"]).where(F.col("all") | (F.struct("doc_id", "lnn") > F.col("at"))).select("doc_id", _line("lnn").alias("ln"))


def _shared(classes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Postings that several classes have (and few others), and of each signature (sig, k, hub): how many have it, and the
    first by rank. Signatures are counted alone, so the one shuffle of all postings is of narrow rows."""
    posted = postings(classes, num, den)
    often = materialize(posted.groupBy("sig").count().where("count > 1").select("sig"), "op9-often")
    settle(classes.sparkSession)
    shared = materialize(posted.where(Bitmap(often, "sig").has("sig")), "op9-shared")
    drop(often)
    hub = F.min(F.struct("rank", "doc_id", "lnn", "low", "high"))
    first = materialize(shared.groupBy("sig").agg(F.count("*").alias("k"), hub.alias("hub")).where("k > 1"), "op9-first")
    settle(classes.sparkSession)
    return shared, first


def _of_more(shared: DataFrame, first: DataFrame) -> DataFrame:
    """Postings of signatures that more than a hub and one other have (and few others, which only repeat what is known)."""
    return shared.where(Bitmap(first.where("k > 2"), "sig").has("sig")).drop("rank")


def _with_hubs(shared: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """(d1, l1, d2, l2, apart): lines and the hubs of their postings, the later one first, as far as the filters let them."""
    hubs = first.select("sig", *(F.col(f"hub.{c}").alias(f"{c}2") for c in ("doc_id", "lnn", "low", "high")))
    seen = shared.select("sig", *(F.col(c).alias(f"{c}1") for c in ("doc_id", "lnn", "low", "high")))
    both = seen.join(hubs.hint("shuffle_hash"), "sig").withColumn("apart", _apart("1", "2"))  # one row a signature in hubs
    both = both.where(((F.col("doc_id1") != F.col("doc_id2")) | (F.col("lnn1") != F.col("lnn2"))) & _near(_size("lnn1"), _size("lnn2"), F.col("apart"), num, den))
    x, y = (F.struct(F.col(f"doc_id{i}").alias("d"), F.col(f"lnn{i}").alias("l")) for i in (1, 2))
    ordered = both.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y"), "apart").where("x <> y")
    flat = ordered.select(F.col("x.d").alias("d1"), F.col("x.l").alias("l1"), F.col("y.d").alias("d2"), F.col("y.l").alias("l2"), "apart")
    return _places(flat.groupBy("d1", "l1", "d2", "l2").agg(F.min("apart").alias("apart")))


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each line the pair with the least distance of sketches."""
    return pairs.groupBy("d1", "l1").agg(F.min(F.struct("apart", "d2", "l2")).alias("m")).select("d1", "l1", "m.d2", "m.l2")


def _places(pairs: DataFrame) -> DataFrame:
    """Places as document and number of line."""
    return pairs.withColumns({"l1": _line("l1"), "l2": _line("l2")}).select("d1", "l1", "d2", "l2", *(c for c in pairs.columns if c == "apart"))


def _met(shared: DataFrame, dead: DataFrame, num: int, den: int) -> DataFrame:
    """(d1, l1, d2, l2, apart): lines that aren't dead, and lines before them that share a posting, as far as the filters let them."""
    may = Bitmap(dead, "d1", "l1").has("doc_id", _line("lnn"))
    checked = shared.where(may).join(dead, (F.col("doc_id") == F.col("d1")) & (_line("lnn") == F.col("l1")), "left_anti")
    alive = shared.where(~may).unionByName(checked)
    x, y = (p.select("sig", *(F.col(c).alias(f"{c}{i}") for c in ("doc_id", "lnn", "low", "high", "pos", "prior"))) for p, i in ((alive, 1), (shared, 2)))
    n1, n2 = _size("lnn1"), _size("lnn2")
    overlap = F.least("pos1", "pos2") + F.least(n1 - F.col("pos1"), n2 - F.col("pos2"))
    # lines that agree in the word before, too, have met at the pair before
    new = F.coalesce(F.col("prior1") != F.col("prior2"), F.lit(True))
    meets = new & _before("doc_id1", "lnn1", "doc_id2", "lnn2") & _near(n1, n2, _apart("1", "2"), num, den) & (overlap * (num + den) >= (n1 + n2) * num)
    pairs = x.join(y, "sig").where(meets).groupBy("doc_id1", "lnn1", "doc_id2", "lnn2").agg(F.min(_apart("1", "2")).alias("apart"))
    return _places(pairs.withColumnsRenamed({"doc_id1": "d1", "lnn1": "l1", "doc_id2": "d2", "lnn2": "l2"}))


def _similar(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(d1, l1), each once, of the pairs (d1, l1, d2, l2) of lines whose sets of words are similar enough."""
    ends = pairs.select(F.col("d1").alias("doc_id"), F.col("l1").alias("ln")).unionByName(pairs.select(F.col("d2").alias("doc_id"), F.col("l2").alias("ln"))).distinct()
    ends = materialize(ends, "op9-places")
    some = lines_of(docs).where(Bitmap(ends, "doc_id", "ln").has("doc_id", "ln"))
    sets = materialize(some.join(ends, ["doc_id", "ln"]).select("doc_id", "ln", _words(F.col("line")).alias("k")), "op9-sets")
    one, two = (sets.select(F.col("doc_id").alias(f"d{i}"), F.col("ln").alias(f"l{i}"), F.col("k").alias(f"k{i}")) for i in (1, 2))
    same = F.size(F.array_intersect("k1", "k2"))
    both = pairs.select("d1", "l1", "d2", "l2").join(two, ["d2", "l2"]).join(one, ["d1", "l1"])
    out = materialize(both.where(same * den >= (F.size("k1") + F.size("k2") - same) * num).select("d1", "l1").distinct(), "op9-similar")
    drop(ends, sets)
    return out


def dedup_documents(docs: DataFrame, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "_lines", n_removed: str = "_removed") -> DataFrame:
    """The documents with the kept lines as text, and numbers of lines before and of those that went."""
    key, lost = fresh(docs, "_id"), fresh(docs, "_gone")
    gone = removed_lines(docs, num, den, id_col, text_col).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("ln").alias(lost))
    gone = materialize(gone, "op9-gone")
    cut = fresh(docs, "_cut")  # a column of its own, or lambdas would split the text again for each line
    split = F.split(F.col(text_col).cast("string"), "\n", -1).alias(cut)
    lines = F.col(cut)
    others = [c for c in docs.columns if c not in (n_lines, n_removed)]
    # only documents that may lose lines are shuffled
    may = Bitmap(gone, key).has(F.col(id_col).cast("long"))
    out = docs.where(may).join(gone, F.col(id_col).cast("long") == F.col(key), "left").select("*", split)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    kept = F.when(F.col(lost).isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines)
    out = out.select(*(kept.alias(c) if c == text_col else F.col(c) for c in others), total, F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n_removed))
    whole = docs.where(~may).select("*", split).select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in others), total, F.lit(0).cast("long").alias(n_removed))
    return whole.unionByName(out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.when(F.col("text").isNull() & (F.col("_removed") == 0), F.lit(0)).otherwise(F.col("_lines")).cast("long").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: CTEs up to lgone(doc_id, ln): the lines that go, over a table or CTE of documents.
def lines_sql(docs: str, num: int = NUM, den: int = DEN) -> str:
    return rf"""
 ll AS (SELECT doc_id, unnest(range(len(l))) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs})),
 lk AS (SELECT doc_id, ln, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS k FROM ll),
 lf AS (SELECT k, min((doc_id, ln)) AS p, count(*) AS times, row_number() OVER () AS s FROM lk WHERE len(k) > 0 GROUP BY k),
 lt AS (SELECT s, p, len(k) AS n, unnest(k) AS t FROM lf WHERE len(k) > 3),
 li AS (SELECT x.s AS s, y.p AS p, x.n AS n, y.n AS m, count(*) AS same FROM lt x JOIN lt y ON x.t = y.t AND x.s <> y.s AND x.p > y.p AND x.n * {den} >= y.n * {num} AND y.n * {den} >= x.n * {num} GROUP BY ALL),
 le AS (SELECT s, min(p) AS p FROM li WHERE same * {den} >= (n + m - same) * {num} GROUP BY s),
 lm AS (SELECT lf.k, least(lf.p, coalesce(le.p, lf.p)) AS p FROM lf LEFT JOIN le USING (s) WHERE times > 1 OR le.p IS NOT NULL),
 lgone AS (SELECT doc_id, ln FROM lk JOIN lm USING (k) WHERE (doc_id, ln) > lm.p)"""


SQL = {
    "op9_line_dedup": f"""
WITH {lines_sql('documents')},
 g AS (SELECT doc_id, list(ln) AS gone FROM lgone GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""
}
