"""Secret scans: fixed rules, and Markov models of random strings against ordinary identifiers. DataFrame operations only.

Two character models (first order, over CLASSES of characters, add-one smoothed) are counted from labelled samples:
random strings of the kinds that keys and tokens have, and ordinary identifiers. A candidate is a run of CANDIDATE
characters; its log-likelihood ratio is the sum of the logarithms of the ratio of transition probabilities, and it is a
span where the ratio is at least LEAST_RATIO, it has LEAST_DISTINCT different characters, and no rule's span overlaps it. What is counted are CLASSES x CLASSES numbers,
whatever the samples' size; only these travel to the driver and back, as a literal.

The labelled samples: SAMPLE random strings made from SHA-256 digests in four alphabets; and as ordinary identifiers
SAMPLE compounds of the word list below in four styles and the words of at least four letters of a bounded sample of
documents of at most 20,000 characters (most_chars of hashed_sample), taken by a hash of their text, of which the runs with a digit are left out, as they may be secrets.

Positions count code points. Java's split and extract give the pieces between and in the matches of one pattern; running
sums of their lengths are the positions.

Defined cases: null text is empty and has no spans; ties sort by start, then by kind as listed in KINDS; repeated rows and
rows with a null id are scanned each by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashed_sample, materialize

KINDS = ("assign", "access", "hex", "markov")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = rf"({_NAMES}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# runs that are long enough: as whole runs are matched, that is the same as matching them all and dropping short ones
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE, LEAST_RATIO, LEAST_DISTINCT = 8, 20.0, 8
SAMPLE, SAMPLE_DOCS = 4000, 1000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
WORDS = (
    "account action active address admin agent alpha amount array asset author batch block branch buffer build bucket button cache call "
    "channel check class client cluster code column commit config connection content context control count create current customer data "
    "database date default delete detail device directory document domain download driver edit element email enable encode engine entry "
    "error event export factory feature field file filter format frame function gateway global group handler header history host image "
    "import index input insert instance interface item job join key label language layer layout length level library limit line list load "
    "local lock log login manager map mask match memory message method metric mode model module monitor mount name network node notify "
    "number object offset option order output owner package page panel parameter parent parse partition path pattern payment permission "
    "plugin point policy pool port position prefix price process product profile project property protocol provider proxy public query "
    "queue range reader record region registry release remote render report request reset resource response result return role root route "
    "sample schedule schema scope screen script search section select sender server service session setting shape share signal size source "
    "stage start state status step storage store stream string style subject submit summary support switch symbol sync system table target "
    "task template test text thread time title topic total trace track transaction transfer type update upload user util validate value "
    "vector version view widget window worker write zone"
).split()


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label): label 1 for random strings, 0 for ordinary identifiers."""
    spark = docs.sparkSession
    made = spark.range(SAMPLE).select("id", F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    kind = F.col("id") % 4
    random = F.when(kind == 0, F.col("h")).when(kind == 1, b64).when(kind == 2, F.translate(b64, "+/", "-_")).otherwise(F.upper(F.conv(F.substring("h", 1, 15), 16, 36)))
    random = made.select(random.alias("token"), F.lit(1).alias("label"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = [F.element_at(words, (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(len(WORDS))) + 1).cast("int")) for i in range(4)]
    style = F.when(kind == 0, F.concat_ws("_", *pick)).when(kind == 1, F.concat_ws("-", *pick[:3])).when(kind == 2, F.concat(pick[0], *(F.initcap(p) for p in pick[1:]))).otherwise(F.concat_ws("/", *pick))
    plain = made.select(style.alias("token"), F.lit(0).alias("label"))
    few = hashed_sample(docs.select(F.col(text_col).cast("string").alias("text")), SAMPLE_DOCS)
    seen = few.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}(?![0-9A-Za-z])"), 0)).alias("token"), F.lit(0).alias("label"))
    return random.unionByName(plain).unionByName(seen)


def train(samples: DataFrame) -> list[float]:
    """samples: token, label. The log ratio of each transition between classes, row by row; class 0 is any other character."""
    chars = samples.where("length(token) > 1").select("label", F.split("token", "").alias("c"))
    cls = F.transform("c", lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = chars.select("label", cls.alias("k")).select("label", F.explode(F.zip_with(F.slice("k", F.lit(1), F.size("k") - 1), F.slice("k", F.lit(2), F.size("k") - 1), lambda a, b: a * CLASSES + b)).alias("at"))
    counts = {(r["label"], r["at"]): r["count"] for r in pairs.groupBy("label", "at").count().collect()}  # 2 * CLASSES^2 rows at most
    out = []
    for a in range(CLASSES):
        rows = [[counts.get((label, a * CLASSES + b), 0) + 1.0 for b in range(CLASSES)] for label in (0, 1)]
        sums = [sum(r) for r in rows]
        out += [round(log(rows[1][b] / sums[1]) - log(rows[0][b] / sums[0]), 4) for b in range(CLASSES)]
    return out


def _matches(text: Column, pattern: str, value_group: int | None = None) -> Column:
    """Array of (start, end, token), leftmost and not overlapping; token is the whole match, or a group of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group or 0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pieces = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("n"), value.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["n"]).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["n"]).alias("end"), x["v"].alias("token"))).alias("out"),
    )
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pieces, zero, step, lambda acc: acc["out"])).otherwise(none)


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token's transitions."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    k = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(values, acc["last"] * CLASSES + c)).alias("sum"))
    return F.aggregate(k, start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, base and spans, arrays of (start, k, end, kind) in order; base has the rules' spans."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    assign = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["token"]) >= LEAST_VALUE)
    rows = rows.select("doc_id", assign.alias("assign"), _matches(text, ACCESS).alias("access"), _matches(text, HEX).alias("hex"), _matches(text, CANDIDATE).alias("candidate"))

    def labelled(name: str) -> Column:
        return F.transform(name, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(name)).alias("k"), m["end"].alias("end"), F.lit(name).alias("kind")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*(labelled(k) for k in KINDS[:3]))))
    alone = F.filter("candidate", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    varied = F.filter(alone, lambda m: F.size(F.array_distinct(F.split(m["token"], ""))) >= LEAST_DISTINCT)
    markov = F.filter(varied, lambda m: ratio(m["token"], table) >= LEAST_RATIO)
    added = F.transform(markov, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("k"), m["end"].alias("end"), F.lit("markov").alias("kind")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).select("doc_id", "base", "spans")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scan(docs, train(materialize(labelled_samples(docs), "op3-samples")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
