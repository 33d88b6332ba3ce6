"""Fill-in-the-middle: cut a text at two units that its id's hash picks and put the pieces in another order.

All in Spark's own functions, a row at a time and without a shuffle: regexp_extract_all makes the array of units, hexadecimal
groups of sha2 give the cuts, slices of the array become the pieces, and substring_index finds the sentinels again to rebuild
the text. A row is worked on alone, so skew of ids or sources does no harm; memory is that of one text's units.

Null texts count as empty. Empty texts, and texts that hold a sentinel themselves, stay plain. A null id has the empty string in
place of its decimals; rows that share an id are cut by the same numbers, each on its own text. Very long texts are cut whole;
ties don't arise. Columns besides id and text are not read. An id must be a number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed_texts

#: Runs of ASCII letters, and every other code point alone.
UNIT = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Sentinels:
    """What stands before prefix, suffix and middle: each begins with '<', ends with '>' and has neither in between, so that
    none can begin inside another or where one meets a piece."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = self.all()
        if len(set(every)) < 3 or any(len(s) < 3 or s[0] != "<" or s[-1] != ">" or set(s[1:-1]) & set("<>") for s in every):
            raise ValueError("sentinels must be three different strings like <P>")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def group(id_: Column, i: int, seed: int = 1) -> Column:
    """The i-th (from 1) of the 8-digit groups of sha256 of 'seed:id', as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, sentinels: Sentinels = Sentinels(), rate: int = 90, spm_rate: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null where form is plain) and output. rate: of 100 texts so many are
    cut; spm_rate: of 100 that are cut so many put the suffix first."""
    p, s, m = sentinels.all()
    rows = keyed_texts(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    holds = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | holds | (group(F.col("doc_id"), 3, seed) % 100 >= rate)
    form = F.when(plain, "plain").when(group(F.col("doc_id"), 4, seed) % 100 < spm_rate, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), form.alias("form"))
    cut = cut.withColumn("n", F.size("units").cast("long"))
    one, two = (group(F.col("doc_id"), i, seed) % (F.col("n") + 1) for i in (1, 2))
    cut = cut.withColumns({"lo": F.least(one, two).cast("int"), "hi": F.greatest(one, two).cast("int")})

    def piece(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, length), ""))

    lo, hi = F.col("lo"), F.col("hi")
    pieces = cut.select(
        "doc_id", "n", "form", "text", piece(F.lit(0), lo).alias("prefix"), piece(lo, hi - lo).alias("middle"), piece(hi, F.col("n").cast("int") - hi).alias("suffix"),
    )
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return pieces.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output was made from. Pieces hold no sentinel, so the first of each kind is where a piece ends."""
    p, s, m = sentinels.all()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    of_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", of_psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_H = ", ".join(f"CAST('0x' || h[{8 * i - 7}:{8 * i}] AS BIGINT) AS h{i}" for i in range(1, 5))
SQL = {
    "op12_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 g AS (SELECT doc_id, t, u, len(u) AS n, {_H} FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
 p AS (SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS pre, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS mid, coalesce(array_to_string(u[hi + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
}
