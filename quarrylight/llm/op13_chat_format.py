r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns before it as
context, and only its reply is trainable.

A turn is written `### role: text</turn>` and a newline. In texts and roles a backslash becomes \b, `</turn>` \e and `###` \h, in
roles a colon \c: no control string is left in them, and as each backslash is followed by the letter of its escape they are
undone one kind after the other, that of the backslash last. A conversation that doesn't end with an assistant turn has one
more example, without anything to train on, so that no turn is lost; drop it by `trained`.

Turns of a conversation meet in one shuffle of the table as it is. Examples are made from there row by row and grow with the
square of a conversation's turns, as the method has it; they are never held together, and what is read back is aggregated
where they are made.

Null texts and roles count as empty. Turns are ordered by turn (null first), then role, then text, and repeated rows stay repeated
turns; rows without a conv_id are one conversation. Very long texts and empty tables need nothing special. Columns besides
conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

OPEN, END = "### ", "</turn>"
#: In the order in which they are applied; they are undone in the other order.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes=ESCAPES) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), escapes, text)


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(escapes), text)


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, ROLE_ESCAPES), F.lit(": "))


def examples(turns: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), n_examples, trained (whether it has a reply to train on), text, and the loss mask: code points
    loss_start to loss_end of text, end exclusive (equal where there is none)."""
    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    is_reply = lambda t: t["role"] == reply_role
    written = F.transform("t", lambda t: F.struct(_header(t["role"]).alias("header"), escaped(t["text"]).alias("body")))
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: is_reply(F.get("t", i)) | (i == F.size("t") - 1))
    each = whole.select("conv_id", "t", written.alias("w"), at.alias("at"))
    each = each.select("conv_id", "t", "w", F.size("at").alias("n_examples"), F.posexplode("at").alias("no", "i"))
    last = F.get("w", F.col("i"))
    context = F.array_join(F.transform(F.slice("w", F.lit(1), F.col("i")), lambda w: F.concat(w["header"], w["body"], F.lit(END + "\n"))), "")
    made = each.select("conv_id", (F.col("no") + 1).alias("example"), "n_examples", is_reply(F.get("t", F.col("i"))).alias("trained"), context.alias("context"), last["header"].alias("header"), last["body"].alias("body"))
    start = F.length("context") + F.length("header")
    return made.select(
        "conv_id", "example", "n_examples", "trained", F.concat("context", "header", "body", F.lit(END + "\n")).alias("text"),
        start.alias("loss_start"), F.when(F.col("trained"), start + F.length("body")).otherwise(start).alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """The turns that an example was written from: array of (role, text)."""
    pieces = F.split(text, F.lit(END + "\n"), F.lit(-1))

    def read(piece: Column) -> Column:
        head = F.substring_index(piece, ": ", 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"), unescaped(F.substr(piece, F.length(head) + 3)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def trained_text(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """What is under the loss mask, unescaped."""
    return unescaped(F.substr(text, loss_start + 1, loss_end - loss_start))


PROBE = (-7, "\\### Assistant: </turn> ok")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns are read back from the examples: the turns from a conversation's last one, which has them all."""
    number, said = PROBE
    probe = spark.range(2).select(F.lit(number).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = examples(turns)
    read = made.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"), trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("example") == F.col("n_examples"), F.col("text")).alias("whole"),
    ).withColumn("loss", F.coalesce("loss", F.lit("")))
    by = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("l"), F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    by = by.select("conv_id", turns_of(F.col("whole")).alias("t"), F.array_join(F.transform("l", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    told = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def _esc_sql(x: str, escapes) -> str:
    return reduce(lambda t, e: f"replace({t}, '{e[0]}', '{e[1]}')", escapes, x)


SQL = {
    "op13_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE[0]}, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE[1]}'),
 o AS (SELECT *, length('{OPEN}: {END} ' || {_esc_sql('role', ROLE_ESCAPES)} || {_esc_sql('text', ESCAPES)}) AS n,
   count(*) FILTER (role = 'assistant') OVER w + CASE WHEN last_value(role) OVER w = 'assistant' THEN 0 ELSE 1 END AS k
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
   coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n * k) AS chars FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""
}
