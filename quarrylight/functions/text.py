"""Scalar functions as Columns: code tokens, keywords, intents, roles, line slices. Nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and their order decide results.
IDENTIFIER = r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*"
KEYWORD = "[A-Za-z][A-Za-z0-9_]*"
STOP_WORDS = (
    "a an and are as at be been by can do does for from has have how i if in is it its me not of on or our please show so tell that the "
    "their them then there this to us using was we what when where which who why will with you"
).split()
INTENTS = (
    ("trace", ("trace", "follow", "path", "flow", "route request", "request to")),
    ("explain", ("explain", "how does", "what does", "describe", "how is")),
    ("find", ("where is", "where does", "find", "locate", "which file")),
)
ROLES = (
    ("entry_point", "endpoint|route|handler|view"),
    ("auth", "auth|verify|validate|require|check|token"),
    ("service", "service|svc"),
    ("repository", "repositor|repo|find_by|update_user|fetch"),
    ("database", "database|db|execute|query|write|connect"),
    ("config", "config|setting"),
    ("error_handler", "error|exception"),
)
ROLE_PRIORITY = {"database": 0, "repository": 1, "service": 2, "auth": 3, "general": 4}

#: What an identifier has that is more than one token; without it the token is all that _expand gives.
_SEVERAL = "[._]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
#: Texts without it have no such identifier: dots count only between letters and digits.
_PLAIN = r"_|[A-Za-z0-9]\.[A-Za-z0-9]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
_ITEM = "array<struct<t:string,full:boolean>>"


def _none() -> Column:
    return F.array().cast(_ITEM)


def _sub(t: Column) -> Column:
    return F.struct(F.lower(t).alias("t"), F.lit(False).alias("full"))


def split_camel(word: Column) -> Column:
    """A word with '_' at its camel-case boundaries."""
    return F.regexp_replace(F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")


def _camel_parts(word: Column) -> Column:
    cut = split_camel(word)
    parts = F.transform(F.filter(F.split(cut, "_"), lambda x: x != ""), _sub)
    return F.when(F.contains(cut, F.lit("_")), parts).otherwise(_none())


def _snake_parts(name: Column) -> Column:
    snake = F.contains(name, F.lit("_"))
    words = F.filter(F.split(name, "_"), lambda x: x != "")
    return F.flatten(F.transform(words, lambda w: F.concat(F.when(snake, F.array(_sub(w))).otherwise(_none()), _camel_parts(w))))


def _expand(raw: Column) -> Column:
    dotted = F.contains(raw, F.lit("."))
    whole = F.array(F.struct(F.lower(raw).alias("t"), F.lit(True).alias("full")))
    parts = F.transform(F.split(raw, r"\."), lambda p: F.concat(F.when(dotted, F.array(_sub(p))).otherwise(_none()), _snake_parts(p)))
    return F.when(raw.rlike(_SEVERAL), F.concat(whole, F.flatten(parts))).otherwise(whole)


def tokenize(text: Column) -> Column:
    """Search tokens of code or prose: each dotted identifier in lower case, then its parts. A part that repeats the token
    before it is left out, a whole identifier never; as a dropped part equals its predecessor, looking one back suffices."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    every = F.flatten(F.transform(found, _expand))
    kept = F.transform(F.array(every), lambda xs: F.filter(xs, lambda x, i: x["full"] | (x["t"] != F.get(xs, i - 1)["t"])))
    general = F.transform(F.get(kept, F.lit(0)), lambda x: x["t"])
    return F.when(text.rlike(_PLAIN), general).otherwise(F.transform(found, lambda w: F.lower(w)))


def spelled(text: Column) -> Column:
    """A text whose identifiers, in lower case, are the tokens of this one: itself where no identifier has parts."""
    return F.when(text.rlike(_PLAIN), F.array_join(tokenize(text), " ")).otherwise(F.coalesce(text, F.lit("")))


def extract_keywords(question: Column) -> Column:
    """Words that are no stop words, each once in its first casing."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(KEYWORD), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    content = F.filter(found, lambda w: ~F.array_contains(stop, F.lower(w)))
    lowered = F.transform(content, lambda w: F.lower(w))
    both = F.struct(content.alias("c"), lowered.alias("l"))
    return F.get(F.transform(F.array(both), lambda b: F.filter(b["c"], lambda w, i: F.array_position(b["l"], F.lower(w)) == i + 1)), F.lit(0))


def detect_intent(question: Column) -> Column:
    low = F.lower(question)
    out = F
    for intent, words in INTENTS:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(intent))
    return out.otherwise(F.lit("search"))


def detect_role(name: Column) -> Column:
    low, out = F.lower(name), F
    for role, pattern in ROLES:
        out = out.when(low.rlike(pattern), F.lit(role))
    return out.otherwise(F.lit("general"))


def role_priority(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])[role], F.lit(5))


def last_part(symbol_id: Column) -> Column:
    return F.element_at(F.split(symbol_id, "::"), -1)


def is_class_only(symbol_id: Column) -> Column:
    """file::Name without a dot and with a capital: a class rather than a method or function."""
    name = last_part(symbol_id)
    head = F.substring(name, 1, 1)
    return F.contains(symbol_id, F.lit("::")) & ~F.contains(name, F.lit(".")) & (F.upper(head) != F.lower(head)) & (head == F.upper(head))


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both included), cut to what there is, joined by newlines."""
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise(F.lit(""))


def module_name(file: Column) -> Column:
    """a/b.py -> a.b"""
    return F.regexp_replace(F.translate(F.regexp_replace(F.translate(file, "\\", "/"), r"\.py$", ""), "/", "."), r"^\.+|\.+$", "")


def format_import(module: Column, name: Column, alias: Column) -> Column:
    base = F.when(F.coalesce(module, F.lit("")) != "", F.concat(F.lit("from "), module, F.lit(" import "), name)).otherwise(F.concat(F.lit("import "), name))
    return F.concat(base, F.when(F.coalesce(alias, F.lit("")) != "", F.concat(F.lit(" as "), alias)).otherwise(F.lit("")))


def format_issue(severity: Column, evidence_id: Column, message: Column) -> Column:
    return F.format_string("[%s] evidence=%s: %s", severity, evidence_id, message)


def short_file(path: Column) -> Column:
    """The last two components of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)), F.lit(2)), "/")


def pluralise(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def summarise(text: Column, most: int = 200) -> Column:
    return F.when(text.isNull(), F.lit("No data returned.")).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def quoted(text: Column) -> Column:
    """A string as Python shows it: in single quotes, or in double ones where it has a single and no double one."""
    shown = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), text)
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("\\'")), F.lit("'")))


def quoted_list(items: Column, show=quoted) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, show), ", "), F.lit("]"))


def has_any(text: Column, words) -> Column:
    """Whether a text has one of some words in any case; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
