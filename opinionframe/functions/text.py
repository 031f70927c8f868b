"""Column expressions over text. All stay in the JVM; nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` knows it, for Java's regular expressions.
WHITE_SPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def strip(t: Column) -> Column:
    """``t`` without white space of any kind at both ends."""
    return F.regexp_replace(t, rf"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def tokens(t: Column) -> Column:
    """Lower-case pieces between white space of any kind."""
    return F.filter(F.split(F.lower(t), WHITE_SPACE + "+"), lambda x: F.length(x) > 0)


def clean_text(t: Column) -> Column:
    """Literal \\n to a space, a space after punctuation, a space for other marks, runs of white space to one space."""
    t = F.regexp_replace(t, r"\\n", " ")
    t = F.regexp_replace(t, r"(?U)(?<=[.,!?;:])(?=[^\s\x{1c}-\x{1f}])", " ")
    t = F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}.,!?;:-]", " ")
    return strip(F.regexp_replace(t, WHITE_SPACE + "{2,}", " "))


def plain_sentences(t: Column) -> Column:
    """Pieces between runs of . ! ?, trimmed; the whole text if there are none."""
    parts = F.filter(F.transform(F.split(t, r"[.!?]+"), strip), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(t)))


def words(t: Column) -> Column:
    """Lower-case words between white space, without marks but hyphens; empty ones dropped."""
    return F.filter(F.transform(F.split(F.lower(t), r"(?U)\s+"), lambda x: F.regexp_replace(x, r"(?U)[^\w-]", "")), lambda x: F.length(x) > 0)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces; empty if there are fewer."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def phrase_candidates(tokens: Column, shortest: int = 3) -> Column:
    """Single words of at least ``shortest`` letters and pairs of such, each once, in order.

    Give it a column of words, not the expression: each use of an expression is worked out again.
    """
    long_ = F.filter(tokens, lambda x: F.length(x) >= shortest)
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    both = F.zip_with(F.slice(tokens, F.lit(1), rest), F.slice(tokens, F.lit(2), rest), lambda x, y: F.when((F.length(x) >= shortest) & (F.length(y) >= shortest), F.concat_ws(" ", x, y)))
    return F.array_distinct(F.concat(long_, F.filter(both, lambda p: p.isNotNull())))


def normal_form(t: Column) -> Column:
    return F.array_join(F.filter(F.split(F.regexp_replace(F.lower(t), "-", " "), r"(?U)\s+"), lambda x: F.length(x) > 0), " ")


def contains_term(t: Column, term: Column) -> Column:
    """Whether the words of ``term`` stand side by side in ``t``."""
    return F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def null_like(t: Column) -> Column:
    """Null where a cell says so in words."""
    return F.when(~F.upper(F.trim(t)).isin("", "NONE", "NULL", "NAN", "NA"), F.trim(t))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by bars; a null part is the word None."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, 16)


def label_map(t: Column) -> Column:
    """A dict literal or JSON object of ratings as a map; empty where it can't be read; blank keys and null values drop."""
    m = F.from_json(F.regexp_replace(t, r"\bNone\b", "null"), "map<string,double>", {"allowSingleQuotes": "true"})
    return F.coalesce(F.map_filter(m, lambda k, v: (F.length(F.trim(k)) > 0) & v.isNotNull()), F.create_map().cast("map<string,double>"))
