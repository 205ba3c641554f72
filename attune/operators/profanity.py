"""Words of a list in text, also when written with look-alike characters, by joining on a coarse normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.functions.text import LOOKALIKES

#: Characters that may stand for one another fall into one class, so the form is the same for every reading.
_CLASS_FROM, _CLASS_TO = "@4*i1!lo0uve3$57", "aaaaaaaaaaaaasst"

#: Characters of tokens, and of words: letters and marks of every script, digits, stand-ins, quotes.
_TOKEN, _WORD = "A-Za-z0-9@$*!", r"\p{L}\p{M}0-9@$*\"'"


def _classes(w: Column) -> Column:
    return F.translate(F.lower(w), _CLASS_FROM, _CLASS_TO)


def coarse(w: Column) -> Column:
    """A form that a word and all its spellings share: ambiguous characters in one class, repeats once."""
    return F.regexp_replace(_classes(w), r"(.)\1+", "$1")


def spells(token: Column, word: Column) -> Column:
    """Whether a token is the word under the look-alike table, character by character."""
    same = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in LOOKALIKES.items()], c)
    # no lambda refers to a column: Spark numbers lambda variables from 0 when it compares conditions, so a column
    # with such a number is taken for one and the condition is pushed to a side that lacks the column
    letters, allowed = F.split(F.lower(token), ""), F.transform(F.split(F.lower(word), ""), same)
    return (F.length(token) == F.length(word)) & F.forall(F.zip_with(letters, allowed, lambda t, a: F.contains(a, t)), lambda x: x)


def matches(df: DataFrame, key: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """(key, token, word) of every token that spells a listed word. Null texts give none; repeats stay once.

    Tokens and words meet by an equi-join on their coarse form and the look-alike table decides; the list is
    broadcast by the planner only if it is small.
    """
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{_TOKEN}]+)"), F.lit(1))).alias("token")).distinct()
    listed = words.select(F.lower(word).alias("word")).where("word IS NOT NULL AND word <> ''").distinct().withColumn("_f", coarse(F.col("word")))
    return tokens.withColumn("_f", coarse(F.col("token"))).join(listed, "_f").where(spells(F.col("token"), F.col("word"))).select(key, "token", "word")


def phrases(text: Column, following: int, longest: int) -> Column:
    """Every word of a text with the words that follow it, as written, unless one of them is longer than ``longest``."""
    w = rf"[{_WORD}]{{1,{longest}}}+(?![{_WORD}])"
    return F.regexp_extract_all(text, F.lit(rf"(?<![{_WORD}])(?=({w}(?:[^{_WORD}]++{w}){{{following}}}))[{_WORD}]++"), F.lit(1))


def walk(df: DataFrame, key: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """(key, token, word) as ``matches``, and of every word of a text that spells a listed word alone or joined with the next ones.

    Words are joined without and with what stands between them, and the token is the first of them, as in the original
    walk. As many next words are joined as the listed word with most separators has, at least one. Here every word begins a
    phrase and the last one of a text may end one; the original steps over some that do. Quotes and letters of all
    scripts belong to words, so tokens of ``matches`` that they part are compared as well.
    """
    listed = words.select(F.lower(F.trim(word)).alias("word")).where("word <> ''").distinct()
    most = listed.agg(F.max(F.length(F.regexp_replace("word", f"[{_WORD}]", ""))).alias("separators"), F.max(F.length("word")).alias("longest")).first()
    separators, longest = most["separators"] or 0, most["longest"] or 1
    parted = F.regexp_extract_all(text, F.lit(rf"(?<![{_TOKEN}])((?<=[{_WORD}])[{_TOKEN}]++|[{_TOKEN}]++(?=[{_WORD}])|[{_WORD}&&[{_TOKEN}]]*+![{_TOKEN}]*+)"), F.lit(1))
    read = F.array(parted, *[phrases(F.col(text), n, longest) for n in range(max(separators, 1) + 1)])
    t = df.select(key, F.posexplode(read).alias("_n", "_p")).select(key, "_n", F.explode("_p").alias("_p"))
    joined = F.when(F.col("_n") < 2, F.col("_p")).otherwise(F.regexp_replace("_p", f"[^{_WORD}]+", ""))
    # an exploded array is computed once, a projected column again in every filter above it
    forms = F.array_distinct(F.array(F.lower(joined), F.lower("_p"))) if separators else F.array(F.lower(joined))
    t = t.withColumn("_form", F.explode(forms)).where(F.length("_form") <= longest).withColumn("_f", F.explode(F.array(_classes(F.col("_form")))))
    met = t.join(listed.withColumn("_f", _classes(F.col("word"))), "_f").where(spells(F.col("_form"), F.col("word")))
    token = F.when(F.col("_n") < 2, F.col("_p")).otherwise(F.regexp_extract("_p", f"^[{_WORD}]+", 0))
    return met.select(key, token.alias("token"), "word").distinct()
