"""Date, number, array and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(epoch: Column, zone: str = "America/Los_Angeles", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text in a time zone; the session runs in UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone), pattern)


def fisher_z(r: Column) -> Column:
    """Fisher's z; infinite at plus and minus one, null outside."""
    inf = F.lit(float("inf"))
    return F.when(r == 1, inf).when(r == -1, -inf).when(F.abs(r) < 1, F.atanh(r))


def inverse_fisher(z: Column) -> Column:
    return F.tanh(z)


def half_up(x: Column) -> Column:
    """int(x + 0.5)."""
    return F.floor(x + 0.5)


def keep_positive(values: Column) -> Column:
    return F.filter(values, lambda x: x > 0)


def votes_or_all(models: Column, label: Column) -> Column:
    """Structs whose ``pred`` equals the label, or all if none does."""
    agreeing = F.filter(models, lambda m: m["pred"] == label)
    return F.when(F.size(agreeing) > 0, agreeing).otherwise(models)


def word_max(tokens: Column, start: Column, end: Column) -> Column:
    """Largest ``v`` of the tokens (s, e, v) inside start..end; null if none is."""
    return F.array_max(F.transform(F.filter(tokens, lambda t: (t["s"] >= start) & (t["e"] <= end)), lambda t: t["v"]))


def zip_skip_empty(tokens: Column, scores: Column) -> Column:
    """Pairs up to the shorter length, without empty tokens."""
    n = F.least(F.size(tokens), F.size(scores))
    pairs = F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("token"), F.slice(scores, F.lit(1), n).alias("score"))
    return F.filter(pairs, lambda p: p["token"] != "")


def regroup(values: Column, n: int) -> Column:
    """Consecutive groups of n (the last may be shorter); empty for an empty list."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(n)), lambda i: i < F.size(values))
    return F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(n)))


def upper_triangle(values: Column) -> Column:
    """Pairs (i < j) of a list's elements."""
    return F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 2, F.size(values)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def entries_by_value(m: Column) -> Column:
    """Entries of a map by value, then key."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key")))), lambda s: F.struct(s["key"].alias("key"), s["value"].alias("value")))


def entries_by_key(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def updated(a: Column, b: Column) -> Column:
    """Entries of both maps; those of ``b`` win, whatever the session's policy on equal keys is."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def any_empty(m: Column) -> Column:
    return F.exists(F.map_values(m), lambda v: v == "")


def turns(messages: Column, offset: int, roles: tuple[str, str] = ("user", "assistant")) -> Column:
    """Messages from an offset as structs (role, content), roles by parity."""
    rest = F.slice(messages, offset + 1, F.greatest(F.size(messages), F.lit(1)))
    return F.transform(rest, lambda x, i: F.struct(F.when(i % 2 == 0, roles[0]).otherwise(roles[1]).alias("role"), x.alias("content")))
