"""The boundary to models: a small protocol, iterator functions that load once per worker, retries of failed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attune.storage import cut


class ModelClient(Protocol):
    """What a generator offers: one answer per pair of messages."""

    def query(self, system: list[str], user: list[str]) -> list[str]: ...


class EchoClient:
    """A deterministic stand-in: the words of the user message in reverse order."""

    def query(self, system: list[str], user: list[str]) -> list[str]:
        return [f"{s}{' '.join(reversed(u.split()))}" for s, u in zip(system, user, strict=True)]


def generate(factory: Callable[[], ModelClient], system: Column, user: Column, batch: int = 64) -> Column:
    """Answers of a model; the client is made once per Python worker. Null messages give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        client = factory()
        for s, u in batches:
            out = pd.Series([None] * len(u), dtype=object)
            known = [i for i, x in enumerate(u) if x is not None]
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                out.iloc[part] = client.query([s.iloc[i] or "" for i in part], [u.iloc[i] for i in part])
            yield out

    return run(system, user)


def classify(factory: Callable[[], Callable[[list[str]], list[float]]], text: Column) -> Column:
    """Probability of the first label; null texts give null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = factory()
        for s in batches:
            out = pd.Series([None] * len(s), dtype="float64")
            known = s.notna()
            out[known] = predict(list(s[known]))
            yield out

    return run(text)


def embed(factory: Callable[[], Callable[[list[str]], list[list[float]]]], text: Column) -> Column:
    """struct(vector, tokens, error) per text: an error is a value, not a failed job."""

    @F.pandas_udf("vector array<double>, tokens int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for s in batches:
            texts = [x or "" for x in s]
            try:
                v, e = model(texts), [None if x else "empty" for x in texts]
            except Exception as x:  # a broken batch is reported row by row
                v, e = [None] * len(texts), [type(x).__name__] * len(texts)
            yield pd.DataFrame({"vector": v, "tokens": [len(x.split()) for x in texts], "error": e})

    return run(text)


def map_chunks(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function over chunks of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return df.mapInPandas(run, schema)


def with_retries(df: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], good: Column, trials: int = 6) -> DataFrame:
    """Run ``attempt(rows, trial)`` on all rows, then again on the rows that are not ``good``; adds ``trial``.

    Rows keep their last answer when the trials run out. Each trial is cut from its lineage, so a retry never
    asks the model again about finished rows.
    """
    left, parts = df, []
    for trial in range(1, trials + 1):
        tried = cut(attempt(left, trial).withColumn("trial", F.lit(trial)))
        ok = F.coalesce(good, F.lit(False))
        bad = tried.where(~ok)
        if trial == trials or bad.isEmpty():
            parts.append(tried)
            break
        parts.append(tried.where(ok))
        left = df.join(bad.select(key), key, "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Scorers by name: a new one registers itself and is then usable from configuration.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(*names: str) -> Callable:
    def add(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        for n in names:
            SCORERS[n] = f
        return f

    return add


@scorer("length_ratio")
def length_ratio(reference: Column, candidate: Column) -> Column:
    return F.when(F.length(reference) > 0, F.length(candidate) / F.length(reference))


@scorer("edit_similarity", "levenshtein")
def edit_similarity(reference: Column, candidate: Column) -> Column:
    n = F.greatest(F.length(reference), F.length(candidate))
    return F.when(n > 0, 1 - F.levenshtein(reference, candidate) / n)
