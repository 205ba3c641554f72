"""Encoding of a whole corpus with a public byte-level BPE vocabulary (rank file) through tiktoken."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attune.llm.common import spread

#: Where the public vocabularies lie on every executor; a parameter of each operator.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Unicode White_Space, which is what ``\s`` means in the pattern above.
SPACE = "\t-\r \x85\xa0  -     　"
#: No piece of the pattern runs from a visible character over a following blank: cutting there is safe.
_SAFE = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Blank runs of this length are taken out of the regular expression, whose engine recurses over them.
LONG_BLANKS = 2_000
_BLANKS = re.compile(f"[{SPACE}]{{{LONG_BLANKS},}}")
#: Characters after which a long text is cut at the next safe place.
CHUNK = 1 << 16


@functools.cache
def encoding(path: str):
    """The tiktoken encoding of a rank file; read once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("attune", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """``text`` cut at safe places only, each part about ``size`` characters or one unbreakable run longer."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(enc, text: str | None) -> list[int]:
    """Ids of one text, without special tokens; null and empty texts give the empty list."""
    if not text:
        return []
    if len(text) < LONG_BLANKS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part in chunks(text):
        at = 0
        for m in _BLANKS.finditer(part):
            # the pattern leaves the last blank before a visible character to the next piece
            end = m.end() if m.end() == len(part) else m.end() - 1
            out += enc.encode_ordinary(part[at : m.start()])
            out += enc._encode_single_piece(part[m.start() : end])
            at = end
        out += enc.encode_ordinary(part[at:])
    return out


def decode(enc, ids: list[int]) -> str:
    """Text of the ids through their raw bytes, so characters split over tokens come back whole."""
    return b"".join(enc.decode_tokens_bytes(ids)).decode("utf-8", errors="strict")


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str, rows: int = 500) -> DataFrame:
    """``key`` and ``ids`` (list of INT) of every row; null and empty texts give ``[]``.

    Narrow: one map over Arrow batches, only the two columns are read, no shuffle unless the input has
    too few splits to keep the cores busy. Results leave in slices of ``rows`` to bound a worker's memory.
    Repeated rows each give a row; other columns are ignored. An empty table gives an empty result.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        import pyarrow as pa

        enc = encoding(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [encode(enc, t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """Report of the exact round trip: rows, tokens, texts whose decoded ids differ (0 when lossless)."""
    kind = df.schema[key].dataType

    def run(batches):
        import pyarrow as pa

        enc = encoding(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [encode(enc, t) for t in texts]
            bad = [decode(enc, i) != (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(bad)], names=[key, "n_tokens", "differs"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("differs", T.BooleanType())])
    each = spread(df.select(key, text)).mapInArrow(run, schema)
    return each.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.col("differs").cast("long")), F.lit(0)).alias("n_differing"),
    )
