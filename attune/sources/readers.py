"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV with quotes doubled or escaped and line ends inside cells."""
    return spark.read.schema(schema).options(sep=sep, header=header, multiLine=True, escape='"', quote='"', enforceSchema=True).csv(path)


def read_positional(spark: SparkSession, path: str, columns: dict[str, tuple[str, int]], sep: str = ",") -> DataFrame:
    """Columns by position: name to (type, position); the positions between are read over."""
    last = max(p for _, p in columns.values())
    raw = spark.read.schema(", ".join(f"_p{i} STRING" for i in range(last + 1))).options(sep=sep, multiLine=True, escape='"').csv(path)
    return raw.select(*[F.col(f"_p{p}").cast(t).alias(n) for n, (t, p) in columns.items()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document that is an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON document keyed by id, as rows (key, value)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_xml(spark: SparkSession, path: str, schema: T.StructType | str, row_tag: str = "row") -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)


def read_aligned(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = True) -> DataFrame:
    """A table aligned by blanks; a header line is known by its first name."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.col("p")[0] != "")
    if header:
        parts = parts.where(F.col("p")[0] != columns[0][0])
    return parts.select(*[F.get("p", i).try_cast(t).alias(n) for i, (n, t) in enumerate(columns)])


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def read_tagged(spark: SparkSession, path: str, schema: str, pattern: str, name: str) -> DataFrame:
    """JSON lines of many files with a column taken from each file's path."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_log_range(spark: SparkSession, root: str, schema: str, first: str, last: str) -> DataFrame:
    """JSON logs of the files whose name holds a date (yyyy-mm-dd) from first to last."""
    logs = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(root)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)
    return logs.where(day.between(first, last))


def leaderboard_value(cell: Column) -> Column:
    """A cell as number: '-' and text are null, a percent sign is dropped."""
    return F.when(cell != "-", F.replace(cell, F.lit("%"), F.lit("")).try_cast("double"))


def parse_prompts(text: str) -> dict[str, str]:
    """``name: template`` lines of a small configuration; quotes are dropped, written line ends become real."""
    out = {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or ":" not in line:
            continue
        name, value = line.split(":", 1)
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[name.strip()] = value.replace("\\\\n", "\n").replace("\\n", "\n")
    return out
