"""Writers and print forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").options(sep=sep, header=header, escape='"', quote='"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(df: DataFrame, path: str) -> None:
    """One text column, a line a row."""
    df.write.mode("overwrite").text(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row") -> None:
    df.write.mode("overwrite").option("rowTag", row_tag).option("rootTag", "rows").format("xml").save(path)


def ordered(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in a canonical order; names the table lacks are passed over, others follow in their order."""
    have = [n for n in names if n in df.columns]
    return df.select(*have, *[c for c in df.columns if c not in have])


def marked(value: Column, p: Column, mark: str = "†") -> Column:
    """Three decimals, a mark where p < 0.05, '-' for null."""
    return F.when(value.isNull(), "-").otherwise(F.concat(F.format_string("%.3f", value), F.when(p < 0.05, mark).otherwise("")))


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A Markdown table of a small report (at most ``limit`` rows are fetched)."""
    rows = df.limit(limit).collect()
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
