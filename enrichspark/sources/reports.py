"""Report files: tables as JSON, CSV or TSV by Spark, and small Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def markdown(df: DataFrame, max_rows: int = 200) -> str:
    """A report table as Markdown; refuses a table that is not small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a Markdown report holds at most {max_rows} rows; write the table with write_delimited")

    def cell(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
