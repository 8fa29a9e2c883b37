"""Small results as JSON rows and as a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A report is read by people; a larger result belongs in a table.
MOST_ROWS = 1000


def write_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def markdown(report: DataFrame, title: str) -> str:
    rows = report.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def overall(checks: DataFrame) -> DataFrame:
    """FAIL for any failed or missing required check, WARNING for any warning, else PASS."""
    bad = F.count_if(F.col("status").isin("FAIL", "NOT_RUN") & F.col("required"))
    warn = F.count_if(F.col("status").isin("WARNING", "NOT_RUN"))
    return checks.agg(F.when(bad > 0, "FAIL").when(warn > 0, "WARNING").otherwise("PASS").alias("overall"))
