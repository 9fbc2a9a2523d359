"""Small results as the lines of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line, text): ``df`` as a table in Markdown, its rows in order; a bar in a cell is escaped, null is empty.

    It is meant for counts and other results of a few rows: lines are numbered in one task.
    """
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line"), row.alias("text"))
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return df.sparkSession.createDataFrame(list(enumerate(head)), "line int, text string").unionByName(body)


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, line, text): tables of lines below a heading each, in the order given."""
    spark = next(iter(parts.values())).sparkSession
    heads = spark.createDataFrame([(k, -1, f"## {name}") for k, name in enumerate(parts)], "part int, line int, text string")
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("part"), "line", "text") for k, df in enumerate(parts.values())], heads)


def write_report(lines: DataFrame, path: str) -> None:
    """Write (part, line, text) as one text file in order, in place of what was there."""
    lines.repartition(1).sortWithinPartitions("part", "line").select("text").write.mode("overwrite").text(path)
