"""What is written for readers: canonical saves of rows, and reports as JSON, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.sources import files


def save(rows: DataFrame, order: list[str], root: str) -> int:
    """rows as canonical JSON lines in the order given, a new version behind the pointer; unchanged rows give equal lines.

    Columns stand in the order of their names, so two writers of the same rows write the same. The pointer moves once all
    is there, which is what renaming a finished file is to a single one.
    """
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return files.publish(ranged.select(line.alias("line")), root)


def saved(spark: SparkSession, root: str) -> DataFrame:
    """(line) of the current save."""
    return files.current(spark, root)


def _cell(c: str) -> Column:
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\\\|"), r"[\r\n]+", " ")


def markdown(rows: DataFrame, order: list[str], title: str) -> DataFrame:
    """(part, line): a title, a head, and a row of a Markdown table for each row, in order within part 1; bars are escaped."""
    spark = rows.sparkSession
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    top = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, place long, line string")
    body = rows.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, rows.columns)), F.lit(" |")).alias("line"))
    ordered = body.repartitionByRange(*order).sortWithinPartitions(*order)
    return top.unionByName(ordered.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("place"), "line"))


def report(rows: DataFrame, order: list[str], title: str, folder: str) -> None:
    """A report's three forms below a folder: json, csv with a head, and markdown as text; each in the order given."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("errorifexists").json(f"{folder}/json")
    ranged.write.mode("errorifexists").option("header", True).csv(f"{folder}/csv")
    lines = markdown(rows, order, title)
    lines.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("line").write.mode("errorifexists").text(f"{folder}/markdown")
