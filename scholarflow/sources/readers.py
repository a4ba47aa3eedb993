"""Readers for landed files. Fetching itself is left to the caller."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators.papers import clean_ids

PAPER_FILE_COLUMNS = {
    "file_name": "string", "semantic_id": "string", "title": "string", "date": "string",
    "authors": "array<string>", "year": "int", "venue": "string", "venue_short": "string",
    "abstract": "string", "citation_count": "bigint", "external_ids": "map<string,string>",
    "_corrupt": "string",
}


def file_name() -> Column:
    return F.col("_metadata.file_name")


def file_key(name: Column | str, suffix: str = "") -> Column:
    """Key from a file name: no extension, and without ``suffix`` before it."""
    stem = X.drop_extension(name)
    return X.without(stem, suffix) if suffix else stem


def file_keys(
    spark: SparkSession, path: str, *, ends_with: tuple[str, ...], suffix: str = ""
) -> DataFrame:
    """(key): keys of the files in a directory that have one of the endings.

    Only names are read: the binary source prunes the content column.
    """
    name = file_name()
    wanted = F.lit(False)
    for end in ends_with:
        wanted = wanted | F.endswith(name, F.lit(end))
    files = spark.read.format("binaryFile").load(path)
    return files.where(wanted).select(file_key(name, suffix).alias("key"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): one id per line, stripped; blank lines are no ids."""
    return clean_ids(spark.read.text(path))


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(journal, name_short, ordinal) of CSV files, by column name.

    ``ordinal`` orders rows by file name and then by their order in the file.
    Doubled quotes inside a quoted name stand for one.
    """
    rows = spark.read.csv(path, header=True, escape='"')
    place = F.struct(file_name().alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.select("journal", "name_short", place.alias("ordinal"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, markdown): one row per file, keyed by its name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(file_key(file_name()).alias("doc_id"), F.col("value").alias("markdown"))


def read_answers(spark: SparkSession, path: str, *, suffix: str = "") -> DataFrame:
    """(paper_id, payload): landed JSON answers, one file per paper."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(
        file_key(file_name(), suffix).alias("paper_id"), F.col("value").alias("payload")
    )


def read_edge_files(spark: SparkSession, path: str, direction: str) -> DataFrame:
    """(paper_id, direction, payload) from files named <id>-<direction>.json."""
    rows = read_answers(spark, path, suffix=f"-{direction}")
    return rows.select("paper_id", F.lit(direction).alias("direction"), "payload")


def read_paper_files(
    spark: SparkSession, path: str, *, endings: tuple[str, ...] = (".yaml", ".yml", ".json")
) -> DataFrame:
    """Paper records from one YAML or JSON file each.

    A file that cannot be parsed gives a row with only ``file_name``,
    ``semantic_id`` (the file's stem) and the message in ``_corrupt``.
    """
    pattern = "*{" + ",".join(endings) + "}"
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(file_name().alias("file_name"), file_key(file_name()).alias("stem"), "value")
    )
    schema = ", ".join(f"{c} {t}" for c, t in PAPER_FILE_COLUMNS.items())
    rows = files.mapInPandas(_record_parser(), schema)
    return rows.withColumn("date", F.expr("try_to_date(date)"))


def _record_parser():
    """Parser of (file_name, stem, value) batches; a closure, so that it is
    shipped to the executors whole and this package need not be there."""
    columns = list(PAPER_FILE_COLUMNS)

    def text(value):
        return None if value is None else str(value)

    def number(value):
        return value if isinstance(value, int) and not isinstance(value, bool) else None

    def parse(name: str, stem: str, content: str) -> dict:
        import yaml

        row = dict.fromkeys(columns) | {"file_name": name, "semantic_id": stem}
        try:
            data = json.loads(content) if name.endswith(".json") else yaml.safe_load(content)
            ids = data.get("external_ids") or {}
            row |= {c: text(data.get(c)) for c in ("title", "date", "venue", "venue_short", "abstract")}
            row |= {
                "authors": [str(a) for a in data.get("authors") or []],
                "year": number(data.get("year")),
                "citation_count": number(data.get("citation_count")),
                "external_ids": {str(k): text(v) for k, v in ids.items()},
            }
        except Exception as e:  # noqa: BLE001 - recorded per file
            row["_corrupt"] = f"{type(e).__name__}: {e}"
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse(*r) for r in batch[["file_name", "stem", "value"]].itertuples(index=False)]
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            for c in ("year", "citation_count"):
                out[c] = out[c].astype("Int64")
            yield out

    return run
