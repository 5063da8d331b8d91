"""Paged JSON exports: which files, which page, which records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import fields
from corvane.schemas import PAGE_ITEM

PAGE_FILE = r"(?i)^page[_-]?[0-9]+\.json\z"
#: Where a payload's records are looked for first, in this order.
RECORD_PATHS = (("data",), ("items",), ("results",), ("companies",), ("records",), ("organizations",), ("data", "items"), ("data", "results"), ("data", "companies"), ("data", "records"))
DEPTH = 5


def page_number(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, "(?i)page[_-]?([0-9]+)", 1), F.lit("")).try_cast("int")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, source_page, text) of the page files in a folder; their order is that of page, then name."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[jJ][sS][oO][nN]").select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    return files.where(F.col("source_file").rlike(PAGE_FILE)).withColumn("source_page", page_number(F.col("source_file")))


def items(pages: DataFrame) -> DataFrame:
    """(source_file, source_page, source_row, item) of pages whose records stand under ``items`` in the usual shape.

    All JVM-side. A file that is no JSON makes the job fail.
    """
    parsed = pages.select("source_file", "source_page", F.from_json("text", f"items array<{PAGE_ITEM.simpleString()}>", {"mode": "FAILFAST"}).alias("p"))
    return parsed.select("source_file", "source_page", F.posexplode("p.items").alias("source_row", "item")).withColumn("source_row", F.col("source_row") + 1)


def _objects(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)]


def _lists(value, depth: int = 0) -> Iterator[list[dict]]:
    """Lists with objects among what is nested in objects, in document order; lists aren't searched themselves."""
    if depth > DEPTH:
        return
    if isinstance(value, list):
        if found := _objects(value):
            yield found
    elif isinstance(value, dict):
        for nested in value.values():
            yield from _lists(nested, depth + 1)


def locate_records(payload) -> list[dict]:
    """The records of a payload: a list itself, the first list at a usual path, or the nested list that looks most like
    companies (its size times the best likeness of its first ten; the first of equals)."""
    if isinstance(payload, list):
        return _objects(payload)
    if not isinstance(payload, dict):
        return []
    for path in RECORD_PATHS:
        value = payload
        for step in path:
            value = value.get(step) if isinstance(value, dict) else None
        if isinstance(value, list):
            return _objects(value)
    best = max(_lists(payload), key=lambda records: len(records) * max(map(fields.likeness, records[:10])), default=[])
    return best


@F.pandas_udf(T.ArrayType(T.StringType()))
def _located(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [json.dumps(r, ensure_ascii=False) for r in locate_records(json.loads(t))], na_action="ignore")


def records(pages: DataFrame) -> DataFrame:
    """(source_file, source_page, source_row, record) of pages of any shape, each record as JSON; a page without any
    has one row without record and number."""
    return pages.select("source_file", "source_page", F.posexplode_outer(_located("text")).alias("source_row", "record")).withColumn("source_row", F.col("source_row") + 1)
