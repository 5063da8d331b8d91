"""Delimited text with physical line numbers and ragged rows, which Spark's own reader doesn't keep."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import JS_WS_CHARS

#: A quoted stretch: doubled quotes are quotes, line breaks belong to it.
_QUOTED = re.compile(r'"((?:[^"]|"")*)("?)')
_BREAK = re.compile(r"\r\n|\r|\n")


def parse(text: str, delimiter: str = ",") -> Iterator[tuple[int, list[str]]]:
    """(line, values) of each row, header included: the line it starts on, and its trimmed fields, however many.

    Quotes open a stretch only where the field is still empty, and what follows a stretch joins it. A row ends with LF,
    CRLF or CR; a last one without an end counts if it has any text or delimiter. An open quote at the end is an error.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter must be one character")
    plain = re.compile(rf"[^{re.escape(delimiter)}\r\n]+")
    at, line, start, field, row = 0, 1, 1, "", []
    while at < len(text):
        if text[at] == '"' and not field:
            found = _QUOTED.match(text, at)
            if not found[2]:
                raise ValueError(f"a quoted field that starts near line {start} is not closed")
            field = found[1].replace('""', '"')
            line += found[1].count("\n")
            at = found.end()
        elif text[at] == delimiter:
            row.append(field)
            field, at = "", at + 1
        elif found := _BREAK.match(text, at):
            yield start, [x.strip(JS_WS_CHARS) for x in [*row, field]]
            line += 1
            field, row, start, at = "", [], line, found.end()
        else:
            # up to a quote that could open a stretch: there is none once the field has text
            found = plain.match(text, at)
            field, at = field + found[0], found.end()
    if field or row:
        yield start, [x.strip(JS_WS_CHARS) for x in [*row, field]]


@F.udtf(returnType=T.StructType([T.StructField("line", T.IntegerType()), T.StructField("values", T.ArrayType(T.StringType()))]))
class ParseDelimited:
    def eval(self, text: str, delimiter: str):
        yield from parse(text, delimiter)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, line, values) of every row of the files at ``path``, the header among them. A file is one task's work."""
    spark.udtf.register("corvane_parse_delimited", ParseDelimited)
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    files.createOrReplaceTempView("corvane_delimited_files")
    return spark.sql("SELECT file, line, values FROM corvane_delimited_files, LATERAL corvane_parse_delimited(text, :delimiter)", args={"delimiter": delimiter})


def split_header(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """The header of a file (a byte-order mark is no part of it), and the other rows; a file without rows has none."""
    first = rows.orderBy("line").limit(1).collect()
    if not first:
        return [], rows
    return [h.strip(JS_WS_CHARS) for h in first[0]["values"]], rows.where(F.col("line") > first[0]["line"])


def as_map(headers: list[str], values: Column) -> Column:
    """A row as a map by header: missing fields are empty, further ones are dropped, of equal headers the last holds."""
    last = {h: i for i, h in enumerate(headers)}
    return F.map_from_arrays(F.array(*[F.lit(h) for h in last]), F.array(*[F.coalesce(F.get(values, i), F.lit("")) for i in last.values()])) if last else F.create_map().cast("map<string,string>")


def header_problems(headers: list[str], expected: list[str]) -> list[str]:
    """What is wrong with a header; none of it is fatal."""
    out = [f"expected {len(expected)} columns, got {len(headers)}"] if len(headers) != len(expected) else []
    return out + [f'column {i + 1}: expected "{name}", got "{headers[i] if i < len(headers) else ""}"' for i, name in enumerate(expected) if i >= len(headers) or headers[i] != name]
