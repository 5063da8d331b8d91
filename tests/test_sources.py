import json

import pytest
from pyspark.sql import functions as F

from corvane.sources import delimited, pages


def test_quotes_breaks_and_lines():
    text = '﻿id,name\r\n"1","a ""b"", c"\r\n,,\r\n\n2,"two\nlines"x\r3, y "q" \n'
    assert list(delimited.parse(text)) == [(1, ["id", "name"]), (2, ["1", 'a "b", c']), (3, ["", "", ""]), (4, [""]), (5, ["2", "two\nlinesx"]), (7, ["3", 'y "q"'])]


def test_partial_last_row():
    assert list(delimited.parse("a")) == [(1, ["a"])] and list(delimited.parse("")) == [] and list(delimited.parse('a\n""')) == [(1, ["a"])]
    assert list(delimited.parse("a;b\n;", ";")) == [(1, ["a", "b"]), (2, ["", ""])]


def test_errors():
    with pytest.raises(ValueError):
        list(delimited.parse('a\n"b'))
    with pytest.raises(ValueError):
        list(delimited.parse("a", "::"))


def test_read_and_map(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,name,id\n1,x,2,extra\n\n3\n")
    headers, rows = delimited.split_header(delimited.read_delimited(spark, str(tmp_path / "f.csv")))
    assert headers == ["id", "name", "id"]
    found = rows.select("line", delimited.as_map(headers, F.col("values")).alias("m")).orderBy("line").collect()
    assert [(r.line, r.m) for r in found] == [(2, {"id": "2", "name": "x"}), (3, {"id": "", "name": ""}), (4, {"id": "", "name": ""})]


def test_header_problems():
    assert delimited.header_problems(["a", "b"], ["a", "b"]) == []
    assert len(delimited.header_problems(["a", "x"], ["a", "b", "c"])) == 3


@pytest.mark.parametrize("payload, count", [
    ([{"a": 1}, 2, [], {"b": 1}], 2), ({"meta": {}, "data": {"items": [{"id": 1}, {"id": 2}]}}, 2), ({"items": [], "results": [{"a": 1}]}, 0), ({"x": {"y": [{"q": 1}] * 3, "z": [{"name": "n", "city": "c"}]}}, 1), ("text", 0), ({"n": 1}, 0),
    ({"a": {"b": {"c": {"d": {"e": {"f": [{"name": 1}]}}}}}}, 0), ({"a": {"b": {"c": {"d": [{"name": 1}]}}}}, 1),
])
def test_locate_records(payload, count):
    assert len(pages.locate_records(payload)) == count


def test_equal_scores_keep_the_first():
    assert pages.locate_records({"a": [{"x": 1}], "b": [{"y": 1}]}) == [{"x": 1}]


def test_pages(spark, tmp_path):
    for name in ("page_2.json", "PAGE-10.json", "other.json", "page_x.json"):
        (tmp_path / name).write_text(json.dumps({"items": [{"id": name, "name": "n", "rating": 4.5, "reviews_count": 1}]}))
    files = pages.read_pages(spark, str(tmp_path))
    assert sorted((r.source_page, r.source_file) for r in files.collect()) == [(2, "page_2.json"), (10, "PAGE-10.json")]
    assert pages.items(files).count() == pages.records(files).count() == 2
