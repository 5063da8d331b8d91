import pytest
from pyspark.sql import functions as F

from corvane.functions import fields, numbers, text, urls


def one(spark, values, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_text(spark):
    assert one(spark, ["  Ёлка\xa0  Сервис ", None, "﻿A b", "№ 1"], text.normalize_text) == ["елка сервис", "", "a b", "no 1"]


def test_clean_text(spark):
    assert one(spark, ["", " \t\n", " a  b ", "ﬁ"], text.clean_text) == [None, None, "a b", "fi"]


def test_identity_text(spark):
    assert one(spark, ["ООО «Сфера-Групп», Ltd.", "!!"], text.identity_text) == ["ооо сфера групп ltd", ""]


def test_email(spark):
    assert one(spark, ["mailto:Sales@Example.RU; backup@example.ru", "почта@example.ru", "none", None], text.normalize_email) == ["sales@example.ru", None, None, None]


def test_plausible_email(spark):
    values = ["sales@example.ru", "bad@@example.ru", "почта@example.ru", ".a@b.ru", "a..b@c.ru", "a@-b.ru", "a@b.ru\n", "a" * 250 + "@b.ru", None]
    assert one(spark, values, text.is_plausible_email) == [True] + [False] * 8


def test_suspicious_email(spark):
    values = ["a@example.com", "test@shop.ru", "test+1@shop.ru", "tester@shop.ru", "noreply@shop.ru", "no-reply@shop.ru", "sales@shop.ru", "", None]
    assert one(spark, values, text.is_suspicious_email) == [True, True, True, False, True, True, False, False, False]


def test_phone(spark):
    values = ["8 (921) 555-12-34", "8 (925) abc-12-34", "+7", "+7 921 555-12-34", "44 20 12345", "123456", "1" * 16, "7123456789", "", None]
    assert one(spark, values, text.normalize_phone) == ["+79215551234", None, None, "+79215551234", "+442012345", None, None, None, None, None]


@pytest.mark.parametrize("value, expected", [
    ("https://www.Example.ru/path", ("https://www.example.ru/path", "example.ru")), ("www.example.ru/path", (None, None)), ("нет сайта", (None, None)), ("https://", (None, None)), ("htp://x.ru", (None, None)),
    ("HTTPS://Orion.RU", ("https://orion.ru/", "orion.ru")), ("http://a.ru:80/x", ("http://a.ru/x", "a.ru")), ("http://a.ru:8080", ("http://a.ru:8080/", "a.ru")), ("http://a.ru/b/../c/./d", ("http://a.ru/c/d", "a.ru")),
    ("http://пример.рф/путь", ("http://xn--e1afmkfd.xn--p1ai/%D0%BF%D1%83%D1%82%D1%8C", "xn--e1afmkfd.xn--p1ai")), ("http://localhost/x", (None, None)), ("https://a.ru?q=1#f", ("https://a.ru/?q=1#f", "a.ru")),
    ("http://1.2.3.4/", ("http://1.2.3.4/", "1.2.3.4")), ("http://1.2.3.400/", (None, None)), (None, (None, None)),
])
def test_website(spark, value, expected):
    found = one(spark, [value], urls.normalize_website)[0]
    assert (found.value, found.host) == expected


def test_lenient_numbers(spark):
    values = ["1 234", "+5", "4,5", "1e3", "", " 45 ", "4.", None]
    assert one(spark, values, numbers.parse_number) == [1234.0, 5.0, 4.5, None, None, 45.0, None, None]
    assert one(spark, ["1 234", "+5", "4,5", "9007199254740992", "-3", "9" * 30], numbers.parse_integer) == [1234, 5, None, None, -3, None]


def test_strict_numbers(spark):
    values = ["4,5", "N/A", "-3", "7.2", "5", "+5", "4.5\n", None, ""]
    assert [(r.value, r.codes) for r in one(spark, values, numbers.strict_rating)] == [
        (4.5, ["RATING_COMMA_SEPARATOR"]), (None, ["INVALID_RATING_FORMAT"]), (None, ["RATING_OUT_OF_RANGE"]), (None, ["RATING_OUT_OF_RANGE"]), (5.0, []), (None, ["INVALID_RATING_FORMAT"]), (None, ["INVALID_RATING_FORMAT"]), (None, []), (None, []),
    ]
    values = ["много", "-10", "45.5", "45", "9007199254740992", "9" * 30, None]
    bad, negative = "INVALID_REVIEWS_COUNT_FORMAT", "NEGATIVE_REVIEWS_COUNT"
    assert [(r.value, r.codes) for r in one(spark, values, numbers.strict_count)] == [(None, [bad]), (None, [negative]), (None, [bad]), (45, []), (None, [bad]), (None, [bad]), (None, [])]


def test_external_number(spark):
    assert one(spark, ["c_000001", "c_1", "c_0000011", "C_000001", "c_000001\n"], numbers.external_number) == [1, None, None, None, None]


def test_dedupe_key_tiers(spark):
    def key(**given):
        columns = [F.lit(given.get(c)).cast("string") for c in ("id", "name", "city", "address", "email", "phone", "site")]
        return spark.range(1).select(text.dedupe_key(*columns).alias("k")).first().k

    assert key(id="C_1", name="a") == key(id=" c_1", name="b", email="x@y.ru") and len(key(id="C_1", name="a")) == 64
    assert key(name="a", email="x@y.ru", phone="+71") == key(name="a", email="x@y.ru") != key(name="b", email="x@y.ru")
    assert key(name="a", phone="+71", site="s.ru") == key(name="a", phone="+71") != key(name="a", site="s.ru")
    assert key(name="a", city="c", address="Ул.  Мира") == key(name="a", city="c", address="ул. мира") != key(name="a", city="c")


def test_mojibake(spark):
    assert one(spark, ["РњРѕСЃРєРІР°", "Москва", "Ростов"], text.looks_like_mojibake) == [True, False, False]


def test_fields():
    record = {"company_name": "Alpha", "site": None, "nested": {"URL": "https://x.ru", "Contact-Email": "a@b.ru", "deep": {"phone": ["1", "", "2"]}}, "rating": [4, 5], "reviews": [1, 2, 3], "city": {"title": "Москва"}}
    flat = fields.flatten(record)
    assert list(flat)[:3] == ["companyname", "site", "nested"]
    assert fields.pick(flat, "website") is None  # the first key holds, even if it is null
    found = dict(zip(fields.FIELDS, fields.pick_all(__import__("json").dumps(record))))
    assert (found["name"], found["email"], found["phone"], found["rating"], found["city"], found["reviews_listed"]) == ("Alpha", "a@b.ru", "1, 2", "4, 5", "Москва", "3")


def test_scalars():
    assert [fields.scalar(x) for x in (4.0, 4.5, True, None, [], {}, {"label": " x "}, [[1, [2]], None, "a"], 10**20)] == ["4", "4.5", "true", None, None, None, "x", "1, 2, a", "100000000000000000000"]


def test_depth_guard():
    record = inner = {}
    for _ in range(5):
        inner["a"] = {}
        inner = inner["a"]
    inner["b"] = {"name": "too deep"}
    assert "b" in fields.flatten(record) and "name" not in fields.flatten(record)


def test_numbers_as_ecmascript_prints_them():
    from corvane.functions import fields

    assert [fields.scalar(v) for v in (0.00005, 0.000001, 1e-7, 0.1, 4.0, 1e20, 1e21, 1.5e-10, -0.00002, 123456.789)] == ["0.00005", "0.000001", "1e-7", "0.1", "4", "100000000000000000000", "1e+21", "1.5e-10", "-0.00002", "123456.789"]
