"""Analytic and serving queries: plain plans that Catalyst may rearrange."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import normalize_text

PAGE_SIZE, LARGEST_PAGE = 25, 100


def labelled(column: str, label: str) -> Column:
    """The column, or ``label`` where it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(label))


def top_groups(table: DataFrame, column: str, label: str, count: str, limit: int = 5) -> DataFrame:
    """The most frequent values with their counts; of equal counts those that sort first."""
    return table.groupBy(labelled(column, label).alias(column)).agg(F.count("*").alias(count)).orderBy(F.col(count).desc(), column).limit(limit)


def average_by(table: DataFrame, column: str, label: str, value: str, where: Column, count: str, average: str, limit: int | None = None) -> DataFrame:
    """The average of a decimal value over rows that fulfil ``where`` and have one, to two places, the highest first."""
    found = table.where(where & F.col(value).isNotNull()).groupBy(labelled(column, label).alias(column)).agg(F.count("*").alias(count), F.round(F.avg(value), 2).alias(average))
    found = found.orderBy(F.col(average).desc(), F.col(count).desc(), column)
    return found if limit is None else found.limit(limit)


def share_by(table: DataFrame, column: str, label: str, having: Column, count: str, part: str, percent: str, as_text: bool = False) -> DataFrame:
    """For each group how many rows there are, how many have something, and their share in percent to two places, the
    highest first. ``as_text`` gives and sorts the share as text, as some reports do."""
    rows = F.count("*")
    share = F.round((F.count_if(having) * 100).cast("decimal(30,10)") / F.nullif(rows, F.lit(0)), 2).cast("decimal(10,2)")
    found = table.groupBy(labelled(column, label).alias(column)).agg(rows.alias(count), F.count_if(having).alias(part), (share.cast("string") if as_text else share).alias(percent))
    return found.orderBy(F.col(percent).desc(), F.col(count).desc(), column)


def summary(companies: DataFrame) -> DataFrame:
    """One row: companies, those with e-mail, site and phone, and those without a city."""
    return companies.agg(F.count("*").alias("companies"), F.count("email_normalized").alias("valid_emails"), F.count("website_normalized").alias("websites"), F.count("phone_normalized").alias("phones"), F.count_if(F.col("city_normalized").isNull()).alias("missing_city"))


def issue_counts(issues: DataFrame, severity: str = "severity", code: str = "code") -> DataFrame:
    """Issues by severity and code, the most frequent of a severity first."""
    return issues.groupBy(severity, code).agg(F.count("*").alias("count")).orderBy(severity, F.col("count").desc(), code)


def review_summary(rows: DataFrame, valid: str = "is_valid", matched: str = "matched_company_id") -> DataFrame:
    return rows.agg(F.count("*").alias("rows_loaded"), F.count_if(F.col(valid)).alias("rows_without_errors"), F.count_if(~F.col(valid)).alias("rows_with_errors"), F.count(matched).alias("matched_to_companies"))


def like_pattern(search: str) -> str:
    """A search text as a LIKE pattern for what contains it. Its wildcards work; a backslash before anything but a
    wildcard or backslash stands for itself."""
    return "%" + re.sub(r"\\(?![%_\\])", r"\\\\", search) + "%"


def searched(table: DataFrame, text: str, search: str = "", facet: str | None = None, value: str = "") -> DataFrame:
    """Rows whose text contains ``search`` in any case, and whose facet is ``value``; empty parameters filter nothing."""
    if search:
        table = table.where(F.col(text).ilike(like_pattern(search)))
    return table.where(F.col(facet) == value) if facet and value else table


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    page: int
    page_size: int
    total_pages: int


def page_of(total: int, page: int | None = None, page_size: int | None = None) -> tuple[int, int, int]:
    """(page, size, pages): sizes from 1 to 100, pages from 1 to what there is (one at least)."""
    size = min(LARGEST_PAGE, max(1, int(PAGE_SIZE if page_size is None else page_size)))
    pages = max(1, math.ceil(total / size))
    return min(max(1, int(1 if page is None else page)), pages), size, pages


def page_numbers(page: int, pages: int) -> list[int | None]:
    """What a pager shows: the first, the last and the pages around, None for a gap."""
    shown = sorted({n for n in (1, page - 1, page, page + 1, pages) if 1 <= n <= pages})
    return [x for before, n in zip([0, *shown], shown) for x in ([None, n] if n - before > 1 else [n])]


def given(params: Mapping[str, str | Sequence[str]], name: str) -> str:
    """A request's parameter: the first of several values, empty without one."""
    value = params.get(name) or ""
    return value if isinstance(value, str) else value[0]


def page_given(text: str) -> int:
    """The page that a parameter asks for: its leading integer if that is above 0, else 1."""
    found = re.match(r"\s*\+?([0-9]+)", text)
    return max(1, int(found[1])) if found else 1


def link(base: str, page: int = 1, search: str = "", city: str = "") -> str:
    """The address of a page of the listing; what is empty or the default is left out."""
    params = [("search", search), ("city", city), ("page", str(page) if page > 1 else "")]
    query = "&".join(f"{k}={quote_plus(v, safe='*')}" for k, v in params if v)
    return f"{base}?{query}" if query else base


LISTED = ("id", "name", "category", "city", "address", "rating", "reviews_count", "website", "email", "phone")


def list_companies(companies: DataFrame, search: str | None = None, city: str | None = None, page: int | None = None, page_size: int | None = None) -> Page:
    """A page of companies by name; parameters are normalised as the columns are. One job counts, the rows are lazy:
    a top-k of the page's end, not a sort of the table."""
    spark = companies.sparkSession
    terms = spark.range(1).select(normalize_text(F.lit(search or "")).alias("s"), normalize_text(F.lit(city or "")).alias("c")).first()
    found = searched(companies, "name_normalized", terms.s, "city_normalized", terms.c)
    total = found.count()
    page, size, pages = page_of(total, page, page_size)
    rows = found.orderBy(F.col("name_normalized").asc_nulls_last(), "id").offset((page - 1) * size).limit(size)
    return Page(rows.select(*[F.col(c).cast("string") if c == "rating" else F.col(c) for c in LISTED]), total, page, size, pages)


def facet(table: DataFrame, value: str, label: str) -> DataFrame:
    """(value, label): each filled value with the least of its spellings, in order of those."""
    return table.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("value")).agg(F.min(label).alias("label")).orderBy("label", "value")


def health(companies: DataFrame, issues: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """The six reports of a check of the tables."""
    reviewed = F.coalesce(F.col("reviews_count") >= 10, F.lit(False))
    return {
        "summary": summary(companies),
        "top_categories": top_groups(companies, "category", "Без категории", "companies_count"),
        "city_ratings": average_by(companies, "city", "Город не указан", "rating", reviewed, "companies_count", "average_rating", 20),
        "website_share": share_by(companies, "category", "Без категории", F.col("website_normalized").isNotNull(), "companies_count", "companies_with_website", "website_share_percent"),
        "issues": issue_counts(issues),
        "reviews": review_summary(reviews),
    }
