"""Tables of the directory: their columns, and what must hold of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "decimal": T.DecimalType(3, 1), "map": T.MapType(T.StringType(), T.StringType())}


def _struct(columns: str) -> T.StructType:
    """Columns and kinds, without a session; decimal has three digits, one of them behind the point, map is of text."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, T.ArrayType(ISSUE) if kind == "issues" else _KINDS[kind]) for name, kind in pairs])


ISSUE = _struct("severity string, code string, message string")

COMPANIES = _struct(
    "id bigint, external_id string, name string, name_normalized string, category string, category_normalized string, city string, city_normalized string, "
    "address string, rating decimal, reviews_count int, website string, website_normalized string, email string, email_normalized string, phone string, "
    "phone_normalized string, source_file string, source_page int, source_row int, dedupe_key string, raw_data map, imported_at timestamp, updated_at timestamp"
)
IMPORT_RUNS = _struct(
    "id bigint, source_type string, source_name string, started_at timestamp, finished_at timestamp, status string, files_seen int, rows_seen int, "
    "rows_inserted int, rows_updated int, rows_rejected int, warnings int, metadata map"
)
IMPORT_ISSUES = _struct("id bigint, import_run_id bigint, source_file string, source_row int, severity string, code string, message string, raw_data string, created_at timestamp")
REVIEW_ROWS = _struct(
    "id bigint, import_run_id bigint, source_row int, external_id string, name string, category string, city string, address string, parsed_rating decimal, "
    "parsed_reviews_count int, website string, website_normalized string, phone string, phone_normalized string, matched_company_id bigint, is_valid boolean, "
    "issues issues, raw_data map, created_at timestamp"
)

#: One record of a page as most pages have it.
PAGE_ITEM = _struct("id string, name string, category string, city string, address string, rating decimal, reviews_count int, site string, phone string")

#: For each table: what every row must fulfil, and which columns are unique (null ones don't count).
ROW_RULES = {
    "companies": {
        "required": "name IS NOT NULL AND name_normalized IS NOT NULL AND source_file IS NOT NULL AND source_row IS NOT NULL AND dedupe_key IS NOT NULL AND raw_data IS NOT NULL",
        "rating": "rating IS NULL OR rating BETWEEN 0 AND 5",
        "reviews_count": "reviews_count IS NULL OR reviews_count >= 0",
        "dedupe_key": "length(dedupe_key) = 64",
    },
    "import_runs": {"status": "status IN ('running', 'completed', 'failed')"},
    "import_issues": {"severity": "severity IN ('warning', 'error')"},
    "review_rows": {},
}
UNIQUE = {"companies": (("dedupe_key",), ("external_id",)), "review_rows": (("import_run_id", "source_row"),)}


def violations(name: str, table: DataFrame) -> DataFrame:
    """(rule, n): how many rows break each rule of the table, in one pass for the rows and one for each unique key."""
    rules = ROW_RULES.get(name, {})
    counts = table.agg(F.lit(0).alias("_"), *[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(r) for r, e in rules.items()])
    out = counts.select(F.explode(F.array(F.struct(F.lit("rows").alias("rule"), F.lit(0).cast("bigint").alias("n")), *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("x")).select("x.*")
    for key in UNIQUE.get(name, ()):
        whole = table.dropna(subset=list(key)).groupBy(*key).count().where("count > 1")
        out = out.unionByName(whole.agg(F.lit("unique " + ", ".join(key)).alias("rule"), F.count("*").alias("n")))
    return out.where("n > 0")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key is set but has no row in the parent table."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
