"""Queries that apply each operator to the driver's tables, and the SQL for DuckDB that each equals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schemas
from corvane.functions import numbers, text, urls
from corvane.operators import extract, merge, review
from corvane.plans import analytics
from corvane.sources import delimited, pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than cores is dealt out, as one file can be one task's work; a large one has many, and isn't shuffled."""
    return rows.repartition(key) if len(rows.inputFiles()) < rows.sparkSession.sparkContext.defaultParallelism else rows


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of the documents."""
    return _dealt(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


# -- analytics ----------------------------------------------------------------------------------------------------


@query("""SELECT coalesce(nullif(p_brand, ''), 'none') AS p_brand, count(*) AS parts FROM part GROUP BY 1 ORDER BY parts DESC, p_brand LIMIT 5""")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_groups(_t(spark, sf_dir, "part"), "p_brand", "none", "parts")


_CENTS = "round(sum({0}::DECIMAL(18,2))::DOUBLE / count(*), 2)"


@query("""SELECT coalesce(nullif(n_name, ''), 'none') AS n_name, count(*) AS customers, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*), 2)::DECIMAL(20,2)::DOUBLE AS average
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 10 AND c_acctbal IS NOT NULL GROUP BY 1""")
def avg_by_group_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return analytics.average_by(rows, "n_name", "none", "c_acctbal", F.col("c_acctbal") >= 10, "customers", "average").withColumn("average", F.col("average").cast("double"))


@query("""SELECT coalesce(nullif(o_orderpriority, ''), 'none') AS o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
    round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2)::DECIMAL(10,2)::DOUBLE AS finished_percent FROM orders GROUP BY 1""")
def filtered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.share_by(_t(spark, sf_dir, "orders"), "o_orderpriority", "none", F.col("o_orderstatus") == "F", "orders", "finished", "finished_percent")
    return found.withColumn("finished_percent", F.col("finished_percent").cast("double"))


@query("""SELECT coalesce(nullif(p_brand, ''), 'none') AS p_brand, count(*) AS parts, count(*) FILTER (WHERE p_size >= 25) AS large,
    (round(100.0 * count(*) FILTER (WHERE p_size >= 25) / count(*), 2)::DECIMAL(10,2))::VARCHAR AS large_percent FROM part GROUP BY 1""")
def filtered_share_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.share_by(_t(spark, sf_dir, "part"), "p_brand", "none", F.col("p_size") >= 25, "parts", "large", "large_percent", as_text=True)


@query("""SELECT count(*) AS companies, count(CASE WHEN event_type = 'click' THEN 1 END) AS valid_emails, count(value) AS websites, count(CASE WHEN value > 50 THEN 1 END) AS phones,
    count(*) FILTER (WHERE props IS NULL) AS missing_city FROM events""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events")
    return analytics.summary(rows.select(F.when(F.col("event_type") == "click", 1).alias("email_normalized"), F.col("value").alias("website_normalized"), F.when(F.col("value") > 50, 1).alias("phone_normalized"), F.col("props").alias("city_normalized")))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2""")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.issue_counts(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE quality = 1) AS rows_without_errors, count(*) FILTER (WHERE NOT quality = 1) AS rows_with_errors,
    count(d.doc_id) AS matched_to_companies FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)""")
def valid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").distinct().withColumn("matched", F.col("doc_id"))
    rows = _t(spark, sf_dir, "labels").withColumn("valid", F.col("quality") == 1).join(matched, "doc_id", "left")
    return analytics.review_summary(rows, "valid", "matched")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) LIKE '%a%' ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25""")
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.searched(_t(spark, sf_dir, "part"), "p_name", "a")
    return found.orderBy(F.col("p_name").asc_nulls_last(), "p_partkey").offset(25).limit(25).select("p_partkey", "p_name", "p_brand")


@query("""SELECT count(*) AS total FROM part WHERE lower(p_name) LIKE '%a%' AND p_brand = 'Brand#11'""")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.searched(_t(spark, sf_dir, "part"), "p_name", "A", "p_brand", "Brand#11").agg(F.count("*").alias("total"))


@query("""SELECT lower(c_mktsegment) AS value, min(c_mktsegment) AS label FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY 1""")
def facet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.facet(_t(spark, sf_dir, "customer").withColumn("segment", F.lower("c_mktsegment")), "segment", "c_mktsegment")


# -- scalar functions ---------------------------------------------------------------------------------------------

_WS = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), ' ')"
_NORM = f"translate(lower({_CLEAN}), 'ё', 'е')"


@query(f"SELECT doc_id, sha256(nullif({_CLEAN}, '')) AS digest FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _sha(text.clean_text(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, sha256({_NORM}) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _sha(text.normalize_text(F.col("text"))).alias("digest"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace({_NORM}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')) AS digest FROM documents")
def identity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _sha(text.identity_text(F.col("text"))).alias("digest"))


_EMAIL = r"(?i)[a-z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"
_FOUND = f"lower(nullif(regexp_extract(regexp_replace({_CLEAN}, '(?i)^mailto:', ''), '{_EMAIL}', 0), ''))"


@query(f"SELECT doc_id, {_FOUND} AS email FROM documents")
def extract_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", text.normalize_email(F.col("text")).alias("email"))


_MAILS = """(SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@mail.org' WHEN 1 THEN 'test+' || c_custkey || '@shop.org' WHEN 2 THEN 'a@example.com'
    WHEN 3 THEN 'a..b@mail.org' WHEN 4 THEN 'x@-edge.org' WHEN 5 THEN 'no-reply@mail.org' WHEN 6 THEN '.a@mail.org' ELSE 'not an address' END AS email FROM customer)"""


@query(f"""SELECT c_custkey, regexp_full_match(email, '(?i)[a-z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+') AND NOT (split_part(email, '@', 1) LIKE '.%' OR split_part(email, '@', 1) LIKE '%.'
    OR contains(split_part(email, '@', 1), '..') OR len(list_filter(string_split(split_part(email, '@', 2), '.'), lambda x: x LIKE '-%' OR x LIKE '%-')) > 0) AS plausible,
    split_part(email, '@', 2) IN ('example.com', 'example.org', 'example.net', 'test.com', 'localhost.local') OR regexp_matches(split_part(email, '@', 1), '(?i)^(test|demo|sample|fake|invalid)([+._-]|$)')
    OR regexp_matches(split_part(email, '@', 1), '(?i)^(no-?reply|donotreply)$') AS suspicious FROM {_MAILS}""")
def email_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    forms = [F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.org")), F.concat(F.lit("test+"), k.cast("string"), F.lit("@shop.org"))]
    forms += [F.lit(x) for x in ("a@example.com", "a..b@mail.org", "x@-edge.org", "no-reply@mail.org", ".a@mail.org", "not an address")]
    mails = _t(spark, sf_dir, "customer").select(k, F.get(F.array(*forms), (k % 8).cast("int")).alias("email"))
    return mails.select("c_custkey", text.is_plausible_email(F.col("email")).alias("plausible"), text.is_suspicious_email(F.col("email")).alias("suspicious"))


_PHONES = """(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '8 (9' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ') 555-12-34' WHEN 1 THEN '+7 921 ' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0')
    WHEN 2 THEN '8 (925) abc-12-34' WHEN 3 THEN '+7' WHEN 4 THEN '44.20.' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS phone FROM customer)"""


@query(f"""SELECT c_custkey, CASE WHEN NOT regexp_full_match(phone, '[0-9+()\\-. ]*') THEN NULL WHEN d LIKE '7%' THEN CASE WHEN length(d) = 11 THEN '+' || d END WHEN length(d) BETWEEN 7 AND 15 THEN '+' || d END AS phone
    FROM (SELECT c_custkey, phone, CASE WHEN length(r) = 11 AND r LIKE '8%' THEN '7' || r[2:] ELSE r END AS d FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS r FROM {_PHONES}))""")
def normalize_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    padded = lambda most, n: F.lpad((k % most).cast("string"), n, "0")
    forms = [F.concat(F.lit("8 (9"), padded(100, 2), F.lit(") 555-12-34")), F.concat(F.lit("+7 921 "), padded(10_000_000, 7)), F.lit("8 (925) abc-12-34"), F.lit("+7"), F.concat(F.lit("44.20."), padded(100_000, 5)), F.lit("")]
    return _t(spark, sf_dir, "customer").select(k, text.normalize_phone(F.get(F.array(*forms), (k % 6).cast("int")), unicode=False).alias("phone"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
    lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) ||
    CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1) LIKE '/%' THEN '' ELSE '/' END || regexp_extract(url, '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS value FROM pages""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = urls.normalize_website(F.col("url"), unicode=False)
    return _t(spark, sf_dir, "pages").select("page_id", site.alias("s")).select("page_id", "s.host", "s.value")


_RAW = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN (event_id % 6)::VARCHAR || ',' || (event_id % 10)::VARCHAR WHEN 1 THEN (event_id % 9)::VARCHAR || '.' || (event_id % 10)::VARCHAR WHEN 2 THEN 'n/a'
    WHEN 3 THEN '-' || (event_id % 5)::VARCHAR WHEN 4 THEN ' ' || (event_id % 5)::VARCHAR || ' 0' WHEN 5 THEN '+' || (event_id % 5)::VARCHAR ELSE '1e3' END AS raw FROM events)"""


@query(f"""SELECT event_id, CASE WHEN regexp_full_match(c, '[-+]?[0-9]+([.,][0-9]+)?') THEN replace(c, ',', '.')::DOUBLE END AS number, CASE WHEN regexp_full_match(c, '[-+]?[0-9]+') THEN c::BIGINT END AS whole,
    CASE WHEN regexp_full_match(raw, '-?[0-9]+([.,][0-9]+)?') AND replace(raw, ',', '.')::DOUBLE BETWEEN 0 AND 5 THEN replace(raw, ',', '.')::DOUBLE END AS rating,
    concat_ws(',', CASE WHEN regexp_full_match(raw, '-?[0-9]+,[0-9]+') THEN 'RATING_COMMA_SEPARATOR' END, CASE WHEN NOT regexp_full_match(raw, '-?[0-9]+([.,][0-9]+)?') THEN 'INVALID_RATING_FORMAT'
    WHEN replace(raw, ',', '.')::DOUBLE NOT BETWEEN 0 AND 5 THEN 'RATING_OUT_OF_RANGE' END) AS rating_codes,
    CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN CASE WHEN raw::BIGINT >= 0 THEN raw::BIGINT END END AS reviews, CASE WHEN NOT regexp_full_match(raw, '-?[0-9]+') THEN 'INVALID_REVIEWS_COUNT_FORMAT' WHEN raw::BIGINT < 0 THEN 'NEGATIVE_REVIEWS_COUNT' ELSE '' END AS reviews_codes
    FROM (SELECT *, replace(raw, ' ', '') AS c FROM {_RAW})""")
def strict_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("event_id"), lambda n: (F.col("event_id") % n).cast("string")
    forms = [F.concat(s(6), F.lit(","), s(10)), F.concat(s(9), F.lit("."), s(10)), F.lit("n/a"), F.concat(F.lit("-"), s(5)), F.concat(F.lit(" "), s(5), F.lit(" 0")), F.concat(F.lit("+"), s(5)), F.lit("1e3")]
    raw = _t(spark, sf_dir, "events").select(k, F.get(F.array(*forms), (k % 7).cast("int")).alias("raw"))
    found = raw.select(k, numbers.parse_number(F.col("raw")).alias("number"), numbers.parse_integer(F.col("raw")).alias("whole"), numbers.strict_rating(F.col("raw")).alias("r"), numbers.strict_count(F.col("raw")).alias("c"))
    return found.select("event_id", "number", "whole", F.col("r.value").alias("rating"), F.array_join("r.codes", ",").alias("rating_codes"), F.col("c.value").alias("reviews"), F.array_join("c.codes", ",").alias("reviews_codes"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


@query("""SELECT event_id, 'c_' || lpad((event_id * 37 % 1000000)::VARCHAR, 6, '0') AS external_id, (event_id * 37 % 1000000)::INTEGER AS number FROM events""")
def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("c_"), F.lpad((F.col("event_id") * 37 % 1_000_000).cast("string"), 6, "0"))
    return _t(spark, sf_dir, "events").select("event_id", made.alias("external_id")).withColumn("number", numbers.external_number(F.col("external_id")))


# -- de-duplication and merging -----------------------------------------------------------------------------------


@query("""SELECT c_custkey, sha256(CASE WHEN c_custkey % 4 = 0 THEN 'external:c_' || c_custkey WHEN c_custkey % 4 = 1 THEN 'email:a' || c_custkey % 10 || '@b.org|name:' || lower(c_name)
    WHEN c_custkey % 4 = 2 THEN 'phone:+7' || c_custkey % 10 || '|name:' || lower(c_name) ELSE 'name:' || lower(c_name) || '|city:' || lower(c_mktsegment) || '|address:street ' || c_nationkey END) AS dedupe_key FROM customer""")
def dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), (F.col("c_custkey") % 10).cast("string")
    tier = lambda i, c: F.when(k % 4 == i, c)
    key = text.dedupe_key(
        tier(0, F.concat(F.lit("C_"), k.cast("string"))), F.lower("c_name"), F.lower("c_mktsegment"), F.concat(F.lit(" Street  "), F.col("c_nationkey").cast("string")),
        tier(1, F.concat(F.lit("a"), n, F.lit("@b.org"))), tier(2, F.concat(F.lit("+7"), n)), F.lit(None).cast("string"), unicode=False,
    )
    return _t(spark, sf_dir, "customer").select(k, key.alias("dedupe_key"))


@query("""SELECT sha256(coalesce(text, '')) AS digest, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(_sha(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id", "lang", "source")
    return merge.keep_last(rows, ["digest"], "doc_id").select("digest", "lang", "source", "doc_id")


@query("""SELECT doc_id, first_value(doc_id) OVER w AS first_doc, row_number() OVER w > 1 AS repeated FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents) WINDOW w AS (PARTITION BY d ORDER BY doc_id)""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", _sha(F.coalesce("text", F.lit(""))).alias("digest"))
    return merge.first_seen(rows, "digest", ["doc_id"], ["doc_id"]).select("doc_id", F.col("first.doc_id").alias("first_doc"), "repeated")


@query("""SELECT user_id, count(*) - 1 AS later, arg_min(event_type, event_id) FILTER (WHERE event_id % 5 <> 0) AS external_id, arg_max(name, (length(name), event_id)) AS name,
    arg_max(category, event_id) FILTER (WHERE category IS NOT NULL) AS category, max(n) AS reviews_count, arg_max(r, event_id) FILTER (WHERE best AND r IS NOT NULL) AS rating
    FROM (SELECT *, coalesce(coalesce(n, -1) >= max(coalesce(n, -1)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best
        FROM (SELECT user_id, event_id, event_type, event_type || repeat('x', (event_id % 4)::INTEGER) AS name, CASE WHEN event_id % 3 <> 0 THEN event_type END AS category,
            CASE WHEN event_id % 4 <> 0 THEN (event_id * 7 % 50)::INTEGER END AS n, CASE WHEN event_id % 6 <> 0 THEN (event_id % 50)::INTEGER END AS r FROM events)) GROUP BY 1""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(e % 5 != 0, F.col("event_type")).alias("external_id"), F.concat("event_type", F.repeat(F.lit("x"), (e % 4).cast("int"))).alias("name"),
        F.when(e % 3 != 0, F.col("event_type")).alias("category"), F.when(e % 4 != 0, (e * 7 % 50).cast("int")).alias("reviews_count"), F.when(e % 6 != 0, (e % 50).cast("int")).alias("rating"),
    )
    found = merge.merged(rows, "user_id", "event_id", newest=["category"])
    counts = rows.groupBy("user_id").agg((F.count("*") - 1).alias("later"))
    return found.join(counts, "user_id").select("user_id", "later", "external_id", "name", "category", "reviews_count", "rating")


_WHOLE = "concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))"


@query(f"""SELECT doc_id, n, first FROM (SELECT doc_id, count(*) OVER (PARTITION BY k) AS n, min(doc_id) OVER (PARTITION BY k) AS first FROM (SELECT doc_id, {_WHOLE} AS k FROM documents)) WHERE n > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("lang", "source", "text")])
    rows = _t(spark, sf_dir, "documents").select("doc_id", _sha(whole).alias("k"))
    return rows.join(review.repeated(rows, "k", "doc_id"), "k").select("doc_id", "n", "first")


@query("""SELECT host, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS path FROM pages)
    WHERE host <> '' GROUP BY 1 HAVING count(DISTINCT path) > 1""")
def shared_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)\z", 1).alias("path"))
    return review.shared(rows, "host", "path", "page_id")


# -- matching -----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c.c_custkey AS matched, c.c_custkey IS NOT NULL AND c.c_nationkey = o.o_custkey % 25 AS same FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey + (o.o_orderkey % 3) * 1000""")
def id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") + F.col("o_orderkey") % 3 * 1000).alias("c_custkey"))
    found = orders.join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("matched")), "c_custkey", "left")
    return found.select("o_orderkey", "matched", (F.col("matched").isNotNull() & F.coalesce(F.col("c_nationkey") == F.col("o_custkey") % 25, F.lit(False))).alias("same"))


_FP = "lower(c_mktsegment) || '|' || c_nationkey::VARCHAR"


@query(f"""WITH c AS (SELECT c_custkey, {_FP} AS fp FROM customer) SELECT a.c_custkey, min(b.c_custkey) AS twin FROM c a JOIN c b ON a.fp = b.fp AND a.c_custkey IS DISTINCT FROM b.c_custkey GROUP BY 1""")
def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("|"), F.col("c_nationkey").cast("string")).alias("fp"))
    first = rows.groupBy("fp").agg(F.min("c_custkey").alias("a"))
    second = rows.join(first, "fp").where("c_custkey <> a").groupBy("fp", "a").agg(F.min("c_custkey").alias("b"))
    return rows.join(second, "fp").select("c_custkey", F.when(F.col("c_custkey") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("twin"))


@query("""SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_custkey IS DISTINCT FROM s_suppkey AND c_mktsegment IS DISTINCT FROM (CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END) GROUP BY 1""")
def conflict_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_custkey").alias("external_id"), F.col("c_mktsegment").alias("identity"), F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("key"), F.col("s_suppkey").alias("external_id"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("identity"))
    return review.conflicts(rows, "key", table, "nation").where("n > 0").select("s_suppkey", "n")


_BAD = "CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || 'x' WHEN 2 THEN replace(p_brand, 'B', '') || 'zz' ELSE substr(p_brand, 3) END"


@query(f"""WITH w AS (SELECT DISTINCT {_BAD} AS word FROM part), d AS (SELECT DISTINCT p_brand AS entry FROM part),
    p AS (SELECT word, entry, levenshtein(word, entry) AS distance FROM w, d WHERE levenshtein(word, entry) <= 2)
    SELECT word, arg_min(entry, (distance, entry)) AS nearest, min(distance)::INTEGER AS distance FROM p GROUP BY 1""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, b = _t(spark, sf_dir, "part"), F.col("p_brand")
    bad = F.when(F.col("p_partkey") % 4 == 0, b).when(F.col("p_partkey") % 4 == 1, F.concat(b, F.lit("x"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.replace(b, F.lit("B"), F.lit("")), F.lit("zz"))).otherwise(F.substring(b, 3, 1000))
    return review.nearest(part.select(bad.alias("w")), "w", part.select("p_brand", b.alias("rank")), "p_brand", "rank")


_SEG = "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment || '?' END"


@query(f"""SELECT c_custkey, CASE WHEN seg IN (SELECT c_mktsegment FROM customer) THEN 'known' WHEN lower(seg) IN (SELECT lower(c_mktsegment) FROM customer) THEN 'case' ELSE 'unknown' END AS verdict
    FROM (SELECT c_custkey, {_SEG} AS seg FROM customer)""")
def dictionary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, m = _t(spark, sf_dir, "customer"), F.col("c_mktsegment")
    seg = F.when(F.col("c_custkey") % 3 == 0, m).when(F.col("c_custkey") % 3 == 1, F.lower(m)).otherwise(F.concat(m, F.lit("?")))
    known = base.select(m.alias("seg")).distinct().withColumn("known", F.lit(True))
    folded = base.select(F.lower(m).alias("low")).distinct().withColumn("folded", F.lit(True))
    rows = base.select("c_custkey", seg.alias("seg")).withColumn("low", F.lower("seg")).join(known, "seg", "left").join(folded, "low", "left")
    return rows.select("c_custkey", F.when(F.col("known"), "known").when(F.col("folded"), "case").otherwise("unknown").alias("verdict"))


@query("""SELECT event_id, n AS number FROM (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN 900000 + event_id % 1000 ELSE event_id % 5000 END AS n FROM events) WHERE n > (SELECT max(c_custkey) FROM customer) + 10000""")
def id_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    largest = _t(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    number = F.when(F.col("event_id") % 100 == 0, 900_000 + F.col("event_id") % 1000).otherwise(F.col("event_id") % 5000)
    return _t(spark, sf_dir, "events").select("event_id", number.alias("number")).where(F.col("number") > largest + review.OUTLIER)


@query("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = _t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return schemas.orphans(_t(spark, sf_dir, "labels"), "doc_id", english, "doc_id").select("doc_id", "quality", "toxic")


@query("""SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderpriority <> ''""")
def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.known(_t(spark, sf_dir, "orders"), "o_orderpriority", "value")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS source_file, (event_id // 100)::INTEGER AS source_page, row_number() OVER (PARTITION BY event_id % 2, event_id // 100 ORDER BY event_id)::INTEGER AS source_row,
    'e' || event_id AS id, (event_id % 50 / 10.0)::DOUBLE AS rating, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 7)::INTEGER END AS reviews_count FROM events""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    item = F.struct(F.concat(F.lit("e"), e.cast("string")).alias("id"), (e % 50 / 10).cast("decimal(3,1)").alias("rating"), F.when(e % 3 != 0, e % 7).alias("reviews_count"))
    rows = _t(spark, sf_dir, "events").groupBy(F.when(e % 2 == 0, "left").otherwise("right").alias("source_file"), F.floor(e / 100).cast("int").alias("source_page")).agg(F.array_sort(F.collect_list(F.struct(e.alias("e"), item.alias("i")))).alias("l"))
    text_ = F.to_json(F.struct(F.lit(1).alias("page"), F.transform("l", lambda x: x["i"]).alias("items")))
    found = pages.items(rows.select("source_file", "source_page", text_.alias("text")))
    return found.select("source_file", "source_page", "source_row", "item.id", F.col("item.rating").cast("double").alias("rating"), "item.reviews_count")


@query("""SELECT * FROM (VALUES ('dedupe_key', (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0)), ('rating', (SELECT count(*) FROM customer WHERE c_acctbal > 5 OR c_acctbal < 0)), ('unique external_id',
    (SELECT count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)))) AS t(rule, n) WHERE n > 0""")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, some = F.col("c_custkey"), F.lit("x")
    key = F.sha2(k.cast("string"), 256)
    rows = _t(spark, sf_dir, "customer").select(
        some.alias("name"), some.alias("name_normalized"), some.alias("source_file"), F.lit(1).alias("source_row"), some.alias("raw_data"), F.col("c_acctbal").alias("rating"), F.lit(1).alias("reviews_count"),
        F.when(k % 5 == 0, k.cast("string")).otherwise(key).alias("dedupe_key"), F.col("c_nationkey").cast("string").alias("external_id"),
    )
    return schemas.violations("companies", rows)


# -- the audit ----------------------------------------------------------------------------------------------------


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as companies: every second one has a phone and a site."""
    k = F.col("c_custkey")
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return _t(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        k.alias("id"), F.concat(F.lit("c_"), F.lpad(k.cast("string"), 6, "0")).alias("external_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("city"),
        F.concat(F.lit("street "), k.cast("string")).alias("address"), (k % 50 / 10).cast("decimal(3,1)").alias("rating"), (k % 300).cast("int").alias("reviews_count"),
        F.when(k % 2 == 0, F.concat(F.lit("site"), (k % 400).cast("string"), F.lit(".org"))).alias("website_normalized"), F.when(k % 2 == 0, F.concat(F.lit("+7900"), F.lpad((k % 500).cast("string"), 7, "0"))).alias("phone_normalized"),
    )


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row of a feed, derived from its customer with a fault that depends on its key."""
    k, o = F.col("id"), F.col("o_orderkey")
    fault = lambda n, bad, good: F.when(o % 16 == n, bad).otherwise(good)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(_companies(spark, sf_dir), "id")
    cells = {
        "id": fault(1, F.concat(F.lit("c_9"), F.lpad((o % 100_000).cast("string"), 5, "0")), fault(2, F.lit("x1"), F.col("external_id"))), "name": fault(3, F.lit(" "), F.col("name")),
        "category": fault(4, F.lit("nothing of the kind"), F.col("category")), "city": fault(5, F.lower("city"), fault(6, F.concat(F.col("city"), F.lit("1")), fault(7, F.lit("Far Away"), F.col("city")))), "address": fault(8, F.lit(""), F.col("address")),
        "rating": fault(9, F.lit("4,5"), fault(10, F.lit("7.2"), fault(11, F.lit("N/A"), numbers.js_number(F.col("rating"))))), "reviews_count": fault(12, F.lit("45.5"), fault(13, F.lit("-10"), F.col("reviews_count").cast("string"))),
        "site": fault(14, F.lit("htp://broken"), F.coalesce(F.concat(F.lit("https://www."), F.col("website_normalized")), F.lit(""))), "phone": fault(15, F.lit("8 abc"), F.coalesce("phone_normalized", F.lit(""))),
    }
    return rows.select(F.col("o_orderkey").cast("int").alias("line"), F.array(*[F.coalesce(cells[h], F.lit("")) for h in review.HEADERS]).alias("values"), F.map_from_arrays(F.array(*[F.lit(h) for h in review.HEADERS]), F.array(*[F.coalesce(cells[h], F.lit("")) for h in review.HEADERS])).alias("raw"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.audit(_feed(spark, sf_dir), len(review.HEADERS), _companies(spark, sf_dir))


_AUDIT = """WITH ref AS (SELECT c_custkey AS id, 'c_' || lpad(c_custkey::VARCHAR, 6, '0') AS ext, c_name AS name, c_mktsegment AS category, n_name AS city, 'street ' || c_custkey AS address,
        (c_custkey % 50) / 10.0 AS rating, c_custkey % 300 AS cnt, CASE WHEN c_custkey % 2 = 0 THEN 'site' || c_custkey % 400 || '.org' END AS host, CASE WHEN c_custkey % 2 = 0 THEN '+7900' || lpad((c_custkey % 500)::VARCHAR, 7, '0') END AS tel,
        trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS ident FROM customer JOIN nation ON c_nationkey = n_nationkey),
    feed AS (SELECT o_orderkey AS line, o_orderkey % 16 AS f, ref.id AS base, CASE o_orderkey % 16 WHEN 1 THEN 'c_9' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') WHEN 2 THEN 'x1' ELSE ext END AS ext, CASE WHEN o_orderkey % 16 <> 3 THEN name END AS name,
        CASE o_orderkey % 16 WHEN 4 THEN 'nothing of the kind' ELSE category END AS category, CASE o_orderkey % 16 WHEN 5 THEN lower(city) WHEN 6 THEN city || '1' WHEN 7 THEN 'Far Away' ELSE city END AS city,
        CASE WHEN o_orderkey % 16 <> 8 THEN address END AS address, CASE o_orderkey % 16 WHEN 9 THEN 4.5 WHEN 10 THEN NULL WHEN 11 THEN NULL ELSE rating END AS rating, CASE WHEN o_orderkey % 16 NOT IN (12, 13) THEN cnt END AS cnt,
        CASE WHEN o_orderkey % 16 <> 14 THEN host END AS host, CASE WHEN o_orderkey % 16 <> 15 THEN tel END AS tel, CASE WHEN o_orderkey % 16 <> 3 THEN ident ELSE '' END AS ident FROM orders JOIN ref ON o_custkey = ref.id),
    whole AS (SELECT *, concat_ws('|', ext, coalesce(name, ''), category, city, coalesce(address, ''), CASE f WHEN 9 THEN '4,5' WHEN 10 THEN '7.2' WHEN 11 THEN 'N/A' ELSE rating::VARCHAR END, CASE f WHEN 12 THEN '45.5' WHEN 13 THEN '-10' ELSE cnt::VARCHAR END, CASE f WHEN 14 THEN 'htp' ELSE coalesce(host, '') END, CASE f WHEN 15 THEN '8 abc' ELSE coalesce(tel, '') END) AS w FROM feed),
    found AS (
        SELECT line, 'INVALID_ID_FORMAT' AS code FROM feed WHERE f = 2 UNION ALL SELECT line, 'ID_OUTLIER' FROM feed WHERE f = 1 AND 900000 + line % 100000 > (SELECT max(id) FROM ref) + 10000
        UNION ALL SELECT line, 'MISSING_NAME' FROM feed WHERE f = 3 UNION ALL SELECT line, 'UNKNOWN_CATEGORY' FROM feed WHERE f = 4 UNION ALL SELECT line, CASE WHEN EXISTS (SELECT 1 FROM ref WHERE ref.city = feed.city) THEN NULL ELSE 'CITY_CASE_VARIANT' END FROM feed WHERE f = 5
        UNION ALL SELECT line, 'CITY_TYPO' FROM feed WHERE f = 6 AND city NOT IN (SELECT city FROM ref) UNION ALL SELECT line, 'CITY_NON_RUSSIAN_VARIANT' FROM feed WHERE f = 7 UNION ALL SELECT line, 'MISSING_ADDRESS' FROM feed WHERE f = 8
        UNION ALL SELECT line, 'RATING_COMMA_SEPARATOR' FROM feed WHERE f = 9 UNION ALL SELECT line, 'RATING_OUT_OF_RANGE' FROM feed WHERE f = 10 UNION ALL SELECT line, 'INVALID_RATING_FORMAT' FROM feed WHERE f = 11
        UNION ALL SELECT line, 'INVALID_REVIEWS_COUNT_FORMAT' FROM feed WHERE f = 12 UNION ALL SELECT line, 'NEGATIVE_REVIEWS_COUNT' FROM feed WHERE f = 13 UNION ALL SELECT line, 'INVALID_WEBSITE' FROM feed WHERE f = 14 UNION ALL SELECT line, 'INVALID_PHONE' FROM feed WHERE f = 15
        UNION ALL SELECT line, CASE WHEN same THEN 'DUPLICATE_OF_BASE_BY_ID' ELSE 'ID_CONFLICT_WITH_BASE' END FROM (SELECT feed.line, feed.ident = ref.ident AND lower(feed.category) = lower(ref.category) AND lower(feed.city) = lower(ref.city) AND feed.address IS NOT DISTINCT FROM ref.address
            AND feed.rating IS NOT DISTINCT FROM ref.rating AND feed.cnt IS NOT DISTINCT FROM ref.cnt AND feed.host IS NOT DISTINCT FROM ref.host AND feed.tel IS NOT DISTINCT FROM ref.tel AS same FROM feed JOIN ref USING (ext))
        UNION ALL SELECT feed.line, 'DUPLICATE_OF_BASE_DIFFERENT_ID' FROM feed JOIN ref ON feed.base = ref.id WHERE f IN (1, 2) AND feed.ext <> ref.ext
        UNION ALL SELECT line, 'DUPLICATE_ID_IN_CSV' FROM (SELECT line, count(*) OVER (PARTITION BY ext) AS n FROM feed) WHERE n > 1
        UNION ALL SELECT line, 'EXACT_DUPLICATE_ROW' FROM (SELECT line, count(*) OVER (PARTITION BY w) AS n FROM whole) WHERE n > 1
        UNION ALL SELECT line, 'WEBSITE_SHARED_IN_CSV' FROM feed WHERE host IN (SELECT host FROM feed WHERE host IS NOT NULL GROUP BY host HAVING count(DISTINCT ident) > 1)
        UNION ALL SELECT line, 'PHONE_SHARED_IN_CSV' FROM feed WHERE tel IN (SELECT tel FROM feed WHERE tel IS NOT NULL GROUP BY tel HAVING count(DISTINCT ident) > 1)
        UNION ALL SELECT line, 'WEBSITE_CONFLICT_WITH_BASE' FROM feed WHERE EXISTS (SELECT 1 FROM ref WHERE ref.host = feed.host AND ref.ext <> feed.ext AND ref.ident <> feed.ident)
        UNION ALL SELECT line, 'PHONE_CONFLICT_WITH_BASE' FROM feed WHERE EXISTS (SELECT 1 FROM ref WHERE ref.tel = feed.tel AND ref.ext <> feed.ext AND ref.ident <> feed.ident))
"""


@query(_AUDIT + "SELECT line::INTEGER AS line, code FROM found WHERE code IS NOT NULL")
def row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("line", F.explode("issues.code").alias("code"))


@query(_AUDIT + "SELECT code, count(*) AS count FROM found WHERE code IS NOT NULL GROUP BY 1")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.findings(_audited(spark, sf_dir)).select("code", "count")


_WARN = "('ID_OUTLIER', 'CITY_CASE_VARIANT', 'CITY_TYPO', 'CITY_NON_RUSSIAN_VARIANT', 'RATING_COMMA_SEPARATOR', 'DUPLICATE_OF_BASE_BY_ID', 'WEBSITE_SHARED_IN_CSV', 'PHONE_SHARED_IN_CSV', 'WEBSITE_CONFLICT_WITH_BASE', 'PHONE_CONFLICT_WITH_BASE')"


@query(_AUDIT + f""", rows AS (SELECT feed.line, ext, coalesce(bool_or(code NOT IN {_WARN}), false) AS err, coalesce(bool_or(code IN {_WARN}), false) AS warn FROM feed LEFT JOIN (SELECT * FROM found WHERE code IS NOT NULL) x USING (line) GROUP BY 1, 2)
    SELECT count(*) AS rows_read, 0::BIGINT AS empty_rows, count(*) FILTER (WHERE NOT err) AS valid_rows, count(*) FILTER (WHERE err) AS rows_with_errors, count(*) FILTER (WHERE warn AND NOT err) AS rows_with_warnings_only, count(DISTINCT ext) AS unique_external_ids FROM rows""")
def stats_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.statistics(_audited(spark, sf_dir))


@query("""SELECT c_custkey, city_known AND address = '' AS shifted FROM (SELECT c_custkey, c_custkey % 3 = 0 AS city_known, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END AS address FROM customer)""")
def column_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, k = _companies(spark, sf_dir), F.col("id")
    rows = companies.select(k, F.when(k % 3 == 0, F.col("city")).otherwise(F.col("category")).alias("category"), F.lit("ул. Мира").alias("city"), F.when(k % 2 == 0, "").otherwise("x").alias("address"))
    raw = F.create_map(*[x for h in review.HEADERS for x in (F.lit(h), F.col(h) if h in ("category", "city", "address") else F.lit(""))])
    found = review.audit(rows.select(k.cast("int").alias("line"), F.array_repeat(F.lit(""), 9).alias("values"), raw.alias("raw")), 9, companies)
    return found.select(F.col("line").cast("bigint").alias("c_custkey"), F.exists("issues", lambda i: i["code"] == "COLUMN_SHIFT_SUSPECTED").alias("shifted"))


# -- sources ------------------------------------------------------------------------------------------------------

_CSV = 'id,name\r\n1,"a, ""b"""\n,,\n\n2,"two\nlines" \r3,x'


@query("SELECT * FROM (VALUES (1, 'id|name'), (2, '1|a, \"b\"'), (3, '||'), (4, ''), (5, '2|two' || chr(10) || 'lines'), (7, '3|x')) AS t(line, fields)")
def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("corvane_parse_delimited", delimited.ParseDelimited)
    return spark.sql("SELECT line, array_join(values, '|') AS fields FROM corvane_parse_delimited(:text, ',')", args={"text": _CSV})


_PAYLOADS = [json.dumps(x) for x in ([{"a": 1}, 2, {"b": 2}], {"meta": 1, "data": {"items": [{"id": 1}, {"id": 2}]}}, {"results": [{"id": 1}]}, {"x": {"y": [{"q": 1}, {"q": 2}, {"q": 3}], "z": [{"name": "n", "city": "c"}]}}, {"n": 1})]


@query("SELECT * FROM (VALUES (0, 2), (1, 2), (2, 1), (3, 1), (4, 0)) AS t(payload, records)")
def record_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(str(i), i, p) for i, p in enumerate(_PAYLOADS)], "source_file string, source_page int, text string")
    return pages.records(files).groupBy(F.col("source_page").alias("payload")).agg(F.count("record").cast("int").alias("records"))


@query("""SELECT o_orderkey, 'c_' || o_custkey AS external_id, 'Order ' || o_orderkey AS name, 'mail' || o_custkey % 7 || '@shop.org' AS email, ((o_orderkey % 50) / 10.0)::DOUBLE AS rating, sha256('external:c_' || o_custkey) AS dedupe_key FROM orders""")
def alias_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    record = F.struct(F.concat(F.lit("C_"), c).alias("Company-ID"), F.struct(F.concat(F.lit("mailto:MAIL"), (F.col("o_custkey") % 7).cast("string"), F.lit("@shop.org")).alias("e-mail"), F.concat(F.lit("Order  "), o.cast("string")).alias("company name")).alias("contact"), F.concat(F.floor(o % 50 / 10).cast("string"), F.lit(","), (o % 10).cast("string")).alias("Рейтинг"))
    rows = _dealt(_t(spark, sf_dir, "orders"), "o_orderkey").select(F.lit("orders").alias("source_file"), F.lit(1).alias("source_page"), o.alias("source_row"), F.to_json(record).alias("record"))
    found = extract.companies(extract.picked(rows))
    return found.select(F.col("source_row").alias("o_orderkey"), F.lower("external_id").alias("external_id"), "name", "email", F.col("rating").cast("double").alias("rating"), "dedupe_key")


_FAULTS = {
    1: ("name", None, [("error", "MISSING_NAME", "row left out: it has no company name")]),
    2: ("rating", "five", [("warning", "INVALID_RATING_FORMAT", 'rating "five" is not a number, kept as null')]),
    3: ("rating", "7.5", [("warning", "INVALID_RATING", 'rating "7.5" is not between 0 and 5, kept as null')]),
    4: ("reviews_count", "4.5", [("warning", "INVALID_REVIEWS_COUNT_FORMAT", 'number of reviews "4.5" is not an integer, kept as null')]),
    5: ("reviews_count", "-3", [("warning", "INVALID_REVIEWS_COUNT", 'number of reviews "-3" is negative, kept as null')]),
    6: ("site", "ftp://shop.org", [("warning", "INVALID_WEBSITE", 'site "ftp://shop.org" is no http(s) address')]),
    7: ("email", "nobody", [("warning", "INVALID_EMAIL", 'e-mail "nobody" is not well formed')]),
    8: ("email", "test@shop.org", [("warning", "SUSPICIOUS_EMAIL", 'e-mail "test@shop.org" looks like a test or machine address')]),
    9: ("phone", "call us", [("warning", "INVALID_PHONE", 'phone "call us" can\'t be normalised')]),
}
_SAID = " ".join(f"WHEN {n} THEN '" + ";".join(":".join(i) for i in found).replace("'", "''") + "'" for n, (_, _, found) in _FAULTS.items())


@query(f"""SELECT o_orderkey, f NOT IN (1, 10) AS accepted, CASE WHEN f NOT IN (2, 3, 10) THEN 4.5::DOUBLE END AS rating, CASE WHEN f NOT IN (4, 5, 10) THEN 12 END AS reviews_count, CASE WHEN f NOT IN (6, 10) THEN 'shop.org' END AS host,
    CASE WHEN f = 8 THEN 'test@shop.org' WHEN f NOT IN (7, 10) THEN 'a@shop.org' END AS email, CASE WHEN f NOT IN (9, 10) THEN '+79001234567' END AS phone,
    CASE f {_SAID} WHEN 10 THEN 'error:NO_RECORDS_FOUND:the file has no list of records' ELSE '' END AS issues FROM (SELECT o_orderkey, o_orderkey % 11 AS f FROM orders)""")
def import_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a record with one fault or none: each rule of an import, its message, and what is kept."""
    f, o = F.col("o_orderkey") % 11, F.col("o_orderkey")
    good = {"name": F.concat(F.lit("Order "), o.cast("string")), "rating": F.lit("4,5"), "reviews_count": F.lit("12"), "site": F.lit("https://www.shop.org/"), "email": F.lit("A@shop.org"), "phone": F.lit("8 900 123-45-67")}
    for n, (field, bad, _) in _FAULTS.items():
        good[field] = F.when(f == n, F.lit(bad)).otherwise(good[field])
    record = F.when(f != 10, F.to_json(F.struct(*[c.alias(name) for name, c in good.items()])))
    rows = _dealt(_t(spark, sf_dir, "orders"), "o_orderkey").select(F.lit("orders").alias("source_file"), F.lit(1).alias("source_page"), o.alias("source_row"), record.alias("record"))
    said = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["severity"], i["code"], i["message"])), ";")
    return extract.companies(extract.picked(rows)).select(F.col("source_row").alias("o_orderkey"), "accepted", F.col("rating").cast("double").alias("rating"), "reviews_count", F.col("website_normalized").alias("host"), "email", F.col("phone_normalized").alias("phone"), said.alias("issues"))


@query("""SELECT user_id, event_type AS name, arg_max(event_id, event_id)::VARCHAR AS value FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2""")
def raw_data_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as maps that are merged: later entries win, rows without a map change nothing."""
    e, none = F.col("event_id"), F.lit(None).cast("int")
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", none.alias("reviews_count"), none.alias("rating"), F.when(e % 5 != 0, F.create_map("event_type", e.cast("string"))).alias("raw_data"))
    return merge.merged(rows, "user_id", "event_id").select("user_id", F.explode("raw_data").alias("name", "value"))


@query("""SELECT count(DISTINCT user_id) FILTER (WHERE user_id % 3 <> 0) AS inserted, count(*) - count(DISTINCT user_id) FILTER (WHERE user_id % 3 <> 0) AS updated FROM events""")
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events upserted into a table that has every third user."""
    none, u = F.lit(None).cast("string"), F.col("user_id")
    columns = {"dedupe_key": F.concat(F.lit("u"), u.cast("string")), "external_id": none, "name": F.col("event_type"), "name_normalized": F.col("event_type"), "reviews_count": F.lit(1), "rating": F.lit(4).cast("decimal(3,1)"), "raw_data": F.create_map(F.lit("k"), F.col("event_type"))}
    columns |= {c: none for c in merge.COMPANY_NEWEST} | {"source_file": F.lit("events"), "source_page": F.lit(1), "source_row": F.col("event_id").cast("int")}
    rows = _t(spark, sf_dir, "events").select(u, *[c.alias(name) for name, c in columns.items()])
    existing = rows.where(u % 3 == 0).dropDuplicates(["user_id"]).withColumns({"id": u.cast("bigint"), "imported_at": F.current_timestamp()})
    return merge.upsert(existing, rows)[1]


def _placed(report: DataFrame, name: str, key: str) -> DataFrame:
    """What a report's rows are about, in their places; a report is a few rows."""
    return report.select(F.lit(name).alias("report"), F.col(key).alias("key"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"))


@query("""SELECT 'averages' AS report, n_name AS key, row_number() OVER (ORDER BY average DESC, n DESC, n_name)::INTEGER AS place FROM (SELECT n_name, count(*) AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE / count(*), 2)::DECIMAL(20,2) AS average
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 10 GROUP BY 1)
    UNION ALL SELECT 'shares', o_orderpriority, row_number() OVER (ORDER BY share DESC, n DESC, o_orderpriority)::INTEGER FROM (SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2)::DECIMAL(10,2) AS share FROM orders GROUP BY 1)
    UNION ALL SELECT 'facet', v, row_number() OVER (ORDER BY label, v)::INTEGER FROM (SELECT lower(c_mktsegment) AS v, min(c_mktsegment) AS label FROM customer WHERE c_mktsegment <> '' GROUP BY 1)
    UNION ALL SELECT 'issues', k, row_number() OVER (ORDER BY l_returnflag, n DESC, l_linestatus)::INTEGER FROM (SELECT l_returnflag, l_linestatus, l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order the reports give their rows."""
    customers = _t(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    rated = customers.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = _placed(analytics.average_by(rated, "n_name", "none", "c_acctbal", F.col("c_acctbal") >= 10, "customers", "average"), "averages", "n_name")
    out = out.unionByName(_placed(analytics.share_by(_t(spark, sf_dir, "orders"), "o_orderpriority", "none", F.col("o_orderstatus") == "F", "orders", "finished", "percent"), "shares", "o_orderpriority"))
    out = out.unionByName(_placed(analytics.facet(customers.withColumn("segment", F.lower("c_mktsegment")), "segment", "c_mktsegment"), "facet", "value"))
    counts = analytics.issue_counts(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return out.unionByName(_placed(counts.withColumn("k", F.concat("l_returnflag", "l_linestatus")), "issues", "k"))


@query("""WITH c AS (SELECT *, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS rn, count(*) OVER () AS total FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), 'customer'))
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, n_name AS city, ((c_custkey % 50) / 10.0)::DECIMAL(3,1)::VARCHAR AS rating, total, (total + 99) // 100 AS page FROM c WHERE rn > (total + 99) // 100 * 100 - 100""")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of a search: a page beyond the last and a size beyond the largest are brought back."""
    companies = _companies(spark, sf_dir).withColumns({"name_normalized": F.lower("name"), "city_normalized": F.lower("city"), "website": F.col("website_normalized"), "email": F.lit(None).cast("string"), "phone": F.col("phone_normalized")})
    page = analytics.list_companies(companies, "  CUSTOMER ", "", 1_000_000, 1_000)
    return page.rows.select("id", "name", "category", "city", "rating", F.lit(page.total).cast("bigint").alias("total"), F.lit(page.page).cast("bigint").alias("page"))


@query("""SELECT c_nationkey, c_custkey, (1 + 2 * row_number() OVER w - 1)::INTEGER AS line, c_name || chr(10) || '"x", y' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def delimited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as one delimited text a nation, read back by header: quotes, breaks inside fields, short rows."""
    k = F.col("c_custkey")
    row = F.concat(k.cast("string"), F.lit(';"'), F.col("c_name"), F.lit('\n""x"", y"'), F.when(k % 3 != 0, F.concat(F.lit("; "), F.col("c_mktsegment"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda x: x["row"])
    files = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("id;name;segment\r\n"), F.array_join(lines, "\r\n")).alias("text"))
    spark.udtf.register("corvane_parse_delimited", delimited.ParseDelimited)
    files.createOrReplaceTempView("corvane_delimited_rows")
    rows = spark.sql("SELECT c_nationkey, line, values FROM corvane_delimited_rows, LATERAL corvane_parse_delimited(text, ';')").where("line > 1")
    named = delimited.as_map(["id", "name", "segment"], F.col("values"))
    return rows.select("c_nationkey", "line", named.alias("m")).select("c_nationkey", F.col("m")["id"].cast(_t(spark, sf_dir, "customer").schema["c_custkey"].dataType).alias("c_custkey"), "line", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS source_row, event_id::VARCHAR AS id FROM events""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a payload of one of four shapes, and the records found in it."""
    item = F.struct(F.col("event_id"), F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name")).alias("r"))
    users = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]).alias("items"))
    items, u = F.col("items"), F.col("user_id")
    shapes = [F.to_json(items), F.to_json(F.struct(F.lit(1).alias("meta"), F.struct(items.alias("items")).alias("data"))), F.to_json(F.struct(items.alias("results"))), F.to_json(F.struct(F.struct(items.alias("y"), F.array(F.struct(F.lit(1).alias("q"))).alias("z")).alias("x")))]
    payloads = users.select(F.lit("events").alias("source_file"), u.alias("source_page"), F.get(F.array(*shapes), (u % 4).cast("int")).alias("text"))
    return pages.records(payloads).select(F.col("source_page").alias("user_id"), "source_row", F.get_json_object("record", "$.id").alias("id"))


@query("""SELECT o_orderkey, o_orderkey % 4 IN (1, 2) AS broken FROM orders""")
def broken_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.lit("Москва"), F.lit("РњРѕСЃРєРІР°"), F.lit("РЎР°СЂР°С‚РѕРІ"), F.lit("Moscow"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.looks_like_mojibake(F.get(forms, (F.col("o_orderkey") % 4).cast("int"))).alias("broken"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of large parts by brand: the analytic query that a directory is asked most."""
    return filtered_share_text(spark, sf_dir)
