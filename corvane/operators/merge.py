"""De-duplication and upserts as aggregates that don't depend on the order of arrival within a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_seen(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``first``, the struct of ``columns`` of the first row of the same key, and ``repeated``.

    A null key is never repeated. The order must be total for a defined result. One aggregation with map-side combine,
    joined to the rows: a key of many rows shrinks before the shuffle, and its rows need not meet in one task.
    """
    at = F.struct(*order)
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_at"), F.min_by(F.struct(*columns), at).alias("first"))
    out = rows.drop("first", "repeated").join(found, F.col(key) == F.col("_key"), "left")
    return out.withColumn("repeated", F.coalesce(at > F.col("_at"), F.lit(False))).drop("_key", "_at")


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, which goes on as the order of the key's first row.

    One aggregation with map-side combine, no window: hot keys shrink before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys and c != order]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias(order))
    return out.select(*keys, order, *[F.col(f"_last.{c}") for c in rest])


def _newest(column: str, order: str) -> Column:
    return F.max_by(F.when(F.col(column).isNotNull(), F.struct(column)), F.when(F.col(column).isNotNull(), F.col(order)))[column]


#: How columns of equal keys merge; the others keep the newest value that isn't null.
FIRST, LONGEST, LARGEST = ("external_id",), (("name", "name_normalized"),), ("reviews_count",)


def merged(history: DataFrame, key: str = "dedupe_key", order: str = "ord", newest: Sequence[str] = (), together: Sequence[Sequence[str]] = ()) -> DataFrame:
    """One row a key: what folding its rows in order, one upsert after the other, would leave.

    external_id: the first; name and its normal form: the longest, of equally long ones the newest; reviews_count: the
    largest; rating: the newest of the rows whose count of reviews was not below any before; columns ``newest``: the
    newest that isn't null; groups of columns ``together``: those of the newest row; raw_data (a map): later keys win.
    Window and aggregate share one shuffle by key, so the rows of a key pass through one task (the window may spill);
    maps are merged entry by entry beside them and combine before their shuffle.
    """
    columns = set(history.columns)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    count = F.coalesce("reviews_count", F.lit(-1))
    rows = history.withColumn("_best", F.coalesce(count >= F.max(count).over(before), F.lit(True)) & F.col("rating").isNotNull())
    out = [F.min(order).alias(order)]
    for c in FIRST:
        if c in columns:
            out.append(F.min_by(F.when(F.col(c).isNotNull(), F.struct(c)), F.when(F.col(c).isNotNull(), F.col(order)))[c].alias(c))
    for group in LONGEST:
        own = [c for c in group if c in columns]
        if own:
            best = F.max_by(F.struct(*own), F.struct(F.length(own[0]).alias("n"), F.col(order).alias("o")))
            out += [best[c].alias(c) for c in own]
    out += [F.max(c).alias(c) for c in LARGEST if c in columns]
    out.append(F.max_by(F.when(F.col("_best"), F.struct("rating")), F.when(F.col("_best"), F.col(order)))["rating"].alias("rating"))
    out += [_newest(c, order).alias(c) for c in newest]
    for group in together:
        last = F.max_by(F.struct(*group), order)
        out += [last[c].alias(c) for c in group]
    found = rows.groupBy(key).agg(*out)
    if "raw_data" not in columns:
        return found
    entries = later_entries(history, key, order).withColumnRenamed(key, "_key")
    return found.join(entries, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def later_entries(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, raw_data): the entries of all maps of a key, of equal names the newest; empty without any."""
    entry = rows.select(key, order, F.explode_outer(F.map_entries("raw_data")).alias("_e"))
    each = entry.groupBy(key, F.col("_e.key").alias("_name")).agg(F.max_by(F.struct(F.col("_e.value").alias("value")), order)["value"].alias("_value"))
    named = F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_name", "_value")))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(named)).alias("raw_data"))


COMPANY_NEWEST = ("category", "category_normalized", "city", "city_normalized", "address", "website", "website_normalized", "email", "email_normalized", "phone", "phone_normalized")
COMPANY_TOGETHER = (("source_file", "source_page", "source_row"),)


def upsert(existing: DataFrame | None, incoming: DataFrame, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """(companies, counters) after accepted ``incoming`` rows were upserted file by file, in batches of ``batch`` rows.

    Within a batch the last row of a key replaces earlier ones whole; across batches rows merge. ``incoming`` has the
    company columns and source_page, source_file, source_row; ``existing`` is the table so far. Counters are one row:
    inserted, updated (rows that met a stored or earlier key, in their batch or across).
    """
    w = Window.partitionBy("source_file").orderBy("source_row")
    rows = incoming.withColumn("_chunk", F.floor((F.row_number().over(w) - 1) / batch))
    rows = rows.withColumn("ord", F.struct(F.lit(1).alias("new"), F.lit(0).cast("bigint").alias("id"), F.col("source_page").alias("page"), F.col("source_file").alias("file"), F.col("_chunk").alias("chunk"), F.col("source_row").alias("row")))
    collapsed = keep_last(rows, ("source_file", "_chunk", "dedupe_key"), "ord").drop("_chunk")
    columns = ["dedupe_key", "ord", "external_id", "name", "name_normalized", "reviews_count", "rating", "raw_data", *COMPANY_NEWEST, *COMPANY_TOGETHER[0]]
    now = F.current_timestamp()
    history = collapsed.select(*columns, now.alias("imported_at"))
    if existing is not None:
        before = F.struct(F.lit(0).alias("new"), F.col("id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("file"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).alias("row"))
        history = existing.withColumn("ord", before).select(*columns, "imported_at").unionByName(history)
    found = merged(history, newest=COMPANY_NEWEST, together=COMPANY_TOGETHER)
    stamps = history.groupBy("dedupe_key").agg(F.min("imported_at").alias("imported_at"))
    found = found.join(stamps, "dedupe_key").withColumn("updated_at", now)
    keys = collapsed.select("dedupe_key").distinct()
    fresh = keys if existing is None else keys.join(existing.select("dedupe_key"), "dedupe_key", "left_anti")
    counted = incoming.select(F.lit(1).alias("rows"), F.lit(0).alias("inserted")).unionByName(fresh.select(F.lit(0).alias("rows"), F.lit(1).alias("inserted")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counters = counted.agg(total("inserted").alias("inserted"), (total("rows") - total("inserted")).alias("updated"))
    return found, counters
