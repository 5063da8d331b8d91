"""The two imports, from files to tables, each as one change of the store."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import extract, merge, review
from corvane.sources import delimited, pages
from corvane.sources.store import Store, numbered, without_runs

REVIEW_SOURCE, PAGES_SOURCE = "review_csv", "json_pages"


def extracted(spark: SparkSession, folder: str, general: bool = True) -> DataFrame:
    """All records of a folder's pages as companies with issues, repeats of a key in this import among them.

    ``general=False`` reads the usual shape without Python.
    """
    files = pages.read_pages(spark, folder)
    rows = extract.picked(pages.records(files)) if general else extract.picked_items(pages.items(files))
    rows = extract.companies(rows)
    accepted, rest = rows.where("accepted"), rows.where("NOT accepted")
    seen = merge.first_seen(accepted, "dedupe_key", ["source_page", "source_file", "source_row"], ["source_file", "source_row"])
    message = F.concat(F.lit("the key was seen in "), F.col("first.source_file"), F.lit(", row "), F.col("first.source_row").cast("string"))
    seen = seen.withColumn("issues", F.array_compact(F.concat("issues", F.array(extract.issue(F.col("repeated"), "warning", "DUPLICATE_SOURCE_RECORD", message)))))
    return seen.drop("first", "repeated").unionByName(rest)


def _run(spark: SparkSession, id_: int, source_type: str, name: str, started, counters: dict, metadata: dict[str, str]) -> DataFrame:
    values = {"id": id_, "source_type": source_type, "source_name": name, "started_at": started, "status": "completed", "metadata": metadata, **counters}
    schema = "id bigint, source_type string, source_name string, started_at timestamp, status string, metadata map<string,string>, files_seen int, rows_seen int, rows_inserted int, rows_updated int, rows_rejected int, warnings int"
    return spark.createDataFrame([tuple(values[f.split(" ")[0]] for f in schema.split(", "))], schema).withColumn("finished_at", F.current_timestamp())


def open_run(store: Store, source_type: str, name: str) -> int:
    """Writes a ``running`` ledger row before the work, so that an import that is killed leaves a trace. Returns its id."""
    id_ = store.next_id("import_runs")
    row = store.spark.createDataFrame([(id_, source_type, name, "running")], "id bigint, source_type string, source_name string, status string").withColumn("started_at", F.current_timestamp())
    store.write(import_runs=store.read("import_runs").unionByName(row, allowMissingColumns=True))
    return id_


def record_failure(store: Store, run: int, error: Exception) -> None:
    """Closes the ledger row of an import that changed nothing else."""
    own = F.col("id") == run
    closed = {"status": F.when(own, "failed").otherwise(F.col("status")), "finished_at": F.when(own, F.current_timestamp()).otherwise(F.col("finished_at")), "metadata": F.when(own, F.create_map(F.lit("error"), F.lit(str(error)[:500]))).otherwise(F.col("metadata"))}
    store.write(import_runs=store.read("import_runs").withColumns(closed))


def import_pages(store: Store, folder: str, replace: bool = False, general: bool = True, batch: int = 500) -> dict[str, int]:
    """Imports a folder of pages: normalise, de-duplicate, upsert, keep issues and a ledger row. Returns the counters.

    ``replace`` starts from empty tables. A failure is in the ledger and nowhere else.
    """
    run = open_run(store, PAGES_SOURCE, folder)
    try:
        return _import_pages(store, run, folder, replace, general, batch)
    except Exception as error:
        record_failure(store, run, error)
        raise


def _import_pages(store: Store, run: int, folder: str, replace: bool, general: bool, batch: int) -> dict[str, int]:
    spark, started = store.spark, _now(store.spark)
    files = pages.read_pages(spark, folder).count()
    if not files:
        raise FileNotFoundError(f"no page files in {folder}")
    staged = extracted(spark, folder, general).persist()
    try:
        existing = None if replace else store.read("companies")
        merged, counted = merge.upsert(existing, staged.where("accepted"), batch)
        warned = F.count_if(F.col("i.severity") == "warning")
        totals = staged.agg(F.count_if(F.col("source_row").isNotNull()).alias("rows_seen"), F.count_if(~F.col("accepted")).alias("rows_rejected")).first()
        issues = staged.select("source_file", F.coalesce("source_row", F.lit(0)).alias("source_row"), "raw_data", F.posexplode("issues").alias("_p", "i"))
        counters = {"files_seen": files, "rows_seen": totals.rows_seen, "rows_rejected": totals.rows_rejected, "warnings": issues.agg(warned).first()[0]}
        upserts = counted.first()
        counters |= {"rows_inserted": upserts.inserted, "rows_updated": upserts.updated}
        run = 1 if replace else run
        issues = numbered(issues, F.struct("source_file", "source_row", "_p"), 1 if replace else store.next_id("import_issues"))
        issues = issues.select("id", F.lit(run).alias("import_run_id"), "source_file", "source_row", "i.severity", "i.code", "i.message", F.to_json("raw_data").alias("raw_data"), F.current_timestamp().alias("created_at"))
        known = merged.where("ord.new = 0").withColumn("id", F.col("ord.id")).drop("ord")
        fresh = numbered(merged.where("ord.new = 1"), F.col("ord"), 1 if replace else store.next_id("companies")).drop("ord")
        ledger = _run(spark, run, PAGES_SOURCE, folder, started, counters, {"batch": str(batch), "replace": str(replace).lower()})
        changes = {"companies": known.unionByName(fresh)}
        if replace:
            changes |= {"import_runs": ledger, "import_issues": issues, "review_rows": spark.createDataFrame([], store.read("review_rows").schema)}
        else:
            changes |= {"import_runs": store.read("import_runs").where(F.col("id") != run).unionByName(ledger, allowMissingColumns=True), "import_issues": store.read("import_issues").unionByName(issues)}
        store.write(**changes)
        return counters
    finally:
        staged.unpersist()


def import_review(store: Store, path: str, replace: bool = False) -> tuple[dict[str, int], str]:
    """Audits a delimited file against the companies; stores all its rows, issues and a ledger row. Returns the counters
    and the report. ``replace`` first drops earlier audits with their issues and rows."""
    run = open_run(store, REVIEW_SOURCE, path)
    try:
        return _import_review(store, run, path, replace)
    except Exception as error:
        record_failure(store, run, error)
        raise


def _import_review(store: Store, run: int, path: str, replace: bool) -> tuple[dict[str, int], str]:
    spark, started = store.spark, _now(store.spark)
    headers, rows = delimited.split_header(delimited.read_delimited(spark, path))
    if not headers:
        raise ValueError(f"{path} is empty")
    companies = store.read("companies")
    if companies.isEmpty():
        raise ValueError("import pages first: there are no companies")
    rows = rows.withColumn("raw", delimited.as_map(headers, F.col("values")))
    problems = delimited.header_problems(headers, list(review.HEADERS))
    audited = review.audit(rows, len(headers), companies).persist()
    try:
        s = review.statistics(audited).first()
        base = without_runs(store, REVIEW_SOURCE) if replace else {t: store.read(t) for t in ("import_runs", "import_issues", "review_rows")}
        issues = audited.select("line", "raw", F.posexplode("issues").alias("_p", "i"))
        counters = {"files_seen": 1, "rows_seen": s.rows_read, "rows_inserted": s.rows_read, "rows_updated": 0, "rows_rejected": s.rows_with_errors, "warnings": issues.where("i.severity = 'warning'").count()}
        issues = numbered(issues, F.struct("line", "_p"), store.next_id("import_issues")).select(
            "id", F.lit(run).alias("import_run_id"), F.lit(path).alias("source_file"), F.col("line").alias("source_row"), "i.severity", "i.code", "i.message", F.to_json("raw").alias("raw_data"), F.current_timestamp().alias("created_at")
        )
        stored = numbered(audited, F.col("line"), store.next_id("review_rows")).select(
            "id", F.lit(run).alias("import_run_id"), F.col("line").alias("source_row"), "external_id", "name", "category", "city", "address", F.col("rating").cast("decimal(3,1)").alias("parsed_rating"),
            F.col("reviews_count").cast("int").alias("parsed_reviews_count"), "website", "website_normalized", "phone", "phone_normalized", "matched_company_id", "is_valid", "issues", F.col("raw").alias("raw_data"), F.current_timestamp().alias("created_at"),
        )
        text = review.report(audited, path, problems)
        ledger = _run(spark, run, REVIEW_SOURCE, path, started, counters, {"empty_rows": str(s.empty_rows), "unique_external_ids": str(s.unique_external_ids)})
        store.write(import_runs=base["import_runs"].where(F.col("id") != run).unionByName(ledger, allowMissingColumns=True), import_issues=base["import_issues"].unionByName(issues), review_rows=base["review_rows"].unionByName(stored))
        return counters, text
    finally:
        audited.unpersist()


def _now(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp().alias("t")).first().t


def main(args: Sequence[str] | None = None) -> None:
    """``pages FOLDER``, ``review FILE [--report FILE]`` or ``check``, each with ``--store FOLDER`` and perhaps ``--replace``."""
    from corvane.plans.analytics import health
    from corvane.session import build

    parser = argparse.ArgumentParser(prog="corvane", description=main.__doc__)
    parser.add_argument("command", choices=("pages", "review", "check"))
    parser.add_argument("path", nargs="?")
    parser.add_argument("--store", required=True)
    parser.add_argument("--replace", action="store_true")
    parser.add_argument("--report")
    given = parser.parse_args(args)
    store = Store(build(), given.store)
    if given.command == "pages":
        print(import_pages(store, given.path, given.replace))
    elif given.command == "review":
        counters, text = import_review(store, given.path, given.replace)
        print(counters)
        if given.report:
            with open(given.report, "w", encoding="utf-8") as file:
                file.write(text)
    else:
        for name, found in health(*[store.read(t) for t in ("companies", "import_issues", "review_rows")]).items():
            print(name)
            found.show(truncate=False)


if __name__ == "__main__":
    main()
