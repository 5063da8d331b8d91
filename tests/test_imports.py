import json

import pytest

from corvane import schemas
from corvane.plans import analytics, imports
from corvane.sources.store import Store
from corvane.streaming import ingest


def company(i, **changes):
    return {"id": f"c_{i:06d}", "name": f"Компания {i}", "category": "Ресторан" if i % 3 else "", "city": "Москва" if i % 2 else "Омск", "address": f"ул. {i}", "rating": 4.0 + i % 10 / 10, "reviews_count": i * 7 % 40, "site": f"https://s{i}.ru", "phone": "8 (921) 555-12-34"} | changes


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "pages"
    made.mkdir()
    (made / "page_1.json").write_text(json.dumps({"page": 1, "items": [company(i) for i in range(1, 21)]}))
    (made / "page_2.json").write_text(json.dumps({"page": 2, "items": [company(3, reviews_count=39, rating=5.0, name="Компания 3 новая"), company(3, rating=None), company(21), {"id": "c_9"}, company(22, rating=9, site="x", phone="abc")]}))
    return str(made)


@pytest.mark.parametrize("general", [True, False])
def test_pages(store, folder, general):
    counters = imports.import_pages(store, folder, general=general)
    assert counters == {"files_seen": 2, "rows_seen": 25, "rows_rejected": 1, "warnings": 5, "rows_inserted": 22, "rows_updated": 2}
    companies = {r.external_id: r for r in store.read("companies").collect()}
    third = companies["c_000003"]
    assert len(companies) == 22 and third.name == "Компания 3" and third.source_file == "page_2.json" and third.source_row == 2  # a batch keeps its last row whole
    assert third.phone == "8 (921) 555-12-34" and third.phone_normalized == "+79215551234" and third.website == "https://s3.ru/" and companies["c_000022"].rating is None
    assert schemas.violations("companies", store.read("companies")).collect() == [] and schemas.orphans(store.read("import_issues"), "import_run_id", store.read("import_runs")).isEmpty()
    codes = sorted(r.code for r in store.read("import_issues").collect())
    assert codes == ["DUPLICATE_SOURCE_RECORD", "DUPLICATE_SOURCE_RECORD", "INVALID_PHONE", "INVALID_RATING", "INVALID_WEBSITE", "MISSING_NAME"]
    ids = {r.external_id: r.id for r in store.read("companies").collect()}
    again = imports.import_pages(store, folder, general=general)
    assert (again["rows_inserted"], again["rows_updated"]) == (0, 24) and ids == {r.external_id: r.id for r in store.read("companies").collect()}
    assert store.read("import_runs").count() == 2 and store.read("import_issues").count() == 12
    imports.import_pages(store, folder, replace=True, general=general)
    assert store.read("import_runs").count() == 1 and store.read("import_issues").count() == 6


def test_small_batches_merge(store, folder):
    imports.import_pages(store, folder, batch=1)
    third = store.read("companies").where("external_id = 'c_000003'").first()
    assert (third.name, third.reviews_count, float(third.rating)) == ("Компания 3 новая", 39, 5.0)


def test_failures_change_nothing_but_the_ledger(store, folder, tmp_path):
    imports.import_pages(store, folder)
    (tmp_path / "pages" / "page_3.json").write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        imports.import_pages(store, folder)
    assert store.read("companies").count() == 22 and [r.status for r in store.read("import_runs").orderBy("id").collect()] == ["completed", "failed"]
    with pytest.raises(ValueError):
        imports.import_review(Store(store.spark, str(tmp_path / "none")), __file__)


def test_a_stopped_import_leaves_the_old_state(store, folder, monkeypatch):
    imports.import_pages(store, folder)
    before = {r.external_id for r in store.read("companies").collect()}

    def stopped(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "commit", stopped)
    with pytest.raises(KeyboardInterrupt):
        store.write(companies=store.read("companies").limit(1), import_issues=store.read("import_issues").limit(0))
    monkeypatch.undo()
    assert {r.external_id for r in store.read("companies").collect()} == before and store.read("import_issues").count() == 6
    monkeypatch.setattr(imports, "_import_pages", stopped)  # as if the process were killed within
    with pytest.raises(KeyboardInterrupt):
        imports.import_pages(store, folder)
    assert [r.status for r in store.read("import_runs").orderBy("id").collect()] == ["completed", "running"]


def test_a_lost_pointer_is_an_error(store, folder, spark):
    imports.import_pages(store, folder)
    path = store._path("CURRENT")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    with pytest.raises(FileNotFoundError):
        store.read("companies")


def test_review(store, folder, tmp_path):
    imports.import_pages(store, folder)
    path = tmp_path / "review.csv"
    path.write_text("id,name,category,city,address,rating,reviews_count,site,phone\nc_000001,Компания 1,Ресторан,Москва,ул. 1,4.1,7,https://s1.ru,8 (921) 555-12-34\nc_900001,Компания 2,Ресторан,Омск,ул. 2,4.2,14,https://s2.ru,8 921 5551234\n,,,,,,,,\n")
    counters, report = imports.import_review(store, str(path))
    assert counters["rows_seen"] == counters["rows_inserted"] == 3 and counters["rows_rejected"] == 2 and "Disguised" in report
    rows = store.read("review_rows").orderBy("source_row").collect()
    assert [r.is_valid for r in rows] == [True, False, False] and [r.matched_company_id is not None for r in rows] == [True, True, False]
    imports.import_review(store, str(path), replace=True)
    assert store.read("review_rows").count() == 3 and store.read("import_runs").count() == 2


def test_health_and_listing(store, folder):
    imports.import_pages(store, folder)
    found = {k: v.collect() for k, v in analytics.health(*[store.read(t) for t in ("companies", "import_issues", "review_rows")]).items()}
    assert found["summary"][0].companies == 22 and found["top_categories"][0].category == "Ресторан" and found["top_categories"][1].category == "Без категории"
    assert [r.website_share_percent for r in found["website_share"]] == sorted((r.website_share_percent for r in found["website_share"]), reverse=True)
    companies = store.read("companies")
    page = analytics.list_companies(companies, " КОМПАНИЯ  1", "омск", 99, 3)
    assert page.total == 5 and page.page == page.total_pages == 2 and [r.name for r in page.rows.collect()] == ["Компания 16", "Компания 18"]
    assert analytics.list_companies(companies, "%я 2_").total == 3 and analytics.list_companies(companies, "\\q").total == 0
    assert [tuple(r) for r in analytics.facet(companies, "city_normalized", "city").collect()] == [("москва", "Москва"), ("омск", "Омск")]


def test_pager():
    assert analytics.page_of(0) == (1, 25, 1) and analytics.page_of(101, 9, 1000) == (2, 100, 2) and analytics.page_of(10, -1, 0) == (1, 1, 10)
    assert analytics.page_numbers(5, 9) == [1, None, 4, 5, 6, None, 9] and analytics.page_numbers(1, 1) == [1] and analytics.page_numbers(2, 3) == [1, 2, 3]


def test_stream(store, folder, tmp_path):
    query = ingest.start(store, folder, str(tmp_path / "checkpoint"), once=True, files_a_batch=1)
    query.awaitTermination(120)
    assert store.read("companies").count() == 22
