"""Reports, feeds, plan, registry, streaming, and registered queries."""

import pytest
from check_oracle import TABLES, compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadloom.queries import registered
from leadloom import rules
from leadloom.operators import crm, report, sync
from leadloom.plans import matrix as mx
from leadloom.sources import catalogue as cat
from leadloom.sources.sinks import add_missing_columns, append_run, write_export


def test_plan_covers_everything(spark):
    plan = {**rules.PLAN, "categories": ["A", "B", "C"], "roles": ["Manufacturer", "Factory", "X"], "places": ["P"], "roleless_categories": ["G"], "daily_limit": 4}
    assert mx.plan_size(plan) == 10 == len(mx.plan_requests(plan)) and mx.days_per_sweep(10, 4) == 3
    table = [(r.category, r.role, r.place) for r in mx.matrix(spark, plan).orderBy("idx").collect()]
    assert table == mx.plan_requests(plan)
    days = [{r.query for r in mx.daily_requests(spark, day, plan).collect()} for day in (30, 31, 32)]
    assert [len(d) for d in days] == [4, 4, 2] and len(set().union(*days)) == 10
    assert mx.plan_size() == 760 and mx.days_per_sweep(760, 12) == 64


def test_interactive_guard(spark):
    assert mx.interactive_requests(spark, [], ["a", "b"], [], ["r"]).count() == 2
    with pytest.raises(ValueError):
        mx.interactive_requests(spark, ["e"], [str(i) for i in range(11)], [str(i) for i in range(11)], [])


def test_source_gate(spark):
    c = cat.catalogue(spark)
    assert "facebook" not in {r.source for r in cat.available(c, ["FEATURE_FACEBOOK"]).collect()}
    wanted = spark.createDataFrame([("facebook",), ("aece",), ("nobody",), ("egydir",)], "source string")
    assert {r.source for r in cat.requested(c, wanted, []).collect()} == {"aece", "egydir"}
    assert {r.source for r in cat.requested(c, wanted, ["FEATURE_FACEBOOK"]).collect()} == {"facebook", "aece", "egydir"}


def test_registry(spark):
    @cat.register_extractor("mine")
    def mine(pages):
        return pages.select(F.lit("mine").alias("source"), F.col("html").alias("company_name"))

    pages = spark.createDataFrame([("mine", "A"), ("other", "B")], "source string, html string")
    with pytest.warns(UserWarning):
        rows = cat.extract_all(pages, ["mine", "missing"]).collect()
    assert [(r.source, r.company_name, r.phone_raw) for r in rows] == [("mine", "A", None)]
    cat._EXTRACTORS.pop("mine")


def test_source_health(spark):
    done = spark.createDataFrame([("a", "keep", None), ("a", "drop", None), ("b", "quarantine", "no_contact")], "source string, outcome string, reason string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    errors = spark.createDataFrame([("b", "timeout"), ("d", "403 Forbidden")], "source string, error string")
    stats = report.source_stats(done, asked, errors)
    assert {r.source: (r.found, r.errors, r.health) for r in stats.collect()} == {"a": (2, 0, "ok"), "b": (1, 1, "error"), "c": (0, 0, "empty"), "d": (0, 1, "blocked")}
    row = report.run_row(stats, 7, F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), {"city": None}).first()
    assert (row.found, row.kept, row.status, row.error) == (3, 1, "done_with_errors", "b: timeout; d: 403 Forbidden") and row.source_stats["a"].health == "ok"
    assert {r.outcome: r.reasons for r in report.reason_maps(done).collect()} == {"drop": {"unknown": 1}, "quarantine": {"no_contact": 1}}


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in (1, 2):
        append_run(spark.range(1).select(F.lit(i).alias("run_id")), path)
    assert sorted(r.run_id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_feed_alignment_and_append(spark, tmp_path, sf):
    leads = entry.registered()["export_table"]  # the crm rows behind it are reused below
    from leadloom.queries.base import crm_leads

    rows = crm_leads(spark, sf).limit(50)
    header = ["Company", "Status", "Sales Name", "Status"]
    assert sync.full_header([]) == rules.FEED_HEADER + rules.FEED_ADDED and len(sync.full_header(header)) == 14
    aligned = sync.aligned_rows(rows, sync.full_header(header), F.lit("2024-01-01"))
    first = aligned.first().asDict()
    assert first["Status"] == "new" and first["Status_4"] == "" and first["Sales Name"] == "" and first["Added Date"] == "2024-01-01"
    path = str(tmp_path / "feed")
    keyed = rows.where("phone_e164 IS NOT NULL AND NOT pushed_to_sheet")
    sync.append_new(keyed, path, [], F.lit("2024-01-01"))
    before = spark.read.parquet(path).count()
    sync.append_new(keyed, path, [], F.lit("2024-01-02"))
    assert before == keyed.count() == spark.read.parquet(path).count() and leads is not None


def test_pushed_and_changes(spark):
    leads = spark.createDataFrame([(1, "new", None, False, None, None), (2, "won", "n", False, None, None)],
                                  "lead_id long, status string, notes string, pushed_to_sheet boolean, sheet_synced_at timestamp_ntz, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "contacted", "x"), (9, "lost", "y")], "lead_id long, status string, score string")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    got = {r.lead_id: (r.status, r.notes, r.updated_at is not None) for r in crm.apply_changes(leads, changes, now).collect()}
    assert got == {1: ("contacted", None, True), 2: ("won", "n", False)}
    assert {r.lead_id: r.pushed_to_sheet for r in crm.mark_pushed(leads, leads.where("lead_id = 2"), now).collect()} == {1: False, 2: True}


def test_migration_twice(spark):
    old = spark.createDataFrame([(1,)], "lead_id long")
    once = add_missing_columns(old, {"a": "string", "b": "boolean"})
    assert once.columns == add_missing_columns(once, {"a": "string", "b": "boolean"}).columns == ["lead_id", "a", "b"]


def test_export_file(spark, tmp_path, sf):
    from leadloom.queries.base import crm_leads

    path = str(tmp_path / "export")
    write_export(crm_leads(spark, sf), path)
    back = spark.read.option("header", "true").csv(path)
    assert back.columns == list(rules.EXPORT_COLUMNS.values()) and back.count() == crm_leads(spark, sf).count()


def test_no_bad_plans(spark, sf):
    """No nested-loop or crosswise join, and rank limits run before the shuffle."""
    queries = entry.queries()
    for name in ("new_contacts", "existing_matches", "plan_yield", "requests_due", "interactive_matrix"):
        plan = queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    for name in ("capped_listings", "first_per_phone", "newest_order_per_customer"):
        assert "WindowGroupLimit" in queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), name


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "lead_id"


SLOW = {"entity_assignment", "entity_leads", "incremental_leads", "upsert_counts", "streamed_leads", "source_coverage", "coverage_drops", "enrichment_effect", "all_layouts"}


@pytest.fixture(scope="session")
def con(sf):
    assert len(TABLES) == 14
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in set(registered()) - SLOW) + ["entity_leads", "incremental_leads", "streamed_leads", "all_layouts"])
def test_query_agrees_with_sql(spark, con, sf, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf) is None


def test_runs_end_to_end(spark, tmp_path):
    import datetime as dt

    from leadloom.plans.run import daily_run, run_search
    from leadloom.sources.sinks import read_leads

    leads, runs, feed = (str(tmp_path / n) for n in ("leads", "runs", "feed"))
    rows = [(i, f"Firm {i % 6}", "a" if i % 2 else "b", f"https://d.example/{i}", f"010{i % 6:08d}", "Cosmetics" if i % 3 else None, "Cairo") for i in range(12)]
    rows += [(12, "--", "a", "u12", "01099999999", None, None), (13, "No Contact", "a", "u13", None, None, None)]
    listings = spark.createDataFrame(rows, "pos long, company_name string, source string, source_url string, phone_raw string, category string, city string")
    asked = spark.createDataFrame([("a",), ("b",), ("silent",), ("down",)], "source string")
    errors = spark.createDataFrame([("down", "429 too many requests")], "source string, error string")
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    row = run_search(listings, leads, runs, run_id=1, sources=asked, started=t, finished=t, errors=errors, max_results=100, params={"country": "Egypt"}).first()
    assert (row.found, row.kept, row.dropped, row.quarantined, row.created, row.updated) == (14, 12, 0, 2, 6, 6)
    assert {k: v.health for k, v in row.source_stats.items()} == {"a": "ok", "b": "ok", "silent": "empty", "down": "blocked"} and row.status == "done_with_errors"
    again = run_search(listings, leads, runs, run_id=2, sources=asked, started=t, finished=t, max_results=2).first()
    assert (again.found, again.created, again.updated) == (4, 0, 4)
    assert read_leads(spark, leads).count() == 6 and spark.read.parquet(runs).count() == 2
    plan = {**rules.PLAN, "daily_limit": 1000, "council_sources": ["b"], "directory_sources": ["a"]}
    answers = listings.withColumn("request_no", F.when(F.col("source") == "a", F.col("pos"))).withColumn("city", F.lit("Elsewhere"))
    day = daily_run(answers, leads, runs, feed, day=dt.date(2024, 1, 2), run_id=3, plan=plan).first()
    assert day.found == 14 and spark.read.parquet(feed).count() == 6
    none = {**plan, "daily_limit": 1, "council_sources": []}
    assert daily_run(answers.where("pos > 1"), leads, runs, feed, day=dt.date(1, 1, 1), run_id=4, plan=none).first().found == 0
    assert spark.read.parquet(feed).count() == 6 and read_leads(spark, leads).where("pushed_to_sheet").count() == 6


def test_cells_that_do_not_fit_become_null(spark):
    from leadloom.operators.qualify import conform

    rows = spark.createDataFrame([("1", "12k", "n/a", "soon", "maybe"), ("2", "12", "4.5", "2024-01-02", "true")],
                                 "pos string, followers string, rating string, last_activity_date string, has_online_store string")
    got = [(r.pos, r.followers, r.rating, str(r.last_activity_date), r.has_online_store) for r in conform(rows).orderBy("pos").collect()]
    assert got == [(1, None, None, "None", None), (2, 12, 4.5, "2024-01-02", True)]


def test_keys_of_tabs_without_key_columns(spark):
    from leadloom.operators.sync import known_keys

    assert known_keys([spark.createDataFrame([("x",)], "Notes string")]).count() == 0


def test_changes_need_an_order(spark):
    from leadloom.operators import crm

    leads = spark.createDataFrame([(1, "a", None)], "lead_id long, notes string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "x"), (1, "y")], "lead_id long, notes string")
    with pytest.raises(Exception, match="several changes"):
        crm.apply_changes(leads, changes, F.lit(None).cast("timestamp_ntz")).collect()


def test_pages_land_again_after_their_time_to_live(spark, tmp_path):
    from leadloom.streaming import jobs

    def landing(folder, rows):
        df = spark.createDataFrame([(u, t, f"{u} {t}") for u, t in rows], "url string, t string, html string").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
        return df.schema

    def kept(folder):
        return sorted((r.url, r.html.split(" ", 1)[1]) for r in spark.read.parquet(str(tmp_path / f"{folder}-out")).collect())

    def ingest(folder, schema, files):
        jobs.ingest_pages(spark, str(tmp_path / folder), schema, str(tmp_path / f"{folder}-out"), str(tmp_path / f"{folder}-state"), files_per_batch=files)

    days = [[("u", "2024-01-01 00:00:00"), ("v", "2024-01-01 10:00:00"), ("u", "2024-01-01 23:59:59"), ("v", "2024-01-02 10:00:00")],
            [("u", "2024-01-05 00:00:00"), ("v", "2024-01-02 11:00:00"), ("u", "2024-01-05 00:00:00")], [("u", "2024-01-09 00:00:00"), ("u", "2024-01-04 12:00:00")]]
    want = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-05 00:00:00"), ("u", "2024-01-09 00:00:00"), ("v", "2024-01-01 10:00:00"), ("v", "2024-01-02 10:00:00")]
    for day in days:  # three runs
        schema = landing("runs", day)
        ingest("runs", schema, 1000)
    assert kept("runs") == want
    for day in days:  # one run, a batch a file
        landing("files", day)
    ingest("files", schema, 1)
    assert kept("files") == want
    landing("one", [row for day in days for row in day if row[1] != "2024-01-04 12:00:00"])  # one file
    ingest("one", schema, 1000)
    assert kept("one") == want


def test_feed_keys_are_looked_up_in_few_buckets(spark, tmp_path):
    from leadloom.sources import key_index

    def keys(texts):
        return spark.createDataFrame([(t,) for t in texts], "key string")

    opened = []
    for n in (200, 2000):
        path = str(tmp_path / f"index{n}")
        key_index.add(spark, path, keys([f"k{i}" for i in range(n)]), ["a"], ["Phone"])
        found = key_index.known(spark, path, keys(["k7", "k7", "none", "k199"]))
        assert sorted(r.key for r in found.collect()) == ["k199", "k7"]
        opened.append(len([f for f in found.inputFiles() if "/keys/" in f]))
    assert max(opened) <= 2
    for k in range(6):
        key_index.add(spark, path, keys([f"b{k}", "k1"]), [f"f{k}"], ["Phone", "Email"])
    done = key_index.parts(spark, path)
    assert len(done) < 6 and {f for p in done for f in p.files} == {"a", *(f"f{k}" for k in range(6))}
    assert sorted(r.key for r in key_index.known(spark, path, keys(["b0", "b5", "k1", "x"])).collect()) == ["b0", "b5", "k1"]


def test_feed_files_without_keys_are_read_first(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("+201012345678", "By Hand")], "Phone string, Company string").write.parquet(feed)  # not written by an append
    leads = spark.createDataFrame([(1, "+201012345678", None, None, False), (2, "+201112345678", None, None, False), (3, None, None, None, False)],
                                  "lead_id long, phone_e164 string, domain string, email string, pushed_to_sheet boolean")
    flagged = sync.flag_new_for(leads, feed, [])
    assert {r.lead_id: r.is_new for r in flagged.collect()} == {1: False, 2: True, 3: True}
