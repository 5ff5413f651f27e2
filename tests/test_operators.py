"""Operators on small frames."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyhound.functions import terms as t
from tallyhound.operators import capture, latest, resolve, scoring, signals, upsert, validate
from tallyhound.plans import ingest
from tallyhound.plans import scoring as plans
from tallyhound.queries import QUERIES
from tallyhound.sources import files, normalize


def now():
    return F.lit(datetime(2024, 6, 1))


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_upserts(spark):
    new = spark.createDataFrame([(0, "a", "1"), (1, "a", "1"), (2, "b", "9"), (3, "a", "2"), (4, "c", "5")], "index int, k string, h string")
    old = spark.createDataFrame([("b", "9"), ("c", "4")], "k string, h string")
    got = upsert.classify_changes(new, old, ["k"], "h")
    assert rows(got.select("index", "status"), "index") == [(0, "inserted"), (1, "duplicate"), (2, "duplicate"), (3, "updated"), (4, "updated")]
    assert rows(upsert.overwrite(new, old, ["k"]), "k") == [("a", "2"), ("b", "9"), ("c", "5")]
    fill = spark.createDataFrame([(0, "a", None, "x"), (1, "a", "p", "y"), (2, "z", None, None)], "index int, k string, f string, g string")
    stored = spark.createDataFrame([("a", None, "keep")], "k string, f string, g string")
    assert rows(upsert.merge_fill_nulls(fill, stored, ["k"], ["f", "g"]), "k") == [("a", "p", "keep"), ("z", None, None)]
    once = upsert.insert_once(fill, stored, [F.col("k"), F.col("f")])
    assert rows(once.select("index"), "index") == [(1,), (2,)]
    barred = spark.createDataFrame([(0, "A@x.com", None), (1, "a@x.com", None), (2, None, "y.com"), (3, None, None)], "index int, email string, domain string")
    assert rows(upsert.add_suppression(barred, spark.createDataFrame([(None, "Y.com")], "email string, domain string")).select("index")) == [(0,)]


def test_contacts_and_parsers(spark):
    old = spark.createDataFrame([(1, "A@x.com", None, "CTO", 0.5, "old", "unverified")], "company_id long, email string, full_name string, role string, confidence double, contact_source string, verification_status string")
    new = spark.createDataFrame([(0, 1, "a@x.com", "Ann", "CEO", 0.4, "new", "verified")], "index long, " + "company_id long, email string, full_name string, role string, confidence double, contact_source string, verification_status string")
    assert rows(upsert.merge_contacts(new, old).select("email", "full_name", "role", "confidence", "contact_source")) == [("a@x.com", "Ann", "CTO", 0.5, "new")]
    versions = spark.createDataFrame([(1, "s", 1, 0.9, 5), (2, "s", 2, 0.9, 5), (3, "s", 3, 0.9, 1)], "id int, source_key string, generated_at int, success_rate double, sample_size int")
    assert rows(upsert.activate_parsers(versions).select("id", "status"), "id") == [(1, "retired"), (2, "active"), (3, "failed")]


def test_identity(spark):
    companies = spark.createDataFrame([("c1", "Known", "known.com")], "id string, canonical_name string, canonical_domain string")
    records = spark.createDataFrame([(1, 1, None, "K", "known.com"), (2, 2, None, None, "x.com"), (3, 3, None, "N", None), (4, 5, None, "New", "new.com"), (5, 4, None, "New2", "new.com"), (6, 6, "c1", "K", None)], "id int, created_at int, company_id string, name string, domain string")
    got = rows(upsert.resolve_identities(records, companies).select("id", "action"), "id")
    assert got == [(1, "match_domain"), (2, "review_missing_name"), (3, "review_missing_domain"), (4, "match_domain"), (5, "create"), (6, "backfill")]


JOBS = "company_id string, ats_provider string, ats_board_id string, external_job_id string, title string, department string, description_text string, url string, posted_at timestamp, first_seen_at timestamp, is_active boolean, missing_since_at timestamp, missing_observation_count int"


def job(i, title, seen, text="", active=True, dept="Engineering"):
    return ("c1", "lever", "b1", str(i), title, dept, text, f"https://j/{i}", None, seen, active, None, 0)


def test_job_signals(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 5, 20)
    jobs = spark.createDataFrame([job(1, "Backend Engineer", old), job(2, "Account Executive", old), job(3, "Operations Platform Lead", new, "Python api and internal tooling"), job(4, "Engineer", datetime(2024, 3, 20))], JOBS).withColumn("stack_terms", F.array().cast("array<string>"))
    got = rows(signals.job_signals(jobs, now()).select("external_job_id", "signal_type"), "external_job_id", "signal_type")
    assert got == [("1", "STALE_ENGINEERING_ROLE"), ("3", "OPERATIONS_SOFTWARE_NEED"), ("3", "TECH_STACK_NEED"), ("4", "AGING_ENGINEERING_ROLE")]
    fresh = spark.createDataFrame([job(i, "Developer", new) for i in range(3)], JOBS)
    spike = signals.hiring_spikes(fresh, fresh, now()).first()
    assert spike.job_count == 3 and spike.job_urls == ["https://j/0", "https://j/1", "https://j/2"]
    once = signals.missing_observations(fresh, fresh.limit(1), now())
    twice = signals.missing_observations(once, fresh.limit(1), now())
    assert sorted(rows(twice.select("external_job_id", "missing_observation_count", "is_active"))) == [("0", 0, True), ("1", 2, False), ("2", 2, False)]
    assert twice.filter("missing_since_at IS NOT NULL").count() == 2


def test_snapshot(spark):
    companies = spark.createDataFrame([("c1", "x.com")], "id string, canonical_domain string")
    batch = spark.createDataFrame([(0, *job(1, "Engineer", datetime(2024, 5, 1))), (1, "zz", *job(2, "Engineer", datetime(2024, 5, 1))[1:])], "index int, " + JOBS).withColumns({"domain": F.lit(None).cast("string"), "stack_terms": F.array().cast("array<string>")})
    stored = spark.createDataFrame([job(1, "Engineer", datetime(2024, 2, 1), active=False), job(9, "Engineer", datetime(2024, 2, 1))], JOBS)
    none = spark.createDataFrame([], "company_id string, signal_type string, source string, source_url string")
    out = ingest.ingest_job_snapshot(batch, stored, companies, none, now())
    assert rows(out["jobs"].select("external_job_id", "is_active", "missing_observation_count", "first_seen_at"), "external_job_id") == [("1", True, 0, datetime(2024, 2, 1)), ("9", True, 1, datetime(2024, 2, 1))]
    assert rows(out["rejects"]) == [(1, "company_not_found")]
    s = out["summary"].first()
    assert (s.received, s.accepted, s.duplicates, s.rejected) == (2, 1, 1, 1)


def test_snapshot_is_merged_in_one_pass(spark):
    """Several rows of a key in the batch and in store, null keys and boards: as the merge and the search for missing jobs one after the other, and as worked out by hand."""
    day = datetime(2024, 5, 1)
    one = lambda i, board="b1", company="c1", provider="lever", active=True, seen=day, n=0, title="T": (company, provider, board, i, title, None, None, None, None, seen, active, None, n)
    old = spark.createDataFrame([one("a", seen=datetime(2024, 1, 1), active=False, n=3), one("a", seen=datetime(2024, 2, 1)), one("gone"), one("gone", n=1), one("off", active=False), one("else", board="b9"), one("early", board="b2"), one("n", provider=None, seen=datetime(2024, 1, 5)), one("m", provider=None), one("x", board=None), one("y", company=None)], JOBS)
    new = spark.createDataFrame([(2, *one("a", title="Last")), (1, *one("a", board="b2", title="First")), (3, *one("n", provider=None)), (4, *one("new", board=None))], "index int, " + JOBS)
    keys, scope = ingest.JOB_KEYS, signals.BOARD
    merged = upsert.merge_jobs(new, old, keys)
    want = signals.missing_observations(merged, new, now())
    got = upsert.observe_jobs(new, old, keys, scope, now())
    assert sorted(map(repr, rows(got))) == sorted(map(repr, rows(want))) and got.columns == old.columns
    short = sorted((r.external_job_id, r.title, r.is_active, r.missing_observation_count, r.missing_since_at is not None, r.first_seen_at.month) for r in got.collect())
    assert short == [
        ("a", "Last", True, 0, False, 1), ("early", "T", True, 1, True, 5), ("else", "T", True, 0, False, 5), ("gone", "T", False, 2, True, 5), ("gone", "T", True, 1, True, 5),
        ("m", "T", True, 1, True, 5), ("n", "T", True, 0, False, 1), ("new", "T", True, 0, False, 5), ("off", "T", False, 0, False, 5), ("x", "T", True, 1, True, 5), ("y", "T", True, 0, False, 5),
    ]


def test_snapshot_reads_its_tables_once(spark):
    plan = QUERIES["job_snapshot"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2  # stored ones and those of the batch


def test_rows_without_domain_do_not_meet(spark):
    """Neither in one task nor, where a batch has no domains at all, in a join."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        companies = spark.range(4000).select("id", F.concat(F.lit("d"), "id", F.lit(".com")).alias("canonical_domain"))
        batch = spark.range(5000).select(F.col("id").alias("index"), F.when(F.col("id") < 4500, F.col("id")).alias("company_id"), F.when(F.col("id") % 100 == 7, F.concat(F.lit("d"), F.col("id") % 1000, F.lit(".com"))).alias("domain"))
        got = resolve.with_company(batch, companies)
        assert max(r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("resolved_id")).collect()) < 2500
        assert {(r["index"], r.resolved_id) for r in got.collect()} == {(i, i if i < 4000 else i % 1000 if i % 100 == 7 else None) for i in range(5000)}
        bare = resolve.with_company(batch.withColumn("domain", F.lit(None).cast("string")), companies)
        assert bare._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_discovery(spark):
    batch = spark.createDataFrame([(0, "s", "r1", "u1", "Acme", "https://acme.com", None, "funding", None, None, None), (1, "s", "r2", "u2", "Acme", None, "acme.com", "tender", "sum", None, None), (2, "s", "r3", "u3", None, None, "q.com", "x", None, None, None), (3, "s", "r4", "u4", "N", None, None, "x", None, None, None)], "index int, source string, source_record_id string, source_url string, company_name string, website string, domain string, event_type string, event_summary string, description string, event_date date")
    records = spark.createDataFrame([], "source string, source_record_id string, content_hash string")
    companies = spark.createDataFrame([], "id string, canonical_domain string")
    stored = spark.createDataFrame([], "company_id string, signal_type string, source string, source_url string")
    out = ingest.ingest_discovery(batch, records, companies, stored, now())
    assert rows(out["rejects"], "index") == [(2, "missing_company_name"), (3, "missing_domain")]
    assert rows(out["companies"].select("domain", "canonical_name")) == [("acme.com", "Acme")]
    assert rows(out["signals"].select("signal_type", "confidence", "description"), "signal_type") == [("FUNDING_EVENT", 0.8, "Acme discovered from s."), ("PROCUREMENT_NOTICE", 0.9, "sum")]


def test_scoring_rules(spark):
    tiers = spark.createDataFrame([("non_technical_buyer", ["FUNDING_EVENT"], ["person"], False), ("non_technical_buyer", ["FUNDING_EVENT"], ["role_inbox"], False), ("non_technical_buyer", ["PROCUREMENT_HISTORY"], [], False), ("agency", [], [], False), ("unclear", ["FUNDING_EVENT"], [], False)], "k string, s array<string>, p array<string>, e boolean")
    got = [r.x.tier for r in tiers.select(scoring.tier_company(F.col("k"), F.col("s"), F.col("p"), F.col("e"), F.array().cast("array<string>")).alias("x")).collect()]
    assert got == ["A", "B", "C", "X", "D"]
    decay = [r.x for r in spark.createDataFrame([(30,), (31,), (91,), (181,)], "d int").select(scoring.decay(now() - F.make_dt_interval(F.col("d")), now()).alias("x")).collect()]
    assert decay == [1.0, 0.8, 0.55, 0.25]
    orgs = spark.createDataFrame([("a", "a.com", 40), ("b", "b.com", 3), (None, "c.com", None)], "login string, domain string, public_repos int").withColumn("repos", F.lit(None).cast("array<struct<pushed_at:timestamp,language:string>>"))
    assert [r.signal_type for r in signals.org_signals(orgs, now()).orderBy("domain").collect()] == list(t.ORG_TYPES)


def test_global_rank(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id") % 50).repartition(7)
    got = latest.global_rank(df, F.col("v").desc(), F.col("id")).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)


def test_global_rank_over_coalesced_ranges(spark):
    """Wide rows in many ranges that adaptive execution merges: no row is lost, and all ranks are right."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        n = 40_000
        df = spark.range(n).select("id", F.xxhash64("id").alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = latest.global_rank(df, F.col("v").desc(), F.col("id"))
        rows = got.select("id", "v", "rank").collect()
        assert [r.id for r in sorted(rows, key=lambda r: r.rank)] == [r.id for r in sorted(rows, key=lambda r: (-r.v, r.id))] and sorted(r.rank for r in rows) == list(range(1, n + 1))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_changes_of_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "h1"), ("a", "h1"), ("a", "h2")], "k string, h string")
    new = spark.createDataFrame([(1, None, "h1"), (2, None, "h2"), (3, "a", "h2"), (4, "b", "h1")], "index int, k string, h string")
    got = upsert.classify_changes(new, old, ["k"], "h").orderBy("index").collect()
    assert [r.status for r in got] == ["duplicate", "updated", "duplicate", "inserted"] and got[0].asDict().keys() == {"index", "k", "h", "status"}
    rows = spark.createDataFrame([(1, None, None)], "id int, review_verdict string, reviewed_at timestamp")
    verdicts = spark.createDataFrame([(1, "accurate", 1), (1, "unclear", 2), (1, "nonsense", 3)], "id int, verdict string, index int")
    assert [r.review_verdict for r in upsert.apply_verdicts(rows, verdicts, now()).collect()] == ["unclear"]


def test_send_ready_csv(spark, tmp_path):
    """The export has every column that the writer fixes, in its order."""
    companies = spark.createDataFrame([(1, "A", "a.com")], "id int, canonical_name string, canonical_domain string")
    scores = spark.createDataFrame([(9, 1, 70, 80, 90, 5)], "id int, company_id int, total_score int, fit_score int, intent_score int, calculated_at int")
    contacts = spark.createDataFrame([(4, 1, "x@a.com", "manual_verified", "Jo Doe", "CTO", 0.5, "page")], "id int, company_id int, email string, verification_status string, full_name string, role string, confidence double, contact_source string")
    barred = spark.createDataFrame([], "email string, domain string")
    seen = spark.createDataFrame([(i, 1, "FUNDING_EVENT", f"raised {i}", f"https://x.y/{i}", 0.8, None) for i in range(60)], "id int, company_id int, signal_type string, description string, source_url string, confidence double, raw_evidence string").withColumn("detected_at", now())
    out = plans.send_ready_export(companies, scores, contacts, barred, scoring.trigger_evidence(seen, now()), 20, ("manual_verified",), 5)
    files.write_send_ready_csv(out, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert text[0].value == "company,domain,contact_name,role,email,verified_at,source,score,fit_score,intent_score,reason_to_write,evidence_urls,score_id,company_id,contact_id"
    row = text[1].value.split(",")
    assert row[:5] == ["A", "a.com", "Jo Doe", "CTO", "x@a.com"] and row[6:11] == ["page", "70", "80", "90", "raised 0"] and row[11].count(";") == 59 and row[12:] == ["9", "1", "4"]


def test_resolution(spark):
    contacts = spark.createDataFrame([(1, "c1", "a@x.com", 1), (2, "c1", "A@x.com", 5), (3, "c2", "b@y.com", 2)], "id long, company_id string, email string, created_at int")
    companies = spark.createDataFrame([("c1",), ("c2",)], "id string")
    asks = spark.createDataFrame([(3, None, None), (None, "c1", "a@X.com"), (None, "zz", "a@x.com"), (None, None, "a@x.com"), (None, None, "?")], "contact_id long, company_id string, email string").withColumn("i", F.monotonically_increasing_id())
    got = resolve.resolve_outcome_target(asks, contacts, companies).orderBy("i").select("target_contact", "target_company").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, "c2"), (2, "c1"), (None, None), (2, "c1"), (None, None)], key=str)
    orgs = spark.createDataFrame([("acme", "https://www.acme.io/x", 3), ("beta", None, 2), ("gamma", None, 0)], "login string, blog string, public_repos int")
    named = spark.createDataFrame([("acme.com",), ("beta.com",), ("gamma.com",)], "canonical_domain string")
    assert rows(resolve.match_org(named, orgs).select("login", "matched_by"), "login") == [("acme", "blog_brand"), ("beta", "login_exact")]


def test_validation(spark):
    boards = spark.createDataFrame([("board", "lever", "acme", "acme.com"), ("board", "lever", "x.js", "acme.com"), ("board", "lever", "other", "acme.com"), ("miss", None, None, None), ("board", "generic", None, "q.com")], "record_type string, ats_provider string, board_token string, domain string")
    assert [r.bucket for r in validate.triage_board_detections(boards).collect()] == ["keep", "quarantine", "quarantine", "miss", "keep"]
    hosts = spark.createDataFrame([("acme.com",), ("jobs.acme.com",), ("acme.lever.co",), ("github.com",), ("nodots",), ("apex.comwe",), ("a.zzz9",)], "host string")
    got = rows(validate.classify_probe_domain(hosts, t_lds := ("com", "co")).select("probe_domain", "reason"))
    assert t_lds and got == [("acme.com", "ok"), ("acme.com", "normalized_from_ats_subdomain"), (None, "ats_platform_host"), (None, "non_company_host"), (None, "not_a_hostname"), ("apex.com", "repaired_glued_tld"), (None, "invalid_tld")]
    verdict = spark.createDataFrame([("software_vendor", "true", 0.9, ["never on the page at all"], [], "hello")], "company_type string, builds_software string, confidence double, engineering_signals array<string>, buyer_signals array<string>, page_text string")
    r = validate.validate_classification(verdict).first()
    assert (r.company_type, r.builds_software, r.confidence, r.notes) == ("unclear", "unknown", 0.6, 2)


PAGE = """<html><head><title>Acme &amp; Co</title><meta name="description" content="We move freight"></head><body><script>x@y.com</script>
<h1>Acme</h1><p>Ann Lee, CEO</p><p>Write to jane.doe@acme.com or call +49 30 1234567</p><a href="mailto:Info@acme.com?subject=x">mail</a>
<a href="/careers">Senior Data Engineer</a><a href="https://linkedin.com/company/acme">in</a><a href="tel:+49301112223">call</a></body></html>"""


def test_page_capture(spark):
    pages = spark.createDataFrame([(1, "https://acme.com/about", PAGE), (2, None, None)], "page_id long, url string, html string")
    parsed = capture.parse_html(pages).withColumn("domain", F.lit("acme.com")).cache()
    first = parsed.filter("page_id = 1").first()
    assert (first.title, first.meta, first.h1) == ("Acme & Co", "We move freight", "Acme")
    mx = spark.createDataFrame([("acme.com", 1, None)], "domain string, mx_count int, error string")
    got = rows(capture.capture_emails(parsed, mx).select("email", "extraction", "contact_kind", "on_company_domain", "deliverability"), "email")
    assert got == [("info@acme.com", "mailto", "role_inbox", True, "role_address"), ("jane.doe@acme.com", "page_text", "person", True, "deliverable_domain")]
    assert rows(capture.capture_phones(parsed).select("phone", "extraction"), "phone") == [("+49 30 1234567", "page_text"), ("+49301112223", "tel")]
    assert rows(capture.capture_web_presence(parsed).select("url", "presence_kind"), "url") == [("https://acme.com/careers", "careers"), ("https://linkedin.com/company/acme", "linkedin")]
    assert rows(capture.extract_jobs_from_html(parsed.filter("page_id = 1")).select("title", "job_url")) == [("Senior Data Engineer", "https://acme.com/careers")]
    lines = latest.previous_line(parsed.select("page_id", "domain", F.posexplode("lines").alias("number", "line")), "page_id", "number", "line")
    assert rows(capture.decision_makers(lines).select("full_name", "role", "role_category")) == [("Ann Lee", "CEO", "executive")]


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('[{"b":1,"a":2}, 7]')
    (tmp_path / "j/b.json").write_text('{"items":[{"x":1},{"x":2}]}')
    (tmp_path / "j/c.json").write_text("nope")
    good, bad = files.read_json_dataset(spark, str(tmp_path / "j"))
    assert sorted(r.raw for r in good.collect()) == ['{"a":2,"b":1}', '{"x":1}', '{"x":2}'] and sorted(r.reason for r in bad.collect()) == ["not_an_object", "not_json"]
    flat = spark.createDataFrame([(1, "a", "b", None)], "id int, `p/0/n` string, `p/10/n` string, `p/2/n` string")
    assert files.rehydrate_flattened(flat, "p", "id").first().p == [{"n": "a"}, {"n": "b"}]
    (tmp_path / "f.csv").write_text("﻿ name ,x\n  Acme , 1 \n")
    assert rows(files.read_records_csv(spark, str(tmp_path / "f.csv"))) == [("Acme", "1")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme raises $5M</title><link>https://news.com/1</link><guid>g</guid><description>&lt;a href=\"https://acme.com\"&gt;</description></item></channel></rss>")
    items = files.read_feed_items(spark, str(tmp_path / "f.xml")).withColumn("index", F.lit(0))
    good, _ = normalize.normalize_funding_items(items, "feed", blocked=("news.com",))
    assert rows(good.select("company_name", "domain")) == [("Acme", "acme.com")]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id int, parent int")
    assert rows(normalize.flatten_comment_tree(tree)[0].select("id", "depth"), "path") == [(1, 0), (2, 1), (3, 2), (4, 1)]
    raw = '{"ocid":"o","parties":[{"name":"Council","roles":["buyer"],"details":{"url":"https://portal.gov"},"contactPoint":{"email":"x@council.org"}}],"tender":{"title":"T","classification":{"id":"72000000"}}}'
    got = normalize.normalize_tenders_ocds(spark.createDataFrame([(raw,)], "raw string"), ("72",), ("portal.gov",)).first()
    assert (got.company_name, got.domain, got.contact_email, got.event_summary) == ("Council", "council.org", "x@council.org", "T | 72000000")
    lever = spark.createDataFrame([('{"id":"1","text":"Senior Engineer","createdAt":0,"descriptionPlain":"Remote python","categories":{"team":"Core"}}',)], "raw string")
    row = normalize.normalize_job_payloads(lever, "lever").first()
    assert (row.title, row.department, row.remote_policy, row.seniority, row.stack_terms) == ("Senior Engineer", "Core", "remote", "senior", ["python"])
    posts = spark.createDataFrame([(0, "p", "Acme Labs | Berlin | Remote<p>We hire engineers, see https://acme.io/jobs for more"), (1, "q", "short")], "index int, id string, text string")
    good, bad = normalize.normalize_hiring_posts(posts, ("io", "com"))
    assert rows(good.select("company_name", "domain")) == [("Acme Labs", "acme.io")] and rows(bad) == [(1, "too_short")]


def test_attested_quotes_whole(spark):
    from tallyhound.operators import validate

    quote = "One  two three\nfour five six seven EIGHT"
    quotes = spark.createDataFrame([(0, quote), (250, "alpha beta gamma delta epsilon zeta eta"), (3, "Short one"), (4, " "), (5, None)], "item_id long, text string")
    docs = [(7, "x one two three four five six seven eight y"), (41, "alone two three four five six seven eighty"), (0, "one two three four five six seven"),
            (12, "alpha beta gamma delta epsilon zeta eta, one two three"), (13, "a SHORT\tone"), (14, None), (15, "")]
    got = validate.attested_quotes(quotes, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(0, 7), (0, 41), (3, 13), (250, 12)]


def test_short_quotes_meet_without_a_cross_join(spark):
    from tallyhound.operators import validate

    texts = ["one two three four five six", "wo th", "hree four five", "a", "ee", "two", "two three four five", "x  y", "x y z", "four"]
    quotes = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = [(0, "One two three four five six"), (1, "xtwo threefold four fives"), (2, "a"), (3, "x\ny zz"), (4, None), (5, "bees")]
    df = validate.attested_quotes(quotes, spark.createDataFrame(docs, "doc_id long, text string"))
    flat = lambda t: " ".join(t.split()).lower()
    assert sorted(map(tuple, df.collect())) == [(i, d) for i, q in enumerate(texts) for d, t in docs if t and flat(q) in flat(t)]
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert validate.attested_quotes(quotes.limit(0), spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_queries_over_whole_tables(spark, monkeypatch):
    from tallyhound import queries
    from tallyhound.adapters import load

    sf = "/root/testdata/sf0.001"
    companies, jobs, records, lines = load(spark, sf, "companies", "jobs", "records", "conversations")
    busy = {r.company_id for r in jobs.select("company_id").distinct().collect()}
    assert not busy & {r.id for r in queries.QUERIES["probe_targets"](spark, sf).collect()}
    assert queries.QUERIES["identity_resolution"](spark, sf).count() == records.count()
    known = {r.id for r in companies.select("id").collect()}
    turns = {(r.conv_id, r.turn) for r in lines.collect() if r.conv_id in known and r.text is not None}
    told = queries.QUERIES["message_facts"](spark, sf).collect()
    assert {(r.company_id, 3 * r.part + k) for r in told for k in range(3) if r[f"turn_{k}"] is not None} == turns
    stored, merge, insert = [], queries.u.merge_fill_nulls, queries.g.insert_signal_once
    monkeypatch.setattr(queries.u, "merge_fill_nulls", lambda new, old, *x: stored.append(old.count()) or merge(new, old, *x))
    monkeypatch.setattr(queries.g, "insert_signal_once", lambda new, old, *x: stored.append(old.count()) or insert(new, old, *x))
    for name in ("merged_records", "signals_once"):
        queries.QUERIES[name](spark, sf)
        assert stored.pop() > 0


def test_companies_are_looked_up_once(spark):
    """Found and unknown rows come from one pass; rows without an id are dealt to all tasks."""
    rows = spark.range(400).select(F.col("id").alias("index"), F.when(F.col("id") < 3, F.col("id")).alias("company_id"), F.when(F.col("id") % 2 == 0, "https://www.X.com/").alias("domain"))
    companies = spark.createDataFrame([(1, "a.com"), (7, "x.com"), (9, "X.com")], "id long, canonical_domain string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        out = resolve.with_company(rows, companies)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 2 and "lambdafunction" not in plan.split("SortMergeJoin")[0]
        assert {r["index"]: r.resolved_id for r in out.collect()} == {i: 1 if i == 1 else 7 if i % 2 == 0 else None for i in range(400)}
        of = rows.withColumn("domain", F.lit(None).cast("string"))
        sizes = [r["count"] for r in resolve.with_company(of, companies).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 and max(sizes) < 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    good, rejects = resolve.resolve_company(rows, companies)
    assert good.count() == 201 and {r.reason for r in rejects.collect()} == {"company_not_found"}
