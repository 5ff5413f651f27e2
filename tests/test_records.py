"""Vendors' items, model profiles and small helpers on cases read off by hand."""

import json

import pytest

from tallyhound.operators import validate
from tallyhound.sources import normalize


def items(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "index int, raw string")


def reasons(bad):
    return {r["index"]: r.reason for r in bad.collect()}


def test_vendor_companies(spark):
    haulage = {"name": "Northgate Haulage", "website": "https://northgate-haulage.co.uk", "industry": "Logistics and Supply Chain", "description": "Regional freight.", "employeeCount": 420}
    builder = {"name": "Devtools Inc", "website": "https://devtools.io", "industry": "Software Development", "description": "We build developer tools for retail."}
    rows = items(spark, haulage, builder, {"name": "Some Co", "website": "https://www.linkedin.com/company/some-co", "industry": "Logistics"}, {"orgTitle": "Renamed Co", "site": "https://renamed.co.uk"}, haulage, "[1]", "broken", None,
                 {"name": "Band Co", "website": "https://band.co.uk", "industry": "Construction", "employees": "201-500"}, {**builder, "website": "northgate-haulage.co.uk"}, {"name": 5, "companyName": " Odd ", "website": "odd.org", "sector": "Water", "staffCount": "no"})
    good, bad = normalize.normalize_vendor_companies(rows)
    got = {r["index"]: r for r in good.collect()}
    assert set(got) == {0, 8, 10} and (got[0].domain, got[0].employee_count, got[8].employee_count, got[10].company_name, got[10].employee_count) == ("northgate-haulage.co.uk", 420, 201, "Odd", None)
    assert reasons(bad) == {1: "not_non_technical", 2: "no_resolvable_domain", 3: "no_company_name", 4: "duplicate_domain", 5: "not_an_object", 6: "not_an_object", 7: "not_an_object", 9: "duplicate_domain"}
    every, _ = normalize.normalize_vendor_companies(rows, require_non_technical=False)
    assert {r["index"] for r in every.collect()} == {0, 1, 8, 10}
    assert normalize.normalize_vendor_companies(rows.limit(0))[0].count() == 0


def test_vendor_posts(spark):
    acme = {"text": "Help", "expandedUrl": "https://acme-distribution.com/about", "author": {"name": "Acme Distribution"}}
    rows = items(spark, {"text": "we are hiring!", "author": {"name": "Someone"}}, acme, {"text": "news", "expandedUrl": "https://t.co/abc"}, {"author": {"website": "https://bare.org"}}, acme, "7")
    good, bad = normalize.normalize_vendor_posts(rows)
    assert {r["index"]: (r.company_name, r.domain) for r in good.collect()} == {1: ("Acme Distribution", "acme-distribution.com"), 3: ("Bare", "bare.org")}
    assert reasons(bad) == {0: "no_resolvable_domain", 2: "non_company_host", 4: "duplicate_domain", 5: "not_an_object"}


def profile(spark, *payloads, page="Dana Reed is CTO; jane@acme.com"):
    df = spark.createDataFrame([(i, "ACME.com", page, json.dumps(p)) for i, p in enumerate(payloads)], "index int, domain string, page_text string, payload string")
    good, bad = validate.validate_profile(df)
    return {r["index"]: r for r in good.collect()}, reasons(bad)


def test_profiles(spark):
    clean = {"positioning": "x", "contact_routes": ["jane@acme.com"]}
    got, bad = profile(
        spark, {**clean, "technology_mentions": ["Python", "Postgres", "Python", 5, " "], "decision_makers": [{"name": "Dana Reed", "role": "CTO"}], "service_fit_evidence": "Small team"},
        {"contact_routes": ["Jane@acme.com", "ceo@totally-different.com", "not-an-email"]}, {"decision_makers": [{"name": "Dana Reed"}, {"name": "Invented Person"}, "x"]}, {"technology_mentions": [f"tech{i}" for i in range(200)]},
        {"positioning": {"nested": "object"}}, {"decision_makers": [{"role": "CTO"}]}, [], clean, {**clean, "contact_routes": ["jane@acme.com", "a@evil.com", "b@evil.com"]}, {"positioning": "x" * 601},
    )
    assert got[0].contact_routes == ["jane@acme.com"] and got[0].technology_mentions == ["Python", "Postgres"] and got[0].notes == [] and got[0].confidence == 0.65
    assert got[1].contact_routes == ["jane@acme.com"] and any("off-domain" in n for n in got[1].notes) and any("malformed" in n for n in got[1].notes)
    assert [p.name for p in got[2].decision_makers] == ["Dana Reed"] and got[2].notes == ["dropped unattested decision maker: Invented Person"]
    assert len(got[3].technology_mentions) == 25 and got[8].confidence < got[7].confidence
    assert bad == {4: "positioning isn't a text of at most 600 characters", 5: "a decision maker has no proper name or role", 6: "not_an_object", 9: "positioning isn't a text of at most 600 characters"}
    unread, _ = profile(spark, {"decision_makers": [{"name": "Anyone Else"}]}, page="")
    assert len(unread[0].decision_makers) == 1


@pytest.mark.parametrize(("columns", "told"), [("a string, b string", []), ("a string", ["missing columns: b, c"])])
def test_missing_columns(spark, columns, told):
    df = spark.createDataFrame([], columns)
    assert [r.message for r in validate.missing_columns(df, ("a", "b") if not told else ("a", "b", "c")).collect()] == told


def test_items_are_worked_out_once(spark):
    """What is taken and what is rejected are read from stored rows."""
    rows = [(1, '{"name": "A", "url": "https://a.com", "industry": "Freight"}'), (2, '{"name": "B", "url": "https://www.a.com/x", "industry": "Retail"}'), (3, "[1]"), (4, '{"name": "C", "url": "https://c.com", "industry": "Gaming"}'), (5, '{"name": "D", "url": "https://c.com", "industry": "Retail"}')]
    good, bad = normalize.normalize_vendor_companies(spark.createDataFrame(rows, "index long, raw string"))
    assert sorted(r["index"] for r in good.collect()) == [1, 5]
    assert sorted(map(tuple, bad.collect())) == [(2, "duplicate_domain"), (3, "not_an_object"), (4, "not_non_technical")]
    assert not any("parse_json" in df._jdf.queryExecution().executedPlan().toString() for df in (good, bad))
