"""Scalar functions on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhound.functions import columns as c

TLDS = ("com", "org", "net", "io", "ai", "dev", "co", "at", "we2")


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [
    ("https://www.Example.com/path?x=1", "example.com"), ("example.com.", "example.com"), ("process.we", None), ("middesk.comat", "middesk.com"),
    ("cockpit.at", "cockpit.at"), ("user@host.org", "host.org"), ("no dots", None), ("", None), (None, None), ("http://a.b.example.io:8080/", "a.b.example.io"),
])
def test_normalize_domain(spark, given, wanted):
    assert one(spark, c.normalize_domain(F.col("v"), TLDS), v=given) == wanted


def test_names_and_places(spark):
    assert one(spark, c.display_name(F.col("v")), v="  Acme \n Tools ") == "Acme Tools"
    assert one(spark, c.match_name(F.col("v")), v="Acme Tools, Ltd") == "acmetools"
    place = one(spark, c.split_location(F.col("v")), v=" Berlin , DE, uk ; Remote")
    assert (place.city, place.country) == ("Berlin", "United Kingdom")
    assert one(spark, c.split_location(F.col("v")), v="Paris").country is None
    assert one(spark, c.root_domain(F.col("v")), v="a.b.example.com") == "example.com"
    assert one(spark, c.title_from_key(F.col("v")), v="my_feed-one") == "My Feed One"
    assert one(spark, c.employee_count(F.col("v")), v="51-200 employees") == 51


def test_emails(spark):
    text = "Mail A.B@Example.org. or info@x.com, logo@2x.png, a..b@x.com"
    assert one(spark, c.extract_emails(F.col("v")), v=text) == ["a.b@example.org", "info@x.com"]
    assert one(spark, c.published_email(F.col("v"), tlds=TLDS), v=" Jeff+hn@X.comat; ") == "jeff+hn@x.com"
    assert one(spark, c.published_email(F.col("v"), tlds=TLDS), v="+hn@x.com") is None
    for e, mx, err, label in (("x", 1, None, "invalid_syntax"), ("a@mailinator.com", 0, None, "disposable_domain"), ("a@gmail.com", 0, None, "free_mail_domain"), ("a@x.com", 0, None, "no_mx_record"), ("a@x.com", 0, "t", "dns_error"), ("careers+q@x.com", 2, None, "role_address"), ("jane@x.com", 1, None, "deliverable_domain")):
        assert one(spark, c.deliverability(F.col("v"), F.lit(mx), F.lit(err).cast("string")), v=e) == label
    assert [one(spark, c.classify_local_part(F.col("v")), v=x) for x in ("jobs@x.y", "jane.doe@x.y", "a1@x.y")] == ["role_inbox", "person", "generic"]


def test_phones_and_links(spark):
    assert one(spark, c.normalize_phone(F.col("v")), v="tel:+49 (30)  123-4567.") == "+49 (30) 123-4567"
    assert one(spark, c.normalize_phone(F.col("v")), v="123") is None
    assert one(spark, c.presence_kind(F.col("v")), v="https://www.LinkedIn.com/company/x") == "linkedin"
    assert one(spark, c.board_key(F.lit(None).cast("string"), F.col("v"), F.lit("z")), v="https://B.io/X//") == "https://b.io/x"
    assert one(spark, c.first_url(F.col("v")), v="x; https://a.b ,https://c") == "https://a.b"


def test_roles(spark):
    assert one(spark, c.extract_role(F.col("v")), v="Ann Lee, Head of Growth and CTO") == "CTO"
    assert one(spark, c.role_category(F.col("v")), v="Vice President Of Sales") == "sales"
    assert one(spark, c.person_name(F.col("v")), v="by Ann Mary Lee,") == "Ann Mary Lee"
    assert one(spark, c.target_roles(F.col("v")), v=["HIRING_DISCOVERY", "FUNDING_EVENT"]) == ["CTO", "Founder", "Head of Talent", "VP Engineering"]


def test_numbers_and_time(spark):
    row = spark.range(1).select(c.half_even(F.lit(0.5)).alias("a"), c.half_even(F.lit(1.5)).alias("b"), c.percent(F.lit(1), F.lit(8)).alias("p"), c.percent(F.lit(1), F.lit(0)).alias("z"), c.age_days(F.lit(datetime(2024, 1, 1, 12)), F.lit(datetime(2024, 1, 3, 11))).alias("d"), c.age_days(F.lit(datetime(2024, 1, 9)), F.lit(datetime(2024, 1, 3))).alias("n")).first()
    assert tuple(row) == (0, 2, "12.5%", "0.0%", 1, 0)


def test_evidence(spark):
    quotes = ["short", "We  run our own warehouses", "never said anywhere at all"]
    assert one(spark, c.attested(F.col("q"), F.col("t")), q=quotes, t="Here we run OUR own\nwarehouses daily.") == ["We  run our own warehouses"]
    assert one(spark, c.content_hash(F.lit('{"b":1,"a":2}')), v="") == one(spark, c.content_hash(F.lit('{ "a": 2, "b": 1 }')), v="")
    assert one(spark, c.as_list(F.col("v")), v='["a","b"]') == ["a", "b"] and one(spark, c.as_list(F.col("v")), v="plain") == ["plain"]
    assert one(spark, c.trim_sentence(F.col("v"), 12), v="One two three. four") == "One two"


def test_terms_stay_in_generated_code(spark):
    rows = spark.createDataFrame([("Python, AWS and Kubernetes",), ("nothing",), (None,)], "t string").repartition(1)
    out = rows.select("t", c.stack_terms(F.col("t"), ["python", "kubernetes", "aws"]).alias("s"), c.matched_terms(F.lower("t"), ["python", "aws"]).alias("m"))
    assert {r.t: (r.s, r.m) for r in out.collect()} == {"Python, AWS and Kubernetes": (["aws", "kubernetes", "python"], ["python", "aws"]), "nothing": ([], []), None: ([], [])}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "*(" in plan.split("Project")[0], plan
