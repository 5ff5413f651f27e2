"""Message drafts from export rows and what is known of their companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.functions import columns as c
from tallyhound.functions import terms as t


def _listed(name: str) -> Column:
    """Values of a list that aren't blank; null is empty."""
    return F.filter(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: c.blank_to_null(x).isNotNull())


def project_area() -> Column:
    """The area of the first rule of ``terms.PROJECT_AREAS`` with a word in its field; else the general one."""
    low = lambda f: F.lower(F.coalesce(F.col(f), F.lit("")) if f == "positioning" else F.array_join(_listed(f), " "))

    def hit(field: str, word: str, whole: bool) -> Column:
        return low(field).rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])") if whole else low(field).contains(word)

    rules = [(reduce(lambda a, b: a | b, (hit(*x) for x in wanted)), area) for area, wanted in t.PROJECT_AREAS]
    first = F.coalesce(*(F.when(found, area) for found, area in rules))
    return F.coalesce(first, F.lit(t.OTHER_AREA))


def basis() -> Column:
    """What a draft rests on, in one line; empty where nothing is known."""
    fit, tech = _listed("service_fit_evidence"), _listed("technology_mentions")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("positioning: "), c.trim_to_words(c.blank_to_null(F.col("positioning")), 18)),
        F.when(F.size(tech) > 0, F.concat(F.lit("tech: "), F.array_join(F.slice(tech, 1, 5), ", "))),
        F.concat(F.lit("fit: "), c.trim_to_words(F.get(fit, 0), 18)),
    )


def detail() -> Column:
    """One sentence on the company: its own words, else the first piece of evidence, else technologies, else a general one."""
    fit, tech = F.get(_listed("service_fit_evidence"), 0), _listed("technology_mentions")
    return F.coalesce(
        F.concat(F.lit("Your site says: "), c.trim_to_words(c.blank_to_null(F.col("positioning")), 24), F.lit(".")),
        F.concat(F.lit("The site points to "), c.trim_to_words(fit, 24), F.lit(".")),
        F.when(F.size(tech) > 0, F.concat(F.lit("The site mentions "), F.array_join(F.slice(tech, 1, 3), ", "), F.lit("."))),
        F.lit("The open roles point to work on product or engineering."),
    )


def message_drafts(queue: DataFrame, facts: DataFrame, pitch: str, sender: str) -> DataFrame:
    """A draft for each row of ``queue`` (``company_id, company, email, contact_name`` and others, which are kept).

    ``facts`` has one row per company: ``positioning``, and lists ``service_fit_evidence, technology_mentions, customer_terms``; companies
    without any get the general texts. Without a contact name the first word of the address is used, or ``there``.
    """
    word = F.regexp_extract(F.substring_index(F.coalesce("email", F.lit("")), "@", 1), "[A-Za-z]+", 0)
    name = F.coalesce(c.blank_to_null(F.col("contact_name")), F.when(word != "", F.initcap(word)), F.lit("there"))
    known = facts.select("company_id", "positioning", "service_fit_evidence", "technology_mentions", "customer_terms")
    rows = queue.join(known, "company_id", "left").withColumns({"contact_name": name, "project_area": project_area(), "personalization_basis": basis(), "_detail": detail()})
    body = F.array_join(F.array(
        F.concat(F.lit("Hi "), "contact_name", F.lit(",")),
        F.concat(F.lit("I saw that "), F.coalesce("company", F.lit("your team")), F.lit(" is hiring. "), "_detail"),
        F.lit(pitch),
        F.concat(F.lit("Shall I send two or three concrete ideas on "), "project_area", F.lit("?")),
        F.lit(f"Best,\n{sender}"),
    ), "\n\n")
    rows = rows.withColumns({"subject": F.concat(F.lit("Quick thought on "), "project_area"), "body": body}).withColumn("word_count", F.regexp_count("body", F.lit(r"\b[\w'-]+\b")))
    return rows.select(*(F.col(x) for x in queue.columns), F.lit("draft").alias("send_status"), "subject", "body", "word_count", "project_area", "personalization_basis")


def outcome_template(drafts: DataFrame) -> DataFrame:
    """One row per draft to fill in what became of it."""
    none = F.lit(None).cast("string")
    return drafts.select("company_id", "email", none.alias("event"), none.alias("occurred_at"), none.alias("notes"))
