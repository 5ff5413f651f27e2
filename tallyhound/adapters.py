"""Domain frames as projections of the given tables.

The projections are plain expressions that Spark and other SQL engines read alike; the oracle SQL uses the same text as views, and all
operators on top of them are written twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Name -> (FROM clause, columns).
FRAMES: dict[str, tuple[str, str]] = {
    "companies": (
        "customer JOIN nation ON n_nationkey = c_nationkey",
        """c_custkey AS id, c_name AS canonical_name,
        CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 47 = 1 THEN 'gmail.com' ELSE concat(lower(replace(c_name, '#', '-')), '.com') END AS canonical_domain,
        CASE c_custkey % 7 WHEN 0 THEN 'Operations software' WHEN 1 THEN 'Freight and haulage' WHEN 2 THEN 'Everything' ELSE NULL END AS description,
        CASE c_custkey % 13 WHEN 0 THEN 'digital agency' WHEN 1 THEN 'crypto exchange' WHEN 2 THEN 'design studio of the council' ELSE c_mktsegment END AS industry,
        n_name AS country, CAST(NULL AS STRING) AS city, CAST(NULL AS STRING) AS company_stage, CAST(floor(abs(c_acctbal) / 10) AS INT) AS employee_estimate""",
    ),
    "signals": (
        "events",
        """event_id AS id, user_id * 10 + event_id % 10 AS company_id,
        CASE event_id % 17 WHEN 0 THEN 'PROCUREMENT_NOTICE' WHEN 1 THEN 'PROCUREMENT_HISTORY' WHEN 2 THEN 'STALE_ENGINEERING_ROLE' WHEN 3 THEN 'AGING_ENGINEERING_ROLE'
          WHEN 4 THEN 'HIRING_SPIKE' WHEN 5 THEN 'OPERATIONS_SOFTWARE_NEED' WHEN 6 THEN 'TECH_STACK_NEED' WHEN 7 THEN 'FUNDING_EVENT' WHEN 8 THEN 'PRODUCT_LAUNCH'
          WHEN 9 THEN 'HIRING_DISCOVERY' WHEN 10 THEN 'ATS_BOARD_DETECTED' WHEN 11 THEN 'GITHUB_ORG_SMALL_FOOTPRINT' WHEN 12 THEN 'NO_GITHUB_ORG_FOUND'
          WHEN 13 THEN CASE WHEN event_id % 3 = 0 THEN 'GITHUB_ENGINEERING_ORG_DETECTED' ELSE 'DISCOVERY' END ELSE 'DISCOVERY' END AS signal_type,
        concat('Evidence ', CAST(event_id % 90 AS STRING)) AS description, event_type AS source,
        CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('https://example.com/e/', CAST(event_id % 500 AS STRING)) END AS source_url,
        event_id % 240 AS days_back, ts, least(value / 500, 1.0) AS confidence,
        concat('{"title":"Role ', CAST(event_id % 40 AS STRING), '","signal":{"age_days":', CAST(60 + event_id % 90 AS STRING), '}}') AS raw_evidence""",
    ),
    "jobs": (
        "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey",
        """o_custkey AS company_id, CASE WHEN l_suppkey % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS ats_provider, l_suppkey AS ats_board_id,
        concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS external_job_id,
        concat(CASE l_linenumber WHEN 1 THEN 'Senior Backend Engineer' WHEN 2 THEN 'Product Manager' WHEN 3 THEN 'Junior Data Analyst' WHEN 4 THEN 'Account Executive'
          WHEN 5 THEN 'Operations Lead' WHEN 6 THEN 'DevOps (contract)' ELSE 'Cook' END, ', ', p_name) AS title,
        CASE l_suppkey % 3 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' ELSE NULL END AS department,
        CASE l_partkey % 5 WHEN 0 THEN 'Python api on AWS, remote' WHEN 1 THEN 'Internal tooling and reporting dashboard, full-time' WHEN 2 THEN 'Based in London, hybrid' WHEN 3 THEN 'Part time internship' ELSE NULL END AS description_text,
        CASE WHEN l_linenumber = 3 THEN o_orderdate END AS posted_at, l_shipdate AS first_seen_at, l_linestatus = 'O' AS is_active, l_returnflag,
        concat('https://jobs.example.com/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS url, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey""",
    ),
    "scores": ("orders", "o_orderkey AS id, o_custkey AS company_id, CAST(floor(o_totalprice / 5000) AS INT) AS total_score, CAST(floor(o_totalprice / 6000) AS INT) AS fit_score, o_orderdate AS calculated_at"),
    "classification": ("labels", "doc_id AS company_id, CASE WHEN toxic = 1 THEN 'software_vendor' WHEN quality = 1 THEN 'non_technical_buyer' ELSE 'unclear' END AS company_type, CASE WHEN doc_id % 4 = 0 THEN 'Rail' ELSE NULL END AS sector"),
    "contacts": (
        "customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k) parts",
        """c_custkey * 3 + k AS id, c_custkey AS company_id, concat(CASE k WHEN 0 THEN 'info' WHEN 1 THEN 'jane.doe' ELSE 'x9' END, '@', lower(replace(c_name, '#', '-')), '.com') AS email,
        CASE k WHEN 1 THEN 'Jane Doe' ELSE NULL END AS full_name, CASE WHEN k = 1 AND c_custkey % 2 = 0 THEN 'CTO' ELSE NULL END AS role,
        CASE c_custkey % 4 WHEN 0 THEN 'manual_verified' WHEN 1 THEN 'provider_verified' ELSE 'unverified' END AS verification_status,
        CASE k WHEN 0 THEN 'role_inbox' WHEN 1 THEN 'person' ELSE 'generic' END AS contact_kind, 0.5 + 0.1 * k AS confidence""",
    ),
    "suppression": ("customer JOIN labels ON doc_id = c_custkey AND toxic = 1", "CASE WHEN c_custkey % 2 = 0 THEN concat('JANE.DOE@', lower(replace(c_name, '#', '-')), '.com') ELSE NULL END AS email, CASE WHEN c_custkey % 2 = 1 THEN concat(lower(replace(c_name, '#', '-')), '.com') ELSE NULL END AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'opt_out' ELSE 'bounced' END AS reason"),
    "sources": ("(SELECT DISTINCT source FROM documents) s", "source AS id, source AS source_key, CASE WHEN length(source) % 2 = 0 THEN 'feed' ELSE 'portal' END AS source_type"),
    "records": ("documents", "doc_id AS id, source AS source_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE doc_id % 700 END AS company_id, doc_id, text, lang"),
    "boards": ("supplier", "s_suppkey AS id, s_suppkey % 90 AS company_id, CASE WHEN s_suppkey % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS ats_provider, lower(replace(s_name, '#', '-')) AS board_token"),
    "outcomes": ("events", "event_id AS id, user_id * 10 + event_id % 10 AS company_id, CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'positive_reply' WHEN 'signup' THEN 'meeting_booked' WHEN 'error' THEN 'bounced' ELSE 'opened' END AS event"),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named frames, and given tables by their own names. Views have names of their own, so that several folders can be open at once."""
    tag = "t" + format(abs(hash(sf_dir)), "x")
    out = []
    for name in names:
        if name not in FRAMES:
            out.append(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))
            continue
        source, columns = FRAMES[name]
        for t in TABLES:
            if t in source.replace("(", " ").replace(")", " ").split():
                spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(f"{tag}_{t}")
        words = source.replace("(", "( ").replace(")", " )").split(" ")
        text = " ".join(f"{tag}_{w} {w}" if w in TABLES else w for w in words)
        df = spark.sql(f"SELECT {columns} FROM {text}")
        if name == "signals":
            df = df.selectExpr("id", "company_id", "signal_type", "description", "source", "source_url", "timestampadd(DAY, CAST(-days_back AS INT), ts) AS detected_at", "confidence", "raw_evidence")
        out.append(df)
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its tables have fewer files than there are: before costly expressions on small inputs. Tables of more files
    stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def view(name: str) -> str:
    """The frame as a common table expression for the oracle."""
    source, columns = FRAMES[name]
    if name == "signals":
        return f"signals AS (SELECT * EXCLUDE (days_back, ts), ts - to_days(CAST(days_back AS INTEGER)) AS detected_at FROM (SELECT {columns} FROM {source}))"
    return f"{name} AS (SELECT {columns} FROM {source})"


def sql(names: str, body: str) -> str:
    """An oracle query: the named frames, then the body (further expressions and the select)."""
    return "WITH " + ",\n".join(map(view, names.split())) + body
