"""The library's entities on the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlake.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

SQL = {
    # ordered observations of a key: text that is sometimes missing, a packed value, a list value, a flag
    "observations": """
        SELECT user_id AS key, event_id AS seq,
               CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE event_type END AS label,
               CASE WHEN event_id % 5 = 0 THEN 'x; y' WHEN event_id % 5 = 1 THEN 'y ;z' ELSE event_type END AS sport,
               event_type AS tag, event_type = 'purchase' AS bought, CAST(CAST(ts AS DATE) AS STRING) AS day, value
        FROM {events}""",
    "site_outcomes": """
        SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_id AS pos, 'host' || CAST(user_id AS STRING) || '.example' AS domain,
               CASE event_type WHEN 'signup' THEN CASE WHEN user_id % 10 = 7 THEN 'error' ELSE 'ok' END WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'network' WHEN 'purchase' THEN 'no_directory' ELSE 'error' END AS status,
               CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS detail, 'https://host' || CAST(user_id AS STRING) || '.example/p' || CAST(event_id AS STRING) AS url, event_id % 4 AS people
        FROM {events}""",
    "attempts": """
        SELECT 'host' || CAST(user_id AS STRING) || '.example' AS domain, event_id AS seq, 'https://host' || CAST(user_id AS STRING) || '.example/' || CAST(event_id AS STRING) AS url,
               CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 = 1 AND event_id % 9 = 0 THEN 999 WHEN user_id % 5 = 2 AND event_id % 11 = 0 THEN 403 WHEN user_id % 5 = 2 AND event_id % 13 = 0 THEN 429
                    WHEN user_id % 5 = 3 THEN 404 ELSE 200 END AS status,
               'body' AS body, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'timeout ' || event_type END AS error, ts
        FROM {events}""",
    "people": """
        SELECT 'k' || CAST(c_custkey AS STRING) AS key, c_custkey AS id,
               CASE WHEN c_custkey % 97 = 0 THEN 'TBA' WHEN c_custkey % 89 = 0 THEN '---' WHEN c_custkey % 11 = 0 THEN 'Doe ' || CAST(c_custkey AS STRING) || ', Ann' ELSE c_name END AS name,
               lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example' AS school_domain, n_name AS school,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Basketball' WHEN 'BUILDING' THEN 'Soccer' WHEN 'FURNITURE' THEN 'Golf' WHEN 'MACHINERY' THEN '' ELSE NULL END AS sport,
               CASE WHEN c_custkey % 6 = 0 THEN 'Customer#' || CAST(c_custkey AS STRING) || '; Media' WHEN c_custkey % 6 = 1 THEN c_name WHEN c_custkey % 6 = 2 THEN 'Media; ' || c_name ELSE NULL END AS department,
               CASE c_custkey % 4 WHEN 0 THEN 'Head Coach' WHEN 1 THEN 'Assistant to the Head Coach' WHEN 2 THEN 'Director' ELSE 'assistant coaches' END AS title,
               CASE WHEN c_custkey % 3 <> 0 THEN 'u' || CAST(c_custkey % 20 AS STRING) || '@' || lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example' END AS email,
               CASE WHEN c_custkey % 5 = 0 THEN 'p' || CAST(c_custkey % 50 AS STRING) || '@mail.example' END AS email2,
               CASE WHEN c_custkey % 2 = 0 THEN '231 555 0' || CAST(100 + c_custkey % 900 AS STRING) END AS phone,
               c_custkey % 13 = 0 AS departed, CASE WHEN c_custkey % 26 = 0 THEN '2024-01-01T00:00:00Z' END AS departed_at, c_custkey % 4 IN (0, 3) AS is_coach, c_acctbal AS balance
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "institutions": """
        SELECT 'n' || substr(CAST(100 + n_nationkey AS STRING), 2, 2) AS key, n_name AS school,
               CASE n_nationkey % 5 WHEN 0 THEN 'DI' WHEN 1 THEN 'DII' WHEN 2 THEN 'NAIA' WHEN 3 THEN '' ELSE 'DI; DII' END AS division, r_name AS conference,
               CASE WHEN n_nationkey % 3 = 0 THEN lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example' END AS athletics_domain,
               CASE WHEN n_nationkey % 4 <> 0 THEN 'https://www.' || lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example/home' END AS website,
               CASE n_nationkey % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'Texas' WHEN 2 THEN 'ny' WHEN 3 THEN 'Ontario' WHEN 4 THEN 'nowhere' ELSE NULL END AS state,
               CASE WHEN n_nationkey % 2 = 0 THEN '$' || CAST(10000 + n_nationkey AS STRING) END AS "totalYearlyCost"
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "companies": """
        SELECT 's' || CAST(s_suppkey AS STRING) AS key, s_name AS company_name, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'hi@' || CAST(s_suppkey AS STRING) || '.example' END AS email,
               CASE WHEN s_suppkey % 4 = 0 THEN '+61 2 9876 54' || CAST(10 + s_suppkey % 90 AS STRING) END AS phone, CASE WHEN s_suppkey % 5 < 2 THEN TRUE WHEN s_suppkey % 5 < 4 THEN FALSE END AS has_open_roles,
               CASE s_suppkey % 3 WHEN 0 THEN 'retail' WHEN 1 THEN 'mining' ELSE NULL END AS hint1, CASE s_suppkey % 7 WHEN 0 THEN 'finance' WHEN 1 THEN 'retail trade' ELSE NULL END AS hint2,
               CASE WHEN s_suppkey % 6 = 0 THEN 'https://linkedin.com/company/' || CAST(s_suppkey AS STRING) END AS linkedin, s_acctbal AS balance
        FROM {supplier}""",
    "rosters": """
        SELECT DISTINCT lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example' AS domain, 'k' || CAST(o_custkey AS STRING) AS key
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 AND (n_nationkey % 4 <> 1 OR o_custkey % 3 = 0)""",
    # spreadsheet rows, some of which name an institution
    "sheet": """
        SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 4 = 0 THEN 'The University of ' || n_name WHEN s_suppkey % 4 = 1 THEN n_name ELSE s_name END AS school,
               CASE n_nationkey % 6 WHEN 0 THEN 'California' WHEN 1 THEN 'TX' WHEN 2 THEN 'New York' WHEN 3 THEN 'ON' ELSE NULL END AS state,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'https://' || lower(replace(replace(n_name, ' ', '-'), '_', '-')) || '.example/team' ELSE 'http://www.team' || CAST(s_suppkey AS STRING) || '.example' END AS link
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name].replace('"', "`")
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def cte(*names: str) -> str:
    """The adapters as common table expressions for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)
