"""Derived views over the benchmark tables: one SQL text each, valid in Spark and in DuckDB.

Tables and views are written as {name}. Every view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "customer_dirty": """
SELECT c_custkey,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN '   '
       WHEN c_custkey % 29 = 0 THEN 'bad name' ELSE c_name END AS c_name,
  c_nationkey,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN c_custkey % 37 = 0 THEN CAST(5000000 AS DOUBLE) ELSE c_acctbal END AS c_acctbal,
  c_mktsegment
FROM {customer}""",
    "customer_cleaned": """
SELECT c_custkey,
  CASE WHEN c_name IS NULL OR TRIM(c_name) = '' THEN 'Unknown' ELSE LOWER(TRIM(c_name)) END AS c_name,
  c_nationkey, c_acctbal, c_mktsegment
FROM {customer_dirty} WHERE c_acctbal IS NULL OR NOT (c_acctbal = CAST(5000000 AS DOUBLE))""",
    "events_text": """
SELECT CAST(event_id AS VARCHAR(20)) AS event_id,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'not-a-date'
       ELSE SUBSTRING(CAST(CAST(ts AS DATE) AS VARCHAR(20)), 1, 10) END AS event_day,
  CASE WHEN event_id % 2 = 0 THEN '1' ELSE '0' END AS flag,
  CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END AS event_type
FROM {events}""",
    "runs": """
SELECT o_orderkey AS run_id, CONCAT('ds', CAST(o_custkey % 12 AS VARCHAR(4))) AS dataset_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL
       ELSE 40 + CAST((o_orderkey * 7919) % 6001 AS DOUBLE) / 100 END AS score,
  CAST(o_orderkey % 15 + 1 AS INT) AS rules_count, o_orderdate AS started_at
FROM {orders}""",
    "rules": """
SELECT p_partkey AS rule_id,
  CASE p_partkey % 3 WHEN 0 THEN 'catalog' WHEN 1 THEN 'table' ELSE 'column' END AS scope,
  p_size % 10 AS catalog_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS table_id,
  CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 97 ELSE NULL END AS column_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE CONCAT('f', CAST(p_partkey % 7 AS VARCHAR(4))) END AS f1,
  CASE WHEN p_partkey % 53 = 0 OR p_partkey % 2 = 0 THEN NULL
       ELSE CONCAT('f', CAST(p_partkey % 5 AS VARCHAR(4))) END AS f2,
  p_name AS natural_language, p_type AS template_category
FROM {part}""",
    "resolutions": """
SELECT LEAST(a.rule_id, b.rule_id) AS rule_lo, GREATEST(a.rule_id, b.rule_id) AS rule_hi,
  CASE WHEN again = 1 THEN b.rule_id ELSE a.rule_id END AS priority_rule_id,
  CASE WHEN again = 1 THEN a.rule_id ELSE b.rule_id END AS overridden_rule_id,
  CASE WHEN again = 1 THEN 'reviewer' ELSE 'admin' END AS resolved_by,
  CASE WHEN again = 1 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS resolved_at
FROM {rules} a
JOIN (SELECT catalog_id, MIN(rule_id) AS rule_id FROM {rules} WHERE scope = 'table' GROUP BY catalog_id) b ON a.catalog_id = b.catalog_id
CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) t
WHERE a.scope = 'catalog' AND a.rule_id % 4 < 3 AND (again = 0 OR a.rule_id % 8 = 1)""",
    "registry_tables": """
SELECT n_nationkey AS table_id, n_name AS name,
  CASE WHEN n_nationkey % 8 = 7 THEN 99 ELSE n_regionkey END AS catalog_id FROM {nation}""",
    "registry_fields": """
SELECT c_custkey AS field_id, c_nationkey AS table_id, c_name AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'string' WHEN 'FURNITURE' THEN 'number'
       WHEN 'MACHINERY' THEN 'date' WHEN 'HOUSEHOLD' THEN 'boolean' ELSE 'decimal' END AS field_type
FROM {customer}""",
    "registry_sizes": """
SELECT t.table_id, t.name, t.catalog_id, COUNT(f.field_id) AS column_count,
  COALESCE(SUM(f.field_id % 1000), 0) AS row_count
FROM {registry_tables} t LEFT JOIN {registry_fields} f ON t.table_id = f.table_id
GROUP BY t.table_id, t.name, t.catalog_id""",
    "audit": """
SELECT o_orderkey AS audit_id, o_custkey AS user_id, o_orderdate AS ts,
  SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)), 1, 7) AS year_month,
  CASE o_orderstatus WHEN 'F' THEN 'create' WHEN 'O' THEN 'update' ELSE 'delete' END AS action_type,
  CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'catalog' WHEN '2' THEN 'table'
       WHEN '3' THEN 'rule' WHEN '4' THEN 'report' ELSE 'dataset' END AS resource_type
FROM {orders}""",
    "notifications": """
SELECT event_id AS id, ts AS sent_at,
  CASE event_type WHEN 'purchase' THEN 'validation_completion' WHEN 'error' THEN 'anomaly_scoring_completion'
       WHEN 'signup' THEN 'report_publication' ELSE 'other' END AS event_type,
  CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'sent' END AS status,
  CASE WHEN event_id % 9 = 0 THEN 3 ELSE CAST(event_id % 3 AS INT) END AS retry_count
FROM {events}""",
    "report_versions": """
SELECT conv_id AS report_id, turn + 1 AS version, role AS edited_by,
  CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS content FROM {conversations}""",
    "scored": """
SELECT event_id AS record_id, user_id AS scoring_id,
  CASE event_id % 10 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.75 AS DOUBLE) WHEN 2 THEN CAST(1.0 AS DOUBLE)
       WHEN 3 THEN CAST(1.5 AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN CAST('NaN' AS DOUBLE)
       ELSE value / 20 END AS reconstruction_error,
  event_type AS field, ts AS detected_at
FROM {events}""",
    "rule_texts": """
SELECT rule_id, scope, catalog_id, table_id, column_id,
  CASE rule_id % 6 WHEN 0 THEN body WHEN 1 THEN CONCAT('Here is the rule:', CHR(10), '```json', CHR(10), body, CHR(10), '```', CHR(10), 'Done.')
    WHEN 2 THEN CONCAT('```', CHR(10), body, CHR(10), '```') WHEN 3 THEN CONCAT('The rule is ', body, ' as asked.')
    WHEN 4 THEN SUBSTRING(body, 1, LENGTH(body) - 1) ELSE CONCAT('No rule for ', label, '.') END AS answer
FROM (SELECT r.*, CONCAT('{{"type": "', CASE WHEN rule_id % 4 = 0 THEN 'unheard_of' WHEN rule_id % 4 = 1 THEN 'cross_field' ELSE 'pattern' END,
    '", "conditions": [{{"field": "', label, '", "operator": "greater_than", "value": ', CAST(rule_id % 100 AS VARCHAR(10)), '}}], "targetFields": ',
    CASE WHEN f1 IS NULL THEN '[]' WHEN f2 IS NULL THEN CONCAT('"', f1, '"') ELSE CONCAT('["', f1, '", "', f2, '", "f8", "f9"]') END,
    ', "expectedBehavior": "reject"}}') AS body
  FROM (SELECT *, REPLACE(natural_language, ' ', '_') AS label FROM {rules}) r) x""",
    "files": """
SELECT page_id, CONCAT(url, CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.PARQUET' WHEN 2 THEN '.txt' WHEN 3 THEN '.parquet' ELSE '' END) AS path,
  CASE WHEN page_id % 9 = 0 THEN 0 WHEN page_id % 7 = 0 THEN CAST(LENGTH(html) AS BIGINT) * 1000000 ELSE CAST(LENGTH(html) AS BIGINT) END AS length
FROM {pages}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _names(text: str) -> list[str]:
    found = re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)
    return list(dict.fromkeys(found))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or a derived view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})


def duckdb_sql(text: str) -> str:
    """The text with the views it names inlined as CTEs."""
    order: list[str] = []

    def need(t: str) -> None:
        for n in _names(t):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda t: t.format(**{n: n for n in _names(t)})
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text)
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n)" if ctes else body
