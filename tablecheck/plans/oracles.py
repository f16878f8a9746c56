"""DuckDB statements that state the same results as ``queries.py``; views are inlined as CTEs."""

from __future__ import annotations

from tablecheck.plans.views import duckdb_sql

_BALANCE_OK = "c_acctbal IS NOT NULL AND NOT isnan(c_acctbal)"
_FILLED_NAME = "c_name IS NOT NULL AND regexp_matches(c_name, '\\S')"

# rule id -> predicate over customer_dirty
_CUSTOMER = {
    "name_present": "c_name IS NOT NULL",
    "name_format": "c_name IS NOT NULL AND regexp_matches(c_name, '^Customer#[0-9]{{9}}$')",
    "balance_range": f"{_BALANCE_OK} AND c_acctbal BETWEEN 0 AND 9000",
    "complete": f"{_FILLED_NAME} AND {_BALANCE_OK} AND c_mktsegment IS NOT NULL",
}
_RESULTS = " UNION ALL ".join(
    f"SELECT *, '{rule}' AS rule_id, ({test}) AS passed FROM {{customer_dirty}}" for rule, test in _CUSTOMER.items()
)


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(100.0 * CAST({part} AS DOUBLE) / {whole}, 2) ELSE 0.0 END"


_FLOAT_RE = "^[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def _type_of(column: str) -> str:
    v = f"trim(CAST({column} AS VARCHAR))"
    date = f"try_strptime({v}, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d'])"
    return f"""CASE WHEN count(*) FILTER ({v} <> '') = 0 THEN 'string'
  WHEN bool_and(lower({v}) IN ('true','false','yes','no','0','1')) FILTER ({v} <> '') THEN 'boolean'
  WHEN bool_and(regexp_matches({v}, '^[+-]?[0-9]+$')) FILTER ({v} <> '') THEN 'integer'
  WHEN bool_and(regexp_matches(lower({v}), '{_FLOAT_RE}')) FILTER ({v} <> '') THEN 'float'
  WHEN count({date}) >= 0.8 * count(*) FILTER ({v} <> '') THEN 'date' ELSE 'string' END"""


def _types(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_type_of(c)} AS inferred_type FROM {source}" for c in columns
    )


_FIELDS = "list_filter([f1, f2], lambda x: x IS NOT NULL)"


def _conflict(first: str, second: str, parent: str) -> str:
    overlap = (
        f"(len(a.fs) = 0 OR len(b.fs) = 0 OR len(list_intersect(a.fs, b.fs)) > 0)"
    )
    side = f"(SELECT *, {_FIELDS} AS fs FROM {{rules}} WHERE status = 'active')"
    return f"""SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, a.scope AS a_scope, b.scope AS b_scope, a.{parent} AS parent_id,
  least(CAST(a.rule_id AS VARCHAR), CAST(b.rule_id AS VARCHAR)) || '|' || greatest(CAST(a.rule_id AS VARCHAR), CAST(b.rule_id AS VARCHAR)) AS pair_key
FROM {side} a JOIN {side} b ON a.{parent} = b.{parent}
WHERE a.scope = '{first}' AND b.scope = '{second}' AND {overlap}"""


_ALL_CONFLICTS = " UNION ALL ".join(
    _conflict(*k) for k in (("catalog", "table", "catalog_id"), ("table", "column", "table_id"), ("catalog", "column", "catalog_id"))
)

_KEYS = {
    "a": "CASE WHEN len(fs) = 0 THEN ['second only', 'neither'] ELSE list_append(list_transform(fs, lambda f: 'field:' || f), 'first only') END",
    "b": "CASE WHEN len(fs) = 0 THEN ['first only', 'neither'] ELSE list_append(list_transform(fs, lambda f: 'field:' || f), 'second only') END",
}


def _groups(first: str, second: str, parent: str) -> str:
    """Each rule and match key that a rule of the other scope has, too, and by how many."""
    side = f"(SELECT *, list_distinct({_FIELDS}) AS fs FROM {{rules}} WHERE status = 'active' AND {parent} IS NOT NULL)"
    each = lambda s, scope: f"{s} AS (SELECT {parent} AS parent_id, unnest({_KEYS[s]}) AS match_key, scope, rule_id FROM {side} WHERE scope = '{scope}')"
    rows = lambda own, other: f"SELECT {own}.*, n AS links FROM {own} JOIN (SELECT parent_id, match_key, count(*) AS n FROM {other} GROUP BY ALL) o USING (parent_id, match_key)"
    return f"WITH {each('a', first)}, {each('b', second)} {rows('a', 'b')} UNION ALL {rows('b', 'a')}"


def _per_rule(first: str, second: str, parent: str) -> str:
    pairs = _conflict(first, second, parent)
    one = lambda own, scope, other, facing: f"SELECT rule_{own} AS rule_id, '{scope}' AS scope, '{facing}' AS other_scope, parent_id, count(*) AS conflicts, min(rule_{other}) AS partner_id FROM ({pairs}) GROUP BY rule_{own}, parent_id"
    return one("a", first, "b", second) + " UNION ALL " + one("b", second, "a", first)


_LATEST_RESOLUTION = """(SELECT rule_lo, rule_hi, max_by(priority_rule_id, resolved_at) AS priority_rule_id, max_by(resolved_by, resolved_at) AS resolved_by
  FROM {resolutions} GROUP BY rule_lo, rule_hi)"""
_RESOLVED = f"""SELECT c.rule_a, c.rule_b, c.a_scope, c.b_scope, c.parent_id, r.priority_rule_id, r.resolved_by
FROM ({_ALL_CONFLICTS}) c JOIN {_LATEST_RESOLUTION} r ON r.rule_lo = least(c.rule_a, c.rule_b) AND r.rule_hi = greatest(c.rule_a, c.rule_b)"""

_CLEAN = "reconstruction_error IS NOT NULL AND NOT isnan(reconstruction_error)"
_SEVERITY = f"""CASE WHEN NOT ({_CLEAN}) THEN 'normal' WHEN reconstruction_error > 1.5 THEN 'critical'
  WHEN reconstruction_error > 1.0 THEN 'high' WHEN reconstruction_error > 0.75 THEN 'medium'
  WHEN reconstruction_error > 0.5 THEN 'low' ELSE 'normal' END"""
_ANOMALY = f"coalesce({_CLEAN} AND reconstruction_error > 0.5, false)"

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_STATS = "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _LINE) + " FROM {lineitem}"
_Z = {c: f"(({c} - m_{c}) / s_{c})" for c in _LINE}
_ERROR = "(" + " + ".join(f"{z} * {z}" for z in _Z.values()) + ") / 4"
_CLIPPED = "(" + " + ".join(f"least(greatest({z}, 0), 1) ** 2" for z in _Z.values()) + ") / 4"

_PRICES = ["l_quantity", "l_extendedprice", "net", "charge"]
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_SEVERITY_OF_T = """CASE WHEN err > 3 * t THEN 'critical' WHEN err > 2 * t THEN 'high' WHEN err > 1.5 * t THEN 'medium'
  WHEN err > t THEN 'low' ELSE 'normal' END"""


def _power(columns: list[str], steps: int) -> str:
    """CTEs over z (columns z0..): correlations, power iteration to the first axis, errors of the projection on it."""
    n = range(len(columns))
    cov = ", ".join(f"avg(z{i} * z{j}) AS c{i}{j}" for i in n for j in n)
    times = ", ".join("(" + " + ".join(f"c{i}{j} * v{j}" for j in n) + f") AS w{i}" for i in n)
    length = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in n) + ")"
    dot = "(" + " + ".join(f"z{i} * v{i}" for i in n) + ")"
    err = "(" + " + ".join(f"(z{i} - {dot} * v{i}) ** 2" for i in n) + f") / {len(columns)}"
    return f"""c AS MATERIALIZED (SELECT {cov} FROM z),
p(step, {", ".join(f"v{i}" for i in n)}) AS (SELECT 0, {", ".join("CAST(0.5 AS DOUBLE)" for _ in n)} UNION ALL
  SELECT step + 1, {", ".join(f"w{i} / {length}" for i in n)} FROM (SELECT step, {times} FROM p, c WHERE step < {steps}) q),
e AS MATERIALIZED (SELECT {_ORDER}, {err} AS err FROM z, (SELECT * FROM p WHERE step = {steps}) last)"""


_LAYERS = [4, 64, 32, 16, 32, 64, 4]
_WEIGHT_LISTS = ", ".join(
    f"list_transform(range({b}), lambda j: list_transform(range({a}), lambda i: 0.3 * sin(7 * i + 3 * j + {k}))) AS w{k}"
    for k, (a, b) in enumerate(zip(_LAYERS, _LAYERS[1:]))
)
_FORWARD = ", ".join(
    f"h{k + 1} AS MATERIALIZED (SELECT l_linenumber, x, list_transform(w{k}, lambda w: "
    + ("greatest(list_dot_product(h, w), 0)" if k < 5 else "1 / (1 + exp(-list_dot_product(h, w)))")
    + f") AS h FROM h{k}, weights)"
    for k in range(6)
)

_DIFF = """SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey,
  CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed'
    WHEN b.c_name IS DISTINCT FROM a.c_name OR b.c_nationkey IS DISTINCT FROM a.c_nationkey
      OR b.c_acctbal IS DISTINCT FROM a.c_acctbal OR b.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN 'modified'
    ELSE 'unchanged' END AS change,
  CASE WHEN b.c_custkey IS NULL OR a.c_custkey IS NULL THEN '' ELSE concat_ws(',',
    CASE WHEN b.c_name IS DISTINCT FROM a.c_name THEN 'c_name' END,
    CASE WHEN b.c_nationkey IS DISTINCT FROM a.c_nationkey THEN 'c_nationkey' END,
    CASE WHEN b.c_acctbal IS DISTINCT FROM a.c_acctbal THEN 'c_acctbal' END,
    CASE WHEN b.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN 'c_mktsegment' END) END AS changed_columns
FROM {customer_dirty} b FULL OUTER JOIN {customer_cleaned} a ON b.c_custkey = a.c_custkey"""

_AUDIT_OUT = "audit_id, user_id, action_type, resource_type, strftime(ts, '%Y-%m-%d') AS day"
_NAME_OR = "c_name IS NULL OR NOT regexp_matches(c_name, '\\S')"


def _lint(*checks: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {bad} THEN '{msg}' END" for bad, msg in checks) + ")"


_ORACLES: dict[str, str] = {
    "q01_rule_score": f"""SELECT rule_id, count(*) AS total, count(*) FILTER (passed) AS passed,
  count(*) FILTER (NOT passed) AS failed, {_rate("count(*) FILTER (passed)", "count(*)")} AS score
FROM ({_RESULTS}) GROUP BY rule_id""",
    "q01b_run_summary": f"""SELECT count(DISTINCT c_custkey) AS total_records, count(*) AS total_evaluations,
  count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CAST(0 AS BIGINT) AS errors,
  CAST(4 AS BIGINT) AS rules_submitted, count(DISTINCT rule_id) AS rules_executed,
  {_rate("count(*) FILTER (passed)", "count(*)")} AS quality_score FROM ({_RESULTS})""",
    "q02_rule_results": f"""SELECT c_custkey AS record_id, rule_id, replace(rule_id, '_', ' ') AS rule_name, passed,
  CASE WHEN passed THEN '' ELSE 'Rule condition not met' END AS message, c_name AS v_name, c_mktsegment AS v_segment,
  CAST(c_nationkey AS VARCHAR) AS v_nation FROM ({_RESULTS})""",
    "q03_simple": f"SELECT c_custkey, ({_FILLED_NAME} AND c_mktsegment IS NOT NULL) AS ok FROM {{customer_dirty}}",
    "q04_cross_field": f"""SELECT c_custkey, (c_name IS NOT NULL AND {_BALANCE_OK}) AS both,
  ({_BALANCE_OK} AND c_acctbal > c_custkey) AS above FROM {{customer_dirty}}""",
    "q05_outlier": f"""SELECT c_custkey, ({_BALANCE_OK} AND c_acctbal BETWEEN -1000000 AND 1000000) AS default_bounds,
  ({_BALANCE_OK} AND c_acctbal BETWEEN -500 AND 5000) AS own_bounds FROM {{customer_dirty}}""",
    "q06_unique": f"""WITH c AS (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS one, l_partkey IS NOT NULL AS has FROM {{lineitem}}),
r AS (SELECT 'line_key' AS rule_id, one AS ok FROM c UNION ALL SELECT 'part_present', has FROM c)
SELECT rule_id, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed,
  {_rate("count(*) FILTER (ok)", "count(*)")} AS score FROM r GROUP BY rule_id""",
    "q07_temporal": """SELECT event_id, (event_day IS NOT NULL AND try_cast(event_day AS DATE) IS NOT NULL) AS ok FROM {events_text}""",
    "q08_pattern": """SELECT doc_id, (text IS NOT NULL AND regexp_matches(text, '\\S')) AS not_blank,
  coalesce(regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9]+\\.[A-Za-z0-9.]+'), false) AS has_mail, false AS not_text FROM {documents}""",
    "q09_condition_mix": """SELECT o_orderkey,
  (((o_orderstatus = 'F' AND o_totalprice > 100000) OR contains(o_orderpriority, 'URGENT')) AND o_custkey <> 7) AS mix,
  o_orderdate < TIMESTAMP '1996-01-01' AS early, false AS absent FROM {orders}""",
    "q10_pass_fail_by_dataset": """SELECT dataset_id, count(*) FILTER (score >= 80) AS passed, count(*) FILTER (score < 80) AS failed
FROM {runs} GROUP BY dataset_id""",
    "q10b_pass_fail_by_segment": f"""SELECT c_mktsegment, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed
FROM (SELECT c_mktsegment, ({_CUSTOMER["complete"]}) AS ok FROM {{customer_dirty}}) GROUP BY c_mktsegment""",
    "q10c_pass_fail_by_rule": f"""SELECT rule_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed
FROM ({_RESULTS}) GROUP BY rule_id""",
    "q11_infer_types": f"""WITH o AS (SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM {{orders}})
{_types("o", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"])}""",
    "q11b_infer_types_dirty": _types("{events_text}", ["event_id", "event_day", "flag", "event_type"]),
    "q12_schema_check": """WITH n AS (SELECT count(*) AS n FROM {events_text}),
r AS (
  SELECT 'event_id' AS field_name, 'number' AS field_type, true AS required, true AS in_dataset,
    count(*) FILTER (coalesce(trim(event_id), '') = '') AS null_count,
    count(*) FILTER (trim(event_id) <> '' AND try_cast(event_id AS DOUBLE) IS NULL) AS bad_count FROM {events_text}
  UNION ALL SELECT 'event_day', 'date', false, true, count(*) FILTER (coalesce(trim(event_day), '') = ''),
    count(*) FILTER (trim(event_day) <> '' AND try_cast(event_day AS DATE) IS NULL) FROM {events_text}
  UNION ALL SELECT 'flag', 'boolean', true, true, count(*) FILTER (coalesce(trim(flag), '') = ''),
    count(*) FILTER (trim(flag) <> '' AND lower(flag) NOT IN ('true','false','yes','no','0','1')) FROM {events_text}
  UNION ALL SELECT 'event_type', 'string', true, true, count(*) FILTER (coalesce(trim(event_type), '') = ''), 0 FROM {events_text}
  UNION ALL SELECT 'no_such_field', 'string', true, false, n, 0 FROM n)
SELECT *, (bad_count = 0 AND (in_dataset OR NOT required) AND (NOT required OR null_count = 0)) AS ok FROM r""",
    "q12b_preview": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment
FROM {customer} ORDER BY {customer}.c_custkey LIMIT 100""",
    "q12c_dataset_stats": " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, count(*) AS row_count, CAST({c} AS BIGINT) AS column_count FROM {{{n}}}"
        for n, c in (("customer", 5), ("orders", 6), ("lineitem", 11), ("events", 6), ("documents", 5), ("embeddings", 3))
    ),
    "q13_run_metrics": f"""WITH r AS (SELECT * FROM {{runs}} WHERE status = 'completed' AND started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31')
SELECT count(*) AS total_runs, CASE WHEN count(*) > 0 THEN coalesce(round(avg(score), 2), 0.0) END AS average_score,
  count(*) FILTER (score >= 80) AS pass_count, count(*) FILTER (score < 80) AS fail_count,
  {_rate("count(*) FILTER (score >= 80)", "count(score)")} AS pass_rate, {_rate("count(*) FILTER (score < 80)", "count(score)")} AS fail_rate FROM r""",
    "q14_dataset_ranking": """WITH a AS (SELECT dataset_id, round(avg(score), 2) AS average_score FROM {runs}
  WHERE status = 'completed' AND score IS NOT NULL GROUP BY dataset_id),
r AS (SELECT 'highest' AS ranking, row_number() OVER (ORDER BY average_score DESC, dataset_id) AS position, * FROM a
  UNION ALL SELECT 'lowest', row_number() OVER (ORDER BY average_score, dataset_id), * FROM a)
SELECT ranking, position, dataset_id, average_score FROM r WHERE position <= 5""",
    "q15_trend": """SELECT strftime(date_trunc('month', started_at), '%Y-%m-%d') AS period, round(avg(score), 2) AS average_score, count(*) AS runs
FROM {runs} WHERE score IS NOT NULL GROUP BY 1""",
    "q16_period_change": """WITH m AS (SELECT dataset_id, date_trunc('month', started_at) AS period, max(score) AS score, count(*) AS runs FROM {runs} GROUP BY 1, 2)
SELECT n.dataset_id, strftime(n.period, '%Y-%m-%d') AS period, n.score, p.score AS score_previous, round(n.score - p.score, 2) AS score_change,
  CASE WHEN p.score <> 0 THEN round(100.0 * (n.score - p.score) / p.score, 2) END AS score_change_pct,
  n.runs, p.runs AS runs_previous, n.runs - p.runs AS runs_change,
  CASE WHEN p.runs <> 0 THEN round(100.0 * CAST(n.runs - p.runs AS DOUBLE) / p.runs, 2) END AS runs_change_pct
FROM m n LEFT JOIN m p ON n.dataset_id = p.dataset_id AND n.period = p.period + INTERVAL 1 MONTH""",
    "q16b_score_bands": """SELECT CASE WHEN score >= 90 THEN 'green' WHEN score >= 70 THEN 'yellow' WHEN score IS NOT NULL THEN 'red' END AS band,
  CASE WHEN score >= 80 THEN 'passed' WHEN score IS NOT NULL THEN 'failed' END AS outcome, count(*) AS runs FROM {runs} GROUP BY 1, 2""",
    "q16c_report_context": """WITH r AS (SELECT score FROM {runs} WHERE status = 'completed' AND dataset_id = 'ds3' ORDER BY started_at DESC, run_id LIMIT 20)
SELECT count(*) AS runs, coalesce(round(avg(score), 1), 0.0) AS average_score, coalesce(min(score), 0.0) AS lowest_score, coalesce(max(score), 0.0) AS highest_score FROM r""",
    "q16d_report_scorings": f"""WITH s AS (SELECT scoring_id, count(*) AS n, count(*) FILTER ({_ANOMALY}) AS a, max(detected_at) AS t FROM {{scored}} GROUP BY scoring_id)
SELECT scoring_id AS id, scoring_id AS dataset_id, a AS anomaly_count, round(round(100.0 * CAST(a AS DOUBLE) / n, 2), 1) AS anomaly_percentage
FROM s ORDER BY t DESC, scoring_id LIMIT 5""",
    "q17_conflicts_catalog_table": _conflict("catalog", "table", "catalog_id"),
    "q18_conflicts_table_column": _conflict("table", "column", "table_id"),
    "q19_conflicts_catalog_column": _conflict("catalog", "column", "catalog_id"),
    "q17b_groups_catalog_table": _groups("catalog", "table", "catalog_id"),
    "q18b_groups_table_column": _groups("table", "column", "table_id"),
    "q19d_groups_catalog_column": _groups("catalog", "column", "catalog_id"),
    "q19b_rule_conflicts": " UNION ALL ".join(
        _per_rule(*k) for k in (("catalog", "table", "catalog_id"), ("table", "column", "table_id"), ("catalog", "column", "catalog_id"))
    ),
    "q19c_conflict_pairs": f"SELECT * FROM ({_conflict('catalog', 'table', 'catalog_id')}) WHERE parent_id = 4",
    "q20_with_resolutions": f"""SELECT c.rule_a, c.rule_b, r.rule_lo IS NOT NULL AS resolved, r.priority_rule_id, r.resolved_by
FROM ({_ALL_CONFLICTS}) c LEFT JOIN (SELECT rule_lo, rule_hi, max_by(priority_rule_id, resolved_at) AS priority_rule_id, max_by(resolved_by, resolved_at) AS resolved_by
  FROM {{resolutions}} GROUP BY rule_lo, rule_hi) r ON r.rule_lo = least(c.rule_a, c.rule_b) AND r.rule_hi = greatest(c.rule_a, c.rule_b)""",
    "q20d_resolved_conflicts": _RESOLVED,
    "q20c_open_conflicts": f"""WITH c AS ({_ALL_CONFLICTS}), s AS ({_RESOLVED}),
t AS (SELECT rule_id, count(*) AS conflicts FROM (SELECT rule_a AS rule_id FROM c UNION ALL SELECT rule_b FROM c) GROUP BY rule_id),
d AS (SELECT rule_id, count(*) AS resolved FROM (SELECT rule_a AS rule_id FROM s UNION ALL SELECT rule_b FROM s) GROUP BY rule_id)
SELECT rule_id, conflicts, coalesce(resolved, 0) AS resolved, conflicts - coalesce(resolved, 0) AS open FROM t LEFT JOIN d USING (rule_id)""",
    "q20b_conflict_sentences": f"""SELECT 'Rules at ''' || a_scope || ''' and ''' || b_scope || ''' scope levels target overlapping fields with potentially contradictory constraints.' AS contradiction_summary,
  CAST(count(*) AS BIGINT) AS conflicts FROM ({_ALL_CONFLICTS}) GROUP BY 1""",
    "q21_resolve": """SELECT rule_id, scope, CASE WHEN rule_id IN (SELECT overridden_rule_id FROM {resolutions}) THEN 'overridden' ELSE status END AS status FROM {rules}""",
    "q21b_resolve_one": "SELECT rule_id, CASE WHEN rule_id IN (3, 12) THEN 'overridden' ELSE status END AS status FROM {rules}",
    "q22_expand_rules": """WITH reg AS (SELECT f.field_id, f.table_id, t.catalog_id FROM {registry_fields} f JOIN {registry_tables} t ON f.table_id = t.table_id),
a AS (SELECT * FROM {rules} WHERE status = 'active')
SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.catalog_id = reg.catalog_id WHERE a.scope = 'catalog'
UNION ALL SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.table_id = reg.table_id WHERE a.scope = 'table'
UNION ALL SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.column_id = reg.field_id WHERE a.scope = 'column'""",
    "q22d_rule_ranges": """WITH reg AS (SELECT f.field_id, f.table_id, t.catalog_id,
  row_number() OVER (ORDER BY t.catalog_id NULLS FIRST, f.table_id NULLS FIRST, f.field_id NULLS FIRST) - 1 AS pos
  FROM {registry_fields} f JOIN {registry_tables} t ON f.table_id = t.table_id),
a AS (SELECT * FROM {rules} WHERE status = 'active')
SELECT a.rule_id, a.scope, min(pos) AS lo, max(pos) + 1 AS hi FROM a JOIN reg ON CASE a.scope WHEN 'catalog' THEN a.catalog_id = reg.catalog_id
  WHEN 'table' THEN a.table_id = reg.table_id ELSE a.column_id = reg.field_id END GROUP BY a.rule_id, a.scope""",
    "q22c_rules_of_tables": """WITH reg AS (SELECT f.field_id, f.table_id, t.catalog_id FROM {registry_fields} f JOIN {registry_tables} t ON f.table_id = t.table_id
  WHERE t.catalog_id IN (1, 99)),
a AS (SELECT * FROM {rules} WHERE status = 'active')
SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.catalog_id = reg.catalog_id WHERE a.scope = 'catalog'
UNION ALL SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.table_id = reg.table_id WHERE a.scope = 'table'
UNION ALL SELECT a.rule_id, a.scope, reg.table_id, reg.field_id FROM a JOIN reg ON a.column_id = reg.field_id WHERE a.scope = 'column'""",
    "q22b_active_rules": "SELECT rule_id, scope, catalog_id FROM {rules} WHERE status = 'active' AND rule_id % 12 = 4",
    "q23_row_diff": _DIFF,
    "q24_clean_summary": f"""WITH d AS ({_DIFF}) SELECT count(*) FILTER (change <> 'added') AS total_records, count(*) FILTER (change = 'modified') AS modified_records,
  count(*) FILTER (change = 'unchanged') AS unchanged_records, CAST(0 AS BIGINT) AS error_records, count(*) FILTER (change <> 'removed') AS output_records,
  count(*) FILTER (change = 'added') AS added_records, count(*) FILTER (change = 'removed') AS removed_records FROM d""",
    "q24b_clean_summary_shape": """WITH b AS (SELECT count(*) AS n FROM {customer_dirty}), a AS (SELECT count(*) AS n FROM {customer_cleaned})
SELECT b.n AS total_records, a.n AS modified_records, CAST(0 AS BIGINT) AS unchanged_records, abs(b.n - a.n) AS error_records, a.n AS output_records,
  CAST(0 AS BIGINT) AS added_records, b.n - a.n AS removed_records FROM a, b""",
    "q25_dedup_clean": "SELECT md5(text) AS text_md5, lang, source, n_chars FROM (SELECT DISTINCT text, lang, source, n_chars FROM {documents})",
    "q25b_clean_steps": f"""SELECT c_custkey, lower(trim(CASE WHEN c_name IS NULL THEN 'Unknown' ELSE c_name END)) AS c_name, c_nationkey, c_acctbal, c_mktsegment
FROM (SELECT DISTINCT * FROM {{customer_dirty}}) WHERE {_BALANCE_OK} AND c_acctbal BETWEEN 0 AND 9000""",
    "q25c_fill_typed": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(0.5 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '1990-01-01' ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown' ELSE o_orderpriority END AS o_orderpriority FROM {orders}""",
    "q26_audit_user": f"SELECT {_AUDIT_OUT} FROM {{audit}} WHERE user_id = 100 AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2000-12-31'",
    "q27_audit_resource": f"SELECT {_AUDIT_OUT} FROM {{audit}} WHERE resource_type = 'rule' AND action_type = 'update'",
    "q28_audit_months": f"SELECT {_AUDIT_OUT} FROM {{audit}} WHERE action_type = 'create' AND ts BETWEEN TIMESTAMP '1997-03-10' AND TIMESTAMP '1998-02-05'",
    "q28b_audit_rows": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'update' AS action_type, 'dataset' AS resource_type, CAST(o_orderkey AS VARCHAR) AS resource_id,
  strftime(o_orderdate, '%Y-%m') AS year_month, 'dataset#' || CAST(o_orderkey AS VARCHAR) AS resource_key FROM {orders}""",
    "q29_keyset_page": """SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_custkey < 100 OR (o_custkey = 100 AND o_orderkey > 500)
ORDER BY o_custkey DESC, o_orderkey LIMIT 50""",
    "q29b_audit_cursor": """SELECT page, count(*) AS rows, strftime(arg_max(ts, n), '%Y-%m-%d %H:%M:%S') AS last_ts, arg_max(audit_id, n) AS last_id
FROM (SELECT *, (n - 1) // 50 + 1 AS page FROM (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, audit_id) AS n FROM {audit})) GROUP BY page""",
    "q29c_audit_page": "SELECT audit_id, user_id FROM {audit} ORDER BY ts DESC NULLS LAST, audit_id LIMIT 50 OFFSET 50",
    "q30_search_any": """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer} WHERE contains(lower(CAST(c_custkey AS VARCHAR)), 'furn')
  OR contains(lower(c_name), 'furn') OR contains(lower(CAST(c_nationkey AS VARCHAR)), 'furn') OR contains(lower(c_mktsegment), 'furn')""",
    "q31_offset_page": "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_custkey, o_orderkey LIMIT 25 OFFSET 150",
    "q31b_total_pages": "SELECT count(*) AS rows, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM {orders}",
    "q31c_sort_as_text": "SELECT s_suppkey, s_name FROM {supplier} ORDER BY CAST(s_suppkey AS VARCHAR) DESC",
    "q31d_deep_page": f"SELECT {_ORDER} FROM {{lineitem}} ORDER BY {_ORDER} LIMIT 40 OFFSET 59960",
    "q32_rule_listing": "SELECT rule_id, scope, status, catalog_id FROM {rules} WHERE status = 'active' AND catalog_id = 4",
    "q32b_catalog_listing": """SELECT o_orderkey AS id, o_orderpriority AS name, o_custkey AS owner, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {orders}
WHERE contains(o_orderpriority, 'HIGH') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'""",
    "q32c_count_where": "SELECT count(*) FILTER (o_orderstatus = 'F') AS n FROM {orders}",
    "q32d_lookup": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey = 77",
    "q32e_tables_of_catalog": """SELECT *, CAST(NULL AS INT) AS asked FROM {registry_tables} UNION ALL SELECT *, 2 FROM {registry_tables} WHERE catalog_id = 2""",
    "q32f_fields_of_table": "SELECT * FROM {registry_fields} WHERE table_id = 7",
    "q32g_templates_of_catalog": """WITH t AS (SELECT n_nationkey AS template_id, n_name AS name FROM {nation}),
a AS (SELECT DISTINCT c_custkey % 30 AS template_id, c_custkey % 11 AS catalog_id FROM {customer})
SELECT *, CAST(NULL AS INT) AS asked FROM t UNION ALL SELECT t.*, a.catalog_id FROM t JOIN a USING (template_id) WHERE a.catalog_id IN (4, 77)""",
    "q33_versions": """SELECT report_id, version, edited_by,
  last_value(content IGNORE NULLS) OVER (PARTITION BY report_id ORDER BY version ROWS UNBOUNDED PRECEDING) AS content,
  max(version) OVER (PARTITION BY report_id) AS current_version, max(version) OVER (PARTITION BY report_id) + 1 AS next_version FROM {report_versions}""",
    "q33b_edit_report": """WITH c AS (SELECT report_id, max(version) AS version, arg_max(coalesce(content, chr(1)), version) AS content FROM {report_versions} GROUP BY report_id)
SELECT report_id, version + 1 AS version, CASE WHEN report_id % 2 = 0 THEN 'new text' ELSE nullif(content, chr(1)) END AS content,
  CASE WHEN report_id % 3 = 0 THEN 'new title' ELSE 't' END AS title, 'me' AS edited_by
FROM c WHERE (report_id % 2 = 0 OR report_id % 3 = 0) AND report_id IN (SELECT conv_id FROM {conversations})""",
    "q33c_publish": """WITH m AS (SELECT conv_id * 10 + turn AS id, CASE WHEN conv_id % 4 = 0 THEN 'published' ELSE 'draft' END AS status FROM {conversations}),
a AS (SELECT doc_id AS id FROM {documents})
SELECT id, CASE WHEN id IN (SELECT id FROM a) THEN 'published' ELSE status END AS outcome FROM m
UNION ALL SELECT a.id, CASE WHEN m.id IS NULL THEN 'not found' ELSE 'not a draft' END FROM a LEFT JOIN m ON a.id = m.id WHERE m.id IS NULL OR m.status <> 'draft'""",
    "q34_latest_state": """SELECT dataset_id, run_id, status, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, run_id DESC) AS rn FROM {runs}) WHERE rn = 1""",
    "q34b_latest_of_many": """SELECT 'part' AS kind, l_partkey AS key, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line FROM (SELECT *,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC) AS rn FROM {lineitem}) WHERE rn = 1
UNION ALL SELECT 'customer', o_custkey, o_orderkey, 0 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM {orders}) WHERE rn = 1""",
    "q35_scaler": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 4) AS std FROM {{lineitem}}"
        for c in _LINE
    ),
    "q35b_scale_clip": f"""WITH s AS ({_STATS}), e AS (SELECT {_CLIPPED} AS err FROM {{lineitem}}, s)
SELECT count(*) AS rows, round(avg(err), 4) AS mean_error, round(max(err), 4) AS max_error FROM e""",
    "q36_threshold": f"""WITH s AS ({_STATS}), e AS (SELECT {_ERROR} AS err FROM {{lineitem}}, s)
SELECT count(*) AS rows, round(quantile_cont(err, 0.95), 6) AS threshold FROM e""",
    "q37_severity": f"SELECT record_id, {_SEVERITY} AS severity, {_ANOMALY} AS is_anomaly FROM {{scored}}",
    "q38_anomaly_summary": f"""WITH c AS (SELECT {_SEVERITY} AS severity, {_ANOMALY} AS is_anomaly FROM {{scored}})
SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomaly_count, {_rate("count(*) FILTER (is_anomaly)", "count(*)")} AS anomaly_percentage,
  CAST(0.5 AS DOUBLE) AS threshold, """
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "normal"))
    + " FROM c",
    "q39_by_field": f"""SELECT field, {_SEVERITY} AS severity, count(*) AS count, max(reconstruction_error) AS max_score, strftime(max(detected_at), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM {{scored}} WHERE {_ANOMALY} GROUP BY 1, 2""",
    "q39b_anomaly_cards": f"""SELECT count(*) AS total, count(*) FILTER (reconstruction_error > 1.5) AS critical, count(*) FILTER (record_id % 3 = 0) AS resolved,
  count(DISTINCT scoring_id) AS datasets_affected FROM {{scored}} WHERE {_ANOMALY}""",
    "q39c_anomalous_of_run": f"SELECT record_id, {_SEVERITY} AS severity, reconstruction_error FROM {{scored}} WHERE scoring_id = 8 AND {_ANOMALY}",
    "q39d_scorable": """SELECT e.event_id AS scoring_id, e.event_id * 2 AS model_id,
  CASE WHEN r.run_id IS NULL THEN 'model not found' WHEN r.status <> 'completed' THEN 'model not ready' ELSE '' END AS reason
FROM {events} e LEFT JOIN {runs} r ON r.run_id = e.event_id * 2""",
    "q40_pca_score": f"""WITH RECURSIVE l AS (SELECT *, net * (1 + l_tax) AS charge FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM {{lineitem}}) n),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _PRICES)} FROM l),
z AS MATERIALIZED (SELECT {_ORDER}, {", ".join(f"({c} - m_{c}) / s_{c} AS z{i}" for i, c in enumerate(_PRICES))} FROM l, s),
{_power(_PRICES, 100)}, t AS (SELECT quantile_cont(err, 0.95) AS t FROM e)
SELECT {_ORDER}, round(err, 6) AS reconstruction_error, {_SEVERITY_OF_T} AS severity, err > t AS is_anomaly FROM e, t""",
    "q41_autoencoder_score": """SELECT count(*) AS scored, CAST(floor(count(*) * 0.8) AS BIGINT) AS training_rows, 10 AS epochs,
  true AS loss_fell, true AS threshold_fits FROM {lineitem}""",
    "q41b_network_score": f"""WITH s AS ({_STATS}), weights AS MATERIALIZED (SELECT {_WEIGHT_LISTS}),
h0 AS MATERIALIZED (SELECT l_linenumber, x, x AS h FROM (
  SELECT l_linenumber, [{", ".join(f"least(greatest({z}, 0), 1)" for z in _Z.values())}] AS x FROM {{lineitem}}, s) q), {_FORWARD}
SELECT l_linenumber, count(*) AS rows, round(avg(list_sum(list_transform(range(1, 5), lambda i: (h[i] - x[i]) ** 2)) / 4), 3) AS mean_error
FROM h6 GROUP BY l_linenumber""",
    "q42_export_rows": f"""SELECT record_id, reconstruction_error, {_SEVERITY} AS severity, field, CAST(scoring_id AS VARCHAR) AS scoring_id FROM {{scored}} WHERE {_ANOMALY}""",
    "q42b_export_long": f"""SELECT record_id, reconstruction_error, {_SEVERITY} AS severity, 'field' AS field, field AS value FROM {{scored}} WHERE {_ANOMALY}
UNION ALL SELECT record_id, reconstruction_error, {_SEVERITY} AS severity, 'scoring_id', CAST(scoring_id AS VARCHAR) FROM {{scored}} WHERE {_ANOMALY}""",
    "q43_split_ordered": """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n, count(*) OVER () AS total FROM {lineitem})
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM i WHERE n < floor(total * 0.8)""",
    "q44_row_index": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_index FROM {lineitem}""",
    "q45_template_join": """SELECT f.field_id, f.table_id, t.catalog_id AS template_id, r.r_name AS template FROM {registry_tables} t
JOIN {region} r ON r.r_regionkey = t.catalog_id JOIN {registry_fields} f ON f.table_id = t.table_id""",
    "q46_association_reject": """WITH p AS (SELECT o_orderkey % 5000 AS table_id, CAST(min(o_orderkey % 7) AS INT) AS catalog_id FROM {orders} GROUP BY 1)
SELECT table_id, catalog_id, CASE WHEN table_id NOT IN (SELECT field_id FROM {registry_fields}) THEN 'table not found' ELSE 'catalog not found' END AS reason
FROM p WHERE table_id NOT IN (SELECT field_id FROM {registry_fields}) OR catalog_id NOT IN (SELECT r_regionkey FROM {region})""",
    "q46b_association_tables": """WITH p AS (SELECT o_orderkey % 5000 AS table_id, CAST(min(o_orderkey % 7) AS INT) AS catalog_id FROM {orders} GROUP BY 1)
SELECT f.field_id AS table_id, p.catalog_id FROM {registry_fields} f
LEFT JOIN p ON p.table_id = f.field_id AND p.catalog_id IN (SELECT r_regionkey FROM {region})""",
    "q46c_children_and_orphans": """SELECT f.field_id, CASE WHEN r.r_regionkey IS NULL THEN 'orphan' ELSE 'kept' END AS state FROM {registry_fields} f
JOIN {registry_tables} t ON t.table_id = f.table_id LEFT JOIN {region} r ON r.r_regionkey = t.catalog_id""",
    "q46d_cascade_delete": """WITH k AS (SELECT table_id FROM {registry_tables} WHERE catalog_id <> 99)
SELECT table_id, field_id FROM {registry_fields} WHERE table_id IN (SELECT table_id FROM k) UNION ALL SELECT table_id, CAST(-1 AS BIGINT) FROM k""",
    "q47_notify_fanout": """WITH c(event_type, recipient) AS (VALUES ('validation_completion', 'ann@example.com'), ('validation_completion', 'bob@example.com'),
  ('anomaly_scoring_completion', 'ann@example.com'))
SELECT CAST(n.id AS VARCHAR) AS event_id, n.event_type, c.recipient, 'sending' AS status, CAST(0 AS INT) AS retry_count FROM {notifications} n JOIN c ON c.event_type = n.event_type""",
    "q48_delivery": """SELECT event_type, status, count(*) AS count, round(avg(retry_count), 4) AS avg_retries, max(retry_count) AS max_retries FROM {notifications} GROUP BY 1, 2""",
    "q49_field_counts": """SELECT t.table_id, count(f.field_id) AS field_count FROM {registry_tables} t LEFT JOIN {registry_fields} f ON f.table_id = t.table_id GROUP BY 1""",
    "q50_catalog_totals": """SELECT catalog_id, count(*) AS tables, CAST(sum(column_count) AS BIGINT) AS columns, CAST(sum(row_count) AS BIGINT) AS rows FROM {registry_sizes} GROUP BY 1""",
    "q51_dashboard": f"""SELECT (SELECT count(DISTINCT dataset_id) FROM {{runs}}) AS total_datasets,
  (SELECT round(avg(score), 2) FROM {{runs}} WHERE status = 'completed') AS quality_score,
  (SELECT count(*) FROM {{scored}} WHERE {_ANOMALY}) AS anomalies_detected, (SELECT count(*) FROM {{rules}} WHERE status = 'active') AS rules_active""",
    "q52_metadata_lint": f"""SELECT field_id, {_lint(
        ("coalesce(trim(name), '') = ''", "name: required"), ("coalesce(trim(field_type), '') = ''", "field_type: required"),
        ("field_type NOT IN ('string', 'number', 'date', 'boolean')", "field_type: not a known type"))} AS errors FROM {{registry_fields}}""",
    "q52b_lint_rules": f"""SELECT rule_id, {_lint(
        ("coalesce(trim(natural_language), '') = ''", "natural_language: required"),
        ("length(trim(natural_language)) > 500", "natural_language: longer than 500"),
        ("catalog_id IS NULL", "catalog_id: required"),
        ("scope IN ('table', 'column') AND table_id IS NULL", "table_id: required for this scope"),
        ("scope = 'column' AND column_id IS NULL", "column_id: required for this scope"),
        ("template_category NOT IN ('cross_field','statistical_outlier','multi_record','temporal','pattern','simple')", "template_category: not a known category"),
    )} AS errors FROM {{rules}}""",
    "q52c_lint_catalogs": f"""SELECT doc_id, {_lint(
        ("NOT coalesce(regexp_matches(source, '\\S'), false)", "name: required"), ("length(trim(source)) > 100", "name: longer than 100"),
        ("doc_id % 5 = 0 OR NOT coalesce(regexp_matches(lang, '\\S'), false)", "owner: required"),
        ("length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 500", "description: longer than 500"),
    )} AS errors FROM {{documents}}""",
    "q52d_lint_training": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_lint(
        ("l_discount NOT BETWEEN 0.0001 AND 0.01", "learningRate: not between 0.0001 and 0.01"),
        ("l_quantity NOT BETWEEN 10 AND 500", "epochs: not between 10 and 500"),
        ("l_partkey NOT BETWEEN 16 AND 256", "batchSize: not between 16 and 256"),
    )} AS errors FROM {{lineitem}}""",
    "q53_emails_in_text": """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS word FROM {documents}),
c AS (SELECT doc_id, word, string_split(word, '@') AS p FROM w WHERE contains(word, '@'))
SELECT doc_id, count(*) AS candidates, count(*) FILTER (len(p) = 2 AND length(p[1]) > 0 AND contains(p[2], '.')) AS valid FROM c GROUP BY doc_id""",
    "q54_rule_text_parse": """WITH p AS (SELECT *, rule_id % 6 < 4 AS ok, replace(natural_language, ' ', '_') AS label FROM {rules}),
t AS (SELECT *, CASE WHEN rule_id % 4 = 0 THEN 'simple' WHEN rule_id % 4 = 1 THEN 'cross_field' ELSE 'pattern' END AS kind,
  CASE WHEN f1 IS NULL THEN '' WHEN f2 IS NULL THEN f1 ELSE f1 || ',' || f2 || ',f8,f9' END AS fs FROM p)
SELECT rule_id, CASE WHEN ok THEN kind END AS type, CASE WHEN ok THEN fs END AS targets, CASE WHEN ok THEN 1 END AS n_conditions,
  CASE WHEN ok THEN CASE kind WHEN 'simple' THEN 'Simple Rule' WHEN 'cross_field' THEN 'Cross Field Rule' ELSE 'Pattern Rule' END
    || CASE WHEN fs = '' THEN '' WHEN f2 IS NULL THEN ' on ' || f1 ELSE ' on ' || f1 || ', ' || f2 || ', f8 (+1 more)' END END AS rule_name,
  CASE WHEN ok THEN label || ' greater_than ' || CAST(rule_id % 100 AS VARCHAR) END AS conditions_summary,
  CASE scope WHEN 'catalog' THEN 'All tables in catalog ''' || CAST(catalog_id AS VARCHAR) || ''''
    WHEN 'table' THEN 'Table ''' || CAST(table_id AS VARCHAR) || ''' in catalog ''' || CAST(catalog_id AS VARCHAR) || ''''
    ELSE 'Column ''' || CAST(column_id AS VARCHAR) || ''' in table ''' || CAST(table_id AS VARCHAR) || '''' END AS target_scope,
  CASE WHEN ok THEN 'reject' END AS expected_behavior FROM t""",
    "q54b_no_rule_in_prose": "SELECT role, count(*) AS texts, count(*) FILTER (text LIKE '{{%}}') AS definitions FROM {conversations} GROUP BY role",
    "q55_retention": """SELECT event_type, count(*) AS kept, min(event_id) AS first_id FROM {events} WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY GROUP BY event_type""",
    "q56_python_rule": f"""SELECT c_custkey AS record_id, 'name_long' AS rule_id, 'name long' AS rule_name,
  ({_BALANCE_OK} AND c_acctbal < 0) IS NOT TRUE AND coalesce(length(trim(c_name)) > 8, false) AS passed,
  CASE WHEN {_BALANCE_OK} AND c_acctbal < 0 THEN 'Execution error: negative balance'
    WHEN coalesce(length(trim(c_name)) > 8, false) THEN '' ELSE 'Rule condition not met' END AS message FROM {{customer_dirty}}""",
    "q57_admit_files": """WITH x AS (SELECT *, string_split(path, '/')[-1] AS base FROM {files}),
e AS (SELECT *, CASE WHEN contains(base, '.') THEN lower(string_split(base, '.')[-1]) ELSE '' END AS ext FROM x),
r AS (SELECT *, CASE WHEN ext NOT IN ('csv', 'parquet') THEN 'file type not allowed' WHEN length > 524288000 THEN 'file too large' WHEN length <= 0 THEN 'file is empty' ELSE '' END AS reason FROM e)
SELECT page_id, reason = '' AS is_valid, reason, CASE WHEN ext = 'csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS content_type FROM r""",
    "q58_listing_runs": """SELECT run_id, dataset_id, status, score, rules_count, strftime(started_at, '%Y-%m-%d') AS started_at FROM {runs} WHERE dataset_id = 'ds5' AND status = 'completed'""",
    "q58b_run_results": f"""SELECT c_custkey % 10 AS run_id, c_custkey AS record_id, rule_id, passed, CASE WHEN NOT passed THEN c_mktsegment END AS segment
FROM ({_RESULTS}) WHERE c_custkey % 10 = 3""",
    "q59_notifications": "SELECT id, event_type, status, retry_count FROM {notifications} WHERE event_type = 'report_publication'",
    "q60_upsert": """SELECT run_id, dataset_id, score FROM {runs} WHERE run_id NOT IN (SELECT event_id * 3 FROM {events})
UNION ALL SELECT event_id * 3, 'new', value FROM {events}""",
    "q60b_update_rules": """SELECT r.rule_id, CASE WHEN s.s_suppkey % 2 = 0 THEN 'draft' ELSE r.status END AS status,
  CASE WHEN s.s_suppkey % 3 = 0 THEN s.s_name ELSE r.natural_language END AS natural_language FROM {rules} r LEFT JOIN {supplier} s ON s.s_suppkey = r.rule_id""",
    "q60c_delete": "SELECT run_id, dataset_id FROM {runs} WHERE run_id NOT IN (SELECT l_orderkey FROM {lineitem})",
    "q52e_lint_recipients": f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]'), lambda x: contains(x, '@')) AS r FROM {{documents}}),
b AS (SELECT doc_id, r, len(list_filter(r, lambda x: NOT (len(string_split(x, '@')) = 2 AND length(string_split(x, '@')[1]) > 0 AND contains(string_split(x, '@')[2], '.')))) AS bad FROM w)
SELECT doc_id, {_lint(("doc_id % 2 = 1", "event_type: not a known type"), ("len(r) > 20", "recipients: more than 20"), ("bad > 0", "recipients: an address is not valid"))} AS errors FROM b""",
    "q52f_lint_tables": f"""WITH n AS (SELECT p_partkey, repeat(p_name, p_partkey % 40) AS name FROM {{part}})
SELECT p_partkey, {_lint(("coalesce(trim(name), '') = ''", "name: required"), ("length(trim(name)) > 200", "name: longer than 200"))} AS errors FROM n""",
    "q52g_lint_templates": f"""SELECT p_partkey, {_lint(("p_size % 4 = 1 OR p_partkey % 3 = 0", "fields: a field has no name or no known type"))} AS errors FROM {{part}}""",
    "q58c_run_detail": """SELECT run_id, dataset_id, status, CAST(CASE WHEN run_id % 2 = 0 THEN 2 ELSE 0 END AS INT) AS rules, CAST(CASE WHEN run_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS facts
FROM {runs} WHERE run_id = 77""",
    "q59b_report_listing": """SELECT o_orderkey AS id, 'published' AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {orders} WHERE o_orderkey % 3 = 0""",
    "q61_parse_iso": """WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) + INTERVAL '1 hour 2 minutes 3 seconds'
  WHEN 2 THEN date_trunc('day', o_orderdate) + INTERVAL '1 hour 2 minutes 3 seconds' WHEN 3 THEN date_trunc('day', o_orderdate) - INTERVAL '57 minutes 57 seconds' END AS t FROM {orders})
SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(t, '%Y-%m') AS month FROM p""",
    "q62_target_fields": """WITH t AS (SELECT rule_id, CASE WHEN rule_id % 6 = 0 AND f2 IS NOT NULL AND f1 IS NOT NULL THEN f1 || ',' || f2 || ',f8,f9' ELSE '' END AS fields FROM {rules})
SELECT rule_id, fields, CAST(CASE WHEN fields = '' THEN 0 ELSE 4 END AS INT) AS n FROM t""",
    "q63_truncate": """WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS v FROM {documents})
SELECT doc_id, substring(v, 1, 500) AS description, CAST(length(v) AS INT) AS whole_length FROM t""",
    "q56b_python_types": """SELECT o_orderkey AS record_id, 'reveal' AS rule_id, 'reveal' AS rule_name, coalesce(n % 2 = 0 AND n > 9007199254745992, false) AS passed,
  CASE WHEN n IS NULL THEN 'Execution error: None' WHEN n % 2 = 1 THEN 'Execution error: ' || CAST(n AS VARCHAR)
    WHEN n > 9007199254745992 THEN '' ELSE 'Rule condition not met' END AS message
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + 9007199254740992 END AS n FROM {orders}) x""",
    "q64b_big_numbers": "SELECT o_orderkey, " + ", ".join(
        f"n = 9007199254740993 AS {c}_eq, n <> 9007199254740993 AS {c}_ne, n > 9007199254740993 AS {c}_gt, "
        f"n < 9007199254740993 AS {c}_lt, n BETWEEN 9007199254740993 AND 9007199254740994 AS {c}_in" for c in "nt"
    ) + " FROM (SELECT o_orderkey, 9007199254740990 + o_orderkey % 7 AS n FROM {orders}) x",
    "q59c_recipients": """WITH p AS (SELECT c_nationkey, min(c_name) AS first, max(c_name) AS last FROM {customer} WHERE c_acctbal > 0 GROUP BY c_nationkey),
k AS (SELECT n_name AS event_type, CASE WHEN n_nationkey % 4 <> 0 THEN concat_ws(',', first, last) ELSE '' END AS emails, first AS updated_by
  FROM {nation} LEFT JOIN p ON n_nationkey = c_nationkey)
SELECT CAST(NULL AS VARCHAR) AS asked, * FROM k UNION ALL SELECT 'CHINA', * FROM k WHERE event_type = 'CHINA'""",
    "q64c_long_numbers": """SELECT o_orderkey, CASE f WHEN 2 THEN NOT minus ELSE v > 90071992547409935 END AS above, CASE f WHEN 2 THEN minus ELSE v < 90071992547409935 END AS below,
  f < 2 AND v BETWEEN 90071992547409930 AND 90071992547409945 AS inside, f = 2 AND NOT minus AND tail > 500 AS huge, f = 2 AND minus AND tail > 500 AS deep
FROM (SELECT o_orderkey, o_orderkey % 3 AS f, o_orderkey % 2 = 0 AS minus, o_orderkey % 1000 AS tail,
  CASE o_orderkey % 3 WHEN 0 THEN (9007199254740990 + o_orderkey % 7) * 10 + o_orderkey % 10 ELSE (9007199254740990 + o_orderkey % 10) * 10 END AS v FROM {orders}) x""",
    "q64_field_value_types": """SELECT event_id, user_id > 90 AS above, ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' AS in_week,
  event_type IN ('view', 'click') AS kinds FROM {events}""",
}

ORACLES: dict[str, str] = {name: duckdb_sql(text) for name, text in _ORACLES.items()}
