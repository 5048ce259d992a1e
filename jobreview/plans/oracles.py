"""SQL for the registered queries, over the same tables."""

from __future__ import annotations

from jobreview.operators import advisor, insights, reports, runs, summary
from jobreview.plans import queries as q


def lit(text: str) -> str:
    """SQL string literal; line ends and tabs as chr() calls."""
    quoted = "'" + text.replace("'", "''") + "'"
    for char, code in (("\n", 10), ("\r", 13), ("\t", 9)):
        quoted = quoted.replace(char, f"' || chr({code}) || '")
    return quoted


EVENTS = """
SELECT CASE WHEN event_id % 97 <> 0 THEN CAST(user_id AS VARCHAR) END AS customer_id,
       CAST(event_id AS VARCHAR) AS event_id, event_type, ts AS event_ts,
       CASE WHEN event_id % 5 <> 0 THEN 'user' || user_id || '@example.com' END AS email,
       CASE user_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' END AS loyalty_tier,
       'C' || (user_id % 25) AS country, props AS preferences,
       '{"value":' || CAST(value AS VARCHAR) || '}' AS attributes
FROM events WHERE event_id % 97 <> 0"""

PROFILES = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_custkey % 10 <> 0 AS is_current,
       c_mktsegment AS segment, c_acctbal AS lifetime_value,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) AS last_profile_update_ts
FROM customer"""

ENRICHED = f"""
SELECT e.customer_id, e.event_id, e.event_type, e.event_ts, e.email, e.loyalty_tier,
       p.segment AS profile_segment, p.lifetime_value AS profile_lifetime_value,
       p.last_profile_update_ts, e.country, e.preferences, e.attributes
FROM ({EVENTS}) e LEFT JOIN ({PROFILES}) p
  ON e.customer_id = p.customer_id AND p.is_current"""

ENRICHED_COLUMNS = (
    "customer_id event_id event_type event_ts email loyalty_tier profile_segment "
    "profile_lifetime_value last_profile_update_ts country preferences attributes"
).split()


def joined_hash(columns) -> str:
    return "sha256(concat_ws('||', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + "))"


def json_hash(columns) -> str:
    fields = ", ".join(f"'{c}', CAST({c} AS VARCHAR)" for c in columns)
    return f"sha256(CAST(json_object({fields}) AS VARCHAR))"


AUDIT = f"""TIMESTAMP '{q.AS_OF}' AS row_ins_utc_tms, TIMESTAMP '{q.AS_OF}' AS row_upd_utc_tms,
       TIMESTAMP '{q.AS_OF}' AS row_eff_start_tms,
       TIMESTAMP '9999-12-31 23:59:59' AS row_eff_end_tms, TRUE AS is_current"""

ENRICHMENT = f"SELECT *, {joined_hash(ENRICHED_COLUMNS)} AS row_hash, {AUDIT} FROM ({ENRICHED})"

NO_JOIN = f"""
SELECT *, {joined_hash(ENRICHED_COLUMNS)} AS row_hash, {AUDIT}
FROM (SELECT customer_id, event_id, event_type, event_ts, email, loyalty_tier,
             CAST(NULL AS VARCHAR) AS profile_segment, CAST(NULL AS DOUBLE) AS profile_lifetime_value,
             CAST(NULL AS TIMESTAMP) AS last_profile_update_ts, country, preferences, attributes
      FROM ({EVENTS}))"""

SCD2 = f"""
WITH hashed AS (
  SELECT *, {joined_hash(("customer_id", *q.TRACKED))} AS row_hash FROM ({EVENTS})),
marked AS (
  SELECT *, lag(row_hash) OVER (PARTITION BY customer_id ORDER BY event_ts) AS before FROM hashed),
changed AS (SELECT * FROM marked WHERE before IS NULL OR before <> row_hash),
ended AS (
  SELECT *, lead(event_ts) OVER (PARTITION BY customer_id ORDER BY event_ts) AS next_start
  FROM changed)
SELECT customer_id, {", ".join(q.TRACKED)}, row_hash, event_ts AS row_eff_start_tms,
       coalesce(next_start, TIMESTAMP '9999-12-31 23:59:59') AS row_eff_end_tms,
       next_start IS NULL AS is_current
FROM ended"""

LATEST = f"""
SELECT * EXCLUDE (rank) FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, event_type
                               ORDER BY event_ts DESC, event_id DESC) AS rank
  FROM ({EVENTS})) WHERE rank = 1"""

KPIS = """
SELECT o_orderkey AS query_id, lower(o_orderpriority) AS environment,
       o_orderkey * 7919 % 3000000 AS rows_read, o_orderkey * 104729 % 12000000 AS rows_written,
       CAST(o_orderkey * 37 % 4096 AS DOUBLE) AS bytes_read_mb,
       CAST(o_orderkey * 53 % 2300 AS DOUBLE) AS bytes_written_mb,
       CAST(o_orderkey * 101 % 2000 AS DOUBLE) AS total_duration_seconds,
       CASE o_orderkey % 8 WHEN 0 THEN 'scan,broadcasthashjoin' WHEN 1 THEN 'batchevalpython'
         WHEN 2 THEN 'project' WHEN 5 THEN 'project' WHEN 3 THEN 'scan,aggregate'
         WHEN 4 THEN 'photonparquetwriter' WHEN 6 THEN 'union,photonparquetwriter' ELSE '' END
         AS operators
FROM orders"""


def any_of(names) -> str:
    return "(" + " OR ".join(f"list_contains(ops, '{name}')" for name in names) + ")"


RULES = {
    "heavy_exchange": any_of(advisor.HEAVY_EXCHANGE),
    "python_eval": any_of(advisor.PYTHON_EVAL),
    "large_write": "(rows_written > 10000000 OR bytes_written_mb > 2048)",
    "long_run": "total_duration_seconds > 1800",
    "read_heavy": f"({any_of(advisor.READ_OPERATORS)} AND total_duration_seconds > 900 "
    "AND bytes_read_mb > 2048)",
    "short_native_write": "(rows_written < 2000000 AND total_duration_seconds < 600 "
    f"AND bytes_written_mb < 1000 AND {any_of(advisor.NATIVE_WRITE)} "
    f"AND NOT {any_of(advisor.NOT_WITH_NATIVE_WRITE)})",
    "lightweight": "(total_duration_seconds < 300 AND rows_read < 1000000 "
    f"AND NOT {any_of(advisor.NOT_LIGHTWEIGHT)})",
}
LADDER = (
    "CASE "
    + " ".join(f"WHEN {RULES[name]} THEN {lit(text)}" for name, text in advisor.RESULTS.items())
    + f" ELSE {lit(advisor.NEUTRAL_RESULT)} END"
)
KPIS_SPLIT = f"SELECT *, string_split(operators, ',') AS ops FROM ({KPIS})"
KPIS_WITH_GAPS = f"""
SELECT query_id, rows_read, 0 AS rows_written, bytes_read_mb, bytes_written_mb,
       CASE WHEN query_id % 3 <> 0 THEN total_duration_seconds ELSE 0 END AS total_duration_seconds,
       CASE WHEN query_id % 4 <> 0 THEN string_split(operators, ',') ELSE [] END AS ops
FROM ({KPIS})"""


def url(job: str, run: str) -> str:
    return (
        "('https://adb-' || o_custkey || '.7.azuredatabricks.net/?o=' || o_custkey || "
        f"'#job/' || ({job}) || '/run/' || ({run}))"
    )


FIRST_URL = url("o_orderkey", "o_orderkey * 10")
HIDDEN_URL = url("o_orderkey", "99")
SECOND_URL = url("o_orderkey + 1", "5")
PULL_REQUESTS = f"""
SELECT o_orderkey AS pr_id, 'Fix <b>job</b>' || chr(10) || {FIRST_URL} || chr(13) || chr(10) ||
       '<' || {HIDDEN_URL} || '> ' || {SECOND_URL} || '<br>' AS description,
       [{FIRST_URL}, {FIRST_URL} || '/x', 'see ' || {FIRST_URL}, {SECOND_URL}] AS runs
FROM orders"""

PATTERN = runs.RUN_URL.removeprefix("(?d)")
PATTERN_WHOLE = runs.RUN_URL_WHOLE.removeprefix("(?d)")
FLAT = "regexp_replace(regexp_replace({0}, '(?:\\r\\n|[\\n\\r])$', ''), '\\r\\n|[\\n\\r]', ' ', 'g')"
CLEAN = "regexp_replace(" + FLAT + ", '<.*?>', '', 'g')"

IDS = ", ".join(
    f"regexp_extract(u, '{PATTERN}', {group}) AS {name}" for name, group in runs.ID_GROUPS.items()
)
REFS_TEXT = f"""
SELECT pr_id, CAST(pos - 1 AS INTEGER) AS pos, {IDS}
FROM (SELECT pr_id, unnest(urls) AS u, generate_subscripts(urls, 1) AS pos
      FROM (SELECT pr_id, regexp_extract_all({CLEAN.format("description")}, '{PATTERN}') AS urls
            FROM ({PULL_REQUESTS})))"""
REFS_URLS = f"""
SELECT pr_id, CAST(pos - 1 AS INTEGER) AS pos, u AS run_url, {IDS}
FROM (SELECT pr_id, unnest(runs) AS u, generate_subscripts(runs, 1) AS pos FROM ({PULL_REQUESTS}))
WHERE regexp_matches(u, '{PATTERN_WHOLE}')"""
REFS_KEYED = f"""
SELECT *, workspace_id || '_' || job_id || '_' || run_id AS run_key FROM ({REFS_TEXT})"""

# One row per run of an order: position 0 may lack a summary, position 1 never.
RUNS = """
SELECT o.*, o_orderkey AS k, pos,
       CASE pos WHEN 0 THEN o_orderkey ELSE o_orderkey + 1 END AS job,
       CASE pos WHEN 0 THEN o_orderkey * 10 ELSE 5 END AS run,
       NOT (pos = 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)) AS has_summary,
       o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AS has_analysis,
       o_orderkey % 31 <> 0 AS has_info
FROM orders o CROSS JOIN (VALUES (0), (1)) AS p(pos)"""
RUN_KEY = "(o_custkey || '_' || job || '_' || run)"
RESOLVED = f"SELECT *, {RUN_KEY} AS run_key FROM ({RUNS}) WHERE has_summary AND has_analysis"

BASE = lit(q.BASE_URL)
RUN_PAGE = f"({BASE} || '/#/app/application/db?execId=' || run_key)"
APP_PAGE = f"({BASE} || '/#/app/application/spark?execId=app-' || k || '&clusterUid=cl-' || k)"
CLUSTER_PAGE = f"({BASE} || '/#/compute/cluster_summary?cluster_uid=cl-' || k || '&app_id=app-' || k)"
COST = "('$ ' || CAST(CAST(o_totalprice + o_custkey AS DECIMAL(18,2)) AS VARCHAR))"
NODE = "('node-' || o_orderstatus)"
DRIVER = "('driver-' || (o_custkey % 10))"
TAGS = """('{"team":"T' || (o_custkey % 7) || '","env":"prod"}')"""
TAGS_MERGED = f"""CASE WHEN k % 3 = 0 THEN
    '{{"team":"T' || (o_custkey % 7) || '","env":"dev","owner":"' || o_orderpriority || '"}}'
    ELSE {TAGS} END"""
AUTOSCALE = f"""(CASE WHEN k % 2 = 0 THEN '{{"autoscale_min_workers":1,"autoscale_max_workers":' ||
    (k % 10 + 1) || ',"autoscale_target_workers":' || (k % 5 + 1) || '}}'
    ELSE {lit(summary.NO_AUTOSCALE)} END)"""


def linked(text: str, address: str, between: str, end: str) -> str:
    return f"('[' || {text} || '{between}' || {address} || '{end}')"


def table_values(between: str, end: str) -> str:
    cells = [
        linked("'app-' || k", APP_PAGE, between, end),
        linked("'cl-' || k", CLUSTER_PAGE, between, end),
        COST,
        NODE,
        DRIVER,
        TAGS,
        AUTOSCALE,
    ]
    return " || ' | ' || ".join(cells)


MARKDOWN_TABLE = (
    lit("| " + " | ".join(summary.SUMMARY_HEADERS) + " |\n| " + " | ".join(["---"] * 7) + " |\n| ")
    + f" || {table_values('](', ')')} || "
    + lit(" |\n")
)
WIKI_TABLE = (
    lit("|| " + " || ".join(summary.SUMMARY_HEADERS) + " |\n| ")
    + f" || {table_values('|', ']')} || "
    + lit(" |\n")
)

KEY_LIST = "['efficiency', 'appFailure', 'Bottlenecks', 'SLA', 'SparkAppTimeReport']"
LABEL = (
    "CASE key "
    + " ".join(f"WHEN {lit(key)} THEN {lit(text)}" for key, text in insights.LABELS.items())
    + " END"
)
# Instances of an order's analysis: two in the first insight, one in the third
# of even orders. The text depends on the order only.
INSTANCES = f"""
SELECT *, {LABEL} AS label FROM (
  SELECT o_orderkey AS k, i.insight_pos, 0 AS category_pos,
         CASE i.insight_pos WHEN 0 THEN o_orderstatus ELSE 'late' END AS category, i.instance_pos,
         CASE WHEN i.n = 1 AND o_orderkey % 29 = 0 THEN 'Unknown'
              ELSE {KEY_LIST}[(o_orderkey + i.n) % 5 + 1] END AS key,
         'order ' || o_orderkey || ' ' || i.suffix AS title, o_orderpriority AS events,
         CASE WHEN o_orderkey % 3 = 0
              THEN '<ul><li> Use <b>cache</b> </li><li>Fix ' || o_orderkey || '</li></ul>'
              ELSE 'See ' || o_orderpriority END AS actions
  FROM orders CROSS JOIN (VALUES (0, 0, 0, 'a'), (0, 1, 1, 'b'), (2, 0, 2, 'c'))
       AS i(insight_pos, instance_pos, n, suffix)
  WHERE (i.insight_pos = 0 OR o_orderkey % 2 = 0) AND o_orderkey % 23 <> 0
    AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0)
WHERE key <> 'SparkAppTimeReport'"""
BULLETS = (
    "CASE WHEN contains(actions, '<li>') THEN '- Usecache' || chr(10) || '- Fix ' || k "
    "ELSE actions END"
)


def filled(template: str, **values: str) -> str:
    """SQL concatenation of a report template's literals and expressions."""
    from string import Formatter

    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(lit(literal))
        if name is not None:
            pieces.append(values[name])
    return " || ".join(pieces)


IDS_OF_RUN = {"workspace_id": "o_custkey", "job_id": "job", "run_id": "run", "run_page": RUN_PAGE}
BRAND_NAME = lit(q.BRAND.name)


def cards(template: str, actions: str) -> str:
    text = filled(
        template, key="upper(key)", label="label", title="title", events="events", actions=actions
    )
    return f"""SELECT k, string_agg({text}, '' ORDER BY insight_pos, instance_pos) AS cards
FROM ({INSTANCES}) WHERE label IS NOT NULL GROUP BY k"""


def section(alias: str) -> str:
    heading = filled(reports.INSIGHTS_HEADING, brand=BRAND_NAME)
    return f"CASE WHEN r.k % 23 = 0 THEN '' ELSE {heading} || coalesce({alias}.cards, '') END"


MARKDOWN_BLOCK = " || ".join(
    [
        filled(
            reports.MARKDOWN_HEAD, logo=lit(q.BRAND.logo_url), brand=BRAND_NAME, **IDS_OF_RUN
        ),
        filled(reports.MARKDOWN_SUMMARY, table=MARKDOWN_TABLE),
        "section",
        lit(reports.MARKDOWN_TAIL),
    ]
)
WIKI_BLOCK = " || ".join(
    [
        filled(reports.WIKI_HEAD, brand=BRAND_NAME, **IDS_OF_RUN),
        filled(reports.WIKI_SUMMARY, table=WIKI_TABLE),
        "section",
    ]
)


def blocks(block: str, card_rows: str) -> str:
    return f"""
SELECT k AS pr_id, pos, o_orderstatus, {block} AS block FROM (
  SELECT r.*, {section("c")} AS section
  FROM ({RESOLVED}) r LEFT JOIN ({card_rows}) c ON r.k = c.k WHERE r.has_info)"""


REPORT_MARKDOWN = f"""
SELECT pr_id, min(pos) AS from_pos, string_agg(block, '' ORDER BY pos) AS report
FROM ({blocks(MARKDOWN_BLOCK, cards(reports.MARKDOWN_CARD, "actions"))}) GROUP BY pr_id"""
REPORT_PAGED = f"""
WITH b AS ({blocks(MARKDOWN_BLOCK, cards(reports.MARKDOWN_CARD, "actions"))}),
s AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY pr_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {q.PAGE_CHARS} AS reached FROM b),
d AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY pr_id ORDER BY reached) - 1 AS INTEGER) AS part FROM s)
SELECT pr_id, part, CAST(max(max(part)) OVER (PARTITION BY pr_id) + 1 AS INTEGER) AS n_parts,
       min(pos) AS from_pos, string_agg(block, '' ORDER BY pos) AS report
FROM d GROUP BY pr_id, part"""
PREAMBLE = filled(
    reports.WIKI_PREAMBLE,
    brand=BRAND_NAME,
    pr_id="pr_id",
    commit_id="'c' || pr_id",
    base_branch="'base-' || o_orderstatus",
    target_branch="'main'",
)
REPORT_WIKI = f"""
SELECT pr_id, -1 AS from_pos, {PREAMBLE} || string_agg(block, '' ORDER BY pos) AS report
FROM ({blocks(WIKI_BLOCK, cards(reports.WIKI_CARD, BULLETS))}) GROUP BY pr_id, o_orderstatus"""

LINE_INSIGHTS = f"""
SELECT *, {LABEL} AS label FROM (
  SELECT l_orderkey, l_linenumber, 0 AS insight_pos, 0 AS category_pos, l_returnflag AS category,
         0 AS instance_pos, {KEY_LIST}[l_linenumber % 5 + 1] AS key,
         'line ' || l_linenumber AS title, l_linestatus AS events,
         CASE WHEN l_returnflag = 'N' THEN '<ul><li>Check ' || l_linenumber || '</li></ul>'
              ELSE 'plain' END AS actions
  FROM lineitem)
WHERE key <> 'SparkAppTimeReport'"""

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ITEM_TEXT = (
    f"regexp_replace(regexp_replace(i, '{SPACES}*<[^>]*>{SPACES}*', '', 'g'), "
    f"'^{SPACES}+|{SPACES}+$', '', 'g')"
)
PAGE_BULLETS = f"""
SELECT page_id, array_to_string(list_transform(
         regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1),
         lambda i: '- ' || {ITEM_TEXT}), chr(10)) AS bullets
FROM pages"""

NESTED_BULLETS = f"""
SELECT page_id, '- Page "' || page_id || '" & all' || array_to_string(items, '') || chr(10) ||
       array_to_string(list_transform(items, lambda i: '- ' || i), chr(10)) || chr(10) || '- last éé&' AS bullets
FROM (SELECT page_id, list_transform(
        regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1),
        lambda i: {ITEM_TEXT}) AS items FROM pages)"""

NOTIFICATIONS = f"""
SELECT c_custkey AS pr_id, {filled(
    reports.NOTIFICATION, brand=BRAND_NAME, pr_id="c_custkey", commit_id="'c' || c_custkey",
    base_branch="'dev'", target_branch="'main'",
    pr_url="'https://git.example.com/pr/' || c_custkey",
    ticket_url="'https://tickets.example.com/' || c_custkey")} || ' ' ||
  CASE WHEN c_custkey % 4 <> 0 THEN '@' || c_name || ' @' || c_mktsegment ELSE '' END AS message
FROM customer"""

SCAN_RULES = " UNION ALL ".join(
    f"SELECT {lit(pattern)} AS pattern, {lit(advice)} AS advice"
    for pattern, advice in q.SCAN_RULES.items()
)
HITS = f"""
SELECT f.doc_id, f.doc_id % 50 AS pr_id, 'c' || (f.doc_id % 50) AS commit_id,
       'doc_' || f.doc_id AS filename, r.pattern, r.advice, CAST(f.n AS INTEGER) AS line, f.lines
FROM (SELECT doc_id, lines, unnest(lines) AS text_line, generate_subscripts(lines, 1) AS n
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) f
JOIN ({SCAN_RULES}) r ON contains(f.text_line, r.pattern)"""
RULE_TABLE_HITS = f"""
WITH r AS (
  SELECT pattern, 'Mind ' || pattern AS advice
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{6,}}')) AS pattern FROM documents)
  ORDER BY md5(pattern) LIMIT {q.N_RULES}),
l AS (SELECT doc_id, unnest(lines) AS text_line, generate_subscripts(lines, 1) AS n
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
SELECT 'doc_' || doc_id AS filename, pattern, advice, CAST(n AS INTEGER) AS line
FROM l JOIN r ON contains(text_line, pattern)"""
CONTEXT = (
    "array_to_string(list_transform(range(greatest(line - 3, 1), line + 1), "
    "lambda n: n || ' ' || lines[n]), chr(10))"
)
COMMENTS = f"SELECT pr_id, advice AS body, filename AS path, commit_id, line FROM ({HITS})"
DELIVERY = f"""
SELECT pr_id, filename AS path, commit_id, line, CASE WHEN line % 2 = 0 THEN 201 ELSE 422 END AS status,
       CASE WHEN line % 2 = 0 THEN 'inline' ELSE 'fallback' END AS delivery,
       CASE WHEN line % 2 = 0 THEN advice ELSE
         {lit(chr(10) + "```python" + chr(10))} || {CONTEXT} || {lit(chr(10) + "```" + chr(10) * 4)} || advice
       END AS body
FROM ({HITS})"""


def registry() -> dict[str, str]:
    summaries = f"FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 31 <> 0"
    return {
        "normalize_events": EVENTS,
        "normalize_events_lenient": f"""
            SELECT customer_id, event_id,
                   CASE WHEN CAST(event_id AS BIGINT) % 50 <> 0 THEN event_ts END AS event_ts
            FROM ({EVENTS})""",
        "current_profiles": f"SELECT * FROM ({PROFILES}) WHERE is_current",
        "enrich_profile_left": ENRICHED,
        "enrich_profile_broadcast": ENRICHED,
        "enrich_profile_salted": ENRICHED,
        "enrich_profile_latest": f"""
            SELECT * REPLACE (lower(profile_segment) AS profile_segment,
                              last_profile_update_ts + INTERVAL 1 DAY AS last_profile_update_ts)
            FROM ({ENRICHED})""",
        "dedupe_keys": f"SELECT DISTINCT * FROM (({EVENTS}) UNION ALL ({EVENTS}))",
        "dedupe_latest": LATEST,
        "dedupe_latest_stream": LATEST,
        "row_hash": f"""
            SELECT customer_id, event_id, {joined_hash(ENRICHED_COLUMNS)} AS row_hash
            FROM ({ENRICHED})""",
        "row_hash_excluding": f"""
            SELECT customer_id, event_id, {joined_hash(
                c for c in ENRICHED_COLUMNS if c not in ("event_ts", "last_profile_update_ts")
            )} AS row_hash FROM ({ENRICHED})""",
        "row_hash_nullsafe": f"""
            SELECT customer_id, event_id, {json_hash(ENRICHED_COLUMNS)} AS row_hash
            FROM ({ENRICHED})""",
        "scd_audit_columns": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS segment, {AUDIT}
            FROM customer""",
        "scd2_close_versions": SCD2,
        "scd2_close_versions_split": SCD2,
        "scd2_merge_batches": SCD2,
        "enrichment_batch": ENRICHMENT,
        "enrichment_stream": ENRICHMENT,
        "enrichment_stream_hot": ENRICHMENT,
        "enrichment_stream_no_join": NO_JOIN,
        "stream_dedupe_watermark": EVENTS,
        "stream_late_rows": f"""
            WITH e AS ({EVENTS}),
            b AS (SELECT epoch_us(min(event_ts)) AS low, epoch_us(max(event_ts)) AS high FROM e)
            SELECT customer_id, event_id, late, CASE WHEN late THEN 2 ELSE 1 END AS n
            FROM (SELECT customer_id, event_id, epoch_us(event_ts) < low + (high - low) // 2 AS late
                  FROM e, b)""",
        "kpi_normalized": KPIS,
        "kpi_defaults": f"SELECT query_id, {LADDER} AS recommendation FROM ({KPIS_WITH_GAPS})",
        "kpi_rules": "SELECT query_id, "
        + ", ".join(f"{condition} AS {name}" for name, condition in RULES.items())
        + f" FROM ({KPIS_SPLIT})",
        "kpi_recommendation": f"SELECT query_id, {LADDER} AS recommendation FROM ({KPIS_SPLIT})",
        "clean_descriptions": f"""
            SELECT pr_id, {FLAT.format("description")} AS flat, {CLEAN.format("description")} AS cleaned
            FROM ({PULL_REQUESTS})""",
        "clean_documents": f"""
            SELECT doc_id, sha256({CLEAN.format("text")}) AS cleaned_hash FROM documents""",
        "run_refs_text": REFS_TEXT,
        "run_refs_urls": REFS_URLS,
        "run_key": f"SELECT DISTINCT pr_id, run_key FROM ({REFS_KEYED})",
        "lookback": """
            SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN
              TIMESTAMP '1998-07-19 10:00:42' AND TIMESTAMP '1998-08-02 10:00:42'""",
        "run_resolved": f"""
            SELECT k AS pr_id, pos, run_key, 'cl-' || k AS clusterUid, 'app-' || k AS sparkAppId,
                   'tune' AS recommendation,
                   CASE WHEN k % 23 = 0 THEN 0 WHEN k % 2 = 0 THEN 3 ELSE 2 END AS n_insights
            FROM ({RESOLVED})""",
        "run_resolved_relanded": f"""
            SELECT k AS pr_id, pos, {RUN_KEY} AS run_key, 'cl-' || k AS clusterUid,
                   CASE WHEN k % 19 = 0 THEN 'old' ELSE 'tune' END AS recommendation,
                   CASE WHEN k % 19 = 0 OR k % 23 = 0 THEN 0 WHEN k % 2 = 0 THEN 3 ELSE 2 END AS n_insights
            FROM ({RUNS}) WHERE has_summary AND k % 13 <> 0 AND k % 17 <> 0""",
        "run_not_found": f"""
            SELECT k AS pr_id, pos, {RUN_KEY} AS run_key FROM ({RUNS}) WHERE NOT has_summary""",
        "run_rejects": f"""
            SELECT k AS pr_id, pos, {RUN_KEY} AS run_key,
                   CASE WHEN NOT has_summary THEN 'no task summary'
                        WHEN NOT has_analysis THEN 'no analysis'
                        ELSE 'unusable app summary' END AS reason
            FROM ({RUNS}) WHERE NOT (has_summary AND has_analysis AND has_info)""",
        "refused_responses": """
            SELECT 'cl-' || o_orderkey AS clusterUid, '{"message": "INVALID_TOKEN"}' AS body
            FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0""",
        "landed_bodies": """
            WITH o AS (SELECT o_orderkey AS k, 'cl-' || o_orderkey AS c FROM orders)
            SELECT c AS clusterUid, 'accepted' AS state,
                   CASE WHEN k % 19 = 0 OR k % 17 = 0 THEN '{"recommendation":"old"}'
                        ELSE '{"recommendation":"r' || k || '"}' END AS body FROM o
            UNION ALL SELECT c, 'refused', '{"message":"INVALID_TOKEN"}' FROM o WHERE k % 19 = 0
            UNION ALL SELECT NULL, 'malformed', '{"clusterUid":"' || c || '","response":{"recomm'
            FROM o WHERE k % 17 = 0 AND k % 19 <> 0""",
        "unusable_analyses": """
            SELECT 'cl-' || o_orderkey AS clusterUid,
                   CASE WHEN o_orderkey % 13 = 0 THEN '{}'
                        WHEN o_orderkey % 17 = 0 THEN '{"insightsV2": [{"categories"'
                        ELSE '{"message": "INVALID_TOKEN"}' END AS body
            FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0""",
        "app_summary": f"""
            SELECT k AS pr_id, pos, {RUN_PAGE} AS run_page, {APP_PAGE} AS app_page,
                   {CLUSTER_PAGE} AS cluster_page, {COST} AS estimated_cost,
                   {NODE} AS executor_node_type, {DRIVER} AS driver_node_type, {TAGS} AS tags,
                   {AUTOSCALE} AS autoscale
            FROM ({RESOLVED}) WHERE has_info""",
        "app_summary_custom_tags": f"""
            SELECT 'app-' || k AS sparkAppId,
                   {BASE} || '/#/app/application/db?execId=app-' || k || '_run' AS run_page,
                   {TAGS_MERGED} AS tags {summaries}""",
        "bad_run_info": """
            SELECT 'app-' || o_orderkey AS sparkAppId FROM orders WHERE o_orderkey % 31 = 0""",
        "summary_tables": f"""
            SELECT 'app-' || k AS sparkAppId, {MARKDOWN_TABLE} AS markdown, {WIKI_TABLE} AS wiki
            {summaries}""",
        "insight_rows": LINE_INSIGHTS,
        "insight_rows_nested": f"""
            SELECT * EXCLUDE (k), 'app-' || k AS sparkAppId FROM ({INSTANCES})""",
        "unlabelled_insights": f"""
            SELECT 'app-' || k AS sparkAppId, key, title FROM ({INSTANCES}) WHERE label IS NULL""",
        "html_bullets": PAGE_BULLETS,
        "html_bullets_any": PAGE_BULLETS,
        "html_bullets_nested": NESTED_BULLETS,
        "action_texts": f"""
            SELECT l_orderkey, l_linenumber, key,
                   CASE WHEN contains(actions, '<li>') THEN '- Check ' || l_linenumber
                        ELSE actions END AS action_text
            FROM ({LINE_INSIGHTS})""",
        "report_markdown": REPORT_MARKDOWN,
        "report_wiki": REPORT_WIKI,
        "report_paged": REPORT_PAGED,
        "reviewers": """
            SELECT c_custkey AS pr_id, CASE WHEN c_custkey % 4 <> 0 THEN 2 ELSE 0 END AS n,
                   CASE WHEN c_custkey % 4 <> 0 THEN c_name || ',' || c_mktsegment ELSE '' END AS logins
            FROM customer""",
        "reviewer_mentions": NOTIFICATIONS,
        "code_hits": f"SELECT filename, pattern, line FROM ({HITS})",
        "code_hits_rule_table": RULE_TABLE_HITS,
        "code_context": f"SELECT filename, pattern, line, {CONTEXT} AS context FROM ({HITS})",
        "code_comments": COMMENTS,
        "code_delivery": DELIVERY,
        "code_comments_gated": f"""
            SELECT * FROM ({COMMENTS}) WHERE pr_id IN (SELECT k FROM ({RESOLVED}))""",
    }
