"""Queries over the supplied tables and inline logs, and the same in SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell import queries_logs as G
from tracewell import queries_more as E
from tracewell.functions import redact
from tracewell.functions import text as X
from tracewell.functions import urls as U
from tracewell.operators import changes as C
from tracewell.operators import graph as G_
from tracewell.operators import intervals as I_
from tracewell.operators import logs as L
from tracewell.operators import relational as Q
from tracewell.operators.lineage import shared_folder
from tracewell.operators import similarity as M
from tracewell.plans import diagnosis as D
from tracewell.plans import inspection as I
from tracewell.plans import retrieval as V
from tracewell.sources.readers import landed, strict_objects

PATHS = ["src/app/main.py", "src/app/util.py", "tests/test_main.py", "lib/util.py", "docs/Guide.md"]
TRACE_PATHS = ["app/main.py", "util.py", "Guide.md", "missing.py", "SRC/app/main.py", "docs/guide.md"]


TABLES = ("documents", "events", "pages")


def _derived(s, d, text: str):
    """Rows that SQL derives from the given tables; the same text, with ``_plain``, is part of the other engine's query."""
    return s.sql(text, **{t: landed(s, d, t) for t in TABLES if f"{{{t}}}" in text})


def _plain(text: str) -> str:
    return "(" + text.format(**{t: t for t in TABLES}) + ")"


def _with(s, d, text: str, cases: list[tuple], schema: str):
    """Derived rows with odd cases appended."""
    return _derived(s, d, text).unionByName(s.createDataFrame(cases, schema))


def _with_sql(text: str, cases: list[tuple], columns: str) -> str:
    return f"(SELECT {columns} FROM {_plain(text)} UNION ALL SELECT * FROM {G.values_sql(cases, columns)})"


#: Files that documents stand for, traces that events name, files that changed with what they were and are, what CI files refer to.
KNOWN = "SELECT DISTINCT concat('app', doc_id % 7, '/Lang_', coalesce(lang, 'x'), '/f', doc_id % 23, '.py') AS path FROM {documents}"
TRACED = "SELECT DISTINCT CASE event_id % 3 WHEN 0 THEN concat('f', event_id % 40, '.py') WHEN 1 THEN concat('app', event_id % 9, '/lang_en/f', event_id % 23, '.py') ELSE concat('Lang_de/f', event_id % 30, '.py') END AS path FROM {events}"
CHANGED = """SELECT path AS old_path, CASE k WHEN 0 THEN lower(path) WHEN 3 THEN concat('new/', n, '/', lower(path)) ELSE path END AS new_path, k = 1 AS deleted_file, k IN (0, 3) AND n % 2 = 0 AS renamed_file, 'd' AS note
FROM (SELECT concat('app', a, '/Lang_', l, '/f', f, '.py') AS path, (a + f) % 6 AS k, a * f AS n FROM (SELECT DISTINCT doc_id % 7 AS a, doc_id % 23 AS f, coalesce(lang, 'x') AS l FROM {documents})) WHERE k < 4"""
REFERRED = """SELECT DISTINCT concat('ci/build', user_id % 5, '.yml') AS path, CASE event_id % 4 WHEN 0 THEN concat('app', event_id % 7, '/lang_en/f', event_id % 23, '.py') WHEN 1 THEN concat('app', event_id % 7, '/Lang_en/f', event_id % 23, '.py') WHEN 2 THEN concat('gone/', event_id % 9) ELSE '$X/y' END AS referenced FROM {events}"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def q_fingerprint_clusters(s, d):
    rows = landed(s, d, "documents").select(X.fingerprint(F.col("source"), F.lit(None), F.col("text")).alias("fingerprint"), F.col("source").alias("category"), F.col("doc_id").alias("updated_at"))
    return Q.cluster_report(rows, None)


_NORMAL_SQL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\b\d{4}-\d{2}-\d{2}[T ][0-9:.+-]+\b', '<timestamp>', 'g'), '(?i)\b[0-9a-f]{8}-[0-9a-f-]{18,}\b', '<id>', 'g'), '(^|[^A-Za-z0-9_])(?:[A-Za-z]:)?[/\\][^\s:]+', '\1<path>', 'g'), '\b\d{5,}\b', '<number>', 'g'), '\s+', ' ', 'g')))"
SQL: dict[str, str] = {
    "fingerprint_clusters": f"SELECT substr(sha256(coalesce(source, '') || '||' || {_NORMAL_SQL}), 1, 20) AS fingerprint, source AS category, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY 1, 2",
}


def q_line_explode(s, d):
    rows = landed(s, d, "documents").select("doc_id", F.posexplode(X.physical_lines(F.col("text"))).alias("idx", "raw"))
    return rows.select("doc_id", "idx", F.sha2("raw", 256).alias("line_sha256"))


SQL["line_explode"] = "SELECT doc_id, (unnest(range(1, len(l) + 1)) - 1)::INT AS idx, sha256(unnest(l)) AS line_sha256 FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n+$', ''), chr(10)) AS l FROM documents WHERE text <> '')"


RUNS = [("r1", "failed", None, False), ("r2", "success", None, False), ("r3", "success", None, True), ("r4", "running", None, False), ("r5", "completed", "success", False), ("r6", "canceled", None, False), ("r7", None, None, False), ("r8", "Completed", "timed_out", None), ("r9", "passed", None, None)]
RUN_FINDINGS = [("r1", "warning"), ("r2", "info"), ("r5", "info"), ("r5", "warning"), ("r4", "error")]


#: Users as runs whose status is that of their smallest event, with findings of some.
_RUNS = "SELECT concat('u', user_id) AS run_id, CASE min(event_id) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'Success' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'canceled' WHEN 5 THEN 'passed' END AS status, CASE min(event_id) % 2 WHEN 0 THEN 'success' ELSE 'failure' END AS conclusion, min(event_id) % 11 = 0 AS partial FROM {events} GROUP BY user_id"
_RUN_FINDINGS = "SELECT DISTINCT concat('u', user_id) AS run_id, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity FROM {events} WHERE user_id % 3 = 0"


def q_overall(s, d):
    return D.overall_status(_with(s, d, _RUNS, RUNS, "run_id string, status string, conclusion string, partial boolean"), _with(s, d, _RUN_FINDINGS, RUN_FINDINGS, "run_id string, severity string"))


SQL["overall_status"] = f"""
WITH r AS (SELECT run_id, CASE WHEN lower(status) = 'completed' THEN lower(coalesce(conclusion, status)) ELSE lower(status) END AS outcome, coalesce(partial, false) AS partial FROM {_with_sql(_RUNS, RUNS, 'run_id, status, conclusion, partial')})
SELECT run_id, CASE WHEN outcome IS NULL THEN 'configuration_only' WHEN outcome IN ('failed', 'failure', 'timed_out') THEN 'failed'
  WHEN outcome IN ('created', 'waiting_for_resource', 'preparing', 'pending', 'running', 'scheduled', 'canceling') THEN 'in_progress'
  WHEN outcome IN ('success', 'succeeded', 'passed') AND NOT partial AND run_id NOT IN (SELECT run_id FROM {_with_sql(_RUN_FINDINGS, RUN_FINDINGS, 'run_id, severity')} WHERE severity IN ('error', 'warning')) THEN 'passed' ELSE 'warning' END AS status
FROM r"""


def q_error_islands(s, d):
    errors = landed(s, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx")).where("event_type = 'error'")
    return L.islands(errors.select("user_id", F.greatest(F.col("idx") - 3, F.lit(1)).alias("lo"), (F.col("idx") + 7).alias("hi")), "user_id").select("user_id", F.col("island").cast("long").alias("island"), "lo", "hi")


SQL["error_islands"] = """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
w AS (SELECT user_id, greatest(idx - 3, 1)::INT AS lo, (idx + 7)::INT AS hi FROM e WHERE event_type = 'error'),
m AS (SELECT *, CASE WHEN coalesce(max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 < lo, true) THEN 1 ELSE 0 END AS new FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, island"""


def q_asof(s, d):
    e = landed(s, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)).where("event_type = 'error'").select("event_id", "last_view")


SQL["asof_last_event"] = "SELECT event_id, last_view FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_view FROM events) WHERE event_type = 'error'"


def q_state(s, d):
    e = landed(s, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 0)
    return e.withColumn("open", F.coalesce(F.last(state, ignorenulls=True).over(order), F.lit(0))).groupBy("user_id").agg(F.sum("open").alias("open_events"), F.count("*").alias("n"))


SQL["state_after_marker"] = "SELECT user_id, sum(coalesce(o, 0))::BIGINT AS open_events, count(*) AS n FROM (SELECT user_id, last_value(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS o FROM events) GROUP BY user_id"


def q_budget(s, d):
    used = Q.budget_cut(landed(s, d, "conversations"), "conv_id", "turn", "text", 1000)
    return used.select("conv_id", "turn", F.length("used").alias("kept"), F.sha2("used", 256).alias("sha256"))


SQL["context_budget"] = "SELECT conv_id, turn, length(u)::INT AS kept, sha256(u) AS sha256 FROM (SELECT conv_id, turn, substr(text, 1, greatest(1000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT) AS u FROM conversations)"


def q_next_key(s, d):
    o = landed(s, d, "orders")
    return o.select("o_orderkey", "o_custkey", (F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("until"))


SQL["next_key_range"] = "SELECT o_orderkey, o_custkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS until FROM orders"


def q_join_inner(s, d):
    o, c = landed(s, d, "orders"), landed(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


SQL["join_inner"] = "SELECT c_mktsegment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def q_zero_fill(s, d):
    o, c = landed(s, d, "orders"), landed(s, d, "customer")
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(counts, c.c_custkey == counts.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


SQL["join_left_zero_fill"] = "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey"


def q_semi(s, d):
    return landed(s, d, "customer").join(landed(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def q_anti(s, d):
    return landed(s, d, "part").join(landed(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


SQL["join_semi"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"
SQL["join_anti"] = "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"


def q_band(s, d):
    """Each error with the number of its user's events in the ten minutes before: a range join on time cells."""
    e = landed(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    width = 600_000_000
    errors = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("us").alias("at"), F.explode(F.array(F.expr(f"us div {width}"), F.expr(f"us div {width} - 1"))).alias("cell"))
    others = e.select(F.col("event_id").alias("other"), "user_id", "us", F.expr(f"us div {width}").alias("cell"))
    near = errors.join(others, ["user_id", "cell"]).where(f"us <= at and us >= at - {width} and other <> error_id")
    return near.groupBy("error_id").agg(F.count("*").alias("n"))


SQL["join_band"] = "SELECT a.event_id AS error_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 10 MINUTE AND a.event_id <> b.event_id WHERE a.event_type = 'error' GROUP BY 1"


def q_suffix(s, d):
    return Q.unique_suffix(_with(s, d, TRACED, [(p,) for p in TRACE_PATHS], "path string"), "path", _with(s, d, KNOWN, [(p,) for p in PATHS], "path string").withColumnRenamed("path", "known"), "known")


SQL["join_unique_suffix"] = f"SELECT path, min(known) AS known FROM {_with_sql(TRACED, [(p,) for p in TRACE_PATHS], 'path')} JOIN (SELECT path AS known FROM {_with_sql(KNOWN, [(p,) for p in PATHS], 'path')}) ON known = path OR ends_with(known, '/' || path) GROUP BY path HAVING count(*) = 1"


def q_case(s, d):
    return Q.case_mismatch(_with(s, d, TRACED, [(p,) for p in TRACE_PATHS], "path string"), "path", _with(s, d, KNOWN, [(p,) for p in PATHS], "path string").withColumnRenamed("path", "known"), "known")


SQL["case_mismatch_paths"] = f"""
WITH p AS (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM {_with_sql(TRACED, [(p,) for p in TRACE_PATHS], 'path')}),
w AS (SELECT path, k, array_to_string(string_split(path, '/')[1:k], '/') AS prefix FROM p),
q AS (SELECT known, unnest(range(1, len(string_split(known, '/')) + 1)) AS k FROM (SELECT path AS known FROM {_with_sql(KNOWN, [(p,) for p in PATHS], 'path')})),
h AS (SELECT DISTINCT array_to_string(string_split(known, '/')[1:k], '/') AS prefix FROM q),
b AS (SELECT lower(prefix) AS folded, min(prefix) AS spelled, count(*) AS n FROM h GROUP BY 1)
SELECT path, arg_min(spelled, k) AS expected FROM w JOIN b ON lower(prefix) = folded AND n = 1 AND spelled <> prefix GROUP BY path"""
_JOBS = [("1", "build", "gitlab"), ("2", "test 1/3", "gitlab"), ("3", "Deploy-Prod", "github"), ("4", "lint: [a, b]", "gitlab"), ("5", "nothing", "github"), ("6", "Unit/Tests", "gitlab")]
_NODES = ["build", "test", "deploy_prod", "lint", "unittests"]


_NAMED = "SELECT concat('e', event_id) AS job_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, ' ', user_id % 3 + 1, '/3') WHEN 2 THEN concat(upper(event_type), '-') WHEN 3 THEN concat(event_type, ': [a, ', user_id, ']') ELSE concat('no ', event_type) END AS name, CASE event_id % 2 WHEN 0 THEN 'gitlab' ELSE 'github' END AS provider FROM {events}"
_NODES += ["click", "view", "error", "sign_up", "SignUp", "purchase"]


def q_tiered(s, d):
    return Q.tiered_match(_with(s, d, _NAMED, _JOBS, "job_id string, name string, provider string"), s.createDataFrame([(n,) for n in _NODES], "node string"))


SQL["join_tiered_unique"] = f"""
WITH j AS (SELECT * FROM {_with_sql(_NAMED, _JOBS, 'job_id, name, provider')}), n AS (SELECT * FROM {G.values_sql([(x,) for x in _NODES], 'node')}),
c AS (
  SELECT job_id, node, 1 AS tier, 1.0::DOUBLE AS confidence FROM j JOIN n ON name = node
  UNION ALL SELECT job_id, node, 2, 0.9 FROM j JOIN n ON regexp_replace(name, '\\s+(?:\\d+/\\d+|\\[[^\\]]*\\])$|:\\s*\\[[^\\]]*\\]$', '') = node AND node <> name
  UNION ALL SELECT job_id, node, 3, 0.95 FROM j JOIN n ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(node), '[^a-z0-9]', '', 'g') AND NOT (provider = 'gitlab' AND regexp_matches(name, '[:\\[\\]/]'))
)
SELECT job_id, min(node) AS node, min(confidence) AS confidence FROM (SELECT *, min(tier) OVER (PARTITION BY job_id) AS first FROM c) WHERE tier = first GROUP BY job_id HAVING count(*) = 1"""


_DOTTED = "SELECT DISTINCT concat(coalesce(lang, 'x'), '.', source, '.', doc_id % 5) AS rule FROM {documents}"
_RUNBOOKS = [("runner", "infra"), ("runner.job", "jobs"), ("test.failed", "tests"), ("en", "English"), ("en.src0", "first"), ("en.src0.3", "third"), ("d", "no prefix of de")]
_DOTTED_CASES = [("runner.job.timeout",), ("runner.x",), ("test.failed",), ("git",), ("english.x",)]


def q_dotted(s, d):
    rows = _with(s, d, _DOTTED, _DOTTED_CASES, "rule string")
    return Q.dotted_lookup(rows, "rule", s.createDataFrame(_RUNBOOKS, "prefix string, runbook string"), "prefix").select("rule", "runbook")


SQL["rule_prefix_lookup"] = f"SELECT rule, arg_max(runbook, length(prefix)) AS runbook FROM {_with_sql(_DOTTED, _DOTTED_CASES, 'rule')} JOIN {G.values_sql(_RUNBOOKS, 'prefix, runbook')} ON rule = prefix OR starts_with(rule, prefix || '.') GROUP BY rule"


def q_top2(s, d):
    return Q.top_n(landed(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.desc("o_orderkey")], 2)


SQL["top2_per_group"] = "SELECT o_custkey, o_orderkey, o_totalprice, rn::INT AS rn FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2"


def q_retention(s, d):
    return Q.top_n(landed(s, d, "events").select("event_id", "event_type", "ts"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


SQL["retention_newest_n"] = "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50"


def q_orphans(s, d):
    l, o = landed(s, d, "lineitem"), landed(s, d, "orders")
    a = l.select(F.col("l_orderkey").alias("key")).join(o.select(F.col("o_orderkey").alias("key")), "key", "left_anti").distinct().withColumn("side", F.lit("lineitem"))
    b = o.select(F.col("o_orderkey").alias("key")).join(l.select(F.col("l_orderkey").alias("key")), "key", "left_anti").withColumn("side", F.lit("orders"))
    return a.unionByName(b)


SQL["orphan_check"] = "SELECT DISTINCT l_orderkey AS key, 'lineitem' AS side FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT o_orderkey, 'orders' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


def q_status_summary(s, d):
    kind = lambda x: F.count_if(F.col("event_type") == x).alias(f"n_{x}")
    return landed(s, d, "events").agg(F.count("*").alias("n"), kind("error"), kind("view"), kind("click"), kind("purchase"), kind("signup"), F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.bool_or(F.col("value") > 0).alias("any_value"))


SQL["status_summary"] = "SELECT count(*) AS n, count_if(event_type = 'error')::BIGINT AS n_error, count_if(event_type = 'view')::BIGINT AS n_view, count_if(event_type = 'click')::BIGINT AS n_click, count_if(event_type = 'purchase')::BIGINT AS n_purchase, count_if(event_type = 'signup')::BIGINT AS n_signup, count(DISTINCT user_id) AS users, min(event_id) AS first, max(event_id) AS last, bool_or(value > 0) AS any_value FROM events"


def q_rule_histogram(s, d):
    return landed(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


SQL["rule_histogram"] = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"


def q_project_summary(s, d):
    e = landed(s, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


SQL["project_summary"] = "SELECT user_id, count(*) AS n, count_if(event_type = 'error')::BIGINT AS errors, min(event_id) AS first, max(event_id) AS last, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1"


def q_having(s, d):
    return landed(s, d, "documents").groupBy(X.row_hash(F.col("text")).alias("row_hash")).agg(F.count("*").alias("n")).where("n > 2")


def q_distinct(s, d):
    return landed(s, d, "lineitem").select("l_orderkey", "l_suppkey").distinct().agg(F.count("*").alias("pairs"))


SQL["having_gt2"] = r"SELECT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS row_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 2"
SQL["distinct_subquery"] = "SELECT count(*) AS pairs FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"


def _keys(s, d):
    e = landed(s, d, "events")
    return e.where("event_type = 'error'").select("user_id"), e.where("event_type = 'purchase'").select("user_id")


SQL |= {f"set_{n}": f"SELECT user_id FROM events WHERE event_type = 'error' {op} SELECT user_id FROM events WHERE event_type = 'purchase'" for n, op in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT"))}


def q_dedup(s, d):
    hashed = landed(s, d, "documents").select("doc_id", X.row_hash(F.col("text")).alias("row_hash"))
    return hashed.groupBy("row_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


SQL["dedup_by_hash"] = r"SELECT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS row_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


def q_incremental(s, d):
    rows = landed(s, d, "documents").select("source", X.row_hash(F.col("text")).alias("row_hash"))
    return Q.insert_new(rows.where("source = 'src0'"), rows, ["row_hash"]).select("row_hash")


SQL["incremental_new_rows"] = r"WITH r AS (SELECT source, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS row_hash FROM documents) SELECT DISTINCT row_hash FROM r WHERE row_hash NOT IN (SELECT row_hash FROM r WHERE source = 'src0')"


def q_head_tail(s, d):
    return landed(s, d, "documents").select("doc_id", F.sha2(X.head_tail(F.col("text"), 500), 256).alias("cut_sha256"), F.sha2(X.byte_prefix(F.col("text"), 300), 256).alias("prefix_sha256"))


def _fitting(side: str, limit: int) -> str:
    """The most characters of one side of a text that fit into so many bytes."""
    return f"{side}(text, list_max(list_filter(range(0, {limit + 1}), lambda i: octet_length(encode({side}(text, i))) <= {limit}))::INT)"


SQL["head_tail_truncate"] = f"""
SELECT doc_id, sha256(CASE WHEN octet_length(encode(text)) <= 500 THEN text ELSE {_fitting('left', 100)} || chr(10) || '[LOG_TRUNCATED]' || chr(10) || {_fitting('right', 400)} END) AS cut_sha256,
  sha256(CASE WHEN octet_length(encode(text)) <= 300 THEN text ELSE {_fitting('left', 288)} || ' [truncated]' END) AS prefix_sha256
FROM documents"""


def q_excerpt(s, d):
    return landed(s, d, "documents").select("doc_id", F.sha2(X.excerpt(F.col("text")), 256).alias("sha256"))


#: Telling words as the excerpt is meant: something went wrong, was refused or took too long.
SQL["excerpt_last6"] = rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS every FROM documents),
t AS (SELECT *, list_filter(every, lambda x: regexp_matches(lower(x), 'error|exception|fail|fatal|denied|timed? ?out|invalid|unable')) AS telling FROM l),
e AS (SELECT doc_id, array_to_string(CASE WHEN len(telling) > 0 THEN telling[greatest(len(telling) - 5, 1):] ELSE every[greatest(len(every) - 5, 1):] END, chr(10)) AS text FROM t)
SELECT doc_id, sha256(CASE WHEN octet_length(encode(text)) <= 800 THEN text ELSE {_fitting('left', 788)} || ' [truncated]' END) AS sha256 FROM e"""


def q_url(s, d):
    return landed(s, d, "pages").select("page_id", X.sanitize_url(F.col("url")).alias("clean"), X.identity("url", F.col("url")).alias("url_key"))


SQL["url_sanitize"] = r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#\s]+') AND NOT regexp_matches(url, '(^|/)\.\.(/|$)') THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#@]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS clean, sha256('url' || chr(0) || url) AS url_key FROM pages"


def q_json(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return landed(s, d, "events").select("event_id", k.alias("k"))


SQL["json_extract"] = "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events"


def q_redact(s, d):
    out = redact.assignments(F.col("text"))
    return landed(s, d, "documents").select("doc_id", F.sha2(out, 256).alias("sha256"), F.regexp_count("text", F.lit(redact.ASSIGNED)).cast("long").alias("n"))


SQL["redact_assignments"] = f"SELECT doc_id, sha256(regexp_replace(text, {_sql(redact.ASSIGNED)}, '\\1\"[REDACTED]\"', 'g')) AS sha256, len(regexp_extract_all(text, {_sql(redact.ASSIGNED)}))::BIGINT AS n FROM documents"


#: Texts with secrets of each kind, beside what documents hold.
SECRETS = [
    '{"password": "hunter2", "user": "bob", "api_key": 1234, "token_count": 5}', "see https://bob:s3cr3t@host.example/x and postgres://u:p@ss@db/x", "curl -H 'Authorization: Bearer abcdefgh12345678' https://h/x?sig=abc&page=2",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----\nafter", "github_pat_11ABCDEFGHIJK and glpat-abcdefghij1 in one line", "a:\n  client_secret: s3cr3t of words # why\n  user: bob", "export DB_PASS='s3cr3t one'; make", None, "",
    "token: ${{ secrets.A }}", 'api_key = "$ENV"',
]


def q_redact_full(s, d):
    cases = s.createDataFrame([(-1 - k, x) for k, x in enumerate(SECRETS)], "doc_id long, text string")
    out = landed(s, d, "documents").select("doc_id", "text").unionByName(cases).select("doc_id", redact.redact_column(F.col("text")).alias("r"))
    return out.select("doc_id", F.sha2("r.content", 256).alias("sha256"), "r.replacements")


#: One pattern a kind of secret, and what stands there then; a quoted value with more right behind it goes on to the next blank.
_KINDS_SQL = [
    (r'(?i)(\btoken = )"[^"\s]*"[^\s;&|<>]+', r"\1[REDACTED]"), (r'(?i)(\btoken = )"[^"\[]*"', r'\1"[REDACTED]"'), (r'("password": )"[^"]*"', r'\1"[REDACTED]"'), (r'("api_key": )[0-9]+', r'\1"[REDACTED]"'), (r"([a-z]+://)[^/\s?#]*@", r"\1"),
    (r"(Authorization: Bearer )[A-Za-z0-9]{8,}", r"\1[REDACTED]"), (r"([?&]sig=)[^&#\s\[%]+", r"\1%5BREDACTED%5D"), (r"\b(?:github_pat_[A-Za-z0-9_]{8,}|glpat-[A-Za-z0-9_-]{6,})", "[REDACTED]"), (r"(client_secret: )[^#\n]*[^#\n\s]", r'\1"[REDACTED]"'), (r"(DB_PASS=)'[^']*'", r"\1'[REDACTED]'"),
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]\n\n\n"),
]
_masked_sql, _count_sql = "text", "0"
for _pattern, _shown in _KINDS_SQL:
    _count_sql += f" + coalesce(len(regexp_extract_all({_masked_sql}, {_sql(_pattern)})), 0)"
    _masked_sql = f"regexp_replace({_masked_sql}, {_sql(_pattern)}, {_sql(_shown)}, 'g')"
SQL["redact_full"] = f"SELECT doc_id, sha256({_masked_sql}) AS sha256, ({_count_sql})::INT AS replacements FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {G.values_sql([(-1 - k, x) for k, x in enumerate(SECRETS)], 'doc_id, text')})"


#: Known secrets, and documents that hold them in one spelling or another, by number.
KNOWN_SECRETS = ["s3cr3t/ pä$$", "ab+cd==ef"]


def q_scrubbed(s, d):
    """Documents as nested rows, with a known secret put into some in several spellings, and none of it left."""
    from tracewell.functions.scrub import scrubbed

    one, two = KNOWN_SECRETS
    spelled = F.array(*map(F.lit, ["", one, "s3cr3t%2F+p%C3%A4%24%24", "czNjcjN0LyBww6QkJA==", "s3cr3t%2f%20p%c3%a4%24%24", two + two, "xab%2Bcd%3D%3Def"]))
    docs = landed(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.element_at(spelled, (F.col("doc_id") % 7 + 1).cast("int")).alias("word"))
    rows = docs.select("doc_id", F.struct(F.array("text", F.concat(F.lit("<"), "word", F.lit(">"))).alias("lines"), F.create_map(F.lit("token key"), F.concat("text", F.lit("|"), "word")).alias("by")).alias("body"))
    out = scrubbed(rows, KNOWN_SECRETS)
    return out.select("doc_id", F.sha2(F.get("body.lines", 0), 256).alias("text_sha256"), F.get("body.lines", 1).alias("word"), F.sha2(F.element_at(F.map_values("body.by"), 1), 256).alias("by_sha256"), F.get(F.map_keys("body.by"), 0).alias("name"))


_TOKEN_SQL = r"""regexp_replace(regexp_replace({t}, '(?i)(\btoken = )"[^"\s]*"[^\s;&|<>]+', '\1[REDACTED]', 'g'), '(?i)(\btoken = )"[^"\[]*"', '\1"[REDACTED]"', 'g')"""
SQL["scrubbed_rows"] = f"""
WITH r AS (SELECT doc_id, {_TOKEN_SQL.format(t="coalesce(text, '')")} AS text, CASE doc_id % 7 WHEN 0 THEN '' WHEN 6 THEN 'x[REDACTED]' ELSE '[REDACTED]' END AS word, CASE WHEN doc_id % 7 = 5 THEN '[REDACTED][REDACTED]' END AS pair FROM documents)
SELECT doc_id, sha256(text) AS text_sha256, '<' || coalesce(pair, word) || '>' AS word, sha256(text || '|' || coalesce(pair, word)) AS by_sha256, 'token key' AS name FROM r"""


def q_token_bag(s, d):
    return Q.token_bags(landed(s, d, "benchmark"), "item_id", "text")


_BAG = "SELECT {k}, token, count(*) AS n FROM (SELECT {k}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_/-]{{2,}}')) AS token FROM {t}) GROUP BY 1, 2"
SQL["token_bag"] = _BAG.format(k="item_id", t="benchmark")


def _similar(s, d):
    return Q.multiset_similarity(Q.token_bags(landed(s, d, "benchmark"), "item_id", "text"), "item_id", Q.token_bags(landed(s, d, "documents"), "doc_id", "text"), "doc_id")


_SIM = f"""
WITH a AS ({_BAG.format(k="item_id", t="benchmark")}), b AS ({_BAG.format(k="doc_id", t="documents")}),
o AS (SELECT item_id, doc_id, sum(least(a.n, b.n))::BIGINT AS overlap FROM a JOIN b USING (token) GROUP BY 1, 2),
sim AS (SELECT item_id, doc_id, overlap, (sa + sb - overlap)::BIGINT AS total FROM o JOIN (SELECT item_id, sum(n) AS sa FROM a GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, sum(n) AS sb FROM b GROUP BY 1) USING (doc_id))
"""
SQL["jaccard_pairs"] = _SIM + "SELECT * FROM sim"


def _bags(s, d):
    return Q.token_bags(landed(s, d, "benchmark"), "item_id", "text"), Q.token_bags(landed(s, d, "documents"), "doc_id", "text")


def q_topk(s, d):
    items, docs = _bags(s, d)
    return M.top_k(items, "item_id", docs, "doc_id", 5).select("item_id", "doc_id", "overlap", "total", "rn")


def q_alike(s, d):
    """All pairs of an item and a document of likeness 0.15 or more."""
    items, docs = _bags(s, d)
    return M.at_least(items, "item_id", docs, "doc_id", 3, 20)


SQL["jaccard_at_least"] = _SIM + "SELECT * FROM sim WHERE 20 * overlap >= 3 * total"
SQL["retrieve_topk"] = _SIM + "SELECT item_id, doc_id, overlap, total, row_number() OVER (PARTITION BY item_id ORDER BY overlap / total DESC, doc_id)::INT AS rn FROM sim QUALIFY rn <= 5"


def q_history(s, d):
    docs = landed(s, d, "documents").select("doc_id", "source", "lang")
    scored = _similar(s, d).join(docs, "doc_id")
    score = Q.history_score(F.col("overlap") / F.col("total"), F.col("source") == "src1", F.col("source") == "src2", F.col("lang") == "en", F.lit(0.0))
    ranked = scored.withColumn("score", score).where("score >= 0.12")
    return Q.top_n(ranked, ["item_id"], [F.desc("score"), "doc_id"], 6).select("item_id", "doc_id", "rn")


SQL["history_search"] = _SIM + """, scored AS (
  SELECT item_id, doc_id, CASE WHEN source = 'src1' THEN 2.0 ELSE least(1, overlap / total + CASE WHEN source = 'src2' THEN 0.25 WHEN lang = 'en' THEN 0.1 ELSE 0 END) END AS raw FROM sim JOIN documents USING (doc_id)
), ranked AS (SELECT item_id, doc_id, CASE WHEN raw = 2 THEN raw ELSE round_even(raw, 3) END AS score FROM scored)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rn FROM ranked WHERE score >= 0.12 QUALIFY rn <= 6"""


def _links(s, d):
    """(page_id, k, src, dst) of links that follow each other on a page, of all pages."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    pairs = F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x, k: F.struct((k + 1).alias("k"), F.get("l", k).alias("src"), x.alias("dst")))
    return landed(s, d, "pages").select("page_id", found.alias("l")).where("size(l) > 1").select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.*")


_LINKS_SQL = """links AS (
  SELECT page_id, unnest(range(1, len(l)))::INT AS k, unnest(l[1:-2]) AS src, unnest(l[2:]) AS dst FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 1
)"""


def q_closure(s, d):
    """What each link reaches over links that follow it on a page, within three steps."""
    return Q.closure(_links(s, d).select("src", "dst").distinct(), "src", "dst", 3)


SQL["transitive_closure"] = f"WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT DISTINCT src, dst FROM links), r AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src WHERE r.depth < 3) SELECT src, dst, min(depth)::INT AS depth FROM r GROUP BY 1, 2"


def q_include_order(s, d):
    """Links as files that include each other, from a layer by length to any later one: the order in which each root merges what it reaches."""
    layer = lambda c: F.length(c) % 6
    edges = _links(s, d).where(layer(F.col("dst")) > layer(F.col("src"))).groupBy("src", "dst").agg(F.max(F.col("page_id") * 100 + F.col("k")).cast("int").alias("ordinal"))
    roots = edges.where(layer(F.col("src")) == 0).select(F.lit("pages").alias("config"), F.col("src").alias("root")).distinct()
    found, _, _ = G_.ordered(roots, edges.withColumn("config", F.lit("pages")), 20)
    return found.select("root", "node", "place")


SQL["include_order"] = f"""
WITH RECURSIVE {_LINKS_SQL}, e AS (SELECT src, dst, max(page_id * 100 + k)::INT AS ordinal FROM links WHERE length(dst) % 6 > length(src) % 6 GROUP BY 1, 2),
w AS (SELECT DISTINCT src AS root, src AS node, []::INT[] AS path FROM e WHERE length(src) % 6 = 0 UNION ALL SELECT root, dst, list_append(path, -ordinal) FROM w JOIN e ON node = src),
b AS (SELECT root, node, min(path) AS path FROM w GROUP BY 1, 2)
SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY path DESC)::INT AS place FROM b"""


def q_upsert(s, d):
    c = landed(s, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey <= 50").select("c_custkey", F.upper("c_name").alias("c_name")).unionByName(s.createDataFrame([(-1, "NEW")], "c_custkey long, c_name string"))
    return Q.upsert(c, new, ["c_custkey"])


SQL["upsert_merge"] = "SELECT c_custkey, CASE WHEN c_custkey <= 50 THEN upper(c_name) ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'NEW'"


def q_violations(s, d):
    return Q.violations(landed(s, d, "lineitem"), {"quantity_positive": F.col("l_quantity") > 0, "discount_small": F.col("l_discount") < 0.05, "has_supplier": F.col("l_suppkey").isNotNull()})


SQL["store_violations"] = "SELECT * FROM (SELECT 'quantity_positive' AS \"check\", count_if(NOT coalesce(l_quantity > 0, false))::BIGINT AS n FROM lineitem UNION ALL SELECT 'discount_small', count_if(NOT coalesce(l_discount < 0.05, false))::BIGINT FROM lineitem UNION ALL SELECT 'has_supplier', count_if(l_suppkey IS NULL)::BIGINT FROM lineitem) WHERE n > 0"


def q_sample_jobs(s, d):
    e = landed(s, d, "events")
    stages = F.array(*map(F.lit, STAGES))
    jobs = e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("name"), F.get(stages, (F.col("event_id") % len(STAGES)).cast("int")).alias("stage"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "manual").otherwise("success").alias("status"), F.lit(None).cast("string").alias("conclusion"), (F.col("event_id") % 97 == 0).alias("selected"),
    )
    return D.sample_jobs(jobs)


STAGES = ["lint", "Sonar", "docs", "pre-build", "Validation", "repackage", "redeploy", "test", "misc"]
SQL["job_sampling"] = f"""
WITH j AS (
  SELECT user_id AS run_id, event_id AS job_id, event_type AS name, (event_id % {len(STAGES)})::INT AS s,
    CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type <> 'signup' THEN 2 END AS grp FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, grp ORDER BY CASE WHEN grp = 2 THEN CASE s WHEN 6 THEN 0 WHEN 5 THEN 1 WHEN 4 THEN 2 WHEN 3 THEN 3 WHEN 1 THEN 4 ELSE 5 END END, CASE WHEN grp = 2 THEN name END, job_id) AS i FROM j WHERE grp IS NOT NULL)
SELECT run_id, job_id, row_number() OVER (PARTITION BY run_id ORDER BY grp, i)::INT AS place FROM k WHERE grp < 2 OR i <= 3 QUALIFY place <= 8"""


def q_stable_ids(s, d):
    return landed(s, d, "events").select("event_id", X.incident_id(F.lit("p"), F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("incident_id"), X.job_name(F.col("event_type")).alias("job"), X.outcome(F.lit("completed"), F.col("event_type")).alias("outcome"))


SQL["stable_ids"] = "SELECT event_id, substr(sha256('p:' || user_id || ':' || event_type || ':' || event_id), 1, 24) AS incident_id, regexp_replace(lower(event_type), '[^a-z0-9]', '', 'g') AS job, lower(event_type) AS outcome FROM events"


ARTIFACTS = [
    ("z1", '{"fieldMappings": {"failed": 2, "failures": [{"status": "failed", "error": "connection reset by peer"}, {"error": "bad"}]}}'), ("z2", '{"fieldMappings": {"failed": 0, "failures": []}}'),
    ("z3", '{"fieldMappings": {"failed": 1, "failures": [{"status": "Skipped", "error": "ConnectionResetError"}]}}'), ("z4", '{"fieldMappings": {"failure": 3}}'), ("z5", '{"fieldMappings": [{"status": "error"}, {"status": "ok"}, {"error": "no status"}]}'),
    ("z6", '{"fieldMappings": [{"error": "no status"}]}'), ("z7", '{"fieldMappings": {"failures": [' + ", ".join('{"message": "late"}' for _ in range(20)) + ', {"message": "connection reset"}]}}'), ("z8", '{}'), ("z9", '{"fieldMappings": {"failed": true, "failures": "none"}}'),
]


_ARTIFACTS = """SELECT concat('e', event_id) AS path, concat(chr(123), '"fieldMappings": ', chr(123), '"failed": ', event_id % 3, ', "failures": [', chr(123), '"status": "', CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'Skipped' ELSE 'error' END,
  '", "error": "', CASE user_id % 5 WHEN 0 THEN 'connection reset' ELSE event_type END, '"', chr(125), ']', chr(125), chr(125)) AS json FROM {events}"""


def q_artifact(s, d):
    return I.artifact_failures(_with(s, d, _ARTIFACTS, ARTIFACTS, "path string, json string"))


SQL["artifact_rollup"] = f"""
WITH a AS (SELECT path, json->'$.fieldMappings' AS f FROM {_with_sql(_ARTIFACTS, ARTIFACTS, 'path, json')}),
b AS (SELECT path, json_type(f) = 'OBJECT' AS obj, CASE json_type(f) WHEN 'ARRAY' THEN f WHEN 'OBJECT' THEN CASE WHEN json_type(f->'$.failures') = 'ARRAY' THEN f->'$.failures' END END AS rows, CASE WHEN json_type(f) = 'OBJECT' THEN coalesce(try_cast(f->>'$.failed' AS BIGINT), try_cast(f->>'$.failure' AS BIGINT)) END AS n FROM a),
r AS (SELECT path, obj, i, lower(trim(x->>'$.status')) AS status, coalesce(x->>'$.error', '') || ' ' || coalesce(x->>'$.message', '') AS said FROM (SELECT path, obj, unnest(rows::JSON[]) AS x, unnest(range(1, (json_array_length(rows) + 1)::BIGINT)) AS i FROM b WHERE rows IS NOT NULL)),
k AS (SELECT *, coalesce(status IN ('ok', 'success', 'skipped', 'updated', 'deployed'), false) AS good FROM r),
w AS (SELECT *, NOT good AND (status IS NOT NULL OR obj AND trim(said) <> '') AS bad FROM k),
c AS (SELECT *, count_if(bad) OVER (PARTITION BY path ORDER BY i) AS nth FROM w),
g AS (SELECT path, count_if(bad) AS bads, bool_and(good) AS benign, coalesce(bool_or(bad AND nth <= 20 AND regexp_matches(lower(said), 'connection ?reset')), false) AS reset FROM c GROUP BY 1),
e AS (SELECT path, coalesce(bads > 0, false) OR coalesce(n > 0, false) AND NOT coalesce(benign, false) AS failed, coalesce(reset, false) AS reset, coalesce(bads > 20, false) AS bounded FROM b LEFT JOIN g USING (path))
SELECT *, CASE WHEN failed THEN CASE WHEN reset THEN 'rlp.datasync_field_mapping_connection_reset' ELSE 'rlp.datasync_field_mapping_artifact_failure' END END AS rule_id FROM e"""


def q_stream(s, d):
    """The documents of two sources collected by a stream that stops when nothing is left."""
    import uuid

    from tracewell.streaming.incremental import collect_available

    work = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    hashed = lambda df: df.select(X.row_hash(F.col("text")).alias("row_hash"), "doc_id")
    out = collect_available(s, f"{d}/document[s].parquet", f"{work}/rows", f"{work}/checkpoint", ["row_hash"], hashed)
    return out.select("row_hash")


SQL["stream_incremental"] = r"SELECT DISTINCT sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS row_hash FROM documents"

def q_job_ends(s, d):
    """Events as what jobs say, twenty jobs in each stretch of 400 events, followed by a stream to their ends."""
    import uuid

    from tracewell.streaming.jobs import collect_job_ends

    work = f"{shared_folder(s)}/jobs-{uuid.uuid4().hex}"
    source = f"{d}/event[s].parquet"
    said = F.when(F.col("event_id") % 3 > 0, "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("running")
    rows = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    job = F.concat((F.col("user_id") % 20).cast("string"), F.lit(":"), F.floor(F.col("event_id") / 400).cast("string"))
    return collect_job_ends(s, rows.select(job.alias("job_id"), said.alias("state"), F.col("ts").cast("timestamp").alias("at")), f"{work}/ends", f"{work}/checkpoint", silence="3 hours")


SQL["job_ends"] = """
WITH e AS (SELECT (user_id % 20) || ':' || (event_id // 400) AS job_id, ts AS moment, CASE WHEN event_id % 3 > 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'succeeded' ELSE 'running' END AS state FROM events),
o AS (SELECT *, row_number() OVER w AS k, lag(moment) OVER w AS earlier, lead(moment) OVER w AS later FROM e WINDOW w AS (PARTITION BY job_id ORDER BY moment, state <> 'running', state)),
x AS (
  SELECT job_id, k::DOUBLE AS k, state, moment, k AS events FROM o WHERE state <> 'running'
  UNION ALL SELECT job_id, k - 0.5, 'timed_out', earlier + INTERVAL 3 HOUR, k - 1 FROM o WHERE moment - earlier > INTERVAL 3 HOUR
  UNION ALL SELECT job_id, k + 0.5, 'timed_out', moment + INTERVAL 3 HOUR, k FROM o WHERE later IS NULL AND moment + INTERVAL 3 HOUR < (SELECT max(moment) FROM e) - INTERVAL 1 HOUR)
SELECT job_id, state, moment AS at, events::BIGINT AS events FROM x QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k) = 1"""


def q_interval_join(s, d):
    """Of each purchase, as an interval of as many minutes as it is worth times ten, the events of other users in it."""
    e = landed(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    spans = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("buyer"), F.col("us").alias("lo"), (F.col("us") + F.floor(F.col("value") * 600) * 1_000_000).alias("hi"))
    return I_.others_in(e, "us", "user_id", "event_id", spans, "purchase", "lo", "hi", "buyer")


SQL["interval_join"] = "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), p AS (SELECT event_id AS purchase, user_id AS buyer, us AS lo, us + floor(value * 600)::BIGINT * 1000000 AS hi FROM e WHERE event_type = 'purchase') SELECT purchase, count(*) AS n, max(event_id) AS last FROM p JOIN e ON us BETWEEN lo AND hi AND user_id <> buyer GROUP BY 1"
#: Objects that are none, or not as they should be, and why.
ODD_JSON = [
    (-1, '{"k": 1, "k": 2}', "repeated key"), (-2, '{"k": NaN}', "invalid"), (-3, "[1]", "no object"), (-4, '{"k": "x"}', "wrong type"), (-5, '{"j": 1}', "extra key"), (-6, '{"k": 1, "z": {"a": 1, "a": 2}}', "repeated key"), (-7, None, "missing"),
    (-8, '{"k"', "invalid"), (-9, "", "invalid"), (-10, '{"k": 1.5}', "wrong type"), (-11, "{}", "missing key"), (-12, '{"k": 1, "x": "' + "y" * 200 + '"}', "too large"),
]


def q_strict_json(s, d):
    """The properties of all events parsed strictly, odd ones appended."""
    rows = landed(s, d, "events").select("event_id", "props").unionByName(s.createDataFrame([x[:2] for x in ODD_JSON], "event_id long, props string"))
    found = strict_objects(rows, "props", {"k": "BIGINT"}, largest=200)
    return found.select("event_id", F.try_variant_get("value", "$.k", "long").alias("k"), "problem")


SQL["strict_json"] = rf"""
WITH r AS (SELECT event_id, props, NULL AS why FROM events UNION ALL SELECT * FROM {G.values_sql(ODD_JSON, 'event_id, props, why')})
SELECT event_id, CASE WHEN why IS NULL THEN regexp_extract(props, '^\{{{{"k": ([0-9]+)\}}}}$', 1)::BIGINT END AS k, CASE WHEN why IS NULL AND NOT regexp_matches(props, '^\{{{{"k": [0-9]+\}}}}$') THEN 'unlike the others' ELSE why END AS problem FROM r""".replace("{{", "{").replace("}}", "}")


DIFFS = [
    ("d1", "--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@\n a\n+b\n-c\n d\n+e\n@@ -20 +21,2 @@ f\n+g\n h\n\\ No newline at end of file"),
    ("d2", "+early\n@@ -0,0 +7 @@\n+seven\r\n+eight"),
    ("d3", " only context"),
]
CHANGES = [
    ("src/app/main.py", "src/App/main.py", False, False, "a"), ("docs/Guide.md", "docs/guide.md", False, True, "b"), ("lib/util.py", "lib/util.py", True, False, "c"),
    ("ci/build.yml", "ci/build.yml", False, False, "d"), (None, "./new/tool.py", False, False, "e"),
]
REFERENCES = [("ci/build.yml", "SRC/app/util.py"), ("ci/build.yml", "lib/util.py"), ("ci/build.yml", "new/tool.py"), ("ci/build.yml", "tests"), ("ci/build.yml", "$DIR/x"), ("other.yml", "gone.py")]
COMMANDS = [("make test || true",), ("echo 'x || true'",), ("$ run; exit 0",), ("+ run '; exit 0'",), ("step ||: ",), ("ls # || true",), ("make || truefalse",), ("# a || true",), ("printf x || true",), ("",)]
FINDINGS = [
    ("r1", "test.failed", "test_failure", "error", "observed", "j1"), ("r1", "pipeline.failed", "pipeline_status", "error", "observed", None), ("r1", "job.no_failure_observed", "no_failure_observed", "info", "observed", "j2"),
    ("r1", "auth.expired", "authentication", "warning", "likely", "j3"), ("r1", "ci.visibility_limited", "configuration", "warning", "unknown", None), ("r2", "deployment.failed", "deployment", "error", "observed", "j4"),
    ("r2", "git.conflict", "git", "error", "observed", None), ("r2", "job.insufficient_evidence", "unknown", "warning", "unknown", "j5"), ("r2", "job.status", "job_status", "error", "likely", "j6"),
]


def q_added_lines(s, d):
    """Documents as diffs, whose lines are kept, added and taken away in turn, and odd diffs."""
    sign = lambda x, i: F.concat(F.element_at(F.array(F.lit(" "), F.lit("+"), F.lit("-")), (i % 3 + 1).cast("int")), x)
    docs = landed(s, d, "documents").where("text is not null")
    body = F.array_join(F.transform(F.split("text", "\n"), sign), "\n")
    made = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("change"), F.concat(F.lit("@@ -1,3 +"), (F.col("doc_id") % 100 + 1).cast("string"), F.lit(",9 @@ f\n"), body).alias("diff"))
    found = C.added_lines(made.unionByName(s.createDataFrame(DIFFS, "change string, diff string")), "change", "diff")
    return found.select("change", "idx", "line", F.sha2("text", 256).alias("text_sha256"))


_DIFFS_SQL = f"""(SELECT 'doc' || doc_id AS change, '@@ -1,3 +' || (doc_id % 100 + 1) || ',9 @@ f' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: [' ', '+', '-'][(i - 1) % 3 + 1] || x), chr(10)) AS diff
  FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM {G.values_sql(DIFFS, 'change, diff')})"""
SQL["diff_added_lines"] = rf"""
WITH r AS (SELECT change, unnest(range(0, len(l)))::INT AS idx, unnest(l) AS raw FROM (SELECT change, regexp_split_to_array(diff, '\r?\n') AS l FROM {_DIFFS_SQL})),
m AS (SELECT *, try_cast(nullif(regexp_extract(raw, '^@@ -\S+ \+(\d+)\S* @@', 1), '') AS INT) AS start, NOT (starts_with(raw, '+++') OR starts_with(raw, '---') OR starts_with(raw, 'diff ') OR starts_with(raw, 'index ') OR starts_with(raw, '\')) AS content FROM r),
h AS (SELECT *, count(start) OVER w AS hunk, last_value(start IGNORE NULLS) OVER w AS first FROM m WINDOW w AS (PARTITION BY change ORDER BY idx ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, first + coalesce(sum(CASE WHEN content AND raw[1] IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY change, hunk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM h)
SELECT change, idx, line::INT AS line, sha256(raw[2:]) AS text_sha256 FROM c WHERE content AND raw[1] = '+'"""


def _changes(s, d):
    return _with(s, d, CHANGED, CHANGES, "old_path string, new_path string, deleted_file boolean, renamed_file boolean, note string"), _with(s, d, KNOWN, [(p,) for p in PATHS], "path string")


def q_current_paths(s, d):
    changes, known = _changes(s, d)
    return C.current_paths(known, changes)


_KNOWN_SQL, _CHANGES_SQL = _with_sql(KNOWN, [(p,) for p in PATHS], "path"), _with_sql(CHANGED, CHANGES, "old_path, new_path, deleted_file, renamed_file, note")
SQL["current_paths"] = f"SELECT path FROM {_KNOWN_SQL} EXCEPT SELECT old_path FROM {_CHANGES_SQL} WHERE deleted_file OR renamed_file UNION SELECT regexp_replace(new_path, '^\\./', '') FROM {_CHANGES_SQL} WHERE NOT deleted_file"


def _configs(s, d):
    """(path, content) of CI files that need what REFERRED says: by include, by variable, by a command's folder, by an option."""
    rows = _with(s, d, REFERRED, REFERENCES, "path string, referenced string").where("path is not null").distinct()
    way = F.pmod(F.crc32("referenced"), F.lit(4))
    told = F.when(way == 0, F.concat(F.lit("  - local: "), "referenced")).when(way == 1, F.concat(F.lit("  PACKAGE_"), F.crc32("referenced").cast("string"), F.lit("_PATH: '"), "referenced", F.lit("'")))
    told = told.when(way == 2, F.concat(F.lit("    - cd '"), "referenced", F.lit("'"))).otherwise(F.concat(F.lit('    - run x --package-folder="'), "referenced", F.lit('"')))
    parts = rows.select("path", way.alias("way"), told.alias("t")).groupBy("path").pivot("way", [0, 1, 2, 3]).agg(F.array_join(F.sort_array(F.collect_list("t")), "\n"))
    block = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c, F.lit("\n"))).otherwise("")
    jobs = F.concat_ws("\n", F.nullif(F.col("2"), F.lit("")), F.nullif(F.col("3"), F.lit("")))
    return parts.select("path", F.concat(block("include:\n", F.col("0")), block("variables:\n", F.col("1")), block("build:\n  script:\n    - make && cd nowhere\n", jobs)).alias("content"))


def q_ci_references(s, d):
    return C.ci_references(_configs(s, d)).select("path", "referenced")


def q_change_risks(s, d):
    changes, known = _changes(s, d)
    return C.change_risks(changes, known, C.ci_references(_configs(s, d)).select("path", "referenced"))


SQL["ci_references"] = f"SELECT DISTINCT path, referenced FROM {_with_sql(REFERRED, REFERENCES, 'path, referenced')} WHERE path IS NOT NULL AND NOT contains(referenced, '$')"
_PREFIXES = "(SELECT {key}, unnest(range(1, len(string_split({key}, '/')) + 1)) AS k FROM {t})"
SQL["change_risks"] = f"""
WITH clean AS (SELECT regexp_replace(old_path, '^\\./', '') AS o, regexp_replace(new_path, '^\\./', '') AS n, deleted_file AS gone, renamed_file AS moved FROM {_CHANGES_SQL}),
touched AS (SELECT n AS path, moved AND lower(o) = lower(n) AS meant FROM clean WHERE NOT gone),
known AS (SELECT path FROM {_KNOWN_SQL}),
now AS (SELECT path FROM known WHERE path NOT IN (SELECT coalesce(o, n) FROM clean WHERE gone OR moved) UNION SELECT n FROM clean WHERE NOT gone),
kp AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS p FROM {_PREFIXES.format(key='path', t='known')}),
np AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS p FROM {_PREFIXES.format(key='path', t='now')}),
k1 AS (SELECT lower(p) AS f, min(p) AS p FROM kp GROUP BY 1 HAVING count(*) = 1), n1 AS (SELECT lower(p) AS f, min(p) AS p FROM np GROUP BY 1 HAVING count(*) = 1),
refs AS (SELECT DISTINCT path, referenced FROM {_with_sql(REFERRED, REFERENCES, 'path, referenced')} WHERE NOT contains(referenced, '$') AND path IN (SELECT path FROM touched)),
tp AS (SELECT path, k, array_to_string(string_split(path, '/')[1:k], '/') AS p FROM {_PREFIXES.format(key='path', t='touched')} WHERE path IN (SELECT path FROM touched WHERE NOT meant)),
rp AS (SELECT referenced, k, array_to_string(string_split(referenced, '/')[1:k], '/') AS p FROM {_PREFIXES.format(key='referenced', t='refs')}),
moved AS (SELECT path, arg_min(k1.p, k) AS expected FROM tp JOIN k1 ON lower(tp.p) = f AND k1.p <> tp.p GROUP BY 1),
spelled AS (SELECT referenced, arg_min(n1.p, k) AS expected FROM rp JOIN n1 ON lower(rp.p) = f AND n1.p <> rp.p GROUP BY 1)
SELECT 'change.path_case_mismatch' AS rule_id, path, path AS referenced, expected FROM moved
UNION ALL SELECT 'change.ci_path_case_mismatch', path, referenced, expected FROM refs JOIN spelled USING (referenced)
UNION ALL SELECT 'change.ci_path_unverified', path, referenced, NULL FROM refs WHERE referenced NOT IN (SELECT referenced FROM spelled) AND referenced NOT IN (SELECT p FROM np)"""


_COMMANDS = """SELECT DISTINCT concat(CASE user_id % 5 WHEN 0 THEN '$ ' WHEN 1 THEN '+ ' WHEN 2 THEN 'echo ' WHEN 3 THEN '# ' ELSE '' END, 'make t', event_id % 9,
  CASE event_id % 8 WHEN 0 THEN ' || true' WHEN 1 THEN '; exit 0' WHEN 2 THEN ' # || true' WHEN 3 THEN ' "|| true"' WHEN 4 THEN ' || :' WHEN 5 THEN ' || truely' WHEN 6 THEN ' ;exit 01' ELSE '' END) AS command FROM {events}"""


def q_hidden_exit(s, d):
    return _with(s, d, _COMMANDS, COMMANDS, "command string").select("command", C.hides_exit_code(F.col("command")).alias("hidden"))


#: What is printed or commented hides nothing; quotes and what follows a number sign are no code.
SQL["exit_suppressed"] = rf"""
WITH c AS (SELECT command, trim(CASE WHEN starts_with(command, '$ ') OR starts_with(command, '+ ') THEN command[3:] ELSE command END) AS plain FROM {_with_sql(_COMMANDS, COMMANDS, 'command')}),
b AS (SELECT *, split_part(regexp_replace(regexp_replace(plain, '"[^"]*"', '', 'g'), concat(chr(39), '[^', chr(39), ']*', chr(39)), '', 'g'), '#', 1) AS bare FROM c)
SELECT command, NOT regexp_matches(lower(plain), '^(#|(echo|printf|write-host|write-output)\b)') AND (regexp_matches(bare, '[|][|] *true\b') OR regexp_matches(bare, '[|][|] *:( |$)') OR regexp_matches(bare, '; *exit +0\b')) AS hidden FROM b"""


def _similar_incidents(s, d):
    """Benchmark items as queries, all documents as incidents of one project; labelled quality stands for a resolution."""
    good = landed(s, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    docs = landed(s, d, "documents").select("doc_id", "lang", "text", X.row_hash(F.col("text")).alias("fingerprint")).join(good, "doc_id", "left")
    incidents = docs.select(F.col("doc_id").alias("incident_id"), F.lit("p").alias("project"), "fingerprint", F.col("lang").alias("category"), "text", F.coalesce("good", F.lit(False)).alias("resolved"))
    items = landed(s, d, "benchmark")
    queries = items.select((-1 - F.col("item_id")).alias("query_id"), F.lit("p").alias("project"), X.row_hash(F.col("text")).alias("fingerprint"), F.lit("en").alias("category"), "text")
    return V.similar_incidents(queries, incidents)


def q_similar_incidents(s, d):
    return _similar_incidents(s, d).select("query_id", "incident_id", "resolved", F.bround("similarity", 6).alias("similarity"), "rn")


_INCIDENTS_SQL = _SIM + r""", h AS (SELECT -1 - item_id AS query_id, item_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS fingerprint FROM benchmark),
p AS (
  SELECT query_id, doc_id AS incident_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS resolved, CASE
    WHEN coalesce(h.fingerprint = sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')), false) THEN 1
    WHEN coalesce(lang = 'en', false) THEN greatest(coalesce(overlap / total, 0), 0.35) ELSE coalesce(overlap / total, 0) END AS similarity
  FROM h CROSS JOIN documents LEFT JOIN sim USING (item_id, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY resolved DESC, similarity DESC, incident_id)::INT AS rn FROM p WHERE similarity >= 0.13 QUALIFY rn <= 5)
"""
SQL["similar_incidents"] = _INCIDENTS_SQL + "SELECT query_id, incident_id, resolved, round(similarity, 6) AS similarity, rn FROM best"


def q_bundle(s, d):
    """What is known of each item within 4,000 characters: its text as a log, a configuration, incidents like it, guidance, own documents."""
    items = landed(s, d, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), "item_id", "text", F.lit(1).alias("rn"))
    docs = landed(s, d, "documents").select("doc_id", "text", "lang", "source")
    chunks = items.select("query_id", "rn", F.concat(F.lit("log-"), F.col("item_id").cast("string")).alias("chunk_id"), F.lit("stack_trace").alias("chunk_type"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.col("text").alias("content"))
    configured = items.where("item_id % 2 = 0").select("query_id", "rn", F.concat(F.lit("ci/a"), (F.col("item_id") % 3).cast("string"), F.lit(".yml")).alias("path"), F.lit("build").alias("job_key"), F.col("item_id").alias("line_start"), (F.col("item_id") + 5).alias("line_end"))
    past = _similar_incidents(s, d).join(docs.select(F.col("doc_id").alias("incident_id"), F.col("text").alias("summary"), F.col("lang").alias("category")), "incident_id").withColumn("resolution", F.when(F.col("resolved"), "fixed"))
    packs = items.where("item_id % 3 = 0").select("query_id", "rn", F.lit("s1").alias("skill_id"), F.lit(2).alias("version"), F.lit("Look").alias("title"), F.lit("twice").alias("runbook"))
    own = V.knowledge(items.select("query_id", "text"), docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), (F.col("source") == "src1").alias("private_scope")), private=True)
    told = own.join(docs.select(F.col("doc_id").alias("document_id"), "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")), "document_id")
    every = V.sections("query_id", chunks=chunks, configured=configured, incidents=past, packs=packs, documents=told)
    found = V.bundle(every, "query_id", 4000).select("query_id", F.sha2("context", 256).alias("context_sha256"), F.array_join("evidence", ",").alias("evidence"))
    sure = every.groupBy("query_id").agg(F.count_if("verified").alias("verified"), F.max(F.when(F.col("place") < 1000, F.col("label"))).alias("label"))
    return found.join(sure, "query_id")


SQL["retrieval_bundle"] = _INCIDENTS_SQL + """, kd AS (
  SELECT -1 - item_id AS query_id, doc_id, source, text, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(overlap / total, 0) DESC, doc_id) AS rn
  FROM benchmark CROSS JOIN (SELECT doc_id, source, text AS t FROM documents WHERE source = 'src1') LEFT JOIN sim USING (item_id, doc_id) JOIN (SELECT doc_id AS i, text AS own FROM documents) ON i = doc_id QUALIFY rn <= 2),
s AS (
  SELECT -1 - item_id AS query_id, 1 AS place, 'log-' || item_id AS id, 'job log' AS kind, text, true AS sure FROM benchmark
  UNION ALL SELECT -1 - item_id, 1001, 'yaml:ci/a' || item_id % 3 || '.yml:' || item_id || '-' || (item_id + 5), 'CI configuration', 'Job build in ci/a' || item_id % 3 || '.yml, lines ' || item_id || '-' || (item_id + 5), true FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT query_id, 2000 + rn, 'incident:' || incident_id, 'past incident', coalesce(text, '') || chr(10) || 'Resolution: ' || CASE WHEN resolved THEN 'fixed' ELSE 'Nobody has confirmed a resolution.' END, resolved FROM best JOIN documents ON doc_id = incident_id WHERE rn <= 2
  UNION ALL SELECT -1 - item_id, 3001, 'skill:s1:2', 'guidance', 'Look' || chr(10) || 'twice', true FROM benchmark WHERE item_id % 3 = 0
  UNION ALL SELECT query_id, 4000 + rn, 'knowledge:' || k.doc_id, 'own document', k.source || '/d' || k.doc_id || chr(10) || coalesce(d.text, ''), false FROM kd k JOIN documents d ON d.doc_id = k.doc_id),
r AS (SELECT query_id, place, id, sure, '[' || id || '] ' || kind || chr(10) || trim(coalesce(text, ''), ' ') || chr(10) AS t FROM s),
u AS (SELECT *, substr(t, 1, greatest(4000 - coalesce(sum(length(t)) OVER (PARTITION BY query_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT) AS used FROM r)
SELECT query_id, sha256(string_agg(used, chr(10) ORDER BY place) FILTER (used <> '')) AS context_sha256, string_agg(id, ',' ORDER BY place) AS evidence, count_if(sure)::BIGINT AS verified, 'Redacted stack trace, lines 1-9' AS label FROM u GROUP BY 1"""


def q_newest(s, d):
    return Q.top_n(landed(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("event_id", "rn")


SQL["newest3_confirmations"] = "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)::INT AS rn FROM events QUALIFY rn <= 3"


def q_retained(s, d):
    return V.retained(landed(s, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id")


SQL["retention_projects_entries"] = "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY min(ts) DESC, user_id DESC LIMIT 50) ORDER BY ts DESC, event_id DESC LIMIT 200"

_FINDING_COLUMNS = "run_id string, rule_id string, category string, severity string, confidence string, job_id string"
_FOUND = """SELECT concat('u', user_id) AS run_id, CASE event_id % 5 WHEN 0 THEN 'deployment.failed' WHEN 1 THEN 'pipeline.failed' WHEN 2 THEN 'ci.visibility_limited' ELSE concat('rule.', event_type) END AS rule_id,
  CASE event_id % 6 WHEN 0 THEN 'pipeline_status' WHEN 1 THEN 'unknown' WHEN 2 THEN 'no_failure_observed' WHEN 3 THEN 'job_status' ELSE event_type END AS category, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'error' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'likely' ELSE 'unknown' END AS confidence, CASE WHEN event_id % 7 > 0 THEN concat('j', event_id) END AS job_id FROM {events}"""
_FINDING_SQL = _with_sql(_FOUND, FINDINGS, "run_id, rule_id, category, severity, confidence, job_id")


def q_ordered(s, d):
    return V.ordered_findings(_with(s, d, _FOUND, FINDINGS, _FINDING_COLUMNS), "run_id").select("run_id", "rule_id", "severity", "confidence", "rn")


SQL["finding_order"] = f"SELECT run_id, rule_id, severity, confidence, row_number() OVER (PARTITION BY run_id ORDER BY list_position(['error', 'warning', 'info'], severity), list_position(['observed', 'likely', 'unknown'], confidence), rule_id IN ('deployment.failed', 'pipeline.failed'), rule_id, coalesce(job_id, ''))::INT AS rn FROM {_FINDING_SQL} QUALIFY rn <= 80"


def q_display_rank(s, d):
    return _with(s, d, _FOUND, FINDINGS, _FINDING_COLUMNS).select("run_id", "rule_id", "job_id", V.display_rank(F.col("rule_id"), F.col("category"), F.col("severity"), F.col("job_id")).alias("rank"))


#: Errors of jobs, then errors of the run's status, then what can be acted on, then warnings about status, then nothing, then the rest.
SQL["display_rank"] = f"""
WITH f AS (
  SELECT *, category IN ('pipeline_status', 'downstream_pipeline', 'job_status') AS of_status, severity IN ('error', 'warning') AS loud,
    severity IN ('error', 'warning') AND category NOT IN ('pipeline_status', 'downstream_pipeline', 'job_status', 'no_failure_observed', 'unknown') AND NOT starts_with(rule_id, 'pipeline.') AND NOT starts_with(rule_id, 'ci.visibility') AS act
  FROM {_FINDING_SQL})
SELECT run_id, rule_id, job_id, (CASE WHEN severity = 'error' AND job_id IS NOT NULL THEN CASE WHEN act THEN 0 ELSE 1 END WHEN severity = 'error' AND of_status THEN 2 WHEN act AND job_id IS NOT NULL THEN 3 WHEN act THEN 4
  WHEN loud AND (of_status OR category = 'unknown') THEN 5 WHEN category = 'no_failure_observed' THEN 6 ELSE 7 END)::INT AS rank FROM f"""


def q_import_report(s, d):
    rows = landed(s, d, "documents").select("source", "text", X.row_hash(F.col("text")).alias("row_hash"))
    return V.import_report(rows, rows.where("source = 'src0'"), "row_hash", "text")


SQL["import_report"] = r"""
WITH r AS (SELECT source, text, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS row_hash, coalesce(trim(text, ' ') = '', true) AS blank FROM documents),
c AS (SELECT count(*) AS read, count_if(blank)::BIGINT AS blank, (SELECT count(DISTINCT row_hash) FROM r WHERE NOT blank AND row_hash NOT IN (SELECT row_hash FROM r WHERE source = 'src0' AND row_hash IS NOT NULL)) AS stored FROM r)
SELECT read, blank, read - blank - stored AS duplicates, stored, CASE WHEN read = blank THEN 'empty' WHEN blank > 0 THEN 'shortfall' ELSE 'complete' END AS state FROM c"""


def q_line_search(s, d):
    """The first 30 turns of each conversation that hold a literal, whatever its case."""
    hits = landed(s, d, "conversations").where(F.contains(F.lower("text"), F.lit("the")))
    return Q.top_n(hits.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")], 30)


def q_first_distinct(s, d):
    first = landed(s, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return first.select("conv_id", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).alias("place"))


SQL["line_search"] = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS rn FROM conversations WHERE contains(lower(text), 'the') QUALIFY rn <= 30"
SQL["ordered_distinct"] = "SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role)::INT AS place FROM conversations GROUP BY conv_id, role"

URLS = [
    "https://gitlab.example.com/group/app/-/pipelines/123", "HTTPS://GitLab.Example.com:443/a/b/c/-/jobs/9", "https://g.io/a/b.git", "https://g.io/a/b/-/tree/feature/x", "https://g.io:8443/a/b/-/blob/feature/x/ci/a.yml?ref_type=heads",
    "https://g.io/a/b/-/raw/main/x%20y.yml?inline=false", "http://localhost:3000/a/b", "http://g.io/a/b", "https://u:p@g.io/a/b", "https://g.io/a/b#x", "https://g.io/a/../b", "https://g.io/a", "https://g.io/a/b/-/pipelines/0", "https://g.io/a/b?x=1",
    "https://g.io/a/b/-/blob/main/a.yml?token=1", "ftp://g.io/a/b", "https://g.io/a//b", "https://g.io/a/b/", None, "no url", "https://g.io/a/b/-/tree/x?ref_type=tags&inline=true",
]


_URLS = """SELECT DISTINCT concat(regexp_extract(url, '^([a-z]+://[^/]+)', 1), '/group/app', CASE page_id % 6 WHEN 0 THEN concat('/-/pipelines/', page_id) WHEN 1 THEN concat('/-/jobs/', page_id) WHEN 2 THEN '.git' WHEN 3 THEN '/-/tree/feature/x' WHEN 4 THEN concat('/-/blob/main/ci/a', page_id % 9, '.yml') ELSE '?x=1' END) AS url FROM {pages} WHERE url IS NOT NULL"""


def q_references(s, d):
    return _with(s, d, _URLS, [(x,) for x in URLS], "url string").select("url", U.reference(F.col("url")).alias("r")).where("r is not null").select("url", "r.*")


SQL["url_references"] = f"""
WITH u AS (SELECT url, string_split(regexp_replace(url, '^[A-Za-z]+://', ''), '?') AS cut, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme FROM {_with_sql(_URLS, [(x,) for x in URLS], 'url')}),
p AS (
  SELECT url, scheme, lower(regexp_extract(cut[1], '^([^/]*)', 1)) AS host, rtrim(url_decode(regexp_replace(cut[1], '^[^/]*/?', '')), '/') AS path, coalesce(cut[2], '') AS query FROM u
  WHERE NOT contains(url, '#') AND NOT contains(url, '@') AND len(cut) <= 2 AND (scheme = 'https' OR scheme = 'http' AND starts_with(cut[1], 'localhost'))),
r AS (
  SELECT *, string_split(path, '/-/') AS halves, CASE WHEN scheme = 'https' AND ends_with(host, ':443') THEN host[:-5] ELSE host END AS short FROM p
  WHERE NOT contains(path, '//') AND NOT list_contains(string_split(path, '/'), '..')),
k AS (
  SELECT *, CASE WHEN len(halves) = 1 THEN regexp_replace(path, '[.]git$', '') ELSE halves[1] END AS project, halves[2] AS rest, string_split(halves[2], '/') AS parts FROM r)
SELECT url, CASE WHEN rest IS NULL THEN 'repository' WHEN parts[1] = 'pipelines' THEN 'pipeline' WHEN parts[1] = 'jobs' THEN 'job' ELSE 'branch' END AS kind, scheme || '://' || short AS base, project,
  CASE WHEN parts[1] = 'pipelines' THEN parts[2] END AS pipeline_id, CASE WHEN parts[1] = 'jobs' THEN parts[2] END AS job_id,
  CASE WHEN parts[1] = 'tree' THEN array_to_string(parts[2:], '/') WHEN parts[1] IN ('blob', 'raw') THEN array_to_string(parts[2:-2], '/') END AS ref, CASE WHEN parts[1] IN ('blob', 'raw') THEN parts[-1] END AS file_path
FROM k WHERE len(string_split(project, '/')) > 1 AND (rest IS NULL AND query = '' OR parts[1] IN ('pipelines', 'jobs') AND try_cast(parts[2] AS BIGINT) > 0 AND query = ''
  OR parts[1] IN ('tree', 'blob', 'raw') AND len(list_filter(string_split(query, '&'), lambda q: q NOT IN ('', 'ref_type=heads', 'ref_type=tags', 'inline=true', 'inline=false'))) = 0)"""


def q_blob_urls(s, d):
    pages = landed(s, d, "pages").select("page_id", F.concat(F.lit("dir ü/"), F.col("page_id").cast("string"), F.lit("+~*.py")).alias("path"))
    made = pages.select("page_id", U.blob_url(F.when(F.col("page_id") % 2 == 0, "gitlab").otherwise("github"), F.lit("https://h.io/a/b/"), F.lit("main"), F.col("path"), F.col("page_id").cast("int")).alias("link"), U.include_key(F.lit("a/b"), F.replace("path", F.lit("*"), F.lit("")), F.lit("v1")).alias("key"))
    return made.select("page_id", "link", "key", U.include_parts(F.col("key")).getField("path").alias("back"))


SQL["blob_urls"] = "SELECT page_id, 'https://h.io/a/b' || CASE WHEN page_id % 2 = 0 THEN '/-/blob/' ELSE '/blob/' END || 'main/dir%20%C3%BC/' || page_id || '%2B~%2A.py#L' || page_id AS link, 'project-include://a%2Fb?ref=v1&file=dir%20%C3%BC%2F' || page_id || '%2B~.py' AS key, 'dir ü/' || page_id || '+~.py' AS back FROM pages"


def _corpus(s, d):
    """Users as projects, five-event stretches as pipelines, events as jobs."""
    e = landed(s, d, "events").select(F.col("user_id").alias("project"), (F.col("event_id") - F.col("event_id") % 5).alias("pipeline_id"), F.col("event_id").alias("job_id"), "event_type", "props")
    state = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "view", "analyzed").when(F.col("event_type") == "click", "oversized").when(F.col("event_type") == "signup", "pending").otherwise("analysis_error")
    jobs = e.select("project", "pipeline_id", "job_id", state.alias("state"), F.concat(F.lit("rule."), (F.col("job_id") % 3).cast("string")).alias("rule_id"), F.col("props").alias("excerpt"))
    pipelines = e.select("project", "pipeline_id").distinct().select("project", "pipeline_id", (F.col("pipeline_id") % 3 > 0).alias("complete"), F.when(F.col("pipeline_id") % 7 == 0, "unreadable").otherwise("listed").alias("listing_state"), (F.col("pipeline_id") % 11 == 0).alias("capped"))
    return pipelines, jobs


def q_corpus_summary(s, d):
    shown = lambda c: F.to_json(c)
    return I.corpus_summary(*_corpus(s, d)).withColumn("rules", shown("rules")).withColumn("excerpts", F.array_join(F.transform("excerpts", lambda x: x.job_id.cast("string")), ","))


SQL["corpus_summary"] = """
WITH j AS (SELECT user_id AS project, event_id - event_id % 5 AS pipeline_id, event_id AS job_id, 'rule.' || event_id % 3 AS rule_id,
    CASE event_type WHEN 'error' THEN 'unknown' WHEN 'view' THEN 'analyzed' WHEN 'click' THEN 'oversized' WHEN 'signup' THEN 'pending' ELSE 'analysis_error' END AS state FROM events),
p AS (SELECT DISTINCT project, pipeline_id, pipeline_id % 3 > 0 AS complete, pipeline_id % 7 = 0 AS lost, pipeline_id % 11 = 0 AS capped FROM j),
s AS (SELECT project, pipeline_id, list(state) AS states FROM j GROUP BY 1, 2),
ps AS (SELECT project, count(*) AS pipelines, count_if(complete)::BIGINT AS complete, count_if(NOT complete)::BIGINT AS pending, count_if(list_has_any(states, ['analyzed', 'unknown']))::BIGINT AS analyzed, count_if(list_contains(states, 'unknown'))::BIGINT AS unknown,
    count_if(complete AND NOT list_has_any(states, ['analyzed', 'unknown', 'analysis_error']))::BIGINT AS no_logs, count_if(lost OR list_contains(states, 'oversized'))::BIGINT AS unreadable, count_if(capped)::BIGINT AS capped, max(pipeline_id) AS newest, min(pipeline_id) AS oldest
  FROM p JOIN s USING (project, pipeline_id) GROUP BY 1),
js AS (SELECT project, count(*) AS jobs, count_if(state IN ('analyzed', 'unknown'))::BIGINT AS analyzed_jobs, count_if(state = 'oversized')::BIGINT AS unreadable_jobs, count_if(state = 'unknown')::BIGINT AS unknown_jobs, count_if(state = 'oversized')::BIGINT AS oversized_jobs,
    0::BIGINT AS empty_jobs, count_if(state = 'analysis_error')::BIGINT AS analysis_error_jobs, count_if(state = 'pending')::BIGINT AS pending_jobs FROM j GROUP BY 1),
rs AS (SELECT project, '[' || string_agg('{"rule_id":"' || rule_id || '","jobs":' || n || ',"pipelines":' || k || '}', ',' ORDER BY n DESC, rule_id) || ']' AS rules FROM (SELECT project, rule_id, count(*) AS n, count(DISTINCT pipeline_id) AS k FROM j WHERE state IN ('analyzed', 'unknown') GROUP BY 1, 2) GROUP BY 1),
us AS (SELECT project, string_agg(job_id::VARCHAR, ',' ORDER BY pipeline_id DESC, job_id DESC) AS excerpts FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pipeline_id DESC, job_id DESC) AS k FROM j WHERE state = 'unknown') WHERE k <= 5 GROUP BY 1)
SELECT * FROM ps JOIN js USING (project) LEFT JOIN rs USING (project) LEFT JOIN us USING (project)"""


def q_dataset_summary(s, d):
    docs, labels = landed(s, d, "documents"), landed(s, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("dataset_label"))
    rows = docs.join(labels, "doc_id", "left").select(F.col("source").alias("source_label"), "dataset_label", F.when(F.col("doc_id") % 4 == 0, "unknown").when(F.col("doc_id") % 9 == 0, "analysis_error").otherwise("classified").alias("state"), F.col("lang").alias("rule_id"))
    return I.dataset_summary(rows).withColumn("rules", F.to_json("rules"))


SQL["dataset_summary"] = """
WITH r AS (SELECT source, quality, lang, CASE WHEN doc_id % 4 = 0 THEN 'unknown' WHEN doc_id % 9 = 0 THEN 'analysis_error' ELSE 'classified' END AS state FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
n AS (SELECT lang, count(*) AS n FROM r WHERE state = 'classified' GROUP BY 1)
SELECT count(DISTINCT source) AS sources, count(*) AS rows, count_if(state = 'classified')::BIGINT AS classified, count_if(state = 'unknown')::BIGINT AS unknown, count_if(state = 'analysis_error')::BIGINT AS errors, count(quality) AS labelled,
  (SELECT '[' || string_agg('{"rule_id":"' || lang || '","n":' || n || '}', ',' ORDER BY n DESC, lang) || ']' FROM n) AS rules FROM r"""


def q_knowledge(s, d):
    items = landed(s, d, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), "text")
    docs = landed(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), (F.col("source") == "src1").alias("private_scope"))
    none = V.knowledge(items, docs, private=False).select((-F.col("query_id")).alias("query_id"), "document_id", "similarity", "rn")
    both = V.knowledge(items, docs, private=True).unionByName(none)
    return both.select("query_id", "document_id", F.bround("similarity", 6).alias("similarity"), "rn")


SQL["knowledge_documents"] = _SIM + """
SELECT -1 - item_id AS query_id, doc_id AS document_id, round(coalesce(overlap / total, 0), 6) AS similarity, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(overlap / total, 0) DESC, doc_id)::INT AS rn
FROM benchmark CROSS JOIN (SELECT doc_id FROM documents WHERE source = 'src1') LEFT JOIN sim USING (item_id, doc_id) QUALIFY rn <= 2"""

HISTORY_JOBS = [("p", 1, "r.a", "c", "red green", 0.0), ("p", 2, "r.b", "c", "red", 0.05), ("p", 3, None, "unknown", "", None), ("q", 4, "r.a", "c", "red green", 0.9), ("p", 5, "r.z", "d", "blue", 0.0), ("p", 6, "r.z", "d", "other", 0.3)]
HISTORY_SAID = [("p", "s1", "r.a", "turn it off", 5), ("p", "s2", "r.a", "turn it on", 7), ("p", "s3", "r.a", " ", 9), ("p", "s4", "r.b", "wait", 1), ("p", "s5", "r.a", "older", 1), ("p", "s6", "r.a", "oldest", 0)]
HISTORY_PAST = [("p", "0123456789abcdefXYZ", "c", "red green blue", "fix it", 0.2), ("p", "i2", "d", "nothing", None, 0.0)]
HISTORY_ASK = [("f1", "p", "r.a", "c", "red green"), ("f2", "p", "r.x", "unknown", "zzz"), ("f3", "q", "r.a", "d", "")]


#: Events as past jobs of four projects, and as what was said of them; users as what is asked.
_PAST_JOBS = "SELECT concat('p', user_id % 4) AS project, event_id AS job_id, concat('r.', event_type) AS rule_id, CASE event_id % 6 WHEN 0 THEN 'unknown' ELSE concat('c', event_id % 3) END AS category, concat(event_type, ' ', CASE event_id % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END) AS excerpt, CAST(event_id % 10 AS DOUBLE) / 100 AS boost FROM {events}"
_PAST_SAID = "SELECT concat('p', user_id % 4) AS project, concat('s', event_id) AS id, concat('r.', event_type) AS rule_id, CASE event_id % 3 WHEN 0 THEN ' ' ELSE concat('did ', event_id) END AS resolution, event_id AS recorded_at FROM {events} WHERE event_type <> 'click'"
_ASKED = "SELECT DISTINCT concat('a', user_id) AS finding_id, concat('p', user_id % 4) AS project, CASE user_id % 3 WHEN 0 THEN 'r.error' WHEN 1 THEN 'r.click' ELSE 'r.none' END AS rule_id, CASE user_id % 2 WHEN 0 THEN 'c1' ELSE 'unknown' END AS category, CASE user_id % 5 WHEN 0 THEN 'error red' WHEN 1 THEN 'signup' ELSE 'nothing here' END AS query FROM {events}"


def q_history_items(s, d):
    items = V.history(
        _with(s, d, _PAST_SAID, HISTORY_SAID, "project string, id string, rule_id string, resolution string, recorded_at long"), _with(s, d, _PAST_JOBS, HISTORY_JOBS, "project string, job_id long, rule_id string, category string, excerpt string, boost double"),
        s.createDataFrame(HISTORY_PAST, "project string, incident_id string, category string, summary string, resolution string, similarity double"))
    return V.history_search(_with(s, d, _ASKED, HISTORY_ASK, "finding_id string, project string, rule_id string, category string, query string"), items)


SQL["history_items"] = f"""
WITH i AS (
  SELECT project, 'history:resolution:' || id AS evidence_id, 'confirmed_resolution' AS kind, rule_id, NULL AS category, resolution AS text, 0.0::DOUBLE AS boost FROM (SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY recorded_at DESC, id DESC) AS n FROM {_with_sql(_PAST_SAID, HISTORY_SAID, 'project, id, rule_id, resolution, recorded_at')} WHERE trim(resolution) <> '') WHERE n <= 3
  UNION ALL SELECT project, 'history:job:' || job_id, 'past_failure', rule_id, category, excerpt, coalesce(boost, 0) FROM (SELECT * FROM {_with_sql(_PAST_JOBS, HISTORY_JOBS, 'project, job_id, rule_id, category, excerpt, boost')} QUALIFY row_number() OVER (PARTITION BY project ORDER BY job_id DESC) <= 500) WHERE excerpt <> '' OR rule_id IS NOT NULL
  UNION ALL SELECT project, 'history:incident:' || id[:16], 'past_incident', NULL, category, summary || coalesce(chr(10) || 'Confirmed resolution: ' || resolution, ''), similarity FROM {G.values_sql(HISTORY_PAST, 'project, id, category, summary, resolution, similarity')}),
t AS (SELECT *, regexp_extract_all(lower(text), '[a-z][a-z0-9_/-]{{2,}}') AS w FROM i),
m AS (
  SELECT finding_id, evidence_id, kind, a.rule_id = t.rule_id AS same_rule, a.category = t.category AND t.category <> 'unknown' AS same_kind, boost,
    len(list_intersect(regexp_extract_all(query, '[a-z]{{3,}}'), w)) AS n, len(regexp_extract_all(query, '[a-z]{{3,}}')) AS nq, len(w) AS nw
  FROM {_with_sql(_ASKED, HISTORY_ASK, 'finding_id, project, rule_id, category, query')} a JOIN t USING (project)),
s AS (SELECT finding_id, evidence_id, kind, CASE WHEN kind = 'confirmed_resolution' THEN CASE WHEN same_rule THEN 2.0 END
    ELSE round_even(least(1, CASE WHEN nq + nw > n THEN n / (nq + nw - n) ELSE 0 END + CASE WHEN coalesce(same_rule, false) THEN 0.25 WHEN coalesce(same_kind, false) THEN 0.1 ELSE 0 END + boost), 3) END::DOUBLE AS score FROM m)
SELECT finding_id, evidence_id, kind, score, row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, evidence_id)::INT AS rn FROM s WHERE score >= 0.12 QUALIFY rn <= 6"""

INSPECTED_JOBS = [
    ("r1", "j1", "build", "ci", "failed", False, None, "a1"), ("r1", "j2", "deploy", "ci", "success", False, None, "a3"), ("r1", "j3", "lint", "ci", "failed", True, None, "a2"), ("r2", "j4", "test", "ci", "failed", True, None, "a9"),
    ("r2", "j5", "more", "ci", "failed", True, None, "a2"), ("r2", "j6", "pack", "ci", "failed", False, None, "a1"), ("r3", "j7", "ok", "ci", "success", False, None, "a3"), ("c1", "k1", "child", "ci", "failed", True, None, "a5"), ("c1", "k2", "child", "ci", "failed", False, None, "a8"),
]
INSPECTED_RUNS = [("r1", "failed", None, False), ("r2", "success", None, False), ("r3", "success", None, False), ("r4", "running", None, False), ("c1", "failed", None, False)]
BRIDGES = [("r1", "b1", "failed", False, "c1"), ("r1", "b2", "failed", False, "c1"), ("r1", "b3", "failed", True, "gone"), ("r3", "b4", "warning", False, "r4"), ("r2", "b5", "success", False, "c1"), ("r1", "b6", "failed", False, "r1")]


def q_inspected(s, d):
    logs = s.createDataFrame([(i, x) for i, _, x in G.LOGS], "name_of_log string, log string")
    jobs = s.createDataFrame(INSPECTED_JOBS, "run_id string, job_id string, name string, stage string, status string, allow_failure boolean, failure_reason string, name_of_log string").join(logs, "name_of_log").withColumn("conclusion", F.lit(None).cast("string")).withColumn("selected", F.lit(False))
    runs = s.createDataFrame(INSPECTED_RUNS, "run_id string, status string, conclusion string, partial boolean")
    found, status = I.inspected(runs, jobs, s.createDataFrame(BRIDGES, "run_id string, bridge_id string, status string, allow_failure boolean, child_id string"), budget=2)
    return found.join(status, "run_id").select("run_id", "rn", "rule_id", "severity", "job_id", "status")


QUERIES = {
    "fingerprint_clusters": q_fingerprint_clusters, "line_explode": q_line_explode, 
    
    "error_islands": q_error_islands, "asof_last_event": q_asof, "state_after_marker": q_state,
    "context_budget": q_budget, "next_key_range": q_next_key, "join_inner": q_join_inner, "join_left_zero_fill": q_zero_fill, "join_semi": q_semi, "join_anti": q_anti,
    "join_band": q_band, "join_unique_suffix": q_suffix, "case_mismatch_paths": q_case, "join_tiered_unique": q_tiered, "rule_prefix_lookup": q_dotted, "top2_per_group": q_top2,
    "retention_newest_n": q_retention, "orphan_check": q_orphans, "status_summary": q_status_summary, "rule_histogram": q_rule_histogram, "project_summary": q_project_summary,
    "having_gt2": q_having, "distinct_subquery": q_distinct, "set_union": lambda s, d: _keys(s, d)[0].union(_keys(s, d)[1]).distinct(),
    "set_intersect": lambda s, d: _keys(s, d)[0].intersect(_keys(s, d)[1]), "set_except": lambda s, d: _keys(s, d)[0].subtract(_keys(s, d)[1]),
    "url_references": q_references, "blob_urls": q_blob_urls, "corpus_summary": q_corpus_summary, "dataset_summary": q_dataset_summary,
    "knowledge_documents": q_knowledge, "history_items": q_history_items, "run_inspection_inline": q_inspected,
    "overall_status": q_overall, 
    "dedup_by_hash": q_dedup, "incremental_new_rows": q_incremental, "head_tail_truncate": q_head_tail, "excerpt_last6": q_excerpt, 
    "url_sanitize": q_url, "json_extract": q_json, "redact_assignments": q_redact, "redact_full": q_redact_full, "scrubbed_rows": q_scrubbed, "token_bag": q_token_bag, "jaccard_pairs": _similar,
    "retrieve_topk": q_topk, "jaccard_at_least": q_alike, "history_search": q_history, "transitive_closure": q_closure, "include_order": q_include_order, "upsert_merge": q_upsert, "store_violations": q_violations,
    "job_sampling": q_sample_jobs, "stable_ids": q_stable_ids, "artifact_rollup": q_artifact, "stream_incremental": q_stream, "job_ends": q_job_ends, "interval_join": q_interval_join, "strict_json": q_strict_json,
    "diff_added_lines": q_added_lines, "current_paths": q_current_paths, "change_risks": q_change_risks, "ci_references": q_ci_references, "exit_suppressed": q_hidden_exit,
    "similar_incidents": q_similar_incidents, "retrieval_bundle": q_bundle, "newest3_confirmations": q_newest, "retention_projects_entries": q_retained,
    "finding_order": q_ordered, "display_rank": q_display_rank, "import_report": q_import_report, "line_search": q_line_search, "ordered_distinct": q_first_distinct,
}
QUERIES |= G.QUERIES | E.QUERIES
SQL |= G.SQL | E.SQL
