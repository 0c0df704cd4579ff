"""Queries over sources written from the given tables, stores, citations, places and small functions, and the same in SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import scrub
from tracewell.functions import text as X
from tracewell.operators import relational as Q
from tracewell.operators import store as St
from tracewell.operators.lineage import shared_folder
from tracewell.plans import diagnosis as D
from tracewell.plans import inspection as I
from tracewell.plans import retrieval as V
from tracewell.sources import readers as S
from tracewell.sources.readers import landed

SQL: dict[str, str] = {}


#: Rows of a CSV file: one of quoted line breaks is one task's, and may have so many bytes only.
CSV_ROWS = 1000


def q_csv(s, d):
    """All documents written as a CSV of logs, line breaks and quotes in them, and read as an import reads them."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    rows = landed(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias(" Log "), F.coalesce("lang", F.lit("none")).alias("Status"))
    rows.write.option("header", True).option("maxRecordsPerFile", CSV_ROWS).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    assert S.csv_preview(s, path)["text"].strip() == "Log"
    found = S.log_csv(s, path).select(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), 256).alias("text_sha256"), "label")
    return found.groupBy("text_sha256", "label").agg(F.count("*").alias("n"))


SQL["csv_source"] = r"SELECT sha256(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS text_sha256, coalesce(lang, 'none') AS label, count(*) AS n FROM documents GROUP BY 1, 2"


def q_zip(s, d):
    """The properties of all events, each in an archive of its own; every eleventh archive is cut short."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for number, text in zip(batch["event_id"], batch["props"]):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("summary.json", text)
                made.append(raw.getvalue()[: 20 if number % 11 == 0 else None])
            yield pd.DataFrame({"path": batch["event_id"].astype(str), "content": made})

    archives = landed(s, d, "events").select("event_id", "props").mapInPandas(pack, "path string, content binary")
    found = S.zip_member(archives, "summary.json")
    return found.select(F.col("path").cast("long").alias("event_id"), F.get_json_object("json", "$.k").cast("long").alias("k"), "problem")


SQL["zip_members"] = "SELECT event_id, CASE WHEN event_id % 11 > 0 THEN (json_extract(props, '$.k'))::BIGINT END AS k, CASE WHEN event_id % 11 = 0 THEN 'BadZipFile' END AS problem FROM events"


def q_ci_nodes(s, d):
    """A CI configuration for each event, and its jobs."""
    text = F.concat(F.lit("stages: [a, b]\nbuild:\n  stage: "), "event_type", F.lit("\n  script: [make, t"), F.col("user_id").cast("string"), F.lit("]\ntest:\n  needs: [build, {job: x"), (F.col("event_id") % 3).cast("string"), F.lit("}]\n  extends: .base\n.hidden: {stage: a}\n"))
    text = F.when(F.col("event_id") % 13 == 0, "a: [").when(F.col("event_id") % 13 == 1, F.repeat(F.lit("---\na: b\n"), 21)).otherwise(text)
    found = S.ci_nodes(landed(s, d, "events").select(F.col("event_id").cast("string").alias("path"), text.alias("content")))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("path", "key", "stage", joined("needs"), joined("extends"), joined("script"), "line_start", "problem")


SQL["ci_nodes"] = """
WITH e AS (SELECT event_id::VARCHAR AS path, event_id, event_type, user_id FROM events WHERE event_id % 13 > 1)
SELECT path, 'build' AS key, event_type AS stage, '' AS needs, '' AS extends, 'make,t' || user_id AS script, 2 AS line_start, NULL AS problem FROM e
UNION ALL SELECT path, 'test', NULL, 'build,x' || event_id % 3, '.base', '', 5, NULL FROM e
UNION ALL SELECT path, '.hidden', 'a', '', '', '', 8, NULL FROM e
UNION ALL SELECT event_id::VARCHAR, NULL, NULL, '', '', '', NULL, CASE event_id % 13 WHEN 0 THEN 'invalid YAML' ELSE 'too many documents' END FROM events WHERE event_id % 13 < 2"""


def q_children(s, d):
    """Customers with their orders, the first fifty replaced with one order each."""
    parents, children = landed(s, d, "customer").select("c_custkey", "c_name"), landed(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    new = parents.where("c_custkey <= 50").withColumn("c_name", F.lit("new"))
    up, down = Q.upsert_with_children(parents, children, new, new.select("c_custkey", (-F.col("c_custkey")).alias("o_orderkey")), ["c_custkey"])
    fit = Q.within_capacity(up, new, ["c_custkey"], {"*": 10**9})
    counts = down.groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("sum"))
    return fit.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "sum")


SQL["upsert_children"] = """
SELECT c_custkey, CASE WHEN c_custkey <= 50 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey <= 50 THEN 1 ELSE coalesce(n, 0) END AS orders, CASE WHEN c_custkey <= 50 THEN -c_custkey ELSE total END::BIGINT AS sum
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def q_store(s, d):
    """Customers and their orders in a store, then some changed in one commit, read from the newest snapshot."""
    store = f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    parents, children = landed(s, d, "customer").select("c_custkey", "c_name"), landed(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    St.commit(s, store, {"customers": (parents, ["c_custkey"]), "orders": (children, ["c_custkey"])}, replaced={"orders": parents.select("c_custkey")}, buckets=16)
    new = parents.where("c_custkey <= 50").withColumn("c_name", F.lit("new")).unionByName(s.createDataFrame([(-1, "first")], "c_custkey long, c_name string"))
    St.commit(s, store, {"customers": (new, ["c_custkey"]), "orders": (new.where("c_custkey < 30").select("c_custkey", (-F.col("c_custkey")).alias("o_orderkey")), ["c_custkey"])}, replaced={"orders": new.select("c_custkey")})
    counts = St.table(s, store, "orders").groupBy("c_custkey").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("sum"))
    return St.table(s, store, "customers").join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).alias("orders"), "sum")


SQL["store_commits"] = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey <= 50 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'first'),
o AS (SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey > 50 UNION ALL SELECT c_custkey, -c_custkey FROM c WHERE c_custkey < 30)
SELECT c_custkey, c_name, coalesce(n, 0) AS orders, total::BIGINT AS sum FROM c LEFT JOIN (SELECT c_custkey, count(*) AS n, sum(o_orderkey) AS total FROM o GROUP BY 1) USING (c_custkey)"""


def q_feedback(s, d):
    """Documents as incidents; labels as what people said of them."""
    incidents = landed(s, d, "documents").select("doc_id", F.lit("open").alias("resolution_status"), F.col("source").alias("resolution")).distinct()
    one = landed(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    outcome = F.when(F.col("t") == 1, "rejected").when(F.col("q") == 1, "resolved").when(F.col("doc_id") % 2 == 0, "nonsense").otherwise("unresolved")
    return Q.with_feedback(incidents, one.select("doc_id", outcome.alias("outcome"), F.lit("fixed").alias("resolution")), "doc_id")


SQL["feedback"] = """
WITH i AS (SELECT DISTINCT doc_id, source FROM documents), l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1),
o AS (SELECT doc_id, CASE WHEN t = 1 THEN 'rejected' WHEN q = 1 THEN 'resolved' WHEN doc_id % 2 = 0 THEN NULL ELSE 'unresolved' END AS outcome FROM l)
SELECT doc_id, coalesce(outcome, 'open') AS resolution_status, CASE WHEN outcome IS NULL THEN source WHEN outcome = 'resolved' THEN 'fixed' END AS resolution FROM i LEFT JOIN o USING (doc_id)"""


def q_reclassified(s, d):
    """Stored rows, half of which were classified by other rules than now."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP "), F.when(F.col("event_id") % 2 == 0, "401").otherwise("503"))).otherwise("calm")
    stored = landed(s, d, "events").select("event_id", text.alias("excerpt"), F.lit("classified").alias("state"), F.lit("old.rule").alias("rule_id"), F.lit("old").alias("category"), F.when(F.col("event_id") % 4 < 2, F.lit(R.checksum())).otherwise(F.lit("other")).alias("rule_checksum"))
    return D.reclassified(stored, "event_id", "excerpt").select("event_id", "state", "rule_id", "category", (F.col("rule_checksum") == R.checksum()).alias("now"))


SQL["reclassified"] = """
SELECT event_id, CASE WHEN event_id % 4 < 2 OR event_type = 'error' THEN 'classified' ELSE 'unknown' END AS state, CASE WHEN event_id % 4 < 2 THEN 'old.rule' WHEN event_type <> 'error' THEN 'job.insufficient_evidence' WHEN event_id % 2 = 0 THEN 'auth.authentication_rejected' ELSE 'http.service_failure' END AS rule_id,
  CASE WHEN event_id % 4 < 2 THEN 'old' WHEN event_type <> 'error' THEN 'unknown' WHEN event_id % 2 = 0 THEN 'authentication_failure' ELSE 'external_api_failure' END AS category, true AS now FROM events"""


def q_counts(s, d):
    return V.knowledge_counts(landed(s, d, "customer"), landed(s, d, "events"), landed(s, d, "labels").where("quality = 1"))


SQL["knowledge_counts"] = "SELECT (SELECT count(*) FROM customer) AS projects, (SELECT count(*) FROM events) AS observations, (SELECT count(*) FROM labels WHERE quality = 1) AS resolutions"


def q_source_order(s, d):
    """Pages as sources of their hosts, eight of each."""
    pages = landed(s, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.col("page_id").cast("string").alias("path"), (F.col("page_id") % 3).cast("string").alias("ref"), "url", (F.col("page_id") % 5 == 0).alias("exact"), (F.col("page_id") % 2 == 0).alias("cited"), (F.col("page_id") % 7 == 0).alias("configures"))
    return V.source_order(pages, "host").select("host", "path", "rn")


SQL["source_order"] = "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id::VARCHAR AS path, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id % 5 = 0 DESC, page_id % 2 = 0 DESC, page_id % 7 = 0 DESC, page_id::VARCHAR, (page_id % 3)::VARCHAR, url)::INT AS rn FROM pages QUALIFY rn <= 8"


def q_subjects(s, d):
    """What lines are about, for rules whose line names it."""
    e = landed(s, d, "events")
    rule = F.when(F.col("event_id") % 3 == 0, "salesforce.csv_as_sobject").when(F.col("event_id") % 3 == 1, "rlp.datasync_ambiguous").otherwise("log.explicit_error")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("InvalidJob : Unable to find object: obj_"), (F.col("event_id") % 9).cast("string"), F.lit(".csv"))).when(F.col("event_id") % 3 == 1, F.concat((F.col("event_id") % 50).cast("string"), F.lit(" |  "), "event_type", F.lit(" x | FAIL | AMBIGUOUS"))).otherwise("ERROR: none")
    return e.select("event_id", D.subject(rule, line).alias("subject"))


SQL["finding_subjects"] = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'obj_' || event_id % 9 || '.csv' WHEN 1 THEN event_type || ' x' END AS subject FROM events"


def q_texts(s, d):
    """Texts in one line, some of their lines with numbers, their instants and parts."""
    docs = landed(s, d, "documents")
    return docs.select("doc_id", F.sha2(X.clip(F.col("text")), 256).alias("clip_sha256"), F.sha2(X.numbered_window(F.col("text"), 2, 3), 256).alias("window_sha256"), X.parse_time(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).alias("at"))


SQL["text_views"] = r"""
WITH p AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS plain, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(regexp_replace(text, '\n+$', ''), chr(10)) END AS l FROM documents)
SELECT doc_id, sha256(CASE WHEN length(plain) <= 480 THEN plain ELSE regexp_replace(substr(plain, 1, 479), '\s+\S*$', '') || '…' END) AS clip_sha256,
  sha256(array_to_string(list_transform(range(2, 1 + least(4, len(l))), lambda i: i || ': ' || l[i]), chr(10))) AS window_sha256,
  CASE WHEN doc_id % 40 BETWEEN 1 AND 31 THEN timestamp '2024-01-01' + to_days((doc_id % 40 - 1)::INT) END AS at FROM p"""


def q_cited(s, d):
    """Users whose events' types are all allowed, where a user may cite what a tenth of users never does."""
    e = landed(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("cited"))
    rows = e.withColumn("allowed", F.when(F.col("user_id") % 2 == 0, F.array(*map(F.lit, ("error", "view", "click", "purchase", "signup")))).otherwise(F.array(F.lit("error"), F.lit("view"))))
    return D.cited(rows, "cited", "allowed").select("user_id", F.size("cited").alias("n"))


SQL["cited_only"] = "SELECT user_id, count(DISTINCT event_type)::INT AS n FROM events GROUP BY 1 HAVING user_id % 2 = 0 OR bool_and(event_type IN ('error', 'view'))"


def q_kept(s, d):
    """Documents cut down to what may be kept: forty characters without controls and secrets, two words."""
    docs = landed(s, d, "documents").select("doc_id", F.concat(F.lit('secret="s3cr3t" \x01'), F.coalesce("lang", F.lit("x")), F.lit(" "), F.translate(F.coalesce("text", F.lit("")), '"=:', "")).alias("text"), F.split(F.coalesce("source", F.lit("")), "").alias("parts"), "source")
    out = scrub.kept(docs, {"doc_id": 0, "text": 40, "parts": 2})
    return out.select("doc_id", F.sha2("text", 256).alias("sha256"), F.array_join("parts", "").alias("parts"))


SQL["kept_rows"] = """SELECT doc_id, sha256(substr('secret="[REDACTED]" ' || coalesce(lang, 'x') || ' ' || translate(coalesce(text, ''), '"=:', ''), 1, 40)) AS sha256, substr(coalesce(source, ''), 1, 2) AS parts FROM documents"""


def q_cross(s, d):
    """Line items whose order, part or supplier is missing, and keys that occur twice; parts above a number count as missing."""
    items = landed(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    keys = lambda t, a, b: landed(s, d, t).select(F.col(a).alias(b))
    parents = {"order": (keys("orders", "o_orderkey", "l_orderkey"), ["l_orderkey"]), "part": (keys("part", "p_partkey", "l_partkey").where("l_partkey % 10 > 0"), ["l_partkey"]), "supplier": (keys("supplier", "s_suppkey", "l_suppkey"), ["l_suppkey"])}
    return Q.violations(items, {"line": F.col("l_linenumber") < 6}, parents, {"one line": ["l_orderkey", "l_linenumber"], "one part": ["l_orderkey", "l_partkey"]})


SQL["cross_violations"] = """
SELECT * FROM (SELECT 'line' AS "check", count_if(NOT l_linenumber < 6)::BIGINT AS n FROM lineitem UNION ALL SELECT 'order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 > 0) UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'one line', (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT FROM lineitem UNION ALL SELECT 'one part', (count(*) - count(DISTINCT (l_orderkey, l_partkey)))::BIGINT FROM lineitem) WHERE n > 0"""


def q_mapped(s, d):
    """Errors of users with how often each user's kinds of event occurred."""
    e = landed(s, d, "events")
    counts = e.where("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))
    return Q.mapped(e.where("event_type = 'error'").select("event_id", "user_id"), counts.where("n % 2 = 0"), "user_id")


SQL["map_join"] = "WITH c AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE event_type <> 'view' GROUP BY 1 HAVING count(*) % 2 = 0) SELECT event_id, user_id, n, kinds FROM events JOIN c USING (user_id) WHERE event_type = 'error'"


def q_export(s, d):
    """Documents as lines of JSON: languages and the first characters without secrets."""
    rows = landed(s, d, "documents").select("doc_id", "lang", F.concat(F.lit("api_key=abc123 "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "")).alias("note"))
    return Q.exported(rows, {"doc_id": 0, "lang": 2, "note": 30}, ["doc_id"]).select(F.sha2("line", 256).alias("line_sha256"))


SQL["sanitized_export"] = """SELECT sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || substr(lang, 1, 2) || '"', 'null') || ',"note":"' || substr('api_key=[REDACTED] ' || regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g'), 1, 30) || '"}') AS line_sha256 FROM documents"""


def q_span(s, d):
    """Events as jobs, their users as pipelines."""
    e = landed(s, d, "events")
    pipelines = e.groupBy("user_id").agg(F.min("event_id").alias("collected_at"), F.max("event_id").alias("last_seen_at"))
    jobs = e.select(F.when(F.col("event_type") != "view", F.concat(F.lit("rules-"), (F.col("event_id") % 3).cast("string"))).alias("rule_checksum"))
    return I.corpus_span(pipelines, jobs).withColumn("checksums", F.array_join("checksums", ","))


SQL["corpus_span"] = "SELECT count(DISTINCT user_id) AS pipelines, count(*) AS jobs, min(event_id) AS first_collected, max(event_id) AS last_seen, string_agg(DISTINCT CASE WHEN event_type <> 'view' THEN 'rules-' || event_id % 3 END, ',' ORDER BY CASE WHEN event_type <> 'view' THEN 'rules-' || event_id % 3 END) AS checksums FROM events"


def q_public(s, d):
    """A summary of a corpus made of events, and of one repository of it."""
    e = landed(s, d, "events").withColumn("repository", F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")))
    runs = e.select("repository", F.when(F.col("event_id") % 4 > 0, "captured").otherwise("missing").alias("config_state"), (F.col("event_id") % 6 == 0).alias("truncated"), (F.col("event_id") % 7 == 0).alias("modified"), F.when(F.col("event_id") % 9 == 0, "limited").otherwise("whole").alias("job_state"))
    state = F.when(F.col("event_type") == "error", "classified").when(F.col("event_type") == "view", "unknown").when(F.col("event_type") == "click", "analysis_error")
    log = F.when(F.col("event_id") % 5 == 0, "redirect").when(F.col("event_id") % 5 == 1, "forbidden").when(F.col("event_id") % 5 == 2, "oversized").otherwise("captured")
    jobs = e.where("event_id % 3 > 0").select("repository", state.alias("classification"), log.alias("log_state"), F.when(F.col("event_id") % 8 == 0, "No Rule").otherwise(F.concat(F.lit("rule."), "event_type")).alias("rule_id"))
    shown = lambda repository: I.public_summary(e.select("repository").distinct(), runs, jobs, repository).withColumn("rules", F.to_json("rules")).withColumn("of", F.lit(repository or "all"))
    return shown(None).unionByName(shown("r1"))


SQL["public_summary"] = """
WITH e AS (SELECT *, 'r' || user_id % 5 AS repository FROM events), scope AS (SELECT 'all' AS "of" UNION ALL SELECT 'r1'),
x AS (SELECT "of", e.*, event_id % 4 > 0 AS captured, event_id % 6 = 0 AS truncated, event_id % 3 > 0 AS job, CASE event_type WHEN 'error' THEN 'classified' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'analysis_error' ELSE '' END AS state FROM scope JOIN e ON "of" = 'all' OR "of" = repository),
r AS (SELECT "of", '[' || string_agg('{"rule_id":"' || rule_id || '","n":' || n || '}', ',' ORDER BY n DESC, rule_id) || ']' AS rules FROM (SELECT "of", 'rule.' || event_type AS rule_id, count(*) AS n FROM x WHERE job AND state IN ('classified', 'unknown') AND event_id % 8 > 0 GROUP BY 1, 2) GROUP BY 1)
SELECT "of", count(DISTINCT repository) AS repositories, count(*) AS runs, count_if(event_id % 9 = 0)::BIGINT AS limited_runs, count_if(captured)::BIGINT AS configs, count_if(captured AND NOT truncated)::BIGINT AS whole_configs, count_if(captured AND truncated)::BIGINT AS truncated_configs,
  count_if(captured AND event_id % 7 = 0)::BIGINT AS modified_configs, count_if(NOT (captured AND NOT truncated))::BIGINT AS no_config, count_if(job)::BIGINT AS jobs, count_if(job AND state = 'classified')::BIGINT AS classified, count_if(job AND state = 'unknown')::BIGINT AS unknown, count_if(job AND state = 'analysis_error')::BIGINT AS analysis_error,
  count_if(job AND event_id % 5 > 2)::BIGINT AS captured_logs, count_if(job AND event_id % 5 = 0)::BIGINT AS redirect_logs, count_if(job AND event_id % 5 = 1)::BIGINT AS forbidden_logs, count_if(job AND event_id % 5 = 2)::BIGINT AS oversized_logs, count_if(job AND event_id % 5 < 3)::BIGINT AS no_log,
  any_value(rules) AS rules, count_if(NOT job)::BIGINT AS no_job_runs FROM x JOIN r USING ("of") GROUP BY 1"""


def q_identity(s, d):
    """An identity for each event, and how many share it."""
    e = landed(s, d, "events").select(I.identity(F.concat(F.lit("rule."), "event_type"), F.col("user_id").cast("string"), F.lit("ci/a.yml"), (F.col("event_id") % 3).cast("int"), F.lit("said")).alias("identity"))
    return e.groupBy("identity").agg(F.count("*").alias("n"))


SQL["finding_identities"] = """SELECT substr(sha256('{"evidence":{"line":' || event_id % 3 || ',"path":"ci/a.yml","text":"said"},"job_id":"' || user_id || '","rule_id":"rule.' || event_type || '"}'), 1, 24) AS identity, count(*) AS n FROM events GROUP BY 1"""
QUERIES = {
    "csv_source": q_csv, "zip_members": q_zip, "ci_nodes": q_ci_nodes, "upsert_children": q_children, "store_commits": q_store, "feedback": q_feedback, "reclassified": q_reclassified, "knowledge_counts": q_counts, "source_order": q_source_order,
    "finding_subjects": q_subjects, "text_views": q_texts, "cited_only": q_cited, "kept_rows": q_kept, "cross_violations": q_cross, "map_join": q_mapped, "sanitized_export": q_export, "corpus_span": q_span, "public_summary": q_public, "finding_identities": q_identity,
}
