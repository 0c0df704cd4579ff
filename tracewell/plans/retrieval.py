"""Retrieval: similar incidents, the bundle of sections within a budget, retention, orders of findings, import reports."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import relational as Q
from tracewell.operators import similarity as M

#: Order of severities and confidences, rules that say no more than that something failed.
SEVERITY, CONFIDENCE = ("error", "warning", "info"), ("observed", "likely", "unknown")
GENERIC = ("deployment.failed", "pipeline.failed")
STATUS_CATEGORIES = ("pipeline_status", "downstream_pipeline", "job_status")
CONTEXT_CATEGORIES = (*STATUS_CATEGORIES, "no_failure_observed", "unknown")


def similar_incidents(queries: DataFrame, incidents: DataFrame, limit: int = 5, least: float = 0.13) -> DataFrame:
    """(query_id, incident_id, resolved, similarity, rn): the ``limit`` most similar incidents of the query's project.

    ``queries`` has (query_id, project, fingerprint, category, text), ``incidents`` has (incident_id,
    project, fingerprint, category, text, resolved). Resolved ones come first, then likeness, then the
    smaller id. An equal fingerprint counts as 1, an equal category as 0.35 at least, and a query is
    not its own answer. Candidates share a word, or are the first ``limit`` + 1 of their category or
    fingerprint: others of those tie with or lose to them, so no group is paired as a whole.
    """
    # words get their project as they are read: joined to it later, all bags would be shuffled once more
    scoped = lambda df, k: Q.token_bags(df.where(F.col(k).isNotNull()), k, "text", "project")
    # a likeness below ``least`` counts for nothing, so it is not looked for
    whole, part = Fraction(str(least)).as_integer_ratio()[::-1]
    lexical = M.at_least(scoped(queries, "query_id"), "query_id", scoped(incidents, "incident_id"), "incident_id", part, whole)

    def firsts(by: str) -> DataFrame:
        few = Q.top_n(incidents.where(F.col(by).isNotNull()), ["project", by], [F.desc("resolved"), "incident_id"], limit + 1)
        return queries.join(few.select("project", by, "incident_id"), ["project", by]).select("query_id", "incident_id", F.lit(0).cast("long").alias("overlap"), F.lit(1).cast("long").alias("total"))

    every = lexical.unionByName(firsts("category")).unionByName(firsts("fingerprint")).where("query_id <> incident_id")
    pairs = every.groupBy("query_id", "incident_id").agg(F.max(F.col("overlap") / F.col("total")).alias("score"))
    q = queries.select("query_id", F.col("fingerprint").alias("qf"), F.col("category").alias("qc"))
    told = pairs.join(q, "query_id").join(incidents.select("incident_id", "fingerprint", "category", "resolved"), "incident_id")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    scored = told.withColumn("similarity", Q.incident_similarity(F.col("score"), same("qf", "fingerprint"), same("qc", "category"))).where(F.col("similarity") >= least)
    return Q.top_n(scored, ["query_id"], [F.desc("resolved"), F.desc("similarity"), "incident_id"], limit).select("query_id", "incident_id", "resolved", "similarity", "rn")


def knowledge(queries: DataFrame, documents: DataFrame, *, private: bool, limit: int = 2) -> DataFrame:
    """(query_id, document_id, similarity, rn): the ``limit`` documents most like each query (query_id, text).

    ``documents`` has (document_id, content, private_scope). Without ``private`` there are none, as only
    documents of private scope are ever shown. Where fewer share a word with the query, the first of
    the others fill up with a similarity of 0: ``limit`` of them, so documents are not paired as a whole.
    """
    own = documents.where(F.lit(private) & F.col("private_scope"))
    lexical = Q.multiset_similarity(Q.token_bags(queries, "query_id", "text"), "query_id", Q.token_bags(own, "document_id", "content"), "document_id")
    scored = lexical.select("query_id", "document_id", (F.col("overlap") / F.col("total")).alias("similarity"))
    first = F.array_sort(F.collect_list("document_id"))
    rest = own.select("document_id").orderBy("document_id").limit(2 * limit).agg(first.alias("ids")).withColumn("k", F.lit(1))
    filler = queries.select("query_id", F.lit(1).alias("k")).join(F.broadcast(rest), "k").select("query_id", F.explode("ids").alias("document_id"), F.lit(0.0).alias("similarity"))
    best = scored.unionByName(filler).groupBy("query_id", "document_id").agg(F.max("similarity").alias("similarity"))
    return Q.top_n(best, ["query_id"], [F.desc("similarity"), F.col("document_id")], limit).select("query_id", "document_id", "similarity", "rn")


def history(resolutions: DataFrame, jobs: DataFrame, incidents: DataFrame, *, scanned: int = 500) -> DataFrame:
    """(project, evidence_id, kind, rule_id, category, text, boost): all that is known of past failures, from three stores.

    ``resolutions`` has (project, id, rule_id, resolution, recorded_at), of which the newest three of a
    rule count; ``jobs`` (project, job_id, rule_id, category, excerpt, boost), of which the ``scanned``
    with the highest ids count and those without excerpt and rule do not; ``incidents`` (project,
    incident_id, category, summary, resolution, similarity). Blank resolutions are left out.
    """
    null, at = F.lit(None).cast("string"), F.desc("recorded_at")
    said = Q.top_n(resolutions.where(F.trim("resolution") != ""), ["project", "rule_id"], [at, F.desc("id")], 3)
    a = said.select("project", F.concat(F.lit("history:resolution:"), F.col("id").cast("string")).alias("evidence_id"), F.lit("confirmed_resolution").alias("kind"), "rule_id", null.alias("category"), F.trim("resolution").alias("text"), F.lit(0.0).alias("boost"))
    few = Q.top_n(jobs, ["project"], [F.desc("job_id")], scanned).where((F.coalesce("excerpt", F.lit("")) != "") | F.col("rule_id").isNotNull())
    b = few.select("project", F.concat(F.lit("history:job:"), F.col("job_id").cast("string")).alias("evidence_id"), F.lit("past_failure").alias("kind"), "rule_id", "category", F.coalesce("excerpt", F.lit("")).alias("text"), F.coalesce("boost", F.lit(0.0)).alias("boost"))
    told = F.concat("summary", F.coalesce(F.concat(F.lit("\nConfirmed resolution: "), "resolution"), F.lit("")))
    c = incidents.select("project", F.concat(F.lit("history:incident:"), F.substring(F.col("incident_id").cast("string"), 1, 16)).alias("evidence_id"), F.lit("past_incident").alias("kind"), null.alias("rule_id"), "category", told.alias("text"), F.col("similarity").alias("boost"))
    return a.unionByName(b).unionByName(c)


def history_search(findings_: DataFrame, items: DataFrame, *, limit: int = 6, least: float = 0.12) -> DataFrame:
    """(finding_id, evidence_id, kind, score, rn): the items of ``history`` that bear on each finding, best first.

    ``findings_`` has (finding_id, project, rule_id, category, query). Confirmed resolutions of its rule
    score 2; others their likeness to the query, raised for the same rule, else the same known
    category, and by their boost, 1 at most. Items of other projects never count. Within a project
    items that share a word are met by it. Of items that share a rule or a known category, or have a boost,
    the best ``limit`` of each rule, category and project are met: any other that shares no word loses to them.
    """
    scoped = lambda df, k, t: Q.token_bags(df, k, t)
    tagged = items.withColumn("item", F.concat_ws("\x1f", "project", "evidence_id"))
    bags_f = scoped(findings_, "finding_id", "query").join(findings_.select("finding_id", "project"), "finding_id").select("finding_id", F.concat_ws("\x1f", "project", "token").alias("token"), "n")
    bags_i = scoped(tagged, "item", "text").join(tagged.select("item", "project"), "item").select("item", F.concat_ws("\x1f", "project", "token").alias("token"), "n")
    lexical = Q.multiset_similarity(bags_f, "finding_id", bags_i, "item").select("finding_id", "item", (F.col("overlap") / F.col("total")).alias("s"))
    known = F.when(F.col("category") != "unknown", F.concat(F.lit("c"), "category"))
    keys = lambda df, third, *more: df.select("project", *more, F.explode(F.array(F.concat(F.lit("r"), "rule_id"), known, third)).alias("key")).where("key is not null")
    confirmed = F.col("kind") == "confirmed_resolution"
    alone = lambda of: Q.history_score(F.lit(0.0), confirmed, of == "r", of == "c", F.col("boost"))
    few = Q.top_n(keys(tagged, F.when(F.col("boost") > 0, F.lit("b")), "item", "kind", "boost", "evidence_id"), ["project", "key"], [F.desc(alone(F.substring("key", 1, 1))), F.col("evidence_id")], limit)
    met = keys(findings_, F.lit("b"), "finding_id").join(few.select("project", "key", "item"), ["project", "key"]).select("finding_id", "item", F.lit(0.0).alias("s"))
    pairs = lexical.unionByName(met).groupBy("finding_id", "item").agg(F.max("s").alias("s"))
    f = findings_.select("finding_id", F.col("rule_id").alias("f_rule"), F.col("category").alias("f_category"))
    told = pairs.join(f, "finding_id").join(tagged.select("item", "evidence_id", "kind", "rule_id", "category", "boost"), "item")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    score = Q.history_score(F.col("s"), confirmed, same("f_rule", "rule_id"), same("f_category", "category") & (F.col("category") != "unknown"), F.col("boost"))
    scored = told.where(~confirmed | same("f_rule", "rule_id")).withColumn("score", score).where(F.col("score") >= least)
    return Q.top_n(scored, ["finding_id"], [F.desc("score"), F.col("evidence_id")], limit).select("finding_id", "evidence_id", "kind", "score", "rn")


def source_order(sources: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Sources (key, path, ref, url, exact, cited, configures) with their place ``rn``: exact, cited and configuring ones first."""
    order = [F.desc("exact"), F.desc("cited"), F.desc("configures"), F.col("path"), F.col("ref"), F.col("url")]
    return Q.top_n(sources, [key], order, limit)


def knowledge_counts(projects: DataFrame, observations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row (projects, observations, resolutions) of how much is kept."""
    parts = [df.agg(F.count("*").alias(n)).withColumn("k", F.lit(1)) for n, df in (("projects", projects), ("observations", observations), ("resolutions", resolutions))]
    return parts[0].join(parts[1], "k").join(parts[2], "k").drop("k")


#: Kinds of evidence in the order in which a bundle has them, and how many sections of each.
EVIDENCE = (("job log", 3), ("CI configuration", 1), ("past incident", 2), ("guidance", 1), ("own document", 2))
UNRESOLVED = "Nobody has confirmed a resolution."


def sections(key: str, *, chunks: DataFrame | None = None, configured: DataFrame | None = None, incidents: DataFrame | None = None, packs: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(key, place, evidence_id, kind, content, label, verified) of what is known of each key, as ``bundle`` takes it.

    ``chunks`` has (key, rn, chunk_id, chunk_type, line_start, line_end, content), ``configured`` (key, rn,
    path, job_key, line_start, line_end), ``incidents`` (key, rn, incident_id, category, summary,
    resolution), ``packs`` (key, rn, skill_id, version, title, runbook), ``documents`` (key, rn,
    document_id, source, path, content). Of each kind the first of EVIDENCE by rn count. An incident is
    verified if it has a resolution, an own document never is; what is not given is not there.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = text(col("line_start"), "-", col("line_end"))
    told = (
        (chunks, lambda: (col("chunk_id"), col("content"), text("Redacted ", F.replace(col("chunk_type"), F.lit("_"), F.lit(" ")), ", lines ", lines), F.lit(True))),
        (configured, lambda: (text("yaml:", col("path"), ":", lines), text("Job ", col("job_key"), " in ", col("path"), ", lines ", lines), text(col("path"), ", lines ", lines), F.lit(True))),
        (incidents, lambda: (text("incident:", col("incident_id")), text(col("summary"), "\nResolution: ", F.coalesce("resolution", F.lit(UNRESOLVED))), text("Past ", F.replace(col("category"), F.lit("_"), F.lit(" "))), F.col("resolution").isNotNull())),
        (packs, lambda: (text("skill:", col("skill_id"), ":", col("version")), text(col("title"), "\n", col("runbook")), text(col("title"), ", version ", col("version")), F.lit(True))),
        (documents, lambda: (text("knowledge:", col("document_id")), text(col("source"), "/", col("path"), "\n", col("content")), text(col("source"), "/", col("path")), F.lit(False))),
    )
    parts = []
    for at, ((kind, most), (rows, made)) in enumerate(zip(EVIDENCE, told)):
        if rows is not None:
            own, content, label, verified = made()
            parts.append(rows.where(F.col("rn") <= most).select(key, (F.col("rn") + at * 1000).cast("int").alias("place"), own.alias("evidence_id"), F.lit(kind).alias("kind"), content.alias("content"), label.alias("label"), verified.alias("verified")))
    return reduce(DataFrame.unionByName, parts)


def bundle(sections: DataFrame, key: str, budget: int = 18_000) -> DataFrame:
    """(key, context, evidence): rendered sections in order of ``place``, cut to a budget of characters, and all ids.

    ``sections`` has (key, place, evidence_id, kind, content). A section's full length counts, so
    nothing follows one that was cut. A key has few sections; they are gathered by key.
    """
    rendered = F.concat(F.lit("["), "evidence_id", F.lit("] "), "kind", F.lit("\n"), F.trim(F.coalesce("content", F.lit(""))), F.lit("\n"))
    full = sections.select(key, "place", "evidence_id", rendered.alias("rendered"))
    used = Q.budget_cut(full, key, "place", "rendered", budget).join(full.select(key, "place", "evidence_id"), [key, "place"])
    in_order = F.sort_array(F.collect_list(F.struct("place", "used", "evidence_id")))
    return used.groupBy(key).agg(in_order.alias("s")).select(key, F.array_join(F.filter("s.used", lambda x: x != ""), "\n").alias("context"), F.col("s.evidence_id").alias("evidence"))


def retained(rows: DataFrame, project: str, at: str, tie: str, projects: int = 50, entries: int = 200) -> DataFrame:
    """The ``entries`` newest rows of the ``projects`` projects that were seen first most recently."""
    known = rows.groupBy(project).agg(F.min(at).alias("since")).orderBy(F.desc("since"), F.desc(project)).limit(projects)
    return rows.join(F.broadcast(known.select(project)), project, "left_semi").orderBy(F.desc(at), F.desc(tie)).limit(entries)


def _place(value: Column, order: tuple[str, ...]) -> Column:
    found = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(found > 0, found - 1).otherwise(len(order) - 1)


def ordered_findings(findings: DataFrame, key: str, limit: int = 80) -> DataFrame:
    """Findings with their place ``rn`` within ``key``: severity, confidence, generic rules last, rule, job."""
    order = [_place(F.col("severity"), SEVERITY), _place(F.col("confidence"), CONFIDENCE), F.col("rule_id").isin(*GENERIC), F.col("rule_id"), F.coalesce("job_id", F.lit(""))]
    return Q.top_n(findings, [key], order, limit)


def display_rank(rule_id: Column, category: Column, severity: Column, job_id: Column) -> Column:
    """0 to 7, the order in which findings are shown: errors of jobs that can be acted on first, context last."""
    loud = severity.isin("error", "warning")
    actionable = ~category.isin(*CONTEXT_CATEGORIES) & ~rule_id.rlike(r"^(?:pipeline\.|ci\.visibility)") & loud
    error = severity == "error"
    return (
        F.when(error & job_id.isNotNull(), F.when(actionable, 0).otherwise(1)).when(error & category.isin(*STATUS_CATEGORIES), 2)
        .when(actionable, F.when(job_id.isNotNull(), 3).otherwise(4)).when(loud & category.isin(*STATUS_CATEGORIES, "unknown"), 5)
        .when(category == "no_failure_observed", 6).otherwise(7)
    )


def import_report(rows: DataFrame, seen: DataFrame, row_hash: str, text: str) -> DataFrame:
    """One row (read, blank, duplicates, stored, state) of an import of ``rows`` besides the hashes in ``seen``.

    ``state`` is empty if no row had a text, shortfall if some had none, else complete.
    """
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    known = seen.select(F.col(row_hash).alias("__known")).distinct()
    per = rows.groupBy(F.when(~blank, F.col(row_hash)).alias("__hash")).agg(F.count("*").alias("n"))
    told = per.join(known, F.col("__hash") == F.col("__known"), "left")
    stored = F.col("__hash").isNotNull() & F.col("__known").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = told.agg(zero(F.sum("n")).alias("read"), zero(F.sum(F.when(F.col("__hash").isNull(), F.col("n")))).alias("blank"), F.count_if(stored).alias("stored"))
    state = F.when(F.col("read") == F.col("blank"), "empty").when(F.col("blank") > 0, "shortfall").otherwise("complete")
    return out.select("read", "blank", (F.col("read") - F.col("blank") - F.col("stored")).alias("duplicates"), "stored", state.alias("state"))
