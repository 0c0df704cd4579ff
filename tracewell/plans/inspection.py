"""Whole runs: findings of jobs, of the run, of jobs left out and of child runs, with one status; and summaries of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text as X
from tracewell.functions.redact import redact_column
from tracewell.plans import diagnosis as D
from tracewell.plans import retrieval as V

#: Child runs that are followed for each run, and rows that are listed.
CHILDREN, EXAMPLES = 2, 3
_FINDING = ("run_id", "rule_id", "category", "severity", "confidence", "job_id", "title", "evidence", "line")


def _own(rows: DataFrame, rule: Column, category: str, severity: Column, confidence: str, title: str, evidence: Column) -> DataFrame:
    """Findings that no job has, in the shape of all findings."""
    null = F.lit(None)
    return rows.select("run_id", rule.alias("rule_id"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(confidence).alias("confidence"), null.cast("string").alias("job_id"), F.lit(title).alias("title"), evidence.alias("evidence"), null.cast("int").alias("line"))


def run_findings(runs: DataFrame) -> DataFrame:
    """A finding for each run (run_id, status, conclusion) that has not succeeded: an error if it failed, an info while it is active, else a warning."""
    outcome = X.outcome(F.col("status"), F.col("conclusion"))
    rows = runs.where("status is not null").withColumn("outcome", outcome).where(~F.col("outcome").isin(*D.SUCCESS))
    failed = F.col("outcome").isin(*D.FAILED)
    severity = F.when(failed, "error").when(F.col("outcome").isin(*D.ACTIVE), "info").otherwise("warning")
    return _own(rows, F.when(failed, "pipeline.failed").otherwise("pipeline.not_completed"), "pipeline_status", severity, "observed", "The run's own status", F.concat_ws(" ", F.lit("status:"), "outcome"))


def left_out(jobs: DataFrame, chosen: DataFrame, runs: DataFrame) -> DataFrame:
    """A finding for each run with failed jobs that are not ``chosen``: a warning if all may fail or the run succeeded."""
    outcome = X.outcome(F.col("status"), F.col("conclusion"))
    rest = jobs.where(outcome.isin(*D.FAILED)).join(chosen.select("run_id", "job_id"), ["run_id", "job_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("job_id"))
    counted = rest.withColumn("n", first).groupBy("run_id").agg(
        F.count("*").alias("jobs"), F.bool_and(F.coalesce("allow_failure", F.lit(False))).alias("allowed"), F.array_sort(F.collect_list(F.when(F.col("n") <= EXAMPLES, F.col("name")))).alias("names"))
    good = runs.select("run_id", X.outcome(F.col("status"), F.col("conclusion")).isin(*D.SUCCESS).alias("good"))
    told = counted.join(good, "run_id", "left")
    severity = F.when(F.col("allowed") | F.coalesce("good", F.lit(False)), "warning").otherwise("error")
    return _own(told, F.lit("jobs.unanalyzed_failures"), "job_status", severity, "observed", "Failed jobs that were not looked at", F.concat(F.col("jobs").cast("string"), F.lit(": "), F.array_join("names", ", ")))


def downstream(runs: DataFrame, bridges: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of triggers whose child failed or warns, and (run_id, child_id, job_id) of one failed job of each child.

    ``bridges`` has (run_id, bridge_id, status, allow_failure, child_id). Of each run's triggers with a
    failure or warning the first CHILDREN distinct children are followed, one level down; a run that
    triggers itself is not. A child that is not among ``runs`` is unavailable; one whose own status is
    better than the trigger's is not declared failed. The run's success or ``allow_failure`` makes
    each a warning. Of a child's failed jobs a blocking one with the highest id is looked at.
    """
    known = runs.select(F.col("run_id").alias("child_id"), X.outcome(F.col("status"), F.col("conclusion")).alias("child"))
    parent = runs.select("run_id", X.outcome(F.col("status"), F.col("conclusion")).isin(*D.SUCCESS).alias("good"))
    bad = bridges.where(F.lower("status").isin(*D.FAILED, "warning") & ~F.coalesce(F.col("child_id") == F.col("run_id"), F.lit(False)))
    one = bad.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "child_id").orderBy("bridge_id"))).where("k = 1 or child_id is null")
    few = one.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("bridge_id"))).where(F.col("n") <= CHILDREN)
    told = few.join(known, "child_id", "left").join(parent, "run_id", "left")
    severity = F.when(F.coalesce("allow_failure", F.lit(False)) | F.coalesce("good", F.lit(False)), "warning").otherwise("error")
    gone, worse = F.col("child").isNull(), F.col("child").isin(*D.FAILED, "warning")
    rule = F.when(gone, "downstream.unavailable").when(worse, "downstream.failed").otherwise("downstream.bridge_failed")
    found = _own(told, rule, "downstream_pipeline", severity, "observed", "A child run failed or warns", F.concat_ws(" ", F.lit("trigger:"), "status", F.lit("child:"), F.coalesce("child", F.lit("unavailable"))))
    found = found.withColumn("confidence", F.when(F.col("rule_id") == "downstream.unavailable", "unknown").otherwise(F.col("confidence")))
    failed = jobs.where(X.outcome(F.col("status"), F.col("conclusion")).isin(*D.FAILED)).select(F.col("run_id").alias("child_id"), "job_id", F.coalesce("allow_failure", F.lit(False)).alias("allow"))
    best = failed.withColumn("n", F.row_number().over(Window.partitionBy("child_id").orderBy("allow", F.desc("job_id")))).where("n = 1")
    return found, told.where("child is not null").select("run_id", "child_id").join(best.select("child_id", "job_id"), "child_id").select("run_id", "child_id", "job_id")


def inspected(runs: DataFrame, jobs: DataFrame, bridges: DataFrame | None = None, more: DataFrame | None = None, *, budget: int = 8, limit: int = 80) -> tuple[DataFrame, DataFrame]:
    """Findings (with their place ``rn``) and (run_id, status) of whole runs.

    ``runs`` has (run_id, status, conclusion, partial), ``jobs`` (run_id, job_id, name, stage, status,
    conclusion, allow_failure, failure_reason, selected, log), ``bridges`` as in ``downstream``; ``more``
    are findings of other kinds, such as change risks. Each run has ``budget`` jobs read, a child's
    job among them where its budget leaves one, and ``limit`` findings listed; the status follows
    from all of them.
    """
    chosen = D.sample_jobs(jobs.select("run_id", "job_id", "name", "stage", "status", "conclusion", "selected"), budget)
    read = chosen.select("run_id", "job_id")
    parts = [run_findings(runs), left_out(jobs, chosen, runs)]
    logs = jobs.select(F.col("run_id").alias("of"), "job_id", "status", "conclusion", "failure_reason", "log")
    if bridges is not None:
        children, of_child = downstream(runs, bridges, jobs)
        parts.append(children)
        room = chosen.groupBy("run_id").agg(F.count("*").alias("n"))
        free = of_child.join(room, "run_id", "left").withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy("child_id"))).where(F.coalesce("n", F.lit(0)) + F.col("k") <= budget)
        read = read.unionByName(free.select("run_id", "job_id")).distinct()
    of_jobs = D.findings(logs.join(read.select("job_id").distinct(), "job_id", "left_semi"))
    parts.append(read.join(of_jobs, "job_id").select(*_FINDING))
    every = parts[0].select(*_FINDING)
    for part in [*parts[1:], *([more] if more is not None else [])]:
        every = every.unionByName(part.select(*_FINDING))
    return V.ordered_findings(every, "run_id", limit), D.overall_status(runs, every)


#: Statuses of rows that did not fail; rows that are read and failures that are shown, at most; the largest count.
BENIGN = ("success", "succeeded", "passed", "ok", "updated", "update", "deployed", "created", "complete", "completed", "skipped", "skip", "ignored", "dry-run", "dry_run", "not-applicable", "not_applicable")
ROWS_READ, FAILURES, COUNT = 10_000, 20, 1_000_000_000
RESET = "(?i)" + R.any_of("connection~reset", "connectionreseterror")


def artifact_failures(summaries: DataFrame, *, rows_read: int = ROWS_READ, failures: int = FAILURES) -> DataFrame:
    """(path, failed, reset, bounded, rule_id) of deployment summaries (path, json): did a field mapping fail, and was it a reset connection.

    ``fieldMappings`` is a list of rows, or has ``failures`` and a count. A row has failed if its status
    is none of BENIGN, or if it has none but stands in ``failures`` with an error. A count alone tells of
    a failure unless every row is benign. Only the first ``failures`` failed rows of the first
    ``rows_read`` are looked into; ``bounded`` says that there were more. Errors are redacted first.
    """
    field = F.get_json_object("json", "$.fieldMappings")
    mapped = field.startswith("{")
    listed = F.when(mapped, F.get_json_object("json", "$.fieldMappings.failures")).otherwise(field)
    rows = F.coalesce(F.from_json(F.when(listed.startswith("["), listed), "array<struct<status:string,error:string,message:string>>"), F.array())
    count = lambda name: F.get_json_object("json", f"$.fieldMappings.{name}").try_cast("long")
    sound = lambda c: F.when((c >= 0) & (c <= COUNT), c)
    told = summaries.select("path", rows.alias("every"), (mapped & listed.startswith("[")).alias("of_failures"), F.when(mapped, F.coalesce(sound(count("failed")), sound(count("failure")))).alias("count"))
    status = lambda x: F.nullif(F.lower(F.trim(x.status)), F.lit(""))
    text = lambda x: F.concat_ws(" ", x.error, x.message)
    good = lambda x: F.coalesce(status(x).isin(*BENIGN), F.lit(False))
    bad = F.filter(F.slice("every", 1, rows_read), lambda x: x.isNotNull() & ~good(x) & (status(x).isNotNull() | (F.col("of_failures") & (text(x) != ""))))
    told = told.withColumn("bad", bad).withColumn("said", redact_column(F.array_join(F.transform(F.slice("bad", 1, failures), text), "\n")).getField("content"))
    benign = (F.size("every") > 0) & (F.size("every") <= rows_read) & F.forall("every", lambda x: x.isNotNull() & good(x))
    failed = (F.size("bad") > 0) | (F.coalesce(F.col("count") > 0, F.lit(False)) & ~benign)
    reset = F.coalesce(F.col("said").rlike(RESET), F.lit(False))
    over = (F.size("bad") > failures) | (F.size("every") > rows_read)
    rule = F.when(failed, F.when(reset, "rlp.datasync_field_mapping_connection_reset").otherwise("rlp.datasync_field_mapping_artifact_failure"))
    return told.select("path", failed.alias("failed"), reset.alias("reset"), over.alias("bounded"), rule.alias("rule_id"))


def actionable(found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that something can be done about, one of each identity: no status, context or success."""
    return found.where(~F.col("category").isin(*V.STATUS_CATEGORIES, "no_failure_observed")).dropDuplicates(keys)


def identity(rule_id: Column, job_id: Column, path: Column, line: Column, text: Column) -> Column:
    """24 digits that stand for a finding: its rule, job and the place and text of its evidence, as JSON with sorted keys."""
    evidence = F.struct(line.alias("line"), path.alias("path"), text.alias("text"))
    return F.substring(F.sha2(F.to_json(F.struct(evidence.alias("evidence"), job_id.alias("job_id"), rule_id.alias("rule_id")), {"ignoreNullFields": "false"}), 256), 1, 24)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over (source_label, state, dataset_label, rule_id): sources, rows by state, labelled rows, rules of classified rows."""
    total = rows.agg(
        F.countDistinct("source_label").alias("sources"), F.count("*").alias("rows"), F.count_if(F.col("state") == "classified").alias("classified"), F.count_if(F.col("state") == "unknown").alias("unknown"),
        F.count_if(F.col("state") == "analysis_error").alias("errors"), F.count("dataset_label").alias("labelled"))
    by = rows.where("state = 'classified'").groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = by.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rule_id", "n"))).alias("r")).select(F.transform("r", lambda x: F.struct(x.rule_id.alias("rule_id"), x.n.alias("n"))).alias("rules"))
    return total.withColumn("k", F.lit(1)).join(rules.withColumn("k", F.lit(1)), "k").drop("k")


def corpus_summary(pipelines: DataFrame, jobs: DataFrame, *, excerpts: int = 5) -> DataFrame:
    """One row a project: counts of its pipelines and jobs by state, first and last id, rules, and a few unknown excerpts.

    ``pipelines`` has (project, pipeline_id, complete, listing_state, capped), ``jobs`` (project,
    pipeline_id, job_id, state, rule_id, excerpt). Analyzed covers unknown, unreadable covers
    oversized. Each side is read once: counts are conditional, pipelines' states come from one
    grouping of their jobs.
    """
    seen, lost = F.col("state").isin("analyzed", "unknown"), F.col("state").isin("unreadable", "oversized")
    of = jobs.groupBy("project", "pipeline_id").agg(
        F.count("*").alias("jobs"), F.count_if(seen).alias("analyzed_jobs"), F.count_if(lost).alias("unreadable_jobs"), F.bool_or(seen | (F.col("state") == "analysis_error")).alias("any"),
        *[F.count_if(F.col("state") == x).alias(f"{x}_jobs") for x in ("unknown", "oversized", "empty", "analysis_error", "pending")])
    told = pipelines.join(of, ["project", "pipeline_id"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    base = told.groupBy("project").agg(
        F.count("*").alias("pipelines"), F.count_if(F.col("complete")).alias("complete"), F.count_if(~F.col("complete")).alias("pending"), F.count_if(some("analyzed_jobs")).alias("analyzed"), F.count_if(some("unknown_jobs")).alias("unknown"),
        F.count_if(F.col("complete") & ~F.coalesce("any", F.lit(False))).alias("no_logs"), F.count_if((F.col("listing_state") == "unreadable") | some("unreadable_jobs")).alias("unreadable"), F.count_if(F.col("capped")).alias("capped"),
        F.max("pipeline_id").alias("newest"), F.min("pipeline_id").alias("oldest"), *[total(c) for c in ("jobs", "analyzed_jobs", "unreadable_jobs", "unknown_jobs", "oversized_jobs", "empty_jobs", "analysis_error_jobs", "pending_jobs")])
    kept = jobs.join(pipelines.select("project", "pipeline_id"), ["project", "pipeline_id"], "left_semi")
    by = kept.where(seen).groupBy("project", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("pipeline_id").alias("p"))
    rules = by.groupBy("project").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rule_id", "n", "p"))).alias("r")).select("project", F.transform("r", lambda x: F.struct(x.rule_id.alias("rule_id"), x.n.alias("jobs"), x.p.alias("pipelines"))).alias("rules"))
    order = Window.partitionBy("project").orderBy(F.desc("pipeline_id"), F.desc("job_id"))
    few = kept.where("state = 'unknown'").withColumn("k", F.row_number().over(order)).where(F.col("k") <= excerpts)
    shown = few.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("k", "pipeline_id", "job_id", "rule_id", "excerpt"))).alias("u")).select("project", F.transform("u", lambda x: F.struct(x.pipeline_id.alias("pipeline_id"), x.job_id.alias("job_id"), x.rule_id.alias("rule_id"), x.excerpt.alias("excerpt"))).alias("excerpts"))
    return base.join(rules, "project", "left").join(shown, "project", "left")


def corpus_span(pipelines: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row (pipelines, jobs, first_collected, last_seen, checksums): what a corpus covers, and by which rules it was classified.

    ``pipelines`` has (collected_at, last_seen_at), ``jobs`` (rule_checksum, null where none was used).
    Checksums are few, one for each version of the rules; an empty corpus has no times.
    """
    a = pipelines.agg(F.count("*").alias("pipelines"), F.min("collected_at").alias("first_collected"), F.max("last_seen_at").alias("last_seen"))
    b = jobs.agg(F.count("*").alias("jobs"), F.array_sort(F.collect_set("rule_checksum")).alias("checksums"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").select("pipelines", "jobs", "first_collected", "last_seen", "checksums")


#: What was made of a log, how its capture went, and what a rule's name looks like.
STATES, CAPTURES, RULE_NAME = ("classified", "unknown", "analysis_error"), ("captured", "redirect", "forbidden", "oversized"), r"^[a-z0-9_]+(?:\.[a-z0-9_]+)+$"


def public_summary(repositories: DataFrame, runs: DataFrame, jobs: DataFrame, repository: str | None = None) -> DataFrame:
    """One row of counts over a corpus, or over one repository of it, and the rules of its classified and unknown jobs.

    ``repositories`` has (repository), ``runs`` (repository, config_state, truncated, modified, job_state),
    ``jobs`` (repository, classification, log_state, rule_id). Each is read once. ``rules`` lists
    (rule_id, n) by descending n; what is no rule's name is left out of it, not of the counts.
    """
    own = lambda df: df.where(F.col("repository") == repository) if repository is not None else df
    one = lambda df: df.withColumn("k", F.lit(1))
    captured = F.col("config_state") == "captured"
    whole = captured & ~F.coalesce("truncated", F.lit(False))
    a = own(repositories).agg(F.count("*").alias("repositories"))
    b = own(runs).agg(
        F.count("*").alias("runs"), F.count_if(F.col("job_state") == "limited").alias("limited_runs"), F.count_if(captured).alias("configs"), F.count_if(whole).alias("whole_configs"), F.count_if(captured & F.col("truncated")).alias("truncated_configs"),
        F.count_if(captured & F.col("modified")).alias("modified_configs"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("no_config"))
    c = own(jobs).agg(F.count("*").alias("jobs"), *[F.count_if(F.col("classification") == x).alias(x) for x in STATES], *[F.count_if(F.col("log_state") == x).alias(f"{x}_logs") for x in CAPTURES], F.count_if(~F.coalesce(F.col("log_state") == "captured", F.lit(False))).alias("no_log"))
    by = own(jobs).where(F.col("classification").isin("classified", "unknown") & F.col("rule_id").rlike(RULE_NAME)).groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = by.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rule_id", "n"))), lambda x: F.struct(x.rule_id.alias("rule_id"), x.n.alias("n"))).alias("rules"))
    told = one(a).join(one(b), "k").join(one(c), "k").join(one(rules), "k").drop("k")
    return told.withColumn("no_job_runs", F.col("runs") - F.col("jobs"))
