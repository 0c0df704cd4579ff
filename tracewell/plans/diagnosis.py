"""Composites: status-aware findings with guidance, row classification, overall status, job sampling, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import rules as R
from tracewell.functions import text as X
from tracewell.operators import changes as C
from tracewell.operators import logs as L

#: Outcomes by class, and what makes a successful job worth a look, in order.
SUCCESS, FAILED = ("success", "succeeded", "passed"), ("failed", "failure", "timed_out")
ACTIVE = ("created", "waiting_for_resource", "preparing", "pending", "running", "scheduled", "canceling")
INTERESTING = ("deploy", "package", "validat", "build", "sonar")
#: A command that runs the tests of an Apex org, alone or after a prompt or a path.
APEX_TESTS = r"(?i)^(?:[$+] *|command: *)?(?:/[a-z0-9_/.-]+/)?(?:sf apex run test|sfdx force:apex:test:run)\b"

#: What to do: by rule first, then by category. (key, title, steps)
ADVICE = (
    ("runner.ssh_executor_unavailable", "The executor's host could not be reached", ("Check that the executor's host accepts SSH from the runner", "Run the job again once it does")),
    ("runner.preparation_failed", "The environment was not prepared", ("Read the runner's own log of the preparation", "Check the executor's disk, network and image")),
    ("runner.image_pull_failed", "The job's image could not be pulled", ("Check the image's name and tag", "Check the registry's credentials and reach")),
    ("runner.reported_system_failure", "The runner reports a failure of its system", ("Ask the runner's owner for the preparation log", "Do not look for the cause in the job's script yet")),
    ("runner.job_timeout", "The job ran longer than it may", ("Find the step that took the time", "Split it or make it faster before the limit is raised")),
    ("artifact.upload_failed", "Artifacts of a failed job were not uploaded", ("Look for the failure before the upload", "Check the artifact paths only if there is none")),
    ("compiler.cs0161", "A code path returns no value", ("Return a value on every path of the named method",)),
    ("rlp.datasync_ambiguous", "A synchronization target is ambiguous", ("List the mappings of the target", "Name the wanted mapping by its identifier")),
    ("salesforce.csv_as_sobject", "A file name was taken for an object", ("Use the object's API name for the object", "Keep the CSV path for the file option")),
    ("git.merge_conflict", "The branches conflict", ("Merge the target branch and resolve the conflicts", "Run the validation again")),
    ("git.merge_approval_required", "An approval is missing", ("Ask a reviewer who may approve",)),
    ("git.merge_status_unresolved", "The merge status does not allow to go on", ("Open the merge request and read its status",)),
    ("salesforce.coverage_failure", "Code coverage is too low", ("Add tests for the named classes",)),
    ("script.exec_format", "A program is for another machine", ("Compare the program's architecture with the runner's", "Check the first line of the script")),
    ("dependency.apt_release_expired", "A package index has expired", ("Point the source at an archive or a current release",)),
    ("script.failure_masked", "A success may hide a failed command", ("Review the expression that drops the exit code", "Compare what was delivered with what was meant")),
    ("job.no_failure_observed", "No failure was seen", ("Compare what was delivered with what was meant",)),
    ("job.insufficient_evidence", "The log does not say why the job ended so", ("Get the complete log", "Run the job again with more output")),
    ("runner_infrastructure_failure", "The runner failed, not the script", ("Ask the runner's owner", "Run the job again once it is well")),
    ("timeout", "Something took too long", ("Find what was waited for", "Check its health before a limit is raised")),
    ("build_failure", "The build failed", ("Open the named source line", "Build it locally with the same versions")),
    ("deployment_failure", "The deployment failed", ("Read the receipt of the deployment", "Validate before it is tried again")),
    ("dependency_failure", "A dependency could not be resolved", ("Check the version and the registry", "Compare the lock file with the manifest")),
    ("merge_conflict", "The branches conflict", ("Merge the target branch and resolve the conflicts",)),
    ("merge_blocked", "The merge is blocked", ("Read what the merge request waits for",)),
    ("test_failure", "Tests failed", ("Run the first failed test locally", "Look at changes since it last passed")),
    ("quality_gate_failure", "The quality gate failed", ("Open the analysis and read the failed conditions",)),
    ("scanner_configuration_failure", "The scanner is not configured", ("Set the named property",)),
    ("scanner_failure", "The scanner failed", ("Read the scanner's log above the error",)),
    ("authentication_failure", "A credential was refused", ("Check whether the credential expired", "Renew it where it is kept")),
    ("authorization_failure", "An account may not do this", ("Check the account's role on the target",)),
    ("artifact_missing", "An artifact is missing", ("Check that the job before it made and kept the artifact",)),
    ("package_path_failure", "A package's path is missing", ("Compare the path with the repository, letter case too",)),
    ("script_input_failure", "A script was given bad input", ("Print the input before it is parsed",)),
    ("script_execution_failure", "A script could not run", ("Read the line above the error",)),
    ("external_api_failure", "A service failed", ("Check the service's status", "Try again with pauses between")),
    ("unknown", "An error without a known cause", ("Read the lines around it",)),
)


def advice(spark: SparkSession) -> DataFrame:
    """(key, title, steps): the small dimension of guidance, keyed by rule and by category."""
    return spark.createDataFrame([(k, t, list(s)) for k, t, s in ADVICE], "key string, title string, steps array<string>")


def subject(rule_id: Column, line: Column) -> Column:
    """What a finding is about, for rules whose line names it; null for others."""
    named = lambda p, g=1: F.nullif(F.trim(F.regexp_extract(line, p, g)), F.lit(""))
    part = F.coalesce(named(L.TABBED), named(L.SPACED, 2))
    return (
        F.when(rule_id == "salesforce.csv_as_sobject", named(r"(?i)unable to find object: *([a-z_][a-z0-9_]*\.csv)"))
        .when(rule_id == "rlp.datasync_ambiguous", named(r"^ *[0-9]+ *\| *([^|]+?) *\|"))
        .when(rule_id.isin("salesforce.apex_compile", *[r for _, _, r in L.COMPONENT_RULES], L.COMPONENT_ELSE), part)
    )


def findings(jobs: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(job_id, rule_id, category, severity, confidence, title, steps, evidence, line, masking) from jobs (job_id, status, conclusion, failure_reason, log).

    Logs are redacted before they are read. A failed job's best signal is an observed error, of
    unknown confidence where its rule or category names no cause. A successful job's is a likely
    warning, and script.failure_masked if a command (of the log, or of ``configured``: job_id,
    command) drops its exit code, which ``masking`` then shows. Where the runner reports that its
    system failed, only signals of the runner count. Without a signal a success has no failure
    observed, of unknown confidence if the log is empty, and other outcomes too little evidence, an
    error if the job failed. A job with a null id has no findings.
    """
    known = jobs.where("job_id is not null")
    logged = known.select("job_id", "status", "conclusion", "failure_reason", (F.coalesce("log", F.lit("")) != "").alias("logged"))
    return judged(logged, facts(L.diagnosed_lines(known, masked=True)), configured)


def facts(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, any, of_runner, masking) of ``diagnosed`` lines: a log's best signal, its runner's best, the first command that drops its exit code."""
    upto = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("tests", F.last(F.when(F.col("text").rlike(APEX_TESTS), F.col("text")), ignorenulls=True).over(upto))
    told, runner = F.col("v").isNotNull(), F.col("v.rule_id").startswith("runner.")
    what, order = F.struct("v.rule_id", "v.category", "text", "line", "tests"), F.struct("v.priority", -F.col("idx"))
    hides = F.col("text").rlike(r"^[$+] ") & C.hides_exit_code(F.col("text"))
    return lines.groupBy(key).agg(
        F.max_by(F.when(told, what), F.when(told, order)).alias("any"), F.max_by(F.when(told & runner, what), F.when(told & runner, order)).alias("of_runner"),
        F.min_by(F.when(hides, F.col("text")), F.when(hides, F.col("idx"))).alias("masking"),
    )


def judged(jobs: DataFrame, of_logs: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """``findings`` of jobs (job_id, status, conclusion, failure_reason, logged) from the ``facts`` of their logs, keyed by job_id."""
    spark = jobs.sparkSession
    joined = jobs.select("job_id", X.outcome(F.col("status"), F.col("conclusion")).alias("outcome"), "failure_reason", "logged").join(of_logs, "job_id", "left")
    if configured is not None:
        plain = F.regexp_replace(F.trim("command"), r"^(?:- +|(?:before_|after_)?script: *)", "")
        dropped = configured.where(~F.trim("command").startswith("#") & C.hides_exit_code(plain)).groupBy("job_id").agg(F.min("command").alias("of_config"))
        joined = joined.join(dropped, "job_id", "left").withColumn("masking", F.coalesce("masking", "of_config"))
    good = F.coalesce(F.col("outcome").isin(*SUCCESS), F.lit(False))
    failed = F.coalesce(F.col("outcome").isin(*FAILED), F.lit(False))
    system = F.coalesce(F.col("failure_reason") == "runner_system_failure", F.lit(False)) & ~good
    s = joined.withColumn("s", F.when(system, F.col("of_runner")).otherwise(F.col("any"))).withColumn("good", good).withColumn("failed", failed).withColumn("system", system)
    none, masked = F.col("s").isNull(), F.col("good") & F.col("masking").isNotNull() & F.col("s").isNotNull()
    rule = F.when(none & F.col("system"), "runner.reported_system_failure").when(none & F.col("good"), "job.no_failure_observed").when(none, "job.insufficient_evidence").when(masked, "script.failure_masked").otherwise(F.col("s.rule_id"))
    category = F.when(none & F.col("system"), "runner_infrastructure_failure").when(none & F.col("good"), "no_failure_observed").when(none, "unknown").when(masked, "script_exit_masking").otherwise(F.col("s.category"))
    severity = F.when(none & (F.col("system") | F.col("failed")), "error").when(none, "info").when(F.col("good"), "warning").otherwise("error")
    vague = (F.col("s.category") == "unknown") | F.col("s.rule_id").isin(*R.INCOMPLETE)
    confidence = F.when(none, F.when(F.col("good") & F.col("logged"), "observed").otherwise("unknown")).when(F.col("good"), "likely").when(vague, "unknown").otherwise("observed")
    out = s.select("job_id", rule.alias("rule_id"), category.alias("category"), severity.alias("severity"), confidence.alias("confidence"), F.col("s.text").alias("evidence"), F.col("s.line").alias("line"), F.when(masked, F.col("masking")).alias("masking"), F.col("s.rule_id").alias("cause"), "good", F.col("s.tests").alias("tests"))
    small = F.broadcast(advice(spark))
    by_rule = small.select(F.col("key").alias("rule_id"), F.col("title").alias("rt"), F.col("steps").alias("rs"))
    by_kind = small.select(F.col("key").alias("category"), F.col("title").alias("ct"), F.col("steps").alias("cs"))
    unknown = next((t, s) for k, t, s in ADVICE if k == "unknown")
    guided = out.join(by_rule, "rule_id", "left").join(by_kind, "category", "left")
    title = F.coalesce("rt", "ct", F.lit(unknown[0]))
    title = F.when((F.col("cause") == "runner.job_timeout") & F.col("tests").isNotNull(), F.lit("Apex tests ran longer than the job may")).otherwise(title)
    about = subject(F.col("cause"), F.col("evidence"))
    title = F.when(about.isNotNull(), F.concat(title, F.lit(": "), about)).otherwise(title)
    title = F.when(F.col("good") & F.col("cause").isNotNull() & F.col("masking").isNull(), F.concat(F.lit("In a successful job: "), title)).otherwise(title)
    return guided.select("job_id", "rule_id", "category", "severity", "confidence", title.alias("title"), F.coalesce("rs", "cs", F.array(*map(F.lit, unknown[1]))).alias("steps"), "evidence", "line", "masking")


def classified(rows: DataFrame, key: str, text: str, done: str = "classified") -> DataFrame:
    """(key, state, rule_id, category) of texts that are read as logs of failed jobs.

    ``state`` is ``unknown`` where the finding's confidence or category is, else ``done``. This is the
    one classification of all stores; classifying again after the rules changed is the same on what
    was stored, and ``relational.upsert`` puts it in place.
    """
    null = F.lit(None).cast("string")
    jobs = rows.select(F.col(key).cast("string").alias("job_id"), F.lit("failed").alias("status"), null.alias("conclusion"), null.alias("failure_reason"), F.col(text).alias("log"))
    found = states(findings(jobs), done)
    return found.select(F.col("job_id").cast(rows.schema[key].dataType).alias(key), "state", "rule_id", "category")


def states(found: DataFrame, done: str = "classified") -> DataFrame:
    """``findings`` with ``state``."""
    return found.withColumn("state", F.when((F.col("confidence") == "unknown") | (F.col("category") == "unknown"), "unknown").otherwise(done))


def reclassified(stored: DataFrame, key: str, text: str, *, done: str = "classified") -> DataFrame:
    """``stored`` (key, text, state, rule_id, category, rule_checksum and more) with rows of other rules than now classified again."""
    now = R.checksum()
    old = stored.where(~F.col("rule_checksum").eqNullSafe(F.lit(now)))
    found = classified(old, key, text, done).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("state", "rule_id", "category")])
    told = stored.join(found, F.col(key) == F.col("__k"), "left")
    new = F.col("__k").isNotNull()
    own = {c: F.when(new, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("state", "rule_id", "category")} | {"rule_checksum": F.when(new, F.lit(now)).otherwise(F.col("rule_checksum"))}
    return told.select(*[own.get(c, F.col(c)).alias(c) for c in stored.columns])


def diagnosis_confidence(priority: Column, category: Column) -> Column:
    """0.96 for a specific diagnostic, 0.42 for a generic one, 0.9 for a success, 0.3 for nothing."""
    return F.when(priority.isNotNull() & (category != "unknown"), 0.96).when(priority.isNotNull(), 0.42).when(category == "no_failure_observed", 0.9).otherwise(0.3)


def diagnoses(logs: DataFrame, key: str = "job_id", log: str = "log", *, citations: int = 3) -> DataFrame:
    """(key, category, confidence, cited): what a log alone says, and the chunks of its best signals, best first.

    ``cited`` has (chunk_id, line, text): of the three best signals the first of each chunk; a log
    without a signal cites its first chunk. A log without lines is of category unknown.
    """
    return diagnoses_of(logs.select(key), L.diagnosed_lines(logs, key, log, masked=True), key, citations=citations)


def diagnoses_of(logs: DataFrame, lines: DataFrame, key: str = "job_id", *, citations: int = 3) -> DataFrame:
    """``diagnoses`` of logs (key) from their ``diagnosed`` lines."""
    found = L.chunks(lines, key)
    every = found.select(key, "rank", "chunk_id", "line_start", F.explode_outer("signals").alias("s"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last("s.priority"), "line_start", "s.idx"))
    top = every.withColumn("n", best).where(F.when(F.col("s").isNull(), F.col("n") == 1).otherwise(F.col("n") <= citations))
    one = top.withColumn("of_chunk", F.row_number().over(Window.partitionBy(key, "chunk_id").orderBy("n"))).where("of_chunk = 1")
    cited_ = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", "chunk_id", "s.line", "s.text"))).alias("c"), F.max(F.struct("s.priority")).alias("p"))
    told = logs.select(key).join(L.categories(lines, key), key, "left").join(cited_, key, "left")
    category = F.coalesce("category", F.lit("unknown"))
    return told.select(key, category.alias("category"), diagnosis_confidence(F.col("p.priority"), category).alias("confidence"), F.transform("c", lambda x: F.struct(x.chunk_id.alias("chunk_id"), x.line.alias("line"), x.text.alias("text"))).alias("cited"))


def sample_jobs(jobs: DataFrame, budget: int = 8, successful: int = 3) -> DataFrame:
    """(run_id, job_id, place) of the jobs to look at in each run: ``budget`` at most.

    ``jobs`` has (run_id, job_id, name, stage, status, conclusion, selected). The selected job comes
    first, then all failed ones by id, then a few successful ones: those whose name or stage holds
    the earliest of INTERESTING, by name and id.
    """
    outcome = X.outcome(F.col("status"), F.col("conclusion"))
    group = F.when(F.col("selected"), 0).when(outcome.isin(*FAILED), 1).when(outcome.isin(*SUCCESS), 2)
    said = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("stage", F.lit(""))))
    word = F.lit(len(INTERESTING))
    for i, w in reversed(list(enumerate(INTERESTING))):
        word = F.when(said.contains(w), i).otherwise(word)
    order = ["grp", F.when(F.col("grp") == 2, word), F.when(F.col("grp") == 2, F.col("name")), "job_id"]
    ranked = jobs.withColumn("grp", group).where("grp is not null").withColumn("in_group", F.row_number().over(Window.partitionBy("run_id", "grp").orderBy(*order[1:])))
    kept = ranked.where((F.col("grp") < 2) | (F.col("in_group") <= successful))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("grp", "in_group"))).where(F.col("place") <= budget).select("run_id", "job_id", "place")


def overall_status(runs: DataFrame, found: DataFrame) -> DataFrame:
    """(run_id, status): configuration_only, failed, in_progress, passed or warning.

    ``runs`` has (run_id, status, conclusion, partial); a null status means that there is no run but
    its configuration. ``found`` has (run_id, severity). A run has passed if it succeeded, was seen
    as a whole and nothing but infos was found; what is none of the others is a warning.
    """
    loud = found.groupBy("run_id").agg(F.bool_or(F.col("severity") != "info").alias("loud"))
    outcome = X.outcome(F.col("status"), F.col("conclusion"))
    clean = ~F.coalesce("partial", F.lit(False)) & ~F.coalesce("loud", F.lit(False))
    status = F.when(F.col("status").isNull(), "configuration_only").when(outcome.isin(*FAILED), "failed").when(outcome.isin(*ACTIVE), "in_progress").when(outcome.isin(*SUCCESS) & clean, "passed").otherwise("warning")
    return runs.join(loud, "run_id", "left").select("run_id", status.alias("status"))


def cited(diagnoses_: DataFrame, cited_col: str, allowed_col: str) -> DataFrame:
    """Diagnoses all of whose cited ids are allowed."""
    return diagnoses_.where(F.size(F.array_except(cited_col, allowed_col)) == 0)
