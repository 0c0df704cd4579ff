"""Joins, sampling, retention, upserts and reports that lookups over run records need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as X
from tracewell.operators.lineage import cut

#: Fixed value: words of the lexical similarity.
TOKEN = r"[a-z][a-z0-9_/-]{2,}"


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def unique_suffix(paths: DataFrame, path: str, inventory: DataFrame, known: str) -> DataFrame:
    """(path, known): the only inventory path that is ``path`` or ends with it after a slash.

    Inventory paths are exploded to their suffixes, so the join is an equality, not a scan of pairs.
    """
    inventory = inventory.select(F.col(known).alias("known"))
    parts = F.split("known", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    exploded = inventory.select("known", F.explode(suffixes).alias("suffix")).distinct()
    one = exploded.groupBy("suffix").agg(F.min("known").alias("known"), F.count("*").alias("n")).where("n = 1")
    return paths.join(one, F.col(path) == F.col("suffix")).select(path, "known")


def case_mismatch(paths: DataFrame, path: str, inventory: DataFrame, known: str) -> DataFrame:
    """(path, expected): the only inventory path or folder that equals a prefix of ``path`` but for case."""

    def prefixes(c: str) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    have = inventory.select(F.explode(prefixes(known)).alias("prefix")).distinct()
    want = paths.select(path, F.posexplode(prefixes(path)).alias("depth", "prefix")).distinct()
    by = have.groupBy(F.lower("prefix").alias("folded")).agg(F.collect_set("prefix").alias("spelled"))
    joined = want.join(by, F.lower(F.col("prefix")) == F.col("folded")).where(~F.array_contains("spelled", F.col("prefix")) & (F.size("spelled") == 1))
    return joined.groupBy(path).agg(F.min_by(F.element_at("spelled", 1), "depth").alias("expected"))


def tiered_match(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(job_id, node, confidence): a job's definition by exact name, by numbered expansion, by letters and digits.

    ``jobs`` has (job_id, name, provider), ``nodes`` has (node). A tier counts only if it has one
    candidate; an ambiguous exact tier leaves the job unmatched. Numbered names of GitLab do not
    reach the last tier.
    """
    plain = F.regexp_replace("name", r"\s+(?:\d+/\d+|\[[^\]]*\])$|:\s*\[[^\]]*\]$", "")
    tier = lambda left, right, t, c: jobs.select("job_id", "name", "provider", left.alias("k")).join(nodes.select("node", right.alias("k")), "k").select("job_id", "node", F.lit(t).alias("tier"), F.lit(c).alias("confidence"))
    exact = tier(F.col("name"), F.col("node"), 1, 1.0)
    numbered = tier(F.when(plain != F.col("name"), plain), F.col("node"), 2, 0.9)
    loose_ok = ~((F.col("provider") == "gitlab") & F.col("name").rlike(r"[:\[\]/]"))
    loose = tier(F.when(loose_ok, X.job_name(F.col("name"))), X.job_name(F.col("node")), 3, 0.95)
    every = exact.unionByName(numbered).unionByName(loose).distinct()
    counted = every.withColumn("n", F.count("*").over(Window.partitionBy("job_id", "tier"))).withColumn("first", F.min("tier").over(Window.partitionBy("job_id")))
    return counted.where("tier = first and n = 1").select("job_id", "node", "confidence")


def dotted_lookup(rows: DataFrame, rule: str, table: DataFrame, prefix: str) -> DataFrame:
    """Each rule with the longest entry of ``table`` that equals it or a dotted prefix of it."""
    parts = F.split(rule, r"\.")
    wanted = rows.select(rule, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias(prefix)).distinct()
    return wanted.join(table, prefix).withColumn("rn", F.row_number().over(Window.partitionBy(rule).orderBy(F.desc(F.length(prefix))))).where("rn = 1").drop("rn")


def token_bags(docs: DataFrame, key: str, text: str, scope: str | None = None) -> DataFrame:
    """(key, token, n): the multiset of a text's words, each behind what its row has in ``scope``, if given, so that only words of one scope are equal."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), 0)
    found = docs.select(F.col(key), F.explode(words if scope is None else F.transform(words, lambda w: F.concat_ws("\x1f", F.col(scope), w))).alias("token"))
    return found.groupBy(key, "token").agg(F.count("*").alias("n"))


def multiset_similarity(queries: DataFrame, q: str, docs: DataFrame, d: str) -> DataFrame:
    """(q, d, overlap, total): sizes of multiset intersection and union for pairs that share a token.

    Both sides are ``token_bags``. Token matches are summed by pair before anything else is joined;
    queries are meant to be few against many documents, and every shared token counts.
    """
    sizes_q = queries.groupBy(q).agg(F.sum("n").alias("size_q"))
    sizes_d = docs.groupBy(d).agg(F.sum("n").alias("size_d"))
    met = queries.select(q, "token", F.col("n").alias("nq")).join(docs.select(d, "token", F.col("n").alias("nd")), "token")
    shared = met.groupBy(q, d).agg(F.sum(F.least("nq", "nd")).alias("overlap"))
    joined = shared.join(sizes_q, q).join(sizes_d, d)
    return joined.select(q, d, "overlap", (F.col("size_q") + F.col("size_d") - F.col("overlap")).alias("total"))


def incident_similarity(score: Column, same_fingerprint: Column, same_category: Column) -> Column:
    """1 for the same fingerprint, at least 0.35 within a category, else the lexical likeness."""
    return F.when(same_fingerprint, 1.0).when(same_category, F.greatest(score, F.lit(0.35))).otherwise(score)


def history_score(score: Column, confirmed: Column, same_rule: Column, same_category: Column, boost: Column) -> Column:
    """2 for confirmed entries, else likeness with boosts for rule or category, 1 at most, three decimals."""
    raised = score + F.when(same_rule, 0.25).when(same_category, 0.10).otherwise(0.0) + boost
    return F.when(confirmed, 2.0).otherwise(F.bround(F.least(raised, F.lit(1.0)), 3))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it has not."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_with_children(parents: DataFrame, children: DataFrame, new_parents: DataFrame, new_children: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``new_parents`` in place, and of their children only the new ones: the old ones of the same keys go."""
    kept = children.join(new_parents.select(*keys).distinct(), keys, "left_anti")
    return upsert(parents, new_parents, keys), kept.unionByName(new_children)


def within_capacity(old: DataFrame, new: DataFrame, keys: list[str], limits: dict[str, int]) -> DataFrame:
    """``upsert`` if the result has no more distinct values of each column of ``limits`` than its limit; ValueError if it has.

    The key's own limit is given under ``*``. Counts are made before anything is written.
    """
    out = upsert(old, new, keys)
    found = out.agg(F.count_distinct(F.struct(*keys)).alias("*"), *[F.count_distinct(c).alias(c) for c in limits if c != "*"]).first().asDict()
    over = {c: found[c] for c, n in limits.items() if found[c] > n}
    if over:
        raise ValueError(f"more than the store takes: {over}")
    return out


#: What a person can say about an incident.
OUTCOMES = ("resolved", "rejected", "unresolved")


def with_feedback(incidents: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """``incidents`` (key, resolution_status, resolution and more) with feedback (key, outcome, resolution) put in.

    Outcomes other than OUTCOMES, null ones and those of unknown incidents change nothing; a
    resolution is kept only where the outcome is ``resolved``. A key has one feedback.
    """
    said = feedback.where(F.col("outcome").isin(*OUTCOMES)).select(F.col(key).alias("__k"), "outcome", F.col("resolution").alias("__r"))
    told = incidents.join(said, F.col(key) == F.col("__k"), "left")
    status = F.coalesce("outcome", "resolution_status")
    solved = F.when(F.col("outcome").isNull(), F.col("resolution")).when(F.col("outcome") == "resolved", F.col("__r"))
    return told.select(*[{"resolution_status": status, "resolution": solved}.get(c, F.col(c)).alias(c) for c in incidents.columns])


def insert_new(seen: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key neither ``seen`` nor an equal row has."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def violations(df: DataFrame, checks: dict[str, Column], parents: dict[str, tuple[DataFrame, list[str]]] | None = None, unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(check, n) for each check that rows fail; no rows if all hold.

    ``parents`` are tables with the columns in which each row must meet a row of theirs (a null meets
    none); ``unique`` names columns that no two rows may share, and counts the rows beyond the first.
    """
    said = [_failed(df, checks)] if checks else []
    for name, (parent, keys) in (parents or {}).items():
        said.append(df.join(parent.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n"))
    for name, keys in (unique or {}).items():
        said.append(df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), "n"))
    return reduce(DataFrame.unionByName, said).where("n > 0")


def mapped(rows: DataFrame, distribution: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of a small ``distribution`` of their key, as a map: keys it lacks go.

    A distribution has one row a key and is broadcast as Spark sees fit; it is no store's whole history.
    """
    return rows.join(distribution, key)


def exported(rows: DataFrame, fields: dict[str, int], order: list[str]) -> DataFrame:
    """(line): each row as a line of JSON with what may be kept of it (``scrub.kept``), in order; nulls are written."""
    from tracewell.functions import scrub

    return scrub.kept(rows, fields).orderBy(*order).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def _failed(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return counts.select(F.explode(F.create_map(*[x for k in checks for x in (F.lit(k), F.col(k))])).alias("check", "n")).where("n > 0")


def cluster_report(fingerprints: DataFrame, limit: int | None = 20) -> DataFrame:
    """(fingerprint, category, n, latest): the most frequent failures; ties by fingerprint."""
    report = fingerprints.groupBy("fingerprint", "category").agg(F.count("*").alias("n"), F.max("updated_at").alias("latest"))
    return report.orderBy(F.desc("n"), "fingerprint").limit(limit) if limit else report


def budget_cut(sections: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(key, order, used): sections in order, each cut to what the full lengths before it leave of the budget."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(budget) - before, F.lit(0)).cast("int")
    return sections.withColumn("__left", left).select(key, order, F.expr(f"substring({text}, 1, __left)").alias("used"))


def closure(edges: DataFrame, src: str, dst: str, depth: int = 20) -> DataFrame:
    """(src, dst, depth) of all nodes reachable within ``depth`` steps, with the fewest steps; cycles end by themselves.

    Each round joins the frontier of new pairs with the edges and is written to the shared folder.
    """
    base = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    reached = frontier = base.withColumn("depth", F.lit(1))
    for step in range(2, depth + 1):
        more = frontier.select("src", F.col("dst").alias("mid")).join(base.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(more.join(reached.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier))
    return reached
