"""CI graphs: includes, inheritance and references, as joins over the leaves of configuration files.

A mapping is held as its leaves, (path of keys, value): merging mappings deeply is then taking, for
each path, the value of the latest one. What is later is told by a place: a root's files, or a job's
ancestors, are numbered in the order in which a walk leaves them for the last time. Each has one
place a root, however many paths lead to it, so rows grow with nodes and edges and not with paths.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.lineage import cut

#: Depth of includes and of inheritance, documents and characters of a file.
DEPTH, PARENTS, DOCUMENTS, CHARACTERS = 20, 11, 20, 1_000_000
#: References that may lead to each other in a script.
REFERENCES = 10
#: Top-level keys that are no jobs.
RESERVED = ("stages", "variables", "include", "default", "workflow", "image", "services", "before_script", "after_script", "cache", "pages", "spec")
_LEAVES = "config string, path string, problem string, job string, at array<string>, value string, line_start int, line_end int, ordinal int"


def _plain(node, yaml):
    """A value as JSON can hold it; a reference keeps its tag."""
    if isinstance(node, yaml.SequenceNode):
        found = [_plain(x, yaml) for x in node.value]
        return {"!reference": found} if node.tag == "!reference" else found
    if isinstance(node, yaml.MappingNode):
        return {str(k.value): _plain(v, yaml) for k, v in node.value}
    return None if node.tag == "tag:yaml.org,2002:null" else node.value


def _leaves(node, yaml, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    if isinstance(node, yaml.MappingNode) and node.value and len(at) < DEPTH:
        for key, value in node.value:
            yield from _leaves(value, yaml, (*at, str(key.value)))
    else:
        yield at, _plain(node, yaml)


def leaves(files: DataFrame) -> DataFrame:
    """(config, path, problem, job, at, value, line_start, line_end, ordinal) of files (config, path, content).

    ``job`` is a top-level key, ``at`` the path of keys below it and ``value`` JSON; lines are those of
    the key's whole entry. A file that is no YAML, too long or of too many documents has one row with
    its ``problem``; documents that are no mappings have none. ``ordinal`` counts a file's leaves.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for config, path, text in zip(batch["config"], batch["path"], batch["content"]):
                fail = lambda why: rows.append((config, path, why, None, None, None, None, None, 0))  # noqa: B023, E731
                if text is None or len(text) > CHARACTERS:
                    fail("unreadable" if text is None else "too long")
                    continue
                try:
                    found = list(yaml.compose_all(text))
                except (yaml.YAMLError, RecursionError):
                    fail("invalid YAML")
                    continue
                if len(found) > DOCUMENTS:
                    fail("too many documents")
                    continue
                last, n = len(text.splitlines()), 0
                for document in found:
                    if not isinstance(document, yaml.MappingNode):
                        continue
                    starts = [k.start_mark.line + 1 for k, _ in document.value] + [last + 1]
                    for i, (key, value) in enumerate(document.value):
                        for at, leaf in _leaves(value, yaml):
                            rows.append((config, path, None, str(key.value), list(at), json.dumps(leaf), starts[i], max(starts[i], starts[i + 1] - 1), n))
                            n += 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _LEAVES.split(", ")])

    return files.select("config", "path", "content").mapInPandas(task, _LEAVES)


def reached(roots: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """What roots (config, root) reach over edges (config, src, dst) in ``depth`` steps at most, and the edges beyond.

    (config, root, node, steps) has a row a node, with its fewest steps; (config, root, src, dst) are
    the edges to nodes that are more than ``depth`` away.
    """
    now = cut(roots.select("config", "root", F.col("root").alias("node")).distinct().withColumn("steps", F.lit(0)))
    every = now
    step = lambda: now.join(edges.select("config", F.col("src").alias("node"), "dst"), ["config", "node"])
    new = lambda: step().select("config", "root", "node", "dst").join(every.select("config", "root", F.col("node").alias("dst")), ["config", "root", "dst"], "left_anti")
    for k in range(1, depth + 1):
        now = cut(new().select("config", "root", F.col("dst").alias("node")).distinct().withColumn("steps", F.lit(k)))
        if now.isEmpty():
            break
        every = cut(every.unionByName(now))
    return every, new().select("config", "root", F.col("node").alias("src"), "dst").distinct()


def ordered(roots: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes in the order in which a walk leaves them for the last time, once a root; edges back; edges too deep.

    ``edges`` has (config, src, ordinal, dst), followed by ascending ordinal, what is included before
    what includes it. Where a node is met again only its last place matters to a merge in which later
    values win, so each root has a row a node, however many paths lead there: (config, root, node,
    place), the last place the highest, the root's own. The last place is the first of the walk backwards, that
    is the least path of negative ordinals; least paths follow from their nodes' least paths, round by
    round. Edges back, (config, root, src, dst), lead to a node above on that path: they close a cycle.
    """
    nodes, deep = reached(roots, edges, depth)
    inside = nodes.select("config", "root", F.col("node").alias("dst"))
    own = cut(nodes.select("config", "root", F.col("node").alias("src")).join(edges, ["config", "src"]).join(inside, ["config", "root", "dst"]).groupBy("config", "root", "src", "dst").agg(F.max("ordinal").alias("ordinal")))
    keys = ["config", "root", "node"]
    start = F.struct(F.array().cast("array<int>").alias("path"), F.array("root").alias("above"))
    known = cut(nodes.where("node = root").select(*keys, start.alias("p")))
    fresh = known
    while not fresh.isEmpty():
        led = fresh.select("config", "root", F.col("node").alias("src"), "p").join(own, ["config", "root", "src"]).where(~F.array_contains("p.above", F.col("dst")))
        path = F.struct(F.concat("p.path", F.array(-F.col("ordinal"))).alias("path"), F.concat("p.above", F.array("dst")).alias("above"))
        better = led.select("config", "root", F.col("dst").alias("node"), path.alias("q")).groupBy(*keys).agg(F.min("q").alias("q"))
        both = cut(known.join(better, keys, "full").withColumn("new", F.col("q").isNotNull() & (F.col("p").isNull() | (F.col("q.path") < F.col("p.path")))))
        fresh = both.where("new").select(*keys, F.col("q").alias("p"))
        known = both.select(*keys, F.when(F.col("new"), F.col("q")).otherwise(F.col("p")).alias("p"))
    place = F.row_number().over(Window.partitionBy("config", "root").orderBy(F.desc("p.path")))
    back = known.select("config", "root", F.col("node").alias("src"), "p.above").join(own, ["config", "root", "src"]).where(F.array_contains("above", F.col("dst")))
    return known.select(*keys, place.alias("place")), back.select("config", "root", "src", "dst"), deep


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of leaves (keys, at, place, ordinal and more) those that a deep merge in order of place keeps.

    Of equal paths the last stays. A leaf goes if a later one replaces a mapping above it, or puts a
    mapping in its place.
    """
    order = F.struct("place", "ordinal")
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "at").orderBy(F.desc("place"), F.desc("ordinal")))).where("__n = 1").drop("__n")
    upto = F.transform(F.sequence(F.lit(0), F.size("at")), lambda k: F.slice("at", F.lit(1), k))
    marks = last.select(*keys, order.alias("__o"), F.col("at").alias("__whole"), F.explode(upto).alias("__at"))
    exact = F.col("__at") == F.col("__whole")
    tops = marks.groupBy(*keys, "__at").agg(F.max(F.when(exact, F.col("__o"))).alias("__set"), F.max(F.when(~exact, F.col("__o"))).alias("__below"))
    own = last.withColumn("__p", F.explode(upto)).join(tops.withColumnRenamed("__at", "__p"), [*keys, "__p"])
    replaced = F.when(F.col("__p") == F.col("at"), F.col("__below") > order).otherwise(F.col("__set") > order)
    gone = own.groupBy(*keys, "at").agg(F.bool_or(F.coalesce(replaced, F.lit(False))).alias("__gone"))
    return last.join(gone.where("not __gone").drop("__gone"), [*keys, "at"])


def _strings(value: Column) -> Column:
    """A JSON string, list of strings, or list of mappings with a ``job``, as strings."""
    many = F.from_json(value, "array<string>")
    named = F.transform(many, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.job")).otherwise(x))
    return F.filter(F.when(value.startswith("["), named).when(value.startswith('"'), F.array(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0])).otherwise(F.array().cast("array<string>")), lambda x: x.isNotNull())


def includes(found: DataFrame) -> DataFrame:
    """(config, src, ordinal, dst) of the local includes in ``leaves``: plain paths, or mappings with ``local``."""
    value = F.col("value")
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"))
    own = found.where("job = 'include' and (size(at) = 0 or at = array('local'))")
    rows = own.select("config", F.col("path").alias("src"), "ordinal", F.posexplode(listed).alias("i", "x"))
    local = F.when(F.col("x").startswith("{"), F.get_json_object("x", "$.local")).otherwise(F.col("x"))
    return rows.select("config", "src", (F.col("ordinal") * 1000 + F.col("i")).cast("int").alias("ordinal"), F.regexp_replace(F.trim(local), r"^(?:\./|/)+", "").alias("dst")).where("dst <> ''")


def ci_graph(files: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and notes of CI configurations: ``files`` (config, path, content), ``roots`` (config, root).

    Jobs are (config, key, stage, needs, script, path, line_start, line_end, inherited): effective
    values after includes and ``extends``, the place that the script (else the job) comes from, and
    the jobs it inherits from. Notes are (config, note, what): an include that is missing, a cycle or too deep, a
    file that could not be read, a parent that is missing, a cycle or too deep, a reference to nothing, in a circle or too deep.
    Hidden jobs (with a dot) and RESERVED keys are no jobs.
    """
    found = cut(leaves(files))
    links = cut(includes(found.where("problem is null")))
    walked, back, deep = ordered(roots, links, DEPTH)
    walked = cut(walked)
    used = walked.select("config", F.col("node").alias("path"), "place")
    known = found.select("config", "path").distinct().unionByName(files.select("config", "path")).distinct()
    notes = [
        back.select("config", F.lit("include cycle ignored").alias("note"), F.col("dst").alias("what")),
        deep.select("config", F.lit("include too deep").alias("note"), F.col("dst").alias("what")),
        used.select("config", "path").distinct().join(known, ["config", "path"], "left_anti").select("config", F.lit("include not found").alias("note"), F.col("path").alias("what")),
        found.where("problem is not null").join(used.select("config", "path").distinct(), ["config", "path"], "left_semi").select("config", F.concat(F.lit("source not analyzed: "), "problem").alias("note"), F.col("path").alias("what")),
    ]
    own = cut(merged(found.where("problem is null").join(used, ["config", "path"]), ["config", "job"]))
    parents = own.where("at = array('extends')").select("config", F.col("job").alias("src"), F.posexplode(_strings(F.col("value"))).alias("ordinal", "dst"))
    jobs = own.where("size(at) > 0").select("config", "job").distinct()
    heirs, rings, far = ordered(jobs.select("config", F.col("job").alias("root")), parents, PARENTS)
    notes.append(rings.select("config", F.lit("cyclic inheritance").alias("note"), F.col("root").alias("what")))
    notes.append(far.select("config", F.lit("inheritance too deep").alias("note"), F.col("root").alias("what")))
    notes.append(parents.join(jobs.select("config", F.col("job").alias("dst")), ["config", "dst"], "left_anti").select("config", F.lit("missing parent").alias("note"), F.col("dst").alias("what")))
    given = own.drop("place").withColumnRenamed("job", "node")
    effective = merged(heirs.select("config", F.col("root").alias("job"), "node", "place").join(given, ["config", "node"]), ["config", "job"])
    effective = cut(effective)
    scripts, lost = _scripts(effective)
    notes.append(lost)
    one = lambda name: F.max(F.when(F.col("at") == F.array(F.lit(name)), F.col("value")))
    where = F.struct("path", "line_start", "line_end")
    shown = effective.where(~F.col("job").isin(*RESERVED) & ~F.col("job").startswith(".")).groupBy("config", F.col("job").alias("key")).agg(
        one("stage").alias("stage"), one("needs").alias("needs"),
        F.max(F.when(F.col("at") == F.array(F.lit("script")), where)).alias("of_script"), F.max_by(F.when(F.col("node") == F.col("job"), where), F.when(F.col("node") == F.col("job"), F.struct("place", "ordinal"))).alias("of_job"),
        F.any_value(where).alias("any"),
    )
    above = heirs.where("root <> node").groupBy("config", F.col("root").alias("key")).agg(F.array_sort(F.collect_set("node")).alias("inherited"))
    told = shown.join(scripts.withColumnRenamed("job", "key"), ["config", "key"], "left").join(above, ["config", "key"], "left")
    place = F.coalesce("of_script", "of_job", "any")
    out = told.select(
        "config", "key", F.get(_strings(F.col("stage")), 0).alias("stage"), F.coalesce(_strings(F.col("needs")), F.array().cast("array<string>")).alias("needs"),
        F.coalesce("script", F.array().cast("array<string>")).alias("script"), place.path.alias("path"), place.line_start.alias("line_start"), place.line_end.alias("line_end"),
        F.coalesce("inherited", F.array().cast("array<string>")).alias("inherited"),
    )
    every = notes[0]
    for more in notes[1:]:
        every = every.unionByName(more)
    return out, every.distinct()


def _scripts(effective: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(config, job, script) with references put in, and notes of those that lead nowhere, in a circle, or too deep."""
    listed = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>"))
    fields = effective.where("size(at) = 1").select("config", "job", F.col("at")[0].alias("field"), F.posexplode(listed).alias("i", "x"))
    target = F.when(F.col("x").startswith('{"!reference"'), F.from_json(F.get_json_object("x", "$['!reference']"), "array<string>"))
    there = cut(fields.select(F.col("config").alias("c"), F.array("job", "field").alias("t"), F.col("i").alias("k"), F.col("x").alias("y")))
    now = fields.where("field = 'script'").select("config", "job", F.array("i").alias("place"), F.array(F.concat_ws(":", "job", F.lit("script"))).alias("above"), "x")
    noted = lambda rows, note: rows.select("config", F.lit(note).alias("note"), F.concat_ws(":", "to").alias("what"))
    lost, done = [], []
    for _ in range(REFERENCES):
        named = cut(now.withColumn("to", target))
        done.append(named.where("to is null").select("config", "job", "place", "x"))
        refs = named.where("to is not null")
        if refs.isEmpty():
            break
        circle = F.array_contains("above", F.concat_ws(":", "to"))
        lost.append(noted(refs.where(circle), "reference in a circle"))
        met = refs.where(~circle).join(there, (F.col("config") == F.col("c")) & (F.slice("to", 1, 2) == F.col("t")), "left")
        lost.append(noted(met.where("t is null"), "reference to nothing"))
        now = met.where("t is not null").select("config", "job", F.concat("place", F.array("k")).alias("place"), F.concat("above", F.array(F.concat_ws(":", "to"))).alias("above"), F.col("y").alias("x"))
    else:
        rest = cut(now.withColumn("to", target))
        done.append(rest.where("to is null").select("config", "job", "place", "x"))
        lost.append(noted(rest.where("to is not null"), "reference too deep"))
    lines = reduce(DataFrame.unionByName, done).where("x is not null")
    in_order = F.sort_array(F.collect_list(F.struct("place", "x")))
    scripts = lines.groupBy("config", "job").agg(F.transform(in_order, lambda s: s.x).alias("script"))
    none = effective.limit(0).select("config", F.lit("").alias("note"), F.lit("").alias("what"))
    return scripts, reduce(DataFrame.unionByName, lost, none)
