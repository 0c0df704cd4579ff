"""Change lists: added lines of diffs, paths after a change, commands that hide their exit code, path risks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.relational import case_mismatch

#: A hunk's header, lines of a diff that are no content, quoted shell text, what drops an exit code.
HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"
NO_CONTENT = r"^(?:\+\+\+|---|diff |index |\\)"
QUOTED = r"\"(?:\\.|[^\"\\])*\"|'[^']*'"
MASKED = r"(?i)\|\|\s*(?:true\b|:(?:\s|$))|;\s*exit\s+0\b"
PRINTING = r"(?i)^(?:(?:echo|printf|Write-Host|Write-Output)\b|#)"


def added_lines(changes: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, idx, line, text) of each line that a unified diff adds.

    ``line`` is its number in the new file, null before the first hunk: the hunk's start plus the
    kept and added lines since. ``idx`` is its place in the diff, from 0. A null diff has no lines.
    """
    rows = changes.select(key, F.posexplode(F.split(F.col(diff), r"\r?\n")).alias("idx", "raw"))
    start = F.regexp_extract("raw", HUNK, 1)
    content = ~F.col("raw").rlike(NO_CONTENT)
    marked = rows.withColumn("start", F.when(start != "", start.cast("int"))).withColumn("new", (content & F.col("raw").rlike(r"^[+ ]")).cast("int"))
    upto = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    hunks = marked.withColumn("hunk", F.count("start").over(upto)).withColumn("first", F.last("start", ignorenulls=True).over(upto))
    before = Window.partitionBy(key, "hunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    counted = hunks.withColumn("line", F.col("first") + F.coalesce(F.sum("new").over(before), F.lit(0)).cast("int"))
    return counted.where(content & F.col("raw").startswith("+")).select(key, "idx", "line", F.expr("substring(raw, 2)").alias("text"))


def literal_path(path: Column) -> Column:
    """A relative path without variables, patterns or steps upward, ``/`` between its parts; null for any other."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^\./", ""), r"/+$", "")
    bad = (plain == "") | plain.rlike(r"^/|[$*?{}\[\]:#\s]|(^|/)\.{0,2}(/|$)")
    return F.when(~bad, plain)


def current_paths(known: DataFrame, changes: DataFrame) -> DataFrame:
    """(path): known paths less deleted and renamed ones, and what the changes leave behind.

    ``known`` has (path); ``changes`` has (old_path, new_path, deleted_file, renamed_file).
    """
    gone = changes.where("deleted_file or renamed_file").select(literal_path(F.coalesce("old_path", "new_path")).alias("path"))
    there = changes.where("not coalesce(deleted_file, false)").select(literal_path(F.col("new_path")).alias("path"))
    kept = known.select(literal_path(F.col("path")).alias("path")).join(gone, "path", "left_anti")
    return kept.unionByName(there).where("path is not null").distinct()


#: Names of variables that hold a required folder, options that name one, and where jobs have commands.
REQUIRED = re.compile(r"(?i)(?:package|migration)[_\w]*(?:path|folder|dir)")
OPTIONS = ("--package", "--package-path", "--package-folder")
COMMANDS = ("script", "before_script", "after_script", "run")
#: States of the shell lexer: between words, in a bare word, in single and in double quotes.
OUTSIDE, BARE, SINGLE, DOUBLE = range(4)


def shell_words(line: str) -> list[str] | None:
    """The words of one command, without their quotes; None for what is more than one plain command.

    Operators, substitutions and comments outside quotes make it more; an open quote does too.
    """
    words: list[str] = []
    state, held = OUTSIDE, ""
    at = 0
    while at < len(line):
        c = line[at]
        at += 1
        if state == SINGLE or state == DOUBLE:
            if c == ("'" if state == SINGLE else '"'):
                state = BARE
            elif c == "\\" and state == DOUBLE and line[at : at + 1] in ('"', "\\", "$", "`"):
                held, at = held + line[at], at + 1
            else:
                held += c
        elif c in " \t":
            if state == BARE:
                words.append(held)
            state, held = OUTSIDE, ""
        elif c in ";&|`()<>" or c == "#" and state == OUTSIDE:
            return None
        elif c in "'\"":
            state = SINGLE if c == "'" else DOUBLE
        else:
            state, held = BARE, held + (line[at : at + 1] if c == "\\" else c)
            at += c == "\\"
    if state in (SINGLE, DOUBLE):
        return None
    return [*words, held] if state == BARE else words


def _inputs(words: list[str]) -> Iterator[str]:
    """What a command needs to be there: the folder it changes to, packages by option."""
    if len(words) > 1 and words[0] == "cd":
        yield words[1]
    for word, after in zip(words, [*words[1:], ""]):
        name, sign, value = word.partition("=")
        if name in OPTIONS:
            yield value if sign else after


def _named(node, yaml, top: bool = True) -> Iterator[tuple[str, int]]:
    """(text, line) of local includes, package variables and inputs of commands below a mapping or list."""
    if isinstance(node, yaml.SequenceNode):
        for item in node.value:
            yield from _named(item, yaml, False)
    if not isinstance(node, yaml.MappingNode):
        return
    for key, value in node.value:
        name = key.value if isinstance(key, yaml.ScalarNode) else None
        many = value.value if isinstance(value, yaml.SequenceNode) else [value]
        plain = [x for x in many if isinstance(x, yaml.ScalarNode)]
        if name == "include" and top:
            yield from ((x.value, x.start_mark.line + 1) for x in plain)
            for item in many:
                own = {k.value: v for k, v in item.value if isinstance(k, yaml.ScalarNode)} if isinstance(item, yaml.MappingNode) else {}
                if isinstance(own.get("local"), yaml.ScalarNode) and not own.keys() & {"project", "remote", "rules"}:
                    yield own["local"].value, own["local"].start_mark.line + 1
        elif name == "variables" and isinstance(value, yaml.MappingNode):
            yield from ((v.value, v.start_mark.line + 1) for k, v in value.value if isinstance(v, yaml.ScalarNode) and REQUIRED.fullmatch(str(k.value)))
        elif name in COMMANDS:
            for x in plain:
                if x.style != ">":  # folded lines have no lines of their own
                    for k, line in enumerate(x.value.split("\n")):
                        yield from ((found, x.start_mark.line + 1 + k + (x.style == "|")) for found in _inputs(shell_words(line) or []))
        yield from _named(value, yaml, False)


def ci_references(configs: DataFrame) -> DataFrame:
    """(path, referenced, line) of the literal repository paths that CI files (path, content) require, each once, at its first line.

    Those are local includes without conditions, variables named for a package folder, and what a plain
    command changes to or names as its package. A file that is no YAML, or nested too deeply, names none.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                try:
                    found = [x for d in yaml.compose_all(text or "") for x in _named(d, yaml)]
                except (yaml.YAMLError, RecursionError):
                    continue
                rows += [(path, referenced, line) for referenced, line in found]
            yield pd.DataFrame(rows, columns=["path", "referenced", "line"])

    named = configs.select("path", "content").mapInPandas(task, "path string, referenced string, line int")
    literal = named.select("path", literal_path(F.col("referenced")).alias("referenced"), "line").where("referenced is not null")
    return literal.groupBy("path", "referenced").agg(F.min("line").alias("line"))


def hides_exit_code(command: Column) -> Column:
    """Whether a shell command, outside quotes and comments, ends in success whatever happens before."""
    plain = F.trim(F.regexp_replace(command, r"^[$+] ", ""))
    bare = F.element_at(F.split(F.regexp_replace(plain, QUOTED, ""), "#"), 1)
    return F.coalesce(~plain.rlike(PRINTING) & bare.rlike(MASKED), F.lit(False))


def change_risks(changes: DataFrame, known: DataFrame, references: DataFrame) -> DataFrame:
    """(rule_id, path, referenced, expected): paths a change spells otherwise than the repository, or can't find.

    ``changes`` as in ``current_paths``, ``known`` has (path), ``references`` has (path, referenced), as
    ``ci_references`` finds them: literal inputs that changed CI files name. A rename that only changes case is meant. What is
    missing is reported as unverified, as the inventory may not be whole. Every lookup is an
    equality join on lower-cased folders; one row for each rule, file and reference.
    """
    old, new = literal_path(F.col("old_path")), literal_path(F.col("new_path"))
    recased = F.coalesce(F.col("renamed_file") & (F.lower(old) == F.lower(new)), F.lit(False))
    touched = changes.where("not coalesce(deleted_file, false)").select(new.alias("path"), recased.alias("meant")).where("path is not null")
    base = known.select(literal_path(F.col("path")).alias("path")).where("path is not null").distinct()
    moved = case_mismatch(touched.where("not meant").select("path").distinct(), "path", base, "path")
    risks = moved.select(F.lit("change.path_case_mismatch").alias("rule_id"), "path", F.col("path").alias("referenced"), "expected")
    now = current_paths(known, changes)
    named = references.select("path", literal_path(F.col("referenced")).alias("referenced")).where("referenced is not null").distinct()
    named = named.join(touched.select("path").distinct(), "path", "left_semi")
    spelled = case_mismatch(named.select("referenced").distinct(), "referenced", now, "path")
    parts = F.split("path", "/")
    folders = now.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("referenced")).distinct()
    open_ = named.join(spelled, "referenced", "left")
    wrong = open_.where("expected is not null").select(F.lit("change.ci_path_case_mismatch").alias("rule_id"), "path", "referenced", "expected")
    lost = open_.where("expected is null").join(folders, "referenced", "left_anti").select(F.lit("change.ci_path_unverified").alias("rule_id"), "path", "referenced", F.lit(None).cast("string").alias("expected"))
    return risks.unionByName(wrong).unionByName(lost)
