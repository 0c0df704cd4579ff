"""The ordered rule table and its compilation to one first-match expression.

Rules are written as phrases, not as patterns: what a tool says, in words, with a few signs for what
varies (``phrase``). A rule fires on a cleaned line if each of its groups has a phrase that is found in it,
whatever the case and whatever white space is between words; the first rule in the order of
declaration wins, whatever its priority. Compiled patterns have no look-around, so engines without
it agree on them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OMISSION

#: What the signs of a phrase stand for; within square brackets a slash parts alternatives.
SIGNS = {
    " ": r"\s+", "~": r"\s*", "<n>": "[1-9][0-9]*", "<d>": "[0-9]+", "<w>": r"\S+", "<id>": r"[A-Za-z_]\w*", "<..>": ".*", "<end>": r"\s*$", "<mark>": r"[.!:]", "<is>": "[:=]",
    "[": "(?:", "]": ")", "/": "|", "?": "?",
}
_PIECE = re.compile(r"<[a-z.]+>|\\.|.")


def phrase(text: str) -> str:
    """The pattern of a phrase: ``^`` begins a line, a backslash takes a sign as it is, words are whole at both ends."""
    body = text.removeprefix("^")
    pieces = _PIECE.findall(body)
    depth, out = 0, []
    for piece in pieces:
        depth += (piece == "[") - (piece == "]")
        plain = piece[1:] if piece.startswith("\\") else piece
        # outside brackets a slash is a slash
        out.append(SIGNS[piece] if piece in SIGNS and (piece != "/" or depth) else re.escape(plain))
    whole = lambda piece: piece.isalnum() or piece in ("<n>", "<d>", "<id>")
    begin = "^" if text.startswith("^") else r"\b" if whole(pieces[0]) or pieces[0] == "[" and whole(pieces[1]) else ""
    last = pieces[-2] if pieces[-1] == "]" else pieces[-1]
    return begin + "".join(out) + (r"\b" if whole(last) else "")


def any_of(*phrases: str) -> str:
    return "|".join(map(phrase, phrases))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    priority: int
    groups: tuple[tuple[str, ...], ...]
    chunk_type: str = "error"

    @property
    def patterns(self) -> tuple[str, ...]:
        return tuple(any_of(*group) for group in self.groups)


def _said(*phrases: str) -> tuple[tuple[str, ...], ...]:
    return (phrases,)


def _status(codes: str) -> tuple[str, ...]:
    """A status code behind the protocol's name or a label."""
    return f"http {codes}", f"http status~{codes}", f"http/<d>[.<d>]? {codes}", f"http/<d>[.<d>]? status~{codes}", f"response status~[<is>]?~{codes}", f"responsestatus~[<is>]?~{codes}", f"status[_/ ]code~[<is>]?~{codes}"


_ABSENT = ("not found", "missing", "does not exist")
#: Ids, categories and priorities are fixed values, and so is their order; phrases are what the tools named say.
RULES = (
    Rule("runner.ssh_executor_unavailable", "runner_infrastructure_failure", 100, (("preparation failed", "preparing environment", "system failure", "docker tunnel"), ("ssh", ":22"), ("timed out", "i/o timeout", "connection refused", "no route", "unreachable", "failed<..>timeout", "error:<..>timeout", "timeout<..>failed", "timeout<..>error:"))),
    Rule("runner.preparation_failed", "runner_infrastructure_failure", 99, _said("preparation failed", "job failed (system failure)", "prepare environment:<..>[fail/error/timeout/cannot]<..>")),
    Rule("runner.image_pull_failed", "runner_infrastructure_failure", 99, _said("^error:~job failed:~failed to pull image")),
    Rule("runner.job_timeout", "timeout", 99, _said("job failed:~execution took longer than <w> seconds", "job failed:~execution took longer than <d>[h/m/s]<..>")),
    Rule("artifact.upload_failed", "unknown", 20, _said("^[error/fatal]:~no files to upload", "^[error/fatal]:~[failed to upload/uploading] artifacts")),
    Rule("compiler.cs0161", "build_failure", 98, _said("error cs0161~:")),
    Rule("compiler.error", "build_failure", 97, _said("error [cs/ts/msb]<d>~:")),
    Rule("rlp.datasync_ambiguous", "deployment_failure", 96, _said("^~<d>~|<..>|~fail~|~ambiguous")),
    Rule("salesforce.csv_as_sobject", "deployment_failure", 96, _said("invalidjob~:~unable to find object:~<id>.csv")),
    Rule("dependency.apt_release_expired", "dependency_failure", 96, _said("^e:~release file for <w> is expired")),
    Rule("rlp.flow_group_filter_rejected", "deployment_failure", 96, (("flow", "flows", "flowgroup", "flowgroupid", "flowfilter"), ("group", "groupid", "flowgroup", "flowgroupid", "flowfilter", "filter", "filters", "filter[ed/ing/id]"), ("error", "fail", "failed", "rejected"), ("<..>reject<..>", "<..>invalid<..>", "<..>unsupported<..>", "<..>not found<..>", "<..>not allowed<..>", "<..>does not exist<..>"))),
    Rule("salesforce.component_failure", "deployment_failure", 95, _said("component failures~\\[~<n>~\\]")),
    Rule("rlp.datasync_failed", "deployment_failure", 94, _said("datasync run fail[ed/ure]", "datasync target fail[ed/ure]", "datasync [pre-]?validation fail[ed/ure]")),
    Rule("git.merge_conflict", "merge_conflict", 94, _said("^conflict (<..>): <w>", "^automatic merge failed;~fix conflicts", "^validation failed~-~merge conflict")),
    Rule("salesforce.test_failure", "test_failure", 93, _said("test failures~\\[~<n>~\\]"), "test"),
    Rule("salesforce.coverage_failure", "test_failure", 93, _said("code coverage failure", "code coverage<..>below<..>", "code coverage<..>less than<..>", "code coverage<..>must be at least<..>"), "test"),
    Rule("test.failed", "test_failure", 93, _said("<n> failing", "<n> test[s]? failed", "test[s]? failed~<is>~<n>", "failed test[s]?~<is>~<n>", "^[=]?<..>=~<n> failed[,/ in]<..>", "^<n> failed,<..>", "^<n> failed in", "<n> failed,<..>passed", "assertion failed", "assertionerror", "^failed <..>::<..>", "^failed <..>test[s]?[\\//\\\\/:]<..>"), "test"),
    Rule("sonar.quality_gate_failed", "quality_gate_failure", 92, _said("quality gate failed", "quality gate has failed", "quality gate[ status]?~<is>~[failed/error]")),
    Rule("sonar.scanner_configuration", "scanner_configuration_failure", 91, (("sonar.projectkey", "sonar.projectbasedir", "sonar.sources", "sonar.tests", "sonar.java.binaries"), ("mandatory", "must define", "not defined", "<..>invalid<..>", "please provide compiled", *_ABSENT))),
    Rule("salesforce.org_not_authenticated", "authentication_failure", 91, _said("^invalid config value:~org <w><..> is not authenticated", "^error[~(<..>)]?:~invalid config value:~org <w><..> is not authenticated", "^[target-org/defaultusername/defaultdevhubusername] <..> false invalid config value:~org <w><..> is not authenticated")),
    Rule("script.exec_format", "script_execution_failure", 91, _said("^exec <w>:~exec format error<end>", "cannot execute binary file:~exec format error<end>")),
    Rule("auth.authentication_rejected", "authentication_failure", 90, _said(*_status("401"), "401 unauthorized", "authentication failed", "[token/credential][s]?[ has/ have/ is/ are]? expired", "[invalid/expired] credentials", "^[error~[:]?~]?unauthorized~<mark>"), "http"),
    Rule("auth.authorization_rejected", "authorization_failure", 90, _said(*_status("403"), "403 forbidden", "permission denied", "not allowed to push", "pre-receive hook declined", "^[error~[:]?~]?[forbidden/not authorized]~<mark>"), "http"),
    Rule("artifact.missing", "artifact_missing", 89, _said("no such artifact", "artifact[s]?<..>missing<..>", "artifact[s]?<..>not found<..>", "could not download<..>artifact[s]?")),
    Rule("package.path_missing", "package_path_failure", 88, (("package", "<..>migrationmanagerpackage\\/<..>", "<..>migrationmanagerpackage\\\\<..>"), ("no such file or directory", "wrong case", "case mismatch", "could not find<..>path<..>", *_ABSENT), ("error", "fatal", "<..>filenotfounderror<..>", "no such file or directory", "could not find", "required package"))),
    Rule("script.invalid_json", "script_input_failure", 87, _said("^jq:~parse error:~[expected/invalid/unfinished/unmatched/unterminated]")),
    Rule("compiler.build_failed", "build_failure", 85, _said("^build failed[.]?<end>", "cannot find symbol", "compilation failed", "compile error", "module not found", "modulenotfounderror", "syntax error")),
    Rule("script.not_callable", "script_execution_failure", 85, _said("^[uncaught ]?typeerror:~<w><..> is not a function"), "stack_trace"),
    Rule("dependency.resolution_failed", "dependency_failure", 84, _said("npm [err!/error] [404/e404/eresolve]", "could not resolve dependency", "no matching distribution found", "unable to resolve [dependency/package]")),
    Rule("deployment.failed", "deployment_failure", 80, _said("deployment failed", "deployment step failed", "status~[\"/']?~<is>~[\"/']?failed")),
    Rule("salesforce.metadata_request_failed", "deployment_failure", 80, _said("^error[~(<..>)]?:~metadata api request failed:~<w>")),
    Rule("http.service_failure", "external_api_failure", 78, _said(*_status("429"), *_status("5[0/1/2/3/4/5/6/7/8/9][0/1/2/3/4/5/6/7/8/9]"), "429 too many requests", "502 bad gateway", "503 service unavailable"), "http"),
    Rule("operation.timeout", "timeout", 75, _said("connection timed out", "deadline exceeded", "i/o timeout", "[error/exception/failed]<..> timed out", "[error/exception/failed]<..> timeout")),
    Rule("sonar.scanner_error", "scanner_failure", 65, _said("error during [sonarscanner/sonar-scanner] execution")),
    Rule("log.explicit_error", "unknown", 50, _said("^[\\[]?error[\\]]?~[:/|/ ]~<w>", "^fatal~[:/|/ ]~<w>", "^[<w>]?[error/exception][~(<..>)]?~:")),
    Rule("script.nonzero_exit", "unknown", 15, _said("exit[ed]?[ with]?[ code/ status]?~[<is>]?~<n>")),
)
#: Rules that name what failed without its cause: a finding of one is of unknown confidence.
INCOMPLETE = ("git.merge_status_unresolved", "salesforce.metadata_request_failed", "salesforce.validation_failed")


def begins(*phrases: str) -> str:
    """A pattern of phrases that begin a line, whatever the case."""
    return f"(?i)^(?:{'|'.join(map(phrase, phrases))})"


#: A level that may stand before a message and says nothing by itself.
LEVELS = ("info", "debug", "trace")


def _levelled(levels: tuple[str, ...], *phrases: str) -> str:
    names = "|".join([*levels, *(rf"\[{x}\]" for x in levels)])
    return rf"(?i)^(?:(?:{names})\s*:?\s*)?(?:{'|'.join(map(phrase, phrases))})"


#: A shell's or a workflow's mark before what it runs.
COMMAND = r"^\s*(?:[$+>] |(?:Executing|Run)\s+)(.+)$"
#: Lines that are no evidence: commands; warnings; nothing that failed, tests that went well, what a test expects; what is only said; marks of omission.
NOISE = (
    COMMAND,
    _levelled(LEVELS, "\\[warn", "\\[warning", "warn", "warning"),
    "(?i)" + phrase(":~warning"),
    _levelled((*LEVELS, "error"), *(f"{n} {what}" for n in ("0", "no", "zero", "<d> warning(s)~0") for what in ("error", "errors", "error(s)", "failure", "failures", "failed")), *(f"{what}~<is>~0" for what in ("error", "errors", "failure", "failures", "failed")), "component failures~\\[~0~\\]", "test failures~\\[~0~\\]"),
    _levelled((*LEVELS, "error"), "assert", "asserting", "expected", "expecting", "ok <d>", "pass ", "passed ", "skipped ", "xfail ", "xfailed ", "[\u2713/\u2714/\u221a] "),
    rf"(?i)^(?:(?:{'|'.join((*LEVELS, 'error'))})\s*:?\s*)?\S*(?:spec|test)\S*\s.*\b(?:passed|skipped|xfail)\b",
    _levelled(LEVELS, "#", "\\/\\/", "```", "\\~\\~\\~", "for example", "e.g. ", "example~<is>", "sample~<is>", "[example/sample] [diagnostic/error/output]~<is>"),
    _levelled(LEVELS, "echo ", "printf ", "write-host ", "write-output ", "print~(", "pprint~(", "logger.<id>~(", "logging.<id>~(", "<id>~=~[\"/']"),
    OMISSION,
)
FOOTER = begins(*(f"{error}{what}[:]?{code}[.]?<end>" for error in ("", "error:~") for what in ("job failed", "process completed") for code in ("", " [with ]?exit [code/status] <n>")))
SUCCESS = begins("build succeeded[.]?<end>", "deployment succeeded<end>", "deployment successful<end>", "execution success<end>", "info execution success<end>", "job succeeded<end>")
MERGE = r"(?i)^(?:error:\s*)?" + phrase("merge request status is <..>\\/~detailed merge request status is [still ]?") + r"([a-z_]+),\s*cannot\s+(?:proceed|continue)\b"
UPLOAD = begins("section_start:<d>:upload_artifacts_on_failure", "uploading artifacts for failed job")
UPLOAD_END = begins("cleaning up", "section_[end/start]:")
EXIT_CODE = "(?i)" + phrase("exit[ed]?[ with]?[ code/ status]?~[<is>]?~") + "([0-9]+)\\b"


def checksum(rules: tuple[Rule, ...] = RULES) -> str:
    """What stored classifications are marked with: a hash of all that decides them, equal as long as nothing of it changes."""
    parts = [[r.rule_id, r.category, r.priority, r.groups, r.chunk_type] for r in rules]
    return hashlib.sha256(json.dumps([parts, NOISE, FOOTER, MERGE, UPLOAD, UPLOAD_END], sort_keys=True).encode()).hexdigest()


def noise(line: Column) -> Column:
    """Lines that are no evidence: blank, a command, a warning, a zero count, an example, a mark of omission."""
    return (line == "") | line.rlike("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in NOISE))


def _verdict(rule_id, category, priority: int, chunk_type: str = "error") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(rule_id).alias("rule_id"), as_column(category).alias("category"), F.lit(priority).alias("priority"), F.lit(chunk_type).alias("chunk_type"))


def plain(text: str) -> tuple[str, ...]:
    """Lower-cased pieces of a phrase, one of which stands in every line it is found in; none if that can't be told.

    That is its longest piece without a sign, or what its alternatives hold where that is longer.
    """
    runs, choices, depth, opened = [""], [], 0, []
    pieces = _PIECE.findall(text.removeprefix("^"))
    for piece, behind in zip(pieces, [*pieces[1:], ""]):
        depth += (piece == "[") - (piece == "]")
        if piece == "]" and not depth and behind != "?":
            choices.append("".join(opened[1:]).split("/") if "[" not in opened[1:] else [""])
        opened = [*opened, piece] if depth else []
        letter = piece[1:] if piece.startswith("\\") else piece
        if depth or piece in SIGNS and piece != "/" or behind == "?" or not letter.isascii():
            runs.append("")
        else:
            runs[-1] += letter
    longest = [(max(runs, key=len),), *(tuple(max(plain(x), key=len, default="") for x in own) for own in choices)]
    best = max(longest, key=lambda own: min(map(len, own)))
    return tuple(x.lower() for x in best) if all(best) else ()


def gate(rule: Rule) -> tuple[str, ...]:
    """Pieces of lower-cased text, one of which stands in any line that the rule fires on; none if that can't be told."""
    found = []
    for group in rule.groups:
        every = [plain(p) for p in group]
        if all(every):
            pieces = {x for own in every for x in own}
            found.append(sorted(p for p in pieces if not any(o in p for o in pieces if o != p)))
    return tuple(min(found, key=len, default=()))


def first_rule(line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The place (from 1) of the first rule in declaration order that fires, null if none does.

    A rule's patterns are tried only in lines that hold a piece of its gate.
    """

    def found(x: Column) -> Column:
        own, low = x.getField("line"), x.getField("low")
        has = lambda pieces: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in pieces])
        chain = None
        for place, rule in enumerate(rules, 1):
            hit = has(gate(rule)) if gate(rule) else F.lit(True)
            for p in rule.patterns:
                hit = hit & own.rlike("(?i)" + p)
            chain = F.when(hit, place) if chain is None else chain.when(hit, place)
        return F.when(has(TELLING), chain) if rules is RULES else chain

    # lower-cased once, not once for each piece
    return let(F.struct(line.alias("line"), F.lower(line).alias("low")), found)


#: Pieces of lower-cased text: a line without any of them fires no rule, as each rule has a group whose phrases all hold one (tested).
TELLING = (
    "fail", "fatal", "error", "err!", "exception", "timed", "timeout", "exit", "expired", "longer", "files", "ambiguous", "unable", "flow", "datasync", "conflict", "coverage", "quality", "sonar", "config value", "format", "http", "status", "unauthorized", "invalid",
    "forbidden", "authorized", "denied", "declined", "allowed", "artifact", "package", "parse", "cannot", "not found", "notfound", "function", "resolve", "distribution", "metadata", "gateway", "unavailable", "requests", "deadline", "failures", "prepar", "tunnel", "codes",
)


def telling(line: Column) -> Column:
    low = F.lower(line)
    found = F.lit(False)
    for piece in TELLING:
        found = found | F.contains(low, F.lit(piece))
    return found


def verdict(place: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """What the rule at a place says, null for null."""
    return F.get(F.array(*[_verdict(r.rule_id, r.category, r.priority, r.chunk_type) for r in rules]), place - 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def classify(line: Column, place: Column, uploading: Column, table_rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """What a line that is no noise says, given its first rule's place: footer first, then failure tables, merge status, and the rule table.

    While a failed job uploads, only the runner's own failures keep their rule.
    """
    detail = F.lower(F.regexp_extract(line, MERGE, 1))
    merge_rule = F.when(detail == "conflict", "git.merge_conflict").when(detail == "not_approved", "git.merge_approval_required").otherwise("git.merge_status_unresolved")
    merge = _verdict(merge_rule, F.when(detail == "conflict", "merge_conflict").otherwise("merge_blocked"), 94)
    table_priority = F.when(table_rule.isin("salesforce.component_failure", "salesforce.validation_failed"), 95).otherwise(96)
    table = F.struct(table_rule.alias("rule_id"), F.lit("deployment_failure").alias("category"), table_priority.alias("priority"), F.lit("error").alias("chunk_type"))
    runner = F.array_contains(F.array(*[F.lit(i) for i, r in enumerate(rules, 1) if r.rule_id.startswith("runner.")]), place)
    return (
        F.when(line.rlike(FOOTER), _verdict("script.nonzero_exit", "unknown", 15))
        .when(table_rule.isNotNull() & ~uploading, table)
        .when(line.rlike(MERGE) & ~uploading, merge)
        .when(place.isNull(), None)
        .when(uploading & ~runner, _verdict("artifact.upload_failed", "unknown", 20))
        .otherwise(verdict(place, rules))
    )
