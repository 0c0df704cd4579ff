"""Lines, failure signals, evidence chunks and fingerprints of logs.

Everything here follows from one frame, ``diagnosed``: each line of each log with its states and with
what it says. What a line is (a fence, a table's header, a row) is told by patterns in the JVM; a
small machine walks over the codes, by blocks of lines (scan.py), so a log may span many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import redact
from tracewell.functions import rules as R
from tracewell.functions import text as X
from tracewell.operators import scan
from tracewell.operators.lineage import stored

#: Kinds of lines, as the machine sees them.
TEXT, TICKS, TILDES, OMITTED, END, BLANK, NOISE, COMPONENTS, NO_COMPONENTS, COUNT, NO_COUNT, COLUMNS, ROW, QUOTED_ROW = range(14)
#: What closes a failure table, that is other reports, sections and fences.
REPORTS = R.begins("cleaning up", "deployment status", "elapsed time", "section_[end/start]:", "test failures", "test results summary", "uploading artifacts")
#: A row is a kind, a name and a problem, in columns two blanks apart; or name, kind and problem, quoted, with tabs between.
SPACED = r"^\s*([A-Za-z]\w*)\s{2,}(\S+)\s{2,}(.*\S)\s*$"
TABBED = r'^"([^"\t]+)"\t+"([A-Za-z]\w*)"\t+"(.+)"\s*$'
#: Lines between a report's count and its column header, at most.
REACH = 6
#: Marks: hidden in a fence; header of a table; the count of a report; a row of either table.
HIDDEN, HEADER, REPORTED, LISTED, QUOTED = 1, 2, 3, 4, 5


def kind_of(line: Column, noisy: Column) -> Column:
    """The kind of a cleaned line; fences, omissions and ends count even where they are noise, and only parts of tables are asked whether they are."""
    is_ = lambda p: line.rlike(p)
    typed = lambda p, g: F.lower(F.regexp_extract(line, p, g)) != "type"
    table = (
        F.when(is_(R.begins(r"component failures~\[~<n>")), COMPONENTS).when(is_(R.begins("component failures")), NO_COMPONENTS)
        .when(is_(r"(?i)^number\s+of\s+errors\s*-\s*0*[1-9][0-9]*\s*$"), COUNT).when(is_(R.begins("number of errors~-~<d><end>")), NO_COUNT)
        .when(is_(R.begins("componentname type errormessage<end>")), COLUMNS)
        .when(is_(TABBED) & typed(TABBED, 2), QUOTED_ROW).when(is_(SPACED) & typed(SPACED, 1), ROW)
    )
    return (
        F.when(is_(X.OMISSION), OMITTED).when(line.startswith("```"), TICKS).when(line.startswith("~~~"), TILDES)
        .when(is_(REPORTS) | is_(R.COMMAND), END).when(is_(R.begins(r"component failures~\[~0~\]<end>")), END)
        .when(line == "", BLANK).otherwise(R.let(table, lambda kind: F.when(kind.isNull(), TEXT).when(noisy, NOISE).otherwise(kind)))
    )


#: What a line does to an upload: nothing, begins one, ends it. A line's code is its kind and 16 times this.
STAYS, BEGINS, ENDS = range(3)
#: What a mark says beside HIDDEN to QUOTED: an upload goes on, something was left out up to here.
UPLOADING, CUT = 8, 16


def _step(state: tuple, code: int) -> tuple:
    """What is known behind a line, from before it: which fence is open, which table (LISTED or QUOTED rows), whether it had
    a row, how many lines ago a report's count stood (beyond REACH: none), whether an upload goes on, whether lines were left out.

    Only the fence that opened closes again, an omission opens everything up, and a blank line ends
    a table that had a row.
    """
    fence, table, rows, ago, upload, cut = state
    kind, turn = code % 16, code // 16
    ago = min(ago + 1, REACH + 1)
    if kind == OMITTED:
        fence, cut = 0, True
    elif kind in (TICKS, TILDES):
        fence = kind if not fence else 0 if fence == kind else fence
    elif fence:
        return fence, table, rows, ago, upload, cut
    upload = upload if turn == STAYS else turn == BEGINS
    if kind in (TICKS, TILDES, OMITTED, END) or kind == BLANK and rows:
        table, rows, ago = 0, False, REACH + 1
    elif kind in (COMPONENTS, NO_COMPONENTS):
        table, rows, ago = (LISTED if kind == COMPONENTS else 0), False, REACH + 1
    elif kind in (COUNT, NO_COUNT):
        table, rows, ago = 0, False, (0 if kind == COUNT else REACH + 1)
    elif kind == COLUMNS:
        table, ago = (QUOTED if ago <= REACH else table), REACH + 1
    elif (kind, table) in ((ROW, LISTED), (QUOTED_ROW, QUOTED)):
        rows = True
    return fence, table, rows, ago, upload, cut


def _marks(codes: list[int], states: list[tuple]) -> list[int]:
    """A mark for each line from its code and the states before it; a report's count is marked by the header behind it."""
    marks = []
    for at, (code, before) in enumerate(zip(codes, states)):
        kind = code % 16
        after = _step(before, code)
        mark = 0
        if before[0] and kind not in (OMITTED, TICKS, TILDES):
            mark = HIDDEN
        elif kind == COMPONENTS:
            mark = HEADER
        elif kind == COLUMNS and before[3] < REACH and at > before[3]:
            marks[at - before[3] - 1] += REPORTED
        elif (kind, before[1]) in ((ROW, LISTED), (QUOTED_ROW, QUOTED)):
            mark = before[1]
        marks.append(mark + UPLOADING * after[4] + CUT * after[5])
    return marks


LINES = scan.Machine((0, 0, False, REACH + 1, False, False), _step, 48, _marks, ahead=REACH)


#: Rules of failed components. The kinds a rule is for (none: all), what the problem says, the rule; the first that fits.
COMPONENT_RULES = (
    (("ApexClass", "ApexTrigger"), R.any_of("invalid type:", "needs recompilation", "no such column", "method does not exist", "variable does not exist"), "salesforce.apex_compile"),
    ((), R.any_of("error parsing file", "parseerror", "xml parse error"), "salesforce.metadata_parse"),
    ((), R.any_of("^duplicate name", "^duplicate property"), "salesforce.metadata_duplicate"),
    ((), R.any_of("dependent metadata", "does not exist", "invalid reference", "invalid type", "no<..> named <..> found", "not found", "referenced by"), "salesforce.metadata_dependency"),
)
COMPONENT_ELSE = "salesforce.metadata_error"


def component(line: Column, mark: Column) -> Column:
    """(kind, name, problem, line, column) of a table row as its mark says it is to be read; null for other lines."""
    pick = lambda spaced, tabbed: F.when(mark == LISTED, F.regexp_extract(line, SPACED, spaced)).when(mark == QUOTED, F.regexp_extract(line, TABBED, tabbed))
    problem = pick(3, 3)
    place = lambda g: F.regexp_extract(problem, r"\b([0-9]+):([0-9]+)\b", g).try_cast("int")
    found = F.struct(pick(1, 2).alias("kind"), pick(2, 1).alias("name"), problem.alias("problem"), place(1).alias("line"), place(2).alias("column"))
    return F.when(mark.isin(LISTED, QUOTED), found)


def table_rule(line: Column, mark: Column) -> Column:
    """The rule of a line that is part of a failure table, null for others."""
    part = component(line, mark)
    rule = None
    for kinds, says, name in COMPONENT_RULES:
        hit = part.problem.rlike("(?i)" + says) & (part.kind.isin(*kinds) if kinds else F.lit(True))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return F.when(mark == HEADER, "salesforce.component_failure").when(mark == REPORTED, "salesforce.validation_failed").when(part.isNotNull(), rule.otherwise(COMPONENT_ELSE))


def _code(line: Column, noisy: Column) -> Column:
    """The code of a cleaned line: its kind, and what it does to an upload."""
    turn = F.when(line.rlike(R.UPLOAD), BEGINS).when(line.rlike(X.OMISSION) | line.rlike(R.COMMAND) | line.rlike(R.UPLOAD_END), ENDS).otherwise(STAYS)
    return (kind_of(line, noisy) + 16 * turn).cast("int")


def explode_lines(logs: DataFrame, key: str, log: str) -> DataFrame:
    """(key, idx, raw, text, line): cleaned lines in order; ``line`` is null once a span was omitted."""
    rows = logs.select(F.col(key), F.posexplode(X.physical_lines(F.col(log))).alias("idx", "raw"))
    rows = rows.withColumn("text", X.clean_line(F.col("raw")))
    seen = F.max(F.col("text").rlike(X.OMISSION)).over(Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("line", F.when(~seen, F.col("idx") + 1))


def redacted(logs: DataFrame, log: str = "log") -> DataFrame:
    """``logs`` with secrets of the log masked; the number of its lines stays."""
    return logs.withColumn(log, redact.redact_column(F.regexp_replace(F.col(log), X.ANSI, "")).getField("content"))


def redacted_lines(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, idx, raw) of ``lines`` (key, idx, raw), masked as ``redacted`` masks the log that they are, which is never held as a whole.

    A log's lines are read in order, as what is open before a line decides what it holds.
    """
    plain = F.when(F.contains("raw", F.lit("\x1b")), F.regexp_replace("raw", X.ANSI, "")).otherwise(F.col("raw"))
    given = lines.select(key, "idx", plain.alias("raw"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, now, ids = redact.Lines(), (), []
        for batch in batches:
            keys, out, done = batch.column(key), [], []
            for own, idx, raw in zip(keys.to_pylist(), batch.column("idx").to_pylist(), batch.column("raw").to_pylist()):
                if (own,) != now:
                    done += log.end() if ids else []
                    now = (own,)
                ids.append((own, idx))
                done += log.push(raw or "")
                if len(done) > 10_000:
                    out.append((ids[: len(done)], done))
                    ids, done = ids[len(done) :], []
            out.append((ids[: len(done)], done))
            ids = ids[len(done) :]
            for of, shown in out:
                yield pa.record_batch([pa.array([k for k, _ in of], keys.type), pa.array([i for _, i in of], batch.column("idx").type), pa.array(shown, pa.string())], [key, "idx", "raw"])
        if ids:
            yield pa.record_batch([pa.array([k for k, _ in ids], keys.type), pa.array([i for _, i in ids], batch.column("idx").type), pa.array(log.end(), pa.string())], [key, "idx", "raw"])

    return given.repartition(key).sortWithinPartitions(key, "idx").mapInArrow(task, given.schema)


def _coded(lines: DataFrame, key: str) -> DataFrame:
    """(key, idx, raw, text, code, place): what patterns say of each line alone."""
    text = F.col("text")
    return lines.select(key, "idx", "raw", X.clean_line(F.col("raw")).alias("text")).withColumn("code", _code(text, R.noise(text))).withColumn("place", R.first_rule(text))


def diagnosed(lines: DataFrame, key: str = "job_id", long: DataFrame | None = None) -> DataFrame:
    """(key, idx, raw, text, line, fence, hidden, uploading, part, v) of each of ``lines`` (key, idx, raw).

    ``idx`` counts a log's lines from 0. ``hidden`` lines are in a code fence, ``fence`` ones mark one,
    ``uploading`` ones belong to a failed job's upload, ``part`` is a failed component, ``v`` (rule_id,
    category, priority, chunk_type) what a line says, null if nothing. A log may be of any length: its lines
    are dealt to blocks, and what came before a block is a prefix scan. ``long`` are the lines of
    logs that are longer than a block; where they are not given, what patterns say of all lines is stored and they are looked up there.
    """
    coded = _coded(lines, key)
    if long is None:
        coded = stored(coded)
        many = coded.groupBy(key).agg(F.max("idx").alias("__last")).where(F.col("__last") >= scan.BLOCK)
        codes = coded.join(many.select(F.col(key).alias("__key")), F.col(key).eqNullSafe(F.col("__key")), "left_semi").select(key, "idx", "code")
    else:
        text = X.clean_line(F.col("raw"))
        codes = long.select(key, "idx", text.alias("text")).select(key, "idx", _code(F.col("text"), R.noise(F.col("text"))).alias("code"))
    rows = scan.marked(coded, key, "idx", "code", LINES, codes)
    text, mark = F.col("text"), F.col("mark") % UPLOADING
    uploading, hidden = F.col("mark").bitwiseAND(UPLOADING) > 0, mark == HIDDEN
    said = R.classify(text, F.col("place"), uploading, table_rule(text, mark))
    heard = R.let(said, lambda v: F.when(v.isNotNull() & ~R.noise(text), v))
    return rows.select(
        key, "idx", "raw", "text", F.when(F.col("mark") < CUT, F.col("idx") + 1).alias("line"), (text.startswith("```") | text.startswith("~~~")).alias("fence"), hidden.alias("hidden"), uploading.alias("uploading"),
        F.when(~uploading, component(text, mark)).alias("part"), F.when(~hidden, heard).alias("v"),
    )


def _exploded(logs: DataFrame, key: str, log: str) -> DataFrame:
    return logs.select(F.col(key), F.posexplode(X.physical_lines(F.col(log))).alias("idx", "raw"))


def diagnosed_lines(logs: DataFrame, key: str = "job_id", log: str = "log", *, masked: bool = False) -> DataFrame:
    """``diagnosed`` lines of logs, first ``redacted`` if ``masked``; a null or empty log has none."""
    long = logs.where(F.size(X.physical_lines(F.col(log))) > scan.BLOCK)
    own = lambda of: _exploded(redacted(of, log) if masked else of, key, log)
    return diagnosed(own(logs), key, own(long))


def ranked(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, idx, line, text, rule_id, category, priority, chunk_type, rank) of ``diagnosed_lines``: best evidence first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("v.priority"), "idx"))
    return lines.where("v is not null").select(key, "idx", "line", "text", "v.rule_id", "v.category", "v.priority", "v.chunk_type", rank.alias("rank"))


def failure_signals(logs: DataFrame, key: str = "job_id", log: str = "log") -> DataFrame:
    """What each log says, best evidence first: ``ranked`` of its ``diagnosed_lines``."""
    return ranked(diagnosed_lines(logs, key, log), key)


def component_failures(logs: DataFrame, key: str = "job_id", log: str = "log", *, limit: int = 10) -> DataFrame:
    """(key, place, kind, name, problem, line, column): the first rows of each log's failure tables."""
    rows = diagnosed_lines(logs, key, log).where("part is not null")
    place = F.row_number().over(Window.partitionBy(key).orderBy("idx"))
    return rows.select(key, place.alias("place"), "part.*").where(F.col("place") <= limit)


def code_locations(logs: DataFrame, key: str = "job_id", log: str = "log", *, limit: int = 10) -> DataFrame:
    """(key, place, path, line, column, message): the first distinct source locations of each log, no warnings' or commands'."""
    lines = explode_lines(logs, key, log).where(~F.col("text").rlike(R.COMMAND))
    for pattern in (R.NOISE[1], R.NOISE[2]):
        lines = lines.where(~F.col("text").rlike(pattern))
    found = lines.select(key, "idx", F.posexplode(X.locations(F.col("text"))).alias("at", "p"))
    first = found.groupBy(key, "p.path", "p.line", "p.column").agg(F.min_by(F.struct("p.message"), F.struct("idx", "at")).alias("m"), F.min(F.struct("idx", "at")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return first.select(key, place.alias("place"), "path", "line", "column", "m.message").where(F.col("place") <= limit)


def islands(windows: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(key, island, lo, hi): ranges that touch or overlap, merged."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(lo) > reach + 1), 1).otherwise(0)
    marked = windows.withColumn("__new", new)
    numbered = marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


#: Lines of a chunk, and of one that begins within an upload: two lines of context go before it.
CHUNK, CHUNK_UPLOAD = 80, 78
CONTEXT = ("[LOG_OMITTED: earlier upload context]", "Uploading artifacts for failed job [earlier in the log]")


#: A line that may be part of a chunk, as a sum of these: it is fenced, its number is known, it is in an upload that began before it, it begins a stretch, its log has signals.
FENCED, KNOWN, INSIDE, BEGINNING, TRIMMED = 1, 2, 4, 8, 16


def _chunked(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` (key, idx, flags and more) with ``c``, the chunk, from 1 in each log; lines left out are left out.

    Fenced lines do not begin a chunk in logs with signals; a chunk is full at CHUNK or CHUNK_UPLOAD lines, ends
    with its stretch and does not go on where original line numbers stop being known. A log's lines are
    read in order and none but the last is remembered.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, room, known = (), 0, 0, None
        for batch in batches:
            out = []
            for own, flags in zip(batch.column(key).to_pylist(), batch.column("flags").to_pylist()):
                if (own,) != now:
                    now, chunk, room = (own,), 0, 0
                if not room or flags & BEGINNING or (flags & KNOWN) != known:
                    if flags & TRIMMED and flags & FENCED:
                        out.append(0)
                        room = 0
                        continue
                    chunk, room, known = chunk + 1, CHUNK_UPLOAD if flags & INSIDE else CHUNK, flags & KNOWN
                room -= 1
                out.append(chunk)
            c = pa.array(out, pa.int32())
            yield batch.append_column("c", c).filter(pc.greater(c, 0))

    shape = T.StructType([*lines.schema.fields, T.StructField("c", T.IntegerType())])
    return lines.repartition(key).sortWithinPartitions(key, "idx").mapInArrow(task, shape)


def chunks(lines: DataFrame, key: str = "job_id", *, before: int = 3, after: int = 7, head: int = 40) -> DataFrame:
    """(key, rank, chunk_id, chunk_type, line_start, line_end, score, content, signals) of ``diagnosed_lines``, best first.

    Lines around signals, from ``before`` above to ``after`` below, are cut into chunks; a log
    without a signal gives its first ``head`` lines as context. Score is the best signal's priority
    in hundredths. A chunk's id says whether its numbers are the original log's. Windows over a
    log's lines find the stretches, so no line is joined to anything.
    """
    order, back = Window.partitionBy(key).orderBy("idx"), Window.partitionBy(key).orderBy(F.desc("idx"))
    hit = F.when(F.col("v").isNotNull(), F.col("idx"))
    # the next signal is the last one from behind: a frame that ends with the log would be read again for each line
    last, next_ = (F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (order, back))
    seen = lines.withColumn("next", next_).withColumn("last", last).withColumn("any", F.col("last").isNotNull() | F.col("next").isNotNull())
    near = F.when(F.col("any"), F.coalesce(F.col("idx") - F.col("last") <= after, F.lit(False)) | F.coalesce(F.col("next") - F.col("idx") <= before, F.lit(False))).otherwise(F.col("idx") < head)
    kept = seen.where(near).withColumn("stretch", F.col("idx") - F.row_number().over(order))
    inside = F.col("uploading") & ~F.col("hidden") & ~F.col("text").rlike(R.UPLOAD)
    begins = F.coalesce(F.col("stretch") != F.lag("stretch").over(order), F.lit(True))
    said = ((F.col("fence") | F.col("hidden"), FENCED), (F.col("line").isNotNull(), KNOWN), (inside, INSIDE), (begins, BEGINNING), (F.col("any"), TRIMMED))
    flags = sum((F.when(is_, weight).otherwise(0) for is_, weight in said), F.lit(0))
    best = F.when(F.col("v").isNotNull(), F.struct("v.priority", (-F.col("idx")).alias("early"), "v.chunk_type", "idx", "line", "text", "v.rule_id"))
    cut_ = _chunked(kept.select(key, "idx", "raw", flags.cast("int").alias("flags"), best.alias("b")), key)
    of = F.struct("idx", "raw", F.struct((F.col("flags").bitwiseAND(KNOWN) > 0).alias("known"), (F.col("flags").bitwiseAND(INSIDE) > 0).alias("inside")).alias("f"), "b")
    made = cut_.groupBy(key, "c").agg(F.sort_array(F.collect_list(of)).alias("l"), F.max("b").alias("best"))
    first, end = F.col("l")[0], F.element_at("l", -1)
    upload = first.f.inside
    shown = F.when(upload, F.concat(F.array(*map(F.lit, CONTEXT)), F.col("l.raw"))).otherwise(F.col("l.raw"))
    told = made.select(
        key, X.chunk_id(first.idx, end.idx, shown, first.f.known & ~upload).alias("chunk_id"), F.coalesce("best.chunk_type", F.lit("context")).alias("chunk_type"),
        (first.idx + 1).alias("line_start"), (end.idx + 1).alias("line_end"), F.coalesce(F.col("best.priority") / 100, F.lit(0.0)).alias("score"), F.array_join(shown, "\n").alias("content"),
        F.transform(F.filter("l.b", lambda x: x.isNotNull()), lambda x: F.struct(x.idx.alias("idx"), x.line.alias("line"), x.priority.alias("priority"), x.rule_id.alias("rule_id"), x.text.alias("text"))).alias("signals"),
    )
    return told.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "line_start")).alias("rank"), *told.columns[1:])


def chunk_logs(logs: DataFrame, key: str = "job_id", log: str = "log", *, before: int = 3, after: int = 7, head: int = 40) -> DataFrame:
    """Evidence of each log in ``chunks``; a null or empty log has none."""
    return chunks(diagnosed_lines(logs, key, log), key, before=before, after=after, head=head)


def primary(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """``diagnosed_lines`` with ``top``, the (idx, text, rule_id, category) that a log's failure is named by, on every line.

    That is the best signal; a data-sync row that is ambiguous gives way to the run's own failure.
    """
    every = Window.partitionBy(key)
    what, order = F.struct("idx", "text", "v.rule_id", "v.category"), F.struct("v.priority", -F.col("idx"))
    told = F.col("v").isNotNull()
    best = F.max_by(F.when(told, what), F.when(told, order)).over(every)
    run = told & (F.col("v.rule_id") == "rlp.datasync_failed")
    other = F.max_by(F.when(run, what), F.when(run, order)).over(every)
    found = lines.withColumn("best", best).withColumn("other", other)
    swap = (F.col("best.rule_id") == "rlp.datasync_ambiguous") & F.col("other").isNotNull()
    return found.withColumn("top", F.when(swap, F.col("other")).otherwise(F.col("best"))).drop("best", "other")


def fingerprints(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, digest, category, message, command, exit_code) of ``diagnosed_lines``: the primary failure, normalized and hashed.

    The command is the last one up to the failure, as it stands; the exit code is the last that the
    log names outside commands, null where it is no int.
    """
    found = primary(lines, key)
    command = F.nullif(F.trim(F.regexp_extract("text", R.COMMAND, 1)), F.lit(""))
    codes = F.regexp_extract_all("text", F.lit(R.EXIT_CODE), 1)
    upto = F.coalesce(F.col("idx") <= F.col("top.idx"), F.lit(True))
    facts = found.groupBy(key).agg(
        F.max_by(command, F.when(upto & command.isNotNull(), F.col("idx"))).alias("command"),
        F.max_by(F.element_at(codes, -1), F.when((F.size(codes) > 0) & ~F.col("text").rlike(R.COMMAND), F.col("idx"))).alias("exit_code"),
        F.max(F.col("text").rlike(R.SUCCESS)).alias("success"), F.any_value("top").alias("top"),
    )
    category = F.coalesce("top.category", F.when(F.col("success"), "no_failure_observed").otherwise("unknown"))
    message = F.coalesce("top.text", F.lit("No explicit failure signal observed"))
    return facts.select(key, X.fingerprint(category, F.col("command"), message).alias("digest"), category.alias("category"), X.normalize_message(message).alias("message"), "command", F.col("exit_code").try_cast("int").alias("exit_code"))


def categories(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, category) of ``diagnosed_lines``: what ``fingerprints`` say it is, from sums by log."""
    told, order = F.col("v").isNotNull(), F.struct("v.priority", -F.col("idx"))
    run = told & (F.col("v.rule_id") == "rlp.datasync_failed")
    what = F.struct("v.rule_id", "v.category")
    facts = lines.groupBy(key).agg(F.max_by(F.when(told, what), F.when(told, order)).alias("best"), F.max_by(F.when(run, what), F.when(run, order)).alias("other"), F.max(F.col("text").rlike(R.SUCCESS)).alias("success"))
    top = F.when((F.col("best.rule_id") == "rlp.datasync_ambiguous") & F.col("other").isNotNull(), F.col("other")).otherwise(F.col("best"))
    return facts.select(key, F.coalesce(top.getField("category"), F.when(F.col("success"), "no_failure_observed").otherwise("unknown")).alias("category"))


def fingerprint_logs(logs: DataFrame, key: str = "job_id", log: str = "log") -> DataFrame:
    """``fingerprints`` of each log; one without lines is of unknown category."""
    found = logs.select(key).join(fingerprints(diagnosed_lines(logs, key, log), key), key, "left")
    nothing, unknown = F.lit("No explicit failure signal observed"), F.lit("unknown")
    digest = F.coalesce("digest", X.fingerprint(unknown, F.lit(None).cast("string"), nothing))
    return found.select(key, digest.alias("digest"), F.coalesce("category", unknown).alias("category"), F.coalesce("message", X.normalize_message(nothing)).alias("message"), "command", "exit_code")
