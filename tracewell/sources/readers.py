"""Sources: log CSVs, folders of CI files, ZIP artifacts, skill packs, CI configurations, landed tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of text and label columns in order of preference; folders and names that are left out.
TEXT_COLUMNS = ("log", "logs", "log_text", "message", "output", "text", "content", "trace")
LABEL_COLUMNS = ("label", "status", "category", "class")
SKIPPED_FOLDERS = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build")


def find_column(names: list[str], wanted: tuple[str, ...], requested: str | None = None) -> str | None:
    """The first wanted column among ``names``, without regard to case and spaces around."""
    by = {n.strip().lower(): n for n in reversed(names)}
    if requested:
        if requested.strip().lower() not in by:
            raise ValueError(f"no column {requested!r}")
        return by[requested.strip().lower()]
    return next((by[w] for w in wanted if w in by), None)


#: Rows of an import, at most and by default; bytes of its file.
ROW_LIMITS, CSV_BYTES = (500, 5_000), 256 << 20


def csv_preview(spark: SparkSession, path: str, *, text_column: str | None = None, label_column: str | None = None) -> dict:
    """What an import would read, without reading a row: its columns, its text and label column and its bytes.

    Fails for a missing or oversized file and for one without a text column. A folder of files with the same
    columns may hold any number of them.
    """
    df = _csv(spark, path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), 0
    while files.hasNext():
        own = files.next().getLen()
        if own > CSV_BYTES:
            raise ValueError(f"{own} bytes are more than {CSV_BYTES}")
        size += own
    text = find_column(df.columns, TEXT_COLUMNS, text_column)
    if text is None:
        raise ValueError("no text column")
    return {"columns": df.columns, "text": text, "label": find_column(df.columns, LABEL_COLUMNS, label_column), "bytes": size}


def csv_rows(spark: SparkSession, path: str, *, limit: int = ROW_LIMITS[0], text_column: str | None = None, label_column: str | None = None) -> DataFrame:
    """The first ``limit`` rows of ``log_csv`` in the file's order, with ``row`` from 1; blank and repeated ones count.

    A CSV with line breaks in quotes can't be split, so one file is one task and its order is that of the task.
    """
    if not 1 <= limit <= ROW_LIMITS[1]:
        raise ValueError(f"limit must be 1 to {ROW_LIMITS[1]}")
    rows = log_csv(spark, path, text_column=text_column, label_column=label_column)
    placed = rows.select("*", F.monotonically_increasing_id().alias("at")).orderBy("at").limit(limit)
    return placed.select((F.row_number().over(Window.orderBy("at"))).alias("row"), "text", "label")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def log_csv(spark: SparkSession, path: str, *, text_column: str | None = None, label_column: str | None = None) -> DataFrame:
    """(text, label) of a CSV with a header: quoted line breaks and a byte-order mark are fine, all columns are strings."""
    df = _csv(spark, path)
    text = find_column(df.columns, TEXT_COLUMNS, text_column)
    if text is None:
        raise ValueError("no text column")
    label = find_column(df.columns, LABEL_COLUMNS, label_column)
    return df.select(F.col(f"`{text}`").alias("text"), (F.col(f"`{label}`") if label else F.lit(None).cast("string")).alias("label"))


#: CI files of a folder that one import reads, and bytes of each.
FILES, FILE_BYTES = 100, 250_000


def _hidden(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of CI files to four folders deep that Spark's listings pass over for the dot before their name or folder, sorted."""
    found = set()
    for pattern in (f"{folder}{'/*' * d}/{name}" for d in range(5) for name in (".gitlab-ci*", ".github/workflows/*")):
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found |= {(s.getPath().toString(), s.getLen()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or () if s.isFile()}
    return sorted(found)


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        content = []
        for path in batch["path"]:
            system, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            with system.open_input_stream(name) as stream:
                content.append(stream.read())
        yield batch.assign(content=content)


def ci_files(spark: SparkSession, folder: str, *, largest: int = FILE_BYTES, limit: int = FILES) -> DataFrame:
    """(path, size, content) of the first ``limit`` CI configurations and logs below a folder, by path, without names that look like secrets.

    Files behind a dot are found by name on the driver and read by tasks like the others.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    if hidden := [x for x in _hidden(spark, folder.rstrip("/")) if x[1] <= largest]:
        opened = spark.createDataFrame(hidden, "path string, length long").mapInPandas(_opened, "path string, length long, content binary")
        files = files.unionByName(opened).dropDuplicates(["path"])
    path = F.col("path")
    wanted = path.rlike(r"(?i)(\.gitlab-ci[^/]*\.ya?ml|/\.github/workflows/[^/]+\.ya?ml|/ci/.*\.ya?ml|\.log)$")
    unwanted = path.rlike("/(" + "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS) + ")/") | path.rlike(r"(?i)/[^/]*(secret|credential|password|token|\.env|\.pem|\.key|id_rsa)[^/]*$")
    kept = files.where(wanted & ~unwanted & (F.col("length") <= largest)).orderBy("path").limit(limit)
    return kept.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"))


def _strict(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def strict_json(text: str):
    """JSON without repeated keys and without numbers that are none."""

    def bad(x: str):
        raise ValueError(f"{x} is no number")

    return json.loads(text, object_pairs_hook=_strict, parse_constant=bad)


def strict_objects(rows: DataFrame, column: str, fields: dict[str, str], *, largest: int = 1 << 20) -> DataFrame:
    """``rows`` with ``value``, a JSON object as a variant, and ``problem``, why it is none (else null).

    A problem is too large (in bytes), invalid (no JSON, or numbers that are none), no object, repeated
    key (at any depth), extra key, missing key or wrong type; ``fields`` are names with the variant
    types (BIGINT, DOUBLE and others as ``schema_of_variant`` names them, ANY for all) that an object
    must have. A null text is missing. Stays in the JVM.
    """
    text = F.col(f"`{column}`")
    value, keys = F.try_parse_json(text), F.json_object_keys(text)
    has = lambda name: F.array_contains(keys, F.lit(name))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$['{name}']", "variant"))
    wrong = reduce(lambda a, b: a | b, [kind(n) != t for n, t in fields.items() if t != "ANY"], F.lit(False))
    lacks = reduce(lambda a, b: a | b, [~has(n) for n in fields], F.lit(False))
    problem = (
        F.when(text.isNull(), "missing").when(F.octet_length(text) > largest, "too large").when(value.isNull() & keys.isNotNull(), "repeated key").when(value.isNull(), "invalid")
        .when(keys.isNull(), "no object").when(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) > 0, "extra key").when(lacks, "missing key").when(wrong, "wrong type")
    )
    return rows.withColumn("problem", problem).withColumn("value", F.when(F.col("problem").isNull(), value))


def zip_member(archives: DataFrame, member: str, *, path: str = "path", content: str = "content", members: int = 64, largest: int = 2 << 20, ratio: int = 200) -> DataFrame:
    """(path, json, problem): one JSON member of each ZIP archive, after a check of all members' names, sizes, sums and compression."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch[path], batch[content]):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        infos = z.infolist()
                        unsafe = [i for i in infos if i.filename.startswith("/") or ".." in i.filename.split("/") or i.file_size > largest or i.file_size > ratio * max(1, i.compress_size)]
                        if len(infos) > members or unsafe or z.testzip():
                            raise ValueError("unsafe archive")
                        text = z.read(member).decode("utf-8")
                        strict_json(text)
                    rows.append((name, text, None))
                except (zipfile.BadZipFile, ValueError, KeyError, RecursionError) as error:
                    rows.append((name, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "json", "problem"])

    return archives.select(path, content).mapInPandas(task, "path string, json string, problem string")


#: Characters and documents of a CI file.
YAML_CHARACTERS, YAML_DOCUMENTS = 1_000_000, 20


def ci_nodes(configs: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """(path, key, stage, needs, extends, script, line_start, line_end, problem) of the jobs in GitLab or GitHub CI YAML.

    A file that is null, too long, no YAML, nested too deeply or of too many documents has one row without a
    key, with its ``problem``; jobs have none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(YAML_KNOWN)(_ci_jobs)
        for batch in batches:
            wheres, rows = [], []
            for where, text in zip(batch.column(path).to_pylist(), batch.column(content).to_pylist()):
                # files that are alike are read once in a while, and what is read of a long one is not kept
                own = read(text) if text is None or len(text) <= YAML_SHORT else _ci_jobs(text)
                wheres += [where] * len(own)
                rows += own
            columns = list(zip(*rows)) or [()] * len(_NODE)
            yield pa.record_batch([pa.array(wheres, pa.string()), *(pa.array(list(c), kind) for c, kind in zip(columns, _NODE))], ["path", "key", "stage", "needs", "extends", "script", "line_start", "line_end", "problem"])

    return configs.select(F.col(path).cast("string").alias(path), content).mapInArrow(task, "path string, key string, stage string, needs array<string>, extends array<string>, script array<string>, line_start int, line_end int, problem string")


#: CI files that a task remembers, and characters of one at most.
YAML_KNOWN, YAML_SHORT = 16_384, 1024
_NODE = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string())
_RESERVED = frozenset({"stages", "variables", "include", "default", "workflow", "image", "services", "before_script", "after_script", "cache", "on", "name", "env", "permissions"})


def _composed(text: str) -> list:
    """The documents of a YAML text as nodes: by libyaml where it is there, agrees with plain Python and takes the text, else by the latter, which is slower by far and decides what is no YAML."""
    import yaml

    # they differ in tabs and in where a text without a line end ends
    if yaml.__with_libyaml__ and text.isascii() and text.endswith("\n") and "\t" not in text and "\r" not in text:
        try:
            return list(yaml.compose_all(text, Loader=yaml.CSafeLoader))
        except (yaml.YAMLError, RecursionError):
            pass
    return list(yaml.compose_all(text))


def _ci_jobs(text: str | None) -> list[tuple]:
    """(key, stage, needs, extends, script, line_start, line_end, problem) of a CI file's jobs, or its problem."""
    import yaml

    plain = lambda n: n.value if isinstance(n, yaml.ScalarNode) else None
    fail = lambda why: [(None, None, [], [], [], None, None, why)]

    def many(node) -> list[str]:
        if isinstance(node, yaml.SequenceNode):
            found = [plain(x) if not isinstance(x, yaml.MappingNode) else next((plain(v) for k, v in x.value if k.value == "job"), None) for x in node.value]
            return [x for x in found if x]
        return [node.value] if isinstance(node, yaml.ScalarNode) else []

    if text is None or len(text) > YAML_CHARACTERS:
        return fail("unreadable" if text is None else "too long")
    try:
        every = _composed(text)
    except (yaml.YAMLError, RecursionError):
        return fail("invalid YAML")
    if len(every) > YAML_DOCUMENTS:
        return fail("too many documents")
    rows = []
    for doc in every:
        if not isinstance(doc, yaml.MappingNode):
            continue
        jobs = next((v for k, v in doc.value if k.value == "jobs" and isinstance(v, yaml.MappingNode)), doc)
        for key, node in jobs.value:
            if not isinstance(node, yaml.MappingNode) or (jobs is doc and key.value in _RESERVED):
                continue
            own = {k.value: v for k, v in node.value if isinstance(k, yaml.ScalarNode)}
            of = lambda name: many(own[name]) if name in own else []  # noqa: B023, E731
            rows.append((key.value, plain(own["stage"]) if "stage" in own else None, of("needs"), of("extends"), of("script"), key.start_mark.line + 1, node.end_mark.line, None))
    return rows


def skill_packs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The small dimension of guidance by category: (skill_id, version, title, categories, runbook)."""
    return spark.createDataFrame(rows, "skill_id string, version int, title string, categories array<string>, runbook string")


def skill_folders(spark: SparkSession, folder: str) -> DataFrame:
    """``skill_packs`` of a folder: ``*/skill.yaml`` (id, version, title, categories) with the ``runbook.md`` beside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.decode("content", "UTF-8").alias("content"))
    packs = files.where(F.col("path").rlike(r"/skill\.ya?ml$")).withColumn("home", F.regexp_extract("path", r"^(.*)/[^/]+$", 1))
    books = files.where(F.col("path").endswith("/runbook.md")).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("home"), F.col("content").alias("runbook"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for home, text in zip(batch["home"], batch["content"]):
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if isinstance(found, dict):
                    rows.append((home, str(found.get("skill_id") or found.get("id") or home.rsplit("/", 1)[-1]), int(found.get("version") or 1), str(found.get("title") or ""), [str(x) for x in found.get("categories") or []]))
            yield pd.DataFrame(rows, columns=["home", "skill_id", "version", "title", "categories"])

    told = packs.select("home", "content").mapInPandas(task, "home string, skill_id string, version int, title string, categories array<string>")
    return told.join(books, "home", "left").select("skill_id", "version", "title", "categories", "runbook")


def matching_packs(packs: DataFrame, category: str) -> DataFrame:
    """Packs that are meant for a category."""
    return packs.where(F.array_contains("categories", category))


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
