"""Every query against its SQL on the small tables, and the operators on rows of their own."""

import base64
import hashlib
import json
import os
import random
import zipfile
from datetime import datetime, timedelta
from urllib.parse import quote

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell import queries as Q
from tracewell.functions import redact, rules, scrub
from tracewell.functions import rules as R_
from tracewell.functions import text as X
from tracewell.operators import changes as C
from tracewell.operators import graph as G
from tracewell.operators import intervals as IV
from tracewell.operators import logs as L
from tracewell.operators import relational as R
from tracewell.operators import scan
from tracewell.operators import similarity as M
from tracewell.operators import store as ST
from tracewell.plans import diagnosis as D
from tracewell.plans import inspection as I
from tracewell.plans import retrieval as V
from tracewell.sources import readers as S
from tracewell.streaming.incremental import collect_available

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object)
    return sorted(map(tuple, plain.where(plain.notna(), None).values.tolist()), key=str)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.SQL:
        want = duck.sql(Q.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def logs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "job_id string, log string")


CASES = [
    ("ERROR: Job failed: failed to pull image alpine", "runner.image_pull_failed", 99),
    ("x.cs(3,4): error CS0161: no value", "compiler.cs0161", 98),
    ("3 | Account | FAIL | AMBIGUOUS", "rlp.datasync_ambiguous", 96),
    ("Automatic merge failed; fix conflicts", "git.merge_conflict", 94),
    ("5 failed, 2 passed", "test.failed", 93),
    ("HTTP 401", "auth.authentication_rejected", 90),
    ("Merge request status is open / detailed merge request status is not_approved, cannot continue", "git.merge_approval_required", 94),
    ("Process completed with exit code 2.", "script.nonzero_exit", 15),
]


@pytest.mark.parametrize("prefix", ["", "2024-01-01T00:00:00Z ", "\x1b[31m"])
@pytest.mark.parametrize(("line", "rule", "priority"), CASES)
def test_rules(spark, prefix, line, rule, priority):
    got = L.failure_signals(logs(spark, f"start\n{prefix}{line}\n")).collect()
    assert [(r.rule_id, r.priority, r.line) for r in got] == [(rule, priority, 2)]


def test_noise_and_fences(spark):
    quiet = "$ exit 1\nwarning: exit code 3\n0 errors\n# ERROR: no\n```\nERROR: inside\n~~~\nERROR: still\n```\necho ERROR: no\n"
    assert L.failure_signals(logs(spark, quiet, "", None)).count() == 0


def test_failure_tables(spark):
    text = "Component Failures [1]\nType  Name  Problem\nApexClass  Foo  Variable does not exist: x (3:4)\n\nFlow  Bar  lone row"
    report = 'Number of errors - 2\nComponentName\tType\tErrorMessage\n"A"\t"Flow"\t"Duplicate name here"'
    got = L.failure_signals(logs(spark, text, report)).select("job_id", "idx", "rule_id").collect()
    assert {tuple(r) for r in got} == {("0", 0, "salesforce.component_failure"), ("0", 2, "salesforce.apex_compile"), ("1", 0, "salesforce.validation_failed"), ("1", 2, "salesforce.metadata_duplicate")}


def test_upload_context(spark):
    text = "Uploading artifacts for failed job\nERROR: permission denied\nCleaning up\nERROR: permission denied"
    got = L.failure_signals(logs(spark, text)).orderBy("idx").collect()
    assert [r.rule_id for r in got] == ["artifact.upload_failed", "auth.authorization_rejected"]


def test_line_numbers_stop_at_an_omission(spark):
    got = L.explode_lines(logs(spark, "a\n[LOG_TRUNCATED]\nb\n\n"), "job_id", "log").orderBy("idx").collect()
    assert [(r.text, r.line) for r in got] == [("a", 1), ("[LOG_TRUNCATED]", None), ("b", None)]


def test_fingerprints_and_chunks(spark):
    df = logs(spark, "$ make\nERROR: cannot read /tmp/abc 123456\nexit code 2", "$ make\nERROR: cannot read /var/x 999999\nexit code 2", "Job succeeded")
    got = {r.job_id: r for r in L.fingerprint_logs(df).collect()}
    assert got["0"].digest == got["1"].digest and got["0"].command == "make" and got["0"].exit_code == 2
    assert got["2"].category == "no_failure_observed"
    odd = {r.job_id: r for r in L.fingerprint_logs(logs(spark, "$  Make ALL \nexit code 99999999999", "", None, "exit code 3\n$ exit 4\nexited with code 0")).collect()}
    assert (odd["0"].exit_code, odd["0"].command) == (None, "Make ALL") and odd["3"].exit_code == 0
    assert odd["1"].category == odd["2"].category == "unknown" and odd["1"].digest == odd["2"].digest


def test_categories_are_those_of_fingerprints(spark):
    """The category of a log's failure from sums alone, without a window over its lines."""
    said = ["x", "Job succeeded", "ERROR: boom", "3 | Account | FAIL | AMBIGUOUS", "3 | A | FAIL | AMBIGUOUS\nDataSync run failed for 1 target(s).\nHTTP 401", "HTTP 401\nexit code 2", "Test failures [3]\nerror CS0161: no"]
    lines = L.diagnosed_lines(logs(spark, *said))
    assert sorted(map(tuple, L.categories(lines).collect())) == sorted((r.job_id, r.category) for r in L.fingerprints(lines).collect())


def chunked(spark, *texts, **options):
    return [[(c.line_start, c.line_end, c.chunk_type, c.score) for c in own] for own in (L.chunk_logs(logs(spark, t), **options).orderBy("rank").collect() for t in texts)]


def test_chunks(spark):
    long = "\n".join(["x"] * 200 + ["ERROR: boom"] + ["y"] * 200)
    assert chunked(spark, long, "calm\n" * 60, "", "a") == [[(198, 208, "error", 0.5)], [(1, 40, "context", 0.0)], [], [(1, 1, "context", 0.0)]]
    # the best evidence first, cut every 80 lines
    many = "\n".join(["ERROR: boom"] * 170 + ["x"] * 20 + ["HTTP 401"])
    assert chunked(spark, many) == [[(188, 191, "http", 0.9), (1, 80, "error", 0.5), (81, 160, "error", 0.5), (161, 177, "error", 0.5)]]
    # line numbers stop being known, and the id says so
    cut = "a\nERROR: b\nc\n[LOG_TRUNCATED]\nd\nERROR: e"
    got = L.chunk_logs(logs(spark, cut)).orderBy("line_start").collect()
    assert [(c.line_start, c.line_end) for c in got] == [(1, 3), (4, 6)]
    digest = lambda a, b, lines: hashlib.sha256(f"{a}:{b}:{'|'.join(lines)}".encode()).hexdigest()[:16]
    assert [c.chunk_id for c in got] == ["log-" + digest(0, 2, cut.split("\n")[:3]), "log-retained-" + digest(3, 5, cut.split("\n")[3:])]
    # a chunk does not begin inside a fence, nor with the mark that closes it
    fenced = "\n".join(["```", *["ERROR: example"] * 5, "```", "x", "ERROR: real"])
    assert chunked(spark, fenced) == [[(8, 9, "error", 0.5)]]
    # one that begins inside an upload says what came before, within 80 lines
    upload = "\n".join(["Uploading artifacts for failed job", *["y"] * 20, *["ERROR: no files to upload"] * 90])
    got = L.chunk_logs(logs(spark, upload)).orderBy("line_start").collect()
    assert [(c.line_start, c.line_end, c.score) for c in got] == [(19, 96, 0.2), (97, 111, 0.2)] and all(c.chunk_id.startswith("log-retained-") for c in got)
    assert all(c.content.split("\n")[:2] == list(L.CONTEXT) and c.content.count("\n") < 80 for c in got)


def test_chunks_are_cut_in_order(spark):
    """Stretches of any length are cut line by line, as a walk over a whole stretch cuts them."""
    rng = random.Random(4)

    def walk(flags):
        out, chunk, room, known = [], 0, 0, None
        for x in flags:
            room = 0 if x & L.BEGINNING else room
            if not room or (x & L.KNOWN) != known:
                if x & L.TRIMMED and x & L.FENCED:
                    out.append(0)
                    room = 0
                    continue
                chunk, room, known = chunk + 1, L.CHUNK_UPLOAD if x & L.INSIDE else L.CHUNK, x & L.KNOWN
            room -= 1
            out.append(chunk)
        return out

    given = {}
    for k, n in (("a", 5000), ("b", 1), ("c", 700), (None, 300)):
        trim, often = rng.choice((0, L.TRIMMED)), rng.choice((0.005, 0.05))
        given[k] = [trim + L.KNOWN * (i < n * 0.8) + L.INSIDE * (rng.random() < 0.2) + L.FENCED * (rng.random() < 0.3) + L.BEGINNING * (i == 0 or rng.random() < often) for i in range(n)]
    rows = [(k, i, x) for k, own in given.items() for i, x in enumerate(own)]
    got = {}
    for r in L._chunked(spark.createDataFrame(rows, "k string, idx int, flags int").repartition(7), "k").collect():
        got.setdefault(r.k, {})[r.idx] = r.c
    assert got == {k: {i: c for i, c in enumerate(walk(own)) if c} for k, own in given.items()}


def plain_walk(codes):
    """The machine's marks by walking over all lines at once."""
    state, before = L.LINES.start, []
    for code in codes:
        before.append(state)
        state = L._step(state, code)
    return L._marks(codes, before)


def test_line_states_by_blocks_are_those_of_one_walk(spark, monkeypatch):
    """Logs of many blocks and stretches, cut anywhere: fences, tables, reports across a block's end."""
    monkeypatch.setattr(scan, "BLOCK", 8)
    monkeypatch.setattr(scan, "STRETCH", 3)
    rng = random.Random(2)
    kinds = [L.TEXT, L.TEXT, L.TICKS, L.TILDES, L.OMITTED, L.END, L.BLANK, L.COMPONENTS, L.COUNT, L.COUNT, L.COLUMNS, L.COLUMNS, L.ROW, L.ROW, L.QUOTED_ROW, L.QUOTED_ROW]
    given = {k: [rng.choice(kinds[: rng.choice((4, 16))]) + 16 * rng.choice((0, 0, 0, 1, 2)) for _ in range(n)] for k, n in (("a", 1), ("b", 8), ("c", 9), ("d", 700), ("e", 331), (None, 40))}
    rows = [(k, i, c) for k, codes in given.items() for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "k string, idx int, code int").repartition(7)
    long = df.where("k is null or k in ('c', 'd', 'e')")
    got = {}
    for r in scan.marked(df, "k", "idx", "code", L.LINES, long).collect():
        got.setdefault(r.k, {})[r.idx] = r.mark
    assert {k: [m[i] for i in range(len(m))] for k, m in got.items()} == {k: plain_walk(codes) for k, codes in given.items()}
    assert any(m % 8 == L.REPORTED for m in plain_walk(given["d"]))


def test_a_table_of_lines_is_a_log(spark, monkeypatch):
    text = "\n".join(["```", *["ERROR: example"] * 30, "```", "Component Failures [1]", "ApexClass  Foo  No such column", "", "ERROR: real"] * 6)
    whole = L.diagnosed_lines(logs(spark, text)).orderBy("idx").collect()
    monkeypatch.setattr(scan, "BLOCK", 16)
    lines = spark.createDataFrame([("0", i, x) for i, x in enumerate(text.split("\n"))], "job_id string, idx int, raw string").repartition(5)
    assert L.diagnosed(lines).orderBy("idx").collect() == whole == L.diagnosed_lines(logs(spark, text)).orderBy("idx").collect()
    assert sum(r.v is not None for r in whole) == 18 and not any(r.v and "example" in r.text for r in whole)


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("error\tCS1002: ; expected", "compiler.error"), ("Quality  gate\tstatus:  FAILED", "sonar.quality_gate_failed"), ("ERROR:  Job failed:  failed to pull image", "runner.image_pull_failed"),
        ("job  failed (system\tfailure)", "runner.preparation_failed"), ("=== 2 failed, 3 passed in 1s ===", "test.failed"), ("FAILED tests/a.py::b", "test.failed"), ("FAILED  pkg::case", "test.failed"), ("response status = 503", "http.service_failure"),
        ("HTTP/1.1 429", "http.service_failure"), ("npm ERR! 404", "dependency.resolution_failed"), ("E: Release file for http://x is expired", "dependency.apt_release_expired"), ("java.lang.NullPointerException: x", "log.explicit_error"),
        ("exec ./run: Exec format error", "script.exec_format"), ("jq: parse error: Invalid numeric", "script.invalid_json"), ("Uncaught TypeError: a.b is not a function", "script.not_callable"), ('"status": "failed"', "deployment.failed"),
        ("Error (1): Metadata API request failed: x", "salesforce.metadata_request_failed"), ("sonar.sources must define", "sonar.scanner_configuration"), ("package x not found: error", "package.path_missing"), ("flow group rejected: error, invalid", "rlp.flow_group_filter_rejected"),
        ("Error: Invalid config value: org \"a\" is not authenticated", "salesforce.org_not_authenticated"), ("conflict (content): Merge", "git.merge_conflict"), ("ERROR: Job failed: execution took longer than 3600 seconds", "runner.job_timeout"),
        ("0 warning(s) 0 Error(s)", None), ("[INFO] warning: x", None), ("ok 12 error", None), ("\u2713 error: fine", None), ("e.g. ERROR: x", None), ("msg = 'ERROR: x'", None), ("tests/x.py PASSED error: no", None), ("exited with code 0", None), ("ERROR: 0 failures", None),
    ],
)
def test_more_rules(spark, line, rule):
    text = F.lit(line)
    row = spark.range(1).select(R_.noise(text).alias("n"), R_.verdict(R_.first_rule(text)).alias("v")).first()
    assert (None if row.n else row.v and row.v.rule_id) == rule


def wordings(phrase):
    """All plain texts of a phrase: its alternatives chosen, what varies left out."""
    pieces, at = R_._PIECE.findall(phrase.lower()), 0

    def choice(closing):
        nonlocal at
        every, now = [], [""]
        while at < len(pieces) and pieces[at] != "]":
            piece, at = pieces[at], at + 1
            if piece == "[":
                inner = choice(True)
                at += 1
                if at < len(pieces) and pieces[at] == "?":
                    inner, at = [*inner, ""], at + 1
                now = [a + b for a in now for b in inner]
            elif piece == "/" and closing:
                every, now = every + now, [""]
            else:
                now = [a + (" " if piece in (" ", "~") else "" if piece[0] == "<" and len(piece) > 1 else piece[-1]) for a in now]
        return every + now

    return choice(False)


def test_each_rule_has_a_telling_group():
    """What a line must hold for a rule to be looked at is in every phrase of one of its groups."""
    for rule in R_.RULES:
        lost = [[w for p in group for w in wordings(p) if not any(t in w for t in R_.TELLING)] for group in rule.groups]
        assert [] in lost, (rule.rule_id, lost)


def test_gates_of_rules(spark):
    """A line that a rule fires on holds a piece of its gate, so patterns are tried in few lines and nothing else changes."""
    for rule in R_.RULES:
        pieces = R_.gate(rule)
        assert pieces and all(len(x) > 2 for x in pieces), rule.rule_id
        lost = [[w for p in group for w in wordings(p) if not any(x in w for x in pieces)] for group in rule.groups]
        assert [] in lost, (rule.rule_id, lost)
    assert R_.plain("^[a/b] cd [efgh/ijkl]?") == ("cd",) and R_.plain("x[abc/defg]y") == ("abc", "defg") and R_.plain("[a]?<n>") == () and R_.plain("Colou?r\\[sxyz") == ("r[sxyz",)
    lines = [w for rule in R_.RULES for group in rule.groups for p in group for w in wordings(p)] + [line for line, *_ in CASES] + Q.G.PHRASES
    told = spark.createDataFrame([(x,) for x in {*lines, *map(str.upper, lines)}], "text string")
    slow = F.lit(None).cast("int")
    for place, rule in reversed(list(enumerate(R_.RULES, 1))):
        hit = F.lit(True)
        for pattern in rule.patterns:
            hit = hit & F.col("text").rlike("(?i)" + pattern)
        slow = F.when(hit, place).otherwise(slow)
    assert told.select("text", R_.first_rule(F.col("text")).alias("a"), slow.alias("b")).where("not a <=> b").collect() == []


def test_stamps_and_places(spark):
    said = ["2024-05-01T10:00:00.000Z 01O x", "2024-05-01T10:00:00Z  12 x", "2024-05-01T1", "2024-05-01 x", " 2024-05-01T10:00:00Z + npm ci "]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, t string").orderBy("i").select(X.clean_line(F.col("t"))).collect()]
    assert got == ["x", "12 x", "2024-05-01T1", "2024-05-01 x", "+ npm ci"]


def test_chunks_fold_once(spark):
    plan = L.chunk_logs(logs(spark, "a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cut") >= 1 and " Join " not in plan


def test_islands_are_idempotent(spark):
    df = spark.createDataFrame([("k", 1, 3), ("k", 4, 5), ("k", 8, 9), ("k", 2, 10), ("m", 5, 5)], "k string, lo int, hi int")
    once = L.islands(df, "k")
    assert {tuple(r) for r in once.select("k", "lo", "hi").collect()} == {("k", 1, 10), ("m", 5, 5)}
    assert {tuple(r) for r in L.islands(once.drop("island"), "k").select("k", "lo", "hi").collect()} == {("k", 1, 10), ("m", 5, 5)}


SECRETS = [
    'password = "hunter2 with spaces"', "https://user:pw@example.com/x", "Authorization: Bearer abcdefghijkl", "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----\nafter",
    '{"api_key": "abc123", "tokenCount": 5}', "glpat-abcdefghijklmnop1234", "token=$TOKEN", "secret: string",
]


def test_redaction():
    out = [redact.redact(x) for x in SECRETS]
    assert [n for _, n in out] == [1, 1, 1, 1, 1, 1, 0, 0]
    for (text, _), raw in zip(out, SECRETS):
        assert redact.redact(text) == (text, 0)
        assert text.count("\n") == raw.count("\n")
    assert "tokenCount\": 5" in out[4][0] and "hunter2" not in out[0][0]


def nested(depth):
    text = '{"password": "s3cr3t"}'
    for _ in range(depth):
        text = json.dumps({"body": text})
    return text


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("password: |\n  s3cr3t one\n\n  s3cr3t two\nuser: bob\n", "password: |\n  [REDACTED]\n\n\nuser: bob\n"),
        ("a:\n  token: >-\r\n    s3cr3t\r\n  b: 1", "a:\n  token: >-\r\n    [REDACTED]\r\n  b: 1"),
        ('password: "s3cr3t one\n  s3cr3t two"\nuser: bob', 'password: "[REDACTED]\n"\nuser: bob'),
        ("secret='s3cr3t\nit''s s3cr3t'\nuser: bob", "secret='[REDACTED]\n'\nuser: bob"),
        ("password: s3cr3t of several words # why\nuser: bob", "password: \"[REDACTED]\" # why\nuser: bob"),
        ("{password: s3cr3t two words, user: bob}", "{password: \"[REDACTED]\", user: bob}"),
        ("DB_PASS=s3cr3t", "DB_PASS=[REDACTED]"),
        ("pwd: s3cr3t more", 'pwd: "[REDACTED]"'),
        ("MY_PAT=s3cr3t\nvendorPwd=s3cr3t", None),
        ("github_pat_11S3CR3TS3CR3TS3CR3T", "[REDACTED]"),
        ("glpat-s3cr3t", "[REDACTED]"),
        ("https://h/k?X-Amz-Signature=s3cr3t&x=1#sig=s3cr3t", None),
        ("openai_total_tokens=55 and path=/usr/bin, compass: north", "openai_total_tokens=55 and path=/usr/bin, compass: north"),
        (r'body={\"password\": \"s3cr3t, and more\"} end', r'body={\"password\": \"[REDACTED]\"} end'),
        ("don't: password: 's3cr3t one'", "don't: password: '[REDACTED]'"),
        ('password: "s3cr3t never closed', 'password: "[REDACTED]'),
        ("password: ${{ x }}hunter2 s3cr3t", 'password: "[REDACTED]"'),
        ('{"token": "${{ a }} s3cr3t"}', '{"token": "[REDACTED]"}'),
        ("postgres://u:p@s3cr3t@host/db", "postgres://host/db"),
        ('{"password": 1234, "my_token": "s3cr3t"}', None),
        ("'vendor_token(value)': 's3cr3t'", "'vendor_token(value)': '[REDACTED]'"),
        ("error CS0103: 'Foo(System.Token)': x", "error CS0103: 'Foo(System.Token)': x"),
        ("Run(CancellationToken token = default, int n)", "Run(CancellationToken token = default, int n)"),
        ("CancellationToken token = default;", "CancellationToken token = default;"),
        ("if token == x or Token::None", "if token == x or Token::None"),
        ('he said "x\ntoken: "s3cr3t" and', 'he said "x\ntoken: "[REDACTED]" and'),
        ('"token":\n  "s3cr3t"', '"token":\n  "[REDACTED]"'),
        ("token := 's3cr3t'", "token := '[REDACTED]'"),
        ('$env:A_SECRET = "one`"s3cr3t"', '$env:A_SECRET = "[REDACTED]"'),
        ('TOKEN="s3cr3t"s3cr3t; a=b', "TOKEN=[REDACTED]; a=b"),
        ("GET /f?download=1&%2573ig=s3cr3t&page=2", "GET /f?download=1&%2573ig=%5BREDACTED%5D&page=2"),
        (r'script: "echo \e Authorization: s3cr3t"', r'script: "echo \e Authorization: [REDACTED]"'),
        ("basic s3cr3tS3CR3T and basic idea", "basic [REDACTED] and basic idea"),
        ("password: ${{ secrets.A }}\ntoken: |\n  $TOKEN\n", "password: ${{ secrets.A }}\ntoken: |\n  $TOKEN\n"),
    ],
)
def test_redaction_of_blocks_and_lines(raw, want):
    text, n = redact.redact(raw)
    assert "s3cr3t" not in text.lower() and redact.redact(text) == (text, 0)
    assert (text, n) == (want, int(raw != want)) if want else n == 2


def test_masked_json_and_yaml_stay_json_and_yaml():
    import yaml

    given = {"client_secret": 'a "b\\" c', "PASSWORD": "12345", "api_key": 98765, "metadata": {"Token": "string", "token_count": 12}, "ok": True, "next": ["x", 1]}
    told = json.loads(redact.redact(json.dumps(given, indent=2))[0])
    assert told == given | {"client_secret": redact.MARK, "PASSWORD": redact.MARK, "api_key": redact.MARK}
    for value in ("one,two", "one;two", "one}two", "12", "'it''s'", '"a b"'):
        text = redact.redact(f"a:\n  TOKEN: {value} # why\n  b: keep\n")[0]
        assert yaml.safe_load(text) == {"a": {"TOKEN": redact.MARK, "b": "keep"}}


def test_redaction_is_linear_and_idempotent():
    for piece in ("token: ", '\\"', "'", '"', "a='", "[{", "?a=", "-----BEGIN PRIVATE KEY-----", "token=\\", "bearer ", "x", "https://a@"):
        text = redact.redact(piece * 20_000)[0]
        assert redact.redact(text) == (text, 0)


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 7, 12, 15, 16, 17])
def test_redaction_of_nested_strings(depth):
    text, n = redact.redact(nested(depth))
    assert "s3cr3t" not in text and n == 1 and redact.redact(text) == (text, 0)
    inner = json.loads(text)
    while "body" in inner and inner["body"].startswith("{"):
        inner = json.loads(inner["body"])
    assert inner == {"password": redact.MARK} if depth < 16 else inner == {"body": redact.MARK}


def test_lines_are_masked_as_their_text(spark):
    """Line by line, with what is open carried on, a log is masked as a whole text is; few lines are held."""
    rng = random.Random(5)
    parts = ['"', "'", "\\", ":", "=", "|", " ", "\n", "\n", "\n  ", "\r", "(", ")", "{", "}", "password", "token", "x", "https://u:p@h/x?sig=abcdef12", "Bearer abcdefgh12", "${{", "}}", "secrets.X", '$pw = "', "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", '\\"', '"password"', '"token": ', "::"]
    said = [*Q.G.PHRASES, "password: |", "  deep", '"password"', '  : "x y"', "password=abc", "", "(", ")", "{token: a, b}", "it's", 'x "token":', '"val"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(700)] + ["\n".join(rng.choice(said) for _ in range(rng.randint(1, 40))) for _ in range(300)]

    def by_line(text):
        own, done, most = redact.Lines(), [], 0
        for line in text.split("\n"):
            done += own.push(line)
            most = max(most, len(own.held))
        return "\n".join(done + own.end()), most

    assert [by_line(t)[0] for t in texts] == [redact.redact(t)[0] for t in texts]
    assert by_line("\n".join(rng.choice(Q.G.PHRASES) for _ in range(20_000)))[1] < 100
    logs = [(None if k == 7 else str(k), t) for k, t in enumerate(texts[-40:]) if t.strip("\n")]
    lines = spark.createDataFrame([(k, i, x) for k, t in logs for i, x in enumerate(t.split("\n"))], "job_id string, idx int, raw string").repartition(5)
    got = {}
    for r in L.redacted_lines(lines).collect():
        got.setdefault(r.job_id, {})[r.idx] = r.raw
    plain = lambda t: redact.redact(t.replace("\x1b[31m", "").replace("\x1b[0m", ""))[0].split("\n")
    assert {k: [own[i] for i in range(len(own))] for k, own in got.items()} == {k: plain(t) for k, t in logs}


def test_no_log_of_events_is_gathered(spark, monkeypatch):
    """What reads the logs that events make reads their lines: no log is one text, nor a stretch of it one row."""

    def whole(*_):
        raise AssertionError("a whole log")

    monkeypatch.setattr(L, "redacted", whole)
    for name in ("finding_status", "diagnosis", "chunk_full"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_join(sort_array" not in plan and "collect_list" not in plan.replace("collect_list(struct(idx", "").replace("collect_list(struct(n,", ""), name


def test_redact_column(spark):
    got = spark.createDataFrame([(x,) for x in [*SECRETS, None, "nothing here"]], "t string").select(redact.redact_column(F.col("t")).alias("r")).collect()
    assert [r.r.replacements for r in got] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0] and got[-1].r.content == "nothing here"


def test_what_is_masked_is_triggered(spark):
    """Texts of the tests above all reach the scan, in the JVM's eyes too."""
    marks = [m for m in test_redaction_of_blocks_and_lines.pytestmark if m.name == "parametrize"][0].args[1]
    texts = [raw for raw, want in marks if want is None or want != raw] + [x for x in SECRETS if redact.redact(x)[1]] + ["MY_PAT = x1", '{"my pass": 1}', "ghp_" + "a" * 30, "eyJhbGciOiJI.eyJhbGciOiJI.abcdefgh"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.where(~redact.triggered(F.col("t"))).collect() == []
    got = {r.t: r.r.content for r in df.select("t", redact.redact_column(F.col("t")).alias("r")).collect()}
    assert got == {x: redact.redact(x)[0] for x in texts}


def test_similarity_is_symmetric_and_one_with_itself(spark):
    bags = R.token_bags(spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, None)], "k int, t string"), "k", "t")
    got = {(r.a, r.b): (r.overlap, r.total) for r in R.multiset_similarity(bags.withColumnRenamed("k", "a"), "a", bags.withColumnRenamed("k", "b"), "b").collect()}
    assert got[1, 2] == got[2, 1] == (1, 4) and got[1, 1] == (3, 3)


JOBS = [
    ("1", "failed", None, None, "ERROR: x"), ("2", "completed", "success", None, "ERROR: x"), ("3", "success", None, None, "ok"), ("4", "failed", None, "runner_system_failure", "ERROR: x"), ("5", "failed", None, None, None),
    ("6", "success", None, "runner_system_failure", "ok"), ("7", "success", None, None, ""), ("8", "passed", None, None, "$ make || true\nHTTP 401"), ("9", "failed", None, None, "HTTP 401\npassword=hunter2"),
    ("10", "failed", None, None, "Number of errors - 1\nComponentName Type ErrorMessage\n"), ("11", "failed", None, None, "$ sf apex run test --wait 90\nERROR: Job failed: execution took longer than 1h0m0s seconds"), ("12", "succeeded", None, None, "ERROR: x"), (None, "failed", None, None, "x"),
]


def test_bounded_search_is_brute_force(spark, monkeypatch):
    """The k best and all above a likeness, of bags of many sizes with ties; few of the pairs that share a token are met."""
    from collections import Counter

    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = {i: Counter(rng.choices(words, k=rng.choice((1, 3, 20, 60, 300)))) for i in range(300)}
    asked = {i: Counter(rng.choices(words, k=rng.choice((1, 5, 40)))) if i % 3 else texts[i] for i in range(1, 25)} | {99: Counter({"nowhere": 3})}
    bags = lambda of, k: spark.createDataFrame([(i, w, n) for i, b in of.items() for w, n in b.items()], f"{k} long, token string, n long")
    like = {(q, t): ((a & b).total(), (a | b).total()) for q, a in asked.items() for t, b in texts.items() if a & b}
    met = []
    got = M.top_k(bags(asked, "q"), "q", bags(texts, "t"), "t", 4, pairs=met).collect()
    want = [(q, t, *like[q, t], k + 1) for q in asked for k, t in enumerate(sorted((t for p, t in like if p == q), key=lambda t: (-like[q, t][0] / like[q, t][1], t))[:4])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert met[0].count() < len(like) / 2
    for num, den in ((1, 5), (4, 5), (1, 1)):
        got = M.at_least(bags(asked, "q"), "q", bags(texts, "t"), "t", num, den).collect()
        assert sorted(map(tuple, got)) == sorted((*k, *v) for k, v in like.items() if v[0] * den >= v[1] * num)


def test_history_search_meets_few_of_a_hot_key(spark):
    """All items of one rule and category: the same answers as scoring everything, from a few of them."""
    rng = random.Random(3)
    items = [("p", f"e{i:03}", "past_failure", "r", "c", " ".join(rng.choices(["red", "blue", "green", "grey", "zzz"], k=3)), round(rng.random() / 3, 4)) for i in range(200)] + [("p", "s1", "confirmed_resolution", "r", None, "turn", 0.0)]
    df = spark.createDataFrame(items, "project string, evidence_id string, kind string, rule_id string, category string, text string, boost double")
    asks = [("f1", "p", "r", "c", "red blue"), ("f2", "p", "other", "c", "nothing"), ("f3", "p", "other", "unknown", ""), ("f4", "q", "r", "c", "red")]
    got = V.history_search(spark.createDataFrame(asks, "finding_id string, project string, rule_id string, category string, query string"), df).collect()
    want = []
    for f, project, rule, category, text in asks:
        scored = []
        for p, e, kind, r, c, t, boost in items:
            a, b = text.split(), t.split()
            shared = sum(min(a.count(w), b.count(w)) for w in set(a))
            s = shared / (len(a) + len(b) - shared) if a else 0
            raw = 2.0 if kind == "confirmed_resolution" else round(min(1.0, s + (0.25 if r == rule else 0.1 if c == category else 0) + boost), 3)
            if p == project and raw >= 0.12 and (kind != "confirmed_resolution" or r == rule):
                scored.append((-raw, e))
        want += [(f, e, k + 1) for k, (_, e) in enumerate(sorted(scored)[:6])]
    assert sorted((r.finding_id, r.evidence_id, r.rn) for r in got) == sorted(want)


def test_findings(spark):
    df = spark.createDataFrame(JOBS, "job_id string, status string, conclusion string, failure_reason string, log string")
    found = {r.job_id: r for r in D.findings(df, spark.createDataFrame([("12", "- ./deploy.sh ; exit 0"), ("2", "# x || true")], "job_id string, command string")).collect()}
    assert {k: (r.rule_id, r.severity, r.confidence) for k, r in found.items()} == {
        "1": ("log.explicit_error", "error", "unknown"), "2": ("log.explicit_error", "warning", "likely"), "3": ("job.no_failure_observed", "info", "observed"),
        "4": ("runner.reported_system_failure", "error", "unknown"), "5": ("job.insufficient_evidence", "error", "unknown"), "6": ("job.no_failure_observed", "info", "observed"),
        "7": ("job.no_failure_observed", "info", "unknown"), "8": ("script.failure_masked", "warning", "likely"), "9": ("auth.authentication_rejected", "error", "observed"),
        "10": ("salesforce.validation_failed", "error", "unknown"), "11": ("runner.job_timeout", "error", "observed"), "12": ("script.failure_masked", "warning", "likely"),
    }
    assert found["11"].title.startswith("Apex tests") and found["8"].masking == "$ make || true" and found["2"].title.startswith("In a successful job") and found["9"].line == 1
    assert all(r.title and r.steps for r in found.values())


def test_findings_name_their_subject(spark):
    tables = ['Component Failures [1]\nFlow  My_Flow  Duplicate name here', 'InvalidJob : Unable to find object: Account.csv', '3 | Prod target | FAIL | AMBIGUOUS', 'Number of errors - 2\nComponentName\tType\tErrorMessage\n"A"\t"Flow"\t"not found"']
    df = spark.createDataFrame([(str(i), "failed", None, None, t) for i, t in enumerate(tables)], "job_id string, status string, conclusion string, failure_reason string, log string")
    assert [r.title.split(": ")[1] for r in D.findings(df).orderBy("job_id").collect()] == ["My_Flow", "Account.csv", "Prod target", "A"]
    rows = L.component_failures(df).orderBy("job_id").collect()
    assert [(r.job_id, r.place, r.kind, r["name"], r.problem) for r in rows] == [("0", 1, "Flow", "My_Flow", "Duplicate name here"), ("3", 1, "Flow", "A", "not found")]


def test_diagnoses(spark):
    got = {r.job_id: r for r in D.diagnoses(logs(spark, "HTTP 401\n" + "x\n" * 30 + "ERROR: y\n" + "x\n" * 30 + "HTTP 403\nERROR: z", "calm", "Job succeeded", "")).collect()}
    assert got["0"].confidence == 0.96 and [c.text for c in got["0"].cited] == ["HTTP 401", "HTTP 403", "ERROR: y"]
    assert (got["1"].confidence, got["1"].category, [c.text for c in got["1"].cited]) == (0.3, "unknown", [None]) and got["2"].confidence == 0.9 and got["3"].cited is None


def test_classified(spark):
    got = D.classified(spark.createDataFrame([(1, "HTTP 401"), (2, "ERROR: x"), (3, ""), (4, None)], "id long, t string"), "id", "t").collect()
    assert sorted(map(tuple, got)) == [(1, "classified", "auth.authentication_rejected", "authentication_failure"), (2, "unknown", "log.explicit_error", "unknown"), (3, "unknown", "job.insufficient_evidence", "unknown"), (4, "unknown", "job.insufficient_evidence", "unknown")]


def test_csv_source(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id, Log ,status\n1,"a\nb ""q""",failed\n2,,ok\n', encoding="utf-8-sig")
    got = S.log_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [tuple(r) for r in got] == [('a\nb "q"', "failed"), (None, "ok")]
    with pytest.raises(ValueError):
        S.log_csv(spark, str(tmp_path / "x.csv"), text_column="none")


def test_files_archives_and_yaml(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name in (".gitlab-ci.yml", "job.log", "secret.log", "readme.md", "node_modules/a.log"):
        (tmp_path / name).write_text("build:\n  stage: b\n  script: [make]\ntest:\n  needs: [build]\n  extends: .base\n")
    files = S.ci_files(spark, str(tmp_path)).where("path like '%yml' or path like '%log'")
    assert sorted(os.path.basename(r.path) for r in files.collect()) == [".gitlab-ci.yml", "job.log"]
    nodes = {r.key: (r.stage, r.needs, r.extends, r.script, r.line_start) for r in S.ci_nodes(files.where("path like '%yml'")).collect()}
    assert nodes == {"build": ("b", [], [], ["make"], 1), "test": (None, ["build"], [".base"], [], 4)}
    for name, text in (("ok", '{"a": 1}'), ("twice", '{"a": 1, "a": 2}'), ("nan", '{"a": NaN}')):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("s.json", text)
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    got = {os.path.basename(r.path): (r.json, r.problem) for r in S.zip_member(raw, "s.json").collect()}
    assert got == {"ok.zip": ('{"a": 1}', None), "twice.zip": (None, "ValueError"), "nan.zip": (None, "ValueError"), "bad.zip": (None, "BadZipFile")}


def test_ci_files_are_composed_alike(spark):
    """By libyaml or in plain Python: the same nodes, lines and failures; libyaml reads what it may."""
    import yaml

    rng = random.Random(6)
    parts = ["build:", "test:", "  stage: a", "  script: [make, t1]", "  script:", "    - x", "    - |", "      more", "", "# c", "---", "...", "a: b", "jobs:", "  b:", "    needs: [x, {job: y}]", "    extends: .z", ".h: {stage: a}", "  x: 'q", "\t", "  - &a 1", "  <<: *a", "? k", "a: [", "\u00e9: 1", "key: @x"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) + rng.choice(("", "\n", "\n")) for _ in range(1500)]

    def shape(node):
        if isinstance(node, yaml.ScalarNode):
            return node.tag, node.value, node.start_mark.line, node.end_mark.line
        return node.tag, [tuple(map(shape, x)) if isinstance(x, tuple) else shape(x) for x in node.value] if node else None, node.start_mark.line, node.end_mark.line

    def tried(compose, text):
        try:
            return [x and shape(x) for x in compose(text)]
        except yaml.YAMLError:
            return "invalid"

    assert [tried(S._composed, t) for t in texts] == [tried(lambda x: list(yaml.compose_all(x)), t) for t in texts]
    assert not yaml.__with_libyaml__ or S._composed("a: b\n")[0].start_mark.buffer is None
    rows = [(str(i), "build:\n  stage: a\n") for i in range(9)] + [("long", "build:\n  stage: b\n" + "#" * 2000 + "\n"), ("none", None)]
    got = {(r.path, r.stage, r.problem) for r in S.ci_nodes(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {*((str(i), "a", None) for i in range(9)), ("long", "b", None), ("none", None, "unreadable")}


def test_stream_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(5).write.parquet(source)
    assert collect_available(spark, source, target, check, ["id"]).count() == 5
    spark.range(3, 8).write.mode("append").parquet(source)
    assert sorted(r.id for r in collect_available(spark, source, target, check, ["id"]).collect()) == list(range(8))
    again = collect_available(spark, source, target, str(tmp_path / "other"), ["id"])  # all files once more, as after a lost checkpoint
    assert sorted(r.id for r in again.collect()) == list(range(8)) and again.columns == ["id", "batch"]


def test_text_functions(spark):
    df = spark.createDataFrame([("é" * 400, "./src/a.py"), ("x\n" * 9, "/home/u/src/b.py"), (None, "C:\\w\\c.py")], "t string, p string")
    got = df.select(X.head_tail(F.col("t"), 301).alias("h"), X.excerpt(F.col("t"), 2).alias("e"), X.source_path(F.col("p")).alias("p"), X.numbered_window(F.col("t"), 2, 2).alias("w")).collect()
    assert got[0].h.count("é") == 150 and "[LOG_TRUNCATED]" in got[0].h and "\ufffd" not in got[0].h
    assert got[0].e == "é" * 400 and got[1].e == "x\nx" and got[1].w == "2: x\n3: x"
    assert [r.p for r in got] == ["src/a.py", "src/b.py", "c.py"]


def test_change_risks(spark):
    changes = spark.createDataFrame(Q.CHANGES, "old_path string, new_path string, deleted_file boolean, renamed_file boolean, note string")
    known = spark.createDataFrame([(p,) for p in Q.PATHS], "path string")
    got = C.change_risks(changes, known, spark.createDataFrame(Q.REFERENCES, "path string, referenced string")).collect()
    assert sorted((r.rule_id, r.path, r.referenced, r.expected) for r in got) == [
        ("change.ci_path_case_mismatch", "ci/build.yml", "SRC/app/util.py", "src"),
        ("change.ci_path_unverified", "ci/build.yml", "lib/util.py", None),
        ("change.path_case_mismatch", "src/App/main.py", "src/App/main.py", "src/app"),
    ]
    assert C.added_lines(spark.createDataFrame([("a", None)], "change string, diff string"), "change", "diff").count() == 0


def test_bundle_stops_at_the_budget(spark):
    rows = [("k", 0, "a", "log", "x" * 20), ("k", 1, "b", "log", "y" * 20), ("k", 2, "c", "log", "z")]
    got = V.bundle(spark.createDataFrame(rows, "k string, place int, evidence_id string, kind string, content string"), "k", 40).first()
    assert got.context == "[a] log\n" + "x" * 20 + "\n\n[b] log\nyyy" and got.evidence == ["a", "b", "c"]


def test_similar_incidents_stay_in_their_project(spark):
    incidents = [(1, "p", "f", "c", "alpha beta", False), (2, "q", "f", "c", "alpha beta", True), (3, "p", "g", "c", "other", True), (4, "p", None, None, "gamma delta", False), (5, "p", "g", "d", None, False)]
    incidents = spark.createDataFrame(incidents, "incident_id long, project string, fingerprint string, category string, text string, resolved boolean")
    queries = spark.createDataFrame([(1, "p", "f", "c", "alpha beta"), (9, "p", "f", "c", None)], "query_id long, project string, fingerprint string, category string, text string")
    got = {(r.query_id, r.rn): (r.incident_id, r.similarity) for r in V.similar_incidents(queries, incidents).collect()}
    assert got == {(1, 1): (3, 0.35), (9, 1): (3, 0.35), (9, 2): (1, 1.0)}

CI = {
    ".gitlab-ci.yml": "include:\n  - local: /ci/base.yml\n  - ci/more.yml\n  - ci/none.yml\nstages: [build, test]\nvariables: {A: '1'}\nbuild:\n  stage: build\n  variables: {X: own}\n  script:\n    - make\n    - !reference [.shared, script]\nunit:\n  extends: [.base, .tests]\n  needs: [build, {job: lint}]\nlost:\n  extends: .nowhere\n  script: !reference [.none, script]\nring:\n  extends: ring2\n  script: [r]\nring2:\n  extends: ring\n",
    "ci/base.yml": ".shared:\n  script: [a, b]\n.base:\n  stage: early\n  variables: {X: base, Y: base}\n  script: [base]\nlint:\n  script: lint\nbuild:\n  variables: {X: first, Z: first}\n  image: old\n",
    "ci/more.yml": "include: ci/base.yml\n.tests:\n  stage: test\n  variables: {X: tests}\nbuild:\n  variables: gone\n",
    "ci/broken.yml": "a: [",
}


def test_bags_by_project_need_no_join(spark):
    df = spark.createDataFrame([(1, "p", "Alpha beta alpha"), (2, None, "beta"), (3, "q", None)], "k int, project string, text string")
    bags = R.token_bags(df, "k", "text", "project")
    assert sorted(map(tuple, bags.collect())) == [(1, "p\x1falpha", 2), (1, "p\x1fbeta", 1), (2, "beta", 1)]
    assert "Join" not in bags._jdf.queryExecution().executedPlan().toString()


def test_ci_graph(spark):
    files = spark.createDataFrame([("p", k, v) for k, v in CI.items()] + [("q", "a.yml", "include: b.yml\nx: {script: 1}"), ("q", "b.yml", "include: a.yml\ny: {script: [!reference [x, script]]}"), ("r", "z.yml", "a: [")], "config string, path string, content string")
    roots = spark.createDataFrame([("p", ".gitlab-ci.yml"), ("q", "a.yml"), ("r", "z.yml")], "config string, root string")
    jobs, notes = G.ci_graph(files, roots)
    got = {(r.config, r.key): r for r in jobs.collect()}
    assert set(got) == {("p", "build"), ("p", "unit"), ("p", "lint"), ("p", "lost"), ("p", "ring"), ("p", "ring2"), ("q", "x"), ("q", "y")}
    unit, build = got["p", "unit"], got["p", "build"]
    assert (unit.stage, unit.needs, unit.script, unit.inherited, unit.path, unit.line_start) == ("test", ["build", "lint"], ["base"], [".base", ".tests"], "ci/base.yml", 3)
    assert (build.stage, build.script, build.path, build.line_start, build.line_end) == ("build", ["make", "a", "b"], ".gitlab-ci.yml", 7, 12)
    assert got["q", "y"].script == ["1"] and got["p", "lint"].script == ["lint"] and got["p", "lost"].script == []
    assert {tuple(r) for r in notes.collect()} == {
        ("p", "include not found", "ci/none.yml"), ("p", "missing parent", ".nowhere"), ("p", "reference to nothing", ".none:script"), ("p", "cyclic inheritance", "ring"), ("p", "cyclic inheritance", "ring2"),
        ("q", "include cycle ignored", "a.yml"), ("r", "source not analyzed: invalid YAML", "z.yml"),
    }


def test_graphs_have_a_row_a_node(spark):
    """Ten diamonds have 31 nodes and a thousand paths; places are those of the walk; cycles and depth are noted."""
    edges = [("g", f"n{3 * k}", o, f"n{3 * k + 1 + o}") for k in range(10) for o in (0, 1)] + [("g", f"n{3 * k + 1 + o}", 0, f"n{3 * k + 3}") for k in range(10) for o in (0, 1)]
    rng = random.Random(5)
    for c in range(6):  # anything, cycles too
        n = 9
        edges += [(f"r{c}", str(a), o, str(b)) for a in range(n) for o, b in enumerate(rng.sample(range(n), rng.randint(0, 3)))]
    df = spark.createDataFrame(edges, "config string, src string, ordinal int, dst string")
    roots = spark.createDataFrame([("g", "n0"), ("none", "x"), *((f"r{c}", "0") for c in range(6))], "config string, root string")
    found, back, deep = G.ordered(roots, df, 40)
    got, backs = {}, {}
    for r in found.collect():
        got.setdefault(r.config, {})[r.node] = r.place
    for r in back.collect():
        backs.setdefault(r.config, set()).add((r.src, r.dst))
    assert len(got["g"]) == 31 and got["none"] == {"x": 1} and deep.count() == 0
    children = {}
    for c, a, o, b in edges:
        children.setdefault((c, a), []).append((o, b))

    def walk(c, node, above, out):
        for _, b in sorted(children.get((c, node), [])):
            if b not in (*above, node):
                walk(c, b, (*above, node), out)
        out.append(node)

    for c in ["g"]:
        order = []
        walk(c, "n0", (), order)
        last = sorted(set(order), key=lambda x: len(order) - 1 - order[::-1].index(x))
        assert len(order) > 2000 and [n for n, _ in sorted(got[c].items(), key=lambda x: x[1])] == last
    for c in range(6):
        seen, stack = {"0"}, ["0"]
        while stack:
            for _, b in children.get((f"r{c}", stack.pop()), []):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        assert set(got[f"r{c}"]) == seen
        # without the edges back the rest is free of cycles: nodes without an edge go, until none is left
        rest = {(a, b) for a in seen for _, b in children.get((f"r{c}", a), [])} - backs.get(f"r{c}", set())
        while rest:
            ends = {b for _, b in rest} - {a for a, _ in rest}
            assert ends
            rest = {(a, b) for a, b in rest if b not in ends}
    short, _, deep = G.ordered(roots, df.where("config = 'g'"), 3)
    assert short.where("config = 'g'").count() == 6 and {r.dst for r in deep.collect()} == {"n6"}


def test_references_are_followed_or_noted(spark):
    chain = "".join(f"j{k}:\n  script: [!reference [j{k + 1}, script], end{k}]\n" for k in range(14)) + "j14: {script: last}\nring: {script: [!reference [ring, script], x]}"
    files = spark.createDataFrame([("p", "a.yml", chain)], "config string, path string, content string")
    jobs, notes = G.ci_graph(files, spark.createDataFrame([("p", "a.yml")], "config string, root string"))
    got = {r.key: r.script for r in jobs.collect()}
    assert got["j5"] == ["last", *(f"end{k}" for k in range(13, 4, -1))] and got["ring"] == ["x"]
    assert {(r.note, r.what) for r in notes.collect()} == {("reference in a circle", "ring:script"), *(("reference too deep", f"j{k}:script") for k in (11, 12, 13, 14))}


def test_deep_merge_replaces_mappings_and_scalars(spark):
    rows = [(["v", "x"], [0], "1"), (["v", "y"], [0], "2"), (["v"], [1], "s"), (["v", "x"], [2], "3"), (["w"], [0], "4"), (["w", "a"], [1], "5"), (["u"], [3], "6"), (["u"], [2], "7")]
    df = spark.createDataFrame([("k", a, p[0], 0, v) for a, p, v in rows], "k string, at array<string>, place int, ordinal int, value string")
    assert {(tuple(r["at"]), r.value) for r in G.merged(df, ["k"]).collect()} == {(("v", "x"), "3"), (("w", "a"), "5"), (("u",), "6")}


def test_inspection(spark):
    got = [(r.run_id, r.rn, r.rule_id, r.severity, r.job_id, r.status) for r in Q.QUERIES["run_inspection_inline"](spark, SF).orderBy("run_id", "rn").collect()]
    assert got == [
        ("c1", 1, "runner.ssh_executor_unavailable", "error", "k1", "failed"), ("c1", 2, "script.invalid_json", "error", "k2", "failed"), ("c1", 3, "pipeline.failed", "error", None, "failed"),
        ("r1", 1, "dependency.resolution_failed", "error", "j3", "failed"), ("r1", 2, "downstream.failed", "error", None, "failed"), ("r1", 3, "test.failed", "error", "j1", "failed"), ("r1", 4, "pipeline.failed", "error", None, "failed"),
        ("r1", 5, "downstream.unavailable", "warning", None, "failed"), ("r2", 1, "dependency.resolution_failed", "error", "j5", "warning"), ("r2", 2, "sonar.quality_gate_failed", "error", "j4", "warning"), ("r2", 3, "jobs.unanalyzed_failures", "warning", None, "warning"),
        ("r3", 1, "downstream.bridge_failed", "warning", None, "warning"), ("r3", 2, "job.no_failure_observed", "info", "j7", "warning"), ("r4", 1, "pipeline.not_completed", "info", None, "in_progress"),
    ]


def test_finding_identity_and_what_can_be_acted_on(spark):
    df = spark.createDataFrame([("r", "a.b", "build_failure", "j", "x.py", 3, "said"), ("r", "a.b", "build_failure", "j", "x.py", 3, "said"), ("r", "a.b", "build_failure", "j", "x.py", 4, "said"), ("r", "p.q", "pipeline_status", None, None, None, None)], "run string, rule_id string, category string, job_id string, path string, line int, text string")
    told = df.withColumn("id", I.identity(F.col("rule_id"), F.col("job_id"), F.col("path"), F.col("line"), F.col("text")))
    want = hashlib.sha256(b'{"evidence":{"line":3,"path":"x.py","text":"said"},"job_id":"j","rule_id":"a.b"}').hexdigest()[:24]
    assert told.first().id == want and I.actionable(told, ["id"]).count() == 2


def test_scrubbed_rows(spark):
    secret = 'p@ss "word"'
    row = ("no " + secret + " here", [secret, None], {"k": quote(secret, safe="")}, ("x", [base64.b64encode(secret.encode()).decode()]), 5, None)
    df = spark.createDataFrame([row], "a string, b array<string>, c map<string,string>, d struct<e:string,f:array<string>>, n int, z string")
    got = scrub.scrubbed(df, [secret]).first()
    assert (got.a, got.b, got.c, got.d.f, got.n, got.z) == ("no [REDACTED] here", ["[REDACTED]", None], {"k": "[REDACTED]"}, ["[REDACTED]"], 5, None)
    assert scrub.scrubbed(df, []).first().a == row[0]
    cut = scrub.kept(df.withColumn("a", F.lit("token=hunter2 \x00and more")), {"a": 22, "b": 1, "n": 0}).first()
    assert cut.a == "token=[REDACTED] and m" and cut.b == [secret] and cut.n == 5


def test_nested_texts_are_redacted(spark):
    """Strings at any depth, sliced and null arrays, overlapping secrets; keys, numbers and nulls stay."""
    secrets = ["abcd1234", "1234efgh", 'q"uo\\te', "two\nlines"]
    find = scrub.finder(secrets)
    assert [tuple(s)[:2] for s in find("xxabcd1234efghyy abcd1234")] == [(2, 14), (17, 25)] and find("") == []
    assert redact.applied("a two\nlines b", find("a two\nlines b"))[0] == "a [REDACTED]\n b"
    rows = [(k, [None, ["password=hunter2", None], []][k % 3], {"token": f"glpat-{'a' * 12}", "n": None} if k % 2 else None, ([(k, "abcd1234efgh")], None) if k % 4 else None, b"abcd1234") for k in range(9)]
    df = spark.createDataFrame(rows, "k int, a array<string>, m map<string,string>, s struct<l:array<struct<i:int,t:string>>,z:string>, raw binary").repartition(2)
    got = {r.k: r for r in scrub.scrubbed(df, secrets).collect()}
    assert scrub.scrubbed(df, secrets).schema == df.schema
    for k, a, m, s, raw in rows:
        r = got[k]
        assert r.a == (["password=[REDACTED]", None] if a and len(a) else a) and r.m == ({"token": "[REDACTED]", "n": None} if m else None) and bytes(r.raw) == raw
        assert (r.s is None) == (s is None) and (s is None or (r.s.l[0].i, r.s.l[0].t, r.s.z) == (k, "[REDACTED]", None))
    spelled = ["q%22uo%5Cte", "q%22uo%5cte", json.dumps(secrets[2])[1:-1], base64.b64encode(secrets[2].encode()).decode()]
    out = scrub.scrubbed(spark.createDataFrame([(x,) for x in spelled], "t string"), secrets).collect()
    assert {r.t for r in out} == {"[REDACTED]"}


def test_job_ends_go_on_after_a_stop(spark, tmp_path):
    """A stream in three runs, each over more files, ends the same jobs as one run; ends are final and come once."""
    from tracewell.streaming.jobs import collect_job_ends

    rng, rows = random.Random(4), []
    for day in range(3):
        rows.append([(f"j{rng.randrange(30)}", rng.choice(["running", "running", "running", "failed", "succeeded"]), f"2024-01-0{day + 1} {rng.randrange(24):02}:{rng.randrange(60):02}:00") for _ in range(60)])
    rows[0] += [(None, "failed", "2024-01-01 00:00:00"), ("j1", "failed", None)]
    schema = "job_id string, state string, at timestamp"

    def land(day):
        spark.createDataFrame(rows[day], "job_id string, state string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    seen = []
    for day in range(3):
        land(day)
        got = collect_job_ends(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), silence="8 hours")
        seen.append({(r.job_id, r.state, str(r.at), r.events) for r in got.collect()})
        assert len(seen[-1]) == got.count() == len({x[0] for x in seen[-1]})
    assert seen[0] < seen[1] <= seen[2]
    want, last = {}, {}
    for job, state, at in sorted((x for day in rows for x in day if x[0] and x[2]), key=lambda x: (x[2], x[1] != "running", x[1])):
        at = datetime.fromisoformat(at)
        before, n = last.get(job, (None, 0))
        if job in want:
            continue
        if before and at - before > timedelta(hours=8):
            want[job] = (job, "timed_out", str(before + timedelta(hours=8)), n)
        elif state != "running":
            want[job] = (job, state, str(at), n + 1)
        else:
            last[job] = (at, n + 1)
    newest = max(datetime.fromisoformat(x[2]) for day in rows for x in day if x[2])
    for job, (at, n) in last.items():
        if job not in want and at + timedelta(hours=8) < newest - timedelta(hours=1):
            want[job] = (job, "timed_out", str(at + timedelta(hours=8)), n)
    assert seen[-1] == set(want.values())


def test_commits_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    """A commit that breaks off between its tables, or at its manifest, leaves the old state; the second of two fails; only touched buckets are written."""
    store = str(tmp_path / "store")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    rows = lambda name, **o: sorted(((r.k, r.v) for r in ST.table(spark, store, name, **o).collect()), key=str)
    first = ST.commit(spark, store, {"a": (frame([(i, "x") for i in range(40)] + [(None, "n")]), ["k"]), "b": (frame([(1, "p"), (1, "q"), (2, "r")]), ["k"])}, replaced={"b": frame([(1, "")])}, buckets=8)
    old = rows("a"), rows("b")
    assert len(old[0]) == 41 and old[1] == [(1, "p"), (1, "q"), (2, "r")]
    real = ST.upsert
    calls = []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(ST, "upsert", breaks)
    change = {"a": (frame([(1, "new")]), ["k"]), "b": (frame([(2, "new")]), ["k"])}
    with pytest.raises(OSError):
        ST.commit(spark, store, change)
    assert (rows("a"), rows("b")) == old
    monkeypatch.setattr(ST, "upsert", real)
    monkeypatch.setattr(ST, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ST.commit(spark, store, change)
    monkeypatch.undo()
    assert (rows("a"), rows("b")) == old
    second = ST.commit(spark, store, change)
    assert (1, "new") in rows("a") and len(rows("a")) == 41 and rows("b") == [(1, "p"), (1, "q"), (2, "new")]
    assert sum(first["tables"]["a"]["folders"][b] != f for b, f in second["tables"]["a"]["folders"].items()) == 1
    assert rows("a", at=first) == old[0]
    with pytest.raises(ST.Conflict):
        ST.commit(spark, store, {"a": (frame([(5, "late")]), ["k"])}, at=first)
    ST.commit(spark, store, {"b": (frame([(1, "only")]), ["k"])}, replaced={"b": frame([(1, ""), (2, "")])})
    assert rows("b") == [(1, "only")] and (5, "x") in rows("a")


def test_references_of_ci_files(spark):
    words = {"cd 'a b'/c": ["cd", "a b/c"], 'x "q\\"r" \\  y': ["x", 'q"r', " ", "y"], "a; b": None, "a 'open": None, "a # b": None, "a#b": ["a#b"], "": [], "x $(y)": None, "echo \"$A\"": ["echo", "$A"]}
    assert {k: C.shell_words(k) for k in words} == words
    text = """include:
  - local: /ci/a.yml
  - local: ci/b.yml
    rules: [x]
  - {project: p, local: ci/c.yml}
  - ci/d.yml
variables:
  MIGRATION_DIR: db/up
  PACKAGE_NAME: no
build:
  variables: {my_package_folder: "pack age"}
  script:
    - cd ./src/app
    - echo x; cd lost
    - |
      # cd no
      cd 'two'
      run --package-path=three --package four --package "$X"
    - >
      cd folded
  after_script: cd src/app
nested: {include: no/top.yml, jobs: [{run: cd deep}]}
"""
    configs = spark.createDataFrame([("c.yml", text), ("bad.yml", "a: ["), ("none.yml", None)], "path string, content string")
    got = {(r.path, r.referenced, r.line) for r in C.ci_references(configs).collect()}
    assert got == {("c.yml", r, n) for r, n in (("ci/d.yml", 6), ("db/up", 8), ("src/app", 13), ("two", 17), ("three", 18), ("four", 18), ("deep", 22))}


def test_points_meet_intervals_once(spark):
    rng = random.Random(1)
    somewhere = lambda: rng.choice([rng.randint(-50, 50), rng.randint(-(10**6), 10**6), rng.randint(-(2**61), 2**61)])
    points = [(i, "ab"[i % 2], somewhere()) for i in range(200)] + [(999, "a", None), (998, "a", 0), (997, "a", 7)]
    spans = [(i, "ab"[i % 2], lo, lo + rng.choice([-1, 0, 1, 2, 7, 100, 10**5, 2 * 10**6, 2**60])) for i, lo in enumerate(somewhere() for _ in range(150))] + [(777, "a", None, 5), (776, "a", 0, 7), (775, "b", -8, -1)]
    p, s = spark.createDataFrame(points, "p int, k string, at long"), spark.createDataFrame(spans, "i int, k string, lo long, hi long")
    inside = lambda at, lo, hi: None not in (at, lo, hi) and lo <= at <= hi
    assert sorted(map(tuple, IV.points_in(p, "at", s, "lo", "hi", ["k"]).select("p", "i").collect())) == sorted((a, b) for a, k, at in points for b, j, lo, hi in spans if k == j and inside(at, lo, hi))
    every = IV.points_in(p.drop("k"), "at", s.drop("k"), "lo", "hi").select("p", "i").collect()
    assert sorted(map(tuple, every)) == sorted((a, b) for a, _, at in points for b, _, lo, hi in spans if inside(at, lo, hi))
    assert IV.points_in(p, "at", s.where("i = 777"), "lo", "hi", ["k"]).collect() == []


def test_others_in_intervals_without_pairs(spark, monkeypatch):
    """As a plain join counts them, whatever buckets and blocks there are; 20,000 points in 20,000 intervals are not paired."""
    monkeypatch.setattr(IV, "BUCKET", 4)
    monkeypatch.setattr(IV, "CROWD", 6)
    rng = random.Random(3)
    when = lambda: rng.choice([rng.randint(-40, 40), rng.randint(-(10**4), 10**4), rng.randint(0, 10**12)])
    points = [(i, rng.randint(0, 3), when()) for i in range(300)] + [(900, None, 1), (901, 1, None), (None, 2, 5)]
    spans = [(i % 140, rng.randint(0, 4), at, at + rng.choice([-1, 0, 1, 9, 500, 10**4, 10**12])) for i, at in enumerate(when() for _ in range(150))] + [(777, None, 0, 9), (778, 1, None, 9)]
    p, s = spark.createDataFrame(points, "v long, o long, at long"), spark.createDataFrame(spans, "i long, own long, lo long, hi long")
    want = {}
    for i, own, lo, hi in spans:
        for v, o, at in points:
            if None not in (own, lo, o, at) and lo <= at <= hi and o != own:
                n, last = want.get(i, (0, None))
                want[i] = (n + 1, max((x for x in (last, v) if x is not None), default=None))
    found = lambda a, b: {r.i: (r.n, r.last) for r in IV.others_in(a, "at", "o", "v", b, "i", "lo", "hi", "own").collect()}
    assert found(p, s) == want
    assert found(p.limit(0), s) == found(p, s.limit(0)) == {}
    monkeypatch.undo()
    many = spark.range(20_000)
    a = many.select(F.col("id").alias("v"), (F.col("id") % 5).alias("o"), (F.col("id") * 1000).alias("at"))
    b = many.select(F.col("id").alias("i"), (F.col("id") % 5).alias("own"), F.lit(0).cast("long").alias("lo"), F.lit(10**9).alias("hi"))
    assert found(a, b) == {i: (16_000, 19_999 if i % 5 != 4 else 19_998) for i in range(20_000)}


def test_csv_preview_and_row_limit(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("Log ,status\n" + "".join(f'"line {i}\nmore",{"" if i % 3 else "bad"}\n' for i in range(30)), encoding="utf-8-sig")
    told = S.csv_preview(spark, str(path))
    assert (told["text"].strip(), told["label"], told["bytes"]) == ("Log", "status", path.stat().st_size)
    rows = S.csv_rows(spark, str(path), limit=7).orderBy("row").collect()
    assert [(r.row, r.text) for r in rows] == [(i + 1, f"line {i}\nmore") for i in range(7)]
    for bad in ({"limit": 0}, {"limit": 5001}, {"text_column": "none"}):
        with pytest.raises(ValueError):
            S.csv_rows(spark, str(path), **bad)


def test_csv_limit_is_of_each_file(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("log\n" + "x" * 60 + "\n")
    monkeypatch.setattr(S, "CSV_BYTES", 100)
    assert S.csv_preview(spark, str(tmp_path))["bytes"] == 3 * 65
    monkeypatch.setattr(S, "CSV_BYTES", 64)
    with pytest.raises(ValueError, match="65 bytes"):
        S.csv_preview(spark, str(tmp_path))


def test_skill_folders_and_many_hidden_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "skills" / name).mkdir(parents=True)
        (tmp_path / "skills" / name / "skill.yaml").write_text(f"skill_id: {name}\nversion: 2\ntitle: T\ncategories: [timeout, {name}x]\n")
    (tmp_path / "skills" / "a" / "runbook.md").write_text("do it")
    packs = S.skill_folders(spark, str(tmp_path / "skills"))
    assert sorted((r.skill_id, r.version, r.categories, r.runbook) for r in packs.collect()) == [("a", 2, ["timeout", "ax"], "do it"), ("b", 2, ["timeout", "bx"], None)]
    assert [r.skill_id for r in S.matching_packs(packs, "bx").collect()] == ["b"]
    flows = tmp_path / "repo" / ".github" / "workflows"
    flows.mkdir(parents=True)
    for i in range(120):
        (flows / f"f{i:03}.yml").write_text("jobs: {}")
    got = [os.path.basename(r.path) for r in S.ci_files(spark, str(tmp_path / "repo")).orderBy("path").collect()]
    assert got == [f"f{i:03}.yml" for i in range(100)]


def test_clip(spark):
    got = spark.createDataFrame([("one two three four",), ("short",), (None,)], "t string").select(X.clip(F.col("t"), 12).alias("c")).collect()
    assert [r.c for r in got] == ["one two…", "short", ""]


def test_upsert_with_children_capacity_and_feedback(spark):
    parents, children = spark.createDataFrame([(1, "p"), (2, "q")], "id int, project string"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, piece string")
    both = R.upsert_with_children(parents, children, spark.createDataFrame([(1, "r"), (3, "p")], "id int, project string"), spark.createDataFrame([(1, "z")], "id int, piece string"), ["id"])
    assert [sorted(map(tuple, x.collect())) for x in both] == [[(1, "r"), (2, "q"), (3, "p")], [(1, "z"), (2, "c")]]
    assert R.within_capacity(parents, parents, ["id"], {"*": 2, "project": 2}).count() == 2
    for limits in ({"*": 2}, {"project": 2}):
        with pytest.raises(ValueError):
            R.within_capacity(parents, spark.createDataFrame([(3, "n")], "id int, project string"), ["id"], limits)
    incidents = spark.createDataFrame([(1, "open", None), (2, "resolved", "old"), (3, "open", None), (4, "open", None)], "id int, resolution_status string, resolution string")
    said = spark.createDataFrame([(1, "resolved", "new"), (2, "rejected", "x"), (3, "nonsense", "y"), (9, "resolved", "z")], "id int, outcome string, resolution string")
    assert sorted(map(tuple, R.with_feedback(incidents, said, "id").collect())) == [(1, "resolved", "new"), (2, "rejected", None), (3, "open", None), (4, "open", None)]


def test_reclassified(spark):
    rows = spark.createDataFrame([(1, "HTTP 401", "classified", "old.rule", "old", "old"), (2, "HTTP 401", "classified", "mine", "own", rules.checksum()), (3, "calm", "classified", "old.rule", "old", None)], "id int, excerpt string, state string, rule_id string, category string, rule_checksum string")
    got = {r.id: (r.state, r.rule_id, r.rule_checksum == rules.checksum()) for r in D.reclassified(rows, "id", "excerpt").collect()}
    assert got == {1: ("classified", "auth.authentication_rejected", True), 2: ("classified", "mine", True), 3: ("unknown", "job.insufficient_evidence", True)}


def test_command_line(capsys):
    from tracewell.__main__ import main

    assert main(["no_such_query", SF]) == 2 and main([]) == 2
    capsys.readouterr()
    assert main(["overall_status", SF]) == 0 and len(capsys.readouterr().out.splitlines()) == len(Q.RUNS) + 15
    assert main(["join_anti", "/no/such/folder"]) == 3
