"""Filter interactions, the trie of conversations and the sanitiser against brute force on small rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import audit, queries, sanitise, trie

random.seed(9)


def morse(n):
    """A word of two letters, and its complement, which polynomial hashes modulo a power of two do not tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


WORDS = [" ".join(random.choice("abcdefgh") + random.choice("xyzÄ") for _ in range(n)) for n in (99, 100, 120, 5000)]
TEXTS = [None, "", "  \n", "a b a b", "ABC#c d", "é ü", "x" * 300, f"{morse(1024)} {morse(1024).translate(str.maketrans('ab', 'ba'))}", *WORDS, *(f"w{i} " * 2 for i in range(3)), " ".join(f"w{i}" for i in range(150))]


def counted(t):
    t = t or ""
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    return [len(t), len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t))]


@pytest.mark.parametrize("piece", [1 << 20, 3000, 64, 5])
def test_scan_counts_bytes_of_arrow_buffers(monkeypatch, piece):
    monkeypatch.setattr(audit, "PIECE", piece)
    for column in (pa.array(TEXTS), pa.array(["before", *TEXTS]).slice(1), pa.array(TEXTS, pa.large_string()), pa.array([], pa.string())):
        want = [counted(t) for t in column.to_pylist()]
        assert audit.scan(column, audit.Filters()).T.tolist() == want


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, lang in rows:
        chars, words, distinct, capitals, symbols = counted(t)
        smaller = any(o is not None and (i is None or o < i) and (u or "") == (t or "") for o, u, _ in rows)
        fails.append("".join(f for f, x in zip("ABCDE", (words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * chars, symbols > 0, smaller)) if x))
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            for step in range(5):
                here = [i for i, f in own if order[step] in f and not set(order[:step]) & set(f)]
                out[part, "".join(order), step + 1] = [
                    sum(not set(order[: step + 1]) & set(f) for _, f in own), len(here), sum(order[step] in f and bool(set(order[:step]) & set(f)) for _, f in own),
                    sum(f == order[step] for _, f in own), sum(i in good for i in here), sum(i in toxic for i in here),
                ]
                shapley[part, order[step]] += len(here)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_is_brute_force(spark):
    langs = ["en", None, "", "de"]
    rows = [(k if k % 7 else None, t, langs[k % 4]) for k, t in enumerate(TEXTS * 2)] + [(3, TEXTS[3], "de"), (3, TEXTS[3], "de"), (3, TEXTS[4], "en"), (-1, TEXTS[8], "fr")]
    labels = [(3, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (9, None, 1), (77, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("mask", "n", "part", "digest", "first"):
        docs = docs.withColumn(c, F.lit(c))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = audit.filter_audit(docs.repartition(3), marks)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert audit.filter_audit(docs.limit(0), marks).collect() == []
    assert audit.filter_audit(docs.repartition(2), marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32], text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    saved = {n: (len(m) - 1) * (len(n[-1][1].encode()) if n else 0) for n, m in members.items()}
    children = Counter(n[:-1] for n in members if n)
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], sum(not children[x] for x in below), sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [3, 1 << 14])
def test_trie_is_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(trie, "IDS", ids)
    rng, rows = random.Random(4), []
    for c in range(-7, 70):
        if c % 11 == 3:
            continue  # some first parts are absent
        for turn in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([None, turn, turn, turn]), rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "hé", "yes", "no"])))
    rows += [(c, t, "user", "the same") for c in range(100, 180) for t in range(12)] + [(None, 1, "user", "lost")] + [(5, 1, "user", "twice")] * 3 + [(3, 0, "u", "1")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("rank", F.lit("rank")).withColumn("node", F.lit(1)).repartition(5)
    got = trie.prefix_trie(turns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == brute_trie(rows)
    places = sorted((r.position, r.last_position) for r in got.collect())
    assert [p for p, _ in places] == list(range(1, len(places) + 1)) and all(p <= q for p, q in places)
    assert trie.prefix_trie(turns.limit(0)).collect() == []


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    odd = lambda d: sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d)))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and odd(digits(m[0])) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_leftmost_matches():
    rng = random.Random(3)
    odd = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "1.2.3.4.5.6.7.8", "000255.0.0.1", "256.1.1.1", "a@b.c_x@d.e@f.g", "é.ü@x.y é@x.y-", "a@b", "++1 23456789"]
    for alphabet in ("a@.-_", "a@.1 -+()", "0125.", "1234 -", "+12 ().-x", "é@a.b1"):
        odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t in odd:
        assert [(sanitise.KINDS[k], a, b) for k, a, b in sanitise.base_spans(t)] == brute_spans(t), t
    for long in ("1" * 10**6, "a" * 10**6, "a@" * 10**5, "1." * 10**5, "+1" * 10**5):  # linear, so done at once
        sanitise.base_spans(long)


def brute_disclosing(texts, reach, support, threshold):
    """Pairs by plain counting over lists."""
    import math

    holds, kinds, both = defaultdict(list), defaultdict(set), defaultdict(set)
    uses = defaultdict(set)
    for at, text in enumerate(texts):
        base = sanitise.base_spans(text or "")
        own = [t for t, _, _ in sanitise.terms(text or "", sanitise._merged(base))]
        for t in own:
            uses[t].add(at)
            uses[sanitise.shape(t)].add(at)
        for name, near, kind in sanitise.contexts(text or "", base, reach):
            if at not in holds[name]:
                holds[name].append(at)
            for t in near.split(" "):
                if t:
                    for x in (t, sanitise.shape(t)):
                        kinds[name, x].add(kind)
                        both[name, x].add(at)
    n, out = len(texts), {}
    for (name, t), seen in kinds.items():
        distinct = {texts[at] for at in both[name, t]}
        if len(seen) >= support and 2 * len(seen) >= len(distinct):
            content = math.log2(n / len(holds[name]))
            share = math.log2(n * len(both[name, t]) / (len(holds[name]) * len(uses[t]))) / content if content > 0 else 0
            if share >= threshold:
                out[name, t] = round(share, 9)
    return out


def corpus():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("the of and to in on by for is was that with from are has not but all can one".split()) + rng.choice(["", "", "", "s"]) for _ in range(n))
    texts = [None, "", "no words", "mail x@y.org", say(5000)]
    texts += [f"{say(20)} Zander {say(3)} zander@corp.example.com {say(9)} ACC-{rng.randint(10, 99)}{rng.randint(10, 99)} {say(15)}" for _ in range(8)]
    texts += [f"{say(8)} the ip 10.0.0.7 {say(30)} box-77 on 10.0.0.7 {say(8)}" for _ in range(5)]
    texts += [f"{say(30)} ACC-1234 {say(4)}" for _ in range(3)] + ["copied passage with Uncommon names and c@d.example.org in it"] * 9
    copy = say(40) + " Rareword near q@r.example.org " + say(40)
    texts += [" ".join(w if rng.random() > 0.02 or "@" in w else "edit" for w in copy.split(" ")) for _ in range(12)]
    return texts + [say(60) for _ in range(60)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_terms_that_disclose(spark, monkeypatch, few):
    """Broadcast and shuffled ways agree with plain counting; names that go with an entity go, copies and clean documents stay."""
    monkeypatch.setattr(sanitise, "BROADCAST_ROWS", few)
    texts = corpus()
    docs = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("s")).withColumn("terms", F.lit(1)).repartition(4)
    want = brute_disclosing(texts, sanitise.CONTEXT, sanitise.SUPPORT, sanitise.THRESHOLD)
    assert ("email:zander@corp.example.com", "zander") in want and ("ip:10.0.0.7", "box-77") in want
    assert not any("c@d" in n or "q@r" in n for n, _ in want)
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = sanitise.staged(sanitise.occurrences(plain), "test")
    got = {(r.entity, r.term): round(r.share, 9) for r in sanitise.disclosing(plain, found).collect()}
    assert got == want
    bad, shapes = defaultdict(set), defaultdict(set)
    for name, t in want:
        (shapes if t.startswith("<") else bad)[name].add(t)
    rows = sanitise.sanitised(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r.doc.text or ""
        base = sanitise.base_spans(text)
        names = {sanitise.entity(k, text[a:b]) for k, a, b in base}
        one, shown = sanitise.cleaned(text, base, set().union(*(bad[n] for n in names)), set().union(*(shapes[n] for n in names)))
        assert [tuple(s) for s in r.spans] == one and r.clean_text == shown
        if not base:
            assert r.clean_text == text and r.spans == []
        if "zander@corp" in text:
            assert "ander" not in r.clean_text and "[EMAIL]" in r.clean_text
    assert sanitise.sanitised(docs.limit(0)).collect() == []


def test_clean_text():
    text = "Ann at a@b.cc id AB-12, +1 2345 6789 and ab-12"
    spans, shown = sanitise.cleaned(text, sanitise.base_spans(text), {"ann", "ab-12"}, {"<a>"})
    assert shown == " at [EMAIL] id <a-0>, [PHONE] and <a-0>"
    assert [s[0] for s in spans] == ["email", "phone", "generalised", "generalised", "removed"]


def test_queries_return_whole_tables(spark):
    found = queries.op13_pii(spark, "/root/testdata/sf0.001")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = found.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_spans(docs[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in want) for n in sanitise.KINDS]
