"""The training-data operators against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import bpe, chat, langid, lattice, likeness, minhash, packing, queries, sharding, simhash, substring, warc

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
random.seed(5)
VOCAB = ["".join(random.choice("abcdeéß") for _ in range(random.randint(1, 7))) for _ in range(400)]
say = lambda n: " ".join(random.choice(VOCAB) for _ in range(n))
PASSAGE, LONG = say(60), say(20000)
TEXTS = [None, "", "   \n", "one", "Zwei Wörter", PASSAGE, say(30) + " " + PASSAGE, PASSAGE + "\t" + say(20), LONG, LONG + " end", "x " * 40, "<|endoftext|> <|im_end|>", say(200), say(200)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (40, say(50)), (41, PASSAGE), (None, PASSAGE), (None, None), (40, "other text with this id"), (-5, PASSAGE)]
#: Extra columns whose names the operators use inside.
EXTRA = ["bucket", "kind", "shard", "row", "doc", "n", "component"]


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for c in EXTRA:
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def split(text):
    return (text or "").encode().split()


def test_sharding(spark, docs):
    got = sharding.shard(docs, 4, ["text"], seed=3).collect()
    n = len(ROWS)
    assert sorted(r.row_number for r in got) == list(range(n)) == sorted(r.position for r in got)
    for r in got:
        assert r.position == sharding.position(r.row_number, n, 3) and sharding.row_number(r.position, n, 3) == r.row_number
        assert (r.shard, r.slot) == (r.position % 4, r.position // 4)
    same([(r.row.doc_id, r.row.text) for r in got], ROWS)
    assert sharding.shard(docs.limit(0), 4, []).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    assert sorted(sharding.position(i, n, 9) for i in range(n)) == list(range(n))
    assert all(sharding.row_number(sharding.position(i, n, 9), n, 9) == i for i in range(n))


def brute_substring(rows, window=13):
    first = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_substring(docs):
    got = substring.substring_dedup(docs).select("doc.doc_id", "n_words", "n_removed", "kept_text")
    same(got.collect(), brute_substring(ROWS))
    assert substring.substring_dedup(docs.limit(0)).collect() == []


def test_substring_with_buckets_in_parts_and_a_full_sketch(docs, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(substring, "FLUSH_ENTRIES", 300)
    monkeypatch.setattr(substring, "log_cells", lambda size: substring.LOG_BLOCK)
    plan = substring.substring_dedup(docs)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4
    same(plan.select("doc.doc_id", "n_words", "n_removed", "kept_text").collect(), brute_substring(ROWS))
    assert substring._parsed(substring._blob(np.array([4, 4, 9]), np.array([1, 1, 2], np.uint32), np.array([0, 7, 3], np.uint32)) + b"\1" * 24 + b"\2" * 24)[2].tolist() == [0, 7, 3]


def test_sketch_follows_the_corpus():
    assert substring.log_cells(0) == 20 and substring.log_cells(10**8) == 25 and substring.log_cells(10**14) == 28


def test_word_hashes_follow_words():
    texts = [b"", b" a  b\n", b"a b", "é\x0bç".encode(), b"ab", b"\xe2\x80\xa8 x"]
    got, counts = substring.word_hashes(texts, substring._Digests())
    assert counts.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert all((got[i] == got[j]).all() == (got[i] == got[j]).any() == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def morse(n):
    """Words of two letters that polynomial hashes modulo powers of two do not tell apart: one, and its complement."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_word_is_taken_for_another(spark):
    """Documents of 13 words that differ in one word, or in the order of two words, hold no repeat."""
    rows = []
    for n in (1024, 2048, 4096):
        for w in morse(n):
            rows.append((len(rows), " ".join([f"n{n}", *"bcdefghijkl", w])))
    a, b = morse(8)
    order = lambda x: [{"a": "yes", "b": "no"}[c] for c in x]
    rows += [(10, " ".join([*order(a), *"vwxyz"])), (11, " ".join([*order(b), *"vwxyz"])), (12, " ".join([*order(b), *"vwxyz"]))]
    got = {r.doc_id: r.n_removed for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc.doc_id", "n_removed").collect()}
    assert got == {i: 13 if i == 12 else 0 for i, _ in rows}


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i % 3] + rng.normal(0, 0.02, 16)]) for i in range(90)]
    rows += [(300, rows[5][1]), (301, rows[5][1]), (301, rows[5][1]), (400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (None, rows[5][1]), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("cid", F.lit(2))
    as32 = [(i, None if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or i is None else np.array(v, np.float32).astype(float)) for i, v in rows]
    links = [[j for j, (_, b) in enumerate(as32) if j != k and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95] for k, (_, a) in enumerate(as32)]
    label = [i for i, _ in rows]
    for _ in rows:
        label = [min([label[k], *(label[j] for j in links[k])]) if links[k] else label[k] for k in range(len(rows))]
    want = [(i, len(links[k]), label[k], None if i is None else i == label[k]) for k, (i, _) in enumerate(rows)]
    same(lattice.embedding_groups(df).collect(), want)
    assert lattice.embedding_groups(df.limit(0)).collect() == []


def test_decoding_finds_the_nearest_lattice_point():
    x = np.random.default_rng(2).normal(0, 2, (500, 8))
    point = lattice.decode(x)
    assert ((point * 2) % 1 == 0).all() and (point.sum(1) % 2 == 0).all()
    near = ((x[:, None] - point[:, None] - lattice.neighbours()[None]) ** 2).sum(2).min(1)
    assert (((x - point) ** 2).sum(1) <= near + 1e-12).all()


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(table).select("doc.doc_id", "doc.lang", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_look_ups_equal_the_network():
    """Filter responses from tables against a convolution written out, window by window."""
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 256, (40, langid.WINDOW), dtype=np.uint8)
    target = (raw[:, :8].mean(1) > 127).astype(int)
    model = langid.train(raw, target, ["a", "b"])
    widths = [w for w in langid.WIDTHS for _ in range(langid.FILTERS)]
    # table j holds, for the filters wider than j, what a byte adds at offset j
    at = lambda f, j, byte: model.tables[j][byte, f - (len(widths) - model.tables[j].shape[1])]
    for row, got in zip(raw[:6], model.windows(raw[:6])):
        padded = [*row.tolist(), *[0] * (max(langid.WIDTHS) - 1)]
        hidden = [max(0.0, max(sum(at(f, j, padded[i + j]) for j in range(w)) for i in range(langid.WINDOW)) + model.bias[f]) for f, w in enumerate(widths)]
        logits = [sum(h * model.weights[f, k] for f, h in enumerate(hidden)) + model.offset[k] for k in range(2)]
        want = np.exp(np.array(logits) - max(logits))
        assert np.allclose(got, want / want.sum(), atol=1e-4)


def test_language_sample_is_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    rows = [(i, f"text {i} " * 3, "xy"[i % 2] if i % 7 else None) for i in range(400)] + [(500 + i, t, "z") for i, t in enumerate(["solo", "", None, "  "])] + [(None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    order = {r.doc_id: r.o for r in df.select("doc_id", F.xxhash64("doc_id").alias("o")).collect()}
    want = {}
    for k in "xyz":
        own = sorted((order[i], t) for i, t, lang in rows if lang == k and i is not None and zlib.crc32(str(i).encode()) % 5 and (t or "").strip())
        want[k] = [t[: langid.SAMPLE_CHARS] for _, t in own[:5]]
    got = langid._sample(df, "doc_id", "text", "lang")
    assert {k: [w[0] for x, w in got if x == k] for k in "xyz"} == want


def test_accepted_keeps_named_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("p", F.lit(1))
    told = {r.doc.doc_id: (r.lang_pred, r.score) for r in langid.identify(table).collect()}
    for languages in (None, ("en",), ("de", "fr"), ()):
        got = {r.doc_id for r in langid.accepted(table, languages=languages).collect()}
        assert got == {i for i, (k, p) in told.items() if p >= 0.5 and k != "und" and (languages is None or k in languages)}


def test_language_of_odd_texts(docs):
    got = langid.identify(docs).select("doc.text", "lang_pred", "score").collect()
    assert len(got) == len(ROWS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(docs.limit(0)).collect() == []


def test_packing(docs):
    exact = Tokenizer.from_file(BYTES)
    got = packing.pack_documents(docs, BYTES, keep_ids=True).collect()
    assert sum(r.length for r in got) == sum(len(exact.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    want = {exact_ids for exact_ids in (tuple([*exact.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in ROWS)}
    for r in got:
        assert any(tuple(r.ids) == w[r.start : r.start + r.length] for w in want)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack_documents(docs.limit(0), BYTES).collect() == []


def test_local_search_keeps_pieces_and_saves_bins():
    rng = random.Random(3)
    for _ in range(5):
        counts = {}
        for _ in range(300):
            length = rng.randint(150, 700)
            counts[length] = counts.get(length, 0) + rng.randint(1, 4)
        first = packing.first_fit(counts, 1024)
        found = packing.local_search(first, 1024)
        total = {}
        for pattern, n in found.items():
            assert sum(pattern) <= 1024
            for x in pattern:
                total[x] = total.get(x, 0) + n
        assert total == counts and sum(found.values()) <= sum(first.values())
    squares = lambda bins: sum(sum(p) ** 2 * n for p, n in bins.items())
    start = packing.Counter({(500, 400): 3, (600, 300): 3, (124,): 3, (24,): 2})
    assert squares(packing.local_search(start, 1024)) > squares(start)


def evenly(counts, capacity):
    """A start without any search: as many of one length in a bin as fit."""
    out = packing.Counter()
    for length, n in counts.items():
        each = capacity // length
        out += packing.Counter({(length,) * each: n // each, (length,) * (n % each): int(n % each > 0)})
    return out


def test_exchanges_empty_bins():
    rng = random.Random(6)
    # where best fit leaves bins underfull, the search empties more than one in forty of them
    counts = packing.Counter(rng.randint(180, 360) for _ in range(5000))
    first = packing.first_fit(counts, 1024)
    assert sum(packing.local_search(first, 1024).values()) < 0.975 * sum(first.values())
    # and from a start without any search it comes near the bound by exchanges alone
    counts = packing.Counter(min(1024, max(5, round(rng.lognormvariate(5, 1)))) for _ in range(3000))
    bound = -(-sum(x * n for x, n in counts.items()) // 1024)
    start, best = evenly(counts, 1024), packing.local_search(packing.first_fit(counts, 1024), 1024)
    found = packing.local_search(start, 1024)
    assert sum(start.values()) > 1.3 * bound and sum(found.values()) <= 1.02 * bound and sum(best.values()) <= 1.003 * bound + 1


def test_packing_comes_near_the_bound(spark):
    got = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), BYTES).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert got[1] <= 1.003 * -(-got[0] // 1024)


def test_packing_numbers_are_gapless_whatever_the_tasks(spark):
    table = spark.createDataFrame([(k // 3, "same words here" if k % 4 else "others") for k in range(600)], "doc_id long, text string").repartition(7)
    pieces = packing.staged(packing.cut_documents(table, BYTES), "pieces")
    per = pieces.groupBy("length", "part").agg(F.count("*").alias("n"), F.countDistinct("number").alias("d"), F.max("number").alias("top")).collect()
    assert len(per) > 7 and all(r.n == r.d == r.top + 1 for r in per)
    packed = packing.pack(pieces)
    assert packed.count() == 600 == packed.select("sequence_id", "offset").distinct().count()


def test_merges_that_are_no_ranks_are_noticed():
    letters = set("abc")
    assert packing.ranked({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4, "<s>": 5}, ["a b", ["ab", "c"]], {"<s>"}, letters)
    assert not packing.ranked({"a": 0, "b": 1, "c": 2, "ab": 4, "abc": 3}, ["a b", "ab c"], set(), letters)
    assert not packing.ranked({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, ["a b"], set(), letters)
    assert not packing.ranked({"a": 0, "b": 1, "c": 5, "ab": 3}, ["a b"], set(), letters)


def gain(low, high, free):
    """The most that an exchange of up to three lengths adds to ``high``, tried one by one; 0 if none does."""
    some = lambda p, k: {c for n in range(k + 1) for c in itertools.combinations(p, n)}
    return max((x for a in some(low, 2) for b in some(high, 2) if len(a) + len(b) <= 3 and 0 < (x := sum(a) - sum(b)) <= free), default=0)


def test_local_search_runs_until_nothing_helps():
    rng = random.Random(4)
    for lengths in ([rng.randint(180, 360) for _ in range(9000)], [min(1024, max(5, round(rng.lognormvariate(5, 1)))) for _ in range(3000)], [7, 9, 11] * 50):
        counts = packing.Counter(lengths)
        found = packing.local_search(packing.first_fit(counts, 1024), 1024)
        total = packing.Counter()
        for p, n in found.items():
            for x in p:
                total[x] += n
        assert total == counts
        left = sorted((p for p in found if sum(p) < 1024), key=sum)
        pairs = [(a, b) for i, a in enumerate(left) for b in left[i:] if a != b or found[a] > 1]
        for a, b in rng.sample(pairs, min(len(pairs), 20_000)):
            assert not gain(a, b, 1024 - sum(b)) and (sum(a) < sum(b) or not gain(b, a, 1024 - sum(a)))


def test_bpe(docs):
    exact = Tokenizer.from_file(WORDS)
    got = bpe.encode_documents(docs, WORDS).collect()
    want = [(i, (ids := exact.encode(t or "", add_special_tokens=False).ids), exact.decode(ids, skip_special_tokens=False)) for i, t in ROWS]
    same(got, want)
    assert bpe.encode_documents(docs.limit(0), WORDS).collect() == []


def test_tokenizers_agree_on_odd_characters():
    letters = [chr(c) for c in [*range(0x250), 0x1C, 0x85, 0x130, 0x3A3, 0x301, 0x1680, 0x2028, 0x202F, 0x3000, 0x4E2D, 0x1F600]] + ["<|endoftext|>", "'s", "'LL", "  ", "\r\n"] * 3
    words, by_bytes, w, b = bpe.Bpe(WORDS), packing.tokenizer(BYTES), Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for _ in range(2000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        ids = w.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == ids and words.decode(ids) == w.decode(ids, skip_special_tokens=False)
        assert by_bytes(text) == b.encode(text, add_special_tokens=False).ids


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| <"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, None, None), (1, 4, "assistant", ""), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, None, "assistant", "x"), (3, None, "a\n%0A<|b", "y")]
    rows += [(4, t, "system" if t == 0 else "assistant" if t % 2 else "user", say(30 if t != 17 else 900)) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).withColumn("kind", F.lit(2))
    windows = chat.format_conversations(df, BYTES, budget=600, history=100)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda y: -1 if y[0] is None else y[0])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own).encode()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    long = windows.where("conv_id = 4").orderBy("first").collect()
    assert len(long) > 3 and all(w.tokens <= 600 or w.n_turns == 1 and w.n_repeated == 0 for w in long)
    assert all(w.formatted.startswith("<|im_start|>system\n") for w in long if w.tokens <= 600) and any(w.n_repeated > 1 for w in long)
    assert chat.read_back(chat.format_conversations(df.limit(0), BYTES)).collect() == []


@pytest.mark.parametrize("system", [0, 100, 900, 1281, 1500, 1577, 1800, 1990, 2040, 2047, 2048, 2500])
def test_chat_windows_keep_to_the_budget(spark, system):
    encode = packing.tokenizer(BYTES)
    size = lambda role, text: len(encode(f"<|im_start|>{role}\n{text}<|im_end|>\n"))
    rng, text = random.Random(system), ""
    while system and size("system", text + " word") <= system:
        text += " word"
    rows = [(0, "system", text)] if system else []
    rows += [(t, "user" if t % 2 else "assistant", " ".join(rng.choice(VOCAB) for _ in range(rng.choice((5, 60, 60, 60, 400))))) for t in range(1, 60)]
    sizes = [size(r, x) for _, r, x in rows]
    df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(df, BYTES).orderBy("first").collect()
    at = 0
    for w in windows:
        own = sizes[at : at + w.n_turns]
        assert w.first == at and w.tokens <= 2048 or (w.n_turns == 1 and own[0] > 2048 and w.n_repeated == 0)
        fits = system and at and sum(own) + sizes[0] <= 2048
        assert (w.n_repeated > 0 and w.formatted.startswith("<|im_start|>system")) or not fits
        at += w.n_turns
    assert at == len(rows)


def test_chat_windows_are_full(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", say(30)) for t in range(200)]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTES).orderBy("first").collect()
    assert len(windows) > 3 and all(1700 < w.tokens <= 2048 for w in windows[1:-1])


def test_warc_with_magic_in_payloads(spark):
    fake = lambda body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    rows = [(i, "u\n", "".join(random.choice("abcdé \r\n") for _ in range(random.randint(0, 400)))) for i in range(60)]
    rows += [(1000, None, "x" * 50 + fake("hello") + fake("again") + "WARC/1.0\r\nbroken" + "y" * 30000 + fake("z" * 20000)), (1001, "", None), (1002, "", "WARC/1.0\r\n" * 500), (1003, "a", fake("q" * 300)), (1004, "b", fake("q" * 300)), (None, "c", fake("q" * 300)), (1005, "", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" * 3), (1003, "a", fake("q" * 300))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("size", F.lit(1)).repartition(3)
    path = warc.archive_folder(spark)
    warc.write_archives(df, path, records_per_file=20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    got = warc.read_archives(spark, path).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    heads = [bytes(r["head"]).decode() for r in got]
    kinds = {(re.search(r"urn:page:(\S+)>", h)[1], re.search(r"Type: (\S+)", h)[1]) for h in heads}
    assert len(got) == len(rows) and {("1003", "response"), ("1004", "revisit"), ("null", "revisit")} <= kinds
    have = {(re.search(r"urn:page:(\S+)>", h)[1], r.payload_size, r.payload_sha256) for h, r in zip(heads, got) if "revisit" not in h.split("\r\n")[0]}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert i in (1004, None) or (str(i), len(raw), hashlib.sha256(raw).hexdigest()) in have
    empty = warc.archive_folder(spark)
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


def xx(value, seed=42):
    """XXH64 of a text or a long as Spark has it, signed."""
    x = xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else struct.pack("<q", value), seed % 2**64)
    return x - 2**64 if x >= 2**63 else x


def xx_all(longs):
    seed = 42
    for x in longs:
        seed = xx(x, seed)
    return seed


def brute_fingerprint(text):
    """One-permutation MinHash, written out: 128 bins by the hash's top 7 bits, empty ones borrow, 8 low bits of each."""
    w = [xx(x.decode()) for x in split(text)]
    if not w:
        return ""
    least = {}
    for h in [xx_all(w[k : k + 5]) for k in range(max(1, len(w) - 4))]:
        bin_ = (h % 2**64) >> 57
        least[bin_] = min(h, least.get(bin_, h))
    owner = lambda b: b if b in least else min(least, key=lambda f: xx_all([b, f]))
    return "".join(f"{least[owner(b)] & 255:02x}" for b in range(128))


def estimate(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 256, 2)) / 128
    return max(0.0, min(1.0, (same - 1 / 256) / (1 - 1 / 256)))


def brute_table(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, xx(x[1])))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        prints = [brute_fingerprint(x) for x in (text, edited, after)]
        yield i, len(text), edited, prints[0], prints[1], round(estimate(prints[0], prints[1]), 9), round(estimate(prints[0], prints[2]), 9)


def printed(df):
    return [(r.doc_id, r.n_chars, r.edited_text, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in minhash.fingerprint_table(df).collect()]


def test_fingerprints(docs):
    same(printed(docs), brute_table(ROWS))
    assert minhash.fingerprint_table(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 12")
    same(printed(one), brute_table([r for r in ROWS if r[0] == 12]))


def test_likeness_is_near_the_truth(spark):
    rng, rows, truth = random.Random(2), [], []
    sets = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    for k in range(60):
        a = [f"w{rng.randrange(5000)}" for _ in range(600)]
        b = [x if rng.random() > 0.004 * k else "new" for x in a]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        truth.append(len(sets(a) & sets(b)) / len(sets(a) | sets(b)))
    got = {r.doc_id: r.near_next for r in minhash.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = np.array([got[2 * k] - t for k, t in enumerate(truth)])
    assert abs(off.mean()) < 0.03 and off.std() < 0.08 and all(got[2 * k + 1] < 0.1 for k in range(59))


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i}") for i in range(900)] + [(7, f"seven {i}") for i in range(900)] + [(i, f"own {i}") for i in range(100, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    dealt, _ = minhash.with_next(df)
    sizes = dealt.where("ghost = 0").groupBy("part", "sub").count().collect()
    assert max(r["count"] for r in sizes) < 60 and sum(r["count"] for r in sizes) == len(rows) and dealt.where("ghost = 1").count() == len(sizes)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, xx(x[1])))
    want = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in dealt.where("ghost = 0").collect()} == want
    bucket = sharding.bucket_of(F.col("doc_id"), [F.col("text")], 4096)
    assert df.where("doc_id is null").groupBy(bucket).count().agg(F.max("count")).first()[0] < 10
    assert sharding.buckets_for(10) == 4096 and sharding.buckets_for(10**12) * sharding.BUCKET_ROWS >= 10**12


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in set(label)}
    return [(i, prints[k], least[label[k]]) for k, (i, _) in enumerate(rows)]


def test_simhash(docs):
    got = simhash.simhash_groups(docs).collect()
    same([(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got], brute_groups(ROWS))
    assert simhash.simhash_groups(docs.limit(0)).collect() == []


def test_fingerprint_links_in_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 3)
    rng = random.Random(8)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    from tracewell.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    label = {x: x for x in prints}
    for _ in prints:
        new = {x: min(label[y] for y in prints if (x ^ y).bit_count() <= 2) for x in prints}
        if new == label:
            break
        label = new
    assert {x: got.get(x, x) for x in prints} == label


@pytest.mark.parametrize("bits", [0, 1])
def test_fingerprint_links_of_fewer_bits_in_full_buckets(spark, monkeypatch, bits):
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    # b and c are one bit apart; x, two bits from c, and y, two bits from b, are smaller than both
    b, c = 0b1100 << 10, 0b1101 << 10
    prints = {b, c, b ^ (1 << 13), c ^ (1 << 12), b ^ (0b11 << 30), c ^ (0b111 << 35)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    from tracewell.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, bits)).collect()}
    label = {x: x for x in prints}
    for _ in prints:
        label = {x: min(label[y] for y in prints if (x ^ y).bit_count() <= bits) for x in prints}
    assert {x: got.get(x, x) for x in prints} == label


def brute_pipeline(rows):
    keep = {}
    for i, print_, component in brute_groups(rows):
        keep.setdefault((print_, component), []).append(i)
    return keep


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, "")
    told = {r.doc.text: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in ROWS if told[t][0] in corpus_pipeline.LANGUAGES and told[t][1] >= 0.5])
    once = stages["near_duplicates"](spark, docs, "")
    assert kept.columns == once.columns == docs.columns
    groups = {}
    for i, _, component in brute_groups(ROWS):
        groups.setdefault(component, []).append(i)
    got = once.collect()
    for i, _, component in brute_groups(ROWS):
        if i is not None and i != component:
            assert i not in [r.doc_id for r in got if r.text == dict((k, t) for k, t in ROWS if k == i)[i]]
    assert {r.doc_id for r in got} == set(groups) and len(got) == len({(brute_simhash(r.text), r.doc_id) for r in got})
    cut = stages["repeated_passages"](spark, docs, "")
    assert cut.columns == docs.columns
    want = [(i, kept_text if gone else text, len(kept_text) if gone else (None if text is None else len(text))) for (i, text), (_, _, gone, kept_text) in zip(ROWS, brute_substring(ROWS))]
    same([(r.doc_id, r.text, r.n_chars) for r in cut.collect()], want)
    packed = stages["sequences"](spark, cut, "")
    assert packed.count() >= len(ROWS)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), "").collect() == []


def brute_near_copies(rows):
    """Pairs of distinct texts with a 5-word Jaccard likeness of 0.8 or more, and the ids that stay."""
    sets = {}
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(tuple(w), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    names, holders, shared = list(sets), {}, {}
    for k, n in enumerate(names):
        for x in sets[n]:
            for other in holders.setdefault(x, []):
                shared[other, k] = shared.get((other, k), 0) + 1
            holders[x].append(k)
    pairs = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[names[a]]) + len(sets[names[b]]) - n)]
    label = list(range(len(names)))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [y if v == x else v for v in label]
    place, least = {n: k for k, n in enumerate(names)}, {}
    for i, t in rows:
        c = label[place[tuple((t or "").encode().lower().split())]]
        least[c] = min(i, least.get(c, i))
    return pairs, sorted(least.values())


def test_near_duplicates_stage_finds_all_of_likeness(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs, want = brute_near_copies([(r.doc_id, r.text) for r in given.collect()])
    assert len(pairs) == 5 and sorted(r.doc_id for r in stage(spark, given, "").collect()) == want
    rng, rows = random.Random(11), []
    for k in range(60):  # chains, and pairs on both sides of the likeness
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(3, 400))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            words = [w if rng.random() > rng.choice((0.01, 0.02, 0.03)) else "new" for w in words]
    pairs, want = brute_near_copies(rows)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(pairs) > 60 and sorted(r.doc_id for r in stage(spark, made, "").collect()) == want


@pytest.mark.parametrize("at_once", [8, 512])
def test_near_copies_in_dense_buckets(spark, monkeypatch, at_once):
    """A hundred edits of one text, most pairs of which are a little too different, against brute force."""
    monkeypatch.setattr(likeness, "AT_ONCE", at_once)
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(k, " ".join(w if rng.random() > 0.025 else f"e{rng.randrange(9000)}" for w in base)) for k in range(100)]
    pairs, want = brute_near_copies(rows)
    assert 20 < len(pairs) < 1000 and 20 < len(want) < 95
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in likeness.near_copies_keep(made).collect()) == want


@pytest.mark.parametrize("at_once, most", [(4096, 1), (64, 13), (4096, None)])
def test_near_copies_left_open_come_once(spark, monkeypatch, at_once, most):
    """What closeness connects and likeness does not comes once for each chunk of its group, not once more for each block.

    The last case is compared bucket by bucket, as where a group's chunks would make more rows.
    """
    monkeypatch.setattr(likeness, "AT_ONCE", at_once)
    if not most:
        chunks = likeness._chunks
        monkeypatch.setattr(likeness, "_chunks", lambda part: F.lit(1000) if part == 8 else chunks(part))
    dealt, real = [], likeness._together
    monkeypatch.setattr(likeness, "_together", lambda df: (dealt.append(df), real(df))[1])
    rng = random.Random(15)
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    rows = [(k, " ".join(w if rng.random() > 0.025 else f"e{rng.randrange(9000)}" for w in base)) for k in range(100)]
    counted = []
    monkeypatch.setattr(likeness, "released", lambda *frames: counted or len(dealt) < 2 or counted.append(dealt[1].groupBy("fp").count().agg(F.max("count")).first()[0]))
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in likeness.near_copies_keep(made).collect()) == brute_near_copies(rows)[1]
    assert counted == [most] if most else counted[0] > 10


def test_links_hang_on_one_hub(spark):
    """Members that have the same few hubs keep about one link each, in the same components."""
    from tracewell.llm import components

    rng = random.Random(16)
    hubs = [b"%04d" % k for k in rng.sample(range(10000), 40)]
    rows = [(b"%04d" % a, h) for a in range(300) for h in rng.sample(hubs, 20)] + [(b"z1", b"z0"), (b"z2", b"z1"), (b"z3", b"z3"), (hubs[0], hubs[1])]
    links = spark.createDataFrame(rows, "a binary, b binary").repartition(3)
    parts = lambda df: sorted((bytes(r.node), bytes(r.component)) for r in components.connected_components(df).collect())
    assert parts(components.hung(links)) == parts(links)
    assert links.count() == 6004 and components.hung(links).count() < 700


def test_near_copies_go_into_components_with_few_links(spark, monkeypatch):
    """A crowd's members meet other middles in each of 32 blocks; the rounds of components get few links of each."""
    taken, real = [], likeness.connected_components
    monkeypatch.setattr(likeness, "connected_components", lambda df: (taken.append(df.where("a <> b").distinct().count()), real(df))[1])
    rng = random.Random(17)
    base = [f"w{rng.randrange(9000)}" for _ in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.012 else f"e{rng.randrange(9000)}" for w in base)) for k in range(500)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in likeness.near_copies_keep(made).collect()) == brute_near_copies(rows)[1]
    n = len({t for _, t in rows})
    assert len(taken) == 3 and max(taken) < 3 * n and taken[2] < n, (n, taken)


def brute_wide(text, bits):
    """A SimHash of so many bits, shingle by shingle."""
    words, m = (text or "").encode().lower().split(), 2**64 - 1
    found = {xxhash.xxh64_intdigest(b" ".join(words[k : k + 5]), 42) for k in range(max(1, len(words) - 4))}
    ones = [0] * bits
    for h in found:
        for k in range(-(-bits // 64)):
            x = (h + k * 0x9E3779B97F4A7C15) & m
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
            # numpy unpacks bytes in order, the highest bit of each first
            for at, byte in enumerate((x ^ (x >> 31)).to_bytes(8, "little")):
                for b in range(8):
                    if 64 * k + 8 * at + b < bits:
                        ones[64 * k + 8 * at + b] += byte >> (7 - b) & 1
    return [int(2 * n > len(found)) for n in ones]


@pytest.mark.parametrize("at_once, plan", [(4096, (32, 5)), (2, (38, 6))])
def test_near_copies_meet_by_simhash(spark, monkeypatch, at_once, plan):
    """What meets is what brute force finds: SimHash fingerprints with a whole block in common, close in Hamming distance."""
    monkeypatch.setattr(likeness, "AT_ONCE", at_once)
    rng, texts = random.Random(13), []
    for n in (4, 8, 9, 30, 120, 200) * 7:
        words = [f"w{rng.randrange(9000)}" for _ in range(n)]
        for _ in range(4):
            texts.append(" ".join(words))
            words = [w if rng.random() > 0.02 else "new" for w in words] + ["more"] * (n < 10)
    texts = sorted(set(texts))
    assert likeness.block_plan(len(texts)) == plan
    bits = [brute_wide(t, max(256, plan[0] * plan[1])) for t in texts]
    for t, b in zip(texts, bits):
        assert simhash.wide_simhash(likeness.shingle_set(likeness._line(t)), len(b)).tolist() == b
    size, want = plan[1], set()
    apart = lambda a, b, n: sum(x != y for x, y in zip(a[:n], b[:n]))
    for (s, a), (t, b) in itertools.combinations(zip(texts, bits), 2):
        if apart(a, b, 128) <= 47 and apart(a, b, 256) <= 80:
            want |= {frozenset((s, t, k)) for k in range(plan[0]) if a[size * k : size * k + size] == b[size * k : size * k + size]}
    name = {likeness._print(likeness._line(t)): t for t in texts}
    given = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    met = likeness.close_members(given.select(likeness._banded(F.col("text"), 5, plan).alias("p")).select("p.*")).collect()
    stars = {frozenset((name[bytes(r.fp)], name[bytes(o)], r.band)) for r in met for o in (r.near, r.before) if o is not None}
    assert stars and stars <= want
    assert {(t, k) for t, k in ((name[bytes(r.fp)], r.band) for r in met)} == {(t, k) for s in want for k in s if isinstance(k, int) for t in s if isinstance(t, str)}
    pairs, kept = brute_near_copies(list(enumerate(texts)))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert len(pairs) > 50 and sorted(r.doc_id for r in likeness.near_copies_keep(made).collect()) == kept
    with pytest.raises(ValueError):
        likeness.near_copies_keep(made, like=(3, 4))


@pytest.mark.parametrize("step", [1 << 19, 3000])
def test_crowds_of_close_prints(monkeypatch, step):
    """Fingerprints are connected as all pairs connect them, though those of a crowd meet its middle only."""
    monkeypatch.setattr(likeness, "STEP", step)
    rng = np.random.default_rng(14)
    made = [rng.random(256) < 0.5 for _ in range(3)]
    noisy = lambda base, n, odds: np.packbits(base ^ (rng.random((n, 256)) < odds), axis=1).view(np.uint64)
    sims = np.concatenate([noisy(made[0], 300, 0.1), noisy(made[0], 40, 0.25), noisy(made[1], 150, 0.12), noisy(made[2], 5, 0.1), rng.integers(0, 2**63, (200, 4), dtype=np.uint64)])
    sims = np.ascontiguousarray(sims[rng.permutation(len(sims))])
    far = np.bitwise_count(sims[:, None] ^ sims[None])
    close = (far.sum(axis=2) <= 80) & (far[:, :, :2].sum(axis=2) <= 47) & ~np.eye(len(sims), dtype=bool)
    assert (likeness._balls(sims) >= 0).sum() > 300

    def parts(close):
        label = np.arange(len(close))
        for a, b in zip(*np.nonzero(close)):
            if label[a] != label[b]:
                label[label == label[a]] = label[b]
        return label

    for half, single in ((np.zeros(len(sims), int), True), (rng.integers(0, 2, len(sims)), False)):
        root, near, before = likeness.close_prints(sims, half, single)
        met = close & (single | (half[:, None] != half[None]))
        want = parts(met)
        assert all(len(set(root[want == c])) == 1 for c in set(want))
        every = parts(close)
        assert all(len(set(every[root == c])) == 1 for c in set(root))
        assert (near >= 0)[met.any(axis=1)].all() and all(close[i, v[i]] for v in (near, before) for i in np.flatnonzero(v >= 0))


def test_embeddings_of_any_size_and_in_chunks(spark, monkeypatch):
    """Tiny and huge components are linked as others are; a cell in chunks gives what brute force gives."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=24)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.05, 24)]) for i in range(70)] + [(100 + i, [float(x) for x in rng.normal(size=24)]) for i in range(30)]
    rows += [(200, [1e-200, 2e-200]), (201, [2e-200, 4e-200]), (202, [1e200, 2e200]), (203, [3e300, 6e300]), (204, [-1.0, -2.0]), (205, [5e-324, 1e-323])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95
    want = {i: sum(cos(unit[i], unit[j]) for j in unit if j != i) for i in unit}
    assert want[200] == 4 and want[204] == 0 and sum(want[i] for i in range(70)) > 4000
    for at_once in (4, 16, lattice.AT_ONCE):
        monkeypatch.setattr(lattice, "AT_ONCE", at_once)
        assert {r.vec_id: r.n_links for r in lattice.embedding_groups(df).collect()} == want


def test_without_broadcasts(spark, docs, monkeypatch, tmp_path):
    """What is broadcast while it is small is joined by a shuffle beyond that, with the same rows."""
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, (_, t) in enumerate(ROWS)], "page_id long, url string, html string")

    def every(name):
        warc.write_archives(pages, str(tmp_path / name))
        records = warc.read_archives(spark, str(tmp_path / name)).select("payload_sha256", "payload_size", "head").collect()
        plain = sorted((r.payload_sha256, r.payload_size, b"revisit" in r.head) for r in records)
        kept = [sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in keep(docs).collect()) for keep in (simhash.simhash_keep, likeness.near_copies_keep)]
        pieces = packing.pack_documents(docs.where("length(text) < 100 or text is null"), BYTES)
        packed = sorted((r.doc_id or -9, r.piece, r.start, r.length) for r in pieces.collect())
        return plain, kept, packed, pieces.select("sequence_id").distinct().count()

    want = every("few")
    for module in (simhash, likeness, packing, warc):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert every("many") == want


def test_texts_are_one_by_128_bits(spark, monkeypatch):
    """Texts whose prints agree in their first 64 bits only are two texts, and both stay."""
    real = likeness._print
    assert len(real(b"x")) == 16 and real(b"x") != real(b"y")
    label = likeness.print_column
    docs = spark.createDataFrame([(1, "A  b\tc"), (2, "a b C"), (3, "a b d")], "doc_id long, text string")
    assert docs.select(label(F.col("text")).alias("p")).distinct().count() == 2
    half = b"12345678"
    edges = spark.createDataFrame([(half + b"aaaaaaaa", half + b"bbbbbbbb")], "a binary, b binary")
    assert {bytes(r.component) for r in likeness.connected_components(edges).collect()} == {half + b"aaaaaaaa"}
    rows = {"c": np.array([half + b"aaaaaaaa", half + b"bbbbbbbb"], object), "half": np.zeros(2, int), "band": np.zeros(2, int), "single": np.array([True, True])}
    sets = [np.array([1, 2, 3], np.int64)] * 2
    assert likeness.spanning_links(rows, np.zeros((2, likeness.BANDS), np.int64), sets, likeness.LIKE) == [(0, 1)]
    assert sorted(r.doc_id for r in likeness.near_copies_keep(docs).collect()) == [1, 3]


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), c.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    plain = lambda d: d[columns].astype(object).where(d[columns].notna(), None).values.tolist()
    same(plain(got), plain(want))
