"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, langid, lattice, minhash, packing, sanitise, sharding, simhash, substring, trie, warc
from .common import hex_of, small_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the query's session, whose Python workers are kept small."""
    small_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at a cosine of 0.95 or more."""
    return lattice.embedding_groups(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc.doc_id", "held_out", "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    found = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a 49k vocabulary and decoded again."""
    found = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = rows.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")))
    return chat.read_back(chat.format_conversations(both, public_tokenizers.path("byte_bpe_50k.json")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back from them."""
    path = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    kind, said = warc.field(F.col("head"), "WARC-Type"), warc.field(F.col("head"), "WARC-Payload-Digest")
    number = lambda name: F.regexp_extract(warc.field(F.col("head"), name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    revisit = kind == "revisit"
    told = found.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(revisit, F.lit(None).cast("long")).otherwise(F.col("payload_size")).alias("own"),
        F.when(revisit, F.substring_index(said, ":", -1)).otherwise(F.col("payload_sha256")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(revisit, number("WARC-Refers-To")).alias("refers_to"),
    )
    sizes = told.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("own").alias("of_response"))
    sized = told.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("own", F.col("of_response")).drop("of_response")
    both = told.where("record_type = 'response'").unionByName(sized)
    return both.select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash fingerprints of all documents and of their edited texts."""
    found = minhash.fingerprint_table(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 64-bit SimHash of 3-word shingles, 2 bits apart at most."""
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose sizes in rows differ by at most one."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = sharding.shard(sized, 24, ["text_crc32", "size"], seed=20240229)
    return found.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 13-word windows that start in a smaller document too are removed from all documents."""
    found = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters of all documents overlap, in each of their 120 orders, by language."""
    return audit.filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations, rebuilt with shared first turns."""
    found = trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that would give it away."""
    found = sanitise.sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in sanitise.KINDS]
    return found.select("doc.doc_id", *counts, F.sha2(sanitise.listed(of(*sanitise.KINDS)), 256).alias("base_sha256"), sanitise.listed(F.col("spans")).alias("spans"))


QUERIES = {"op1_sharding": op1_sharding, "op2_substring": op2_substring, "op3_embeddings": op3_embeddings, "op4_language": op4_language, "op5_packing": op5_packing, "op6_bpe": op6_bpe, "op7_chat": op7_chat, "op8_warc": op8_warc, "op9_fingerprints": op9_fingerprints, "op10_simhash": op10_simhash, "op11_audit": op11_audit, "op12_trie": op12_trie, "op13_pii": op13_pii}


def _sharding_sql() -> str:
    """The permutation as a recursive query: a row's halves go through the rounds until they are in range again."""
    p, (f0, f1, _) = sharding.PRIME, sharding.FACTORS
    keys = ", ".join(map(str, sharding._keys(20240229)))
    stir = lambda x: f"xor(({{0}}), ({{0}}) >> 13)".replace("{0}", f"((xor(({{1}}), ({{1}}) >> 15)) * {f1} + key) % {p}").replace("{1}", f"(({x}) * {f0} + key) % {p}")
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, bits
), bucketed AS (
  SELECT *, ((((((coalesce(doc_id, 0) % {p}) + {p}) % {p}) * {f0} + 12345) % {p}) >> 8) % {sharding.BUCKETS} AS bucket FROM sized
), numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM bucketed
), sides AS (
  SELECT *, (floor(sqrt(n - 1)) + 1)::BIGINT AS a FROM numbered
), ruled AS (
  SELECT *, (n + a - 1) // a AS b, [{keys}]::BIGINT[] AS keys FROM sides
), walk AS (
  SELECT r, n, a, b, keys, r // b AS lft, r % b AS rgt, 0 AS i FROM ruled
  UNION ALL
  SELECT r, n, a, b, keys,
    CASE WHEN i % 2 = 0 THEN (lft + {stir("rgt")}) % a ELSE lft END,
    CASE WHEN i % 2 = 1 THEN (rgt + {stir("lft")}) % b ELSE rgt END, i + 1
  FROM (SELECT *, keys[i % {sharding.ROUNDS} + 1] AS key FROM walk WHERE i = 0 OR i % {sharding.ROUNDS} <> 0 OR lft * b + rgt >= n)
), placed AS (
  SELECT r, lft * b + rgt AS pos FROM walk WHERE i > 0 AND i % {sharding.ROUNDS} = 0 AND lft * b + rgt < n
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos % 24)::INT AS shard, (pos // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered JOIN placed USING (r)"""


SQL: dict[str, str] = {
    "op1_sharding": _sharding_sql(),
    "op2_substring": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13)
), firsts AS (
  SELECT h, min(doc_id) AS first FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM win JOIN firsts USING (h) WHERE doc_id > first
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS line, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
    "op3_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT DISTINCT a AS node, a AS seen FROM links
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), least AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.node = vec_id
""",
    "op11_audit": r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY text) < coalesce(doc_id, 9223372036854775807) THEN 'E' ELSE '' END AS fails
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM letter a, letter b, letter d, letter e, letter g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS upto FROM orders, (SELECT unnest(range(1, 6)) AS step), (SELECT DISTINCT part FROM m)
), told AS (
  SELECT s.part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS only_hit,
    len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(upto, x))) > 0 AS gone
  FROM steps s JOIN m USING (part)
), counted AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_hit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
""",
    "op12_trie": """
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, (xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9)::INT AS h FROM c, crc
), rebuilt AS (
  SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5
), prefixes AS (
  SELECT conv_id, d, len(turns) AS n, md5(turns[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN md5(turns[1:d - 1]::VARCHAR) END AS parent,
    CASE WHEN d > 0 THEN octet_length(encode(turns[d].text)) ELSE 0 END AS size, list_transform(range(0, d + 1), lambda k: md5(turns[1:k]::VARCHAR)) AS above
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), nodes AS (
  SELECT node, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, any_value(above) AS above,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY node, d
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT top AS node, sum(saved) AS saved_tokens, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
  FROM (SELECT unnest(above) AS top, saved, n_children FROM nodes LEFT JOIN children USING (node)) GROUP BY top
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children k USING (node) LEFT JOIN nodes p ON p.node = n.parent
""",
}
