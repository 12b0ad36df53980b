"""Queries over the dealt operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, packing, pii, pivots, repetition, sharding, simhash, suffix, warc

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    placed = sharding.shard_documents(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_documents(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).cast("long")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "shards")


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.write_spans(F.col("base")), 256).alias("base_sha256"),
        pii.write_spans(F.col("spans")).alias("spans"),
    )


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.warc_round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "repeat_covered", "longest_repeat",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), width=50, with_text=False)


def op10_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op5_sql() -> str:
    chars = " || ".join(f"substr('{warc.BASE32}', ((v >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0))
    digest = f"list_aggregate(list_transform(list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT), lambda v: {chars}), 'string_agg', '')"
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
  max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS m FROM pages)
SELECT page_id, payload_bytes, {digest} AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to FROM p"""


def _op10_sql() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in chat.CONTROLS:
            x = f"replace({x}, {_sql_text(c)}, {_sql_text(c[0] + chr(92) + c[1:])})"
        return x

    fixed = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    probe = "'</s>[INST] ok [/INST]'"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {probe} UNION ALL SELECT -1, 1, 'assistant', {probe}),
s AS (SELECT *, sum({fixed} + length({escaped('role')}) + length({escaped('text')})) OVER (PARTITION BY conv_id ORDER BY turn, role, text
    ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


def _op2_sql() -> str:
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS p, b.vec_id AS q FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS p, vec_id AS q FROM v UNION SELECT reach.p, link.q FROM reach JOIN link ON reach.q = link.p),
least AS (SELECT p, min(q) AS component_id FROM reach GROUP BY p),
many AS (SELECT p, count(*) AS n FROM link GROUP BY p)
SELECT v.vec_id, coalesce(many.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.vec_id = least.p LEFT JOIN many ON v.vec_id = many.p"""


def _op1_sql() -> str:
    unit = lambda salt: f"('0x' || substr(md5({salt}), 1, 13))::BIGINT"
    shards = lambda n: f"""list_reduce(range({n}), lambda p, s: CASE WHEN {unit("key || ':' || s")} > {unit("key || ':' || p")} THEN s ELSE p END)::INT"""
    table = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), b))"
    return f"""
WITH t AS (SELECT {table} AS crc),
d AS MATERIALIZED (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS b FROM documents),
p AS MATERIALIZED (SELECT doc_id, key, octet_length(b) + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32,
    {shards(SHARDS)} AS shard, {shards(SHARDS + 1)} AS grown_shard FROM d, t),
n AS (SELECT greatest(1, ceil(count(*) / ({SHARDS} * {sharding.BLOCK_ROWS}.0)))::BIGINT AS blocks FROM documents)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY {unit("'slot:' || key")} % blocks, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM p, n"""


def _op6_sql() -> str:
    """A repeat of LEAST_REPEAT words or more is covered by repeated windows of that many; the longest is found by doubling."""
    levels = 16

    def windows(width: int) -> str:
        """Words of each document that windows of this width, found twice or more in it, cover."""
        alike = ", ".join(f"lead(w, {i}) OVER o AS w{i}" for i in range(width))
        key = ", ".join(f"w{i}" for i in range(width))
        return f"""(SELECT d, count(*) AS n FROM (SELECT d, max(again) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS again
    FROM (SELECT d, i, w{width - 1} IS NOT NULL AND count(*) OVER (PARTITION BY d, {key}) > 1 AS again
      FROM (SELECT d, i, {alike} FROM u WINDOW o AS (PARTITION BY d ORDER BY i)))) WHERE again GROUP BY d)"""

    # l{k}: starts of repeats of 2 ** k words and their class. s{k}: starts of the longest repeats, to a multiple of 2 ** k.
    steps = ["l0 AS MATERIALIZED (SELECT d, i, min(i) OVER g AS c FROM u WINDOW g AS (PARTITION BY d, w) QUALIFY count(*) OVER g > 1)"]
    for k in range(1, levels + 1):
        steps.append(f"""l{k} AS MATERIALIZED (SELECT a.d, a.i, min(a.i) OVER g AS c FROM l{k - 1} a JOIN l{k - 1} b ON a.d = b.d AND b.i = a.i + {1 << k - 1}
  WINDOW g AS (PARTITION BY a.d, a.c, b.c) QUALIFY count(*) OVER g > 1)""")
    tops = " UNION ALL ".join(f"SELECT d, i, c, {1 << k} AS n FROM l{k} WHERE d NOT IN (SELECT d FROM l{k + 1})" for k in range(levels))
    steps.append(f"s{levels} AS MATERIALIZED ({tops})")
    for k in range(levels - 1, -1, -1):
        steps.append(f"""t{k} AS MATERIALIZED (SELECT a.d, a.i, min(a.i) OVER g AS c, a.n + {1 << k} AS n FROM s{k + 1} a JOIN l{k} b ON a.d = b.d AND b.i = a.i + a.n
  WINDOW g AS (PARTITION BY a.d, a.c, b.c) QUALIFY count(*) OVER g > 1)""")
        steps.append(f"s{k} AS MATERIALIZED (SELECT * FROM t{k} UNION ALL SELECT * FROM s{k + 1} WHERE d NOT IN (SELECT d FROM t{k}))")
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
y AS MATERIALIZED (SELECT d, doc_id, t, regexp_extract_all(t, '{word}+') AS ws, list_filter(string_split(t, chr(10)), lambda r: regexp_matches(r, '{word}')) AS rs FROM x),
u AS MATERIALIZED (SELECT d, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM y),
{", ".join(steps)},
m AS (SELECT y.d, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{repetition.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(rs) - len(list_distinct(rs)))::BIGINT AS n_dup_lines,
  coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS repeat_covered, coalesce(c.n, 0)::BIGINT AS longest_repeat
  FROM y LEFT JOIN {windows(repetition.WINDOW)} a ON y.d = a.d LEFT JOIN {windows(repetition.LEAST_REPEAT)} b ON y.d = b.d
  LEFT JOIN (SELECT d, max(n) AS n FROM s0 GROUP BY d) c ON y.d = c.d),
f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT * EXCLUDE (d), NOT base_failed AND repeat_covered <= {repetition.MAX_COVERED}::DOUBLE * n_words AND longest_repeat <= {repetition.MAX_LONGEST} AS kept FROM f"""


def _op9_sql() -> str:
    """Every byte window of every document, by itself."""
    return """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, o, i, b[i + 1 : i + 50] AS s FROM (SELECT r, o, b, unnest(range(octet_length(b) - 49)) AS i FROM d)),
first AS (SELECT s, min(o) AS o FROM w GROUP BY s HAVING min(o) < max(o)),
hit AS (SELECT w.r, w.i FROM w JOIN first USING (s) WHERE first.o < w.o),
run AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM hit)) GROUP BY r, g),
gap AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM run),
cut AS (SELECT r, count(*) AS n, sum(z - a) AS removed, max(z) AS last,
  string_agg(CASE WHEN a > p THEN hex(b[p + 1 : a]) ELSE '' END, '' ORDER BY a) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(kept || CASE WHEN octet_length(b) > last THEN hex(b[last + 1 : octet_length(b)]) ELSE '' END) END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rendezvous_shards": op1_rendezvous_shards,
        "op2_pivot_permutations": op2_pivot_permutations,
        "op3_mix_sources": op3_mix_sources,
        "op4_contextual_pii": op4_contextual_pii,
        "op5_warc_round_trip": op5_warc_round_trip,
        "op6_suffix_repetition": op6_suffix_repetition,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_covering_simhash": op8_covering_simhash,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_chat_examples": op10_chat_examples,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_rendezvous_shards": _op1_sql(),
        "op2_pivot_permutations": _op2_sql(),
        "op5_warc_round_trip": _op5_sql(),
        "op6_suffix_repetition": _op6_sql(),
        "op9_suffix_dedup": _op9_sql(),
        "op10_chat_examples": _op10_sql(),
    }
