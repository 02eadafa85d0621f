"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from overlay_jobs.llm import bpe, chat, minhash, mixing, pii, quality, ranking, repeats, secrets, token_counts, topk, warc, whitening
from overlay_jobs.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _digest(found: DataFrame, kinds: tuple[str, ...], base: Callable[[Column], Column]) -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans as text, and all spans as text."""
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("own", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "spans", F.filter("spans", base).alias("own")).select("doc_id", *map(count, kinds), F.sha2(say("own"), 256).alias("base_sha256"), say("spans").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(pii.find_pii(_table(spark, sf_dir, "documents")), pii.KINDS, lambda s: s["base"])


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    return _digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")), base, lambda s: s["kind"].isin(*base))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), new_path(spark, "token-cache"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_topk, op3_repeats, op4_warc, op5_pii, op6_near, op7_quality, op8_secrets, op9_chat, op10_bpe, op11_token_counts, op12_whitening, op13_ranking)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator; the others are held against brute force in tests/llm."""
    return {"op1_mixing": OP1, "op2_topk": OP2, "op7_quality": OP7, "op9_chat": OP9, "op13_ranking": OP13}


OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
         (3 * source_size)::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER o AS k,
         (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
water AS (SELECT arg_min(level, k) AS water FROM levels WHERE level <= cap / w),
targets AS (SELECT source, source_size, least(w * coalesce(water, 0), cap) AS target FROM levels LEFT JOIN water ON true),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds FROM targets),
runs AS (
  SELECT s.doc_id, s.size, s.h, p.source_size, p.target, p.rounds, p.target - p.rounds * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS UNBOUNDED PRECEDING) AS incl, s.size AS own
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (rounds + CASE WHEN incl <= budget OR (incl - own <= budget AND incl - budget < budget - (incl - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

OP7 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hot) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 4 * n_symbols > n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_letters < word_chars) AS kept
FROM j
"""

OP9 = r"""
WITH own AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS t, row_number() OVER () AS u FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM own WHERE role IS NOT NULL AND role <> 'system'),
segs AS (
  SELECT o.conv_id, s.speaker, o.turn, o.role, o.t, coalesce(floor(o.turn / 256), -1)::BIGINT AS part, o.u,
         CASE WHEN o.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
              WHEN o.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || coalesce(o.role, 'unknown') || chr(10) END AS head,
         coalesce(o.role = s.speaker, false) AS mine
  FROM own o JOIN speakers s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(t) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role NULLS FIRST, t NULLS FIRST, u
                ROWS UNBOUNDED PRECEDING) - length(t) - 11 AS a
  FROM segs)
SELECT conv_id, speaker, part, count(*)::BIGINT AS n_turns,
       string_agg(head || t || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, t, u) AS rendered,
       coalesce(string_agg(a::BIGINT || ':' || (a + length(t))::BIGINT, ',' ORDER BY a) FILTER (mine), '') AS masks,
       coalesce(sum(length(t)) FILTER (mine), 0)::BIGINT AS n_masked
FROM placed GROUP BY conv_id, speaker, part
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
i AS (
  SELECT row_number() OVER () AS v, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts
  FROM benchmark),
asked AS (SELECT v, item_id, unnest(ts) AS t FROM i),
size AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
tf AS (SELECT u, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT u, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY t),
s AS (
  SELECT v, item_id, u, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN df USING (t), size GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
