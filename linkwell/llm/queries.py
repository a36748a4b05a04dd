"""The registered queries of the corpus operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwell.llm import ann, chat, divergence, exact_copies, html_extract, merkle, minhash, mixing, quality, sentencepiece_codec, sharding, simhash, toxicity
from linkwell.storage import scratch_path, table

#: Operator 9: parts of 128 MB, made from eight arrivals.
SHARD_BYTES, ARRIVALS = 128 << 20, 8


def tokenizer_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    return sentencepiece_codec.read_model(public_tokenizers.path(name))


def fold_of(parts: int) -> Column:
    """crc32 of the doc_id's decimal text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold_of(3) == 1).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), F.to_json("offending").alias("offending"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold_of(5) != 0)
    return quality.score(docs, model).select("doc_id", (fold_of(5) == 0).alias("held_out"), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.selectExpr("doc_id", "_size AS size", "_source_size AS source_size", "_target AS target", "_size * _copies AS taken")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op7_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_model())


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"), docs.schema, target_bytes=SHARD_BYTES)
    store.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum(keep=1, least_age=0)  # nobody else knows this store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_events(chat.events_of(rows.unionByName(own))))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(fold_of(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": tampered})
    folded = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.fold(F.col("altered_leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_exact_copies": op7_exact_copies,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_chat": op10_chat,
    "op11_merkle": op11_merkle,
    "op12_minhash": op12_minhash,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS i FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CASE k % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM s),
c AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS cap0, coalesce(sum(w) OVER o, 0) AS w0
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (all_w - w0) <= w * (1.5::DOUBLE * all_size - cap0) AS cut FROM c),
g AS (
  SELECT *, sum(CASE WHEN cut THEN cap ELSE 0 END) OVER () AS cut_cap, sum(CASE WHEN cut THEN w ELSE 0 END) OVER () AS cut_w FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN cut THEN cap::DOUBLE ELSE w::DOUBLE * (1.5::DOUBLE * all_size - cut_cap) / (all_w - cut_w) END AS target
  FROM g),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
r AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.times, u.target - u.times * u.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, d.size AS own
  FROM n AS d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, times + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op7_exact_copies": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_sharding": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op11_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS k,
         list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM documents),
e AS (
  SELECT k, doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
         text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM d),
h AS (
  SELECT k, doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(front || coalesce(strlen(tampered) || ':' || tampered, '-')) AS altered FROM e),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
t AS (
  SELECT 0 AS level, source, pos, leaf AS hash, n FROM leaves
  UNION ALL
  SELECT level + 1, source, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY level, source, pos // 3, n),
tops AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, hash, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, pos // 3, n),
sides AS (
  SELECT a.level, a.source, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM t AS a LEFT JOIN t AS b ON a.level = b.level AND a.source IS NOT DISTINCT FROM b.source AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos
  WHERE a.n > 1 GROUP BY a.level, a.source, a.pos),
crown AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM u AS a LEFT JOIN u AS b ON a.level = b.level AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos
  WHERE a.n > 1 GROUP BY a.level, a.pos),
steps AS (
  SELECT leaves.k, 0 AS part, s.level, s.l, s.r FROM leaves JOIN sides AS s ON s.source IS NOT DISTINCT FROM leaves.source AND s.pos = leaves.pos // (3 ** s.level)::BIGINT
  UNION ALL
  SELECT leaves.k, 1, c.level, c.l, c.r FROM leaves JOIN tops ON tops.source IS NOT DISTINCT FROM leaves.source JOIN crown AS c ON c.pos = tops.pos // (3 ** c.level)::BIGINT),
proofs AS (SELECT k, list({'l': l, 'h': '', 'r': r} ORDER BY part, level) AS steps, string_agg(l || r, '' ORDER BY part, level) AS siblings FROM steps GROUP BY k),
folded AS (
  SELECT leaves.*, tops.hash AS subroot, (SELECT hash FROM u WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_concat([{'l': '', 'h': altered, 'r': ''}], coalesce(steps, [])), lambda a, s: {'l': '', 'h': sha256(s.l || a.h || s.r), 'r': ''}).h AS folded_root
  FROM leaves JOIN tops ON tops.source IS NOT DISTINCT FROM leaves.source LEFT JOIN proofs USING (k))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "op12_minhash": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT k, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))) END AS found
  FROM w),
x AS (SELECT k, len(found) AS n, unnest(found) AS shingle FROM s),
common AS (SELECT a.k AS a, b.k AS b, a.n AS n, b.n AS m, count(*) AS c FROM x AS a JOIN x AS b USING (shingle) WHERE a.k < b.k GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k AS a, k AS b FROM s UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT reach.a AS k, min(s.doc_id) AS component_id FROM reach JOIN s ON s.k = reach.b GROUP BY reach.a)
SELECT doc_id, len(found)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN least USING (k)""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
e AS (
  SELECT g.lang, g.source, kept.term, kept.n_lang, coalesce(c.n, 0) AS n, v.v, v.n AS all_n
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // ((sum(n) OVER (PARTITION BY lang, source)) + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (n_lang + 2)) // (all_n + 2 * v) AS q
  FROM e),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
