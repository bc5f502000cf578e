"""The queries of this subpackage, over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, interpolation, line_dedup, mixing, repeats, resampling, sharding, simhash, token_ids, toxicity, warc
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", F.col("shares_passage").cast("int").alias("shares_passage"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY h)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g USING (h)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# crc32 in SQL: a table of 16 entries by the polynomial's rule, and two steps of four bits for each byte of a text given in hexadecimal
_CRC_TABLE = """RECURSIVE bit AS (SELECT range AS i, 0 AS step, range AS c FROM range(16)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE step < 4),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bit WHERE step = 4)"""
_HALF = "xor(xor(c, y) >> 4, t[1 + (xor(c, y) & 15)])"


def _crc32_sql(x: str) -> str:
    octets = f"list_transform(regexp_extract_all({x}, '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, y: xor({_HALF} >> 4, t[1 + ({_HALF} & 15)])))"


def _highest_draw_sql(name: str, n: int, weight: str) -> str:
    """The child of highest ln(u) / weight, u by the md5 of its name and the row's key."""
    draw = f"ln((CAST('0x' || substr(md5({name} || '|' || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"
    return f"list_reduce(list_transform(range({n}), lambda i: {{'draw': {draw}, 'child': i}}), lambda a, b: CASE WHEN b.draw > a.draw THEN b ELSE a END).child"


OP4_SQL = f"""WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, hex(coalesce(text, '')) AS x, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
e AS (SELECT doc_id, size, key, {_crc32_sql('x')} AS text_crc32, {_highest_draw_sql("'region' || i", 2, '20')} AS region,
        {_highest_draw_sql("'region' || i", 3, 'CASE WHEN i < 2 THEN 20.0 ELSE 1.0 END')} AS grown FROM d, tab),
k AS (SELECT *, {_highest_draw_sql("'region' || region || '/rack' || i", 4, '5')} AS rack FROM e),
s AS (SELECT *, CAST(20 * region + 5 * rack + {_highest_draw_sql("'region' || region || '/rack' || rack || '/shard' || i", 5, '1')} AS INTEGER) AS shard FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CASE WHEN grown = 2 THEN 40 ELSE shard END AS grown_shard FROM s
"""


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_ids.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, end_id=END_ID)
    return token_ids.read_token_files(files, token_ids.ids_crc32, "ids_crc32 long").withColumnRenamed("id", "doc_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, top FROM p JOIN g USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + CAST(i // 4 AS INTEGER) * 5, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw JOIN (SELECT DISTINCT CAST(least(len(w), 5) AS BIGINT) AS k FROM iw WHERE len(w) > 0) ON len(w) >= k),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ds JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    copies = mixing.replicate(docs, mixing.source_rates(docs)).select("doc_id", "source", "n_copies", "copy", F.round("rate", 9).alias("rate"))
    return mixing.shuffled(copies)


OP10_SQL = r"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE sqrt(CAST(bytes AS DOUBLE)) / (SELECT sum(sqrt(CAST(bytes AS DOUBLE))) FROM s)
             * (SELECT sum(bytes) FROM s) / bytes END AS rate FROM s),
m AS (SELECT source, rate, greatest(ceil(rate / 64.0), 1) AS parts, rate / greatest(ceil(rate / 64.0), 1) AS mean FROM r),
c AS (SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM m
      UNION ALL SELECT c.source, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source
      WHERE k < ceil(3 * mean) + 96),
u AS (SELECT doc_id, documents.source, rate,
             (CAST('0x' || substr(md5('10|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS x
      FROM documents JOIN m ON documents.source IS NOT DISTINCT FROM m.source, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS t(part)),
n AS (SELECT doc_id, u.source, rate, CAST(count(c.k) AS INTEGER) AS n_copies
      FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.x GROUP BY doc_id, u.source, rate)
SELECT doc_id, source, n_copies, CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy, round(rate, 9) AS rate FROM n WHERE n_copies > 0
"""

def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = interpolation.text_scores(table(spark, sf_dir, "documents"))
    return scores.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")

_OP12_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w"
OP12_SQL = f"""WITH {_CRC_TABLE},
w AS (SELECT 0 AS side, doc_id, {_OP12_WORDS} FROM documents UNION ALL SELECT 1, NULL, {_OP12_WORDS} FROM benchmark),
f AS (SELECT side, doc_id, unnest(flatten(list_transform(range(1, 4), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS f FROM w),
c AS MATERIALIZED (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
h AS MATERIALIZED (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM c)),
b AS MATERIALIZED (SELECT f, {_crc32_sql('x')} % 10000 AS b FROM h, tab),
u AS (SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM c JOIN b USING (f) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM u),
s AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN b USING (f) JOIN g USING (b) WHERE side = 0 GROUP BY doc_id),
r AS (SELECT w.doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN s USING (doc_id) WHERE side = 0),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM o) THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS nl FROM w WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
l AS (SELECT lang, count(*) AS v, sum(nl) AS tl FROM k GROUP BY lang),
c AS (SELECT w.lang, source, w.term, count(*) AS n, any_value(nl) AS nl FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, source, w.term),
g AS (SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, any_value(tl) AS tl FROM d LEFT JOIN l ON d.lang = l.lang GROUP BY d.lang, d.source),
t AS (SELECT g.lang, g.source, g.v, g.tl, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
m AS (SELECT t.lang, t.source, k.term, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (total + 2 * v) AS p, coalesce(n, 0) AS n,
             1 + CAST(1000000000 AS HUGEINT) * (k.nl + 2) // (tl + 2 * v) AS q
      FROM t JOIN k ON t.lang = k.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM t a JOIN t b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM m WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_token_ids": op7_token_ids,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op4_sharding": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_warc": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
