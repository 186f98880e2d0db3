"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontaminate, jaccard, langid, ppm, quality, sharding, suffix_dedup, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_language_model(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_language, op4_neighbours, op5_shard_bytes, op6_decontaminate, op7_ppm, op8_quality, op9_bpe, op10_jaccard_join)}


# SQL

#: A-Z lower-cased, then runs of digits, small letters and characters beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _crc_table() -> str:
    """The 256 numbers of the checksum's table, from its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(str(n))
    return ", ".join(out)


SHARDS_SQL = f"""
WITH bytes AS (SELECT doc_id, rowid_, list_transform(range(1, 1 + 2 * strlen(coalesce(text, '')), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT) AS b
  FROM (SELECT doc_id, text, row_number() OVER () AS rowid_, hex(encode(coalesce(text, ''))) AS h FROM documents)),
rows AS (SELECT doc_id, len(b)::BIGINT + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, [{_crc_table()}][xor(c & 255, x) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT)::BIGINT AS text_crc32 FROM bytes),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM rows),
put AS (SELECT *, least(((before + size // 2) * 16) // total, 15)::INT AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM put
"""

CONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, s.n, i, array_to_string(w[i : i + s.n - 1], ' ') AS body FROM (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) s) t JOIN (SELECT DISTINCT n FROM windows) s USING (n)),
met AS (SELECT p.r, p.i, p.n, w.item_id FROM places p JOIN windows w ON w.n = p.n AND w.body = p.body),
hits AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0) UNION ALL SELECT r, '| ' || text FROM docs WHERE len(w) = 0),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y, c = a.n AND c = b.n AS equal FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE c * 10 >= 8 * (a.n + b.n - c)),
reach(r, root) AS (SELECT x, x FROM links UNION SELECT l.y, reach.root FROM reach JOIN links l ON l.x = reach.r),
groups AS (SELECT reach.r, min(d.doc_id) AS group_id FROM reach JOIN docs d ON d.r = reach.root GROUP BY reach.r),
counted AS (SELECT x AS r, count(*) AS n_links, count(*) FILTER (equal) AS copies, min(d.doc_id) FILTER (equal) AS least FROM links JOIN docs d ON d.r = y GROUP BY x)
SELECT doc_id, least(doc_id, least)::BIGINT AS class_id, (coalesce(copies, 0) + 1)::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, doc_id)::BIGINT AS group_id
FROM docs LEFT JOIN counted USING (r) LEFT JOIN groups USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """Neither models nor automata nor byte windows of whole tables fit SQL; those queries are tested by brute force, exact round
    trips, held-out accuracy or recall."""
    return {"op5_shard_bytes": SHARDS_SQL.strip(), "op6_decontaminate": CONTAMINATION_SQL.strip(), "op10_jaccard_join": JACCARD_SQL.strip()}
