"""The registered queries of the subpackage: one opN_<name> for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import documents, table_if_any
from .erasure import erased_files
from .fingerprints import compare_with_edits
from .jaccard import shingle_components
from .licenses import scan_licenses
from .minhash import minhash_components
from .mixing import mix_sources
from .quality import fit_limits, quality_bands
from .secrets import scan_secrets
from .sharding import shard_documents
from .spelling import spelling_groups
from .substrings import remove_repeats
from .token_files import token_file_index


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
        F.sha2("offsets", 256).alias("offsets_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position").orderBy("first_position", "doc_id")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op10_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_bands(docs, fit_limits(docs, table_if_any(spark, sf_dir, "labels")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir), n=2, num=80, den=100)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erased_files(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_sharding": op2_sharding,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_fingerprints": op5_fingerprints,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_mixing": op8_mixing,
    "op9_substrings": op9_substrings,
    "op10_quality_bands": op10_quality_bands,
    "op11_minhash": op11_minhash,
    "op12_spelling": op12_spelling,
    "op13_erasure": op13_erasure,
}

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS order_key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, ([5, 2, 1])[(rank % 3 + 1)::INT]::BIGINT AS weight, ([0.5, 0.0, -0.5])[(rank % 3 + 1)::INT]::DOUBLE AS tilt FROM r),
f AS (SELECT *, source_size / weight AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0))::BIGINT AS rest_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS open_weight
  FROM f WINDOW b AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, row_number() OVER (ORDER BY fill, rank) AS place, source_size * 3 * open_weight >= rest_size * weight AS is_open FROM l),
v AS (SELECT place AS level_place, rest_size AS level_size, open_weight AS level_weight FROM o WHERE is_open ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_size, tilt,
         CASE WHEN place >= level_place THEN (level_size * weight)::DOUBLE / level_weight ELSE (source_size * 3)::DOUBLE END AS target
  FROM o LEFT JOIN v ON true),
p AS (
  SELECT doc_id, size, source_size, target, tilt, floor(target)::BIGINT AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS passes FROM p),
z AS (SELECT *, passes * size + least(size, greatest(0, whole - passes * source_size - prefix)) AS taken FROM q)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN tilt = 0 THEN prefix / target
            ELSE ((1.0 + tilt) - sqrt((1.0 + tilt) * (1.0 + tilt) - 4.0 * tilt * (prefix / target))) / (2.0 * tilt) END, 9) END AS first_position
FROM z
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(near) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS docs FROM s GROUP BY g),
p AS (SELECT s.doc_id, g, n FROM s JOIN f USING (g) JOIN n USING (doc_id) QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY docs, g) <= n - (80 * n + 99) // 100 + 1),
t AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
c AS (SELECT a, b, na, nb, count(*) AS common FROM t JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
e AS (SELECT a, b FROM c WHERE 100 * common >= 80 * (na + nb - common) UNION ALL SELECT b, a FROM c WHERE 100 * common >= 80 * (na + nb - common)),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(near) AS component_id, d.doc_id = min(near) AS kept
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT place, k, array_to_string(w[k:k + 34], ' ') AS g FROM (SELECT place, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
r AS (SELECT place, k FROM v QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT place, k + j AS spot FROM r, range(0, 35) t(j)),
words AS (SELECT place, unnest(range(1, len(w) + 1)) AS spot, unnest(w) AS word FROM d),
kept AS (SELECT place, string_agg(word, ' ' ORDER BY spot) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (place, spot) GROUP BY place)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (place)
"""

ORACLE_SQL: dict[str, str] = {"op6_jaccard_join": OP6_SQL, "op11_minhash": OP11_SQL, "op8_mixing": OP8_SQL, "op9_substrings": OP9_SQL}
