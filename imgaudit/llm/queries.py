"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, jaccard_join, language_id, license_scan, media, merkle, mixing, quality, secret_scan, sharding, token_alignment, token_counts


#: Shards of the sharding query and of the pipeline's last stage.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the word-level BPE vocabulary."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.license_matches(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the join of three-word shingle sets at a similarity of 0.9 or more."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards labelled good text keeps."""
    return quality.importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's text reads back as, stored as chunked sound."""
    return media.media_features(_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.page_texts(_table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside any thirteen-word window of a benchmark item."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and spans of languages of every document."""
    return language_id.predicted(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a piece vocabulary line up in every document."""
    return token_alignment.token_alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and verified witness of every document."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scans": op2_license_scans,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_media_columns": op6_media_columns,
    "op7_secret_scans": op7_secret_scans,
    "op8_html_extraction": op8_html_extraction,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_source_mixing": op10_source_mixing,
    "op11_language_id": op11_language_id,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = s.doc_id
"""

_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 13) AS k, array_to_string(ws[j:j + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS j FROM i WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, j, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (SELECT d.*, k.k, unnest(range(1, len(ws) - k.k + 2)) AS j FROM d, k WHERE len(ws) >= k.k)),
h AS (SELECT doc_id, j, g.k, item FROM g JOIN p ON g.g = p.g AND g.k = p.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _manifest_sql(levels: int = 7) -> str:
    """SQL of the manifest for trees of up to 16**levels nodes: a table of nodes for each level of sources, then of the whole."""

    def coded(x: str) -> str:
        return f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(coded, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"

    def climb(name: str, k: int) -> str:
        # a tree of one node has no further run: its node goes up as it is
        return f"""{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, p // 16 AS p, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h,
  CASE WHEN n = 1 THEN '' ELSE string_agg(h, '' ORDER BY p) END AS run FROM {name}{k - 1} GROUP BY tree, p // 16, n))"""

    def walk(name: str, base: str) -> str:
        # rows of leaves (w) get the texts before and after them, level by level
        parts, last = [], base
        for k in range(1, levels + 1):
            parts.append(f"""w{name}{k} AS (SELECT w.* REPLACE (w.place // 16 AS place, w.proof || CASE WHEN r.run = '' THEN '' ELSE substr(r.run, 1, 64 * (w.place % 16)) || substr(r.run, 64 * (w.place % 16) + 65) END AS proof,
  CASE WHEN r.run = '' THEN w.folded ELSE sha256(substr(r.run, 1, 64 * (w.place % 16)) || w.folded || substr(r.run, 64 * (w.place % 16) + 65)) END AS folded)
  FROM {last} w JOIN {name}{k} r ON r.tree = w.tree AND r.p = w.place // 16)""")
            last = f"w{name}{k}"
        return ",\n".join(parts)

    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    chain = ",\n".join(climb("s", k) for k in range(1, levels + 1))
    upper = ",\n".join(climb("t", k) for k in range(1, levels + 1))
    return f"""
WITH d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN coalesce(xor({crc}, 4294967295) % 5 = 0, false) THEN {leaf(lower)} END AS tampered FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT d.*, src.rank AS tree, row_number() OVER (PARTITION BY src.rank ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
s0 AS (SELECT tree, p, leaf AS h, '' AS run, count(*) OVER (PARTITION BY tree) AS n FROM l),
{chain},
t0 AS (SELECT 0 AS tree, tree AS p, h, '' AS run, count(*) OVER () AS n FROM s{levels}),
{upper},
w0 AS (SELECT doc_id, leaf, tree, tree AS rank, p AS place, '' AS proof, coalesce(tampered, leaf) AS folded FROM l),
{walk("s", "w0")},
v0 AS (SELECT w.* REPLACE (0 AS tree, w.rank AS place) FROM ws{levels} w),
{walk("t", "v0")}
SELECT w.doc_id, w.leaf, t0.h AS subroot, t{levels}.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t{levels}.h AS verified
FROM wt{levels} w JOIN t0 ON t0.p = w.rank JOIN t{levels} ON true
"""


ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": _OP3_SQL, "op9_benchmark_decontamination": _OP9_SQL, "op13_merkle_manifest": _manifest_sql()}
