"""Registered queries of the core library and their DuckDB counterparts.

The driver's tables stand in for the library's own: ``events`` are scored views of images,
``documents`` items with provenance, ``labels`` their labels, ``embeddings`` a feature table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, conditions, keys
from ..operators import exclusion, images, metrics, near_duplicates, probe, resampling, sampling, scoreboard
from ..streaming import rounds as stream_rounds
from . import audit, training

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
T = 0.5


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# events as scored views ---------------------------------------------------------------------------

_CONDITION = {"view": "clean", "click": "jpeg_q90", "purchase": "jpeg_q50", "signup": "blur_sigma1.0", "error": "noise_sigma0.05"}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, ts, source, condition, label, score."""
    e = _read(spark, sf_dir, "events")
    named = F.create_map(*[F.lit(x) for kv in _CONDITION.items() for x in kv])
    return e.select(
        F.col("event_id").alias("image_id"),
        "ts",
        F.concat(F.lit("s"), F.col("user_id") % 12).alias("source"),
        named[F.col("event_type")].alias("condition"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)).alias("label"),
        (F.col("value") / (F.col("value") + 25.0)).alias("score"),
    )


_SCORED = """WITH scored AS (SELECT event_id AS image_id, ts, 's' || (user_id % 12) AS source,
  CASE event_type WHEN 'view' THEN 'clean' WHEN 'click' THEN 'jpeg_q90' WHEN 'purchase' THEN 'jpeg_q50'
    WHEN 'signup' THEN 'blur_sigma1.0' ELSE 'noise_sigma0.05' END AS condition,
  CAST(json_extract_string(props, '$.k') AS INT) % 2 AS label, value / (value + 25.0) AS score FROM events)"""


def _auc_sql(key: str, source: str = "scored") -> str:
    """CTEs ranked_KEY and auc_KEY with n, auc, confusion counts by key."""
    return f""", ranked_{key} AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY score)
    + (count(*) OVER (PARTITION BY {key}, score) - 1) / 2.0 AS r FROM {source}),
  sums_{key} AS (SELECT {key}, count(*) AS n, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS q,
    sum(CASE WHEN label = 1 THEN r END) AS rs,
    count(*) FILTER (WHERE label = 0 AND score < {T}) AS tn, count(*) FILTER (WHERE label = 0 AND score >= {T}) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < {T}) AS fn, count(*) FILTER (WHERE label = 1 AND score >= {T}) AS tp
    FROM ranked_{key} GROUP BY {key}),
  auc_{key} AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END AS auc,
    (tn + tp) / CAST(n AS DOUBLE) AS accuracy,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM sums_{key})"""


@_query(_SCORED + _auc_sql("condition") + " SELECT condition, round(auc, 6) AS auc FROM auc_condition")
def auc_by_condition(spark, sf):
    return _rounded(metrics.roc_auc(scored(spark, sf), ["condition"]))


_MATRIX = _SCORED + _auc_sql("condition")


@_query(_MATRIX + " SELECT condition, n, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(auc, 6) AS auc FROM auc_condition")
def score_matrix(spark, sf):
    return _rounded(metrics.score_matrix(scored(spark, sf), ["condition"], T))


@_query(
    _MATRIX
    + """ SELECT condition, n, tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(f1, 6) AS f1,
  round((tp + fp) / n, 6) AS fake_rate,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM auc_condition"""
)
def threshold_metrics(spark, sf):
    return _rounded(metrics.threshold_metrics(scored(spark, sf), ["condition"], T))


_FAMILY = """, fam AS (SELECT split_part(condition, '_', 1) AS family, avg(auc) AS auc, count(*) AS n FROM auc_condition WHERE condition <> 'clean' GROUP BY 1)"""


@_query(
    _MATRIX
    + _FAMILY
    + """, a AS (SELECT (SELECT auc FROM auc_condition WHERE condition = 'clean') AS c, (SELECT avg(auc) FROM auc_condition WHERE condition <> 'clean') AS m,
  (SELECT count(*) FROM auc_condition WHERE condition <> 'clean') AS k, (SELECT avg(auc) FROM fam) AS f, (SELECT count(*) FROM fam) AS g)
  SELECT round(c, 6) AS clean_auc, round(m, 6) AS condition_auc, k AS n_conditions, round(f, 6) AS family_auc, g AS n_families,
  round((c + m) / 2, 6) AS condition_score, round((c + f) / 2, 6) AS family_score FROM a"""
)
def robustness(spark, sf):
    """Exact AUC by condition and the robustness composites."""
    return _rounded(metrics.aggregate_robustness(metrics.roc_auc(scored(spark, sf), ["condition"])))


@_query(_MATRIX + _FAMILY + " SELECT family, round(auc, 6) AS auc, n FROM fam")
def family_auc(spark, sf):
    return _rounded(metrics.family_auc(metrics.roc_auc(scored(spark, sf), ["condition"])))


@_query(
    _MATRIX
    + """ SELECT 'events' AS dataset, 'individual_transform' AS kind, count(*) AS n, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc,
  round((SELECT auc FROM auc_condition WHERE condition = 'clean'), 6) AS clean_auc,
  round(((SELECT auc FROM auc_condition WHERE condition = 'clean') + avg(auc)) / 2, 6) AS composite FROM auc_condition WHERE condition <> 'clean'"""
)
def stress_summary(spark, sf):
    return _rounded(metrics.stress_summary(metrics.roc_auc(scored(spark, sf), ["condition"]).withColumn("dataset", F.lit("events"))))


@_query(
    _MATRIX
    + """, c AS (SELECT auc AS clean_auc FROM auc_condition WHERE condition = 'clean')
  SELECT condition, round(auc, 6) AS auc, round(clean_auc, 6) AS clean_auc, round(clean_auc - auc, 6) AS "drop", round((clean_auc - auc) / clean_auc, 6) AS relative_drop
  FROM auc_condition, c WHERE condition <> 'clean'"""
)
def condition_drop(spark, sf):
    return _rounded(metrics.condition_drop(metrics.roc_auc(scored(spark, sf), ["condition"])))


_CURVE = """, h AS (SELECT condition, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1, 2),
  curve AS (SELECT condition, score AS threshold, CAST(sum(pos) OVER w AS DOUBLE) / sum(pos) OVER (PARTITION BY condition) AS tpr,
    CAST(sum(neg) OVER w AS DOUBLE) / sum(neg) OVER (PARTITION BY condition) AS fpr FROM h WINDOW w AS (PARTITION BY condition ORDER BY score DESC))"""


@_query(
    _SCORED
    + _CURVE
    + " SELECT condition, round(threshold, 9) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM curve UNION ALL SELECT DISTINCT condition, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM scored"
)
def roc_curve(spark, sf):
    r = metrics.roc_curve(scored(spark, sf), ["condition"])
    finite = F.when(F.col("threshold") < float("inf"), F.round("threshold", 9)).otherwise(F.col("threshold"))
    return r.select("condition", finite.alias("threshold"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@_query(
    _SCORED
    + _CURVE
    + """, j AS (SELECT *, tpr - fpr AS youden, max(tpr - fpr) OVER (PARTITION BY condition) AS best FROM curve WHERE threshold BETWEEN 0 AND 1)
  SELECT condition, round(threshold, 9) AS threshold, round(youden, 6) AS youden FROM j WHERE best - youden <= 1e-8 + 1e-5 * abs(best)
  QUALIFY row_number() OVER (PARTITION BY condition ORDER BY abs(threshold - 0.5), threshold DESC) = 1"""
)
def calibrate_threshold(spark, sf):
    r = metrics.calibrate_threshold(scored(spark, sf), ["condition"])
    return r.select("condition", F.round("threshold", 9).alias("threshold"), F.round("youden", 6).alias("youden"))


@_query(
    _SCORED
    + _auc_sql("condition")
    + """, s AS (SELECT condition, stddev_pop(score) AS sd, quantile_cont(score, 0.5) FILTER (WHERE label = 0) AS rm, quantile_cont(score, 0.5) FILTER (WHERE label = 1) AS fm FROM scored GROUP BY 1),
  g AS (SELECT a.condition AS dataset, n, accuracy, f1, auc, (tp + fp) / n AS fake_rate, sd, rm, fm,
    list_filter([CASE WHEN auc < 0.5 THEN 'auc' END, CASE WHEN sd < 0.01 THEN 'score_std' END, CASE WHEN (tp + fp) / n NOT BETWEEN 0.05 AND 0.95 THEN 'predicted_fake_rate' END,
      CASE WHEN fm <= rm THEN 'median_order' END], lambda x: x IS NOT NULL) AS fails FROM auc_condition a JOIN s USING (condition))
  SELECT dataset, n, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(auc, 6) AS auc, round(fake_rate, 6) AS fake_rate, round(sd, 6) AS score_std,
    round(rm, 6) AS real_median, round(fm, 6) AS fake_median, 0.5::DOUBLE AS min_auc, array_to_string(fails, ',') AS failures, len(fails) = 0 AS passed FROM g"""
)
def promotion_gates(spark, sf):
    rows = scored(spark, sf).withColumn("dataset", F.col("condition"))
    least = rows.select("dataset").distinct().withColumn("min_auc", F.lit(0.5))
    return _rounded(metrics.promotion_gates(rows, least, T))


_BINS = """, e AS (SELECT CAST(range AS INT) AS bin, range / 10.0 AS lower, (range + 1) / 10.0 AS upper FROM range(10)),
  b AS (SELECT CAST((score >= 0.1)::INT + (score >= 0.2)::INT + (score >= 0.3)::INT + (score >= 0.4)::INT + (score >= 0.5)::INT + (score >= 0.6)::INT + (score >= 0.7)::INT
    + (score >= 0.8)::INT + (score >= 0.9)::INT AS INT) AS bin, count(*) AS n, avg(score) AS ms, avg(label) AS pr FROM scored GROUP BY 1),
  bins AS (SELECT e.bin, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, coalesce(n, 0) AS n, ms, pr FROM e LEFT JOIN b ON e.bin = b.bin)"""


@_query(_SCORED + _BINS + " SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, n, round(ms, 6) AS mean_score, round(pr, 6) AS positive_rate FROM bins")
def reliability_bins(spark, sf):
    return _rounded(metrics.reliability_bins(scored(spark, sf)))


@_query(_SCORED + _BINS + " SELECT (SELECT round(sum(n * abs(ms - pr)) / sum(n), 6) FROM bins) AS ece, round(avg((score - label) * (score - label)), 6) AS brier FROM scored")
def calibration_error(spark, sf):
    return _rounded(metrics.calibration_error(scored(spark, sf)))


_KEYED = """, b AS (SELECT condition, least(CAST(floor(score * 10 + 1e-12) AS INT), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(label) AS pr FROM scored GROUP BY 1, 2),
  e AS (SELECT condition, CAST(range AS INT) AS bin, CAST(range / 10.0 AS DOUBLE) AS lower, CAST((range + 1) / 10.0 AS DOUBLE) AS upper FROM (SELECT DISTINCT condition FROM scored), range(10))"""


@_query(_SCORED + _KEYED + " SELECT condition, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(n, 0) AS n, round(ms, 6) AS mean_score, round(pr, 6) AS positive_rate FROM e LEFT JOIN b USING (condition, bin)")
def reliability_by_condition(spark, sf):
    return _rounded(metrics.reliability_bins(scored(spark, sf), keys=["condition"]))


@_query(_SCORED + _KEYED + ", c AS (SELECT condition, sum(n * abs(ms - pr)) / sum(n) AS ece FROM b GROUP BY 1) SELECT condition, round(any_value(ece), 6) AS ece, round(avg((score - label) * (score - label)), 6) AS brier FROM scored JOIN c USING (condition) GROUP BY 1")
def calibration_by_condition(spark, sf):
    return _rounded(metrics.calibration_error(scored(spark, sf), keys=["condition"]))


@_query(_SCORED + " SELECT condition, count(*) FILTER (WHERE score = 0) AS n_zero, count(*) FILTER (WHERE score = 1) AS n_one, count(DISTINCT score) AS distinct_prob, count(DISTINCT score) AS distinct_margin FROM scored GROUP BY 1")
def saturation(spark, sf):
    return metrics.saturation(scored(spark, sf), ["condition"], "score", "score")


_Q = ", ".join(f"round(quantile_cont(score, {p}), 6) AS {n}" for p, n in ((0.0, "min"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (0.99, "p99"), (1.0, "max")))


@_query(_SCORED + f" SELECT condition, count(score) AS n, {_Q} FROM scored GROUP BY 1")
def quantile_summary(spark, sf):
    return _rounded(metrics.quantile_summary(scored(spark, sf), ["condition"], "score"))


@_query(
    _SCORED
    + _auc_sql("source")
    + """, q AS (SELECT source, quantile_cont(score, 0.05) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.95) AS c FROM scored GROUP BY 1)
  SELECT source, n, tn + fp AS n_real, fn + tp AS n_fake, fp + fn AS errors, round((tp + fp) / n, 6) AS fake_rate, round(a, 6) AS p05, round(b, 6) AS median, round(c, 6) AS p95,
  round(auc, 6) AS auc, CASE WHEN auc IS NULL THEN 'one class only' ELSE '' END AS note FROM auc_source JOIN q USING (source)"""
)
def source_scores(spark, sf):
    return _rounded(metrics.source_scores(scored(spark, sf), T))


@_query(
    _SCORED
    + f""", e AS (SELECT *, CASE WHEN label = 0 AND score >= {T} THEN 'false_positive' WHEN label = 1 AND score < {T} THEN 'false_negative' END AS error_type FROM scored)
  SELECT image_id, condition, label, round(score, 6) AS score, error_type, CAST(row_number() OVER w AS INT) AS rank FROM e WHERE error_type IS NOT NULL
  WINDOW w AS (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'false_positive' THEN -score ELSE score END, image_id) QUALIFY row_number() OVER w <= 25"""
)
def top_errors(spark, sf):
    return _rounded(sampling.top_errors(scored(spark, sf), T, 25).select("image_id", "condition", "label", "score", "error_type", "rank"))


_SUB = ", ".join(f"({s})" for s in range(20))


@_query(
    _SCORED
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY sha256(seed || ':' || image_id), image_id) AS k FROM scored, (VALUES {_SUB}) v(seed)),
  sub AS (SELECT * FROM t WHERE k <= 200)"""
    + _auc_sql("seed", "sub")
    + " SELECT seed, round(auc, 7) AS auc FROM auc_seed"
)
def subsample_auc(spark, sf):
    """AUCs are multiples of 1 / 80,000, which seven digits hold without rounding."""
    rows = sampling.seeded_subsamples(scored(spark, sf).select("image_id", "label", "score"), 200, list(range(20)))
    return _rounded(metrics.roc_auc(rows, ["seed"]), 7)


@_query(
    _SCORED
    + f""", t AS (SELECT *, row_number() OVER (PARTITION BY condition, seed, label ORDER BY sha256(seed || ':' || image_id), image_id) AS k FROM scored, (VALUES {_SUB}) v(seed)),
  sub AS (SELECT condition || '/' || seed AS slot, condition, label, score FROM t WHERE k <= 100)"""
    + _auc_sql("slot", "sub")
    + " SELECT split_part(slot, '/', 1) AS condition, round(min(auc), 6) AS min, round(quantile_cont(auc, 0.5), 6) AS median, round(max(auc), 6) AS max FROM auc_slot GROUP BY 1"
)
def subsample_summary(spark, sf):
    return _rounded(audit.subsample_sensitivity(scored(spark, sf), 100, list(range(20)), "score", ["condition"]))


@_query()
def bootstrap_ci(spark, sf):
    return _rounded(resampling.bootstrap_auc_ci(scored(spark, sf), ["condition"], replicates=5000, seed=3))


@_query()
def paired_bootstrap_ci(spark, sf):
    rows = scored(spark, sf).withColumn("other", F.col("score") * F.col("score"))
    return _rounded(resampling.paired_difference_ci(rows, ["condition"], "score", "other", replicates=5000, seed=3))


@_query(_SCORED + ", s AS (SELECT *, split_part(condition, '_', 1) AS family, CASE WHEN condition = 'clean' THEN 'none' ELSE regexp_extract(condition, '^[^_]*_(.*)$', 1) END AS severity, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'individual_transform' END AS kind FROM scored) SELECT family, severity, kind, count(*) AS n FROM s GROUP BY 1, 2, 3")
def condition_parts(spark, sf):
    c = F.col("condition")
    return scored(spark, sf).groupBy(conditions.family(c).alias("family"), conditions.severity(c).alias("severity"), conditions.kind(c).alias("kind")).agg(F.count("*").alias("n"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select(F.lit("events").alias("dataset"), "condition", "image_id", "label", F.col("score").alias("prob"), F.log(F.col("score") / (1.0 - F.col("score"))).alias("margin"))


@_query()
def score_audit(spark, sf):
    return _rounded(audit.score_audit(_audited(spark, sf), T, ["condition"], replicates=5000))


@_query()
def stress_audit(spark, sf):
    return _rounded(audit.stress_audit(_audited(spark, sf), T, replicates=1000)[1])


@_query(_MATRIX + f""", weak AS (SELECT condition FROM auc_condition WHERE condition <> 'clean' ORDER BY auc, condition LIMIT 1),
  e AS (SELECT *, CASE WHEN label = 0 AND score >= {T} THEN 'false_positive' WHEN label = 1 AND score < {T} THEN 'false_negative' END AS error_type FROM scored WHERE condition IN (SELECT condition FROM weak))
  SELECT image_id, error_type, CAST(row_number() OVER w AS INT) AS rank FROM e WHERE error_type IS NOT NULL
  WINDOW w AS (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'false_positive' THEN -score ELSE score END, image_id) QUALIFY row_number() OVER w <= 10""")
def weakest_condition_errors(spark, sf):
    return audit.robustness_report(_audited(spark, sf), T)["errors"].select("image_id", "error_type", "rank")


# documents as items with provenance ---------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, source, sha256, label of the labelled documents."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    x = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return d.join(x, "doc_id").select(F.col("doc_id").alias("image_id"), "source", "sha256", "label")


_ITEMS = "WITH items AS (SELECT d.doc_id AS image_id, source, sha256(text) AS sha256, label FROM documents d JOIN (SELECT doc_id, min(quality) AS label FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"


def _h(seed: int, *parts: str) -> str:
    return "sha256('" + str(seed) + ":' || " + " || ':' || ".join(parts) + ")"


@_query(_ITEMS + f" SELECT image_id, label, 'development' AS role FROM items QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_h(7, 'image_id')}, image_id) <= 5")
def balanced_sample(spark, sf):
    return sampling.balanced_sample(items(spark, sf), 5, 7, role="development", strict=False).select("image_id", "label", "role")


@_query(_ITEMS + " SELECT image_id, label FROM items QUALIFY row_number() OVER (PARTITION BY label ORDER BY image_id) <= 10")
def balanced_limit(spark, sf):
    return sampling.balanced_limit(items(spark, sf), 20, "image_id").select("image_id", "label")


@_query(
    _ITEMS
    + f""" SELECT image_id, label, source, CAST(row_number() OVER w AS INT) AS rank FROM items WHERE image_id % 10 <> 0
  WINDOW w AS (PARTITION BY label ORDER BY {_h(7, 'source')}, source, {_h(7, 'source', 'image_id')}, image_id) QUALIFY row_number() OVER w <= 20"""
)
def quota_select(spark, sf):
    rows = items(spark, sf)
    return sampling.quota_select(rows, 20, 7, "source", "image_id", rows.where("image_id % 10 = 0")).select("image_id", "label", "source", "rank")


_QUOTA = ORACLES["quota_select"]


@_query(_QUOTA)
def quota_select_pages(spark, sf):
    """The same rows as quota_select, from sources that are read in rounds until the quotas are full."""
    excluded = items(spark, sf).where("image_id % 10 = 0").select("image_id")
    pages = _read(spark, sf, "documents").select("source")
    read = lambda names: items(spark, sf).where(F.col("source").isin(names))
    return sampling.quota_select_pages(pages, read, 20, 7, "source", "image_id", excluded, first=2)[0].select("image_id", "label", "source", "rank")


@_query(
    _ITEMS
    + f""", g AS (SELECT label, source, 22 // count(*) OVER (PARTITION BY label) + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY source) <= 22 % count(*) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS quota
    FROM (SELECT DISTINCT label, source FROM items)),
  c AS (SELECT i.image_id, i.label, i.source, row_number() OVER (PARTITION BY i.label, i.source ORDER BY {_h(7, 'i.image_id')}, i.image_id) AS r, quota FROM items i JOIN g ON i.label = g.label AND i.source = g.source)
  SELECT image_id, label, source, CAST(row_number() OVER (PARTITION BY label ORDER BY {_h(7, "'order'", 'image_id')}, image_id) AS INT) AS selection_rank FROM c WHERE r <= quota"""
)
def group_balanced_select(spark, sf):
    rows = items(spark, sf).withColumn("group", F.col("source"))
    groups = rows.select("label", "group").distinct().withColumn("position", F.col("group"))
    return sampling.group_balanced_select(rows, groups, 20, 2, 7, "image_id", strict=False).select("image_id", "label", F.col("group").alias("source"), "selection_rank")


@_query(
    _ITEMS
    + """, d AS (SELECT * FROM items QUALIFY image_id = min(image_id) OVER (PARTITION BY sha256)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY image_id) AS k FROM d)
  SELECT image_id, label, CASE WHEN k <= 10 THEN 'train' WHEN k <= 15 THEN 'evaluation' ELSE 'reserve' END AS role FROM r"""
)
def split_roles(spark, sf):
    rows = exclusion.dedupe_by_hash(items(spark, sf), "image_id")
    return sampling.assign_split_roles(rows, 10, 5, "image_id", strict=False).select("image_id", "label", "role")


@_query(
    _ITEMS
    + """, f AS (SELECT DISTINCT sha256 FROM items WHERE image_id % 10 = 0), n AS (SELECT * FROM items WHERE sha256 NOT IN (SELECT sha256 FROM f)),
  u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY label, sha256 ORDER BY image_id) = 1),
  a AS (SELECT * FROM u WHERE label = 0 QUALIFY row_number() OVER (ORDER BY image_id) <= 40),
  b AS (SELECT * FROM u WHERE label = 1 AND sha256 NOT IN (SELECT sha256 FROM a) QUALIFY row_number() OVER (ORDER BY image_id) <= 40)
  SELECT image_id, label FROM a UNION ALL SELECT image_id, label FROM b"""
)
def training_records(spark, sf):
    rows = items(spark, sf)
    return sampling.assign_training_records(rows, rows.where("image_id % 10 = 0"), 40, "image_id").select("image_id", "label")


@_query(_ITEMS + f" SELECT image_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_h(5, chr(39) + 'fold' + chr(39), 'image_id')}, image_id) - 1) % 5 AS INT) AS fold FROM items")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(items(spark, sf), 5, 5).select("image_id", "label", "fold")


@_query(
    _ITEMS
    + f""", im AS (SELECT *, 'd' || (image_id % 3) AS domain FROM items), q AS (SELECT min(n) AS q FROM (SELECT count(*) AS n FROM im GROUP BY domain, label)),
  c AS (SELECT image_id, domain, label FROM im QUALIFY row_number() OVER (PARTITION BY domain, label ORDER BY {_h(7, 'image_id')}, image_id) <= (SELECT q FROM q))
  SELECT image_id, domain, label, v AS view FROM c, (VALUES ('clean'), ('augmented')) t(v)"""
)
def domain_balanced_training_set(spark, sf):
    rows = items(spark, sf).withColumn("domain", F.concat(F.lit("d"), F.col("image_id") % 3)).withColumn("view", F.explode(F.array(F.lit("clean"), F.lit("augmented"))))
    return sampling.domain_balanced(rows, 7).select("image_id", "domain", "label", "view")


@_query("WITH h AS (SELECT doc_id, source, sha256(text) AS s FROM documents) SELECT doc_id, source FROM h WHERE s NOT IN (SELECT s FROM h WHERE doc_id % 10 = 0 AND s IS NOT NULL)")
def exclude_frozen(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "source", F.upper(F.sha2("text", 256)).alias("sha256"))
    return exclusion.exclude_frozen(d, d.where("doc_id % 10 = 0"), ["sha256"]).select("doc_id", "source")


@_query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY 2")
def dedupe_by_hash(spark, sf):
    d = _read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return exclusion.dedupe_by_hash(d, "doc_id")


@_query("SELECT doc_id, source, doc_id // 300 AS shard_index, doc_id % 300 AS shard_row_index FROM documents WHERE doc_id % 7 = 3")
def extract_planned_rows(spark, sf):
    shard, row = keys.shard_position(F.col("doc_id"), 300)
    d = _read(spark, sf, "documents").select("doc_id", "source", shard.alias("shard_index"), row.alias("shard_row_index"))
    plan = d.where("doc_id % 7 = 3").select("shard_index", "shard_row_index", "source")
    return exclusion.extract_planned_rows(plan, d, ["shard_index", "shard_row_index"], ["source"]).select("doc_id", "source", "shard_index", "shard_row_index")


@_query("SELECT DISTINCT a.doc_id FROM labels a JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
def overlapping_ids(spark, sf):
    return exclusion.overlapping_ids(_read(spark, sf, "labels"), _read(spark, sf, "documents").where("doc_id % 3 = 0"), "doc_id")


@_query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM labels a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS q FROM labels WHERE doc_id % 4 <> 1) b ON a.doc_id = b.doc_id WHERE a.quality IS DISTINCT FROM b.q")
def misaligned_views(spark, sf):
    a = _read(spark, sf, "labels")
    b = a.where("doc_id % 4 <> 1").withColumn("quality", F.expr("case when doc_id % 5 = 0 then 1 - quality else quality end"))
    return exclusion.misaligned(a, b, "doc_id", "quality").select("doc_id")


@_query("SELECT l.doc_id, coalesce(d.source, 'unspecified') AS source, l.quality FROM labels l JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source FROM documents) d ON l.doc_id = d.doc_id")
def attach_source(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.expr("case when doc_id % 4 = 0 then ' ' else source end").alias("source"))
    return exclusion.attach_source(_read(spark, sf, "labels").select("doc_id", "quality"), d, "doc_id").select("doc_id", "source", "quality")


@_query(
    """WITH p AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 0 ELSE doc_id END AS image_id, CASE WHEN doc_id % 31 = 0 THEN 2 ELSE quality END AS label,
    CASE WHEN quality = 1 AND doc_id % 3 <> 0 THEN 'FAKE' ELSE 'REAL' END AS class_name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'x' END AS source_id FROM labels)
  SELECT image_id, 'label' AS problem FROM p WHERE label NOT IN (0, 1) UNION ALL
  SELECT image_id, 'class_name' FROM p WHERE label IN (0, 1) AND class_name <> CASE label WHEN 1 THEN 'FAKE' ELSE 'REAL' END UNION ALL
  SELECT image_id, 'source_id' FROM p WHERE source_id = '' UNION ALL SELECT image_id, 'repeated' FROM p GROUP BY 1 HAVING count(*) > 1"""
)
def provenance_violations(spark, sf):
    p = _read(spark, sf, "labels").selectExpr(
        "case when doc_id % 50 = 0 then 0 else doc_id end as image_id",
        "case when doc_id % 31 = 0 then 2 else quality end as label",
        "case when quality = 1 and doc_id % 3 <> 0 then 'FAKE' else 'REAL' end as class_name",
        "case when doc_id % 7 = 0 then '' else 'x' end as source_id",
    )
    return exclusion.provenance_violations(p)


@_query(
    _ITEMS
    + f""", f AS (SELECT * FROM items WHERE image_id % 10 = 0), n AS (SELECT * FROM items WHERE image_id % 10 <> 0 AND sha256 NOT IN (SELECT sha256 FROM f)),
  g AS (SELECT label, source, 50 // count(*) OVER (PARTITION BY label) + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY source) <= 50 % count(*) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS quota
    FROM (SELECT DISTINCT label, source FROM n)),
  c AS (SELECT n.*, row_number() OVER (PARTITION BY n.label, n.source ORDER BY {_h(7, 'image_id')}, image_id) AS r, quota FROM n JOIN g ON n.label = g.label AND n.source = g.source),
  s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_h(7, "'order'", 'image_id')}, image_id) AS selection_rank FROM c WHERE r <= quota),
  u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY selection_rank * 2 + label) = 1)
  SELECT image_id, label, source, CAST(selection_rank AS INT) AS selection_rank,
    CASE WHEN row_number() OVER w <= 30 THEN 'train' WHEN row_number() OVER w <= 40 THEN 'evaluation' ELSE 'reserve' END AS role FROM u WINDOW w AS (PARTITION BY label ORDER BY selection_rank)"""
)
def training_set(spark, sf):
    """Frozen items out, groups balanced, repeats out, roles by rank."""
    rows = items(spark, sf)
    return training.build_training_set(rows, rows.where("image_id % 10 = 0"), 40, 10, 7, strict=False).select("image_id", "label", "source", "selection_rank", "role")


@_query(_ITEMS + " SELECT source, count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 1) AS n_fake FROM items GROUP BY 1")
def source_label_counts(spark, sf):
    return metrics.source_label_counts(items(spark, sf))


@_query(_ITEMS + " SELECT source, label, count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 1) AS n_fake FROM items GROUP BY ROLLUP (source, label)")
def class_counts(spark, sf):
    return exclusion.class_counts(items(spark, sf), ["source", "label"])


@_query("WITH a AS (SELECT sha256(text) AS s FROM documents WHERE doc_id % 2 = 0), b AS (SELECT sha256(text) AS s FROM documents WHERE doc_id % 2 = 1) SELECT (SELECT count(s) FROM a) AS a_rows, (SELECT count(DISTINCT s) FROM a) AS a_unique, (SELECT count(s) FROM b) AS b_rows, (SELECT count(DISTINCT s) FROM b) AS b_unique, (SELECT count(DISTINCT s) FROM a WHERE s IN (SELECT s FROM b)) AS exact_overlap, (SELECT count(s) - count(DISTINCT s) FROM a) AS a_repeats, (SELECT count(s) - count(DISTINCT s) FROM b) AS b_repeats")
def overlap_summary(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return exclusion.overlap_summary(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@_query("WITH a AS (SELECT doc_id AS plan_index, turn AS attempt, CASE WHEN (doc_id + turn) % 3 = 0 THEN 'ok' ELSE 'failed' END AS status, 'e' || turn AS error FROM documents, (VALUES (1), (2)) t(turn) WHERE doc_id % 4 <> 0) SELECT d.doc_id AS plan_index, max_by(error, attempt) AS last_error, max(attempt) AS last_attempt FROM documents d LEFT JOIN a ON d.doc_id = a.plan_index AND status <> 'ok' WHERE d.doc_id NOT IN (SELECT plan_index FROM a WHERE status = 'ok') GROUP BY 1")
def pending_work(spark, sf):
    plan = _read(spark, sf, "documents").select(F.col("doc_id").alias("plan_index"))
    tried = plan.where("plan_index % 4 <> 0").withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    tried = tried.withColumn("status", F.expr("case when (plan_index + attempt) % 3 = 0 then 'ok' else 'failed' end")).withColumn("error", F.expr("concat('e', attempt)"))
    return exclusion.pending_work(plan, tried)


@_query("WITH b AS (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096 AS bucket, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_ids FROM b")
def set_fingerprint(spark, sf):
    return exclusion.set_fingerprint(_read(spark, sf, "documents"), "doc_id")


@_query("SELECT doc_id, substr(sha256(source || '/' || doc_id), 1, 16) AS path_id, substr(sha256(concat_ws('|', source, '', lang, doc_id, 'i' || doc_id)), 1, 24) AS identity_id, CAST(('0x' || substr(sha256('7:' || doc_id || ':clean'), 1, 16))::UBIGINT AS VARCHAR) AS seed, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def item_keys(spark, sf):
    d = _read(spark, sf, "documents").where("text is not null")
    name = F.concat(F.lit("i"), "doc_id")
    return d.select(
        "doc_id",
        keys.path_id(F.concat("source", F.lit("/"), "doc_id")).alias("path_id"),
        keys.identity_id(F.col("source"), F.lit(None).cast("string"), F.col("lang"), F.col("doc_id"), F.lit(""), name).alias("identity_id"),
        keys.stable_seed(7, F.col("doc_id"), F.lit("clean")).cast("string").alias("seed"),
        keys.content_hash(F.col("text")).alias("content_hash"),
    )


@_query(r"SELECT page_id, CASE WHEN t = '' THEN 'image' ELSE right(t, 100) END AS safe_name, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS grp FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS t FROM pages)")
def names_of_pages(spark, sf):
    p = _read(spark, sf, "pages")
    return p.select("page_id", keys.safe_name(F.col("url")).alias("safe_name"), keys.normalize_group(F.col("url")).alias("grp"))


def _picked_sql(options: list[str], salt: str) -> str:
    """The option that a stable seed of document and ``salt`` picks."""
    listed = ", ".join(f"'{o}'" for o in options)
    return f"[{listed}][CAST(('0x' || substr(sha256('7:' || doc_id || ':{salt}'), 1, 16))::UBIGINT % {len(options)} AS INT) + 1]"


_FAMILIES = sorted({f for f, _, _ in conditions.TRANSFORMS})


@_query(
    f"SELECT doc_id, CASE {_picked_sql(_FAMILIES, 'family')} "
    + " ".join(f"WHEN '{name}' THEN {_picked_sql([f'{f}_{s}' for f, s, _ in conditions.TRANSFORMS if f == name], name)}" for name in _FAMILIES)
    + " END AS condition FROM documents"
)
def training_conditions(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", conditions.training_condition(7, F.col("doc_id")).alias("condition"))


@_query("SELECT CAST(event_id AS BIGINT) AS image_id, c AS condition, CAST(('0x' || substr(sha256('7:' || event_id || ':' || c), 1, 16))::UBIGINT AS VARCHAR) AS seed FROM events, (VALUES " + ", ".join(f"('{c}')" for c in ["clean", *(f"{f}_{s}" for f, s, _ in conditions.TRANSFORMS), *conditions.CHAINS]) + ") v(c)")
def expand_conditions(spark, sf):
    rows = _read(spark, sf, "events").select(F.col("event_id").alias("image_id"))
    return conditions.expand_conditions(rows, 7).select("image_id", "condition", F.col("seed").cast("string").alias("seed"))


# embeddings as a feature table --------------------------------------------------------------------


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), (F.col("label") >= 5).cast("int").alias("label"), F.concat(F.lit("g"), "label").alias("source"), F.col("embedding").alias("features"))


@_query("SELECT CAST(i - 1 AS INT) AS idx, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(embedding[i] AS DOUBLE)), 6) AS std FROM embeddings, range(1, 65) t(i) GROUP BY 1")
def standardize_fit(spark, sf):
    return _rounded(probe.standardize_fit(features(spark, sf)))


@_query("SELECT vec_id AS image_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def feature_norms(spark, sf):
    return features(spark, sf).select("image_id", F.round(arrays.norm(F.col("features")), 5).alias("norm"))


_BITS = "SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS s FROM embeddings"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("image_id", "label", "source", arrays.sign_hash(F.col("features")).alias("h"))


_SHIFTED = _BITS.replace("x > 0 ", "CAST(x AS DOUBLE) > CAST(0.01 AS DOUBLE) ")


@_query(f"WITH a AS (SELECT DISTINCT s FROM ({_BITS}) WHERE vec_id % 5 = 0), b AS (SELECT DISTINCT s FROM ({_SHIFTED})) SELECT a.s AS a, b.s AS b, CAST(hamming(a.s, b.s) AS INT) AS distance FROM a, b WHERE hamming(a.s, b.s) <= 4")
def near_duplicate_pairs(spark, sf):
    """Hashes of a fifth of the vectors against those of all vectors shifted a little, as re-encoded views are."""
    shifted = features(spark, sf).select(arrays.sign_hash(F.transform("features", lambda x: x.cast("double") - 0.01)).alias("h"))
    found = near_duplicates.near_pairs(_hashes(spark, sf).where("image_id % 5 = 0"), shifted)
    text = lambda c: F.lpad(F.conv(F.hex(c), 16, 2), 64, "0")
    return found.select(text("a").alias("a"), text("b").alias("b"), F.col("distance").cast("int").alias("distance"))


@_query(
    f"""WITH h AS (SELECT vec_id AS image_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label, 'g' || label AS source, s FROM ({_BITS})),
  e AS (SELECT *, 'd' || (image_id % 3) AS dataset FROM h WHERE image_id % 5 = 0), t AS (SELECT * FROM h WHERE image_id % 5 <> 0),
  p AS (SELECT a.s AS a, b.s AS b FROM (SELECT DISTINCT s FROM e) a, (SELECT DISTINCT s FROM t) b WHERE hamming(a.s, b.s) <= 4),
  k AS (SELECT p.a, max(t.label) AS hi, min(t.label) AS lo, list(DISTINCT t.source) AS sources FROM p JOIN t ON t.s = p.b GROUP BY 1)
  SELECT dataset, count(*) AS n_rows, count(hi) AS n_near, count(*) FILTER (WHERE hi <> label OR lo <> label) AS n_opposite,
    coalesce(array_to_string(list_sort(list_distinct(flatten(list(sources) FILTER (WHERE sources IS NOT NULL)))), ','), '') AS sources FROM e LEFT JOIN k ON e.s = k.a GROUP BY 1"""
)
def near_duplicate_summary(spark, sf):
    h = _hashes(spark, sf).withColumn("dataset", F.concat(F.lit("d"), F.col("image_id") % 3))
    return near_duplicates.near_duplicate_summary(h.where("image_id % 5 = 0"), h.where("image_id % 5 <> 0"))


@_query()
def probe_scores(spark, sf):
    rows = features(spark, sf)
    return _rounded(probe.score(rows, probe.fit_probe(rows)).select("image_id", "label", "margin", "prob"), 4)


@_query()
def branch_contributions(spark, sf):
    rows = features(spark, sf)
    model = probe.fit_probe(rows)
    return _rounded(probe.branch_contributions(rows, model, 48).select("image_id", "semantic_part", "frequency_part"), 4)


@_query(
    """WITH s AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS d FROM embeddings, range(1, 65) t(i) GROUP BY 1),
  z AS (SELECT 'g' || label AS source, abs((CAST(embedding[s.i] AS DOUBLE) - m) / d) AS z FROM embeddings, s)
  SELECT source, round(max(z), 5) AS max_z, round(quantile_cont(z, 0.999), 5) AS p999_z FROM z GROUP BY 1"""
)
def shift_diagnosis(spark, sf):
    rows = features(spark, sf)
    return _rounded(probe.shift_diagnosis(rows, probe.standardize_fit(rows), ["source"]), 5)


@_query()
def leave_pair_out(spark, sf):
    """All 25 pairs, each under a model of the other sources' vectors and their shifted views."""
    rows = features(spark, sf)
    shifted = rows.withColumn("features", F.transform("features", lambda x: (x.cast("double") * 0.98 - 0.01).cast("float")))
    return _rounded(probe.pair_audit(probe.leave_pair_out(rows, [f"g{i}" for i in range(5)], [f"g{i}" for i in range(5, 10)], shifted)), 3)


_LINEAR = """s AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m, stddev_pop(CAST(embedding[i] AS DOUBLE)) AS d FROM embeddings, range(1, 65) t(i) GROUP BY 1),
  z AS (SELECT vec_id, CASE WHEN label >= 5 THEN 'FAKE' ELSE 'REAL' END AS class, i, (CAST(embedding[s.i] AS DOUBLE) - m) / d AS z FROM embeddings, s),
  p AS (SELECT vec_id, class, CASE WHEN i <= 48 THEN 'semantic' ELSE 'frequency' END AS branch, sum(z / i) AS value FROM z GROUP BY 1, 2, 3),
  v AS (SELECT branch, class, value FROM p UNION ALL SELECT branch, 'all', value FROM p UNION ALL SELECT 'absolute_frequency', 'all', abs(z) FROM z WHERE i > 48)"""


@_query(f"WITH {_LINEAR} SELECT branch, class, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 5) AS {n}" for p, n in ((0.0, "min"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (0.99, "p99"), (1.0, "max"))) + " FROM v GROUP BY 1, 2")
def branch_summary(spark, sf):
    """Contributions under weights of 1, 1/2, 1/3 and so on, which SQL can repeat."""
    rows = features(spark, sf)
    stats = sorted(probe.standardize_fit(rows).collect())
    model = {"mean": [r["mean"] for r in stats], "std": [r["std"] for r in stats], "weights": [1.0 / (i + 1) for i in range(len(stats))], "bias": 0.0}
    return _rounded(probe.branch_summary(probe.branch_contributions(rows, model, 48), 48), 5)


@_query()
def promoted_probe(spark, sf):
    """Balanced fit, threshold on a disjoint set, gates on a third: one row for each dataset."""
    rows = features(spark, sf)
    fit = rows.where("image_id % 3 = 0").withColumn("domain", F.concat(F.lit("d"), F.col("image_id") % 2)).withColumn("view", F.lit("clean"))
    held = rows.where("image_id % 3 = 2").withColumn("dataset", F.concat(F.lit("d"), F.col("image_id") % 2))
    least = spark.createDataFrame([("d0", 0.5), ("d1", 0.5)], "dataset string, min_auc double")
    return _rounded(training.train_and_promote(fit, rows.where("image_id % 3 = 1"), held, least, 7)[1], 3)


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("image_id"), F.col("quality").alias("label"), (F.col("n_chars") % 97 + 1).alias("width"), (F.col("n_chars") % 89 + 1).alias("height"), F.col("n_chars").alias("bytes"))


@_query()
def metadata_baseline(spark, sf):
    return _rounded(probe.metadata_baseline(_metadata(spark, sf), [0, 1, 2, 3, 4]), 4)


@_query()
def metadata_summary(spark, sf):
    return _rounded(probe.auc_summary(probe.metadata_baseline(_metadata(spark, sf), [0, 1, 2, 3, 4])), 4)


# rounds of people against the detector ------------------------------------------------------------


def rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, sf_dir)
    name = lambda c: F.when(c, "FAKE").otherwise("REAL")
    r = s.where("image_id % 4 <> 0").select(F.floor(F.col("image_id") / 2).alias("round_id"), F.col("source").alias("match_id"), name(F.col("label") == 1).alias("ground_truth"), name(F.col("score") >= T).alias("ai_label"), (F.col("score") * 1000).alias("ai_elapsed_ms"), "image_id")
    r = r.groupBy("round_id").agg(F.min_by(F.struct("match_id", "ground_truth", "ai_label", "ai_elapsed_ms"), "image_id").alias("x")).select("round_id", "x.*")
    g = s.where("image_id % 3 <> 0").select(F.floor(F.col("image_id") / 2).alias("round_id"), "ts", name(F.col("image_id") % 5 < 2).alias("label"), (F.col("image_id") % 7001 * 1.0).alias("elapsed_ms"))
    return r, g


_ROUNDS = (
    _SCORED
    + f""", r AS (SELECT image_id // 2 AS round_id, source AS match_id, CASE WHEN label = 1 THEN 'FAKE' ELSE 'REAL' END AS ground_truth,
    CASE WHEN score >= {T} THEN 'FAKE' ELSE 'REAL' END AS ai_label, score * 1000 AS ai_elapsed_ms FROM scored WHERE image_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY image_id // 2 ORDER BY image_id) = 1),
  g AS (SELECT image_id // 2 AS round_id, ts, CASE WHEN image_id % 5 < 2 THEN 'FAKE' ELSE 'REAL' END AS label, image_id % 7001 * 1.0::DOUBLE AS elapsed_ms FROM scored WHERE image_id % 3 <> 0
    QUALIFY row_number() OVER (PARTITION BY image_id // 2 ORDER BY ts, CASE WHEN image_id % 5 < 2 THEN 'FAKE' ELSE 'REAL' END, image_id % 7001) = 1),
  f AS (SELECT r.*, g.ts, g.label AS human_label, g.elapsed_ms AS human_elapsed_ms, g.label = ground_truth AS human_correct, ai_label = ground_truth AS ai_correct FROM r JOIN g USING (round_id))"""
)


@_query(_ROUNDS + " SELECT round_id, match_id, human_label, human_correct, ai_correct FROM f")
def finished_rounds(spark, sf):
    return scoreboard.finish_rounds(*rounds(spark, sf)).select("round_id", "match_id", "human_label", "human_correct", "ai_correct")


_BOARD = (
    _ROUNDS
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ts, round_id) AS turn FROM f QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY ts, round_id) <= 10),
  s AS (SELECT match_id, turn, 'human' AS side, human_correct AS ok, human_elapsed_ms AS ms FROM k UNION ALL SELECT match_id, turn, 'ai', ai_correct, ai_elapsed_ms FROM k),
  board AS (SELECT match_id, side, count(*) AS completed, count(*) FILTER (WHERE ok) AS correct, avg(ms) AS mean_ms, CAST(max(turn) - coalesce(max(CASE WHEN NOT ok THEN turn END), 0) AS INT) AS streak,
    CAST(round(count(*) FILTER (WHERE ok) * 100.0 / count(*)) AS INT) AS accuracy FROM s GROUP BY 1, 2)"""
)


@_query(_BOARD + " SELECT match_id, side, completed, correct, round(mean_ms, 6) AS mean_ms, streak, accuracy FROM board")
def scoreboard_by_match(spark, sf):
    return _rounded(scoreboard.scoreboard(scoreboard.finish_rounds(*rounds(spark, sf))))


@_query(
    _BOARD
    + """, p AS (SELECT h.match_id, CAST((h.accuracy > a.accuracy)::INT + (h.mean_ms < a.mean_ms)::INT AS INT) AS human_points, CAST((a.accuracy > h.accuracy)::INT + (a.mean_ms < h.mean_ms)::INT AS INT) AS ai_points
    FROM board h JOIN board a ON h.match_id = a.match_id AND h.side = 'human' AND a.side = 'ai')
  SELECT *, CASE WHEN human_points > ai_points THEN 'human' WHEN human_points < ai_points THEN 'ai' ELSE 'draw' END AS winner FROM p"""
)
def match_winners(spark, sf):
    return scoreboard.match_winners(scoreboard.scoreboard(scoreboard.finish_rounds(*rounds(spark, sf)))).select("match_id", "human_points", "ai_points", "winner")


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; a local one only where the session runs in one process and names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='spark-stream-', dir='/tmp')).rstrip('/')}/{uuid.uuid4().hex}"


@_query(_BOARD + " SELECT match_id, side, completed, correct, round(mean_ms, 6) AS mean_ms, streak, accuracy FROM board")
def scoreboard_stream(spark, sf):
    """The scoreboard as a stream's running figures: rounds and the earlier half of the guesses, then the later half."""
    folder = _scratch(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    r, g = rounds(spark, sf)
    r = written(r, "rounds")
    g = written(g.join(r.select("round_id", F.col("match_id").alias("game_id")), "round_id"), "guesses")
    first, middle, guesses = g.agg(F.min("ts"), F.percentile_approx("ts", 0.5), F.count("*")).first()
    opened = r.withColumnRenamed("match_id", "game_id").withColumn("ts", F.lit(first))
    slices = [(opened, g.where(F.col("ts") <= middle)), (opened.limit(0), g.where(F.col("ts") > middle))]
    # texts of one length, from 0 for the least bigint on, have the order of the numbers
    text = F.lpad((F.col("round_id").cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string"), 20, "0")
    slices = [tuple(df.withColumn("round_id", text) for df in pair) for pair in slices]
    parts = 1 + (r.count() + guesses) // stream_rounds.PART_EVENTS
    return _rounded(stream_rounds.running_board(stream_rounds.replay(slices, folder, parts, cache_size=1_000_000)))


# pixels -------------------------------------------------------------------------------------------


@_query()
def image_view_features(spark, sf):
    """Radial spectrum and difference hash of every embedding under one transform each, drawn as 8 x 8 tiles."""
    rows = features(spark, sf).withColumn("condition", conditions.training_condition(7, F.col("image_id"))).withColumn("seed", keys.stable_seed(7, F.col("image_id"), F.col("condition")))
    drawn = images.vectors_as_images(rows.select("image_id", "condition", "seed", "features"))
    return images.view_features(drawn)
