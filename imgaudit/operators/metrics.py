"""Exact metrics of scored tables (label 0/1, score), grouped by any keys.

Scores first collapse to a histogram of distinct values, so windows run over values and not over
rows; everything else is partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.conditions import family, kind


def score_histogram(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, score, pos, neg for each distinct score."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


#: Distinct values of a cell, on average, and cells of a group, on average at most.
DEPTH, CELLS = 1 << 14, 1024
#: Rank error of the sketch that brackets quantiles is one in so many rows; groups of up to SMALL rows need no bracket.
SKETCH, SMALL = 10_000, 100_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each value of the keys; null keys match."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(named, same, how).drop(*[f"_k_{k}" for k in keys])


def with_cells(hist: DataFrame, keys: list[str], value: str = "score", name: str = "_cell", depth: int | None = None, most: int = CELLS) -> DataFrame:
    """``hist`` with the cell of each row: ranges of the value that hold some ``depth`` rows each, however the values lie.

    The cuts of a group are those of its values whose hash is a multiple of the depth, a sample that
    does not depend on partitions; large groups take every n/most-th, so that a group has about
    ``most`` cuts at most. Equal values share a cell, and cells ascend with the value.
    """
    size = hist.groupBy(*keys).agg(F.count("*").alias("_rows"))
    every = F.greatest(F.lit(depth or DEPTH).cast("long"), F.ceil(F.col("_rows") / most))
    cuts = joined(hist, size, keys).where(F.pmod(F.xxhash64(value), every) == 0).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_cuts"))
    steps = ", ".join(str(1 << k) for k in range(most.bit_length(), -1, -1))
    place = F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= size(_cuts) and get(_cuts, at + step - 1) < `{value}`, at + step, at))")
    return joined(hist, cuts, keys, "left").withColumn(name, F.when(F.col("_cuts").isNull(), 0).otherwise(place)).drop("_cuts")


def _running(hist: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    """``hist`` with pos and neg sums over all scores before the row's, within the keys.

    Sums of cells of equally many scores come first; inside a cell a window adds the rest, so one
    group of very many distinct scores runs in many tasks, also if they lie close together.
    """
    celled = with_cells(hist, keys)
    order = F.col("_cell").desc() if descending else F.col("_cell")
    ahead = W.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = celled.groupBy(*keys, "_cell").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    starts = sums.select(*keys, "_cell", F.sum("_p").over(ahead).alias("_p0"), F.sum("_n").over(ahead).alias("_n0"))
    inner = W.partitionBy(*keys, "_cell").orderBy(F.col("score").desc() if descending else F.col("score")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    out = joined(celled, starts, [*keys, "_cell"]).withColumn("pos_before", F.coalesce(F.col("_p0"), zero) + F.coalesce(F.sum("pos").over(inner), zero))
    out = out.withColumn("neg_before", F.coalesce(F.col("_n0"), zero) + F.coalesce(F.sum("neg").over(inner), zero))
    return out.drop("_cell", "_p0", "_n0")


def roc_auc(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, auc with ties counted half; null for a group of one class."""
    hist = _running(score_histogram(scored, keys, score), keys)
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return hist.groupBy(*keys).agg(F.when((p > 0) & (n > 0), pairs / F.nullif(p * n, F.lit(0.0))).alias("auc"))


def quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float], names: list[str]) -> DataFrame:
    """keys and the exact quantiles of a column, interpolated between neighbours; null where a group has no value.

    A mergeable sketch brackets each rank within some hundredths of a percent of the rows; a second
    pass counts what lies below a bracket and ranks only the values inside it. Groups of up to SMALL
    values are small enough for Spark's own exact aggregate.
    """
    v = F.col(value).cast("double")
    ends = [min(1.0, max(0.0, p + d / SKETCH)) for p in points for d in (-3, 3)]
    sketch = rows.groupBy(*keys).agg(F.count(value).alias("_total"), F.percentile_approx(v, ends, SKETCH).alias("_ends"))
    placed = joined(rows.select(*keys, v.alias("score")), sketch, keys)
    small = F.col("_total") <= SMALL
    low, high = ([F.get("_ends", F.lit(2 * i + k)) for i in range(len(points))] for k in (0, 1))
    below = [F.count_if(~small & (F.col("score") < low[i])).alias(f"_below{i}") for i in range(len(points))]
    first = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), F.percentile(F.when(small, F.col("score")), F.array(*map(F.lit, points))).alias("_small"), *below)
    brackets = F.array(*[F.when((F.col("score") >= low[i]) & (F.col("score") <= high[i]), F.lit(i)) for i in range(len(points))])
    inside = placed.where(~small & F.col("score").isNotNull()).select(*keys, "score", F.explode(F.array_compact(brackets)).alias("_point"))
    hist = inside.groupBy(*keys, "_point", "score").agg(F.count("*").alias("pos")).withColumn("neg", F.lit(0))
    ranked = joined(_running(hist, [*keys, "_point"]), first, keys)
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in points]

    def on(i: int, rank: Column) -> Column:
        start = F.col(f"_below{i}") + F.col("pos_before")
        return F.max(F.when((F.col("_point") == i) & (start <= rank) & (rank < start + F.col("pos")), F.col("score")))

    pairs = [on(i, f(at[i])).alias(f"_{n}{i}") for i in range(len(points)) for n, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(*keys).agg(*pairs)

    def picked(i: int) -> Column:
        lo, hi, share = F.col(f"_lo{i}"), F.col(f"_hi{i}"), at[i] - F.floor(at[i])
        large = F.when(lo.isNull() | hi.isNull(), F.raise_error(F.lit("the sketch missed a rank"))).when(lo == hi, lo).otherwise(lo * (1 - share) + hi * share)
        return F.when(F.col("_total") > SMALL, large).otherwise(F.get("_small", F.lit(i)))

    return joined(first, found, keys, "left").select(*keys, *[picked(i).alias(name) for i, name in enumerate(names)])


def confusion(threshold: float | Column, score: str = "score") -> list[Column]:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pos, hit = F.col("label") == 1, F.col(score) >= t
    return [F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_metrics(scored: DataFrame, keys: list[str], threshold: float, score: str = "score") -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, precision, sensitivity, specificity, f1, fake rate."""
    c = scored.groupBy(*keys).agg(F.count("*").alias("n"), *confusion(threshold, score))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    out = c.withColumn("accuracy", _ratio(tn + tp, F.col("n"))).withColumn("precision", _ratio(tp, tp + fp)).withColumn("sensitivity", _ratio(tp, tp + fn))
    out = out.withColumn("specificity", _ratio(tn, tn + fp)).withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn)).withColumn("fake_rate", _ratio(tp + fp, F.col("n")))
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def score_matrix(scored: DataFrame, keys: list[str], threshold: float, score: str = "score") -> DataFrame:
    """n, auc, accuracy, f1 for every combination of keys, in one pass over the rows."""
    rates = threshold_metrics(scored, keys, threshold, score).select(*keys, "n", "accuracy", "f1")
    auc = roc_auc(scored, keys, score)
    return rates.join(auc, keys) if keys else rates.crossJoin(auc)


def aggregate_robustness(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Clean AUC, mean over conditions and over families, both composites; of ``matrix(by, condition, auc)``.

    A group without exactly one clean row, without any other, or with a repeated condition is an
    error when the result is computed.
    """
    by = by or []
    one = matrix if by else matrix.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    named = one.withColumn("family", family(F.col("condition")))
    clean = F.col("condition") == "clean"
    totals = named.groupBy(*keys).agg(
        F.max(F.when(clean, F.col("auc"))).alias("clean_auc"),
        F.count_if(clean).alias("_clean"),
        F.avg(F.when(~clean, F.col("auc"))).alias("condition_auc"),
        F.count_if(~clean).alias("n_conditions"),
        F.count_distinct(F.when(~clean, F.col("condition"))).alias("_kinds"),
    )
    per_family = named.where(~clean).groupBy(*keys, "family").agg(F.avg("auc").alias("auc")).groupBy(*keys).agg(F.avg("auc").alias("family_auc"), F.count("*").alias("n_families"))
    problem = F.when(F.col("_clean") != 1, "not one clean condition").when(F.col("n_conditions") == 0, "no transformed condition").when(F.col("_kinds") < F.col("n_conditions"), "a condition is repeated")
    checked = F.when(problem.isNull(), F.col("clean_auc")).otherwise(F.raise_error(problem))
    out = totals.join(per_family, keys, "left").withColumn("clean_auc", checked).drop("_clean", "_kinds", "_all")
    return out.withColumn("condition_score", (F.col("clean_auc") + F.col("condition_auc")) / 2).withColumn("family_score", (F.col("clean_auc") + F.col("family_auc")) / 2)


def family_auc(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    return matrix.where("condition <> 'clean'").groupBy(*(by or []), family(F.col("condition")).alias("family")).agg(F.avg("auc").alias("auc"), F.count("*").alias("n"))


def stress_summary(matrix: DataFrame) -> DataFrame:
    """dataset, kind, n, mean, least and greatest AUC, and the composite with clean for single transforms."""
    named = matrix.withColumn("kind", kind(F.col("condition")))
    clean = named.where("kind = 'clean'").select("dataset", F.col("auc").alias("clean_auc"))
    out = named.where("kind <> 'clean'").groupBy("dataset", "kind").agg(F.count("*").alias("n"), F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"))
    composite = F.when(F.col("kind") == "individual_transform", (F.col("clean_auc") + F.col("mean_auc")) / 2)
    return out.join(clean, "dataset").withColumn("composite", composite)


def condition_drop(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUC lost against clean, absolute and relative."""
    by = by or []
    clean = matrix.where("condition = 'clean'").select(*by, F.col("auc").alias("clean_auc"))
    rest = matrix.where("condition <> 'clean'")
    out = rest.join(clean, by) if by else rest.crossJoin(clean)  # one clean row
    return out.withColumn("drop", F.col("clean_auc") - F.col("auc")).withColumn("relative_drop", F.col("drop") / F.col("clean_auc"))


def roc_curve(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, threshold, tpr, fpr for each distinct score; the point (inf, 0, 0) begins every curve."""
    hist = _running(score_histogram(scored, keys, score), keys, descending=True)
    total = hist.groupBy(*keys).agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    joined = hist.join(total, keys) if keys else hist.crossJoin(total)
    points = joined.select(*keys, F.col("score").cast("double").alias("threshold"), F.try_divide(F.col("pos_before") + F.col("pos"), "p").alias("tpr"), F.try_divide(F.col("neg_before") + F.col("neg"), "n").alias("fpr"))
    first = total.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(first)


def calibrate_threshold(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys, threshold, youden: of the thresholds in [0, 1] whose J is close to the best, the one nearest

    to a half, then the higher. Groups of one class have none.
    """
    j = roc_curve(scored, keys, score).where("threshold >= 0 and threshold <= 1 and tpr is not null and fpr is not null").withColumn("youden", F.col("tpr") - F.col("fpr"))
    best = j.groupBy(*keys).agg(F.max("youden").alias("best"))
    near = (j.join(best, keys) if keys else j.crossJoin(best)).where(F.col("best") - F.col("youden") <= 1e-8 + 1e-5 * F.abs("best"))
    choice = F.min_by(F.struct("threshold", "youden"), F.struct(F.abs(F.col("threshold") - 0.5), -F.col("threshold"))).alias("c")
    return near.groupBy(*keys).agg(choice).select(*keys, "c.threshold", "c.youden")


#: Bounds that a promoted score must keep on every dataset.
GATES = {"least_std": 0.01, "least_rate": 0.05, "most_rate": 0.95}


def promotion_gates(scored: DataFrame, minimums: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """One row for each dataset: figures, the list of failed gates and whether all hold; ``minimums(dataset, min_auc)``."""
    s = F.col(score)
    halves = quantiles(scored.where("label in (0, 1)").select("dataset", "label", s.alias("_s")), ["dataset", "label"], "_s", [0.5], ["median"])
    median = lambda y: F.max(F.when(F.col("label") == y, F.col("median")))
    medians = halves.groupBy("dataset").agg(median(0).alias("real_median"), median(1).alias("fake_median"))
    stats = scored.groupBy("dataset").agg(F.stddev_pop(s).alias("score_std")).join(medians, "dataset", "left")
    m = score_matrix(scored, ["dataset"], threshold, score).join(threshold_metrics(scored, ["dataset"], threshold, score).select("dataset", "fake_rate"), "dataset")
    all_ = m.join(stats, "dataset").join(F.broadcast(minimums), "dataset")  # a row for each dataset
    fails = [
        (F.coalesce(F.col("auc") < F.col("min_auc"), F.lit(True)), "auc"),
        (F.col("score_std") < GATES["least_std"], "score_std"),
        (~F.col("fake_rate").between(GATES["least_rate"], GATES["most_rate"]), "predicted_fake_rate"),
        (F.coalesce(F.col("fake_median") <= F.col("real_median"), F.lit(True)), "median_order"),
    ]
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in fails]), lambda x: x.isNotNull())
    return all_.withColumn("failures", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def reliability_bins(scored: DataFrame, bins: int = 10, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """keys, bin, lower, upper, n, mean_score, positive_rate; lower edges belong to their bin, the last is closed."""
    keys = keys or []
    edges = [k / bins for k in range(bins + 1)]
    own = F.lit(0)
    for e in edges[1:-1]:
        own = own + F.when(F.col(score) >= e, 1).otherwise(0)
    table = scored.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(bins)], "bin int, lower double, upper double")
    found = scored.where(F.col(score).isNotNull()).groupBy(*keys, own.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
    if not keys:
        return table.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("bin").alias("_bin"), "n", "mean_score", "positive_rate")
    same = F.col("bin") == F.col("_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    every = scored.select(*keys).distinct().crossJoin(F.broadcast(table))  # a row for each bin
    return every.join(found, same, "left").select(*keys, "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "positive_rate")


def calibration_error(scored: DataFrame, bins: int = 10, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """keys, ece and brier; without keys, one row."""
    keys = keys or []
    b = reliability_bins(scored, bins, score, keys)
    ece = b.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_rate"))) / F.sum("n")).alias("ece"))
    brier = scored.groupBy(*keys).agg(F.avg((F.col(score) - F.col("label")) * (F.col(score) - F.col("label"))).alias("brier"))
    return ece.join(brier, keys) if keys else ece.crossJoin(brier)  # one row each


def saturation(scored: DataFrame, keys: list[str], prob: str = "prob", margin: str = "margin", approximate: bool = False) -> DataFrame:
    """Rows at 0 and at 1, and distinct probabilities and margins; by a sketch within about 2 % if ``approximate``, which shuffles no value."""
    distinct = (lambda c: F.approx_count_distinct(c, 0.02)) if approximate else F.count_distinct
    return scored.groupBy(*keys).agg(F.count_if(F.col(prob) == 0).alias("n_zero"), F.count_if(F.col(prob) == 1).alias("n_one"), distinct(prob).alias("distinct_prob"), distinct(margin).alias("distinct_margin"))


def quantile_summary(rows: DataFrame, keys: list[str], value: str, approximate: bool = False) -> DataFrame:
    """min, p05, median, p95, p99, max; exact by default, by a sketch in one pass if ``approximate``."""
    points, names = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0], ["min", "p05", "median", "p95", "p99", "max"]
    n = F.count(value).alias("n")
    if approximate:
        out = rows.groupBy(*keys).agg(F.percentile_approx(value, points, 10_000).alias("q"), n)
        return out.select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(names)])
    exact = quantiles(rows, keys, value, points, names).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.groupBy(*keys).agg(n).join(exact, same).select(*keys, "n", *names)


def source_scores(scored: DataFrame, threshold: float, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """One row for each source (and keys): counts, errors, quantiles, AUC or null with a note."""
    by = [*(keys or []), "source"]
    t = threshold_metrics(scored, by, threshold, score).select(*by, "n", (F.col("tn") + F.col("fp")).alias("n_real"), (F.col("fn") + F.col("tp")).alias("n_fake"), (F.col("fp") + F.col("fn")).alias("errors"), "fake_rate")
    q = quantile_summary(scored, by, score).select(*by, "p05", "median", "p95")
    out = t.join(q, by).join(roc_auc(scored, by, score), by)
    return out.withColumn("note", F.when(F.col("auc").isNull(), "one class only").otherwise(""))


def source_label_counts(rows: DataFrame) -> DataFrame:
    """n_real and n_fake of each source, zeros kept."""
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unspecified"))
    return rows.groupBy(source.alias("source")).agg(F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"))
