"""Linear probe: standardization, L2 logistic regression, ablations, contributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import margin, metadata_features, probability
from .exclusion import misaligned
from .metrics import quantile_summary, quantiles, roc_auc
from .resampling import bootstrap_auc_ci
from .sampling import require, stratified_folds


def standardize_fit(rows: DataFrame, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """keys, idx, mean, std (population; 1 where it is 0) of each feature."""
    keys = keys or []
    cells = rows.select(*keys, F.posexplode(features).alias("idx", "x"))
    std = F.stddev_pop(F.col("x").cast("double"))
    return cells.groupBy(*keys, "idx").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))


def fit_probe(rows: DataFrame, features: str = "features", label: str = "label", max_iter: int = 2000, c: float = 1.0, tol: float = 1e-9) -> dict:
    """mean, std, weights and bias of a standardized L2 logistic regression; both classes are needed."""
    n, classes = rows.agg(F.count("*"), F.count_distinct(label)).first()
    if classes != 2:
        raise ValueError("both classes are needed")
    stats = sorted(standardize_fit(rows, features).collect())  # one row a feature
    mean, std = [r["mean"] for r in stats], [r["std"] for r in stats]
    m, s = (F.array(*[F.lit(v) for v in values]) for values in (mean, std))
    scaled = F.zip_with(F.zip_with(F.col(features), m, lambda x, y: x.cast("double") - y), s, lambda x, y: x / y)
    table = rows.select(array_to_vector(scaled).alias("x"), F.col(label).cast("double").alias("y"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(table)
    return {"mean": mean, "std": std, "weights": [float(w) for w in model.coefficients], "bias": float(model.intercept)}


def score(rows: DataFrame, model: dict, features: str = "features") -> DataFrame:
    """``rows`` with margin and prob; a margin that is NaN or infinite is an error, a row without features has none."""
    arrays = [F.array(*[F.lit(v) for v in model[k]]) for k in ("mean", "std", "weights")]
    m = margin(F.col(features), *arrays, F.lit(model["bias"]))
    finite = m.isNull() | (~F.isnan(m) & (F.abs(m) < float("inf")))
    return rows.withColumn("margin", F.when(finite, m).otherwise(F.raise_error(F.lit("a margin is not finite")))).withColumn("prob", probability(F.col("margin")))


def not_finite(scored: DataFrame) -> DataFrame:
    return scored.where("margin is null or isnan(margin) or abs(margin) = double('infinity')")


def fit_ablations(clean: DataFrame, augmented: DataFrame) -> dict[str, dict]:
    """Three models of tables(image_id, label, semantic, frequency): semantic, hybrid, hybrid with both views.

    Both tables must hold the same ids with the same labels, each once.
    """
    for view in (clean, augmented):
        require(view.groupBy("image_id").count().where("count > 1"), "ids are repeated")
    require(misaligned(clean, augmented), "views are not aligned")
    hybrid = lambda df: df.withColumn("features", F.concat("semantic", "frequency"))
    sets = {"semantic": clean.withColumn("features", F.col("semantic")), "hybrid": hybrid(clean), "hybrid_augmented": hybrid(clean.unionByName(augmented))}
    return {name: fit_probe(rows) for name, rows in sets.items()}


def fit_probes(rows: DataFrame, keys: list[str], width: int, features: str = "features", label: str = "label", c: float = 1.0, max_rounds: int = 60) -> list[tuple]:
    """(keys..., mean, std, weights, bias) of the standardized L2 logistic regression of every group of keys.

    All groups are fitted in the same passes, one a Newton step, of built-in sums over the rows. It is meant for few
    groups and few features: a pass brings some width * width / 2 numbers a group to the driver. Keys, labels and
    features may not be null. A group of one class, or one that has not settled after ``max_rounds`` passes, is an error.
    """
    xs, n = [f"_x{i}" for i in range(width)], width + 1
    base = rows.select(*keys, F.col(label).cast("double").alias("_y"), *[F.get(F.col(features), F.lit(i)).cast("double").alias(x) for i, x in enumerate(xs)])
    stats = base.groupBy(*keys).agg(F.count_distinct("_y").alias("_classes"), *[F.avg(x).alias(f"m{x}") for x in xs], *[F.stddev_pop(x).alias(f"s{x}") for x in xs]).collect()
    groups = {tuple(r[k] for k in keys): ([r[f"m{x}"] for x in xs], [r[f"s{x}"] or 1.0 for x in xs]) for r in stats}
    if any(r["_classes"] != 2 for r in stats):
        raise ValueError("both classes are needed in every group")
    schema = ", ".join([*(f"{k} {dict(rows.dtypes)[k]}" for k in keys), "_m array<double>", "_s array<double>", "_b array<double>"])

    def sums(trial: dict[tuple, np.ndarray]) -> dict[tuple, tuple]:
        """Loss, gradient and second derivatives of every group in ``trial``, without the penalty."""
        table = rows.sparkSession.createDataFrame([(*g, *groups[g], b.tolist()) for g, b in trial.items()], schema)
        z = [(F.col(x) - F.get("_m", F.lit(i))) / F.get("_s", F.lit(i)) for i, x in enumerate(xs)]
        scaled = base.join(F.broadcast(table), keys).select(*keys, "_y", "_b", *[v.alias(x) for v, x in zip(z, xs, strict=True)], F.lit(1.0).alias("_one"))  # a row a group
        names = [*xs, "_one"]
        m = sum((F.get("_b", F.lit(i)) * F.col(x) for i, x in enumerate(names)), F.lit(0.0))
        scored = scaled.withColumn("_z", m).withColumn("_p", probability(F.col("_z")))
        loss = F.sum(F.log1p(F.exp(-F.abs("_z"))) + F.greatest("_z", F.lit(0.0)) - F.col("_y") * F.col("_z"))
        gradient = [F.sum((F.col("_p") - F.col("_y")) * F.col(x)) for x in names]
        curved = F.col("_p") * (1 - F.col("_p"))
        second = [F.sum(curved * F.col(names[i]) * F.col(names[j])) for i in range(n) for j in range(i, n)]
        found = {}
        for r in scored.groupBy(*keys).agg(loss.alias("loss"), F.array(*gradient).alias("gradient"), F.array(*second).alias("second")).collect():
            h = np.zeros((n, n))
            h[np.triu_indices(n)] = r["second"]
            found[tuple(r[k] for k in keys)] = (r["loss"], np.array(r["gradient"]), h + np.triu(h, 1).T)
        return found

    penalty = np.append(np.full(width, 1.0 / c), 0.0)
    best = {g: (np.inf, np.zeros(n)) for g in groups}
    step = {g: np.zeros(n) for g in groups}
    for _ in range(max_rounds):
        trial = {g: best[g][1] - step[g] for g in step}
        for g, (loss, gradient, second) in (sums(trial) if trial else {}).items():
            b = trial[g]
            value = loss + (penalty * b * b).sum() / 2
            if value > best[g][0] + 1e-9 * abs(best[g][0]):
                step[g] = step[g] / 2
                continue
            best[g] = (value, b)
            step[g] = np.linalg.solve(second + np.diag(penalty) + 1e-12 * np.eye(n), gradient + penalty * b)
            if np.abs(step[g]).max() < 1e-8:
                del step[g]
    if step:
        raise RuntimeError(f"{len(step)} groups have not settled after {max_rounds} passes")
    return [(*g, *groups[g], b[:-1].tolist(), float(b[-1])) for g, (_, b) in best.items()]


def metadata_baseline(rows: DataFrame, seeds: list[int], folds: int = 5) -> DataFrame:
    """seed, auc of out-of-fold scores of a four-feature probe; rows(image_id, label, width, height, bytes).

    The models of all seeds and folds are fitted together.
    """
    base = rows.select("image_id", "label", metadata_features(F.col("width"), F.col("height"), F.col("bytes")).alias("features"))
    dealt = None
    for seed in seeds:
        part = stratified_folds(base, folds, seed).withColumn("seed", F.lit(seed))
        dealt = part if dealt is None else dealt.unionByName(part)
    dealt = dealt.persist()
    trained = dealt.withColumn("held", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).where("held <> fold")
    models = fit_probes(trained, ["seed", "held"], 4)
    dealt.unpersist()
    table = rows.sparkSession.createDataFrame(models, "seed int, fold int, mean array<double>, std array<double>, weights array<double>, bias double")
    scored = dealt.join(F.broadcast(table), ["seed", "fold"])  # a row for each seed and fold
    m = margin(F.col("features"), F.col("mean"), F.col("std"), F.col("weights"), F.col("bias"))
    return roc_auc(scored.select("seed", "label", probability(m).alias("score")), ["seed"])


def auc_summary(aucs: DataFrame) -> DataFrame:
    """n, mean, least, median and greatest AUC of a table of AUCs, one a seed or a pair; one row."""
    return aucs.agg(F.count("auc").alias("n"), F.avg("auc").alias("mean"), F.min("auc").alias("min"), F.percentile("auc", 0.5).alias("median"), F.max("auc").alias("max"))


#: Numbers of second derivatives that one pass sums, over all its models.
SECOND = 1 << 22
#: Numbers in a row of partial sums.
CHUNK = 1 << 13


def _summed(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], length: int) -> np.ndarray:
    """Sums of ``length`` numbers over all rows: each task adds up its own, chunks of them are summed by index."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        add(batches, total)
        for k in range(0, length, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + CHUNK].tobytes()], pa.binary())], names=["at", "sums"])

    def whole(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_py()) for batch in batches for x in batch.column("sums"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

    schema, out = "at long, sums binary", np.zeros(length)
    for r in df.mapInArrow(part, schema).groupBy("at").applyInArrow(whole, schema).toLocalIterator():
        out[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["sums"])
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(values) != len(column) * width or np.isnan(values).any():
        raise ValueError("features must have one width and no nulls")
    return values.reshape(len(column), width)


def fit_without(rows: DataFrame, held: list[tuple[str, ...]], c: float = 1.0, max_rounds: int = 60, tol: float = 1e-9) -> list[dict]:
    """A model (mean, std, weights, bias, n) for each tuple of sources in ``held``, fitted on the rows of all other sources.

    All models are fitted in the same passes, one a Newton step: a pass multiplies blocks of rows
    with the matrix of all coefficients, and losses, gradients and second derivatives are added up by task
    and then by chunk. Models go in rounds of as many as SECOND second derivatives allow. A model
    of one class, or one that has not settled after ``max_rounds`` passes, is an error.
    """
    width = len(rows.select("features").first()[0]) if held else 0
    ready = rows.select("source", F.col("label").cast("double").alias("label"), "features")
    at_once = max(1, SECOND // (width + 1) ** 2)
    out: list[dict] = []
    for k in range(0, len(held), at_once):
        out += _fit_round(ready, held[k : k + at_once], width, c, max_rounds, tol)
    return out


def _fit_round(rows: DataFrame, held: list[tuple[str, ...]], width: int, c: float, max_rounds: int, tol: float) -> list[dict]:
    models = len(held)
    out_of = {s: np.array([s not in h for h in held]) for s in {s for h in held for s in h}}
    everywhere = np.ones(models, dtype=bool)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features, labels and which models a row belongs to."""
        for batch in batches:
            uses = np.array([out_of.get(s, everywhere) for s in batch.column("source").to_pylist()])
            if len(uses):
                yield _matrix(batch.column("features"), width), batch.column("label").to_numpy(zero_copy_only=False), uses

    def moments(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        table = total.reshape(2 * width + 2, models)
        for x, y, uses in blocks(batches):
            u = uses.astype(float)
            table[:width] += x.T @ u
            table[width : 2 * width] += (x * x).T @ u
            table[-2] += u.sum(axis=0)
            table[-1] += y @ u

    found = _summed(rows, moments, (2 * width + 2) * models).reshape(2 * width + 2, models)
    n, positive = found[-2], found[-1]
    if ((positive == 0) | (positive == n)).any():
        raise ValueError("both classes are needed")
    mean = found[:width] / n
    std = np.sqrt(np.maximum(found[width : 2 * width] / n - mean * mean, 0))
    std[std <= 1e-9 * np.abs(mean) + 1e-300] = 1.0
    penalty = np.append(np.full(width, 1.0 / c), 0.0)[:, None]
    size = (width + 1) ** 2

    def sums(trial: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and second derivatives of the models in ``some`` at ``trial`` (standardized weights and bias)."""
        m, s = mean[:, some], std[:, some]
        slope = trial[:-1] / s
        shift = trial[-1] - (m * slope).sum(axis=0)

        def add(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
            loss, gradient, second = total[: len(some)], total[len(some) : (width + 2) * len(some)].reshape(width + 1, len(some)), total[(width + 2) * len(some) :].reshape(len(some), width + 1, width + 1)
            for x, y, uses in blocks(batches):
                one = np.column_stack([x, np.ones(len(x))])
                for low in range(0, len(x), 4096):
                    part, u, label = one[low : low + 4096], uses[low : low + 4096][:, some].astype(float), y[low : low + 4096, None]
                    z = part[:, :-1] @ slope + shift
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    loss += (u * (np.logaddexp(0, z) - label * z)).sum(axis=0)
                    gradient += part.T @ (u * (p - label))
                    curved = u * p * (1 - p)
                    for k in range(len(some)):
                        second[k] += part.T @ (part * curved[:, k : k + 1])

        got = _summed(rows, add, len(some) * (1 + width + 1 + size))
        loss, gradient, second = got[: len(some)], got[len(some) : (width + 2) * len(some)].reshape(width + 1, len(some)), got[(width + 2) * len(some) :].reshape(len(some), width + 1, width + 1)
        for k in range(len(some)):  # from features to standardized ones
            change = np.diag(np.append(1 / s[:, k], 1.0))
            change[-1, :-1] = -m[:, k] / s[:, k]
            gradient[:, k] = change.T @ gradient[:, k]
            second[k] = change.T @ second[k] @ change
        return loss, gradient, second

    best, value = np.zeros((width + 1, models)), np.full(models, np.inf)
    step = np.zeros((width + 1, models))
    left = np.arange(models)
    for _ in range(max_rounds):
        trial = best[:, left] - step[:, left]
        loss, gradient, second = sums(trial, left)
        now = loss + (penalty * trial * trial).sum(axis=0) / 2
        settled = []
        for j, k in enumerate(left):
            if now[j] > value[k] + 1e-9 * abs(value[k]):
                step[:, k] /= 2
                continue
            best[:, k], value[k] = trial[:, j], now[j]
            step[:, k] = np.linalg.solve(second[j] + np.diag(penalty[:, 0]) + 1e-12 * np.eye(width + 1), gradient[:, j] + penalty[:, 0] * trial[:, j])
            if np.abs(step[:, k]).max() < max(tol, 1e-12) ** 0.5:
                best[:, k] -= step[:, k]  # what is left after this step is of the order of its square
                settled.append(k)
        left = np.setdiff1d(left, settled)
        if not len(left):
            break
    else:
        raise RuntimeError(f"{len(left)} models have not settled after {max_rounds} passes")
    return [{"mean": mean[:, k].tolist(), "std": std[:, k].tolist(), "weights": best[:-1, k].tolist(), "bias": float(best[-1, k]), "n": int(n[k])} for k in range(models)]


def leave_pair_out(rows: DataFrame, real: list[str], fake: list[str], augmented: DataFrame | None = None, tol: float = 1e-9) -> DataFrame:
    """pair, n_fit, label, score (margin) of the rows of each (real, fake) pair of sources under a model without them.

    Models are fitted on the rows of all other sources and, if given, on their ``augmented`` views; only ``rows``
    are scored. All pairs are fitted in the same passes over a table kept in the cluster's memory or on its disks,
    and scored in one.
    """
    views = rows if augmented is None else rows.unionByName(augmented.select(rows.columns))
    fitted = views.select("source", "label", "features").persist()
    pairs = [(r, f) for r in real for f in fake]
    models = fit_without(fitted, pairs, tol=tol)
    fitted.unpersist()
    table = [(s, f"{r}|{f}", m["n"], m["mean"], m["std"], m["weights"], m["bias"]) for (r, f), m in zip(pairs, models, strict=True) for s in (r, f)]
    known = rows.sparkSession.createDataFrame(table, "source string, pair string, n_fit long, mean array<double>, std array<double>, weights array<double>, bias double")
    m = margin(F.col("features"), F.col("mean"), F.col("std"), F.col("weights"), F.col("bias"))
    return rows.select("source", "label", "features").join(F.broadcast(known), "source").select("pair", "n_fit", "label", m.alias("score"))  # two rows a pair


def pair_audit(held_out: DataFrame, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """pair, n_fit, n_real, n_fake, auc, low, high of the rows that ``leave_pair_out`` scored."""
    counts = held_out.groupBy("pair").agg(F.max("n_fit").alias("n_fit"), F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"))
    return counts.join(roc_auc(held_out, ["pair"]), "pair").join(bootstrap_auc_ci(held_out, ["pair"], replicates=replicates, seed=seed), "pair", "left")


def branch_contributions(rows: DataFrame, model: dict, semantic: int, features: str = "features") -> DataFrame:
    """``rows`` with the parts of the margin that the first ``semantic`` features and the others make."""
    arrays = {k: F.array(*[F.lit(v) for v in model[k]]) for k in ("mean", "std", "weights")}
    standard = F.zip_with(F.zip_with(F.col(features), arrays["mean"], lambda x, y: x.cast("double") - y), arrays["std"], lambda x, y: x / y)
    out = rows.withColumn("standardized", standard).withColumn("_terms", F.zip_with("standardized", arrays["weights"], lambda x, w: x * w))
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
    rest = len(model["weights"]) - semantic
    return out.withColumn("semantic_part", add(F.slice("_terms", 1, semantic))).withColumn("frequency_part", add(F.slice("_terms", semantic + 1, max(rest, 1))) if rest else F.lit(0.0)).drop("_terms")


def branch_summary(parts: DataFrame, semantic: int, keys: list[str] | None = None) -> DataFrame:
    """keys, branch, class, n and quantiles of what ``branch_contributions`` gave.

    Both contributions are summarised for all rows and for each class, the absolute standardized features after
    the first ``semantic`` ones for all.
    """
    keys = keys or []
    named = F.array(*[F.struct(F.lit(name).alias("branch"), F.col(f"{name}_part").alias("value")) for name in ("semantic", "frequency")])
    classes = F.array(F.lit("all"), F.when(F.col("label") == 1, "FAKE").otherwise("REAL"))
    sums = parts.select(*keys, F.explode(named).alias("x"), classes.alias("c")).select(*keys, "x.branch", F.explode("c").alias("class"), "x.value")
    rest = F.expr(f"slice(standardized, {semantic + 1}, greatest(size(standardized) - {semantic}, 0))")
    cells = parts.select(*keys, F.lit("absolute_frequency").alias("branch"), F.lit("all").alias("class"), F.explode(rest).alias("value")).withColumn("value", F.abs("value"))
    return quantile_summary(sums.unionByName(cells), [*keys, "branch", "class"], "value")


def shift_diagnosis(rows: DataFrame, stats: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """keys, largest and 99.9th percentile of |standardized feature| under ``stats(idx, mean, std)``."""
    cells = rows.select(*keys, F.posexplode(features).alias("idx", "x")).join(F.broadcast(stats), "idx")  # one row a feature
    z = F.abs((F.col("x").cast("double") - F.col("mean")) / F.col("std"))
    return quantiles(cells.select(*keys, z.alias("z")), keys, "z", [1.0, 0.999], ["max_z", "p999_z"])
