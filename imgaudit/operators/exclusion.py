"""Exclusion, duplicates, provenance joins and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import blank_to_null
from .sampling import require


def exclude_frozen(rows: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys with ``frozen``; blank values never match, case does not count."""
    for key in keys:
        held = frozen.select(F.lower(blank_to_null(F.col(key).cast("string"))).alias("_f")).where("_f is not null").distinct()
        rows = rows.join(held, F.lower(blank_to_null(F.col(key).cast("string"))) == F.col("_f"), "left_anti")
    return rows


def dedupe_by_hash(rows: DataFrame, order: str, sha: str = "sha256") -> DataFrame:
    """The first row of each hash, over all labels, and all rows without a hash.

    A partial minimum comes before the join, so a very frequent hash is one row in the shuffle.
    """
    known = F.lower(blank_to_null(F.col(sha)))
    first = rows.where(known.isNotNull()).groupBy(known.alias("_h")).agg(F.min(order).alias("_o"))
    kept = rows.join(first, (known == F.col("_h")) & (F.col(order) == F.col("_o")), "left_semi")
    return kept.unionByName(rows.where(known.isNull()))


def extract_planned_rows(plan: DataFrame, shards: DataFrame, keys: list[str], checked: list[str]) -> DataFrame:
    """Rows of ``shards`` that the plan names; an error if a checked column differs."""
    named = plan.select(*keys, *[F.col(c).alias(f"_{c}") for c in checked])
    found = shards.join(named, keys)
    differs = F.lit(False)
    for c in checked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    require(found.where(differs).select(*keys), "planned rows differ")
    return found.drop(*[f"_{c}" for c in checked])


def overlapping_ids(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def validate_disjoint(a: DataFrame, b: DataFrame, key: str = "image_id") -> None:
    common = overlapping_ids(a, b, key)
    n = common.count()
    if n:
        raise ValueError(f"{n} ids are in both sets, such as {[r[0] for r in common.orderBy(key).limit(3).collect()]}")


def misaligned(a: DataFrame, b: DataFrame, key: str = "image_id", label: str = "label") -> DataFrame:
    """Ids that only one of the views has, or that have different labels in them."""
    x, y = a.select(key, F.col(label).alias("_a")), b.select(key, F.col(label).alias("_b"))
    return x.join(y, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_a").isNull())


def attach_source(scored: DataFrame, manifest: DataFrame, key: str = "relative_path", strict: bool = True) -> DataFrame:
    """Scores with the manifest's source, ``unspecified`` where it names none."""
    named = manifest.select(key, F.coalesce(blank_to_null(F.col("source")), F.lit("unspecified")).alias("source"))
    if strict:
        require(scored.join(named, key, "left_anti").select(key), "scores without a manifest row")
    return scored.join(named, key)


def overlap_summary(a: DataFrame, b: DataFrame, sha: str = "sha256") -> DataFrame:
    """rows, unique hashes and repeats of each set, and the hashes that both have; one row."""
    count = lambda df, p: df.agg(F.count(sha).alias(f"{p}_rows"), F.count_distinct(sha).alias(f"{p}_unique"))
    both = a.select(sha).distinct().join(b.select(sha), sha, "left_semi").agg(F.count("*").alias("exact_overlap"))
    out = count(a, "a").crossJoin(count(b, "b")).crossJoin(both)  # three rows of one aggregate each
    return out.withColumn("a_repeats", F.col("a_rows") - F.col("a_unique")).withColumn("b_repeats", F.col("b_rows") - F.col("b_unique"))


def pending_work(plan: DataFrame, attempts: DataFrame, key: str = "plan_index") -> DataFrame:
    """Planned rows without a successful attempt, with the error of the last one."""
    done = attempts.where("status = 'ok'").select(key).distinct()
    last = attempts.where("status <> 'ok'").groupBy(key).agg(F.max_by("error", "attempt").alias("last_error"), F.max("attempt").alias("last_attempt"))
    return plan.join(done, key, "left_anti").join(last, key, "left")


def provenance_violations(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, problem): labels outside 0 and 1, class names that differ, missing source ids, repeated ids."""
    name = F.when(F.col("label") == 1, "FAKE").when(F.col("label") == 0, "REAL")
    problems = [
        (F.coalesce(~F.col("label").isin(0, 1), F.lit(True)), "label"),
        (F.col("label").isin(0, 1) & ~F.upper("class_name").eqNullSafe(name), "class_name"),
        (blank_to_null(F.col("source_id").cast("string")).isNull(), "source_id"),
    ]
    found = [rows.where(c).select(key, F.lit(p).alias("problem")) for c, p in problems]
    found.append(rows.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("problem")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def class_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys and all their prefixes (rollup), with the share of each label."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("n_real"), F.count_if(F.col("label") == 1).alias("n_fake"))


def set_fingerprint(rows: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """One hash of a set of ids: of the hashes of its sorted hash buckets, in bucket order.

    Each bucket is sorted in a task of its own; only ``buckets`` hashes meet in the last one.
    """
    ids = rows.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    part = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % buckets
    per = ids.groupBy(part.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["h"])), "\n")
    return per.agg(F.sha2(line, 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_ids"))
