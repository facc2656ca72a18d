"""Deterministic, balanced samples, quotas and splits.

Rows are ranked by a hash of seed and id with the id as tie-break, so no result depends on
partitioning. Ranks are limited, which lets Spark keep only the first rows of a group in each task
before it shuffles.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import normalize_group, seed_hex


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


#: Hexadecimal digits of a hashed order that deal the rows of a group into parts (4,096).
PART_DIGITS = 3


def ranked_by_hash(rows: DataFrame, by: list[str], hashed: Column, key: str, name: str = "rank") -> DataFrame:
    """``ranked`` in the order of (hashed, key), where ``hashed`` is a hexadecimal hash, for groups of any size.

    Parts of a group by the first digits are ranked apart and shifted by the rows of the parts before.
    """
    dealt = rows.withColumn("_hash", hashed).withColumn("_part", F.substring("_hash", 1, PART_DIGITS))
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    names = [*by, "_part"]
    starts = dealt.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_k_{c}") for c in names], "_before")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inner = F.row_number().over(W.partitionBy(*names).orderBy("_hash", key))
    out = dealt.withColumn(name, inner).join(starts, same).withColumn(name, F.col(name) + F.col("_before"))
    return out.drop("_hash", "_part", "_before", *[f"_k_{c}" for c in names])


def require(problem: DataFrame, message: str) -> None:
    """Raise with the first rows of ``problem`` if it has any."""
    found = problem.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def short_groups(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Groups of ``wanted(keys, quota)`` with fewer rows than their quota."""
    return wanted.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").where("coalesce(n, 0) < quota")


def balanced_sample(rows: DataFrame, per_class: int, seed: int, label: str = "label", key: str = "image_id", role: str | None = None, strict: bool = True) -> DataFrame:
    """``per_class`` rows of each label, without replacement."""
    if strict:
        require(rows.groupBy(label).count().where(F.col("count") < per_class), f"fewer than {per_class} rows")
    out = ranked(rows, [label], [seed_hex(seed, F.col(key)), F.col(key)]).where(F.col("rank") <= per_class).drop("rank")
    return out if role is None else out.withColumn("role", F.lit(role))


def balanced_limit(rows: DataFrame, limit: int, order: str, label: str = "label") -> DataFrame:
    """The first limit // 2 rows of each label in the given order; all rows if there are no more than limit."""
    if limit < 2:
        raise ValueError("limit must be at least 2")
    if rows.limit(limit + 1).count() <= limit:
        return rows
    return ranked(rows, [label], [F.col(order)]).where(F.col("rank") <= limit // 2).drop("rank")


def quota_select(rows: DataFrame, per_class: int, seed: int, page: str, key: str, excluded: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Equal quotas of labels 0 and 1, pages in seeded order and rows in seeded order inside a page."""
    kept = rows.where(F.col(label).isin(0, 1))
    if excluded is not None:
        kept = kept.join(excluded.select(key).distinct(), key, "left_anti")
    order = [seed_hex(seed, F.col(page)), F.col(page), seed_hex(seed, F.col(page), F.col(key)), F.col(key)]
    return ranked(kept, [label], order).where(F.col("rank") <= per_class)


def quota_select_pages(pages: DataFrame, read: Callable[[list[str]], DataFrame], per_class: int, seed: int, page: str, key: str, excluded: DataFrame | None = None, label: str = "label", first: int = 8) -> tuple[DataFrame, int]:
    """What ``quota_select`` gives of all pages, read in rounds that end when both quotas are full; and how many pages were read.

    ``pages`` has a row for each page name in the column ``page``; ``read`` gives the rows of some
    pages. Pages go in seeded order, ``first`` of them in the first round and twice as many in each
    further one. Only the chosen rows, 2 * per_class at most, are kept between rounds.
    """
    names = (r[0] for r in pages.select(page).distinct().orderBy(seed_hex(seed, F.col(page)), page).toLocalIterator())
    chosen, left, size, opened = None, {0: per_class, 1: per_class}, first, 0
    while any(left.values()) and (some := list(itertools.islice(names, size))):
        opened += len(some)
        found = quota_select(read(some), per_class, seed, page, key, excluded, label)
        kept = [r for r in found.collect() if r["rank"] <= left[r[label]]]
        part = [{**r.asDict(), "rank": r["rank"] + per_class - left[r[label]]} for r in kept]
        for r in kept:
            left[r[label]] -= 1
        chosen = chosen or (found.schema, [])
        chosen[1].extend(part)
        size *= 2
    if chosen is None:
        return quota_select(read([]), per_class, seed, page, key, excluded, label), opened
    schema, rows = chosen
    return pages.sparkSession.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema), opened


def group_quotas(groups: DataFrame, total: int) -> DataFrame:
    """label, group, quota: ``total`` split over the groups of a label, remainder to the first in list order."""
    w = W.partitionBy("label")
    n, turn = F.count("*").over(w), F.row_number().over(w.orderBy("position"))
    return groups.withColumn("quota", F.floor(F.lit(total) / n) + F.when(turn <= F.lit(total) % n, 1).otherwise(0)).select("label", "group", "quota")


def group_balanced_select(rows: DataFrame, groups: DataFrame, per_class: int, reserve: int, seed: int, key: str, strict: bool = True, forbidden: list[str] | None = None) -> DataFrame:
    """A quota of each group, then a seeded order inside each label as selection_rank.

    Groups whose normalized name is that of a ``forbidden`` one are an error.
    """
    if forbidden:
        barred = {re.sub("[^a-z0-9]+", "", name.lower()) for name in forbidden}
        require(groups.where(normalize_group(F.col("group")).isin(*barred)), "groups are forbidden")
    quotas = group_quotas(groups, per_class + reserve)
    if strict:
        require(short_groups(rows, ["label", "group"], quotas), "groups are short")
    order = [seed_hex(seed, F.col(key)), F.col(key)]
    first = ranked(rows, ["label", "group"], order).where(F.col("rank") <= per_class + reserve)  # no quota is larger
    chosen = first.join(F.broadcast(quotas), ["label", "group"]).where("rank <= quota").drop("rank", "quota")
    shuffled = [seed_hex(seed, F.lit("order"), F.col(key)), F.col(key)]
    return ranked(chosen, ["label"], shuffled, "selection_rank")


def assign_split_roles(rows: DataFrame, train: int, evaluation: int, order: str, label: str = "label", strict: bool = True) -> DataFrame:
    """By label and order: the first rows train, the next ones evaluation, the rest reserve.

    ``order`` tells the rows of a label apart; a row without it is reserve. Only the first rows of a
    label are ranked, which gives the last value of each role; all rows are compared with these.
    """
    if strict:
        require(rows.groupBy(label).count().where(F.col("count") < train + evaluation), "too few rows")
    first = ranked(rows.where(F.col(order).isNotNull()).select(label, order), [label], [F.col(order)]).where(F.col("rank") <= train + evaluation)
    cuts = first.groupBy(F.col(label).alias("_label")).agg(F.max(F.when(F.col("rank") <= train, F.col(order))).alias("_train"), F.max(order).alias("_evaluation"))
    role = F.when(F.col(order) <= F.col("_train"), "train").when(F.col(order) <= F.col("_evaluation"), "evaluation").otherwise("reserve")
    return rows.join(cuts, F.col(label).eqNullSafe(F.col("_label")), "left").withColumn("role", role).drop("_label", "_train", "_evaluation")


def assign_training_records(rows: DataFrame, frozen: DataFrame, per_class: int, order: str = "selection_rank", label: str = "label", sha: str = "sha256") -> DataFrame:
    """The first ``per_class`` rows of each label with new hashes; label 1 also avoids those kept for label 0."""
    fresh = rows.join(frozen.select(F.lower(sha).alias("_f")).distinct(), F.lower(F.col(sha)) == F.col("_f"), "left_anti")
    first = ranked(fresh, [label, sha], [F.col(order)]).where("rank = 1").drop("rank")
    real = ranked(first.where(F.col(label) == 0), [label], [F.col(order)]).where(F.col("rank") <= per_class).drop("rank")
    fake = first.where(F.col(label) == 1).join(real.select(sha), sha, "left_anti").select(rows.columns)
    return real.select(rows.columns).unionByName(ranked(fake, [label], [F.col(order)]).where(F.col("rank") <= per_class).drop("rank"))


def domain_balanced(rows: DataFrame, seed: int, key: str = "image_id") -> DataFrame:
    """The same number of images of each (domain, label), all views of each; rows(domain, view, label, key)."""
    images = rows.select("domain", "label", key).distinct()
    least = images.groupBy("domain", "label").count().agg(F.min("count").alias("quota"))
    chosen = ranked_by_hash(images, ["domain", "label"], seed_hex(seed, F.col(key)), key).crossJoin(F.broadcast(least)).where("rank <= quota")
    return rows.join(chosen.select("domain", key), ["domain", key], "left_semi")


def stratified_folds(rows: DataFrame, folds: int, seed: int, label: str = "label", key: str = "image_id") -> DataFrame:
    dealt = ranked_by_hash(rows, [label], seed_hex(seed, F.lit("fold"), F.col(key)), key)
    return dealt.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop("rank")


def top_errors(scored: DataFrame, threshold: float, k: int, key: str = "image_id", score: str = "score", strict: bool = False) -> DataFrame:
    """The k worst false positives (score high) and false negatives (score low), with their rank."""
    p = F.col(score)
    kind = F.when((F.col("label") == 0) & (p >= threshold), "false_positive").when((F.col("label") == 1) & (p < threshold), "false_negative")
    wrong = scored.withColumn("error_type", kind).where("error_type is not null")
    out = ranked(wrong, ["error_type"], [F.when(F.col("error_type") == "false_positive", -p).otherwise(p), F.col(key)]).where(F.col("rank") <= k)
    if strict:
        found = {r["error_type"]: r["count"] for r in out.groupBy("error_type").count().collect()}
        if any(found.get(t, 0) < k for t in ("false_positive", "false_negative")):
            raise ValueError(f"fewer than {k} errors of a type: {found}")
    return out


def seeded_subsamples(scored: DataFrame, per_class: int, seeds: list[int], key: str = "image_id", keys: list[str] | None = None) -> DataFrame:
    """``per_class`` rows of each label for each seed and group of keys, with the seed."""
    table = scored.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
    tagged = scored.crossJoin(F.broadcast(table))
    order = [F.sha2(F.concat_ws(":", "seed", F.col(key).cast("string")), 256), F.col(key)]
    return ranked(tagged, [*(keys or []), "seed", "label"], order).where(F.col("rank") <= per_class).drop("rank")
