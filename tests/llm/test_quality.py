"""Weights, counts, threshold and draws of the quality classifier, recomputed from strings."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from imgaudit.llm import quality

RNG = random.Random(21)
GOOD = ["clear", "Prose", "reads", "well,", "überall", "today"]
BAD = ["BUY", "now!!!", "click", "here", "zzz...", "today"]
SCHEMA = "doc_id long, text string, key string, noise double, log_weight double, n_words int"


def text(words, n):
    return " ".join(RNG.choice(words) for _ in range(n))


ROWS = [(k, text(GOOD if k % 3 else BAD, RNG.randint(20, 60))) for k in range(120)]
ROWS += [(200, None), (201, ""), (202, "  \n"), (203, "clear"), (204, "!"), (None, text(GOOD, 30)), (5, text(BAD, 40)), (205, text(GOOD, 4000)), (206, "a" * 70_000)]
LABELS = [(k, 1 if k % 3 else 0, 0) for k in range(0, 120, 2)] + [(4, 0, 0), (8, 1, 1), (None, 1, 0), (10, None, 0), (999, 1, 0), (-1, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", 0.5, 7.0, 3) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def features(t):
    """Word pairs (the word itself if it is alone) and five-byte beginnings."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", t or "")]
    pairs = list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(w,) for w in words]
    return pairs, [w.encode()[:5] for w in words]


def brute_weights(rows, trained):
    size = 1 << quality.BUCKET_BITS
    ratios = []
    for k in (0, 1):
        raw, target = Counter(), Counter()
        for i, t in rows:
            own = features(t)[k]
            raw.update(own)
            if i in trained:
                target.update(own)
        n, m = sum(raw.values()), sum(target.values())
        table = {}
        for f, c in raw.items():
            expected = c * m / n
            sure = abs(target[f] - expected) >= quality.SIGNIFICANT * np.sqrt(expected + 1)
            table[f] = np.log((target[f] + 1) / (m + size)) - np.log((c + 1) / (n + size)) if sure else 0.0
        ratios.append(table)
    out = []
    for i, t in rows:
        own = features(t)
        out.append((i, len(own[1]), sum(np.mean([r[f] for f in fs]) for r, fs in zip(ratios, own, strict=True)) if own[1] else 0.0))
    return out


def test_weights_and_threshold_are_those_of_strings(spark, docs, labels):
    sample = {r["doc_id"]: r for r in quality.labelled_sample(labels, 10_000, 11).collect()}
    worst = {}
    for i, q, t in LABELS:
        if None not in (i, q, t):
            worst[i] = worst.get(i, True) and q == 1 and t == 0
    assert {i: r["good"] for i, r in sample.items()} == worst
    trained = {i for i, r in sample.items() if r["good"] and r["train"]}
    held = {i for i, r in sample.items() if r["good"] and not r["train"]}
    model = quality.fit(docs, labels, clean_loss=0.25)
    want = brute_weights(ROWS, trained)
    got = sorted(((r["doc_id"], r["n_words"], r["log_weight"]) for r in quality.score(docs, model.ratios).collect()), key=repr)
    want.sort(key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)
    assert np.ptp([x[2] for x in want]) > 0.1  # good and bad texts do weigh differently
    kept = sorted(x[2] for x in want if x[0] in held and x[1])
    rank = max(0, int(np.ceil(0.25 * len(kept))) - 1)
    assert model.threshold == pytest.approx(min(kept[rank], 0.0), abs=1e-9)
    # as many rows are drawn as weigh at least the threshold, and the stage keeps the same rows as the query
    drawn = quality.importance_resample(docs, labels, clean_loss=0.25)
    n = sum(x[2] >= model.threshold - 1e-12 for x in want)
    assert n <= drawn.count() <= n + 3  # repeated ids may tie at the cut
    taken = quality.accepted(docs, model)
    assert taken.columns == docs.columns
    assert sorted((r[0] for r in taken.select("doc_id").collect()), key=repr) == sorted((r[0] for r in drawn.select("doc_id").collect()), key=repr)


def test_draws_are_in_proportion_to_the_weights(spark):
    """The first of a Gumbel top-k is each document with the probability of its weight."""
    weights = [0.0, 0.002, 0.004, -0.003, 0.008, 0.001]
    p = np.exp(np.array(weights) / quality.TEMPERATURE)
    p /= p.sum()
    n = 20_000
    rows = spark.range(n).withColumnRenamed("id", "seed").withColumn("seed", F.col("seed").cast("int")).crossJoin(spark.createDataFrame(list(enumerate(weights)), "doc_id long, w double"))
    key = F.col("w") / quality.TEMPERATURE - F.log(-F.log(quality.uniform(F.col("doc_id"), F.col("seed"))))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy(key.desc()))).where("r = 1").groupBy("doc_id").count().collect()
    share = {r["doc_id"]: r["count"] / n for r in first}
    assert [share.get(i, 0.0) for i in range(6)] == pytest.approx(list(p), abs=0.015)


def test_ties_at_the_cut_are_all_taken(spark):
    scored = spark.createDataFrame([(i, float(k)) for i, k in enumerate([5, 4, 4, 4, 3, 1])], "doc_id long, gumbel_key double")
    assert quality.gumbel_top(scored, 2).count() == 4
    assert quality.gumbel_top(scored, 0).count() == 0
    assert quality.gumbel_top(scored, 9).count() == 6
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("gumbel_key"))
    cut = sorted((r[0] for r in many.select("gumbel_key").collect()), reverse=True)[12_344]
    assert quality.kth_key(many, 12_345) == cut


def test_without_labels_nothing_is_rejected(spark, docs, labels):
    model = quality.fit(docs, labels.limit(0))
    assert quality.accepted(docs, model).count() == len(ROWS)
    assert quality.importance_resample(docs.limit(0), labels).count() == 0
