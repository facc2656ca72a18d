"""Registered queries that SQL cannot repeat, against numpy on the same tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from imgaudit.operators import sampling
from imgaudit.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def logistic(x, y):
    """mean, std, weights and bias of the L2 logistic regression of standardized columns, by Newton steps."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    penalty = np.append(np.ones(x.shape[1]), 0.0)
    b = np.zeros(z.shape[1])
    value = lambda b: np.logaddexp(0, z @ b).sum() - y @ (z @ b) + (penalty * b * b).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ b)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty), z.T @ (p - y) + penalty * b)
        while value(b - step) > value(b) + 1e-12:
            step = step / 2
        b = b - step
        if np.abs(step).max() < 1e-10:
            break
    return mean, std, b[:-1], b[-1]


def margins(model, x):
    mean, std, weights, bias = model
    return (x - mean) / std @ weights + bias


def auc(y, s):
    neg = np.sort(s[y == 0])
    below, upto = np.searchsorted(neg, s[y == 1]), np.searchsorted(neg, s[y == 1], "right")
    return (below + upto).sum() / 2 / ((y == 1).sum() * (y == 0).sum())


@pytest.fixture(scope="module")
def vectors(spark):
    rows = queries.features(spark, SF).orderBy("image_id").toPandas()
    return rows, np.stack(rows["features"]).astype(np.float64), rows["label"].to_numpy()


def test_probe_scores_and_contributions(spark, vectors):
    rows, x, y = vectors
    model = logistic(x, y)
    got = queries.probe_scores(spark, SF).toPandas().sort_values("image_id")
    m = margins(model, x)
    assert got["margin"].to_numpy() == pytest.approx(m, abs=2e-3)
    assert got["prob"].to_numpy() == pytest.approx(1 / (1 + np.exp(-m)), abs=1e-3)
    parts = queries.branch_contributions(spark, SF).toPandas().sort_values("image_id")
    terms = (x - model[0]) / model[1] * model[2]
    assert parts["semantic_part"].to_numpy() == pytest.approx(terms[:, :48].sum(axis=1), abs=2e-3)
    assert parts["frequency_part"].to_numpy() == pytest.approx(terms[:, 48:].sum(axis=1), abs=2e-3)


def test_held_out_pairs(spark, vectors):
    rows, x, y = vectors
    shifted = (x * 0.98 - 0.01).astype(np.float32).astype(np.float64)
    got = {r["pair"]: r for r in queries.leave_pair_out(spark, SF).collect()}
    sources = rows["source"].to_numpy()
    assert len(got) == 25
    for real in range(5):
        for fake in range(5, 10):
            own = np.isin(sources, [f"g{real}", f"g{fake}"])
            model = logistic(np.concatenate([x[~own], shifted[~own]]), np.concatenate([y[~own], y[~own]]))
            r = got[f"g{real}|g{fake}"]
            assert r["auc"] == pytest.approx(auc(y[own], margins(model, x[own])), abs=2e-3)
            assert (r["n_fit"], r["n_real"], r["n_fake"]) == (2 * (~own).sum(), (own & (y == 0)).sum(), (own & (y == 1)).sum())
            assert r["low"] <= r["auc"] <= r["high"]


def test_promoted_probe(spark, vectors):
    rows, x, y = vectors
    ids = rows["image_id"].to_numpy()
    training = queries.features(spark, SF).where("image_id % 3 = 0").selectExpr("*", "concat('d', image_id % 2) as domain", "'clean' as view")
    chosen = {r[0] for r in sampling.domain_balanced(training, 7).select("image_id").collect()}
    counts = pd.DataFrame({"d": [i % 2 for i in chosen], "y": [y[ids == i][0] for i in chosen]}).value_counts()
    assert len(set(counts)) == 1  # the same number of each domain and label
    fit = np.isin(ids, list(chosen))
    model = logistic(x[fit], y[fit])
    prob = 1 / (1 + np.exp(-margins(model, x)))
    held = ids % 3 == 1
    best = max(((prob[held & (y == 1)] >= t).mean() - (prob[held & (y == 0)] >= t).mean() for t in prob[held]))
    got = {r["dataset"]: r for r in queries.promoted_probe(spark, SF).collect()}
    for d in (0, 1):
        own = (ids % 3 == 2) & (ids % 2 == d)
        r = got[f"d{d}"]
        assert (r["n"], r["auc"]) == (own.sum(), pytest.approx(auc(y[own], prob[own]), abs=2e-3))
        assert r["score_std"] == pytest.approx(prob[own].std(), abs=2e-3)
        assert r["real_median"] == pytest.approx(np.median(prob[own & (y == 0)]), abs=2e-3)
        # some threshold of the best balance on the calibration rows gives the share of fakes
        good = [t for t in prob[held] if (prob[held & (y == 1)] >= t).mean() - (prob[held & (y == 0)] >= t).mean() >= best - 1e-4]
        assert any(abs((prob[own] >= t).mean() - r["fake_rate"]) < 2e-3 for t in good)


def test_metadata_baseline(spark):
    rows = queries._metadata(spark, SF)
    got = {r["seed"]: r["auc"] for r in queries.metadata_baseline(spark, SF).collect()}
    for seed in range(5):
        dealt = sampling.stratified_folds(rows, 5, seed).toPandas()
        w, h, b = (dealt[c].to_numpy(dtype=float) for c in ("width", "height", "bytes"))
        x = np.column_stack([np.log1p(w), np.log1p(h), np.log1p(b), np.log(w / h)])
        y, fold = dealt["label"].to_numpy(), dealt["fold"].to_numpy()
        prob = np.zeros(len(y))
        for k in range(5):
            prob[fold == k] = 1 / (1 + np.exp(-margins(logistic(x[fold != k], y[fold != k]), x[fold == k])))
        assert got[seed] == pytest.approx(auc(y, prob), abs=2e-3)
    summary = queries.metadata_summary(spark, SF).first()
    values = sorted(got.values())
    assert (summary["n"], summary["min"], summary["median"], summary["max"]) == (5, values[0], values[2], values[-1])
    assert summary["mean"] == pytest.approx(np.mean(values), abs=2e-4)


@pytest.fixture(scope="module")
def scores(spark):
    return queries.scored(spark, SF).select("condition", "label", "score").toPandas()


def replicates(y, columns, n, seed):
    """AUC of each column over plain resamples of the rows of each class."""
    rng = np.random.default_rng(seed)
    pos, neg, out = np.flatnonzero(y == 1), np.flatnonzero(y == 0), []
    for _ in range(n):
        at = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        out.append([auc(y[at], c[at]) for c in columns])
    return np.array(out)


def test_bootstrap_intervals(spark, scores):
    plain = {r["condition"]: r for r in queries.bootstrap_ci(spark, SF).collect()}
    paired = {r["condition"]: r for r in queries.paired_bootstrap_ci(spark, SF).collect()}
    assert set(plain) == set(paired) == set(scores["condition"])
    for condition, own in scores.groupby("condition"):
        y, s = own["label"].to_numpy(), own["score"].to_numpy()
        want = np.quantile(replicates(y, [s], 2000, 1)[:, 0], [0.025, 0.975])
        assert [plain[condition]["low"], plain[condition]["high"]] == pytest.approx(want, abs=0.02)
        assert abs(paired[condition]["low"]) + abs(paired[condition]["high"]) < 1e-6  # the square keeps the order


def test_audits(spark, scores):
    got = {r["condition"]: r for r in queries.score_audit(spark, SF).collect()}
    kinds = {r["kind"]: r for r in queries.stress_audit(spark, SF).collect()}
    aucs = {}
    for condition, own in scores.groupby("condition"):
        y, s, r = own["label"].to_numpy(), own["score"].to_numpy(), got[condition]
        aucs[condition] = auc(y, s)
        hit = s >= queries.T
        assert (r["n"], r["tp"], r["fp"]) == (len(y), (hit & (y == 1)).sum(), (hit & (y == 0)).sum())
        assert r["prob_auc"] == pytest.approx(aucs[condition], abs=1e-6)
        assert r["margin_auc"] == pytest.approx(auc(y, np.log(s / (1 - s))), abs=1e-6)
        assert r["brier"] == pytest.approx(((s - y) ** 2).mean(), abs=1e-6)
        assert r["distinct_prob"] == len(np.unique(s))
        assert [r["prob_low"], r["prob_high"]] == pytest.approx(np.quantile(replicates(y, [s], 2000, 2)[:, 0], [0.025, 0.975]), abs=0.02)
        # prob and margin order alike but where rounding makes values equal
        assert abs(r["difference_low"]) < 1e-3 and abs(r["difference_high"]) < 1e-3
    single = [v for c, v in aucs.items() if c != "clean"]
    assert kinds["individual_transform"]["mean_auc"] == pytest.approx(np.mean(single), abs=1e-6)
    assert kinds["individual_transform"]["min_auc"] == pytest.approx(min(single), abs=1e-6)
