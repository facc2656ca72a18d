"""Bounds of the Jaccard join: no postings of sets that sizes keep apart, none lost of others, parity bitmaps."""

import numpy as np
import pyarrow as pa
import pytest

from imgaudit.llm import jaccard_join
from imgaudit.llm.store import Scratch


def heads_of(spark, sizes, percent):
    rows = [(k, n, 1, list(range(n - -(-percent * n // 100) + 1))) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "set_id long, n long, copies long, tokens array<long>")


def test_sets_of_distant_sizes_share_no_posting(spark):
    with Scratch(spark, "sizes") as own:
        assert jaccard_join._postings(heads_of(spark, [100, 200, 400], 90), 90, own).count() == 0
        near = jaccard_join._postings(heads_of(spark, [100, 110, 400], 90), 90, own).collect()
        assert {r["set_id"] for r in near} == {0, 1}


@pytest.mark.parametrize("percent", [50, 80, 90, 99, 100])
def test_sets_of_close_sizes_share_every_token_they_may_need(percent):
    sizes = np.arange(1, 260)
    prefixes = [np.arange(n - -(-percent * n // 100) + 1) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(sizes), jaccard_join._lists(prefixes)], names=["n", "tokens"])
    found = {int(n): {} for n in sizes}
    for some, tokens, low, at, row in jaccard_join._entries(batch, percent):
        for n, token, own_class, place in zip(some.column("n").to_numpy()[row], tokens, low, at, strict=True):
            found[int(n)].setdefault(int(place), {})[int(token)] = own_class
    for n in found:
        for m in range(n, min(n * 100 // percent, len(sizes)) + 1):
            least = -(-(n + m) * percent // (100 + percent))
            for place in range(min(n, m) - least + 1):
                x, y = found[n][place], found[m][place]
                assert any(x[token] or y[token] for token in x.keys() & y.keys()), (n, m, place)


def test_parity_bitmaps_bound_the_difference(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    sets = [base[:n] for n in (1, 30, 64, 65, 250, 270, 500, 530)] + [np.append(base[:500], rng.integers(0, 1 << 63, 20).astype(np.uint64)), rng.integers(0, 1 << 63, 510).astype(np.uint64)]
    rows = [(k, len(s), jaccard_join.parity(s).view(np.int64).tolist()) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, n int, parity array<long>")
    pairs = df.alias("x").crossJoin(df.alias("y")).select("x.id", "y.id", jaccard_join._bits_apart("x.parity", "y.parity"))
    got = {(a, b): d for a, b, d in pairs.collect()}
    assert all(d <= len(np.setxor1d(sets[a], sets[b])) and d == got[b, a] for (a, b), d in got.items())
    assert got[6, 6] == 0 and got[6, 8] > 10 and got[6, 9] > 100
