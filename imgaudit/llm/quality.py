"""Quality classifier by importance resampling with hashed n-gram models.

Two generative models over hashed features are counted: the target model over labelled good texts
and the raw model over all documents. Features are word pairs and five-byte word beginnings, each
with a table of its own. A document's log importance weight is its mean log ratio target / raw,
where buckets whose counts do not differ significantly count as equal. Documents are sampled without
replacement in proportion to exp(log weight / TEMPERATURE) by Gumbel top-k. How many is calibrated on
held-out labelled rows: as many as weigh at least what all but a hundredth of the good ones do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counters import count_all
from .store import free_name, materialize
from .words import LOWER, MODEL, batch_words, grams, mix, text_bytes

#: Buckets of each feature table: 2**18.
BUCKET_BITS = 18
#: Bytes of the word beginnings.
BEGINNING = 5
#: Standard deviations by which a bucket's target count must differ from its expectation.
SIGNIFICANT = 4.0
#: Divides log weights before the noise is added. Both are means over a document's features, so
#: differences of a few hundredths are certain and only documents about the cut are left to chance.
TEMPERATURE = 0.005
#: Labelled rows used at most, chosen by a hash of doc_id; their ids are broadcast (17 bytes each).
SAMPLE_ROWS = 200_000
#: Of 10 labelled rows, so many train the target model; the others set the threshold.
TRAIN_TENTHS = 7


def uniform(key: Column, seed: int) -> Column:
    """Uniform double in (0, 1) from a key and a seed, the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = np.zeros(len(starts), dtype=np.uint64)
    for k in range(BEGINNING):
        at = np.minimum(starts + k, len(data) - 1)
        h = (h << np.uint64(9)) + np.where(starts + k < ends, LOWER[data[at]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return mix(h)


def _features(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(row, pair buckets, beginning buckets, words) of each text with words."""
    data, offsets = text_bytes(batch.column("text"))
    low = np.uint64((1 << bits) - 1)
    for first, hashes, starts, ends, bounds in batch_words(data, offsets, MODEL):
        own = (_beginnings(data, starts, ends) & low).astype(np.int64) if len(starts) else starts
        for i in range(len(bounds) - 1):
            part = slice(bounds[i], bounds[i + 1])
            pairs = grams(hashes[part], 2)
            yield first + i, (pairs & low).astype(np.int64), own[part], int(bounds[i + 1] - bounds[i])


def labelled_sample(labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """(doc_id, good, train) of at most about ``rows`` labelled documents, chosen by hash.

    good: quality 1 and not toxic. Of repeated ids the worst label counts; rows with a null id or
    without both labels are left out.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("q"), (F.max("toxic") == 0).alias("t"))
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(uniform(F.col("doc_id"), seed) < share)
    return picked.select("doc_id", (F.col("q") & F.col("t")).alias("good"), (uniform(F.col("doc_id"), seed + 1) * 10 < TRAIN_TENTHS).alias("train"))


def log_ratios(docs: DataFrame, good_ids: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """Two tables of log(target / raw), counted over all documents; good_ids: sorted target ids."""
    chosen = docs.sparkSession.sparkContext.broadcast(good_ids)
    size = 1 << bits

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        raw, target = total[: 2 * size], total[2 * size :]
        for batch in batches:
            good = _among(batch.column("doc_id"), chosen.value)
            kept: dict[bool, list[np.ndarray]] = {True: [], False: []}
            held = 0
            for row, pairs, own, n in _features(batch, bits):
                kept[bool(good[row])] += [pairs, own + size]
                held += n
                if held > 1 << 19:
                    for is_good, parts in kept.items():
                        _add(raw, target if is_good else None, parts)
                    kept, held = {True: [], False: []}, 0
            for is_good, parts in kept.items():
                _add(raw, target if is_good else None, parts)

    raw, target = count_all(docs.select(F.col("doc_id").cast("long"), "text"), fill, 4 * size).reshape(2, 2, size)
    chosen.destroy()
    n, m = raw.sum(axis=1, keepdims=True), target.sum(axis=1, keepdims=True)
    ratio = np.log((target + 1) / (m + size)) - np.log((raw + 1) / (n + size))
    expected = raw * (m / np.maximum(n, 1))
    return np.where(np.abs(target - expected) >= SIGNIFICANT * np.sqrt(expected + 1), ratio, 0.0)


def _among(ids: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which ids are among the known ones; null is not."""
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), known) & ids.is_valid().to_numpy(zero_copy_only=False)


def _add(raw: np.ndarray, target: np.ndarray | None, parts: list[np.ndarray]) -> None:
    if parts:
        counts = np.bincount(np.concatenate(parts), minlength=len(raw))
        raw += counts
        if target is not None:
            target += counts


def _weights(batch: pa.RecordBatch, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and log weight of each text; 0 for one without words."""
    words, weights = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
    for row, pairs, own, n in _features(batch, ratios.shape[1].bit_length() - 1):
        words[row] = n
        if n:
            weights[row] = ratios[0][pairs].mean() + ratios[1][own].mean()
    return words, weights


def _noise(seed: int) -> Column:
    """Gumbel noise of a document's id."""
    return -F.log(-F.log(uniform(F.col("doc_id"), seed)))


def _keys(batch: pa.RecordBatch, ratios: np.ndarray, noise: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, log weight and Gumbel key of each text."""
    words, weights = _weights(batch, ratios)
    return words, weights, weights / TEMPERATURE + noise.to_numpy(zero_copy_only=False)


def score(docs: DataFrame, ratios: np.ndarray, seed: int = 13, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, log_weight and gumbel_key of every document, or of those with an id in the sorted ``only``."""
    known = docs.sparkSession.sparkContext.broadcast((ratios, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, only = known.value
        for batch in batches:
            if only is not None:
                batch = batch.filter(pa.array(_among(batch.column("doc_id"), only)))
            words, weights, keys = _keys(batch, ratios, batch.column("noise"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(weights), pa.array(keys)], names=["doc_id", "n_words", "log_weight", "gumbel_key"])

    return docs.select(F.col("doc_id").cast("long"), "text", _noise(seed).alias("noise")).mapInArrow(run, "doc_id long, n_words long, log_weight double, gumbel_key double")


def kth_key(scored: DataFrame, k: int, key: str = "gumbel_key") -> float:
    """The k-th largest key; minus infinity if there are no more than k rows.

    Histograms of 4,096 cells narrow the range down until its cell holds few rows, so no task
    sorts the table and the driver receives 4,096 counts at most.
    """
    inside = scored
    while True:
        low, high, n = inside.agg(F.min(key), F.max(key), F.count(key)).first()
        if n <= k and inside is scored:
            return float("-inf")
        if low == high:
            return low
        if n <= 10_000:
            return inside.orderBy(F.col(key).desc()).limit(k).agg(F.min(key)).first()[0]
        cell = F.least(F.floor((F.col(key) - low) / ((high - low) / 4096)), F.lit(4095))
        counts = dict(inside.groupBy(cell.alias("c")).count().collect())
        for c in sorted(counts, reverse=True):
            if k <= counts[c]:
                break
            k -= counts[c]
        inside = inside.where(cell == c)


def gumbel_top(scored: DataFrame, k: int, key: str = "gumbel_key") -> DataFrame:
    """The k rows of largest key and all that tie with the last of them."""
    return scored.where(F.col(key) >= kth_key(scored, k, key)) if k > 0 else scored.limit(0)


@dataclass(frozen=True)
class Model:
    """Log ratios of the two feature tables, the calibrated log weight and the seed of the noise.

    As many documents are taken as weigh at least the threshold.
    """

    ratios: np.ndarray
    threshold: float
    seed: int = 13


def fit(docs: DataFrame, labels: DataFrame, clean_loss: float = 0.01, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """Count both models over ``docs`` and set the threshold.

    The target model is counted over the good rows of a bounded labelled sample, the raw model over
    all documents. The threshold is the ``clean_loss`` quantile of the log weights of good rows
    held out from the target model, 0 at most; without such rows nothing is rejected.
    """
    sample = labelled_sample(labels, sample_rows, seed).toPandas()  # bounded by sample_rows
    trained = np.sort(sample.loc[sample["good"] & sample["train"], "doc_id"].to_numpy(dtype=np.int64))
    held = np.sort(sample.loc[sample["good"] & ~sample["train"], "doc_id"].to_numpy(dtype=np.int64))
    if not len(trained) or not len(held):
        return Model(np.zeros((2, 1 << BUCKET_BITS)), float("-inf"), seed + 2)
    ratios = log_ratios(docs, trained)
    found = score(docs, ratios, only=held).where("n_words > 0").agg(F.percentile_approx("log_weight", clean_loss, 100_000)).first()[0]
    return Model(ratios, float("-inf") if found is None else min(found, 0.0), seed + 2)


def _sampled(docs: DataFrame, model: Model, share: float) -> tuple[DataFrame, int]:
    """The scores of all documents, written, and how many of them are taken."""
    scored = materialize(score(docs, model.ratios, model.seed), "scores")
    return scored, round(share * scored.where(F.col("log_weight") >= model.threshold).count())


def accepted(docs: DataFrame, model: Model, share: float = 1.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, that importance_resample takes for this model.

    The cut is found on the scores alone; a second pass over the texts keeps what is above it, so
    no text is shuffled.
    """
    scored, k = _sampled(docs.select("doc_id", "text"), model, share)
    known = docs.sparkSession.sparkContext.broadcast((model.ratios, kth_key(scored, k) if k else float("inf")))
    noise = free_name(docs, "_noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, cut = known.value
        for batch in batches:
            *_, keys = _keys(batch, ratios, batch.column(noise))
            yield batch.filter(pa.array(keys >= cut)).drop_columns([noise])

    return docs.withColumn(noise, _noise(model.seed)).mapInArrow(run, docs.schema)


def importance_resample(docs: DataFrame, labels: DataFrame, share: float = 1.0, clean_loss: float = 0.01, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """doc_id, n_words, log_weight and gumbel_key of the documents that are taken.

    The k documents of largest key log_weight / TEMPERATURE + Gumbel noise are a sample without
    replacement in proportion to the weights; k is ``share`` times the number of documents whose
    log weight is at least the model's threshold. A null or empty text has log weight 0 and counts
    as any other; repeated doc_ids get the same noise and are judged row by row, so do null ones; a
    null doc_id never counts as labelled. Other columns are ignored; an empty table gives no rows.
    All rows that tie at the cut are taken.
    """
    scored, k = _sampled(docs, fit(docs, labels, clean_loss, sample_rows, seed), share)
    return gumbel_top(scored, k)
