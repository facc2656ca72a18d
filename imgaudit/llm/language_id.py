"""Languages of mixed texts: script ranges, word scores and Viterbi over the words.

Counted over all labelled texts are, for each language, byte trigrams inside words (with word ends),
whole words and letters by script, in hashed tables. A word's score in a language is the log ratio
of the smoothed language model to the mean of all languages. The script of a word narrows down which languages
it may have. Viterbi over a text's words with a penalty for each switch labels spans; the
language of most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counters import count_all
from .words import BLOCK, LOWER, batch_words, byte_classes, mix, text_bytes

#: Buckets of the trigram table and of the word table of a language: 2**16 each.
BITS = 16
#: Weight of the mean over all languages in a language's model: unseen features tell nothing.
BACKGROUND = 0.05
#: Log units that a switch of language costs: some three words' evidence.
SWITCH = 14.0
#: A language may have words of a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Score of a word in a language that its script excludes.
EXCLUDED = -1e5
#: More distinct values than this are no languages: an error.
MOST_LANGUAGES = 1024
#: Scores of words and languages that a task holds at a time.
SCORES = 1 << 22

#: First code point of each range of a script; 0 is no letter of a script.
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x00AB, 0), (0x00B5, 2), (0x00B6, 0), (0x00BA, 1), (0x00BB, 0), (0x00C0, 1), (0x00D7, 0), (0x00D8, 1), (0x00F7, 0), (0x00F8, 1),
    (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14),
    (0x0D00, 15), (0x0D80, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0), (0x1C80, 3), (0x1C90, 21),
    (0x1CC0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3041, 26), (0x3100, 27), (0x3130, 22), (0x3190, 0), (0x31F0, 26), (0x3200, 0), (0x3400, 27), (0x4DC0, 0),
    (0x4E00, 27), (0xA000, 0), (0xA640, 3), (0xA6A0, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 1), (0xFB13, 4), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0),
    (0xFF21, 1), (0xFF3B, 0), (0xFF41, 1), (0xFF5B, 0), (0xFF66, 26), (0xFFA0, 22), (0xFFE0, 0), (0x20000, 27), (0x32000, 0),
]
_FIRST, _SCRIPT = (np.array(x, dtype=np.int64) for x in zip(*SCRIPTS, strict=True))
N_SCRIPTS = 32

#: Runs of ASCII letters and of characters beyond ASCII.
_LETTERS = byte_classes("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
_LONG = np.int64


def held_out() -> Column:
    """Whether a document is kept from training: the checksum of its id modulo 4 is 2; not for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _folded() -> Column:
    """The text in lower case where that keeps its code points in place, else as it is."""
    lower = F.lower("text")
    return F.when(F.length(lower) == F.length("text"), lower).otherwise(F.col("text"))


def _scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word's first character."""
    b = [np.where(starts + k < ends, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.int64) for k in range(4)]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F],
        (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F,
    )
    return _SCRIPT[np.searchsorted(_FIRST, point, side="right") - 1]


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(words, offsets, buckets): for words of some BLOCK bytes at a time, the bucket of each byte and its neighbours.

    A word longer than a block comes in parts; its neighbours at word ends are 0.
    """
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        at, stop = int(starts[first]), int(ends[last - 1])
        for low in range(at, stop, 2 * BLOCK):
            high = min(low + 2 * BLOCK, stop)
            piece = LOWER[data[max(0, low - 1) : high + 1]].astype(np.uint64)
            piece = np.pad(piece, (int(low == 0), int(high + 1 > len(data))))
            s, e = starts[first:last], ends[first:last]
            s, e = np.clip(s, low, high) - low, np.clip(e, low, high) - low
            before, own, after = piece[:-2].copy(), piece[1:-1], piece[2:].copy()
            if low == at:
                before[s] = 0
            if high == stop:
                after[e - 1] = 0
            inside = np.zeros(high - low + 1, dtype=np.int8)
            np.add.at(inside, s, 1)
            np.add.at(inside, e, -1)
            mask = np.cumsum(inside[:-1]) > 0
            code = (before << np.uint64(16) | own << np.uint64(8) | after)[mask]
            yield slice(first, last), np.concatenate(([0], np.cumsum(e - s))), (mix(code) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        first = last


@dataclass(frozen=True)
class Model:
    """Languages in order, log ratios of trigram and word buckets (bucket x language), languages of each script."""

    languages: list[str]
    trigrams: np.ndarray
    words: np.ndarray
    scripts: np.ndarray


def _log_ratios(counts: np.ndarray) -> np.ndarray:
    """log(language / background) by (bucket, language); background is the mean of the languages."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    mean = share.mean(axis=0) + 1e-12
    return np.log((1 - BACKGROUND) * share / mean + BACKGROUND).T.astype(np.float32)


def fit(docs: DataFrame) -> Model:
    """Count the models over all rows of ``docs(text, lang)``; rows without lang or text say nothing."""
    known = docs.where("lang is not null").select("lang", _folded().alias("text"))
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not languages:
        return Model([], *(np.zeros((1 << BITS, 0), dtype=np.float32),) * 2, np.zeros((N_SCRIPTS, 0), dtype=bool))
    size, number = 1 << BITS, {x: k for k, x in enumerate(languages)}
    each = 2 * size + (1 << 10)  # trigrams, words, scripts

    def fill(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        tables = total.reshape(len(languages), each)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, hashes, starts, ends, bounds in batch_words(data, offsets, _LETTERS):
                own = np.repeat(of[first : first + len(bounds) - 1], np.diff(bounds))
                for k in np.unique(own):
                    mine = own == k
                    tables[k, size : 2 * size] += np.bincount((hashes[mine] & np.uint64(size - 1)).astype(np.int64), minlength=size)
                    tables[k, 2 * size : 2 * size + N_SCRIPTS] += np.bincount(_scripts(data, starts[mine], ends[mine]), weights=(ends - starts)[mine], minlength=N_SCRIPTS).astype(np.int64)
                for words, cuts, buckets in _trigrams(data, starts, ends):
                    lang = np.repeat(own[words], np.diff(cuts))
                    for k in np.unique(lang):
                        tables[k, :size] += np.bincount(buckets[lang == k], minlength=size)

    counts = count_all(known, fill, len(languages) * each).reshape(len(languages), each)
    letters = counts[:, 2 * size + 1 : 2 * size + N_SCRIPTS].astype(float)
    may = np.ones((N_SCRIPTS, len(languages)), dtype=bool)
    may[1:] = (letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)).T
    may[~may.any(axis=1)] = True  # a script of no language excludes none
    return Model(languages, _log_ratios(counts[:, :size]), _log_ratios(counts[:, size : 2 * size]), may)


def word_scores(model: Model, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of words by (word, language)."""
    scores = model.words[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)]
    for words, cuts, buckets in _trigrams(data, starts, ends):
        full = np.flatnonzero(np.diff(cuts))
        if len(full):
            scores[np.arange(words.start, words.stop)[full]] += np.add.reduceat(model.trigrams[buckets], cuts[full], axis=0)
    return np.where(model.scripts[_scripts(data, starts, ends)], scores, np.float32(EXCLUDED))


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: the largest sum of scores less ``switch`` for each change; ties go to the first.

    ``bounds`` cuts the words into texts. All texts go step by step together, longest first, so a
    step costs a few array operations over those that still have words.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) and sizes[0] else np.zeros(0, dtype=int)
    came = np.zeros(scores.shape, dtype=bool)  # whether a word's best way to a language is from another
    best = np.zeros(len(scores), dtype=np.int16)  # the best language before a word
    value = np.zeros((len(sizes), scores.shape[1]), dtype=np.float64)
    for t, n in enumerate(active):
        at, v = starts[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            changed = (v[np.arange(n), top] - switch)[:, None]
            came[at] = changed > v
            best[at] = top
            np.maximum(v, changed, out=v)
        v += scores[at]
    path = np.zeros(len(scores), dtype=np.int16)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        own = state[:n]
        path[at] = own
        state[:n] = np.where(came[at, own], best[at], own)
    return path


_SPANS = "array<struct<start: int, end: int, lang: string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _labelled(model: Model, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, score) of each text with words, and (first, last) word of each span."""
    path = viterbi(scores, bounds)
    n, k = len(bounds) - 1, len(model.languages)
    text = np.repeat(np.arange(n), np.diff(bounds))
    letters = np.bincount(text * k + path, weights=ends - starts, minlength=n * k).reshape(n, k)
    chosen = letters.argmax(axis=1)
    mine = path == chosen[text]
    sums = np.stack([np.bincount(text[mine], weights=scores[mine, j], minlength=n) for j in range(k)], axis=1).astype(float)
    own = sums[np.arange(n), chosen]
    sums[np.arange(n), chosen] = -np.inf
    margin = np.clip(own - sums.max(axis=1), -50, 50) if k > 1 else np.full(n, 50.0)
    share = letters[np.arange(n), chosen] / np.maximum(letters.sum(axis=1), 1)
    cut = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])))) if len(path) else np.zeros(0, dtype=int)
    return chosen, share / (1 + np.exp(-margin)), cut, path


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (start and end in code points, language) of every row of ``docs``.

    lang_pred is the language that holds most of the text's letters, ``und`` for a null text, one
    without a letter, or if no language is known; score is that share times the logistic margin of
    the language over the next on its own words, 0 for ``und``. Spans are runs of words of one
    language. Repeated and null doc_ids keep their rows (null ones are not held out); other columns
    are ignored; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 numbers a language, MOST_LANGUAGES at most
    names = ["doc_id", "held_out", "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            pred, score = np.full(batch.num_rows, -1, dtype=np.int64), np.zeros(batch.num_rows)
            cuts: list[tuple] = [(np.zeros(0, dtype=np.int64),) * 4]  # row, start, end and language of each span
            held: list[tuple] = []

            def label() -> None:
                if not held:
                    return
                rows, scores, starts, ends, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                chosen, sure, cut, path = _labelled(model, scores, starts, ends, bounds)
                own = letters[rows] & (sizes > 0)
                pred[rows[own]], score[rows[own]] = chosen[own], sure[own]
                if spans and len(cut):
                    text = np.repeat(rows, sizes)
                    cuts.append((text[cut], starts[cut], ends[np.concatenate((cut[1:], [len(path)])) - 1], path[cut].astype(np.int64)))

            if model.languages:
                size = 0
                for first, hashes, starts, ends, bounds in batch_words(data, offsets, _LETTERS):
                    # places of words are counted in code points of their text from here on
                    at, last = int(offsets[first]), first + len(bounds) - 1
                    points = np.concatenate(([0], np.cumsum((data[at : int(offsets[last])] & 0xC0) != 0x80, dtype=np.int32)))
                    zero = np.repeat(points[offsets[first:last] - at], np.diff(bounds))
                    scores = word_scores(model, data, hashes, starts, ends)
                    held.append((np.arange(first, last), scores, points[starts - at] - zero, points[ends - at] - zero, np.diff(bounds)))
                    size += len(starts)
                    if size * len(model.languages) >= SCORES:
                        label()
                        size = 0
                label()
            row, start, end, lang = (np.concatenate(x) for x in zip(*cuts, strict=True))
            keep = letters[row]
            row, start, end, lang = row[keep], start[keep], end[keep], lang[keep]
            place = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))).astype(np.int32)
            languages = pa.array([*model.languages, "und"])
            struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (start, end)] + [languages.take(pa.array(lang))], names=["start", "end", "lang"])
            named = languages.take(pa.array(np.where(pred < 0, len(model.languages), pred)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), named, pa.array(score), pa.ListArray.from_arrays(pa.array(place), struct)], names=names)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), _folded().alias("text"))
    return ready.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double, spans {_SPANS}")


def predicted(docs: DataFrame) -> DataFrame:
    """``identify`` with models counted over the labelled rows of ``docs`` that are not held out."""
    return identify(docs, fit(docs.where(~held_out() & F.col("doc_id").isNotNull())))
