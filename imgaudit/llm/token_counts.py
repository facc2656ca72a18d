"""Token counts of whole texts with a whole-token shortcut.

A pre-token that the vocabulary holds as a whole and that the tokenizer leaves whole costs one
token, wherever it stands. Which vocabulary strings are of that kind is proved once, on the driver,
by encoding each of them alone. In the tasks, texts fall apart at white space, which no pre-token
crosses; pre-tokens among the proved strings count one, only the rest go through the merges, and
what a white-space-separated piece costs is remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pieces whose cost a worker remembers at most (some 100 bytes each).
REMEMBERED = 1_000_000
#: Pieces longer than this are not remembered.
LONG_PIECE = 64
#: Characters that str.split() takes for white space and the tokenizer does not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of characters that are composed already and that every Unicode version treats alike.
_SIMPLE = regex.compile(r"[\x00-\u02ff\u2010-\u2027]*").fullmatch
#: Bytes that are spelled by characters of their own: those that are no printable Latin-1 character.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Pre-tokens, as the pre-tokenizer spells them, that are proved to encode alone as one token."""
    suffix = tokenizer.model.end_of_word_suffix or ""
    proved = set()
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith(suffix):
            spelled = token[: len(token) - len(suffix)]
            if spelled and len(tokenizer.model.tokenize(spelled)) == 1:
                proved.add(spelled)
    return frozenset(proved)


def _simple_pattern(tokenizer: Tokenizer) -> regex.Pattern | None:
    """The splitting pattern of a tokenizer that composes, lower-cases and splits by one pattern; else None."""
    config = json.loads(tokenizer.to_str())
    normal, before = config["normalizer"] or {}, config["pre_tokenizer"] or {}
    steps = [x["type"] for x in normal.get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    if sorted(steps) != ["Lowercase", "NFC", "Replace"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    split, spell = parts
    if not (split["behavior"] == "Removed" and split["invert"]) or spell["add_prefix_space"] or spell["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"])


class TokenCounter:
    """Counts tokens as the tokenizer's ``encode`` gives them without added special tokens."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str]) -> None:
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merge = tokenizer.model.tokenize
        self.whole = whole
        self.special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.pattern = _simple_pattern(tokenizer)

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a piece without white space, spelled by bytes.

        Where neither composition nor a newer Unicode table can matter, lower-casing and the
        tokenizer's own pattern do what the library's slower calls would.
        """
        if self.pattern is None or not (text.isascii() or _SIMPLE(text)):
            return [spelled for spelled, _ in self.split(self.normalize(text))]
        found = self.pattern.findall(text.lower())
        return [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(_SPELLING) for x in found]

    def piece(self, text: str) -> int:
        """Tokens of a piece without white space."""
        n = 0
        for spelled in self.pre_tokens(text):
            if spelled in self.whole:
                n += 1
                continue
            cost = self.merged.get(spelled)
            if cost is None:
                cost = len(self.merge(spelled))
                if len(spelled) <= LONG_PIECE:
                    if len(self.merged) >= REMEMBERED:
                        self.merged.clear()
                    self.merged[spelled] = cost
            n += cost
        if len(text) <= LONG_PIECE:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        pieces = text.split() if not any(c in text for c in _NOT_SPACE) else text.translate(dict.fromkeys(map(ord, _SPACE), " ")).split(" ")
        known, n, unknown = self.known.get, 0, []
        for piece in pieces:
            cost = known(piece)
            if cost is None:
                unknown.append(piece)
            else:
                n += cost
        return n + sum(map(self.piece, unknown))

    def count(self, text: str) -> int:
        """Tokens of a text; a special string in it is one token and parts what stands around it."""
        for special in self.special:
            if special in text:
                parts = text.split(special)
                return len(parts) - 1 + sum(map(self.count, parts))
        return self.plain(text)


@cache
def _counter(path: str, whole: frozenset[str]) -> TokenCounter:
    """One counter for each worker process; what it remembers serves all its tasks."""
    return TokenCounter(Tokenizer.from_file(path), whole)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    ``tokenizer_path`` is a BPE tokenizer file that every executor has, with special strings taken
    as written. A null text counts as the empty one: 0 bytes, 0 tokens. Repeated and null doc_ids
    keep their rows; other columns are ignored; an empty table gives no rows.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(Tokenizer.from_file(tokenizer_path)))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, whole.value)
        for batch in batches:
            counts = [counter.count(text.as_py() or "") for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
