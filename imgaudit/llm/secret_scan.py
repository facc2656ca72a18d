"""Secret scans, in DataFrame and SQL functions only.

Three patterns give the base spans. Beside them, long tokens are judged by two character Markov
models: one of random strings, one of ordinary identifiers. A token whose log-likelihood ratio
speaks for chance is a span of kind model. Both models are trained on labelled samples: random
strings drawn in the alphabets that keys are written in (labelled by how they were made, of a fixed
number), and ordinary tokens of all documents, plain and put together as identifiers are (words and
numbers outside base spans; what mixes letters and digits carries no label and trains nothing).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Shortest value of an assignment.
VALUE = 6
#: Tokens that the models judge, and tokens that train them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z+/_=-]{6,}|[0-9]{6,})(?![A-Za-z0-9+/_=-])"
KINDS = ("assign", "access", "hex", "model")
#: Random strings of each alphabet that train the model of random strings.
RANDOM_STRINGS = 20_000
#: A token is random if its ratio is at least this in all and for each pair of characters.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.6
#: Characters a token can have, for the uniform part of the random model.
ALPHABET = 67

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, accept: Column | None = None, group: int | None = None) -> Column:
    """Spans (start, kind, end) of all matches; of those only where the group has VALUE characters.

    Splitting by the pattern gives the gaps, extracting gives the matches; their lengths in code
    points add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group or 0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("found"), value.alias("value"))
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        if accept is not None:
            keep = accept(x["found"])
        else:
            keep = F.length(x["value"]) >= VALUE if group else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    all_ = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), all_).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """The spans of the three patterns."""
    return [_spans(text, ASSIGN, 0, group=2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]


def _pairs(tokens: DataFrame) -> DataFrame:
    """(random, pair, n): pairs of following characters, as one number below 2**14."""
    codes = F.transform(F.sequence(F.lit(2), F.length("token")), lambda i: F.ascii(F.substring(F.col("token"), i - 1, F.lit(1))) * 128 + F.ascii(F.substring(F.col("token"), i, F.lit(1))))
    return tokens.where("length(token) > 1").select("random", F.explode(codes).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """(token): n strings each of small and capital hex digits, capitals and digits, letters and digits, base 64."""
    digest = F.sha2(F.concat(F.lit("secret-"), F.col("id").cast("string")), 512)
    code = F.base64(F.unhex(digest))
    kinds = [digest, F.upper(digest), F.regexp_replace(code, "[^A-Z0-9]", ""), F.regexp_replace(code, "[^A-Za-z0-9]", ""), F.translate(code, "+/=\n\r", "-_")]
    return spark.range(n).select(F.explode(F.array(*[F.substring(k, 1, 40) for k in kinds])).alias("token"))


def ordinary_tokens(docs: DataFrame) -> DataFrame:
    """(token): words and numbers of ``docs(text)`` outside base spans, a half of them as identifiers.

    By its hash, a word stays as it is, gets a capital or all capitals, or is put together with the
    next one in one of three ways.
    """
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    found = docs.select(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0)).alias("words"))

    def made(word: Column, i: Column) -> Column:
        next_ = F.coalesce(F.try_element_at("words", i + 2), word)
        turn = F.pmod(F.xxhash64(word), F.lit(10))
        ways = [F.initcap(word), F.upper(word), F.concat_ws("_", word, next_), F.concat(word, F.initcap(next_)), F.concat_ws("-", word, F.length(next_).cast("string"))]
        out = word
        for k, way in enumerate(ways):
            out = F.when(turn == k, way).otherwise(out)
        return out

    return found.select(F.explode(F.transform("words", made)).alias("token"))


def train(docs: DataFrame, strings: int = RANDOM_STRINGS) -> list[float]:
    """Log-likelihood ratio random / ordinary of each pair of ASCII characters, 2**14 numbers.

    A tenth of the random model is uniform over the alphabet. The driver receives at most 2**15 counts.
    """
    labelled = random_strings(docs.sparkSession, strings).select(F.lit(True).alias("random"), "token").union(ordinary_tokens(docs).select(F.lit(False), "token"))
    counts = {(r["random"], r["pair"]): r["n"] for r in _pairs(labelled).collect()}
    rows: dict[tuple[bool, int], int] = {}
    for (random, pair), n in counts.items():
        rows[random, pair >> 7] = rows.get((random, pair >> 7), 0) + n
    ratios = []
    for pair in range(1 << 14):
        chance = 0.1 / ALPHABET + 0.9 * (counts.get((True, pair), 0) + 1 / ALPHABET) / (rows.get((True, pair >> 7), 0) + 1)
        usual = (counts.get((False, pair), 0) + 0.2) / (rows.get((False, pair >> 7), 0) + 0.2 * ALPHABET)
        ratios.append(round(math.log(chance / usual), 4))
    return ratios


def secret_spans(docs: DataFrame, strings: int = RANDOM_STRINGS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind in the order of
    KINDS, joined by commas. Base spans are all there are of the three patterns; model spans are
    added where no base span overlaps. A null text counts as the empty one; repeated and null
    doc_ids keep their rows; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    table = ",".join(map(str, train(docs, strings)))
    ratios = F.split(F.lit(table), ",").cast("array<double>")  # folded to one constant

    def is_random(token: Column) -> Column:
        steps = F.sequence(F.lit(2), F.length(token))
        total = F.aggregate(
            steps,
            F.lit(0.0),
            lambda acc, i: acc + F.element_at(ratios, F.ascii(F.substring(token, i - 1, F.lit(1))) * 128 + F.ascii(F.substring(token, i, F.lit(1))) + 1),
        )
        return (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * F.length(token))

    base = docs.select("doc_id", "text", *[c.alias(k) for k, c in zip(KINDS, base_spans(F.col("text")), strict=False)])
    base = base.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    added = _spans(F.col("text"), CANDIDATE, 3, accept=is_random)
    scored = base.withColumn("model", added).withColumn("model", F.filter("model", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))

    def joined(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return scored.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "model"))).alias("spans"),
    )
