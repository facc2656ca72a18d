"""Language spans, token alignment and the Merkle manifest against brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from imgaudit.llm import language_id, merkle, queries, token_alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
RNG = random.Random(5)
ODD = "end int, tree string, name string, pos long, row long, pairs string, spans string, letters string, part int"
ODD_ROW = (1, "t", "n", 7, 7, "p", "s", "l", 3)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(t):
    return None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- manifest


def brute_manifest(rows):
    def leaf(r, text):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                low = a - a % 16
                proofs[k].append((nodes[low:a], nodes[a + 1 : low + 16]))
                at[k] = a // 16
            nodes = [H(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        return nodes[0], proofs

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    leaves = [sorted(by[x], key=lambda y: y[:3]) for x in sources]
    trees = [tree([y[2] for y in own]) for own in leaves]
    root, upper = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for own, (subroot, proofs), above in zip(leaves, trees, upper, strict=True):
        for (_, _, digest, r), proof in zip(own, proofs, strict=True):
            path = proof + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, lower(r[4])) if tampered else digest
            for before, after in path:
                folded = H(*before, folded, *after)
            out.append((r[0], digest, subroot, root, H(*(x for a, b in path for x in a + b)), folded, folded == root))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_of_odd_rows(spark):
    # a hot source of 667 rows (three blocks), repeated rows and ids, null sources, ids and texts, one source of a single row
    sources = ["s", "é", None, "", "z"]
    rows = [(i % 700 if i % 11 else None, sources[i % 4] if i % 3 else "hot", None if i % 5 else "en", i % 50, ["Ab", None, "", "ÀBC x"][i % 4]) for i in range(2000)]
    rows += [(1, "z", "en", 2, "Alone"), rows[0], rows[0], rows[7]]
    docs = spark.createDataFrame([(*r, *ODD_ROW) for r in rows], f"doc_id long, source string, lang string, n_chars long, text string, {ODD}")
    assert tuples(merkle.manifest(docs)) == brute_manifest(rows)
    assert merkle.manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert tuples(merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == brute_manifest(rows)


def test_manifest_sql_of_tampered_rows():
    # the SQL marks the same ids as tampered and finds the same roots
    rows = [(i, "s" if i % 3 else None, "en", 1, f"Text {i}") for i in range(300)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(queries.ORACLES["op13_merkle_manifest"]).fetchall(), key=repr) == brute_manifest(rows)


def test_appended_witnesses_fold_to_the_root():
    for n in (1, 5, 16, 100, 256):
        nodes = [merkle.Node(H(str(k))) for k in range(n)]
        tree = merkle.Appender()
        for node in nodes:
            tree.append(node)
        root = tree.close(None)
        assert all(merkle.fold(x.digest, x.path()) == root.digest for x in nodes)
        assert n == 1 or merkle.fold(H("other"), nodes[0].path()) != root.digest


# --- alignment


def brute_alignment(rows):
    pair = token_alignment.Pair(*PATHS)

    def spans(ids, by):
        at, out = 0, []
        for k in ids:
            out.append((at, at + len(by[k]), k))
            at += len(by[k])
        return out

    docs = []
    for doc_id, text in rows:
        ids = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        by = pair.bytes_a, pair.bytes_b
        if not text or any(b"".join(y[k] for k in x) != (" " + text).encode() for x, y in zip(ids, by, strict=True)):
            docs.append((doc_id, None))
            continue
        a, b = (spans(x, y) for x, y in zip(ids, by, strict=True))
        cuts = {e for _, e, _ in a} & {e for _, e, _ in b}
        sides = [[[]] for _ in "ab"]
        for own, groups in zip((a, b), sides, strict=True):
            for _, end, k in own:
                groups[-1].append(str(k))
                if end in cuts:
                    groups.append([])
        text_of = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*(s[:-1] for s in sides), strict=True))
        links, j = [], 0
        for start, end, k in a:
            while b[j][1] <= start:
                j += 1
            i = j
            while i < len(b) and b[i][0] < end:
                links.append((k, b[i][2]))
                i += 1
        docs.append((doc_id, (len(a), len(b), len(cuts), links, H(text_of))))
    counts = Counter(p for _, x in docs if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for d, x in docs]
    return sorted(out, key=repr)


PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "ß", "▁", "<0x41>", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "'s", "1", "23", "-!", "🙂", "가", "İ", "é", "\x00", "</s>", "<unk>", "."]
TEXTS = [(i, "".join(RNG.choice(PARTS) for _ in range(RNG.randint(0, 25)))) for i in range(300)]
TEXTS += [(1, None), (None, ""), (None, "hello world"), (None, "hello world"), (7, "x" * 3000), (8, "word other, " * 3000), (9, " "), (10, "   "), (11, "a ")]


@pytest.mark.parametrize("lookup", [10**6, 40, 0])
def test_alignment_of_odd_texts(spark, lookup):
    docs = spark.createDataFrame([(*r, *ODD_ROW) for r in TEXTS], f"doc_id long, text string, {ODD}").repartition(3)
    assert tuples(token_alignment.token_alignment(docs, *PATHS, lookup)) == brute_alignment(TEXTS)
    assert token_alignment.token_alignment(docs.limit(0), *PATHS, lookup).count() == 0


def test_long_text_is_aligned_in_parts():
    pair = token_alignment.Pair(*PATHS)
    segments = pair.segments("one two, three\nfour  five " * 50)
    whole, parts = token_alignment._Document(), token_alignment._Document()
    whole.add(token_alignment.Block(pair, [segments]), 0)
    for k in range(0, len(segments), 7):
        parts.add(token_alignment.Block(pair, [segments[k : k + 7]]), 0)
    a, b = whole.row(), parts.row()
    assert a[:5] == b[:5]
    assert [x.to_pylist() for x in a[5:]] == [x.to_pylist() for x in b[5:]]


def test_segments_make_up_the_text():
    pair = token_alignment.Pair(*PATHS)
    assert pair.apart
    for _, text in TEXTS:
        if text:
            assert "".join(pair.segments(text)) == " " + text


# --- languages


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 2, 6, 1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.integers(-3, 4, (bounds[-1], 3)).astype(float)
    path = language_id.viterbi(scores, bounds, 2.0)

    def value(way, part):
        return sum(part[k, s] for k, s in enumerate(way)) - 2.0 * sum(x != y for x, y in zip(way, way[1:], strict=False))

    for k in range(len(sizes)):
        part = scores[bounds[k] : bounds[k + 1]]
        ways = [[]]
        for _ in range(len(part)):
            ways = [[*w, s] for w in ways for s in range(3)]
        assert value(list(path[bounds[k] : bounds[k + 1]]), part) == max(value(w, part) for w in ways)


SENTENCES = {
    "en": "the house of the people was not there when they came with their children and the weather",
    "de": "das haus der leute war nicht dort als sie mit ihren kindern und dem wetter kamen für übung",
    "ru": "дом этих людей не был там когда они пришли со своими детьми и хорошей погодой",
    "bg": "къщата на тези хора не беше там когато те дойдоха със своите деца и хубавото време",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, " ".join(RNG.sample(t.split(), 8)), lang) for k in range(60) for lang, t in SENTENCES.items()]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts(spark, model):
    en, de, ru = SENTENCES["en"], SENTENCES["de"], SENTENCES["ru"]
    texts = [f"{en}. {de}", f"🙂 {en}, {ru} {de}", en.upper(), None, "", "12 34 !?", "İ" + en, "日本語", "the " * 60000 + de, "z" * 700_000]
    docs = spark.createDataFrame([(k, t, *ODD_ROW) for k, t in enumerate(texts)], f"doc_id long, text string, {ODD}")
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}

    def spans(k):
        return [(s["lang"], texts[k][s["start"] : s["end"]]) for s in got[k]["spans"]]

    assert spans(0) == [("en", en), ("de", de)]
    assert spans(1) == [("en", f"🙂 {en}"), ("ru", ru), ("de", de)]  # what is beyond ASCII counts as a word
    assert spans(2) == [("en", en.upper())]
    # the text's language is that of most letters: of code points, not of bytes
    assert len(de) > len(en) > len(ru) and len(ru.encode()) > len(de.encode())
    assert [got[k]["lang_pred"] for k in range(7)] == ["de", "de", "en", "und", "und", "und", "en"]
    assert all(got[k]["score"] == 0 and got[k]["spans"] == [] for k in (3, 4, 5))
    assert spans(8)[-1] == ("de", de)
    assert got[7]["lang_pred"] in SENTENCES  # a letter of a script of no language
    assert len(spans(9)) == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_scripts_narrow_languages(spark, model):
    assert model.languages == ["bg", "de", "en", "ru"]
    assert model.scripts[1].tolist() == [False, True, True, False]
    assert model.scripts[3].tolist() == [True, False, False, True]
    assert model.scripts[27].all()


def test_language_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    nothing = spark.createDataFrame([], schema)
    assert language_id.predicted(nothing).count() == 0
    unknown = spark.createDataFrame([(None, "hello", "en"), (2, "hello", None), (2, "hello", None)], schema)
    assert tuples(language_id.predicted(unknown).select("doc_id", "held_out", "lang_pred", "score")) == sorted([(None, False, "und", 0.0), *[(2, zlib.crc32(b"2") % 4 == 2, "und", 0.0)] * 2], key=repr)
    one = language_id.predicted(spark.createDataFrame([(k, "hello there", "en") for k in range(9)], schema))
    assert {r["lang_pred"] for r in one.collect()} == {"en"}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op11_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    # languages of held-out rows are never an input
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert tuples(language_id.predicted(other)) == tuples(language_id.predicted(docs))
