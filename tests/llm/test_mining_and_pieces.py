"""Hard negatives, collocations and sentence pieces: against brute force, the library, and on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fieldtrace.llm import collocations, hard_negatives, sentence_pieces
from pyspark.sql import functions as F

PIECES = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int, score string, node int"


# Hard negatives


def mined(rows, positives=5, negatives=5):
    """Loops over every anchor and row."""
    good = {(i, lab, tuple(int(np.floor(256.0 * x)) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, lab, v in good:
        if a % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, m == lab) for i, m, w in good if i != a and len(w) == len(v)]
        first = sorted(((-s, i) for s, i, same in scored if same))[:positives]
        for p, i in first:
            p = -p
            rest = sorted((-s, j) for s, j, same in scored if not same and 80 * p <= 100 * s <= 100 * p)[:negatives]
            out += [(a, i, k + 1, j, p, -s) for k, (s, j) in enumerate(rest)]
    return sorted(out)


def found(df, **more):
    rows = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def test_hard_negatives_equal_loops(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], r.choice([1, 2, 3])) for i in range(0, 1500, 5)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 7) for i in range(2000, 2060)]  # ties in score and vector
    rows += [(100, [1.0, 1.0, 0.0, 0.0], 2), (200, None, 1), (300, [None, 1.0, 1.0, 1.0], 1), (301, [float("nan")] * 4, 1), (302, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (400, [1.0] * 4, None)]
    rows += [rows[0], rows[7], (600, [1.0, 1.0], 1), (601, [1.0, 1.0], 1), (602, [0.9, 0.9], 2), (700, [], 1), (701, [], 2), (900, [-1.0, 0.0, 0.0, 0.0], 9), (901, [1.0, 0.0, 0.0, 0.0], 9)]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], VECTORS).repartition(3)
    want = mined(rows)
    assert len(want) > 100 and found(df) == want
    assert found(df, positives=2, negatives=1) == mined(rows, 2, 1)
    assert found(df.where("false")) == [] and found(df.where("label is null")) == []


def test_tiles_of_any_size_give_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], r.choice([1, 2])) for i in range(0, 2000, 4)]
    df = spark.createDataFrame([(i, [float(np.float32(x)) for x in v], lab, "x", 1) for i, v, lab in rows], VECTORS)
    want = mined([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    for name, value in (("BLOCK", 7), ("SHARE", 50), ("LEAST_SHARES", 3), ("CELLS", 1 << 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert found(df) == want


def test_products_are_exact_beyond_doubles():
    a = np.array([[1 << 27, 3], [1, 1]], np.int64)
    assert hard_negatives._products(a, a).tolist() == [[(1 << 54) + 9, (1 << 27) + 3], [(1 << 27) + 3, 2]]


# Collocations


def phrases(rows, longest=3, least=10, percent=50, top=2000):
    """Counts by loops in plain Python, whose whole numbers have no bound."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    often = {k: v for k, v in f.items() if v >= least}
    hidden = collections.defaultdict(int)
    for (lang, p), v in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                hidden[lang, p[i : i + size]] = max(hidden[lang, p[i : i + size]], v)
    for (lang, p), a in often.items():
        if len(p) < 2 or (hidden[lang, p] and 100 * hidden[lang, p] >= percent * a):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    place, rows = collections.Counter(), []
    for lang, score, a, p, left, right in out:
        place[lang] += 1
        if place[lang] <= top:
            rows.append((lang, place[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    vocabulary = ["alpha", "Beta", "GAMMA", "dé", "Éx", "漢字", "a.b", "x"]
    rows = [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ", ", "\n", "! ", "\x0b"]) for _ in range(r.randint(1, 60)))) for _ in range(400)]
    rows += [("en", "new york city") for _ in range(30)] + [("en", None), ("en", ""), ("fr", " . ,\n"), (None, "new york"), ("fr", "one two")]
    return [*rows, *rows[:20], ("en", " ".join(r.choice(vocabulary) for _ in range(3000)))]


def counted(df, **more):
    return sorted(tuple(r) for r in collocations.collocations(df, **more).collect())


def test_collocations_equal_loops(spark, texts, monkeypatch):
    df = spark.createDataFrame([(lang, t, 1, "p") for lang, t in texts], "lang string, text string, f int, phrase string").repartition(4)
    want = phrases(texts)
    assert len(want) > 50 and counted(df) == want
    assert counted(df, longest=4, least=3, percent=30, top=40) == phrases(texts, 4, 3, 30, 40)
    # Small blocks, summaries and filters lose nothing.
    monkeypatch.setattr(collocations, "GATHER", 500)
    monkeypatch.setattr(collocations, "PHRASES", 50)
    monkeypatch.setattr(collocations, "ROOM", 1)
    monkeypatch.setattr(collocations, "LEAST_PARTS", 2)
    assert counted(df) == want
    assert counted(df.where("false")) == [] and counted(df.where("text is null")) == []


def test_long_texts_come_in_stretches():
    r = random.Random(2)
    text = "".join(r.choice(["ab", "c", "Def"]) + r.choice([" ", "  ", ". ", "\t"]) for _ in range(3000)) + "x" * 5000 + " end"
    column = pa.array(["one two. three", "", None, text, "four five"])
    salt = np.arange(5, dtype=np.uint64)
    for size in (1, 2, 3):
        whole, cut = [], []
        for out, limit in ((whole, 1 << 20), (cut, 300)):
            for lo, w in collocations.stretches(column, 3, limit):
                out.append(w.grams(size, salt[lo:])[0])
        assert np.array_equal(np.sort(np.concatenate(whole)), np.sort(np.concatenate(cut)))


def test_summaries_keep_every_frequent_print(monkeypatch):
    r = np.random.default_rng(4)
    for room in (1, 4):
        monkeypatch.setattr(collocations, "ROOM", room)
        prints = np.concatenate([r.integers(0, 1 << 32, 30_000), np.repeat(r.integers(0, 1 << 32, 300), 10)]).astype(np.uint32)
        r.shuffle(prints)
        s = collocations.Summary(len(prints), 10)
        monkeypatch.setattr(s, "merge", s.merge)
        for part in np.array_split(prints, 60):
            s.add(*[x.astype(t) for x, t in zip(np.unique(part, return_counts=True), (np.uint32, np.uint32), strict=True)])
            s.merge()
            assert len(s.prints) <= s.room
        value, count = np.unique(prints, return_counts=True)
        assert s.lost < 10 / room and set(value[count >= 10]) <= set(s.survivors().tolist())


# Sentence pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


AWKWARD = ["", None, " ", "   ", "a", " a", "a ", "  a  b  ", "▁x▁▁y", "a▁ b", "tab\tnew\nline", "<s> </s> <unk> <0x41>", "é é 😀😀​", "ﬁ №", "\x00a", "漢字" * 50, "x" * 20_000, "ab " * 9000, "한국어 텍스트", "ﷺ" * 10]


def test_pieces_equal_the_library(spark, library):
    rows = [(i, t, "x", [1]) for i, t in enumerate(AWKWARD)] + [(3, "again", "x", [1]), (3, "again", "x", [1]), (None, "no id", "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    got = sentence_pieces.encoded(df, PIECES).collect()
    key = lambda i, ids, text: (i is None, i or 0, ids, text)
    want = [key(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _, _ in rows]
    assert sorted(key(r["doc_id"], list(r["ids"]), r["decoded"]) for r in got) == sorted(want)
    for r in sentence_pieces.digest(sentence_pieces.encoded(df.where("doc_id = 7"), PIECES)).collect():
        ids = library.encode(AWKWARD[7])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert sentence_pieces.digest(sentence_pieces.encoded(df.where("false"), PIECES)).count() == 0


def test_segments_parts_and_tables_change_nothing(library, monkeypatch):
    r = random.Random(1)
    letters = ["a", "b", " ", "▁", "\n", "\t", "é", "😀", "<s>", "x", "th", "\x00", "́", "  ", "漢", "ﬁ"]
    for segment, part, table in ((1 << 19, 4096, 1 << 19), (7, 4096, 5), (7, 5, 20)):
        monkeypatch.setattr(sentence_pieces, "SEGMENT", segment)
        monkeypatch.setattr(sentence_pieces, "PART", part)
        monkeypatch.setattr(sentence_pieces, "TABLE", table)
        coder = sentence_pieces.Coder(PIECES)
        for _ in range(1500):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
            ids, plain = coder.encoded(text)
            assert ids.tolist() == library.encode(text) and plain == library.decode(ids.tolist()), text
        assert len(coder.new) <= table


def test_models_whose_pieces_cross_words_are_encoded_whole(library):
    coder = sentence_pieces.Coder(PIECES)
    coder.by_words = False
    assert coder.encode("two words  here").tolist() == library.encode("two words  here")
