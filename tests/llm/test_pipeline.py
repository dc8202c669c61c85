"""The corpus pipeline on a small folder of tables, against a brute-force version of its stages."""

from __future__ import annotations

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    item = words(30, 900)
    rows = []
    for i in range(240):
        t = words(60, i)
        if i % 8 == 0:
            t += ["you", "vilest", *["vilenesses"] * 3]
        elif i % 10 == 1:  # a near copy of the one before, which is kept
            t = words(60, i - 1) if (i - 1) % 8 else t
            t[3] = "other"
        elif i % 15 == 4:
            t = t[:20] + item + t[20:]
        elif i % 7 == 3:
            t[10:10] = [f"x{i}@mail.example.com", f"+1 (212) 555-{i:04d}"]
        rows.append((i, " ".join(t)))
    rows += [(300, None), (301, ""), (302, "  \n"), (None, " ".join(words(60, 2))), (303, " ".join(words(9000, 77))), (2, rows[2][1]), (304, rows[3][1])]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(240) if i % 3] + [(None, None, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, item


def expected(rows, item):
    """(doc_id, text) of the rows that come through the first four stages."""
    rows = [(i, t) for i, t in rows if "vilenesses" not in (t or "")]
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None and shingles(t):
            sets[i].append(shingles(t))
    root = {i: i for i in sets}
    for _ in range(5):
        for i, a in sets.items():
            for j, b in sets.items():
                if any(100 * len(x & y) >= 80 * len(x | y) for x in a for y in b):
                    root[i] = root[j] = min(root[i], root[j])
    rows = [(i, t) for i, t in rows if root.get(i, i) == i]
    held = {i for i, t in rows if i is not None and len(shingles(t) & shingles(" ".join(item))) >= 0.8 * len(shingles(" ".join(item)))}
    rows = [(i, t) for i, t in rows if i not in held]
    out = []
    for i, t in rows:
        w = (t or "").split(" ")
        if i is not None and f"x{i}@mail.example.com" in w:
            t = t.replace(f"x{i}@mail.example.com", "[EMAIL]").replace(f"+1 (212) 555-{i:04d}", "[PHONE]")
        out.append((i, t or ""))
    return out


def test_pipeline_equals_brute_force(spark, folder):
    at, rows, item = folder
    want = expected(rows, item)
    assert 100 < len(want) < len(rows) - 40
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = collections.Counter((i, tuple(coder.encode(t, add_special_tokens=False).ids) + (1,)) for i, t in want)
    got = corpus_pipeline.run(spark, at).collect()
    pieces = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    spots = collections.defaultdict(list)
    for r in got:
        spots[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in spots.values():
        assert [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert sum(r["length"] for r in got) == sum(n * len(x) for (_, x), n in ids.items())
    of = collections.defaultdict(list)
    for i, x in ids.elements():
        of[i].append(x)
    for (i, start, n, crc), _ in pieces.items():
        assert any(len(x) >= start + n and zlib.crc32(np.array(x[start : start + n], "<u4").tobytes()) == crc for x in of[i])
    assert {r["doc_id"] for r in got} == set(of)


def test_stages_keep_the_columns_of_documents(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < -1"), at).count() == 0, name
