"""The training-data operators on small inputs, against brute force and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from fieldtrace.llm import common, decontamination, jaccard, language_model, metric_join, packing, pii, quality, sql, suffix_dedup, token_counts, toxicity
from pyspark.sql import functions as F

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(["the", "of", "and", "to"]) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


BASE = words(120, 1)
TEXTS = [
    " ".join(BASE), " ".join(BASE), " ".join(BASE[:60] + ["changed"] + BASE[61:]).upper(), " ".join(words(90, 2)), " ".join(words(40, 3)) + "\n" + " ".join(words(40, 3)),
    "", None, "   \n", "one two", "ONE  two", "just four words here", " ".join(words(3000, 4)), "x" * 70_000, " ".join(words(50, 5)) + " " + " ".join(BASE[10:40]),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, "x", 1, b"m") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1, b"m"), (None, TEXTS[0], "x", 1, b"m")]
    return spark.createDataFrame(rows, DOCS + ", key string, n long, found binary").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(len(TEXTS))] + [(None, None, None)], "doc_id long, quality int, toxic int")


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets):
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and both * 100 >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_equals_brute_force(docs):
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = components(sets)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_jaccard_of_a_chain_and_a_crowd(spark):
    """Links through a middle text only, and a crowd of near copies of one text."""
    r, rows, text = random.Random(9), [], list(BASE)
    for i in range(6):
        rows.append((i, " ".join(text)))
        at = r.randrange(100)
        text[at : at + 2] = ["new", f"w{i}"]
    for i in range(60):
        t = list(BASE[::-1])
        t[r.randrange(118)] = f"z{i}"
        rows.append((100 + i, " ".join(t)))
    got = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == components({i: shingles(t) for i, t in rows})


@pytest.mark.parametrize(("n", "few"), [(1000, 1 << 16), (100, 0)])
def test_components_of_a_long_path(spark, monkeypatch, n, few):
    """A path with ids 0, n-1, n-2, ..., 1 is one component, on the driver's few edges or not; a loop and lone vertices stay."""
    monkeypatch.setattr(common, "FEW_EDGES", few, raising=False)
    ids = [0, *range(n - 1, 0, -1)]
    edges = list(zip(ids[:-1], ids[1:], strict=True)) + [(9000, 9001), (9002, 9002)]
    vertices = spark.createDataFrame([(i,) for i in [*ids, 9000, 9001, 9002, 9003]], "id long")
    got = {r["id"]: r["component"] for r in common.components(vertices, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0) | {9000: 9000, 9001: 9000, 9002: 9002, 9003: 9003}


def test_jaccard_of_a_long_chain(spark):
    """300 successive versions, each near its neighbours only, with shuffled ids: one component."""
    n, r = 300, random.Random(11)
    ids = r.sample(range(n), n)
    rows = [(ids[i], " ".join(f"v{k}" for k in range(3 * i, 3 * i + 60))) for i in range(n)]
    sets = {i: shingles(t) for i, t in rows}
    near = [len(sets[ids[0]] & sets[ids[k]]) * 100 >= 80 * len(sets[ids[0]] | sets[ids[k]]) for k in range(1, n)]
    assert near[0] and not any(near[2:])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == n and {x["component_id"] for x in got} == {0}


def test_contained_items_equal_brute_force(spark, docs):
    items = [(1, " ".join(BASE[10:40])), (2, " ".join(words(30, 77))), (3, "one TWO"), (4, None), (5, " "), (6, " ".join(BASE[10:38] + ["else", "where"])), (None, "one two"), (7, "four")]
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_common"]) for r in decontamination.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        for k, q in items:
            w = (q or "").lower().split()
            if k is None or not w:
                continue
            s, d = shingles(q, min(5, len(w))), shingles(t, min(5, len(w)))
            if len((t or "").split()) >= min(5, len(w)) and len(s & d) * 100 >= 80 * len(s):
                want[i, k] = (len(s), len(s & d))
    assert got == want and want
    assert decontamination.contained_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_language_model(docs):
    rows = language_model.scores(docs).collect()
    tok = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(TEXTS)}
    train = [i for i in list(tok) + [3] if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for i in train for x in tok[i])
    n, v = sum(c.values()), len(c)
    assert len(rows) == docs.count()
    for r in rows:
        t = tok[r["doc_id"] if r["doc_id"] is not None else 0]
        assert r["train_tokens"] == n and r["n_tokens"] == len(t) and r["n_known"] == sum(c[x] > 0 for x in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["score"] < 0


def test_every_attested_word_has_a_class(spark):
    """700 words of one ending, of which every second follows the others: all are clustered, and told apart by context."""
    r, n = random.Random(3), 350
    first, then = ([f"{k}{i}xx" for i in range(n)] for k in "ab")
    rows = [(i, " ".join(x for _ in range(10) for x in (r.choice(first), r.choice(then)))) for i in range(4000)]
    model, counts = language_model.train(spark.createDataFrame(rows, DOCS).repartition(3))
    often = counts.where(F.col("n") >= language_model.ATTESTED).count()
    assert often > 650 and (model.units.word_unit >= 0).sum() == often == len(model.cls) - language_model.UNITS + language_model.WORD_UNITS
    data = np.frombuffer(" ".join(first + then).encode(), np.uint8)
    starts, ends, _ = common.block_words(data, np.array([0, len(data)]))
    table = language_model.WordTable(model.units.hashes)
    at = table.find(common.word_hashes(data, starts, ends))
    unit = np.where(at >= 0, model.units.word_unit[at], -1)
    late = [set(model.cls[u[u >= language_model.UNITS]]) for u in (unit[:n], unit[n:])]
    assert all(late) and not late[0] & late[1]


def test_class_model_is_a_distribution():
    """Over all units, the chance of the next one sums to 1 after any class."""
    rng = np.random.default_rng(0)
    pairs = np.zeros((language_model.UNITS, language_model.UNITS), np.int64)
    a, b = rng.integers(0, 40, 3000), rng.integers(0, 40, 3000)
    np.add.at(pairs, (a, np.where(a % 2 == 0, b // 2 * 2, b // 2 * 2 + 1)), 1)
    cls = language_model.exchange_clustering(pairs, 6)
    onehot = np.eye(6)[cls]
    grid = onehot.T @ pairs @ onehot
    likelihood = lambda g: (g * np.log(np.maximum(g, 1e-300))).sum() - (g.sum(0) * np.log(np.maximum(g.sum(0), 1e-300))).sum() - (g.sum(1) * np.log(np.maximum(g.sum(1), 1e-300))).sum()
    mixed = np.eye(6)[rng.permutation(cls)]
    assert likelihood(grid) > likelihood(mixed.T @ pairs @ mixed)
    assert cls[language_model.END] == 5 and (cls[: language_model.END] != 5).all()


def test_packing_is_exact(docs, empty):
    got = packing.pack(docs, WORD_TOKENIZER, capacity=256).collect()
    ids = {i: packing.WordIds(WORD_TOKENIZER).tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"] if r["doc_id"] is not None else 0]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, p in pieces.items():
        covered = collections.Counter(k for s, n in p for k in range(s, s + n))
        times = 2 if i == 3 else 1
        assert covered == {k: times for k in range(len(ids[i or 0]))}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(empty, WORD_TOKENIZER).count() == 0


def test_column_generation_is_near_the_bound():
    r = np.random.default_rng(5)
    demand = r.integers(0, 400, 64)
    demand[24:] = 0  # no size is so large that volume alone is no bound
    patterns, times = packing.column_generation(demand, 64)
    sizes = np.arange(1, 65)
    assert (patterns @ sizes <= 64).all() and (patterns.T @ times <= demand).all()
    left = demand - patterns.T @ times
    used = times.sum() + math.ceil((left * sizes).sum() / 64)
    assert used <= math.ceil((demand * sizes).sum() / 64) * 1.02 + len(times)
    assert packing.stream_cuts(2048 + 1300).tolist() == [2048, 3072, 3328, 3344, 3348]


def removed_by_brute_force(texts, span):
    raw = [(t or "").encode() for t in texts]
    c = collections.Counter(t[k : k + span] for t in raw for k in range(len(t) - span + 1))
    out = []
    for t in raw:
        m = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if c[t[k : k + span]] > 1:
                m[k : k + span] = True
        starts = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1)
        out.append((len(t), int(m.sum()), len(starts), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_repeated_strings_equal_brute_force(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(block)
    text = lambda n: "".join(r.choice("abcdefgh ij") for _ in range(n))
    parts = [text(n) for n in (450, 405, 400, 399, 900)]
    texts = [text(r.randint(0, 300)) + r.choice(parts) + text(r.randint(0, 300)) for _ in range(60)]
    texts += ["a" * 1500, texts[0], None, "", "ab" * 600, parts[4][:500] + "é" + parts[4][500:], parts[4][200:650] + "-" + parts[4][200:650]]
    got = suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got] == removed_by_brute_force(texts, 400)
    if block == 256:
        assert suffix_dedup.removed(docs).count() == docs.count()
        assert suffix_dedup.removed(empty).count() == 0


def test_suffixes_are_sorted():
    r = random.Random(4)
    s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(300)] + [b"a" * 80] * 3
    order, lcp = [], []
    for o, common in suffix_dedup.deep_shallow(s, 16):
        order += o
        for a, b, n in zip(o, o[1:], common, strict=False):
            assert suffix_dedup.common_prefix(s[a], s[b]) == n
    padded = [x.ljust(16, b"\0") for x in s]
    assert [padded[i] for i in order] == sorted(padded)


def test_quality_learns(spark, docs, empty, labels):
    r = random.Random(2)
    good = [" ".join(words(60, k)) for k in range(80)]
    bad = [" ".join(w + r.choice(["***", "$$$"]) for w in words(60, 1000 + k)) for k in range(40)]
    rows = list(enumerate(good + bad))
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, int(i < 80)) for i, _ in rows], "doc_id long, quality int")
    out = quality.quality_scores(d, quality.train(d, lab)).collect()
    held = [x for x in out if x["held_out"]]
    assert held and all((x["score"] >= 0.3) == (x["predicted"] == 1) and 0 <= x["score"] <= 1 for x in out)
    assert sum((x["predicted"] == 1) == (x["doc_id"] < 80) for x in held) >= 0.9 * len(held)
    p = quality.train(docs, labels)
    assert quality.quality_scores(docs, p).count() == docs.count()
    whole = {x["doc_id"]: x["score"] for x in quality.quality_scores(docs, p).collect()}
    one = quality.quality_scores(docs.where("doc_id = 11"), p).first()["score"]
    assert whole[11] == pytest.approx(one, abs=1e-5)  # a score does not depend on its neighbours
    assert quality.quality_scores(empty, quality.train(empty, labels)).count() == 0


def test_gradients_match_differences():
    p = {k: v.astype(np.float64) for k, v in quality.start_params().items()}
    data = np.frombuffer(("some text, " * 40 + "OTHER!! " * 30).encode(), np.uint8)
    padded, first = quality.laid_out(data, np.array([0, 440, len(data)]))
    y, w = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    loss = lambda: -np.mean([math.log(q if t else 1 - q) for q, t in zip(quality.forward(p, padded, first)[0], y, strict=True)])
    g = quality.gradients(p, padded, first, y, w)
    for k, at in (("out", 0), ("hidden", (3, 2)), ("here", (5, 4)), ("next", (2, 1)), ("embed", (101, 1)), ("bias", 3)):
        p[k][at] += 1e-4
        up = loss()
        p[k][at] -= 2e-4
        down = loss()
        p[k][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(float(np.asarray(g[k])[at]), rel=0.05, abs=2e-5)


def test_toxic_documents_are_found(spark, docs, empty, labels):
    rows = [(i, " ".join(words(80, i)) + (" you vilest " + "vilenesses " * 3 + " ".join(words(5, i)) if i % 6 == 0 else "")) for i in range(240)]
    d = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 240, 1) if i % 4], "doc_id long, toxic int")
    out = {r["doc_id"]: r["is_toxic"] for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    assert out == {i: i % 6 == 0 for i in range(240)}
    kept = toxicity.keep_clean(d.withColumn("n", F.lit(1)), lab)
    assert kept.columns == ["doc_id", "text", "n"] and kept.count() == 200
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()
    none = toxicity.train(empty, labels.where("toxic = 9"))
    assert toxicity.score(docs, none).where("is_toxic").count() == 0 and toxicity.keep_clean(empty, labels).count() == 0


def test_token_counts(docs, empty):
    coder = token_counts.encoding(BYTE_RANKS)
    n = [len(coder.encode_ordinary(t or "")) for t in [*TEXTS, TEXTS[3], TEXTS[0]]]
    for r in token_counts.token_counts(docs, BYTE_RANKS).collect():
        k = r["context_limit"]
        assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (n.count(k), sum(x > k for x in n), sum(x for x in n if x > k))
        assert (r["total_docs"], r["total_tokens"], r["truncated_tokens"]) == (len(n), sum(n), sum(min(x, k) for x in n))
    sums = token_counts.token_counts(docs, BYTE_RANKS)
    got = {(r["kind"], r["at"]): r["value"] for r in token_counts.answers(sums, [100], [0.5]).collect()}
    assert got["limit", 100.0] == sum(min(x, 100) for x in n) and got["quantile", 0.5] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.token_counts(empty, BYTE_RANKS).count() == 0


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PER_CELL", 12)
    monkeypatch.setattr(metric_join, "TILE", 7)
    r = np.random.default_rng(8)
    centre = r.normal(size=(6, 8))
    x = [centre[k % 6] + r.normal(size=8) * 0.35 for k in range(120)]
    rows = [(k, [float(np.float32(v)) for v in x[k % 110]], k % 2) for k in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] + [1.0] * 7, 0), (203, [None] + [1.0] * 7, 0), (204, rows[0][1], None), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = {k: np.array(e, float) / np.linalg.norm(np.array(e, float)) for k, e, lab in rows if k < 120 or k > 204}
    lab = {k: v for k, _, v in rows}
    links = {k: {j for j in unit if j != k and lab[j] == lab[k] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.93} for k in unit}
    reach = {k: k for k in lab}
    for _ in range(40):
        for k, ls in links.items():
            reach[k] = min([reach[k], *(reach[j] for j in ls)])
    got = {r["vec_id"]: tuple(r)[1:] for r in metric_join.near_vectors(df).collect()}
    assert got == {k: (len(links.get(k, ())), reach[k], reach[k] == k) for k in lab}
    assert metric_join.near_vectors(df.where("vec_id < 0")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], t or "") if ok(k, m.group())]


def test_personal_data(spark, docs, empty):
    texts = [
        "a@b.c_x@d.e a@b@c.d 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 4111 1111 1111 1111 é😀 +49 (0)30-1234567", "mail joe (at) host (dot) com, call 555-123-4567", "1" * 4000 + " " + "a." * 2000 + "@" + "b." * 1000 + "c +" + "1 " * 900,
        None, "", "version 1.2.3.4", "+1 (988) 555-2485 x", "4041894974608795", "@@..++",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in pii.digest(pii.personal_spans(d)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))
    out = {r["doc_id"]: r["text"] for r in pii.redacted(d).collect()}
    assert out[6] == "[PHONE] x" and out[7] == "[CARD]" and out[3] == out[4] == ""
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == docs.count()
    assert pii.redacted(empty).count() == 0


def test_em_finds_the_liar():
    """A labeler that disagrees with three good ones gets low weight."""
    counts = []
    for code, n in {(2, 2, 2, 1, 1): 80, (0, 0, 0, 1, 1): 80, (2, 2, 2, 0, 1): 40, (0, 0, 0, 2, 1): 40}.items():
        value = 0
        for v in code:
            value = 3 * value + v
        counts.append(("phone", value * pii.DIGIT_STEPS * pii.MARK_RUNS, n))  # of one shape
    post = list(pii.estimate(counts).values())
    assert post[0] > 0.9 and post[1] < 0.1 and post[2] > 0.9 and post[3] < 0.1


def test_sql_agrees(spark, data):
    from fieldtrace.llm.queries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, query in {"op1_decontamination": sql.CONTAINED_ITEMS, "op2_ngram_jaccard_join": sql.JACCARD, "op9_embedding_near_dedup": sql.NEAR_VECTORS}.items():
        got, want = QUERIES[name](spark, data).toPandas(), con.sql(query).df()
        keys = list(want.columns)
        assert got[keys].sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist()
