"""Personal data with known spans: what the label model and the classifier add, and what they reject."""

from __future__ import annotations

import random

from fieldtrace.llm import pii

DOCS = "doc_id long, text string"


def luhn(digits):
    total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def corpus(n=400):
    """(text, [(true or false span, whether it is personal)]) of several makes, and plain texts with base spans."""
    r = random.Random(6)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    phone = lambda: f"{r.randint(200, 989)}-{digits(3)}-{digits(4)}"
    for k in range(n):
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        kind = k % 8
        if kind == 0:
            x = f"{name} (at) host{k % 7} (dot) com"
            yield f"please mail {x} soon", [(x, True)]
        elif kind == 1:
            x = phone()
            yield f"you can call {x} now", [(x, True)]
        elif kind == 2:
            x = phone()
            yield f"part with serial {x} inside", [(x, False)]
        elif kind == 3:
            x, y = f"+1 ({r.randint(200, 989)}) {digits(3)}-{digits(4)}", luhn("4" + digits(14))
            yield f"reach me at phone {x} {y} today", [(x, True), (y, True)]
        elif kind == 4:
            x = "4" + digits(14)
            x = x + str((int(luhn(x)[-1]) + 1 + r.randrange(8)) % 10)
            yield f"run number {x} ended", [(x, False)]
        elif kind == 5:
            yield f"my card {luhn('4' + digits(14))} is new", []
        elif kind == 6:
            yield f"write {name}@mail{k % 5}.com or call +1 ({r.randint(200, 989)}) {digits(3)}-{digits(4)}", []
        else:
            yield f"server {r.randint(1, 220)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 255)} is up", []


def test_spans_are_added_and_rejected(spark):
    rows = list(corpus())
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_spans(docs, with_text=False)).collect()}
    tally = {True: [0, 0], False: [0, 0]}
    for i, (text, spans) in enumerate(rows):
        ends = {tuple(map(int, x.split(":")[1:])) for x in found[i].split(",") if x}
        for x, personal in spans:
            tally[personal][(text.index(x), text.index(x) + len(x)) in ends] += 1
    assert tally[True][1] >= 0.9 * sum(tally[True]), tally
    assert tally[False][1] <= 0.1 * sum(tally[False]), tally


def test_reliabilities_beat_plain_votes(spark):
    """Every candidate of the labelled texts: a majority of votes takes serial numbers for phones and
    failed runs for cards; with estimated reliabilities the same votes tell them apart."""
    rows = list(corpus())
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    found = {r["doc_id"]: r["found"] for r in pii.candidates(docs).select("doc_id", "found").collect()}
    post, right = pii.reliabilities(pii.vote_counts(pii.candidates(docs)))
    plain = weighed = asked = 0
    for i, (text, spans) in enumerate(rows):
        truth = {(text.index(x), text.index(x) + len(x)): personal for x, personal in spans}
        for c in found[i]:
            personal = truth.get((c["start"], c["end"]))
            if personal is not None and not c["base"]:
                asked += 1
                plain += (sum(pii.votes_of(c["code"])) > 0) == personal
                weighed += (post[c["kind"], c["code"]] > 0.5) == personal
    assert weighed >= 0.99 * asked and plain <= 0.75 * asked, (asked, plain, weighed)
    # The words before a number tell true from false; its place in the text does not.
    assert right["phone", "context", 0] > 0.8 > 0.2 > right["phone", "edges", 0]


def test_looser_cards_need_the_rule(spark):
    """Cards in groups that the strict pattern does not take: those that pass the rule are added."""
    r = random.Random(3)
    rows = []
    for k in range(60):
        x = luhn("4" + "".join(r.choice("0123456789") for _ in range(14)))
        bad = x[:-1] + str((int(x[-1]) + 1 + k % 8) % 10)
        rows += [(3 * k, f"card {x} here"), (3 * k + 1, f"card {bad} here"), (3 * k + 2, f"pay {'.'.join((x if k % 2 else bad)[j : j + 4] for j in (0, 4, 8, 12))} now")]
    got = {d["doc_id"]: d["spans"] for d in pii.digest(pii.personal_spans(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(bool(got[3 * k]) and not got[3 * k + 1] and bool(got[3 * k + 2]) == bool(k % 2) for k in range(60))


def test_both_ways_find_the_same(spark):
    rows = [(i, t) for i, (t, _) in enumerate(corpus(80))] + [(None, None), (3, ""), (3, "a@b.com"), (3, "a@b.com")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("code", pii.F.lit("x"))
    a, b = (sorted(map(tuple, pii.digest(pii.personal_spans(docs, with_text=w)).collect()), key=str) for w in (True, False))
    assert a == b and len(a) == len(rows)


def test_shape_separates_what_votes_do_not():
    """Spans of like votes: the classifier tells them apart by their shape."""
    shapes = pii.DIGIT_STEPS * pii.MARK_RUNS
    code = lambda votes, digits, marks: sum((v + 1) * 3 ** (len(votes) - 1 - j) for j, v in enumerate(votes)) * shapes + digits * pii.MARK_RUNS + marks
    good, bad, open_ = [1, 1, 1, 0, 0], [0, -1, -1, -1, -1], [0, 0, 0, 0, 0]
    counts = [("phone", code(good, 2, 4), 500), ("phone", code(bad, 4, 0), 500), ("phone", code(open_, 2, 4), 20), ("phone", code(open_, 4, 0), 20)]
    assert pii.votes_of(counts[0][1]) == good and pii.shape_of(counts[0][1]) == (2, 4)
    w = pii.train(counts)["phone"]
    z = [sum(a * b for a, b in zip(w, pii._features(c), strict=True)) for _, c, _ in counts]
    assert z[0] > 0 > z[1] and z[2] > z[3]
