"""Operator 10: personal data by weak supervision.

Patterns propose spans.  Labelers vote on each span, or abstain: the strict pattern with
its rule, the form within (which the rule does not look at), a gazetteer, the words before
it, and the characters around it.  Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is for each kind; spans of the strict
patterns are known to be personal, all others start from the share of their votes.  A
logistic span classifier is trained on the posteriors: it sees the votes and, beside them,
the shape of the span, which no labeler judges.  Spans of the strict patterns always stay;
the classifier adds others and rejects the rest.

DataFrame and SQL functions only: what the driver sees is one row per kind, vote pattern
and shape, some ten thousand at most whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base.  Possessive quantifiers and the look-behinds change no
#: match; they keep the matcher linear and off the stack on very long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms that only the labelers together can tell from other text.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[.\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: A text without this cannot hold the kind.
NEEDS = {"email": r"@|[(\[](?:at|AT)[)\]]", "ip": r"[0-9A-Fa-f]{1,4}[.:][0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9]"}
GAZETTEER = {
    "email": r"(?i)[.)\]\x20](?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|us)$",
    "ip": r"^(?:10\.|127\.|192\.168\.|[1-9][0-9]?\.|1[0-9]{2}\.|2[0-2][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|44|49|39|31|41|43)|\(?[2-9][0-9]{2}\)?)",
}
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|address|server|host|client|adresse)",
    "card": r"(?i)(?:card|visa|master|credit|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel\b|tel\.|call|mobile|fax|telefon|tel[eé]fono|t[eé]l)",
}
AGAINST = r"(?i)(?:version|licen[sc]e|release|chapter|\bno\.|\bid\b|isbn|serial)\W*$"
LABELERS = ("strict", "form", "gazetteer", "context", "edges")
#: Before any data a labeler counts as right in RIGHT of so many votes on either class.
RIGHT, BEFORE = 0.7, 4.0
#: Shape of a span: digits by fours (up to 20), and runs of marks between them (up to 7).
DIGIT_STEPS, MARK_RUNS = 6, 8


def _luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '')"
    digit = f"cast(substring({d}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"


def _digits(x: str) -> str:
    return f"length(regexp_replace({x}, '[^0-9]', ''))"


CHECK = {
    "email": "true",
    "ip": r"{x} rlike r'^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){{3}}$'",
    "card": "if(" + _digits("{x}") + " between 16 and 19, " + _luhn("{x}") + ", false)",
    "phone": _digits("{x}") + " between 8 and 15",
}
#: Kinds whose looser forms are judged by the rule of the strict ones.
DIGITS = ("card",)
#: Digits of a number with its country code, for the countries of the gazetteer, and those codes.
DIALLED = r"^(?:1[2-9][0-9]{2}[2-9][0-9]{6}|(?:33|34|31|41)[1-9][0-9]{8}|44[1-9][0-9]{8,9}|(?:49|39|43)[0-9]{7,11})$"
DIALLED_CODES = r"^(?:1|33|34|31|41|44|49|39|43)"
_NUMBER = "regexp_replace(x, '[^0-9]', '')"
_DIALLED = f"if({_NUMBER} rlike r'{DIALLED}', 2, if({_NUMBER} rlike r'{DIALLED_CODES}', 0, 1))"
#: Votes on the form within, of strict and of looser spans: names that end and begin well, octets
#: without leading zeros, digits in the groups that cards are printed in, numbers as long as their country's.
FORM = {
    "email": (r"if(x rlike r'^[^.@](?:[^@]*[^.@])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}$', 2, 0)", r"if(x rlike r'[A-Za-z]{2,24}$', 2, 0)"),
    "ip": (r"if(x rlike r'^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$', 2, 0)", "1"),
    "card": (r"if(x rlike r'^(?:[0-9]+|(?:[0-9]{4}[\x20-]){3,4}[0-9]{1,4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5,6})$', 2, 0)", "1"),
    "phone": (_DIALLED, rf"if(x rlike r'^\+', {_DIALLED}, if({_NUMBER} rlike r'^[2-9][0-9]{{2}}[2-9]', 2, 0))"),
}
#: Failed matches of the strict patterns that are still worth a vote.
WORTH = {"email": "true", "ip": "true", "card": _digits("{x}") + " between 13 and 19", "phone": _digits("{x}") + " between 7 and 16"}


def _matches(kind: str, pattern: str, strict: bool) -> str:
    """SQL for array<struct<kind, start, end, base, code>> of one pattern in ``text``.

    Positions are code points; they are running sums of the lengths of the matches and
    of the pieces between them.
    """
    m, p = f"regexp_extract_all(text, r'{pattern}', 0)", f"split(text, r'{pattern}', -1)"
    vote = {
        "strict": "if(ok, 2, 0)" if strict or kind in DIGITS else "1",
        "form": FORM[kind][0 if strict else 1],
        "gazetteer": f"if(x rlike r'{GAZETTEER[kind]}', 2, 0)",
        "context": f"if(before rlike r'{AGAINST}', 0, if(before rlike r'{CUES[kind]}', 2, 1))",
        "edges": "if(before rlike r'[\\p{L}0-9_]$' or after rlike r'^[\\p{L}0-9_]', 0, 2)",
    }
    code = "if(ok, 1, 0)" if strict else "0"  # above the votes: a base span
    for name in LABELERS:
        code = f"3 * ({code}) + {vote[name]}"
    shape = f"{MARK_RUNS} * least({DIGIT_STEPS - 1}, ({_digits('x')}) div 4) + least({MARK_RUNS - 1}, regexp_count(x, '[^0-9A-Za-z]+'))"
    code = f"cast({DIGIT_STEPS * MARK_RUNS} * ({code}) + {shape} as int)"
    ok = CHECK[kind].format(x="x") if strict or kind in DIGITS else "false"
    keep = f"where_ok or ({WORTH[kind].format(x='x')})" if strict else "true"
    # let-bindings by one-element transforms: m, pieces, running ends, then each span
    spans = f"""flatten(transform(array(struct({m} as m, {p} as p)), v ->
        flatten(transform(array(aggregate(zip_with(v.m, slice(v.p, 1, size(v.m)), (a, b) -> length(a) + length(b)), array(0), (c, n) -> array_append(c, element_at(c, -1) + n))), c ->
          filter(transform(v.m, (x, i) -> struct(x as x, c[i] + length(v.p[i]) as start, c[i + 1] as end, {ok} as ok)), q ->
            {keep.replace("where_ok", "q.ok").replace("x,", "q.x,") if strict else "true"})))))"""
    return f"""transform({spans}, s -> element_at(transform(array(struct(s.x as x, s.ok as ok, substring(text, greatest(s.start - 31, 1), least(s.start, 32)) as before, substring(text, s.end + 1, 1) as after)), t ->
        struct('{kind}' as kind, s.start as start, s.end as end, {"s.ok" if strict else "false"} as base, {_qualify(code)} as code)), 1))"""


def _qualify(code: str) -> str:
    return code.replace("if(ok", "if(t.ok").replace("if(x ", "if(t.x ").replace("(x,", "(t.x,").replace("before ", "t.before ").replace("after ", "t.after ")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: array<struct<kind, start, end, base, code>> by kind, then start.

    A candidate that overlaps a base span of its kind is left out, as is a looser one at the
    very place of a failed strict one; others that overlap are told apart by the classifier.
    """
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    none = "cast(array() as array<struct<kind: string, start: int, end: int, base: boolean, code: int>>)"
    columns = []
    for kind in KINDS:
        own = f"case when text rlike r'{NEEDS[kind]}' then {_matches(kind, BASE[kind], True)} else {none} end"
        d = d.withColumn(f"_{kind}", F.expr(own))
        if kind in LOOSE:
            more = f"case when text rlike r'{LOOSE[kind]}' then {_matches(kind, LOOSE[kind], False)} else {none} end"
            d = d.withColumn(f"_more_{kind}", F.expr(more))
            d = d.withColumn(f"_{kind}", F.expr(f"array_sort(concat(_{kind}, filter(_more_{kind}, y -> not exists(_{kind}, z -> if(z.base, z.start < y.end and y.start < z.end, z.start = y.start and z.end = y.end)))))")).drop(f"_more_{kind}")
        columns.append(f"_{kind}")
    return d.withColumn("found", F.concat(*columns)).drop(*columns)


def vote_counts(found: DataFrame) -> list[tuple[str, int, int]]:
    """(kind, code, number of spans): at most len(KINDS) * 2 * 3 ** len(LABELERS) * DIGIT_STEPS * MARK_RUNS rows."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.code").count()
    return sorted((r["kind"], r["code"], r["count"]) for r in rows.collect())


def votes_of(code: int) -> list[int]:
    """Votes in the order of LABELERS: -1 against, 0 abstains, 1 for."""
    code //= DIGIT_STEPS * MARK_RUNS
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return out[::-1]


def is_base(code: int) -> bool:
    return code >= 3 ** len(LABELERS) * DIGIT_STEPS * MARK_RUNS


def shape_of(code: int) -> tuple[int, int]:
    """Steps of digits, and runs of marks."""
    return divmod(code % (DIGIT_STEPS * MARK_RUNS), MARK_RUNS)


def reliabilities(counts: list[tuple[str, int, int]], rounds: int = 100) -> tuple[dict[tuple[str, int], float], dict[tuple[str, str, int], float]]:
    """Expectation-maximisation over what labelers do on true and on false spans of a kind.

    Returns the posterior of each (kind, code), and for each (kind, labeler, class) the
    share of its votes that are right.  An abstention says nothing.  Base spans are
    true; the others of a kind share a prior and start from the share of votes for among
    those given.  BEFORE votes of each labeler speak beside the data.
    """
    post, right = {}, {}
    for kind in KINDS:
        own = [(code, votes_of(code), n) for k, code, n in counts if k == kind]
        p = [1.0 if is_base(c) else (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for c, v, _ in own]
        for _ in range(rounds):
            unknown = [(q, n) for q, (c, _, n) in zip(p, own, strict=True) if not is_base(c)]
            prior = (1 + sum(q * n for q, n in unknown)) / (2 + sum(n for _, n in unknown))
            share = []
            for j in range(len(LABELERS)):
                known = [(q, v[j], n) for q, (_, v, n) in zip(p, own, strict=True) if v[j]]
                true = (BEFORE * RIGHT + sum(q * n for q, x, n in known if x > 0)) / (BEFORE + sum(q * n for q, _, n in known))
                false = (BEFORE * RIGHT + sum((1 - q) * n for q, x, n in known if x < 0)) / (BEFORE + sum((1 - q) * n for q, _, n in known))
                share.append((false, true))
            new = []
            for c, v, _ in own:
                z = math.log(prior / (1 - prior))
                for x, (false, true) in zip(v, share, strict=True):
                    if x:
                        z += math.log(true / (1 - false)) if x > 0 else math.log((1 - true) / false)
                new.append(1.0 if is_base(c) else 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            moved = max((abs(a - b) for a, b in zip(new, p, strict=True)), default=0.0)
            p = new
            if moved < 1e-6:
                break
        if own:
            right |= {(kind, name, y): share[j][y] for j, name in enumerate(LABELERS) for y in (0, 1)}
        post |= {(kind, code): q for q, (code, _, _) in zip(p, own, strict=True)}
    return post, right


def estimate(counts: list[tuple[str, int, int]], rounds: int = 100) -> dict[tuple[str, int], float]:
    """Posterior of each (kind, code), in the order of ``counts``."""
    post = reliabilities(counts, rounds)[0]
    return {(k, c): post[k, c] for k, c, _ in counts}


def _features(code: int) -> list[float]:
    """Bias, votes, and the shape of the span."""
    digits, marks = shape_of(code)
    votes = [float(v == s) for v in votes_of(code) for s in (-1, 1)]
    return [1.0, *votes, *(float(digits == k) for k in range(DIGIT_STEPS)), *(float(marks == k) for k in range(MARK_RUNS))]


def train(counts: list[tuple[str, int, int]], rounds: int = 400, rate: float = 1.0) -> dict[str, list[float]]:
    """Weights of the span classifier of each kind: logistic regression on the posteriors.

    Every pattern of votes and shape counts by the logarithm of its spans, so that rare
    ones are heard beside the usual ones.
    """
    post = estimate(counts)
    weights = {}
    for kind in KINDS:
        rows = [([j for j, v in enumerate(_features(c)) if v], post[k, c], 1 + math.log(n)) for k, c, n in counts if k == kind]
        w = [0.0] * len(_features(0))
        total = sum(m for _, _, m in rows) or 1.0
        for _ in range(rounds):
            g = [0.002 * x for x in w]
            for at, y, m in rows:
                z = sum(w[j] for j in at)
                e = m / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y)
                for j in at:
                    g[j] += e
            w = [a - rate * b for a, b in zip(w, g, strict=True)]
        weights[kind] = w
    return weights


def decided(found: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """``found`` with only base spans and those the classifier accepts; of accepted ones of a
    kind that overlap the first stays."""
    shapes = DIGIT_STEPS * MARK_RUNS
    cases = []
    for kind in KINDS:
        w = weights[kind]
        terms = [f"{w[0]}D"]
        for j in range(len(LABELERS)):
            v = f"(s.code div {shapes * 3 ** (len(LABELERS) - 1 - j)}) % 3"
            terms += [f"if({v} = 0, {w[1 + 2 * j]}D, if({v} = 2, {w[2 + 2 * j]}D, 0D))"]
        at = 1 + 2 * len(LABELERS)
        for steps, value in ((DIGIT_STEPS, f"s.code % {shapes} div {MARK_RUNS}"), (MARK_RUNS, f"s.code % {MARK_RUNS}")):
            terms.append(f"element_at(array({', '.join(f'{x}D' for x in w[at : at + steps])}), cast({value} + 1 as int))")
            at += steps
        cases.append(f"when s.kind = '{kind}' then {' + '.join(terms)}")
    accepted = f"filter(found, s -> s.base or (case {' '.join(cases)} end) >= 0D)"
    # Among accepted spans only those that the classifier adds can overlap others of their kind.
    return found.withColumn("found", F.expr(accepted)).withColumn(
        "found", F.expr("filter(found, (s, i) -> s.base or not exists(slice(found, 1, i), z -> z.kind = s.kind and z.end > s.start and z.start < s.end))")
    )


def personal_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs``, with its column text, and ``found``, the accepted spans; text is not null after it.

    Spans are by kind, then start; positions are code points, the end exclusive.  A null
    or empty text has none; rows that are equal or repeat an id are rows each; other
    columns stay as they are.  Without text the candidates are found once and kept in a
    checkpoint; with it they are found again, as texts would be most of the checkpoint.
    """
    found = candidates(docs)
    if not with_text:
        found = settle(found.drop("text"))
        return decided(found, train(vote_counts(found)))
    return decided(found, train(vote_counts(candidates(docs.select("text")))))


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and all spans as text."""
    joined = lambda a: f"array_join(transform({a}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(found, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(F.expr(joined("filter(found, s -> s.base)")), 256).alias("base_sha256"), F.expr(joined("found")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in text replaced by its kind in brackets, n_chars renewed.

    Overlapping spans are replaced once, by the first of them.
    """
    # The document is carried whole, so no column of it can clash with the work columns.
    x = personal_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text"))
    step = """aggregate(array_sort(transform(found, s -> struct(s.start as start, s.end as end, s.kind as kind))),
        struct(0 as pos, cast(array() as array<string>) as parts),
        (a, s) -> if(s.start < a.pos, struct(greatest(a.pos, s.end) as pos, a.parts as parts),
          struct(s.end as pos, concat(a.parts, array(substring(text, a.pos + 1, s.start - a.pos), concat('[', upper(s.kind), ']'))) as parts)),
        a -> concat(array_join(a.parts, ''), substring(text, a.pos + 1)))"""
    x = x.withColumn("text", F.when(F.size("found") > 0, F.expr(step)).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return x.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
