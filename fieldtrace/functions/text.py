"""Labels, clocks and routing of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(us: Column) -> Column:
    """mm:ss.ss of a time in microseconds."""
    hundredths = F.floor(us / 10_000)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(pad(F.floor(hundredths / 6000)), F.lit(":"), pad(F.floor(hundredths / 100) % 60), F.lit("."), pad(hundredths % 100))


def long_id(role: Column, team: Column, number: Column) -> Column:
    """Identity names by role: GK-1, A-07, B-12."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return F.when(role == "GOALKEEPER", F.concat(F.lit("GK-"), number.cast("string"))).otherwise(F.concat(team, F.lit("-"), padded))


def parsed_id(text: Column) -> tuple[Column, Column]:
    """(prefix, number) of an identity name, nulls if it is none."""
    prefix, number = F.regexp_extract(text, r"^(REF|GK|A|B)-(\d+)$", 1), F.regexp_extract(text, r"^(REF|GK|A|B)-(\d+)$", 2)
    return F.when(prefix != "", prefix), F.when(number != "", number.cast("long"))


#: Fixed patterns; the first that a question matches names its topic.
ROUTES = (("distance", r"distance|most.*run"), ("defence", r"defen|issue|mark|lost|train"), ("press", r"press|regain"), ("wide", r"right|wide|overload"), ("goal", r"goal|attack|build"))


def topic(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("other")
    for name, pattern in reversed(ROUTES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return F.coalesce(out, F.lit("other"))
