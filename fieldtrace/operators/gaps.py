"""As-of positions, gaps, and estimates between and beyond observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .samples import squared_step

INTERPOLATE_US, HOLD_US, SAME_US = 1_000_000, 600_000, 10_000
PREDICT_US = 25_000_000


def positions_at(samples: DataFrame, times: DataFrame) -> DataFrame:
    """Where each identity is at each asked time (id, t_us): OBSERVED within the tolerance,
    INTERPOLATED over a short gap, HELD for a while after the last sample, else nothing.

    Samples and asked times are sorted together once per identity; the neighbours are
    the last and next non-null sample.
    """
    s = samples.select("id", "t_us", F.lit(0).alias("side"), F.struct("t_us", "x_m", "y_m").alias("at"))
    q = times.select("id", "t_us", F.lit(1).alias("side"), F.lit(None).cast(s.schema["at"].dataType).alias("at"))
    w = Window.partitionBy("id").orderBy("t_us", "side")
    both = s.unionByName(q)
    both = both.withColumns({"p": F.last("at", ignorenulls=True).over(w), "n": F.first("at", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    t, p, n = F.col("t_us"), F.col("p"), F.col("n")
    gap = n["t_us"] - p["t_us"]
    kind = (
        F.when(t - p["t_us"] <= SAME_US, "OBSERVED").when(n["t_us"] - t <= SAME_US, "OBSERVED_NEXT").when(gap <= INTERPOLATE_US, "INTERPOLATED").when(t - p["t_us"] <= HOLD_US, "HELD")
    )
    blend = lambda c: p[c] + (n[c] - p[c]) * ((t - p["t_us"]) / gap)
    place = lambda c: F.when(kind.isin("OBSERVED", "HELD"), p[c].cast("double")).when(kind == "OBSERVED_NEXT", n[c].cast("double")).when(kind == "INTERPOLATED", blend(c))
    return both.where("side = 1").select("id", "t_us", F.when(kind == "OBSERVED_NEXT", "OBSERVED").otherwise(kind).alias("kind"), place("x_m").alias("x"), place("y_m").alias("y"))


def nearest(points: DataFrame, asked: DataFrame, tolerance: int) -> DataFrame:
    """The point nearest in time to each asked time (id, q_us) within the tolerance; of equal
    distances the later row wins.  Buckets of the tolerance make it an equi-join."""
    p = points.withColumn("bucket", F.floor(F.col("t_us") / tolerance))
    q = asked.withColumn("bucket", F.explode(F.expr(f"transform(array(-1, 0, 1), k -> floor(q_us / {tolerance}) + k)")))
    j = q.join(p, ["id", "bucket"]).withColumn("off", F.abs(F.col("t_us") - F.col("q_us"))).where(F.col("off") <= tolerance)
    best = F.row_number().over(Window.partitionBy("id", "q_us").orderBy("off", F.desc("ord")))
    return j.withColumn("turn", best).where("turn = 1").select("id", "q_us", "ord", "t_us", "off")


def bridged(samples: DataFrame, most: int, step: int) -> DataFrame:
    """Straight lines over gaps of at most ``most`` between neighbouring samples, at every ``step``."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    s = samples.withColumns({"t1": F.lead("t_us").over(w), "x1": F.lead("x_m").over(w), "y1": F.lead("y_m").over(w)})
    s = s.where((F.col("t1") - F.col("t_us") <= most) & (F.col("t1") - F.col("t_us") > step))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("t1") - F.col("t_us") - 1) / step))))
    share = F.col("k") * step / (F.col("t1") - F.col("t_us"))
    return s.select("id", (F.col("t_us") + F.col("k") * step).alias("t_us"), (F.col("x_m") + (F.col("x1") - F.col("x_m")) * share).alias("x"), (F.col("y_m") + (F.col("y1") - F.col("y_m")) * share).alias("y"))


def on_grid(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """(id, step) for every step of the grid, with the sample of that step or nulls."""
    ids = samples.select("id", "team").distinct()
    return ids.join(grid, "team").join(samples.select("id", "step", "x_m", "y_m"), ["id", "step"], "left")


def carried(cells: DataFrame) -> DataFrame:
    """Last observed position carried forward, with its age in steps, and the next one's age."""
    w = Window.partitionBy("id").orderBy("step")
    seen = F.when(F.col("x_m").isNotNull(), F.struct("step", "x_m", "y_m"))
    c = cells.withColumns({"p": F.last(seen, ignorenulls=True).over(w), "n": F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    return c.select("id", "team", "step", "x_m", "y_m", "p", "n", (F.col("step") - F.col("p.step")).alias("age"), (F.col("n.step") - F.col("step")).alias("until"))


def imputed(cells: DataFrame, short: int = 2, far: int = 25) -> DataFrame:
    """Two-sided estimate: O observed, I between close neighbours, P predicted, U unknown.

    Between two observations the position is blended by inverse age; sigma grows with
    the nearer age.
    """
    c = carried(cells)
    p, n, a, u = F.col("p"), F.col("n"), F.col("age"), F.col("until")
    both = p.isNotNull() & n.isNotNull()
    near = F.least(F.coalesce(a, F.lit(1 << 30)), F.coalesce(u, F.lit(1 << 30)))
    kind = F.when(a == 0, "O").when(both & (a + u <= short), "I").when(near <= far, "P").otherwise("U")
    mean = lambda k: F.when(a == 0, p[k].cast("double")).when(both, (p[k] * u + n[k] * a) / (a + u)).otherwise(F.coalesce(p[k], n[k]).cast("double"))
    known = kind != "U"
    return c.select("id", "step", kind.alias("kind"), F.when(known, mean("x_m")).alias("x"), F.when(known, mean("y_m")).alias("y"), F.when(known, near).alias("near"))


def age_bucket(age: Column) -> Column:
    return F.when(age < 1, "0-1").when(age < 3, "1-3").when(age < 8, "3-8").when(age < 20, "8-20").otherwise(">20")


def centres(samples: DataFrame, least: int = 4) -> DataFrame:
    """Centre of a team in a frame, inverse-variance weighted (confidence squared), of at
    least ``least`` voters."""
    w = F.col("pitch_conf") * F.col("pitch_conf")
    g = samples.where("pitch_conf > 0").groupBy("team", "frame_idx").agg(F.count(F.lit(1)).alias("voters"), F.sum(w).alias("weight"), F.sum(F.col("x_m") * w).alias("wx"), F.sum(F.col("y_m") * w).alias("wy"))
    return g.where(F.col("voters") >= least).select("team", "frame_idx", "voters", (F.col("wx") / F.col("weight")).alias("x"), (F.col("wy") / F.col("weight")).alias("y"))


def jumps(breaks: DataFrame, speed: int = 12) -> DataFrame:
    """Steps faster than ``speed`` by the states at both ends."""
    w = Window.partitionBy("id").orderBy("t_us", "ord")
    b = breaks.withColumn("before", F.lag("kind").over(w)).where("before is not null and dt > 0")
    fast = F.col("square") * 1_000_000 > speed * speed * F.col("dt") * F.col("dt")
    return b.groupBy("before", "kind").agg(F.count(F.lit(1)).alias("steps"), F.count(F.when(fast, 1)).alias("fast"))


def upper_quantiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """Upper median sorted[n // 2] and sorted[int(.9 n) - 1], by rank and not by interpolation.

    Rows are counted by value first, so the window sorts distinct values only.
    """
    c = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("times"))
    r = c.withColumns({"upto": F.sum("times").over(Window.partitionBy(key).orderBy(value)), "n": F.sum("times").over(Window.partitionBy(key))})
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    return r.groupBy(key).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2) + 1).alias("median"), at(F.greatest(F.lit(1), F.floor(F.col("n") * 9 / 10))).alias("p90"))


def teleports(track: DataFrame, most_us: int, metres_per_s: int) -> DataFrame:
    """Steps of at most ``most_us`` faster than the speed, within islands that a lost state ends."""
    w = Window.partitionBy("track_key").orderBy("t_us", "ord")
    t = track.withColumn("island", F.sum(F.when(F.col("state") == "uncertain", 1).otherwise(0)).over(w)).where("state <> 'uncertain'")
    v = Window.partitionBy("track_key", "island").orderBy("t_us", "ord")
    dt = F.col("t_us") - F.lag("t_us").over(v)
    square = squared_step(F.col("x_m"), F.col("y_m"), F.lag("x_m").over(v), F.lag("y_m").over(v))
    t = t.withColumns({"dt": dt, "square": square})
    fast = (F.col("dt") > 0) & (F.col("dt") <= most_us) & (F.col("square") * 1_000_000 > metres_per_s**2 * F.col("dt") * F.col("dt"))
    return t.groupBy("track_key").agg(F.count(F.when(fast, 1)).alias("teleports"), F.count(F.lit(1)).alias("shown"))


def sampled(samples: DataFrame, times: DataFrame) -> DataFrame:
    """The whole answer of the sampler at each asked time (id, t_us) with a position: kind, source, x, y,
    confidence, sigma, alpha, quality.

    Samples have a kind (O or P) and perhaps a sigma.  Next to a predicted sample the answer
    is predicted; what is held fades, in confidence to nothing and in alpha to three tenths.
    """
    s = samples.select("id", "t_us", F.lit(0).alias("side"), "ord", F.struct("t_us", "x_m", "y_m", (F.col("identity_conf") / 100.0).alias("c"), (F.col("pitch_conf") / 100.0).alias("q"), "kind", "sigma").alias("at"))
    q = times.select("id", "t_us", F.lit(1).alias("side"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast(s.schema["at"].dataType).alias("at"))
    w = Window.partitionBy("id").orderBy("t_us", "side", "ord")
    down = Window.partitionBy("id").orderBy(F.desc("t_us"), F.desc("side"), "ord")
    both = s.unionByName(q).withColumns({"p": F.last("at", ignorenulls=True).over(w), "n": F.last("at", ignorenulls=True).over(down)})
    both = both.where("side = 1")
    t, p, n = F.col("t_us"), F.col("p"), F.col("n")
    gap, since = n["t_us"] - p["t_us"], t - p["t_us"]
    how = F.when(since <= SAME_US, 1).when(n["t_us"] - t <= SAME_US, 2).when(gap <= INTERPOLATE_US, 3).when(since <= HOLD_US, 4)
    x = both.withColumn("how", how).where("how is not null")
    how, fade = F.col("how"), since / HOLD_US
    either = (p["kind"] == "P") | (n["kind"] == "P")
    pick = lambda one, two, three, four: F.when(how == 1, one).when(how == 2, two).when(how == 3, three).otherwise(four)
    seen = lambda k: F.when(k["kind"] == "P", "PREDICTED").otherwise("OBSERVED")
    wide = F.greatest(F.coalesce(p["sigma"], F.lit(0.0)), F.coalesce(n["sigma"], F.lit(0.0)))
    at = lambda c: pick(p[c].cast("double"), n[c].cast("double"), p[c] + (n[c] - p[c]) * (since / gap), p[c].cast("double"))
    return x.select(
        "id",
        "t_us",
        pick(p["kind"], n["kind"], F.when(either, "P").otherwise("I"), p["kind"]).alias("kind"),
        pick(seen(p), seen(n), F.when(either, "PREDICTED").otherwise("INTERPOLATED"), F.lit("HELD")).alias("source"),
        at("x_m").alias("x"),
        at("y_m").alias("y"),
        pick(p["c"], n["c"], F.least(p["c"], n["c"]), p["c"] * (1 - fade)).alias("confidence"),
        pick(p["sigma"], n["sigma"], F.when(wide > 0, wide), p["sigma"]).alias("sigma"),
        F.when(how == 4, 1 - 0.7 * fade).otherwise(F.lit(1.0)).alias("alpha"),
        pick(p["q"], n["q"], F.least(p["q"], n["q"]), p["q"]).alias("quality"),
    )
