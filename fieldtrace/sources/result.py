"""Recorded results and other stored inputs, shredded once into flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PERSON = "track long, box array<double>, cls string, zone string, evidence string, id string, display string, team string, role string, label string, state string, identityConfidence double, roleConfidence double, pitch array<double>, pitchConfidence double, pitchSource string, pitchClipped boolean"
ENTRY = "id string, display string, team string, role string, status string, confirmed boolean, retiredInto string"
def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in fields.split(", "))) + ">"


RESULT = (
    "version int, video struct<width: int, height: int, fps: double>, "
    f"frames array<struct<time: double, frame: long, calibrated: boolean, people: array<{_struct(PERSON)}>>>, "
    f"match struct<players: array<{_struct(ENTRY)}>, goalkeepers: array<{_struct(ENTRY)}>>, "
    "tactical struct<pitchSize: struct<length: double, width: double>>"
)


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one JSON object a file, with the file name as run; broken ones are kept apart
    in _corrupt_record."""
    return spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("run", F.input_file_name())


def roster(results: DataFrame) -> DataFrame:
    """Players and goalkeepers of a team; only an explicit confirmed = false keeps one out."""
    both = F.concat(F.coalesce("match.players", F.array()), F.coalesce("match.goalkeepers", F.array()))
    e = results.select("run", F.explode(both).alias("e")).select("run", "e.*")
    return e.where(F.col("id").isNotNull() & F.col("team").isin("A", "B") & ~F.col("confirmed").eqNullSafe(False)).select("run", "id", "team", "role", "display").dropDuplicates(["run", "id"])


def observations(results: DataFrame) -> DataFrame:
    """One row per person and frame, in the integer columns that the operators take."""
    f = results.select("run", F.posexplode("frames").alias("frame_idx", "f"))
    p = f.select("run", F.col("frame_idx").cast("long"), F.col("f.time").alias("time"), F.posexplode("f.people").alias("ord", "p"))
    scaled = lambda c, k: F.round(c * k).cast("long")
    x, y = F.get("p.pitch", 0), F.get("p.pitch", 1)
    known = roster(results).select("run", "id", F.lit(True).alias("in_roster"))
    o = p.select(
        "run",
        "frame_idx",
        (F.col("frame_idx") * 1000 + F.col("ord")).alias("ord"),
        F.col("p.id").alias("id"),
        F.col("p.track").alias("track"),
        scaled(F.col("time"), 1_000_000).alias("t_us"),
        scaled(x, 1000).alias("x_m"),
        scaled(y, 1000).alias("y_m"),
        F.col("p.state").alias("state"),
        scaled(F.coalesce("p.identityConfidence", F.lit(0.0)), 100).alias("identity_conf"),
        scaled(F.coalesce("p.pitchConfidence", F.lit(0.0)), 100).alias("pitch_conf"),
        F.coalesce("p.pitchClipped", F.lit(False)).alias("clipped"),
        F.col("p.team").alias("team"),
        F.col("p.role").alias("role"),
    )
    return o.join(known, ["run", "id"], "left").withColumn("in_roster", F.coalesce("in_roster", F.lit(False)))


#: Seconds between two frames of a wide tracking file; a fixed value.
STEP_S = 0.04


def wide_tracking(spark: SparkSession, path: str, players: list[str]) -> DataFrame:
    """A wide tracking CSV (three header rows; period, frame, time, then x and y per player) as
    long rows; '' and NaN are null, and where a period starts its clock anew, time goes on by one step."""
    names = ["period", "frame", "time"] + [f"{a}_{i}" for i in range(len(players)) for a in "xy"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("mode", "PERMISSIVE").csv(path)
    num = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    rows = raw.where(F.col("frame").rlike(r"^\d+$")).select(F.col("period").cast("int"), F.col("frame").cast("long"), num("time").alias("time"), *(num(c).alias(c) for c in names[3:]))
    w = Window.orderBy("period", "frame").partitionBy(F.input_file_name())
    back = F.when(F.col("time") <= F.lag("time").over(w), F.lag("time").over(w) - F.col("time") + STEP_S).otherwise(0.0)
    rows = rows.withColumn("back", back).withColumn("time", F.col("time") + F.sum("back").over(w)).drop("back")
    cells = F.array(*(F.struct(F.lit(p).alias("player"), F.col(f"x_{i}").alias("x"), F.col(f"y_{i}").alias("y")) for i, p in enumerate(players)))
    return rows.select("period", "frame", "time", F.explode(cells).alias("c")).select("period", "frame", "time", "c.*")


def annotation_counts(spark: SparkSession, path: str) -> DataFrame:
    """Hand counts {video: {time: {count, uncertainty}}}; keys that start with _ are notes."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("video", "body"))
    inner = doc.where(~F.col("video").startswith("_")).select("video", F.explode(F.from_json("body", "map<string, struct<count: int, uncertainty: int>>")).alias("stamp", "c"))
    return inner.select("video", F.col("stamp").cast("double").alias("time"), "c.count", "c.uncertainty")


def kv_rows(records: DataFrame, owner: str) -> DataFrame:
    """Records of an owner but tracking documents, newest first, latest version of each id only."""
    turn = F.row_number().over(Window.partitionBy("id", "owner").orderBy(F.desc("created")))
    r = records.where((F.col("owner") == owner) & (F.col("kind") != "tracking")).withColumn("turn", turn).where("turn = 1")
    return r.select("id", "kind", "data", "created").orderBy(F.desc("created"), "id")


def kv_get(records: DataFrame, key: str, owner: str, kind: str) -> DataFrame:
    """The latest record of an id, owner and kind."""
    return records.where((F.col("id") == key) & (F.col("owner") == owner) & (F.col("kind") == kind)).orderBy(F.desc("created")).limit(1)


def inserted_or_ignored(records: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the new records whose id is not there yet."""
    return records.unionByName(new.join(records.select("id"), "id", "left_anti").select(records.columns))


def replaced_at(records: DataFrame, new: DataFrame) -> DataFrame:
    """Compare and set: a new record (with ``expected``, a revision) replaces that of its id and owner
    only if the document there has the expected revision."""
    now = records.select("id", "owner", F.get_json_object("data", "$.revision").cast("long").alias("now"))
    ok = new.join(now, ["id", "owner"]).where(F.col("now") == F.col("expected")).select(*records.columns)
    return records.join(ok.select("id", "owner"), ["id", "owner"], "left_anti").select(records.columns).unionByName(ok)


def deleted(records: DataFrame, owner: str, keys: DataFrame) -> DataFrame:
    """Records without those of the owner whose id is in ``keys``."""
    return records.join(keys.select("id").distinct().withColumn("owner", F.lit(owner)), ["id", "owner"], "left_anti").select(records.columns)


def run_documents(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The JSON documents ``name`` of all run folders below ``folder``, with the run; none is no error."""
    wanted = StructType.fromDDL(schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(folder)
    body = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.from_json(F.decode("content", "UTF-8"), wanted).alias("d"))
    return body.select("run", *(F.col(f"d.{f.name}") for f in wanted.fields))


_ANCHOR = "index long, time double, H string, observability double, source string, details string, root long"
_STEP = "t double, dt double, M string, reliable boolean, cut boolean, quality string"
REGISTRATION = f"anchors array<{_struct(_ANCHOR)}>, frames array<{_struct(_STEP)}>"


def _matrix(text: Column) -> Column:
    """Nine numbers, row by row, of a 3 x 3 matrix written flat or nested; null if there are not nine."""
    flat = F.when(text.rlike(r"^\s*\[\s*\["), F.flatten(F.from_json(text, "array<array<double>>"))).otherwise(F.from_json(text, "array<double>"))
    return F.when((F.size(flat) == 9) & F.forall(flat, lambda x: x.isNotNull()), flat)


def registration_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of the registration records of all runs: run, index, time, H, observability, source, details (JSON), root.

    An anchor without a root is its own.
    """
    a = run_documents(spark, folder, "registration.json", REGISTRATION).select("run", F.explode("anchors").alias("a"))
    return a.select("run", "a.index", "a.time", _matrix(F.col("a.H")).alias("H"), "a.observability", "a.source", F.coalesce("a.details", F.lit("{}")).alias("details"), F.coalesce("a.root", "a.index").alias("root"))


def registration_log(spark: SparkSession, folder: str) -> DataFrame:
    """Frame-to-frame motions of those records: run, frame_idx, t, dt, M (null: none), reliable, cut, quality ('none' if unsaid)."""
    f = run_documents(spark, folder, "registration.json", REGISTRATION).select("run", F.posexplode("frames").alias("frame_idx", "f"))
    quality = F.when(F.length("f.quality") > 0, F.col("f.quality")).otherwise("none")
    return f.select("run", F.col("frame_idx").cast("long"), "f.t", "f.dt", _matrix(F.col("f.M")).alias("M"), "f.reliable", "f.cut", quality.alias("quality"))


def recorded_motion(spark: SparkSession, folder: str) -> DataFrame:
    """Motions of results that store one for each frame: run, frame_idx, M, reliable, cut.

    Six numbers are the upper rows of an affine 3 x 3 matrix; a frame with none has no motion
    and is not reliable.  Results in which a frame lacks the field give no rows, as their
    motion has to come from elsewhere; a field that is null is there.
    """
    f = run_documents(spark, folder, "result.json", "frames array<map<string, string>>").select("run", "frames").where(F.forall("frames", lambda x: F.map_contains_key(x, "motion")))
    m = F.from_json(F.col("f")["motion"], "array<double>")
    full = F.when((F.size(m) == 6) & F.forall(m, lambda x: x.isNotNull()), F.concat(m, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))))
    yes = lambda name: F.coalesce(F.col("f")[name] == "true", F.lit(False))
    r = f.select("run", F.posexplode("frames").alias("frame_idx", "f")).select("run", F.col("frame_idx").cast("long"), full.alias("M"), yes("cameraReliable").alias("reliable"), yes("cut").alias("cut"))
    return r.withColumn("reliable", F.col("reliable") & F.col("M").isNotNull())


def ball_negatives(spark: SparkSession, folder: str, least: float = 0.5, every: int = 3) -> DataFrame:
    """Rejected candidates and observed balls of every third frame, to train a detector on: run, frame_idx, time, frame, reason, det, box.

    Candidates count from ``least`` on; what a candidate without a reason is called is
    "candidate", a tracked and observed ball "positives".  Pictures are cut elsewhere.
    """
    found = "box: array<double>, det: double, status: string, reason: string, detector: double, visual: double, state: string, observed: boolean"
    d = run_documents(spark, folder, "result.json", f"frames array<struct<time: double, frame: long, ballCandidates: array<struct<{found}>>, ball: struct<{found}>>>")
    f = d.select("run", F.posexplode("frames").alias("frame_idx", "f")).where(F.col("frame_idx") % every == 0)
    rejected = f.select("*", F.explode("f.ballCandidates").alias("c")).where(~F.col("c.status").eqNullSafe("ball") & (F.coalesce("c.det", F.lit(0.0)) >= least))
    seen = f.where((F.col("f.ball.state") == "TRACKED") & F.col("f.ball.observed") & (F.size("f.ball.box") > 0))
    base = ["run", F.col("frame_idx").cast("long"), "f.time", "f.frame"]
    named = F.when(F.length("c.reason") > 0, F.col("c.reason")).otherwise("candidate")
    return rejected.select(*base, named.alias("reason"), "c.det", "c.box").unionByName(seen.select(*base, F.lit("positives").alias("reason"), F.coalesce("f.ball.detector", "f.ball.visual", F.lit(1.0)).alias("det"), F.col("f.ball.box").alias("box")))


def uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, modified) of the files of a folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "name")


def at_revision(records: DataFrame, revision: int) -> DataFrame:
    """Records whose JSON document has the revision."""
    return records.where(F.get_json_object("data", "$.revision").cast("long") == revision)


def upserted(records: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update by id; an update by another owner is ignored."""
    owners = records.select("id", F.col("owner").alias("first_owner")).dropDuplicates(["id"])
    ok = new.join(owners, "id", "left").where(F.col("first_owner").isNull() | (F.col("first_owner") == F.col("owner"))).drop("first_owner")
    return records.join(ok.select("id"), "id", "left_anti").unionByName(ok)


def flattened(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(schema, at: str, name: str) -> list[Column]:
        out = []
        for f in schema.fields:
            path, label = f"{at}`{f.name}`", f"{name}{f.name}"
            if f.dataType.typeName() == "struct":
                out += walk(f.dataType, path + ".", label + sep)
            else:
                out.append(F.col(path).alias(label))
        return out

    return df.select(*walk(df.schema, "", ""))


def exported(chunks: list[DataFrame]) -> DataFrame:
    """All chunks together; of rows with equal (local_id, t_us) the last chunk's stays."""
    both = reduce(lambda a, b: a.unionByName(b), (c.withColumn("chunk", F.lit(k)) for k, c in enumerate(chunks)))
    turn = F.row_number().over(Window.partitionBy("local_id", "t_us").orderBy(F.desc("chunk")))
    return both.withColumn("turn", turn).where("turn = 1").drop("turn", "chunk")


def write_result(df: DataFrame, path: str, partition: list[str] | None = None, kind: str = "parquet", append: bool = False) -> None:
    """Parquet or JSON sink; Spark's commit makes the files appear whole or not at all."""
    w = df.write.mode("append" if append else "overwrite").format(kind)
    (w.partitionBy(*partition) if partition else w).save(path)
