"""Recorder files: XML event lists, and text recordings (plain or in zip archives) as frames of telemetry.

Numbering and carried values go by blocks of lines, so a long recording is not one task; only unpacking an archive is.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.operators import scans

#: What a missing attribute is called, and the slots of a telemetry record in order.
UNKNOWN, UNKNOWN_WEAPON = "Unknown", "Unknown Weapon"
SLOTS = ("lon", "lat", "alt", "roll", "pitch", "yaw")
ATTRIBUTES = ("name", "pilot", "coalition", "country", "group")

_XML = """Time STRING, Location STRUCT<Longitude: STRING, Latitude: STRING, Altitude: STRING>,
    PrimaryObject STRUCT<_ID: STRING, Type: STRING, Name: STRING, Pilot: STRING, Coalition: STRING, Country: STRING, Group: STRING>,
    SecondaryObject STRUCT<_ID: STRING, Name: STRING>, Action STRING"""


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of the recordings at ``path`` (a file, a folder, a pattern): ``recording`` (the file), ``seq, t, lon, lat, alt, obj_id, type, action``, the object's attributes, ``side`` (its
    coalition), ``weapon_id, weapon_name, launch``.

    ``seq`` increases in the order of a recording's document: where the split that a row is read in begins, and the row's place
    in its task, which is less than a split is long. Events without a number for time or a coordinate, or without an object, are left
    out. An attribute whose element is missing is ``Unknown``; one whose element is empty is null.
    """
    x = spark.read.format("xml").option("rowTag", "Event").schema(_XML).load(path)
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    x = x.select("*", F.col("_metadata.file_path").alias("recording"), place.alias("seq"))
    number = lambda c: F.col(c).try_cast("double")
    known = lambda c, other: F.when(F.col(c).isNull(), F.lit(other)).otherwise(F.nullif(F.col(c), F.lit("")))
    fired = F.coalesce((F.col("Action") == "HasFired") & F.col("SecondaryObject").isNotNull(), F.lit(False))
    out = x.where("PrimaryObject is not null").select(
        "recording",
        "seq",
        number("Time").alias("t"),
        number("Location.Longitude").alias("lon"),
        number("Location.Latitude").alias("lat"),
        number("Location.Altitude").alias("alt"),
        F.col("PrimaryObject._ID").alias("obj_id"),
        F.nullif(F.col("PrimaryObject.Type"), F.lit("")).alias("type"),
        F.nullif(F.col("Action"), F.lit("")).alias("action"),
        *[known(f"PrimaryObject.{a.capitalize()}", UNKNOWN).alias(a) for a in ATTRIBUTES],
        F.col("SecondaryObject._ID").alias("weapon_id"),
        F.when(fired, known("SecondaryObject.Name", UNKNOWN_WEAPON)).alias("weapon_name"),
        fired.alias("launch"),
    )
    return out.dropna(subset=["t", "lon", "lat", "alt"]).withColumn("side", F.col("coalition"))


def read_recordings(spark: SparkSession, path: str, lines_per_batch: int = 20_000) -> DataFrame:
    """``file, line_no, line, error`` of text recordings: plain files, or the first recording in each zip archive.

    Lines are stripped, bytes that are no UTF-8 ignored. A broken archive, or one without a recording, gives one row with
    null line and what is wrong.
    """

    def opened(content: bytes):
        if content[:2] != b"PK":
            return io.BytesIO(content)
        archive = zipfile.ZipFile(io.BytesIO(content))
        names = [n for n in archive.namelist() if n.endswith(".acmi")]
        if not names:
            raise zipfile.BadZipFile("no recording in the archive")
        return archive.open(names[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                held, first = [], 0
                try:
                    for raw in opened(content):
                        held.append(raw.decode("utf-8", "ignore").strip())
                        if len(held) == lines_per_batch:
                            yield pd.DataFrame({"file": file, "line_no": range(first, first + len(held)), "line": held, "error": None})
                            held, first = [], first + len(held)
                    if held:
                        yield pd.DataFrame({"file": file, "line_no": range(first, first + len(held)), "line": held, "error": None})
                except (zipfile.BadZipFile, EOFError) as e:
                    yield pd.DataFrame({"file": [file], "line_no": [first], "line": [None], "error": [str(e)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, line_no long, line string, error string")


def _record(line: Column, partial: bool) -> Column:
    """``obj_id`` and the six numbers of a line's last telemetry part; null without a usable one."""
    parts = F.split(line, ",", -1)
    last = F.try_element_at(F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p.startswith("T=")), F.lit(-1))
    slots = F.split(F.substr(last, F.lit(3)), r"\|", -1)
    slot = lambda i: F.when(F.coalesce(F.get(slots, F.lit(i)), F.lit("")) == "", F.lit(0.0)).otherwise(F.get(slots, F.lit(i)).try_cast("double"))
    read = [slot(i) for i in range(len(SLOTS))]
    before = [F.when(F.forall(F.array(*read[: i + 1]), lambda v: v.isNotNull()), read[i]).alias(n) for i, n in enumerate(SLOTS)]
    needed = before[0] if partial else before[-1]
    return F.when(last.isNotNull() & needed.isNotNull(), F.struct(F.get(parts, F.lit(0)).alias("obj_id"), *before))


def _framed(lines: DataFrame, block: int) -> DataFrame:
    """The lines of finished frames, marks left out, with ``frame_no, frame_t``."""
    x = lines.where("line is not null").withColumn("mark", F.col("line").startswith("#"))
    x = x.withColumn("at", F.when(F.col("mark"), F.substr("line", F.lit(2)).try_cast("double")))
    marks = x.groupBy("file").agg(F.count_if("mark").alias("marks"))
    running = {"frame_no": scans.Running("sum", F.col("mark").cast("long")), "frame_t": scans.Running("last", F.col("at"))}
    x = scans.scan(x, ["file"], ["line_no"], scans.blocks_of("line_no", block), **running)
    return x.join(marks, "file").where("not mark and frame_no < marks")


def frames(lines: DataFrame, block: int = 4096) -> DataFrame:
    """``file, frame_no, frame_t, n_lines`` of the frames that are finished and hold a line, of whatever kind."""
    return _framed(lines, block).groupBy("file", "frame_no").agg(F.first("frame_t").alias("frame_t"), F.count(F.lit(1)).alias("n_lines"))


def telemetry(lines: DataFrame, block: int = 4096, partial: bool = False) -> DataFrame:
    """``file, frame_no, frame_t, line_no, obj_id`` and six numbers: the records of all finished frames.

    A line ``#seconds`` begins a frame, which the next such line finishes; what follows the last one is left out. Blank
    and missing slots are 0. A record with a slot that is no number is left out whole; with ``partial`` the slots before
    that one count and the others are null.
    """
    x = _framed(lines, block).withColumn("r", _record(F.col("line"), partial))
    return x.where("r is not null").select("file", "frame_no", "frame_t", "line_no", "r.*")


def ego_frames(records: DataFrame, frames: DataFrame, ego: str) -> DataFrame:
    """``file, frame_no, ego, agent_id, agent_no, agent``: feature tokens of every other object known by a frame, against
    the ego; one row with null agent for a frame in which only the ego is known. ``frames``: see :func:`frames`.

    An object's state holds from its record until the next (a null slot keeps its last value); it is an interval of frame
    numbers, of which those of frames that hold a line count. ``agent_no`` numbers a file's other objects as first met.
    """
    w = Window.partitionBy("file", "obj_id").orderBy("frame_no")
    held = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in SLOTS]
    state = records.groupBy("file", "obj_id", "frame_no").agg(*slots, F.min("line_no").alias("line_no"))
    state = state.select("file", "obj_id", "frame_no", "line_no", F.struct(*[F.last(n, True).over(held).alias(n) for n in SLOTS]).alias("s"), F.lead("frame_no").over(w).alias("until"))
    last = frames.groupBy("file").agg(F.max("frame_no").alias("last_frame"))
    met = state.where(F.col("obj_id") != ego).groupBy("file", "obj_id").agg(F.min("line_no").alias("line_no"))
    met = met.select(F.col("file").alias("f"), F.col("obj_id").alias("o"), F.row_number().over(Window.partitionBy("file").orderBy("line_no")).alias("agent_no"))
    each = state.join(last, "file").withColumn("frame_no", F.explode(F.sequence("frame_no", F.coalesce(F.col("until") - 1, F.col("last_frame")))))
    each = each.join(frames.select("file", "frame_no"), ["file", "frame_no"], "left_semi")
    own = each.where(F.col("obj_id") == ego).select("file", "frame_no", F.col("s").alias("e"))
    others = each.where(F.col("obj_id") != ego).join(met, (F.col("file") == F.col("f")) & (F.col("obj_id") == F.col("o"))).select("file", "frame_no", F.col("obj_id").alias("agent_id"), "agent_no", "s")
    zeros = [F.lit(0.0)] * 3
    token = F.array(F.lit(0.0), F.lit(0.0), *[F.col(f"e.{n}") for n in SLOTS[2:]], *zeros).cast("array<float>")
    delta = F.when(F.col("s").isNotNull(), F.array(*[F.col(f"s.{n}") - F.col(f"e.{n}") for n in SLOTS], *zeros).cast("array<float>"))
    return own.join(others, ["file", "frame_no"], "left").select("file", "frame_no", token.alias("ego"), "agent_id", "agent_no", delta.alias("agent"))
