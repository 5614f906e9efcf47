"""Sinks: one SRT or JSON file per document, written to a temporary name and renamed; stage events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_fragment


# The version of the JSON layout, and the file of each stage.
JSON_VERSION = "1.0"
STAGE_FILES = {
    "audio-loader": "00_audio_load.json", "whisper": "01_whisper.json", "whisperx-alignment": "02_align.json", "qwen-repair": "03_repair.json",
    "homophone-resolution": "04_homophone_resolution.json", "sentence-boundary-resolution": "05_sentence_boundary_resolution.json", "subtitle-builder": "06_build.json",
    "subtitle-merger": "07_merge.json", "readability-optimizer": "08_readability.json", "subtitle-validator": "09_validate.json", "subtitle-writer": "10_write.json",
}


def timed(x, **more: Column) -> Column:
    """Text, speaker and range of a row or struct, with its duration, as the JSON has them."""
    return F.struct(x("text").alias("text"), x("speaker_id").alias("speaker_id"), x("start").alias("start_seconds"), x("end").alias("end_seconds"), (x("end") - x("start")).alias("duration_seconds"), *[c.alias(k) for k, c in more.items()])


def listening_documents(paths: DataFrame, segments: DataFrame, cues: DataFrame, key: str = "doc_id") -> DataFrame:
    """paths(doc_id, source_path, output_path, run_id) with ``json``: nested segments and cues of each document; nulls are kept."""

    def words(s):
        return F.transform(s["words"], lambda w: F.struct(w["text"].alias("text"), w["speaker_id"].alias("speaker_id"), w["confidence"].alias("confidence"), w["start"].alias("start_seconds"), w["end"].alias("end_seconds"), (w["end"] - w["start"]).alias("duration_seconds")))

    sentences = F.transform("sentences", lambda s: timed(s.getField, words=words(s)))
    body = timed(F.col)
    segment = F.struct(F.col("position"), *[body[c].alias(c) for c in ("text", "speaker_id", "start_seconds", "end_seconds", "duration_seconds")], sentences.alias("sentences"))
    cue = F.struct(F.col("index"), *[body[c].alias(c) for c in ("text", "speaker_id", "start_seconds", "end_seconds", "duration_seconds")])
    s = segments.select(key, "position", segment.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", F.to_json("r", {"ignoreNullFields": "false"}).alias("r")))).alias("s"))
    c = cues.select(key, "index", cue.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", F.to_json("r", {"ignoreNullFields": "false"}).alias("r")))).alias("c"))

    def listed(a):
        return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(a, lambda x: x["r"]), ","), F.lit("")), F.lit("]"))

    head = F.to_json(F.struct(F.lit(JSON_VERSION).alias("schema_version"), "source_path", "output_path", "run_id"), {"ignoreNullFields": "false"})
    whole = F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"segments":'), listed(F.col("s")), F.lit(',"subtitles":'), listed(F.col("c")), F.lit("}"))
    return paths.join(s, key, "left").join(c, key, "left").withColumn("_h", head).withColumn("json", whole).drop("_h", "s", "c")


def json_value(df: DataFrame, binary: tuple[str, ...] = ()) -> Column:
    """A row as JSON with sorted keys; bytes are told by their number only."""
    sizes = {c: F.when(F.col(c).isNotNull(), F.struct(F.octet_length(c).alias("size_bytes"), F.lit("bytes").alias("type"))) for c in binary}
    return F.to_json(F.struct(*[sizes.get(c, F.col(f"`{c}`")).alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def stage_file(stage: str) -> str:
    """The artifact file of a stage."""
    if stage in STAGE_FILES:
        return STAGE_FILES[stage]
    name = re.sub(r"[^A-Za-z0-9_.-]+", "_", stage.replace("-", "_").strip()).strip("._")
    if not name:
        raise ValueError("a stage needs a name")
    return f"{name}.json"


def write_files(df: DataFrame, folder: str, name: str, text: str) -> None:
    """Writes each row's text to ``folder/name`` from its executor, through the file system of the folder.

    The folder must be one that executors share. A file appears under its name only when it is whole. A null text is
    an error.
    """

    def put(rows):
        import os

        for r in rows:
            path = os.path.join(folder, r[name])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".tmp", "w", encoding="utf-8", newline="") as f:
                if r[text] is None:
                    raise ValueError(f"nothing to write for {r[name]}")
                f.write(r[text])
            os.replace(path + ".tmp", path)

    df.select(name, text).foreachPartition(put)


def latest_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last recorded event of each key (ties: the greater stage name)."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("stage", "status", "elapsed", "message"), F.struct("recorded_at", "stage")).alias("e")).select(*keys, "e.*")


def artifact_files(events: DataFrame, run: str) -> DataFrame:
    """(name, json) of events(source, output, file_index, file_total, stage, status, elapsed, message, recorded_at): the last status of each stage of a document, and a manifest of each."""
    stem = path_fragment(F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]+$", ""))
    known = F.create_map(*[F.lit(x) for kv in STAGE_FILES.items() for x in kv])
    other = F.concat(path_fragment(F.replace(F.col("stage"), F.lit("-"), F.lit("_"))), F.lit(".json"))
    rows = events.withColumns({"run_name": F.lit(run), "folder": F.concat(F.lit(run + "/"), stem), "file": F.coalesce(F.element_at(known, F.col("stage")), other)})
    mine = ("run_name", "source", "output", "file_index", "file_total", "stage", "status", "elapsed", "message", "recorded_at")
    body = F.to_json(F.struct(*sorted(mine)), {"ignoreNullFields": "false"})
    stages = rows.withColumn("json", body).groupBy("folder", "file").agg(F.max_by("json", "recorded_at").alias("json")).select(F.concat_ws("/", "folder", "file").alias("name"), "json")
    last = F.to_json(F.struct("file_index", "file_total", "output", "run_name", "source", F.col("stage").alias("current_stage"), F.concat_ws("/", "folder", "file").alias("stage_artifact_path"), "status", F.col("recorded_at").alias("updated_at")), {"ignoreNullFields": "false"})
    manifests = rows.withColumn("json", last).groupBy("folder").agg(F.max_by("json", F.struct("recorded_at", "file")).alias("json")).select(F.concat("folder", F.lit("/manifest.json")).alias("name"), "json")
    return stages.unionByName(manifests)


def write_all(documents: DataFrame, folder: str, formats: dict[str, str]) -> list[str]:
    """Writes each document once for every format (suffix: column), the first being the primary; documents(stem, columns) is read once for each."""
    for suffix, column in formats.items():
        write_files(documents.withColumn("_name", F.concat("stem", F.lit(suffix))), folder, "_name", column)
    return list(formats)


def quiet(event: dict) -> None:
    """Takes the events of a run and says nothing."""
    if not isinstance(event, dict):
        raise TypeError("an event is a dictionary")


def console_line(file_index: Column, file_total: Column, source: Column, stage: Column, status: Column, elapsed: Column, artifact: Column, message: Column) -> Column:
    """One line of progress for a stage event."""
    head = F.concat(F.lit("["), file_index.cast("string"), F.lit("/"), file_total.cast("string"), F.lit("] "), source, F.lit(" "), stage)
    took = F.coalesce(F.concat(F.lit(" "), F.format_string("%.2f", elapsed), F.lit("s")), F.lit(""))
    said = F.when(F.coalesce(message, F.lit("")) != "", F.concat(F.lit(": "), message)).otherwise(F.lit(""))
    where = F.coalesce(F.concat(F.lit(" -> "), artifact), F.lit(""))
    total = F.concat(F.lit(" "), F.format_string("%.2f", F.coalesce(elapsed, F.lit(0.0))), F.lit("s"))
    whole = F.when(status == "succeeded", F.concat(head, F.lit(" done"), total)).otherwise(F.concat(head, F.lit(" failed"), total, said))
    part = F.when(status == "started", F.concat(head, F.lit(" started"))).when(status == "succeeded", F.concat(head, F.lit(" done"), took, where)).otherwise(F.concat(head, F.lit(" failed"), took, said, where))
    return F.when(stage == "pipeline-total", whole).otherwise(part)
