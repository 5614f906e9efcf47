"""The whole chain from recognised segments to files: stages over named tables, with issues, events and quarantine.

Every stage takes and returns a dictionary of tables; those whose inputs are absent are left out of the plan. Models
are tables (aligned rows, turns, scores) or columns (a repairer). With a work folder each stage's main table is
written there and read again, so that no stage is planned twice and its documents can be counted.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cues, homophone, nested, repair
from ..schema import SENTENCE, model_issues, row_issues, with_sentences
from ..sources import sinks, transcripts
from .workflow import StageFailed

Tables = dict[str, DataFrame]


@dataclass
class Options:
    """What a run is made of. Tables that are None leave their stage out; rules are parameters of the operators."""

    aligned: DataFrame | None = None
    turns: DataFrame | None = None
    repairer: Column | None = None
    homophones: dict | None = None  # morphemes, lexicon, scores, model and rules of homophone.resolve
    boundaries: bool = True
    merge: bool = True
    normalise: bool = True
    strict: bool = False
    boundary_rule: dict = field(default_factory=dict)
    merge_rule: dict = field(default_factory=dict)
    readability_rule: dict = field(default_factory=dict)


def plug_in(path: str) -> Callable:
    """A function named module:name, imported when it is asked for; says what is missing."""
    module, _, name = path.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise StageFailed(f"plug-in {path} is not installed") from e


def _align(t: Tables, o: Options) -> Tables:
    s = transcripts.aligned(o.aligned, t["segments"]) if o.aligned is not None else t["segments"]
    return t | {"segments": nested.by_speaker(s, o.turns) if o.turns is not None else s}


def _repair(t: Tables, o: Options) -> Tables:
    segments, decisions = repair.repair_segments(t["segments"], o.repairer)
    return t | {"segments": segments, "repair_decisions": decisions}


def _homophones(t: Tables, o: Options) -> Tables:
    rows = t["segments"].withColumn("sentences", with_sentences())
    flat = rows.select("doc_id", "position", F.posexplode("sentences").alias("sentence_index", "s")).select("doc_id", "position", "sentence_index", "s.*")
    new, decisions = homophone.resolve(flat, **o.homophones)
    one = F.struct("text", "start", "end", "speaker_id", "words")
    back = new.groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct("sentence_index", one.alias("s")))).alias("s")).select("doc_id", "position", F.transform("s", lambda x: x["s"]).cast(f"array<{SENTENCE}>").alias("_s"))
    touched = decisions.where("accepted").select("doc_id", "position").distinct().withColumn("_t", F.lit(True))
    out = t["segments"].join(back, ["doc_id", "position"]).join(touched, ["doc_id", "position"], "left")
    hit = F.col("_t").isNotNull()
    starts, ends = F.transform("_s", lambda x: x["start"]), F.transform("_s", lambda x: x["end"])
    out = out.withColumns({"text": F.when(hit, nested.joined(F.col("_s"))).otherwise(F.col("text")), "start": F.when(hit, F.array_min(starts)).otherwise(F.col("start")), "end": F.when(hit, F.array_max(ends)).otherwise(F.col("end")), "sentences": F.when(hit, F.col("_s")).otherwise(F.col("sentences"))})
    return t | {"segments": out.select(*t["segments"].columns), "homophone_decisions": decisions}


def _boundaries(t: Tables, o: Options) -> Tables:
    segments, decisions = nested.resolve_boundaries(t["segments"], **o.boundary_rule)
    return t | {"segments": segments, "boundary_decisions": decisions}


def issues_of(t: Tables) -> DataFrame:
    """(doc_id, code, location): constraints, duplicates, gaps and overlaps of segments and cues."""
    s, c = t["segments"].withColumn("ord", F.col("position")), t["cues"].withColumn("ord", F.col("index"))
    return model_issues(t["segments"]).unionByName(row_issues(c, "index", 1)).unionByName(cues.segment_issues(s)).unionByName(cues.cue_issues(c)).distinct()


def _validate(t: Tables, o: Options) -> Tables:
    issues = issues_of(t)
    if o.strict:
        first = issues.orderBy("doc_id", "code", "location").head(1)
        if first:
            raise StageFailed(f"{first[0]['code']} in document {first[0]['doc_id']}")
        return t | {"rejected": issues}
    bad = issues.select("doc_id").distinct()
    held = t["rejected"].unionByName(issues) if "rejected" in t else issues
    return t | {"rejected": held, "segments": t["segments"].join(bad, "doc_id", "left_anti"), "cues": t["cues"].join(bad, "doc_id", "left_anti")}


def stages(o: Options) -> list[tuple[str, str, Callable[[Tables, Options], Tables]]]:
    """(name, main table, function) of the stages that the options ask for, in order."""
    out = [("whisper", "segments", lambda t, _: t | {"segments": transcripts.recognised(t["raw"])} if "segments" not in t else t)]
    if o.aligned is not None or o.turns is not None:
        out.append(("whisperx-alignment", "segments", _align))
    if o.repairer is not None:
        out.append(("qwen-repair", "segments", _repair))
    if o.homophones is not None:
        out.append(("homophone-resolution", "segments", _homophones))
    if o.boundaries:
        out.append(("sentence-boundary-resolution", "segments", _boundaries))
    out.append(("subtitle-builder", "cues", lambda t, _: t | {"cues": cues.build_cues(t["segments"])}))
    if o.merge:
        out.append(("subtitle-merger", "cues", lambda t, o: t | {"cues": cues.merge_cues(t["cues"], **o.merge_rule)}))
    if o.normalise:
        out.append(("readability-optimizer", "cues", lambda t, o: t | {"cues": cues.normalise_cues(t["cues"], **o.readability_rule)}))
    return [*out, ("subtitle-validator", "cues", _validate)]


def run(tables: Tables, options: Options, observe: Callable[[dict], None] = sinks.quiet, work: str | None = None) -> Tables:
    """Runs the stages over ``raw`` rows or nested ``segments``. Documents that break a constraint are in ``rejected``, or raise if strict.

    ``documents(doc_id)``, if given, names all: those without segments at the start are rejected as ``missing_segments``.
    """
    if "segments" not in tables and "raw" not in tables:
        raise StageFailed("segments or raw rows are needed")
    for name, main, stage in stages(options):
        began, event = time.time(), {"stage": name, "message": ""}
        observe(event | {"status": "started", "elapsed": None})
        try:
            new = stage(tables, options)
            if work:
                path = f"{work.rstrip('/')}/{sinks.stage_file(name).removesuffix('.json')}"
                new[main].write.mode("overwrite").parquet(path)
                table = new[main].sparkSession.read.parquet(path)
                if name != "subtitle-validator" and main in tables and not tables[main].select("doc_id").join(table.select("doc_id"), "doc_id", "left_anti").isEmpty():
                    raise StageFailed(f"{name} lost documents")
                new = new | {main: table}
            if name == "whisper" and "documents" in tables:
                lost = tables["documents"].select("doc_id").distinct().join(new["segments"].select("doc_id"), "doc_id", "left_anti")
                lost = lost.select("doc_id", F.lit("missing_segments").alias("code"), F.lit(None).cast("long").alias("location"))
                if options.strict and (first := lost.head(1)):
                    raise StageFailed(f"missing_segments in document {first[0]['doc_id']}")
                new = new | {"rejected": lost}
        except Exception as e:
            observe(event | {"status": "failed", "elapsed": time.time() - began, "message": str(e)[:500]})
            raise
        observe(event | {"status": "succeeded", "elapsed": time.time() - began})
        tables = new
    return tables


def outputs(tables: Tables, documents: DataFrame) -> DataFrame:
    """documents(doc_id, source_path) with stem, run_id, output_path, json and srt, for those that passed."""
    name = F.element_at(F.split("source_path", "/"), -1)
    d = documents.select("doc_id", "source_path", F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"))
    d = d.withColumns({"run_id": F.concat(F.lit("transcribe-"), "stem"), "output_path": F.concat("stem", F.lit(".json"))}).join(tables["segments"].select("doc_id").distinct(), "doc_id", "left_semi")
    twice = d.groupBy("stem").count().where("count > 1").head(1)
    if twice:
        raise StageFailed(f"two documents would be written to {twice[0]['stem']}")
    return sinks.listening_documents(d, tables["segments"], tables["cues"]).join(cues.srt_documents(tables["cues"]), "doc_id")
