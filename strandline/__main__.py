"""Command line: ``status``, ``--version`` and ``transcribe TABLE`` over a Parquet table of a recogniser's rows or of nested segments."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    sub.add_parser("status", help="the stages of a run")
    t = sub.add_parser("transcribe", help="runs the chain and writes one file for each document and format")
    t.add_argument("table", help="Parquet: raw rows (doc_id, ord, text, ..., words) or nested segments (doc_id, position, ..., sentences)")
    t.add_argument("--output-dir", default="output", help="folder that executors share")
    t.add_argument("--documents", help="Parquet of doc_id and source_path; by default a document's id is its file name")
    t.add_argument("--export-srt", action="store_true", help="writes SRT files beside the JSON files")
    t.add_argument("--aligned", help="Parquet of an aligner's rows")
    t.add_argument("--turns", help="Parquet of a diariser's turns (doc_id, turn_idx, speaker_id, start, end)")
    t.add_argument("--repairer", help="module:function that returns a column over text, prev_text and next_text")
    t.add_argument("--morphemes", help="Parquet of an analyser's tokens; with --lexicon and --scores it turns homophone resolution on")
    t.add_argument("--lexicon", help="Parquet of ord, surface, reading, pos, vocab_rank")
    t.add_argument("--scores", help="Parquet of a language model's scores (doc_id, position, sentence_index, start, text, score)")
    t.add_argument("--proposals", help="Parquet of a language model's proposals, with ord")
    t.add_argument("--homophone-top-k", type=int, default=80, help="proposals of a target that are looked at")
    t.add_argument("--homophone-score-margin", type=float, default=0.0)
    t.add_argument("--no-boundaries", action="store_true")
    t.add_argument("--no-merge", action="store_true")
    t.add_argument("--no-normalise", action="store_true")
    t.add_argument("--strict", action="store_true", help="ends at the first issue instead of leaving its document out")
    t.add_argument("--work-dir", help="folder for the table of each stage")
    return p


def transcribe(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import homophone
    from .plans import chain
    from .sources import sinks

    spark = SparkSession.builder.getOrCreate()
    read = lambda path: spark.read.parquet(path) if path else None
    rows = read(a.table)
    tables = {"segments" if "sentences" in rows.columns else "raw": rows}
    homophones = None
    if a.morphemes or a.lexicon or a.scores:
        if not (a.morphemes and a.lexicon and a.scores):
            raise chain.StageFailed("homophone resolution needs --morphemes, --lexicon and --scores")
        model = read(a.proposals)
        if model is not None:
            model = homophone.top_tokens(model, ["doc_id", "position", "sentence_index", "start"], a.homophone_top_k)
        homophones = {"morphemes": read(a.morphemes), "lexicon": read(a.lexicon), "scores": read(a.scores), "model": model, "margin": a.homophone_score_margin}
    documents = read(a.documents)
    if documents is None:
        documents = rows.select("doc_id", F.col("doc_id").cast("string").alias("source_path")).distinct()
    options = chain.Options(aligned=read(a.aligned), turns=read(a.turns), repairer=chain.plug_in(a.repairer)() if a.repairer else None, homophones=homophones, boundaries=not a.no_boundaries, merge=not a.no_merge, normalise=not a.no_normalise, strict=a.strict)
    said = lambda e: print(f"{e['stage']} {e['status']}" + (f" {e['elapsed']:.2f}s" if e["elapsed"] is not None else ""), file=sys.stderr)
    done = chain.run(tables | {"documents": documents}, options, said, a.work_dir)
    out = chain.outputs(done, documents)
    sinks.write_all(out, a.output_dir, {".json": "json"} | ({".srt": "srt"} if a.export_srt else {}))
    rejected = done["rejected"].groupBy("doc_id").agg(F.min("code").alias("code")).orderBy("doc_id").limit(100).collect()
    for r in rejected:
        print(f"left out: {r['doc_id']}: {r['code']}", file=sys.stderr)
    print(a.output_dir)
    return 1 if rejected else 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "status":
        print("stages: whisper, whisperx-alignment, qwen-repair, homophone-resolution, sentence-boundary-resolution, subtitle-builder, subtitle-merger, readability-optimizer, subtitle-validator, subtitle-writer")
        return 0
    if a.command != "transcribe":
        p.print_help()
        return 2
    from .plans.workflow import StageFailed

    try:
        return transcribe(a)
    except (StageFailed, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
