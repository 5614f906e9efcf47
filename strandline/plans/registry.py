"""Registered queries: each applies operators to whole driver tables.

Conversations stand in for transcripts: turns are segments whose times follow from their lengths, in
whole milliseconds, and Latin word lists take the place of the Japanese defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..operators import boundary, cues, homophone, intervals, nested, repair, sequence
from ..sources import sinks

SUFFIXES, MARKS, PREFIXES, MARKERS, EXCLUDED = ("ion", "en"), (".", "?", "!"), ("de", "the", "la", "un"), ("The", "De", "La"), ("The of", "De la")
#: Milliseconds by which long documents are dealt in interval joins.
BUCKET = 20_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.col("role").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("dur", F.length("text").cast("long") * 50)
    gap = F.pmod(F.col("position") * 137 + F.col("doc_id") * 71, F.lit(900)) - 100
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("start", F.coalesce(F.sum(F.col("dur") + gap).over(w), F.lit(0)).cast("long"))
    return t.withColumn("end", F.col("start") + F.col("dur")).drop("dur")


def words(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    w = s.select("doc_id", "position", "speaker_id", "start", F.posexplode(F.split("text", "[ \n]+")).alias("word_idx", "text")).where("text <> ''")
    before = Window.partitionBy("doc_id", "position").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) * 50
    w = w.withColumn("start", (F.col("start") + at).cast("long"))
    return w.withColumn("end", F.col("start") + F.length("text") * 50)


def turns(spark: SparkSession, d: str) -> DataFrame:
    shift = F.pmod(F.col("doc_id") * 31, F.lit(400))
    return segments(spark, d).select("doc_id", F.col("position").alias("turn_idx"), "speaker_id", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))


def cue_table(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a turn is a sentence of it."""
    s = segments(spark, d)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), (F.col("start") + i * 10).alias("start"), (F.col("start") + i * 10 + 10).alias("end"), F.lit(None).cast("string").alias("speaker_id"))), lambda x: x["text"] != "")
    return cues.build_cues(s.withColumn("sentences", lines))


def merged(spark: SparkSession, d: str) -> DataFrame:
    return cues.merge_cues(cue_table(spark, d), max_gap=350, max_chars=1500, marks=("?",), suffixes=("ion.",))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark items; a word's reading is its consonants."""
    w = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("surface")).where("length(surface) >= 3").groupBy("surface").count()
    w = w.select("surface", F.col("count").cast("long").alias("n"), F.regexp_replace("surface", "[aeiou]", "").alias("reading")).where("reading <> ''")
    return w.withColumn("ord", F.row_number().over(Window.partitionBy("reading").orderBy("surface")).cast("long"))


def q_segments(spark, d):
    return segments(spark, d).select("doc_id", "position", "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def q_neighbours(spark, d):
    n = sequence.neighbours(segments(spark, d), ["doc_id"], ["position"], "text")
    return n.select("doc_id", "position", F.length("prev_text").alias("prev_len"), F.length("next_text").alias("next_len"))


def q_runs(spark, d):
    r = sequence.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def q_continuations(spark, d):
    s = segments(spark, d).withColumn("speaker_id", F.lit("s"))
    return boundary.join_continuations(s, max_gap=200, marks=("?",), prefixes=("the", "de", "la", "De", "The", "La", "A", "Er", "An", "In", "Th")).select("doc_id", "position", "start", "end", F.length("text").alias("chars"))


def q_pairs(spark, d):
    return merged(spark, d).select("doc_id", "index", "start", "end", "speaker_id", F.length("text").alias("chars"))


def q_readability(spark, d):
    return segments(spark, d).select("doc_id", "position", tx.readable(F.col("text"), markers=MARKERS, exclusions=EXCLUDED).alias("text"))


def q_srt(spark, d):
    s = segments(spark, d)
    return s.select("doc_id", "position", tx.srt_block(F.col("position") + 1, F.col("start") / 1000, F.col("end") / 1000, F.col("text")).alias("block")).where("block is not null")


def q_flagship(spark, d):
    c = cues.normalise_cues(merged(spark, d), markers=MARKERS, exclusions=EXCLUDED).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    return cues.cue_report(c).select("doc_id", "n_cues", "n_issues", F.length("srt").alias("srt_chars"))


def q_json(spark, d):
    """Whole nested documents: each line of a turn is a sentence, and every turn a cue; times in seconds."""
    t = segments(spark, d)
    s = F.col("start") / 1000
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    sentences = F.transform(lines, lambda x: F.struct(x.alias("text"), s.alias("start"), (F.col("end") / 1000).alias("end"), F.lit(None).cast("string").alias("speaker_id"), F.array().cast(f"array<{schema.WORD}>").alias("words")))
    t = t.withColumn("sentences", sentences.cast(f"array<{schema.SENTENCE}>")).withColumns({"start": s, "end": F.col("end") / 1000})
    c = t.withColumn("index", F.col("position") + 1)
    paths = t.select("doc_id").distinct().select("doc_id", F.concat(F.lit("in/"), "doc_id", F.lit(".mp3")).alias("source_path"), F.concat(F.lit("out/"), "doc_id", F.lit(".json")).alias("output_path"), F.concat(F.lit("transcribe-"), "doc_id").alias("run_id"))
    return sinks.listening_documents(paths, t, c).select("doc_id", "json")


def q_explode(spark, d):
    return cue_table(spark, d).select("doc_id", "index", "start", "end", "speaker_id", "text")


def q_issues(spark, d):
    s = segments(spark, d).withColumn("ord", F.col("position"))
    c = s.withColumn("index", F.col("position"))
    return cues.segment_issues(s).unionByName(cues.cue_issues(c))


def q_speakers(spark, d):
    a = intervals.assign_speakers(words(spark, d), turns(spark, d), "doc_id", ["position", "word_idx"], BUCKET)
    return a.groupBy("doc_id", "assigned").agg(F.count("*").alias("n_words"), F.min("start").alias("first_start"))


def q_bucketed(spark, d):
    t = turns(spark, d).select("doc_id", "turn_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    met = intervals.interval_join(segments(spark, d), t, "doc_id", bucket=BUCKET)
    return met.select("doc_id", "position", "turn_idx", intervals.overlap(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end")).cast("long").alias("overlap"))


def q_speaker_runs(spark, d):
    a = intervals.assign_speakers(words(spark, d), turns(spark, d), "doc_id", ["position", "word_idx"], BUCKET).withColumn("sentence_text", F.lit("?"))
    return intervals.speaker_runs(a, ["doc_id", "position"]).select("doc_id", "position", "run", "start", "end", "speaker_id")


def q_concat(spark, d):
    w = words(spark, d)
    g = w.groupBy("doc_id", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), "").alias("text"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"), intervals.common_speaker(F.col("speaker_id")).alias("speaker_id"))
    return g


def q_contiguity(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("d"), F.count("*").alias("n"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))
    return c.select("l_orderkey", ((F.col("d") == F.col("n")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("contiguous"), (F.col("n") - F.col("d")).alias("repeats"))


def q_prefilter(spark, d):
    w = words(spark, d).withColumns({"original_score": F.when(F.length("text") % 3 != 0, F.length("text") / 16.0), "asr_confidence": F.when(F.col("word_idx") % 5 != 0, (F.col("word_idx") % 7) / 8.0), "vocab_rank": (F.ascii("text") % 8) / 8.0, "candidate_count": F.length("text") % 4})
    return homophone.prefilter(w, ["doc_id", "position"]).select("doc_id", "position", "word_idx", "rank")


def q_lexical(spark, d):
    lex = lexicon(spark, d)
    t = lex.select(F.col("surface").alias("text"), "reading")
    return homophone.whole_candidates(t.withColumn("t", F.col("text")), lex, ["t"]).select("text", "candidate", "rank")


def q_composed(spark, d):
    lex = lexicon(spark, d)
    t = lex.select(F.col("surface").alias("text"), "reading").withColumn("t", F.col("text"))
    return homophone.composed_candidates(t, lex.select("surface", "reading"), ["t"]).select("text", "candidate", "rank")


def q_decide(spark, d):
    lex = lexicon(spark, d)
    t = lex.select(F.col("surface").alias("text"), "reading", F.when(F.col("n") % 3 != 0, F.col("n") / 64.0).alias("original_score")).withColumn("t", F.col("text"))
    c = homophone.whole_candidates(t, lex, ["t"]).select("t", "candidate", F.col("rank").alias("ord")).join(lex.select(F.col("surface").alias("candidate"), "n"), "candidate")
    c = c.select("t", "ord", F.col("candidate").alias("text"), F.when(F.col("n") % 5 != 0, F.col("n") / 64.0).alias("score"))
    return homophone.decide(t, c, ["t"]).select("text", "reason", "accepted", "selected_text", "selected_score")


def q_gate(spark, d):
    """Repairs that change nothing, punctuation, the opening, or the length."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("original_text"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    t = t.withColumn("candidate_text", F.when(kind == 0, F.col("original_text")).when(kind == 1, F.concat("original_text", F.lit("!"))).when(kind == 2, F.concat(F.lit("Abc"), F.expr("substring(original_text, 4)"))).otherwise(F.concat("original_text", "original_text")))
    return repair.gate_repairs(t).select("conv_id", "turn", "accepted", "reason", F.round("content_change_ratio", 6).alias("content"), F.round("length_delta_ratio", 6).alias("length"))


def q_echo(spark, d):
    ws = words(spark, d).groupBy("doc_id", "position").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "start", "end"))).alias("words"))
    s = segments(spark, d).join(ws, ["doc_id", "position"])
    return boundary.remove_echoes(s).select("doc_id", "position", "start", F.length("text").alias("chars"), "echo_removed")


def q_commas(spark, d):
    s = segments(spark, d)
    return boundary.restore_commas(s, endings=("n.", "e.", "s."), comma=",").select("doc_id", "position", F.length("text").alias("chars"))


def q_overlap_fold(spark, d):
    """Each whole turn also says the first characters of the next, which are then an echo."""
    ahead = F.lead("text", 1, "").over(Window.partitionBy("doc_id").orderBy("position"))
    s = segments(spark, d).withColumn("first_word", F.regexp_extract("text", r"^[^ \n]+", 0)).withColumn("text", F.concat("text", F.substring(ahead, F.lit(1), 1 + F.pmod("doc_id", F.lit(4)).cast("int"))))
    return boundary.merge_overlaps(s.withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000}), marks=("?",)).select("doc_id", "position", "text")


def q_split_fold(spark, d):
    w = words(spark, d).withColumns({"start": F.col("start") / 1000 + F.col("word_idx") % 4 * 0.6 * F.floor(F.col("word_idx") / 9), "end": F.col("end") / 1000 + F.col("word_idx") % 4 * 0.6 * F.floor(F.col("word_idx") / 9)})
    return boundary.split_sentences(w, ["doc_id", "position"], marks=(".",), suffixes=SUFFIXES, particles=("qu",), prefixes=PREFIXES).select("doc_id", "position", "word_idx", "reason")


def nested_segments(spark, d):
    """Each line of a turn is a sentence of its words, without the spaces; turns without words are left out."""
    s = segments(spark, d)
    lines = s.select("doc_id", "position", "speaker_id", "start", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    w = lines.select("doc_id", "position", "speaker_id", "start", "line", F.posexplode(F.split("text", " +")).alias("n", "text")).where("text <> ''")
    before = Window.partitionBy("doc_id", "position").orderBy("line", "n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) * 50
    w = w.withColumns({"start": at / 1000, "end": (at + F.length("text") * 50) / 1000})
    word = F.struct("text", "start", "end", F.lit(None).cast("double").alias("confidence"), "speaker_id")
    g = w.groupBy("doc_id", "position", "speaker_id", "line").agg(F.array_sort(F.collect_list(F.struct("n", word.alias("w")))).alias("w")).withColumn("w", F.transform("w", lambda x: x["w"]))
    text = F.array_join(F.transform("w", lambda x: x["text"]), "")
    sentence = F.struct(text.alias("text"), F.get("w", F.lit(0))["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), "speaker_id", F.col("w").alias("words"))
    out = g.select("doc_id", "position", "speaker_id", F.struct("line", sentence.alias("s")).alias("s")).groupBy("doc_id", "position", "speaker_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]).alias("sentences"))
    whole = F.array_join(F.transform("sentences", lambda s: s["text"]), "")
    out = out.withColumns({"sentences": F.col("sentences").cast(f"array<{schema.SENTENCE}>"), "text": whole, "start": F.get("sentences", F.lit(0))["start"], "end": F.element_at("sentences", -1)["end"]})
    return nested.normalised(out.select("doc_id", *nested.COLUMNS))


def told(df):
    """What nested segments hold: texts, ranges, and how many words each sentence has."""
    sizes = F.array_join(F.transform("sentences", lambda s: F.size(s["words"]).cast("string")), ",")
    lines = F.array_join(F.transform("sentences", lambda s: s["text"]), "\n")
    return df.select("doc_id", "position", "text", "start", "end", lines.alias("sentence_texts"), sizes.alias("word_counts"))


def q_nested_echo(spark, d):
    return told(nested.remove_echoes(echoing(spark, d)))


def echoing(spark, d):
    """Nested segments of which every other one ends with the first word of the next."""
    s = nested_segments(spark, d)
    ahead = F.lead(F.get(F.get("sentences", F.lit(0))["words"], F.lit(0))["norm"], 1, "").over(Window.partitionBy("doc_id").orderBy("position"))
    return s.withColumn("text", F.when(F.col("position") % 2 == 0, F.concat("text", ahead)).otherwise(F.col("text")))


def q_nested_continuations(spark, d):
    s = nested_segments(spark, d)
    none = F.transform("sentences", lambda x: x.withField("speaker_id", F.lit(None).cast("string")))
    return told(nested.join_continuations(s.withColumn("sentences", none), max_gap=0.9, marks=("?",), prefixes=("the", "de", "la", "De", "The", "La", "A", "Er", "An", "In", "Th")))


def q_nested_commas(spark, d):
    return told(nested.restore_commas(nested_segments(spark, d), endings=("n.", "e.", "s."), comma=","))


def q_nested_split(spark, d):
    return told(nested.split(nested_segments(spark, d), marks=(".",), suffixes=SUFFIXES, particles=("qu",), prefixes=PREFIXES)[0])


def q_latest(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("stage"), F.col("ts").alias("recorded_at"), F.lit(None).cast("double").alias("elapsed"), F.lit("").alias("message"))
    return sinks.latest_events(e, ["user_id"]).select("user_id", "status", F.col("stage").alias("last_event"))


def q_asr(spark, d):
    w = words(spark, d)
    s = segments(spark, d).withColumns({"start": F.col("start") + 30, "end": F.col("end") - 30})
    b = w.groupBy("doc_id", "position").agg(F.min_by("start", "word_idx").alias("w0"), F.max_by("end", "word_idx").alias("w1"))
    kept = s.where(tx.strip(F.col("text")) != "").join(b, ["doc_id", "position"], "left").select("doc_id", "position", F.least("start", "w0").alias("start"), F.greatest("end", "w1").alias("end"))
    return sequence.renumber(kept, ["doc_id"], ["position"], "new_position", 0)


def q_predicates(spark, d):
    s = segments(spark, d)
    w = Window.partitionBy("doc_id").orderBy("position")
    return s.select("doc_id", "position", (F.lead("start").over(w) - F.col("end")).alias("gap"), (~F.col("speaker_id").eqNullSafe(F.lead("speaker_id").over(w))).alias("speaker_boundary"), tx.ends_with_any(F.col("text"), MARKS).alias("terminal"), tx.starts_with_any(F.col("text"), PREFIXES).alias("dependent"), tx.has_kanji(F.col("text")).alias("kanji"))


def q_preflight(spark, d):
    return table(spark, d, "part").groupBy(tx.path_fragment(F.col("p_brand")).alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


def _long(query):
    """The query with 32-bit counts as longs, as SQL engines count."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = query(spark, d)
        return df.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])

    return run


_ALL = {
    "flagship_srt": q_flagship, "json_doc": q_json, "seg_timeline": q_segments, "win_neighbors": q_neighbours, "win_runs": q_runs, "win_islands": q_continuations, "win_pair_merge": q_pairs,
    "win_echo": q_echo, "win_commas": q_commas, "str_readability": q_readability, "str_safety": q_gate, "fmt_srt": q_srt, "explode_cues": q_explode, "union_issues": q_issues,
    "agg_argmax_overlap": q_speakers, "join_interval": q_bucketed, "win_speaker_runs": q_speaker_runs, "agg_concat": q_concat, "agg_contiguity": q_contiguity,
    "topk_prefilter": q_prefilter, "join_equi_antiself": q_lexical, "join_prefix": q_composed, "decide_homophone": q_decide, "fold_overlap": q_overlap_fold, "fold_split": q_split_fold,
    "nested_echo": q_nested_echo, "nested_continuations": q_nested_continuations, "nested_commas": q_nested_commas, "nested_split": q_nested_split,
    "stage_latest": q_latest, "scan_asr": q_asr, "filter_predicates": q_predicates, "preflight_duplicates": q_preflight,
}

QUERIES = {name: _long(query) for name, query in _ALL.items()}
