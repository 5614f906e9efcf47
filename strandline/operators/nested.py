"""Sentence boundaries and speakers over nested segments: sentences and their words are carried through every pass.

segments(doc_id, position, text, start, end, speaker_id, sentences), see ``schema``. Passes that look at neighbours are
windows; the two that depend on what they have done (overlaps, splits) fold small states of one document or sentence,
and tables are rebuilt from their decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.text import WS, boundary_overlap, compact, ends_with_any, nfkc_words, starts_with_any, strip
from ..schema import SENTENCE, WORD, sentences_of, with_sentences, words_of
from ..sources.transcripts import common_of
from .boundary import split_sentences
from .intervals import assign_speakers
from .sequence import islands, ordered, renumber, runs

NORMAL = WORD.replace("speaker_id:string", "speaker_id:string,norm:string")
NESTED = SENTENCE.replace(WORD, NORMAL)
COLUMNS = ("position", "text", "start", "end", "speaker_id", "sentences")


def normalised(segments: DataFrame) -> DataFrame:
    """Words get ``norm``: their NFKC text without white space at the ends (NFKC leaves ASCII as it is, so only other texts visit Python)."""
    texts = F.transform("sentences", lambda s: F.transform(s["words"], lambda w: w["text"]))
    plain = F.coalesce(~F.array_join(F.flatten(texts), "").rlike(r"[^\x00-\x7f]"), F.lit(True))
    df = segments.withColumn("_n", nfkc_words(F.when(~plain, texts)))

    def sentence(s, i):
        words = F.transform(s["words"], lambda w, k: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["confidence"].alias("confidence"), w["speaker_id"].alias("speaker_id"), F.coalesce(F.get(F.get("_n", i), k), strip(w["text"])).alias("norm")))
        return F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["speaker_id"].alias("speaker_id"), F.coalesce(words, F.array().cast(f"array<{NORMAL}>")).alias("words"))

    return df.withColumn("sentences", F.coalesce(F.transform("sentences", sentence), F.array().cast(f"array<{NESTED}>"))).drop("_n")


def plain(segments: DataFrame) -> DataFrame:
    def word(w):
        return F.struct(*[w[c].alias(c) for c in ("text", "start", "end", "confidence", "speaker_id")])

    def sentence(s):
        return F.struct(*[s[c].alias(c) for c in ("text", "start", "end", "speaker_id")], F.transform(s["words"], word).alias("words"))

    return segments.withColumn("sentences", F.transform("sentences", sentence).cast(f"array<{SENTENCE}>"))


def of_words(words: Column, speaker: Column) -> Column:
    """A sentence of words: their normal texts, from the first start to the last end."""
    text = strip(F.array_join(F.transform(words, lambda w: w["norm"]), ""))
    return F.struct(text.alias("text"), F.get(words, F.lit(0))["start"].alias("start"), F.element_at(words, -1)["end"].alias("end"), F.coalesce(F.nullif(speaker, F.lit("")), common_of(words)).alias("speaker_id"), words.alias("words"))


def joined(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s: s["text"]), "")


def last_of(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def but_last(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def merge_overlaps(segments: DataFrame, key: str = "doc_id", marks=(*lx.TERMINAL_MARKS, "?", "!")) -> DataFrame:
    """Joins a segment of one sentence that begins with the end (two characters or more) of the sentence so far, without the echo.

    Words of the right sentence go from its start until the echo is covered. The document's fold keeps the text of the
    sentence so far; what it decides for each segment is the length of the echo, 0 to stay apart.
    """
    first = F.get(F.col("sentences"), F.lit(0))
    one = F.struct("position", F.size("sentences").alias("n"), last_of(F.col("sentences"))["text"].alias("last"), first["text"].alias("first"), F.length(F.get(first["words"], F.lit(0))["norm"]).alias("w"))
    a = segments.select(key, one.alias("one")).groupBy(key).agg(F.array_sort(F.collect_list("one")).alias("a"))
    state = "struct<tail:string,out:array<struct<position:int,n:int>>>"

    def step(acc: Column, x: Column) -> Column:
        n = F.when((x["n"] == 1) & acc["tail"].isNotNull(), boundary_overlap(acc["tail"], x["first"])).otherwise(F.lit(0))

        def settle(held: Column) -> Column:  # the overlap is computed once
            n = held["n"]
            apart = (n < 2) | F.coalesce(n == x["w"], F.lit(False)) | F.coalesce(ends_with_any(acc["tail"], marks), F.lit(False))
            tail = F.when(apart, x["last"]).otherwise(F.concat(acc["tail"], F.substring(x["first"], n + 1, F.length(x["first"]))))
            return F.struct(tail.alias("tail"), F.concat(acc["out"], F.array(F.struct(x["position"].cast("int").alias("position"), F.when(apart, 0).otherwise(n).cast("int").alias("n")))).alias("out")).cast(state)

        return F.get(F.transform(F.array(F.struct(n.alias("n"))), settle), F.lit(0))

    zero = F.struct(F.lit(None).cast("string").alias("tail"), F.array().alias("out")).cast(state)
    decided = a.select(key, F.explode(F.aggregate("a", zero, step)["out"]).alias("d")).select(key, "d.position", F.col("d.n").alias("echo"))
    g = islands(segments.join(decided, [key, "position"]), [key], ["position"], F.col("echo") > 0)
    row = F.struct("position", "text", "start", "end", "speaker_id", "sentences", "echo")
    g = g.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("position", row.alias("r")))).alias("g")).select(key, "island", F.transform("g", lambda x: x["r"]).alias("g"))
    head, rest = F.get("g", F.lit(0)), F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(1)))
    left, final = last_of(head["sentences"]), last_of(F.col("g"))

    def uncovered(r: Column) -> Column:
        words = F.get(r["sentences"], F.lit(0))["words"]
        zero = F.struct(r["echo"].alias("left"), F.array().cast(f"array<{NORMAL}>").alias("out"))
        go = lambda acc, w: F.when(acc["left"] > 0, F.struct((acc["left"] - F.length(w["norm"])).alias("left"), acc["out"].alias("out"))).otherwise(F.struct(acc["left"].alias("left"), F.concat(acc["out"], F.array(w)).alias("out")))
        return F.aggregate(words, zero, go)["out"]

    def firsts(field):
        return F.transform(rest, lambda r: F.get(r["sentences"], F.lit(0))[field])

    text = F.concat(left["text"], F.array_join(F.transform(rest, lambda r: F.substring(F.get(r["sentences"], F.lit(0))["text"], r["echo"] + 1, F.lit(1 << 30))), ""))
    speaker = F.coalesce(left["speaker_id"], F.get(F.filter(firsts("speaker_id"), lambda x: x.isNotNull()), F.lit(0)))
    new = F.struct(text.alias("text"), left["start"].alias("start"), last_of(firsts("end")).alias("end"), speaker.alias("speaker_id"), F.concat(left["words"], F.flatten(F.transform(rest, uncovered))).alias("words"))
    many = F.size("g") > 1
    out = g.select(key, F.col("island").cast("int").alias("position"), head.alias("h"), final["end"].alias("end"), many.alias("many"), F.when(many, F.concat(but_last(head["sentences"]), F.array(new))).otherwise(head["sentences"]).alias("sentences"))
    return out.select(key, "position", F.when(F.col("many"), joined(F.col("sentences"))).otherwise(F.col("h.text")).alias("text"), "h.start", F.col("end"), "h.speaker_id", "sentences")


def remove_echoes(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops a first word that the segment before already ends with; the other sentences stay."""
    w = ordered([key], ["position"])
    first = F.get("sentences", F.lit(0))
    words = first["words"]
    echo = F.get(words, F.lit(0))["norm"]
    hit = (echo != "") & F.endswith(F.lag(compact(F.col("text"))).over(w), echo) & (F.size(words) > 1) & F.startswith(compact(first["text"]), echo)
    rows = segments.withColumn("_h", F.coalesce(hit, F.lit(False)))
    new = of_words(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), first["speaker_id"])
    rows = rows.withColumn("sentences", F.when(F.col("_h"), F.concat(F.array(new), F.slice("sentences", 2, F.greatest(F.size("sentences") - 1, F.lit(0))))).otherwise(F.col("sentences")))
    return rows.withColumns({"text": F.when(F.col("_h"), joined(F.col("sentences"))).otherwise(F.col("text")), "start": F.when(F.col("_h"), F.get("sentences", F.lit(0))["start"]).otherwise(F.col("start"))}).drop("_h")


def join_continuations(segments: DataFrame, key: str = "doc_id", max_gap=lx.CONTINUATION_GAP, marks=(*lx.TERMINAL_MARKS, "?", "!"), prefixes=lx.CONTINUATION_PREFIXES) -> DataFrame:
    """Joins segments whose first sentence opens with a dependent word right after an unfinished one of the same speaker."""
    w = ordered([key], ["position"])
    left, right = F.lag(last_of(F.col("sentences"))).over(w), F.get("sentences", F.lit(0))
    gap = right["start"] - left["end"]
    tie = (gap >= 0) & (gap <= max_gap) & ~ends_with_any(left["text"], marks) & starts_with_any(right["text"], prefixes) & left["speaker_id"].eqNullSafe(right["speaker_id"])
    g = islands(segments, [key], ["position"], tie)
    row = F.struct("position", "text", "start", "end", "speaker_id", "sentences")
    g = g.groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("position", row.alias("r")))).alias("g")).select(key, "island", F.transform("g", lambda x: x["r"]).alias("g"))
    told = F.flatten(F.transform("g", lambda r, i: F.transform(r["sentences"], lambda s, k: F.struct(s.alias("s"), ((i > 0) & (k == 0)).alias("glue")))))

    def step(acc: Column, x: Column) -> Column:
        a, b = last_of(acc), x["s"]
        both = F.struct(F.concat(a["text"], b["text"]).alias("text"), a["start"].alias("start"), b["end"].alias("end"), F.coalesce(a["speaker_id"], b["speaker_id"]).alias("speaker_id"), F.concat(a["words"], b["words"]).alias("words"))
        return F.when(x["glue"], F.concat(but_last(acc), F.array(both))).otherwise(F.concat(acc, F.array(b)))

    head, many = F.get("g", F.lit(0)), F.size("g") > 1
    sentences = F.when(many, F.aggregate(told, F.array().cast(f"array<{NESTED}>"), step)).otherwise(head["sentences"])
    speaker = F.get(F.filter(F.transform("g", lambda r: r["speaker_id"]), lambda x: x.isNotNull()), F.lit(0))
    out = g.select(key, F.col("island").cast("int").alias("position"), head.alias("h"), last_of(F.col("g"))["end"].alias("end"), speaker.alias("speaker_id"), many.alias("many"), sentences.alias("sentences"))
    return out.select(key, "position", F.when(F.col("many"), joined(F.col("sentences"))).otherwise(F.col("h.text")).alias("text"), "h.start", F.col("end"), "speaker_id", "sentences")


def restore_commas(segments: DataFrame, key: str = "doc_id", endings=("て", "で"), comma=lx.COMMA) -> DataFrame:
    """A comma after a connective ending of a segment's last sentence and word, for all but a document's last segment."""
    w = ordered([key], ["position"])
    s = last_of(F.col("sentences"))
    tail = compact(s["text"])
    hit = F.lead("position").over(w).isNotNull() & (F.substring(tail, -1, 1) != comma)
    ends = F.lit(False)
    for e in endings:
        ends = ends | tail.endswith(e)
    words = s["words"]
    word = last_of(words)
    marked = F.struct(F.concat(word["norm"], F.lit(comma)).alias("text"), *[word[c].alias(c) for c in ("start", "end", "confidence", "speaker_id")], F.concat(word["norm"], F.lit(comma)).alias("norm"))
    new = F.struct(F.concat(F.regexp_replace(s["text"], f"{WS}+$", ""), F.lit(comma)).alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["speaker_id"].alias("speaker_id"), F.when(F.size(words) > 0, F.concat(but_last(words), F.array(marked))).otherwise(words).alias("words"))
    rows = segments.withColumn("_h", F.coalesce(hit & ends, F.lit(False)))
    rows = rows.withColumn("sentences", F.when(F.col("_h"), F.concat(but_last(F.col("sentences")), F.array(new))).otherwise(F.col("sentences")))
    return rows.withColumn("text", F.when(F.col("_h"), joined(F.col("sentences"))).otherwise(F.col("text"))).drop("_h")


def split(segments: DataFrame, key: str = "doc_id", **rule) -> tuple[DataFrame, DataFrame]:
    """Segments whose sentences are split at their boundaries, and the decisions(position, sentence_index, word_index, gap_seconds, reason, left_text, right_text)."""
    w = segments.select(key, "position", F.posexplode("sentences").alias("sentence_index", "s")).select(key, "position", "sentence_index", F.posexplode("s.words").alias("word_idx", "w"))
    words = w.select(key, "position", "sentence_index", "word_idx", F.col("w.norm").alias("text"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    decisions = split_sentences(words, [key, "position", "sentence_index"], **rule)
    cuts = decisions.groupBy(key, "position").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "word_idx"))).alias("_c"))

    def parts(s, i):
        ends = F.transform(F.filter("_c", lambda c: c["sentence_index"] == i), lambda c: c["word_idx"] + 1)
        starts, stops = F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(s["words"])))
        made = F.zip_with(starts, stops, lambda a, b: of_words(F.slice(s["words"], a + 1, b - a), s["speaker_id"]))
        return F.when(F.size(ends) > 0, made).otherwise(F.array(s))

    rows = segments.join(cuts, [key, "position"], "left")
    some = F.col("_c").isNotNull()
    rows = rows.withColumn("sentences", F.when(some, F.flatten(F.transform("sentences", parts))).otherwise(F.col("sentences")))
    rows = rows.withColumn("text", F.when(some, joined(F.col("sentences"))).otherwise(F.col("text"))).drop("_c")
    told = decisions.select(key, "position", "sentence_index", F.col("word_idx").alias("word_index"), F.col("gap").alias("gap_seconds"), "reason", "left_text", "right_text")
    return rows, told


def resolve_boundaries(segments: DataFrame, key: str = "doc_id", marks=lx.TERMINAL_MARKS, prefixes=lx.CONTINUATION_PREFIXES, endings=("て", "で"), comma=lx.COMMA, max_gap=lx.CONTINUATION_GAP, **rule) -> tuple[DataFrame, DataFrame]:
    """The five passes in order: overlaps, echoes, continuations, commas, splits. Segments and the decisions of the last."""
    rows = normalised(segments.select(key, *COLUMNS))
    rows = remove_echoes(merge_overlaps(rows, key, (*marks, "?", "!")), key)
    rows = restore_commas(join_continuations(rows, key, max_gap, (*marks, "?", "!"), prefixes), key, endings, comma)
    rows, decisions = split(rows, key, marks=marks, prefixes=prefixes, **rule)
    return plain(rows).select(key, *COLUMNS), decisions


def by_speaker(segments: DataFrame, turns: DataFrame, key: str = "doc_id", bucket: float | None = 30.0) -> DataFrame:
    """One segment for each run of words of one speaker, or sentence without words; documents without turns stay as they are.

    A word's speaker is that of the greatest overlap, else its own; a sentence without words takes that of its own
    range, else its own, else its segment's. ``bucket``: seconds by which long documents are dealt.
    """
    turns = turns.where(strip(F.col("speaker_id")) != "")
    known = turns.select(key).distinct()
    with_turns = segments.join(known, key, "left_semi")
    s = sentences_of(with_turns.withColumn("sentences", with_sentences()), key)
    w = words_of(with_turns, key)
    ids = [key, "position", "sentence_index"]
    a = assign_speakers(w, turns, key, ["position", "sentence_index", "word_idx"], bucket)
    a = runs(a, ids, ["word_idx"], "assigned")
    word = F.struct("text", "start", "end", "confidence", F.col("assigned").alias("speaker_id"))
    g = a.groupBy(*ids, "run").agg(F.array_sort(F.collect_list(F.struct("word_idx", word.alias("w")))).alias("w")).withColumn("w", F.transform("w", lambda x: x["w"]).cast(f"array<{WORD}>"))
    whole = g.join(s.select(*ids, F.col("text").alias("whole"), F.size("words").alias("n")), ids)
    text = F.when(F.size("w") == F.col("n"), F.col("whole")).otherwise(F.array_join(F.transform("w", lambda x: x["text"]), ""))
    spoken = whole.select(*ids, "run", text.alias("text"), F.get("w", F.lit(0))["start"].alias("start"), last_of(F.col("w"))["end"].alias("end"), F.get("w", F.lit(0))["speaker_id"].alias("speaker_id"), F.col("w").alias("words"))
    bare = s.where(F.size("words") == 0).join(with_turns.select(key, "position", F.col("speaker_id").alias("own")), [key, "position"])
    silent = assign_speakers(bare.withColumn("speaker_id", F.coalesce("speaker_id", "own")), turns, key, ["position", "sentence_index"], bucket)
    silent = silent.select(*ids, F.lit(0).cast("long").alias("run"), "text", "start", "end", F.col("assigned").alias("speaker_id"), "words")
    rows = spoken.withColumn("run", F.col("run").cast("long")).unionByName(silent)
    sentence = F.array(F.struct("text", "start", "end", "speaker_id", "words")).cast(f"array<{SENTENCE}>")
    rows = renumber(rows.withColumn("sentences", sentence).withColumnRenamed("position", "_p"), [key], ["_p", "sentence_index", "run"], "position", 0)
    rows = rows.select(key, F.col("position").cast("int").alias("position"), "text", "start", "end", "speaker_id", "sentences")
    return rows.unionByName(segments.select(*rows.columns).join(known, key, "left_anti"))
