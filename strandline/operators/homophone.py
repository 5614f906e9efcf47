"""Same-reading corrections: eligible targets, lexical candidates, ranking, decision and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx
from ..functions.text import has_japanese, has_kanji, word_text


def pos_at(pos: Column, i: int) -> Column:
    return F.coalesce(F.get(pos, F.lit(i)), F.lit(""))


def eligible(text: Column, pos: Column, min_chars=lx.MIN_CHARS, skipped=lx.SKIPPED_SURFACES, content=lx.CONTENT_POS, script=has_japanese) -> Column:
    return (F.length(text) >= min_chars) & ~text.isin(*skipped) & pos_at(pos, 0).isin(*content) & script(text)


def compatible(o_text: Column, o_pos: Column, c_text: Column, c_pos: Column) -> Column:
    """Same class, same subclass where both have one, and no change from kanji to none."""
    a1, b1 = pos_at(o_pos, 1), pos_at(c_pos, 1)
    return (pos_at(o_pos, 0) == pos_at(c_pos, 0)) & ((a1 == "") | (b1 == "") | (a1 == b1)) & ~(has_kanji(o_text) & ~has_kanji(c_text))


def whole_candidates(targets: DataFrame, lexicon: DataFrame, target: list[str], limit=lx.MAX_LEXICAL) -> DataFrame:
    """Lexicon entries with a target's reading, not itself, in lexicon order; the first ``limit``."""
    lex = lexicon.select("reading", F.col("surface").alias("candidate"), F.col("ord").alias("c_ord"))
    met = targets.join(lex, "reading").where("candidate <> text")
    first = met.groupBy(*target, "text", "candidate").agg(F.min("c_ord").alias("c_ord"))
    w = Window.partitionBy(*target).orderBy("c_ord")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def composed_candidates(targets: DataFrame, pieces: DataFrame, target: list[str], max_pieces: int = 3, limit=lx.MAX_LEXICAL) -> DataFrame:
    """Surfaces of up to three lexicon pieces whose readings add up to the target's, in order of their paths.

    pieces(surface, reading) are ordered by length of reading, then surface, as a depth-first visit takes them.
    Paths are made once for each reading, from its end: the first ``limit + 1`` surfaces (a target may be one of them)
    of what is left after a piece give those of the whole. The surfaces of i pieces of one reading, each before all
    of r rests, are at least i + r - 1, as they are so many steps of a chain by length, then letters; rows that come
    after more than ``limit`` others are not made, so a reading's rows do not grow with the lexicon.
    """
    most_kept = limit + 1
    p = pieces.where("reading <> '' AND surface IS NOT NULL").select(F.col("reading").alias("_p"), F.col("surface").alias("_s")).distinct()
    p = p.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("_s"))).where(F.col("_i") <= most_kept)
    readings = pieces.where("reading <> ''").select(F.col("reading").alias("_p")).distinct()
    longest = pieces.agg(F.coalesce(F.max(F.length("reading")), F.lit(1)).alias("_most"))

    def firsts(whole: DataFrame) -> DataFrame:
        """(_x, candidate, path): the first surfaces of each _x, once each, and how many they are (_r)."""
        once = whole.groupBy("_x", "candidate").agg(F.min("path").alias("path"))
        w = Window.partitionBy("_x")
        once = once.withColumns({"_k": F.row_number().over(w.orderBy("path")), "_r": F.least(F.count("*").over(w), F.lit(most_kept))})
        return once.where(F.col("_k") <= most_kept).drop("_k")

    # from the front: each prefix that is a piece's whole reading, and what it leaves, for one piece fewer
    left, cuts = targets.where("reading <> ''").select(F.col("reading").alias("_x")).distinct(), []
    for _ in range(max_pieces - 1):
        at = left.withColumn("_most", longest.scalar()).withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.length("_x"), F.col("_most")))))
        cuts.append(at.select("_x", F.substring(F.col("_x"), F.lit(1), F.col("_n")).alias("_p"), F.substring(F.col("_x"), F.col("_n") + 1, F.length("_x")).alias("_left")).join(readings, "_p", "left_semi"))
        left = cuts[-1].where("_left <> ''").select(F.col("_left").alias("_x")).distinct()
    # from the end: single pieces, then a piece before the first surfaces of what it leaves
    step = F.struct(F.length("_p").alias("n"), F.col("_s").alias("s"))
    single = p.select(F.col("_p").alias("_x"), F.col("_s").alias("candidate"), F.array(step).alias("path"))
    made = firsts(single)
    for at in reversed(cuts):
        rest = made.select(F.col("_x").alias("_left"), F.col("candidate").alias("_c"), F.col("path").alias("_path"), "_r")
        whole = at.where("_left = ''").select("_x").join(single, "_x")
        longer = at.join(p, "_p").join(rest, "_left").where((F.col("_i") == 1) | (F.col("_i") + F.col("_r") <= most_kept + 1))
        made = firsts(whole.unionByName(longer.select("_x", F.concat("_s", "_c").alias("candidate"), F.concat(F.array(step), "_path").alias("path"))))
    done = targets.select(*target, "text", F.col("reading").alias("_x")).join(made.drop("_r"), "_x").where("candidate <> text")
    done = done.groupBy(*target, "text", "candidate").agg(F.min("path").alias("path"))
    w = Window.partitionBy(*target).orderBy("path")
    return done.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def composed_entries(entries: DataFrame, pieces: DataFrame, max_pieces: int = 3) -> DataFrame:
    """(candidate, reading, path): entries that up to three pieces(surface, reading) spell and sound, by the first of their paths.

    Pieces join on a prefix of both what is left to spell and to sound, so what is made follows the entries' lengths.
    """
    p = pieces.where("reading <> ''").select(F.col("reading").alias("_r"), F.col("surface").alias("_s"))
    step = F.struct(F.length("_r").alias("n"), F.col("_s").alias("s"))
    live = entries.select("candidate", "reading", F.col("candidate").alias("_spell"), F.col("reading").alias("_left"), F.array().cast("array<struct<n:int,s:string>>").alias("path"))
    done = None
    for _ in range(max_pieces):
        cut = live.where("_left <> ''").withColumn("_n", F.explode(F.sequence(F.lit(1), F.length("_left")))).withColumn("_m", F.explode(F.sequence(F.lit(0), F.length("_spell"))))
        cut = cut.withColumns({"_r": F.substring(F.col("_left"), F.lit(1), F.col("_n")), "_s": F.substring(F.col("_spell"), F.lit(1), F.col("_m"))}).join(p, ["_r", "_s"])
        live = cut.select("candidate", "reading", F.substring(F.col("_spell"), F.col("_m") + 1, F.length("_spell")).alias("_spell"), F.substring(F.col("_left"), F.col("_n") + 1, F.length("_left")).alias("_left"), F.concat("path", F.array(step)).alias("path"))
        ended = live.where("_left = '' AND _spell = ''")
        done = ended if done is None else done.unionByName(ended)
    return done.groupBy("candidate", "reading").agg(F.min("path").alias("path"))


def prefilter(targets: DataFrame, sentence: list[str], limit=lx.TARGETS_PER_SENTENCE) -> DataFrame:
    """The riskiest targets of a sentence: low original score, low confidence, rare, many candidates, early."""
    w = Window.partitionBy(*sentence).orderBy(F.coalesce("original_score", F.lit(1.0)), F.coalesce("asr_confidence", F.lit(1.0)), F.col("vocab_rank").desc(), F.col("candidate_count").desc(), "start")
    return targets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def decide(targets: DataFrame, candidates: DataFrame, target: list[str], margin=lx.SCORE_MARGIN, require_original: bool = True, min_score=lx.MIN_CANDIDATE_SCORE) -> DataFrame:
    """One decision per target: the best candidate (ties: the first) and why it is taken or not.

    candidates(target, ord, text, score) have passed reading, class and script.
    """
    c = candidates.groupBy(*target).agg(F.max_by(F.struct("text", "score"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ord"))).alias("best"), F.count("*").alias("n_candidates"))
    d = targets.join(c, target, "left")
    score, old = F.col("best.score"), F.col("original_score")
    without = F.when(F.lit(require_original), "missing_original_score").when(score < min_score, "candidate_score_too_low").otherwise("accepted_same_reading_context")
    reason = (
        F.when(F.col("best").isNull(), "no_same_reading_candidate")
        .when(score.isNull(), "missing_candidate_score")
        .when(old.isNull(), without)
        .when(score <= old + margin, "candidate_not_better_than_original")
        .otherwise("accepted_same_reading_context")
    )
    d = d.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted_same_reading_context")
    chosen = F.when(F.col("accepted"), F.col("best.text")).otherwise(F.col("text"))
    return d.withColumns({"selected_text": chosen, "selected_score": score, "n_candidates": F.coalesce("n_candidates", F.lit(0))}).drop("best")


def apply_text_changes(sentences: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """sentences(text) with accepted changes(start, end, selected_text) put in by their offsets, which do not overlap."""
    c = changes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "selected_text"))).alias("c"))
    text = F.col("text")
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("selected_text"))
    step = lambda acc, x: F.struct(x["end"].cast("int").alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"].cast("int") - acc["at"]), x["selected_text"]).alias("out"))
    filled = F.aggregate(F.concat("c", F.array(end)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)["out"]
    return sentences.join(c, key, "left").withColumn("text", F.when(F.col("c").isNull(), text).otherwise(filled)).drop("c")


def surface_confidence(targets: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """targets with the least confidence of the first run of words that spells their text (null: none).

    A run begins and ends where words do, so only the starts of words are tried, at one comparison each.
    """
    word = F.struct("word_idx", "text", "confidence", F.sum(F.length("text")).over(Window.partitionBy(*key).orderBy("word_idx")).cast("int").alias("to"))
    a = words.select(*key, word.alias("w")).groupBy(*key).agg(F.array_sort(F.collect_list("w")).alias("w"))
    a = a.withColumn("_j", F.array_join(F.transform("w", lambda x: x["text"]), ""))
    t = targets.join(a, key, "left")
    first = F.transform("w", lambda x: x["to"] - F.length(x["text"]))
    fits = F.filter(first, lambda at: (F.substring(F.col("_j"), at + 1, F.length("text")) == F.col("text")) & F.exists("w", lambda x: x["to"] == at + F.length("text")))
    at = F.get(fits, F.lit(0))
    run = F.filter("w", lambda x: (x["to"] - F.length(x["text"]) >= at) & (x["to"] <= at + F.length("text")))
    return t.withColumn("asr_confidence", F.array_min(F.transform(run, lambda x: x["confidence"]))).drop("w", "_j")


@F.udf(T.ArrayType(T.StructType().add("text", "string").add("start", "double").add("end", "double").add("confidence", "double").add("speaker_id", "string")), useArrow=True)
def changed_words(words, changes):
    """A sentence's words after accepted changes, in their order: each takes the first words, one or a run, that spell its original.

    A run becomes one word of its whole range, least confidence and first speaker. A change whose result the word
    before already is counts as made and leaves its word as it was.
    """
    out, pending, i = [], list(changes or []), 0
    words = list(words or [])
    while i < len(words):
        for c in pending:
            j, spelled = i, ""
            while j < len(words) and len(spelled) < len(c["original"]):
                spelled, j = spelled + words[j]["text"], j + 1
            if spelled != c["original"]:
                continue
            run, word = words[i:j], dict(words[i] if isinstance(words[i], dict) else words[i].asDict())
            if len(run) > 1 or not (out and out[-1]["text"] == c["selected"]):
                sure = [w["confidence"] for w in run if w["confidence"] is not None]
                word |= {"text": c["selected"], "end": run[-1]["end"], "confidence": min(sure) if sure else None}
            out.append(word)
            pending.remove(c)
            i = j
            break
        else:
            out.append(dict(words[i] if isinstance(words[i], dict) else words[i].asDict()))
            i += 1
    return out


def geometric_mean(probabilities: Column, least: float = 1e-12) -> Column:
    """Of an array of token probabilities; a single one is returned as it is."""
    logs = F.aggregate(F.transform(probabilities, lambda p: F.ln(F.greatest(p, F.lit(least)))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(probabilities) == 1, F.get(probabilities, F.lit(0))).otherwise(F.exp(logs / F.size(probabilities)))


def vocabulary_rank(token_ids: Column, size: int) -> Column:
    """How rare a text's tokens are: the mean id as a share of the vocabulary, 1 at most and without tokens."""
    total = F.aggregate(token_ids, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(token_ids) > 0, F.least(total / F.size(token_ids) / size, F.lit(1.0))).otherwise(F.lit(1.0))


def top_tokens(tokens: DataFrame, target: list[str], k: int = 80) -> DataFrame:
    """The k likeliest of a model's tokens(text, score) for each target, a text once, with ``ord`` from 0."""
    best = tokens.groupBy(*target, "text").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*target).orderBy(F.col("score").desc(), "text")
    return best.withColumn("ord", F.row_number().over(w) - 1).where(F.col("ord") < k)


def clean_vocabulary(tokens: DataFrame, special: tuple[str, ...] = ()) -> DataFrame:
    """Usable texts of a model's vocabulary(ord, token): without word-piece marks and spaces, Japanese only, each once."""
    text = F.regexp_replace(word_text(F.regexp_replace("token", "^##", "")), " ", "")
    rows = tokens.where(~F.col("token").isin(*special) if special else F.lit(True)).withColumn("surface", text)
    rows = rows.where(has_japanese(F.col("surface")) & ~F.col("surface").rlike(r"[\[\]]"))
    return rows.groupBy("surface").agg(F.min("ord").alias("ord"))


def lexical_candidates(targets: DataFrame, lexicon: DataFrame, target: list[str], limit=lx.MAX_LEXICAL) -> DataFrame:
    """(target, candidate, rank): entries with a target's reading, then compositions of up to three pieces, under one limit.

    A composition must itself be an entry of equal reading, compatible class and script; whole entries are taken as they are.
    """
    whole = whole_candidates(targets, lexicon, target, limit).select(*target, "candidate", F.lit(0).alias("phase"), "rank")
    entry = lexicon.groupBy(F.col("surface").alias("candidate")).agg(F.min(F.struct("ord", "reading", "pos")).alias("e")).select("candidate", F.col("e.reading").alias("c_reading"), F.col("e.pos").alias("c_pos"))
    made = composed_entries(entry.select("candidate", F.col("c_reading").alias("reading")), lexicon.select("surface", "reading").distinct())
    made = targets.select(*target, "text", "reading", "pos").join(made, "reading").join(entry, "candidate")
    made = made.where((F.col("candidate") != F.col("text")) & (F.col("c_reading") == F.col("reading")) & compatible(F.col("text"), F.col("pos"), F.col("candidate"), F.col("c_pos")))
    made = made.withColumn("rank", F.row_number().over(Window.partitionBy(*target).orderBy("path")))
    both = whole.unionByName(made.select(*target, "candidate", F.lit(1).alias("phase"), "rank")).groupBy(*target, "candidate").agg(F.min(F.struct("phase", "rank")).alias("o"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(*target).orderBy("o"))).where(F.col("rank") <= limit).drop("o")


def resolve(sentences: DataFrame, morphemes: DataFrame, lexicon: DataFrame, scores: DataFrame, model: DataFrame | None = None, key: tuple[str, ...] = ("doc_id", "position", "sentence_index"), targets_each=lx.TARGETS_PER_SENTENCE, prefilter_targets: bool = True, eligible_script=has_japanese, **rule) -> tuple[DataFrame, DataFrame]:
    """Same-reading corrections of sentences(key, text, words), and one decision for each target that was looked at.

    morphemes(key, start, end, surface, reading, pos) are an analyser's tokens; lexicon(ord, surface, reading, pos,
    vocab_rank); scores(key, start, text, score) are a language model's, of originals and candidates; model(key,
    start, ord, text, score) are its own proposals, which go before lexical ones. A candidate must be a single token
    of the lexicon, of equal reading, compatible class and script. Without prefilter the first targets of a sentence are taken.
    """
    key, tk = list(key), [*key, "start"]
    t = morphemes.where(eligible(F.col("surface"), F.col("pos"), script=eligible_script)).select(*tk, "end", F.col("surface").alias("text"), "reading", "pos")
    entry = lexicon.groupBy(F.col("surface").alias("text")).agg(F.min(F.struct("ord", "reading", "pos", "vocab_rank")).alias("e"))
    own = scores.select(*tk, "text", F.col("score").alias("original_score"))
    t = t.join(own, [*tk, "text"], "left").join(entry.select("text", F.col("e.vocab_rank").alias("vocab_rank")), "text", "left").withColumn("vocab_rank", F.coalesce("vocab_rank", F.lit(1.0)))
    if prefilter_targets:
        lexical = lexical_candidates(t, lexicon, tk)
        t = t.join(lexical.groupBy(*tk).agg(F.count("*").alias("candidate_count")), tk)
        words = sentences.select(*key, F.posexplode("words").alias("word_idx", "w")).select(*key, "word_idx", "w.text", "w.confidence")
        t = prefilter(surface_confidence(t, words, key), key, targets_each)
    else:
        t = t.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("start"))).where(F.col("rank") <= targets_each)
        lexical = lexical_candidates(t, lexicon, tk)
    told = lexical.select(*tk, F.col("candidate").alias("text"), F.lit(1).alias("phase"), F.col("rank").alias("ord")).join(scores.where("score is not null"), [*tk, "text"])
    if model is not None:
        told = told.unionByName(model.select(*tk, "text", F.lit(0).alias("phase"), "ord", "score"))
    told = told.groupBy(*tk, "text").agg(F.min_by("score", F.struct("phase", "ord")).alias("score"), F.min(F.struct("phase", "ord")).alias("o"))
    near = told.withColumnRenamed("text", "c_text").join(entry.select(F.col("text").alias("c_text"), F.col("e.reading").alias("c_reading"), F.col("e.pos").alias("c_pos")), "c_text").join(t.select(*tk, "text", "reading", "pos"), tk)
    near = near.where((F.col("c_text") != F.col("text")) & (F.col("c_reading") == F.col("reading")) & compatible(F.col("text"), F.col("pos"), F.col("c_text"), F.col("c_pos")))
    near = near.withColumn("ord", F.row_number().over(Window.partitionBy(*tk).orderBy("o")))
    listed = near.groupBy(*tk).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("c_text").alias("text"), F.col("c_reading").alias("reading"), "score").alias("c")))), lambda x: x["c"]).alias("candidates"))
    decisions = decide(t, near.select(*tk, "ord", F.col("c_text").alias("text"), "score"), tk, **rule).join(listed, tk, "left")
    accepted = decisions.where("accepted")
    texts = apply_text_changes(sentences, accepted.select(*key, "start", "end", "selected_text"), key)
    changes = accepted.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(F.col("text").alias("original"), F.col("selected_text").alias("selected")).alias("c")))), lambda x: x["c"]).alias("_c"))
    out = texts.join(changes, key, "left")
    out = out.withColumn("words", F.when(F.col("_c").isNotNull(), changed_words("words", "_c")).otherwise(F.col("words"))).drop("_c")
    cols = [*tk, "end", F.col("text").alias("original_text"), "reading", "rank", "accepted", "reason", "original_score", "selected_text", "selected_score", "candidates"]
    return out, decisions.select(*cols)
