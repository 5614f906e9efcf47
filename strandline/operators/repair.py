"""The gate for proposed repairs of a text: how far may a candidate leave its original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as lx
from ..functions.text import clean_output, nfkc, safety_core, strip
from ..schema import SENTENCE, segment_speaker
from .sequence import neighbours


@F.pandas_udf(T.DoubleType())
def content_change(a, b):
    """Characters in changed stretches of an edit script (the larger side of each), as a share of the longer text."""
    from difflib import SequenceMatcher

    def one(x, y):
        if x is None or y is None:
            return None
        changed = sum(max(i1 - i0, j1 - j0) for tag, i0, i1, j0, j1 in SequenceMatcher(None, x, y).get_opcodes() if tag != "equal")
        return changed / max(len(x), len(y), 1)

    return a.combine(b, one)


def gate_repairs(df: DataFrame, original: str = "original_text", candidate: str = "candidate_text", max_length=lx.MAX_LENGTH_DELTA, max_change=lx.MAX_CONTENT_CHANGE, exact_ratio: bool = True) -> DataFrame:
    """df with accepted, reason, length_delta_ratio, content_change_ratio and selected_text.

    Equal cores accept, so punctuation, case and width edits pass. Without ``exact_ratio`` the edit script is
    not built for rows whose Levenshtein distance, a lower bound of it, already decides; the bound is reported.
    """
    o, c = strip(F.col(original)), strip(F.col(candidate))
    df = df.withColumns({"_o": o, "_c": c}).withColumns({"_a": safety_core(nfkc(F.col("_o"))), "_b": safety_core(nfkc(F.col("_c")))})
    length = F.abs(F.length("_b") - F.length("_a")) / F.greatest(F.length("_a"), F.lit(1))
    bound = F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"), F.lit(1))
    open_ = (F.col("_c") != "") & (F.col("_a") != F.col("_b"))
    ask = open_ if exact_ratio else open_ & (length <= max_length) & (bound <= max_change)
    script = content_change(F.when(ask, F.col("_a")), F.when(ask, F.col("_b")))
    df = df.withColumn("_s", script)
    ratio = F.when(F.col("_c") == "", F.lit(1.0)).when(F.col("_a") == F.col("_b"), F.lit(0.0)).otherwise(F.coalesce("_s", bound))
    delta = F.when(F.col("_c") == "", F.lit(1.0)).when(F.col("_a") == F.col("_b"), F.lit(0.0)).otherwise(length)
    df = df.withColumns({"length_delta_ratio": delta, "content_change_ratio": ratio})
    reason = F.when(F.col("_c") == "", "empty_candidate").when(F.col("length_delta_ratio") > max_length, "length_delta_exceeded").when(F.col("content_change_ratio") > max_change, "content_change_exceeded").otherwise("accepted")
    df = df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "accepted")
    return df.withColumn("selected_text", F.when(F.col("accepted"), F.col("_c")).otherwise(F.col("_o"))).drop("_o", "_c", "_a", "_b", "_s")


def prompt(template: str, text: str = "text") -> Column:
    """A template with {prev}, {text} and {next} filled in."""
    out = F.lit(template)
    for name, column in (("{prev}", "prev_text"), ("{text}", text), ("{next}", "next_text")):
        out = F.replace(out, F.lit(name), F.col(column))
    return out


def repair_with(df: DataFrame, repair: Column, key: str, order: str) -> DataFrame:
    """Asks a plugged-in model (a column over text, prev_text and next_text) and applies the gate; neighbours are the unrepaired texts."""
    return gate_repairs(neighbours(df, [key], [order], "text").withColumn("candidate_text", clean_output(repair)), "text")


def repair_segments(segments: DataFrame, repair: Column, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Segments whose text is repaired, as one sentence with all their words, and the gate's decisions."""
    rows = repair_with(segments, repair, key, "position")
    decisions = rows.select(key, "position", F.col("text").alias("original_text"), "candidate_text", "accepted", "reason", "length_delta_ratio", "content_change_ratio", "selected_text")
    words = F.flatten(F.transform(F.coalesce("sentences", F.array().cast(f"array<{SENTENCE}>")), lambda s: s["words"]))
    one = F.struct(F.col("selected_text").alias("text"), "start", "end", segment_speaker().alias("speaker_id"), words.alias("words"))
    out = rows.withColumn("sentences", F.array(one).cast(f"array<{SENTENCE}>")).withColumn("text", F.col("selected_text"))
    return out.select(*segments.columns), decisions
