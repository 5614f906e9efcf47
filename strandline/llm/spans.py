"""Code-point spans of regular-expression matches with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string,value:string>>"


#: Matches of a text that are folded at a time: a fold copies what it has for each match.
FOLD = 128


def match_spans(text: Column, pattern: str, group: int = 0, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a pattern that matches no empty string, in order.

    Matches and the gaps between them (the parts of a split) add up to the text, so each match starts at
    the sum of the lengths before it. ``value`` is the given group. Rows that fail ``gate`` are not searched.
    Sums are taken over stretches of FOLD matches and then within them, so a text's matches cost linear time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    empty = F.array().cast(SPAN)
    rows = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("m"), values.alias("v")), lambda x: x["m"].isNotNull())
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), lambda b: b * FOLD + 1)

    def stretch(rows_):
        blocks = F.transform(cut, lambda b: F.slice(rows_, b, FOLD))
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(sums)), within))

    def within(block, start):
        def add(acc, x):
            at = acc["at"] + x["gap"]
            end = at + F.length(x["m"])
            one = F.struct(at.alias("start"), end.alias("end"), x["m"].alias("text"), x["v"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), empty.alias("out")), add)["out"]

    # an array of one holds the matches, as an expression within a lambda would be computed again for each stretch
    folded = F.get(F.transform(F.array(rows), stretch), F.lit(0))
    hit = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(hit, folded).otherwise(empty)


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def join_spans(spans: Column, by: str = "start") -> Column:
    """kind:start:end, comma-joined, by start then rank of kind, or by rank of kind then start."""
    if by == "kind":
        spans = F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cut_spans(text: Column, spans: Column, mark: str) -> Column:
    """text with every span replaced by a mark; spans that overlap or touch are replaced once."""
    merged = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))),
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["b"]))
    ends = F.concat(F.transform(merged, lambda s: s["a"]), F.array(F.length(text)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(text, s["a"] + 1, s["b"] - s["a"]))
    return F.when(F.size(spans) > 0, F.array_join(parts, mark)).otherwise(text)
