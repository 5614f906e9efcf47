"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Texts and templates are read as five-word shingles. Templates are classed by length; for each class the
shingles of a text are cut into windows that overlap so far that any stretch of a template's length lies
within one. Each band is one MinHash value. Bands of windows are joined by (class, band, value) with the bands of
the templates; a window and a template that meet are compared exactly, and the template is reported if the window
holds 0.8 of its shingles or more. A window has at most 2.5 times a template's shingles, so one that holds 0.8 of
them has a similarity of 0.29 or more, and 32 bands of one row miss it with probability below 2e-5.

Two tests that lose nothing come first. A text can hold 0.8 of a template's shingles only if it has a word of any
set of words whose shingles are more than 0.2 of the template's: for each template such a set is chosen, longest
words first, and texts without any of these words are not cut into shingles. Windows that share no shingle with any
template of their class cannot agree in a band and get none.

Defined results: null, empty and short texts report nothing; very long texts are read whole; repeated rows get
equal results; a null doc_id is a key like any other; a template of fewer than five words is one shingle; templates
that tie are all reported, in order of name; an empty table gives an empty table; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .license_texts import TEMPLATES

WIDTH = 5
BANDS = 32
#: Templates are broadcast: beyond this many shingles (8 bytes each, and their bands) a call raises; split them over several.
MAX_TEMPLATE_SHINGLES = 50_000
FOUND = "array<struct<name:string,containment:double,start:int,end:int>>"


def words_of(low: Column) -> Column:
    """Runs of letters and digits of a lower-cased text."""
    return F.filter(F.split(low, r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of the five-word shingles, in order; of fewer words, of all of them."""
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, WIDTH)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def band_values(shingles: Column) -> Column:
    """The least value of each of the permutations, an array by band."""
    return F.transform(F.array(*[F.lit(k) for k in range(BANDS)]), lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k))))


def class_of(n: int) -> int:
    """The length class of a template of n shingles: the next power of two."""
    return 1 << (n - 1).bit_length()


def window_of(size: int) -> tuple[int, int]:
    """Stride and length of a class's windows: ``size`` shingles in a row lie within one of them."""
    stride = max(1, size // 4)
    return stride, size + stride - 1


def telling_words(templates: list, containment: float) -> list[str]:
    """Words of which a text that holds ``containment`` of any template has at least one.

    templates: (words, shingle hashes in order). A template's words are taken longest first until the shingles
    that hold one of them are too many to be missing.
    """
    chosen: set[str] = set()
    for words, hashes in templates:
        kinds = len(set(hashes))
        spans = [words[i : i + WIDTH] for i in range(len(hashes))]

        def held(taken):
            return len({h for h, span in zip(hashes, spans, strict=True) if not taken.isdisjoint(span)})  # noqa: B023

        mine: set[str] = chosen & set(words)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if kinds - held(mine) < containment * kinds - 1e-9:
                break
            mine.add(w)
        chosen |= mine
    return sorted(chosen)


def template_rows(spark: SparkSession, templates: dict[str, str]) -> list:
    """(name, words, hashes in order, distinct hashes, bands) of each template, by the expressions that texts are read with; bounded by its check."""
    df = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", words_of(F.lower("text")).alias("words"))
    df = df.select("name", "words", shingles_of(F.col("words")).alias("hashes")).withColumn("h", F.array_distinct("hashes"))
    rows = [r for r in df.withColumn("bands", band_values(F.col("h"))).collect() if r["h"]]
    if sum(len(r["h"]) for r in rows) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("too many template shingles for one call")
    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, licenses (name, containment, word span) by start, and their names."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = template_rows(spark, templates or TEMPLATES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.lower(text).alias("low"))
    telling = F.lit(False)
    for w in telling_words([(r["words"], r["hashes"]) for r in rows], containment):
        telling = telling | F.col("low").contains(w)
    every = F.array(*[F.lit(x) for x in sorted({x for r in rows for x in r["h"]})]) if rows else F.array().cast("array<bigint>")
    none = F.array().cast("array<bigint>")
    # generators of one element hold the words and the hashes, as an expression within a lambda would be computed again for each element
    cut = read.select("doc_id", "digest", F.explode(F.array(F.when(telling, words_of(F.col("low"))).otherwise(F.array().cast("array<string>")))).alias("words"))
    cut = cut.select("doc_id", "digest", F.explode(F.array(shingles_of(F.col("words")))).alias("h"))
    parts = scratch.write(cut.select("doc_id", "digest", F.when(F.arrays_overlap("h", every), F.col("h")).otherwise(none).alias("h")), "parts")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k")
    sizes = sorted({class_of(len(r["h"])) for r in rows}) or [1]
    known = {s: sorted({x for r in rows if class_of(len(r["h"])) == s for x in r["h"]}) for s in sizes}
    classes = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(window_of(s)[0]).alias("stride"), F.lit(window_of(s)[1]).alias("reach"), F.array(*[F.lit(x) for x in known[s]]).cast("array<bigint>").alias("known")) for s in sizes])
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - F.col("c.reach"), F.lit(0)) + F.col("c.stride") - 1, F.col("c.stride"))
    windows = parts.where(F.size("h") > 0).select(key, "digest", "h", F.explode(classes).alias("c")).select("k", "digest", "h", "c.size", "c.reach", "c.known", F.explode(starts).alias("i"))
    windows = windows.select("k", "digest", "size", "i", "known", F.slice("h", F.col("i") + 1, F.col("reach")).alias("w")).where(F.arrays_overlap("w", "known"))
    banded = windows.select("k", "digest", "size", "i", "w", F.posexplode(band_values(F.col("w"))).alias("band", "value"))
    index = spark.createDataFrame([(r["name"], class_of(len(r["h"])), b, v, r["h"]) for r in rows for b, v in enumerate(r["bands"])], "name string, size int, band int, value long, t array<long>")
    met = banded.join(F.broadcast(index), ["size", "band", "value"])  # of at most MAX_TEMPLATE_SHINGLES templates
    share = F.size(F.array_intersect("t", "w")) / F.size("t")
    hits = met.select("k", "digest", "name", share.alias("containment"), F.col("i").alias("start"), (F.col("i") + F.size("w") + WIDTH - 1).alias("end")).where(F.col("containment") >= containment)
    found = hits.groupBy("k", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "name", "containment", "end"))).alias("hits"))
    out = parts.select("doc_id", key, "digest").join(found, ["k", "digest"], "left")
    licenses = F.transform("hits", lambda x: F.struct(x["name"].alias("name"), x["containment"].alias("containment"), x["start"].alias("start"), x["end"].alias("end")))
    out = out.select("doc_id", F.coalesce(licenses, F.array().cast(FOUND)).alias("licenses"))
    return out.select("doc_id", "licenses", F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["name"]))).alias("names"))
