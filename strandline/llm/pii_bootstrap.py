"""Personal data: sure patterns, then contexts learned from them discover further identifiers.

Seeds are the base matches. Every identifier-like token (a digit in five characters or more, or an @)
is an instance; the two words before it on its line are a lexical pattern. Patterns and instances form
a bipartite graph for each kind, which grows from the seeds: in each round the instances that are believed so far
induce the patterns that they stand in. A pattern's confidence is the believed share of its distinct instances,
discounted for few instances; an instance is believed by the noisy-or of its patterns if that is 0.5 or more;
seeds stay at 1. Instances first believed in one round induce further patterns in the next. After the last round,
patterns of high confidence and support name the kind of the unseen tokens that they precede (``ctx_email`` and
so on).

Defined results: null text is empty; repeated rows count once for the graph and get equal results; of kinds that
tie for a pattern the later by name is taken; spans of one kind stand in order of their start; very long texts and
words are read whole; a null doc_id is a key like any other; a table without seeds learns nothing; an empty table
gives an empty table; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .spans import join_spans, match_spans, of_kind

# The patterns of the base kinds. Possessive repeats and starts at a run's edge match the
# same spans as the plain forms and stay linear in long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

SLOT = r"(?<!\S)[^\s0-9@]*+[0-9@][^\s]*+"
# The last two words of a line so far; possessive, and from a word's start only, so linear.
LAST_TWO = r"(?<!\S)(\S++[^\S\n]++\S++)[^\S\n]*+\z"
KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        d2 = d * 2
        return acc + F.when(i % 2 == 1, F.when(d2 > 9, d2 - 9).otherwise(d2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text):
    has_digit = text.rlike("[0-9]")
    email = match_spans(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(match_spans(text, IP, 0, has_digit), lambda s: s["text"].rlike(OCTETS))

    def digits(s):
        return F.regexp_replace(s["text"], "[^0-9]", "")

    card = F.filter(match_spans(text, CARD, 0, has_digit), lambda s: F.when(F.length(digits(s)).between(13, 19), luhn(digits(s))).otherwise(False))
    phone = F.filter(match_spans(text, PHONE, 0, text.contains("+")), lambda s: F.length(digits(s)).between(9, 15))
    return F.concat(*[of_kind(s, kind, rank) for rank, (kind, s) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True))])


def slots(text):
    """Identifier-like tokens with their two words before, on the same line, digits folded.

    A token is a word without spaces, so the words before it lie in the two tokens before it and the gaps after these.
    """
    gate = text.rlike("[0-9@]")
    raw, gaps = match_spans(text, SLOT, 0, gate), F.when(gate, F.split(text, SLOT, -1)).otherwise(F.array(F.lit("")))

    def of(held):
        def one(s, i):
            def at(name, k, part=None):
                x = F.get(held[name], i - k)
                return F.coalesce(x if part is None else x[part], F.lit(""))

            before = F.concat(at("spans", 2, "text"), at("gaps", 1), at("spans", 1, "text"), at("gaps", 0))
            clean = F.regexp_replace(F.lower(F.regexp_extract(before, LAST_TWO, 1)), "[0-9]", "0")
            token = F.regexp_replace(s["text"], r"^[\"'(\[<{]+|[\"')\]>},.;:!?]+$", "")
            lead = F.length(F.regexp_extract(s["text"], r"^([\"'(\[<{]*)", 1))
            fine = (s["end"] - s["start"] >= 5) | s["text"].contains("@")
            return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(token)).alias("end"), token.alias("token"), clean.alias("context"), fine.alias("fine"))

        return F.filter(F.transform(held["spans"], one), lambda s: s["fine"] & (s["context"] != "") & (s["end"] > s["start"]))

    # an array of one holds the tokens and gaps, as an expression within a lambda would be computed again for each token
    return F.get(F.transform(F.array(F.struct(raw.alias("spans"), gaps.alias("gaps"))), of), F.lit(0))


def bootstrap(occurrences: DataFrame, scratch: Scratch, rounds: int, smooth: float) -> DataFrame:
    """occurrences(kind or null, context, token) -> (context, kind, confidence, support).

    Iterates over the distinct edges of the pattern-instance graph; every step is a join on a key with
    sums that are combined before the shuffle.
    """
    seeds = scratch.write(occurrences.where("kind is not null").select("token", F.col("kind").alias("k"), F.lit(1.0).alias("p")).distinct(), "seeds")
    edges = scratch.write(occurrences.select("context", "token").distinct(), "edges")
    sizes = edges.groupBy("context").agg(F.count("*").alias("n"))
    believed = seeds
    for r in range(rounds):
        mass = edges.join(believed, "token").groupBy("context", "k").agg(F.sum("p").alias("mass"), F.count("*").alias("support"))
        score = scratch.write(mass.join(sizes, "context").select("context", "k", (F.col("mass") / (F.col("n") + smooth)).alias("confidence"), "support"), f"patterns-{r}")
        noisy_or = 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        belief = edges.join(score, "context").groupBy("token", "k").agg(noisy_or.alias("p")).where("p >= 0.5")
        believed = scratch.write(belief.unionAll(seeds).groupBy("token", "k").agg(F.max("p").alias("p")), f"instances-{r}")
    return score.select("context", F.col("k").alias("kind"), "confidence", "support")


def personal_spans(docs: DataFrame, rounds: int = 3, smooth: float = 1.0, confidence: float = 0.5, support: int = 3) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and its spans, base and discovered."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    parts = scratch.write(read.select("doc_id", F.xxhash64("t").alias("digest"), base_spans(F.col("t")).alias("base"), slots(F.col("t")).alias("slots")), "parts")
    held = F.filter("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    seen = parts.where(F.size("slots") > 0).select("doc_id", "digest", "base", F.explode("slots").alias("s"))
    seen = seen.select("doc_id", "digest", "s.start", "s.end", "s.token", "s.context", F.get(held, F.lit(0))["kind"].alias("kind"))
    seen = scratch.write(seen, "slots")
    patterns = bootstrap(seen.select("kind", "context", "token"), scratch, rounds, smooth).where((F.col("confidence") >= confidence) & (F.col("support") >= support))
    best = patterns.groupBy("context").agg(F.max_by("kind", F.struct("confidence", "support", "kind")).alias("as"))
    found = seen.where("kind is null").join(best, "context")
    rank = F.element_at(F.create_map(*[F.lit(x) for r, k in enumerate(KINDS) for x in (k, len(KINDS) + r)]), F.col("as"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k")
    more = found.groupBy(key, "digest").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("ctx_"), "as").alias("kind"))).alias("more"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    out = parts.select("doc_id", "digest", "base", key).join(more, ["k", "digest"], "left")
    return out.select("doc_id", "digest", F.concat("base", F.coalesce("more", none)).alias("spans"))


def personal_report(docs: DataFrame, **settings) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text, by kind."""
    s = personal_spans(docs, **settings)

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = join_spans(F.filter("spans", lambda x: x["rank"] < len(KINDS)), "kind")
    return s.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), join_spans(F.col("spans"), "kind").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
