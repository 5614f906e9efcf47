"""Secret scans: sure patterns, and weak candidates that count only beside complementary parts.

Base spans (assign, access, hex) come from the patterns below. Weak parts - named identifiers, short or
bare secret-like tokens, endpoints - are linked by an interval join: parts of a text are dealt to buckets
of the scope's width, neighbouring buckets are joined on equality, and pairs within the scope count. A
weak secret is reported beside an identifier or endpoint, a weak identifier beside a secret, an endpoint
beside both.

Defined results: null text is empty; repeated rows get equal results; a null doc_id is a key like any
other; spans that start together stand in the order of their kinds; very long texts are read whole; an empty
table gives an empty table; columns of any name are kept by ``redact``. A text's spans are folded in its own row,
so no group of rows grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .spans import cut_spans, join_spans, match_spans, of_kind

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"

# Weak parts.
IDENTIFIER = r"""((?i:user_?name|user_?id|user|login|account|client_?id|access_?key_?id|access_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
SHORT = r"""((?i:pwd|pass|passphrase|credential|private_?key|secret_?key|auth))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})"""
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:[A-Za-z][A-Za-z0-9+.]{1,11}://[^\x20\x09-\x0D"'<>]+|(?i:host|hostname|endpoint|server|database|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9./:_-]{3,})"""

#: Code points between two parts at most.
SCOPE = 200
KINDS = ["assign", "access", "hex", "link_secret", "link_access", "link_endpoint"]


def found_parts(text):
    """Arrays of base spans and of weak parts (kind: secret, access, endpoint) of a text."""
    low = F.lower(text)

    def names(*words):
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    mark = text.contains(":") | text.contains("=")
    assign = F.filter(match_spans(text, ASSIGN, 2, mark & names("passw", "secret", "token", "api")), lambda s: F.length(s["value"]) >= 12)
    access = F.filter(match_spans(text, ACCESS, 0, text.contains("AKIA")), lambda s: s["end"] - s["start"] >= 18)
    hexes = match_spans(text, HEX)
    bare = F.filter(match_spans(text, BARE), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Z]") & s["text"].rlike("[a-z]"))
    short = match_spans(text, SHORT, 2, mark & names("pwd", "pass", "credential", "key", "auth"))
    named = match_spans(text, IDENTIFIER, 2, mark & names("user", "login", "account", "client", "access"))
    ends = match_spans(text, ENDPOINT, 0, mark & (text.contains("://") | names("host", "endpoint", "server", "database", "bucket")))
    base = F.concat(of_kind(assign, "assign", 0), of_kind(access, "access", 1), of_kind(hexes, "hex", 2))
    weak = F.concat(of_kind(short, "secret", 3), of_kind(bare, "secret", 3), of_kind(named, "access", 4), of_kind(ends, "endpoint", 5))
    return base, weak


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, digest (of the text) and spans, an array by start."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, weak = found_parts(F.col("t"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.xxhash64("t").alias("digest"), base.alias("base"), weak.alias("weak"))
    parts = scratch.write(read, "parts")
    key = ["k", "digest"]
    # a base span is strong; where a weak span lies in one, it adds nothing
    open_ = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    keyed = parts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("k"), "digest", "base", open_.alias("weak")).where(F.size("weak") > 0)
    role = F.when(F.col("p.rank").isin(0, 2, 3), "secret").when(F.col("p.rank").isin(1, 4), "access").otherwise("endpoint")
    every = keyed.select(*key, F.explode(F.concat("base", "weak")).alias("p")).select(*key, "p.start", "p.end", (F.col("p.rank") > 2).alias("weak"), role.alias("role")).distinct()
    every = scratch.write(every, "every")
    bucket = F.floor(F.col("start") / scope)
    mine = every.where("weak").select(*key, "start", "end", "role", F.explode(F.sequence(bucket - 1, F.floor(F.col("end") / scope) + 1)).alias("bucket"))
    other = every.select(*key, F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r"), F.explode(F.sequence(bucket, F.floor(F.col("end") / scope))).alias("bucket"))
    met = mine.join(other, [*key, "bucket"]).where((F.col("role") != F.col("r")) & (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope))
    met = met.where("not (s < end and start < e)")
    seen = met.groupBy(*key, "start", "end", "role").agg(*[F.bool_or(F.col("r") == r).alias(r) for r in ("secret", "access", "endpoint")])
    good = seen.where("(role = 'secret' and (access or endpoint)) or (role = 'access' and secret) or (role = 'endpoint' and secret and access)")
    rank = F.element_at(F.create_map(F.lit("secret"), F.lit(3), F.lit("access"), F.lit(4), F.lit("endpoint"), F.lit(5)), F.col("role"))
    linked = good.groupBy(*key).agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", F.concat(F.lit("link_"), "role").alias("kind"))).alias("linked"))
    all_ = parts.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).join(linked, key, "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return all_.select("doc_id", "digest", F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    s = secret_spans(docs, scope)

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    base = join_spans(F.filter("spans", lambda x: x["rank"] < 3))
    return s.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by a mark; ``n_chars``, if there is one, is counted anew for changed texts."""
    spans = secret_spans(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("doc"), "digest", "spans").distinct()
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("row"))  # whatever the columns are called
    at = {c: F.col(f"row.c{k}") for k, c in enumerate(columns)}
    text = F.coalesce(at["text"].cast("string"), F.lit(""))
    joined = row.join(spans, at["doc_id"].cast("long").eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("digest")), "left")
    joined = joined.withColumn("new", F.when(F.col("spans").isNull(), at["text"]).otherwise(cut_spans(text, F.col("spans"), mark)))
    out = dict(at) | {"text": F.col("new")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("spans").isNull(), at["n_chars"]).otherwise(F.length("new")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) for c in columns])
