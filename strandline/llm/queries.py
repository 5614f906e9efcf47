"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_prefix, decontam_sam, langid_ftrl, license_minhash, nn_descent, pii_bootstrap, secret_link, sentencepiece_sampling, superminhash, url_cascade

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Domains of the block list.
LISTED = ["spam-farm.example.org", "spam-farm.example.com", "spam-farm.example.net", "cheap-pills.example.com", "cheap-pills.example.org", "cheap-pills.example.net"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_sampling.encode_samples(docs, F.col("doc_id"), samples=3, verify=True)
    s = F.col("samples")
    return out.select("doc_id", F.size(s).alias("n_samples"), F.transform(s, lambda x: F.size(x["ids"])).alias("n_pieces"), F.transform(s, lambda x: x["log_prob"]).alias("log_prob"), F.transform(s, lambda x: x["perturbed"]).alias("perturbed"), F.transform(s, lambda x: x["inclusion"]).alias("inclusion"), F.transform(s, lambda x: F.xxhash64(x["ids"])).alias("ids_hash"), "roundtrip")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return url_cascade.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_link.secret_report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_report(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_prefix.read_back(chat_prefix.expand(turns.unionByName(own)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_minhash.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0))
    return out.select("doc_id", F.array_join("names", ",").alias("names"), F.size("names").alias("n_licenses"), F.size("licenses").alias("n_hits"), best.alias("best"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid_ftrl.train(docs, ~langid_ftrl.held_out())
    out = langid_ftrl.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid_ftrl.held_out().alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam_sam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", dirty.alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_secrets, op4_pii, op5_chat, op6_licenses, op7_near_dedup, op8_embeddings, op9_language, op10_decontaminate)}

_HOST = "translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}{h}{p}{{}}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_RULE = "CASE " + _FITS.replace("{}", "") + " END"
_VERDICT = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " ELSE CASE WHEN " + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED) + " THEN 'block' ELSE 'allow' END END"

_SAID = "'</s>[INST] ok [/INST]'"


def _escaped(x: str, marks: str) -> str:
    return f"length({x})" + "".join(f" + length({x}) - length(replace({x}, '{m}', ''))" for m in marks)


_CHAT = f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
p AS (SELECT *, 14 + {_escaped('role', chr(92) + '<[]')} + {_escaped('text', chr(92) + '<[')} AS n, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, role = 'assistant' AS reply FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (reply), '')) AS loss_sha256,
CAST(coalesce(sum(upto) FILTER (reply), 0) + CASE WHEN arg_max(reply, k) THEN 0 ELSE max(upto) END AS BIGINT) AS formatted_chars, count(*) FILTER (reply) AS n_examples FROM c GROUP BY conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
o AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
l AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)"""

_VECTORS = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_max(list_transform(x, lambda v: abs(v))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
k AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept, 1.0::DOUBLE AS recall FROM e JOIN k USING (vec_id) LEFT JOIN n USING (vec_id)"""

_LEAKS = f"""WITH d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
b AS (SELECT item_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, m WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, n, i FROM p JOIN g USING (n, g)),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""


def _either(words: str) -> str:
    """A pattern of words whose ASCII letters stand in either case (a flag would also fold other letters)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _found(kind: str, rank: int, pattern: str, fine: str = "true", end: str = "length(m)") -> str:
    """Leftmost matches m of a pattern in texts d(doc_id, t): matches and the gaps between them add up to the text."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + {end.replace('PATTERN', p)} AS BIGINT) AS e, '{kind}' AS kind, {rank} AS rank FROM (
SELECT doc_id, m, sum(length(g) + coalesce(length(b), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, i, a[i] AS m, a[i - 1] AS b, c[i] AS g FROM (
SELECT doc_id, a, c, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS a, string_split_regex(t, '{p}') AS c FROM d)))) WHERE {fine.replace('PATTERN', p)}"""


_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
_PARTS = [
    _found("assign", 0, f"({_either('password|passwd|secret|token|api_?key')}){_NAMED}([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(m, 'PATTERN', 2)) >= 12"),
    _found("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
    _found("hex", 2, "[0-9a-f]+", "length(m) >= 16"),
    _found("secret", 3, f"({_either('pwd|pass|passphrase|credential|private_?key|secret_?key|auth')}){_NAMED}([A-Za-z0-9+/_.=!@#$%^&*-]{{6,}})"),
    # a bare token opens a run of its letters and equals signs
    _found("secret", 3, "[A-Za-z0-9+/_=-]+", "x <> '' AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')", "length(x)").replace("SELECT doc_id, m, sum", "SELECT doc_id, regexp_extract(m, '^[A-Za-z0-9+/_-]{20,}={0,2}') AS x, m, sum"),
    _found("access", 4, f"({_either('user_?name|user_?id|user|login|account|client_?id|access_?key_?id|access_?key')}){_NAMED}([A-Za-z0-9._@+-]{{3,}})"),
    _found("endpoint", 5, rf"""(?:[A-Za-z][A-Za-z0-9+.]{{1,11}}://[^\x20\x09-\x0D"'<>]+|(?:{_either('host|hostname|endpoint|server|database|bucket')}){_NAMED}[A-Za-z0-9./:_-]{{3,}})"""),
]
_SCOPE = secret_link.SCOPE
_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({' UNION ALL '.join(_PARTS)}),
base AS (SELECT * FROM p WHERE rank < 3), weak AS (SELECT DISTINCT * FROM p WHERE rank > 2 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.s < p.e AND p.s < b.e)),
every AS (SELECT doc_id, s, e, kind AS role FROM weak UNION SELECT doc_id, s, e, CASE kind WHEN 'access' THEN 'access' ELSE 'secret' END FROM base),
seen AS (SELECT w.doc_id, w.s, w.e, w.kind, w.rank, bool_or(o.role = 'secret') AS secret, bool_or(o.role = 'access') AS access, bool_or(o.role = 'endpoint') AS endpoint FROM weak w JOIN every o ON o.doc_id = w.doc_id AND o.role <> w.kind AND o.s - w.e <= {_SCOPE} AND w.s - o.e <= {_SCOPE} AND NOT (o.s < w.e AND w.s < o.e) GROUP BY ALL),
spans AS (SELECT doc_id, s, e, kind, rank FROM base UNION ALL SELECT doc_id, s, e, 'link_' || kind, rank FROM seen WHERE CASE kind WHEN 'secret' THEN access OR endpoint WHEN 'access' THEN secret ELSE secret AND access END),
o AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS x FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN o USING (doc_id)"""

ORACLE = {
    "op3_secrets": _SECRETS,
    "op5_chat": _CHAT,
    "op7_near_dedup": _NEAR,
    "op8_embeddings": _VECTORS,
    "op10_decontaminate": _LEAKS,
    "op2_url_filter": f"WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages), r AS (SELECT *, {_RULE} AS rule FROM p) SELECT page_id, host, path, rule, {_VERDICT} AS verdict FROM r",
}
