"""SQL for the registered queries, to be run by DuckDB over the same tables."""

SEG = """seg0 AS (SELECT conv_id AS doc_id, turn AS position, role AS speaker_id, coalesce(text, '') AS text, 50 * length(coalesce(text, '')) AS dur,
 (turn * 137 + conv_id * 71) % 900 - 100 AS gap FROM conversations),
seg AS (SELECT doc_id, position, speaker_id, text, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, dur FROM seg0),
segments AS (SELECT doc_id, position, speaker_id, text, s AS "start", s + dur AS "end" FROM seg)"""
WORDS = SEG + """,
w0 AS (SELECT doc_id, position, speaker_id, "start" AS s0, unnest(regexp_split_to_array(text, '[ \n]+')) AS text, generate_subscripts(regexp_split_to_array(text, '[ \n]+'), 1) - 1 AS word_idx FROM segments),
w1 AS (SELECT doc_id, position, speaker_id, word_idx, text, CAST(s0 + 50 * coalesce(sum(length(text)) OVER (PARTITION BY doc_id, position ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM w0 WHERE text <> ''),
words AS (SELECT *, "start" + 50 * length(text) AS "end" FROM w1)"""
TURNS = """turns AS (SELECT doc_id, position AS turn_idx, speaker_id, "start" + (doc_id * 31) % 400 AS t_start, "end" + (doc_id * 31) % 400 AS t_end FROM segments)"""
ASSIGN = WORDS + ", " + TURNS + """,
met AS (SELECT w.doc_id, w.position, w.word_idx, t.speaker_id AS sp, sum(least(w."end", t.t_end) - greatest(w."start", t.t_start)) AS o, min(t.turn_idx) AS f FROM words w JOIN turns t ON w.doc_id = t.doc_id AND w."start" < t.t_end AND t.t_start < w."end" AND least(w."end", t.t_end) > greatest(w."start", t.t_start) GROUP BY ALL),
best AS (SELECT doc_id, position, word_idx, sp FROM met QUALIFY row_number() OVER (PARTITION BY doc_id, position, word_idx ORDER BY o DESC, f) = 1),
assigned AS (SELECT w.*, coalesce(b.sp, w.speaker_id) AS assigned FROM words w LEFT JOIN best b USING (doc_id, position, word_idx))"""
CUES = SEG + """,
l0 AS (SELECT doc_id, position, speaker_id, text AS whole, "start" AS s0, "end" AS e0, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM segments),
l1 AS (SELECT doc_id, position, i, text, s0 + i * 10 AS "start", s0 + i * 10 + 10 AS "end", speaker_id FROM l0 WHERE text <> ''
 UNION ALL SELECT doc_id, position, 0, text, "start", "end", speaker_id FROM segments WHERE replace(text, chr(10), '') = ''),
cues AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position, i) AS "index", "start", "end", speaker_id, text FROM l1)"""
MERGED = CUES + """,
e0 AS (SELECT *, coalesce((lead("start") OVER w) - "end" BETWEEN 0 AND 350 AND length(text) + length(lead(text) OVER w) <= 1500 AND NOT regexp_matches(text, '(\\?|ion\\.)$') AND speaker_id IS NOT DISTINCT FROM (lead(speaker_id) OVER w) AND (lead("start") OVER w) IS NOT NULL, false) AS e FROM cues WINDOW w AS (PARTITION BY doc_id ORDER BY "index")),
e1 AS (SELECT *, coalesce(sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, r ORDER BY "index") % 2 AS head FROM e1),
e3 AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY "index") AS pair FROM e2),
e4 AS (SELECT doc_id, pair, min("start") AS "start", max_by("end", "index") AS "end", min_by(speaker_id, "index") AS speaker_id, string_agg(text, '' ORDER BY "index") AS text FROM e3 GROUP BY ALL),
merged AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pair) AS "index", "start", "end", speaker_id, text FROM e4)"""
WSP = r"[\s\x{3000}\x{a0}\x1c-\x1f]"


def readable(x: str) -> str:
    y = f"regexp_replace({x}, '^{WSP}+|{WSP}+$', '', 'g')"
    for a, b in ((",", "、"), ("，", "、"), (".", "。"), ("．", "。")):
        y = f"replace({y}, '{a}', '{b}')"
    y = f"regexp_replace({y}, '{WSP}+', ' ', 'g')"
    return y


def opened(y: str) -> str:
    out = f"CASE WHEN regexp_matches({y}, '^(The of|De la)') THEN {y} "
    for m in ("The", "De", "La"):
        out += f"WHEN starts_with({y}, '{m}') THEN CASE WHEN substr({y}, {len(m) + 1}) = '' OR starts_with(substr({y}, {len(m) + 1}), '、') THEN {y} ELSE '{m}、' || substr({y}, {len(m) + 1}) END "
    return out + f"ELSE {y} END"


def squeezed(y: str) -> str:
    for m in "。、？！":
        y = f"regexp_replace({y}, '{m}+', '{m}', 'g')"
    return y


def srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


LEX = """lex0 AS (SELECT surface, count(*) AS n, regexp_replace(surface, '[aeiou]', '', 'g') AS reading FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS surface FROM benchmark) WHERE length(surface) >= 3 GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY surface) AS ord FROM lex0 WHERE reading <> '')"""
FLAG = MERGED + f", r1 AS (SELECT * REPLACE ({readable('text')} AS text) FROM merged), r2 AS (SELECT * REPLACE ({opened('text')} AS text) FROM r1), fin AS (SELECT * REPLACE ({squeezed('text')} AS text) FROM r2)"

def compact(x: str) -> str:
    return f"regexp_replace({x}, '{WSP}', '', 'g')"


QUOTES = "[」』）)】］\\]〉》]*$"


def ending(x: str, words: str) -> str:
    return f"regexp_matches(regexp_replace({x}, '{QUOTES}', ''), '({words})$')"


def folded(words: str) -> str:
    """Boundaries of sentences: words(k, i, word_idx, text, s, e) of a sentence k, i from 1, walked one word at a time."""
    first = "(qu|de|the|la|un)"
    return f"""x0 AS (SELECT *, {compact('text')} AS c FROM {words}),
x1 AS (SELECT k, i, word_idx, length(c) AS nc, sum(length(c)) OVER w AS at_c, sum(length(text)) OVER w AS upto, lead(s) OVER w - e AS gap, {ending('c', '[.]')} AS mark FROM x0 WINDOW w AS (PARTITION BY k ORDER BY i)),
x2 AS (SELECT k, string_agg(c, '' ORDER BY i) AS u, sum(length(text)) AS nt FROM x0 GROUP BY k HAVING count(*) > 1),
walk AS (SELECT k, u, nt, CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS first, CAST(0 AS HUGEINT) AS first_c, CAST(NULL AS BIGINT) AS word_idx, CAST(NULL AS VARCHAR) AS reason FROM x2
UNION ALL SELECT k, u, nt, i, CASE WHEN reason IS NULL THEN first ELSE upto END, CASE WHEN reason IS NULL THEN first_c ELSE at_c END, word_idx, reason FROM (
SELECT *, CASE WHEN upto <= first OR upto >= nt THEN NULL WHEN mark OR {ending('bare', '[.]')} THEN 'terminal_mark' WHEN regexp_matches(ahead, '^{first}') THEN NULL WHEN regexp_matches(ahead, '^\\p{{Nd}}') AND NOT final THEN NULL
WHEN gap >= 1.5 THEN 'strong_pause' WHEN at_c - first_c >= 2 AND bare = again THEN 'repeated_heading' WHEN final AND gap >= 0.5 THEN 'pause_after_sentence_final' WHEN final THEN 'sentence_final_expression' END AS reason FROM (
SELECT *, {ending('bare', 'ion|en')} AS final FROM (SELECT r.k, r.u, r.nt, x.i, r.first, r.first_c, x.word_idx, x.upto, x.at_c, x.gap, x.mark, substr(r.u, CAST(r.first_c + 1 AS BIGINT), CAST(x.at_c - r.first_c AS BIGINT)) AS bare, substr(r.u, CAST(x.at_c + 1 AS BIGINT), 3) AS ahead, substr(r.u, CAST(x.at_c + 1 AS BIGINT), CAST(x.at_c - r.first_c AS BIGINT)) AS again FROM walk r JOIN x1 x ON r.k = x.k AND x.i = r.i + 1 WHERE x.gap IS NOT NULL))))"""


NESTED = SEG + """,
n0 AS (SELECT doc_id, position, speaker_id, "start" AS s0, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM segments),
n1 AS (SELECT doc_id, position, speaker_id, s0, l, unnest(regexp_split_to_array(line, ' +')) AS text, generate_subscripts(regexp_split_to_array(line, ' +'), 1) AS n FROM n0),
n2 AS (SELECT *, s0 + 50 * coalesce(sum(length(text)) OVER (PARTITION BY doc_id, position ORDER BY l, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM n1 WHERE text <> ''),
nw AS (SELECT doc_id, position, speaker_id, l, n, text, CAST(upto AS BIGINT) / 1000 AS s, CAST(upto + 50 * length(text) AS BIGINT) / 1000 AS e FROM n2),
ns AS (SELECT doc_id, position, speaker_id, l, string_agg(text, '' ORDER BY n) AS text, min_by(s, n) AS s, max_by(e, n) AS e, count(*) AS words, min_by(text, n) AS word FROM nw GROUP BY ALL),
nseg AS (SELECT doc_id, position, string_agg(text, '' ORDER BY l) AS text, min_by(s, l) AS "start", max_by(e, l) AS "end", list(text ORDER BY l) AS t, list(words ORDER BY l) AS c, min_by(word, l) AS word, min_by(s, l) AS s1, max_by(e, l) AS e1 FROM ns GROUP BY ALL)"""
TOLD = """doc_id, position, text, "start", "end", array_to_string(t, chr(10)) AS sentence_texts, array_to_string(c, ',') AS word_counts"""

ORACLE = {
    "seg_timeline": f'WITH {SEG} SELECT doc_id, position, "start", "end", "end" - "start" AS duration FROM segments',
    "win_neighbors": f"WITH {SEG} SELECT doc_id, position, length(lag(text, 1, '') OVER w) AS prev_len, length(lead(text, 1, '') OVER w) AS next_len FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY position)",
    "win_runs": "WITH c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY ALL",
    "win_islands": f"""WITH {SEG}, t AS (SELECT *, CASE WHEN coalesce("start" - lag("end") OVER w BETWEEN 0 AND 200 AND NOT regexp_matches(lag(text) OVER w, '\\?[」』）)】］\\]〉》\\s]*$') AND regexp_matches(text, '^\\s*(the|de|la|De|The|La|A|Er|An|In|Th)'), false) THEN 0 ELSE 1 END AS c FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY position)), g AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) - 1 AS island FROM t) SELECT doc_id, CAST(island AS BIGINT) AS position, min_by("start", position) AS "start", max_by("end", position) AS "end", CAST(sum(length(text)) AS BIGINT) AS chars FROM g GROUP BY doc_id, island""",
    "win_pair_merge": f'WITH {MERGED} SELECT doc_id, "index", "start", "end", speaker_id, length(text) AS chars FROM merged',
    "win_echo": f"""WITH {WORDS}, f AS (SELECT doc_id, position, count(*) AS n, min_by(text, word_idx) AS echo, string_agg(text, '' ORDER BY word_idx) AS all_text FROM words GROUP BY ALL), z AS (SELECT doc_id, position, "start" AS s2 FROM words QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY word_idx) = 2), j AS (SELECT s.doc_id, s.position, s.text, s."start", f.n, f.echo, f.all_text, z.s2, lag(regexp_replace(s.text, '\\s', '', 'g')) OVER (PARTITION BY s.doc_id ORDER BY s.position) AS before FROM segments s JOIN f USING (doc_id, position) LEFT JOIN z USING (doc_id, position)), h AS (SELECT *, coalesce(n > 1 AND ends_with(before, echo) AND starts_with(regexp_replace(text, '\\s', '', 'g'), echo), false) AS hit FROM j) SELECT doc_id, position, CASE WHEN hit THEN s2 ELSE "start" END AS "start", CASE WHEN hit THEN length(all_text) - length(echo) ELSE length(text) END AS chars, hit AS echo_removed FROM h""",
    "win_commas": f"WITH {SEG} SELECT doc_id, position, CASE WHEN lead(1) OVER w IS NOT NULL AND regexp_matches(regexp_replace(text, '\\s', '', 'g'), '(n\\.|e\\.|s\\.)$') THEN length(rtrim(text, ' ')) + 1 ELSE length(text) END AS chars FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY position)",
    "str_readability": f"WITH {SEG}, r1 AS (SELECT doc_id, position, {readable('text')} AS text FROM segments), r2 AS (SELECT doc_id, position, {opened('text')} AS text FROM r1) SELECT doc_id, position, {squeezed('text')} AS text FROM r2",
    "fmt_srt": f"""WITH {SEG} SELECT doc_id, position, (position + 1) || chr(10) || {srt('"start"')} || ' --> ' || {srt('"end"')} || chr(10) || text || chr(10) || chr(10) AS block FROM segments WHERE "start" >= 0 AND "end" >= 0""",
    "explode_cues": f'WITH {CUES} SELECT doc_id, "index", "start", "end", speaker_id, text FROM cues',
    "flagship_srt": f"""WITH {FLAG}, o AS (SELECT *, "start" < lag("end") OVER (PARTITION BY doc_id ORDER BY "index") AS over, "start" < 0 OR "end" < "start" AS bad FROM fin)
SELECT doc_id, count(*) AS n_cues, count(*) FILTER (over) + count(*) FILTER (bad) AS n_issues, CAST(CASE WHEN bool_or(bad) THEN NULL ELSE sum(length(CAST("index" AS VARCHAR)) + length({srt('"start"')}) + length({srt('"end"')}) + length(text) + 9) END AS BIGINT) AS srt_chars FROM o GROUP BY doc_id""",
    "json_doc": f"""WITH {SEG}, t AS (SELECT doc_id, position, speaker_id, text, "start" / 1000.0::DOUBLE AS s, "end" / 1000.0::DOUBLE AS e FROM segments),
r AS (SELECT *, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: {{'text': x, 'speaker_id': CAST(NULL AS VARCHAR), 'start_seconds': s, 'end_seconds': e, 'duration_seconds': e - s, 'words': CAST([] AS VARCHAR[])}}) AS lines FROM t),
g AS (SELECT doc_id, list({{'position': position, 'text': text, 'speaker_id': speaker_id, 'start_seconds': s, 'end_seconds': e, 'duration_seconds': e - s, 'sentences': lines}} ORDER BY position) AS segments,
list({{'index': position + 1, 'text': text, 'speaker_id': speaker_id, 'start_seconds': s, 'end_seconds': e, 'duration_seconds': e - s}} ORDER BY position) AS subtitles FROM r GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'schema_version': '1.0', 'source_path': 'in/' || doc_id || '.mp3', 'output_path': 'out/' || doc_id || '.json', 'run_id': 'transcribe-' || doc_id, 'segments': segments, 'subtitles': subtitles}}) AS VARCHAR) AS json FROM g""",
    "union_issues": f"""WITH {SEG}, u AS (SELECT doc_id, position, "start", "end", lag("end") OVER (PARTITION BY doc_id ORDER BY position) AS p FROM segments), k AS (SELECT doc_id, count(DISTINCT position) AS d, count(*) AS n, min(position) AS lo, max(position) AS hi FROM segments GROUP BY ALL)
SELECT doc_id, 'duplicate_' || x AS code, position AS location FROM (SELECT doc_id, position FROM segments GROUP BY ALL HAVING count(*) > 1), (VALUES ('segment_position'), ('subtitle_index')) v(x)
UNION ALL SELECT doc_id, 'gap_in_segment_positions', CAST(NULL AS BIGINT) FROM k WHERE NOT (d = n AND lo = 0 AND hi = n - 1)
UNION ALL SELECT doc_id, 'gap_in_subtitle_indexes', CAST(NULL AS BIGINT) FROM k WHERE NOT (d = n AND lo = 1 AND hi = n)
UNION ALL SELECT doc_id, 'overlapping_' || x, position FROM u, (VALUES ('segments'), ('subtitles')) v(x) WHERE "start" < p
UNION ALL SELECT doc_id, 'invalid_time_range', position FROM u, (VALUES (1), (2)) v(x) WHERE "start" < 0 OR "end" < "start" """,
    "agg_argmax_overlap": f'WITH {ASSIGN} SELECT doc_id, assigned, count(*) AS n_words, min("start") AS first_start FROM assigned GROUP BY ALL',
    "join_interval": f'WITH {SEG}, {TURNS} SELECT s.doc_id, s.position, t.turn_idx, least(s."end", t.t_end) - greatest(s."start", t.t_start) AS overlap FROM segments s JOIN turns t ON s.doc_id = t.doc_id AND least(s."end", t.t_end) > greatest(s."start", t.t_start)',
    "win_speaker_runs": f'WITH {ASSIGN}, c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR assigned IS NOT DISTINCT FROM lag(assigned) OVER w THEN 0 ELSE 1 END AS c FROM assigned WINDOW w AS (PARTITION BY doc_id, position ORDER BY word_idx)), r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, position ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT doc_id, position, CAST(run AS BIGINT) AS run, min_by("start", word_idx) AS "start", max_by("end", word_idx) AS "end", any_value(assigned) AS speaker_id FROM r GROUP BY doc_id, position, run',
    "agg_concat": f"""WITH {WORDS} SELECT doc_id, position, string_agg(text, '' ORDER BY word_idx) AS text, min_by("start", word_idx) AS "start", max_by("end", word_idx) AS "end", CASE WHEN count(DISTINCT speaker_id) = 1 THEN max(speaker_id) END AS speaker_id FROM words GROUP BY doc_id, position""",
    "agg_contiguity": "SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS contiguous, count(*) - count(DISTINCT l_linenumber) AS repeats FROM lineitem GROUP BY ALL",
    "topk_prefilter": f"""WITH {WORDS} SELECT doc_id, position, word_idx, row_number() OVER (PARTITION BY doc_id, position ORDER BY coalesce(CASE WHEN length(text) % 3 <> 0 THEN length(text) / 16.0 END, 1.0), coalesce(CASE WHEN word_idx % 5 <> 0 THEN (word_idx % 7) / 8.0 END, 1.0), (unicode(text) % 8) DESC, (length(text) % 4) DESC, "start") AS rank FROM words QUALIFY rank <= 3""",
    "join_equi_antiself": f"WITH {LEX} SELECT t.surface AS text, c.surface AS candidate, row_number() OVER (PARTITION BY t.surface ORDER BY c.ord) AS rank FROM lex t JOIN lex c ON t.reading = c.reading AND t.surface <> c.surface QUALIFY rank <= 64",
    "join_prefix": f"""WITH {LEX}, p AS (SELECT surface AS s, reading AS r FROM lex), t AS (SELECT surface AS text, reading FROM lex),
c AS (SELECT text, a.s AS candidate, [{{'n': length(a.r), 's': a.s}}] AS path FROM t JOIN p a ON reading = a.r
UNION ALL SELECT text, a.s || b.s, [{{'n': length(a.r), 's': a.s}}, {{'n': length(b.r), 's': b.s}}] FROM t JOIN p a ON starts_with(reading, a.r) JOIN p b ON reading = a.r || b.r
UNION ALL SELECT text, a.s || b.s || d.s, [{{'n': length(a.r), 's': a.s}}, {{'n': length(b.r), 's': b.s}}, {{'n': length(d.r), 's': d.s}}] FROM t JOIN p a ON starts_with(reading, a.r) JOIN p b ON starts_with(reading, a.r || b.r) JOIN p d ON reading = a.r || b.r || d.r),
f AS (SELECT text, candidate, min(path) AS path FROM c WHERE candidate <> text GROUP BY ALL) SELECT text, candidate, row_number() OVER (PARTITION BY text ORDER BY path) AS rank FROM f QUALIFY rank <= 64""",
    "decide_homophone": f"""WITH {LEX}, c AS (SELECT t.surface AS text, c.surface AS cand, CASE WHEN c.n % 5 <> 0 THEN c.n / 64.0 END AS score, c.ord FROM lex t JOIN lex c ON t.reading = c.reading AND t.surface <> c.surface QUALIFY row_number() OVER (PARTITION BY t.surface ORDER BY c.ord) <= 64),
b AS (SELECT text, cand, CAST(score AS DOUBLE) AS score FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY coalesce(score, 0) DESC, ord) = 1),
d AS (SELECT lex.surface AS text, b.cand, b.score, CASE WHEN b.cand IS NULL THEN 'no_same_reading_candidate' WHEN b.score IS NULL THEN 'missing_candidate_score' WHEN lex.n % 3 = 0 THEN 'missing_original_score' WHEN b.score <= lex.n / 64.0 THEN 'candidate_not_better_than_original' ELSE 'accepted_same_reading_context' END AS reason FROM lex LEFT JOIN b ON lex.surface = b.text)
SELECT text, reason, reason = 'accepted_same_reading_context' AS accepted, CASE WHEN reason = 'accepted_same_reading_context' THEN cand ELSE text END AS selected_text, score AS selected_score FROM d""",
    "stage_latest": "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, max(event_id) AS last_event FROM events GROUP BY ALL",
    "scan_asr": f"""WITH {WORDS}, b AS (SELECT doc_id, position, min_by("start", word_idx) AS w0, max_by("end", word_idx) AS w1 FROM words GROUP BY ALL) SELECT s.doc_id, s.position, least(s."start" + 30, w0) AS "start", greatest(s."end" - 30, w1) AS "end", row_number() OVER (PARTITION BY s.doc_id ORDER BY s.position) - 1 AS new_position FROM segments s LEFT JOIN b USING (doc_id, position) WHERE trim(replace(s.text, chr(10), '')) <> ''""",
    "filter_predicates": f"""WITH {SEG} SELECT doc_id, position, (lead("start") OVER w) - "end" AS gap, speaker_id IS DISTINCT FROM (lead(speaker_id) OVER w) AS speaker_boundary, regexp_matches(text, '[.?!][」』）)】］\\]〉》\\s]*$') AS terminal, regexp_matches(text, '^\\s*(de|the|la|un)') AS dependent, regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}]') AS kanji FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY position)""",
    "preflight_duplicates": "SELECT regexp_replace(regexp_replace(trim(p_brand), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS stem, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "fold_overlap": f"""WITH RECURSIVE {SEG}, a AS (SELECT doc_id, position, row_number() OVER w AS k, text || substr(lead(text, 1, '') OVER w, 1, 1 + doc_id % 4) AS text, regexp_extract(text, '^[^ \n]+') AS word FROM segments WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
f AS (SELECT doc_id, k, CAST(0 AS BIGINT) AS position, text FROM a WHERE k = 1
UNION ALL SELECT doc_id, k, CASE WHEN apart THEN position + 1 ELSE position END, CASE WHEN apart THEN text ELSE tail || substr(text, n + 1) END FROM (
SELECT *, n < 2 OR n = length({compact('word')}) OR {ending('ct', '[?]')} AS apart FROM (
SELECT *, coalesce(list_max(list_filter(range(2, least(length(ct), length(cx)) + 1), lambda z: right(ct, z) = left(cx, z))), 0) AS n FROM (
SELECT f.doc_id, a.k, f.position, f.text AS tail, a.text, a.word, {compact('f.text')} AS ct, {compact('a.text')} AS cx FROM f JOIN a ON a.doc_id = f.doc_id AND a.k = f.k + 1))))
SELECT doc_id, position, max_by(text, k) AS text FROM f GROUP BY doc_id, position""",
    "fold_split": f"""WITH RECURSIVE {WORDS}, sw AS (SELECT {{'d': doc_id, 'p': position}} AS k, row_number() OVER (PARTITION BY doc_id, position ORDER BY word_idx) AS i, CAST(word_idx AS BIGINT) AS word_idx, text,
"start" / 1000 + word_idx % 4 * 0.6::DOUBLE * (word_idx // 9) AS s, "end" / 1000 + word_idx % 4 * 0.6::DOUBLE * (word_idx // 9) AS e FROM words), {folded('sw')}
SELECT k.d AS doc_id, k.p AS position, word_idx, reason FROM walk WHERE reason IS NOT NULL""",
    "nested_echo": f"""WITH {NESTED}, a AS (SELECT * REPLACE (CASE WHEN position % 2 = 0 THEN text || lead(word, 1, '') OVER (PARTITION BY doc_id ORDER BY position) ELSE text END AS text) FROM nseg),
h AS (SELECT *, coalesce(ends_with({compact('lag(text) OVER (PARTITION BY doc_id ORDER BY position)')}, word) AND c[1] > 1, false) AS h FROM a), z AS (SELECT doc_id, position, s AS s2 FROM nw QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY l, n) = 2),
o AS (SELECT doc_id, position, CASE WHEN h THEN array_to_string(list_prepend(substr(t[1], length(word) + 1), t[2:]), '') ELSE text END AS text, CASE WHEN h THEN s2 ELSE "start" END AS "start", "end", CASE WHEN h THEN list_prepend(substr(t[1], length(word) + 1), t[2:]) ELSE t END AS t, CASE WHEN h THEN list_prepend(c[1] - 1, c[2:]) ELSE c END AS c FROM h LEFT JOIN z USING (doc_id, position)) SELECT {TOLD} FROM o""",
    "nested_continuations": f"""WITH {NESTED}, b AS (SELECT *, s1 - lag(e1) OVER w AS gap, lag(t[-1]) OVER w AS before, position = min(position) OVER (PARTITION BY doc_id) AS head FROM nseg WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
g AS (SELECT *, coalesce(gap >= 0 AND gap <= 0.9 AND NOT {ending(compact('before'), '[?]')} AND regexp_matches({compact('t[1]')}, '^(the|de|la|De|The|La|A|Er|An|In|Th)'), false) AS tie FROM b),
i AS (SELECT *, sum(CASE WHEN tie THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY position) - 1 AS island FROM g),
q AS (SELECT i.doc_id, island, i.position, ns.text, ns.words, l, CASE WHEN tie AND l = min(l) OVER (PARTITION BY i.doc_id, i.position) THEN 0 ELSE 1 END AS new FROM i JOIN ns ON i.doc_id = ns.doc_id AND i.position = ns.position),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, island ORDER BY position, l) AS n FROM q), v AS (SELECT doc_id, island, n, string_agg(text, '' ORDER BY position, l) AS text, CAST(sum(words) AS BIGINT) AS words FROM u GROUP BY ALL),
m AS (SELECT doc_id, island, string_agg(text, '' ORDER BY n) AS text, list(text ORDER BY n) AS t, list(words ORDER BY n) AS c FROM v GROUP BY ALL), r AS (SELECT doc_id, island, min("start") AS "start", max_by("end", position) AS "end", min_by("start", position) AS s0 FROM i GROUP BY ALL),
o AS (SELECT doc_id, CAST(island AS BIGINT) AS position, text, s0 AS "start", "end", t, c FROM m JOIN r USING (doc_id, island)) SELECT {TOLD} FROM o""",
    "nested_commas": f"""WITH {NESTED}, h AS (SELECT *, lead(1) OVER (PARTITION BY doc_id ORDER BY position) IS NOT NULL AND regexp_matches({compact('t[-1]')}, '(n[.]|e[.]|s[.])$') AS h FROM nseg),
o AS (SELECT doc_id, position, CASE WHEN h THEN text || ',' ELSE text END AS text, "start", "end", CASE WHEN h THEN list_append(t[:-2], t[-1] || ',') ELSE t END AS t, c FROM h) SELECT {TOLD} FROM o""",
    "nested_split": f"""WITH RECURSIVE {NESTED}, sw AS (SELECT {{'d': doc_id, 'p': position, 'l': l}} AS k, row_number() OVER (PARTITION BY doc_id, position, l ORDER BY n) AS i, CAST(n AS BIGINT) AS word_idx, text, s, e FROM nw), {folded('sw')},
y AS (SELECT k, i, text, coalesce(sum(b) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM (SELECT sw.k, sw.i, sw.text, CASE WHEN w.reason IS NULL THEN 0 ELSE 1 END AS b FROM sw LEFT JOIN walk w ON w.k = sw.k AND w.i = sw.i)),
z AS (SELECT k, part, string_agg(text, '' ORDER BY i) AS text, count(*) AS words FROM y GROUP BY ALL), m AS (SELECT k.d AS doc_id, k.p AS position, list(text ORDER BY k.l, part) AS t, list(words ORDER BY k.l, part) AS c FROM z GROUP BY ALL),
o AS (SELECT doc_id, position, text, "start", "end", m.t, m.c FROM nseg JOIN m USING (doc_id, position)) SELECT {TOLD} FROM o""",
}
