"""Cases of transcripts, with Japanese defaults, and random checks against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import boundary, cues, homophone, intervals, repair, sequence


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("given,wanted", [(" 日本語です..  ", "日本語です。"), ("最も 良いものを一つ", "最も良いものを一つ"), ("では練習しましょう", "では、練習しましょう"), ("それでは始めます", "それでは、始めます"), ("ではありません", "ではありません"), ("では、練習しましょう", "では、練習しましょう"), ("日本では人気があります", "日本では人気があります")])
def test_readability(spark, given, wanted):
    assert one(spark, tx.readable(F.col("t")), t=given) == wanted


@pytest.mark.parametrize("s,wanted", [(3723.456, "01:02:03,456"), (1.2, "00:00:01,200"), (0.0005, "00:00:00,000"), (360000.0, "100:00:00,000"), (-1.0, None)])
def test_srt_time(spark, s, wanted):
    assert one(spark, tx.srt_time(F.col("s")), s=s) == wanted


def test_srt_block(spark):
    assert one(spark, tx.srt_block(F.lit(1), F.col("a"), F.col("b"), F.lit("日本語")), a=1.2, b=3.45) == "1\n00:00:01,200 --> 00:00:03,450\n日本語\n\n"


@pytest.mark.parametrize("candidate,accepted,reason", [("今日は日本語を勉強します。", True, "accepted"), ("今日は一緒に日本語を勉強します", False, "length_delta_exceeded"), ("今日は勉強します", False, "length_delta_exceeded"), ("今日は日本語を便強します", True, "accepted"), ("  ", False, "empty_candidate"), ("明日も英会話を練習します", False, "content_change_exceeded")])
def test_gate(spark, candidate, accepted, reason):
    df = spark.createDataFrame([("今日は日本語を勉強します", candidate)], "original_text string, candidate_text string")
    for exact in (True, False):
        r = repair.gate_repairs(df, exact_ratio=exact).first()
        assert (r.accepted, r.reason) == (accepted, reason)
        assert r.selected_text == (candidate.strip() if accepted else "今日は日本語を勉強します")


@pytest.mark.parametrize("rows,texts", [([("日本語", 0.0, 0.5, None), ("です。", 0.6, 1.0, None)], ["日本語です。"]), ([("そう", 0.0, 0.5, "s1"), ("はい。", 0.6, 1.0, "s2")], ["そう", "はい。"]), ([("聞いてください", 0.0, 0.5, None), ("いつでもいいです", 0.6, 1.0, None)], ["聞いてください", "いつでもいいです"]), ([("a", 0.0, 0.1, None), ("b", 0.1, 0.2, None), ("c", 0.2, 0.3, None)], ["ab", "c"])])
def test_merge(spark, rows, texts):
    df = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], "doc_id int, index int, text string, start double, end double, speaker_id string")
    out = cues.merge_cues(df).orderBy("index").collect()
    assert [r.text for r in out] == texts and [r["index"] for r in out] == list(range(1, len(texts) + 1))
    assert out[0].speaker_id == rows[0][3]


def test_validation(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 1.0), (1, 1, 2, 1.0, 2.0), (2, 0, 1, 0.0, 1.5), (2, 1, 2, 1.0, 2.0), (2, 2, 2, 2.0, 3.0)], "doc_id int, ord int, n int, start double, end double")
    seg = cues.segment_issues(df.withColumnRenamed("n", "position")).collect()
    assert {(r.doc_id, r.code) for r in seg} == {(1, "gap_in_segment_positions"), (2, "duplicate_segment_position"), (2, "gap_in_segment_positions"), (2, "overlapping_segments")}


def test_speakers(spark):
    w = spark.createDataFrame([(1, 0, 0, "そう", 0.0, 0.4, None), (1, 0, 1, "はい", 0.6, 1.0, None), (1, 0, 2, "x", 9.0, 9.0, "own")], "doc_id int, position int, word_idx int, text string, start double, end double, speaker_id string")
    t = spark.createDataFrame([(1, 0, "SPEAKER_00", 0.0, 0.5), (1, 1, "SPEAKER_01", 0.5, 1.1), (1, 2, "S2", 8.0, 10.0)], "doc_id int, turn_idx int, speaker_id string, start double, end double")
    for bucket in (None, 0.3):
        a = intervals.assign_speakers(w, t, "doc_id", ["position", "word_idx"], bucket)
        assert {r.word_idx: r.assigned for r in a.collect()} == {0: "SPEAKER_00", 1: "SPEAKER_01", 2: "own"}
    r = intervals.speaker_runs(a.withColumn("sentence_text", F.lit("s")), ["doc_id", "position"]).orderBy("run").collect()
    assert [(x.text, x.start, x.end) for x in r] == [("そう", 0.0, 0.4), ("はい", 0.6, 1.0), ("x", 9.0, 9.0)]


SEG = "doc_id int, position int, text string, start double, end double, speaker_id string, first_word string"


def test_overlap_merge(spark):
    rows = [(1, 0, "学生は授業を休んだ", 104.0, 107.94, None, "学生"), (1, 1, "休んだときどのように確認しますか", 107.94, 112.0, None, "休"), (2, 0, "ABC", 0.0, 1.0, "a", "ABC"), (2, 1, "BC", 1.0, 2.0, "b", "B"), (2, 2, "ABCD", 2.0, 3.0, "c", "A"), (3, 0, "終わり。", 0.0, 1.0, None, None), (3, 1, "わり。x", 1.0, 2.0, None, None)]
    out = boundary.merge_overlaps(spark.createDataFrame(rows, SEG)).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.position, r.text) for r in out] == [(1, 0, "学生は授業を休んだときどのように確認しますか"), (2, 0, "ABCD"), (3, 0, "終わり。"), (3, 1, "わり。x")]


@pytest.mark.parametrize("left,gap,speakers,n", [("学生は授業を休んだ", 0.0, ("a", "a"), 1), ("終わった。", 0.0, ("a", "a"), 2), ("学生は授業を休んだ", 0.0, ("a", "b"), 2), ("学生は授業を休んだ", 1.0, (None, None), 2)])
def test_continuation(spark, left, gap, speakers, n):
    rows = [(1, 0, left, 104.62, 107.94, speakers[0], None), (1, 1, "とき、どうしますか", 107.94 + gap, 111.08, speakers[1], None)]
    out = boundary.join_continuations(spark.createDataFrame(rows, SEG)).collect()
    assert len(out) == n
    if n == 1:
        assert out[0].text == left + "とき、どうしますか" and (out[0].start, out[0].end) == (104.62, 111.08)


def test_comma(spark):
    rows = [(1, 0, "それから話を聞いて", 79.14, 82.35, None, None), (1, 1, "話を聞いて", 83.0, 84.0, None, None)]
    assert [r.text for r in boundary.restore_commas(spark.createDataFrame(rows, SEG)).orderBy("position").collect()] == ["それから話を聞いて、", "話を聞いて"]


@pytest.mark.parametrize("words,reasons", [
    ([("聞いてください。", 0, 1), ("音", 1.0, 1.2), ("を", 1.2, 1.3), ("聞いてください", 1.3, 2)], ["terminal_mark"]),
    ([("聞いて", 5.0, 5.9), ("ください", 5.92, 6.16), ("音", 6.81, 7.67), ("を", 7.7, 8.0)], ["pause_after_sentence_final"]),
    ([("聞いて", 5.0, 5.9), ("ください", 5.92, 6.16), ("音", 6.17, 7.67)], ["sentence_final_expression"]),
    ([("音が", 0, 1), ("し", 1, 2), ("た", 2, 3), ("とき", 9, 10), ("は", 10, 11)], []),
    ([("確認します", 107.94, 110.72), ("か?", 110.72, 111.08)], []),
    ([("天気", 0, 1), ("天気", 1, 2)], ["repeated_heading"]),
    ([("天気", 0, 1), ("が", 3, 4)], ["strong_pause"]),
])
def test_split(spark, words, reasons):
    df = spark.createDataFrame([(1, i, t, float(a), float(b)) for i, (t, a, b) in enumerate(words)], "doc_id int, word_idx int, text string, start double, end double")
    assert [r.reason for r in boundary.split_sentences(df, ["doc_id"]).orderBy("word_idx").collect()] == reasons


def test_pairs_like_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for doc in range(60):
        edges = [rnd.random() < 0.6 for _ in range(rnd.randint(1, 12))]
        rows += [(doc, i, e) for i, e in enumerate(edges)]
        i, group = 0, 0
        while i < len(edges):
            step = 2 if edges[i] and i + 1 < len(edges) else 1
            for k in range(step):
                want[doc, i + k] = group
            i, group = i + step, group + 1
    df = spark.createDataFrame(rows, "doc int, i int, e boolean")
    got = sequence.greedy_pairs(df, ["doc"], ["i"], F.col("e"))
    assert {(r.doc, r.i): r.pair for r in got.collect()} == want


@pytest.mark.parametrize("old,score,reason", [(0.1, 0.8, "accepted_same_reading_context"), (0.4, 0.2, "candidate_not_better_than_original"), (None, 0.8, "missing_original_score"), (0.1, None, "missing_candidate_score")])
def test_decision(spark, old, score, reason):
    t = spark.createDataFrame([(1, "懲戒", old)], "t int, text string, original_score double")
    c = spark.createDataFrame([(1, 0, "聴解", score)], "t int, ord int, text string, score double")
    r = homophone.decide(t, c, ["t"]).first()
    assert r.reason == reason and r.selected_text == ("聴解" if r.accepted else "懲戒")
    assert homophone.decide(t, c.limit(0), ["t"]).first().reason == "no_same_reading_candidate"


def test_composed_and_changes(spark):
    t = spark.createDataFrame([(1, "懲戒", "ちょうかい")], "t int, text string, reading string")
    p = spark.createDataFrame([("聴", "ちょう"), ("解", "かい"), ("丁", "ちょう"), ("会", "かい")], "surface string, reading string")
    assert [r.candidate for r in homophone.composed_candidates(t, p, ["t"]).orderBy("rank").collect()] == ["丁会", "丁解", "聴会", "聴解"]
    s = spark.createDataFrame([(1, "懲戒の試験と懲戒")], "k int, text string")
    c = spark.createDataFrame([(1, 6, 8, "聴解"), (1, 0, 2, "聴解")], "k int, start int, end int, selected_text string")
    assert homophone.apply_text_changes(s, c, ["k"]).first().text == "聴解の試験と聴解"


def test_candidates_of_the_queries_by_brute_force(spark):
    from strandline.plans import registry

    d = "/root/testdata/sf0.001"
    reading = {r.surface: r.reading for r in registry.lexicon(spark, d).collect()}
    by = {}
    for s in sorted(reading):
        by.setdefault(reading[s], []).append(s)

    def paths(left, k):
        if not left:
            yield ()
        elif k:
            for n in range(1, len(left) + 1):
                for s in by.get(left[:n], ()):
                    yield from (((n, s), *rest) for rest in paths(left[n:], k - 1))

    whole = {(t, c, k) for t, r in reading.items() for k, c in enumerate([c for c in by[r] if c != t][:64], 1)}
    composed = set()
    for t, r in reading.items():
        best = {}
        for p in paths(r, 3):
            c = "".join(s for _, s in p)
            if c != t:
                best[c] = min(best.get(c, p), p)
        composed |= {(t, c, k) for k, c in enumerate(sorted(best, key=best.get)[:64], 1)}
    for name, want, limit in (("join_equi_antiself", whole, 5), ("join_prefix", composed, 10)):
        rows = [tuple(r) for r in registry.QUERIES[name](spark, d).select("text", "candidate", "rank").collect()]
        print(name, len(rows), sum(r[2] > limit for r in rows))
        assert len(rows) == len(want) and set(rows) == want
    assert any(k > 10 for _, _, k in composed)


def test_composed_like_a_loop_where_surfaces_meet(spark):
    """Pieces that spell the same whole by several cuts, more of them than the limit: same ranks, and few rows made."""
    rnd = random.Random(7)
    lex = sorted({("".join(rnd.choice("aeb") for _ in range(rnd.randint(1, 3))), rnd.choice(("b", "c", "bc", "cb", "bb"))) for _ in range(60)} | {("aa", "b"), ("a", "b")})
    targets = [(k, s, r) for k, (s, r) in enumerate(lex)] + [(1000 + k, t, r) for k, (t, r) in enumerate((("a", "bcbcb"), ("aaa", "bbbbbb"), ("a", "cbbcc"), ("a", "x"), ("a", "")))]

    def paths(left, k):
        if not left:
            yield ()
        elif k:
            for s, r in lex:
                if left.startswith(r):
                    yield from (((len(r), s), *rest) for rest in paths(left[len(r):], k - 1))

    t = spark.createDataFrame(targets, "t int, text string, reading string")
    p = spark.createDataFrame(lex, "surface string, reading string")
    for pieces, limit in ((1, 64), (2, 5), (3, 1), (3, 7), (3, 64), (3, 1 << 30)):
        want = set()
        for k, text, r in targets:
            best = {}
            for path in paths(r, pieces) if r else ():
                c = "".join(s for _, s in path)
                if c != text:
                    best[c] = min(best.get(c, path), path)
            want |= {(k, c, i) for i, c in enumerate(sorted(best, key=best.get)[:limit], 1)}
        got = [(r.t, r.candidate, r["rank"]) for r in homophone.composed_candidates(t, p, ["t"], pieces, limit).collect()]
        assert len(got) == len(want) and set(got) == want, (pieces, limit)


def test_composed_makes_paths_once_for_a_reading(spark):
    """20 homophones of each of three pieces: 8,000 paths a target, of which the first 65 decide."""
    p = spark.createDataFrame([(f"{c}{i:02d}", c) for c in "xyz" for i in range(20)], "surface string, reading string")
    t = spark.range(500).selectExpr("id AS t", "concat('x00y00z', lpad(id % 20, 2, '0')) AS text", "'xyz' AS reading")
    out = homophone.composed_candidates(t, p, ["t"])
    got = out.collect()
    assert len(got) == 500 * 64 and {r.candidate for r in got if r["rank"] == 2 and r.t == 0} == {"x00y00z02"}

    def most(plan):
        metrics, kids, rows = plan.metrics(), plan.children(), 0
        rows = metrics.get("numOutputRows").get().value() if metrics.contains("numOutputRows") else 0
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return most(plan.executedPlan())
        if "QueryStage" in name:
            return most(plan.plan())
        return max([rows, *(most(kids.apply(i)) for i in range(kids.size()))])

    assert 500 * 64 <= most(out._jdf.queryExecution().executedPlan()) < 100_000  # 4,000,000 if each target had its paths


def test_lexical_candidates_like_a_loop(spark):
    """Whole entries, then entries of equal reading that pieces spell, by their first path."""
    rnd = random.Random(11)
    lex = sorted({("".join(rnd.choice("山川木") for _ in range(rnd.randint(1, 3))), rnd.choice(("や", "か", "やか", "かや", "ややか"))) for _ in range(60)})
    rows = [(k, s, r, [("名詞"), "一般" if len(s) % 2 else "固有"]) for k, (s, r) in enumerate(lex)]
    first = {}
    for _, s, r, pos in rows:
        first.setdefault(s, (r, pos))
    targets = [(k, s, r, pos) for k, s, r, pos in rows]

    def paths(left, k):
        if not left:
            yield ()
        elif k:
            for s, r in lex:
                if left.startswith(r):
                    yield from (((len(r), s), *rest) for rest in paths(left[len(r):], k - 1))

    for limit in (64, 2):
        want = set()
        for k, text, r, pos in targets:
            whole = [s for _, s, x, _ in rows if x == r and s != text]
            order = list(dict.fromkeys(whole))[:limit]
            best = {}
            for path in paths(r, 3):
                c = "".join(s for _, s in path)
                if c != text and c in first and first[c][0] == r and first[c][1] == pos:
                    best[c] = min(best.get(c, path), path)
            order = list(dict.fromkeys([*order, *sorted(best, key=best.get)]))[:limit]
            want |= {(k, c, i) for i, c in enumerate(order, 1)}
        t = spark.createDataFrame(targets, "t int, text string, reading string, pos array<string>")
        x = spark.createDataFrame(rows, "ord int, surface string, reading string, pos array<string>")
        got = [(r.t, r.candidate, r["rank"]) for r in homophone.lexical_candidates(t, x, ["t"], limit).collect()]
        assert len(got) == len(want) and set(got) == want


def split_by_rules(words, marks=("。",), suffixes=("ます", "です", "だ"), particles=("か", "ね"), prefixes=("とき", "ので")):
    """split_sentences as its rules say, over (text, start, end) in order: (word_idx, gap, reason, left, right)."""
    import re

    quotes = "」』）)】］]〉》"
    out, first = [], 0
    texts = [t or "" for t, _, _ in words]
    bare = ["".join(t.split()) for t in texts]
    for i in range(len(words) - 1):
        a, b = words[i][2], words[i + 1][1]
        gap = None if a is None or b is None else b - a
        left, right, l, r = "".join(texts[first : i + 1]), "".join(texts[i + 1 :]), "".join(bare[first : i + 1]), "".join(bare[i + 1 :])
        final = l.rstrip(quotes).endswith(suffixes)
        if not left or not right:
            continue
        if bare[i].rstrip(quotes).endswith(marks) or l.rstrip(quotes).endswith(marks):
            reason = "terminal_mark"
        elif r.startswith((*particles, *prefixes)) or (re.match(r"\d", r) and not final):
            continue
        elif gap is not None and gap >= 1.5:
            reason = "strong_pause"
        elif len(l) >= 2 and r.startswith(l):
            reason = "repeated_heading"
        elif final:
            reason = "pause_after_sentence_final" if gap is not None and gap >= 0.5 else "sentence_final_expression"
        else:
            continue
        out.append((i, max(gap or 0.0, 0.0), reason, left, right))
        first = i + 1
    return out


def test_split_by_its_rules(spark):
    rnd = random.Random(5)
    parts = ["。", "ます", "ま", "す", "で", "です", "だ", "か", "ね", "とき", "と", "き", "の", "ので", "7", "３", "」", "』」", "」" * 33, " ", "\u3000", "", None, "山", "川", "山川", "天気", "𠮷", "る 。", "ま す」"]
    docs = [[(rnd.choice(parts[-8:] if k % 3 == 0 else parts), None if rnd.random() < 0.05 else i * 4.0, i * 4.0 + 4.0 - rnd.choice((0.0, 0.25, 0.5, 1.0, 1.5, 2.0, -1.0))) for i in range(rnd.randint(1, 30))] for k in range(400)]
    df = spark.createDataFrame([(k, i, *w) for k, d in enumerate(docs) for i, w in enumerate(d)], "doc_id int, word_idx int, text string, start double, end double")
    out = boundary.split_sentences(df, ["doc_id"], marks=("。",), suffixes=("ます", "です", "だ"), particles=("か", "ね"), prefixes=("とき", "ので"))
    want = {(k, *d) for k, doc in enumerate(docs) for d in split_by_rules(doc)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and {r[3] for r in got} == set(boundary.REASONS)


def test_split_of_a_long_sentence(spark):
    """A sentence's time grows as its length does: looking into its text from its start for each of 40,000 words takes minutes."""
    import time

    rnd = random.Random(9)
    words = [(0, i, "".join(rnd.choice("山川木") for _ in range(4)), float(i), i + 1.0) for i in range(40_000)] + [(0, 40_000, "です", 40_000.0, 40_001.0), (0, 40_001, "終", 40_002.0, 40_003.0)]
    df = spark.createDataFrame(words, "doc_id int, word_idx int, text string, start double, end double").coalesce(1)
    began = time.time()
    out = [(r.word_idx, r.reason, len(r.left_text), r.right_text) for r in boundary.split_sentences(df, ["doc_id"]).collect()]
    assert out == [(40_000, "pause_after_sentence_final", 160_002, "終")]
    assert time.time() - began < 40
