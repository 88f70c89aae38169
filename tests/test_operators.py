"""Operators on small tables, with the cases worked out by hand."""

import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions.arrays import run_lengths_to_spans
from wordloom.operators import align, captions, evaluation, examples, intervals, masking, numbering, packing, quality, sampling, vectors, words
from wordloom.operators import segments as S
from wordloom.operators.running import neighbours, running
from wordloom.plans.record_queries import QUERIES
from wordloom.rand import uniform


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_gaps_and_periods(spark):
    data = [("a", 0, 5), ("a", 3, 4), ("a", 5, 7), ("a", 9, 12), ("a", 9, 12), ("a", 20, 19), ("a", None, 3), ("b", 4, 4), (None, 1, 2), (None, 4, 6), ("c", -10, -5), ("c", 5, 8)]
    df = spark.createDataFrame([(k, s, e, 1, 2) for k, s, e in data], "k string, x long, y long, s int, _k0 int")
    for width in (1, 3, 1000):
        assert rows(intervals.gaps(df, ["k"], "x", "y", width)) == sorted([("a", 7, 9), (None, 2, 4), ("c", -5, 5)], key=str)
        assert rows(intervals.periods(df, ["k"], "x", "y", width)) == sorted([("a", 1, 0, 7), ("a", 2, 9, 12), (None, 1, 1, 2), (None, 2, 4, 6), ("c", 1, -10, -5), ("c", 2, 5, 8)], key=str)
    assert intervals.gaps(df.limit(0), ["k"], "x", "y").count() == 0
    assert intervals.periods(df.limit(0), ["k"], "x", "y").count() == 0


def brute(iv):
    iv, out, end = sorted(iv), [], None
    for s, e in iv:
        if end is not None and s > end:
            out.append((end, s))
        end = e if end is None else max(end, e)
    return out


def test_gaps_against_brute_force(spark):
    r = random.Random(3)
    data = [(k, s, s + r.randrange(1, 40)) for k in range(12) for s in (r.randrange(2000) for _ in range(40))]
    df = spark.createDataFrame(data, "k int, s long, e long")
    want = sorted(((k, *g) for k in range(12) for g in brute([(s, e) for q, s, e in data if q == k])), key=str)
    assert rows(intervals.gaps(df, ["k"], "s", "e", 50)) == want


def test_video_gaps_edges(spark):
    kind = "youtube_id string, start_time double, end_time double, playback_speed bigint, tok_start_times array<float>, tok_end_times array<float>, time_level int"
    data = [
        ("v", 0.0, 10.0, 2, [0.0, 1.0, None, 3.0], [1.0, 2.0, 5.0], 1), ("v", 20.0, 30.0, 1, None, None, 1), ("v", 20.0, 30.0, None, [0.0], [1.0], 1),
        ("v", None, 3.0, 1, [0.0], [1.0], 1), ("", 0.0, 1.0, 1, [], [], 1), (None, 0.0, 1.0, 1, [], [], 1), ("v", 50.0, 40.0, 1, [1.0], [2.0], 1), ("w", float("nan"), 2.0, 1, [], [], 1), ("w", 0.0, 2.0, 1, [1.5, 0.0], [1.8, 0.5], 1),
    ]
    df = spark.createDataFrame(data, kind)
    assert rows(intervals.video_gaps(df)) == [("v", "segment", 10000, 20000), ("w", "token", 500, 1500)]
    assert ("v", "token", 1, 0, 4000) in rows(intervals.video_periods(df))


def test_bounds_of_assignment(spark):
    iv = spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 1, 5.0, 10.0)], "k string, seg int, lo double, hi double")
    pt = spark.createDataFrame([("v", t) for t in (0.0, 5.0, 10.0, 11.0)], "k string, t double")
    left = S.assign_to_intervals(pt, iv, "k", "t", "lo", "hi", "left", 3.0)
    right = S.assign_to_intervals(pt, iv, "k", "t", "lo", "hi", "right", 3.0)
    assert rows(left.select("t", "seg")) == [(0.0, 0), (5.0, 1)] and rows(right.select("t", "seg")) == [(10.0, 1), (5.0, 0)]
    lone = S.assign_to_intervals(pt.where("t < 5"), iv, "k", "t", "lo", "hi", "left", 3.0, "left")
    assert rows(lone.select("seg", "t")) == [(0, 0.0), (1, None)]


def test_nearest_span(spark):
    df = spark.createDataFrame([("v", i, c) for i, c in enumerate((1.0, 3.9, 1.2))], "k string, pos int, centroid double")
    r = S.nearest_span_monotone(df, F.array(F.lit(0.8), F.lit(2.5), F.lit(4.2)), "k")
    assert rows(r.select("pos", "nearest", "assigned")) == [(0, 0, 0), (1, 2, 2), (2, 0, 2)]


@pytest.mark.parametrize("kind", ["max", "min", "sum"])
def test_running(spark, kind):
    r = random.Random(6)
    data = [(k, i, r.choice([None, *range(-9, 9)])) for k in ("a", "b", None) for i in r.sample(range(-50, 300), 60)]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    fold = {"max": max, "min": min, "sum": sum}[kind]
    want = []
    for k in ("a", "b", None):
        seen = []
        for _, i, v in sorted((x for x in data if x[0] == k), key=lambda x: x[1]):
            seen += [v] if v is not None else []
            want.append((k, i, fold(seen) if seen else None))
    for width in (1, 7, 1000):
        assert rows(running(df, ["k"], "pos", F.col("v"), "out", kind, width).select("k", "pos", "out")) == sorted(want, key=str)
    assert running(df.limit(0), ["k"], "pos", F.col("v"), "out", kind).count() == 0


def test_word_gates(spark):
    w = spark.createDataFrame([(1, 0, "HELLO,"), (1, 1, "I"), (1, 2, "am"), (1, 3, "A B"), (2, 0, "x")], "d int, pos int, word string")
    q = {r.d: r for r in words.token_quality(w.where("word <> 'A B'").unionByName(spark.createDataFrame([(1, 3, "ABC")], w.schema)), "d").collect()}
    assert q[1].frac_good == 0.5 and q[1].dropped and q[2].len_var == 0 and not q[2].dropped
    d = spark.createDataFrame([("v", t) for t in (0.0, 10.0, 29.9, 30.0, 61.0, 150.0)], "v string, t double")
    assert rows(words.density_bins(d, "v", F.col("t"), 30.0)) == [("v", 0, 3), ("v", 1, 1), ("v", 2, 1), ("v", 3, 0), ("v", 4, 0), ("v", 5, 1)]
    s = spark.createDataFrame([("v", 0, 1.0, 2.0, 0.2, 0.6), ("v", 1, 2.0, 3.0, 0.4, -0.9)], "k string, pos int, start double, end double, start_off double, end_off double")
    got = [(round(r.d_start, 6), round(r.d_end, 6)) for r in words.smoothed_bounds(s, "k").orderBy("pos").collect()]
    assert got == [(0.2, 0.5), (0.5, -0.5)]


def test_first_reason(spark):
    df = spark.createDataFrame([(1, None), (5, 2), (9, 9)], "a int, b int")
    assert [r[2] for r in quality.with_reason(df, [("big", F.col("a") > 8), ("b", F.col("b") > 1)]).collect()] == [None, "b", "big"]


def test_pack_blocks(spark):
    docs = spark.createDataFrame([(1, i, list(range(100, 100 + n))) for i, n in enumerate((8, 5, 18, 12))] + [(2, 0, None)], "shard int, ord int, tok array<int>")
    got = packing.pack_blocks(docs, "shard", "ord", "tok", 16).where("shard = 1").collect()
    assert len(got) == 3 and all(len(r.block) == 16 for r in got)
    c = packing.block_counts(docs.withColumn("n", F.coalesce(F.size("tok"), F.lit(0))).where("shard = 1"), "shard", "ord", "n", 16).first()
    assert (c.blocks, c.discarded, c.carried) == (3, 3, 0) and 16 * 3 + 3 == 10 + 7 + 20 + 14


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(2, 16), st.integers(1, 10))
def test_groups_are_full_and_disjoint(counts, size, most):
    p, groups = packing.Packer(size, most), []
    for k, n in enumerate(counts):
        groups += p.add(k, 0, n)
    groups += p.finish()
    used = [(k, i) for g in groups for k, a, n in g for i in range(a, a + n)]
    assert all(sum(n for _, _, n in g) == size for g in groups) and len(used) == len(set(used)) and all(i < counts[k] for k, i in used)


def test_masking(spark):
    df = spark.createDataFrame([([[11, 12], [13], []], [True, False, True])], "s array<array<int>>, m array<boolean>")
    r = df.select(masking.masked_spans(F.col("s"), F.col("m"), F.array(F.lit(True), F.lit(True), F.lit(False)), True, 5).alias("p"), masking.masked_texts(F.col("s"), F.col("m")).alias("t"), masking.reassign_empty(F.col("s"), F.array(F.lit(False), F.lit(False), F.lit(True))).alias("r")).first()
    assert [tuple(x) for x in r.p] == [(3, 0, 5), (4, 0, 5)] + [(5, 1, -1)] * 6 + [(3, 2, 6), (4, 2, 6)]
    assert r.t == [[11, 12], []] and r.r == [[11, 12], [13], []]
    d = spark.createDataFrame([([[], [1, 2, 3], []], [True, False, True])], "s array<array<int>>, m array<boolean>")
    assert d.select(masking.reassign_empty(F.col("s"), F.col("m"))).first()[0] == [[1], [2], [3]]


def test_truncation_keeps_masks(spark):
    t = [(20, 0, -1), (21, 0, -1), (3, 1, 0), (22, 2, -1), (3, 3, 1), (23, 4, -1), (24, 4, -1)]
    df = spark.createDataFrame([(t,)], "t array<struct<tok:int,audio_ptr:int,text_ptr:int>>")
    for n in (7, 5, 4, 3, 2):
        got = [x.tok for x in df.select(masking.truncated(F.col("t"), n, F.array(*[F.lit(0.0)] * 5))).first()[0]]
        assert len(got) == n and got.count(3) == 2, (n, got)


def test_sequences(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    r = spark.range(1).select(masking.qa_joint(a(1, 2, 3), a(4, 5), 8), masking.qa_linear(a(1, 2, 3), 3)).first()
    assert r[0] == [1, 2, 3, 4, 5, 3, 0, 0] and r[1] == [1, 2, 3]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0]), (3, "g", [1.0, 1.0]), (4, "h", [1.0, 0.0]), (5, "z", [0.0, 0.0])], "id int, label string, embedding array<double>")
    got = {r.label: r.avg_cos for r in vectors.mean_pairwise_cosine(df, "label").collect()}
    assert round(got["g"], 6) == 0.471405 and got["h"] is None
    f = spark.createDataFrame([("v", [0.2, 0.9]), ("v", [0.25, 0.4]), ("v", [0.5, 0.1])], "k string, s array<double>")
    assert vectors.class_max_sum(f, "k", "s").first().expectation == 1.4


def test_evaluation(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate("AABBA")] + [("q", 0, None), ("q", 1, None)], "r string, pos int, v string")
    got = [r.src_index for r in evaluation.running_source_index(df, "r", "pos", "v").where("r = 'r'").orderBy("pos").collect()]
    assert got == [0, 0, 1, 1, 2] and evaluation.running_source_index(df, "r", "pos", "v").where("r = 'q'").agg(F.max("src_index")).first()[0] == 0
    o = spark.createDataFrame([(0, 0, "person"), (0, 1, "person"), (0, 2, "car")], "g int, i int, kind string")
    n = evaluation.named_objects(o, "g", "kind", "i").orderBy("i")
    assert [r.obj_name for r in n.collect()] == ["Person 1", "Person 2", "the car"]
    s = spark.createDataFrame([("k", i, [0.1 * i] * 4, [1.0] * 4) for i in range(4)], "k string, c int, a array<double>, r array<double>")
    sub = evaluation.submission(s, "k", "c", "a", "r")
    assert len(sub.columns) == 21 and round(sub.first().answer_2, 3) == 0.3 and evaluation.complete(sub).count() == 1
    with pytest.raises(Exception, match="null in the submission"):
        evaluation.complete(evaluation.submission(s.where("c < 3"), "k", "c", "a", "r")).collect()
    with pytest.raises(Exception, match="no match"):
        evaluation.lookup(o, spark.createDataFrame([("car", 1)], "kind string, n int"), "kind").collect()


AUTO = "WEBVTT\n\n00:00:00.030 --> 00:00:02.060 align:start position:0%\n \nhello<00:00:00.450><c> everyone</c><00:00:00.840><c> and</c><00:00:01.140><c> welcome</c>\n\n00:00:02.060 --> 00:00:03.000 align:start position:0%\nx\nlone\n \n"


def test_captions(spark):
    df = spark.createDataFrame([(1, AUTO), (2, "WEBVTT\n\n00:00:00.000 --> 00:00:04.000\na <b>b</b>\nc d\n"), (3, None), (4, "no cues"), (5, "")], "id int, t string")
    got = [(r.id, r.pos, r.word, round(r.start, 3), round(r.end, 3)) for r in captions.caption_words(df, "id", "t").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "hello", 0.03, 0.45), (1, 1, "everyone", 0.45, 0.84), (1, 2, "and", 0.84, 1.14), (1, 3, "welcome", 1.14, 2.06), (1, 4, "lone", 2.06, 3.0), (2, 0, "a", 0.0, 1.0), (2, 1, "b", 1.0, 2.0), (2, 2, "c", 2.0, 3.0), (2, 3, "d", 3.0, 4.0)]
    srt = spark.createDataFrame([(1, "1\r\n00:00:01,000 --> 00:00:02,500\r\nhi\r\nyou\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nbye\r\n")], "id int, t string")
    assert rows(captions.srt_rows(srt, "id", "t")) == [(1, 0, 1.0, 2.5, "hi you"), (1, 1, 3.0, 4.0, "bye")]


def brute_dtw(a, b):
    n, m = len(a), len(b)
    r = int(max(n * 0.1, 32))
    cost = [[align.edit_distance(a[i], b[j]) if max(i - r, 0) <= j < min(i + r, m) else 9999 for j in range(m)] for i in range(n)]
    t = [[float("inf")] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            p = 0 if i == j == 0 else min(t[i - 1][j - 1] if i and j else float("inf"), t[i - 1][j] if i else float("inf"), t[i][j - 1] if j else float("inf"))
            t[i][j] = p + cost[i][j]
    return t[-1][-1]


def test_alignment():
    src = "much of a pancake waffle person so i love a".split()
    got = align.aligned(src, "much of a pancakewaffle person so i love a good".split())
    assert got[:3] == ["much", "of", "a"] and sorted(" ".join(got).split()) == sorted("much of a pancakewaffle person so i love a good".split())
    assert align.aligned([], ["a"]) == [] and align.aligned(["a"], []) == [""]
    assert align.edit_distance("kitten", "sitting") == 3 and align.edit_distance("", "ab") == 2 and brute_dtw(["a"], ["a", "b"]) == 1


def test_sampling(spark):
    df = spark.range(200).withColumn("w", (F.col("id") % 3).cast("double"))
    a = rows(sampling.weighted_sample(df, 20, F.col("w"), 7, "id"))
    assert a == rows(sampling.weighted_sample(df.repartition(7), 20, F.col("w"), 7, "id")) and len(a) == 20 and all(w > 0 for _, w in a)
    assert rows(sampling.uniform_sample(df, 5, 1, "id")) == rows(sampling.uniform_sample(df.repartition(3), 5, 1, "id"))
    assert rows(sampling.shuffled(df, 4, 3, "id")) == rows(df)
    n = df.where(sampling.bernoulli(0.3, 5, "id")).count()
    assert 30 < n < 90


def test_examples(spark):
    seg = spark.read.parquet("/root/testdata/sf0.001/segment_k2f.parquet")
    e = examples.build_examples(seg, 400)
    got = e.collect()
    assert len(got) == seg.select("record_id").distinct().count()
    one = seg.groupBy("record_id", "seg_idx").agg(F.max_by(F.struct("tok_ids", "title", "random_text"), "arrived_at").alias("x")).select("record_id", "seg_idx", "x.*").collect()
    for r in got:
        mine = sorted((x for x in one if x.record_id == r.record_id), key=lambda x: x.seg_idx)
        assert len(r.text_to_audio) == len(r.audio_to_text) == len(r.matching) == len(r.random_text) == 400
        # Targets of both views: twelve spans each, numbered on; the sound is hidden in the first view only.
        assert sorted(t.text_ptr for t in r.text_to_audio if t.tok == 3) == list(range(12)) == sorted(t.text_ptr - 12 for t in r.audio_to_text if t.tok == 3)
        assert sum(t.tok == 4 for t in r.text_to_audio) == 12 and not any(t.tok == 4 for t in r.audio_to_text)
        assert [t.audio_ptr for t in r.matching if t.tok == 6] == [x.seg_idx * 3 for x in mine]
        assert sum(t.tok == 5 for t in r.matching) == 18 * len(mine) and r.matching[0].tok == 1 and r.matching[0].audio_ptr == -1
        # No token is lost or doubled in the first view: those shown and those asked for are all.
        whole = [t for x in mine for t in x.tok_ids or []]
        if len(whole) < 200:
            shown, asked = [t for t in r.text_to_audio if t.audio_ptr >= 0 and t.tok not in (3, 4)], r.targets[:12]
            if all(s[-1] == 0 for s in asked):
                assert sorted([t.tok for t in shown] + [t for s in asked for t in s if t]) == sorted(whole)
        assert all(len(s) == 15 for s in r.targets)
        random = [t.tok for t in r.random_text if t.tok > 10]
        assert not random or any(set(random) <= set(x.random_text or []) for x in mine[:4])
    assert sorted(map(str, got)) == sorted(map(str, examples.build_examples(seg.repartition(5), 400).collect()))


def brute_grow(lengths, centres, masked, starts, ends, right, delta):
    cuts, at = [], 0
    for n in lengths:
        cuts.append(centres[at : at + n])
        at += n
    out, step = list(lengths), 1 if right else -1
    for i in range(len(lengths)):
        j = i + step
        if masked[i] and 0 <= j < len(lengths) and not masked[j] and lengths[j] > 1:
            if (min(cuts[j]) - ends[i] if right else starts[i] - max(cuts[j])) < delta:
                out[i] += 1
                out[j] -= 1
    return out


def test_growth_against_brute_force(spark):
    r = random.Random(2)
    data = []
    for k in range(60):
        n = r.randrange(1, 9)
        lengths = [r.randrange(0, 4) for _ in range(n)]
        c = sorted(round(r.uniform(0, n), 2) for _ in range(sum(lengths)))
        data.append((k, lengths, c, [r.random() < 0.4 for _ in range(n)], [float(i) for i in range(n)], [i + 0.9 for i in range(n)], r.random() < 0.5))
    df = spark.createDataFrame(data, "k int, n array<int>, c array<double>, m array<boolean>, a array<double>, b array<double>, r boolean")
    spans = run_lengths_to_spans(F.col("c"), F.col("n"))
    got = {x.k: x.g for x in df.select("k", masking.grown_spans(spans, F.col("c"), F.col("m"), F.col("a"), F.col("b"), F.col("r"), 0.3).alias("g")).collect()}
    for k, lengths, c, m, a, b, right in data:
        want = brute_grow(brute_grow(lengths, c, m, a, b, right, 0.3), c, m, a, b, not right, 0.3)
        assert [len(s) for s in got[k]] == want and [t for s in got[k] for t in s] == c


def test_drawn_lengths_fill_the_room(spark):
    df = spark.createDataFrame([(i, list(range(20, 20 + 7 * i))) for i in range(30)], "k int, t array<int>")
    for r in df.select("k", "t", masking.drawn_lengths(F.col("t"), 60, 3, 4, "k").alias("l")).collect():
        assert sum(r.l) <= min(len(r.t), 72) and all(1 <= x <= 15 for x in r.l) and (sum(r.l) > min(len(r.t), 60) - 16)


def test_valid_tokens(spark):
    v = spark.createDataFrame([(11, "a b"), (12, "a-b"), (149, "x"), (5, "y"), (13, "it's"), (14, None)], "id int, text string")
    table = masking.valid_table(v)
    df = spark.createDataFrame([([5, 11, 12, 13, 14, 149, 999, -1],), ([],), (None,)], "t array<int>")
    assert [r[0] for r in df.select(masking.valid_tokens(F.col("t"), table)).collect()] == [[11, 13], [], None]
    with pytest.raises(ValueError, match="more than"):
        masking.valid_table(v, 1)


def test_valid_tokens_of_a_vocabulary_of_any_size(spark):
    B = 1 << masking.BLOCK
    v = spark.createDataFrame([(11, "a b"), (11, "a b"), (12, "a-b"), (149, "x"), (5, "y"), (13, "it's"), (14, None), (63, "z"), (64, "z"), (B - 1, ""), (B, "b"), (3 * B + 127, "c"), (2**31 - 1, "d"), (2**40 + 15, "e"), (None, "f")], "id bigint, text string")
    arrays = [[5, 11, 12, 13, 14, 149, 999, -1], [], None, [None, B, 11, None, B - 1, B, 63], [3 * B + 127, 64, 2**31 - 1, 2 * B + 11, 15, 65], [3, 149]]
    df = spark.createDataFrame([(None if i == 3 else i, a) for i, a in enumerate(arrays)], "k int, t array<int>")
    want = [(0, 8, [11, 13]), (1, 0, []), (2, None, None), (None, 7, [B, 11, B - 1, B, 63]), (4, 6, [3 * B + 127, 64, 2**31 - 1]), (5, 2, [])]
    for few in (0, 100):
        assert rows(masking.valid_by_blocks(df, ["k"], "t", v, few)) == sorted(want, key=str)
    assert masking.valid_by_blocks(df.limit(0), ["k"], "t", v).count() == 0
    assert rows(masking.valid_by_blocks(df, ["k"], "t", v.limit(0))) == sorted([(k, n, None if n is None else []) for k, n, _ in want], key=str)
    many = spark.range(1_000_200).selectExpr("id", "'w' as text")  # more ids than a table may have
    assert rows(masking.valid_by_blocks(df, ["k"], "t", many).where("k = 0")) == [(0, 8, [11, 12, 13, 14, 999])]


def test_query_of_valid_tokens_takes_a_large_vocabulary(spark, tmp_path):
    spark.range(1_000_200).selectExpr("id as doc_id", "if(id = 20, 'no-word', 'word and more') as text").write.parquet(f"{tmp_path}/documents.parquet")
    cols = "record_id bigint, seg_idx int, youtube_id string, video_src_index int, start_time double, end_time double, playback_speed double, tok_ids array<int>, tok_start_times array<double>, tok_end_times array<double>, title array<int>, tags array<int>, random_text array<int>, arrived_at timestamp_ntz"
    seg = [(1, k, "v", 0, 0.0, 1.0, 1.0, [], [], [], [], [], t, datetime(2022, 1, 1)) for k, t in enumerate([[5, 20, 21, 21, 1_000_199, 1_000_200], [20], [], None])]
    spark.createDataFrame(seg, cols).write.parquet(f"{tmp_path}/segment_k2f.parquet")
    assert rows(QUERIES["valid_tokens"](spark, str(tmp_path))) == [(1, 0, 3, 6), (1, 1, 0, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(2, 16), st.integers(1, 10), st.integers(0, 9))
def test_groups_with_draws_are_full_and_disjoint(counts, size, most, seed):
    def made():
        p, groups = packing.Packer(size, most, seed), []
        for k, n in enumerate(counts):
            groups += p.add(k, 0, n)
        return groups + list(p.finish())

    groups = made()
    used = [(k, i) for g in groups for k, a, n in g for i in range(a, a + n)]
    assert all(sum(n for _, _, n in g) == size for g in groups) and len(used) == len(set(used)) and all(0 <= i < counts[k] for k, i in used)
    assert groups == made()


def test_numbering(spark):
    r = random.Random(5)
    data = [(r.choice("abc") + str(r.randrange(10_000)), i) for i in range(500)]
    df = spark.createDataFrame(data, "s string, n int").withColumnRenamed("n", "other")
    for parts in (1, 3, 16):
        got = numbering.numbered(df, "s", "other", parts=parts).orderBy("n").collect()
        assert [(x.s, x.other) for x in got] == sorted(data) and [x.n for x in got] == list(range(500)) and got[0].total == 500
    assert numbering.numbered(df.limit(0), "s").count() == 0
    assert [numbering.shard_of(df, 3, k, "s", "other").count() for k in range(3)] == [167, 167, 166]
    z = numbering.zipped(df, ["s", "other"], spark.range(3).withColumnRenamed("id", "b"), ["b"])
    assert sorted((x.n, x.s, x.b) for x in z.collect()) == [(i, s, i) for i, (s, _) in enumerate(sorted(data)[:3])]
    with pytest.raises(Exception, match="ends before"):
        numbering.zipped(df, ["s"], spark.range(3).withColumnRenamed("id", "b"), ["b"], strict=True).collect()
    e = numbering.epochs(df, 3, 1, "s", 2, 0).unionByName(numbering.epochs(df, 3, 1, "s", 2, 1))
    assert e.count() == 1500 and e.select("s", "epoch", "file_order").distinct().count() == 3 * len({s for s, _ in data})


def test_sizes_and_rates(spark):
    df = spark.createDataFrame([(300, 200), (1000, 200), (640, 480), (480, 640), (2000, 400), (512, 288)], "w int, h int")
    got = [tuple(r[0]) for r in df.select(S.resize_size(F.col("w"), F.col("h"), 288, 512)).collect()]
    # Short sides at or under the target stay; else the short side is the target, or round(512 short / long).
    assert got == [(300, 200), (1000, 200), (384, 288), (288, 384), (510, 102), (512, 288)]
    last = spark.range(1).select(S.learning_rate(F.lit(10), 1.0, 1, 10, "linear"), S.learning_rate(F.lit(4), 1.0, 8, 9)).first()
    assert round(last[0], 6) == 0.1 and last[1] == 0.5
    g = spark.range(1).select(S.grid_coordinates(F.lit(2), F.lit(3)), S.centred_coordinates(F.lit(5)), S.plain_coordinates(F.lit(2)), S.joint_coordinates(token=F.lit(512))).first()
    assert [(round(x.h, 3), round(x.w, 3)) for x in g[0]] == [(-0.25, -0.25), (-0.25, 0.25), (-0.25, 0.5), (0.25, -0.25), (0.25, 0.25), (0.25, 0.5)]
    assert g[1] == [-2.0, -1.0, 1.0, 2.0, 3.0] and g[2] == [1.0, 2.0] and g[3] == [0.0, 0.0, 0.0, 0.5]
    w = spark.range(1).select(S.normalised_wave(F.array(F.lit(2.0), F.lit(-4.0)), F.lit(4)), S.too_short(F.lit(5.5)), S.too_short(F.lit(None).cast("double")), S.of_size(F.array(F.lit(1)), 1)).first()
    assert w[0] == [0.5, -1.0, 0.0, 0.0] and w[1] and w[2] and w[3] == [1]
    with pytest.raises(Exception, match="other than 2"):
        spark.range(1).select(S.of_size(F.array(F.lit(1)), 2)).collect()


def test_windows_start_at_the_first_word(spark):
    words_ = spark.createDataFrame([("v", 12.0 + i / 2, 60.0, 11.876) for i in range(80)], "k string, center double, duration double, start double")
    first = S.adaptive_windows(words_, "k", start="start").orderBy("seg_idx").first()
    assert first.start_time == 11.88 and first.end_time == 16.88
    drawn = S.adaptive_windows(words_, "k", start="start", seed=3).orderBy("seg_idx").collect()
    assert 11.876 - 2.5 <= drawn[0].start_time <= 11.88 and drawn == S.adaptive_windows(words_.repartition(3), "k", start="start", seed=3).orderBy("seg_idx").collect()
    u = spark.range(1).select(uniform(3, F.lit("v"))).first()[0]
    assert S.chance(3, "v") == u and drawn[0].start_time == round(11.876 - 2.5 * u, 2)


def test_words_in_a_row(spark):
    df = spark.createDataFrame([(1, "HELLO I am Ab,c"), (2, ""), (3, "x")], "d int, t string")
    q = {r.d: r.q for r in df.select("d", words.row_quality(words.split_words(F.col("t"))).alias("q")).collect()}
    w = {r.d: r for r in words.token_quality(words.words_of(df, "d", "t"), "d").collect()}
    assert q[2] is None and all((q[k].n_words, q[k].frac_good, round(q[k].len_var, 9)) == (w[k].n_words, w[k].frac_good, round(w[k].len_var, 9)) for k in (1, 3))
    cols = ["d", "pos", "word", *[f"feat_{n}{x}" for n in ("charlen", "is_upper", "num_vowels", "num_punct") for x in ("", "_left", "_right")]]
    want = words.word_features(words.words_of(df, "d", "t"), "d").select(*cols)
    got = words.row_features(df.unionByName(spark.createDataFrame([(4, None)], df.schema)), words.split_words(F.col("t")), "d").select(*cols)
    assert rows(got) == rows(want) and got.count() == 5
    subs = spark.createDataFrame([("&gt;",), ("x;",), ("",), ("\x07",), ("caf\u00c3\u00a9",), (None,)], "word string")
    assert rows(words.clean_subtitles(subs)) == [("caf\u00c3\u00a9",)] and rows(words.clean_subtitles(subs, store_repaired=True)) == [("caf\u00e9",)]
    t = spark.range(1).select(words.per_token(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>"), F.array(F.lit(3))))).first()[0]
    assert t == ["a", "a", "c"]


def test_gates_of_language_and_sound(spark):
    df = spark.createDataFrame([("en", 0.9, 1), ("en", 0.7, 1), ("en", 0.9, 0), ("en", 0.9, None)], "lang string, p double, a int")
    one = F.lit(1.0)
    gates = quality.crawl_gates(transcript=F.lit("x"), duration=one, categories=F.array(F.lit("A")), density=one * 60, lang=F.col("lang"), cosine=one / 2, objects=one, lang_prob=F.col("p"), audio_streams=F.col("a"))
    assert [r.failreason for r in quality.with_reason(df, gates).collect()] == [None, "maybe not english", "no audio", "no audio"]


def test_neighbours(spark):
    r = random.Random(9)
    data = [(k, i, r.randrange(99)) for k in ("a", "b", None) for i in r.sample(range(0, 300), 50)] + [("c", 5, 1)]
    df = spark.createDataFrame(data, "k string, pos int, v int")
    want = []
    for k in ("a", "b", None, "c"):
        mine = sorted(x for x in data if x[0] == k)
        want += [(*x, mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None) for i, x in enumerate(mine)]
    for width in (1, 7, 1000):
        assert rows(neighbours(df, ["k"], ["pos"], F.floor(F.col("pos") / width), ["v"])) == sorted(want, key=str)
    assert neighbours(df.limit(0), ["k"], ["pos"], F.lit(0), ["v"]).count() == 0


def test_rankings_in_rows_and_by_blocks(spark, monkeypatch):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.choice([None, *range(9)]), r.choice([None, [r.uniform(-1, 1) for _ in range(4)]]) if i else None) for i in range(80)], "vec_id int, label int, embedding array<double>")
    want = rows(vectors.ranked_labels(df, 4).select("vec_id", "cand", F.round("score", 9), "rank"))
    assert want and rows(vectors.ranked_by_blocks(df, 4).select("vec_id", "cand", F.round("score", 9), "rank")) == want
    own = {x.vec_id: x.rank for x in vectors.ranked_labels(df).where("cand = label").collect()}
    assert {x.vec_id: x.rank for x in vectors.own_ranks(df).collect()} == own
    monkeypatch.setattr(vectors, "LABEL_BLOCK", 4)
    assert rows(vectors.ranked_by_blocks(df, 4).select("vec_id", "cand", F.round("score", 9), "rank")) == want
    with pytest.raises(Exception, match="too many labels"):
        vectors.ranked_labels(df).collect()
    assert vectors.ranked_labels(df.limit(0)).count() == 0
