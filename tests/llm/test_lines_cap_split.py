import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import cap, lines, split
from wordloom.llm.components import components

SEG = "record_id bigint, seg_idx int, youtube_id string, description string, arrived_at timestamp_ntz, channel int, key int, slots string, n_docs int"
META = "youtube_id string, channel_id string, view_count double, _num_coco_objects_expectation double, categories array<string>, crawled_at timestamp_ntz, channel string, n int"
T0, T1 = datetime(2022, 1, 1), datetime(2023, 1, 1)


def seg(spark, texts):
    return spark.createDataFrame([(i, 0, v, d, T0, 1, 1, "x", 1) for i, (v, d) in enumerate(texts)], SEG)


def meta(spark, rows):
    return spark.createDataFrame([(v, c, w, q, cats, t, "x", 1) for v, c, w, q, cats, t in rows], META)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def videos(n, channel="c"):
    return [(f"v{i}", channel, 1.0, 1.0, ["A"], T0) for i in range(n)]


def test_lines_with_other_marks_and_case_are_the_same(spark):
    texts = ["Thumbs up!", "thumbs-up", "  THUMBS​ UP 🔥", "**Thumbs, up**\r", "thumbs up\nown line"] + ["Take 17: other"] * 4
    s = seg(spark, [(f"v{i}", "first\n\n" + t + "\n---") for i, t in enumerate(texts[:5])] + [(f"v{i + 5}", t) for i, t in enumerate(texts[5:])])
    m = meta(spark, videos(9))
    got = rows(lines.repeated_lines(s, m).select("youtube_id", "line_no"))
    assert got == sorted([(f"v{i}", k) for i in range(5) for k in (1, 3)])
    clean = dict(rows(lines.without_repeated_lines(s, m).select("youtube_id", "description")))
    assert clean["v4"] == "\nown line\n---" and clean["v0"] == "\n---" and clean["v5"] == "Take 17: other"


def test_lines_edges(spark):
    same = "x" * 40_000
    s = seg(spark, [("v0", same), ("v0", same), ("v1", same), ("v2", same), ("v3", same), (None, same), ("", same), ("v5", None), ("v6", ""), ("v7", "---\n \n")] + [("v8", same)] * 9)
    m = meta(spark, videos(8) + [("v8", None, 1.0, 1.0, None, T0), ("v3", "c2", 1.0, 1.0, None, T1)])
    assert rows(lines.repeated_lines(s, m)) == []  # three videos of c, one moved, one without channel
    m2 = meta(spark, videos(4) + [("v8", " c ", 1.0, 1.0, None, T0)])
    assert [r[0] for r in rows(lines.repeated_lines(s, m2))] == ["v0", "v1", "v2", "v3", "v8"]
    assert lines.repeated_lines(s.limit(0), m2).count() == 0 and lines.repeated_lines(s, m2.limit(0)).count() == 0
    assert lines.without_repeated_lines(s.limit(0), m2).count() == 0


def test_lines_against_brute_force(spark):
    r = random.Random(1)
    pool = [f"Line {k} of the {r.choice('abc')} kind" for k in range(30)]
    data = [(f"v{i}", "\n".join(r.choice(pool) + r.choice(["", "!", " "]) for _ in range(r.randrange(1, 8)))) for i in range(120)]
    chan = {f"v{i}": f"c{i % 7}" for i in range(120)}
    m = meta(spark, [(v, c, 1.0, 1.0, None, T0) for v, c in chan.items()])
    key = lambda x: "".join(c for c in x.lower() if c.isalnum())
    seen = defaultdict(set)
    for v, d in data:
        for ln in d.split("\n"):
            seen[chan[v], key(ln)].add(v)
    want = sorted({(v, i + 1) for v, d in data for i, ln in enumerate(d.split("\n")) if len(seen[chan[v], key(ln)]) >= 5})
    assert rows(lines.repeated_lines(seg(spark, data), m).select("youtube_id", "line_no")) == want


def test_wildcards(spark):
    s = seg(spark, [(f"v{i}", f"Music number {i * 7919} here it is") for i in range(6)])
    t = lines.templates(s, meta(spark, videos(6))).collect()
    assert len(t) == 1 and t[0].n_wild >= 1 and t[0].n_lines == 6 and lines.WILD in t[0].template


def test_templates_count_different_documents(spark):
    six = "\n".join(f"Chapter one part{x} go" for x in "abcdef")
    tree = lines.parsed(lines.lines_of(lines.described(seg(spark, [("v0", six)]), meta(spark, videos(1)))), 1)
    assert lines.templates(seg(spark, [("v0", six)]), meta(spark, videos(1))).count() == 0
    assert {tuple(r.slots) for r in tree.collect()} == {("chapter", "one", f"part{x}", "go") for x in "abcdef"}
    two = lines.templates(seg(spark, [("v0", six), ("v1", six)]), meta(spark, videos(2)), 2).collect()
    assert {(t.n_docs, t.n_lines, t.n_wild) for t in two} == {(2, 1, 0)} and len(two) == 6


def test_lines_with_changing_parts_are_removed_as_templates(spark):
    s = seg(spark, [(f"v{i}", f"Own words {'abcdefghijkl'[i] * 3}\nUploaded on 2024-01-{i + 10} by the studio") for i in range(12)])
    m = meta(spark, videos(12))
    got = lines.template_lines(s, m).select("youtube_id", "line_no", "template", "n_docs")
    assert rows(got) == sorted((f"v{i}", k, t, 12) for i in range(12) for k, t in ((1, "own words <*>"), (2, "uploaded on 2024 01 <*> by the studio")))
    assert rows(lines.template_lines(s, m, literal=0.7).select("line_no").distinct()) == [(2,)]
    assert lines.repeated_lines(s, m).count() == 0


def test_repeated_lines_are_counted_without_the_tree(spark, monkeypatch):
    s = seg(spark, [(f"v{i}", f"Same line!\nPart {x} of the show\nTwice, in one text\nsame LINE") for i, x in enumerate("abcdef")] + [("v6", "Rare\nrare"), ("v7", "same line")])
    m = meta(spark, videos(7) + [("v7", "other", 1.0, 1.0, None, T0)])
    of_tree = rows(lines.template_lines(s, m).select("youtube_id", "line_no"))
    monkeypatch.delattr(lines, "parsed")
    got = rows(lines.repeated_lines(s, m).select("youtube_id", "line_no"))
    assert got == sorted((f"v{i}", k) for i in range(6) for k in (1, 3, 4))
    assert of_tree == sorted(got + [(f"v{i}", 2) for i in range(6)])  # what only the tree finds
    clean = dict(rows(lines.without_repeated_lines(s, m).select("youtube_id", "description")))
    assert clean["v0"] == "Part a of the show" and clean["v6"] == "Rare\nrare" and clean["v7"] == "same line"


def test_latest_channel_counts(spark):
    m = meta(spark, [("v0", "c", 1.0, 1.0, None, T0), ("v0", " \t", 1.0, 1.0, None, T1)] + videos(5)[1:])
    s = seg(spark, [(f"v{i}", "same") for i in range(5)])
    assert lines.repeated_lines(s, m).count() == 0


def caps(spark, counts, max_count=None, max_share=None):
    data = [(None if c == "-" else c, i, float(i % 3)) for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(data, "c string, i int, q double")
    out = cap.cap_contributors(df, "c", [F.desc("q"), F.asc("i")], max_count, max_share, salts=3)
    assert out.count() == len(data)
    return out, Counter(r.c for r in out.where("kept").collect())


def test_cap_counts(spark):
    out, kept = caps(spark, {"a": 20, "b": 3, "-": 9}, 5)
    assert kept == {"a": 5, "b": 3, None: 9}
    assert sorted(r.i for r in out.where("kept and c = 'a'").collect()) == [2, 5, 8, 11, 14]
    assert caps(spark, {"a": 4}, None)[1] == {"a": 4} and caps(spark, {"a": 4}, 0)[1] == {}


@pytest.mark.parametrize("counts", [{"a": 100, "b": 10, "c": 10, "d": 5}, {"a": 7, "b": 7, "c": 7}, {"a": 50, "-": 30}, {"a": 3, "b": 2, "c": 1, "d": 1, "e": 1, "-": 2}])
@pytest.mark.parametrize("share", [0.5, 0.34, 0.2, 0.05])
def test_share_levels_against_brute_force(spark, counts, share):
    named, free = [n for c, n in counts.items() if c != "-"], counts.get("-", 0)
    ok = [L for L in range(max(named) + 1) if min(L, max(named)) <= share * (free + sum(min(n, L) for n in named)) + 1e-9]
    _, kept = caps(spark, counts, None, share)
    want = {c: min(n, max(ok)) for c, n in counts.items() if c != "-" and max(ok)} | ({None: free} if free else {})
    assert kept == want


def test_both_rankings_agree(spark):
    data = [("abc"[i % 7 % 3], i, float(i * 31 % 17)) for i in range(600)] + [(None, i, 1.0) for i in range(5)]
    df = spark.createDataFrame(data, "c string, i int, q double")
    best = [F.desc("q"), F.asc("i")]
    for level in (1, 60, 599):
        assert rows(cap.cap_contributors(df, "c", best, level, few=0)) == rows(cap.cap_contributors(df, "c", best, level))


def test_capped_videos(spark):
    nan = float("nan")
    m = meta(spark, [(f"v{i}", "c", v, q, None, T0) for i, (q, v) in enumerate([(nan, 9.0), (None, 9.0), (0.5, -1.0), (0.5, None), (0.5, 0.0), (0.7, 1.0), (-1.0, 1.0), (0.5, 0.0), (0.1, nan)])])
    m = m.unionByName(m).unionByName(meta(spark, [("w", None, 1.0, 1.0, None, T0), ("", "c", 1.0, 1.0, None, T0), ("v5", " c", 1.0, 0.9, None, T1)]))
    got = cap.capped_videos(m, 3)
    assert rows(got.where("kept").select("youtube_id")) == [("v4",), ("v5",), ("v7",), ("w",)]
    assert got.count() == 10 and cap.capped_videos(m.limit(0), 3).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(2)
    for n, e in ((40, 30), (60, 80), (30, 0)):
        edges = [(f"n{r.randrange(n):03d}", f"n{r.randrange(n):03d}") for _ in range(e)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(e)]
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        df = spark.createDataFrame(edges + [(None, "x"), ("y", None), ("z", "z")], "a string, b string")
        assert dict(rows(components(df))) == {x: find(x) for x in up}


def split_tables(spark):
    r = random.Random(5)
    m = [(f"v{i}", f"c{int(r.random() ** 2 * 40)}", 1.0, 1.0, r.choice([["A"], ["B"], ["A", "C"], [], None]), T0) for i in range(300)]
    m += [(f"v{r.randrange(300)}", f"c{r.randrange(40)}", 1.0, 1.0, ["A"], T1) for _ in range(6)] + [("v1", " ", 1.0, 1.0, None, T1), ("none", "c0", 1.0, 1.0, None, T0), ("none", "c39", 1.0, 1.0, None, T1)]
    s = [(f"v{r.randrange(300)}", "x") for _ in range(2000)] + [(None, "x"), ("", "x")] + [(f"lone{i}", "x") for i in range(50)]
    return seg(spark, s), meta(spark, m), m, s


def test_splits_keep_channels_together(spark):
    s, m, mrows, srows = split_tables(spark)
    plan = spark.createDataFrame([("train", 80.0), ("validation", 10.0), ("test", 10.0), ("none", None)], "split_name string, share_pct double")
    got = {r.youtube_id: (r.split_name, r.n_rows) for r in split.assign_splits(s, m, plan, shard_groups=40).collect()}
    assert set(got) == {v for v, _ in srows if v} and sum(n for _, n in got.values()) == 2050
    by = defaultdict(set)
    for v, c, *_ in mrows:
        if v in got and c.strip():
            by[c].add(got[v][0])
    assert all(len(x) == 1 for x in by.values())
    share = Counter()
    for name, n in got.values():
        share[name] += n / 2050
    assert abs(share["train"] - 0.8) < 0.08 and share["test"] > 0.03 and share["validation"] > 0.03
    assert split.split_rows(s, m, plan).count() == 2050
    assert split.assign_splits(s.limit(0), m, plan).count() == 0
    with pytest.raises(ValueError):
        split.assign_splits(s, m, plan.limit(0))


def test_joined_channels(spark):
    s = seg(spark, [("a", "x"), ("b", "x"), ("d", "x")])
    m = meta(spark, [("a", "c1", 1.0, 1.0, None, T0), ("a", " c2", 1.0, 1.0, None, T1), ("b", "c2", 1.0, 1.0, None, T0), ("b", "c3", 1.0, 1.0, None, T0), ("gone", "c3", 1.0, 1.0, None, T0), ("gone", "c4", 1.0, 1.0, None, T0), ("d", "c5", 1.0, 1.0, None, T0), ("d", None, 1.0, 1.0, None, T0)])
    assert rows(split.joined_channels(s, m)) == [("c1", "c2"), ("c1", "c3"), ("c2", "c3")]
    assert split.joined_channels(s.limit(0), m).count() == 0


def test_roots_of_all_channels(spark):
    s = seg(spark, [(f"v{i}", "d") for i in range(4)])
    m = meta(spark, [("v0", "c1", 1.0, 1.0, None, T0), ("v0", "c2", 1.0, 1.0, None, T1), ("v1", "c3", 1.0, 1.0, None, T0), ("v9", "c4", 1.0, 1.0, None, T0), ("v2", " ", 1.0, 1.0, None, T0)])
    assert rows(split.channel_roots(s, m)) == [("c1", "c1"), ("c2", "c1"), ("c3", "c3")]


def test_labels_keep_their_shares(spark):
    r = random.Random(7)
    many = [(f"v{i}", f"c{i % 700}", 1.0, 1.0, r.sample("ABCDE", r.choice([1, 1, 2])) + (["Z"] if i % 400 == 0 else []), T0) for i in range(4000)]
    plan = spark.createDataFrame([("train", 80.0), ("test", 10.0), ("val", 10.0)], "split_name string, share_pct double")
    got = split.label_balance(seg(spark, [(v, "d") for v, *_ in many]), meta(spark, many), plan).collect()
    for g in got:
        if g.label != "Z":
            assert abs(g.share_pct - {"train": 80, "test": 10, "val": 10}[g.split_name]) < 1.0, g
    assert sum(g.rows for g in got) == sum(len(x[4]) for x in many)


def test_refine_moves_only_for_the_better():
    g = np.random.default_rng(3)
    w = np.column_stack([np.full(200, 5.0), g.integers(0, 3, (200, 4))])
    target = np.array([0.8, 0.1, 0.1])[:, None] * w.sum(axis=0)
    first = split.place(w, target.copy())
    off = lambda s: sum(np.abs(w[s == k].sum(axis=0) - target[k]).sum() for k in range(3))
    assert off(split.refine(w, first.copy(), target)) <= off(first)
    assert len(split.refine(w[:0], first[:0], target)) == 0
