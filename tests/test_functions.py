"""Hand-worked cases of the text, array and geometry functions."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import arrays as A
from wordloom.functions import text as T
from wordloom.operators import segments as S


def one(spark, **cols):
    r = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return r.asDict(recursive=True)


def test_clocks(spark):
    r = one(spark, a=T.seconds_of_clock(F.lit("01:02:03.500")), b=T.clock_of_seconds(F.lit(3723.5)), c=T.clock_of_seconds(F.lit(59.9996)), d=T.seconds_of_clock(F.lit("x")), e=T.clock_of_seconds(F.lit(None).cast("double")))
    assert r == {"a": 3723.5, "b": "01:02:03.500", "c": "00:00:59.000", "d": None, "e": None}


@pytest.mark.parametrize("text,want", [("5:07", "five oh seven"), ("5:00", "five"), ("5:30", "five thirty"), ("$12.50", "twelve dollars"), ("3rd", "third"), ("21st", "twenty-first"), ("100 and 42", "100 and forty-two"), ("", ""), (None, None)])
def test_spelling(text, want):
    assert T.spell_text(text) == want


@pytest.mark.parametrize("text", ["Café – naïve", "plain", "", None, "日本", "Ünïcödé", "“quoted”…", "\U0001f600 ok"])
def test_repair(spark, text):
    once = text and text.encode().decode("cp1252", "replace")
    fixed = lambda t: spark.createDataFrame([(t,)], "t string").select(T.repaired_text(F.col("t"))).first()[0]
    assert fixed(text) == text
    if once is not None and "\ufffd" not in once:
        assert fixed(once) == text
        twice = once.encode().decode("cp1252", "replace")
        assert "\ufffd" in twice or fixed(twice) == text
    assert T.name_emoji("a\U0001f600b") == "a[grinningface]b" and T.name_emoji(None) is None


def test_folding(spark):
    # By hand from the usual spelling of each letter and sign.
    texts = {"Москва…": "Moskva...", "Щука, Ёж": "Shchuka, Iozh", "Αθήνα": "Athena", "Straße — Øre": "Strasse    Ore", "“a” ‘b’": "\"a\" 'b'", "(x) [y] {z} a_b": " x   y   z  a b", "½ € ©": "1/2 EUR  c ", "ﬁn 日本": "ﬁn 日本", "e\u0301": "e", "Ａ１": "A1", "": ""}
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold_ascii(F.col("t")).alias("f")).collect()}
    assert got == texts


def test_spelled_numbers_in_spark(spark):
    df = spark.createDataFrame([("5:07",), (None,), ("no",)], "t string")
    assert [r[0] for r in df.select(T.spelled_numbers(F.col("t"))).collect()] == ["five oh seven", None, "no"]
    for _ in range(3):
        rows = T.spoken_text(spark.range(400).withColumn("t", F.concat(F.lit("take 7 “"), F.lit("”"))), "t", "s", 3, "id").collect()
    n = sum(r.s == 'take seven "' for r in rows)
    assert 140 < n < 260 and {r.s for r in rows} == {'take seven "', 'take 7 "'}


def test_small_texts(spark):
    r = one(spark, loc=T.location_text(F.lit(1.0), F.lit(2.999), F.lit(3.0)), ann=T.annotation_id(F.lit("val-12-q_a1")), cond=T.condition_of(F.lit("val-12-q_a1")), names=T.named_references(F.array(F.lit(1), F.lit(9), F.lit(0)), F.array(F.lit("the car"), F.lit("Person 1"))), search=T.searchable_text(F.lit("T"), F.lit("see #x www.y me"), F.array(F.lit("a"), F.lit("b"))), none=T.searchable_text(F.lit(None), F.lit(None), F.lit(None).cast("array<string>")), ok=T.is_clean(F.lit("It's 5, ok?")), bad=T.is_clean(F.lit("a-b")))
    assert r == {"loc": "33 to 99", "ann": "val-12", "cond": "a1", "names": "Person 1", "search": "T\nsee me\na b", "none": "\n\n", "ok": True, "bad": False}


def test_addresses_in_brackets(spark):
    # The public pattern takes brackets nested once; both forms agree on these.
    texts = {"see https://a.example/b_(c_(d)_e)?x=1, now": "see %, now", "(www.a.example/x)": "(%)", "a.org/b end.": "% end.", "a.example/b": "a.example/b", "no.such place": "no.such place", "http://x.example/a(b": "%(b"}
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_description(F.col("t")).alias("f")).collect()}
    assert got == texts


def test_cleaning(spark):
    r = one(spark, runs=T.collapse_runs(F.lit("a!!b??")), clean=T.clean_text(F.lit("Café <br>(naïve) & 50%...\n\nok\U0001f600")), none=T.clean_text(F.lit(None).cast("string")), empty=T.clean_text(F.lit("  ")), desc=T.clean_description(F.lit("See https://a.example/b?c=1 now  \n\n\n end \n")), toks=T.description_tokens(F.lit("hi #tag see http://x @me www.a.b there")))
    assert r == {"runs": "a!b?", "clean": "Cafe naive and 50 percent . ok grinningface", "none": None, "empty": "", "desc": "See % now\n end", "toks": "hi see there"}


def test_clean_description_is_fast_on_long_texts(spark):
    long = "https://a.example/" + "(" * 3000 + "x" * 20000
    assert spark.createDataFrame([(long,)], "t string").select(T.clean_description(F.col("t"))).first()[0]


def test_words(spark):
    r = one(spark, up=T.is_upper(F.lit("HELLO,")), no=T.is_upper(F.lit("12")), norm=T.normalised_word(F.lit(" Don't! ")), v=T.vowels(F.lit("Queue")), p=T.marks(F.lit("a-b.")), colour=T.stable_colour(F.lit("person")))
    assert (r["up"], r["no"], r["norm"], r["v"], r["p"]) == (True, False, "dont", 4, 2)
    assert len(r["colour"]) == 3 and all(0 <= x <= 255 for x in r["colour"])


def test_colour_against_whole_digest(spark):
    import hashlib

    d = int(hashlib.sha256(b"car").hexdigest(), 16)
    assert one(spark, c=T.stable_colour(F.lit("car")))["c"] == [d % m * 255 // (m - 1) for m in (1024, 1023, 1025)]


def test_templates_and_names(spark):
    r = one(spark, bad=T.infill(F.lit("a _ is _.")), good=T.infill(F.lit("a _ is red.")), noun=T.reversed_noun(F.lit("knife:butter")), iv=T.interval_of(F.lit("10.5-20")), nan=T.interval_of(F.lit("nan-nan")), tok=T.fix_token(F.lit("a:b")), ans=T.fix_token(F.lit("Answer:")), sent=T.fix_tokens(F.array(*[F.lit(x) for x in ("I", "do", "n't", "know", ",", "it", "'s", "x", ";")])))
    assert r == {"bad": None, "good": "a<|MASK|> is red.", "noun": "butter knife", "iv": {"a": 10.5, "b": 20.0}, "nan": {"a": 0.0, "b": 9999.0}, "tok": "a b", "ans": "Answer:", "sent": "I don't know, it's x"}


def test_arrays(spark):
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, pad=A.fit_tokens(lit(1, 2), 4), cut=A.fit_tokens(lit(1, 2, 3), 2), hot=A.one_hot(lit(0, 2), 3), mx=A.cumulative_max(lit(1, 3, 2)), spans=A.run_lengths_to_spans(lit(1, 2, 3, 4), lit(1, 0, 3)), arg=A.argmax(lit(1.0, 5.0, 5.0)), soft=A.softmax(lit(0.0, 0.0)), ptr=A.media_pointers(F.lit(1)), none=A.fit_tokens(F.lit(None).cast("array<int>"), 2), zero=A.cosine(lit(0.0, 0.0), lit(1.0, 0.0)))
    assert r["pad"] == [1, 2, 0, 0] and r["cut"] == [1, 2] and r["hot"] == [True, False, True] and r["mx"] == [1, 3, 3]
    assert r["spans"] == [[1], [], [2, 3, 4]] and r["arg"] == 1 and r["soft"] == [0.5, 0.5] and r["ptr"] == [3] * 6 + [4] * 6 + [5] * 6
    assert r["none"] is None and r["zero"] is None


def test_string_codes(spark):
    r = one(spark, e=A.encoded_string(F.lit("hé"), 5), d=A.decoded_string(A.encoded_string(F.lit("hé"), 5)))
    assert r == {"e": [104, 195, 169, 0, 0], "d": "hé"}


def test_geometry(spark):
    r = one(spark, big=S.resize_size(F.lit(1280), F.lit(720), 288, 512), small=S.resize_size(F.lit(300), F.lit(200), 288, 512), ant=S.anticipation(F.lit(5.0), 1.0, 16.0), tiles=S.centred_tiles(F.lit(10.0), 3.0), back=S.backward_tiles(F.lit(5.0), 3.0, 2), width=S.spectrogram_width(F.lit(22050), F.lit(1), F.lit(588)))
    assert r["big"] == {"w": 512, "h": 288} and r["small"] == {"w": 300, "h": 200} and r["ant"] == {"start": 0.0, "end": 4.0}
    assert [t["start"] for t in r["tiles"]] == [0.5, 3.5, 6.5] and [t["start"] for t in r["back"]] == [0.0, 2.0] and r["width"] == 188


def test_windows_of():
    got = S.windows_of([0.5 * k for k in range(1, 61)], 31)
    assert [(g[3], g[5]) for g in got] == [(1, 9), (1, 10), (1, 10), (1, 10), (1, 10), (1, 10)]
    got = S.windows_of([float(k) for k in range(1, 61, 2)], 61)
    assert [(g[3], g[5]) for g in got] == [(3, 7), (3, 8), (3, 7), (3, 8)]
    assert S.windows_of([], 50) == [] and S.windows_of([1.0], 3) == []


def test_adaptive_windows_stream_like_lists(spark):
    rows = [(k, float((i * 37) % 90) / 2, 60.0) for k in ("a", "b", None) for i in range(70)]
    df = spark.createDataFrame(rows, "v string, center double, duration double")
    got = S.adaptive_windows(df, "v").orderBy("v", "seg_idx").collect()
    want = S.windows_of([r[1] for r in rows if r[0] == "a"], 60.0)
    assert [tuple(r)[1:] for r in got if r.v == "a"] == want and {r.v for r in got} == {"a", "b"}
    assert S.adaptive_windows(df.limit(0), "v").count() == 0


def test_snapped_frame_rounds_to_even(spark):
    r = one(spark, a=S.snapped_frame(F.lit(0.5), F.lit(99)), b=S.snapped_frame(F.lit(1000.0), F.lit(99)), c=S.snapped_frame(F.lit(-3.0), F.lit(99)))
    assert r == {"a": 3, "b": 99, "c": 1}
