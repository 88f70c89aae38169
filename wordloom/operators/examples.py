"""Training examples of packed records: three views of one record's spans, and random text.

A record's segments each give PARTS spans, those of their audio parts, which are placed by
hash: a token goes to the part whose centre is nearest, monotone in order. Two disjoint sets of
target spans are drawn by hash. All of it is array work on one row a record; the only shuffle
brings a record's segments together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import AUDIOSPAN, END, LTOVPOOL, START, fit_pointers, fit_tokens, let, pointer
from ..rand import uniform
from .masking import AUDIO_TOKENS, drawn_lengths, grown_spans, masked_spans, masked_texts, pseudo_spans, reassign_empty, span_budget, truncated, valid_token
from .sampling import gumbel
from .segments import audio_bounds, audio_starts

#: Audio parts of a segment, and the target spans of each of the two views.
PARTS, TARGETS = 3, 12
#: Frames of a part and of a segment; seconds between frames and around each.
FRAMES, SPACE, HOP, SIGHT = 60, 188, 588 / 22050, 1536 / 22050
#: Chance that a neighbour of a target is text; tokens of a target text; segments with random text.
AS_TEXT, SPAN_LENGTH, RANDOM_TEXTS = 0.8, 15, 4


def utf8_ids(c: Column) -> Column:
    """A stand-in for an encoder: a text's UTF-8 codes."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(c, "UTF-8")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.when(F.length(c) > 0, codes).otherwise(F.array().cast("array<int>"))


def nearest_parts(centres: Column, parts: Column) -> Column:
    """The part (from 0) with the nearest centre for each token, the first of equals, then a
    running maximum. Tokens without a time go to the part of the token before them."""

    def one(c: Column) -> Column:
        d = F.transform(parts, lambda p: F.abs(p - c))
        return F.coalesce(F.array_position(d, F.array_min(d)).cast("int") - 1, F.lit(0))

    def running(raw: Column) -> Column:
        zero = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(raw, zero, lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.concat(a["out"], F.array(F.greatest(a["top"], x))).alias("out")))["out"]

    return let(F.transform(centres, one), running)


def by_part(values: Column, part: Column, parts: int = PARTS) -> Column:
    """The values of each part, in order."""
    of = lambda k: F.filter(values, lambda v, i: F.get(part, i) == k)
    return F.array(*[of(k) for k in range(parts)])


def drawn(seed: int, key: Column, n: int, first: int, count: int) -> Column:
    """n booleans: the places whose hashed order is among first .. first + count - 1."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(uniform(seed, key, k).alias("u"), k.alias("k"))))
    chosen = F.transform(F.slice(order, first + 1, count), lambda x: x["k"])
    return let(chosen, lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.array_contains(c, k)))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*[p.cast("array<int>") for p in parts])


def _plain(tokens: Column, audio: Column) -> Column:
    return F.transform(tokens, lambda t: pointer(t, audio, F.lit(-1)))


def random_view(text: Column, counter: int, length: int, seq_len: int, seed: int, valid: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
    """(lengths, masked, view) of a random text in the columns record_id and random_text: pseudo
    spans, of which a budget is masked, those of valid tokens five times as likely, and the
    tokens around them, half on each side, up to the length."""
    budget = span_budget(length)
    lens = drawn_lengths(text, length, budget, seed + 3, "record_id")
    inside = F.aggregate(F.col("_lens"), F.lit(0), lambda a, b: a + b)
    offset = F.floor(uniform(seed + 4, "record_id") * F.greatest(F.size(text) - inside, F.lit(1))).cast("int")
    cut = pseudo_spans(text, F.col("_lens"), offset)
    weight = lambda s: F.when(F.exists(s, lambda t: ~valid(t)), 0.2).otherwise(1.0)
    scored = F.transform(F.col("_cut.spans"), lambda s, i: F.struct((-gumbel(weight(s), uniform(seed + 5, "record_id", i))).alias("g"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(scored), 1, budget), lambda x: x["i"])
    return lens, cut, let(chosen, lambda c: F.transform(F.col("_cut.spans"), lambda s, i: F.array_contains(c, i)))


def build_examples(segments: DataFrame, seq_len: int = 640, seed: int = 13, size: int = 16, encode: Callable[[Column], Column] = utf8_ids, valid: Callable[[Column], Column] = valid_token, delta: float = 0.125, lang_len: int | None = None, audio_share: float = 1.0) -> DataFrame:
    """(record_id, text_to_audio, audio_to_text, matching, random_text, targets): pointer
    triples of each view, cut or padded to seq_len (the first two to lang_len, where that is
    given), and the token arrays of the target spans, cut or padded to SPAN_LENGTH: those of
    the first view, of the second, and of the random text without tokens that aren't valid.

    Segments are deduplicated by (record_id, seg_idx); records of fewer than `size` segments
    have empty spans for the others. encode gives the token ids of the header's words and of
    descriptions, valid whether a token counts among valid ones.
    """
    lang_len = lang_len or seq_len
    cols = ["tok_ids", "tok_start_times", "tok_end_times", "title", "tags", "description", "random_text", "start_time", "end_time"]
    one = segments.groupBy("record_id", "seg_idx").agg(F.max_by(F.struct(*cols), "arrived_at").alias("x"))
    none = F.array().cast("array<int>")
    draws = F.array(*[uniform(seed + 1, "record_id", "seg_idx", F.lit(k)) for k in range(PARTS + 1)])
    one = one.withColumn("bounds", audio_bounds(audio_starts(draws, PARTS, FRAMES, SPACE), FRAMES, HOP, SIGHT))
    one = one.withColumn("tok", F.coalesce("x.tok_ids", none)).withColumn("centre", F.transform("tok", lambda t, i: (F.get(F.col("x.tok_start_times"), i) + F.get(F.col("x.tok_end_times"), i)).cast("double") / 2))
    one = one.withColumn("part", nearest_parts(F.col("centre"), F.transform("bounds", lambda b: (b["start"] + b["end"]) / 2)))
    long = F.coalesce(F.greatest(F.col("x.end_time") - F.col("x.start_time"), F.lit(0.0)), F.lit(0.0))
    entry = F.struct("seg_idx", "tok", by_part(F.col("tok"), F.col("part")).alias("spans"), F.flatten(by_part(F.col("centre"), F.col("part"))).alias("centres"), "bounds", long.alias("long"), *[F.col(f"x.{c}").alias(c) for c in ("title", "tags", "description", "random_text")])
    rec = one.groupBy("record_id").agg(F.array_sort(F.collect_list(entry)).alias("l"))  # `size` at most
    n = size * PARTS
    # Times of later segments begin where those before end.
    offset = lambda i: F.aggregate(F.slice(F.col("l"), F.lit(1), i), F.lit(0.0), lambda a, s: a + s["long"])
    rec = rec.withColumn("at", F.transform("l", lambda s, i: offset(i)))
    blank = F.array_repeat(none, n)
    shifted = lambda f: F.flatten(F.transform("l", lambda s, i: F.transform(f(s), lambda x: x + F.get(F.col("at"), i))))
    rec = rec.select(
        "record_id", "l", F.slice(F.concat(F.flatten(F.transform("l", lambda s: s["spans"])), blank), 1, n).alias("spans"), shifted(lambda s: s["centres"]).alias("centres"),
        shifted(lambda s: F.transform(s["bounds"], lambda b: b["start"])).alias("starts"), shifted(lambda s: F.transform(s["bounds"], lambda b: b["end"])).alias("ends"),
        drawn(seed, F.col("record_id"), n, 0, TARGETS).alias("a"), drawn(seed, F.col("record_id"), n, TARGETS, TARGETS).alias("b"),
    )
    right = uniform(seed + 2, "record_id") < 0.5
    rec = rec.withColumn("filled", F.when(right, reassign_empty(F.col("spans"), F.col("a"))).otherwise(reassign_empty(F.col("spans"), F.col("a"), True)))
    rec = rec.withColumn("spans_a", grown_spans(F.col("filled"), F.col("centres"), F.col("a"), F.col("starts"), F.col("ends"), uniform(seed + 6, "record_id") < 0.5, delta))
    near = lambda i: F.coalesce(F.get(F.col("b"), i - 1), F.lit(False)) | F.coalesce(F.get(F.col("b"), i + 1), F.lit(False))
    rec = rec.withColumn("heard", F.transform("b", lambda x, i: ~x & ~(near(i) & (uniform(seed + 7, "record_id", i) < AS_TEXT))))
    # Matching: the header, then each segment's pool token and its sound (or its words).
    heard = lambda s: F.flatten(F.array(*[F.array_repeat(pointer(F.lit(AUDIOSPAN), s["seg_idx"] * PARTS + j, F.lit(-1)), AUDIO_TOKENS) for j in range(PARTS)]))
    sound = uniform(seed + 8, "record_id") < audio_share
    body = F.flatten(F.transform("l", lambda s: F.concat(F.array(pointer(F.lit(LTOVPOOL), s["seg_idx"] * PARTS, F.lit(-1))), F.when(sound, heard(s)).otherwise(_plain(s["tok"], s["seg_idx"] * PARTS)))))
    words = {w: F.concat(F.array(F.lit(START)), encode(F.lit(w))) for w in ("title:", "description:", "tags:")}
    first = F.get(F.col("l"), F.lit(0))
    head = _joined([words["title:"], F.coalesce(first["title"], none), words["description:"], encode(F.coalesce(first["description"], F.lit(""))), words["tags:"], F.coalesce(first["tags"], none), F.array(F.lit(END))])
    matching = let(body, lambda b: F.concat(_plain(F.slice(head, F.lit(1), F.greatest(F.lit(seq_len) - F.size(b), F.lit(0))), F.lit(-1)), b))
    # Random text: that of one of the first segments, without its padding.
    texts = F.filter(F.transform(F.slice("l", 1, RANDOM_TEXTS), lambda s: F.filter(F.coalesce(s["random_text"], none), lambda t: t != 0)), lambda t: F.size(t) > 0)
    rec = rec.withColumn("_texts", texts).withColumn("_text", F.coalesce(F.get("_texts", F.floor(uniform(seed + 9, "record_id") * F.size("_texts")).cast("int")), none))
    counter = 2 * TARGETS
    lens, cut, chosen = random_view(F.col("_text"), counter, seq_len, seq_len, seed, valid)
    rec = rec.withColumn("_lens", lens).withColumn("_cut", cut).withColumn("_masked", chosen)
    rec = rec.withColumn("_in", masked_spans(F.col("_cut.spans"), F.col("_masked"), None, False, counter))
    room = F.greatest(F.lit(seq_len) - F.size("_in"), F.lit(0))
    before = F.least(F.size("_cut.before"), F.floor(room / 2).cast("int"))
    after = F.least(F.size("_cut.after"), F.floor((room + 1) / 2).cast("int"))
    last = F.coalesce(F.get(F.col("_in"), F.size("_in") - 1)["audio_ptr"], F.lit(-1))
    around = F.concat(_plain(F.slice(F.col("_cut.before"), F.size("_cut.before") - before + 1, before), F.lit(0)), F.col("_in"), _plain(F.slice(F.col("_cut.after"), F.lit(1), after), last + 1))
    fit = lambda t, m: fit_pointers(truncated(t, m), m)
    targets = F.concat(masked_texts(F.col("spans_a"), F.col("a")), masked_texts(F.col("spans"), F.col("b")), F.transform(masked_texts(F.col("_cut.spans"), F.col("_masked")), lambda s: F.filter(s, valid)))
    return rec.select(
        "record_id", fit(masked_spans(F.col("spans_a"), F.col("a"), None, True, 0), lang_len).alias("text_to_audio"),
        fit(masked_spans(F.col("spans"), F.col("b"), F.col("heard"), False, TARGETS), lang_len).alias("audio_to_text"),
        fit_pointers(matching, seq_len).alias("matching"), fit_pointers(around, seq_len).alias("random_text"), F.transform(targets, lambda s: fit_tokens(s, SPAN_LENGTH)).alias("targets"),
    )
