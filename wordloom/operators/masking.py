"""Masked-span examples: span masking, empty-span repair, pseudo spans, truncation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import AUDIOSPAN, END, MASK, MASKAUDIO, PAD, START, fit_pointers, fit_tokens, let, pointer, run_lengths_to_spans
from ..rand import uniform

# Fixed value: weights of span lengths 1..15 in text without audio.
SPAN_WEIGHTS = (0.03233136, 0.05236081, 0.08763368, 0.11757072, 0.13737426, 0.13717706, 0.12541218, 0.10262764, 0.0771088, 0.05364242, 0.0342899, 0.0203823, 0.01177542, 0.00664939, 0.00366406)
# Fixed value: token ids that never count as valid.
BAD_TOKENS = (149, 4858, 9504, 15162, 22312, 22433, 32156)
#: Bits of an id within its block of the vocabulary: 32768 ids, 4 KB.
BLOCK = 15
#: Blocks of the vocabulary up to which their bits are broadcast (32 MB); the rows are the same either way.
FEW_BLOCKS = 8192
#: Parts of a block's rows where blocks are not broadcast.
SALTS = 16
#: Tokens that stand for one audio span.
AUDIO_TOKENS = 6


def masked_spans(spans: Column, masked: Column, audio: Column | None = None, mask_audio: bool = False, counter: int = 0) -> Column:
    """Pointer triples of one row's spans (array of token arrays): a masked span becomes
    MASK (and MASKAUDIO), one that is heard becomes AUDIO_TOKENS times AUDIOSPAN, others
    keep their tokens; text pointers number the masked spans from counter on."""
    none = F.lit(-1)
    rank = lambda i: F.size(F.filter(F.slice(masked, F.lit(1), i + 1), lambda m: m)) - 1 + counter
    marks = [F.lit(MASK), F.lit(MASKAUDIO)] if mask_audio else [F.lit(MASK)]

    def one(s: Column, i: Column) -> Column:
        is_m = F.get(masked, i)
        heard = F.transform(F.array(*[F.lit(AUDIOSPAN)] * AUDIO_TOKENS), lambda t: pointer(t, i, none))
        own = F.transform(s, lambda t: pointer(t, i, none))
        out = F.when(is_m, F.transform(F.array(*marks), lambda t: pointer(t, i, rank(i))))
        if audio is not None:
            out = out.when(F.get(audio, i), heard)
        return out.otherwise(own)

    return F.flatten(F.transform(spans, one))


def masked_texts(spans: Column, masked: Column) -> Column:
    """The token arrays of the masked spans, in order."""
    return F.filter(spans, lambda s, i: F.get(masked, i))


def donate(lengths: Column, masked: Column, rightwards: bool) -> Column:
    """Lengths after each empty masked span took a token from an unmasked neighbour with
    two or more: from its right one, or (rightwards) from its left one."""
    step = -1 if rightwards else 1

    def move(ns: Column) -> Column:
        needs = lambda i: F.coalesce(F.get(masked, i) & (F.get(ns, i) == 0), F.lit(False))
        gives = lambda i: F.coalesce(~F.get(masked, i) & (F.get(ns, i) >= 2), F.lit(False))
        return F.transform(ns, lambda n, i: n + (needs(i) & gives(i + step)).cast("int") - (gives(i) & needs(i - step)).cast("int"))

    return let(lengths, move)


def reassign_empty(spans: Column, masked: Column, first_right: bool = False) -> Column:
    """Spans after both directions of donation; tokens keep their order."""
    lengths = F.transform(spans, lambda s: F.size(s))
    once = donate(lengths, masked, first_right)
    return run_lengths_to_spans(F.flatten(spans), donate(once, masked, not first_right))


def grow(lengths: Column, centres: Column, masked: Column, starts: Column, ends: Column, rightwards: bool, delta: float) -> Column:
    """Lengths after each masked span took one token from its right neighbour (or, leftwards,
    from its left one), where that isn't masked, has two tokens or more and its nearest one
    lies less than delta beyond the span's audio bound. centres are all tokens' in order."""
    step = 1 if rightwards else -1

    def move(ns: Column) -> Column:
        def by_span(cs: Column) -> Column:
            def takes(i: Column) -> Column:
                there = F.get(cs, i + step)
                gap = F.array_min(there) - F.get(ends, i) if rightwards else F.get(starts, i) - F.array_max(there)
                return F.coalesce(F.get(masked, i) & ~F.get(masked, i + step) & (F.get(ns, i + step) > 1) & (gap < delta), F.lit(False))

            return F.transform(ns, lambda n, i: n + takes(i).cast("int") - takes(i - step).cast("int"))

        return let(run_lengths_to_spans(centres, ns), by_span)

    return let(lengths, move)


def grown_spans(spans: Column, centres: Column, masked: Column, starts: Column, ends: Column, right_first: Column, delta: float = 0.1) -> Column:
    """Spans after both directions of growth, the right one first where right_first holds;
    tokens keep their order. centres are all tokens' centres in order."""
    lengths = F.transform(spans, lambda s: F.size(s))
    both = lambda first: grow(grow(lengths, centres, masked, starts, ends, first, delta), centres, masked, starts, ends, not first, delta)
    return run_lengths_to_spans(F.flatten(spans), F.when(right_first, both(True)).otherwise(both(False)))


def pointer_groups(pointers: Column, spans: int, groups: int, size: int | None = None) -> Column:
    """Pointer triples parted by span into groups of spans // groups spans each, cut or padded
    to size where it is given."""
    each = spans // groups
    part = lambda g: F.filter(pointers, lambda t: F.floor(t["audio_ptr"] / each) == g)
    return F.array(*[fit_pointers(truncated(part(g), size), size) if size else part(g) for g in range(groups)])


def grown_masks(df: DataFrame, keys: list[str], pos: str = "pos", delta: float = 0.1) -> DataFrame:
    """Rows (keys, pos, masked, n, lo, hi, audio_start, audio_end) of spans with the flags
    takes_right and takes_left: a masked span takes the first token of its right
    neighbour (the last of its left one), if that isn't masked, has two or more tokens
    and its nearest one lies within delta of the span's audio bound."""
    w = Window.partitionBy(*keys).orderBy(pos)
    nxt, prv = (lambda c: F.lead(c).over(w)), (lambda c: F.lag(c).over(w))
    right = F.col("masked") & ~nxt("masked") & (nxt("n") > 1) & (nxt("lo") - F.col("audio_end") < delta)
    left = F.col("masked") & ~prv("masked") & (prv("n") > 1) & (F.col("audio_start") - prv("hi") < delta)
    return df.withColumn("takes_right", F.coalesce(right, F.lit(False))).withColumn("takes_left", F.coalesce(left, F.lit(False)))


def neighbour_flags(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Whether a row's neighbour before or after it has the flag, and it has not."""
    w = Window.partitionBy(*keys).orderBy(pos)
    near = F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))
    return df.withColumn("next_to", near & ~F.col(flag))


def pseudo_lengths(u: Column, total: Column) -> Column:
    """Span lengths from uniform numbers by the inverse of SPAN_WEIGHTS' distribution, as
    many as fit into total."""
    whole = sum(SPAN_WEIGHTS)
    bounds, run = [], 0.0
    for x in SPAN_WEIGHTS[:-1]:
        run += x / whole
        bounds.append(run)

    def length(x: Column) -> Column:
        out = F.lit(1)
        for b in bounds:
            out = out + (x >= b).cast("int")
        return out

    lens = F.transform(u, length)
    upto = lambda i: F.aggregate(F.slice(lens, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x)
    return F.filter(lens, lambda x, i: upto(i) <= total)


def span_budget(desired: int, mask_rate: float = 0.25, mean_length: float = 5.5) -> int:
    """Masked spans of a text of the desired length: each gives one token for mean_length."""
    return int(desired / (mean_length / mask_rate - mean_length + 1.0))


def drawn_lengths(tokens: Column, desired: int, budget: int, seed: int, *keys: str) -> Column:
    """Span lengths by hash of the keys, as many as fit into what the desired length stands for
    before `budget` spans are masked, and into the tokens."""
    mean = sum(i * w for i, w in enumerate(SPAN_WEIGHTS)) + 1
    room = F.least(F.lit(desired + int((mean * 0.85 - 1) * budget)), F.size(tokens))
    whole, bounds, run = sum(SPAN_WEIGHTS), [], 0.0
    for x in SPAN_WEIGHTS[:-1]:
        run += x / whole
        bounds.append(run)

    def length(i: Column) -> Column:
        return let(uniform(seed, *keys, i), lambda u: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: u >= b)) + 1)

    def step(acc: Column, i: Column) -> Column:
        def with_length(n: Column) -> Column:
            # Beyond the room nothing is taken any more.
            fits = acc["total"] + n <= room
            return F.struct(F.when(fits, acc["total"] + n).otherwise(1 << 30).alias("total"), F.when(fits, F.concat(acc["lens"], F.array(n))).otherwise(acc["lens"]).alias("lens"))

        return F.when(acc["total"] >= room, acc).otherwise(let(length(i), with_length))

    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("lens"))
    return F.when(room > 0, F.aggregate(F.sequence(F.lit(0), room - 1), zero, step)["lens"]).otherwise(F.array().cast("array<int>"))


def pseudo_spans(tokens: Column, lengths: Column, offset: Column) -> Column:
    """struct(spans, before, after): tokens from offset on cut by the lengths, and the rest
    on both sides."""
    n = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    return F.struct(run_lengths_to_spans(F.slice(tokens, offset + 1, n), lengths).alias("spans"), F.slice(tokens, F.lit(1), offset).alias("before"), F.slice(tokens, offset + n + 1, F.lit(1 << 30)).alias("after"))


def truncated(tokens: Column, size: int, score: Column | None = None) -> Column:
    """Pointer triples cut to size from both ends without losing a mask: from the front at
    most what lies before the first mask or audio span, from the end at most what lies
    after the last mask. What is still too long keeps its masks, then the segments (audio
    pointers) of greatest score, in order."""
    return let(tokens, lambda t: _truncated(t, size, score))


def _truncated(tokens: Column, size: int, score: Column | None) -> Column:
    is_mask = lambda t: (t["tok"] == MASK) | (t["tok"] == MASKAUDIO)
    n = F.size(tokens)
    over = F.greatest(n - size, F.lit(0))
    first = F.coalesce(F.array_min(F.transform(tokens, lambda t, i: F.when(is_mask(t) | (t["tok"] == AUDIOSPAN), i))), n)
    last = F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(is_mask(t), i))), F.lit(-1))
    rhs = n - 1 - last
    front = F.least(F.floor(over / 2).cast("int"), first)
    back = F.least(over - front, rhs)
    front = F.least(over - back, first)
    cut = F.slice(tokens, front + 1, n - front - back)
    if score is None:
        return cut

    def sampled(c: Column) -> Column:
        want = F.transform(c, lambda t, i: F.struct((~is_mask(t)).cast("int").alias("a"), (-F.coalesce(F.get(score, t["audio_ptr"]), F.lit(0.0))).alias("b"), i.alias("i")))
        keep = F.transform(F.slice(F.array_sort(want), 1, size), lambda x: x["i"])
        return F.when(F.size(c) <= size, c).otherwise(let(keep, lambda k: F.filter(c, lambda t, i: F.array_contains(k, i))))

    return let(cut, sampled)


def valid_token(t: Column) -> Column:
    """Above the control tokens and not among the bad ones; what a token says is left to
    valid_tokens, which knows the vocabulary."""
    return (t > 10) & ~t.isin(*BAD_TOKENS)


def valid_ids(vocabulary: DataFrame) -> DataFrame:
    """(id): the valid ids of a vocabulary (id, text), each at least once: valid_token(), and the
    text has only letters, digits, blanks and apostrophes."""
    return vocabulary.where(valid_token(F.col("id")) & F.col("text").rlike(r"^[ A-Za-z0-9']*$")).select(F.col("id").cast("bigint").alias("id"))


def valid_blocks(vocabulary: DataFrame) -> DataFrame:
    """(block, bits): the valid ids that an int can hold as bits of 64-bit words, 2**BLOCK ids a
    row; blocks without a valid id have no row. That is 4 KB a row and 65536 rows at most."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = valid_ids(vocabulary).where(F.col("id") < 1 << 31).groupBy(F.shiftright("id", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    n = 1 << BLOCK - 6
    held = F.map_from_entries(F.collect_list(F.struct((F.col("w") % n).cast("int").alias("k"), "b")))  # n entries at most
    blocks = words.groupBy(F.shiftright("w", BLOCK - 6).alias("block")).agg(held.alias("m"))
    return blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("bigint"))).alias("bits"))


def valid_by_blocks(rows: DataFrame, keys: list[str], tokens: str, vocabulary: DataFrame, few: int = FEW_BLOCKS) -> DataFrame:
    """(keys, n, valid): how many tokens (array of int) each row has and which of them are valid, in
    order and as often as they stand there. The keys tell the rows apart, null ones too.

    For vocabularies of any size: each row's tokens are joined to the blocks they lie in. Up to
    `few` blocks are broadcast, so that a block that holds most tokens is spread as the rows are;
    more of them are sorted and merged, each once a salt of the rows, and skew handling splits a
    salt that is still too large. Ids that the vocabulary has not and null tokens are not valid;
    a null array gives null for both, an empty one 0 and an empty one.
    """
    blocks = valid_blocks(vocabulary)
    used = valid_ids(vocabulary).where(F.col("id") < 1 << 31).select(F.shiftright("id", BLOCK)).distinct().count()
    # A token and its place in one number, so that those of several blocks can be put in order.
    packed = F.transform(F.filter(tokens, valid_token), lambda t, i: F.shiftleft(i.cast("bigint"), 32) + t)
    token = lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF))
    block = lambda p: F.shiftright(token(p), BLOCK)
    parts = rows.select(*keys, F.when(F.col(tokens).isNotNull(), F.size(tokens)).alias("n"), packed.alias("_p"))
    parts = parts.select("*", F.explode_outer(F.array_distinct(F.transform("_p", block))).alias("block"))
    parts = parts.withColumn("_p", F.filter("_p", lambda p: block(p) == F.col("block")))
    word = lambda p: F.get("bits", F.shiftright(token(p), 6).bitwiseAND(F.lit((1 << BLOCK - 6) - 1)).cast("int"))
    known = lambda p: F.getbit(word(p), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    if used <= few:
        joined = parts.join(F.broadcast(blocks), "block", "left")
    else:
        salt = F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")
        salted = blocks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = parts.withColumn("_s", salt).join(salted.hint("merge"), ["block", "_s"], "left")
    found = joined.select(*keys, "n", F.filter("_p", known).alias("_p"))
    whole = F.transform(F.sort_array(F.flatten(F.collect_list("_p"))), lambda p: token(p).cast("int"))  # one row's tokens
    return found.groupBy(*keys, "n").agg(whole.alias("valid")).withColumn("valid", F.when(F.col("n").isNotNull(), F.col("valid")))


def valid_table(vocabulary: DataFrame, most: int = 1_000_000) -> np.ndarray:
    """Whether each id of a vocabulary (id, text) is valid, as valid_ids() says. A vocabulary of
    more than `most` ids is an error; valid_by_blocks() takes those."""
    good = valid_ids(vocabulary).distinct()
    ids = [r[0] for r in good.limit(most + 1).collect()]
    if len(ids) > most or max(ids, default=0) > most * 10:
        raise ValueError(f"a vocabulary of more than {most} ids")
    table = np.zeros(max(ids, default=0) + 1, bool)
    table[ids] = True
    return table


def valid_tokens(tokens: Column, table: np.ndarray) -> Column:
    """The valid tokens of an array, by a look-up of all tokens of a batch at once; ids that the
    vocabulary has not are not valid. A null array stays null."""

    @F.pandas_udf("array<int>")
    def keep(s: pd.Series) -> pd.Series:
        def one(a):
            if a is None:
                return None
            a = np.asarray(a)
            known = (a >= 0) & (a < len(table))
            return a[known & table[np.where(known, a, 0)]]

        return s.map(one)

    return keep(tokens)


def header(title: Column, description: Column, tags: Column, words: tuple[list[int], list[int], list[int]], size: int) -> Column:
    """START title-word title START description-word description START tags-word tags END,
    cut to size; a null part counts as empty."""
    none = F.array().cast("array<int>")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    parts = [x for name, c in zip(words, (title, description, tags)) for x in (lit([START, *name]), F.coalesce(c.cast("array<int>"), none))]
    return F.slice(F.concat(*parts, lit([END])), 1, size)


def qa_joint(query: Column, option: Column, size: int) -> Column:
    """Query and option, cut to size - 1, then MASK, then padding."""
    return fit_tokens(F.concat(F.slice(F.concat(query, option), 1, size - 1), F.array(F.lit(MASK))), size)


def qa_linear(query: Column, size: int) -> Column:
    """The query cut to size - 1, then MASK, then padding."""
    return fit_tokens(F.concat(F.slice(query, 1, size - 1), F.array(F.lit(MASK))), size)


def span_is_valid(span: Column, count: Column) -> Column:
    return F.exists(span, lambda t: t != PAD) & (count > 0)
