"""Array functions: padding, batching, membership, pointers, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, START, END, MASK, MASKAUDIO, AUDIOSPAN, LTOVPOOL, RESETCTX = 0, 1, 2, 3, 4, 5, 6, 9
POINTER = "struct<tok:int,audio_ptr:int,text_ptr:int>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it: a lambda's
    variable is evaluated, a repeated expression may be evaluated again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fit(a: Column, n: int | Column, pad: Column) -> Column:
    """The array cut or padded at its end to n elements; null stays null."""
    n = F.lit(n) if isinstance(n, int) else n
    return let(a, lambda x: F.slice(F.concat(x, F.array_repeat(pad, F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n))


def fit_tokens(a: Column, n: int) -> Column:
    return fit(a.cast("array<int>"), n, F.lit(PAD))


def pointer(tok: Column, audio: Column, text: Column) -> Column:
    return F.struct(tok.cast("int").alias("tok"), audio.cast("int").alias("audio_ptr"), text.cast("int").alias("text_ptr"))


def fit_pointers(a: Column, n: int) -> Column:
    """Pointer triples cut or padded with (0, -1, -1)."""
    return fit(a.cast(f"array<{POINTER}>"), n, pointer(F.lit(PAD), F.lit(-1), F.lit(-1)))


def one_hot(idx: Column, n: int) -> Column:
    """n booleans: whether each place is among the indices."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(idx, i.cast("int")))


def cumulative_max(a: Column) -> Column:
    """The running maximum of a short array; for long ones use a window over its rows."""
    return F.transform(a, lambda x, i: F.array_max(F.slice(a, F.lit(1), i + 1)))


def run_lengths_to_spans(flat: Column, lengths: Column) -> Column:
    """A flat array cut into consecutive parts of the given lengths."""


    def cut(t: Column, ns: Column) -> Column:
        ends = lambda i: F.aggregate(F.slice(ns, F.lit(1), i), F.lit(0), lambda s, x: s + x)
        return F.transform(ns, lambda n, i: F.slice(t, ends(i) + 1, n))

    return let(flat, lambda t: let(lengths, lambda ns: cut(t, ns)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, eps: float = 1e-5) -> Column:
    """v over the root of its squared length plus eps, in doubles; nulls where that is 0."""
    return let(v.cast("array<double>"), lambda d: let(F.sqrt(dot(d, d) + eps), lambda n: F.transform(d, lambda x: F.try_divide(x, n))))


def cosine(a: Column, b: Column) -> Column:
    """Without a guard: null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def softmax(a: Column) -> Column:
    powers = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda n: F.transform(e, lambda x: x / n)))


def log_softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda n: F.transform(a, lambda x: x - n))


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.ln(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """The first place (from 0) of the greatest element."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def media_pointers(segment: Column, per_segment: int = 3, tokens: int = 18) -> Column:
    """Audio pointers of one segment's tokens: tokens spread evenly over its parts."""
    share = tokens // per_segment
    return F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda k: (segment * per_segment + F.floor(k / share)).cast("int"))


def encoded_string(s: Column, n: int) -> Column:
    """The UTF-8 bytes of a string as n integers, padded with zeros."""
    text = F.hex(F.encode(s, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.conv(F.substr(text, 2 * i - 1, F.lit(2)), 16, 10).try_cast("int"))
    return F.transform(codes, lambda x: F.coalesce(x, F.lit(0)))


def decoded_string(a: Column) -> Column:
    """The string of such integers; zeros are dropped."""
    return F.decode(F.unhex(F.array_join(F.transform(F.filter(a, lambda x: x != 0), lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")
