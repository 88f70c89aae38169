"""Operators on words with times: features, gates, density, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import let
from .running import neighbours


def split_words(text: Column) -> Column:
    """A text's words by white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def words_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word): a text's words by white space, counted from 0."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("pos", "word"))


def word_features(words: DataFrame, key: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """Each word's length, first-letter case, vowels and marks (and extra features), with
    those of its neighbours; beyond the ends 1 for the length, 0.1 for chunklen, else 0."""
    feats = {"charlen": F.length("word"), "is_upper": T.is_upper(F.substring("word", 1, 1)).cast("int"), "num_vowels": T.vowels(F.col("word")), "num_punct": T.marks(F.col("word")), **(extra or {})}
    default = {"charlen": 1.0, "chunklen": 0.1}
    w = Window.partitionBy(key).orderBy("pos")
    out = words.select(key, "pos", "word", *[c.cast("double").alias(f"feat_{n}") for n, c in feats.items()])
    for n in feats:
        d = default.get(n, 0.0)
        out = out.withColumn(f"feat_{n}_left", F.lag(f"feat_{n}", 1, d).over(w)).withColumn(f"feat_{n}_right", F.lead(f"feat_{n}", 1, d).over(w))
    return out


def token_quality(words: DataFrame, key: str, least_good: float = 0.6, most_variance: float = 10.0) -> DataFrame:
    """(key, n_words, frac_good, len_var, dropped). A word of several capitals is no good
    one; the variance of one word counts as 0."""
    good = ~((F.length("word") > 1) & T.is_upper(F.col("word")))
    out = words.groupBy(key).agg(F.count("*").alias("n_words"), F.avg(good.cast("int")).alias("frac_good"), F.coalesce(F.var_samp(F.length("word")), F.lit(0.0)).alias("len_var"))
    return out.withColumn("dropped", (F.col("frac_good") < least_good) | (F.col("len_var") > most_variance))


def clean_subtitles(words: DataFrame, word: str = "word", store_repaired: bool = False) -> DataFrame:
    """Without words that begin with '&', end with ';' or are empty after the repair of broken
    encodings and the removal of control characters. Words stay as they are, or, with
    store_repaired, as repaired; other columns stay. Null words are left out."""
    c = F.col(word)
    fixed = F.regexp_replace(T.repaired_text(c), r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{feff}]", "")
    kept = words.where(~c.startswith("&") & ~c.endswith(";") & (fixed != ""))
    return kept.withColumn(word, fixed) if store_repaired else kept


def row_features(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    """(keep..., pos, word, features): what word_features gives, from an array of words in each
    row: features and those of both neighbours are laid side by side before words are brought
    apart, so nothing is shuffled."""
    one = {"charlen": F.length, "is_upper": lambda w: T.is_upper(F.substring(w, 1, 1)).cast("int"), "num_vowels": T.vowels, "num_punct": T.marks}
    default = F.struct(*[F.lit(1.0 if n == "charlen" else 0.0).alias(n) for n in one])
    rows = df.select(*keep, words.alias("_w")).withColumn("_f", F.transform("_w", lambda w: F.struct(*[f(w).cast("double").alias(n) for n, f in one.items()])))
    n = F.size("_f")
    left = F.concat(F.array(default), F.slice("_f", F.lit(1), F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.slice("_f", F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(default))
    rows = rows.where("size(_w) > 0").select(*keep, F.posexplode(F.arrays_zip("_w", "_f", left.alias("_l"), right.alias("_r"))).alias("pos", "x"))
    part = lambda name, field: F.col("x")[name][field]
    return rows.select(*keep, "pos", F.col("x._w").alias("word"), *[c for k in one for c in (part("_f", k).alias(f"feat_{k}"), part("_l", k).alias(f"feat_{k}_left"), part("_r", k).alias(f"feat_{k}_right"))])


def row_quality(words: Column) -> Column:
    """token_quality of an array of words: struct(n_words, frac_good, len_var); null for none."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        good = F.size(F.filter(ws, lambda w: ~((F.length(w) > 1) & T.is_upper(w))))
        total = F.aggregate(ws, F.lit(0.0), lambda s, w: s + F.length(w))
        spread = let(total / n, lambda m: F.aggregate(ws, F.lit(0.0), lambda s, w: s + (F.length(w) - m) * (F.length(w) - m)))
        return F.when(n > 0, F.struct(n.cast("bigint").alias("n_words"), (good / n).alias("frac_good"), F.when(n > 1, spread / (n - 1)).otherwise(0.0).alias("len_var")))

    return let(words, of)


def density_bins(words: DataFrame, key: str, time: Column, width: float) -> DataFrame:
    """(key, bin, n): words in bins of the given width from time 0 to the last word's bin,
    empty bins as 0."""
    rows = words.where(time.isNotNull() & (time >= 0)).select(key, F.floor(time / width).cast("bigint").alias("bin"))
    count = rows.groupBy(key, "bin").agg(F.count("*").alias("n"))
    last = count.groupBy(key).agg(F.max("bin").alias("last"))
    every = last.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("bin"))
    return every.join(count, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def smoothed_bounds(words: DataFrame, key: str, start: str = "start", end: str = "end", start_off: str = "start_off", end_off: str = "end_off", most: float = 0.5, order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Start, end and center moved by offsets that are made consistent: a boundary between
    two words moves by the mean of both sides' offsets, the outer ones by their own, all
    clipped. Words are in the given order (`pos`); `bucket` never falls in it and parts a
    long video's words."""
    order = order or ["pos"]
    near = neighbours(words, [key], order, bucket if bucket is not None else F.floor(F.col(order[0]) / 10_000), [start_off, end_off])
    clip = lambda c: F.greatest(F.least(c, F.lit(most)), F.lit(-most))
    left = clip(F.coalesce((F.col(start_off) + F.col(f"prev_{end_off}")) / 2, F.col(start_off)))
    right = clip(F.coalesce((F.col(f"next_{start_off}") + F.col(end_off)) / 2, F.col(end_off)))
    out = near.withColumn("d_start", left).withColumn("d_end", right)
    out = out.withColumn("new_start", F.col(start) + F.col("d_start")).withColumn("new_end", F.col(end) + F.col("d_end"))
    return out.withColumn("center", (F.col("new_start") + F.col("new_end")) / 2).select(*words.columns, "d_start", "d_end", "new_start", "new_end", "center")


def per_token(words: Column, tokens: Column) -> Column:
    """What belongs to each word (an array of any kind), once for each token of the word."""
    return F.flatten(F.zip_with(words, tokens, lambda w, t: F.array_repeat(w, F.coalesce(F.size(t), F.lit(0)))))


def local_times(t: Column, start: Column, speed: Column) -> Column:
    """Times of an array, from the segment's start and divided by its speed."""
    return F.transform(t, lambda x: (x - start) / speed)
