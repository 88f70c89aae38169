"""Segments of media time: assignment, nearest spans, tiles, adaptive windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def assign_to_intervals(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, closed: str = "left", width: float = 60.0, how: str = "inner") -> DataFrame:
    """Points joined with the intervals of their key that hold them: [start, end) or, with
    closed='right', (start, end]. Both sides are cut into buckets of the given width, so
    the join is by key and bucket and a key's points are spread; an interval is repeated
    once for each bucket it touches. how='left' keeps intervals without points."""
    a, b, t = F.col(start), F.col(end), F.col(time)
    iv = intervals.where(b > a).withColumn("_b", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    pt = points.withColumn("_b", F.floor(t / width))
    inside = (t >= a) & (t < b) if closed == "left" else (t > a) & (t <= b)
    hit = pt.join(iv, [key, "_b"]).where(inside).drop("_b")
    if how == "inner":
        return hit
    lone = intervals.join(hit.select(key, start, end).distinct(), [key, start, end], "left_anti")
    return hit.unionByName(lone, allowMissingColumns=True)


def nearest_span_monotone(words: DataFrame, spans: Column, key: str, pos: str = "pos", centroid: str = "centroid") -> DataFrame:
    """Each word with the place (from 0) of the nearest of its row's few span centroids, the
    first of equals, then made monotone by a running maximum over the key's words."""
    d = F.transform(spans, lambda s: F.abs(s - F.col(centroid)))
    near = words.withColumn("nearest", F.array_position(d, F.array_min(d)).cast("int") - 1)
    return running(near, [key], pos, F.col("nearest"), "assigned")


def snapped_frame(t: Column, last: Column, rate: int = 3) -> Column:
    """The frame (from 1) nearest to a time at the given rate, halves to even, clamped."""
    return F.greatest(F.least(F.rint(t * rate).cast("int") + 1, last), F.lit(1))


def fixed_tiles(duration: Column, width: float, most: int = 1_000_000) -> Column:
    """Tiles [k w, (k + 1) w) that end before the duration."""
    n = F.greatest(F.ceil(duration / width).cast("int") - 1, F.lit(0))
    return _tiles(F.lit(0.0), F.least(n, F.lit(most)), width)


def centred_tiles(duration: Column, width: float) -> Column:
    """As many whole tiles as fit, centred; the first start is rounded to 2 places."""
    n = F.floor(duration / width).cast("int")
    return _tiles(F.round((duration - n * width) / 2, 2), n, width)


def backward_tiles(end: Column, width: float, count: int) -> Column:
    """count tiles that end at end and go back from there, clamped at 0, in order of time."""
    k = F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1))
    return F.transform(k, lambda i: F.struct(F.greatest(end - (i + 1) * width, F.lit(0.0)).alias("start"), F.greatest(end - i * width, F.lit(0.0)).alias("end")))


def _tiles(first: Column, n: Column, width: float) -> Column:
    k = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(k, lambda i: F.struct((first + i * width).alias("start"), (first + (i + 1) * width).alias("end")))


def anticipation(start: Column, gap: float, observed: float) -> Column:
    """The interval that is seen before an action: [start - gap - observed, start - gap]."""
    return F.struct(F.greatest(start - gap - observed, F.lit(0.0)).alias("start"), F.greatest(start - gap, F.lit(0.0)).alias("end"))


def expanded_segments(centre: Column, count: int = 7, width: float = 5.0) -> Column:
    """count segments around a centre: the middle one, then one before, one after, and so
    on; sorted by start, those that begin before 0 left out."""
    k = [0] + [s * j for j in range(1, count) for s in (-1, 1)]
    all_ = F.array(*[F.struct((centre + (i - 0.5) * width).alias("start"), (centre + (i + 0.5) * width).alias("end")) for i in k[:count]])
    return F.array_sort(F.filter(all_, lambda s: s["start"] >= 0))


#: Adaptive windows: base width, words that suffice, words that the next step must promise.
BASE, ENOUGH, PROMISE = 5.0, 8, 16
WINDOWS = ("seg_idx int", "start_time double", "end_time double", "playback_speed int", "first_word int", "n_words int")


#: Chance of a break at a speed that would go on, where chance is asked for.
BREAK = 0.1


def chance(seed: int, *parts: object) -> float:
    """rand.uniform of the same seed and values, for a worker."""
    return int(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16) / (1 << 48)


class WindowBuilder:
    """The adaptive windows of one video, from its words' centers in order. A window grows
    to two or three times its base while it has too few words, unless the video ends or
    the next step already promises enough, or, with a seed, by chance. Only words that no
    window has taken are kept."""

    def __init__(self, duration: float, start: float = 0.0, seed: int | None = None, key: object = ""):
        self.limit, self.start, self.seed, self.key = duration - 1, start, seed, key
        self.waiting, self.at = np.zeros(0), 0
        self.taken = self.made = 0

    def feed(self, centers: np.ndarray) -> Iterator[tuple]:
        self.waiting, self.at = np.concatenate([self.waiting[self.at :], centers]), 0
        while self.at < len(self.waiting) and self.waiting[-1] >= self.start + 4 * BASE and self.start + BASE <= self.limit:
            yield self._window()

    def finish(self) -> Iterator[tuple]:
        while self.at < len(self.waiting) and self.start + BASE <= self.limit:
            yield self._window()

    def _window(self) -> tuple:
        before = lambda t: int(np.searchsorted(self.waiting[self.at :], t))
        for speed in (1, 2, 3):
            end = self.start + BASE * speed
            n = before(end)
            if n >= ENOUGH or end + BASE > self.limit or before(end + BASE) >= PROMISE:
                break
            if self.seed is not None and chance(self.seed, self.key, self.made, speed) > 1 - BREAK:
                break
        end = round(end, 2)
        out = (self.made, self.start, end, speed, self.taken, n)
        self.at += n
        self.start, self.taken, self.made = end, self.taken + n, self.made + 1
        return out


def windows_of(centers: list[float], duration: float, start: float = 0.0) -> list[tuple]:
    """(seg_idx, start, end, speed, first word, words) of one video's windows."""
    b = WindowBuilder(duration, start)
    return [*b.feed(np.sort(np.array(centers, float))), *b.finish()]


def adaptive_windows(words: DataFrame, key: str, center: str = "center", duration: str = "duration", start: str | None = None, seed: int | None = None) -> DataFrame:
    """The adaptive windows of each video. The first begins where its first word does (the
    column `start`; its center where there is none), at 0 at least, rounded to hundredths;
    with a seed up to half a base earlier, by a hash of the key, and windows may break by
    chance. Each depends on the one before it, so a video's words pass one worker in order of
    their centers; they stream through it, sorted by the shuffle, a batch's words of a video
    at a time, and no video is held as a whole. Rows with a null in one of the columns are
    left out."""
    kind = words.schema[key].dataType.simpleString()
    begin = start or center
    rows = words.where(F.col(center).isNotNull() & F.col(key).isNotNull() & F.col(duration).isNotNull() & F.col(begin).isNotNull())
    rows = rows.select(key, F.col(center).cast("double").alias("_c"), F.col(duration).cast("double").alias("_d"), F.col(begin).cast("double").alias("_s")).repartition(key).sortWithinPartitions(key, "_c")
    names = [key, *(w.split()[0] for w in WINDOWS)]

    def first(k: object, s: float) -> float:
        return round(max(s - (0.5 * BASE * chance(seed, k) if seed is not None else 0.0), 0.0), 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, b = None, None
        for pdf in batches:
            out: list[tuple] = []
            keys, centers = pdf[key].to_numpy(), pdf["_c"].to_numpy()
            edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for i, j in zip([0, *edges], [*edges, len(keys)]):
                if i == j:
                    continue
                k = keys[i]
                if b is None or k != now:
                    out += [(now, *w) for w in b.finish()] if b else []
                    now, b = k, WindowBuilder(float(pdf["_d"].iloc[i]), first(k, float(pdf["_s"].iloc[i])), seed, k)
                out += [(k, *w) for w in b.feed(centers[i:j])]
            yield pd.DataFrame(out, columns=names)
        if b:
            yield pd.DataFrame([(now, *w) for w in b.finish()], columns=names)

    return rows.mapInPandas(run, f"`{key}` {kind}, " + ", ".join(WINDOWS))


def resize_size(w: Column, h: Column, shorter: int, longer: int) -> Column:
    """Width and height with the shorter side at its target, or at what the longer side's limit
    leaves for it, rounded with halves to even; the other side is cut off to whole pixels. A
    picture whose shorter side is at most its target stays as it is."""
    lo, hi = F.least(w, h), F.greatest(w, h)
    size = F.when(hi / lo * shorter > longer, F.rint(F.lit(float(longer)) * lo / hi)).otherwise(F.lit(float(shorter))).cast("int")
    same = (lo <= shorter) | (lo == size)
    other = (size * hi / lo).cast("int")
    return F.struct(F.when(same, w).when(w < h, size).otherwise(other).cast("int").alias("w"), F.when(same, h).when(w < h, other).otherwise(size).cast("int").alias("h"))


def contained_size(w: Column, h: Column, tw: int, th: int) -> Column:
    """The largest size of the same shape inside a target, and the padding around it."""
    f = F.least(F.lit(float(tw)) / w, F.lit(float(th)) / h)
    nw, nh = F.floor(w * f + 1e-9).cast("int"), F.floor(h * f + 1e-9).cast("int")
    return F.struct(nw.alias("w"), nh.alias("h"), F.floor((F.lit(tw) - nw) / 2).cast("int").alias("pad_left"), F.floor((F.lit(th) - nh) / 2).cast("int").alias("pad_top"))


def spectrogram_width(rate: Column, speed: Column, hop: Column, seconds: float = 5.0) -> Column:
    return F.floor(rate * seconds * speed / hop).cast("int") + 1


def audio_starts(u: Column, n: int, length: int, total: int) -> Column:
    """Starts of n audio parts of one length inside total places: the free places are
    dealt out by the running share of n + 1 uniform numbers."""
    s = F.aggregate(u, F.lit(0.0), lambda a, x: a + x)
    run = lambda i: F.aggregate(F.slice(u, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor((total - n * length) * run(i) / s) + i * length).cast("int"))


def audio_bounds(starts: Column, length: int, hop: float, window: float) -> Column:
    """Start and end time of each audio part from its first frame: frames are hop seconds
    apart and look at window seconds around them."""
    return F.transform(starts, lambda s: F.struct((s * hop - window / 2).alias("start"), (s * hop - window / 2 + length * hop + window).alias("end")))


def centred_coordinates(n: Column) -> Column:
    """Coordinates of n places around an origin that none has: -n/2 .. -1, 1 .. n/2, one more
    after it where n is odd."""
    half = F.floor(n / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.when(i < half, i - half).otherwise(i - half + 1).cast("double"))


def plain_coordinates(n: Column) -> Column:
    """1 .. n."""
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("double"))


def grid_coordinates(h: Column, w: Column) -> Column:
    """struct(h, w) of each cell of a grid, row by row: centred, in units of the longer side."""
    scale = F.lit(1.0) / (F.greatest(h, w) + 1.0)
    return F.flatten(F.transform(centred_coordinates(h), lambda y: F.transform(centred_coordinates(w), lambda x: F.struct((y * scale).alias("h"), (x * scale).alias("w")))))


def joint_coordinates(h: Column | None = None, w: Column | None = None, segment: Column | None = None, token: Column | None = None, most_segments: float = 16.0, most_tokens: float = 1024.0) -> Column:
    """The four coordinates of a place in a joint sequence; those not given are 0."""
    zero = F.lit(0.0)
    return F.array(h if h is not None else zero, w if w is not None else zero, segment / most_segments if segment is not None else zero, token / most_tokens if token is not None else zero).cast("array<double>")


def window_stats(windows: DataFrame, key: str, n_words: str = "n_words") -> DataFrame:
    """(key, windows, mean, most, std): words a window of each video; the deviation is that of
    all windows."""
    return windows.groupBy(key).agg(F.count("*").alias("windows"), F.avg(n_words).alias("mean"), F.max(n_words).alias("most"), F.stddev_pop(n_words).alias("std"))


def too_short(duration: Column, least: float = 5.0) -> Column:
    """Whether a video without its last second has less than one window."""
    return F.coalesce(duration - 1 < least, F.lit(True))


def normalised_wave(samples: Column, n: Column) -> Column:
    """Samples over their greatest size (1 at least), with zeros at the end up to n; longer ones
    stay whole."""
    peak = F.greatest(F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0)), F.lit(1.0))
    return F.concat(F.transform(samples, lambda x: (x / peak).cast("double")), F.array_repeat(F.lit(0.0), F.greatest(n - F.size(samples), F.lit(0)).cast("int")))


def padded_frames(frames: Column, times: Column, subs: Column, n: int) -> Column:
    """struct(frames, times, subs) of n entries at least: the last frame again, time -1, and
    empty subtitles."""
    more = F.greatest(F.lit(n) - F.size(frames), F.lit(0))
    return F.struct(F.concat(frames, F.array_repeat(F.element_at(frames, -1), more)).alias("frames"), F.concat(times, F.array_repeat(F.lit(-1.0), more)).alias("times"), F.concat(subs, F.array_repeat(F.lit(""), more)).alias("subs"))


def of_size(a: Column, n: int) -> Column:
    """The array, failing where it has another size than n."""
    return F.when(F.assert_true(F.size(a) == n, F.lit(f"array of a size other than {n}")).isNull(), a)


def learning_rate(step: Column, peak: float, warmup: int, total: int, kind: str = "cosine", final: float = 0.02) -> Column:
    """Linear warm-up, then a cosine (down to final times the peak) or linear (to 0) fall over
    one step more than are left, so that the last step is not yet at its end."""
    up = step / warmup
    part = F.least(F.greatest((step - warmup) / (total - warmup + 1.0), F.lit(0.0)), F.lit(1.0))
    down = final + (1 - final) * 0.5 * (1 + F.cos(F.pi() * part)) if kind == "cosine" else 1 - part
    return peak * F.when(step < warmup, up).otherwise(down)
