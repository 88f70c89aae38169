"""Queries on media time: density, assignment, tiles, windows, schedules, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import segments as S
from ..operators import words as W
from ..operators.running import neighbours, running
from ..rand import uniform, uniform_sql
from ..session import table


def _events(spark, d):
    """Events as words: video user_id, time in seconds from the video's first event."""
    e = table(spark, d, "events").where("ts is not null and user_id is not null").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    first = e.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return e.join(first, "user_id").select("event_id", "user_id", F.round(F.col("t") - F.col("t0"), 3).alias("sec"), F.round(F.col("t1") - F.col("t0"), 3).alias("duration"))


_E = """WITH e0 AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 t FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
e AS (SELECT event_id, user_id, round(t - min(t) OVER (PARTITION BY user_id), 3) sec, round(max(t) OVER (PARTITION BY user_id) - min(t) OVER (PARTITION BY user_id), 3) duration FROM e0)"""
DAY = 86400.0


def _days(spark, d):
    """Intervals of a day and a half from each video's second day on, to its end."""
    u = _events(spark, d).groupBy("user_id").agg(F.max("duration").alias("dur"))
    return u.select("user_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("dur") / (1.5 * DAY)).cast("int")))).alias("seg")).select("user_id", "seg", (F.col("seg") * 1.5 * DAY).alias("lo"), ((F.col("seg") + 1) * 1.5 * DAY).alias("hi"))


_D = _E + ", iv AS (SELECT user_id, CAST(s AS INT) seg, s * 1.5 * 86400.0 lo, (s + 1) * 1.5 * 86400.0 hi FROM (SELECT user_id, unnest(range(1, 1 + greatest(1, CAST(floor(max(duration) / (1.5 * 86400.0)) AS INT)))) s FROM e GROUP BY user_id))"


def word_density_bins(spark, d):
    return W.density_bins(_events(spark, d), "user_id", F.col("sec"), DAY)


def density_gate(spark, d):
    b = word_density_bins(spark, d).groupBy("user_id").agg(F.max("n").alias("most"))
    return b.withColumn("dropped", F.col("most") < 10)


def interval_assign_left(spark, d):
    return S.assign_to_intervals(_events(spark, d), _days(spark, d), "user_id", "sec", "lo", "hi", "left", DAY).select("event_id", "user_id", "seg")


def interval_assign_right(spark, d):
    r = S.assign_to_intervals(_events(spark, d), _days(spark, d), "user_id", "sec", "lo", "hi", "right", DAY, "left")
    return r.groupBy("user_id", "seg").agg(F.count("event_id").alias("n"))


def nearest_span_monotone(spark, d):
    """Three centroids for each video, at a quarter, half and three quarters of it."""
    e = _events(spark, d).withColumn("pos", F.col("event_id"))
    spans = F.array(*[F.col("duration") * q for q in (0.25, 0.5, 0.75)])
    r = S.nearest_span_monotone(e, spans, "user_id", "pos", "sec")
    return r.select("event_id", "nearest", "assigned")


def nearest_frame(spark, d):
    s = table(spark, d, "segment_k2f").where("start_time is not null and end_time is not null").select("record_id", "seg_idx", ((F.col("start_time") + F.col("end_time")) / 2).alias("mid")).distinct()
    return s.select("record_id", "seg_idx", "mid", S.snapped_frame(F.col("mid"), F.lit(900)).alias("frame"))


def _durations(spark, d):
    return _events(spark, d).groupBy("user_id").agg((F.round(F.max("duration") / 3600, 1)).alias("dur"))


_DU = _E + ", du AS (SELECT user_id, round(max(duration) / 3600, 1) dur FROM e GROUP BY 1)"


def _flat(rows, name="tiles"):
    return rows.select("user_id", F.posexplode(name).alias("k", "x")).select("user_id", "k", F.round("x.start", 3).alias("start"), F.round("x.end", 3).alias("end"))


def fixed_tiles(spark, d):
    return _flat(_durations(spark, d).withColumn("tiles", S.fixed_tiles(F.col("dur"), 24.0, 40)))


def centred_tiles(spark, d):
    return _flat(_durations(spark, d).withColumn("tiles", S.centred_tiles(F.col("dur"), 7.0)))


def backward_tiles(spark, d):
    return _flat(_durations(spark, d).withColumn("tiles", S.backward_tiles(F.col("dur"), 200.0, 6)))


def anticipation(spark, d):
    return _durations(spark, d).select("user_id", S.anticipation(F.col("dur") / 20, 1.0, 16.0).alias("x")).select("user_id", F.round("x.start", 4).alias("start"), F.round("x.end", 4).alias("end"))


def expanded_segments(spark, d):
    return _flat(_durations(spark, d).withColumn("tiles", S.expanded_segments(F.col("dur") / 50, 7, 5.0)))


def boundary_smoothing(spark, d):
    """Events as words that end where the next begins, offsets from the event id."""
    e = neighbours(_events(spark, d), ["user_id"], ["sec", "event_id"], F.floor(F.col("sec") / DAY), ["sec"])
    e = e.select("event_id", "user_id", F.col("sec").alias("start"), F.coalesce("next_sec", F.col("sec") + 1).alias("end"), (F.pmod("event_id", F.lit(7)) / 5 - 0.5).alias("start_off"), (F.pmod("event_id", F.lit(11)) / 8 - 0.6).alias("end_off"))
    r = W.smoothed_bounds(e, "user_id", order=["start", "event_id"], bucket=F.floor(F.col("start") / DAY))
    return r.select("event_id", F.round("d_start", 6).alias("d_start"), F.round("d_end", 6).alias("d_end"), F.round("center", 6).alias("center"))


def local_times(spark, d):
    """Token starts of each segment in video time, and back."""
    s = table(spark, d, "segment_k2f").where("start_time is not null and size(tok_start_times) > 0").select("record_id", "seg_idx", "start_time", "playback_speed", F.transform("tok_start_times", lambda x: x.cast("double")).alias("t")).distinct()
    g = F.transform("t", lambda x: F.col("start_time") + F.col("playback_speed") * x)
    back = W.local_times(g, F.col("start_time"), F.col("playback_speed"))
    return s.select("record_id", "seg_idx", F.round(F.element_at(g, -1), 3).alias("last_global"), F.round(F.element_at(back, -1), 3).alias("last_local")).distinct()


def adaptive_windows(spark, d):
    """Events in hours as words of a video."""
    e = _events(spark, d).select("user_id", (F.col("sec") / 3600).alias("center"), (F.col("duration") / 3600 + 6).alias("duration"))
    r = S.adaptive_windows(e, "user_id")
    return r.select("user_id", "seg_idx", F.round("start_time", 2).alias("start_time"), F.round("end_time", 2).alias("end_time"), "playback_speed", "first_word", "n_words")


def running_offset(spark, d):
    """Running sum of segment lengths before each segment of a record."""
    s = table(spark, d, "segment_k2f").groupBy("record_id", "seg_idx").agg(F.max(F.coalesce(F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.0)), F.lit(0.0))).alias("len"))
    w = Window.partitionBy("record_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("record_id", "seg_idx", F.round(F.coalesce(F.sum("len").over(w), F.lit(0.0)), 3).alias("offset"))


def cumulative_max(spark, d):
    e = _events(spark, d)
    return running(e, ["user_id"], "event_id", F.col("sec"), "top", width=1000).select("event_id", "top")


def batch_ranges(spark, d):
    """Batches of 16 segments' worth of each record's rows, the short last batch dropped."""
    s = table(spark, d, "segment_k2f").select("record_id", "seg_idx").distinct()
    w = Window.partitionBy("record_id").orderBy("seg_idx")
    s = s.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 4).cast("int"))
    return s.groupBy("record_id", "batch").agg(F.count("*").alias("n"), F.min("seg_idx").alias("first")).where("n = 4")


def resize_sizes(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 16).alias("w"), (F.pmod("p_partkey", F.lit(700)) + 20).alias("h"))
    return s.select("p_partkey", S.resize_size(F.col("w"), F.col("h"), 288, 512).alias("r"), S.contained_size(F.col("w"), F.col("h"), 384, 224).alias("c")).select("p_partkey", F.col("r.w").alias("w"), F.col("r.h").alias("h"), F.col("c.w").alias("cw"), F.col("c.h").alias("ch"), "c.pad_left", "c.pad_top")


def spectrogram_widths(spark, d):
    return table(spark, d, "segment_k2f").select("playback_speed").distinct().select("playback_speed", S.spectrogram_width(F.lit(22050), F.col("playback_speed"), 588 * F.col("playback_speed")).alias("width"), (1536 * F.col("playback_speed")).alias("fft_window"), (588 * F.col("playback_speed")).alias("hop"))


def magic_scale(spark, d):
    """The scale by the 99th percentile of each record's numbers: 255 / max(p99, 1)."""
    s = table(spark, d, "segment_k2f").where("spectrogram_magic_number is not null and not isnan(spectrogram_magic_number)").groupBy("record_id").agg(F.expr("percentile(cast(spectrogram_magic_number as double), 0.99)").alias("p99"))
    return s.select("record_id", F.round(255 / F.greatest("p99", F.lit(1.0)), 4).alias("scale"))


def lr_schedule(spark, d):
    n = spark.range(0, 7500, 50).select(F.col("id").alias("step"))
    return n.select("step", F.round(S.learning_rate(F.col("step"), 4e-4, 375, 7500), 10).alias("cosine"), F.round(S.learning_rate(F.col("step"), 4e-4, 375, 7500, "linear"), 10).alias("linear"))


def rotary_coords(spark, d):
    """Coordinates of the cells of a picture's grid, in units of its longer side, and of a
    segment's row, for each size of grid that records of 12 by 20 down to 1 by 2 give."""
    g = spark.range(12).select((F.col("id") + 1).cast("int").alias("h"), (2 * F.col("id") + 1).cast("int").alias("w"))
    c = g.select("h", "w", F.posexplode(S.grid_coordinates(F.col("h"), F.col("w"))).alias("cell", "c"))
    return c.select("h", "w", "cell", F.round("c.h", 6).alias("ch"), F.round("c.w", 6).alias("cw"))


def joint_coords(spark, d):
    """Joint coordinates of segments' tokens: 0, 0, segment and token."""
    s = table(spark, d, "segment_k2f").where("size(tok_ids) > 0").select("record_id", "seg_idx", F.size("tok_ids").alias("n")).distinct()
    return s.select("record_id", "seg_idx", "n", S.joint_coordinates(segment=F.col("seg_idx"), token=F.col("n")).alias("coords"))


def line_coords(spark, d):
    n = table(spark, d, "segment_k2f").where("size(tok_ids) > 0").select(F.size("tok_ids").alias("n")).distinct()
    return n.select("n", S.centred_coordinates(F.col("n")).alias("centred"), S.plain_coordinates(F.col("n")).alias("plain"))


def audio_times(spark, d):
    """Bounds of three parts of each segment, placed by hash."""
    s = table(spark, d, "segment_k2f").select("record_id", "seg_idx").distinct()
    u = F.array(*[uniform(31, "record_id", "seg_idx", F.lit(k)) for k in range(4)])
    b = S.audio_bounds(S.audio_starts(u, 3, 60, 188), 60, 588 / 22050, 1536 / 22050)
    return s.select("record_id", "seg_idx", F.transform(b, lambda x: F.round(x["start"], 6)).alias("starts"), F.transform(b, lambda x: F.round(x["end"], 6)).alias("ends"))


def window_stats(spark, d):
    w = S.window_stats(adaptive_windows(spark, d), "user_id")
    return w.select("user_id", "windows", F.round("mean", 6).alias("mean"), "most", F.round("std", 6).alias("std"))


def short_videos(spark, d):
    return table(spark, d, "segment_k2f").select("youtube_id", F.col("end_time").alias("duration")).distinct().select("youtube_id", "duration", S.too_short(F.col("duration")).alias("short"))


def media_pointers(spark, d):
    s = table(spark, d, "segment_k2f").select("seg_idx").distinct()
    return s.select("seg_idx", A.media_pointers(F.col("seg_idx")).alias("audio_ptr"))


def audio_placement(spark, d):
    """Three parts of 60 places in 188, by fixed numbers from the segment's place."""
    s = table(spark, d, "segment_k2f").select("seg_idx").distinct()
    u = F.array(*[(F.pmod((F.col("seg_idx") + 1) * k, F.lit(17)) + 1).cast("double") for k in (3, 5, 7, 11)])
    return s.select("seg_idx", S.audio_starts(u, 3, 60, 188).alias("starts"))


def checkpoint_metrics(spark, d):
    """Means of a loss by checkpoint (an event's hundred) and type, for wanted checkpoints."""
    e = table(spark, d, "events").select((F.floor(F.col("event_id") / 100) * 75).alias("step"), "event_type", "value")
    name = F.concat(F.lit("ckpt_"), F.col("step").cast("string"))
    step = F.regexp_extract(name, r"_(\d+)$", 1).cast("bigint")
    e = e.where((step == 7500) | (step % 750 == 0))
    return e.groupBy("step", "event_type").agg(F.round(F.avg("value"), 4).alias("loss"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (word_density_bins, density_gate, interval_assign_left, interval_assign_right, nearest_span_monotone, nearest_frame, fixed_tiles, centred_tiles, backward_tiles, anticipation, expanded_segments, boundary_smoothing, local_times, adaptive_windows, running_offset, cumulative_max, batch_ranges, resize_sizes, spectrogram_widths, magic_scale, lr_schedule, rotary_coords, joint_coords, line_coords, audio_times, window_stats, short_videos, media_pointers, audio_placement, checkpoint_metrics)}
_BINS = _E + ", b AS (SELECT user_id, CAST(floor(sec / 86400.0) AS BIGINT) b, count(*) n FROM e GROUP BY 1, 2), l AS (SELECT user_id, unnest(range(0, max(b) + 1)) AS bin FROM b GROUP BY user_id), r AS (SELECT l.user_id, bin, coalesce(n, 0) AS n FROM l LEFT JOIN b ON l.user_id = b.user_id AND l.bin = b.b)"
# One step a window: how many words stand before each bound decides the speed.
_WINDOWS = _E + """, v AS (SELECT user_id, list(sec / 3600 ORDER BY sec) c, max(duration) / 3600 + 5 lim FROM e GROUP BY 1),
made AS (WITH RECURSIVE q AS (SELECT user_id, -1::BIGINT k, 0.0::DOUBLE a, round(greatest(c[1], 0), 2) b, 1 speed, 0::BIGINT taken, 0::BIGINT n FROM v
 UNION ALL SELECT user_id, k, a, round(a + 5 * speed, 2), speed, taken, len(list_filter(c, lambda x: x < a + 5.0 * speed)) - taken FROM
 (SELECT user_id, k, a, taken, c, CASE WHEN n1 >= 8 OR a + 10 > lim OR n2 >= 16 THEN 1 WHEN n2 >= 8 OR a + 15 > lim OR n3 >= 16 THEN 2 ELSE 3 END speed FROM
 (SELECT q.user_id, k + 1 k, b a, taken + n taken, c, lim, len(list_filter(c, lambda x: x < b + 5)) - taken - n n1, len(list_filter(c, lambda x: x < b + 10)) - taken - n n2, len(list_filter(c, lambda x: x < b + 15)) - taken - n n3 FROM q JOIN v ON q.user_id = v.user_id WHERE taken + n < len(c) AND b + 5 <= lim)))
 SELECT * FROM q WHERE k >= 0) """
SQL = {
    "word_density_bins": _BINS + " SELECT * FROM r",
    "density_gate": _BINS + " SELECT user_id, max(n) AS most, max(n) < 10 AS dropped FROM r GROUP BY 1",
    "interval_assign_left": _D + " SELECT event_id, e.user_id, seg FROM e JOIN iv ON e.user_id = iv.user_id AND sec >= lo AND sec < hi",
    "interval_assign_right": _D + " SELECT iv.user_id, seg, count(event_id) AS n FROM iv LEFT JOIN e ON e.user_id = iv.user_id AND sec > lo AND sec <= hi GROUP BY 1, 2",
    "nearest_span_monotone": _E + ", d AS (SELECT *, [abs(duration * 0.25 - sec), abs(duration * 0.5 - sec), abs(duration * 0.75 - sec)] ds FROM e), n AS (SELECT event_id, user_id, CAST(list_position(ds, list_min(ds)) - 1 AS INT) nearest FROM d) SELECT event_id, nearest, max(nearest) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS assigned FROM n",
    "nearest_frame": "SELECT DISTINCT record_id, seg_idx, (start_time + end_time) / 2 AS mid, CAST(greatest(least(round_even((start_time + end_time) / 2 * 3, 0) + 1, 900), 1) AS INT) AS frame FROM segment_k2f WHERE start_time IS NOT NULL AND end_time IS NOT NULL",
    "fixed_tiles": _DU + " SELECT user_id, CAST(k AS INT) AS k, round(k * 24.0::DOUBLE, 3) AS start, round((k + 1) * 24.0::DOUBLE, 3) AS end FROM (SELECT user_id, unnest(range(0, least(CAST(ceil(dur / 24) AS INT) - 1, 40))) k FROM du)",
    "centred_tiles": _DU + " SELECT user_id, CAST(k AS INT) AS k, round(f + k * 7.0, 3) AS start, round(f + (k + 1) * 7.0, 3) AS end FROM (SELECT user_id, round((dur - floor(dur / 7) * 7) / 2, 2) f, unnest(range(0, CAST(floor(dur / 7) AS INT))) k FROM du)",
    "backward_tiles": _DU + " SELECT user_id, CAST(5 - i AS INT) AS k, round(greatest(dur - (i + 1) * 200.0, 0), 3) AS start, round(greatest(dur - i * 200.0, 0), 3) AS end FROM du, range(0, 6) r(i)",
    "anticipation": _DU + " SELECT user_id, round(greatest(dur / 20 - 17, 0), 4) AS start, round(greatest(dur / 20 - 1, 0), 4) AS end FROM du",
    "boundary_smoothing": _E + """, p AS (SELECT *, coalesce(lead(sec) OVER w, sec + 1) en, event_id % 7 / 5 - 0.5 so, event_id % 11 / 8 - 0.6 eo, row_number() OVER w pos FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)),
q AS (SELECT *, greatest(least(coalesce((so + lag(eo) OVER w) / 2, so), 0.5), -0.5) ds, greatest(least(coalesce((lead(so) OVER w + eo) / 2, eo), 0.5), -0.5) de FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos))
SELECT event_id, round(ds, 6) AS d_start, round(de, 6) AS d_end, round(((sec + ds) + (en + de)) / 2, 6) AS center FROM q""",
    "expanded_segments": _DU + ", s AS (SELECT user_id, (dur / 50 + (o - 0.5) * 5.0) a, (dur / 50 + (o + 0.5) * 5.0) b FROM du, (VALUES (0), (-1), (1), (-2), (2), (-3), (3)) t(o)) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS INT) AS k, round(a, 3) AS start, round(b, 3) AS end FROM s WHERE a >= 0",
    "local_times": "WITH s AS (SELECT DISTINCT record_id, seg_idx, start_time, playback_speed p, CAST(tok_start_times[-1] AS DOUBLE) t FROM segment_k2f WHERE start_time IS NOT NULL AND len(tok_start_times) > 0) SELECT DISTINCT record_id, seg_idx, round(start_time + p * t, 3) AS last_global, round((start_time + p * t - start_time) / p, 3) AS last_local FROM s",
    "spectrogram_widths": "SELECT DISTINCT playback_speed, CAST(floor(22050 * 5.0::DOUBLE * playback_speed / (588 * playback_speed)) AS INT) + 1 AS width, 1536 * playback_speed AS fft_window, 588 * playback_speed AS hop FROM segment_k2f",
    "audio_placement": "WITH s AS (SELECT DISTINCT seg_idx, [(seg_idx + 1) * 3 % 17 + 1, (seg_idx + 1) * 5 % 17 + 1, (seg_idx + 1) * 7 % 17 + 1, (seg_idx + 1) * 11 % 17 + 1] u FROM segment_k2f) SELECT seg_idx, list_transform([0, 1, 2], lambda i: CAST(floor(8 * list_sum(u[1:i + 1])::DOUBLE / list_sum(u)) + i * 60 AS INT)) AS starts FROM s",
    "running_offset": "WITH s AS (SELECT record_id, seg_idx, max(coalesce(greatest(end_time - start_time, 0.0), 0.0)) l FROM segment_k2f GROUP BY 1, 2) SELECT record_id, seg_idx, round(coalesce(sum(l) OVER (PARTITION BY record_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS offset FROM s",
    "cumulative_max": _E + " SELECT event_id, max(sec) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS top FROM e",
    "batch_ranges": "WITH s AS (SELECT DISTINCT record_id, seg_idx FROM segment_k2f), b AS (SELECT *, CAST((row_number() OVER (PARTITION BY record_id ORDER BY seg_idx) - 1) // 4 AS INT) batch FROM s) SELECT record_id, batch, count(*) AS n, min(seg_idx) AS first FROM b GROUP BY 1, 2 HAVING count(*) = 4",
    "resize_sizes": """WITH s AS (SELECT p_partkey, p_size * 37 + 16 w, p_partkey % 700 + 20 h FROM part),
z AS (SELECT *, CAST(CASE WHEN greatest(w, h)::DOUBLE / least(w, h) * 288 > 512 THEN round_even(512.0::DOUBLE * least(w, h) / greatest(w, h), 0) ELSE 288 END AS INT) z, least(384.0::DOUBLE / w, 224.0::DOUBLE / h) g FROM s),
r AS (SELECT *, CASE WHEN least(w, h) <= 288 OR (w <= h AND w = z) OR (h <= w AND h = z) THEN w WHEN w < h THEN z ELSE CAST(trunc((z * w)::DOUBLE / h) AS INT) END rw, CASE WHEN least(w, h) <= 288 OR (w <= h AND w = z) OR (h <= w AND h = z) THEN h WHEN w < h THEN CAST(trunc((z * h)::DOUBLE / w) AS INT) ELSE z END rh, CAST(floor(w * g + 1e-9) AS INT) cw, CAST(floor(h * g + 1e-9) AS INT) ch FROM z)
SELECT p_partkey, CAST(rw AS INT) AS w, CAST(rh AS INT) AS h, cw, ch, (384 - cw) // 2 AS pad_left, (224 - ch) // 2 AS pad_top FROM r""",
    "magic_scale": "SELECT record_id, round(255 / greatest(quantile_cont(CAST(spectrogram_magic_number AS DOUBLE), 0.99), 1.0), 4) AS scale FROM segment_k2f WHERE spectrogram_magic_number IS NOT NULL AND NOT isnan(spectrogram_magic_number) GROUP BY 1",
    "lr_schedule": "WITH s AS (SELECT range AS step, least(greatest((range - 375)::DOUBLE / 7126, 0), 1) p FROM range(0, 7500, 50)) SELECT step, round(4e-4 * CASE WHEN step < 375 THEN step / 375 ELSE 0.02 + 0.98 * 0.5 * (1 + cos(pi() * p)) END, 10) AS cosine, round(4e-4 * CASE WHEN step < 375 THEN step / 375 ELSE 1 - p END, 10) AS linear FROM s",
    "rotary_coords": """WITH g AS (SELECT CAST(range + 1 AS INT) h, CAST(2 * range + 1 AS INT) w FROM range(12)), c AS (SELECT h, w, unnest(range(h * w)) cell FROM g), p AS (SELECT *, cell // w y, cell % w x FROM c)
SELECT h, w, CAST(cell AS INT) AS cell, round((CASE WHEN y < h // 2 THEN y - h // 2 ELSE y - h // 2 + 1 END) / (greatest(h, w) + 1.0::DOUBLE), 6) AS ch, round((CASE WHEN x < w // 2 THEN x - w // 2 ELSE x - w // 2 + 1 END) / (greatest(h, w) + 1.0::DOUBLE), 6) AS cw FROM p""",
    "joint_coords": "SELECT DISTINCT record_id, seg_idx, CAST(len(tok_ids) AS INT) AS n, [0.0::DOUBLE, 0.0::DOUBLE, seg_idx / 16.0::DOUBLE, len(tok_ids) / 1024.0::DOUBLE] AS coords FROM segment_k2f WHERE len(tok_ids) > 0",
    "line_coords": "WITH s AS (SELECT DISTINCT len(tok_ids) n FROM segment_k2f WHERE len(tok_ids) > 0) SELECT CAST(n AS INT) AS n, list_transform(range(n), lambda i: (CASE WHEN i < n // 2 THEN i - n // 2 ELSE i - n // 2 + 1 END)::DOUBLE) AS centred, list_transform(range(n), lambda i: (i + 1)::DOUBLE) AS plain FROM s",
    "audio_times": f"WITH s AS (SELECT DISTINCT record_id, seg_idx FROM segment_k2f), u AS (SELECT *, [{', '.join(uniform_sql(31, 'record_id', 'seg_idx', str(k)) for k in range(4))}] u FROM s), p AS (SELECT record_id, seg_idx, list_transform([0, 1, 2], lambda i: floor(8 * list_sum(u[1:i + 1]) / list_sum(u)) + i * 60) f FROM u) SELECT record_id, seg_idx, list_transform(f, lambda x: round(x * (588 / 22050) - 1536 / 22050 / 2, 6)) AS starts, list_transform(f, lambda x: round(x * (588 / 22050) - 1536 / 22050 / 2 + 60 * (588 / 22050) + 1536 / 22050, 6)) AS ends FROM p",
    "adaptive_windows": _WINDOWS + "SELECT user_id, CAST(k AS INT) AS seg_idx, round(a, 2) AS start_time, round(b, 2) AS end_time, speed AS playback_speed, CAST(taken AS INT) AS first_word, CAST(n AS INT) AS n_words FROM made",
    "window_stats": _WINDOWS + "SELECT user_id, count(*) AS windows, round(avg(n), 6) AS mean, CAST(max(n) AS INT) AS most, round(stddev_pop(n), 6) AS std FROM made GROUP BY 1",
    "short_videos": "SELECT DISTINCT youtube_id, end_time AS duration, coalesce(end_time - 1 < 5, true) AS short FROM segment_k2f",
    "media_pointers": "SELECT DISTINCT seg_idx, list_transform(range(0, 18), lambda k: CAST(seg_idx * 3 + k // 6 AS INT)) AS audio_ptr FROM segment_k2f",
    "checkpoint_metrics": "WITH e AS (SELECT event_id // 100 * 75 AS step, event_type, value FROM events) SELECT step, event_type, round(avg(value), 4) AS loss, count(*) AS n FROM e WHERE step = 7500 OR step % 750 = 0 GROUP BY 1, 2",
}
