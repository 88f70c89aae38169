"""Queries on captions, alignments and streams, with SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import align as AL
from ..operators import captions as C
from ..operators import words as W
from ..session import ensure_checkpoint_dir, table
from ..streaming import ops as ST

_CLOCK = r"\d\d:\d\d:\d\d\.\d\d\d"


def caption_words(spark, d):
    r = C.caption_words(table(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "pos", "word", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def caption_density(spark, d):
    """Words of captions in bins of 30 s."""
    return W.density_bins(C.caption_words(table(spark, d, "documents"), "doc_id", "text"), "doc_id", F.col("start"), 30.0)


def align_words(spark, d):
    """Each item's words with those of its text without every seventh word."""
    q = table(spark, d, "eval_items").where("text is not null").select("item_id", F.split("text", r"\s+").alias("w"))
    return q.select("item_id", AL.aligned_words("w", F.filter("w", lambda x, i: i % 7 != 6)).alias("aligned"))


def offset_network(spark, d):
    """Offsets of documents' words from features, by a network with fixed weights."""
    r = np.random.default_rng(1)
    n = 18
    w = {"mean": np.zeros(n), "std": np.ones(n), "w0": r.standard_normal((32, n)) / 8, "b0": np.zeros(32), "w1": r.standard_normal((32, 32)) / 8, "b1": np.zeros(32), "w2": r.standard_normal((2, 32)) / 8, "b2": np.zeros(2), "temp": np.array(-1.0), "bias": np.zeros(2)}
    words = C.caption_words(table(spark, d, "documents"), "doc_id", "text")
    f = W.word_features(words.select("doc_id", "pos", "word", "start", "end"), "doc_id", {"bpelen": F.lit(1), "chunklen": F.lit(0.3)})
    cols = [c for c in f.columns if c.startswith("feat_")]
    return f.select("doc_id", "pos", AL.offset_network(w)(F.array(*[F.col(c).cast("float") for c in cols])).alias("o")).select("doc_id", "pos", F.round(F.col("o")[0], 4).alias("start_off"), F.round(F.col("o")[1], 4).alias("end_off"))


def _run(spark, stream, name):
    """Runs a stream over what there is, into the shared folder, and reads the result."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start(f"{root}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_copies(spark, d):
    """Segments of a stream without those delivered again, which happens within days."""
    path = f"{d}/segment_k2f.parquet"
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).parquet(path + "*").select("record_id", "seg_idx", "arrived_at").withColumn("at", F.col("arrived_at").cast("timestamp"))
    return _run(spark, ST.without_copies(s, "at", ["record_id", "seg_idx"], "14 days").select("record_id", "seg_idx"), "copies")


def stream_day_counts(spark, d):
    """Events of a stream by type and day, for the days that the last event has closed."""
    path = f"{d}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*").where("ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    r = _run(spark, ST.windowed_counts(s, "at", ["event_type"], "1 day", "0 seconds"), "days")
    return r.select(F.unix_seconds("start").alias("day_start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_day_counts, caption_words, caption_density, align_words, offset_network, stream_copies)}
_CUES = rf"""WITH d AS (SELECT doc_id, regexp_replace(replace(text, chr(13), ''), '(^|\n)({_CLOCK}) --> ({_CLOCK})[^\n]*', chr(10) || chr(1) || '\2' || chr(2) || '\3' || chr(2), 'g') t FROM documents WHERE starts_with(text, 'WEBVTT') AND contains(text, ' --> ')),
c AS (SELECT doc_id, unnest(string_split(t, chr(1))[2:]) c, unnest(range(len(string_split(t, chr(1))) - 1)) k FROM d),
p AS (SELECT doc_id, k, string_split(c, chr(2))[1] a, string_split(c, chr(2))[2] b, list_filter(regexp_split_to_array(regexp_replace(string_split(c, chr(2))[3], '<[^\n]*?>', '', 'g'), '[ \n]+'), lambda w: w <> '') w FROM c),
s AS (SELECT doc_id, k, w, CAST(a[1:2] AS INT) * 3600 + CAST(a[4:5] AS INT) * 60 + CAST(a[7:12] AS DOUBLE) a, CAST(b[1:2] AS INT) * 3600 + CAST(b[4:5] AS INT) * 60 + CAST(b[7:12] AS DOUBLE) b FROM p),
x AS (SELECT doc_id, k, unnest(w) AS word, unnest(range(len(w))) i, len(w) n, a, b FROM s),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS INT) AS pos, word, a + i * (b - a) / n st, a + (i + 1) * (b - a) / n en FROM x)"""
SQL = {
    "caption_words": _CUES + " SELECT doc_id, pos, word, round(st, 3) AS start, round(en, 3) AS end FROM r",
    "caption_density": _CUES + ", b AS (SELECT doc_id, CAST(floor(st / 30.0) AS BIGINT) b, count(*) n FROM r GROUP BY 1, 2), l AS (SELECT doc_id, unnest(range(0, max(b) + 1)) AS bin FROM b GROUP BY 1) SELECT l.doc_id, bin, coalesce(n, 0) AS n FROM l LEFT JOIN b ON l.doc_id = b.doc_id AND l.bin = b.b",
    "stream_day_counts": "WITH e AS (SELECT date_trunc('day', ts) d, event_type FROM events WHERE ts IS NOT NULL) SELECT CAST(epoch(d) AS BIGINT) AS day_start, event_type, count(*) AS n FROM e WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2",
    "stream_copies": "SELECT DISTINCT record_id, seg_idx FROM segment_k2f",
}
