"""Readers, writers, the TFRecord source and streams."""

import gzip
import json

import pytest
import zstandard

from wordloom.sources import readers, sinks, tfrecord
from wordloom.streaming import ops


def test_crc_and_frames(tmp_path):
    assert tfrecord.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF
    p = tmp_path / "a.tfrecord"
    p.write_bytes(b"".join(tfrecord.frame(x) for x in (b"", b"abc")))
    assert list(tfrecord.frames(str(p), True)) == [b"", b"abc"]
    f = {"a": [1, -5, 1 << 40], "b": [0.5], "c": [b"x", b""], "d": []}
    assert tfrecord.parse_example(tfrecord.make_example(f)) == f


def test_tfrecord_round_trip(spark, tmp_path):
    spark.dataSource.register(tfrecord.TFRecord)
    kind = "id bigint, x float, name string, toks array<bigint>, raw binary"
    df = spark.createDataFrame([(1, 0.5, "é", [1, 2, -3], bytearray(b"\x00\x01")), (2, None, None, [], None)], kind)
    df.write.format("tfrecord").mode("append").option("path", str(tmp_path / "out")).save()
    back = spark.read.format("tfrecord").schema(kind).option("check", "true").load(str(tmp_path / "out")).orderBy("id")
    assert [tuple(r) for r in back.collect()] == [(1, 0.5, "é", [1, 2, -3], bytearray(b"\x00\x01")), (2, None, None, [], None)]


def test_readers(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("video_id\n" + "\n".join(f"v{i}" for i in range(50)))
    assert [readers.id_list(spark, str(tmp_path / "ids.csv"), 4, k, seed=1).count() for k in range(4)] == [13, 13, 12, 12]
    with pytest.raises(ValueError, match="no ids"):
        readers.id_list(spark, str(tmp_path / "ids.csv"), 99, 98)
    with gzip.open(tmp_path / "info.json.gz", "wt") as f:
        for x in ({"id": "a", "title": "t", "transcripts": {"en": "WEBVTT"}}, {"id": "b", "title": "t", "transcripts": {"de": "x"}}, {"id": "c", "transcripts": {"en": "x"}}):
            f.write(json.dumps(x) + "\n")
        f.write("{broken\n")
    assert [r.id for r in readers.info_documents(spark, str(tmp_path / "info.json.gz")).collect()] == ["a"]
    lines = [json.dumps({"text": f"t{i}", "meta": {"pile_set_name": "A" if i % 2 else "B"}}) for i in range(10)] + ["{", "[]", '{"meta": {}}']
    (tmp_path / "c.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    assert readers.text_corpus(spark, str(tmp_path / "c.zst"), None).count() == 10 and readers.text_corpus(spark, str(tmp_path / "c.zst")).count() == 0
    assert [readers.text_corpus(spark, str(tmp_path / "c.zst"), None, 3, k).count() for k in range(3)] == [4, 3, 3]
    assert readers.text_corpus(spark, str(tmp_path / "c.zst"), ["A"]).count() == 5
    (tmp_path / "q.json").write_text('[{"id": 1}, {"id": 2}]')
    assert readers.json_array(spark, str(tmp_path / "q.json"), "id int").count() == 2
    (tmp_path / "x.srt").write_text("1\n")
    assert readers.whole_texts(spark, str(tmp_path / "x.srt")).first().text == "1\n"


def test_sinks(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "concat('x-', id) as k", "cast(id % 2 as string) as split", "concat('v', id % 7) as video_id")
    sinks.write_records(df, str(tmp_path / "r"), 4, 1, "id")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 40
    sinks.write_folds(df, str(tmp_path / "f"), 3, "id")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 40
    sinks.write_ids(df, str(tmp_path / "i"))
    assert spark.read.csv(str(tmp_path / "i"), header=True).count() == 7
    sinks.write_predictions(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 40
    sinks.write_submission(df.coalesce(1), str(tmp_path / "s"), "k")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 40


def run(stream, tmp_path, spark):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "o"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "o"))


def test_streamed_packing_equals_batch(spark, tmp_path):
    from wordloom.operators.packing import pack_blocks

    docs = spark.createDataFrame([(s, i, list(range(100, 100 + (i * 7 + s) % 30))) for s in range(3) for i in range(25)], "shard int, ord int, toks array<int>")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    got = run(ops.packed_blocks(stream, "shard", "ord", "toks", 32), tmp_path, spark)
    want = pack_blocks(docs, "shard", "ord", "toks", 32)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp_seconds(id * 50) as ts, cast(id % 2 as string) as k from range(100)").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    got = run(ops.windowed_counts(s, "ts", ["k"], "10 minutes", "0 seconds"), tmp_path, spark)
    assert got.count() >= 14 and got.agg({"n": "max"}).first()[0] == 6


def test_records_of_any_file_system(spark, tmp_path):
    spark.dataSource.register(tfrecord.TFRecord)
    kind = "id bigint, x float, name string, toks array<bigint>, raw binary"
    df = spark.createDataFrame([(1, 0.5, "é", [1, 2, -3], bytearray(b"\x00\x01")), (2, None, None, [], None)], kind)
    df.write.format("tfrecord").mode("append").option("path", str(tmp_path / "out")).save()
    back = tfrecord.read_records(spark, str(tmp_path / "out"), kind, {"x": 9.0, "name": "none", "toks": [7]}, check=True).orderBy("id")
    assert [tuple(r) for r in back.collect()] == [(1, 0.5, "é", [1, 2, -3], bytearray(b"\x00\x01")), (2, 9.0, "none", [7], None)]
    again = spark.read.format("tfrecord").schema(kind).option("default.name", "none").option("default.x", "9").load(str(tmp_path / "out")).orderBy("id")
    assert [(r.x, r.name) for r in again.collect()] == [(0.5, "é"), (9.0, "none")]
    (tmp_path / "cut.tfrecord").write_bytes(tfrecord.frame(b"abc")[:-5])
    with pytest.raises(Exception, match="inside a record"):
        tfrecord.read_records(spark, str(tmp_path / "cut.tfrecord"), kind).collect()


def test_config_metadata_and_padding(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nb:\n  - x\n")
    assert readers.read_config(spark, str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]}
    (tmp_path / "m" / "s").mkdir(parents=True)
    (tmp_path / "m" / "s" / "1.json").write_text('{"w": 5}')
    rows = spark.createDataFrame([(1, "s/1.json"), (2, "s/2.json"), (3, None)], "id int, metadata_fn string")
    got = readers.with_metadata(rows, spark, str(tmp_path / "m"), "w int").orderBy("id").collect()
    assert [r.metadata and r.metadata.w for r in got] == [5, None, None]
    ids = spark.createDataFrame([("a",), ("pad",), (None,)], "id string")
    assert readers.without_padding(ids, "id").count() == 2 and readers.categories(spark).count() == 20


def test_vocabulary_files(spark, tmp_path):
    v = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, n int")
    sinks.write_vocabulary(v, str(tmp_path / "v"))
    assert [(r.word, r.id) for r in spark.read.json(str(tmp_path / "v")).orderBy("id").collect()] == [("c", 0), ("a", 1), ("b", 2)]
    t = spark.createDataFrame([("q", "a _"), ("r", None)], "k string, t string")
    sinks.write_infill(t, str(tmp_path / "t"), "k", "t")
    sinks.write_splits(t.withColumn("split", t.k), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "t")).count() == 1 and spark.read.json(str(tmp_path / "s")).count() == 2
