"""Readers of the file kinds that crawls and corpora come in."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import shard_of
from ..rand import uniform

INFO = "id string, title string, description string, channel_id string, upload_date string, tags array<string>, categories array<string>, duration double, view_count double, average_rating double, transcripts map<string,string>, _avg_cosine_sim double, _num_coco_objects_expectation double, _cld3_lang string, _cld3_lang_prob double, _ids_fn string"


# Names of categories, in the order of their ids from 0.
CATEGORIES = ["music", "people", "gaming", "sports/actions", "news/events/politics", "education", "tv shows", "movie/comedy", "animation", "vehicles/autos", "howto", "travel", "science/technology", "animals/pets", "kids/family", "documentary", "food/drink", "cooking", "beauty/fashion", "advertisement"]


def categories(spark: SparkSession) -> DataFrame:
    """(name, category_id) of the categories."""
    return spark.createDataFrame(list(zip(CATEGORIES, range(len(CATEGORIES)))), "name string, category_id int")


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML file as a dictionary, from any file system Spark knows; it comes to the driver,
    where plans are made. An empty file is an empty dictionary."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(text[0]) or {} if text else {}


def without_padding(df: DataFrame, key: str) -> DataFrame:
    """Rows of a validation set without those that only fill up its last batch ('pad')."""
    return df.where(F.col(key).isNull() | (F.col(key) != "pad"))


def with_metadata(rows: DataFrame, spark: SparkSession, folder: str, schema: str, key: str = "metadata_fn") -> DataFrame:
    """Rows with the fields (as `metadata`) of the JSON document in a folder that each names by
    its path below the folder; rows whose document is missing have a null."""
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    root = folder.rstrip("/") + "/"
    path = F.input_file_name()
    # The file's path behind the folder's own, however the file system writes its root.
    docs = docs.select(F.element_at(F.split(path, F.lit("\\Q" + root.split(":", 1)[-1].lstrip("/") + "\\E")), -1).alias(key), F.struct("*").alias("metadata"))
    return rows.join(docs, key, "left")


def id_list(spark: SparkSession, path: str, folds: int = 1, fold: int = 0, seed: int | None = None) -> DataFrame:
    """(video_id) of one shard of a CSV with a header: every folds-th of the ids in order, from
    the fold's number on; with a seed they come shuffled. A shard without ids is an error."""
    ids = spark.read.csv(path, header=True).select("video_id")
    out = ids if folds == 1 else shard_of(ids, folds, fold, "video_id")
    if out.isEmpty():
        raise ValueError(f"no ids in shard {fold} of {folds} of {path}")
    return out if seed is None else out.orderBy(uniform(seed, "video_id"))


def info_documents(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """Video documents (JSON lines or one document a file, gzipped or not) with the
    transcript of one language; documents without title or that transcript are left out,
    as are malformed ones."""
    rows = spark.read.schema(INFO + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    rows = rows.where("_corrupt_record is null and title is not null and transcripts is not null").drop("_corrupt_record")
    return rows.withColumn("transcript", F.try_element_at("transcripts", F.lit(lang))).where("transcript is not null")


# Sources of the public text corpus that are wanted by default.
SOURCES = ["Pile-CC", "FreeLaw", "StackExchange", "PubMed Abstracts", "OpenWebText2", "Wikipedia (en)", "HackerNews", "NIH ExPorter", "USPTO Backgrounds", "OpenSubtitles", "Books3", "Gutenberg (PG-19)", "BookCorpus2"]
#: Compressed bytes of a file that one worker takes.
LARGEST_FILE = 1 << 30


def text_corpus(spark: SparkSession, path: str, sources: list[str] | None = SOURCES, every: int = 1, skip: int = 0) -> DataFrame:
    """(text, source) of zstd-compressed JSON lines on any file system Spark knows: of each file
    every `every`-th line from `skip` on, of the sources given (None: all). Files are the unit
    of parallelism and come to the workers as bytes, so one larger than LARGEST_FILE is an
    error; they are decompressed as streams. Lines that don't decode or have no text are left
    out, as are bytes that are no UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.assert_true(F.col("length") <= LARGEST_FILE, F.concat(F.col("path"), F.lit(" is too large; split it")))
    files = files.where(F.coalesce(fits.isNull(), F.lit(True))).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for content in batch.column(0):
                stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()))
                texts: list = []
                names: list = []
                for j, line in enumerate(io.TextIOWrapper(stream, "utf-8", errors="ignore")):
                    if j % every != skip:
                        continue
                    try:
                        x = json.loads(line)
                        t, s = x["text"], (x.get("meta") or {}).get("pile_set_name")
                    except (ValueError, KeyError, AttributeError, TypeError):
                        continue
                    if isinstance(t, str) and (sources is None or s in sources):
                        texts.append(t)
                        names.append(s)
                    if len(texts) == 2000:
                        yield _texts(texts, names)
                        texts, names = [], []
                yield _texts(texts, names)

    return files.mapInArrow(run, "text string, source string")


def _texts(texts: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "source"])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file, for caption and subtitle files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def headerless_csv(spark: SparkSession, path: str, schema: str, skip_header: bool) -> DataFrame:
    """Positional columns; the header row, where there is one, is skipped."""
    return spark.read.schema(schema).csv(path, header=skip_header, enforceSchema=True)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return df.join(done.select(key), key, "left_anti")
