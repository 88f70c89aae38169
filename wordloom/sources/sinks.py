"""Writers: shuffled record files, id logs, predictions, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import shuffled


def write_records(df: DataFrame, path: str, files: int, seed: int, *keys: str) -> None:
    """All rows in a random order that the seed fixes, in the given number of files."""
    shuffled(df, files, seed, *keys).write.parquet(path)


def write_folds(df: DataFrame, path: str, folds: int, key: str) -> None:
    """Rows by fold, one directory each."""
    df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")).repartition(folds, "fold").write.partitionBy("fold").parquet(path)


def write_ids(df: DataFrame, path: str, key: str = "video_id") -> None:
    """The different ids as CSV."""
    df.select(key).where(F.col(key).isNotNull()).distinct().write.csv(path, header=True)


def write_predictions(df: DataFrame, path: str, split: str = "split") -> None:
    """Predictions as JSON lines, by split."""
    df.write.partitionBy(split).json(path)


def write_submission(df: DataFrame, path: str, order: str) -> None:
    """A submission as CSV, sorted by the number in its key's second part."""
    df.orderBy(F.split_part(order, F.lit("-"), F.lit(2)).try_cast("int"), order).write.csv(path, header=True)


def write_vocabulary(df: DataFrame, path: str, name: str = "word", count: str = "n") -> None:
    """A vocabulary as one JSON line a word with its number, the most frequent first; equal
    counts go by the word."""
    from ..operators.numbering import numbered

    numbered(df.select(name, count), -F.col(count), name, name="id").select(name, "id", count).write.json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Rows as JSON lines, one folder a split."""
    df.write.partitionBy(split).json(path)


def write_infill(df: DataFrame, path: str, key: str, template: str) -> None:
    """Infill templates as JSON lines; rows without one are left out."""
    df.where(F.col(template).isNotNull()).select(key, template).write.json(path)


def without_heavy(df: DataFrame, *heavy: str) -> DataFrame:
    return df.drop(*heavy)
