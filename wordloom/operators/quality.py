"""Quality gates with the reason of the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition holds, in order; null if none does. A
    null condition doesn't hold."""
    out = None
    for name, failed in gates:
        out = F.when(failed, F.lit(name)) if out is None else out.when(failed, F.lit(name))
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def crawl_gates(*, transcript: Column, duration: Column, categories: Column, density: Column, lang: Column, cosine: Column, objects: Column, lang_prob: Column | None = None, audio_streams: Column | None = None, skip_gaming: bool = True, min_lang_prob: float = 0.8, max_minutes: float = 20, min_density: float = 50, max_cosine: float = 0.9, min_objects: float = 0.9) -> list[tuple[str, Column]]:
    """The crawl's chain: from the cheapest test to the dearest. Density is tested only
    where there is a transcript; the probability of the language and the number of audio
    streams only where they are given."""
    gates = [
        ("no_transcript", transcript.isNull() | (transcript == "")),
        ("video too long", duration.isNull() | (duration > max_minutes * 60)),
    ]
    if skip_gaming:
        gates.append(("gaming", F.array_contains(categories, "Gaming")))
    return gates + [
        ("word density too low", density < min_density),
        ("maybe not english", lang.isNull() | (lang != "en") | (lang_prob < min_lang_prob if lang_prob is not None else F.lit(False))),
        ("acs_too_high", cosine > max_cosine),
        ("nco_too_low", objects < min_objects),
        *([("no audio", F.coalesce(audio_streams < 1, F.lit(True)))] if audio_streams is not None else []),
    ]


def with_reason(df: DataFrame, gates: list[tuple[str, Column]], name: str = "failreason") -> DataFrame:
    return df.withColumn(name, first_reason(gates))
