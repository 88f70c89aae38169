"""Caption files: words and times of VTT and SRT texts, inside a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import seconds_of_clock

_CLOCK = r"\d\d:\d\d:\d\d\.\d\d\d"
_NONE = "array<struct<word:string,start:double,end:double>>"


def _word(w: Column, a: Column, b: Column) -> Column:
    return F.struct(w.alias("word"), a.alias("start"), b.alias("end"))


def _cues(text: Column, auto: bool) -> Column:
    """The parts of a text that begin with a cue line."""
    tail = r"[^\n]* align:start position:0%" if auto else ""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("")), rf"(?m)^(?={_CLOCK} --> \S+{tail})")
    return F.filter(parts, lambda p: p.rlike(rf"^{_CLOCK} --> {_CLOCK}"))


def _bound(cue: Column, i: int) -> Column:
    return seconds_of_clock(F.regexp_extract(cue, rf"^({_CLOCK}) --> ({_CLOCK})", i))


def uploaded_words(text: Column) -> Column:
    """Words of hand-made cues: tags dropped, cut at blanks, spread evenly over the cue."""

    def one(cue: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(cue, r"^[^\n]*\n?", ""), r"<.*?>", "")
        words = F.filter(F.split(body, r"[ \n]+"), lambda w: w != "")
        a, b, n = _bound(cue, 1), _bound(cue, 2), F.size(words)
        return F.transform(words, lambda w, i: _word(w, a + i * (b - a) / n, a + (i + 1) * (b - a) / n))

    return F.flatten(F.transform(_cues(text, False), one))


def auto_words(text: Column) -> Column:
    """Words of automatic cues: inline stamps part them, the last ends with the cue. A cue
    without stamps gives its second line as one word, if it has three lines or more; one
    with two stamped lines is malformed and gives nothing."""

    def one(cue: Column) -> Column:
        lines = F.split(F.regexp_replace(cue, r"^[^\n]*\n?", ""), "\n")
        stamped = F.filter(lines, lambda x: x.rlike(rf".<{_CLOCK}>."))
        a, b = _bound(cue, 1), _bound(cue, 2)
        line = F.concat(F.lit("<"), F.regexp_extract(cue, rf"^({_CLOCK})", 1), F.lit(">"), F.get(stamped, F.lit(0)))
        pieces = F.regexp_extract_all(line, F.lit(rf"<{_CLOCK}>[^\x00]*?(?=<{_CLOCK}>|$)"), 0)
        words = F.transform(pieces, lambda p: F.struct(F.trim(F.regexp_replace(p, r"<[^>]*>", "")).alias("w"), seconds_of_clock(F.regexp_extract(p, rf"^<({_CLOCK})>", 1)).alias("t")))
        words = F.filter(words, lambda x: x["w"] != "")
        timed = F.transform(words, lambda x, i: _word(x["w"], x["t"], F.coalesce(F.get(words, i + 1)["t"], b)))
        second = F.trim(F.get(lines, F.lit(1)))
        lone = F.when((F.size(lines) >= 3) & (second != "") & ~F.contains(second, F.lit("<c>")), F.array(_word(second, a, b)))
        return F.coalesce(F.when(F.size(stamped) == 1, timed).when(F.size(stamped) == 0, lone), F.array().cast(_NONE)).cast(_NONE)

    return F.flatten(F.transform(_cues(text, True), one))


def caption_words(df: DataFrame, key: str, text: str, need_times: bool = False) -> DataFrame:
    """(key, pos, word, start, end) of each text that has cues. Automatic cues are tried
    first; a text without any word from them that begins with WEBVTT is read as an
    uploaded one, unless need_times. Other texts give no rows."""
    c = F.col(text)
    if need_times:
        df = df.where(F.contains(c, F.lit("<c>")))
    auto = auto_words(c)
    plain = F.array().cast(_NONE) if need_times else uploaded_words(c).cast(_NONE)
    rows = df.where(F.contains(c, F.lit(" --> "))).select(key, F.when(F.size(auto) > 0, auto).when(c.startswith("WEBVTT"), plain).alias("_w"))
    return rows.select(key, F.posexplode("_w").alias("pos", "_x")).select(key, "pos", "_x.word", "_x.start", "_x.end")


def srt_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, start, end, text) of SRT texts: blocks parted by blank lines, of which the
    line with the arrow gives the times and the lines after it the text."""
    clock = r"(\d\d:\d\d:\d\d)[,.](\d\d\d)"
    blocks = F.filter(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), r"\n\s*\n"), lambda b: b.rlike(rf"(?m)^{clock} --> {clock}"))
    rows = df.select(key, F.posexplode(blocks).alias("n", "b"))
    full = rf"(?s)^.*?{clock} --> {clock}[^\n]*\n?(.*)$"
    at = lambda i: seconds_of_clock(F.concat_ws(".", F.regexp_extract("b", full, i), F.regexp_extract("b", full, i + 1)))
    return rows.select(key, "n", at(1).alias("start"), at(3).alias("end"), F.trim(F.replace(F.regexp_extract("b", full, 5), F.lit("\n"), F.lit(" "))).alias("text"))
