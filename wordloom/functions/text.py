"""Text functions: cleaning, folding, spelling of numbers, clocks, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..rand import uniform
from .arrays import let

# Markup that is dropped, marks whose runs collapse, and symbols spelled out.
MARKUP = r"<p>|<strong>|><p>|<br>|<em>|<span>|\[unreadable\]"
RUNS = "-$%&'+,./:;?!@[]\\_’\"="
SPELLED = {"&": " and ", "/": " slash ", "@": " at ", "\\": " backslash ", "+": " plus ", "%": " percent ", "=": " equals "}
BLANKED = "()<>{}[]^_|~-"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: the well-known public pattern of web addresses, brackets nested once, with
# possessive repeats, so that no text makes it try the same characters again and again.
URL = r"""(?i)\b(?:https?://|www\d{0,3}[.]|[a-z0-9\-]++(?:[.][a-z0-9\-]++)*+(?<=[.][a-z]{2,4})/)(?:[^\s()<>]|\((?:[^\s()<>]|\([^\s()<>]*+\))*+\))*(?:[^\s()<>`!\[\]{};:'".,?«»“”‘’]|\((?:[^\s()<>]|\([^\s()<>]*+\))*+\))"""
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"


# Fixed value: what Windows-1252 has at 0x80 to 0x9F, but for the five places it leaves open.
CP1252 = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
CP1252_AT = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
#: A text that, byte for byte, is UTF-8 with something beyond ASCII in it.
_UTF8 = r"(?:[\x00-\x7f]|[\x{c2}-\x{df}][\x{80}-\x{bf}]|[\x{e0}-\x{ef}][\x{80}-\x{bf}]{2}|[\x{f0}-\x{f4}][\x{80}-\x{bf}]{3})"
_EMOJI = re.compile("[\U0001f300-\U0001faff\u2600-\u27bf]\ufe0f?")


def repaired_text(c: Column) -> Column:
    """A text whose UTF-8 was read as Windows-1252, once or twice, read again; others and
    those that can't be read again stay. All of it is done by built-in functions."""


    def once(x: Column) -> Column:
        # Most texts have no character that broken ones begin with.
        return F.when(x.rlike(r"[\x{c2}-\x{f4}]"), let(F.translate(x, CP1252, CP1252_AT), lambda y: F.when(y.rlike(rf"^{_UTF8}*+$"), F.decode(F.encode(F.when(y.rlike(rf"^{_UTF8}*+$"), y), "ISO-8859-1"), "UTF-8")).otherwise(x))).otherwise(x)

    return let(let(c, once), once)


def name_emoji(t: str | None) -> str | None:
    """Emoji as their names in brackets, without blanks."""
    return t and _EMOJI.sub(lambda m: "[" + unicodedata.name(m[0][0], "emoji").lower().replace(" ", "") + "]", t)


#: Each emoji and its name, as one text for str_to_map().
_EMOJI_NAMES = "\n".join(f"{chr(c)}\t{name_emoji(chr(c))}" for r in (range(0x2600, 0x27C0), range(0x1F300, 0x1FB00)) for c in r)
_ONE_EMOJI = r"([\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}])"


def named_emoji(c: Column) -> Column:
    """Emoji as their names in brackets: each different one of a text is replaced by its name."""
    names = F.str_to_map(F.lit(_EMOJI_NAMES), F.lit("\n"), F.lit("\t"))

    def name(x: Column) -> Column:
        there = F.array_distinct(F.regexp_extract_all(x, F.lit(_ONE_EMOJI), 1))
        return F.aggregate(there, F.regexp_replace(x, _ONE_EMOJI + r"\x{FE0F}", "$1"), lambda t, e: F.replace(t, e, F.element_at(names, e)))

    return let(c, lambda x: F.when(x.rlike(_ONE_EMOJI), name(x)).otherwise(x))


# The usual Latin spelling of letters and signs without a decomposition into one.
SPELLINGS = {
    **dict(zip("\u0410\u0411\u0412\u0413\u0414\u0415\u0417\u0418\u0419\u041a\u041b\u041c\u041d\u041e\u041f\u0420\u0421\u0422\u0423\u0424\u042b\u042d", "ABVGDEZIIKLMNOPRSTUFYE")),
    **dict(zip("\u0430\u0431\u0432\u0433\u0434\u0435\u0437\u0438\u0439\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442\u0443\u0444\u044b\u044d", "abvgdeziiklmnoprstufye")),
    "\u0416": "Zh", "\u0425": "Kh", "\u0426": "Ts", "\u0427": "Ch", "\u0428": "Sh", "\u0429": "Shch", "\u042e": "Iu", "\u042f": "Ia", "\u0401": "Io", "\u042a": "'", "\u042c": "'",
    "\u0436": "zh", "\u0445": "kh", "\u0446": "ts", "\u0447": "ch", "\u0448": "sh", "\u0449": "shch", "\u044e": "iu", "\u044f": "ia", "\u0451": "io", "\u044a": '"', "\u044c": "'",
    **dict(zip("\u0391\u0392\u0393\u0394\u0395\u0396\u0397\u0399\u039a\u039b\u039c\u039d\u039e\u039f\u03a0\u03a1\u03a3\u03a4\u03a5\u03a9", "ABGDEZEIKLMNXOPRSTUO")),
    **dict(zip("\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b9\u03ba\u03bb\u03bc\u03bd\u03be\u03bf\u03c0\u03c1\u03c3\u03c2\u03c4\u03c5\u03c9", "abgdezeiklmnxoprsstuo")),
    "\u0398": "Th", "\u03a6": "Ph", "\u03a7": "Kh", "\u03a8": "Ps", "\u03b8": "th", "\u03c6": "ph", "\u03c7": "kh", "\u03c8": "ps",
    "\u00c6": "AE", "\u00e6": "ae", "\u0152": "OE", "\u0153": "oe", "\u00df": "ss", "\u00de": "Th", "\u00fe": "th", "\u00d0": "D", "\u00f0": "d", "\u00d8": "O", "\u00f8": "o", "\u0141": "L", "\u0142": "l", "\u0110": "D", "\u0111": "d", "\u0131": "i",
    "\u2026": "...", "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u201c": '"', "\u201d": '"', "\u201e": ",,", "\u2010": " ", "\u2011": " ", "\u2012": " ", "\u2013": " ", "\u2014": "  ", "\u2022": "*", "\u00b7": "*", "\u00a1": "!", "\u00bf": "?", "\u00ab": "  ", "\u00bb": "  ", "\u2039": " ", "\u203a": " ",
    "\u00a9": " c ", "\u00ae": " r ", "\u2122": " tm ", "\u20ac": "EUR", "\u00b0": "deg", "\u00d7": "x", "\u00f7": "/", "\u00b1": "+ ", "\u00bd": "1/2", "\u00bc": "1/4", "\u00be": "3/4", "\u00b2": "2", "\u00b3": "3", "\u00b9": "1", "\u00b5": "u", "\u00a0": " ", "\u200b": "", "\u200d": "", "\ufe0f": "", "\u00ad": "", "`": "'",
}


def fold_table() -> tuple[str, str, dict[str, str]]:
    """Characters and their single plain letters for translate(), with those that vanish at
    the end, and the ones that need several letters."""
    one: dict[str, str] = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            one[chr(cp)] = " " if plain in BLANKED else plain
    # Greek and Cyrillic letters with marks go by those without.
    marked = {c: SPELLINGS[b] for c in map(chr, [*range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x1F00, 0x2000)]) if c not in SPELLINGS and (b := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) in SPELLINGS}
    spelled = {**SPELLINGS, **marked}
    one |= {c: " " for c in BLANKED} | {k: v for k, v in spelled.items() if len(v) == 1}
    gone = [chr(c) for c in range(0x300, 0x370)] + [k for k, v in spelled.items() if v == ""]
    return "".join([*one, *gone]), "".join(one.values()), {k: v for k, v in spelled.items() if len(v) > 1}


FOLD_FROM, FOLD_TO, FOLD_MANY = fold_table()


def fold_ascii(c: Column) -> Column:
    """Letters of Latin, Cyrillic and Greek in plain Latin ones, quotes and signs plain,
    brackets, strokes and dashes as blanks. Letters of other scripts stay."""

    some = "([" + "".join(FOLD_MANY) + "])"
    spelled = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in FOLD_MANY.items())), F.lit("\n"), F.lit("\t"))

    def fold(x: Column) -> Column:
        # Of the characters that take several letters, each that a text has is replaced once.
        there = F.array_distinct(F.regexp_extract_all(x, F.lit(some), 1))
        every = F.translate(F.aggregate(there, x, lambda t, k: F.replace(t, k, F.element_at(spelled, k))), FOLD_FROM, FOLD_TO)
        # A text of ASCII alone needs no look-up of each character.
        plain = F.replace(F.regexp_replace(x, "[" + re.escape(BLANKED) + "]", " "), F.lit("`"), F.lit("'"))
        return F.when(x.rlike(r"[^\x00-\x7f]"), every).otherwise(plain)

    return let(c, fold)


def collapse_runs(c: Column) -> Column:
    """Runs of one punctuation mark become one mark."""
    return F.regexp_replace(c, r"([\-$%&'+,./:;?!@\[\]\\_’\"=])\1+", "$1")


def spell_symbols(c: Column) -> Column:
    for k, v in SPELLED.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_emoji(c: Column) -> Column:
    return F.regexp_replace(c, EMOJI, "")


def clean_text(c: Column) -> Column:
    """Broken encodings repaired, emoji named, markup dropped, text folded, runs collapsed,
    symbols spelled out, blanks made single. Null stays null, a blank text becomes ''.
    spelled_numbers() adds the optional last step."""
    return collapse_blanks(spell_symbols(collapse_runs(fold_ascii(F.regexp_replace(named_emoji(repaired_text(c)), MARKUP, "")))))


def spoken_text(df: DataFrame, text: str, name: str, seed: int, *keys: str, share: float = 0.5) -> DataFrame:
    """df with the column `name`: the clean text, with numbers spelled out in a share of the
    rows chosen by hash of the keys."""
    rows = df.withColumn(name, clean_text(F.col(text)))
    return rows.withColumn(name, F.when(uniform(seed, *keys) > 1 - share, spelled_numbers(F.col(name))).otherwise(F.col(name)))


def is_clean(c: Column) -> Column:
    """Only letters, digits, blanks and the marks .,?!' stand in the text."""
    return c.rlike(r"^[ A-Za-z0-9.,?!']*$")


def clean_description(c: Column) -> Column:
    """Emoji named, web addresses made '%', blanks single, line breaks single."""
    c = F.regexp_replace(F.trim(named_emoji(c)), URL, "%")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, " +", " "), r"\s*\n+", "\n"), r"^\s+|\s+$", "")


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
_ORDINAL = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def spell(n: int) -> str:
    """A number in words, below 10^12; larger ones digit by digit."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + ("-" + _ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return _ONES[n // 100] + " hundred" + (" and " + spell(n % 100) if n % 100 else "")
    for size, word in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
        if size <= n < size * 1000:
            rest = n % size
            return spell(n // size) + " " + word + ("" if not rest else (" and " if rest < 100 else ", ") + spell(rest))
    return " ".join(_ONES[int(d)] for d in str(n))


def ordinal(n: int) -> str:
    words = spell(n)
    head, sep, last = re.match(r"(.*?)([- ]?)(\w+)$", words).groups()
    return head + sep + (_ORDINAL.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th"))


def clock(hours: int, minutes: int) -> str:
    if not minutes:
        return spell(hours)
    return f"{spell(hours)} oh {spell(minutes)}" if minutes < 10 else f"{spell(hours)} {spell(minutes)}"


# What is spelled out, in this order.
SPOKEN = {
    r"\$(\d+)(\.\d+)?": lambda m: spell(int(m[1])) + " dollars",
    r"(\d+)(?:rd|nd|th|st)": lambda m: ordinal(int(m[1])),
    r"\b(\d{1,2}):(\d\d)\b": lambda m: clock(int(m[1]), int(m[2])),
    r"\d+": lambda m: spell(int(m[0])) if len(m[0].lstrip("0")) < 3 else m[0],
}


def spell_text(t: str | None) -> str | None:
    """Money, ordinals, clock times and numbers below 100 in words."""
    for pattern, speak in SPOKEN.items():
        t = t and re.sub(pattern, speak, t)
    return t


@F.pandas_udf(StringType())
def _spelled(s: pd.Series) -> pd.Series:
    return s.map(spell_text, na_action="ignore")


def spelled_numbers(c: Column) -> Column:
    """Money, ordinals, clock times and numbers below 100 in words. Only texts with a digit
    leave the JVM. Give a column, not an expression with lambdas, which Spark can't hand
    to Python."""
    return F.coalesce(_spelled(F.when(c.rlike(r"\d"), c)), c)


def seconds_of_clock(c: Column) -> Column:
    """HH:MM:SS.mmm (or any number of parts) as seconds; null if it is no clock time."""
    parts = F.transform(F.split(c, ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s * 60 + x)


def clock_of_seconds(c: Column) -> Column:
    """Seconds as HH:MM:SS.mmm: the seconds cut off, the milliseconds rounded from all of
    the number, so 59.9996 gives 00:00:59.000."""
    whole = F.floor(c)
    ms = F.substring_index(F.format_string("%.3f", c.cast("double")), ".", -1)
    return F.when(c.isNotNull(), F.format_string("%02d:%02d:%02d.%s", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, ms))


def strip(c: Column) -> Column:
    """Without white space of any script around it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised_word(c: Column) -> Column:
    """Without ASCII punctuation and outer blanks, in lower case."""
    return F.lower(strip(F.translate(c, PUNCTUATION, "")))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def vowels(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit("[aeiou]"))


def marks(c: Column) -> Column:
    """Characters that are no letter, digit or underscore of any script."""
    return F.regexp_count(c, F.lit(r"(?U)\W"))


def description_tokens(c: Column, most: int = 100) -> Column:
    """The first words without tags, addresses and handles, by single blanks."""
    ok = F.filter(F.split(c, r"\s+"), lambda w: ~(F.contains(w, F.lit("#")) | F.contains(w, F.lit("http")) | F.contains(w, F.lit("@")) | F.contains(w, F.lit("www"))))
    return F.array_join(F.slice(ok, 1, most), " ")


def interval_of(c: Column) -> Column:
    """'a-b' in seconds as struct(a, b); NaN or malformed gives (0, 9999)."""
    p = F.split(c, "-")
    a, b = F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return F.struct(F.when(bad, 0.0).otherwise(a).alias("a"), F.when(bad, 9999.0).otherwise(b).alias("b"))


def infill(c: Column) -> Column:
    """A template with exactly one '_' with the mask in its place; null otherwise."""
    one = F.length(c) - F.length(F.replace(c, F.lit("_"), F.lit(""))) == 1
    return F.when(one, F.replace(F.replace(c, F.lit("_"), F.lit("<|MASK|>")), F.lit(" <|MASK|>"), F.lit("<|MASK|>")))


def fix_tokens(words: Column) -> Column:
    """Words joined to a sentence: endings and marks without a blank before them, '-' and
    ';' dropped, blanks single."""
    s = F.array_join(words, " ")
    s = F.regexp_replace(s, r" n't\b", "n't")
    s = F.regexp_replace(s, r" '(s|re|ve|ll|d|m)\b", "'$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+([.,!?:)])", "$1"), r"[-;]", " ")
    return collapse_blanks(s)


def named_references(refs: Column, names: Column, most: int = 2) -> Column:
    """The names at the first `most` places that a token refers to, joined by 'and'; places
    beyond the names are passed over."""
    return F.array_join(F.array_compact(F.transform(F.slice(refs, 1, most), lambda i: F.get(names, i))), " and ")


def fix_token(c: Column) -> Column:
    """':' becomes a blank except in 'Answer:'."""
    return F.when(c == "Answer:", c).otherwise(F.replace(c, F.lit(":"), F.lit(" ")))


def reversed_noun(c: Column) -> Column:
    """'a:b:c' as 'c b a'."""
    return F.array_join(F.reverse(F.split(c, ":")), " ")


def stable_colour(c: Column) -> Column:
    """Three colour parts of a name: its 256-bit digest modulo 1024, 1023 and 1025, each
    scaled to 0..255. The digest is folded digit by digit."""
    digits = F.split(F.sha2(c, 256), "")
    value = lambda x: F.conv(x, 16, 10).cast("bigint")
    rest = lambda m: F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0).cast("bigint"), lambda s, x: (s * 16 + value(x)) % m)
    return F.array(*[F.floor(rest(m) * 255 / (m - 1)).cast("int") for m in (1024, 1023, 1025)])


def annotation_id(c: Column) -> Column:
    """The first two parts of a name between '-'."""
    return F.concat_ws("-", F.slice(F.split(c, "-"), 1, 2))


def condition_of(c: Column) -> Column:
    """The last part of a name between '_'."""
    return F.element_at(F.split(c, "_"), -1)


def location_text(start: Column, end: Column, duration: Column) -> Column:
    """Where an interval lies in its video: 'a to b' in whole hundredths, cut off."""
    part = lambda x: (x / duration * 100).cast("int").cast("string")
    return F.concat(part(start), F.lit(" to "), part(end))


def searchable_text(title: Column, description: Column, words: Column, most: int = 100) -> Column:
    """Title, the first words of the description without tags, addresses and handles, and the
    transcript's words, one under the other; null parts count as empty."""
    none = F.lit("")
    return F.concat_ws("\n", F.coalesce(title, none), F.coalesce(description_tokens(description, most), none), F.coalesce(F.array_join(words, " "), none))


def qa_id(qid: Column, video: Column) -> Column:
    return F.concat(F.lpad(qid.cast("string"), 6, "0"), F.lit("~"), video)
