"""Template residue, filler, error pages and script notices.

Labelled exemplars (residue_exemplars) are kept in an inverted index. A document is cut into
passage windows, one for each sentence or line, and the terms of a window retrieve the
exemplars that share one. Two kinds of exemplars are compared by TF-IDF containment:

- Of an exemplar in the window: unfilled slots and missing values, which are residue even
  among real sentences. Their terms are shapes: "{{ user.name }}" and "{{ guest.city }}" are
  one term, "by [artist]" and "by [guest]" another, so names of slots don't matter.
- Of the window in the exemplars of one label (the best few together): pages that are
  filler, an error or a notice as a whole. Terms are words, equals taken as one, and pairs of
  neighbouring words, so a window must hold an exemplar's phrases and not only its words
  (but for bags of words, as of Latin filler). Exemplars of talk about such things compete.

A document is a case if a window holds residue and no word of code or templates, or if pages
cover nearly all of its letters. Document frequencies are counted over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import residue_exemplars as E

#: Share of a residue exemplar's weight that a window must hold.
CONTAINED = 0.8
#: Share of a window's weight that exemplars of a page must hold, and how many may share in it.
PAGE, TOGETHER = 0.62, 4
#: Share of a document's letters that filler, errors and notices must cover.
COVERED = 0.8
#: Terms of a window, and the step between windows of a long passage.
WINDOW, STEP = 32, 16

_SLOT = re.compile(
    r"(?P<open>\{\{\{?|\{%|<%[=-]?|[$#]\{|\{|\*\||\[\[|\[|\(\((?!\()|%%|@@|##|__|[%$|]|<(?![/%\s]))[ ]*"
    r"(?P<name>[^\W_][^{}\[\]<>%$@#|*()\n]*?)[ ]*"
    r"(?P<close>\}\}\}?|%\}|%>|\}|\|\*|\]\]|\]|\)\)|%%|@@|##|__|[%$|]|(?<![-=/])>)"
)
_PAIRS = {"{{{": "}}}", "{{": "}}", "{%": "%}", "<%": "%>", "<%=": "%>", "<%-": "%>", "${": "}", "#{": "}", "{": "}", "*|": "|*", "[[": "]]", "[": "]", "((": "))", "%%": "%%", "@@": "@@", "##": "##", "__": "__", "%": "%", "$": "$", "|": "|", "<": ">"}
#: Openings whose content must be one word.
_TIGHT = frozenset("% $ | __ @@ ## %%".split())
_CODE_BEFORE = re.compile(r"(?:[\w\\=(:/&]|\b(?:import|export|const|let|var)\s+)$")
_JOINED = re.compile(r"[^\W_]+(?:[._-][^\W_]+)+|[a-z]+(?:[A-Z][a-z]+)+")
_LAST_WORD = re.compile(r"(?:([^\W\d_]+)[\"'`\u201c\u2018(,]*|([:$]))\s*[\"'`\u201c\u2018]?$")
_OBJECT = re.compile(r"\[object object\]", re.I)
_ABSENT = re.compile(r"(?i)\b(?:null|undefined|nan|none)\b")
_BLOCK = re.compile(r"</?(?:html|body|head|div|p|h\d|li|ul|ol|br|tr|td|table|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<\|[^|\n]*\|>|\d\d:\d\d:\d\d\.\d{3}|-->|&[a-z]+;")
_CUT = re.compile(r"[\n\r]+|(?<=[.!?])\s+")
# Words; a break between words that are no neighbours is the empty word.
_WORD = re.compile(r"\w*\d\w*|[^\W\d_]+|[^\w\s'\u2019,.!?_-]|(?<=\s)[-\u2013](?=\s)")
_ACCENT = re.compile("[\u0300-\u036f]+")
_SIGNS = re.compile(r"[\[\]{}<>%@|#$]|__|\(\(")
_UNFILLED = ("null", "undefined", "nan", "none")
_TO_FILL = ("todo", "tbd", "goes here")
_NOTE = frozenset(E.NOTES)


def _kind_of(name: str) -> str | None:
    """The shape of what stands in a slot: one word by its case, joined words, several
    words, a number; None for lists and sentences."""
    if name.isdigit():
        return "0" if len(name) < 3 else None
    if _JOINED.fullmatch(name):
        return "a_b"
    words = name.split(" ")
    if len(words) > 1 and words[0].lower() in E.FIRST:
        return "a b"
    if not all(w.replace("'", "").isalpha() for w in words if w):
        return None
    if len(words) == 1:
        return "A" if len(name) > 1 and name.isupper() else "a" if name.islower() else "Aa"
    return "a b"


def _is_note(words: list[str]) -> bool:
    return words[0] not in E.FIRST and any(w in _NOTE or w.endswith("ing") for w in words)


def slots(part: str) -> list[str]:
    """The terms of a passage's unfilled slots and missing values.

    A slot gives its shape ("{a_b}"), its shape with the word before it ("by [a]"), and,
    where it holds several words, its first and last word ("[insert ..", ".. name]").
    Notes of captions, markup and what is glued to code give none.
    """
    out: list[str] = []
    low = part.lower()
    at = 0
    while m := _SLOT.search(part, at):
        opening, name, closing = m["open"], m["name"], m["close"]
        kind = _kind_of(name)
        if _PAIRS[opening] != closing or kind is None or (opening in _TIGHT and " " in m[0]):
            at = m.start() + 1
            continue
        at = m.end()
        words = [w.lower() for w in re.findall(r"[^\W\d_]+", name)]
        opening = opening.rstrip("=-")
        if words and opening in ("[", "<", "((", "|") and _is_note(words):
            continue
        if opening == "<" and words and kind != "a b" and (len(name) < 3 and kind != "a_b" or words[0] in E.MARKUP or f"</{name.lower()}" in low):
            continue
        if opening in ("%", "$", "{", "|") and kind == "a" and len(name) < 3:
            continue
        before = part[: m.start()]
        if opening in ("{", "<", "[", "(", "$", "%", "__", "|") and _CODE_BEFORE.search(before):
            continue
        if opening in ("${", "{{") and before.endswith("\\"):
            continue
        shape = opening + kind + closing
        out.append(shape)
        if w := _LAST_WORD.search(before):
            out.append(f"{(w[1] or w[2]).lower()} {shape}")
        if len(words) > 1:
            out.append(f"{opening}{words[0]} ..")
        if words:
            out.append(f"{opening}.. {words[-1]}{closing}" if opening not in ("[", "<", "((", "__", "|", "%", "[[") or words[-1] in _FIELDS else "")
    for m in _ABSENT.finditer(part):
        before, after = part[: m.start()], part[m.end() :]
        value = m[0].lower()
        if before[-1:] in "\"'`\u201c\u2018" and before:
            before = before[:-1]
        if (w := _LAST_WORD.search(before)) and not re.match(r"\w|\s*[(.]\w", after):
            out.append(f"{(w[1] or w[2]).lower()} {value}")
        if w := re.match(r"\s*([^\W\d_]+)", after):
            out.append(f"{value} {w[1].lower()}")
        elif re.match(r"\s*[%/]", after):
            out.append(f"{value} of")
    if _OBJECT.search(part):
        out.append("[object]")
    return [t for t in out if t]


_FIELDS = frozenset(E.FIELD)


def residue_exemplars() -> list[frozenset[str]]:
    """The terms of each exemplar of a slot or missing value: the most telling one."""
    out = [frozenset(["[object]"])]
    for a, b in zip(E.SURE[::2], E.SURE[1::2]):
        out += [frozenset(slots(f"{a}{n}{b}")[:1]) for n in E.NAMES]
    for a, b in zip(E.LOOSE[::2], E.LOOSE[1::2]):
        out.append(frozenset(slots(f"{a}{E.JOINED}{b}")[:1]))
        out += [frozenset([f"{a}{w} .."]) for w in E.FIRST]
        out += [frozenset([f"{a}.. {f}{b}"]) for f in E.FIELD]
    for w in E.AFTER:
        out += [frozenset(t for t in slots(f"{w} {s}") if t.startswith(w + " ")) for s in E.OPEN]
    for line in E.MISSING.strip().split("\n"):
        out.append(frozenset([line]))
    return sorted({x for x in out if x}, key=sorted)


def plain(text: str) -> str:
    """NFKC, block markup as line breaks."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _BLOCK.sub("\n", text) if "<" in text else text


_SAME = {w: k for k, ws in E.SAME.items() for w in ws.split()}


def words_of(part: str) -> list[str]:
    """Words in lower case without accents, equals as one; tags, cue times, numbers and
    marks that part words give an empty word, which breaks pairs."""
    if "<" in part or "&" in part or ":" in part:
        part = _TAG.sub(" | ", part)
    part = part.lower()
    if not part.isascii():
        part = _ACCENT.sub("", unicodedata.normalize("NFD", part))
    return [_SAME.get(w, w if w.isalpha() else "") for w in _WORD.findall(part)]


def windows(part: str) -> Iterator[tuple[list[str], int]]:
    """The words of a passage, in overlapping windows if they are many, each with the number
    of letters that no window before it has."""
    words = words_of(part)
    if len(words) <= WINDOW + STEP:
        if any(words):
            yield words, sum(map(len, words))
        return
    for i in range(0, len(words) - STEP, STEP):
        new = words[i : i + WINDOW] if i == 0 else words[i + WINDOW - STEP : i + WINDOW]
        yield words[i : i + WINDOW], sum(map(len, new))


def _pairs(words: list[str] | tuple[str, ...]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in zip(words, words[1:]) if a and b]


def may_hold_residue(text: str) -> bool:
    """Whether a text has any sign or word that residue begins with."""
    if _SIGNS.search(text):
        return True
    low = text.lower()
    return any([w in low for w in _UNFILLED]) or any([w in low for w in _TO_FILL])


class Index:
    """The inverted index of the exemplars, weighted by inverse document frequency."""

    def __init__(self, counts: dict[str, int], documents: int):
        # Slots and missing values: exemplars of one term, each as rare as a term can be.
        self.slots: dict[str, list[frozenset[str]]] = defaultdict(list)
        for s in residue_exemplars():
            for t in s:
                self.slots[t].append(s)
        self.code = frozenset(w for w in words_of(" ".join(E.CODE)) if w)
        self.pages = [(label, frozenset(w) - {""}, frozenset(_pairs(w))) for label in E.PAGES for w in map(words_of, E.lines(label))]
        vocabulary = sorted(set().union(*(s for _, s, _ in self.pages)))
        self.weight = {t: 1 + float(np.log((1 + documents) / (1 + counts.get(t, 0)))) for t in vocabulary}
        self.other = float(np.mean(list(self.weight.values())))
        self.weight[""] = 0.0
        self.by_pair: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for e, (label, words, pairs) in enumerate(self.pages):
            for p in pairs:
                self.by_pair[p].append(e)
            # Bags of words, menus and exemplars of one word are retrieved by words.
            for w in words if label in ("words", "frame") or not pairs else ():
                self.by_word[w].append(e)
        self.bags = frozenset(w for label, s, _ in self.pages if label == "words" for w in s)
        self.label = lru_cache(50_000)(self._label)

    def _label(self, words: tuple[str, ...]) -> str | None:
        """The label whose best exemplars together hold the window, if any does."""
        get, other = self.weight.get, self.other
        w1 = [get(w, other) for w in words]
        size, held = sum(w1), sum([get(w, 0.0) for w in words])
        # Pairs of known words weigh no more than these words do.
        if held < PAGE / (2 - PAGE) * size:
            return None
        at = [i for i in range(len(words) - 1) if words[i] and words[i + 1]]
        w2 = {i: (w1[i] + w1[i + 1]) / 2 for i in at}
        pairs = {i: (words[i], words[i + 1]) for i in at}
        both = sum(w2.values())
        # What stands in no exemplar at all can't be held by one.
        known = held + sum([v for i, v in w2.items() if pairs[i] in self.by_pair])
        if known < PAGE * (size + both) and sum([v for w, v in zip(words, w1) if w in self.bags]) < PAGE * size:
            return None
        by_label: dict[str, set[int]] = defaultdict(set)
        for e in {e for p in pairs.values() for e in self.by_pair.get(p, ())} | {e for w in words for e in self.by_word.get(w, ())}:
            by_label[self.pages[e][0]].add(e)
        best: dict[str, float] = {}
        for label, found in by_label.items():
            mine = sorted(found | by_label.get("frame", set()) if label not in ("frame", "talk") else found)
            bag = label == "words"
            left_w, left_p = {i: v for i, v in enumerate(w1) if v}, {} if bag else dict(w2)
            whole, have = size if bag else size + both, 0.0
            for _ in range(TOGETHER):
                gain, top = max(((sum([v for i, v in left_w.items() if words[i] in self.pages[e][1]]) + sum([v for i, v in left_p.items() if pairs[i] in self.pages[e][2]]), -e) for e in mine), default=(0.0, 0))
                if gain <= 0:
                    break
                _, ws, ps = self.pages[-top]
                left_w = {i: v for i, v in left_w.items() if words[i] not in ws}
                left_p = {i: v for i, v in left_p.items() if pairs[i] not in ps}
                have += gain
            best[label] = have / whole
        if not best:
            return None
        if best.get("frame", 0) >= max(PAGE, *best.values()) - 1e-9:
            return "frame"
        label = max(sorted(best), key=best.get)
        return label if label != "talk" and best[label] >= PAGE else None

    def has_residue(self, part: str) -> bool:
        """Whether a passage holds an exemplar of residue, and none of its words is of code."""
        terms = set(slots(part))
        if any(len(s & terms) >= CONTAINED * len(s) for t in terms for s in self.slots.get(t, ())):
            if self.code.isdisjoint(words_of(part)):
                return True
        low = part.lower()
        return any([w in low for w in _TO_FILL]) and self.label(tuple(words_of(part))) == "residue"

    def is_residue(self, text: str | None) -> bool:
        if not text:
            return False
        marked, page, rest, hit, open_ = may_hold_residue(text), 0, 0, False, True
        text = plain(text)
        for part in _CUT.split(text):
            if marked and may_hold_residue(part) and self.has_residue(part):
                return True
            if open_:
                for words, size in windows(part):
                    label = self.label(tuple(words))
                    if label in ("words", "filler", "script", "error", "frame"):
                        page += size
                        hit = hit or label != "frame"
                    else:
                        rest += size
                    # All the letters still to come could not make up for this.
                    open_ = rest <= (1 - COVERED) * len(text)
                    if not open_:
                        break
            elif not marked:
                break
        return open_ and hit and page >= COVERED * (page + rest)


def document_counts(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Documents that hold each word of the exemplars, and all documents: one row a word comes
    to the driver. Of equal words, the most frequent one counts for all."""
    vocabulary = {w for label in E.PAGES for line in E.lines(label) for w in words_of(line)} | {w for ws in E.SAME.values() for w in ws.split()}
    words = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("text"), r"[^\p{L}\p{N}]+")))
    counted = texts.select(F.explode(words).alias("w")).where(F.col("w").isin(["", *sorted(vocabulary)])).groupBy("w").agg(F.count("*").alias("n"))
    raw = {r["w"]: r["n"] for r in counted.collect()}
    total, out = raw.pop("", 0), {}
    for w, n in raw.items():
        out[_SAME.get(w, w)] = max(n, out.get(_SAME.get(w, w), 0))
    return out, total


def find_residue(documents: DataFrame) -> DataFrame:
    """(doc_id) of every document that is residue, filler, an error page or a notice.
    Null, empty and blank texts are none; equal rows give their id once."""
    texts = documents.where("text is not null and text <> ''").select("doc_id", "text")
    counts, total = document_counts(texts)
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, total)
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column(1).to_pylist()) if index.is_residue(t)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], ["doc_id"])

    return texts.mapInArrow(search, f"doc_id {kind}").distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are no residue, all columns kept; rows with a null doc_id too."""
    found = find_residue(documents).select(F.col("doc_id").alias("_residue"))
    return documents.join(found, F.col("doc_id") == F.col("_residue"), "left_anti")
