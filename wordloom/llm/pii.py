"""Personal information in free text, by a skip-chain conditional random field.

A line's tokens form a chain; equal or similar tokens of one text (of one key, see alike)
that could belong to a name or a number are joined by skip edges from each occurrence to
the next, whose potentials favour equal labels. Node scores are sums of weights of features of the tokens around;
chain weights are fitted by conditional likelihood, skip weights by the agreement that
loopy belief propagation expects against the one seen, both on generated labelled lines
(pii_training), so the model depends on no corpus. Marginals come from loopy message
passing: forward-backward along all chains, then messages over the skip edges, again and
again. Lines of a batch are worked on together, by length.
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

from . import pii_training

LABELS = ("O", "E", "P", "I", "A", "N")
#: A part of a name that stands elsewhere in the text in full: redacted, but no full name.
MENTION = "n"
KINDS = {"E": "email", "P": "phone", "I": "id_number", "A": "address", "N": "person_name"}
#: Generated lines and texts for training; more change little.
TRAIN_LINES, TRAIN_TEXTS, EPOCHS = 20000, 400, 7
#: Tokens on either side whose features count.
REACH = 3
#: Rounds of messages over skip edges.
ROUNDS = 3
#: Tokens whose scores a worker keeps.
REMEMBERED = 60_000
_L = len(LABELS)

_DASH = "\\-\u2010\u2011\u2012\u2013"
_TOKEN = re.compile(
    rf"""(?P<url>(?:https?\s?:?\s?-?//|www\.)\S+)
|(?P<mail>[\w.+%-](?:[\w.+%'-]{{0,62}}[\w.+%-])?\s{{0,3}}[@\uff20]\s{{0,3}}[A-Za-z\d-]+(?:\.[A-Za-z\d-]+)+|[\w.+%-]{{1,64}}\s{{0,3}}(?:\[at\]|\(at\)|\bat\b)\s{{0,3}}[\w.-]+\s{{0,3}}(?:\[dot\]|\(dot\)|\bdot\b)\s{{0,3}}[\w-]+(?:\s{{0,3}}(?:\[dot\]|\(dot\)|\bdot\b)\s{{0,3}}[\w-]+)*)
|(?P<handle>[@\uff20][\w.]+)
|(?P<tag>\#[^\W\d]\w*)
|(?P<code>(?<!\w)(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z\d]{{6,}}(?!\w))
|(?P<num>(?:(?<!\w)[A-Za-z]{{1,2}})?[+(]{{0,2}}\d(?:[ ().{_DASH}/]{{0,3}}\d)*(?:[{_DASH}]?[A-Za-z\u00ba]{{1,2}}(?!\w))?)
|(?P<word>[^\W\d_]+(?:['\u2019][^\W\d_]+)*(?:\.(?=\s?[^\W\d_]|[:,]))?)
|(?P<other>\S)""",
    re.X | re.I,
)
_ZERO = re.compile("[\u200b\u200c\u200d\u2060\ufeff]")


def tokenize(line: str) -> list[tuple[str, str, int, int]]:
    """(class, text, start, end) of each token of a line."""
    return [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(line)]


def even(line: str) -> tuple[str, list[int] | None]:
    """The line with plain blanks and without zero-width characters, and the places of
    its characters in the line as it was (None: unchanged)."""
    out = line.replace("\xa0", " ").replace("\r", " ")
    if not _ZERO.search(out):
        return out, None
    keep = [i for i, c in enumerate(out) if not _ZERO.match(c)]
    return "".join(out[i] for i in keep), keep


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]", "L", re.sub(rf"[{_DASH}]", "-", re.sub(r"\d", "d", s)))


_GIVEN = frozenset(pii_training.GIVEN)


@lru_cache(REMEMBERED)
def features(cls: str, s: str) -> tuple[str, ...]:
    """What a token says about itself; used at each place around."""
    low = s.lower()
    if cls == "word":
        bare = low.rstrip(".")
        body = s.rstrip(".")
        form = "1" if len(body) == 1 else "X" if body.isupper() else "x" if body.islower() else "Xx" if body[:1].isupper() and body[1:].islower() else "mix"
        out = ["w=" + low, "form=" + form, f"{form}{min(len(body), 9)}"]
        if bare in _GIVEN:
            out.append("given")
        if len(bare) > 5:
            out.append("s3=" + bare[-3:])
        return tuple(out)
    if cls in ("num", "code"):
        sh = _shape(s)
        n = sh.count("d")
        return (cls, "sh=" + sh, f"n={min(n, 14)}", "lead=" + s[0] if s[0] in "+(0" else "lead=d", "tail=" + ("L" if sh[-1] == "L" else "d"), "head=" + ("L" if sh[0] == "L" else "d"), f"groups={min(len(re.findall('d+', sh)), 6)}")
    if cls == "mail":
        return ("c=mail", "top=" + re.split(r"[.\s)\]]", low)[-1], "at" if "@" in s or "\uff20" in s else "spelled", "tight" if " " not in s else "loose")
    if cls == "other":
        return ("p=" + (s if s.isascii() else "\u00a4"),)
    return ("c=" + cls,)


def _lines_of(parts: list) -> tuple[list, list[int]]:
    """The tokens of a labelled line and their label numbers."""
    text, spans = "", []
    for s, x in parts:
        if x:
            spans.append((len(text), len(text) + len(s), LABELS.index(x)))
        text += s
    toks, lab = tokenize(text), []
    for _, _, a, b in toks:
        lab.append(next((y for p, q, y in spans if a < q and b > p), 0))
    return toks, lab


class Model:
    """Weights by offset and feature, transitions, and skip potentials."""

    def __init__(self, weights: dict, trans: np.ndarray, start: np.ndarray, skip: np.ndarray, known: frozenset):
        self.weights, self.trans, self.start, self.skip, self.known = weights, trans, start, skip, known
        self.cache: dict = {}

    def part(self, cls: str, s: str) -> np.ndarray:
        """A token's scores for the labels at each place around it, (2 REACH + 1) x labels."""
        key = (cls, s)
        got = self.cache.get(key)
        if got is None:
            got = np.zeros((2 * REACH + 1, _L), np.float32)
            for f in features(cls, s):
                w = self.weights.get(f)
                if w is not None:
                    got += w
            if len(self.cache) >= REMEMBERED:
                self.cache.clear()
            self.cache[key] = got
        return got

    def scores(self, lines: list[list]) -> list[np.ndarray]:
        """Node scores of each line."""
        edge = self.weights["<edge>"]
        out = []
        for toks in lines:
            n = len(toks)
            e = np.zeros((n + 2 * REACH, _L), np.float32)
            for i, t in enumerate(toks):
                # Place k of the part belongs to the token k - REACH places before this one.
                e[i : i + 2 * REACH + 1] += self.part(t[0], t[1])[::-1]
            e = e[REACH : REACH + n]
            for k in range(min(REACH, n)):
                e[k] += edge[k]
                e[n - 1 - k] += edge[REACH + k]
            out.append(e)
        return out


def _marginals(scores: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals (lines, length, labels) and summed pair marginals of equal-length
    chains, by forward-backward with scaled probabilities."""
    b, n, _ = scores.shape
    node = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    move = np.exp(trans)
    f, g = np.empty((b, n, _L)), np.ones((b, n, _L))
    x = node[:, 0] * np.exp(start)
    f[:, 0] = x / x.sum(axis=1, keepdims=True)
    for i in range(1, n):
        x = (f[:, i - 1] @ move) * node[:, i]
        f[:, i] = x / x.sum(axis=1, keepdims=True)
    pairs = np.zeros((_L, _L))
    for i in range(n - 2, -1, -1):
        y = node[:, i + 1] * g[:, i + 1]
        x = y @ move.T
        g[:, i] = x / x.sum(axis=1, keepdims=True)
        z = 1.0 / np.maximum(((f[:, i] @ move) * y).sum(axis=1), 1e-300)
        pairs += move * ((f[:, i] * z[:, None]).T @ y)
    p = f * g
    return p / p.sum(axis=2, keepdims=True), pairs


_POSSESSIVE = re.compile("['\u2019]s$")
_VOWELS = re.compile("(?<=.)[aeiouyhw]+")
_DOUBLE = re.compile(r"(.)\1+")


@lru_cache(REMEMBERED)
def alike(cls: str, s: str) -> str | None:
    """The key that equal and similar tokens share: the digits of a number; of a word, its
    letters without accents, case, possessive and full stop, and, where it is long, only its
    first letter and consonants, doubled ones once. None for tokens that give no edges, as
    words in small letters, which would only confirm each other."""
    if cls in ("num", "code"):
        digits = re.sub(r"\D", "", s)
        return digits if len(digits) > 4 else None
    if cls != "word" or len(s) < 3 or s[0].islower():
        return None
    word = _POSSESSIVE.sub("", s.lower().rstrip("."))
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return _DOUBLE.sub(r"\1", _VOWELS.sub("", word)) if len(word) > 5 else word


def _skips(model_known: frozenset, texts: list[list[list]]) -> tuple[np.ndarray, np.ndarray]:
    """Skip edges as places in the row of all tokens: tokens of one text and one key that are
    no common words, each occurrence with the next."""
    a, b, at = [], [], 0
    for lines in texts:
        last: dict[str, int] = {}
        for toks in lines:
            for i, (cls, s, _, _) in enumerate(toks):
                key = alike(cls, s)
                if key is not None and s.lower().rstrip(".") not in model_known:
                    if key in last:
                        a.append(last[key])
                        b.append(at + i)
                    last[key] = at + i
            at += len(toks)
    return np.array(a, np.int64), np.array(b, np.int64)


def beliefs(model: Model, texts: list[list[list]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens of the texts in a row, and the skip edges."""
    lines = [toks for t in texts for toks in t]
    scores = model.scores(lines)
    sizes = np.array([len(x) for x in lines], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(scores) if len(scores) else np.zeros((0, _L), np.float32)
    out = np.zeros((len(flat), _L))
    a, b = _skips(model.known, texts)

    def chains(which: np.ndarray, extra: np.ndarray | None) -> None:
        for n in np.unique(sizes[which]):
            if n == 0:
                continue
            mine = which[sizes[which] == n]
            places = at[mine][:, None] + np.arange(n)
            s = flat[places] if extra is None else flat[places] + extra[places]
            out[places] = _marginals(s, model.trans, model.start)[0]

    chains(np.arange(len(lines)), None)
    if len(a):
        line_of = np.repeat(np.arange(len(lines)), sizes)
        again = np.unique(line_of[np.concatenate([a, b])])
        there, back = np.zeros((len(a), _L)), np.zeros((len(a), _L))  # messages a->b, b->a
        gain = np.expm1(model.skip)
        for _ in range(rounds):
            log = np.log(np.maximum(out, 1e-12))

            def message(frm: np.ndarray, cameback: np.ndarray) -> np.ndarray:
                q = np.exp(log[frm] - cameback)
                q /= q.sum(axis=1, keepdims=True)
                m = np.log1p(gain * q)
                return m - m.mean(axis=1, keepdims=True)

            there, back = message(a, back), message(b, there)
            extra = np.zeros((len(flat), _L))
            np.add.at(extra, b, there)
            np.add.at(extra, a, back)
            chains(again, extra)
    return out, a, b


def train(n_lines: int = TRAIN_LINES, n_texts: int = TRAIN_TEXTS, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """The model from generated lines; the same arguments give the same model."""
    data = [_lines_of(p) for p in pii_training.lines(n_lines, seed)]
    data = [(t, y) for t, y in data if t]
    count: dict[str, int] = defaultdict(int)
    for toks, _ in data:
        for t in toks:
            for f in features(t[0], t[1]):
                count[f] += 1
    names = [f for f, c in count.items() if c >= (3 if not f.startswith(("w=", "s3=")) else 12)]
    number = {f: i for i, f in enumerate(names)}
    width, places = len(names), 2 * REACH + 1
    # Rows of the weight table: feature * places + place, then line ends, then a blank row.
    ends, blank = width * places, width * places + 2 * REACH
    table = np.zeros((blank + 1, _L))
    trans, start = np.zeros((_L, _L)), np.zeros(_L)
    groups: dict[int, list] = defaultdict(list)
    for toks, y in data:
        n, rows = len(toks), []
        own = [[number[f] for f in features(t[0], t[1]) if f in number] for t in toks]
        for i in range(n):
            r = [f * places + REACH + o for o in range(-REACH, REACH + 1) if 0 <= i + o < n for f in own[i + o]]
            r += [ends + i] if i < REACH else []
            r += [ends + REACH + n - 1 - i] if n - 1 - i < REACH else []
            rows.append(r)
        groups[n].append((rows, y))
    batches = []
    for n, many in groups.items():
        for i in range(0, len(many), 128):
            chunk = many[i : i + 128]
            deep = max(len(r) for rows, _ in chunk for r in rows)
            idx = np.full((len(chunk), n, deep), blank, np.int32)
            for j, (rows, _) in enumerate(chunk):
                for k, r in enumerate(rows):
                    idx[j, k, : len(r)] = r
            batches.append((idx, np.array([y for _, y in chunk])))
    rng = np.random.default_rng(seed)
    square, tsquare, ssquare = np.full(table.shape, 1e-6), np.full(trans.shape, 1e-6), np.full(_L, 1e-6)
    for epoch in range(epochs):
        rate = 0.3 / (1 + 0.3 * epoch)
        for k in rng.permutation(len(batches)):
            idx, y = batches[k]
            p, pairs = _marginals(table[idx].sum(axis=2), trans, start)
            gold = np.eye(_L)[y]
            d = gold - p
            flat = idx.reshape(-1, idx.shape[2])
            rows, inverse = np.unique(flat, return_inverse=True)
            inverse = inverse.reshape(flat.shape)
            g = np.zeros((len(rows), _L))
            dd = d.reshape(-1, _L)
            each = np.repeat(np.arange(len(flat)), flat.shape[1])
            for lab in range(_L):
                g[:, lab] = np.bincount(inverse.ravel(), dd[each, lab], len(rows))
            g -= 1e-3 * table[rows]
            square[rows] += g * g
            table[rows] += rate * g / np.sqrt(square[rows])
            table[blank] = 0
            tg = np.zeros((_L, _L))
            np.add.at(tg, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            tg -= pairs
            tsquare += tg * tg
            trans += rate * tg / np.sqrt(tsquare)
            sg = d[:, 0].sum(axis=0)
            ssquare += sg * sg
            start += rate * sg / np.sqrt(ssquare)
    weights = {f: table[i * places : (i + 1) * places].astype(np.float32) for f, i in number.items()}
    weights["<edge>"] = table[ends:blank].astype(np.float32)
    known = frozenset(f[2:].rstrip(".") for f in names if f.startswith("w=")) - _GIVEN
    model = Model(weights, trans, start, np.zeros(_L), known)
    texts, labels = [], []
    for doc in pii_training.documents(n_texts, seed + 1):
        pairs_ = [_lines_of(p) for p in doc]
        texts.append([t for t, _ in pairs_])
        labels += [y for _, ys in pairs_ for y in ys]
    gold = np.array(labels)
    model.skip = np.full(_L, 0.1)
    for step in range(8):
        p, a, b = beliefs(model, texts)
        if not len(a):
            break
        both = p[a] * p[b]
        seen = np.array([((gold[a] == k) & (gold[b] == k)).sum() for k in range(_L)])
        agree = both * np.exp(model.skip)
        agree = agree / (1 - both.sum(axis=1, keepdims=True) + agree.sum(axis=1, keepdims=True))
        model.skip = np.clip(model.skip + 0.5 * (seen - agree.sum(axis=0)) / np.maximum(seen, 20), 0, 3)
    model.cache = {}
    return model


_trained: dict = {}


def default_model() -> Model:
    """The model with the documented sizes, trained once in a process."""
    if "m" not in _trained:
        _trained["m"] = train()
    return _trained["m"]


_TITLE = re.compile(r"(?i)(?:dr|mr|mrs|ms|prof|professor|sir|miss)\.?$")
def _valid(kind: str, toks: list, text: str) -> bool:
    """The form a found stretch must have: a full name or a title and a name, enough
    digits for a number, a number for an address."""
    digits = sum(c.isdigit() for c in text)
    if kind == "E":
        return any(t[0] == "mail" for t in toks)
    if kind == "P":
        return digits >= 7
    if kind == "I":
        return digits >= 5
    if kind == "A":
        return digits >= 1
    return sum(t[0] == "word" and (len(t[1].rstrip(".")) > 1) for t in toks) >= 2


def spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, int, str]]]:
    """Of each text its (line index, start, end, label), places in the line as it stands.
    Parts of names have the label MENTION."""
    tokens, maps, owners = [], [], []
    for text in texts:
        lines, back = [], []
        for k, line in enumerate(text.split("\n")):
            flat, keep = even(line)
            toks = tokenize(flat)
            if toks:
                lines.append(toks)
                back.append((k, keep, flat))
        tokens.append(lines)
        maps.append(back)
    p, _, _ = beliefs(model, tokens)
    best, at, out = p.argmax(axis=1), 0, []
    for lines, back in zip(tokens, maps):
        found, lone, named = [], [], set()
        for toks, (k, keep, flat) in zip(lines, back):
            lab = best[at : at + len(toks)]
            at += len(toks)
            i = 0
            while i < len(toks):
                if lab[i] == 0:
                    i += 1
                    continue
                j = i + 1
                while j < len(toks) and lab[j] == lab[i]:
                    j += 1
                a, b = i, j
                while b - 1 > a and toks[b - 1][0] == "other" and toks[b - 1][1] not in ")":
                    b -= 1
                while a < b - 1 and toks[a][0] == "other" and toks[a][1] not in "(+":
                    a += 1
                s, e = toks[a][2], toks[b - 1][3]
                kind = LABELS[lab[i]]
                place = (k, s if keep is None else keep[s], e if keep is None else keep[e - 1] + 1)
                if _valid(kind, toks[a:b], flat[s:e]):
                    found.append((*place, kind))
                    if kind == "N":
                        named.update(alike(t[0], t[1]) for t in toks[a:b])
                elif kind == "N":
                    lone.append((*place, {alike(t[0], t[1]) for t in toks[a:b]} - {None}))
                i = j
        # A part of a name counts as a mention where the whole name stands in the text.
        found += [(k, s, e, MENTION) for k, s, e, keys in lone if keys & named]
        out.append(found)
    return out


def replaced(text: str, found: list[tuple[int, int, int, str]]) -> str:
    """The text with each stretch replaced by a placeholder of its kind."""
    lines = text.split("\n")
    for k, a, b, kind in sorted(found, reverse=True):
        lines[k] = lines[k][:a] + "[" + KINDS[kind.upper()].upper() + "]" + lines[k][b:]
    return "\n".join(lines)


def tag_texts(rows: DataFrame, key: str, text: str, batch: int = 512) -> DataFrame:
    """(key, found array<struct<line_no, pi_kind>>, redacted) of each row. A null text
    gives an empty list and a null; an empty one stays empty."""
    shared = rows.sparkSession.sparkContext.broadcast(default_model())
    kind = rows.select(f"`{key}`").schema[0].dataType.simpleString()
    item = pa.list_(pa.struct([("line_no", pa.int32()), ("pi_kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rb in batches:
            for i in range(0, rb.num_rows, batch):
                part = rb.slice(i, batch)
                texts = part.column(1).to_pylist()
                got = spans(model, [t or "" for t in texts])
                found = [[{"line_no": k, "pi_kind": x} for k, x in sorted({(k + 1, KINDS[x]) for k, _, _, x in g if x != MENTION})] for g in got]
                red = [None if t is None else replaced(t, g) for t, g in zip(texts, got)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, item), pa.array(red, pa.string())], [key, "found", "redacted"])

    return rows.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, found array<struct<line_no:int,pi_kind:string>>, redacted string")


def video_texts(segments: DataFrame) -> DataFrame:
    """(youtube_id, description): each video's texts, each once, without empty ones."""
    return segments.where("youtube_id is not null and youtube_id <> '' and description is not null and description <> ''").select("youtube_id", "description").distinct()


def personal_lines(segments: DataFrame) -> DataFrame:
    """(youtube_id, line_no, pi_kind), each once."""
    return tag_texts(video_texts(segments), "youtube_id", "description").select("youtube_id", F.explode("found").alias("x")).select("youtube_id", "x.line_no", "x.pi_kind").distinct()


def redacted_descriptions(segments: DataFrame) -> DataFrame:
    """(youtube_id, description) with placeholders instead of personal information."""
    return tag_texts(video_texts(segments), "youtube_id", "description").select("youtube_id", F.col("redacted").alias("description"))
