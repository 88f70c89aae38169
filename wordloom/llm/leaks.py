"""Evaluation texts leaking into training text, by latent semantic retrieval.

Terms are the words of the items, weighted by their inverse document frequency over the
whole corpus. A distributed randomised SVD of TF-IDF passages gives each term a latent
vector; it is fitted on the items and a sample of the documents of bounded size, while all
documents are searched, in one pass for each block of items. The latent vector of a passage
is the sum of its terms' vectors.

- Whole leaks (leaked): passages are windows of twelve words at every word. Sums are held in
  integers, so they don't depend on the order of summing; windows whose vectors fall into one
  cell of random directions are candidates, compared by cosine and then by their longest run
  of common words. A window equal to an item's has the same vector, the same cell and cosine
  1, so no case is lost to the rank or to the sample.
- Paraphrases (near_leaks): passages are longer windows; candidates by cosine are confirmed by
  the longest common subsequence of words and by the answer check, that the rarest terms of
  the item's passage, which answers hang on, stand in the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a passage, which is also the shortest leak.
WINDOW = 12
#: Latent dimensions.
RANK = 32
#: Least cosine of a candidate.
MIN_COSINE = 0.999
#: Words of an item's passage and of a document's, and the steps between them, for paraphrases.
PASSAGE, SCOPE, STRIDE = 24, 36, 12
#: Of paraphrases: least cosine of a candidate, share of the item's passage that must stand in
#: order, number of rarest terms that are checked, and how many must be there.
NEAR_COSINE, IN_ORDER, ANSWER, ANSWERED = 0.5, 0.6, 4, 2
#: Documents of the sample on which the SVD is fitted.
SAMPLE_DOCS = 5_000
#: Characters of items that one block may hold.
BLOCK_CHARS = 4_000_000
#: Words of a document that are searched at a time.
STRETCH = 1 << 15
_SEED = 20
_FIXED = float(1 << 24)

_BREAK = re.compile(r"<[^<>]*>|\d\d:\d\d:\d\d\.\d{3}")
_WORD = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters a-z and digits, without tags and cue times."""
    return _WORD.findall(_BREAK.sub(" ", text.lower())) if text else []


def _encoded(vocabulary: dict[str, int], text: str | None) -> np.ndarray:
    """The term ids of a text's words, -1 for words that no item has."""
    return np.array([vocabulary.get(w, -1) for w in words_of(text)], np.int64)


def _windows(ids: np.ndarray) -> np.ndarray:
    """Starts of the windows of known terms only."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    gone = np.concatenate([[0], np.cumsum(ids < 0)])
    return np.flatnonzero(gone[WINDOW:] == gone[:-WINDOW])


def _passages(lists: list[np.ndarray]) -> np.ndarray:
    """Term ids of texts' passages for the SVD: windows side by side, of known terms."""
    parts = []
    for ids in lists:
        ids = ids[ids >= 0]
        n = len(ids) // WINDOW * WINDOW
        if n:
            parts.append(ids[:n].reshape(-1, WINDOW))
            if n < len(ids):
                parts.append(ids[-WINDOW:].reshape(1, -1))
    return np.concatenate(parts) if parts else np.zeros((0, WINDOW), np.int64)


def _term_sums(texts: DataFrame, vocabulary: dict[str, int], width: int, make) -> np.ndarray:
    """The sum over all partitions of make(passages) -> rows of an array with the given
    number of columns; what comes to the driver has the size of that array, whose rows are
    the terms of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            p = _passages([_encoded(vocabulary, t) for t in batch.column(0).to_pylist()])
            for i in range(0, len(p), 1 << 15):
                x = make(p[i : i + (1 << 15)])
                total = x if total is None else total + x
        if total is not None:
            rows = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(list(total[rows]), pa.list_(pa.float64()))], ["row", "v"])

    parts = texts.mapInArrow(run, "row bigint, v array<double>")
    got = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).collect()
    out = np.zeros((max([r["row"] for r in got], default=-1) + 1, width))
    for r in got:
        out[r["row"]] = r["v"]
    return out


def _grown(a: np.ndarray, rows: int) -> np.ndarray:
    return np.vstack([a, np.zeros((rows - len(a), a.shape[1]))])


def latent_terms(texts: DataFrame, vocabulary: dict[str, int], weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The terms' latent vectors (weighted rows of V) by randomised SVD of the texts' passages.

    One pass projects A'A on random directions; their orthonormal basis Q spans the
    range. A second pass sums (AQ)'(AQ), whose eigenvectors turn Q into V.
    """
    terms = len(weight)
    rank = min(rank, terms)
    omega = np.random.default_rng(_SEED).standard_normal((terms, rank))

    def scatter(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        flat, w = p.ravel(), weight[p].ravel()
        each = np.repeat(np.arange(len(p)), p.shape[1])
        return np.stack([np.bincount(flat, w * rows[each, j], terms) for j in range(rows.shape[1])], axis=1)

    project = lambda p, m: np.einsum("pw,pwk->pk", weight[p], m[p])
    z = _grown(_term_sums(texts, vocabulary, rank, lambda p: scatter(p, project(p, omega))), terms)
    q = np.linalg.qr(z)[0] if z.any() else np.linalg.qr(omega)[0]

    def small(p: np.ndarray) -> np.ndarray:
        b = project(p, q)
        return b.T @ b

    gram = _grown(_term_sums(texts, vocabulary, rank, small), rank)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return weight[:, None] * (q @ vectors[:, np.argsort(-values)])


class Index:
    """The items' windows by cell of their latent vectors."""

    def __init__(self, items: list[tuple[int, np.ndarray]], terms: np.ndarray):
        k = terms.shape[1]
        self.unit = np.rint(terms * _FIXED).astype(np.int64)
        planes = np.random.default_rng(_SEED + 1).integers(-(1 << 12), 1 << 12, (k, 62))
        self.planes = planes.astype(np.int64)
        self.cells = np.rint(terms * (1 << 20)).astype(np.int64) @ self.planes  # a term's part in each direction
        owner, run = [], []
        for item, ids in items:
            at = _windows(ids)
            owner += [item] * len(at)
            run += [ids[i : i + WINDOW] for i in at]
        self.run = np.array(run, np.int64).reshape(-1, WINDOW)
        self.owner = np.array(owner, np.int64)
        cell = self._cell(self.cells[self.run].sum(axis=1))
        order = np.argsort(cell, kind="stable")
        self.cell, self.run, self.owner = cell[order], self.run[order], self.owner[order]
        self.vector = self.unit[self.run].sum(axis=1).astype(float)

    @staticmethod
    def _cell(parts: np.ndarray) -> np.ndarray:
        return (parts > 0) @ (np.int64(1) << np.arange(parts.shape[1], dtype=np.int64))

    def search(self, ids: np.ndarray) -> set[int]:
        """The items of which at least WINDOW consecutive words stand in the document."""
        found: set[int] = set()
        for start in range(0, max(1, len(ids) - WINDOW + 1), STRETCH):
            part = ids[start : start + STRETCH + WINDOW - 1]
            at = _windows(part)
            if not len(at):
                continue
            safe = np.where(part < 0, 0, part)
            sums = np.concatenate([np.zeros((1, self.cells.shape[1]), np.int64), np.cumsum(self.cells[safe], axis=0)])
            cell = self._cell(sums[at + WINDOW] - sums[at])
            lo, hi = np.searchsorted(self.cell, cell, "left"), np.searchsorted(self.cell, cell, "right")
            for i in np.flatnonzero(hi > lo):
                run = part[at[i] : at[i] + WINDOW]
                mine = self.unit[run].sum(axis=0).astype(float)
                cand = np.arange(lo[i], hi[i])
                there = self.vector[cand]
                length = np.linalg.norm(there, axis=1) * np.linalg.norm(mine)
                # Vectors without length have no direction: the run of words decides.
                for j in cand[(there @ mine >= MIN_COSINE * length) | (length == 0)]:
                    if self.owner[j] not in found and longest_common_run(run, self.run[j]) >= WINDOW:
                        found.add(int(self.owner[j]))
        return found


def longest_common_run(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest run of words that stands in both."""
    best, prev = 0, np.zeros(len(b) + 1, np.int64)
    for x in a:
        now = np.zeros(len(b) + 1, np.int64)
        now[1:] = np.where(b == x, prev[:-1] + 1, 0)
        best, prev = max(best, int(now.max())), now
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of two passages."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        # Either what was, or one more at an equal word; then the best so far in the row.
        row[1:] = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row = np.maximum.accumulate(row)
    return int(row[-1])


class NearIndex:
    """The items' passages by their latent vectors."""

    def __init__(self, items: list[tuple[int, np.ndarray]], terms: np.ndarray, weight: np.ndarray):
        self.terms, self.run, owner, answer = terms, [], [], []
        for item, ids in items:
            for i in range(0, max(1, len(ids) - PASSAGE + STRIDE), STRIDE):
                run = ids[i : i + PASSAGE]
                if len(run) >= WINDOW:
                    different = np.unique(run)
                    rare = different[np.argsort(-weight[different], kind="stable")[:ANSWER]]
                    self.run.append(run)
                    owner.append(item)
                    answer.append(rare)
        self.owner = np.array(owner, np.int64)
        self.answer = answer
        self.vector = self._unit(np.array([terms[r].sum(axis=0) for r in self.run]).reshape(-1, terms.shape[1]))
        self.asked = np.zeros(len(terms) + 1, bool)  # the last place is for unknown words
        self.askers: dict[int, list[int]] = {}
        for j, rare in enumerate(answer):
            self.asked[rare] = True
            for t in rare.tolist():
                self.askers.setdefault(t, []).append(j)
        self.least_answer = np.array([min(ANSWERED, len(a)) for a in answer], np.int64)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def candidates(self, ids: np.ndarray, least: float = NEAR_COSINE) -> Iterator[tuple[np.ndarray, int]]:
        """(document passage, place of the item's passage) of at least the given cosine that also
        pass the answer check. Passages without the terms it asks for are left out."""
        starts = np.arange(0, max(1, len(ids) - SCOPE + STRIDE), STRIDE)
        known = np.concatenate([[0], np.cumsum(self.asked[ids])])
        ends = np.minimum(starts + SCOPE, len(ids))
        starts = starts[known[ends] - known[starts] >= ANSWERED]
        if not len(starts) or not len(self.owner):
            return
        for block in range(0, len(starts), 4096):
            at = starts[block : block + 4096]
            parts = [ids[i : i + SCOPE] for i in at]
            mine = self._unit(np.array([self.terms[p[p >= 0]].sum(axis=0) for p in parts]))
            near = mine @ self.vector.T >= least
            for i, p in enumerate(parts):
                # Of the near ones, those whose rarest terms stand here, by postings of terms.
                asked = [j for t in set(p[self.asked[p]].tolist()) for j in self.askers[t]]
                there = np.bincount(np.array(asked, np.int64), minlength=len(self.owner)) >= self.least_answer
                for j in np.flatnonzero(there & near[i]):
                    yield p, int(j)

    def confirmed(self, part: np.ndarray, j: int) -> float:
        """The share of the item's passage that stands in order; 0 if it is too small."""
        share = common_subsequence(self.run[j], part) / len(self.run[j])
        return share if share >= IN_ORDER else 0.0

    def search(self, ids: np.ndarray, least: float = NEAR_COSINE) -> dict[int, float]:
        """The items that stand nearly in the document, each with the greatest share."""
        found: dict[int, float] = {}
        for part, j in self.candidates(ids, least):
            item = int(self.owner[j])
            if found.get(item, 0) < 1:
                share = self.confirmed(part, j)
                if share > found.get(item, 0):
                    found[item] = share
        return found


def _texts(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null and text <> ''")


def term_weights(documents: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """The terms' inverse document frequencies over all documents, and the documents: one row
    a term of the items comes to the driver."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower("text"), _BREAK.pattern, " "), F.lit("([a-z0-9]+)"), 1)
    seen = _texts(documents).select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), words))).alias("w"))
    # Word lists of any size stay in the plan as one set, not as a join.
    counts = {r["w"]: r["n"] for r in seen.where(F.col("w").isin(["", *vocabulary])).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.pop("", 0)
    weight = np.ones(len(vocabulary))
    for w, k in vocabulary.items():
        weight[k] = 1 + np.log((1 + total) / (1 + counts.get(w, 0)))
    return weight, total


def _block(documents: DataFrame, rows: list, near: bool) -> DataFrame | None:
    split = [(r["item_id"], words_of(r["text"])) for r in rows]
    split = [(i, w) for i, w in split if len(w) >= WINDOW]
    if not split:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    items = [(i, np.array([vocabulary[w] for w in ws], np.int64)) for i, ws in split]
    weight, total = term_weights(documents, vocabulary)
    spark = documents.sparkSession
    own = spark.createDataFrame([(" ".join(ws),) for _, ws in split], "text string")
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    sample = _texts(documents).where(F.pmod(F.xxhash64("doc_id", F.lit(_SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    terms = latent_terms(sample.unionByName(own), vocabulary, weight)
    # At most BLOCK_CHARS of items: the index is bounded by a multiple of that.
    shared = spark.sparkContext.broadcast((vocabulary, NearIndex(items, terms, weight) if near else Index(items, terms)))
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, index = shared.value
        for batch in batches:
            docs, hits, shares = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _encoded(vocabulary, t)
                for item in index.search(ids).items() if near else [(i, 1.0) for i in index.search(ids)]:
                    docs.append(d)
                    hits.append(item[0])
                    shares.append(item[1])
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(hits, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "share"])

    return _texts(documents).select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, item_id bigint, share double")


def _found(documents: DataFrame, items: DataFrame, near: bool) -> DataFrame:
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        found = _block(documents, rows, near)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("share")).limit(0)
    return out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each once: the documents in which at least twelve consecutive
    words of an item's text stand consecutively.

    Null, empty and short items never count, nor do null and empty documents. Items with
    equal texts, or sharing a passage, all leak. Rows without item_id are left out.
    """
    return _found(documents, items, False).select("doc_id", "item_id").distinct()


def near_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share), each pair once: the documents with a passage of which the item
    holds at least IN_ORDER of a passage's words in order, and its rarest terms; share is the
    greatest. Nulls, empty and short texts as in leaked()."""
    return _found(documents, items, True).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
