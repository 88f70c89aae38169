"""Byte-level BPE encoding of whole texts with a public vocabulary.

A piece of text starts as its bytes. A segment tree over the ranks of neighbouring pairs
holds in its root the leftmost pair of lowest rank; merging it changes at most three
leaves, each updated along one path to the root, until the root holds no mergeable
pair. A piece of n bytes so takes n log n steps, also where a text has no blanks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter everywhere below.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: A larger vocabulary file is refused: it goes to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces whose ids a worker remembers, and the longest of them, in bytes.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64
# Fixed value: the pattern that cuts a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it is
    printable Latin-1, else the next letter from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(b) if b not in rest else rest[b] for b in range(256)]


class Encoder:
    """Ids of texts by the vocabulary in a tokenizer file's JSON."""

    def __init__(self, text: str | bytes):
        model = json.loads(text)["model"]
        ids = model["vocab"]
        letters = {c: b for b, c in enumerate(byte_letters())}
        self.byte_ids = [ids[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        sym = [self.byte_ids[b] for b in data]
        n, merges = len(sym), self.merges
        if n < 2:
            return sym
        width = 1
        while width < n:
            width *= 2
        # Leaf i holds (rank of the pair that begins at i) * 2^32 + i; pairs of one rank
        # compare by position, so a node's least value is its leftmost lowest pair.
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m is not None:
                tree[width + i] = m[0] << 32 | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            k = width + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        def pair_at(i: int) -> int:
            j = after[i]
            m = merges.get((sym[i], sym[j])) if j < n else None
            return _NONE if m is None else m[0] << 32 | i

        while tree[1] != _NONE:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            sym[i] = merges[sym[i], sym[j]][1]
            sym[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            update(j, _NONE)
            update(i, pair_at(i))
            if before[i] >= 0:
                update(before[i], pair_at(before[i]))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        out: list[int] = []
        if text:
            known = self.known
            for piece in self.cut.findall(text):
                ids = known.get(piece)
                if ids is None:
                    data = piece.encode("utf-8", "surrogatepass")
                    ids = self.merge(data)
                    if len(data) <= REMEMBERED_BYTES:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; ids that aren't in the vocabulary give nothing."""
        return b"".join(self.bytes.get(i, b"") for i in ids or []).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", directory: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row of df. Empty and null texts get an empty list.
    The vocabulary is read on the driver and sent to the workers, each of which builds
    its encoder once."""
    path = os.path.join(directory, vocabulary)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(shared.value)
        enc = _encoders[path]
        for batch in batches:
            # Texts are taken a few at a time, so that long ones don't pile up as ids.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array([enc.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = df.select(f"`{key}`").schema[0].dataType.simpleString()
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, ids array<int>")
