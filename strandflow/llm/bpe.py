"""Byte-pair encoding of a corpus with a public vocabulary, by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token ends its encoding. The tokens that may end a
prefix are the suffix matches of an automaton over the vocabulary; the one that does is the match
whose last token before it, already stored for the shorter prefix, is compatible with it: the two
side by side encode to themselves. Following the stored tokens back from the end gives the ids, in
time linear in the text whatever the piece (merging by rank is not).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces kept encoded by each Python worker; beyond it the store starts anew.
KEPT_PIECES = 400_000
#: Ids after which a batch is put out.
BATCH_IDS = 1 << 22
KEPT_PAIRS = 2_000_000


def _byte_letters() -> dict[str, str]:
    """Letter that stands for a byte in the vocabulary file -> that byte as a Latin-1 character.

    Printable bytes stand for themselves, the others, in order, for the letters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): chr(b) for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Encoder:
    """Exact ids of texts under a byte-level BPE vocabulary file, special tokens being plain text."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = str.maketrans(_byte_letters())
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = [(a.translate(letters), b.translate(letters)) for a, b in merges]
        made = {a + b for a, b in parts}
        self._ids = {t.translate(letters): i for t, i in model["vocab"].items() if len(t) == 1 or t.translate(letters) in made}
        #: Rank at which two tokens merge; the two halves of a token and the rank at which it arises.
        self._rank = {(self._ids[a], self._ids[b]): r for r, (a, b) in enumerate(parts)}
        self._halves = {self._ids[a + b]: (self._ids[a], self._ids[b]) for a, b in parts}
        self._born = {self._ids[a + b]: r for r, (a, b) in enumerate(parts)}
        self._size = {i: len(t) for t, i in self._ids.items()}
        self._suffixes = ahocorasick.Automaton()
        for token, i in self._ids.items():
            self._suffixes.add_word(token, i)
        self._suffixes.make_automaton()
        self._pieces = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int | None]]:
        """The tokens at one end (0 left, 1 right) of a token as it grows, each with the rank that ends it."""
        out = [(token, None)]
        while token in self._halves:
            rank, token = self._born[token], self._halves[token][side]
            out.append((token, rank))
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens side by side encode to themselves.

        They do unless, while both grow, some token at the right end of the one and some token at
        the left end of the other merge before either is used up. Equal ranks go from left to
        right: the left token's own merge comes first, the right token's own merge after.
        """
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        fits, ends = True, self._spine(right, 0)
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in ends:
                r = self._rank.get((a, b))
                if r is not None and (a_ends is None or r < a_ends) and (b_ends is None or r <= b_ends):
                    fits = False
        if len(self._pairs) >= KEPT_PAIRS:
            self._pairs.clear()
        self._pairs[left, right] = fits
        return fits

    def _piece(self, piece: str) -> list[int]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self._ids.get(text)
        if whole is not None:
            return [whole]
        size, compatible = self._size, self.compatible
        last = [-1] * (len(text) + 1)
        at = 0
        for end, token in self._suffixes.iter(text):
            end += 1
            if end == at:  # the one token that ends this prefix is found
                continue
            start = end - size[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end], at = token, end
        out, end = [], len(text)
        while end > 0:
            out.append(last[end])
            end -= size[last[end]]
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and for the empty text."""
        out: list[int] = []
        if not text:
            return out
        known = self._known
        for piece in self._pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._piece(piece)
                if len(piece) <= 64:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out


_LOADED: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Encoder(path, pattern)
    return _LOADED[path, pattern]


def encode_corpus(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row for each row of ``docs``, whole texts, without special tokens.

    Null and empty texts give an empty list, blank texts are encoded as they stand, and strings that
    look like special tokens are ordinary text. Other columns are not read. ``vocabulary`` is a path
    that every executor can read. The plan is a narrow map over the scan: no shuffle, and a worker
    holds one batch of texts, the vocabulary and two stores of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        for batch in batches:
            values: list[int] = []
            ends = [0]
            for row, text in enumerate(batch.column(1), 1):
                values.extend(enc.encode(text.as_py()))
                ends.append(len(values))
                if len(values) >= room or row == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row - len(ends) + 1, len(ends) - 1), ids], names=[id_col, "ids"])
                    values, ends = [], [0]

    room = BATCH_IDS
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
