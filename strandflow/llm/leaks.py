"""Evaluation texts inside training text: spaced-seed hashing.

A mask lays over a span of words and ignores some of them, so a seed survives a changed word under
an ignored place. Seeds of the evaluation items meet seeds of the documents; around each hit the
whole alignment of the two texts is compared word by word, and its longest exact run as well as its
longest stretch with few changed words come out. Nothing is judged by a seed alone.

The documents are only scanned: words are cut and hashed in the JVM, seeds are laid and looked up in
batches of arrays. The items' side is sent to the executors in blocks of a stated number of words,
with one scan per block, so its memory is bounded however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 a word that counts, 0 one that is ignored. Each span of twelve words and each
#: place of a single changed word is left out by one of them.
MASKS = ("110110110110", "101101101101", "011011011011")
#: Masks of eight words for two changed ones: the triples of places that they ignore are the lines of
#: the Fano plane over places 1 to 7, so every two of these are ignored together by one mask. Place 0
#: is never ignored, as a stretch begins with an equal word.
PAIR_MASKS = tuple("1" + "".join("0" if (p - i) % 7 in (0, 1, 3) else "1" for p in range(7)) for i in range(7))
BLOCK_WORDS = 2_000_000
#: Words and hits that a task lays side by side at a time.
ROOM = 2_000_000


def words(text: Column) -> Column:
    """Maximal runs of letters or digits of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def word_codes(text: Column) -> Column:
    """64-bit codes of the words, in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seed(codes: np.ndarray, starts: np.ndarray, mask: str) -> np.ndarray:
    out = np.full(len(starts), np.uint64(len(mask)), dtype=np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ codes[starts + i]) * _ODD
            out ^= out >> np.uint64(29)
    return out


class Items:
    """One block of evaluation items as arrays: words, and for each mask the sorted seeds."""

    def __init__(self, ids: Sequence, codes: Sequence[Sequence[int]], masks: Sequence[str]):
        self.ids = list(ids)
        self.masks = tuple(masks)
        self.size = np.array([len(c) for c in codes], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        flat = [np.array(c, dtype=np.int64).view(np.uint64) for c in codes]
        self.words = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        self.known = np.unique(self.words)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.words)) - self.at[owner]
        self.seeds = []
        for mask in self.masks:
            starts = np.flatnonzero(place + len(mask) <= self.size[owner])
            seeds = _seed(self.words, starts, mask)
            order = np.argsort(seeds, kind="stable")
            self.seeds.append((seeds[order], owner[starts][order], place[starts][order]))


def _stretches(same: np.ndarray, size: np.ndarray, most_changed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of alignments laid end to end (``size`` words each, ``same``: equal or not): the longest run of
    equal words, the longest stretch, equal at both ends, with few changed words, and how many these are.
    """
    n = len(size)
    stop = np.cumsum(size)
    # edges of an alignment: one before it, each changed word, one behind it
    changed = np.flatnonzero(~same)
    of = np.searchsorted(stop, changed, "right")
    owner = np.concatenate([np.arange(n), of, np.arange(n)])
    place = np.concatenate([np.full(n, -1), changed - (stop - size)[of], size])
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    run = np.zeros(n, np.int64)
    inner = owner[1:] == owner[:-1]
    np.maximum.at(run, owner[1:][inner], (place[1:] - place[:-1] - 1)[inner])
    best, few = run.copy(), np.zeros(n, np.int64)
    for k in range(1, most_changed + 1):
        # between edges i and i+k+1 lie k changed words; both ends must be equal words
        if len(place) <= k + 1:
            break
        ok = (owner[k + 1 :] == owner[: -k - 1]) & (place[1 : len(place) - k] - place[: -k - 1] > 1) & (place[k + 1 :] - place[k:-1] > 1)
        wide = np.zeros(n, np.int64)
        np.maximum.at(wide, owner[k + 1 :][ok], (place[k + 1 :] - place[: -k - 1] - 1)[ok])
        longer = wide > best
        best[longer], few[longer] = wide[longer], k
    return run, best, few


def _parts(count: np.ndarray, room: int) -> Iterator[slice]:
    """Slices of a row of counts that sum to ``room`` or hold one count."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + room, "right")))
        yield slice(at, stop)
        at = stop


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1... (count[0] of them), start[1]..."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _hits(values: np.ndarray, owner: np.ndarray, place: np.ndarray, size: np.ndarray, items: Items, room: int) -> np.ndarray:
    """Rows (document row, item, place in document less place in item) of every seed that both have, each once."""
    found, more = np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    if not len(items.known) or not len(values):
        return np.zeros((0, 3), np.int64)
    least, width = int(items.size.max()), int(items.size.max() + size.max() + 1)
    slot = np.minimum(np.searchsorted(items.known, values), len(items.known) - 1)
    usable = items.known[slot] == values
    for mask, (seeds, of, off) in zip(items.masks, items.seeds):
        if not len(seeds) or len(values) < len(mask):
            continue
        n = len(values) - len(mask) + 1
        ok = place[:n] + len(mask) <= size[owner[:n]]
        for i, c in enumerate(mask):
            if c == "1":
                ok &= usable[i : i + n]
        starts = np.flatnonzero(ok)
        own = _seed(values, starts, mask)
        low = np.searchsorted(seeds, own, "left")
        count = np.searchsorted(seeds, own, "right") - low
        hit = np.flatnonzero(count)
        for part in _parts(count[hit], room):
            h = hit[part]
            k, s = _spread(low[h], count[h]), np.repeat(starts[h], count[h])
            more.append((owner[s] * len(items.ids) + of[k]) * width + place[s] - off[k] + least)
            if sum(map(len, more)) > max(room, len(found)):
                found, more = np.unique(np.concatenate([found, *more])), []
    pair, shift = np.divmod(np.unique(np.concatenate([found, *more])), width)
    return np.stack([*np.divmod(pair, len(items.ids)), shift - least], axis=1)


def _scan(shared, item_type: pa.DataType, most_changed: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(size)])
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(values)) - at[owner]
            hits = _hits(values, owner, place, size, items, room)
            row, item, shift = hits.T
            first = np.maximum(shift, 0)
            length = np.minimum(size[row], shift + items.size[item]) - first
            for part in _parts(length, room):
                r, i, n = row[part], item[part], length[part]
                same = values[_spread(at[r] + first[part], n)] == items.words[_spread(items.at[i] + first[part] - shift[part], n)]
                found = _stretches(same, n, most_changed)
                out = [batch.column(0).take(pa.array(r)), pa.array([items.ids[x] for x in i.tolist()], item_type)]
                yield pa.RecordBatch.from_arrays(out + [pa.array(x.astype(np.int32)) for x in found], names=["doc", "item", "run", "overlap", "changed"])

    return run


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    masks: Sequence[str] = MASKS,
    most_changed: int = 2,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, run, overlap, changed) of every document and item with a seed in common.

    ``run`` is the longest run of consecutive words in the alignments looked at, ``overlap`` the longest
    aligned stretch with at most ``most_changed`` changed words, ``changed`` how many it has. A run at
    least as long as the masks is never missed; with ``PAIR_MASKS`` neither is a stretch of eight words
    or more with two changed ones. Null and empty texts have no words; items or documents
    shorter than the masks meet nothing; repeated rows come out once; null ids are passed over.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("id"), word_codes(F.col(text)).alias("w")).where(F.col("id").isNotNull() & (F.size("w") > 0)).distinct()
    total = own.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = max(1, -(-total // max(1, block_words // 2)))
    item_type = pa.from_numpy_dtype(np.int64) if items.schema[item_id].dataType.simpleString() == "bigint" else None
    kinds = (docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString())
    texts = docs.select(F.col(doc_id).alias("doc"), word_codes(F.col(text)).alias("w")).where("doc is not null and size(w) > 0")
    out = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # at most block_words words or so
        shared = spark.sparkContext.broadcast(Items([r.id for r in block], [r.w for r in block], masks))
        part = texts.mapInArrow(_scan(shared, item_type, most_changed, ROOM), f"doc {kinds[0]}, item {kinds[1]}, run int, overlap int, changed int")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max(F.struct("overlap", (-F.col("changed")).alias("less"))).alias("o"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "run", "o.overlap", (-F.col("o.less")).alias("changed"))


def leaked(docs: DataFrame, items: DataFrame, consecutive: int = 12, **options) -> DataFrame:
    """(doc_id, item_id): documents and items with ``consecutive`` words in common, in the same order."""
    if any(len(m) > consecutive for m in options.get("masks", MASKS)):
        raise ValueError("a mask longer than the passage looked for could miss it")
    found = overlaps(docs, items, **options)
    return found.where(F.col("run") >= consecutive).select(*found.columns[:2])
