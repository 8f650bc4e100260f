"""Long spans that stand letter for letter in more than one record: level-wise doubling.

A window of 2n letters that stands in two records has its windows of n letters in both. So windows
of half the length wanted are looked at first, those whose content occurs in one record only are
dropped, and only where one is repeated is it extended to twice its length; what repeats there is
extended again, until no candidate survives. At the lowest level it is enough to look at one chosen
window of n letters in each window of 2n, the one whose name is least: equal windows choose alike,
so none is lost, and about two places in n are looked at instead of every one. ``shared_spans`` asks
for one length and needs no level above it; ``shared_share`` climbs on to the end.

The text is shuffled once, by record, and read there twice. Each level shuffles its windows once:
the task that makes a window already knows of many that they repeat, and tells this to the rest with
one row, so however often a name stands in the corpus, few rows of it meet in one place.

Names above the lowest level are 128-bit fingerprints; the chance that two different windows of ten
trillion share one is below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.session import cut

#: Letters of a text, and of several texts together, that are held as numbers at a time.
BLOCK = 1 << 20
#: Names that a task remembers from the blocks before.
KEPT_NAMES = 1 << 20
#: Parts over which different texts under one id are spread.
PARTS = 1 << 15
#: A row's place is one number, so that less is shuffled: its start in the low 32 bits, above them how
#: many further starts it stands for (SPREAD at most) and the part, or the text among all of its id.
SPREAD = 1 << 15


def whole_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, texts): the texts of each id, each once; rows with a null id or text are left out.

    Redelivered rows fall together before anything is shuffled. An id has one text as a rule; should
    it have many, they lie in parts by their content, so that no list grows with the table.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.groupBy("id", F.xxhash64("text").bitwiseAND(F.lit(PARTS - 1)).alias("part")).agg(F.sort_array(F.collect_set("text")).alias("texts"))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(1), np.uint64(0x5EED))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _names(letters: np.ndarray, size: int, seed: np.uint64 = _SEEDS[0]) -> np.ndarray:
    """Name of the window of ``size`` letters at each place, itself built by doubling."""
    power, width = _mix(letters * _ODD + seed), 1
    out, done = None, 0
    while True:
        if size & width:
            if out is None:
                out = power
            else:
                n = min(len(out), len(power) - done)
                out = _mix(out[:n] * _ODD + power[done : done + n])
            done += width
        if done == size:
            return out
        power = _mix(power[:-width] * _ODD + power[width:])
        width *= 2


def _least_of(x: np.ndarray, count: int) -> np.ndarray:
    """Least of ``count`` neighbours from each place on."""
    width = 1
    while 2 * width <= count:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == count else np.minimum(x[: len(x) - (count - width)], x[count - width :])


class Meeting:
    """What one task knows of the names it has made.

    A window whose name the task has met in two records is repeated: it gets a salt above 0, that of
    its block, which keeps it out of the crowd, and one row of salt 0 tells so to the windows of
    other tasks. All other windows get salt 0. Names of earlier blocks are remembered in a store of bounded size;
    what is forgotten costs further rows of salt 0, never an answer. Tasks read their rows in order
    of the records, so one that is run again gives the same salts.
    """

    def __init__(self, kept: int):
        self.kept = kept
        self.h1, self.h2, self.owner, self.told = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def salted(self, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(salt of each row, numbers of the rows that stand for a name known to be repeated)."""
        salt = np.zeros(len(h1), np.int32)
        if not len(h1):
            return salt, np.zeros(0, np.int64)
        order = np.lexsort((h2, h1))
        a, b, o = h1[order], h2[order], owner[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        low = np.minimum.reduceat(o, first)
        known = low != np.maximum.reduceat(o, first)
        told = np.zeros(len(first), bool)
        if len(self.h1):
            slot = np.minimum(np.searchsorted(self.h1, a[first]), len(self.h1) - 1)
            met = (self.h1[slot] == a[first]) & (self.h2[slot] == b[first])
            told = met & self.told[slot]
            known |= told | (met & (self.owner[slot] != low))
        again = known[group]
        salt[order[again]] = 1 + (int(_mix(h1.sum(keepdims=True))[0]) >> 34)
        self._keep(a[first], b[first], low, known)
        return salt, order[first[known & ~told]]

    def _keep(self, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, told: np.ndarray) -> None:
        gone = np.isin(self.h1, h1)
        old = np.concatenate([np.flatnonzero(self.told & ~gone), np.flatnonzero(~self.told & ~gone)])[: max(0, self.kept - len(h1))]
        both = [np.concatenate([x, getattr(self, n)[old]]) for n, x in (("h1", h1), ("h2", h2), ("owner", owner), ("told", told))]
        order = np.argsort(both[0], kind="stable")
        self.h1, self.h2, self.owner, self.told = (x[order] for x in both)


def _owners(ids: pa.Array) -> np.ndarray:
    return np.fromiter((hash(i) for i in ids.to_pylist()), np.int64, len(ids))


def _blocks(pieces: Iterator[tuple], room: int) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Pieces (text, ...) as arrays of letters, some at a time, each with the pieces it holds."""
    some: list[tuple] = []
    size = 0
    for p in pieces:
        some.append(p)
        size += len(p[0])
        if size >= room:
            yield np.frombuffer("".join(x[0] for x in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), some
            some, size = [], 0
    if some:
        yield np.frombuffer("".join(x[0] for x in some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), some


def _put_out(batch: pa.RecordBatch, rows: np.ndarray, columns: dict[str, np.ndarray], h1: np.ndarray, h2: np.ndarray, owners: np.ndarray, meeting: Meeting) -> pa.RecordBatch:
    """The rows with their salt, and one with ``at`` -1 for each name that the task has come to know as repeated."""
    salt, tell = meeting.salted(h1, h2, owners[rows])
    take = np.concatenate([np.arange(len(rows)), tell])
    columns = {n: x[take] for n, x in columns.items()}
    columns["at"][len(rows) :] = -1
    out = {"id": batch.column(0).take(pa.array(rows[take])), "salt": pa.array(np.concatenate([salt, np.zeros(len(tell), np.int32)]))}
    return pa.RecordBatch.from_pydict(out | {n: pa.array(x) for n, x in columns.items()})


def chosen_windows(records: DataFrame, least: int) -> DataFrame:
    """(id, salt, h1, at): windows of ``least`` letters that start at the places of ``at``, in a row,
    and all choose the window of half their length that is named h1.
    """
    half = (least + 1) // 2
    room, kept = BLOCK, KEPT_NAMES

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, texts in enumerate(batch.column(2).to_pylist()):
            for text in texts:
                for at in range(0, len(text) - least + 1, room):
                    yield text[at : at + room + least - 1], row, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(kept)
        for batch in batches:
            owners, part = _owners(batch.column(0)), batch.column(1).to_numpy()
            for letters, some in _blocks(pieces(batch), room):
                size, row, at = (np.array(x, np.int64) for x in zip(*((len(t), r, a) for t, r, a in some)))
                best = _least_of(_names(letters, half), least - half + 1)
                piece = np.repeat(np.arange(len(size)), size)[: len(best)]
                place = np.arange(len(best)) - (np.cumsum(size) - size)[piece]
                fits = place + least <= size[piece]
                best, piece, place = best[fits], piece[fits], place[fits]
                fresh = np.ones(len(best), bool)
                fresh[1:] = (best[1:] != best[:-1]) | (piece[1:] != piece[:-1]) | (place[1:] % SPREAD == 0)
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(best)) - 1
                h1, rows = best[first], row[piece[first]]
                columns = {"h1": h1.view(np.int64), "at": (part[rows] << 47) + ((last - first) << 32) + at[piece[first]] + place[first]}
                yield _put_out(batch, rows, columns, h1, np.zeros_like(h1), owners, meeting)

    return records.sortWithinPartitions("id", "part").mapInArrow(run, f"id {_kind(records)}, salt int, h1 bigint, at bigint")


def extended(candidates: DataFrame, records: DataFrame, least: int, tell_texts: bool) -> DataFrame:
    """(id, salt, h1, h2, at): the windows of ``least`` letters that start at the places of a candidate
    (id, at), named by the two windows of half their length that they are made of. ``tell_texts``:
    the place says also in which of the texts of the id.
    """
    half = (least + 1) // 2
    apart = least - half
    room, kept = BLOCK, KEPT_NAMES
    spots = candidates.groupBy("id", F.shiftright("at", 47).alias("part")).agg(F.collect_set("at").alias("spots"))
    held = records.join(spots, ["id", "part"]).select("id", "part", "texts", "spots")

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, (texts, spots) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            runs: list[list[int]] = []
            for lo, more in sorted((s & 0xFFFFFFFF, s >> 32 & SPREAD - 1) for s in spots):
                hi = lo + more
                if runs and lo <= runs[-1][1] + 1:
                    runs[-1][1] = max(hi, runs[-1][1])
                else:
                    runs.append([lo, hi])
            for n, text in enumerate(texts):
                for lo, hi in runs:
                    for at in range(lo, min(hi, len(text) - least) + 1, room):
                        yield text[at : min(hi + 1, at + room) + least - 1], row, at, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(kept)
        for batch in batches:
            owners, part = _owners(batch.column(0)), batch.column(1).to_numpy()
            for letters, some in _blocks(pieces(batch), room):
                size, row, at, number = (np.array(x, np.int64) for x in zip(*((len(t), *rest) for t, *rest in some)))
                shorter = [_names(letters, half, seed) for seed in _SEEDS]
                h1, h2 = (_mix(x[: len(x) - apart] * _ODD + x[apart:]) for x in shorter)
                piece = np.repeat(np.arange(len(size)), size)[: len(h1)]
                place = np.arange(len(h1)) - (np.cumsum(size) - size)[piece]
                fits = place + least <= size[piece]
                h1, h2, piece, place = h1[fits], h2[fits], piece[fits], place[fits]
                rows = row[piece]
                text = (part[rows] + PARTS * number[piece]) << 32 if tell_texts else 0
                columns = {"h1": h1.view(np.int64), "h2": h2.view(np.int64), "at": text + at[piece] + place}
                yield _put_out(batch, rows, columns, h1, h2, owners, meeting)

    return held.sortWithinPartitions("id", "part").mapInArrow(run, f"id {_kind(records)}, salt int, h1 bigint, h2 bigint, at bigint")


def _kind(records: DataFrame) -> str:
    return records.schema["id"].dataType.simpleString()


def repeated(windows: DataFrame, *name: str) -> DataFrame:
    """The windows whose name occurs in more than one record; without their salt and the rows that only tell.

    A window of salt above 0 is known to. Those of salt 0 meet by name, and of a name there are a
    few from each task at most, as ``Meeting`` says; the frame is as bounded as the number of tasks.
    """
    w = Window.partitionBy(*name, "salt")
    met = (F.col("salt") > 0) | (F.min("at").over(w) < 0) | (F.min("id").over(w) < F.max("id").over(w))
    return windows.withColumn("met", met).where("met and at >= 0").drop("met", "salt")


def doubled(alive: DataFrame, size: int) -> DataFrame:
    """(id, salt, h1, h2, at): windows of twice ``size`` letters both of whose halves are alive, named by the halves.

    The window is over one record's own places, and as bounded as a record is.
    """
    kept = KEPT_NAMES
    ahead = Window.partitionBy("id", F.shiftright("at", 32)).orderBy("at").rangeBetween(size, size)
    both = alive.select("id", "at", "h1", "h2", F.first("h1").over(ahead).alias("g1"), F.first("h2").over(ahead).alias("g2")).where("g1 is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting = Meeting(kept)
        for batch in batches:
            h1, h2, g1, g2 = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3, 4, 5))
            h1, h2 = _mix(h1 * _ODD + g1), _mix(h2 * _ODD + g2)
            columns = {"h1": h1.view(np.int64), "h2": h2.view(np.int64), "at": batch.column(1).to_numpy()}
            yield _put_out(batch, np.arange(len(h1)), columns, h1, h2, _owners(batch.column(0)), meeting)

    return both.mapInArrow(run, f"id {_kind(alive)}, salt int, h1 bigint, h2 bigint, at bigint")


def shared_windows(records: DataFrame, least: int, tell_texts: bool = False) -> DataFrame:
    """(id, h1, h2, at) of the windows of ``least`` letters that stand in more than one record.

    Two levels: chosen windows of half the length, and those that repeat extended to the whole of it.
    """
    return repeated(extended(repeated(chosen_windows(records, least), "h1"), records, least, tell_texts), "h1", "h2")


def levels(records: DataFrame, least: int = 50) -> Iterator[tuple[int, DataFrame]]:
    """(length, windows that repeat at it) from ``least`` on, doubled until no candidate survives.

    Each level is checkpointed, since the next one and the caller both read it.
    """
    size, alive = least, cut(shared_windows(records, least, tell_texts=True))
    while not alive.isEmpty():
        yield size, alive
        alive = cut(repeated(doubled(alive, size), "h1", "h2"))
        size *= 2


def merged_spans(windows: DataFrame, size: int) -> DataFrame:
    """(id, span_start, span_stop): maximal runs of letters covered by windows of ``size`` letters.

    A record's places are gathered as one set, which its length bounds.
    """
    places = windows.groupBy("id").agg(F.array_sort(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))).alias("p"))
    p = F.col("p")
    starts = F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, i - 1) + size))
    stops = F.transform(F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + size)), lambda x: x + size)
    return places.select("id", F.inline(F.arrays_zip(starts.alias("span_start"), stops.alias("span_stop"))))


def shared_spans(df: DataFrame, id_col: str, text_col: str, least: int = 50) -> DataFrame:
    """(id, span_start, span_stop): maximal runs of letters of a record that lie in some window of
    ``least`` letters which also stands in another record.

    Counted from 0, stop exclusive; same letters, no reverse complement. Repeats within one record
    do not count, nor do rows delivered again. Where one id has several texts, a place counts if it
    is shared in any of them. Rows with a null id or text are left out; records shorter than
    ``least`` have no span; other columns are not read.
    """
    found = merged_spans(shared_windows(whole_records(df, id_col, text_col), least), least)
    return found.select(F.col("id").alias(id_col), F.col("span_start").cast("int").alias("span_start"), F.col("span_stop").cast("int").alias("span_stop"))


def shared_share(df: DataFrame, id_col: str, text_col: str, least: int = 50) -> DataFrame:
    """(id, n_letters, n_shared, longest): for every record how much of it is shared elsewhere.

    ``longest`` is the greatest length least, 2*least, 4*least... of which a whole window is shared,
    0 for a record that shares nothing. Records with the empty text come out with zeros. Where one
    id has several texts, ``n_letters`` is that of the longest.
    """
    records = whole_records(df, id_col, text_col)
    out = records.groupBy("id").agg(F.max(F.array_max(F.transform("texts", F.length))).alias("n_letters"))
    parts, reach = None, None
    for size, alive in levels(records, least):
        top = alive.select("id").distinct().select("id", F.lit(size).alias("size"))
        reach = top if reach is None else reach.unionByName(top)
        if parts is None:
            parts = merged_spans(alive, least).groupBy("id").agg(F.sum(F.col("span_stop") - F.col("span_start")).alias("n_shared"))
    if parts is None:
        return out.select(F.col("id").alias(id_col), "n_letters", F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).alias("longest"))
    reach = reach.groupBy("id").agg(F.max("size").alias("longest"))
    return (
        out.join(parts, "id", "left")
        .join(reach, "id", "left")
        .select(F.col("id").alias(id_col), "n_letters", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), F.coalesce("longest", F.lit(0)).alias("longest"))
    )
