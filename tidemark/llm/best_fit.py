"""Best-fit packing with a swap-based local search that empties underfull bins.

Texts become token ids where they are read (as in packing), and only their pieces (place, length, checksum) move on. Only a
document longer than a sequence is cut, at multiples of the length; its whole pieces are sequences of their own. All other
pieces are dealt evenly into groups of about GROUP_PIECES, by their rows' numbers, so the groups' number grows with the input and a group's
size does not, whatever ids or texts repeat. Each group is packed by itself:

1. Best fit: the largest first, each into the fullest bin that has room.
2. Local search, while there are more bins than a lower bound: from the emptiest bin on, a piece is moved to another bin, or
   one or two of its pieces are exchanged for one smaller piece of another, whichever adds most to the sum of squared fills. Every step
   increases that sum, so the search ends; fuller bins get fuller, and the emptiest runs empty.

What is left in the emptiest bin of every group is dealt into groups once more, and packed in the same way.

Edge cases: a null or empty text is the end token alone. Very long texts are cut into many pieces. Rows that repeat an
id are documents of their own and get pieces each; a null id is carried as null. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.packing import pieces

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 8192
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long"


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bin of each length, none over size: the largest first, each into the bin with the least room that suffices.

    The rooms that some bin has are the bits of one number, so the least that suffices is its lowest bit from there on.
    """
    bins, by_room, rooms, n = np.zeros(len(lengths), dtype=np.int64), {}, 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if fits := rooms >> length:
            room = length + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, n = size, n, n + 1
        bins[i] = at
        if room > length:
            by_room.setdefault(room - length, []).append(at)
            rooms |= 1 << (room - length)
    return bins


def fewest(lengths: np.ndarray, size: int) -> int:
    """A number of bins that no packing goes below: by what must be held, and by pieces of which no two share a bin."""
    return max(-(-int(lengths.sum()) // size), int((2 * lengths > size).sum()))


class Search:
    """A packing, and the steps that increase its sum of squared fills. Bins that run empty stay, with nothing in them."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, size: int):
        self.lengths, self.bins, self.size = lengths.astype(np.int64), bins.copy(), size
        self.fill = np.bincount(bins, weights=lengths, minlength=int(bins.max(initial=-1)) + 1).astype(np.int64)
        self.items: list[list[int]] = [[] for _ in self.fill]
        for i, b in enumerate(bins.tolist()):
            self.items[b].append(i)

    def score(self) -> int:
        return int((self.fill**2).sum())

    def step(self, source: int) -> bool:
        """The best of: moving a piece of source, exchanging one, or two, for one of another bin. False if none increases the sum."""
        best = (0, -1, (), -1)  # increase, bin, pieces that go, piece that comes
        room, mine = self.size - self.fill, self.items[source]
        open_bins = np.flatnonzero((room > 0) & (self.fill > 0))
        open_bins = open_bins[open_bins != source]
        theirs = np.flatnonzero((room[self.bins] > 0) & (self.bins != source))
        by_length = {int(self.lengths[i]): i for i in mine}  # of equal pieces one is enough
        twice = {int(self.lengths[i]) for i in mine if by_length[int(self.lengths[i])] != i}
        ones = [(x, (i,)) for x, i in by_length.items()]
        names = sorted(by_length)
        twos = [(x + y, (by_length[x], by_length[y])) for a, x in enumerate(names) for y in names[a + 1 :]]
        for x in twice:
            twos.append((2 * x, tuple([i for i in mine if self.lengths[i] == x][:2])))

        def better(gain: np.ndarray, bin_of: np.ndarray, go: tuple, come: np.ndarray | None) -> None:
            nonlocal best
            fits = (gain > 0) & (gain <= room[bin_of])
            rise = np.where(fits, 2 * gain * (self.fill[bin_of] - self.fill[source] + gain), 0)
            at = int(rise.argmax()) if len(rise) else -1
            if at >= 0 and rise[at] > best[0]:
                best = (int(rise[at]), int(bin_of[at]), go, -1 if come is None else int(come[at]))

        for x, go in ones:
            better(np.full(len(open_bins), x), open_bins, go, None)
        for x, go in ones + twos:
            better(x - self.lengths[theirs], self.bins[theirs], go, theirs)
        _, other, go, come = best
        if other < 0:
            return False
        for i in go:
            self._put(i, other)
        if come >= 0:
            self._put(come, source)
        return True

    def _put(self, i: int, to: int) -> None:
        self.items[self.bins[i]].remove(i)
        self.fill[self.bins[i]] -= self.lengths[i]
        self.items[to].append(i)
        self.fill[to] += self.lengths[i]
        self.bins[i] = to

    def run(self, enough: int) -> None:
        """Steps from the emptiest bin on, until no bin has one, or no more than enough bins hold anything."""
        moved = True
        while moved:
            moved = False
            order = np.argsort(self.fill, kind="stable")
            for source in order[(self.fill[order] > 0) & (self.fill[order] < self.size)].tolist():
                if np.count_nonzero(self.fill) <= enough:
                    return
                while 0 < self.fill[source] < self.size and self.step(source):
                    moved = True


def packed_bins(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, none over size. The bins are numbered from 0, the emptiest last."""
    search = Search(lengths, best_fit_decreasing(lengths, size), size)
    search.run(fewest(lengths, size))
    used = np.flatnonzero(search.fill)
    used = used[np.argsort(-search.fill[used], kind="stable")]
    number = np.zeros(len(search.fill), dtype=np.int64)
    number[used] = np.arange(len(used))
    bins = number[search.bins]
    order = np.argsort(bins, kind="stable")
    ahead = np.cumsum(lengths[order]) - lengths[order]
    firsts = np.searchsorted(bins[order], np.arange(len(used)))
    offsets = np.zeros(len(lengths), dtype=np.int64)
    offsets[order] = ahead - ahead[firsts][bins[order]] if len(lengths) else ahead
    return bins, offsets


def _in_groups(rows: DataFrame, size: int, group_pieces: int, number: int) -> DataFrame:
    """rows with sequence_id, offset, and last: whether the piece is in its group's emptiest bin."""
    groups = max(1, -(-rows.count() // group_pieces))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(groups)))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row").reset_index(drop=True)
        bins, offsets = packed_bins(group["length"].to_numpy(), size)
        group["sequence_id"] = (group["grp"].to_numpy().astype(np.int64) << 32) + 4 * bins + number
        group["offset"] = offsets
        group["last"] = bins == bins.max()
        group["doc_id"] = group["doc_id"].astype("Int64")
        return group.drop(columns="grp")

    return rows.groupBy("grp").applyInPandas(one, f"{_PIECES}, row long, sequence_id long, offset long, last boolean")


def pack_best_fit(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, group_pieces: int = GROUP_PIECES, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    rows = pieces(docs, tokenizer_path, id_col, text_col, size, end_id).withColumn("piece", F.floor(F.col("start") / size).cast("int"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pieces")
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    whole = rows.where(F.col("length") == size).select(*columns, (4 * F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = written(_in_groups(rows.where(F.col("length") < size).select(*columns, "row"), size, group_pieces, 1), "packed")
    again = _in_groups(first.where("last").select(*columns, "row"), size, group_pieces, 2)
    out = [*columns, "sequence_id", "offset"]
    return whole.unionByName(first.where("not last").select(*out)).unionByName(again.select(*out))
