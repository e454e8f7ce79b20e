"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Texts become token ids where they are read, and only their pieces (place, length, checksum) move on. A document is cut
at multiples of the sequence length. Documents are dealt at random into groups of about GROUP_DOCS; each group is packed
by itself, so the groups' number grows with the input and a group's size does not. Whole sequences fill bins of their
own; a document has one shorter piece at most.

A word's ids don't depend on its neighbours: the tokenizer breaks at white space. So each worker keeps the ids of the
words that it has met (at most CACHE_WORDS, then it starts anew) and asks the tokenizer for new ones only.

Edge cases: a null or empty text is the end token alone. Very long texts are cut into many pieces. Rows that repeat an
id are documents of their own and get pieces each; a null id is carried as null. Other columns are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 4096
GROUP_DOCS = 4096
END_ID = 2
CACHE_WORDS = 900_000
JOINED_WORDS = 500
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of texts, by words; ids(text) equals the tokenizer's own ids."""

    _made: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self.tails = {t: ids[0] for t in (b",", b".") if len(ids := self.tokenizer.encode(t.decode(), add_special_tokens=False).ids) == 1}
        self._clear()

    @classmethod
    def at(cls, path: str) -> "WordIds":
        """One for each worker process, so that what it has learnt serves the next task too."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _learn(self, words: set[bytes]) -> None:
        # A word and the comma or full stop after it are token runs of their own: only the word is new to learn.
        tailed = [w for w in words if w[-1:] in self.tails and w[-2:-1].islower()]
        words.difference_update(tailed)
        words.update({w[:-1] for w in tailed}.difference(self.index))
        self._add(*self._encoded(words))
        at = np.fromiter((self.index[w[:-1]] for w in tailed), dtype=np.int64, count=len(tailed))
        lengths = self.lengths[at] + 1
        ids = self._gathered(self.starts[at], lengths)
        ids[np.cumsum(lengths) - 1] = np.fromiter((self.tails[w[-1:]] for w in tailed), dtype=np.uint32, count=len(tailed))
        self._add(tailed, lengths, ids)

    def _encoded(self, words: set[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words in some order, their numbers of ids, and the ids."""
        texts = {w: w.decode("utf-8", "replace") for w in words}
        # Words of lower-case Latin letters are one token run each, which ends with an end-of-word token: many are
        # encoded as one text, and cut at those tokens.
        plain = [w for w, t in texts.items() if t.isalpha() and t.islower() and max(t) < "\u0250"]
        other = list(texts.keys() - set(plain))
        joined = [" ".join([texts[w] for w in plain[i : i + JOINED_WORDS]]) for i in range(0, len(plain), JOINED_WORDS)]
        runs = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([texts[w] for w in other], add_special_tokens=False)]
        lengths = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(np.flatnonzero(self.ends[r]), prepend=-1) for r in runs), np.fromiter(map(len, alone), dtype=np.int64, count=len(alone))])
        return plain + other, lengths, np.concatenate([np.zeros(0, dtype=np.uint32), *runs, np.fromiter(itertools.chain.from_iterable(alone), dtype=np.uint32)])

    def _add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        known = len(self.index)
        for name, have, need in (("flat", self.used, len(ids)), ("starts", known, len(words)), ("lengths", known, len(words))):
            old = getattr(self, name)
            if have + need >= len(old):
                new = np.zeros(2 * (have + need), dtype=old.dtype)
                new[:have] = old[:have]
                setattr(self, name, new)
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[known : known + len(words)] = lengths
        self.starts[known : known + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.index.update(zip(words, range(known, known + len(words)), strict=True))

    def _gathered(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The runs of flat from starts, one after another."""
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def batch(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts are taken in runs of a few MB, which bounds the memory beside the cache."""
        run, weight = [], 0
        for text in texts:
            run.append(text or b"")
            weight += len(run[-1])
            if weight > 4_000_000:
                yield from self._run(run)
                run, weight = [], 0
        yield from self._run(run)

    def _run(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self._clear()
        # The tokenizer lower-cases; doing so for ASCII first makes fewer words, but could spell a special token.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        fresh: set[bytes] = set()
        for words in split:
            fresh.update(words)
        fresh = fresh.difference(self.index)  # a look at each fresh word, not at each known one
        if fresh:
            self._learn(fresh)
        starts, lengths = self.starts, self.lengths
        for words in split:
            at = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
            yield self._gathered(starts[at], lengths[at])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids, cut at multiples of size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.at(tokenizer_path)
        for b in batches:
            rows: list[tuple] = []
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for doc, ids in zip(b.column(0).to_pylist(), words.batch(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(cut, _PIECES)


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, none over size. Largest first; each goes to the first bin that has room.

    A tournament tree holds the room of every bin; a node holds the larger room of its two children, so the first bin
    with room is found from the root in as many steps as the tree is high.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [size] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, size - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, group_docs: int = GROUP_DOCS, seed: int = 17, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding of each piece.

    padding: what the piece's sequence lacks to size; 0 where its length is a power of two, as such a sequence is
    kept at its length.
    """
    groups = max(1, -(-docs.count() // group_docs))
    rows = pieces(docs, tokenizer_path, id_col, text_col, size, end_id)
    # All pieces of a document go to its group; documents of equal content differ in id, and without an id in content.
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("ids_crc32"))), F.lit(groups))
    rows = rows.withColumn("grp", key)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="last").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        filled = np.bincount(bins, weights=group["length"].to_numpy()).astype(np.int64)
        even = (filled & (filled - 1)) == 0
        group["sequence_id"] = (group["grp"].to_numpy().astype(np.int64) << 32) + bins
        group["offset"] = offsets
        group["padding"] = np.where(even, 0, size - filled)[bins]
        group["doc_id"] = group["doc_id"].astype("Int64")
        return group.drop(columns="grp")

    return rows.groupBy("grp").applyInPandas(one, f"{_PIECES}, sequence_id long, offset long, padding long")
