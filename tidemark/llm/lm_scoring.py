"""LM scoring: a bigram model in log-frequency Bloom filters.

1. The training documents' words are counted (64-bit hashes), and a filter of quantised word counts is built: a word
   of level q is inserted q times, as (word, 1) to (word, q), so asking for rising levels until one is missing gives
   its level; a wrong answer can only be too high, with probability 2^-hashes a level (the first level has more hashes: an
   unseen pair that passes for a seen one costs most).
2. Word pairs are counted, each marked with the level of its first word, and a second filter holds their levels. A
   filter's segments are built where their share of the hashes is gathered, and sized to what they hold.
3. Every text is scored by probing the filters: absolute discounting, whose discount and
   back-off weights come from the counts of counts, by level of the first word:
   P(w | h) = max(c(h, w) - D, 0) / c(h) + D * T(level of h) / C(level of h) * P(w).
   Levels stand for the mean count of what they hold. P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)).
4. The base score needs exact counts: the most frequent words' are broadcast (at most TOP_WORDS), and occurrences of
   the others are joined to their counts.

Bound of the broadcasts: SHARD_BYTES for the word filter, PAIR_BYTES for the pair filter. A filter's segments are so many
that each is built from about SEGMENT_INPUT bytes of counts. If the word filter is larger than a shard, its shards are
broadcast in turn to write their words' levels beside the texts, and what follows reads them there. A pair filter that may
be larger than PAIR_BYTES is not broadcast: the pairs of the texts are dealt once, to the segments that count them. A
segment makes its part of the filter, probes it for the same pairs, and sends the levels that it finds back to the runs of
texts that they came from. So the texts are read once for it however large the filter, and what moves is in proportion to
them. The levels, and so the scores, are the same as with one broadcast of as many segments.

Edge cases: a null or empty text is the end token alone. A null id is held out. Rows that repeat an id are texts of
their own. Without training tokens every word is unknown: N and V are 0 and the scores follow from the formulas. Other columns
are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, written
from tidemark.llm.hashing import ODD, mix, word_hashes

END = 0x454E44  # stands for the end token; words hash to all of 64 bits
TOP_WORDS = 500_000
SHARD_BYTES = 1 << 29
#: A pair filter up to this is broadcast: a larger one leaves the caches, and probing it takes longer than dealing its pairs.
PAIR_BYTES = 1 << 24
#: Counts that a segment is built from, of 16 bytes each; the most tasks that build segments.
SEGMENT_INPUT, SEGMENT_TASKS = 64 << 20, 50_000
#: Levels are kept in a byte; with WORD_STEPS a doubling they reach counts of 2^63, so no count of the data is cut.
LEVEL_BITS = 8
LEVELS = 1 << LEVEL_BITS
WORD_STEPS, WORD_HASHES = 4, (10, 5)  # levels a doubling of the count; hashes of the first level, and of each other
PAIR_STEPS, PAIR_HASHES = 2, (8, 5)
#: Tokens that are counted (or dealt) together before they move, and that are scored together.
COUNT_CHUNK, SCORE_CHUNK = 600_000, 150_000
#: Pairs of at least this level are asked for once a task, as long as so many are remembered.
KNOWN_LEVEL, KNOWN_PAIRS = 4, 1_000_000


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def levels(counts: np.ndarray, steps: int) -> np.ndarray:
    """1 for a count of 1, and steps more for each doubling; at most LEVELS - 1."""
    return np.minimum(1 + np.floor(steps * np.log2(counts) + 1e-9).astype(np.int64), LEVELS - 1)


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit hashes of (key, level), of which all its places are made."""
    h = mix(keys ^ np.uint64(level * int(ODD) & 0xFFFFFFFFFFFFFFFF))
    return h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def _places(one: np.ndarray, two: np.ndarray, j: int, sizes: np.ndarray) -> np.ndarray:
    """Bit numbers below sizes."""
    return (((one + np.uint64(j) * two) & np.uint64(0xFFFFFFFF)) * sizes) >> np.uint64(32)


class Filter:
    """Segments of a log-frequency Bloom filter; a key's segment is its remainder."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, hashes: tuple[int, int]):
        """sizes: bytes of each segment, which lie one after another in bits."""
        self.hashes = hashes
        self.sizes = 8 * sizes.astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = bits

    @staticmethod
    def segment(keys: np.ndarray, level: np.ndarray, hashes: tuple[int, int]) -> bytes:
        """Sized for half of its bits to be set."""
        inserted = hashes[0] * len(keys) + hashes[1] * int((level - 1).sum())
        size = 64 * max(1, math.ceil(1.4427 * inserted / 64))
        bits = np.zeros(size, dtype=bool)
        for at in range(1, int(level.max(initial=0)) + 1):
            one, two = _hashed(keys[level >= at], at)
            for j in range(hashes[at > 1]):
                bits[_places(one, two, j, np.uint64(size))] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of rising levels."""
        found = np.zeros(len(keys), dtype=np.int64)
        live, mine = np.arange(len(keys)), keys
        sizes, starts = self.sizes[segments], self.starts[segments]
        for at in range(1, LEVELS):
            one, two = _hashed(mine, at)
            for j in range(self.hashes[at > 1]):
                p = starts + _places(one, two, j, sizes)
                on = ((self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).view(bool)
                if not on.all():
                    live, mine, one, two, sizes, starts = (x[on] for x in (live, mine, one, two, sizes, starts))
            if not len(live):
                break
            found[live] = at
        return found


class _Known:
    """A filter whose answers of high levels, which take the most probes and come again in each run, are remembered."""

    def __init__(self, of: Filter, segments: int):
        self.of, self.segments = of, segments
        self.keys, self.found = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each of the sorted keys."""
        out, hit = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.found[at[hit]]
        rest = keys[~hit]
        out[~hit] = found = self.of.levels(rest, _segment_of(rest, self.segments))
        new = rest[found >= KNOWN_LEVEL]
        if len(self.keys) + len(new) > KNOWN_PAIRS:
            self.keys, self.found = new, found[found >= KNOWN_LEVEL]
        else:
            at = np.searchsorted(self.keys, new)
            self.keys, self.found = np.insert(self.keys, at, new), np.insert(self.found, at, found[found >= KNOWN_LEVEL])
        return out


def _top_places(top: tuple, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands in the broadcast table, and whether it does."""
    keys = top[0]
    if not len(keys):
        return np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=bool)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    return at, keys[at] == distinct


def _levels_of(words: Filter, top: tuple, distinct: np.ndarray) -> np.ndarray:
    """The level of each distinct word. Frequent words have many levels to probe: the table holds their answers."""
    at, hit = _top_places(top, distinct)
    out = np.zeros(len(distinct), dtype=np.int64)
    out[hit] = top[2][at[hit]]
    rest = distinct[~hit]
    out[~hit] = words.levels(rest, _segment_of(rest, len(words.sizes)))
    return out


def _runs(batches: Iterator[pa.RecordBatch], training_only: bool, chunk: int) -> Iterator[list[tuple]]:
    """Lists of (row number in its batch, batch, token hashes) of about chunk tokens."""
    run, size = [], 0
    for b in batches:
        for i, (doc, text) in enumerate(zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()), strict=True)):
            if training_only and held_out(doc):
                continue
            run.append((i, b, word_hashes(text.as_py(), END)))
            size += len(run[-1][2])
            if size >= chunk:
                yield run
                run, size = [], 0
    if run:
        yield run


def _packed(keys: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    """A row for each segment: its keys and counts as bytes, which move and are read without a step for each key."""
    seg = _segment_of(keys, segments)
    order = np.argsort(seg, kind="stable")
    held, starts = np.unique(seg[order], return_index=True)
    cuts = [*starts.tolist(), len(order)]
    keys, counts = keys[order], counts[order].astype(np.int64)
    runs = list(zip(cuts, cuts[1:], strict=False))
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([keys[i:j].tobytes() for i, j in runs], type=pa.binary()), pa.array([counts[i:j].tobytes() for i, j in runs], type=pa.binary())], names=["seg", "keys", "counts"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, True, COUNT_CHUNK):
        distinct, counts = np.unique(np.concatenate([r[2] for r in run]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "c"])


def _histories(run: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a run, and the token before each; the end token comes before a text's first."""
    tokens = np.concatenate([r[2] for r in run])
    before = np.roll(tokens, 1)
    before[0] = END
    return tokens, before


def pair_keys(before: np.ndarray, tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """uint64: 56 bits of hash, and the level of the first word in the last eight."""
    return ((mix(mix(before * ODD) + tokens) >> np.uint64(LEVEL_BITS)) << np.uint64(LEVEL_BITS)) | level.astype(np.uint64)


_SUMS = pa.list_(pa.struct([("at", pa.int32()), ("x", pa.int64())]))


def _sums(keys: np.ndarray, c: np.ndarray, q: np.ndarray) -> list[dict]:
    """By level, and by the last eight bits of the keys: how many keys, and their counts; then how many of counts 1 and 2."""
    history = (keys & np.uint64(LEVELS - 1)).astype(np.int64)
    sums = [np.bincount(at, weights=w, minlength=LEVELS).astype(np.int64) for at, w in ((q, None), (q, c), (history, None), (history, c))]
    sums.append(np.array([np.count_nonzero(c == 1), np.count_nonzero(c == 2)]))
    sums = np.concatenate(sums)
    used = np.flatnonzero(sums)  # most levels hold nothing
    return [{"at": i, "x": x} for i, x in zip(used.tolist(), sums[used].tolist(), strict=True)]


def _segments(steps: int, hashes: tuple[int, int]):
    """mapInArrow function: packed counts in the order of their segments to a filter's segment each; one is held at a time."""

    def made(seg: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        k = np.frombuffer(b"".join(x for x, _ in held), dtype=np.uint64)
        c = np.frombuffer(b"".join(x for _, x in held), dtype=np.int64)
        held.clear()
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, c = k[first], np.add.reduceat(c, first)
        q = levels(c, steps)
        return pa.RecordBatch.from_arrays([pa.array([seg], type=pa.int32()), pa.array([Filter.segment(k, q, hashes)], type=pa.binary()), pa.array([_sums(k, c, q)], type=_SUMS)], names=["seg", "bits", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for seg, keys, counts in zip(b.column("seg").to_pylist(), b.column("keys"), b.column("counts"), strict=True):
                if seg != now and held:
                    yield made(now, held)
                now = seg
                held.append((keys.as_py(), counts.as_py()))
        if held:
            yield made(now, held)

    return run


def _repacked(segments: int):
    """mapInArrow function: (key, c) to packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _packed(b.column("key").to_numpy().view(np.uint64), b.column("c").to_numpy(), segments)

    return run


_PACKED = "seg int, keys binary, counts binary"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _moved(df: DataFrame, name: str) -> DataFrame:
    """written(df), after which its shuffle files, which nothing else reads, are removed."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _in_order(rows: DataFrame, segments: int, *then: str) -> DataFrame:
    """rows with seg, dealt so that each task holds segments next to each other, one after another."""
    tasks = min(segments, SEGMENT_TASKS)
    return rows.repartitionById(tasks, F.floor(F.col("seg") * F.lit(float(tasks)) / segments).cast("int")).sortWithinPartitions("seg", *then)


def _gathered(counts: DataFrame, segments: int, steps: int, hashes: tuple[int, int]) -> tuple[DataFrame, np.ndarray]:
    """The written segments of a filter, and the sums over them."""
    made = _moved(_in_order(counts, segments).mapInArrow(_segments(steps, hashes), "seg int, bits binary, sums array<struct<at:int,x:long>>"), "bloom")
    return made, _added(made)


def _added(made: DataFrame) -> np.ndarray:
    """The sums over all segments."""
    sums = np.zeros(4 * LEVELS + 2, dtype=np.int64)
    for r in made.select(F.inline("sums")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        sums[r["at"]] = r["x"]
    return sums


def _filter(made: DataFrame, segments: int, hashes: tuple[int, int], low: int = 0, high: int | None = None) -> Filter:
    """Segments low to high; an absent one holds nothing. They come one after another into one array."""
    high = segments if high is None else high
    mine = made.where(F.col("seg").between(low, high - 1))
    sizes = np.full(high - low, 8, dtype=np.int64)
    for r in mine.select("seg", F.length("bits").alias("n")).collect():
        sizes[r["seg"] - low] = r["n"]
    starts = np.cumsum(sizes) - sizes
    bits = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for r in mine.select("seg", "bits").toLocalIterator():
        at = starts[r["seg"] - low]
        bits[at : at + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(sizes, bits, hashes)


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(LEVEL_BITS)) % np.uint64(segments)).astype(np.int64)


def _split(keys: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each key, and 32 bits of its hash that tell it from others there.

    A segment is made from so few counts that a key meets another's bits less than once in 1000, four times less than it passes the filter.
    """
    rest, seg = np.divmod(keys >> np.uint64(LEVEL_BITS), np.uint64(segments))
    return seg.astype(np.int64), rest.astype(np.uint32)


def _joined(seg: np.ndarray | int, rest: np.ndarray, level: np.ndarray, segments: int) -> np.ndarray:
    """The key that the parts stand for."""
    return ((rest.astype(np.uint64) * np.uint64(segments) + np.uint64(seg)) << np.uint64(LEVEL_BITS)) | level.astype(np.uint64)


def _noted(part: list[tuple]) -> np.ndarray:
    """The levels of a run's tokens that _note has written."""
    return np.frombuffer(b"".join(b.column("levels")[i].as_py() for i, b, _ in part), dtype=np.uint8).astype(np.int64)


def _note(words, shard: tuple[int, int], segments: int):
    """mapInArrow over (uid, doc, text, levels): adds the levels of the tokens whose segments are in the shard."""
    low, high = shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, False, SCORE_CHUNK):
            distinct, back = np.unique(np.concatenate([r[2] for r in part]), return_inverse=True)
            seg = _segment_of(distinct, segments)
            mine = np.flatnonzero((seg >= low) & (seg < high))
            found = np.zeros(len(distinct), dtype=np.uint8)
            found[mine] = words.value.levels(distinct[mine], seg[mine] - low)
            found, at, levels = found[back], 0, []
            for i, b, tokens in part:
                before = b.column("levels")[i].as_py()
                now = found[at : at + len(tokens)]
                levels.append((now if before is None else now + np.frombuffer(before, dtype=np.uint8)).tobytes())
                at += len(tokens)
            columns = [pa.concat_arrays([b.column(c).slice(i, 1) for i, b, _ in part]) for c in ("uid", "doc", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(levels, type=pa.binary())], names=["uid", "doc", "text", "levels"])

    return run


def _count_pairs(words, top, end_level: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, True, COUNT_CHUNK):
            tokens, before = _histories(part)
            if words is None:
                history = np.roll(_noted(part), 1)
                history[0] = end_level
            else:
                distinct, back = np.unique(before, return_inverse=True)
                history = _levels_of(words.value, top.value, distinct)[back]
                del back
            seg, rest = _split(pair_keys(before, tokens, history), segments)
            keys = _joined(seg.astype(np.uint64), rest, history, segments)
            del tokens, before, history, seg, rest
            yield _packed(*np.unique(keys, return_counts=True), segments)

    return run


def _shards(sizes: dict[int, int], segments: int, shard_bytes: int) -> list[tuple[int, int]]:
    """(low, high) of runs of segments that take at most shard_bytes."""
    out, low, size = [], 0, 0
    for i in range(segments):
        if size and size + sizes.get(i, 8) > shard_bytes:
            out.append((low, i))
            low, size = i, 0
        size += sizes.get(i, 8)
    return [*out, (low, segments)]


def _sizes(made: DataFrame) -> dict[int, int]:
    return {r["seg"]: r["n"] for r in made.select("seg", F.length("bits").alias("n")).collect()}


def _segment_number(least: int, bytes_bound: float, shard_bytes: int, counts: int) -> int:
    """So many that a segment takes about an eighth of a shard at most, and at most SEGMENT_INPUT bytes of counts make it."""
    return max(least, math.ceil(8 * bytes_bound / shard_bytes), math.ceil(16 * counts / SEGMENT_INPUT))


def _mean(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mean count by level; empty levels, which only a wrong probe finds, take the level below."""
    out = np.zeros(LEVELS)
    for q in range(1, LEVELS):
        out[q] = total[q] / count[q] if count[q] else max(out[q - 1], 1.0)
    return out


def _log10_p(model: dict, found: np.ndarray, history: np.ndarray, level: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability of a word of this level after one of level history, whose pair has level found."""
    alone = (model["word_mean"][level] + 0.1) / model["room"]
    seen = np.maximum(model["pair_mean"][found] - model["discount"], 0) / np.maximum(model["word_mean"][history], 1e-9)
    return np.log10(np.where(history > 0, np.minimum(seen, 1 - model["back_off"][history]) + model["back_off"][history] * alone, alone))


_SCORES = "uid long, doc long, n_tokens long, n_known long, base double, score double, key long, tf long"
_SCORED = pa.schema([("uid", pa.int64()), ("doc", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("key", pa.int64()), ("tf", pa.int64())])


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCORED], schema=_SCORED)


def _text_rows(part: list[tuple], lengths: np.ndarray, distinct: np.ndarray, back: np.ndarray, top: tuple, log_base: float, score: pa.Array) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """A row for each text of a run (key null), and one for each word of a text that the broadcast counts lack (key)."""
    n, text = len(part), np.repeat(np.arange(len(part)), lengths)
    uid = np.array([b.column("uid")[i].as_py() for i, b, _ in part], dtype=np.int64)
    doc = pa.array([b.column("doc")[i].as_py() for i, b, _ in part], type=pa.int64())
    at, hit = _top_places(top, distinct)
    p = np.zeros(len(distinct))
    p[hit] = np.log10(top[1][at[hit]] + 0.1) - log_base
    known = hit[back]
    base = np.bincount(text, weights=p[back], minlength=n)
    rare = np.flatnonzero(~known)
    places, tf = np.unique(text[rare] * np.int64(len(distinct)) + back[rare], return_counts=True)
    which, word = places // len(distinct), distinct[places % len(distinct)]
    return (
        _rows(n, uid=pa.array(uid), doc=doc, n_tokens=pa.array(lengths), n_known=pa.array(np.bincount(text[known], minlength=n)), base=pa.array(base), score=score),
        _rows(len(tf), uid=pa.array(uid[which]), key=pa.array(word.view(np.int64)), tf=pa.array(tf)),
    )


def _score(words, pairs, top, model: dict, segments: int):
    """mapInArrow over (uid, doc, text): the rows of the texts, scored by a filter of pairs that is at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pairs = _Known(pairs.value, segments)
        for part in _runs(batches, False, SCORE_CHUNK):
            tokens, before = _histories(part)
            lengths, n = np.array([len(r[2]) for r in part]), len(part)
            distinct, back = np.unique(tokens, return_inverse=True)
            level = _noted(part) if words is None else _levels_of(words.value, top.value, distinct)[back]
            history = np.roll(level, 1)
            history[0] = model["end_level"]
            seg, rest = _split(pair_keys(before, tokens, history), segments)
            asked, again = np.unique(_joined(seg.astype(np.uint64), rest, history, segments), return_inverse=True)
            del tokens, before, seg, rest
            found = known_pairs.levels(asked)[again]
            score = np.bincount(np.repeat(np.arange(n), lengths), weights=_log10_p(model, found, history, level), minlength=n)
            del asked, again, found, history, level
            yield from _text_rows(part, lengths, distinct, back, top.value, model["log_base"], pa.array(score))

    return run


_DEALT = "seg int, run long, n int, trained int, width int, rest binary, marks binary, home binary"


def _deal(words, top, end_level: int, log_base: float, segments: int):
    """mapInArrow over (uid, doc, text): each run of texts as a row for each segment that its pairs belong to, and one (home) with the texts' rows.

    A pair is its 32 bits, the levels of both words, and how many texts after that of the pair before it its own is (of width
    bytes). The first trained pairs of a row are of training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, False, COUNT_CHUNK):
            part = sorted(((held_out(b.column("doc")[i].as_py()), (i, b, tokens)) for i, b, tokens in part), key=lambda x: x[0])
            trained = sum(len(r[2]) for held, r in part if not held)
            part = [r for _, r in part]
            tokens, before = _histories(part)
            lengths = np.array([len(r[2]) for r in part])
            distinct, back = np.unique(tokens, return_inverse=True)
            level = (_noted(part) if words is None else _levels_of(words.value, top.value, distinct)[back]).astype(np.uint8)
            history = np.roll(level, 1)
            history[0] = end_level
            seg, rest = _split(pair_keys(before, tokens, history), segments)
            del tokens, before
            order = np.argsort(seg.astype(np.min_scalar_type(segments)), kind="stable")
            counts, learned = np.bincount(seg, minlength=segments), np.bincount(seg[:trained], minlength=segments)
            held = np.flatnonzero(counts)
            counts, learned = counts[held], learned[held]
            ends = np.cumsum(counts)
            starts = ends - counts
            text = np.repeat(np.arange(len(part), dtype=np.uint32), lengths)[order]
            step = np.diff(text, prepend=np.uint32(0))
            step[starts] = text[starts]
            widths = [np.min_scalar_type(x).itemsize for x in np.maximum.reduceat(step, starts)]
            rest, history, level = rest[order], history[order], level[order]
            cuts = list(zip(starts.tolist(), ends.tolist(), widths, strict=True))
            marks = [pa.compress(history[i:j].tobytes() + level[i:j].tobytes() + step[i:j].astype(f"u{w}").tobytes(), codec="zstd", asbytes=True) for i, j, w in cuts]
            first = part[0][1].column("uid")[part[0][0]].as_py()
            home = pa.BufferOutputStream()
            with pa.ipc.new_stream(home, _SCORED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in _text_rows(part, lengths, distinct, back, top.value, log_base, pa.nulls(len(part), pa.float64())):
                    out.write_batch(b)
            ints = lambda x, last=0: pa.array(np.append(x, last).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ints(held, first % segments),
                    pa.array([first] * (len(held) + 1), type=pa.int64()),
                    ints(counts),
                    ints(learned),
                    ints(widths),
                    pa.array([*(rest[i:j].tobytes() for i, j, _ in cuts), None], type=pa.binary()),
                    pa.array([*marks, None], type=pa.binary()),
                    pa.array([*([None] * len(held)), home.getvalue().to_pybytes()], type=pa.binary()),
                ],
                names=["seg", "run", "n", "trained", "width", "rest", "marks", "home"],
            )

    return run


_FOUND = "run long, n int, width int, marks binary, home binary, sums array<struct<at:int,x:long>>"


def _found(segments: int):
    """mapInArrow over _deal's rows in the order of segments: the same runs with the levels that their segments' filters find, and the segments' sums."""
    schema = pa.schema([("run", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("marks", pa.binary()), ("home", pa.binary()), ("sums", _SUMS)])

    def rows(**columns: list) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def made(seg: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([r["n"] for r in held])
        marks = [pa.decompress(r["marks"], decompressed_size=r["n"] * (2 + r["width"]), codec="zstd", asbytes=True) for r in held]
        history = np.frombuffer(b"".join(m[: r["n"]] for m, r in zip(marks, held, strict=True)), dtype=np.uint8)
        keys = _joined(seg, np.frombuffer(b"".join(r.pop("rest") for r in held), dtype=np.uint32), history, segments)
        del history
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        learned = np.concatenate([np.arange(r["n"]) < r["trained"] for r in held])
        c = np.add.reduceat(learned[order], first, dtype=np.int64)
        times, keys = np.diff(first, append=len(keys)), keys[first]
        k, c = keys[c > 0], c[c > 0]
        q = levels(c, PAIR_STEPS)
        bits = Filter.segment(k, q, PAIR_HASHES)
        own = Filter(np.array([len(bits)]), np.frombuffer(bits, dtype=np.uint8), PAIR_HASHES)
        yield rows(sums=[_sums(k, c, q)])
        del k, c, q, learned, first
        at = [own.levels(x, np.zeros(len(x), dtype=np.int64)).astype(np.uint8) for x in np.array_split(keys, 1 + len(keys) // SCORE_CHUNK)]
        found = np.empty(len(order), dtype=np.uint8)
        found[order] = np.repeat(np.concatenate(at), times)
        del order, keys, times, at
        found = [pa.compress(x.tobytes() + m, codec="zstd", asbytes=True) for x, m in zip(np.split(found, ends[:-1]), marks, strict=True)]
        yield rows(run=[r["run"] for r in held], n=[r["n"] for r in held], width=[r["width"] for r in held], marks=found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["home"] is not None:
                    yield rows(run=[r["run"]], home=[r["home"]])
                    continue
                if r["seg"] != now and held:
                    yield from made(now, held)
                    held = []
                now = r["seg"]
                held.append(r)
        if held:
            yield from made(now, held)

    return run


def _gather(model: dict):
    """mapInArrow over _found's rows, each run's home before what was found for it: the rows of its texts, scored."""

    def made(home: bytes, held: list[dict]) -> Iterator[pa.RecordBatch]:
        texts, rare = pa.ipc.open_stream(home)
        parts, at = [], []
        for r in held:
            n = r["n"]
            m = np.frombuffer(pa.decompress(r["marks"], decompressed_size=n * (3 + r["width"]), codec="zstd", asbytes=True), dtype=np.uint8)
            parts.append(m[: 3 * n].reshape(3, n))
            at.append(np.cumsum(m[3 * n :].view(f"u{r['width']}"), dtype=np.int64))
        found, history, level = np.concatenate(parts, axis=1)
        score = np.bincount(np.concatenate(at), weights=_log10_p(model, found, history, level), minlength=texts.num_rows)
        yield texts.set_column(_SCORED.get_field_index("score"), "score", pa.array(score))
        yield rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["home"] is None:
                    held.append(r)
                    continue
                if home is not None:
                    yield from made(home, held)
                home, held = r["home"], []
        if home is not None:
            yield from made(home, held)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_words: int = TOP_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    base = docs.select(F.monotonically_increasing_id().alias("uid"), named(id_col).cast("long").alias("doc"), named(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    counts = _moved(base.mapInArrow(_count_words, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    distinct, total = (x or 0 for x in counts.agg(F.count("*"), F.sum("c")).first())
    # A word is inserted once for its first level and WORD_STEPS times for each doubling: log is concave.
    inserted = distinct * (WORD_HASHES[0] + WORD_STEPS * WORD_HASHES[1] * math.log2(total / distinct)) if distinct else 0
    segments = _segment_number(partitions, 1.4427 * inserted / 8, shard_bytes, distinct)
    made, sums = _gathered(counts.mapInArrow(_repacked(segments), _PACKED), segments, WORD_STEPS, WORD_HASHES)
    n_words, word_sum = sums[:LEVELS], sums[LEVELS : 2 * LEVELS]

    # The lowest count whose words, and those of higher counts, number at most top_words.
    by_count = counts.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("q")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("q")).collect()
    least, n = None, 0
    for r in by_count:
        n += r["n"]
        if n > top_words:
            break
        least = r["least"]
    frequent = counts.where(F.col("c") >= least).toPandas() if least is not None else None
    keys = frequent["key"].to_numpy(dtype=np.int64).view(np.uint64) if frequent is not None else np.zeros(0, dtype=np.uint64)
    order = np.argsort(keys)
    keys, c = keys[order], frequent["c"].to_numpy(dtype=np.int64)[order] if frequent is not None else np.zeros(0, dtype=np.int64)

    asked = np.append(keys, np.uint64(END))
    where, found = _segment_of(asked, segments), np.zeros(len(asked), dtype=np.int64)
    word_shards = _shards(_sizes(made), segments, shard_bytes)
    if len(word_shards) > 1:
        base = base.withColumn("levels", F.lit(None).cast("binary")).withColumn("text", F.col("text").cast("binary"))
    for low, high in word_shards:
        word_filter = _filter(made, segments, WORD_HASHES, low, high)
        mine = np.flatnonzero((where >= low) & (where < high))
        found[mine] = word_filter.levels(asked[mine], where[mine] - low)
        words = sc.broadcast(word_filter)
        if len(word_shards) > 1:
            # The first of these writes the rows' numbers too; whatever reads them later reads the same.
            base = written(base.mapInArrow(_note(words, (low, high), segments), "uid long, doc long, text binary, levels binary"), "levels")
            words.unpersist()
    if len(word_shards) > 1:
        words = None
    top, end_level = sc.broadcast((keys, c, found[:-1])), int(found[-1])

    # A pair's hashes are at most nine for each of its occurrences. Dealt pairs take twice the counts' bytes.
    pair_bytes, most = 1.4427 * 9 * total / 8, min(shard_bytes, PAIR_BYTES)
    segments = _segment_number(partitions, pair_bytes, shard_bytes, 2 * total)
    room, pairs = total + 0.1 * (distinct + 1), None
    if pair_bytes <= most:
        pairs, pair_sums = _gathered(base.mapInArrow(_count_pairs(words, top, end_level, segments), _PACKED), segments, PAIR_STEPS, PAIR_HASHES)
        if len(_shards(_sizes(pairs), segments, most)) > 1:  # sizes are rounded up
            discard(pairs)
            pairs = None
    if pairs is None:
        # All rows of a text come from this one scan, so its number need not be the same in another.
        dealt = base.mapInArrow(_deal(words, top, end_level, math.log10(room), segments), _DEALT)
        found = _moved(_in_order(dealt, segments).mapInArrow(_found(segments), _FOUND), "found")
        pair_sums = _added(found)
    n_pairs, pair_sum, kinds, tokens = (pair_sums[i * LEVELS : (i + 1) * LEVELS] for i in range(4))
    once, twice = pair_sums[4 * LEVELS :]
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model = {
        "word_mean": _mean(n_words, word_sum),
        "pair_mean": _mean(n_pairs, pair_sum),
        "discount": discount,
        "back_off": np.divide(discount * kinds, tokens, out=np.full(LEVELS, 0.5), where=tokens > 0),
        "room": room,
        "log_base": math.log10(room),
        "end_level": end_level,
    }

    if pairs is not None:
        pair_filter = sc.broadcast(_filter(pairs, segments, PAIR_HASHES))
        whole = written(base.mapInArrow(_score(words, pair_filter, top, model, segments), _SCORES), "scores")
        pair_filter.unpersist()
    else:
        pairs = found
        back = found.where("run is not null").drop("sums").repartition(segments, "run").sortWithinPartitions("run", F.col("home").isNull())
        whole = _moved(back.mapInArrow(_gather(model), _SCORES), "scores")
    texts = whole.where("key is null")
    rare = whole.where("key is not null").select("uid", "key", "tf")
    # Words that the broadcast has can't be in rare rows, so they stay out of the join.
    others = counts.where(F.col("c") < least) if least is not None else counts
    rare = rare.join(others, "key", "left").groupBy("uid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - F.lit(model["log_base"]))).alias("more_base"))
    out = texts.join(rare, "uid", "left")
    discard(made, pairs)
    is_held = F.col("doc").isNull() | (F.crc32(F.col("doc").cast("string").cast("binary")) % 10 == 0)
    return out.select(
        F.col("doc").alias(id_col),
        is_held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
