"""MinHash near-dedup by a multi-index Hamming join, with exact confirmation.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a signature of K minima and a parity sketch. Texts of
   equal sets form a class, which has a number of its own: an id that is given with different texts stands in several
   classes. From here on only classes take part.
2. The signature is cut into M chunks. If two signatures differ in at most T places, pigeonhole puts at most
   E = T // M errors into some chunk, so leaving out each choice of E places of each chunk enumerates all that may
   be wrong: the two share a key of (chunk, places left out, the other minima). All pairs within T are found. With
   K = 64, M = 16 and T = 31, E is 1; two texts of similarity 0.75 differ in 16 places on average (standard deviation
   3.5), so T lies over four deviations beyond.
3. Of the pairs within T, those go on to full sets whose similarity can be reached. Two bounds rule out the others, and
   neither can lose a link: the sets' sizes, and their parity sketches. A sketch holds for each of its bits whether an odd
   number of shingles falls there; common shingles cancel, so two sketches differ in at most as many bits as the sets
   differ in shingles.
4. Within a key's bucket every class is first compared with the bucket's smallest class: as many pairs as rows, taken
   by a partial aggregate, so hot buckets don't matter. What passes is confirmed on full sets and linked.
5. What is still in different components of one bucket is compared class by class, in blocks of about BLOCK classes,
   so that no task holds a large bucket; a block pair emits only pairs that pass, of different components, and not yet
   given by another bucket. They are confirmed on full sets as well.
6. Components by alternating neighbour minima and pointer jumps, each round written to the shared folder. Ids are
   joined to classes at the end: a component is named by the smallest id of its classes.

Joins to a class that very many pairs name are salted: its row is copied once for each HOT pairs, and they are dealt to the copies.

Edge cases: null and empty texts, and texts without words, have an empty set, link with nothing and stay. Texts with
fewer words than a shingle are one shingle. A null id takes part in nothing and is returned as it is, kept. Rows that
repeat an id: the id's rows are its classes' members, linked with each other through the id. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_rows, discard, named, of_row, written
from tidemark.llm.hashing import ODD, mix, word_hashes

WORDS = 5
K, CHUNKS, DISTANCE = 64, 16, 31
PERCENT = 75
#: Bits of a parity sketch for each shingle, rounded up to a power of two, and at least so many.
PARITY_BITS, LEAST_BITS = 8, 1024
BLOCK = 2048
#: Pairs that a task gathers before it gives them on.
RUN_PAIRS = 100_000
SLOTS = 64
#: Pairs of one class that share a copy of its row; copies of a key; the most keys that are broadcast.
HOT, SALTS, BROADCAST_KEYS = 2000, 64, 1_000_000


def shingles(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct uint64 hashes of the runs of words; fewer words than that make one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    run = min(n, words)
    h = np.full(n - run + 1, np.uint64(run))
    for i in range(run):
        h = mix(h * ODD + hashes[i : n - run + 1 + i])
    return np.unique(h)


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240)
    return rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minima(found: np.ndarray, k: int = K) -> np.ndarray:
    """k uint32 minima of a set of shingles."""
    a, b = _multipliers(k)
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 512):
        hashed = high[at : at + 512, None] * a
        hashed += b
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def parity(found: np.ndarray) -> bytes:
    """Of each bit, whether an odd number of the shingles falls there."""
    size = max(LEAST_BITS, 1 << (PARITY_BITS * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _signatures(column: pa.Array) -> np.ndarray:
    """(n, K) uint32."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), K)


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches, as uint64 words, brought to so many words: a bit's place is its shingle's remainder."""
    while odd.shape[1] > words:
        half = odd.shape[1] // 2
        odd = odd[:, :half] ^ odd[:, half:]
    return odd


def possible(differ: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity if they differ in at least differ shingles."""
    both = one + two
    return (100 * np.minimum(one, two) >= PERCENT * np.maximum(one, two)) & (100 * (both - differ) >= PERCENT * (both + differ))


def parity_distance(one: bytes, two: bytes) -> int:
    """A number of shingles in which the two sets differ at least."""
    a, b = (np.frombuffer(x, dtype=np.uint64)[None, :] for x in (one, two))
    words = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(_folded(a, words) ^ _folded(b, words)).sum())


def key_rows(signatures: np.ndarray, chunks: int = CHUNKS, distance: int = DISTANCE) -> np.ndarray:
    """(n, keys) int64: for each signature, its chunk keys with each choice of distance // chunks places left out.

    The last bits of a key are its slot, the number of its chunk and choice.
    """
    n, k = signatures.shape
    wide = signatures.astype(np.uint64)
    bounds = [k * i // chunks for i in range(chunks + 1)]
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        for gone in combinations(range(lo, hi), min(distance // chunks, hi - lo)):
            h = np.full(n, np.uint64(len(out) + 1))
            for i in range(lo, hi):
                if i not in gone:
                    h = mix(h * ODD + wide[:, i])
            out.append((h & ~np.uint64(SLOTS - 1)) | np.uint64(len(out)))
    return np.stack(out, axis=1).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, keys, sigs, odd = [], [], [], []
        for text in b.column(1).cast(pa.binary()):
            found = shingles(word_hashes(text.as_py()))
            n.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sigs.append(minima(found).tobytes() if len(found) else None)
            odd.append(parity(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), *(pa.array(x, type=pa.binary()) for x in (keys, sigs, odd)), b.column(2)], names=["doc", "n", "set_key", "sig", "odd", "text_key"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            keys = key_rows(_signatures(b.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("cls").to_numpy(), keys.shape[1]))], names=["key", "cls"])


def first_slot(equal: np.ndarray) -> np.ndarray:
    """(n, K) places that agree to the first slot whose key the two share, for pairs within the distance, one error a chunk."""
    by_chunk = equal.reshape(len(equal), CHUNKS, K // CHUNKS)
    wrong = (~by_chunk).sum(axis=2)
    chunk = (wrong <= 1).argmax(axis=1)
    mine = np.arange(len(equal))
    gone = np.where(wrong[mine, chunk] == 0, 0, (~by_chunk[mine, chunk]).argmax(axis=1))
    return chunk * (K // CHUNKS) + gone


def _star_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n_a, n_b, sig_a, sig_b, odd_a, odd_b): the a, b within the distance whose similarity is possible."""
    for b in batches:
        if b.num_rows:
            agree = (_signatures(b.column("sig_a")) == _signatures(b.column("sig_b"))).sum(axis=1)
            na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            fits = (agree >= K - DISTANCE) & possible(np.zeros(len(na), dtype=np.int64), na, nb)
            at = np.flatnonzero(fits)
            differ = [parity_distance(b.column("odd_a")[i].as_py(), b.column("odd_b")[i].as_py()) for i in at.tolist()]
            fits[at] = possible(np.array(differ, dtype=np.int64), na[at], nb[at])
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(fits)), b.column("b").filter(pa.array(fits))], names=["a", "b"])


class _Parities:
    """Parity sketches of a run's rows, in a matrix for each length."""

    def __init__(self, odd: np.ndarray):
        lengths = np.array([len(x) // 8 for x in odd])
        self.group, self.place, self.matrices = np.zeros(len(odd), dtype=np.int64), np.zeros(len(odd), dtype=np.int64), []
        for g, words in enumerate(np.unique(lengths).tolist()):
            at = np.flatnonzero(lengths == words)
            self.group[at], self.place[at] = g, np.arange(len(at))
            self.matrices.append(np.frombuffer(b"".join(odd[at].tolist()), dtype=np.uint64).reshape(len(at), words))

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """parity_distance of row i to each of others."""
        out = np.zeros(len(others), dtype=np.int64)
        mine = self.matrices[self.group[i]][self.place[i] : self.place[i] + 1]
        groups = self.group[others]
        for g in np.unique(groups).tolist():
            at = np.flatnonzero(groups == g)
            theirs = self.matrices[g][self.place[others[at]]]
            words = min(mine.shape[1], theirs.shape[1])
            out[at] = np.bitwise_count(_folded(theirs, words) ^ _folded(mine, words)).sum(axis=1)
        return out


def _within(key: int, rows: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """(2, pairs) at a time: of one block pair of one bucket, the pairs of different components within the distance, and possible.

    A pair shares several buckets: it is given by the one of its first slot only.
    """
    side, cls, comp, n, sigs = (rows[c] for c in ("side", "cls", "comp", "n", "sig"))
    odd = _Parities(rows["odd"])
    slot = int(key) & (SLOTS - 1)
    alone = bool((side == 2).all())  # a block with itself
    left = np.arange(len(cls)) if alone else np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    for i in left:
        with_i = right[right > i] if alone else right
        with_i = with_i[(comp[with_i] != comp[i]) & (100 * np.minimum(n[with_i], n[i]) >= PERCENT * np.maximum(n[with_i], n[i]))]
        if not len(with_i):
            continue
        equal = sigs[with_i] == sigs[i]
        within = equal.sum(axis=1) >= K - DISTANCE
        equal, with_i = equal[within], with_i[within]
        near = with_i[first_slot(equal) == slot]
        near = near[possible(odd.distances(i, near), n[near], n[i])]
        if len(near):
            yield np.stack([np.minimum(cls[i], cls[near]), np.maximum(cls[i], cls[near])])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_within of each run of equal (key, lo, hi) in rows in that order; only one run is held at a time."""
    names = ["side", "cls", "comp", "n"]

    def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: b.column(c).to_numpy(zero_copy_only=False) for c in [*names, "key", "lo", "hi"]}
        return out | {"sig": _signatures(b.column("sig")), "odd": np.array([*b.column("odd").to_pylist(), None], dtype=object)[:-1]}

    def pairs(run: list[dict[str, np.ndarray]], key: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in _within(key, {c: np.concatenate([r[c] for r in run]) for c in [*names, "sig", "odd"]}):
            held.append(found)
            size += found.shape[1]
            if size >= RUN_PAIRS:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    open_run: list[dict[str, np.ndarray]] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in ("key", "lo", "hi"):
            change |= np.diff(rows[c]) != 0
        cuts = (np.flatnonzero(change) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            here = tuple(rows[c][lo] for c in ("key", "lo", "hi"))
            if at is not None and here != at:
                yield from pairs(open_run, at[0])
                open_run = []
            at = here
            open_run.append({c: rows[c][lo:hi] for c in [*names, "sig", "odd"]})
    if open_run:
        yield from pairs(open_run, at[0])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, set_a, set_b): the a, b that reach the similarity on full sets."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):  # read in place, not copied
            one, two = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            both = np.concatenate([one, two])
            both.sort(kind="stable")  # two sorted runs
            common = np.count_nonzero(both[1:] == both[:-1])
            good.append(100 * common >= PERCENT * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(good, type=pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):  # sets are as large as their texts
            b = batch.slice(at, 500)
            sets = [shingles(word_hashes(t.as_py())).tobytes() for t in b.column("text").cast(pa.binary())]
            own = [xxhash.xxh3_128_digest(x) == key for x, key in zip(sets, b.column("set_key").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column("cls"), pa.array(sets, type=pa.binary())], names=["cls", "shingles"])
            yield out.filter(pa.array(own, type=pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """v, comp of every end of links (a, b): comp is the smallest id that can be reached.

    Each round takes the least label among a node and its neighbours, then the label of the label.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            discard(both)
            return labels
        total = now
        near = both.join(labels, both["b"] == labels["v"]).select(F.col("a").alias("v"), "comp").unionByName(labels)
        least = written(near.groupBy("v").agg(F.min("comp").alias("comp")), "labels")
        up = least.select(F.col("v").alias("comp"), F.col("comp").alias("top"))
        before, labels = labels, written(least.join(up, "comp").select("v", F.col("top").alias("comp")), "labels")
        discard(before, least)


def _with_ends(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b) with the other columns of ends (cls, ...) for both, as name_a and name_b.

    The smaller class of many pairs is a bucket's smallest: it is joined last and salted.
    """
    side = lambda x: ends.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ends.columns if c != "cls"])
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("a", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    found = many.count()
    if not found:
        return pairs.join(side("b"), "b").join(side("a"), "a")
    many = F.broadcast(many) if found <= BROADCAST_KEYS else many
    dealt = pairs.join(many, "a", "left").select("a", "b", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).cast("int").alias("salt"))
    copies = side("a").join(many, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(side("b"), "b").join(copies, ["a", "salt"]).drop("salt")


def _with_blocks(comp: DataFrame, open_keys: DataFrame) -> DataFrame:
    """comp with the blocks of open keys. Where those can't be broadcast, each is copied to SALTS tasks, which share a large bucket's rows."""
    if open_keys.count() <= BROADCAST_KEYS:
        return comp.join(F.broadcast(open_keys), "key")
    copies = open_keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return comp.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, n_links (pairs of classes confirmed at the id's class), component_id, kept of each row."""
    base = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text"))
    base = base.withColumn("text_key", F.xxhash64("text"))
    sketch = written(base.mapInArrow(_sketch, "doc long, n long, set_key binary, sig binary, odd binary, text_key long"), "sketch")
    known = sketch.where("doc is not null and set_key is not null")
    # Rows of equal sets have equal sketches: any row's will do.
    # The row of the smallest id (and of its texts, the one of the smallest key) is where the class's text is read again.
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc", "text_key")).alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    found = written(classes.select("row.doc", "row.text_key", "set_key", "n", "sig", "odd"), "found")
    # Numbers in the order of the ids: a bucket's smallest class is that of its oldest text, which most copies are near to.
    classes = written(found.orderBy("doc", "set_key").select(F.monotonically_increasing_id().alias("cls"), "*"), "classes")
    discard(found)

    keys = written(classes.select("cls", "sig").mapInArrow(_keys, "key long, cls long"), "keys")
    buckets = keys.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last"), F.count("*").alias("size")).where("hub < last")
    met = written(keys.join(buckets.drop("last"), "key"), "buckets")
    discard(keys)

    stars = written(met.where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    near = _with_ends(stars, classes.select("cls", "n", "sig", "odd"))
    tried = written(near.mapInArrow(_star_filter, "a long, b long"), "tried")
    discard(stars)

    confirmed = written(_confirmed(base, classes, tried), "confirmed")
    same_id = known.join(classes.select("set_key", "cls"), "set_key").select("doc", "cls")
    by_id = same_id.groupBy("doc").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("doc", "a")
    by_id = same_id.join(by_id, "doc").where("cls <> a").select("a", F.col("cls").alias("b"))
    links = written(confirmed.unionByName(by_id), "linked")
    labels = components(links)

    comp = met.where("cls <> hub and size > 2").join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    comp = written(comp, "in-buckets")
    open_keys = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    open_keys = written(open_keys, "open-keys")
    rows = _with_blocks(comp, open_keys)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.expr("case when block = other then 2 when block < other then 0 else 1 end").alias("side"), "cls", "comp")
    rows = rows.join(classes.select("cls", "n", "sig", "odd"), "cls")
    # A block with itself is asked for by its own rows only; two blocks meet with the rows of both.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rest = dealt.mapInArrow(_blocks, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    discard(met, comp, open_keys, tried)
    if rest.limit(1).count():
        more = written(links.unionByName(_confirmed(base, classes, rest)), "linked")
        discard(links, labels)
        links, labels = more, components(more)
    discard(rest, confirmed)

    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    names = classes.select(F.col("cls").alias("v"), "doc").join(labels, "v").groupBy("comp").agg(F.min("doc").alias("name"))
    of_class = labels.join(names, "comp").select(F.col("v").alias("cls"), "name")
    comps = classes.select("set_key", "cls", F.col("doc").alias("least")).join(of_class, "cls", "left").join(ends, "cls", "left")
    comps = written(comps.select("set_key", F.coalesce("name", "least").alias("comp"), "n_links"), "components")
    discard(classes, links, labels)
    out = sketch.select("doc", "n", "set_key").join(comps, "set_key", "left")
    found = F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), found.alias("component_id"), F.coalesce(F.col("doc") == found, F.lit(True)).alias("kept"))


def _confirmed(base: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that reach the similarity on full sets, which are made anew for these classes only."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = classes.join(ends, "cls", "left_semi").select("cls", "doc", "text_key", "set_key")
    rows = base.join(wanted, ["doc", "text_key"]).select("cls", "text", "set_key")
    # Rows may repeat a text, and texts a key: only the class's own set is taken, and once.
    sets = written(rows.mapInArrow(_sets, "cls long, shingles binary").dropDuplicates(["cls"]), "sets")
    return _with_ends(pairs, sets.withColumnRenamed("shingles", "set")).select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates does not keep; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(named(id_col).alias("gone")).distinct()
    left = as_rows(docs).join(gone, of_row(id_col) == F.col("gone"), "left_anti")
    return left.select(*[of_row(c).alias(c) for c in docs.columns])
