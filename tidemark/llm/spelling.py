"""Spelling variant grouping: words one edit apart, found by an even-partition pigeonhole join, and the form each stands for.

1. Each text's runs of letters are counted by (document, run); some runs lose a letter, as the seeded checksum says. The
   words are the results of at least LEAST_LENGTH letters and LEAST_COUNT occurrences.
2. A word of length l is cut evenly into two segments, at l // 2, and stands in the index under each: (l, first segment),
   (l, second segment). One edit leaves one of the two whole. So a word of length l, or l + 1, that is one edit away has
   the first segment as its beginning, or the second as its end, which is shifted by the difference of the lengths: those
   substrings are probed. Equal words stand in the index and probe by one row.
3. A bucket of more than BUCKET rows is not compared: what its words do not share is cut evenly again, in the same way, and
   each word moves on to two narrower buckets. This ends, as a rest of one letter has only as many forms as there are
   letters. So the work in a bucket is bounded, however many words have a segment in common, and no pair is lost.
4. Candidates are compared within their bucket, and only pairs of one edit leave it. One that two buckets have found (a letter
   inserted between two segments) is taken once.
5. A word's form is its near word of the largest count, if that is FACTOR times its own. Counts grow by that factor with
   each step, so chains of forms are short: a few pointer jumps over written tables find their ends.

Edge cases: a null or empty text has no words. A text may be one very long run; it is compared like others. Rows that repeat
an id and a text count again; a null id is an empty one in the checksum. Ties between forms go to the smaller word in
code-point order. Other columns are ignored, whatever their names. An empty table, or one without words, gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, written

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
#: One in so many (document, run)s is misspelt.
MISSPELT = 31
BUCKET = 256
#: Large buckets' keys are broadcast up to so many.
BROADCAST_KEYS = 50_000
#: So many distinct words of a task are held, before their counts are passed on.
HELD_WORDS = 200_000
SALTS = 16
_BYTES = 4_000_000
_FEW = 12


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, one_in: int = MISSPELT) -> DataFrame:
    """word, n of all words of at least least_length letters. Counts are added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), type=pa.string()), pa.array(held.values(), type=pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                lower = text.as_py().lower().decode("utf-8", "replace")  # of bytes: A-Z only
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs.findall(lower)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % one_in == 0:
                        gone = h % len(run)
                        if len(run) <= least_length:
                            continue
                        run = run[:gone] + run[gone + 1 :]
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    rows = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _entries(words: DataFrame, least_length: int) -> DataFrame:
    """l, key, word, n, longer, x, w: the index rows of each word (longer 0), and its probes of the words that are one shorter.

    A key is the path of segments shared so far; of the indexed word, the w letters from x on are what is not shared.
    """
    rows = words.select("word", "n", F.char_length("word").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    rows = rows.withColumn("l", F.col("size") - F.col("longer")).where(F.col("l") >= least_length)
    return _cut(rows.withColumns({"x": F.lit(0), "w": F.col("l"), "key": F.lit("")}))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row under its two next segments. The second is shifted by one in a longer word."""
    half = F.expr("w div 2").cast("int")
    first = F.struct(F.concat("key", F.lit("<"), F.substring(F.col("word"), F.col("x") + 1, half)).alias("key"), (F.col("x") + half).alias("x"), (F.col("w") - half).alias("w"))
    second = F.struct(F.concat("key", F.lit(">"), F.substring(F.col("word"), F.col("x") + half + F.col("longer") + 1, F.col("w") - half)).alias("key"), F.col("x"), half.alias("w"))
    return rows.select("l", "word", "n", "longer", F.explode(F.array(first, second)).alias("s")).select("l", "s.key", "word", "n", "longer", "s.x", "s.w")


def _large(rows: DataFrame, bucket: int) -> DataFrame:
    """l, key of the buckets that are to be cut again."""
    sizes = rows.groupBy("l", "key").agg(F.count("*").alias("size"), F.min("w").alias("w"))
    return sizes.where((F.col("size") > bucket) & (F.col("w") > 1)).select("l", "key")


def _split(rows: DataFrame, large: DataFrame, n_large: int) -> tuple[DataFrame, DataFrame]:
    """rows outside of, and inside, the large buckets. Many large buckets meet their rows salted, as they are hot keys."""
    if n_large <= BROADCAST_KEYS:
        return rows.join(F.broadcast(large), ["l", "key"], "left_anti"), rows.join(F.broadcast(large), ["l", "key"], "left_semi")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = ["l", "key", "salt"]
    return salted.join(large, on, "left_anti").drop("salt"), salted.join(large, on, "left_semi").drop("salt")


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether b, as long as a or one longer, differs from it by exactly one replaced or inserted letter."""
    n = len(a)
    if len(b) == n:
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    at = next((i for i in range(n) if a[i] != b[i]), n)
    return a[at:] == b[at + 1 :]


def near_pairs(same: list[bytes], longer: list[bytes]) -> Iterator[tuple[int, int]]:
    """(place in same, place in same + longer) of the pairs that are one edit apart; same are of one length, longer one more."""
    n, m = len(same), len(longer)
    if n * (n + m) <= _FEW:
        others = same + longer
        yield from ((i, j) for i in range(n) for j in range(i + 1, n + m) if one_edit(same[i], others[j]))
        return
    size = len(same[0])
    a = np.frombuffer(b"".join(same), dtype=np.uint8).reshape(n, size)
    b = np.frombuffer(b"".join(longer), dtype=np.uint8).reshape(m, size + 1)
    step = max(1, _BYTES // (size * (n + m)))
    for at in range(0, n, step):
        mine = a[at : at + step, None]
        i, j = np.nonzero((mine != a[None]).sum(axis=2) == 1)
        i += at
        yield from zip(i[i < j].tolist(), j[i < j].tolist(), strict=True)
        if m:
            ahead = np.logical_and.accumulate(mine == b[None, :, :-1], axis=2).sum(axis=2)
            behind = np.logical_and.accumulate((mine == b[None, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            i, j = np.nonzero(ahead + behind >= size)
            yield from zip((i + at).tolist(), (j + n).tolist(), strict=True)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets (same, longer: arrays of word and n): the pairs that are one edit apart."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            b = batch.slice(lo, 2000)
            found: list[tuple] = []
            for same, longer in zip(b.column("same").to_pylist(), b.column("longer").to_pylist(), strict=True):
                rows = same + longer
                code = lambda side: [r["word"].encode("latin-1") for r in side]  # noqa: E731 - all letters are below U+0100
                for i, j in near_pairs(code(same), code(longer)):
                    found.append((rows[i]["word"], rows[i]["n"], rows[j]["word"], rows[j]["n"]))
            cols = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2, strict=True)], names=["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, bucket: int = BUCKET) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n) that are one edit apart, once. words is a written table."""
    rows, settled, tables = _entries(words, least_length), [], []
    while True:
        large = written(_large(rows, bucket), "large-buckets")
        tables.append(large)
        n_large = large.count()
        if not n_large:
            break
        small, inside = _split(rows, large, n_large)
        settled.append(small)
        rows = written(_cut(inside), "cut-again")
        tables.append(rows)
    for small in settled:
        rows = rows.unionByName(small)
    of = lambda longer: F.array_compact(F.collect_list(F.when(F.col("longer") == longer, F.struct("word", "n"))))
    buckets = rows.groupBy("l", "key").agg(of(0).alias("same"), of(1).alias("longer"))
    buckets = buckets.where((F.size("same") > 0) & (F.size("same") + F.size("longer") > 1)).select("same", "longer")
    pairs = written(buckets.mapInArrow(_verify, "a string, n_a long, b string, n_b long").dropDuplicates(["a", "b"]), "near-words")
    discard(*tables)
    return pairs


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root of (word, form): the end of each chain of at most so many steps, by pointer jumps."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    covered = 1
    while covered < steps:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        before, roots = roots, written(roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root")), "roots")
        discard(before)
        covered *= 2
    return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, one_in: int = MISSPELT, bucket: int = BUCKET) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word."""
    words = written(word_counts(docs, id_col, text_col, least_length, one_in).where(F.col("n") >= least_count), "words")
    pairs = near_words(words, least_length, bucket)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("near")))
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "n"), F.struct(-F.col("n"), "near")).alias("best"))
    found = words.join(near, "word", "left")
    holds = F.col("best.n") >= factor * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, F.col("best.n")).alias("form_n"))
    found = written(found, "forms")
    # A chain's counts grow from least_count by factor with each step.
    most, steps = found.agg(F.max("n")).first()[0] or 0, 0
    while max(1, least_count) * factor ** (steps + 1) <= most:
        steps += 1
    roots = _roots(found.where("form is not null"), steps)
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
