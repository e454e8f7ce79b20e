"""Target-distribution importance resampling over a sparse document-by-bucket count matrix, held as CSR blocks.

1. Each text's features (runs of 1 to ngrams words) are counted in buckets by their checksum. The counts are persisted as rows of
   the matrix: a block holds BLOCK_DOCS documents, or fewer if they have over BLOCK_COUNTS counts, as indptr, indices and counts.
2. The matrix's column sums are the distribution of the documents; those of the target texts' matrix the target's.
   A bucket's gain is the scaled logarithm of their smoothed ratio. There are as many gains as buckets, which bounds what is
   broadcast.
3. The matrix times the gains, a sparse product block by block, is the documents' weights. With a seeded Gumbel noise on
   each, the largest scores are a sample without replacement. Scores are sorted by ranges, and a range's first rank is
   the number of rows before it, so no task sees all rows.

Edge cases: a null or empty text has no features and the weight 0, and is never drawn. A very long text has at most as many
counts as there are buckets. Rows that repeat an id are drawn each for itself, ties in any order; a null id is an empty one in the seed and
comes last among ties. Other columns are ignored, whatever their names. Empty documents give an empty result; an empty
target is an even one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named, written

BUCKETS = 10_000
NGRAMS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SCALE = 1000
BLOCK_DOCS = 256
BLOCK_COUNTS = 200_000
CACHE_FEATURES = 250_000
_MATRIX = "docs array<bigint>, n_words binary, indptr binary, indices binary, counts binary"
#: Byte to byte: A-Z lower-cased, digits, a-z and all beyond ASCII as they are, the rest to a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Feature to its bucket, for those met in this task; it starts anew beyond CACHE_FEATURES."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHE_FEATURES:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.buckets
        return b


def features(text: bytes | None, ngrams: int = NGRAMS) -> tuple[list[bytes], int]:
    """The features of a text, repeated as they are, and its number of words."""
    words = (text or b"").translate(_LETTERS).split()
    runs = [b" ".join(words[i : i + k]) for k in range(2, ngrams + 1) for i in range(len(words) - k + 1)]
    return words + runs, len(words)


def count_matrix(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> DataFrame:
    """The matrix's blocks of rows: docs (ids), n_words (uint32), and CSR: indptr (uint32, docs + 1), indices, counts (uint32)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        ids, n_words, rows, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            found, n = zip(*rows, strict=True)
            pointers = np.cumsum([0, *map(len, found)], dtype=np.uint32)
            data = [pa.array([ids], type=pa.list_(pa.int64()))]
            for x in (np.array(n_words), pointers, np.concatenate(found), np.concatenate(n)):
                data.append(pa.array([x.astype(np.uint32).tobytes()], type=pa.binary()))
            return pa.RecordBatch.from_arrays(data, names=["docs", "n_words", "indptr", "indices", "counts"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                all_features, words = features(text.as_py(), ngrams)
                at = np.fromiter(map(known.__getitem__, all_features), dtype=np.int64, count=len(all_features))
                rows.append(np.unique(at, return_counts=True))
                ids.append(doc)
                n_words.append(words)
                held += len(rows[-1][0])
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_COUNTS:
                    yield block()
                    ids, n_words, rows, held = [], [], [], 0
        if ids:
            yield block()

    return docs.select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text")).mapInArrow(blocks, _MATRIX)


def _array(column: pa.Array, at: int) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), dtype=np.uint32)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """int64 sums of each bucket: every task adds up its blocks, so at most buckets rows a task are shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                at = _array(b.column("indices"), i)
                total += np.bincount(at, weights=_array(b.column("counts"), i), minlength=buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    rows = matrix.select("indices", "counts").mapInArrow(sums, "bucket long, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """int64: of each bucket, the scaled logarithm of the target's smoothed share against the source's, rounded down."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratio = ((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(scale * math.log(r)) for r in ratio], dtype=np.int64)


def weighted(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc, n_words, n_features, weight: the matrix's row sums, and its product with gain."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                pointers = _array(b.column("indptr"), i).astype(np.int64)
                counts = _array(b.column("counts"), i).astype(np.int64)
                n, w = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * gain[_array(b.column("indices"), i)]))
                rows = [b.column("docs")[i].values, pa.array(_array(b.column("n_words"), i).astype(np.int64)), *(pa.array(np.diff(x[pointers])) for x in (n, w))]
                yield pa.RecordBatch.from_arrays(rows, names=["doc", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(product, "doc long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, scale: int = SCALE) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Of the documents with at least least_words words, percent in a hundred are drawn.
    """
    matrix = written(count_matrix(docs, id_col, text_col, buckets, ngrams), "matrix")
    wanted = column_sums(count_matrix(target, target_id, target_text, buckets, ngrams), buckets)
    rows = weighted(matrix, gains(column_sums(matrix, buckets), wanted, scale))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = rows.withColumn("score", F.col("weight") + F.floor(-scale * F.log(-F.log(uniform))).cast("long"))
    # A row's number breaks the ties of repeated rows, so that ranges can part them.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    enough = F.col("n_words") >= least_words
    ordered = rows.where(enough).orderBy(F.desc("score"), F.asc_nulls_last("doc"), "row").drop("row")
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy(part).agg(F.count("*").alias("n")).collect())  # a row a range
    firsts, before = [(-1, 0)], 0
    for p, n in sizes:
        firsts.append((p, before))
        before += n
    firsts = F.broadcast(docs.sparkSession.createDataFrame(firsts, "part long, first long"))
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.select("*", part).join(firsts, "part").withColumn("rank", F.when(rank <= before * percent // 100, rank))
    others = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    out = ["n_words", "n_features", "weight", "score", "rank"]
    return ranked.select("doc", *out).unionByName(others.select("doc", *out)).withColumnRenamed("doc", id_col)
