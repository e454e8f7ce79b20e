"""Line dedup: range-partitioned line hashes, streamed in order, to keep bitmaps.

1. Every line that is long enough becomes a 24-byte row: a 128-bit hash of its key and its place. No text moves.
2. The rows are range-partitioned by (hash, document descending, position) and sorted within partitions. As the
   document is part of the range key, one hot line is dealt over many partitions.
3. Each partition is streamed once. A key that lies wholly inside it is decided there: the first document of a run
   holds the kept occurrence, and the others go once the run is known to span enough documents. The first and the last key of a partition may
   continue next door; their rows are passed on and decided by a two-level aggregate over at most two keys per
   partition, whose verdicts are broadcast (bound: twice the number of partitions).
4. Dropped positions are gathered by document into compressed bitmaps, which are joined to the documents.

Edge cases: a null text is an empty text (one empty line). A row with a null id keeps all its lines and counts for no
other row. Rows that repeat an id count as one document; rows with the same id and different texts have bitmaps of
their own. Other columns are ignored, whatever their names: they move in one struct. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, as_rows, ascii_lower, discard, lines_of, named, of_row, written

_STREAMED = "edge boolean, h1 long, h2 long, doc long, fp long, pos int, n_lines int"


def _stream(min_docs: int):
    """mapInArrow function over rows in the order (h1, h2, doc descending, fp, pos)."""

    def batch_of(rows: np.ndarray, edge: bool) -> pa.RecordBatch:
        columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), edge)), *columns, *(pa.array(rows[:, i].astype(np.int32)) for i in (4, 5))], names=["edge", "h1", "h2", "doc", "fp", "pos", "n_lines"])

    def later(run: list[np.ndarray]) -> np.ndarray:
        """The rows of a whole run that are dropped: all but its first document's, if it has enough documents."""
        rows = np.concatenate(run) if len(run) > 1 else run[0]
        enough = np.count_nonzero(np.diff(rows[:, 2])) + 1 >= min_docs
        return rows[rows[:, 2] != rows[0, 2]] if enough else rows[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = None
        open_run: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
            cuts = (np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1).tolist()
            dropped, edges = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                here = (rows[lo, 0], rows[lo, 1])
                if first is None:
                    first = key = here
                if here != key:
                    if key != first:
                        dropped.append(later(open_run))
                    key, open_run = here, []
                if here == first:
                    edges.append(rows[lo:hi])
                else:
                    open_run.append(rows[lo:hi])
            if edges:
                yield batch_of(np.concatenate(edges), True)
            if dropped:
                yield batch_of(np.concatenate(dropped), False)
        if open_run:
            yield batch_of(np.concatenate(open_run), True)

    return run


def _bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """zlib-compressed bits of a document's lines, 1: keep."""
    keep = np.ones(n_lines, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_text(text: str, bitmap: bytes | None) -> str:
    """The lines that bitmap keeps, joined; all of them for None."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join([lines[i] for i in np.flatnonzero(keep)])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [_bitmap(n, np.array(at, dtype=np.int64)) for n, at in zip(b.column("n_lines").to_pylist(), b.column("at").to_pylist(), strict=True)]
        dropped = pa.array([len(x) for x in b.column("at").to_pylist()], type=pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("fp"), dropped, pa.array(made, type=pa.binary())], names=["doc", "fp", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc, fp (xxhash64 of the text), n_dropped, keep_bitmap of the documents that lose lines.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least min_chars
    code points in at least min_docs documents lose all lines but those of the largest document.
    """
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text")).where("doc is not null")
    rows = rows.select("doc", F.xxhash64("text").alias("fp"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select("doc", "fp", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc", "fp", "pos", "n_lines", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).where(F.length("key") >= min_chars)
    rows = written(rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"), "doc", "fp", "pos", "n_lines"), "line-hashes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.desc("doc"), "fp", "pos"]
    streamed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), _STREAMED), "line-runs")
    discard(rows)

    edge = streamed.where("edge")
    verdict = edge.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    # At most the first and the last key of each range partition have edge rows: that bounds the broadcast.
    more = edge.join(F.broadcast(verdict), ["h1", "h2"]).where("doc <> keeper")
    dropped = streamed.where("not edge").select("doc", "fp", "pos", "n_lines").unionByName(more.select("doc", "fp", "pos", "n_lines"))
    # Equal rows of one document give equal positions: collect_set makes them one.
    gathered = dropped.groupBy("doc", "fp").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("at"))
    return gathered.mapInArrow(_bitmaps, "doc long, fp long, n_dropped long, keep_bitmap binary")


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **rules) -> DataFrame:
    """row (all of docs' columns), n_dropped and keep_bitmap."""
    maps = keep_bitmaps(docs, id_col, text_col, **rules)
    # The row's own fingerprint is a join key, so rows that share an id get the bitmap of their own text.
    joined = as_rows(docs).join(maps, (of_row(id_col).cast("long") == F.col("doc")) & (F.xxhash64(of_row(text_col)) == F.col("fp")), "left")
    return joined.select("row", "n_dropped", "keep_bitmap")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """docs with the dropped lines gone from text_col; a null text stays null, and n_chars, if there, is counted anew."""
    joined = _with_bitmaps(docs, id_col, text_col, **rules)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            columns = [row.field(i) for i in range(row.type.num_fields)]
            at = row.type.get_field_index(text_col)
            texts = [t if t is None else kept_text(t, m) for t, m in zip(columns[at].to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True)]
            columns[at] = pa.array(texts, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[row.type.field(i).name for i in range(row.type.num_fields)])

    done = joined.mapInArrow(apply, docs.schema)
    return done.withColumn("n_chars", F.length(named(text_col)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256, keep_bitmap (null: every line is kept) of each row of docs."""
    docs = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    joined = _with_bitmaps(docs, "id", "text", **rules).select("row.id", "row.text", "n_dropped", "keep_bitmap")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, hashes = [], []
            for t, m in zip(b.column("text").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
                t = t or ""
                lines.append(t.count("\n") + 1)
                hashes.append(hashlib.sha256(kept_text(t, m).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lines, type=pa.int64()), b.column("n_dropped").fill_null(0), pa.array(hashes, type=pa.string()), b.column("keep_bitmap")], names=[id_col, "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])

    return joined.mapInArrow(digest, f"`{id_col}` long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary")
