"""Token counts: a count-only Viterbi over a unigram vocabulary, whose matches an Aho-Corasick automaton enumerates.

For each end place, the matches come longest first; the best score and the number of pieces of its path are carried
along, and no path is kept. Ties go to the match that begins first, as in the tokenizer (a later candidate must be
better). A character that is no piece costs 10 more than the worst piece; runs of such characters count as one piece.

A word, with the mark of its beginning, is tokenized by itself, so a worker keeps the counts of the words it has met
(at most CACHE_WORDS, then it starts anew). The vocabulary (pieces and scores) is read from a public tokenizer file.

Edge cases: null and empty texts, and white space alone, have no pieces. Rows are independent of each other, so
repeated rows get the same count each. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 500_000
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: What separates words beside the characters that bytes.split() knows.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


#: A mark within a word begins a word too.
_MARKED = re.compile(f"{MARK}[^{MARK}]*")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in n if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]


class UnigramCounter(dict):
    """word (bytes) to its number of pieces."""

    _made: dict[str, "UnigramCounter"] = {}

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def at(cls, path: str) -> "UnigramCounter":
        if path not in cls._made:
            cls._made[path] = cls(vocabulary(path))
        return cls._made[path]

    def pieces(self, word: str) -> int:
        """Number of pieces of the best segmentation of one marked word."""
        size = len(word)
        score, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        done = 0
        matches = self.automaton.iter(word)
        end, match = next(matches, (size, None))
        while done < size:
            done += 1
            best = None
            single = False
            while end + 1 == done and match is not None:
                length, own = match
                start = done - length
                if length == 1:
                    single = True
                total = score[start] + own
                if best is None or total > best:
                    best, from_start = total, start
                end, match = next(matches, (size, None))
            if best is not None:
                score[done], count[done] = best, count[from_start] + 1
            if not single and (best is None or score[done - 1] + self.unknown > best):
                score[done] = score[done - 1] + self.unknown
                count[done] = count[done - 1] + (not unknown[done - 1])
                unknown[done] = True
        return count[size]

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        n = sum(self.pieces(x) for w in _WIDE_SPACE.split(text) if w for x in _MARKED.findall(w if w[0] == MARK else MARK + w))
        if len(word) <= 200:
            self[word] = n
        return n

    def count(self, text: bytes | None) -> int:
        return sum(map(self.__getitem__, (text or b"").split()))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter.at(vocabulary_path)
        for b in batches:
            counts = [counter.count(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, type=pa.int64())], names=[id_col, "n_pieces"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_pieces long")
