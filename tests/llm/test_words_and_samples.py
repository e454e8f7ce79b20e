"""Spelling variants, importance resampling and best-fit packing against brute force and their SQL."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import best_fit, importance, queries, spelling

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FAMILY = ["absolute", "absolote", "absoluts", "absolut", "xabsolute", "absolutely", "ábsolute", "abslute", "abso-lute", "Résoluté", "résolute"]
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n" * 5),
    (4, " ".join(FAMILY) * 2),
    (5, "absolute " * 60 + "absolote " * 3),
    (6, "ÀBSOLUTE ABSOLUTE résolute"),
    (7, "q" * 60_000 + " " + "q" * 60_000),
    (8, " ".join(FAMILY)),
    (8, " ".join(FAMILY)),
    (9, "one two three 4 five " * 9),
    (10, "日本 x1 ÷×÷×÷×÷ " * 8),
    (None, "absolute résolute " * 11),
    (None, None),
]
SCHEMA = "doc_id long, text string, word int, n string, key int, row int, score string, rank int, doc string, at int"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, "n", 2, 3, "s", 4, "d", 5) for d, t in ODD], SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def values(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_importance_resampling"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want) and len(got)


# Spelling variants


def brute_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        found = [(-words[x], x) for x in words if near(w, x)]
        best = min(found, default=None)
        out[w] = (n, len(found), *((best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None)))
    rows = []
    for w, (n, k, form, form_n) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows.append((w, n, k, form, form_n, root))
    return sorted(rows, key=str)


def test_variants_of_odd_rows(odd):
    for df in (odd, odd.unionByName(odd), odd.limit(0), odd.where("doc_id in (1, 2, 3)")):
        got = spelling.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(map(tuple, got.collect()), key=str) == brute_variants(brute_words(pairs(df)))


def test_large_buckets_are_cut_again(spark, monkeypatch):
    """Words of few letters share many segments; small buckets, broadcast or salted, give the same pairs as one large one."""
    rng = random.Random(3)
    words = {"".join(rng.choices("abé", k=rng.choice((7, 7, 8, 9)))): rng.randint(2, 999) for _ in range(700)}
    words |= {f"{w}zzzzzz": n for w, n in list(words.items())[:200]}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))
    for bucket, keys in ((10_000, 100), (8, 100), (8, 0)):
        monkeypatch.setattr(spelling, "BROADCAST_KEYS", keys)
        got = spelling.near_words(table, bucket=bucket).collect()
        assert sorted(tuple(sorted((r.a, r.b))) for r in got) == want and all(words[r.a] == r.n_a and words[r.b] == r.n_b for r in got)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=3, max_size=3), max_size=12), st.sets(st.text("abé", min_size=4, max_size=4), max_size=12))
def test_pairs_of_a_bucket(same, longer):
    same, longer = sorted(same), sorted(longer)
    code = lambda side: [x.encode("latin-1") for x in side]
    want = {(i, j) for i, a in enumerate(same) for j, b in enumerate(same + longer) if i < j and near(a, b)}
    assert set(spelling.near_pairs(code(same), code(longer))) == want


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    got = spelling._roots(spark.createDataFrame(chain, "word string, form string"), 11)
    assert {r.word: r.root for r in got.collect()} == {w: "w11" for w, _ in chain}


# Importance resampling


def brute_resample(docs, target, ngrams=1, least=20):
    def counted(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_UPPER))
        feats = [" ".join(words[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]
        return len(words), Counter(zlib.crc32(f.encode()) % 10000 for f in feats)

    rows = [(d, *counted(t)) for d, t in docs]
    source, wanted = sum((r[2] for r in rows), Counter()), sum((counted(t)[1] for t in target), Counter())
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    out = []
    for d, n_words, c in rows:
        weight = sum(gain(b) * n for b, n in c.items())
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n_words, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: 10 * len(drawn) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


def resampled(df, target, **how):
    got = importance.resample(df, target, **how)
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_of_odd_rows(spark, odd, benchmark):
    texts = [r.text for r in benchmark.collect()]
    thrice = odd.unionByName(odd).unionByName(odd)
    for df, ngrams in ((odd, 1), (thrice, 1), (thrice, 3), (odd.limit(0), 1)):
        assert resampled(df, benchmark, ngrams=ngrams) == brute_resample(pairs(df), texts, ngrams)
    assert resampled(odd, benchmark.limit(0)) == brute_resample(pairs(odd), [])
    empty = odd.where("doc_id <= 3")
    assert {r[3:] for r in resampled(empty, benchmark)} == {(0, r[4], None) for r in resampled(empty, benchmark)}


def test_small_blocks_give_the_same_weights(docs, benchmark, monkeypatch):
    want = resampled(docs, benchmark, ngrams=2)
    monkeypatch.setattr(importance, "BLOCK_DOCS", 3)
    monkeypatch.setattr(importance, "BLOCK_COUNTS", 100)
    monkeypatch.setattr(importance, "CACHE_FEATURES", 50)
    assert resampled(docs, benchmark, ngrams=2) == want == brute_resample(pairs(docs), [r.text for r in benchmark.collect()], 2)


def test_blocks_are_csr(docs):
    row = importance.count_matrix(docs.limit(5), "doc_id", "text").first()
    n_words, pointers, indices, counts = (np.frombuffer(row[c], dtype=np.uint32) for c in ("n_words", "indptr", "indices", "counts"))
    assert len(row.docs) == len(n_words) == len(pointers) - 1 and pointers[-1] == len(indices) == len(counts)
    for lo, hi, n in zip(pointers, pointers[1:], n_words, strict=False):
        assert (np.diff(indices[lo:hi].astype(int)) > 0).all() and counts[lo:hi].sum() == n


# Best-fit packing


def check_packing(df, got, size, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc, text in pairs(df):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            want[doc, piece, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held), sum(r.length for r in rows)


def test_packed_pieces(docs, odd):
    for df, size in ((docs, 2048), (odd, 2048), (odd.unionByName(odd), 64), (odd.limit(0), 64)):
        got = best_fit.pack_best_fit(df, TOKENIZER, size=size)
        n, tokens = check_packing(df, got, size, 0)
        assert n <= -(-tokens // size) + 1


def test_groups_and_what_they_leave(docs):
    """Many small groups: what each leaves in its emptiest bin is packed again, so the whole lacks little."""
    n, tokens = check_packing(docs, best_fit.pack_best_fit(docs, TOKENIZER, group_pieces=25), 2048, 0)
    assert n <= 1.03 * tokens / 2048 + 1


def _bins_ok(lengths, bins, offsets, size):
    for b in set(bins.tolist()):
        inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert [o for o, _ in inside] == [0, *np.cumsum([n for _, n in inside])[:-1].tolist()] and sum(n for _, n in inside) <= size
    return len(set(bins.tolist()))


def _optimum(lengths, size):
    """The fewest bins, by trying all placements."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for at in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[at] >= lengths[i]:
                place(i + 1, [r - lengths[i] if k == at else r for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_few_pieces_against_all_placements(lengths):
    n = _bins_ok(lengths, *best_fit.packed_bins(np.array(lengths, dtype=np.int64), 20), 20)
    best = _optimum(lengths, 20)
    assert best <= n <= best + 1 and best >= best_fit.fewest(np.array(lengths, dtype=np.int64), 20)


def test_search_empties_bins_that_best_fit_leaves():
    saved = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(150, 500, 200)
        before = best_fit.best_fit_decreasing(lengths, 1000)
        n = _bins_ok(lengths, *best_fit.packed_bins(lengths, 1000), 1000)
        assert best_fit.fewest(lengths, 1000) <= n <= before.max() + 1
        saved += before.max() + 1 - n
    assert saved > 10


def test_every_step_raises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    lengths = rng.integers(100, 700, 120)
    search = best_fit.Search(lengths, np.arange(120) // 2 * 0 + np.arange(120), 1000)  # a bin each
    kinds, score = set(), search.score()
    for source in itertools.cycle(range(120)):
        before = search.bins.copy()
        if not (0 < search.fill[source] < 1000 and search.step(source)):
            if not any(0 < search.fill[s] < 1000 and search.step(s) for s in range(120)):
                break
        else:
            moved = (before != search.bins).sum()
            kinds.add(int(moved))
        assert search.score() > score and search.fill.max() <= 1000
        score = search.score()
        assert np.array_equal(search.fill, np.bincount(search.bins, weights=lengths, minlength=120).astype(int))
    assert kinds == {1, 2, 3}


def test_best_fit_takes_the_fullest_bin():
    lengths = np.array([60, 55, 40, 45, 3])
    assert best_fit.best_fit_decreasing(lengths, 100).tolist() == [0, 1, 0, 1, 2]
    assert best_fit.best_fit_decreasing(np.array([70, 50, 28]), 100).tolist() == [0, 1, 0]


def test_extra_columns_do_not_matter(odd):
    bare = odd.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "word", "n", "row")
    want = sorted(map(tuple, spelling.spelling_variants(odd).collect()), key=str)
    assert sorted(map(tuple, spelling.spelling_variants(bare, "id", "body").collect()), key=str) == want
