"""Mixing, LM scoring, top-k, HTML, licences, token counts and the pipeline against brute force."""

import math
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_documents import ODD, pairs
from tidemark.llm import html_text, license_scan, lm_scoring, mixing, near_dedup, packing, token_counts, topk

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else None, f"src{(d or 0) % 3}", 5, "x") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key int, uid string")


def test_scores(documents, odd):
    for df in (documents, odd, odd.unionByName(odd), odd.limit(0)):
        got = sorted((tuple(r)[:6] for r in lm_scoring.score(df, top_words=50).collect()), key=str)
        want = sorted(brute.base_scores([(d, t) for d, t in pairs(df)]), key=str) if df is documents else None
        assert len(got) == df.count()
        if want:
            for a, b in zip(got, want, strict=True):
                assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_scores_of_odd_rows(odd):
    docs = odd.where("doc_id is not null")
    want = {r[0]: r for r in brute.base_scores(pairs(docs))}
    for r in lm_scoring.score(docs).collect():
        assert tuple(r)[:5] == want[r.doc_id][:5] and math.isclose(r.base_score, want[r.doc_id][5], rel_tol=1e-9)
        assert r.score <= 0


def test_held_out_texts_score_better_than_the_base(documents):
    r = lm_scoring.score(documents).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_shards_give_the_same_scores(documents, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_segment_number", lambda *_: 16)  # wrong probes depend on the segments
    noted = []
    note = lm_scoring._note
    monkeypatch.setattr(lm_scoring, "_note", lambda words, shard, n: noted.append(shard) or note(words, shard, n))
    docs = documents.limit(60).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = lambda **kw: sorted(map(tuple, lm_scoring.score(docs, **kw).collect()), key=str)
    one = rows()
    for size, word_shards in ((40_000, False), (4_000, True)):  # bytes: several shards of pairs, then of words too
        noted.clear()
        two = rows(shard_bytes=size)
        assert (len(noted) > 1) == word_shards and len(one) == len(two)
        for a, b in zip(one, two, strict=True):
            assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:], strict=True))


def test_dealt_pairs_move_few_bytes(documents, monkeypatch):
    """A pair filter that is not broadcast: what is written of the texts' pairs is below the 17 bytes a token of keys, texts and levels."""
    moved, written = [], lm_scoring.written

    def noted(df, name):
        out = written(df, name)
        moved.append((name, sum(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles())))
        return out

    monkeypatch.setattr(lm_scoring, "written", noted)
    docs = documents.limit(60)
    tokens = lm_scoring.score(docs, shard_bytes=25_000).agg(F.sum("n_tokens")).first()[0]
    assert sum(size for name, size in moved if name not in ("words", "levels", "bloom")) < 8 * tokens, (tokens, moved)


def test_dealt_runs_of_many_texts(spark, monkeypatch):
    """Steps between the texts of a segment's pairs of one, two and four bytes, held-out texts among them."""
    monkeypatch.setattr(lm_scoring, "_segment_number", lambda *_: 64)
    late = " ".join(f"late{i}" for i in range(40))
    rows = [(i, late if i == 89_990 else "to be or not to be" if i % 20_000 == 7 else f"w{i % 3} x" if i % 300 == 5 else None) for i in range(90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    of = lambda: {r.doc_id: tuple(r)[1:] for r in lm_scoring.score(docs, top_words=20).collect()}
    one, sent, in_order = of(), [], lm_scoring._in_order
    monkeypatch.setattr(lm_scoring, "PAIR_BYTES", 0)
    monkeypatch.setattr(lm_scoring, "_in_order", lambda df, *a: sent.append(df) or in_order(df, *a))
    two = of()
    widths = {r.width for r in sent[-1].where("home is null").select("width").distinct().collect()}
    assert widths == {1, 2, 4}
    assert one.keys() == two.keys() and len(one) == 90_000
    for d, a in one.items():
        assert a[:4] == two[d][:4] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[4:], two[d][4:], strict=True))


def test_segments_fit_their_shards(documents, monkeypatch):
    made, shards = [], lm_scoring._shards
    monkeypatch.setattr(lm_scoring, "_shards", lambda sizes, n, most: made.append((sizes, n, shards(sizes, n, most))) or made[-1][2])
    lm_scoring.score(documents.limit(30), shard_bytes=20_000).count()
    assert len(made) == 2  # words, pairs
    for sizes, n, found in made:
        assert [i for low, high in found for i in range(low, high)] == list(range(n))
        assert all(sum(sizes.get(i, 8) for i in range(low, high)) <= 20_000 for low, high in found)


def test_scores_of_words_counted_beyond_46341_times(spark):
    """The bigram formula with exact counts: words and pairs of equal levels have equal counts here."""
    n = 80_000
    docs = spark.createDataFrame([(1, "a a a b " * n), (6, "a b a")], "doc_id long, text string")
    assert lm_scoring.held_out(6) and not lm_scoring.held_out(1)
    c, room = {"a": 3 * n, "b": n, None: 1}, 4 * n + 1 + 0.1 * 4
    pairs_of = {(None, "a"): 1, ("a", "a"): 2 * n, ("a", "b"): n, ("b", "a"): n - 1, ("b", None): 1}
    kinds = {"a": 2, "b": 2, None: 1}

    def p(h, w):
        return max(pairs_of.get((h, w), 0) - 0.5, 0) / c[h] + 0.5 * kinds[h] / c[h] * (c[w] + 0.1) / room

    text = [None, "a", "b", "a", None]
    want = sum(math.log10(p(h, w)) for h, w in zip(text, text[1:], strict=False))
    got = lm_scoring.score(docs).where("held_out").first()
    assert math.isclose(got.score, want, abs_tol=0.001), (got.score, want)


def test_levels_reach_any_count():
    import numpy as np

    counts = 2 ** np.arange(0, 61, dtype=np.int64)
    got = lm_scoring.levels(counts, lm_scoring.WORD_STEPS)
    assert got.tolist() == [1 + lm_scoring.WORD_STEPS * i for i in range(61)] and got.max() < lm_scoring.LEVELS
    keys = lm_scoring.pair_keys(counts.view(np.uint64), counts.view(np.uint64), got)
    assert (keys & np.uint64(lm_scoring.LEVELS - 1)).tolist() == got.tolist()


def test_filter_levels_are_seldom_too_high():
    import numpy as np

    keys = np.random.default_rng(7).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    for hashes in (lm_scoring.WORD_HASHES, lm_scoring.PAIR_HASHES):
        raw = lm_scoring.Filter.segment(keys, np.ones(20_000, dtype=np.int64), hashes)
        f = lm_scoring.Filter(np.array([len(raw)]), np.frombuffer(raw, dtype=np.uint8), hashes)
        assert (f.levels(keys, np.zeros(20_000, dtype=np.int64)) > 1).mean() < 0.05


def test_remembered_levels_are_the_filters(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    raw = lm_scoring.Filter.segment(keys, rng.integers(1, 12, len(keys)), (8, 2))
    f = lm_scoring.Filter(np.array([len(raw)]), np.frombuffer(raw, dtype=np.uint8), (8, 2))
    for most in (1_000_000, 700, 0):
        monkeypatch.setattr(lm_scoring, "KNOWN_PAIRS", most)
        known = lm_scoring._Known(f, 1)
        for _ in range(20):
            asked = np.unique(rng.choice(keys, 500) ^ np.uint64(rng.integers(0, 2)))
            assert (known.levels(asked) == f.levels(asked, np.zeros(len(asked), dtype=np.int64))).all()
            assert (np.diff(known.keys.astype(float)) > 0).all()


def test_filter_levels_are_never_too_low():
    import numpy as np

    keys = np.random.default_rng(5).integers(0, 1 << 63, 5000, dtype=np.uint64)
    level = np.random.default_rng(6).integers(1, 12, 5000)
    raw = lm_scoring.Filter.segment(keys, level, (8, 2))
    f = lm_scoring.Filter(np.array([len(raw)]), np.frombuffer(raw, dtype=np.uint8), (8, 2))
    zero = np.zeros(5000, dtype=np.int64)
    assert (f.levels(keys, zero) >= level).all()
    assert (f.levels(keys ^ np.uint64(1 << 63), zero) > 0).mean() < 0.02


def test_top_k(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("id"), F.lit(2).alias("score"))
    odd = spark.createDataFrame([(0, [1.0, 0.5]), (0, [1.0, 0.5]), (20, [0.0]), (1, [1.0]), (2, [1.0, None]), (3, None), (4, [float("nan")]), (None, [1.0]), (5, [1.0, 0.0, 9.0]), (6, [1e12]), (7, [])], "vec_id long, embedding array<double>")
    for df, block in ((vecs, 4096), (vecs, 3), (odd, 4096), (odd.limit(0), 4096)):
        rows = {}
        for r in df.collect():
            v = r.embedding
            if r.vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
                rows[r.vec_id] = [math.floor(64 * x) for x in v]
        want = []
        for q, x in rows.items():
            if q % 20 == 0:
                scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows.items() if i != q)[:20]
                want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
        got = topk.top_k(df, F.col("id") % 20 == 0, query_block=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_mixing(documents, odd):
    for df in (documents, documents.unionByName(documents.limit(20)), odd, odd.limit(0)):
        how = {"tokens_share": 0.7, "max_epochs": 3, "weights": {"domain0": 3.0, "domain1/en": 0.5}}
        got = mixing.mix_report(df, **how)
        want = _copies(df, how)
        have = Counter()
        for r in got.collect():
            have[r.doc_id] += r.copies
        assert +have == +want
        assert mixing.mixed(df, **how).schema.names == df.schema.names
        assert mixing.mixed(df, **how).count() == sum(want.values())


def _copies(df, how):
    """{doc_id: how many rows of it the mixture gives}"""
    rows = df.withColumns({"place": F.xxhash64(F.lit(29), "doc_id", F.xxhash64("text")), "domain": mixing.source_domain(F.col("source"))}).collect()
    want = Counter()
    leaves = defaultdict(list)
    for r in rows:
        leaves[r.domain, r.lang, r.source].append((r.place, len(brute.WORD.findall(r.text or "")), r.doc_id))
    tokens = {k: sum(x[1] for x in v) for k, v in leaves.items()}
    budget = _budgets(tokens, int(sum(tokens.values()) * how["tokens_share"]), how["weights"], how["max_epochs"])
    for k, docs in leaves.items():
        t = max(tokens[k], 1)
        full, more = (1, 0) if not tokens[k] else (budget[k] // t, budget[k] % t)
        by_place = defaultdict(int)
        for p, n, _ in docs:
            by_place[p] += n
        run, taken = 0, set()
        for p in sorted(by_place):
            run += by_place[p]
            if run > more:
                break
            taken.add(p)
        if not tokens[k]:
            taken = set()
        for p, _, d in docs:
            want[d] += full + (p in taken)
    return want


def _budgets(tokens, budget, weights, epochs):
    """Water-filling by repeated rounds: what is full leaves, and the rest share anew."""
    given = {(): budget}
    for depth in (1, 2, 3):
        nodes = defaultdict(int)
        for k, n in tokens.items():
            nodes[k[:depth]] += n * epochs
        below = {}
        for parent, b in given.items():
            kids = {k: c for k, c in nodes.items() if k[: depth - 1] == parent}
            w = {k: weights.get("/".join("null" if x is None else x for x in k), 1.0) for k in kids}
            open_, left = set(kids), b
            while True:
                total = sum(w[k] for k in open_)
                full = {k for k in open_ if kids[k] * total <= left * w[k]}
                if not full:
                    break
                left -= sum(kids[k] for k in full)
                open_ -= full
            for k in kids:
                below[k] = kids[k] if k not in open_ else min(kids[k], math.floor(left * w[k] / total))
        given = below
    return given


HTML = """<!DOCTYPE html><title>T</title><style>p{}</style><h1>Head</h1><p>one<br>two <b>bold</b> x<p>para &amp; <span style="display: none">no</span>two
<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul><table><tr><th>Name<th>N<tr><td>longer cell<td>1</table><pre> a
  b</pre><div hidden>z</div>tail<script>var t="</p>";</script> end<!-- x --></body>"""


def test_html(spark, sf):
    assert html_text.visible_text(HTML) == "Head\n\none\ntwo bold x\n\npara & two\n\n- a\n- b\n  3. c\n  4. d\n- e\n\nName         N\nlonger cell  1\n\n a\n  b\n\ntail end"
    for page in (None, "", "<p", "<!--", "<script>x", "</div></p>", "<table><td>", "<li>" * 3000, "<div>" * 5000 + "x", "a < b", "<ul></ul>"):
        assert isinstance(html_text.visible_text(page), str)
    assert html_text.visible_text("<div>" * 5000 + "x") == "x" and html_text.visible_text("a < b") == "a < b"
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        # Every word outside of tags, scripts and the head is there, in order.
        from html.parser import HTMLParser

        words, skip = [], []

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag in ("head", "script", "style"):
                    skip.append(tag)

            def handle_endtag(self, tag):
                if skip and skip[-1] == tag:
                    skip.pop()

            def handle_data(self, data):
                if not skip:
                    words.append(data)

        Reader().feed(r.html)
        assert "".join(got[r.page_id].split()).replace("-", "") == "".join(" ".join(words).split()).replace("-", "")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_licenses(documents, odd):
    found = {r.doc_id: (r.license, r.coverage) for r in license_scan.scan_licenses(documents).collect()}
    for d, t in pairs(documents):
        assert (found[d][0] is not None) == ("icense" in t), t
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    assert scanner.scan(b"this, and that. Licensed under the Apache License (Version 2.0). the end") == ("Apache-2.0", 1.0, 7, 3, 9)
    assert scanner.scan(b"released " + b"x " * 50 + b"under the x license")[0] is None
    assert license_scan.scan_licenses(odd).where("license is null").count() == len(ODD)
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
    assert license_scan.increasing([5, 1, 2, 9, 3, 4]) == [1, 2, 4, 5]


def test_html_of_formulas_drawings_and_lists():
    visible = html_text.visible_text
    assert visible("a <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2 tex</annotation></semantics></math> b") == "a x=2 b"
    assert visible("<svg><defs/><title>no</title><style>p{}</style><desc>no</desc><path d='M0'/><text x='1'>One</text><text>Two</text></svg>") == "One\nTwo"
    assert visible("pick <select><option>A<option selected>B</select>") == "pick\nA\nB"
    assert visible("<select><optgroup label='G'><option>A</option></optgroup></select>") == "G\nA"
    assert visible("x <span aria-hidden=true>star</span> y <span hidden>no</span>") == "x star y"
    assert visible("<desc>one</desc> <text>two</text>") == "one two"


def test_notices_that_occur_several_times():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    assert scanner.scan(b"the cat. Released under the MIT License. the dog. Released under the MIT License. the end") == ("MIT", 1.0, 5, 2, 6)
    for copies in (1, 2, 3, 50):
        for name, notice in license_scan.TEMPLATES.items():
            for between in ("", "the cat of the License under a ", "word " * 500):
                text = "in the " + f"{notice}. {between}" * copies + "the end"
                got = scanner.scan(text.encode())
                assert got[:3] == (name, 1.0, len(notice.split())), (name, copies, got)
    # One word of each copy is another.
    assert scanner.scan(b"of the " + b"Released under the new License. the end under the " * 3)[:3] == ("MIT", 0.8, 4)


def test_all_notices_of_a_text_are_listed(spark):
    texts = ["in short: Licensed under the Apache License, Version 2.0. also Licensed under CC BY-NC 4.0 here", "Released under the MIT License", "nothing", None]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[(x.license, x.coverage, x.n_matched, x.last_word) for x in r.licenses] for r in rows] == [[("Apache-2.0", 1.0, 7, 8), ("CC-BY-NC-4.0", 1.0, 5, 14)], [("MIT", 1.0, 5, 4)], [], []]
    assert [r.license for r in rows] == ["Apache-2.0", "MIT", None, None]


def test_matches_in_windows_are_the_longest():
    import random

    rng = random.Random(4)
    for _ in range(1500):
        template = [rng.choice("abcdef").encode() for _ in range(rng.randint(1, 7))]
        words = [rng.choice(template) for _ in range(rng.randint(0, 25))]
        places = sorted(rng.sample(range(40), len(words)))
        most, need = rng.randint(1, 3 * len(template)), rng.randint(1, len(template))
        want = 0
        for i in range(len(words)):
            row = [0] * (len(template) + 1)
            for w, p in zip(words[i:], places[i:], strict=True):
                if p - places[i] < most:
                    above = row[:]
                    for j, x in enumerate(template, 1):
                        row[j] = max(row[j - 1], above[j], above[j - 1] + (w == x))
            want = max(want, row[-1])
        n, first, last = license_scan.in_windows(words, places, template, most, need)
        assert n == (want if want >= need else 0)
        assert not n or 0 <= last - first < most and first in places and last in places


def test_scanner_equals_brute_force_alignment(spark):
    """The longest match in the template's order in any window of three template lengths, for every template that reaches the least coverage."""
    import random

    rng = random.Random(9)
    templates = {f"t{i}": " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for i in range(6)}
    scanner = license_scan.Scanner(templates, 0.8)
    texts = [None, "", "x"]
    for _ in range(300):
        parts = [rng.choice([rng.choice(list(templates.values())), " ".join(rng.choice("abcdefghijxyz") for _ in range(rng.randint(1, 12)))]) for _ in range(rng.randint(1, 6))]
        texts.append(" ".join(parts))

    def longest(words, template):
        best = 0
        for i in range(len(words)):
            row = [0] * (len(template) + 1)
            for w in words[i : i + 3 * len(template)]:
                above = row[:]
                for j, x in enumerate(template, 1):
                    row[j] = max(row[j - 1], above[j], above[j - 1] + (w == x))
            best = max(best, row[-1])
        return best

    hits = 0
    for text in texts:
        words = (text or "").split()
        want = {}
        for name, template in templates.items():
            n = longest(words, template.split())
            if n and n / len(template.split()) >= 0.8:
                want[name] = n
        got = scanner.scan_all(None if text is None else text.encode())
        assert {x[0]: x[2] for x in got} == want, text
        assert all(last - first < 3 * len(templates[name].split()) for name, _, _, first, last in got)
        hits += bool(want)
    assert hits > 100
    df = spark.createDataFrame(list(enumerate(texts[:40])), "doc_id long, text string")
    rows = {r.doc_id: {x.license: x.n_matched for x in r.licenses} for r in license_scan.scan_licenses(df.unionByName(df), templates=templates).collect()}
    assert rows == {i: {x[0]: x[2] for x in scanner.scan_all(None if t is None else t.encode())} for i, t in enumerate(texts[:40])}


def test_full_texts_are_found_in_long_documents():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    for name in ("MIT-full", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Apache-full-notice"):
        words = license_scan.TEMPLATES[name].split()
        changed = " ".join("changed" if i % 17 == 9 else w for i, w in enumerate(words))
        found = scanner.scan_all(("the software of the license " * 4000 + changed + " and the conditions " * 4000).encode())
        assert name in {x[0] for x in found}, name


def test_html_visibility():
    visible = html_text.visible_text
    assert visible("x <b style='visibility:hidden'>no <i style='visibility: visible'>yes</i> no</b> y") == "x yes y"
    assert visible("a<dialog>no</dialog><dialog open>yes</dialog>") == "a\nyes"
    assert visible("<div style='VISIBILITY:hidden'><p>no<p style='visibility:visible'>yes <img alt=pic><p>no <img alt=no></div>") == "yes pic"
    assert visible("<div style='display:none'><p style='visibility:visible'>no</p></div>") == ""
    assert visible("<table><tr style='visibility:collapse'><td>gone<tr><td style='visibility:hidden'>no<td>b</table>") == "  b"


def test_html_table_layout():
    visible = html_text.visible_text
    page = "<table><caption>Fruit of all sorts</caption><tr><th colspan=2>Two columns<th>N<tr><td>a<td>bb<td>c<tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4<tr><td colspan=0>x<td rowspan=zero>y</table>"
    assert visible(page) == "Fruit of all sorts\nTwo columns  N\na  bb        c\nr  1         2\n   3         4\nx  y"
    assert visible("<table><tr><td>日本<td>x<tr><td>abcde<td>y<tr><td>e\u0301<td>z</table>") == "日本   x\nabcde  y\ne\u0301      z"
    assert visible("<table><tr><td colspan=3>a very long heading here<tr><td>a<td>b<td>c</table>") == "a very long heading here\na  b  c"
    assert visible("<table><tr><td>one<br>two<td>x<tr><td><table><tr><td>in<td>ner</table><td>y</table>") == "one      x\ntwo\nin  ner  y"
    assert visible("<table><tr><td rowspan=99999999999>a<td>b<tr><td colspan=5000>c</table>") == "a  b\n   c"


def test_html_golden_pages():
    visible = html_text.visible_text
    page = "<html><head><title>no</title></head><body><header><nav><ul><li><a href=/>Home</a><li><a href=/x>About</a></ul></nav></header><main><h1>Title</h1><p>First <em>para</em>graph,\n two   lines.<p>Second.<blockquote>Said<br>twice</blockquote><dl><dt>Term<dd>Meaning</dl></main><footer>&copy; 2024</footer></body></html>"
    assert visible(page) == "- Home\n- About\n\nTitle\n\nFirst paragraph, two lines.\n\nSecond.\n\nSaid\ntwice\n\nTerm\nMeaning\n\n© 2024"
    assert visible("<ol start=9><li>nine<li>ten<ul><li>inner<p>para</ul><li>eleven</ol>") == "9. nine\n10. ten\n    - inner\n\n      para\n\n11. eleven"
    assert visible("<pre>a\tb\n\n  c</pre>after") == "a\tb\n\n  c\n\nafter"


def test_html_of_odd_rows(spark):
    rows = [(1, None, "u", "t"), (2, "", "u", None), (3, "<p>x", None, "t"), (3, "<p>x", None, "t"), (None, "<p>y", "v", "t"), (4, "<b>" + "word " * 200_000, "w", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string").withColumnsRenamed({"url": "__tm_html"})
    got = html_text.extract(df, keep=("__tm_html", "text"))
    assert got.columns == ["page_id", "__tm_html", "text"]
    found = sorted(((r.page_id, r["__tm_html"], r.text) for r in got.collect()), key=str)
    assert found == sorted([(1, "u", ""), (2, "u", ""), (3, None, "x"), (3, None, "x"), (None, "v", "y"), (4, "w", ("word " * 200_000).strip())], key=str)


def test_scores_equal_smoothing_with_exact_counts(documents):
    """Absolute discounting with exact counts: the levels and the filters' wrong answers cost at most 0.05 log10 a token on average, and 0.3 in any one text."""
    rows = [(d, t) for d, t in pairs(documents)]
    texts = {d: [None, *brute.WORD.findall(brute.lower(t)), None] for d, t in rows}
    training = [d for d in texts if not lm_scoring.held_out(d)]
    c = Counter(w for d in training for w in texts[d][1:])
    pair = Counter(p for d in training for p in zip(texts[d], texts[d][1:], strict=False))
    kinds = Counter(h for h, _ in pair)
    once, twice = (sum(n == k for n in pair.values()) for k in (1, 2))
    discount, room = once / (once + 2 * twice), sum(c.values()) + 0.1 * (len(c) + 1)

    def p(h, w):
        alone = (c[w] + 0.1) / room
        return max(pair[h, w] - discount, 0) / c[h] + discount * kinds[h] / c[h] * alone if c[h] else alone

    off = []
    for r in lm_scoring.score(documents).collect():
        words = texts[r.doc_id]
        want = sum(math.log10(p(h, w)) for h, w in zip(words, words[1:], strict=False))
        off.append(((r.score - want), len(words) - 1))
    assert abs(sum(x for x, _ in off) / sum(n for _, n in off)) < 0.05
    assert max(abs(x) / n for x, n in off if n > 50) < 0.3


def test_many_blocks_of_queries(spark, monkeypatch):
    """One block lives at a time, and the plan is one scan of results."""
    alive, most = [], []
    real = topk._search

    def search(block, k):
        alive.append(block)
        most.append(sum(b._jbroadcast.isValid() if hasattr(b._jbroadcast, "isValid") else True for b in alive))
        return real(block, k)

    monkeypatch.setattr(topk, "_search", search)
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[(F.xxhash64(F.lit(i), "id") % 100 / 100.0) for i in range(4)]).alias("embedding"))
    got = topk.top_k(df, F.col("id") % 2 == 0, k=3, query_block=2)
    assert len(alive) > 8 and max(most) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "MapInArrow" not in plan
    assert got.count() == 90


def test_mixing_with_salted_leaves(documents, monkeypatch):
    """Beyond the broadcast, texts meet their leaf's cut by salted shuffles: the same rows."""
    rows = lambda: sorted(map(tuple, mixing.mix_report(documents, weights={"domain0": 3.0}).collect()), key=str)
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert rows() == want and want


def test_token_counts(documents, odd, monkeypatch):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *token_counts.vocabulary(PIECES)], unk_id=0, byte_fallback=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    for df in (documents, odd, odd.limit(0)):
        got = sorted((tuple(r) for r in token_counts.count_tokens(df, PIECES).collect()), key=str)
        assert got == sorted(((d, len(tokenizer.encode(t or "").ids)) for d, t in pairs(df)), key=str)
    counter = token_counts.UnigramCounter.at(PIECES)
    for t in ("日本語 テスト ☃☃☃ x☃y", "a\xa0b　c \x1cq\x1f", "▁▁ a▁b", "𐍈𐍈 é́", "aaaaaaaaaaaaaa 0000"):
        assert counter.count(t.encode()) == len(tokenizer.encode(t).ids)


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.schema.names == documents.schema.names
        if name == "quality rules":
            assert not {r[0] for r in brute.quality(pairs(kept)) if r[6]}
        if name == "MinHash near-dedup":
            want = {d for d, (_, c) in brute.near(pairs(docs)).items() if c == d}
            assert {r.doc_id for r in kept.select("doc_id").collect()} == want
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    got = corpus_pipeline.run(spark, sf)
    want = packing.pieces(docs, corpus_pipeline.public_tokenizers.path(corpus_pipeline.PACKING_TOKENIZER))
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf, documents):
    """Each stage before packing, on all that the one before kept, row by row."""
    import hashlib

    import corpus_pipeline
    from tidemark.llm import quality_rules
    from tidemark.llm.queries import MIX_WEIGHTS

    stages = dict(corpus_pipeline.STAGES)
    docs = documents.unionByName(documents.limit(5))
    kept = stages["quality rules"](spark, docs, sf).collect()
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_report(docs).collect()}
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r in docs.collect() if verdict[r.doc_id]) and kept
    docs = spark.createDataFrame(kept, documents.schema)
    deduped = stages["line dedup"](spark, docs, sf).collect()
    got = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in deduped)
    want = brute.lines(pairs(docs))
    assert got == sorted((d, sha) for d, _, _, sha in want) and any(x[2] for x in want)
    assert all(r.n_chars == len(r.text) for r in deduped)
    docs = spark.createDataFrame(stages["MinHash near-dedup"](spark, spark.createDataFrame(deduped, documents.schema), sf).collect(), documents.schema)
    mixed = Counter(r.doc_id for r in stages["mixing sources to target weights"](spark, docs, sf).collect())
    assert mixed == +_copies(docs, {"tokens_share": 0.8, "max_epochs": 2, "weights": MIX_WEIGHTS}) and mixed


def test_very_long_texts(spark):
    """30,000 words, over all operators that read texts."""
    from tokenizers import Tokenizer

    from tidemark.llm import line_dedup, quality_rules

    words = [f"{chr(97 + i % 26)}{'lorem ipsum dolor sit amet'.split()[i % 5]}{i % 9973}" for i in range(30_000)]
    long = "\n".join(" ".join(words[i : i + 20]) for i in range(0, len(words), 20))
    rows = [(1, long, "en", "a"), (2, long + " more", "en", "a"), (3, long + "x" * 100_000, "en", "b"), (4, "short", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted((r.n_words, r.n_repeat_words) for r in quality_rules.quality_report(df).collect()) == [(1, 0), (30_000, 0), (30_000, 0), (30_001, 0)]
    assert sorted(r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()) == [1, 4]
    assert sorted(tuple(r)[:4] for r in line_dedup.line_report(df, min_docs=2).collect()) == sorted(brute.lines(pairs(df), min_docs=2))
    assert mixing.mixed(df).count() == sum(_copies(df, {"tokens_share": 0.8, "max_epochs": 2, "weights": {}}).values())
    assert lm_scoring.score(df).where("n_tokens > 30000").count() == 3
    assert license_scan.scan_licenses(df).where("license is null").count() == 4
    counted = {r.doc_id: r[1] for r in token_counts.count_tokens(df.unionByName(df), PIECES).collect()}
    assert counted[1] > 30_000 and counted[2] == counted[1] + token_counts.UnigramCounter.at(PIECES).count(b"more")
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.doc_tokens for r in packing.pack(df, path).collect()}
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in pairs(df)}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.v, r.comp) for r in near_dedup.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
