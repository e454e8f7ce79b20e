"""Near misses of licences, shortages of a mixture passed on, and very deep pages."""

import itertools
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_documents import ODD, pairs
from tests.llm.test_models import _budgets
from tidemark.llm import html_text, license_scan, mixing, quality_rules
from tidemark.llm.license_scan import TELLING, TEMPLATES, Scanner, Telling, common, normal_words


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en" if (d or 0) % 2 else None, f"src{(d or 0) % 3}") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# Licences

NEAR_MISSES = {
    "released under the GPL License": [],
    "the album was released under the Sony license": [],
    "licensed under CC BY 4.0": ["CC-BY-4.0-short"],
    "Licensed under CC BY-NC 4.0": ["CC-BY-NC-4.0"],
    "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
    "Licensed under CC BY-ND 4.0": [],
    "This work is licensed under the GNU General Public License, version 2": ["GPL-2.0"],
    "This work is licensed under the GNU General Public License, version 3": ["GPL-3.0"],
    "This work is licensed under the GNU Lesser General Public License, version 3": [],
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC-4.0-long"],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0-long"],
    "This work is licensed under a Creative Commons Attribution 3.0 International License": [],
    "Licensed under the Apache License, Version 1.1": ["Apache-1.1"],
    "Licensed under the Apache License, Version 2.0": ["Apache-2.0"],
    "Licensed under the Mozilla License, Version 2.0": [],
    TEMPLATES["LGPL-text"]: ["LGPL-text"],
    TEMPLATES["AGPL-text"]: ["AGPL-text"],
    TEMPLATES["GPL-text"]: ["GPL-text"],
    TEMPLATES["BSD-2-Clause"]: ["BSD-text", "BSD-2-Clause"],
}


def test_a_near_miss_is_no_match(spark):
    df = spark.createDataFrame([(i, f"one two {t} three") for i, t in enumerate(NEAR_MISSES)], "doc_id long, text string")
    got = {r.doc_id: sorted(x.license for x in r.licenses) for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: sorted(names) for i, names in enumerate(NEAR_MISSES.values())}


def test_every_telling_phrase_is_in_its_template_and_tells():
    scanner = Scanner(TEMPLATES, 0.8, 3, TELLING)
    for name, text in TEMPLATES.items():
        assert (name, 1.0) in [x[:2] for x in scanner.scan_all(text.encode())]
        for phrase in TELLING.get(name, ()):  # one of its words away
            words = [w for w in text.split() if normal_words(w.encode())[0].decode() != phrase.split()[0]]
            assert name not in [x[0] for x in scanner.scan_all(" ".join(words).encode())]


def _longest_with(words, template, phrases, most):
    """The most matched words of any window of most words, in order, that hold the phrases one after another: by dynamic programming."""
    best = 0
    for low in range(len(words)):
        part = words[low : low + most]
        spans = dict(phrases)  # they match as wholes
        table = [[None] * (len(template) + 1) for _ in range(len(part) + 1)]
        table[0][0] = 0
        for i, j in itertools.product(range(len(part) + 1), range(len(template) + 1)):
            v = table[i][j]
            if v is None:
                continue

            def put(x, y, n):
                if x <= len(part) and y <= len(template) and (table[x][y] is None or table[x][y] < n):
                    table[x][y] = n

            put(i + 1, j, v)
            if j in spans:
                w = spans[j]
                if part[i : i + len(w)] == w:
                    put(i + len(w), j + len(w), v + len(w))
            elif j < len(template):
                put(i, j + 1, v)
                if i < len(part) and part[i] == template[j]:
                    put(i + 1, j + 1, v + 1)
        ends = [row[-1] for row in table if row[-1] is not None]
        best = max([best, *ends])
    return best


def test_matches_with_telling_words_against_all_alignments():
    rng = random.Random(5)
    template = b"a b t c d u v e".split()
    telling = Telling(template, ["t", "u v"], 2)
    found = 0
    for _ in range(900):
        words = [rng.choice(b"a b t c d u v e x".split()) for _ in range(rng.randint(0, 20))]
        index = defaultdict(list)
        for i, w in enumerate(words):
            index[w].append(i)
        n, first, last = telling.best(words, index)
        want = _longest_with(words, template, telling.phrases, 2 * len(template))
        assert n <= want and (n > 0) == (want > 0) and last - first < 2 * len(template)
        if len(index[b"t"]) == 1 and len([i for i in index[b"u"] if words[i + 1 : i + 2] == [b"v"]]) == 1 and len(words) <= 16:
            assert n == want  # one choice of the phrases, and all of the text within reach
            found += 1
    assert found > 3


def test_common_subsequences():
    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.choices(b"abc", k=rng.randint(0, 9))) for _ in range(2))
        a, b = [[bytes([x]) for x in s] for s in (a, b)]
        got = common(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        longest = max(k for k in range(len(b) + 1) for c in itertools.combinations(b, k) if _within(c, a))
        assert len(got) == longest


def _within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


# Mixtures


def _mixed(rows, how):
    """{(id, place): copies} with shortages passed on: leaf by leaf, level by level, as the docstring says."""
    leaves = defaultdict(lambda: defaultdict(int))
    for r in rows:
        leaves[r.domain, r.lang, r.source][r.place] += len(brute.WORD.findall(r.text or ""))
    tokens = {k: sum(v.values()) for k, v in leaves.items()}
    total = int(sum(tokens.values()) * how["tokens_share"])
    own = {k: n for k, n in _budgets(tokens, total, how["weights"], how["max_epochs"]).items()}

    def cut(k, budget):
        """(tokens given, epochs, places of the prefix)"""
        if not tokens[k]:
            return 0, 1, set()
        epochs, more = divmod(budget, tokens[k])
        run, taken = 0, set()
        for p in sorted(leaves[k]):
            if run + leaves[k][p] > more:
                break
            run += leaves[k][p]
            taken.add(p)
        return epochs * tokens[k] + run, epochs, taken

    cuts = {k: cut(k, own[k]) for k in leaves}
    for depth in (2, 1, 0):
        groups = defaultdict(list)
        for k in leaves:
            groups[k[:depth]].append(k)
        for members in groups.values():
            lacking = (sum(own[k] for k in members) if depth else total) - sum(cuts[k][0] for k in members)
            room = {k: tokens[k] * how["max_epochs"] - cuts[k][0] for k in members}
            taker = min(members, key=lambda k: (-room[k], [(x is not None, x or "") for x in k]))  # noqa: B023
            if lacking > 0 and room[taker] > 0:
                cuts[taker] = cut(taker, cuts[taker][0] + min(lacking, room[taker]))
    copies = Counter()
    for r in rows:
        _, epochs, taken = cuts[r.domain, r.lang, r.source]
        copies[r.doc_id] += epochs + (r.place in taken)
    return +copies, total - sum(c[0] for c in cuts.values())


def _placed(df):
    return df.withColumns({"place": F.xxhash64(F.lit(29), "doc_id", F.xxhash64("text")), "domain": mixing.source_domain(F.col("source"))}).collect()


def test_shortages_are_passed_on(documents, odd, monkeypatch):
    how = {"tokens_share": 0.7, "max_epochs": 3, "weights": {"domain0": 3.0, "domain1/en": 0.5}}
    for df, leaves in ((documents, 20_000), (documents, 0), (documents.unionByName(documents.limit(20)), 20_000), (odd, 20_000), (odd.limit(0), 20_000)):
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
        rows = _placed(df)
        want, short = _mixed(rows, how)
        have = Counter()
        for r in mixing.mix_report(df, pass_on=True, **how).collect():
            have[r.doc_id] += r.copies
        assert +have == want
        sizes = Counter()  # equal rows are one document here: they go together
        for r in rows:
            sizes[r.domain, r.lang, r.source, r.place] += len(brute.WORD.findall(r.text or ""))
        assert 0 <= short <= max(sizes.values(), default=0)


def test_texts_of_very_different_lengths_use_up_the_budget(spark):
    """Leaves whose next document is larger than what is left of their budget: the whole lacks less than one document."""
    rows = [(i, "w " * (5000 if i % 3 == 0 else 50), "en" if i % 2 else "fr", f"src{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = {i: len(t.split()) for i, t, _, _ in rows}
    budget = int(sum(size.values()) * 0.5)
    given = [sum(size[r.doc_id] * r.copies for r in mixing.mix_report(df, tokens_share=0.5, max_epochs=1, pass_on=p).collect()) for p in (False, True)]
    assert given[0] <= given[1] <= budget and budget - given[1] < 5000
    assert pairs(df)


# Pages


def test_deep_pages_take_time_in_proportion():
    def seconds(page):
        began = time.process_time()
        html_text.visible_text(page)
        return time.process_time() - began

    for opening in ("<div>", "<ul><li>", "<ul><li>a ", "<p>a<b>", "<svg><g>", "<dl><dd>q", "<table><tr><td>a "):
        small, large = (min(seconds(opening * n + "x") for _ in range(2)) for n in (3_000, 24_000))
        assert large < 30 * max(small, 0.02), opening
    assert html_text.visible_text("<div>" * 50_000 + "x" + "</b>" * 50_000 + "<p>y") == "x\n\ny"


def test_deep_lists_and_tables_keep_their_text():
    lines = html_text.visible_text("<ul><li>a" * 300 + "</ul>" * 300).split("\n")
    assert [len(x) - len(x.lstrip()) for x in lines[:202]] == [min(2 * i, 400) for i in range(202)] and len(lines) == 300
    text = html_text.visible_text("".join(f"<table><tr><td>w{i}" for i in range(200)))
    assert text.split() == [f"w{i}" for i in range(200)]


def test_numbers_of_lists():
    shown = lambda page: html_text.visible_text(page).split("\n")
    assert shown("<ol reversed><li>a<li>b<li value=9>c<li>d</ol>") == ["4. a", "3. b", "9. c", "8. d"]
    assert shown("<ol start=5><li>a<li value=x>b<li value=2>c<li>d</ol>") == ["5. a", "6. b", "2. c", "3. d"]
    assert html_text.visible_text("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"


def _plain(page):
    """Visible words of a small tree by recursion: an independent reading of what is shown."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], []

        def handle_starttag(self, tag, attrs):
            gone = (self.hidden[-1] if self.hidden else False) or "hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", "")
            self.hidden.append(gone)

        def handle_endtag(self, tag):
            self.hidden.pop()

        def handle_data(self, data):
            if not (self.hidden and self.hidden[-1]):
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    return "".join(reader.out).split()


def test_random_small_trees_against_a_plain_reading():
    """Well-formed trees of blocks, inline elements, lists and tables, some of them hidden: the same words.

    Cells of several lines stand side by side, so only pages without tables keep the order of their words.
    """
    rng, count = random.Random(8), itertools.count()

    def made(depth, tag):
        kinds = {"ul": ["li"], "table": ["tr"], "tr": ["td"]}.get(tag, ["div", "b", "section", "ul", "table", "span"])
        inside = []
        for _ in range(rng.randint(1, 3)):
            if tag not in ("ul", "table", "tr"):
                inside.append(f" w{next(count)} ")
            if depth:
                kind = rng.choice(kinds)
                how = rng.choice(["", "", "", " hidden", ' style="color: red; display: none"'])
                inside.append(f"<{kind}{how}>{made(depth - 1, kind)}</{kind}>")
        return "".join(inside)

    for _ in range(150):
        page = made(4, "body")
        got, want = html_text.visible_text(page).replace("- ", " ").split(), _plain(page)
        assert (sorted(got) == sorted(want) if "<table" in page else got == want), page


# Quality rules


def test_the_order_of_rules_follows_from_the_sample(spark, documents):
    """Counted, not timed: one table gives one order, and each text's first rule that rejects is the same in every run."""
    orders = [[(r.name, s, x) for r, s, x in quality_rules.ordered_rules(documents)] for _ in range(2)]
    assert orders[0] == orders[1] and {x[0] for x in orders[0]} == {r.name for r in quality_rules.RULES} and all(s > 0 for _, s, _ in orders[0])
    texts = [t or "" for _, t in pairs(documents)]
    work = {"chars": sum(map(len, texts)), "words": sum(len(brute.WORD.findall(t)) for t in texts), "lines": 0, "long_words": 0}
    part, rule = quality_rules.costs(work, quality_rules.RULES)
    assert part["__tm_w"] == pytest.approx(37e-9 * work["chars"]) and rule["repeated_windows"] == pytest.approx(555e-9 * work["words"])
    first = min(quality_rules.RULES, key=lambda r: r.name != orders[0][0][0])
    found = {r.doc_id: r.rejected_by for r in quality_rules.quality_report(documents).collect()}
    assert found == {r.doc_id: r.rejected_by for r in quality_rules.quality_report(documents).collect()}
    verdicts = quality_rules.with_metrics(documents).select("doc_id", F.expr(first.rejects).alias("bad")).collect()
    assert all(found[r.doc_id] == first.name for r in verdicts if r.bad)
    assert [(r.name, s, x) for r, s, x in quality_rules.ordered_rules(documents.limit(0))] == [(r.name, 0.0, 0.0) for r in quality_rules.RULES]
