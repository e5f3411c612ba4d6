"""Cases the queries' tables do not hold: ties, hot groups, odd columns, small parts of each method."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from llm_tables import FILL, OTHER

from forumlens.llm import (
    decontamination,
    extraction,
    fingerprints,
    language,
    language_model,
    licenses,
    near_duplicates,
    packing,
    quality,
    repeats,
)
from forumlens.llm.batches import BYTE_KEYS, mix, slices, split_words
from forumlens.llm.components import components
from forumlens.llm.dom import match, parse
from forumlens.llm.exchange import among
from forumlens.llm.queries import tokenizer_path
from forumlens.llm.tokens import Encoder


def test_words_and_their_keys():
    texts = ["a b", None, "", "b\x0ba\u00a0c", "  x  "]
    words = split_words(pa.array(texts))
    assert [words.word(i).decode() for i in range(len(words.keys))] == ["a", "b", "b", "a\u00a0c", "x"]
    assert words.counts().tolist() == [2, 0, 0, 2, 1]
    assert words.keys[1] == words.keys[2] and len(set(words.keys.tolist())) == 4
    assert len(BYTE_KEYS) == 256 and len(np.unique(mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (1, 50, 500, 0, 3, 200)] + [None]})
    parts = list(slices(batch, "t", 100))
    assert sum(p.num_rows for p in parts) == 7 and pa.Table.from_batches(parts).column("t").to_pylist() == batch.column("t").to_pylist()
    assert all(p.num_rows for p in slices(batch.slice(2), "t", 1))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    random.seed(5)
    letters = list("aAbsStTdMlLvr''  \n\t\x0b\x1c123.!—“éÉñßæ²½́\xa0\x85中文Ωσς İÅ<|>") + ["'s", "'LL", " don't ", "<|endoftext|>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    ids, at = Encoder(tokenizer_path()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_places_where_the_sum_is_least():
    random.seed(2)
    packer = packing.SumOfSquares(32)
    for item in range(500):
        length, before = random.randint(1, 31), packer.level.copy()
        outcomes = []
        for h in range(0, 33 - length):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + length] += h + length < 32
            outcomes.append((after[1:32] ** 2).sum())
        packer.place(item, length)
        assert (packer.level[1:32] ** 2).sum() == min(outcomes)


def test_suffix_array_and_index():
    random.seed(3)
    for _ in range(60):
        stretches = [[random.randint(1, 4) for _ in range(random.randint(3, 30))] for _ in range(random.randint(1, 6))]
        begin = np.cumsum([0, *map(len, stretches)])
        index = decontamination.FMIndex(np.concatenate(stretches), begin, 4)
        windows = np.array([[random.randint(1, 4) for _ in range(3)] for _ in range(20)])
        rows, low, high = index.search(windows)
        found = {r: sorted(index.locate(np.arange(a, b)).tolist()) for r, a, b in zip(rows.tolist(), low, high)}
        for i, window in enumerate(windows.tolist()):
            want = sorted(begin[k] + j for k, s in enumerate(stretches) for j in range(len(s) - 2) if s[j : j + 3] == window)
            assert found.get(i, []) == want


def test_benchmark_in_blocks(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"shared{k}" for k in range(i, i + 13))) for i in range(5)], "item long, text string")
    whole = decontamination.find_passages(odd, "text", items, "item", "text").collect()
    monkeypatch.setattr(decontamination, "PATTERN_WORDS", 60)
    parts = decontamination.find_passages(odd, "text", items, "item", "text").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))
    assert {tuple(r.bench_item_ids) for r in whole} == {(), ("0", "1", "2", "3", "4")}
    assert whole[0].asDict().keys() >= {"kept", "tokens", "node", "page"}


@pytest.mark.parametrize("nodes,edges", [(1, []), (2000, "path"), (3000, "star"), (400, "random")])
def test_components(spark, nodes, edges):
    random.seed(nodes)
    if edges == "path":
        edges = [(i, i + 1) for i in range(nodes - 1)]
    elif edges == "star":
        edges = [(nodes, i) for i in range(nodes)]
    elif edges == "random":
        edges = [(random.randrange(nodes), random.randrange(nodes)) for _ in range(nodes // 2)]
    parent = list(range(nodes + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_links_of_leftovers_are_found(spark):
    """Members far from the middle of a large group and linked only with each other are joined."""
    random.seed(9)
    base = [f"b{i}" for i in range(100)]

    def changed(words, n, tag):
        words = list(words)
        for i in random.sample(range(len(words)), n):
            words[i] = f"{tag}{i}"
        return words

    rows = [base] + [changed(base, random.randint(0, 16), f"c{k}_") for k in range(150)]
    far = changed(base, 20, "far")
    rows += [far, changed(far, 3, "near"), changed(far, 4, "by")]
    texts = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = [set(zip(w, w[1:])) for w in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = near_duplicates.near_duplicates(spark.createDataFrame(texts, "i long, t string"), "i", "t", size=2)
    assert {r.i: r.component_id for r in found.collect()} == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = near_duplicates.near_duplicates(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count()
    by_id = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by_id[9_003, 1].component_id == by_id[9_004, 1].component_id == 9_003
    assert by_id[9_000, 0].kept and by_id[9_001, 0].component_id == 9_001
    assert sum(r.doc_id == 9_007 and r.component_id == 9_007 for r in rows) == 3
    assert [r.kept for r in rows if r.doc_id is None] == [True]


def test_near_duplicates_without_ids(spark):
    base = " ".join(f"n{i}" for i in range(60))
    rows = spark.createDataFrame([(None, base + " x"), (None, base + " y"), (4, base)], "doc_id int, text string")
    found = near_duplicates.near_duplicates(rows, "doc_id", "text").collect()
    assert [r.component_id for r in found] == [4, 4, 4] and sorted(r.kept for r in found) == [False, False, True]
    assert {r.doc_id for r in packing.pack(rows, "doc_id", "text", tokenizer_path()).collect()} == {None, 4}


def test_repeats_inside_one_text_and_across(spark, odd):
    rows = {r.doc_id: r for r in repeats.remove_repeats(odd.where("doc_id >= 9010"), "text").collect()}
    assert rows[9_014].rep_n_removed == 120 and rows[9_014].rep_kept == ""
    assert rows[9_012].rep_kept == f"{FILL} after" and rows[9_013].rep_kept == f"Before x {OTHER}" and rows[9_011].rep_kept == ""
    assert rows[9_015].rep_n_words == 60_000 and rows[9_012]["kept"] == "clash"


def test_among():
    values = np.array([1, 5, 9], np.uint64)
    assert among(np.array([0, 1, 9, 10], np.uint64), values).tolist() == [False, True, True, False]
    assert not among(values, values[:0]).any()


def test_common_extension_and_sketches():
    texts = [b"abcdefgh", b"abcdxfgh", b"", b"zzz"]
    p = fingerprints.Prefixes(texts)
    at = p.begin[:-1]
    pairs = [(0, 1, 4), (0, 0, 8), (0, 2, 0), (0, 3, 0)]
    a, b = (np.array([at[x[k]] for x in pairs]) for k in (0, 1))
    most = np.array([min(len(texts[x]), len(texts[y])) for x, y, _ in pairs])
    assert p.common_extension(a, b, most).tolist() == [n for _, _, n in pairs]
    found = fingerprints.sketches(fingerprints.Prefixes([b"same text " * 400, b"same text " * 300, b"", b"x"]))
    assert fingerprints.likeness(found[0], found[1]) > 0.7 and fingerprints.likeness(found[2], found[2]) == 1
    assert fingerprints.likeness(found[2], found[3]) == 0


def test_neighbours_over_repeated_and_missing_ids(spark, odd):
    rows = fingerprints.fingerprint_neighbours(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 1
    one = odd.where("doc_id = 9010")
    assert [r.near_next for r in fingerprints.fingerprint_neighbours(one, "doc_id", "text").collect()] == [1.0]


def test_network_gradients():
    draw = np.random.default_rng(4)
    net = language.ByteNetwork(["a", "b", "c"])
    for p in net._parameters():
        p[...] = draw.normal(0, 0.5, p.shape)
    x, y, w = draw.integers(0, 256, (5, 20), np.uint8), np.array([0, 1, 2, 1, 0]), np.ones(5)

    def loss():
        p = language.softmax(language.window_logits(net.tables(), x).astype(np.float64))
        return -np.log(p[np.arange(5), y]).mean()

    for p, g in zip(net._parameters(), net._gradients(x, y, w)):
        for at in np.flatnonzero(np.abs(g.ravel()) > 0.02)[:3]:
            old = p.ravel()[at]
            p.ravel()[at] = old + 1e-2
            up = loss()
            p.ravel()[at] = old - 1e-2
            assert abs((up - loss()) / 2e-2 - g.ravel()[at]) < 0.05 * max(1, abs(g.ravel()[at]))
            p.ravel()[at] = old


def test_language_windows_cover_the_text():
    data, offsets = np.arange(300, dtype=np.uint8), np.array([0, 0, 129, 300])
    text, start, length = language.cut_windows(data, offsets)
    assert text.tolist() == [1, 1, 2, 2] and start.tolist() == [0, 128, 129, 257] and length.tolist() == [128, 1, 128, 43]


def test_language_without_labels(spark, odd):
    net = language.train(odd.where("lang = 'none'"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language.identify(odd, "text", net).collect()} == {"und"}


def test_discounts():
    assert language_model.discounts([10, 0, 1, 1]) == [0.5, 1.0, 1.5]
    assert language_model.discounts([100, 40, 20, 10]) == pytest.approx([0.5556, 1.1667, 1.8889], abs=1e-3)


def test_model_of_nothing_and_of_odd_rows(spark, odd, empty):
    model = language_model.fit(empty, "text")
    assert {r.lm_score for r in language_model.score(odd, "text", model).collect()} == {0.0}
    model = language_model.fit(odd, "text")
    rows = language_model.score(odd, "text", model).collect()
    assert len(rows) == odd.count() and all(r.lm_score < 0 and r.lm_known == r.lm_tokens for r in rows)


def test_model_counts_frequent_pairs(spark):
    rows = spark.createDataFrame([("a b " * 400,), ("a c",)], "t string")
    model = language_model.fit(rows, "t")
    known = language_model.reader(model, "test")
    words = split_words(pa.array(["a b c"]))
    a, b, c = known.word_numbers(words.keys)[0].tolist()
    pairs = np.array([(a << 32) | b, (b << 32) | a, (a << 32) | c, (c << 32) | a], np.uint64)
    assert known.pair_counts(pairs).tolist() == [400, 399, 1, 0]


def test_licenses_by_size_and_ties(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(0, f"code\n\n{mit}\n\nmore " + "x y z " * 50), (1, mit.upper()), (2, "Released under the MIT License"), (3, None), (4, "")]
    rows.append((5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."))
    found = {r.i: (r.lic_name, r.lic_dice) for r in licenses.scan(spark.createDataFrame(rows, "i long, t string"), "t").collect()}
    assert found[0] == found[1] == ("MIT", 1.0) and found[2] == ("MIT notice", 1.0)
    assert found[3] == found[4] == (None, 0.0) and found[5] == ("Apache-2.0 notice", 1.0)
    none = licenses.scan(spark.createDataFrame(rows, "i long, t string"), "t", templates={"a": "x"})
    assert {r.lic_name for r in none.collect()} == {None}


def test_standard_licences_in_documents(spark):
    def text(name):
        return (Path(licenses.__file__).parent / "licences" / f"{name}.txt").read_text()

    around = "some words of the story go on and on\n\n"
    wanted = {f"{n} text": text(f"{n} text") for n in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    wanted |= {n: text(n) for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT full", "EPL-2.0 header", "AGPL-3.0 header")}
    inside = ["GPL-3.0 header", "GPL-2.0 header", "LGPL-2.1 header", "AGPL-3.0 header", "Apache-2.0 header", "BSD-3-Clause", "MIT full"]
    rows = list(wanted.items()) + [(f"in {n}", around * 60 + text(n) + "\n" + around * 60) for n in inside]
    got = {r.i: r.lic_name for r in licenses.scan(spark.createDataFrame(rows, "i string, t string"), "t").collect()}
    # a whole text may end with the licence's own header, which is as much like itself and comes first by name
    assert {n: (got[n] or "").split(" ")[0] for n in wanted} == {n: n.split(" ")[0] for n in wanted}
    assert {n: (got[f"in {n}"] or "").split(" ")[0] for n in inside} == {n: n.split(" ")[0] for n in inside}


def brute_match(a, b):
    if a.label != b.label:
        return 0
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        row = [0]
        for j, y in enumerate(b.children):
            row.append(max(rows[-1][j] + brute_match(x, y), rows[-1][j + 1], row[j]))
        rows.append(row)
    return 1 + rows[-1][-1]


def test_tree_matching_is_largest():
    random.seed(1)

    def tree(depth):
        tag = random.choice(["div", "ul", "section"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(random.randint(0, 3) if depth else 0)) + f"</{tag}>"

    for _ in range(80):
        a, b = parse(tree(3)), parse(tree(3))
        pairs = list(match(a, b))
        assert len(pairs) == brute_match(a, b) and all(x.label == y.label for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


PAGE = """<html><body class="has-sidebar"><header><h1>Site {n}</h1></header><div id="main-menu"><a href=/a>menu {n}</a></div>
<script>if (a < b) document.write("<p>no</p>")</script><p class=lead>Site wide claim</p>
<div class="post"><h2>Title {n}</h2><p>First &amp; <b>bold</b>text {n}<br>line<p>Second &lt;{n}&gt; paragraph</div>
<section id="comments"><p>reader {n}</p></section><div class="cookieNotice">We use {n}</div>
<form><p>mail {n}</p></form><aside>side {n}</aside><div style="display: none">hidden {n}</div><footer>foot {n}</footer>"""


def test_wrapper_induction(spark):
    rows = [(k, f"https://User@Host.example:80/{k}", PAGE.format(n=k * 7)) for k in range(8)]
    rows += [(90, "https://alone.example/", PAGE.format(n=1)), (91, None, "<main><p>x</p><nav>n</nav></main><p>y"), (92, "u", None)]
    got = {r.i: r.main_text for r in extraction.extract(spark.createDataFrame(rows, "i long, u string, h string"), "u", "h").collect()}
    for k in range(8):  # the claim that all pages share is template
        assert got[k] == f"Title {k * 7} First & boldtext {k * 7} line Second <{k * 7}> paragraph"
    assert got[90].startswith("Site wide claim Title 1") and got[91] == "x" and got[92] == ""


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(k, "http://h.example/", PAGE.format(n=3)) for k in range(50)]
    got = extraction.extract(spark.createDataFrame(rows, "i long, u string, h string"), "u", "h")
    assert Counter(r.main_text for r in got.collect()) == {"Site wide claim Title 3 First & boldtext 3 line Second <3> paragraph": 50}


def test_template_lines_inside_an_article_go(spark):
    page = "<body><p>Top</p><article><h1>Title {n}</h1><p>{line}</p><p>Body {n} of the text</p><p>Share this story now</p></article>"
    rows = [(k, f"http://a.example/{k}", page.format(n=k, line="Same words" if k < 3 else f"Lead {k}")) for k in range(12)]
    card = "<article><p>Read our magazine</p></article><div class=text><p>Story {n} is here</p><p>and ends {n}</p></div>"
    rows += [(100 + k, f"http://b.example/{k}", card.format(n=k)) for k in range(12)]
    got = {r.i: r.main_text for r in extraction.extract(spark.createDataFrame(rows, "i long, u string, h string"), "u", "h").collect()}
    for k in range(12):
        line = "Same words" if k < 3 else f"Lead {k}"  # a line of few pages is their own
        assert got[k] == f"Title {k} {line} Body {k} of the text"
        assert got[100 + k] == f"Story {k} is here and ends {k}"


def test_every_layout_of_a_host_has_a_template(spark):
    notice = "<p>Notice of the {kind} pages that all of these share</p>"
    rows = []
    for k in range(300):
        kind = "rare" if k % 50 == 0 else "common"
        text = f"<p>{kind} story {k}</p>" + notice.format(kind=kind)
        rows.append((k, f"http://h.example/{k}", f"<body><div class={kind}>{text}</div>" if kind == "common" else f"<body><section class=x>{text}</section>"))
    heavy = "<body><div>" + "<p>These words stand on each page of this site</p>" * 4 + "<p>Own text {n}</p></div>"
    rows += [(1000 + k, f"http://w.example/{k}", heavy.format(n=k)) for k in range(9)]
    got = {r.i: r.main_text for r in extraction.extract(spark.createDataFrame(rows, "i long, u string, h string"), "u", "h").collect()}
    assert all(got[k] == f"{'rare' if k % 50 == 0 else 'common'} story {k}" for k in range(300))
    assert all(got[1000 + k] == f"Own text {k}" for k in range(9))


def test_shrinking_follows_the_spread_of_sites(spark):
    rows = [(f"s{s}", "p", float(i % 10 < s)) for s in range(11) for i in range(200)] + [("few", "p", 1.0), (None, None, None)]
    level = quality.shrunk(spark.createDataFrame(rows, "site string, path string, y double"), "y", ["site"], quality.F.lit(0.5), "rate")
    rates = {r.site: r.rate for r in level.rates.collect()}
    assert abs(rates["s10"] - 1) < 0.05 and 0.5 < rates["few"] < 0.9 and rates[None] == pytest.approx(0.5)


@pytest.mark.parametrize("sample", [20_000, 100])
def test_quality_curve_rows_are_never_word_rows(spark, sample):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, good int")
    drawn = {r.doc_id for r in quality.sampled(labels, "doc_id", sample).collect()}
    held = {r.doc_id for r in labels.where(quality.held_out("doc_id")).collect()}
    assert len(drawn) == min(sample, 400 - len(held)) and 60 < len(held) < 140 and not drawn & held


def test_quality_with_odd_rows(spark, odd):
    labels = spark.createDataFrame([(9_007, 1), (9_010, 0), (9_010, 1), (9_011, None), (None, 1)], "doc_id long, good int")
    rows = quality.classify(odd, "doc_id", "text", "source", "lang", labels, ["good"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.good_score <= 1 for r in rows)
    none = quality.classify(odd, "doc_id", "text", "source", "lang", labels.where("false"), ["good"]).collect()
    assert {round(r.good_score, 6) for r in none} == {0.5}


def test_packing_of_odd_rows(spark, odd, empty):
    rows = packing.pack(odd, "doc_id", "text", tokenizer_path(), size=64).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
        assert len(r.tokens) == 4 * r.length and r.offset + r.length <= 64
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(r.doc_tokens == 1 for r in rows) >= 3 and any(r.doc_id is None for r in rows)
    assert packing.pack(empty, "doc_id", "text", tokenizer_path()).count() == 0
