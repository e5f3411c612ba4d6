"""Source divergence, packing by local search and hard negatives against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlens.llm import divergence, extraction, hard_negatives, repeats, swap_packing
from forumlens.llm.batches import split_words
from forumlens.llm.byte_tokens import byte_encoder
from forumlens.llm.dom import from_skeleton, parse, skeleton
from forumlens.llm.queries import QUERIES, tokenizer_path

# ---- source divergence


def plain_audit(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, term by term."""
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t, _, _ in rows]
    groups, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), own in zip(rows, words):
        groups[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
        langs[lang or ""].update(own)

    def differ(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, of_docs in docs.items():
        kept = [t for t, n in of_docs.items() if n >= least]

        def share(counts):
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // below for t in kept}

        own = {s: share(c) for (a, s), c in groups.items() if a == lang}
        whole = share(langs[lang])
        for s, p in own.items():
            pairs = [(sum(differ(p[t], q[t]) for t in kept), x) for x, q in own.items() if x != s]
            used = [(differ(p[t], whole[t]), t) for t in kept if groups[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", pairs), ("term", used)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i) for i, (v, x) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, "text", "lang", "source", **options).collect())


def test_audit_of_a_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang", "source").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_source_divergence"](spark, folder).collect())
    assert got == plain_audit(rows) and {r[2] for r in got} == {"pair", "term"}


@pytest.mark.parametrize("least, top", [(1, 10), (2, 1), (3, 3), (99, 10)])
def test_audit_over_small_tiles(spark, monkeypatch, least, top):
    """Many sources and blocks; nulls, groups without terms, ties, repeated rows, a language without kept terms."""
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    draw = np.random.default_rng(4)
    terms = [f"t{chr(97 + i)}" for i in range(14)] + ["é", "Z", "z", "ŋa"]
    rows = [
        (" ".join(draw.choice(terms, draw.integers(0, 12))), str(draw.choice(["en", "fr"])), f"s{draw.integers(0, 7)}")
        for _ in range(120)
    ]
    rows += [(None, "en", "none"), ("12 !?", "en", "marks"), (None, None, None), ("te te", None, "s1"), *rows[:3], ("rare", "x", "a"), ("words", "x", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    df = df.withColumn("n", F.lit(1)).withColumn("term", F.lit("x")).withColumn("kept", F.lit(2))  # names of its own columns
    assert audited(df, least_docs=least, top=top) == plain_audit(rows, least, top)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 9), st.sampled_from("abcdefgh")), max_size=60), st.integers(1, 4))
def test_skyband_keeps_rows_with_few_dominators(rows, k):
    rows = sorted({(-n, n + more, t.encode()) for n, more, t in rows})
    band = divergence.Skyband(k)
    for at, (n, lang_n, term) in enumerate(rows):
        over = sum(a <= n and b <= lang_n and t < term for a, b, t in rows if (a, b, t) != (n, lang_n, term))
        assert band.meet(lang_n, term) == (over < k)


def test_blocks_name_a_pair_the_same_way_round():
    """Rows of a tile come in any order; sums of a pair over blocks of terms meet by its two names."""
    marks = [("b", "en", 0, 0, 0, 5, None, 0), ("a", "en", 0, 0, 0, 3, None, 0), ("c", "en", 0, 0, 0, 4, None, 0)]
    names = ["source", "lang", "first", "second", "tile", "zero", "term", "p"]
    found = []
    for own in (marks, marks[::-1], [marks[1], marks[2], marks[0]]):
        rows = [*own, ("a", "en", 0, 0, 0, 3, "x", 90)]
        table = pa.table({n: pa.array([r[i] for r in rows], pa.string() if n in ("source", "lang", "term") else pa.int64()) for i, n in enumerate(names)})
        found.append(sorted(tuple(r.values()) for r in divergence._tile(table).to_pylist()))
    assert found[0] == found[1] == found[2] and [r[1:3] for r in found[0]] == [("a", "b"), ("a", "c"), ("b", "c")]


def test_long_regular_terms_stay_apart(spark):
    """Thue-Morse words of 2,048 letters share any polynomial key modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    rows = [(words[i % 2], "en", f"s{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(df) == plain_audit(rows)


def test_hot_group_is_split_by_term(spark):
    """The whole corpus is one group: counted terms lie in many partitions, and each holds its part only."""
    df = spark.range(400).select(F.lit("en").alias("lang"), F.lit("one").alias("source"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    sizes = divergence.count_terms(df, "text", "lang", "source").repartition(4, "lang", "term").rdd.mapPartitions(lambda x: [len(list(x))]).collect()
    assert sum(sizes) == 400 and max(sizes) < 150


# ---- packing by local search


def test_pieces_round_trip(spark, folder, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rows = QUERIES["op12_best_fit_packing"](spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(documents)
    for doc, text in documents.items():
        ids, at = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for i, r in enumerate(sorted(pieces[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.doc_tokens) == (i, at, len(ids)) and (r.length == 1024 or i == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    least = swap_packing.least_bins([r.length for r in rows], 1024)
    assert least <= len(sequences) <= least * 1.01 + 1


def test_pieces_of_odd_rows(spark, odd, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    got = swap_packing.pack(odd, "doc_id", "text", path).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in odd.collect())
    assert swap_packing.pack(empty, "doc_id", "text", path).count() == 0
    with pytest.raises(ValueError, match="rename"):
        swap_packing.pack(odd.withColumnRenamed("doc_id", "piece"), "piece", "text", path)


def test_bins_of_many_small_tasks_meet(spark):
    """Each task alone would leave a sequence of one document."""
    df = spark.range(60).select(F.col("id").alias("doc"), F.repeat(F.lit(" word"), 99).alias("text")).repartition(30)
    got = swap_packing.pack(df, "doc", "text", tokenizer_path("byte_bpe_50k.json"))
    assert got.select("sequence_id").distinct().count() == 6  # 60 documents of 100 tokens


def squares(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_local_search_ends_in_a_local_optimum(lengths):
    size = 24
    first = swap_packing.best_fit_decreasing(lengths, size)
    bins = swap_packing.pack_lengths(lengths, size)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    fills = [sum(lengths[i] for i in b) for b in bins]
    assert all(0 < f <= size for f in fills)
    assert len(bins) <= len(first) and squares(bins, lengths) >= squares(first, lengths)
    least = swap_packing.least_bins(lengths, size)
    assert least <= len(bins)
    if len(bins) == least:
        return
    some = [[(), *combinations(b, 1), *combinations(b, 2)] for b in bins]
    for a, b in combinations(range(len(bins)), 2):
        for x, y in ((a, b), (b, a)):  # x gives to y, which is as full or fuller
            for out in some[x]:
                for back in some[y]:
                    if fills[y] >= fills[x] and out and len(out) + len(back) <= 3 and min(len(out), len(back)) < 2:
                        if len(out) == 2 and len(back) != 1:
                            continue
                        gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                        assert not (gain > 0 and fills[y] + gain <= size)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_least_bins_is_a_bound(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        tried = {b for b in bins if b + rest[0] <= 12}
        options = [fewest(rest[1:], [*bins[: (i := bins.index(b))], b + rest[0], *bins[i + 1 :]]) for b in tried]
        return min([*options, fewest(rest[1:], [*bins, rest[0]])])

    best = fewest(sorted(lengths, reverse=True), [])
    assert swap_packing.least_bins(lengths, 12) <= best <= len(swap_packing.pack_lengths(lengths, 12))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab Zé  —'slt19,.!\n\t\r\x0b\x1c\x85中😀<|>")), max_size=30), max_size=6))
def test_byte_ids_are_the_tokenizers(texts):
    encoder = byte_encoder(tokenizer_path("byte_bpe_50k.json"))
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    plain = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == plain


def test_byte_ids_outlive_the_cache(monkeypatch):
    from forumlens.llm import byte_tokens

    monkeypatch.setattr(byte_tokens, "CACHED_UNITS", 50)
    encoder = byte_tokens.ByteEncoder(tokenizer_path("byte_bpe_50k.json"))
    for i in range(30):
        texts = [f"the word{i} and {chr(97 + i % 26) * (j + 1)} once" for j in range(20)]
        ids, at = encoder.encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


# ---- hard negatives


def plain_mine(rows, positives=5, negatives=3):
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if None not in (i, v, label)]
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, label in rows:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-t, k) for t, k, other in scored if other != label and -50 * s <= -100 * t <= -95 * s]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket", [2048, 16])
def test_negatives_of_a_whole_table(spark, folder, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", bucket)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, folder).collect())
    assert got == plain_mine(rows) and got


def test_negatives_with_clashing_names_and_large_numbers(spark):
    draw = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in draw.normal(size=6) * 10.0 ** (3 * (i % 3))], int(draw.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").withColumn("block", F.lit(1)).withColumn("anchor", F.lit(2))
    got = hard_negatives.mine(df, "id", "x", "label", F.col("id") % 50 == 0)
    rows = [(i, v, (label - 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]  # the brute force changes these labels
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(rows)


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_candidates_hold_every_row_that_reaches(spread):
    """Ranges of coordinates lose nothing, and leave rows out where directions are close together."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(4, 12))
    x = centres[draw.integers(0, 4, 600)] + spread * draw.normal(size=(600, 12))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)  # a bucket holds rows of like length
    table = {"id": pa.array(range(600)), "label": pa.array([0] * 600), "x": pa.array(x.tolist(), pa.list_(pa.int64()))}
    bucket = hard_negatives.Bucket(pa.table(table))
    chosen = {k: v[:40] for k, v in table.items()}
    anchors = hard_negatives.Anchors(pa.table({"anchor": pa.array(range(40)), **chosen}))
    scores = x[:40] @ x.T
    anchors.reach = np.sort(scores, axis=1)[:, -5].astype(float)
    found, verified = defaultdict(set), 0
    for at, rows in hard_negatives.candidates(bucket, anchors):
        some = np.arange(600)[rows]
        verified += len(at) * len(some)
        assert (bucket.scores(rows, anchors.x[at]) == x[some] @ x[at].T).all()
        for a in at:
            found[a].update(some.tolist())
    for a in range(40):
        assert set(np.flatnonzero(scores[a] >= anchors.reach[a]).tolist()) <= found[a]
    if spread < 0.1:
        assert verified < 40 * 600 / 3


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(i, [1e9] * 40, i % 2) for i in range(51)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits|OVERFLOW"):
        hard_negatives.mine(df, "vec_id", "embedding", "label", F.col("id") % 50 == 0).count()


# ---- what decides in the operators for repeats and pages


def test_spans_come_from_the_automaton(monkeypatch):
    """Every repeated window is located, and with an automaton that finds nothing nothing is cut."""
    draw = np.random.default_rng(3)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(3)] + ["same " * 50]
    texts = [" ".join([*(f"w{x}" for x in draw.integers(0, 10**6, 30)), str(draw.choice(passages)), "end"]) for _ in range(40)]
    words = split_words(pa.array(texts))
    at, keys = words.grams(35)
    known, times = np.unique(keys, return_counts=True)
    confirmed = known[times > 1]
    assert len(confirmed) and np.array_equal(repeats.spans(words, confirmed, 35, 6), at[np.isin(keys, confirmed)])
    assert not len(repeats.spans(words, known[:0], 35, 6))

    class Nothing:
        def __init__(self, *_):
            pass

        def add_word(self, _):
            pass

        make_automaton = lambda self: None
        iter = lambda self, _: iter(())

    monkeypatch.setattr(repeats.ahocorasick, "Automaton", Nothing)
    assert not len(repeats.spans(words, confirmed, 35, 6))


@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
@pytest.mark.parametrize(
    "name",
    ["content", "content with-sidebar", "has-header wrap", "related-content", "layout_no-comments", "social-science", "row tags-on", "adVert-free", "register", "content withSidebar"],
)
def test_names_do_not_hide_an_article(name, inner):
    draw = np.random.default_rng(7)

    def some(n):
        return " ".join(f"w{x}" for x in draw.integers(0, 10**6, n))

    pages, texts = [], []
    for _ in range(8):
        texts.append(f"{some(4)} {some(90)} {some(60)}")
        head, first, last = re.match("(.*?w.*?w.*?w.*?w\\d+) ((?:w\\d+ ?){90}) ?(.*)", texts[-1]).groups()
        body = inner.format(f"<h1>{head}</h1><p>{first.strip()}</p><p>{last}</p>")
        pages.append(
            f"<body><nav>Home</nav><div class='sidebar'><p>Popular {some(5)}</p></div><div class='{name}'>{body}"
            f"<div class='share-buttons'>Share {some(2)}</div></div><div class='user-comments'><p>{some(400)}</p></div><footer>End</footer>"
        )
    trees = [from_skeleton(skeleton(parse(p), extraction.text_key)) for p in pages]
    for i, page in enumerate(pages):
        assert extraction.main_text(page, [t for j, t in enumerate(trees) if j != i]) == texts[i]


def test_scoring_without_the_model_s_files_is_an_error(spark, tmp_path):
    import os

    from forumlens.llm import language_model

    df = spark.createDataFrame([(i, f"some words of text {i} again and again") for i in range(20)], "i long, text string")
    model = language_model.fit(df, "text")
    assert language_model.score(df, "text", model).where("lm_known > 2").count() == 20
    away = language_model.Model(**{**model.__dict__, "folder": str(tmp_path / "away")})
    with pytest.raises(Exception, match="mounted on every machine"):
        language_model.score(df, "text", away).collect()
    words = next(f for f in os.listdir(model.folder) if f.startswith("words-") and f.endswith(".keys"))
    os.remove(f"{model.folder}/{words}")
    other = language_model.Model(**{**model.__dict__, "texts": 0})
    language_model._readers.clear()
    with pytest.raises(Exception, match="not complete"):
        language_model.score(df.repartition(3), "text", other).collect()


def test_columns_named_like_results_are_refused(spark, odd):
    with pytest.raises(ValueError, match="rep_kept"):
        repeats.remove_repeats(odd.withColumn("rep_kept", F.lit(1)), "text")
    pages = spark.createDataFrame([("http://a.b/", "<p>x", 1)], "url string, html string, main_text int")
    with pytest.raises(ValueError, match="main_text"):
        extraction.extract(pages, "url", "html")
    assert extraction.extract(pages, "url", "html", prefix="own_").columns == [*pages.columns, "own_text"]
