"""Every query of the subpackage against a brute-force version on a small table."""

import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from forumlens.llm.language_model import discounts
from forumlens.llm.queries import CHECKS, QUERIES, tokenizer_path


def result(spark, name, folder, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, folder).collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_empty_tables_give_no_rows(spark, none, name):
    assert QUERIES[name](spark, none).count() == 0


def test_packing_round_trip(spark, folder, documents):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    encoder.encode_special_tokens = True
    rows = QUERIES["op1_packing"](spark, folder).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(documents)
    for doc, text in documents.items():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: nothing is padded


def test_repeats(spark, folder, documents):
    words = {d: (t or "").encode().split() for d, t in documents.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = result(spark, "op2_repeats", folder)
    removed = 0
    for d, w in words.items():
        cut = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                cut[k : k + 35] = [True] * 35
        left = b" ".join(x for x, c in zip(w, cut) if not c)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), sum(cut), sha(left))
        removed += sum(cut)
    assert removed > 60_000


def test_licenses(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rows = con.execute(CHECKS["op3_licenses"])
    names = [d[0] for d in rows.description]
    want = sorted(map(repr, rows.fetchall()))
    got = sorted(repr(tuple(r[n] for n in names)) for r in QUERIES["op3_licenses"](spark, folder).collect())
    assert got == want


def test_extraction(spark, folder):
    got = result(spark, "op4_extraction", folder, "page_id")
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        found = re.search(r"<article>(.*?)</article>", page.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ")) if found else []
        text = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in blocks]
        want = " ".join(t for t in text if t) if k < 9_000 else ("a" if k == 9_001 else "")
        assert (got[k].text, got[k].n_chars, got[k].url) == (want, len(want), page.url)


def test_fingerprints(spark, folder, documents):
    got = result(spark, "op5_fingerprints", folder)
    order = sorted(documents)
    prints = {}
    for k, d in enumerate(order):
        text, after = documents[d] or "", documents[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert r.common_bytes == len(os.path.commonprefix([text.encode(), edited.encode()]))
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1
        if len(text) > 500 and text != edited:
            assert 0.05 < r.near_edited < 1
    assert len(set(prints.values())) == len(prints)


def test_near_duplicates(spark, folder, documents):
    words = {d: (t or "").encode().lower().split() for d, t in documents.items()}
    sets = {d: frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] * bool(w))) for d, w in words.items()}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    got = result(spark, "op6_near_duplicates", folder)
    for d in sets:
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[d]), find(d), find(d) == d)


def test_decontamination(spark, folder, documents):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word.findall(lower(r.text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    got = result(spark, "op7_decontamination", folder)
    for d, text in documents.items():
        w = word.findall(lower(text))
        hit, items = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    items |= found
                    hit[k : k + n] = [True] * n
        h, r = sum(hit), got[d]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), h, len(items))
        assert r.items_sha256 == sha(",".join(sorted(items)))
        assert r.contaminated == (h > 0 and 20 * h >= len(w))


def test_quality(spark, folder):
    rows = QUERIES["op8_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= x <= 1 for r in rows for x in (r.quality_score, r.quality_site, r.quality_path, r.toxic_score))


def test_quality_finds_toxic_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = result(spark, "op8_quality", folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    found = [(r.toxic, got[r.doc_id].toxic_score >= 0.5) for r in labels]
    good = [(r.quality, got[r.doc_id].quality_score >= 0.5) for r in labels]
    assert sum(t and f for t, f in found) > 0.5 * sum(t for t, _ in found)
    assert sum(f for t, f in found if not t) < 0.02 * len(found)
    assert sum(bool(q) == g for q, g in good) > 0.95 * len(good)


def test_language(spark):
    folder = "/root/testdata/sf0.01"
    got = result(spark, "op9_language", folder)
    held = [r for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) > 0.98 * len(held)


def test_language_of_odd_texts(spark, folder, documents):
    got = result(spark, "op9_language", folder)
    for d, text in documents.items():
        assert (got[d].lang_pred == "und") == (text is None or not any(map(str.isalpha, text)))
        assert 0 <= got[d].score <= 1


def test_language_model(spark, folder, documents):
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in documents.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in documents}
    words, pairs = Counter(), Counter()
    for d, w in tokens.items():
        if not held[d]:
            words.update(w)
            pairs.update(zip([0, *w[:-1]], w))
    total, types = sum(words.values()), len(words)
    follows, before, split = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), n in pairs.items():
        split[u][min(n, 3) - 1] += 1
        before[u] += n
    high = discounts([Counter(pairs.values())[k] for k in (1, 2, 3, 4)])
    kinds = Counter(follows.values())
    low = discounts([kinds[k] for k in (1, 2, 3, 4)])
    all_follow = sum(follows.values())
    spread = sum(low[min(k, 3) - 1] * n for k, n in kinds.items()) / all_follow

    def less(n, by):
        return max(n - by[min(n, 3) - 1], 0) if n else 0

    def single(w):
        return less(follows[w], low) / all_follow + spread / (types + 1)

    def probability(u, w):
        if not before[u]:
            return single(w)
        return (less(pairs[u, w], high) + sum(h * n for h, n in zip(high, split[u])) * single(w)) / before[u]

    assert math.isclose(sum(probability(0, w) for w in words) + probability(0, b"never seen"), 1)
    got = result(spark, "op10_language_model", folder)
    for d, w in tokens.items():
        base = sum(math.log10((words[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        score = sum(math.log10(probability(u, x)) for u, x in zip([0, *w[:-1]], w))
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(words[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
