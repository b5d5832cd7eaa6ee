"""Substring, suffix-array and n-gram deduplication against plain versions."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cytolake.llm import ngram_join, substring_dedup, suffix_dedup
from cytolake.llm._anchors import Words, window_anchors
from cytolake.llm._common import U64, byte_gram_hashes, from40, low40, ngram_hashes, packed, sliding_min, unpacked, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def words_of(text):
    return WORD.findall((text or "").encode())


def plain_words(rows, window=13):
    first = defaultdict(lambda: LAST * 2)
    for i, t, _ in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], LAST if i is None else i)
    out = []
    for i, t, _ in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def test_substring_dedup(make, corpus):
    found = substring_dedup.dedup(make(corpus)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == plain_words(corpus)
    texts = {i: words_of(t) for i, t, _ in corpus if i is not None and i not in (500, 501)}
    some = 0
    for r in found:
        for f in r["factors"]:
            if r["doc_id"] in texts and f["ref_doc"] in texts:
                assert texts[r["doc_id"]][f["start"] : f["start"] + f["words"]] == texts[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["words"]]
                assert f["words"] >= 13
                some += 1
    assert some > 10


def test_factors_are_greedy():
    runs = np.array([(0, 3, 1, 10), (2, 5, 2, 0), (20, 1, 1, 0), (6, 2, 3, 7)], substring_dedup.RUN)
    parse = substring_dedup.factors(runs, 13)
    assert parse == [(0, 15, 1, 10), (3, 16, 2, 1), (7, 13, 3, 8), (20, 13, 1, 0)]
    assert np.flatnonzero(~substring_dedup.covered(parse, 40)).tolist() == [*range(33, 40)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=25), min_size=1, max_size=6), st.lists(st.integers(0, 3), min_size=6, max_size=6))
def test_parse_against_a_block(texts, ids):
    """Factors agree with their reference, cannot be longer, cover each window with an earlier occurrence and no other."""
    docs = sorted(zip(ids, texts), key=lambda x: x[0])
    own = np.array([i for i, _ in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(t) for _, t in docs])
    pos, key = np.concatenate([np.arange(len(t)) for _, t in docs]), np.concatenate([t for _, t in docs]).astype(U64)
    first = substring_dedup._firsts(key, key, own[doc], np.arange(len(doc)))
    start, n, ref = substring_dedup.parsed(own, doc, pos, key, first)
    inside = np.zeros(len(key), bool)
    for s, k, r in zip(start, n, ref):
        assert (key[s : s + k] == key[r : r + k]).all() and doc[s] == doc[s + k - 1] and doc[r] == doc[r + k - 1] and own[doc[r]] < own[doc[s]]
        more = s + k < len(key) and r + k < len(key) and doc[s + k] == doc[s] and doc[r + k] == doc[r] and key[s + k] == key[r + k]
        assert not more and not inside[s : s + k].any()
        inside[s : s + k] = True
    assert (inside == (own[doc[first]] < own[doc])).all()


def test_the_parse_decides(make, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "factors", lambda runs, window: [])
    assert {r["n_removed"] for r in substring_dedup.dedup(make(corpus)).collect()} == {0}


@pytest.fixture(scope="module")
def phrases():
    """One phrase in many different contexts, some of them repeated."""
    rng = random.Random(12)
    phrase, pool = " ".join(f"common{k}" for k in range(12)), [f"c{k}" for k in range(9)]
    texts = [f"{rng.choice(pool)} {rng.choice(pool)} {phrase} {rng.choice(pool)} {rng.choice(pool)} tail{k % 40}" for k in range(300)]
    return [(k, t, None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [True, False])
def test_common_anchors_are_dealt_finer(make, phrases, monkeypatch, hot):
    from cytolake.llm import _anchors

    monkeypatch.setattr(_anchors, "BLOCK_KEYS", 40)
    monkeypatch.setattr(_anchors, "HOT_BLOCKS", 2 if hot else 1 << 30)
    docs = make(phrases).repartition(4)
    _, listed = _anchors.shared_keys(docs, _anchors.doc_keys(Words()), 4)
    assert (len(listed) > 0) == hot and (np.diff(listed.astype(np.int64)) > 0).all()
    found = substring_dedup.dedup(docs).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found), key=repr) == plain_words(phrases)
    first = {}
    for i, t, _ in phrases:
        for k in range(len(t) - 99):
            first.setdefault(t[k : k + 100], (i, k))
    for r in suffix_dedup.dedup(docs).collect():
        t = phrases[r["doc_id"]][1]
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            if first[t[k : k + 100]] < (r["doc_id"], k):
                gone[k : k + 100] = True
        assert bytes(r["kept"]).decode() == "".join(c for c, g in zip(t, gone) if not g)


@pytest.mark.parametrize("characters", [False, True])
def test_suffix_dedup(make, corpus, characters):
    rows = [r for r in corpus if r[0] != 501]  # two texts under one id: their order is a hash
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        if i is None:
            continue
        raw = (t or "").encode()
        for k in range(len(raw) - 99):
            first.setdefault(raw[k : k + 100], (i, k))
    got = suffix_dedup.dedup(make(rows), characters=characters, keep=("keep", "text")).collect()
    assert len(got) == len(rows) and all(r["keep"] == "k" for r in got)
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = (r["text"] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if first[raw[k : k + 100]] < (r["doc_id"], k):
                gone[k : k + 100] = True
        if not characters:
            assert bytes(np.frombuffer(raw, np.uint8)[~gone]) == bytes(r["kept"])
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), gone.sum(), (np.diff(gone.astype(int), prepend=0) == 1).sum())
        else:
            bytes(r["kept"]).decode()
            assert r["n_removed"] <= gone.sum()
    nulls = [r for r in got if r["doc_id"] is None]
    assert any(r["n_removed"] == r["n_bytes"] > 0 for r in nulls)  # the copy of a text with an id


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=30), min_size=1, max_size=6), st.randoms())
def test_two_stage_sort(pieces, rng):
    pieces = [p.encode() for p in pieces]
    bounds = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    wanted = np.array([rng.random() < 0.7 for _ in text])
    got = suffix_dedup.suffix_array(text, bounds, wanted)
    tail = lambda i: text[i : bounds[np.searchsorted(bounds, i, "right")]].tobytes()
    assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist() and [tail(i) for i in got] == sorted(tail(i) for i in got)
    up = suffix_dedup.ascending(text, bounds[1:] - 1)
    for i in range(len(text)):
        successor = tail(i + 1) if i + 1 not in bounds else b""
        assert up[i] == (tail(i) < successor)


def shingle_set(text, k=5):
    w = [x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words_of(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_join(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
            parent[top(i)] = top(j)
    least = defaultdict(lambda: LAST)
    for i, r in enumerate(rows):
        least[top(i)] = min(least[top(i)], LAST if r[0] is None else r[0])
    return [(r[0], len(sets[i]), None if least[top(i)] == LAST else least[top(i)]) for i, r in enumerate(rows)]


def test_ngram_join(make, corpus):
    got = ngram_join.join(make(corpus), keep=("keep", "text")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(plain_join(corpus), key=repr)
    for component, rows in itertools.groupby(sorted((r for r in got if r["component_id"] is not None and r["n_shingles"]), key=lambda r: r["component_id"]), key=lambda r: r["component_id"]):
        rows = list(rows)
        if component != 501:
            assert [r["doc_id"] for r in rows if r["chosen"]] == [component]
    assert all(r["chosen"] for r in got if not r["n_shingles"])


def test_ngram_join_of_near_copies(make):
    """A large group whose sets link in chains rather than with one centre."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(200)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words), None))
    got = ngram_join.join(make(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_join(rows))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=1, max_size=20), st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), max_size=12), st.integers(40, 90))
def test_trie(pivot, sets, percent):
    lists = [np.array(sorted(s), U64) for s in sets]
    got = ngram_join.trie_links(np.array(sorted(pivot), U64), len(pivot), lists, [len(s) for s in sets], percent)
    assert sorted(got) == [i for i, s in enumerate(sets) if 100 * len(s & pivot) >= percent * len(s | pivot)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=12), st.integers(40, 90), st.randoms())
def test_forest_connects_what_links(sets, percent, rng):
    """Groups of one element each: all rows that hold it."""
    hashes = [np.array(sorted(s), U64) * U64(0x9E3779B97F4A7C15) for s in sets]
    sketches = ngram_join.Sketches(list(map(ngram_join.sketch, hashes)))
    n, lists = np.array([len(s) for s in sets]), [np.array(sorted(s), U64) for s in sets]
    links = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}

    def components(pairs):
        labels = list(range(len(sets)))
        for i, j in pairs:
            labels = [min(labels[i], labels[j]) if x in (labels[i], labels[j]) else x for x in labels]
        return labels

    some = [p for p in sorted(links) if rng.random() < 0.3]
    before = np.array([f"l{x}" for x in components(some)], object)
    keep = ngram_join.with_partners(sketches, np.arange(len(sets)), n, before, percent)
    assert all(keep[i] and keep[j] for i, j in links if before[i] != before[j])
    groups = [np.array([i for i, s in enumerate(sets) if e in s and keep[i]], np.int64) for e in range(26)]
    found = ngram_join.trie_forest([g for g in groups if len(g) > 1], lists, n, sketches, before, percent)
    assert set(map(lambda p: (min(p), max(p)), found)) <= links and len(found) < len(sets)
    assert components([*some, *found]) == components(links)


def test_sketches_of_different_sizes():
    """The bits in which two sketches differ are at most the elements in which the sets do, also across sizes."""
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**63, 5000).astype(U64)
    sets = [np.unique(base[: n]) for n in (900, 1000, 1024, 1025, 1100, 1400, 2048, 2049, 2700, 4096, 4097, 5000)]
    sets += [np.unique(np.r_[base[:1500], rng.integers(1, 2**63, 300).astype(U64)]), np.unique(base[700:2000])]
    sketches, n = ngram_join.Sketches(list(map(ngram_join.sketch, sets))), np.array([len(s) for s in sets])
    assert len(set(sketches.level.tolist())) > 2
    for i in range(len(sets)):
        near = np.flatnonzero(np.abs(sketches.level - sketches.level[i]) <= 1)
        true = np.array([len(np.setxor1d(sets[i], sets[j])) for j in near])
        found = sketches.apart(i, near)
        assert (found <= true).all() and (found >= 0.5 * np.minimum(true, n[i])).all()
        linked = [j for j in range(len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        assert set(linked) <= set(ngram_join.may_link(sketches, n, i, np.arange(len(sets)), 75).tolist())


@pytest.mark.parametrize("rows_in_group", [7, 8192])
def test_ngram_join_of_large_groups(make, monkeypatch, rows_in_group):
    """Blocks of one group: several components that share a passage, so that groups hold many of them."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows_in_group)
    rng = random.Random(3)
    shared = [f"s{k}" for k in range(60)]
    bases = [shared + [f"b{b}x{k}" for k in range(25)] for b in range(6)]
    rows = []
    for k in range(90):
        words = list(bases[rng.randrange(6)])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(words), None))
    got = ngram_join.join(make(rows)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_join(rows))


def test_empty_tables(make):
    none = make([]).limit(0)
    assert substring_dedup.dedup(none).count() == suffix_dedup.dedup(none).count() == ngram_join.join(none).count() == 0


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**40, 500).astype(U64)
    assert (from40(low40(x)) == x).all()
    for y in (x, x % U64(300), np.zeros(0, U64), np.array([0, 127, 128, 2**62], U64)):
        assert (unpacked(packed(y)).astype(U64) == y).all()
    a = rng.integers(0, 50, 300)
    for w in (1, 2, 7, 9, 69):
        assert (sliding_min(a, w) == [a[i : i + w].min() for i in range(300 - w + 1)]).all()
    data = np.frombuffer(b"a bb\tccc  bb\na" * 40, np.uint8)
    s, e, h = word_hashes(data)
    by = defaultdict(set)
    for i, j, v in zip(s, e, h, strict=True):
        by[data[i:j].tobytes()].add(int(v))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    g = byte_gram_hashes(data, 32)
    assert len(set(g.tolist())) == len({data[i : i + 32].tobytes() for i in range(len(g))})
    n = ngram_hashes(h, 5)
    assert len(n) == len(h) - 4
    places = window_anchors(n, 9)
    assert all(i <= p < i + 9 and n[p] >> U64(27) == (n[i : i + 9] >> U64(27)).min() for i, p in enumerate(places))
    assert Words().anchors(np.frombuffer(b"too few words", np.uint8))[0].size == 0
