"""Classifier, searches, mixing, token counts, byte-pair encoding and LM scores against plain versions."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cytolake.llm import byte_bpe, kneser_ney, mixing, mtree, prefix_forest, quality, token_counts
from cytolake.llm._common import mix, shard_of, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- mixing

def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    free = [s for s in names if sizes[s]]
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        add = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += add[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                free.remove(s)
    return target


def test_mixing(make, corpus):
    rows = mixing.mix(make(corpus)).collect()
    assert len(rows) == len(corpus)
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    expected, taken = plain_targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= len(sizes) for s in sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    again = mixing.mix(make(list(reversed(corpus)))).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)


@pytest.mark.parametrize("seed", [7, 8])
def test_mixing_serves_by_virtual_finish_time(make, corpus, seed, monkeypatch):
    """A plain queue: every word of a packet is served in order of the packets' finish times, until the budget is out."""
    import hashlib

    monkeypatch.setattr(mixing, "TIME_RANGES", 5)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", 2)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    rows = [r for r in corpus if r[0] not in (500, 501)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target, packets = plain_targets(sizes), []
    for name in sizes:
        queue = sorted((int(hashlib.md5(f"{seed}|{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16), k) for k, (i, t, s) in enumerate(rows) if s == name)
        at = 0
        for _ in range(2):
            for place, k in queue:
                n = len(WORD.findall(rows[k][1] or ""))
                # a packet ends where the source's target is met
                for end in sorted({min(at + n, max(at, int(target[name]))), at + n}):
                    if end > at and target[name] > 0:
                        packets.append((end / target[name], place, at, end - at, k))
                        n, at = n - (end - at), end
    left, taken = int(1.5 * sum(sizes.values())), Counter()
    for _, _, _, words, k in sorted(packets):
        taken[k] += min(words, left)
        left -= min(words, left)
    got = Counter()
    for r in mixing.mix(make(rows), seed=seed).collect():
        got[r["key"], r["source"], r["size"]] += r["taken"]
    expected = Counter()
    for k, (i, t, s) in enumerate(rows):
        expected[i, s, len(WORD.findall(t or ""))] += taken[k]
    assert +got == +expected


def test_mixing_ends(make):
    assert mixing.mix(make([]).limit(0)).count() == 0
    only_empty = mixing.mix(make([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in only_empty] == [(0, 0, 0.0)] * 2


def test_mixed_documents(make, corpus):
    docs = make([r for r in corpus if r[0] not in (500, 501)])
    taken = {(r["key"], r["shuffle"]): r for r in mixing.mix(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    expected = Counter()
    for (i, _), r in taken.items():
        expected[i] += r["taken"]
    assert words == +expected


def test_mixed_repeated_rows(spark, make):
    """Rows of one id and text in two sources are documents of either; others of a source share what is taken."""
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (2, "i j k l", "y"), (3, "m n", "z"), (None, "o p q r s", "z"), (None, "o p q r s", "z")]
    docs = make(rows).withColumn("keep", F.concat("keep", F.monotonically_increasing_id().cast("string")))
    taken, words = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r["key"], r["source"]] += r["taken"]
    for r in mixing.apply_mix(docs).collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    assert words == +taken


# ---------------------------------------------------------------- searches

def vectors(rng, n=400, dim=16):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:80] = x[50]  # ties
    return [(k, [float(v) for v in row], 0, "x", 1) for k, row in enumerate(x)]


VEC = "vec_id long, embedding array<float>, label int, shard string, block int"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = vectors(rng) + [(1000, None, 0, "x", 1), (1020, [1.0, None] + [0.0] * 14, 0, "x", 1), (1040, [math.nan] * 16, 0, "x", 1), (1060, [math.inf] * 16, 0, "x", 1), (1100, [0.0] * 16, 0, "x", 1), (None, [1.0] * 16, 0, "x", 1)]
    return rows, spark.createDataFrame(rows, VEC)


@pytest.mark.parametrize("rows_in_shard", [64, 32768])
def test_exact_top_k(table, monkeypatch, rows_in_shard):
    monkeypatch.setattr(mtree, "SHARD_ROWS", rows_in_shard)
    rows, df = table
    good = [(i, [math.floor(64 * v) for v in e]) for i, e, *_ in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e)]
    expected = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:20]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == sorted(expected)


def test_exact_top_k_of_large_components(spark):
    rows = [(k, [3e30 * (k - 2), 1.0], 0, "x", 1) for k in range(5)] + [(20, [1e30, 5.0, 7.0], 0, "x", 1)]
    got = mtree.top_k(spark.createDataFrame(rows, VEC), k=3).collect()
    assert {r["query_id"] for r in got} == {0, 20} and all(abs(r["score"]) < 2**63 for r in got)


@pytest.mark.parametrize("width, size, rows", [(768, 64, 700), (130, 1, 700), (8, 1 << 20, 700), (192, 1 << 26, 200), (3, 1 << 29, 200)])
def test_the_tree_serves_wide_and_large_vectors(width, size, rows):
    """Also beyond the integers that doubles hold."""
    x = np.floor(np.random.default_rng(8).normal(size=(rows, width)) * size)
    x[40:70] = x[40]  # ties
    place, row, score = mtree._find(np.arange(rows), x, np.arange(0, rows, 20), x[::20], 20)
    whole = [[int(v) for v in r] for r in x]
    for i in range(rows // 20):
        s = [max(1 - mtree._LIMIT, min(mtree._LIMIT, sum(a * b for a, b in zip(whole[20 * i], r)))) for r in whole]
        best = sorted((-s[j], j) for j in range(rows) if j != 20 * i)[:20]
        assert sorted(zip((-score[place == i]).tolist(), row[place == i].tolist())) == best


def test_bounds_save_most_products_of_clusters():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.floor(64 * (centres[rng.integers(0, 100, 12_000)] + 0.02 * rng.normal(size=(12_000, 64))))
    tree, q = mtree.MTree(x), x[::20]
    none = np.zeros((len(q), 2), np.int64)
    place, row, score = tree.top(q, none, 20)
    assert tree.computed < 0.3 * len(x) * len(q)
    best = -np.sort(-(q @ x.T), axis=1)[:, :20]
    assert (np.sort(score.reshape(-1, 20), axis=1)[:, ::-1] == best).all()
    least = best[:, 4].astype(np.int64)
    place, row, score = tree.top(q, none, 20, least)
    assert (score >= least[place]).all() and (np.bincount(place) >= 5).all()


def test_balls_of_clusters_are_left_out(spark, monkeypatch):
    """Queries go to the balls that can hold their neighbours; repeated rows count each."""
    monkeypatch.setattr(mtree, "SHARD_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = 10 * rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 500)] + 0.1 * rng.normal(size=(500, 8))).astype(np.float32)
    rows = [(int(k), [float(v) for v in x[k]], 0, "x", 1) for k in [*range(500), 7, 7, 20, 40]]
    good = [(i, [math.floor(64 * v) for v in e]) for i, e, *_ in rows]
    expected = []
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:20]
            expected += [(q, i, -s) for s, i in best]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in mtree.top_k(spark.createDataFrame(rows, VEC)).collect()]
    # a repeated query is one query: its answers are found twice and cut to k
    single = [e for e in expected if e[0] not in (20, 40)]
    assert sorted(g for g in got if g[0] not in (20, 40)) == sorted(single) and {g[0] for g in got} == {q for q, _ in good if q % 20 == 0}


def test_small_pages_prune_nothing_away():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 6)) * 64)
    q = x[::20]
    place, row, score = mtree.MTree(x, page=8).top(q, np.c_[np.arange(0, 500, 20), np.arange(0, 500, 20) + 1], 7)
    for i in range(len(q)):
        s = x @ q[i]
        s[i * 20] = -np.inf
        assert sorted(zip(-score[place == i], row[place == i])) == sorted(zip(-s, range(500)))[:7]


@pytest.mark.parametrize("rows_in_shard", [128, 32768])
def test_neighbours(table, monkeypatch, rows_in_shard):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", rows_in_shard)
    rows, df = table
    good = {i: np.array(e, float) for i, e, *_ in rows if i is not None and e is not None and all(v is not None and math.isfinite(v) for v in e) and any(e)}
    got = defaultdict(list)
    for r in prefix_forest.neighbours(df).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(np.sqrt(((good[r["query_id"]] - good[r["vec_id"]]) ** 2).sum()))
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {i for i in good if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 10
        best = sorted((np.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)[:10]
        hits += len({i for _, i in best} & {i for _, i in found})
    assert hits >= 0.9 * 10 * len(got)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    hits = n = 0
    found = defaultdict(set)
    for r in prefix_forest.neighbours(df).collect():
        found[r["query_id"]].add(r["vec_id"])
    for q, got in found.items():
        d = ((m - x[q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(got & set(ids[np.argsort(d)[:10]].tolist()))
        n += 10
    assert hits >= 0.9 * n


@pytest.mark.parametrize("copies", [8, 9, 10, 30])
def test_copies_do_not_use_up_the_ascent(copies):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16))
    x[:copies] = x[0]
    place, row, score = prefix_forest._find(np.arange(500), x, np.arange(copies), x[:copies], 10)
    for q in range(copies):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(500), d)) if i != q][:10]
        found = row[place == q].tolist()
        assert len(found) == 10 and found[: copies - 1] == best[: copies - 1] and len(set(found) & set(best)) >= 9


def test_equal_distances_at_the_last_rank():
    """Ties go to the smaller id, also across the k-th rank."""
    x = np.r_[np.eye(16), -np.eye(16), np.zeros((1, 16))] + 3.0
    ids = np.r_[np.arange(32)[::-1], 100]
    order = np.argsort(ids)
    place, row, score = prefix_forest._find(ids[order], x[order], np.array([100]), x[32:], 10)
    assert row.tolist() == list(range(10)) and np.allclose(score, 1)


def test_candidates_are_at_least_k_or_all():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    x[:9] = x[0] + 1e-9 * rng.normal(size=(9, 16))
    place, _, _ = prefix_forest._find(np.arange(2000), x, np.arange(12), x[:12], 1500)
    assert np.bincount(place).tolist() == [1500] * 12
    place, row, _ = prefix_forest._find(np.arange(12), x[:12], np.arange(12), x[:12], 20)
    assert np.bincount(place).tolist() == [11] * 12 and (place != row).all()


def test_empty_searches(spark):
    none = spark.createDataFrame([], VEC)
    assert mtree.top_k(none).count() == prefix_forest.neighbours(none).count() == 0
    one = spark.createDataFrame([(100, [1.0], 0, "x", 1), (3, [2.0, 5.0], 0, "x", 1), (100, [7.0], 0, "x", 1)], VEC)
    assert {r["vec_id"] for r in prefix_forest.neighbours(one).collect()} == {3}


# ---------------------------------------------------------------- token counts

@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), token_counts.PrefixCounts(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghtheing 'sdmlé世🌍1٣ΣσİẞA\t\ń|<>"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=40))
def test_counts_are_the_librarys(library, text):
    tokenizer, counter = library
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert counter.total(text) == count(text)
    text = counter.normal(text)
    if unicodedata.normalize("NFC", text) == text and counter.normal(text) == text:
        ends, counts = counter.prefixes(text)
        for e, c in zip(ends, counts):
            if counter.normal(text[:e]) == text[:e]:
                assert c == count(text[:e])


def test_special_strings_and_budget(library):
    tokenizer, counter = library
    text = "one<|endoftext|>two  three <|startoftext|> unbelievable"
    assert counter.total(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    ends, counts = counter.prefixes(text)
    for budget in range(counter.total(text) + 2):
        end = counter.within(text, budget)
        assert end == max([e for e, c in zip(ends, counts) if c <= budget], default=0)


def test_count_tokens(make, corpus, library):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = token_counts.count_tokens(make(corpus), path, limit=300).collect()
    expected = [(i, len((t or "").encode()), n := len(library[0].encode(t or "", add_special_tokens=False).ids), n > 300) for i, t, _ in corpus]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    long = token_counts.count_tokens(make(corpus[:5]), path, limit=10, prefixes=True).collect()
    assert all((r["fit_chars"] is not None) == r["over_limit"] and len(r["prefix_ends"]) == len(r["prefix_tokens"]) for r in long)
    assert token_counts.count_tokens(make([]).limit(0), path).count() == 0


# ---------------------------------------------------------------- byte-pair encoding

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_encode_and_decode(make, corpus, encoding):
    docs = make([*corpus, (900, "<|endoftext|> x", None), (901, "ab" * 4000, None)])
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    expected = [(i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in corpus] + [(900, encoding.encode_ordinary("<|endoftext|> x"), b"<|endoftext|> x"), (901, encoding.encode_ordinary("ab" * 4000), b"ab" * 4000)]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == sorted(expected, key=repr)
    assert byte_bpe.encode(make([]).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_small_blocks_give_the_same(make, corpus, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 50)
    got = byte_bpe.encode(make(corpus).coalesce(1), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(((i, encoding.encode_ordinary(t or "")) for i, t, _ in corpus), key=repr)


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([([1, 2],), (None,), ([],), ([10**6],), ([-1],), ([None],)], "ids array<int>")
    got = [r["decoded"] for r in byte_bpe.decode(rows, RANKS).collect()]
    assert got[0] is not None and bytes(got[2]) == b"" and [got[k] for k in (1, 3, 4, 5)] == [None] * 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(-2, 6)), max_size=6)), max_size=6), st.integers(0, 3))
def test_join_with_the_token_table(rows, skip):
    import pyarrow as pa

    ranks = {b"a": 0, b"bc": 1, b"\xff": 2, b"def": 4}
    table = {r: t for t, r in ranks.items()}
    got = byte_bpe.decoded(pa.array(rows, pa.list_(pa.int32())).slice(skip), byte_bpe.token_bytes(ranks)).to_pylist()
    assert got == [None if row is None or any(i not in table for i in row) else b"".join(table[i] for i in row) for row in rows[skip:]]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeé世", min_size=1, max_size=60))
def test_long_words_are_encoded_alike(encoding, word):
    raw = word.encode()
    if raw not in encoding._mergeable_ranks:
        assert byte_bpe._encode_long([raw[i : i + 1] for i in range(len(raw))], encoding._mergeable_ranks) == byte_bpe.encode_word(raw, encoding._mergeable_ranks)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**21), max_size=50))
def test_code_planes(values):
    codes = np.array(values, np.int32)
    assert (byte_bpe.unpacked_codes(byte_bpe.packed_codes(codes)) == codes).all()


def test_code_planes_of_a_block_with_many_words():
    codes = np.array([0, 127, 128, 2**14 - 1, 2**14, 2**21 - 1, 2**21, 2**22 - 1, 2**22, 2**22 + 5, 2**29 - 1, 3], np.int32)
    assert (byte_bpe.unpacked_codes(byte_bpe.packed_codes(codes)) == codes).all()
    with pytest.raises(ValueError, match="distinct words"):
        byte_bpe.packed_codes(np.array([2**29], np.int32))


# ---------------------------------------------------------------- LM scores

def chen_goodman(times):
    """D1, D2, D3 by the published formulas, from the counts of all types; within (0, count)."""
    n = [sum(x == k for x in times) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return {k: min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2, 0.05 * k), 0.95 * k) for k in (1, 2, 3)}


def plain_model(texts):
    """p(w, v, u) from dictionaries; u is None for the first token of a text, whose v is 1."""
    one, two, three = Counter(), Counter(), Counter()
    for ws in texts:
        one.update(ws)
        two.update(zip([1, *ws], ws))
        three.update(zip([1, *ws], ws, ws[1:]))
    before = Counter((v, w) for _, v, w in three)  # distinct tokens before a pair
    pairs = {p: c if p[0] == 1 else before[p] for p, c in two.items()}
    ends = Counter(w for _, w in pairs)
    d3, d2, d1 = chen_goodman(three.values()), chen_goodman(pairs.values()), chen_goodman(ends.values())
    kinds, vocabulary = len(pairs), len(one)
    spare = sum(d1[min(c, 3)] for c in ends.values()) / kinds if kinds else 1.0
    of_pair, of_word = defaultdict(list), defaultdict(list)
    for (u, v, _), c in three.items():
        of_pair[u, v].append(c)
    for (v, _), c in pairs.items():
        of_word[v].append(c)

    def level(c, all_counts, d, lower):
        if not all_counts:
            return lower
        return ((c - d[min(c, 3)] if c else 0) + sum(d[min(x, 3)] for x in all_counts) * lower) / sum(all_counts)

    def p(w, v, u=None):
        low = (ends[w] - d1[min(ends[w], 3)] if ends[w] else 0) / max(kinds, 1) + spare / (vocabulary + 1)
        low = level(pairs.get((v, w), 0), of_word[v], d2, low)
        return low if u is None else level(three[u, v, w], of_pair[u, v], d3, low)

    return p, one


def test_kneser_ney(make, corpus):
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = kneser_ney.score(make(corpus), train).collect()
    rows = [(i, [*WORD.findall((t or "").translate(LOWER)), 0], i is None or i % 3 != 0) for i, t, _ in corpus]
    p, c = plain_model([ws for _, ws, t in rows if t])
    n, v = sum(c.values()), len(c)
    expected = sorted(((i, len(ws), sum(c[w] > 0 for w in ws), n) for i, ws, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=repr) == expected
    whole = lambda ws: sum(math.log10(p(w, a, b)) for w, a, b in zip(ws, [1, *ws], [None, 1, *ws]))
    near = lambda rs: sorted((repr(i), round(b, 6), round(s, 3)) for i, b, s in rs)
    assert near((r["doc_id"], r["base_score"], r["score"]) for r in got) == near((i, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), whole(ws)) for i, ws, _ in rows)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got)
    # probabilities of all words and of an unknown one sum to 1
    for v, u in ((1, None), ("go", 1), ("go", "go"), ("nowhere", "nowhere"), ("go", "nowhere")):
        assert sum(p(w, v, u) for w in c) + p("unknown word", v, u) == pytest.approx(1)


def test_other_texts_under_a_kept_model(make, corpus, tmp_path):
    """Arrays that were kept score texts as the run that counted them did, and texts that it never saw."""
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    near = lambda rows: sorted((repr(r["doc_id"]), r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    first = kneser_ney.score(make(corpus), ~held, model=str(tmp_path / "m")).collect()
    assert near(kneser_ney.perplexity(make(corpus), str(tmp_path / "m")).collect()) == near(first)
    others = [(1, "go go go never seen", None), (2, None, None), (3, "", None)]
    p, _ = plain_model([[*WORD.findall((t or "").translate(LOWER)), 0] for i, t, _ in corpus if i is None or i % 3])
    for r in kneser_ney.perplexity(make(others), str(tmp_path / "m")).collect():
        ws = [*WORD.findall(others[r["doc_id"] - 1][1] or ""), 0]
        assert r["score"] == pytest.approx(sum(math.log10(p(w, a, b)) for w, a, b in zip(ws, [1, *ws], [None, 1, *ws])))
    assert kneser_ney.perplexity(make([]).limit(0), str(tmp_path / "m")).count() == 0


def test_small_blocks_of_the_model_give_the_same(make, corpus, monkeypatch):
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    near = lambda rows: sorted((repr(r["doc_id"]), r["n_known"], round(r["score"], 6)) for r in rows)
    whole = near(kneser_ney.score(make(corpus).coalesce(1), train).collect())
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 3000)
    assert near(kneser_ney.score(make(corpus).repartition(3), train).collect()) == whole


def test_lm_ends(make):
    assert kneser_ney.score(make([]).limit(0), F.lit(True)).count() == 0
    r = kneser_ney.score(make([(1, "a b", None)]), F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0, 0)


def test_lm_beats_unigrams_on_held_out_text(spark):
    rows = kneser_ney.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ~quality.held_out("doc_id", 7, 2)).filter(quality.held_out("doc_id", 7, 2))
    r = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=30))
def test_sorted_numbers_packed(values):
    values = np.array(sorted(values), np.int64)
    assert (kneser_ney.unpacked_sorted(kneser_ney.packed_sorted(values)) == values).all()


def test_mapped_arrays():
    m = kneser_ney.MappedArrays(np.array([3, 9, 2**62]), [np.array([1, 5, 2**40]), np.array([7, 8, 9])])
    assert isinstance(m.keys.base, np.memmap) or isinstance(m.keys, np.memmap)
    assert m.find(np.array([2, 3, 9, 2**62]))[1].tolist() == [[0, 1, 5, 2**32 - 1], [0, 7, 8, 9]]
    assert kneser_ney.MappedArrays(np.zeros(0), [np.zeros(0)]).find(np.array([5]))[1].tolist() == [[0]]


def test_bigrams_whose_hashes_agree_in_32_bits_of_a_shard(spark, make):
    names = [f"w{k}" for k in range(1500)]
    words = np.concatenate([word_hashes(np.frombuffer(w.encode(), np.uint8))[2] for w in names])
    n_shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = mix((words * np.uint64(0x9E3779B97F4A7C15))[:, None] + words).ravel()
    tags = shard_of(keys, n_shards).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    order = np.argsort(tags, kind="stable")
    pairs = [[*divmod(int(order[k]), 1500), *divmod(int(order[k + 1]), 1500)] for k in np.flatnonzero(tags[order][1:] == tags[order][:-1])]
    a, b, c, d = (names[k] for k in next(p for p in pairs if len(set(p)) == 4))

    def scores(a, b, c, d):
        texts = [*[f"{a} {b}"] * 6, f"{c} {c} {a} {b} {b}", f"{d} {d} {c}", f"{b} {d} {a}", f"{c} {d}", f"{a} {d} {c} {d}"]
        rows = kneser_ney.score(make([(k, t, None) for k, t in enumerate(texts)]), F.col("doc_id") < 9).collect()
        return {r["doc_id"]: r["score"] for r in rows}

    assert scores(a, b, c, d) == pytest.approx(scores("one", "two", "three", "four"), abs=1e-9)


# ---------------------------------------------------------------- quality

def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter(~quality.held_out("doc_id", 5, 0)), sample=2500)
    rows = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out("doc_id", 5, 0)).select("score", "quality").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert ((s >= 0.3) == y).mean() > 0.95 and (s[y == 1] >= 0.3).mean() > 0.99
    order = np.argsort(np.argsort(s)) + 1
    n1 = y.sum()
    assert (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)) > 0.97


def test_features_and_scores_against_plain_loops(spark, make):
    """Word vectors, pools and the network's probability, token by token and bucket by bucket."""
    texts = ["The cat sat, the cat ran.", "x1 y2 x1 y2!!", "héllo wörld 42", "", None, "a"]
    token = re.compile(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff \t\n\x0b\x0c\r]+")
    bucket = {}
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        found = np.concatenate([np.zeros(0, np.int64), *quality.token_buckets(raw)]).tolist()
        names = token.findall(t or "")
        assert len(found) == len(names)
        for name, b in zip(names, found):
            assert bucket.setdefault(name, b) == b
    index = quality.index_vectors()
    context = defaultdict(lambda: np.zeros(quality.DIM))
    for t in texts:
        names = token.findall(t or "")
        for i, name in enumerate(names):
            for j in range(max(0, i - quality.REACH), min(len(names), i + quality.REACH + 1)):
                if j != i:
                    context[bucket[name]] += index[bucket[names[j]]]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    docs = make([(k, t, "s") for k, t in enumerate(texts)])
    model = quality.train(docs, labels)
    for b in range(quality.BUCKETS):
        if b in context or b < 50:
            v = index[b] + context[b]
            assert np.allclose(model.vectors[b], v / max(np.linalg.norm(v), 1e-6), atol=1e-5)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for k, t in enumerate(texts):
        v = [model.vectors[bucket[n]].astype(float) for n in token.findall(t or "")]
        pool = [sum(x[d] for x in v) / max(len(v), 1) for d in range(quality.DIM)]
        pairs = [sum(x[d] * y[d] for x, y in zip(v, v[1:])) / max(len(v) - 1, 1) for d in range(quality.DIM)]
        x = [(a - c) / s for a, c, s in zip([*pool, *pairs, math.log(1 + len(v)) / 10], model.center, model.spread)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, column)) + b) for column, b in zip(model.w1.T, model.b1)]
        logit = (sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature
        assert scores[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-6)


def test_the_fit_lowers_the_loss_and_the_temperature_is_its_best():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2 * quality.DIM + 1))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    model = quality.fit(x, y, quality.unit(quality.index_vectors()))
    p = model.scores(x)
    assert ((p >= 0.5) == y).mean() > 0.9
    held = np.random.default_rng(3)
    held.normal(0, 1, (x.shape[1], quality.HIDDEN)), held.normal(0, 1, quality.HIDDEN)
    rows = held.permutation(len(y))[: len(y) // 5]
    loss = lambda t: np.mean(np.logaddexp(0, model.logits(x[rows]) / t) - y[rows] * model.logits(x[rows]) / t)
    best = min(np.exp(np.linspace(-2, 2.5, 400)), key=loss)
    assert loss(model.temperature) <= loss(best) + 1e-6


def test_classifier_ends(spark, make, corpus):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality.score(make(corpus), quality.train(make(corpus), some), keep=("keep", "id")).collect()
        assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 and r["keep"] == "k" and r["id"] == "i" for r in got)
    none = make([]).limit(0)
    assert quality.score(none, quality.train(none, labels)).count() == 0


def test_scores_do_not_depend_on_other_columns(make):
    model = quality.fit(np.random.default_rng(0).normal(size=(50, 2 * quality.DIM + 1)), np.arange(50) % 2, quality.unit(quality.index_vectors()))
    a, b = (quality.score(make([(i, "same text here", s)]), model).first()["score"] for i, s in ((1, "x"), (99, None)))
    assert a == b


def test_tokens_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer(("word, next " * 300 + "x" * 5000).encode(), np.uint8)
    whole = np.concatenate(list(quality.token_buckets(data)))
    monkeypatch.setattr(quality, "SLICE_BYTES", 6000)
    assert (np.concatenate(list(quality.token_buckets(data))) == whole).all()


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, make, corpus, tmp_path):
    import corpus_pipeline as c

    rng = random.Random(2)
    junk = [(1000 + k, " ".join(["JUNK!!"] * rng.randint(20, 60)), "s1") for k in range(60)]
    rows = [*corpus, *junk, *[(2000 + k, " ".join("".join(rng.choice("aeioumnrst") for _ in range(5)) for _ in range(60)), f"s{k % 3}") for k in range(80)]]
    labels = [(i, 0 if i >= 1000 and i < 2000 else 1, 0) for i, *_ in rows if i is not None and (i % 2 or i < 1000)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    assert [n for n, _ in c.STAGES] and len(c.STAGES) == 5
    for k, (_, stage) in enumerate(c.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        columns = columns or before.columns
        if k < 4:
            assert docs.columns == columns
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k == 0:
            assert not [i for i in ids if i is not None and 1000 <= i < 2000] and sum(i is not None and i >= 2000 for i in ids) == 80
        if k == 1:  # one of each group of copies; null and empty texts stay
            assert 201 in ids and 202 not in ids and 203 not in ids and {401, 402} <= set(ids) and 100 in ids
        if k == 2:
            kept = {r["doc_id"]: r for r in docs.collect()}
            first = {r["doc_id"]: r["text"] for r in before.collect()}
            assert kept[100]["text"] == first[100] and len(kept[101]["text"]) < len(first[101]) and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in kept.values())
        if k == 3:
            n = len(WORD.findall(" ".join(r["text"] or "" for r in before.collect())))
            assert abs(len(WORD.findall(" ".join(r["text"] for r in docs.collect()))) - int(1.5 * n)) <= 10
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    expected = sorted((r["doc_id"] or -1, enc.encode_ordinary(r["text"] or "")) for r in before.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in docs.collect()) == expected
    assert c.run(spark, str(tmp_path)).count() == len(expected)


def test_pipeline_of_an_empty_table(spark, make, tmp_path):
    import corpus_pipeline as c

    make([]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_stages_side_by_side(spark, make, corpus, tmp_path):
    """A stage's result stays readable when the same stage runs on something else."""
    import corpus_pipeline as c

    first, second = make(corpus), make(corpus[:30])
    for stage in (c.one_of_near_copies, c.without_repeats, c.mixed, c.encoded):
        a = stage(spark, first, "")
        b = stage(spark, second, "")
        assert b.count() <= a.count()
        assert len(a.collect()) == a.count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cytolake.llm._common import shared_dir

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")) and shared_dir(session("local"))


def test_labels_of_a_repeated_id_count_once(spark, make):
    rows = [(k % 7, f"text {k} " * (k % 5), "s") for k in range(70)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)], "doc_id long, quality int, toxic int")
    model = quality.train(make(rows), labels, sample=5)
    again = quality.train(make(rows[::-1]), labels, sample=5)
    assert np.allclose(model.vectors, again.vectors) and np.allclose(model.center, again.center)


def test_queries_run_on_the_small_tables(spark):
    from cytolake.llm.queries import QUERIES

    n = spark.read.parquet(f"{TABLES}/documents.parquet").count()
    for name, run in QUERIES.items():
        if name not in ("op2_prefix_forest", "op6_mtree_topk"):
            rows = run(spark, TABLES).collect()
            assert len({r["doc_id"] for r in rows}) == len(rows) == n, name
