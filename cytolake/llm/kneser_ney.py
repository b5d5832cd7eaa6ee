"""LM scoring with an interpolated modified Kneser-Ney model of order three.

Documents are held in blocks: word codes by falling frequency, and the hashes of the block's words. A block sends each
of its distinct triples of tokens once, as a hash, to the hash's shard, with how often it occurs in training. A shard's
part of the model is a sorted array of hashes beside arrays of counts; the worker writes them to a file of its own, maps
it into memory, and looks up the triples of every block there. Blocks get back the corpus count of each of their
triples, and a mark on those that they own (one block owns each triple of the training text). From the owned ones they
derive what smoothing needs of pairs: how many triples a pair begins that were seen once, twice or more often, and how
many it ends. These travel by pair in the same way, are summed and looked up; and what the owned pairs tell of words
travels by word. Then blocks score their documents. So counting and scoring share each exchange, the model is never in
one place, and its shards grow in number with the texts.

Triples, pairs and words are known by 63 bits of a hash, whatever the number of shards: among 10**9 types, 0.05 pairs
are expected to share one, and one lookup in 10**10 of an unseen one to find another's count.

p(w | u v) = max(c(uvw) - D(c(uvw)), 0) / c(uv) + (D1 N1(uv) + D2 N2(uv) + D3 N3(uv)) / c(uv) * p(w | v)
p(w | v)   = max(a(vw) - E(a(vw)), 0) / a(v) + (E1 N1(v) + E2 N2(v) + E3 N3(v)) / a(v) * p(w)
p(w)       = max(N(w) - F(N(w)), 0) / N + (F1 M1 + F2 M2 + F3 M3) / N / (V + 1)

with a(vw) the number of distinct tokens before vw (where v is the mark before a text: how often vw occurs), a(v) their
sum, N(w) the number of distinct tokens before w, N their sum, and discounts D, E and F from the counts of counts. Each
text starts after a mark that is no token itself; its first token is scored by p(w | v). The last term leaves room for
unknown words.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.llm._anchors import NO_ID, ids_of
from cytolake.llm._common import U64, dealt, lowered, mix, packed, packed_bytes, shard_of, shards_for, stored, stretches, texts_of, unpacked, unpacked_bytes, word_hashes

#: Text of a block, and text that one shard serves.
BLOCK_BYTES, SHARD_BYTES = 10 << 20, 16 << 20
END, START = U64(0xE0D), U64(0x57A27)  # hashes of the end token and of the mark before a text
_BLOCK = ["block", "ids", "train", "sizes", "codes", "words"]
_BLOCK_DDL = "block long, ids binary, train binary, sizes binary, codes binary, words binary"


class Block:
    """The documents of a block, and their pairs and triples of tokens by hashes of 63 bits, in whose order shards are.

    Each text starts after a mark. A token has a pair with what is before it; all but a text's first have a triple."""

    def __init__(self, row: dict, n_shards: int):
        self.ids, self.train = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["train"], bool)
        self.sizes, self.codes = unpacked(row["sizes"]), unpacked(unpacked_bytes(row["codes"])).astype(np.int32)
        self.words = np.r_[np.frombuffer(row["words"], U64), START]
        self.in_training = np.repeat(self.train, self.sizes)
        self.first = np.zeros(len(self.codes), bool)  # of its text
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.before = np.r_[np.int32(0), self.codes[:-1]]
        self.before[self.first] = len(self.words) - 1
        self.n_shards = n_shards
        self.pairs = mix(self.words[self.before] * U64(0x9E3779B97F4A7C15) + self.words[self.codes])

    def grams(self, order: int) -> Grams:
        """Pairs (2), or triples (3), which are of the tokens that are not the first of their text."""
        if order == 2:
            return Grams(self.pairs >> U64(1), np.arange(len(self.codes)), self.n_shards)
        token = np.flatnonzero(~self.first)
        return Grams(mix(self.pairs[token - 1] * U64(0xD6E8FEB86659FD93) + self.words[self.codes[token]]) >> U64(1), token, self.n_shards)


class Grams:
    """The distinct tags of tokens in ascending order: tags; of each its number of tokens, and one of them."""

    def __init__(self, tags: np.ndarray, token: np.ndarray, n_shards: int):
        order = np.argsort(tags)
        ordered = tags[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(tags) else order
        self.tags, self.token = ordered[heads], token[order[heads]]
        self.place = np.empty(len(order), np.int32)  # of each token's tag
        self.place[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(order)))
        self.shard = shard_of(self.tags << U64(1), n_shards)

    def counted(self, which: np.ndarray) -> np.ndarray:
        """How many of the chosen tokens have each tag."""
        return np.bincount(self.place[which], minlength=len(self.tags))


class MappedArrays:
    """A sorted array of hashes and arrays of their counts, in a file without a name that is mapped into memory."""

    def __init__(self, keys: np.ndarray, counts: list[np.ndarray]):
        self.n, width = len(keys), len(counts)
        if not self.n:
            self.keys, self.sums = np.zeros(0, np.int64), np.zeros((width, 0), np.uint32)
            return
        with tempfile.TemporaryFile() as f:  # goes with the last handle, also when the worker is killed
            keys.astype(np.int64).tofile(f)
            for c in counts:
                np.minimum(c, 2**32 - 1).astype(np.uint32).tofile(f)
            f.flush()
            both = np.memmap(f, np.uint32, "r", shape=((2 + width) * self.n,))
        self.keys, self.sums = both[: 2 * self.n].view(np.int64), both[2 * self.n :].reshape(width, self.n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key (0 where there is none), and its counts (0 where there is none), a row for each array."""
        if not self.n:
            return np.zeros(len(keys), np.int64), np.zeros((len(self.sums), len(keys)), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        hit = self.keys[at] == keys
        return np.where(hit, at, 0), np.where(hit, self.sums[:, at], 0).astype(np.int64)


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2, D3 (at 1, 2, 3) from the numbers of types with counts 1 to 4; kept within (0, count)."""
    out = np.zeros(4)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    for c in (1, 2, 3):
        d = c - (c + 1) * y * n[c] / n[c - 1] if n[c - 1] else 0.5 * c
        out[c] = min(max(d, 0.05 * c), 0.95 * c)
    return out


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers: the first in eight bytes, then their differences, each in as many bytes as the largest needs;
    the first byte says how many. Nothing for no numbers."""
    if not len(values):
        return b""
    values = values.astype(np.int64)
    steps = np.diff(values)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + np.ascontiguousarray(steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def n_packed(raw: bytes) -> int:
    return (len(raw) - 9) // raw[0] + 1 if raw else 0


def unpacked_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    steps = np.zeros((n_packed(raw), 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, offset=1)
    steps[1:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    return np.cumsum(steps.view("<i8").ravel())


_PART = ["shard", "block", "keys", "values"]
_PART_DDL = "shard int, block long, keys binary, values binary"
_ANSWER_DDL = "block long, shard int, totals binary, own binary"


def _sent(block: int, grams: Grams, columns: list[np.ndarray]) -> pa.Table:
    """A row for each shard: the tags of a block that it serves, and columns of numbers."""
    rows = [(int(grams.shard[lo]), block, packed_sorted(grams.tags[lo:hi]), packed_bytes(packed(np.concatenate([np.zeros(0, np.int64), *[c[lo:hi] for c in columns]])))) for lo, hi in stretches(grams.shard)]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(_PART, zip(*rows, strict=True) if rows else ((), (), (), ()), kinds, strict=True)})


def _joined(answers: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """What the shards answered to a block, in order of its tags: columns of totals, and which tags it owns."""
    totals, own = [np.zeros((columns, 0), np.int64)], [np.zeros(0, bool)]
    for r in sorted(answers.select(["shard", "totals", "own"]).to_pylist(), key=lambda r: r["shard"]):
        totals.append(unpacked(unpacked_bytes(r["totals"])).reshape(columns, -1))
        own.append(np.unpackbits(np.frombuffer(r["own"], np.uint8), count=totals[-1].shape[1]).astype(bool))
    return np.concatenate(totals, axis=1), np.concatenate(own)


def _added(rows: pa.Table, columns: int, seen: int, of: int, extra: Callable[[np.ndarray, np.ndarray], dict], keep: bool) -> pa.Table:
    """A shard's part of the model: all blocks' tags as one sorted array, mapped from a file, with the sums of their
    columns. Each block gets back the sums of its tags, and owns those that it is the first to have in column seen.

    The row of block -1 holds n1 to n4, the tags whose column ``of`` is 1 to 4, and what extra makes of (tags, sums);
    with keep, also the arrays themselves."""
    rows = rows.sort_by("block")
    keys = [unpacked_sorted(x) for x in rows.column("keys").to_pylist()]
    values = [unpacked(unpacked_bytes(x)).reshape(columns, -1) for x in rows.column("values").to_pylist()]
    every = np.concatenate(keys)
    known = np.concatenate([v[seen] for v in values]) > 0
    order = np.flatnonzero(known)[np.argsort(every[known])]
    every = every[order]
    heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else order
    sums = [np.add.reduceat(np.concatenate([v[c] for v in values])[order], heads) if len(heads) else np.zeros(0, np.int64) for c in range(columns)]
    model = MappedArrays(every[heads], sums)
    del every, order, sums
    owned = np.zeros(model.n, bool)
    totals, own = [], []
    for k, v in zip(keys, values, strict=True):
        at, found = model.find(k)
        mine = (v[seen] > 0) & ~owned[at] if model.n else np.zeros(len(k), bool)
        owned[at[mine]] = True
        totals.append(packed_bytes(packed(found.ravel())))
        own.append(np.packbits(mine).tobytes())
    times = np.bincount(np.minimum(model.sums[of], 5), minlength=6) if model.n else np.zeros(6, int)
    stat = {f"n{c}": int(times[c]) for c in (1, 2, 3, 4)} | {k: int(v) for k, v in extra(model.keys, model.sums).items()}
    n = len(keys)
    kept = (packed_bytes(packed(model.sums.ravel())), packed_sorted(model.keys)) if keep else (None, None)
    return pa.table({"block": pa.array([*rows.column("block").to_pylist(), -1], pa.int64()), "shard": pa.array([rows.column("shard")[0].as_py()] * (n + 1), pa.int32()), "totals": pa.array([*totals, kept[0]], pa.binary()), "own": pa.array([*own, kept[1]], pa.binary()), **{k: pa.array([*[None] * n, v], pa.int64()) for k, v in stat.items()}})


def _held(rows: DataFrame) -> DataFrame:
    """(doc_id, text, train) as blocks."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, ids, flags, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(hashes)
            words, codes, n = np.unique(every, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            values = (block, np.array(ids, np.int64).tobytes(), np.array(flags, bool).tobytes(), packed(np.array([len(h) for h in hashes])), packed_bytes(packed(rank[codes])), words[order].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v], pa.binary()) for v in values[1:]]], names=_BLOCK)

        for b in batches:
            for i, t, data in zip(ids_of(b.column("doc_id")).tolist(), b.column("train").to_pylist(), texts_of(b.column("text")), strict=True):
                ids.append(i)
                flags.append(t)
                hashes.append(np.r_[word_hashes(lowered(data))[2], END] if data is not None and len(data) else np.array([END], U64))
                held += 32 + (len(data) if data is not None else 0)
                if held >= BLOCK_BYTES:
                    yield flush()
                    block, ids, flags, hashes, held = block + 1, [], [], [], 0
        if ids:
            yield flush()

    return stored(rows.mapInArrow(hold, _BLOCK_DDL), "lm-blocks")


def _word_grams(block: Block) -> Grams:
    return Grams(block.words >> U64(1), np.arange(len(block.words)), block.n_shards)


def _mixed(times: np.ndarray, of: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A probability interpolated with the lower order's; that alone where the context was never seen."""
    seen = np.maximum(of, 1)
    own = np.maximum(times - d[np.minimum(times, 3)], 0.0) / seen
    return np.where(of > 0, own + (d[1] * one + d[2] * two + d[3] * more) / seen * lower, lower)


def _scored(blocks: DataFrame, answers: dict[int, DataFrame], numbers: dict, n_shards: int) -> DataFrame:
    """The documents of blocks with their scores, from what the shards answered for words (1), pairs and triples."""
    big, middle, small = (discounts(numbers[f"n{k}"]) for k in (3, 2, 1))
    v, n, kinds = numbers["vocabulary"], numbers["tokens"], numbers["kinds"]
    spare = (small[1] * numbers["n1"][0] + small[2] * numbers["n1"][1] + small[3] * numbers["more"]) / kinds if kinds else 1.0

    def probabilities(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        three, two, one = (right.filter(pa.compute.equal(right.column("of"), k)) for k in (3, 2, 1))
        for row in left.to_pylist():
            block = Block(row, n_shards)
            (by_word, _), (by_pair, _), (by_triple, _) = _joined(one, 6), _joined(two, 5), _joined(three, 1)
            occurs, middles, m1, m2, m3, ends = by_word[:, _word_grams(block).place]
            p = (ends - small[np.minimum(ends, 3)]) / max(kinds, 1) + spare / (v + 1)
            pair = block.grams(2).place
            p = _mixed(by_pair[4][pair], *(x[block.before] for x in (middles, m1, m2, m3)), middle, p[block.codes])
            token = np.flatnonzero(~block.first)
            if len(token):
                times, context = by_triple[0][block.grams(3).place], pair[token - 1]
                p[token] = _mixed(times, *(x[context] for x in by_pair[:4]), big, p[token])
            c = occurs[block.codes]
            at = np.cumsum(block.sizes) - block.sizes
            out["doc_id"] += [None if i == NO_ID else i for i in block.ids.tolist()]
            out["n_tokens"] += block.sizes.tolist()
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64), at).tolist()
            out["base_score"] += np.add.reduceat(np.log10((c + 1) / (n + v + 1)), at).tolist()
            out["score"] += np.add.reduceat(np.log10(p), at).tolist()
        kind = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(x, kind[k]) for k, x in out.items()})

    every = reduce(DataFrame.unionByName, [a.select("block", "shard", "totals", "own").withColumn("of", F.lit(k)) for k, a in answers.items()])
    scored = blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(probabilities, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10 of
    the text under add-one unigrams), score (log10 of the text under the model) and perplexity (10 to the power of
    -score / n_tokens).

    train tells which rows are learned from (null: they are). Words are lower-cased (A-Z); each text ends with one end
    token, so null and empty texts have one token. Repeated rows count each, in training too. Without training rows
    every token has probability 1 / (0 + 1). Null ids are rows like others; other columns are ignored.

    model: a new folder in which the shards' sorted arrays are kept, for perplexity() of other texts."""
    n_shards = shards_for(docs, text, SHARD_BYTES)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    blocks = _held(rows)
    numbers: dict = {"shards": n_shards}

    def exchanged(order: int, parts: DataFrame, columns: int, seen: int, of: int, extra: Callable, names: tuple[str, ...], label: str) -> DataFrame:
        """The blocks' answers; the sums of all shards' numbers go to numbers, their arrays to the model's folder."""
        more, keep = ("n1", "n2", "n3", "n4", *names), model is not None
        found = dealt(parts, n_shards, "shard").groupBy("shard").applyInArrow(lambda t: _added(t, columns, seen, of, extra, keep), _ANSWER_DDL + "".join(f", {c} long" for c in more))
        found = stored(found, label)
        total = found.filter("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in more]).first().asDict()
        numbers[f"n{order}"] = [total[f"n{c}"] for c in (1, 2, 3, 4)]
        numbers.update({c: total[c] for c in names})
        if keep:
            found.filter("block < 0").select("shard", F.col("own").alias("keys"), F.col("totals").alias("sums")).write.parquet(f"{model}/order={order}")
        return found.filter("block >= 0").select("block", "shard", "totals", "own")

    # triples: how often each occurs
    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                block = Block(row, n_shards)
                grams = block.grams(3)
                yield from _sent(row["block"], grams, [grams.counted(block.in_training[~block.first])]).to_batches()

    of_three = exchanged(3, blocks.mapInArrow(triples, _PART_DDL), 1, 0, 0, lambda keys, sums: {}, (), "lm-triples")

    # pairs: how often each occurs, how many triples that occur once, twice, more often it begins, and how many it ends
    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, n_shards)
            two, three = block.grams(2), block.grams(3)
            (counts,), own = _joined(right, 1)
            token, counts, n = three.token[own], counts[own], len(two.tags)
            begun = two.place[token - 1]
            occurs = two.counted(block.in_training)
            ended = np.bincount(two.place[token], minlength=n)
            # nothing is before a text's mark: its pairs count as often as they occur
            marked = block.first[two.token]
            ended[marked] = occurs[marked]
            out.append(_sent(row["block"], two, [occurs, *[np.bincount(begun[pick], minlength=n) for pick in (counts == 1, counts == 2, counts > 2)], ended]))
        return pa.concat_tables(out)

    sent = blocks.groupBy("block").cogroup(of_three.groupBy("block")).applyInArrow(pairs, _PART_DDL)
    of_two = exchanged(2, sent, 5, 0, 4, lambda keys, sums: {}, (), "lm-pairs")

    # words: how often each occurs, how many triples have it in the middle, how many pairs it begins that end one, two,
    # more triples, and how many pairs it ends
    def words(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            block = Block(row, n_shards)
            two = block.grams(2)
            (_, _, _, _, ended), own = _joined(right, 5)
            token, ended, n = two.token[own], ended[own], len(block.words)
            occurs = np.bincount(block.codes[block.in_training], minlength=n)
            occurs[-1] = int(block.train.sum())
            begun = block.before[token]
            columns = [occurs, np.bincount(begun, weights=ended, minlength=n).astype(np.int64), *[np.bincount(begun[pick], minlength=n) for pick in (ended == 1, ended == 2, ended > 2)], np.bincount(block.codes[token], minlength=n)]
            grams = _word_grams(block)
            out.append(_sent(row["block"], grams, [c[grams.token] for c in columns]))
        return pa.concat_tables(out)

    mark = np.int64(START >> U64(1))
    extra = lambda keys, sums: {"vocabulary": (keys != mark).sum(), "tokens": sums[0][keys != mark].sum(), "kinds": sums[5].sum(), "more": (sums[5] > 2).sum()}
    sent = blocks.groupBy("block").cogroup(of_two.groupBy("block")).applyInArrow(words, _PART_DDL)
    of_one = exchanged(1, sent, 6, 0, 5, extra, ("vocabulary", "tokens", "kinds", "more"), "lm-words")
    if model is not None:
        docs.sparkSession.createDataFrame([(json.dumps(numbers),)], "value string").coalesce(1).write.text(f"{model}/numbers")
    return _scored(blocks, {3: of_three, 2: of_two, 1: of_one}, numbers, n_shards)


def perplexity(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """What score() gives, for other texts, under a model that score() has kept in a folder. A task maps one shard's
    arrays of it into memory and answers the blocks of texts; nothing is learned from them."""
    spark = docs.sparkSession
    numbers = json.loads(spark.read.text(f"{model}/numbers").first()["value"])
    n_shards = numbers["shards"]
    blocks = _held(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("train")))

    def looked_up(order: int, columns: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    row = b.slice(k, 1).to_pylist()[0]
                    block = Block(row, n_shards)
                    yield from _sent(row["block"], _word_grams(block) if order == 1 else block.grams(order), []).to_batches()

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            kept = right.to_pylist()
            arrays = MappedArrays(unpacked_sorted(kept[0]["keys"]), list(unpacked(unpacked_bytes(kept[0]["sums"])).reshape(columns, -1))) if kept else MappedArrays(np.zeros(0, np.int64), [np.zeros(0)] * columns)
            totals = [packed_bytes(packed(arrays.find(unpacked_sorted(k))[1].ravel())) for k in left.column("keys").to_pylist()]
            own = [bytes(-(-n_packed(k) // 8)) for k in left.column("keys").to_pylist()]
            return pa.table({"block": left.column("block"), "shard": left.column("shard"), "totals": pa.array(totals, pa.binary()), "own": pa.array(own, pa.binary())})

        asked = dealt(blocks.mapInArrow(ask, _PART_DDL), n_shards, "shard")
        arrays = dealt(spark.read.schema("shard int, keys binary, sums binary").parquet(f"{model}/order={order}"), n_shards, "shard")
        return stored(asked.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInArrow(answer, _ANSWER_DDL), "lm-answers")

    return _scored(blocks, {k: looked_up(k, c) for k, c in ((3, 1), (2, 5), (1, 6))}, numbers, n_shards)
