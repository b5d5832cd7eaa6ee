"""Which parts of documents can repeat elsewhere, found exactly and cheaply.

Every window (13 words, 100 bytes) chooses an anchor: the gram inside it with the smallest hash. Equal windows choose
equal anchors, so a window whose anchor occurs once in the corpus occurs once itself. Anchors are a small part of all
positions (2 of w + 1), and only their hashes travel. Each task reduces its documents' anchors to distinct ones before
the shuffle, so an anchor reaches its shard once for each block of documents, however common it is.

What meets by anchor next may be many different windows around one common anchor. The anchors that most blocks hold,
HOT_KEYS at most, are known after this step, and callers deal their windows finer than by anchor. Every task decides
by the same list, so equal windows still meet; which anchors are listed changes where windows meet, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._common import U64, batch, byte_gram_hashes, dealt, from40, low40, mix, ngram_hashes, packed_bytes, shard_of, stored, stretches, texts_of, unpacked_bytes, window_anchors, word_hashes

#: Stands for a null id: after all others.
NO_ID = 2**63 - 1
#: Keys that a task gathers before it sends them on.
BLOCK_KEYS = 1_000_000
#: The anchors that are dealt finer: those in the most blocks, in HOT_BLOCKS at least.
HOT_KEYS, HOT_OF_SHARD, HOT_BLOCKS = 1 << 16, 64, 8
LOW40 = U64((1 << 40) - 1)

_SENT = pa.schema([("shard", pa.int32()), ("done", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_SENT_DDL = "shard int, done boolean, ids binary, counts binary, keys binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("sizes", pa.binary()), ("blobs", pa.binary())])
PACKED_DDL = "bucket int, ids binary, marks binary, sizes binary, blobs binary"
_FOUND = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("found", pa.binary())])


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """13-word windows anchored on 5-word grams."""

    window, gram = 13, 5

    def __init__(self, window: int = 13, gram: int = 5):
        self.window, self.gram = window, gram

    def units(self, data: np.ndarray):
        return word_hashes(data)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor's place of each window, and the hash of each gram."""
        return self.of_units(word_hashes(data)[2])

    def of_units(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        grams = ngram_hashes(words, self.gram)
        return window_anchors(grams, self.window - self.gram + 1), grams


class Bytes:
    """100-byte windows anchored on 32-byte grams."""

    def __init__(self, window: int = 100, gram: int = 32):
        self.window, self.gram = window, gram

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        grams = byte_gram_hashes(data, self.gram)
        return window_anchors(grams, self.window - self.gram + 1), grams


def distinct_sorted(places: np.ndarray) -> np.ndarray:
    """The distinct values of an array whose equal values adjoin."""
    return places[np.flatnonzero(np.diff(places, prepend=-1))] if len(places) else places


def doc_keys(unit: Words | Bytes, within: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """A text's anchors; with within, one that the text itself repeats comes twice, and so counts as shared."""

    def keys(data: np.ndarray) -> np.ndarray:
        places, grams = unit.anchors(data)
        found, n = np.unique(grams[distinct_sorted(places)], return_counts=True)
        return np.repeat(found, np.minimum(n, 2)) if within else found

    return keys


def packed_by_doc(shard: np.ndarray, doc: np.ndarray, keys: np.ndarray, ids: np.ndarray, done: bool) -> Iterator[pa.RecordBatch]:
    """One row a shard: its documents, how many keys each has, and the keys."""
    order = np.lexsort((doc, shard))
    shard, doc, keys = shard[order], doc[order], keys[order]
    rows = []
    for lo, hi in stretches(shard):
        heads = np.flatnonzero(np.diff(doc[lo:hi], prepend=-1))
        rows.append((int(shard[lo]), ids[doc[lo:hi][heads]].tobytes(), np.diff(heads, append=hi - lo).astype(np.uint32).tobytes(), low40(keys[lo:hi])))
    if rows:
        a, b, c, d = zip(*rows, strict=True)
        yield batch(_SENT, shard=a, done=[done] * len(rows), ids=b, counts=c, keys=d)


def packed_by_bucket(ids: list[int], marks: list[int], blobs: list[bytes], n_buckets: int) -> pa.Table:
    """What was found for documents, in one row for each bucket of ids: rows do not multiply with the shards."""
    own, other = np.array(ids, np.int64), np.array(marks, np.int64)
    bucket = (mix(own.astype(U64)) % U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = []
    for lo, hi in stretches(bucket[order]):
        part = order[lo:hi]
        some = [blobs[k] for k in part.tolist()]
        rows.append((int(bucket[part[0]]), own[part].tobytes(), other[part].tobytes(), np.array([len(x) for x in some], np.uint32).tobytes(), b"".join(some)))
    return pa.table(dict(zip(_PACKED.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in _PACKED.names}, schema=_PACKED)


def by_document(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(id, mark, found): for each document all that was found, one after the other."""

    def unpack(rows: pa.Table) -> pa.Table:
        found: dict[tuple, list[bytes]] = {}
        for r in rows.to_pylist():
            at = 0
            for i, m, n in zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["marks"], np.int64).tolist(), np.frombuffer(r["sizes"], np.uint32).tolist(), strict=True):
                found.setdefault((i, m), []).append(r["blobs"][at : at + n])
                at += n
        return pa.table({"id": pa.array([None if i == NO_ID else i for i, _ in found], pa.int64()), "mark": pa.array([m for _, m in found], pa.int64()), "found": pa.array([b"".join(x) for x in found.values()], pa.binary())}, schema=_FOUND)

    return dealt(packed, n_buckets, "bucket").groupBy("bucket").applyInArrow(unpack, "id long, mark long, found binary")


def shared_keys(docs: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], n_shards: int, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(id, mark, found): for each document the low 40 bits of those of its keys that another document (or row) has
    too, five bytes each; mark is 0. And the low 40 bits of the keys that the most blocks hold, ascending.

    keys_of gives a text's distinct 64-bit keys. Documents without such keys give no row; null texts have none.
    Different keys with the same low 40 bits in one shard count as shared: callers use the answer as a filter only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held, block = [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if not keys:
                return
            every, doc = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            own = np.array(ids, np.int64)
            order = np.argsort(every, kind="stable")
            every, doc = every[order], doc[order]
            heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            many = np.repeat(np.diff(heads, append=len(every)) > 1, np.diff(heads, append=len(every)))
            block += 1
            if many.any():  # known here already
                place = (doc[many] + block) % n_shards
                yield from packed_by_doc(place, doc[many], every[many], own, True)
            # anchors and prefixes are small hashes: mixed, or the first shards would get most of them
            yield from packed_by_doc(shard_of(mix(every[heads]), n_shards), doc[heads], every[heads], own, False)

        for part in batches:
            for i, data in zip(ids_of(part.column(0)), texts_of(part.column(1)), strict=True):
                found = keys_of(data) if data is not None else ()
                if len(found):
                    ids.append(i)
                    keys.append(found)
                    held += len(found)
                if held >= BLOCK_KEYS:
                    yield from flush()
                    ids, keys, held = [], [], 0
        yield from flush()

    def meet(rows: pa.Table) -> pa.Table:
        done = rows.column("done").to_numpy()
        ids = [np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()]
        keys = [from40(x) for x in rows.column("keys").to_pylist()]
        every = np.concatenate([k for k, d in zip(keys, done, strict=True) if not d] or [np.zeros(0, U64)])
        every.sort()
        heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        blocks = np.diff(heads, append=len(every))
        shared, blocks = every[heads[blocks > 1]], blocks[blocks > 1]
        common = np.argsort(-blocks, kind="stable")[:HOT_OF_SHARD]
        common = common[blocks[common] >= HOT_BLOCKS]
        out_ids, out_keys = [], []
        for i, c, k, d in zip(ids, counts, keys, done, strict=True):
            if not d:
                at = np.minimum(np.searchsorted(shared, k), max(len(shared) - 1, 0))
                hit = shared[at] == k if len(shared) else np.zeros(len(k), bool)
                doc = np.repeat(np.arange(len(i)), c)[hit]
                k = k[hit]
                i, c = i[distinct_sorted(doc)], np.bincount(doc, minlength=len(i))
                c = c[c > 0]
            raw, ends = low40(k), np.cumsum(c) * 5
            out_ids += i.tolist()
            out_keys += [raw[e - 5 * n : e] for n, e in zip(c.tolist(), ends.tolist(), strict=True)]
        out = packed_by_bucket(out_ids, [0] * len(out_ids), out_keys, n_shards)
        hot = pa.table({"hot": pa.array(shared[common].astype(np.int64)), "blocks": pa.array(blocks[common], pa.int64())})
        return pa.concat_tables([out, hot], promote_options="default")

    sent = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(send, _SENT_DDL)
    packed = stored(dealt(sent, n_shards, "shard").groupBy("shard").applyInArrow(meet, f"{PACKED_DDL}, hot long, blocks long"), "shared-keys")
    hot = packed.filter("hot is not null").orderBy(F.desc("blocks"), "hot").limit(HOT_KEYS).select("hot").collect()
    return by_document(packed.filter("bucket is not null").drop("hot", "blocks"), n_shards), np.unique(np.array([r["hot"] for r in hot], np.int64).astype(U64))


def packed_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with its text as packed_bytes, for a shuffle of whole texts: half of what the shuffle's own codec makes of
    them. Null stays null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.schema.names.index(text)
            out = [None if t is None else packed_bytes(t.tobytes()) for t in texts_of(part.column(at))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if k == at else c for k, c in enumerate(part.columns)], names=part.schema.names)

    ddl = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(pack, ddl)


def unpacked_texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    for value in column:
        value = value.as_py()
        yield None if value is None else np.frombuffer(unpacked_bytes(value), np.uint8)


def joined(docs: DataFrame, found: DataFrame, how: str, marked: bool = False) -> DataFrame:
    """docs (doc_id, text, mark, ...) with packed texts, and what was found for their id, or for their id and mark."""
    d, f = packed_texts(docs).alias("d"), found.alias("f")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.id"))
    return d.join(f, on & (F.coalesce(F.col("d.mark"), F.lit(0)) == F.col("f.mark")) if marked else on, how).select("d.*", "f.found")


def in_keys(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the low 40 bits of each hash are among keys (sorted)."""
    if not len(keys):
        return np.zeros(len(hashes), bool)
    low = hashes & LOW40
    at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
    return keys[at] == low
