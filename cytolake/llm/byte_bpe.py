"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut into pre-tokens. Each task keeps its documents as positions in a local dictionary of distinct words (a
block) and sends every distinct word once, to the shard of its hash. A shard encodes each distinct word of the corpus
once, and the ids travel back to the blocks that hold the word, where documents are put together by position.
A frequent word reaches its shard once for each block, however often it occurs.

Decoding joins ids with the table of token bytes, whose rows are in order of id and as many as the vocabulary has: a
batch of ids takes its rows of the table, and a document's bytes are what its ids took, one after the other.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._common import collected, dealt, packed, packed_bytes, part, removed, shards_for, stored, stretches, unpacked, unpacked_bytes

#: A block ends at so many distinct words or characters of text. Large blocks send fewer words in all.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 20 << 20

_BLOCK_DDL = "block long, shard int, data binary, sizes binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge neighbours by lowest rank, leftmost first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 500:
        return _encode_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _encode_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap over a linked list."""
    import heapq

    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    live: list[bytes | None] = list(parts)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if live[i] is not None else -1
        if j < 0 or live[i] != left or live[j] != right:
            continue
        live[i], live[j] = left + right, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(live[a] + live[b])) is not None:
                heapq.heappush(heap, (r, a, live[a], live[b]))
    return [ranks[p] for p in live if p is not None]


def packed_codes(codes: np.ndarray) -> bytes:
    """Codes in one to four bytes; first, second, third and fourth bytes apart, which zstd packs better."""
    if codes.max(initial=0) >= 1 << 29:  # more distinct words than a text of 2 GB, the most that Spark holds, is likely to have
        raise ValueError("a block of over 2**29 distinct words")
    second, third, fourth = codes >= 128, codes >= 16384, codes >= 1 << 21
    a = (codes & 127).astype(np.uint8) | second.astype(np.uint8) << 7
    b = (codes[second] >> 7 & 127).astype(np.uint8) | third[second].astype(np.uint8) << 7
    c = (codes[third] >> 14 & 127).astype(np.uint8) | fourth[third].astype(np.uint8) << 7
    d = (codes[fourth] >> 21).astype(np.uint8)
    return np.array([len(a), len(b), len(c)], np.int64).tobytes() + packed_bytes(b"".join((a.tobytes(), b.tobytes(), c.tobytes(), d.tobytes())), 9)


def unpacked_codes(raw: bytes) -> np.ndarray:
    a, b, c, d = np.split(np.frombuffer(unpacked_bytes(raw[24:]), np.uint8), np.cumsum(np.frombuffer(raw, np.int64, 3)))
    out, second = (a & 127).astype(np.int32), np.flatnonzero(a > 127)
    out[second] |= (b & 127).astype(np.int32) << 7
    third = second[b > 127]
    out[third] |= (c & 127).astype(np.int32) << 14
    out[third[c > 127]] |= d.astype(np.int32) << 21
    return out


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids, the tokens of the whole text; null and empty texts have none.

    No special tokens: their strings are ordinary text. Repeated rows and null ids are rows like others; other columns
    are ignored. ranks_path is read by the driver; the ranks (one row for each token of the vocabulary) go to the
    workers."""
    spark = docs.sparkSession
    known_ranks = read_ranks(ranks_path)
    kind = np.uint16 if max(known_ranks.values()) < 1 << 16 else np.uint32
    ranks = spark.sparkContext.broadcast(known_ranks)
    n_shards = shards_for(docs, text)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        block, size, codes, out, ids = TaskContext.get().partitionId() << 32, 0, _Codes(), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            # what is held is given up as soon as it has been put into another form
            sizes = np.array([len(x) for x in out], np.int64)
            every = np.concatenate(out)
            out.clear()
            order = np.argsort(-np.bincount(every, minlength=len(codes)), kind="stable")  # frequent words get short codes
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            words = list(codes)
            codes.clear()
            raw = [words[k].encode() for k in order.tolist()]
            del words
            lengths = np.array([len(w) for w in raw], np.int64)
            shard = np.array([zlib.crc32(w) % n_shards for w in raw], np.int64)  # Python's own hash differs between processes
            by = np.argsort(shard, kind="stable")
            rows = [(block, -1, packed_codes(rank[every]), packed(sizes), ids)]
            for lo, hi in stretches(shard[by]):
                own = by[lo:hi]
                rows.append((block, int(shard[own[0]]), packed_bytes(b"".join([raw[k] for k in own.tolist()]), 9), packed(np.r_[np.diff(own, prepend=0), lengths[own]]), None))
            del raw, every
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(id_arrow)), strict=True)]
            kind = pa.array(["documents", *["words"] * (len(rows) - 1)])
            del rows
            yield pa.RecordBatch.from_arrays([*columns, kind], names=["block", "shard", "data", "sizes", "ids", "kind"])
            pa.default_memory_pool().release_unused()

        id_arrow = None
        for part in batches:
            id_arrow = part.column(0).type
            for i, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                value = value.as_py() or ""
                words = find(value)
                out.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                size += len(value)
                if len(codes) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield from flush()
                    block, size, codes, out, ids = block + 1, 0, _Codes(), [], []
        if out:
            yield from flush()

    with collected() as tables:
        blocks = stored(rows.mapInArrow(split, f"{_BLOCK_DDL}, ids array<{id_type}>, kind string"), "bpe-blocks", by="kind")
    words, words_folder = part(blocks, tables[0], "kind", "words")
    documents, _ = part(blocks, tables[0], "kind", "documents")

    def encode_words(rows: pa.Table) -> pa.Table:
        table, known, out = ranks.value, {}, []
        for k in range(len(rows)):
            r = rows.slice(k, 1).to_pylist()[0]
            own, lengths = unpacked(r["sizes"]).reshape(2, -1)
            raw, ids, at = unpacked_bytes(r["data"]), [], 0
            for n in lengths.tolist():
                word = raw[at : at + n]
                at += n
                found = known.get(word)
                if found is None:
                    found = known[word] = np.array(encode_word(word, table), kind)
                ids.append(found)
            out.append((r["block"], packed_bytes(np.concatenate(ids).tobytes(), 9), packed(np.r_[own, [len(x) for x in ids]])))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "data": pa.array([x[1] for x in out], pa.binary()), "sizes": pa.array([x[2] for x in out], pa.binary())})

    # the words' part goes once they are encoded
    answers = stored(dealt(words.select("shard", "block", "data", "sizes"), n_shards, "shard").groupBy("shard").applyInArrow(encode_words, "block long, data binary, sizes binary"), "bpe-words")
    removed(spark, [words_folder])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        owns, sizes, flats = [], [], []
        for r in right.select(["data", "sizes"]).to_pylist():
            own, n = unpacked(r["sizes"]).reshape(2, -1)
            owns.append(np.cumsum(own))
            sizes.append(n)
            flats.append(np.frombuffer(unpacked_bytes(r["data"]), kind).astype(np.int32))
        own, sizes, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owns, sizes, flats))
        start, size = np.empty(len(own), np.int64), np.empty(len(own), np.int32)
        start[own], size[own] = np.cumsum(sizes) - sizes, sizes
        tables = []
        for row in range(len(left)):
            codes, lengths = unpacked_codes(left.column("data")[row].as_py()), unpacked(left.column("sizes")[row].as_py())
            n = size[codes]
            tokens = np.empty(int(n.sum()), np.int32)
            edges, at = np.zeros(len(lengths) + 1, np.int32), 0
            ends = np.cumsum(lengths)
            for k, (lo, hi) in enumerate(zip(ends - lengths, ends, strict=True)):
                edges[k + 1] = edges[k] + n[lo:hi].sum()
            for lo in range(0, len(codes), 1 << 19):
                c, m = codes[lo : lo + (1 << 19)], n[lo : lo + (1 << 19)]
                some = int(m.sum())
                tokens[at : at + some] = flat[np.repeat(start[c] - (np.cumsum(m) - m), m) + np.arange(some)]
                at += some
            tables.append(pa.table({"doc_id": left.column("ids")[row].values, "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(tokens))}))
        return pa.concat_tables(tables)

    return documents.select("block", "data", "sizes", "ids").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, f"doc_id {id_type}, ids array<int>")


def token_bytes(ranks: dict[bytes, int]) -> pa.LargeBinaryArray:
    """The token-byte table: row i holds the bytes of token i, null where the vocabulary has none."""
    rows: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        rows[rank] = token
    return pa.array(rows, pa.large_binary())


def decoded(column: pa.ListArray, table: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    """The bytes of each row's ids; null where the row is null or one of its ids has no row in the table."""
    rows = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.int64())
    fine = pa.compute.fill_null(pa.compute.and_(pa.compute.greater_equal(flat, 0), pa.compute.less(flat, len(table))), False)
    if len(table):
        joined = table.take(pa.compute.if_else(fine, flat, pa.scalar(None, pa.int64())))
    else:
        joined = pa.nulls(len(flat), pa.large_binary())
    lost = np.r_[0, np.cumsum(joined.is_null().to_numpy(zero_copy_only=False))]
    ends = np.r_[0, np.cumsum(rows)]
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (lost[ends[1:]] == lost[ends[:-1]])
    joined = joined.fill_null(b"")
    edges = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(edges[ends]).tobytes()), joined.buffers()[2] if len(joined) else pa.py_buffer(b"")])
    return pa.compute.if_else(pa.array(whole), out, pa.scalar(None, pa.large_binary()))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """tokens with a column decoded (binary): the bytes of the ids, joined with the table of token bytes.

    Null ids columns, and rows that hold an id that is null or not in the vocabulary, decode to null."""
    known = token_bytes(read_ranks(ranks_path))  # as many rows as the vocabulary has: shipped with the task

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            # bounded slices: the joined bytes of many long documents would be large at once
            for lo in range(0, part.num_rows, 256):
                some = part.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, decoded(some.column(ids), known).cast(pa.binary())], names=[*part.schema.names, "decoded"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(join, f"{ddl}, decoded binary")
