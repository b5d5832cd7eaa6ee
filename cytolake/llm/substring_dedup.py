"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is parsed relative to itself: the reference of a document is all text of documents with smaller ids, cut
into blocks that are indexed by the content of their windows, so that a block holds every occurrence of its windows
and a document meets exactly those blocks that can match.

A document is factored greedily against a block: the index gives the first occurrence of a window of ``window`` words
in a document with a smaller id, and the factor follows that occurrence word by word as long as both agree. After its
end, the window that straddles the factor's boundary is looked up next: it may continue in another reference. Factors of
different blocks that continue each other are joined and parsed once more over the whole document, and the words of
its factors, all of ``window`` words at least, are its duplicate spans. Every window that also starts in a document with
a smaller id lies in a factor, since the parse passes over a window only when it is inside a factor or not in the index.

A block's windows are 64-bit hashes under 64-bit anchors; both must agree. Tasks factor their own documents against
each other first and send only windows outside of these factors. Windows around an anchor that very many blocks hold are
dealt by their own hash (see _anchors), so a common phrase with many different contexts spreads over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._anchors import PACKED_DDL, Words, by_document, doc_keys, ids_of, in_keys, joined, packed_by_bucket, shared_keys, unpacked_texts
from cytolake.llm._common import U64, _BASE, _inverse, batch, collected, dealt, from40, mix, ngram_hashes, powers, removed, shard_of, shards_for, stored, stretches, word_hashes

_OTHER = U64(0xA0761D6478BD642F)
#: Part of a factor: ``n`` windows from word ``pos`` on, that also start in document ``doc`` from word ``at`` on.
RUN = np.dtype([("pos", "<u4"), ("n", "<u4"), ("doc", "<i8"), ("at", "<u4")])
BLOCK_WINDOWS = 1_000_000

_SENT = pa.schema([("shard", pa.int32()), ("id", pa.binary()), ("mark", pa.binary()), ("runs", pa.binary()), ("anchors", pa.binary()), ("windows", pa.binary())])
_SENT_DDL = "shard int, id binary, mark binary, runs binary, anchors binary, windows binary"
#: What one task sends of a document: windows pos .. pos + n - 1 share one anchor.
_PIECE = np.dtype([("doc", "<u4"), ("pos", "<u4"), ("n", "<u4")])


def factors(runs: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (start, words, reference document, reference start) of each factor, left to right.

    From each first window not yet covered, the longest continuation in one reference; then on after its end."""
    out, at, i = [], 0, 0
    runs = np.sort(merged(runs), order=["pos", "n"])
    while i < len(runs):
        best = None
        while i < len(runs) and runs[i]["pos"] <= at:
            end = int(runs[i]["pos"]) + int(runs[i]["n"])
            if end > at and (best is None or end > best[0]):
                best = (end, i)
            i += 1
        if best is None:
            if i < len(runs):
                at = int(runs[i]["pos"])
            continue
        r = runs[best[1]]
        out.append((at, best[0] - at + window - 1, int(r["doc"]), int(r["at"]) + at - int(r["pos"])))
        at = best[0]
    return out


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs that continue each other in the same reference, joined."""
    if len(runs) < 2:
        return runs
    diagonal = runs["at"].astype(np.int64) - runs["pos"]
    runs = runs[np.lexsort((runs["pos"], diagonal, runs["doc"]))]
    diagonal = runs["at"].astype(np.int64) - runs["pos"]
    new = np.r_[True, (runs["doc"][1:] != runs["doc"][:-1]) | (diagonal[1:] != diagonal[:-1]) | (runs["pos"][1:] > runs["pos"][:-1] + runs["n"][:-1])]
    heads = np.flatnonzero(new)
    out = runs[heads].copy()
    out["n"] = np.maximum.reduceat(runs["pos"].astype(np.int64) + runs["n"], heads) - out["pos"]
    return out


def covered(parse: list[tuple[int, int, int, int]], n_words: int) -> np.ndarray:
    """Which words lie in a factor."""
    step = np.zeros(n_words + 1, np.int32)
    for start, words, _, _ in parse:
        step[start] += 1
        step[start + words] -= 1
    return np.cumsum(step[:n_words]) > 0


def _firsts(key: np.ndarray, anchor: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each window, the index of its first occurrence by (id, pos)."""
    order = np.lexsort((pos, ids, key))
    k, a = key[order], anchor[order]
    heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
    first = np.empty(len(key), np.int64)
    first[order] = np.repeat(order[heads], np.diff(heads, append=len(k)))
    return first


def parsed(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy factors of documents against the block that they make up: the window at which each begins, how many
    windows it has, and the window of the block that it begins with in its reference.

    Windows come by (doc, pos); ids are of the documents; first is the index: of each window its first occurrence.
    All documents are parsed side by side, a factor at a time."""
    n = len(key)
    none = np.zeros(0, np.int64)
    heads = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)]) if n else none
    ends = np.repeat(np.append(heads[1:], n), np.diff(heads, append=n)) if n else none  # of the text around each window
    hit = np.flatnonzero(ids[doc] > ids[doc[first]])
    after = np.append(hit, n)  # the next window with an earlier occurrence: after[searchsorted(hit, place)]
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(key) * powers(_BASE, n), out=total[1:])
    back = powers(_inverse(_BASE), n + 1)

    def alike(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (total[a + length] - total[a]) * back[a] == (total[b + length] - total[b]) * back[b]

    out = [(none, none, none)]
    at = after[np.searchsorted(hit, heads)]
    last = ends[heads] if n else none
    at, last = at[at < last], last[at < last]
    while len(at):
        ref = first[at]
        low, high = np.ones(len(at), np.int64), np.minimum(last - at, ends[ref] - ref)
        while (low < high).any():  # how far the reference agrees
            middle = (low + high + 1) // 2
            good = alike(at, ref, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        out.append((at, low, ref))
        at = after[np.searchsorted(hit, at + low)]  # from the first window across the factor's end
        at, last = at[at < last], last[at < last]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _as_runs(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, factors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Of each document with factors, its place and packed RUNs."""
    start, n, ref = factors
    order = np.argsort(start, kind="stable")
    start, n, ref = start[order], n[order], ref[order]
    runs = np.zeros(len(start), RUN)
    runs["pos"], runs["n"], runs["doc"], runs["at"] = pos[start], n, ids[doc[ref]], pos[ref]
    for lo, hi in stretches(doc[start]):
        yield int(doc[start[lo]]), runs[lo:hi].tobytes()


def duplicate_runs(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, found): for each document its windows that also start in a document with a smaller id, as packed
    RUNs; mark (xxhash64 of the text) tells apart texts under the same id."""
    unit = Words(window)
    n_shards = shards_for(docs, text)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    shared, hot = shared_keys(docs, doc_keys(unit), n_shards)
    suspects = joined(docs, shared, "inner")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for part in batches:
            for i, mark, data, found in zip(ids_of(part.column("doc_id")), part.column("mark").to_numpy(), unpacked_texts(part.column("text")), part.column("found"), strict=True):
                if data is None:
                    continue
                words = word_hashes(data)[2]
                places, grams = unit.of_units(words)
                keys = np.unique(from40(found.as_py()))
                hit = np.flatnonzero(in_keys(grams[places], keys)) if len(places) else places
                if len(hit):
                    block.append((i, mark, hit, places[hit], grams[places[hit]], ngram_hashes(words, window, _OTHER)[hit]))
                    held += len(hit)
                if held >= BLOCK_WINDOWS:
                    yield from flush(block)
                    block, held = [], 0
        if block:
            yield from flush(block)

    def flush(block: list) -> Iterator[pa.RecordBatch]:
        ids, marks = np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.int64)
        order = np.argsort(ids, kind="stable")
        block, ids, marks = [block[o] for o in order], ids[order], marks[order]
        doc = np.repeat(np.arange(len(block)), [len(b[2]) for b in block])
        pos, place, anchor, key = (np.concatenate([b[k] for b in block]) for k in (2, 3, 4, 5))
        # documents of one id never refer to each other: the index looks for their first window by id
        factors = parsed(ids, doc, pos, key, _firsts(key, anchor, ids[doc], np.arange(len(doc))))
        rows = [(k % n_shards, ids[k].tobytes(), marks[k].tobytes(), runs, None, None) for k, runs in _as_runs(ids, doc, pos, factors)]
        step = np.zeros(len(doc) + 1, np.int32)
        np.add.at(step, factors[0], 1)
        np.add.at(step, factors[0] + factors[1], -1)
        going = np.flatnonzero(np.cumsum(step[:-1]) == 0)
        d, p, a, k, l = doc[going], pos[going], anchor[going], key[going], place[going]
        fine = in_keys(a, hot)
        shard = np.where(fine, shard_of(mix(k ^ _OTHER), n_shards), shard_of(mix(a), n_shards))
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1) | (l[1:] != l[:-1]) | fine[1:]]) if len(d) else going
        size = np.diff(new, append=len(d))
        by = np.argsort(shard[new], kind="stable")
        new, size = new[by], size[by]
        flat = np.repeat(new - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ends = np.cumsum(size)
        for lo, hi in stretches(shard[new]):
            own, at = np.unique(d[new[lo:hi]], return_inverse=True)
            piece = np.zeros(hi - lo, _PIECE)
            piece["doc"], piece["pos"], piece["n"] = at, p[new[lo:hi]], size[lo:hi]
            w = k[flat[ends[lo] - size[lo] : ends[hi - 1]]]
            rows.append((int(shard[new[lo]]), ids[own].tobytes(), marks[own].tobytes(), piece.tobytes(), a[new[lo:hi]].tobytes(), w.tobytes()))
        if rows:
            yield batch(_SENT, **dict(zip(_SENT.names, zip(*rows, strict=True), strict=True)))

    def look_up(rows: pa.Table) -> pa.Table:
        out, ids, marks, doc, pos, anchor, key = [], [], [], [], [], [], []
        n = 0
        for r in rows.to_pylist():
            i, m = np.frombuffer(r["id"], np.int64), np.frombuffer(r["mark"], np.int64)
            if r["windows"] is None:
                out.append((int(i[0]), int(m[0]), r["runs"]))
                continue
            piece = np.frombuffer(r["runs"], _PIECE)
            size = piece["n"].astype(np.int64)
            doc.append(np.repeat(piece["doc"].astype(np.int64) + n, size))
            pos.append(np.repeat(piece["pos"].astype(np.int64) - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()))
            anchor.append(np.repeat(np.frombuffer(r["anchors"], U64), size))
            key.append(np.frombuffer(r["windows"], U64))
            ids.append(i)
            marks.append(m)
            n += len(i)
        if doc:
            ids, marks, doc, pos, anchor, key = map(np.concatenate, (ids, marks, doc, pos, anchor, key))
            order = np.lexsort((pos, doc, ids[doc]))
            doc, pos, anchor, key = doc[order], pos[order], anchor[order], key[order]
            factors = parsed(ids, doc, pos, key, _firsts(key, anchor, ids[doc], np.arange(len(doc))))
            out += [(int(ids[k]), int(marks[k]), runs) for k, runs in _as_runs(ids, doc, pos, factors)]
        return packed_by_bucket([x[0] for x in out], [x[1] for x in out], [x[2] for x in out], n_shards)

    sent = dealt(suspects.mapInArrow(send, _SENT_DDL), n_shards, "shard")
    return by_document(sent.groupBy("shard").applyInArrow(look_up, PACKED_DDL), n_shards)


def dedup(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the kept words, joined by one space) and factors, the
    greedy parse as an array of (start, words, ref_doc, ref_start) in words. The words of factors go.

    A word goes if it lies in a window of ``window`` consecutive words that also starts in a document with a smaller
    id; windows are judged on the input. Null and empty texts have no words and keep an empty text. Rows with the same
    id never remove each other's words. A null id counts as larger than all others. Other columns are ignored."""
    with collected() as tables:
        runs = duplicate_runs(docs, window, id_column, text)
    found = stored(runs, "rlz-runs")
    removed(docs.sparkSession, tables)
    rows = joined(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark")), found, "left", marked=True)
    struct = pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())])
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, gone, kept, parse = [], [], [], []
            for data, found in zip(unpacked_texts(part.column("text")), part.column("found"), strict=True):
                raw = data.tobytes() if data is not None else b""
                words = raw.split()  # bytes.split() splits at exactly the six bytes
                n.append(len(words))
                runs = np.frombuffer(found.as_py() or b"", RUN)
                parse.append(factors(runs, window))
                off = covered(parse[-1], len(words))
                gone.append(int(off.sum()))
                kept.append(b" ".join([w for w, o in zip(words, off.tolist(), strict=True) if not o]))
            fields = list(zip(*[f for p in parse for f in p], strict=True)) or [[], [], [], []]
            inner = pa.StructArray.from_arrays([pa.array(f, t.type) for f, t in zip(fields, struct, strict=True)], fields=list(struct))
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in parse])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(offsets, inner)], names=["doc_id", "n_words", "n_removed", "kept", "factors"])

    return rows.select("doc_id", "text", "found").mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>")
