"""Suffix-array deduplication: repeated byte strings found by two-stage suffix sorting.

Anchors (see _anchors) leave only the windows that can repeat. Each anchor's windows travel as one piece of text to
the shard of their anchor, where every occurrence of a window meets. A shard collapses equal pieces, then builds the
suffix array of the distinct ones that share an anchor with others: only suffixes smaller than their successors are
sorted directly, the rest follows by scans over the buckets of first bytes. Neighbours with a common prefix of at
least ``window`` bytes are repeats; all but the earliest are removed. Tasks collapse equal pieces before the shuffle,
so a piece reaches its shard once for each block of documents. Pieces of an anchor that very many blocks hold (see
_anchors) are cut into runs of HOT_RUN windows by their place beside the anchor, and dealt by the bytes that all
windows of such a run share: a common phrase with many different contexts spreads over all shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm._anchors import PACKED_DDL, Bytes, by_document, doc_keys, ids_of, in_keys, joined, packed_by_bucket, shared_keys, unpacked_texts
from cytolake.llm._common import U64, batch, collected, dealt, from40, mix, packed_bytes, removed, shard_of, shards_for, stored, stretches, unpacked_bytes

#: ``n`` windows from byte ``start`` on.
RUN = np.dtype([("start", "<u4"), ("n", "<u4")])
_PIECE = np.dtype([("doc", "<u4"), ("start", "<u4"), ("n", "<u4"), ("size", "<u4"), ("anchor", "<u4"), ("hot", "u1")])
#: Text that one shard serves: its pieces are Python's objects, and take several times as much.
SHARD_BYTES = 8 << 20
#: Windows of one run at a hot anchor.
HOT_RUN = 16
BLOCK_BYTES = 24 << 20
#: Text that is suffix-sorted at a time (an anchor's pieces stay together).
BATCH_BYTES = 4 << 20
#: Suffixes whose bytes are laid out side by side for one direct sort.
SORT_ROWS = 100_000

_SENT = pa.schema([("shard", pa.int32()), ("id", pa.binary()), ("mark", pa.binary()), ("runs", pa.binary()), ("text", pa.binary())])
_SENT_DDL = "shard int, id binary, mark binary, runs binary, text binary"


# ---------------------------------------------------------------- two-stage suffix sorting

def ascending(text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each place: is its suffix smaller than its successor? last marks the ends of pieces; what follows an end
    is smaller than any byte."""
    after = np.empty_like(text)
    after[:-1], after[-1:] = text[1:], 0
    after[last] = 0
    up = after > text
    same = np.flatnonzero(after == text)  # decided by the first place after the run of equal bytes
    for_run = np.flatnonzero(np.diff(same, append=-1) != 1)
    up[same] = np.repeat(up[same[for_run] + 1], np.diff(for_run, prepend=-1))
    return up


def _directly(text: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """places by their suffixes, which stop at ends; text has no zero byte."""
    out = []
    if not len(places):
        return places
    first = text[places].astype(np.int64) << 8 | np.where(places + 1 < ends, text[np.minimum(places + 1, len(text) - 1)], 0)
    order = np.argsort(first, kind="stable")
    places, ends, first = places[order], ends[order], first[order]
    lo = 0
    edges = [hi for _, hi in stretches(first)]
    for k, hi in enumerate(edges):
        if k + 1 < len(edges) and edges[k + 1] - lo <= SORT_ROWS:
            continue
        p, e = places[lo:hi], ends[lo:hi]
        width = int((e - p).max())
        at = p[:, None] + np.arange(width, dtype=np.int64)
        rows = text[np.minimum(at, len(text) - 1)]
        rows[at >= e[:, None]] = 0
        out.append(p[np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")])
        lo = hi
    return np.concatenate(out)


def suffix_array(text: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places marked in wanted in order of their suffixes. text holds pieces, piece k from bounds[k] to
    bounds[k + 1]; suffixes stop at the end of their piece. Bytes are 0 to 254 (UTF-8 has no 255).

    Suffixes smaller than their successors are sorted directly. A wanted suffix that is larger than its successor
    needs it in the array: those are added, up to the next one that is sorted directly, and left out at the end."""
    if not len(text):
        return np.zeros(0, np.int64)
    text = text + np.uint8(1)
    last = bounds[1:] - 1
    up = ascending(text, last)
    end = np.zeros(len(text), bool)
    end[last] = True
    # the chain from a wanted place to the next one sorted directly, or to the end of the piece
    have = wanted.copy()
    fresh = np.flatnonzero(wanted & ~up & ~end) + 1
    while len(fresh):
        fresh = fresh[~have[fresh]]
        have[fresh] = True
        fresh = fresh[~up[fresh] & ~end[fresh]] + 1
    piece_end = np.repeat(bounds[1:], np.diff(bounds))
    direct = np.flatnonzero(have & up)
    direct = _directly(text, piece_end[direct], direct)
    induced = have & ~up
    starts = np.zeros(len(text) + 1, bool)
    starts[bounds[:-1]] = True
    heads = np.searchsorted(text[direct], np.arange(258))
    buckets: list[list[np.ndarray]] = [[] for _ in range(257)]

    def deal(places: np.ndarray, above: int) -> None:
        before = places[~starts[places]] - 1
        before = before[induced[before]]
        c = text[before]
        before, c = before[c > above], c[c > above]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        for lo, hi in stretches(c):
            buckets[c[lo]].append(before[lo:hi])

    final = last[induced[last]]  # suffixes of one byte: their successor is the end
    order = np.argsort(text[final], kind="stable")
    for lo, hi in stretches(text[final[order]]):
        buckets[text[final[order][lo]]].append(final[order][lo:hi])
    out = []
    for c in range(1, 257):
        part = list(buckets[c])
        now = np.concatenate(part) if part else np.zeros(0, np.int64)
        while len(now):  # runs of the same byte
            now = now[~starts[now]] - 1
            now = now[induced[now]]
            now = now[text[now] == c]
            part.append(now)
        whole = np.concatenate([*part, direct[heads[c] : heads[c + 1]]]) if part else direct[heads[c] : heads[c + 1]]
        if len(whole):
            out.append(whole)
            deal(whole, c)
    array = np.concatenate(out) if out else np.zeros(0, np.int64)
    return array[wanted[array]]


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it, up to most bytes; the first has 0."""
    out = np.zeros(len(array), np.int32)
    span = np.arange(most)
    for lo in range(1, len(array), 100_000):
        now, before = array[lo : lo + 100_000], array[lo - 1 : lo - 1 + min(100_000, len(array) - lo)]
        same = text[now[:, None] + span] == text[before[:, None] + span]
        out[lo : lo + len(now)] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


def repeats(pieces: list[bytes], n_windows: np.ndarray, window: int) -> np.ndarray:
    """pieces come by document and start. Which windows (in order of pieces and starts) occurred in an earlier one?"""
    bounds = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    wanted = np.zeros(len(text), bool)
    where = np.repeat(bounds[:-1] - np.r_[0, np.cumsum(n_windows)[:-1]], n_windows) + np.arange(n_windows.sum())
    wanted[where] = True
    array = suffix_array(text, bounds, wanted)
    groups = np.flatnonzero(common_prefixes(text, array, window) < window)
    first = np.minimum.reduceat(array, groups) if len(groups) else array
    late = np.zeros(len(text), bool)
    late[array] = True
    late[first] = False
    return late[where]


# ---------------------------------------------------------------- the distributed part

def _merged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), RUN)
    out["start"], out["n"] = starts, n
    return out


def duplicate_runs(docs: DataFrame, window: int = 100, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, found): for each document its windows that also start earlier, as packed RUNs; mark (xxhash64 of the
    text) tells apart texts under the same id."""
    unit = Bytes(window, min(32, window))
    n_shards = shards_for(docs, text, SHARD_BYTES)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    shared, hot = shared_keys(docs, doc_keys(unit, within=True), n_shards)
    suspects = joined(docs, shared, "inner")
    per = min(HOT_RUN, window)
    inside = window - per + 1  # bytes that all windows of a run share

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, tuple] = {}
        settled: dict[tuple, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [((i + m) % n_shards, np.int64(i).tobytes(), np.int64(m).tobytes(), _merged(*np.array(r, np.int64).T).tobytes(), None) for (i, m), r in settled.items()]
            pieces = sorted(own.items(), key=lambda x: x[1][4])
            shard = np.array([x[1][4] for x in pieces], np.int64)
            for lo, hi in stretches(shard):
                part = pieces[lo:hi]
                docs = {d: k for k, d in enumerate(dict.fromkeys(v[:2] for _, v in part))}
                head = np.array([(docs[v[:2]], v[2], v[3], len(t), *v[5:]) for t, v in part], _PIECE)
                ids = np.array(list(docs), np.int64)
                rows.append((int(shard[lo]), ids[:, 0].tobytes(), ids[:, 1].tobytes(), head.tobytes(), packed_bytes(b"".join(t for t, _ in part))))
            if rows:
                yield batch(_SENT, **dict(zip(_SENT.names, zip(*rows, strict=True), strict=True)))

        for part in batches:
            for i, mark, data, found in zip(ids_of(part.column("doc_id")).tolist(), part.column("mark").to_pylist(), unpacked_texts(part.column("text")), part.column("found"), strict=True):
                if data is None:
                    continue
                places, grams = unit.anchors(data)
                if not len(places):
                    continue
                hit = np.flatnonzero(in_keys(grams[places], np.unique(from40(found.as_py()))))
                if not len(hit):
                    continue
                fine = in_keys(grams[places[hit]], hot)
                run = np.where(fine, (places[hit] - hit) // per, -1)
                new = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (np.diff(places[hit]) != 0) | (np.diff(run) != 0)])
                starts, n, fine, run = hit[new], np.diff(new, append=len(hit)), fine[new], run[new]
                anchor = places[starts]
                code = mix(grams[anchor])
                raw = data.tobytes()
                if fine.any():
                    shared = [zlib.crc32(raw[lo : lo + inside]) for lo in (anchor[fine] - per * run[fine]).tolist()]
                    code[fine] = mix(code[fine] ^ np.array(shared, U64) + (run[fine].astype(U64) << U64(32)))
                shard = shard_of(code, n_shards)
                for s, k, a, to, h in zip(starts.tolist(), n.tolist(), (anchor - starts).tolist(), shard.tolist(), fine.tolist(), strict=True):
                    t, v = raw[s : s + k + window - 1], (i, mark, s, k, to, a, h)
                    w = own.setdefault(t, v)
                    if w is v:
                        held += len(t) + 200
                    elif w[:3] != v[:3]:
                        own[t], late = (w, v) if w < v else (v, w)
                        settled.setdefault(late[:2], []).append(late[2:4])
                        held += 100
                if held >= BLOCK_BYTES:
                    yield from flush()
                    own, settled, held = {}, {}, 0
        yield from flush()

    def sort(rows: pa.Table) -> pa.Table:
        out, own, settled = [], {}, {}
        for k in range(len(rows)):
            r = rows.slice(k, 1).to_pylist()[0]
            ids, marks = np.frombuffer(r["id"], np.int64), np.frombuffer(r["mark"], np.int64)
            if r["text"] is None:
                out.append((int(ids[0]), int(marks[0]), r["runs"]))
                continue
            at, text, ids, marks = 0, unpacked_bytes(r["text"]), ids.tolist(), marks.tolist()
            for d, s, n, size, a, h in np.frombuffer(r["runs"], _PIECE).tolist():
                t, v = text[at : at + size], (ids[d], marks[d], s, n, a, h)
                at += size
                w = own.setdefault(t, v)
                if w is not v and w[:3] != v[:3]:
                    own[t], late = (w, v) if w < v else (v, w)
                    settled.setdefault(late[:2], []).append(late[2:4])
        by_anchor: dict[tuple, list] = {}
        for t, v in own.items():
            run, lo = divmod(v[4], per) if v[5] else (-1, v[4])
            by_anchor.setdefault((run, t[lo : lo + (inside if v[5] else unit.gram)]), []).append((v, t))
        del own
        # equal windows have equal anchors: whole anchors make up batches of bounded size
        many, batches, held = [g for g in by_anchor.values() if len(g) > 1], [[]], 0
        del by_anchor
        for group in many:
            if held > BATCH_BYTES:
                batches.append([])
                held = 0
            batches[-1] += group
            held += sum(len(t) for _, t in group)
        del many
        while batches and batches[-1]:
            pieces = sorted(batches.pop(), key=lambda p: p[0][:3])
            n = np.array([v[3] for v, _ in pieces], np.int64)
            late = repeats([t for _, t in pieces], n, window)
            edge = np.zeros(len(late), bool)
            edge[np.r_[0, np.cumsum(n)[:-1]]] = True
            of, start = np.repeat(np.arange(len(n)), n), np.repeat([v[2] for v, _ in pieces], n) + np.arange(len(late)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
            where = np.flatnonzero(late)
            for lo, hi in stretches(np.cumsum(edge[where] | np.r_[True, np.diff(where) != 1])) if len(where) else []:
                settled.setdefault(pieces[of[where[lo]]][0][:2], []).append((int(start[where[lo]]), hi - lo))
        out += [(i, m, _merged(*np.array(r, np.int64).T).tobytes()) for (i, m), r in settled.items()]
        return packed_by_bucket([x[0] for x in out], [x[1] for x in out], [x[2] for x in out], n_shards)

    sent = dealt(suspects.mapInArrow(send, _SENT_DDL), n_shards, "shard")
    return by_document(sent.groupBy("shard").applyInArrow(sort, PACKED_DDL), n_shards)


def spans_of(runs: np.ndarray, size: int, window: int) -> np.ndarray:
    """The maximal stretches (from, to) of bytes that lie in a duplicate window."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, runs["start"], 1)
    np.add.at(step, runs["start"].astype(np.int64) + runs["n"] + (window - 1), -1)
    inside = np.diff((np.cumsum(step[:size]) > 0).astype(np.int8), prepend=0, append=0)
    return np.c_[np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)]


def whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans narrowed so that they cut no UTF-8 character."""
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def dedup(docs: DataFrame, window: int = 100, id_column: str = "doc_id", text: str = "text", characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), spans (array of
    from, to in bytes), then the columns named in keep.

    A byte goes if it lies in a string of ``window`` bytes that also starts earlier: in a document with a smaller id,
    or earlier in the same document; strings are judged on the input. With characters, spans are narrowed to whole
    characters. Null and empty texts have no bytes. A null id comes after all others; different texts under one id
    count as two documents, in order of a hash; repeated rows count as one document and get the same result."""
    with collected() as tables:
        runs = duplicate_runs(docs, window, id_column, text)
    found = stored(runs, "suffix-runs")
    removed(docs.sparkSession, tables)
    columns = [F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"), *[F.col(c).alias(f"keep_{c}") for c in keep]]
    rows = joined(docs.select(*columns), found, "left", marked=True)
    kept_types = [(f"keep_{c}", rows.schema[f"keep_{c}"].dataType.simpleString()) for c in keep]
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n, gone, many, kept, where = [], [], [], [], []
            for data, found in zip(unpacked_texts(part.column("text")), part.column("found"), strict=True):
                data = data if data is not None else np.zeros(0, np.uint8)
                runs = np.frombuffer(found.as_py() or b"", RUN)
                spans = spans_of(runs, len(data), window) if len(runs) else np.zeros((0, 2), np.int64)
                if characters and len(spans):
                    spans = whole_characters(data, spans)
                raw, at, out = data.tobytes(), 0, []
                for a, b in spans.tolist():
                    out.append(raw[at:a])
                    at = b
                out.append(raw[at:])
                n.append(len(raw))
                gone.append(int((spans[:, 1] - spans[:, 0]).sum()))
                many.append(len(spans))
                kept.append(b"".join(out))
                where.append(spans)
            flat = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
            offsets = pa.array(np.r_[0, np.cumsum([len(w) for w in where])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(offsets, inner), *[part.column(c) for c, _ in kept_types]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", *[c for c, _ in kept_types]])

    ddl = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>" + "".join(f", `{c}` {t}" for c, t in kept_types)
    out = rows.select("doc_id", "text", "found", *[f"`{c}`" for c, _ in kept_types]).mapInArrow(cut, ddl)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", *[F.col(f"`keep_{c}`").alias(c) for c in keep])
