"""N-gram Jaccard join with prefix trees.

1. Equal sets are one: a set's 128-bit fingerprint is its node, and its documents are members of the node.
2. Prefix filter: sets in order of hash, the first l elements that two linked sets share are among the first
   n - ceil(t n) + l of each, for any l. With l an eighth of the set, only such prefixes travel, as hashes, and a set
   of which too few elements turn up in other prefixes is done, which most are.
3. The remaining sets get a global order of elements, rare before frequent (by powers of two of the number of sets
   that hold them, then by hash). Elements that no other set holds cannot match; a set with too many of them is done.
4. Sets that share an element of their new prefix form its group. Each is compared with two pivots of the group: the
   one that shares most of itself, and one by hash. A comparison of a pivot with many sets walks a trie of the sets:
   sorted lists, whose common prefixes share their partial overlap; a subtree is left as soon as its overlap and
   remaining lengths cannot reach the threshold. Components of the links follow by smallest label.
5. Groups whose sets are in different components by now are joined with themselves. First parity sketches of two to
   four bits an element, 2048 at least (the bits in which two sketches differ are at most the elements in which the
   sets do), tell which members may link with one of another component; only these go on. Then their tries are joined: every member outside of the largest
   component is walked against those of other components, and links that join two components are kept, at most one
   less than the members. Of a large group, the members outside of its largest component are dealt over blocks that
   meet all blocks; the largest component's blocks do not meet each other. So no link between components is missed,
   and neither pairs nor links of a group are written out in full.
6. Components of both kinds of links, by smallest label with pointer jumping.

The operator finds components, not all links. Which pairs inside a component link, and how many links a document has,
stays unknown: Jaccard links are not transitive, so they do not follow from the links found. A group of g near copies
has g * g links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cytolake.llm._anchors import NO_ID, packed_texts, shared_keys, unpacked_texts
from cytolake.llm._common import U64, batch, collected, dealt, from40, low40, lowered, mix, ngram_hashes, removed, shard_of, shards_for, stored, stretches, texts_of, word_hashes

BLOCK_KEYS = 1_000_000
#: The prefix filter asks for shared elements in number of this part of a set.
PART = 8
#: Members of a group that meet in one task; larger groups meet block by block.
GROUP_ROWS = 8192
#: Members that one slot of a component's groups holds, about.
SLOT_ROWS = 2048
LEAST_BITS = 11  # of a sketch, as a power of two
#: Codes of sets that one task compares, about, if each set went to one.
BUCKET_BYTES = 4 << 20
#: Sets compared with one pivot in one group.
PIVOT_ROWS = 2048
_KEYS = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("node", pa.binary()), ("n", pa.int32()), ("data", pa.binary()), ("counts", pa.binary())])
_KEYS_DDL = "block long, shard int, node binary, n int, data binary, counts binary"


def shingles(data: np.ndarray | None, k: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct k-word shingles; with fewer words, of the whole sequence."""
    if data is None or not len(data):
        return np.zeros(0, U64)
    words = word_hashes(lowered(data))[2]
    if not len(words):
        return np.zeros(0, U64)
    n = min(k, len(words))
    return np.unique(mix(ngram_hashes(words, n) ^ U64(n)))


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return np.array([hashes.sum(dtype=U64), mix(hashes * U64(0x9FB21C651E98DF25)).sum(dtype=U64)], U64).tobytes()


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return (percent * n + 99) // 100


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of elements that fall on each bit; at least twice as many bits as elements."""
    level = max(LEAST_BITS, (2 * len(hashes) - 1).bit_length())
    bits = np.bincount((mix(hashes ^ U64(0x5851F42D4C957F2D)) >> U64(64 - level)).astype(np.int64), minlength=1 << level) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def folded(raw: np.ndarray) -> np.ndarray:
    """A sketch (bytes) of half as many bits: neighbours become one, by parity."""
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(raw).reshape(-1, 2), axis=1))


class Sketches:
    """Sketches of rows, each in its own number of bits and in half as many."""

    def __init__(self, raw: list[bytes]):
        self.level = np.array([(8 * len(r)).bit_length() - 1 for r in raw], np.int64)
        self.place = np.zeros((2, len(raw)), np.int64)
        held: dict[int, list[np.ndarray]] = {}
        for k, (r, level) in enumerate(zip(raw, self.level.tolist(), strict=True)):
            own = np.frombuffer(r, np.uint8)
            for j, (at, x) in enumerate(((level, own), (level - 1, folded(own)))):
                self.place[j, k] = len(held.setdefault(at, []))
                held[at].append(x)
        self.held = {at: np.stack(x).view(np.uint64) for at, x in held.items()}

    def _at(self, rows: np.ndarray, level: int) -> np.ndarray:
        return self.held[level][np.where(self.level[rows] == level, self.place[0, rows], self.place[1, rows])]

    def apart(self, i: int, other: np.ndarray) -> np.ndarray:
        """In how many bits row i differs from each of other, of a level at most one off."""
        out, own = np.empty(len(other), np.int64), int(self.level[i])
        for pick, level in ((self.level[other] >= own, own), (self.level[other] < own, own - 1)):
            if pick.any():
                out[pick] = np.bitwise_count(self._at(other[pick], level) ^ self._at(np.array([i]), level)).sum(axis=1, dtype=np.int64)
        return out


def may_link(sketches: Sketches, n: np.ndarray, i: int, other: np.ndarray, percent: int) -> np.ndarray:
    """Those of the rows other whose sizes and sketches do not exclude a link with row i."""
    other = other[(100 * n[other] >= percent * n[i]) & (100 * n[i] >= percent * n[other])]
    near = other[np.abs(sketches.level[other] - sketches.level[i]) <= 1]
    apart = (100 + percent) * sketches.apart(i, near)
    # sizes over a factor of two apart, where a lower threshold allows them, are not told by sketches
    return np.union1d(near[apart <= (100 - percent) * (n[near] + n[i])], other[np.abs(sketches.level[other] - sketches.level[i]) > 1])


def with_partners(sketches: Sketches, rows: np.ndarray, n: np.ndarray, labels: np.ndarray, percent: int) -> np.ndarray:
    """Which of the rows may link with one of them of another label?"""
    own = np.unique(labels[rows], return_inverse=True)[1]
    out = np.zeros(len(rows), bool)
    # the largest component only answers: every pair has a side in another
    for k in np.flatnonzero(own != np.bincount(own).argmax()):
        other = rows[own != own[k]]
        found = may_link(sketches, n, int(rows[k]), other, percent)
        out[np.isin(rows, found)] = True
        out[k] |= len(found) > 0
    return out


# ---------------------------------------------------------------- the trie

def trie_links(pivot: np.ndarray, pivot_size: int, lists: list[np.ndarray], sizes: list[int], percent: int) -> list[int]:
    """Which of the sets link with the pivot? Sets are ascending lists of element codes; sizes count all elements,
    also those that no other set holds.

    In lexicographic order, neighbours share the path of their common prefix: the overlap up to there is taken over.
    A subtree whose overlap so far plus the most that can follow stays below the least need of its sets is skipped."""
    order = sorted(range(len(lists)), key=lambda i: lists[i].tobytes() if len(lists[i]) == 0 else lists[i].astype(">u8").tobytes())
    found: list[int] = []
    before = np.zeros(0, U64)
    overlaps = np.zeros(1, np.int64)  # overlaps[d]: of the first d elements of the path
    dead = -1  # sets that share more than this many elements with the last one are in a skipped subtree
    for i in order:
        now, size = lists[i], sizes[i]
        m = min(len(now), len(before))
        differ = np.flatnonzero(now[:m] != before[:m])
        common = int(differ[0]) if len(differ) else m
        least = -(-percent * (size + pivot_size) // (100 + percent))
        if dead >= 0 and common > dead:
            # the shared path is already hopeless for the smallest need: 100 |x & y| >= percent |x or y|
            best = int(overlaps[dead + 1]) + min(len(now) - dead - 1, int(len(pivot) - np.searchsorted(pivot, now[dead], "right")))
            if best < least:
                continue
        dead = -1
        common = min(common, len(overlaps) - 1)
        tail = now[common:]
        at = np.minimum(np.searchsorted(pivot, tail), len(pivot) - 1)
        hit = pivot[at] == tail if len(pivot) else np.zeros(len(tail), bool)
        overlaps = np.r_[overlaps[: common + 1], overlaps[common] + np.cumsum(hit)]
        before = now
        # the most that can still follow after each element of the path
        left = np.minimum(np.arange(len(tail) - 1, -1, -1), len(pivot) - np.searchsorted(pivot, tail, "right"))
        hopeless = np.flatnonzero(overlaps[common + 1 :] + left < least)
        if len(hopeless):
            dead = common + int(hopeless[0])
            overlaps, before = overlaps[: dead + 2], now[: dead + 1]
        elif 100 * overlaps[-1] >= percent * (size + pivot_size - overlaps[-1]):
            found.append(i)
    return found


def trie_forest(groups: list[np.ndarray], lists: list[np.ndarray], sizes: np.ndarray, sketches: Sketches, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components: groups are rows that share an element, labels their components so far. All pairs of
    rows in a group that may link and are in different components are compared, once, unless links found before have
    joined them."""
    labels = np.unique(labels, return_inverse=True)[1]
    done: set[tuple[int, int]] = set()
    found = []
    for rows in groups:
        own, size = np.unique(labels[rows], return_counts=True)
        largest = own[size.argmax()]
        for i in rows[labels[rows] != largest].tolist():
            other = may_link(sketches, sizes, i, rows[labels[rows] != labels[i]], percent).tolist()
            other = [j for j in other if (min(i, j), max(i, j)) not in done]
            done.update((min(i, j), max(i, j)) for j in other)
            for k in trie_links(lists[i], int(sizes[i]), [lists[j] for j in other], [int(sizes[j]) for j in other], percent) if other else ():
                j = other[k]
                if labels[i] != labels[j]:
                    found.append((i, j))
                    labels[labels == labels[j]] = labels[i]
    return found


# ---------------------------------------------------------------- stages

def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node, row, ...) of every row: its id, the size and fingerprint of its set, a number of its own, and
    the columns after doc_id and text. The number is settled once the result is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            sets = [shingles(t, k) for t in texts_of(b.column("text"))]
            own = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array(np.arange(row, row + b.num_rows), pa.int64())]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([*own, *b.columns[2:]], names=["doc_id", "n", "node", "row", *b.schema.names[2:]])

    ddl = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(run, f"doc_id long, n long, node binary, row long{ddl}")


def ordered(docs: DataFrame, k: int, percent: int, n_shards: int) -> DataFrame:
    """(node, n, codes, prefix, sketch): the sets of docs in the global order; only sets that can link."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, nodes, sets, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(sets), 500):
                some = sets[lo : lo + 500]
                yield batch(_KEYS, block=[block] * len(some), shard=[-1] * len(some), node=nodes[lo : lo + 500], n=[len(s) for s in some], data=[s.tobytes() for s in some], counts=pa.nulls(len(some), pa.binary()))
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            shard, rows = shard_of(keys, n_shards), []
            for lo, hi in stretches(shard):
                rows.append((int(shard[lo]), low40(keys[lo:hi]), np.minimum(counts[lo:hi], 65535).astype(np.uint16).tobytes()))
            a, b, c = zip(*rows, strict=True)
            yield batch(_KEYS, block=[block] * len(rows), shard=a, node=pa.nulls(len(rows), pa.binary()), n=[0] * len(rows), data=b, counts=c)

        for b in batches:
            for t in unpacked_texts(b.column("text")):
                s = shingles(t, k)
                if len(s):
                    nodes.append(fingerprint(s))
                    sets.append(s)
                    held += len(s)
                if held >= BLOCK_KEYS:
                    yield from flush()
                    block, nodes, sets, held = block + 1, [], [], 0
        if sets:
            yield from flush()

    blocks = stored(docs.mapInArrow(send, _KEYS_DDL), "join-sets")

    def classes(rows: pa.Table) -> pa.Table:
        parts = [from40(x) for x in rows.column("data").to_pylist()]
        counts = [np.frombuffer(x, np.uint16) for x in rows.column("counts").to_pylist()]
        keys, total = np.concatenate(parts), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        held = np.add.reduceat(total[order], heads)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.repeat(np.floor(np.log2(held)).astype(np.uint8), np.diff(heads, append=len(keys)))
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "levels": pa.array([level[e - len(p) : e].tobytes() for e, p in zip(ends, parts, strict=True)], pa.binary())})

    levels = dealt(blocks.filter("shard >= 0").select("block", "shard", "data", "counts"), n_shards, "shard").groupBy("shard").applyInArrow(classes, "block long, shard int, levels binary")

    def put_in_order(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left):
            sets = [np.frombuffer(x, U64) for x in left.column("data").to_pylist()]
            keys = np.unique(np.concatenate(sets))
            level = np.frombuffer(b"".join(x for _, x in sorted(zip(right.column("shard").to_pylist(), right.column("levels").to_pylist(), strict=True))), np.uint8)
            for node, s in zip(left.column("node").to_pylist(), sets, strict=True):
                own = level[np.searchsorted(keys, s)].astype(U64)
                alone = int((own == 0).sum())
                first = len(s) - need(len(s), percent) + 1
                if alone < first:
                    codes = np.sort((own << U64(58) | s >> U64(6))[own > 0])
                    out.append((node, len(s), codes.tobytes(), codes[: first - alone].view(np.int64).tolist(), sketch(s)))
        a, b, c, d, e = zip(*out, strict=True) if out else ((), (), (), (), ())
        return pa.table({"node": pa.array(a, pa.binary()), "n": pa.array(b, pa.int32()), "codes": pa.array(c, pa.binary()), "prefix": pa.array(d, pa.list_(pa.int64())), "sketch": pa.array(e, pa.binary())})

    sets = blocks.filter("shard < 0").select("block", "node", "data")
    return sets.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(put_in_order, "node binary, n int, codes binary, prefix array<long>, sketch binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """Those of pairs (a, b, held) whose sets link; held is about how many partners the pivot a has. They are dealt by
    pivot and slot, of about PIVOT_ROWS pairs, so that a pivot with many partners is spread over tasks and nothing is
    grouped by pivot alone."""
    slot = F.pmod(F.xxhash64("b"), F.ceil(F.col("held") / PIVOT_ROWS))
    placed = pairs.select(F.pmod(F.xxhash64("a", slot), F.lit(n_buckets)).cast("int").alias("bucket"), "a", "b")
    s = sets.select(F.col("node").alias("b"), F.col("n"), F.col("codes"))
    leaves = placed.join(s, "b").select("bucket", "a", "b", "n", "codes")
    pivots = placed.select(F.col("bucket").alias("home"), "a").distinct().join(s.withColumnRenamed("b", "a"), "a").select("home", F.col("a").alias("pivot"), F.col("n").alias("size"), F.col("codes").alias("body"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {a: (n, np.frombuffer(c, U64)) for a, n, c in zip(*(right.column(x).to_pylist() for x in ("pivot", "size", "body")), strict=True)}
        groups: dict[bytes, list] = {}
        for a, b, n, c in zip(*(left.column(x).to_pylist() for x in ("a", "b", "n", "codes")), strict=True):
            groups.setdefault(a, []).append((b, n, np.frombuffer(c, U64)))
        out = [(a, group[i][0]) for a, group in groups.items() for i in trie_links(known[a][1], known[a][0], [g[2] for g in group], [g[1] for g in group], percent)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})

    return dealt(leaves, n_buckets, "bucket").groupBy("bucket").cogroup(dealt(pivots, n_buckets, "home").groupBy("home")).applyInArrow(compare, "a binary, b binary")


def meetings(members: DataFrame, labels: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, key, low, high, node, label): where members (key, node) of groups with several components meet. A group
    of up to GROUP_ROWS meets in one place; of a larger one, blocks low and high.

    Sets that are alike share many groups. Groups with the same smallest component lie in one bucket, so such sets are
    sent there once and compared once; the groups of a component with many members are dealt over slots."""
    t = members.join(labels, "node")
    counts = t.groupBy("key", "label").agg(F.count("*").alias("n"))
    groups = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"), F.min("label").alias("home"), F.count("*").alias("kinds")).filter("kinds > 1")
    small = F.col("n") <= GROUP_ROWS
    blocks = lambda x: F.when(small, 1).otherwise(F.ceil(x / GROUP_ROWS)).cast("int")
    slots = groups.groupBy("home").agg(F.ceil(F.sum("n") / SLOT_ROWS).alias("slots"))
    groups = groups.join(slots, "home").withColumn("home", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("slots"))))
    groups = groups.select("key", "home", "major", blocks(F.col("n") - F.col("most")).alias("minor_blocks"), F.when(small, 0).otherwise(blocks(F.col("most"))).alias("major_blocks"))
    t = t.join(groups, "key")
    spread = F.xxhash64("node")
    major = (F.col("label") == F.col("major")) & (F.col("major_blocks") > 0)
    own = F.when(major, F.col("minor_blocks") + F.pmod(spread, F.col("major_blocks"))).otherwise(F.pmod(spread, F.col("minor_blocks"))).cast("int")
    # a block of the largest component meets those of others only
    last = F.when(major, F.col("minor_blocks") - 1).otherwise(F.col("minor_blocks") + F.col("major_blocks") - 1).cast("int")
    t = t.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    bucket = F.pmod(F.xxhash64("home", low, high), F.lit(n_buckets)).cast("int")
    return t.select(bucket.alias("bucket"), "key", low.alias("low"), high.alias("high"), "node", "label")


def joining_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, n_buckets: int) -> DataFrame:
    """(a, b): links between members (key, node) of groups that join their components."""
    rows = meetings(members, labels, n_buckets).join(sets.select("node", "n", "sketch"), "node").select("bucket", "key", "low", "high", "node", "n", "label", "sketch")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending")])
        key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
        sketches = Sketches(rows.column("sketch").to_pylist())
        n, labels = rows.column("n").to_numpy().astype(np.int64), np.array(rows.column("label").to_pylist(), object)
        keep, place = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            place[lo:hi] = k
            keep[lo:hi] = with_partners(sketches, np.arange(lo, hi), n, labels, percent)
        some = pa.array(np.flatnonzero(keep))
        return pa.table({"bucket": rows.column("bucket").take(some), "place": pa.array(place[keep]), "node": rows.column("node").take(some), "label": rows.column("label").take(some)})

    active = dealt(rows, n_buckets, "bucket").groupBy("bucket").applyInArrow(run, "bucket int, place long, node binary, label binary")
    active = active.groupBy("bucket", "node").agg(F.first("label").alias("label"), F.collect_list("place").alias("places"))
    active = active.join(sets.select("node", "n", "sketch", "codes"), "node").select("bucket", "node", "label", "places", "n", "sketch", "codes")

    def forest(rows: pa.Table) -> pa.Table:
        nodes, places = rows.column("node").to_pylist(), rows.column("places").to_pylist()
        row = np.repeat(np.arange(len(nodes)), [len(p) for p in places])
        flat = np.array([x for p in places for x in p], np.int64)
        order = np.argsort(flat, kind="stable")
        groups = [row[order[lo:hi]] for lo, hi in stretches(flat[order])]
        sketches = Sketches(rows.column("sketch").to_pylist())
        lists = [np.frombuffer(c, U64) for c in rows.column("codes").to_pylist()]
        found = trie_forest(groups, lists, rows.column("n").to_numpy().astype(np.int64), sketches, np.array(rows.column("label").to_pylist(), object), percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    return dealt(active, n_buckets, "bucket").groupBy("bucket").applyInArrow(forest, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): the smallest node that it reaches.

    Each round takes the smallest label among neighbours, then the label's label; a table is written each round, so a
    lost executor costs one round. Rounds grow with the logarithm of a component's width."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "join-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "join-labels")
    changed = 1
    while changed:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        seen = Observation()
        new = step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        labels = stored(new.observe(seen, F.coalesce(F.sum((F.col("old") != F.col("label")).cast("long")), F.lit(0)).alias("changed")), "join-step").select("node", "label")
        changed = seen.get["changed"]
    return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (a, b) joined some of them."""
    x, y = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    joins = stored(links.join(x, "a").join(y, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "join-joins")
    if joins.isEmpty():
        return labels
    new = components(joins).select(F.col("node").alias("old"), F.col("label").alias("new"))
    left, right = labels.alias("l"), new.alias("n")
    return stored(left.join(right, F.col("l.label") == F.col("n.old"), "left").select("l.node", F.coalesce("n.new", "l.label").alias("label")), "join-relabelled")


def join(docs: DataFrame, k: int = 5, percent: int = 75, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id (the smallest id reachable by links)
    and chosen (true for one row of each component, of the smallest id), then the columns named in keep.

    Words are lower-cased (A-Z); a set holds the distinct k-word shingles, with fewer words the whole sequence as one.
    Two sets link when 100 * overlap >= percent * union. Null and empty texts have an empty set, link with nothing and
    have their own id as component. Repeated rows and equal sets are linked. Null ids come after all others: a
    component of null ids only has a null id. Other columns are ignored."""
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    extra = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])

    def prefix(data: np.ndarray) -> np.ndarray:
        s = shingles(data, k)
        return s[: len(s) - need(len(s), percent) + max(1, len(s) // PART)] if len(s) else s

    with collected() as tables:
        n_shards = shards_for(own)
        every = stored(described(extra, k), "join-nodes")
        nodes = every.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row")).alias("lead"), F.first("n").alias("n")).withColumn("first", F.col("lead.id"))
        # a linked set has need(n) elements at least, and so shares the first need(n) / PART of its common elements
        enough = F.greatest(F.lit(1), F.floor(F.floor((percent * F.col("n") + 99) / 100) / PART))
        partners = shared_keys(own, prefix, n_shards)[0].select(F.coalesce("id", F.lit(NO_ID)).alias("first"), (F.length("found") / 5).alias("hits"))
        chosen = nodes.groupBy("first").agg(F.min("n").alias("n")).join(partners, "first").filter(F.col("hits") >= enough).select("first")
        some = packed_texts(own).join(chosen, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("first"), "left_semi").select("text")
        sets = stored(ordered(some, k, percent, n_shards).dropDuplicates(["node"]), "join-ordered")

        held = sets.agg(F.sum(F.length("codes") + F.lit(512))).first()[0] or 0
        n_buckets = max(n_shards, -(-held // BUCKET_BYTES))
        members = sets.select("node", "n", F.explode("prefix").alias("key"), (F.length("codes") / 8 / F.col("n")).alias("share"))
        close = lambda x, y: (100 * x >= percent * y) & (100 * y >= percent * x)
        pivots = members.groupBy("key").agg(F.max(F.struct("share", "node", "n")).alias("best"), F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("_n")).filter("_n > 1")
        m = members.join(pivots, "key")
        pivot = F.explode(F.array(*[F.struct(F.col(f"{p}.node").alias("node"), F.col(f"{p}.n").alias("n")) for p in ("best", "low")]))
        stars = m.select(pivot.alias("p"), "node", "n", "_n").filter((F.col("p.node") != F.col("node")) & close(F.col("p.n"), F.col("n")))
        compared = stored(stars.groupBy(F.col("p.node").alias("a"), F.col("node").alias("b")).agg(F.max("_n").alias("held")), "join-stars")
        labels = relabelled(sets.select("node", F.col("node").alias("label")), linked(compared, sets, percent, n_buckets))
        links = stored(joining_links(members.select("key", "node"), sets, labels, percent, n_buckets), "join-forest")
        labels = relabelled(labels, links)
        # sets without links are their own component: only the others are looked up
        label = nodes.join(labels, "node").select("node", "label", "lead")
        of_label = label.groupBy("label").agg(F.min("lead").alias("top"))
        of_label = label.join(of_label, "label").select("node", "top")
        named = nodes.select("node", "lead").join(of_label, "node", "left").select("node", F.coalesce("top", "lead").alias("top"))
        named = stored(named, "join-named")
    removed(docs.sparkSession, tables[1:-1])  # the result reads the first table, of all rows, and the last
    # rows without a set have no component: a null key would meet in one task
    some, none = every.filter("node is not null"), every.filter("node is null").withColumn("top", F.lit(None).cast(named.schema["top"].dataType))
    out = some.join(named, "node").unionByName(none)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("top.id") != NO_ID, F.col("top.id"))
    chosen = F.col("node").isNull() | (F.col("row") == F.col("top.row"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), chosen.alias("chosen"), *[F.col(f"`keep_{c}`").alias(c) for c in keep])
