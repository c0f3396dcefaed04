"""The trie of conversation prefixes, built compressed (Patricia) from sorted paths and expanded afterwards.

A turn is a digest of 16 bytes, a conversation the path of its digests; texts stay where they are read. Equal paths are counted before
they are sorted. Sorted ranges are streamed: the longest common prefix with the path before says which points close and where an edge is
split, so that only branches, ends and leaves exist; each takes up the sums of its subtree as it closes. Nodes that a range may
share with its neighbours are prefixes of its first or of its last path; for these alone the ranges give partial sums, which are added
up by key. Edges become nodes as they are written, by suffix sums of the bytes along them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestat.llm.common import materialise, only, tidy

STEP = 16
NONE = hashlib.sha256(b"").hexdigest()
#: Conversation ids in one string while those of an end are joined; rows of an Arrow batch.
IDS = 4096
ROWS = 2048
#: Ranges are told apart by so many turns of a path, which bounds what their borders hold; paths that agree in all of them share a range.
BORDER = 256
#: Tables of at most so many rows (of 24 bytes) are broadcast.
BROADCAST_ROWS = 100_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def name(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:STEP]


class _Writer:
    """Rows that become Arrow batches."""

    def __init__(self, fields: list[tuple[str, pa.DataType]]):
        self.fields, self.rows = fields, []

    def full(self, least: int = ROWS) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, self.fields, strict=True)], names=[n for n, _ in self.fields])
            self.rows = []


# paths


def rebuilt(conversations: DataFrame, base: Column, kept: Column) -> DataFrame:
    """conv_id, path, sizes, key: every conversation with its first `kept` turns replaced by those of conversation `base`.

    path joins the digests of its turns, sizes the bytes of their texts (64-bit); base and kept are expressions over conv_id, kept at
    most 8. One shuffle by base brings digests together; a task streams them, holding one conversation.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    size = F.octet_length("role").cast("string")
    digest = F.sha2(F.concat(size, F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    turns = rows.where("conv_id is not null").select(
        base.alias("base"), "conv_id", "turn", F.substring(F.unhex(digest), 1, STEP).alias("digest"), F.octet_length("text").cast("long").alias("size"), kept.cast("long").alias("kept")
    )
    order = [F.col("base"), F.col("conv_id") != F.col("base"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "size", "kept")
    fields = [("conv_id", pa.int64()), ("path", pa.binary()), ("sizes", pa.binary()), ("key", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, heads, head = _Writer(fields), [], None  # the first turns of the base, and whose they are
        conv, path, sizes = None, bytearray(), bytearray()
        seen = 0

        def add() -> None:
            if conv is not None:
                out.rows.append((conv, bytes(path), bytes(sizes), name(bytes(path))))

        for b in batches:
            for of, c, digest, n, keep in zip(*[x.to_pylist() for x in b.columns], strict=True):
                size = n.to_bytes(8, "little")
                if c != conv:
                    add()
                    yield from out.full()
                    if of != head:
                        heads, head = [], of
                    conv, seen, path, sizes = c, 0, bytearray(), bytearray()
                    if c != of:
                        for d, s in heads[:keep]:
                            path += d
                            sizes += s
                seen += 1
                if c == of and seen <= 8:
                    heads.append((digest, size))
                if c == of or seen > keep:
                    path += digest
                    sizes += size
        add()
        yield from out.full(1)

    return dealt.mapInArrow(tidy(run), "conv_id long, path binary, sizes binary, key binary")


def joined_ids(paths: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ids of each key, ascending and comma-joined.

    Ids are sorted in ranges of (key, id), so that a path of very many conversations lies in many; what then meets by key are strings of
    IDS ids, and a task holds one of them.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
        key, ids = None, []
        for b in batches:
            for k, c in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if k != key or len(ids) == IDS:
                    if ids:
                        out.rows.append((key, ids[0], ",".join(map(str, ids)).encode()))
                        yield from out.full(256)
                    key, ids = k, []
                ids.append(c)
        if ids:
            out.rows.append((key, ids[0], ",".join(map(str, ids)).encode()))
        yield from out.full(1)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer([("key", pa.binary()), ("ends_sha256", pa.string())])
        key, sha = None, None
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        out.rows.append((key, sha.hexdigest()))
                        yield from out.full()
                    key, sha = k, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
        if sha is not None:
            out.rows.append((key, sha.hexdigest()))
        yield from out.full(1)

    sorted_ids = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    strings = sorted_ids.mapInArrow(tidy(join), "key binary, first long, ids binary")
    return strings.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(tidy(digest), "key binary, ends_sha256 string")


# the compressed tree of a sorted range


class Point:
    """A branch, an end or a leaf that is still open; `spine` if it is a prefix of the range's first path."""

    __slots__ = ("children", "depth", "ends", "first", "leaves", "n", "saved", "spine", "tops")

    def __init__(self, depth: int, spine: bool):
        self.depth, self.spine, self.n, self.first, self.ends = depth, spine, 0, None, None
        self.children = self.leaves = self.saved = 0  # of the subtrees that lie in this range alone
        self.tops: list[tuple] = []  # the uppermost nodes of edges to children: they wait for this point's smallest member

    def member(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def common_turns(a: bytes, b: bytes) -> int:
    """The turns that two paths share at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // STEP
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * STEP] == b[: mid * STEP] else (lo, mid - 1)
    return lo


class Patricia:
    """Takes sorted, distinct paths and gives rows: nodes of this range alone, and partial ones of its spine.

    A row is (spine key, parent's key, size of the last text, *NODE). Nodes alone have no spine key; they have a parent's key, and
    no parent_conv_id yet, where the parent is on the spine.
    """

    def __init__(self):
        self.rows: list[tuple] = []
        self.path, self.sizes, self.stack, self.begun = b"", np.zeros(0, np.int64), [Point(0, True)], False

    def add(self, path: bytes, sizes: bytes, n: int, first: int, ends: str) -> None:
        shared = common_turns(self.path, path)
        self._close(shared)
        self.path, self.sizes = path, np.frombuffer(sizes, np.int64)
        if len(path) // STEP > shared:
            self.stack.append(Point(len(path) // STEP, not self.begun))
        self.begun = True
        self.stack[-1].member(n, first)
        self.stack[-1].ends = ends

    def finish(self) -> None:
        if self.begun:
            for p in self.stack:
                p.spine = True  # prefixes of the last path
            self._close(0)
            self._spine(self.stack[0], 0)

    def _close(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            low = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, low.spine))
            top = self.stack[-1]
            top.member(low.n, low.first)
            if low.spine:
                self._spine(low, top.depth + 1)
            else:
                self._edge(low, top)

    def _edge(self, low: Point, top: Point) -> None:
        """The nodes from below top to low, which lie in this range alone; all have the members of low."""
        for t in low.tops:
            self.rows.append((None, None, None, t[0], t[1], low.first, *t[2:]))
        leaves = low.leaves if low.children else 1
        along = self.sizes[top.depth : low.depth]
        below = np.cumsum(along[::-1])[::-1] * (low.n - 1) + low.saved  # suffix sums
        for d in range(low.depth, top.depth, -1):
            own = (low.children, low.ends or NONE) if d == low.depth else (1, NONE)
            node = (low.first, d, low.n, own[0], leaves, int(below[d - top.depth - 1]), own[1])
            if d > top.depth + 1:
                self.rows.append((None, None, None, node[0], node[1], low.first, *node[2:]))
            elif top.spine:
                self.rows.append((None, name(self.path[: top.depth * STEP]), None, node[0], node[1], None, *node[2:]))
            else:
                top.tops.append(node)
        top.children += 1
        top.leaves += leaves
        top.saved += int(below[0])

    def _spine(self, low: Point, least: int) -> None:
        """Partial nodes from depth `least` down to low, one by one: other ranges may have points between them."""
        key = name(self.path[: low.depth * STEP])
        for t in low.tops:
            self.rows.append((None, key, None, t[0], t[1], None, *t[2:]))
        for d in range(low.depth, least - 1, -1):
            above = name(self.path[: (d - 1) * STEP]) if d else None
            sums = (low.children, low.leaves, low.saved, low.ends) if d == low.depth else (0, 0, 0, None)
            self.rows.append((key, above, int(self.sizes[d - 1]) if d else 0, low.first, d, None, low.n, *sums))
            key = above


_KINDS = [("key", pa.binary()), ("above", pa.binary()), ("size", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree, out = Patricia(), _Writer(_KINDS)
    out.rows = tree.rows
    for b in batches:
        for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
            tree.add(*row)
            yield from out.full()
            tree.rows = out.rows
    tree.finish()
    yield from out.full(1)


def _backbone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spine nodes, whole, from their added sums: children before parents."""
    nodes = {}
    for b in batches:
        for key, *rest in zip(*[b[n].to_pylist() for n, _ in _KINDS], strict=True):
            nodes[key] = rest
    out = _Writer([*_KINDS[:1], *_KINDS[3:], ("holds", pa.int64())])
    below: dict[bytes, list[int]] = {}
    for key in sorted(nodes, key=lambda k: -nodes[k][3]):
        above, size, conv, depth, _, n, children, leaves, saved, ends = nodes[key]
        more = below.pop(key, [0, 0, 0])
        holds, children = children, children + more[0]
        leaves = leaves + more[1] if children else 1
        saved += more[2] + (n - 1) * size
        if above is not None:
            up = below.setdefault(above, [0, 0, 0])
            up[0] += 1
            up[1] += leaves
            up[2] += saved
        out.rows.append((key, conv, depth, nodes[above][2] if above is not None else None, n, children, leaves, saved, ends or NONE, holds))
        yield from out.full()
    yield from out.full(1)


def prefix_trie(conversations: DataFrame, base: Column | None = None, kept: Column | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for every distinct prefix.

    A node of depth d is a distinct sequence of first d turns (role, text), the root that of none; its members are the conversations that
    start with it, conv_id the smallest. saved_tokens adds up, over its subtree, (members - 1) times the bytes of each node's last text;
    ends_sha256 is the digest of the ids, ascending and comma-joined, of the members that end there. With base and kept (see rebuilt),
    conversations are rebuilt first.
    Cases: turns sort by turn (nulls first), ties by the digest of (role, text), so that repeated rows are turns each; null role and text
    are empty; rows without conv_id belong to no conversation; an empty table has no nodes; other columns are ignored. A conversation's
    digests (24 bytes a turn) are held at once, its texts never.
    """
    base = F.col("conv_id") if base is None else base
    paths = materialise(rebuilt(conversations, base, F.lit(0) if kept is None else kept), "trie-paths")
    distinct = paths.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    whole = distinct.join(joined_ids(paths), "key").select("path", "sizes", "n", "first", "ends_sha256")
    border = F.substring("path", 1, BORDER * STEP)
    ranges = whole.repartitionByRange(border).sortWithinPartitions("path")
    columns = "key binary, above binary, size long, " + NODE
    points = materialise(ranges.mapInArrow(tidy(_ranges), columns), "trie-points")
    spine = points.where("key is not null").groupBy("key").agg(
        F.first("above").alias("above"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"),
    )
    # two paths for each range
    backbone = materialise(spine.coalesce(1).mapInArrow(tidy(_backbone), f"key binary, {NODE}, holds long"), "trie-spine")
    holders = backbone.where("holds > 0").select(F.col("key").alias("above"), F.col("conv_id").alias("holder"))
    if holders.count() <= BROADCAST_ROWS:
        holders = F.broadcast(holders)
    names = [f.split()[0] for f in NODE.split(", ")]
    inside = points.where("key is null").join(holders, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "holder"))
    return inside.select(*names).unionByName(backbone.select(*names))
