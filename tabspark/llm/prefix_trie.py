"""Trie of shared conversation prefixes, built from ternary search trees of range shards.

A turn is known by the digest of its role and text, a conversation by the array of its turns.  One
range shuffle orders all conversations by their turns, then by id, so the members of a prefix are
consecutive, and equal conversations, however many, spread over tasks.  Each task cuts its rows into
shards of bounded size, encodes the shard's turns by a dictionary, inserts the distinct sequences into
a ternary search tree, the median of each range first, and sums members, leaves and savings upwards
without recursion.

Nodes on the first or last sequence of a shard may have members in the neighbours; all others are
final.  The shard counts each such boundary node as if it were its own, and three corrections, known
once the common prefix with the neighbour is, make the parts additive: a node that the shard before
holds is no new child and saves its full length, and a last sequence that goes on in the next shard is
no leaf yet.  So boundary nodes merge by plain sums over their path digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, saved

SHARD = 200_000  # conversations and turns of a shard, about
_INNER, _EDGE, _ENDS, _TASK = range(4)
_OUT = pa.schema([
    ("kind", pa.int32()), ("task", pa.int64()), ("shard", pa.int64()), ("path", pa.binary()), ("up", pa.binary()),
    ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
    # open sides of a boundary node: its task's first or last sequence, lengths above it on the first one
    ("first_open", pa.bool_()), ("last_open", pa.bool_()), ("above", pa.int64()),
    ("first_path", pa.list_(pa.binary())), ("first_sums", pa.list_(pa.int64())), ("last_path", pa.list_(pa.binary())),
])
_DDL = (
    "kind int, task long, shard long, path binary, up binary, depth long, conv_id long, parent long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, first_open boolean, last_open boolean, above long, "
    "first_path array<binary>, first_sums array<long>, last_path array<binary>"
)


def sequences(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, turns is an array of (key, len) in order.

    Null turns come first, equal ones follow their keys; null roles and texts are empty; len counts
    code points.  Rows without a conv_id belong to no conversation.  Texts themselves are not shuffled.
    """
    text = lambda name: F.coalesce(col_of(name).cast("string"), F.lit(""))
    role = text(role_col)
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text(text_col))))
    one = F.struct(col_of(turn_col).alias("turn"), key.alias("key"), F.length(text(text_col)).alias("len"))
    rows = df.select(col_of(id_col).cast("long").alias("conv_id"), one.alias("t")).filter("conv_id is not null")
    turns = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t.getField("key").alias("key"), t.getField("len").alias("len"))).alias("turns"))


class TernaryTree:
    """Distinct sequences of turn codes; every node of the tree is a node of the trie, 0 its root."""

    def __init__(self) -> None:
        self.code, self.low, self.same, self.high, self.up = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.size, self.n, self.least, self.ends = [0], [0], [0], [None], {}

    def _new(self, code: int, up: int, size: int) -> int:
        self.code.append(code)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.size.append(size)
        self.n.append(0)
        self.least.append(None)
        for link in (self.low, self.same, self.high):
            link.append(-1)
        return len(self.code) - 1

    def _child(self, node: int, code: int, size: int) -> int:
        at, link, owner = self.same[node], self.same, node
        while at >= 0 and self.code[at] != code:
            link, owner = (self.low if code < self.code[at] else self.high), at
            at = link[owner]
        if at < 0:
            at = self._new(code, node, size)
            link[owner] = at
        return at

    def _join(self, node: int, ids: list[int]) -> None:
        self.n[node] += len(ids)
        if self.least[node] is None or ids[0] < self.least[node]:
            self.least[node] = ids[0]

    def insert(self, codes: list[int], sizes: list[int], ids: list[int]) -> None:
        """One sequence with the ascending ids of the conversations that have it."""
        node = 0
        self._join(node, ids)
        for code, size in zip(codes, sizes):
            node = self._child(node, code, size)
            self._join(node, ids)
        self.ends[node] = ids

    def walk(self, codes: list[int]) -> list[int]:
        nodes = [0]
        for code in codes:
            nodes.append(self._child(nodes[-1], code, 0))
        return nodes

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings below and at each node: parents come before their children."""
        children, leaves, savings = ([0] * len(self.code) for _ in range(3))
        for i in range(len(self.code) - 1, -1, -1):
            leaves[i] += children[i] == 0
            savings[i] += (self.n[i] - 1) * self.size[i]
            if i:
                up = self.up[i]
                children[up] += 1
                leaves[up] += leaves[i]
                savings[up] += savings[i]
        return children, leaves, savings


def _median_order(n: int) -> Iterator[int]:
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(mid + 1, b), (a, mid)]


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _digests(path: list[bytes]) -> list[bytes]:
    """The path digest of every prefix."""
    out = [md5(b"").digest()]
    for key in path:
        out.append(md5(out[-1] + key).digest())
    return out


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


class _Shard:
    """Consecutive conversations of one task: [path, lens, ids] of each distinct sequence."""

    def __init__(self, before: list[bytes] | None):
        self.before, self.seqs, self.load = before, [], 0  # the sequence before the shard, None: in another task

    def add(self, path: list[bytes], lens: list[int], conv_id: int) -> None:
        if self.seqs and self.seqs[-1][0] == path:
            self.seqs[-1][2].append(conv_id)
            self.load += 1
        else:
            self.seqs.append([path, lens, [conv_id]])
            self.load += 1 + len(path)

    def rows(self, task: int, number: int, after: list[bytes] | None) -> Iterator[pa.RecordBatch]:
        """``after``: the sequence that follows the shard, None: in another task."""
        dictionary = {k: i for i, k in enumerate(sorted({k for path, _, _ in self.seqs for k in path}))}
        codes = [[dictionary[k] for k in path] for path, _, _ in self.seqs]
        tree = TernaryTree()
        for i in _median_order(len(codes)):
            tree.insert(codes[i], *self.seqs[i][1:])
        children, leaves, savings = tree.sums()
        (first, lens, _), last = self.seqs[0], self.seqs[-1][0]
        on_first, on_last = tree.walk(codes[0]), tree.walk(codes[-1])
        digest = dict(zip(on_first, _digests(first))) | dict(zip(on_last, _digests(last)))
        sums = [0]
        for n in lens:
            sums.append(sums[-1] + n)
        known = 0 if self.before is None else _shared(self.before, first)
        goes_on = after is not None and after[: len(last)] == last
        rows = []
        for node, path in digest.items():
            d = tree.depth[node]
            on_1, on_2 = d < len(on_first) and on_first[d] == node, d < len(on_last) and on_last[d] == node
            above = sums[d - 1] if on_1 and d else 0
            row = {"kind": _EDGE, "task": task, "path": path, "up": digest.get(tree.up[node]) if node else None, "depth": d,
                   "conv_id": tree.least[node], "n_convs": tree.n[node], "n_children": children[node], "n_leaves": leaves[node],
                   "saved_tokens": savings[node], "first_open": on_1 and self.before is None, "last_open": on_2 and after is None, "above": above}
            if on_1 and self.before is not None:
                row["n_children"] -= d < known
                row["saved_tokens"] += max(sums[known] - above, 0)
            if on_2 and goes_on:
                row["n_leaves"] -= 1
            rows.append(row)
            if node in tree.ends:
                rows.append({"kind": _ENDS, "task": task, "shard": number, "path": path, "ends": _joined(tree.ends[node])})
        yield pa.RecordBatch.from_pylist(rows, _OUT)
        inner = [i for i in range(len(tree.code)) if i not in digest]
        up = [tree.up[i] for i in inner]
        values = {
            "kind": [_INNER] * len(inner), "up": [digest.get(u) for u in up], "depth": [tree.depth[i] for i in inner],
            "conv_id": [tree.least[i] for i in inner], "parent": [None if u in digest else tree.least[u] for u in up],
            "n_convs": [tree.n[i] for i in inner], "n_children": [children[i] for i in inner], "n_leaves": [leaves[i] for i in inner],
            "saved_tokens": [savings[i] for i in inner],
            "ends": [sha256(_joined(tree.ends.get(i, [])).encode()).hexdigest() for i in inner],
        }
        yield pa.RecordBatch.from_arrays([pa.array(values.get(f.name, [None] * len(inner)), f.type) for f in _OUT], schema=_OUT)


def _build(shard_size: int):
    def run(batches):
        task, shard, number, first, last = TaskContext.get().partitionId(), _Shard(None), 0, None, None
        for b in batches:
            for conv_id, path, lens in zip(*(c.to_pylist() for c in b.columns)):
                if first is None:
                    first = (path, lens)
                if shard.load >= shard_size:
                    yield from shard.rows(task, number, path)
                    shard, number = _Shard(last), number + 1
                shard.add(path, lens, conv_id)
                last = path
        if first is not None:
            yield from shard.rows(task, number, None)
            sums = [0]
            for n in first[1]:
                sums.append(sums[-1] + n)
            yield pa.RecordBatch.from_pylist([{"kind": _TASK, "task": task, "first_path": first[0], "first_sums": sums, "last_path": last}], _OUT)

    return run


def _hash_ends(batches):
    """(path, ends_sha256) of rows sorted by path, task and shard: one running hash, whatever the length."""
    path, digest = None, None
    for b in batches:
        done = []
        for p, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != path:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = p, sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["path", "ends_sha256"])
    if path is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], names=["path", "ends_sha256"])


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays, 0 where one is null."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return F.coalesce(F.when(differ == 0, F.size(a)).otherwise(differ - 1), F.lit(0))


def prefix_trie(seqs: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """One row per node of the trie over ``seqs`` (conv_id, turns as of ``sequences``).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (in the subtree), saved_tokens (over the subtree, lengths shared beyond the first
    member), ends_sha256 (of the ids of the conversations that end here).  Conversations without
    turns are members of the root; a table without conversations has no nodes.  ids are integers.
    """
    rows = seqs.select("conv_id", F.col("turns.key").alias("path"), F.col("turns.len").alias("lens"))
    dealt = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    out = saved(dealt.mapInArrow(_build(shard_size), _DDL), "trie-shards")

    # One row a task: what its first and last sequences share with the neighbouring tasks.
    tasks = out.filter(F.col("kind") == _TASK).select("task", "first_path", "first_sums", "last_path")
    tasks = tasks.withColumn("prev", F.expr("lag(last_path) over (order by task)")).withColumn("next", F.expr("lead(first_path) over (order by task)"))
    known = _common_prefix(F.col("prev"), F.col("first_path"))
    goes_on = F.col("next").isNotNull() & (_common_prefix(F.col("last_path"), F.col("next")) == F.size("last_path"))
    tasks = tasks.select(F.col("task").alias("_task"), known.alias("known"), F.get("first_sums", known).alias("known_sum"), goes_on.alias("goes_on"))

    edges = out.filter(F.col("kind") == _EDGE).join(tasks, F.col("task") == F.col("_task"))
    held = F.when(F.col("first_open") & (F.col("depth") < F.col("known")), 1).otherwise(0)
    again = F.when(F.col("first_open"), F.greatest(F.col("known_sum") - F.col("above"), F.lit(0))).otherwise(0)
    ongoing = F.when(F.col("last_open") & F.col("goes_on"), 1).otherwise(0)
    merged = edges.groupBy("path", "up", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") - held).alias("n_children"),
        F.sum(F.col("n_leaves") - ongoing).alias("n_leaves"), F.sum(F.col("saved_tokens") + again).alias("saved_tokens"),
    )
    merged = saved(merged, "trie-boundary")
    ends = out.filter(F.col("kind") == _ENDS).select("path", "ends", "task", "shard")
    ends = ends.repartition("path").sortWithinPartitions("path", "task", "shard").select("path", "ends")
    ends = ends.mapInArrow(_hash_ends, "path binary, ends_sha256 string")
    parents = merged.select(F.col("path").alias("_path"), F.col("conv_id").alias("_conv"))
    none = F.lit(sha256(b"").hexdigest())
    cols = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    boundary = merged.join(ends, "path", "left").join(parents, F.col("up") == F.col("_path"), "left")
    boundary = boundary.select("conv_id", F.col("_conv").alias("parent_conv_id"), *cols, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    inner = out.filter(F.col("kind") == _INNER).join(parents, F.col("up") == F.col("_path"), "left")
    inner = inner.select("conv_id", F.coalesce("parent", "_conv").alias("parent_conv_id"), *cols, F.col("ends").alias("ends_sha256"))
    whole = inner.union(boundary)
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
