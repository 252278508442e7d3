"""Merkle dataset manifest over concatenated-level strings.

Every row of a table is a leaf; the leaves of a group are ordered and cut into aligned blocks of
``BLOCK``.  A block keeps each of its levels as one string of hex digests: the parents of a level are
the hashes of its fixed-width substrings of two digests, a sibling is the flanking substring of one
digest.  The last level of a block is its root; the block roots of a group are the nodes of the next
round, in blocks again, until one is left (the group's subroot).  The subroots, ordered by group, make
the top tree in the same way.

Rows are ordered by one range shuffle (groups of any size, one included, spread over all tasks); no
task holds more than a block.  Each round is a written table, so a lost executor repeats one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, saved

BLOCK = 256  # nodes of a block; a power of two
WIDTH = 64  # hex digits of a digest
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")  # of a leaf, in order
_STEP = "array<struct<sib:string,right:boolean>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: per value ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (with a column g) with pos, the place in g by ``order``, and n, the rows of g."""
    # A random last key deals equal rows to several tasks; their order does not matter.
    dealt = rows.withColumn("_tie", F.rand(1))
    keys = ["g", *order, "_tie"]
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    dealt = dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    dealt = saved(dealt, name)
    # One row a group and task: as many as groups and tasks together.
    runs = dealt.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("k"), F.min("_row").alias("first"))
    whole = F.expr("sum(k) over (partition by g)")
    before = F.expr("sum(k) over (partition by g order by _part) - k")
    runs = saved(runs.select(F.col("g").alias("_g"), F.col("_part").alias("_p"), "first", before.alias("before"), whole.alias("n")), f"{name}-runs")
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    pos = F.col("before") + F.col("_row") - F.col("first")
    return dealt.join(runs, same).select(*rows.columns, pos.alias("pos"), "n")


def _levels(digests: Column, single: Column) -> Column:
    """All levels of a block from the digests of its nodes, each one string of hex digits.

    ``single``: the group has no other block, so its tree ends at the first level of one digest.
    """
    pair = 2 * WIDTH

    def grow(levels: Column, _) -> Column:
        last = F.element_at(levels, -1)
        count = F.floor((F.length(last) + (pair - 1)) / pair).cast("int")
        parents = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.substring(last, i * pair + 1, F.lit(pair)), 256)
        )
        longer = F.concat(levels, F.array(F.array_join(parents, "").cast("binary")))
        return F.when(single & (F.length(last) == WIDTH), levels).otherwise(longer)

    rounds = F.sequence(F.lit(1), F.lit(BLOCK.bit_length() - 1))
    # As bytes: a substring of bytes is found without reading what lies before it.
    return F.aggregate(rounds, F.array(F.array_join(digests, "").cast("binary")), grow)


def _steps(levels: Column, pos: Column) -> Column:
    """The way from node ``pos`` to its block's root: each level's sibling (empty: none) and side."""
    lower = F.slice(levels, F.lit(1), F.size(levels) - 1)
    at = (pos % BLOCK).cast("int")

    def step(level: Column, i: Column) -> Column:
        here = F.call_function("shiftright", at, i)
        sibling = F.substring(level, here.bitwiseXOR(F.lit(1)) * WIDTH + 1, F.lit(WIDTH)).cast("string")
        return F.struct(sibling.alias("sib"), (here % 2 == 1).alias("right"))

    return F.transform(lower, step)


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written rounds of the trees over nodes (g, pos, n, digest, ...), and (g, digest) of the roots.

    A round has a row a block: g, block, n (nodes of g in this round), nodes, levels, root.
    """
    rounds, extra = [], [c for c in nodes.columns if c not in ("g", "pos", "n", "digest")]
    while True:
        one = F.struct("pos", "digest", *extra)
        blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block"), "n").agg(
            F.sort_array(F.collect_list(one)).alias("nodes")  # at most BLOCK
        )
        blocks = blocks.withColumn("levels", _levels(F.col("nodes.digest"), F.col("n") <= BLOCK))
        blocks = blocks.withColumn("root", F.element_at("levels", -1).cast("string"))
        rounds.append(saved(blocks, f"{name}-{len(rounds)}"))
        open_blocks = rounds[-1].filter(F.col("n") > BLOCK)
        if open_blocks.isEmpty():
            break
        n = F.floor((F.col("n") + (BLOCK - 1)) / BLOCK)
        nodes, extra = open_blocks.select("g", F.col("block").alias("pos"), n.alias("n"), F.col("root").alias("digest")), []
    roots = rounds[0].filter(F.col("n") <= BLOCK)
    for r in rounds[1:]:
        roots = roots.select("g", "root").union(r.filter(F.col("n") <= BLOCK).select("g", "root"))
    return rounds, roots.select("g", F.col("root").alias("digest"))


def _ways(rounds: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """(g, subroot, root, path, node): every node of round 0 with its steps to the very root.

    ``tops``: (g, subroot, root, path) of each group.
    """
    up = None
    for i in range(len(rounds) - 1, -1, -1):
        r = rounds[i].withColumnsRenamed({"g": "_g"})
        ended = r.filter(F.col("n") <= BLOCK).join(tops, F.col("_g").eqNullSafe(F.col("g"))).select(r["*"], "subroot", tops["root"].alias("top"), "path")
        if up is not None:
            same = F.col("_g").eqNullSafe(F.col("g")) & (F.col("block") == F.col("pos"))
            going = r.filter(F.col("n") > BLOCK).join(up, same).select(r["*"], "subroot", "top", "path")
            ended = ended.union(going)
        way = ended.select(F.col("_g").alias("g"), "levels", "subroot", "top", "path", F.explode("nodes").alias("node"))
        path = F.concat(_steps(F.col("levels"), F.col("node.pos")), F.col("path"))
        if i == 0:
            return way.select("g", "subroot", F.col("top").alias("root"), path.alias("path"), "node")
        up = saved(way.select("g", F.col("node.pos").alias("pos"), "subroot", "top", path.alias("path")), f"{name}-up-{i}")
    raise AssertionError("no rounds")


def proofs(
    df: DataFrame,
    columns: Sequence[str] = COLUMNS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, path and the ``carry`` columns.

    Leaves ascend by id within their group (null ids first; equal ids by their digests), groups
    ascend bytewise (the null group first).  Rows that are equal in all of ``columns`` have equal
    leaves, so their order does not matter; each has its own place and proof.  Null values are told
    from empty ones.  An empty table gives no rows.  Only the named columns are read, so further
    ones may have any name.
    """
    carry = carry or {}
    rows = df.select(
        col_of(group_col).alias("g"), col_of(id_col).alias("id"), leaf_digest([col_of(c) for c in columns]).alias("digest"),
        *(v.alias(k) for k, v in carry.items()),
    )
    rounds, subroots = _rounds(_placed(rows, ["id", "digest"], "merkle-rows"), "merkle")
    subroots = saved(subroots, "merkle-subroots")
    top_nodes = _placed(subroots.select(F.lit(0).alias("g"), F.struct(F.col("g").alias("lang"), "digest").alias("group"), "digest"), ["group"], "merkle-groups")
    top_rounds, tops = _rounds(top_nodes, "merkle-top")
    start = tops.select("g", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_STEP).alias("path"))
    by_group = _ways(top_rounds, start, "merkle-top").select(
        F.col("node.group.lang").alias("g"), F.col("node.digest").alias("subroot"), "root", "path"
    )
    ways = _ways(rounds, saved(by_group, "merkle-tops"), "merkle")
    return ways.select(
        F.col("node.id").alias("doc_id"), F.col("node.digest").alias("leaf"), "subroot", "root", "path",
        *(F.col("node").getField(k).alias(k) for k in carry),
    )


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s.getField("sib")), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(digest: Column, s: Column) -> Column:
        sib = s.getField("sib")
        return F.sha2(F.when(s.getField("right"), F.concat(sib, digest)).otherwise(F.concat(digest, sib)), 256)

    return F.aggregate(path, leaf, up)
