r"""Conversation prefix trie by preorder intervals.

Every distinct sequence of the first d turns of the conversations is a node; the textless root has d = 0. Conversations
become paths of turn digests. The distinct paths are sorted lexicographically and ranked over all partitions at once, so
a node's conversations are an interval of ranks [first, last], and the nodes in order of (first, depth) are a preorder.
A node's subtree ends at the node of its last path. Leaves and savings are summed along the preorder, partition by
partition with the partitions' totals added, and a subtree's are the difference of the sums at its end and before its
top. Nothing recurses, and no node's members or children meet in one task: they are counted and summed before and after
shuffles, ranks come from range partitions of (path) and of (first, depth).

A node's ends (the conversations that are just its turns) are hashed in order of id: range partitions join runs of ids
to texts of some kB, and these are hashed one after the other, since SHA-256 can't be put together from parts.

`rebuild` makes the conversations: a prefix of a neighbour's turns, then the own turns behind one's own first ones.

Memory: a conversation's path of digests (24 bytes a turn) must fit a task; texts are read once and not kept.

Defined results: null roles and texts are empty; turns go by number, null first, then by role and text; repeated rows are
turns each; rows without a conv_id belong to no conversation; a conversation without turns is a member of the root and
ends there; a table without conversations gives no rows; further columns aren't read. Turns and nodes are told apart by
128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FAMILY, PREFIXES = 5, 9
#: Of an empty sequence of turns.
ROOT = bytes(16)
#: Bytes of decimal ids that are handed on as one text.
RUN_BYTES = 1 << 14
NO_ENDS = hashlib.sha256().hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, size): turns in order from 1, each as a digest of role and text with the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("n"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    # The role's length keeps ("ab", "c") from ("a", "bc").
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    rows = rows.select("conv_id", "n", "role", "text", digest.alias("turn"), F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("n"), "role", "text")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "turn", "size")


def rebuild(rows: DataFrame, family: int = FAMILY, prefixes: int = PREFIXES) -> DataFrame:
    """(conv_id, pos, turn, size) of the rebuilt conversations; pos, turn and size are null for one without turns.

    c starts with the first h turns of c - c % family, h = crc32(c) % prefixes, then has its own after its first h.
    """
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % prefixes).cast("int")
    own = rows.withColumn("h", taken)
    all_ids = own.groupBy("conv_id").agg(F.first("h").alias("h"))
    # Only a conversation's first turns are borrowed, so no side of the join has many rows of a key.
    lent = rows.where(F.col("pos") < prefixes).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "size"))).alias("lent"))
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    heads = all_ids.select("conv_id", "h", base).join(lent.withColumnRenamed("conv_id", "base"), "base", "left")
    heads = heads.select("conv_id", F.coalesce(F.slice("lent", 1, F.col("h")), F.array().cast(lent.schema["lent"].dataType)).alias("lent"))
    first = heads.select("conv_id", F.inline_outer("lent"))
    # Own turns keep their order behind the borrowed ones; numbers needn't be without gaps.
    rest = own.where("pos > h").select("conv_id", (F.col("pos") + prefixes).alias("pos"), "turn", "size")
    return first.unionByName(rest)


def paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, path): turns in order, as an array of (turn, size)."""
    step = F.when(F.col("pos").isNotNull(), F.struct("pos", "turn", "size"))
    sorted_ = F.array_sort(F.collect_list(step))
    return rebuilt.groupBy("conv_id").agg(F.transform(sorted_, lambda x: F.struct(x["turn"].alias("turn"), x["size"].alias("size"))).alias("path"))


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """df in the order of keys over all partitions, with (place, row): partition and number within it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id())
    # As checkpointed, the ranges can't come out otherwise later.
    return cut(rows).withColumn("place", F.shiftright("row", 33)).withColumn("row", F.col("row").bitwiseAND((1 << 33) - 1))


def _before(totals: DataFrame, *sums: str) -> DataFrame:
    """totals (place, ...): of each partition what those before it sum to. One row for each partition."""
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("place", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums)))


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """df with its rank in the order of keys, from 0, without a window over all rows."""
    rows = _ordered(df, *keys)
    before = _before(rows.groupBy("place").agg(F.count("*").alias("n")), "n")
    return rows.join(before, "place").withColumn("rank", F.col("n_before") + F.col("row")).drop("place", "row", "n_before")


def _steps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ranked paths (rank, n, least, path) a row for each prefix: (node, parent, depth, size, rank, n, least, own)."""
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["node", "parent", "depth", "size", "rank", "n", "least", "own"]
    for batch in parts:
        rank, n, least, path = (batch.column(i) for i in range(4))
        rank, n, least = (x.to_pylist() for x in (rank, n, least))
        for a in range(batch.num_rows):
            turns, sizes = path[a].values.field("turn"), path[a].values.field("size")
            turns, sizes, node = turns.to_pylist(), sizes.to_pylist(), ROOT
            rows = [(node, None, 0, 0, rank[a], n[a], least[a], n[a] if not turns else 0)]
            for depth, (turn, size) in enumerate(zip(turns, sizes, strict=True), 1):
                parent, node = node, hashlib.md5(node + turn).digest()
                rows.append((node, parent, depth, size, rank[a], n[a], least[a], n[a] if depth == len(turns) else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def nodes(distinct: DataFrame) -> DataFrame:
    """(node, parent, depth, size, first, last, n_convs, conv_id, own) of distinct ranked paths (rank, n, least, path)."""
    kinds = "node binary, parent binary, depth long, size long, rank long, n long, least long, own long"
    steps = distinct.select("rank", "n", "least", "path").mapInArrow(_steps, kinds)
    sums = F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("own").alias("own"), F.min("rank").alias("first"), F.max("rank").alias("last")
    return steps.groupBy("node", "parent", "depth", "size").agg(*sums)


def _running(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one ordered partition with the running sums of their last two columns in place of these."""
    leaves = saved = 0
    for batch in parts:
        sums = [np.cumsum(batch.column(i).to_numpy()) for i in (-2, -1)] if batch.num_rows else [np.array([], np.int64)] * 2
        columns = [pa.array(sums[0] + leaves), pa.array(sums[1] + saved)]
        if batch.num_rows:
            leaves, saved = leaves + int(sums[0][-1]), saved + int(sums[1][-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], batch.schema.names)


def measured(found: DataFrame) -> DataFrame:
    """nodes() with parent_conv_id, n_children, n_leaves and saved_tokens."""
    children = found.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    tree = found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf, saving = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    tree = _ordered(tree.withColumns({"leaf": leaf, "saving": saving}), "first", "depth")
    before = _before(tree.groupBy("place").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving")), "leaf", "saving")
    # Rows keep the partition and the order they were checkpointed in, so a task sees its range from start to end.
    rows = tree.withColumns({"leaves": F.col("leaf"), "savings": F.col("saving")})
    rows = rows.mapInArrow(_running, rows.schema).join(before, "place")
    rows = rows.withColumns({"leaves": F.col("leaves") + F.col("leaf_before"), "savings": F.col("savings") + F.col("saving_before")})
    rows = cut(rows.drop("place", "row", "leaf_before", "saving_before"))
    # Where a subtree ends: the node of a whole path, whose first rank is that path's.
    stops = rows.where("own > 0").select(F.col("first").alias("last"), F.col("leaves").alias("leaves_end"), F.col("savings").alias("savings_end"))
    rows = rows.join(stops, "last")
    up = rows.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = rows.join(up, "parent", "left")
    leaves = F.col("leaves_end") - F.col("leaves") + F.col("leaf")
    saved = F.col("savings_end") - F.col("savings") + F.col("saving")
    return rows.select("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "own")


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, conv_id) in order: (node, first, ids), ids joined by commas, up to RUN_BYTES at a time."""
    held, begin, ids, size = None, None, [], 0
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])

    for part in parts:
        for node, conv_id in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if ids and (node != held or size > RUN_BYTES):
                out.append((held, begin, ",".join(ids)))
                ids = []
            if not ids:
                held, begin, size = node, conv_id, 0
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield batch()
            out.clear()
    if ids:
        out.append((held, begin, ",".join(ids)))
    if out:
        yield batch()


def _hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, first, ids) in order: (node, ends_sha256)."""
    held, state, out = None, None, []
    for part in parts:
        for node, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
            if node != held:
                if state:
                    out.append((held, state.hexdigest()))
                held, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])
            out = []
    if state:
        out.append((held, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["node", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): SHA-256 of each node's decimal ids, ascending, joined by commas."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_runs, "node binary, first long, ids string")
    return runs.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def _last_node(path: Column) -> Column:
    """The node of a whole path, as _steps names it."""
    return F.aggregate(path, F.lit(bytearray(ROOT)), lambda a, x: F.unhex(F.md5(F.concat(a, x["turn"]))))


def build(rebuilt: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, pos, turn, size): a row for each node, with its digest `node`."""
    each = cut(paths(rebuilt))
    distinct = each.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    tree = measured(cut(nodes(ranked(distinct, "path"))))
    ends = end_hashes(each.select(_last_node(F.col("path")).alias("node"), "conv_id"))
    rows = tree.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return rows.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
