r"""N-gram Jaccard join: prefixes with token combinations, then verification.

Words are `[^\x20\x09-\x0D]+` with A-Z lower-cased, a token is the 64-bit hash of a run of five words. Documents link
when 100 * intersection >= 80 * union of their token sets. The join returns one row per document with its class.

1. Documents of one set are one node. A document that holds more tokens of its own than a link allows errors can't link:
   that is counted on a fixed third of the hash space, which only ever keeps too many.
2. Among the rest, tokens are ordered by document frequency. A node's prefix is extended until a link must share either a
   token of at most RARE documents in it, which is indexed alone, or two frequent tokens of the same cell, which are
   indexed as a combination (cells: hash buckets, their number set by the size class; see `signatures`).
3. Documents sharing a signature are candidates. Each signature's documents are first held against one head, linked ones
   become a class, and only pairs of different classes go on, so a group of copies isn't expanded into its pairs.
   Every candidate pair that classes don't already connect is verified by exact intersection of its token sets.
4. Documents of different classes that meet in signatures of more than HEAVY documents sign again with the tokens of
   their shortest prefix: these are their most seldom ones, so documents that share a common passage but not its
   surroundings part. (Combinations of three and four tokens need longer prefixes, which reach further into such a
   passage, and part less.) What still meets in heavy signatures is compared block by block, so nothing is lost.

Nothing is capped: memory per task is bounded by single documents; a hot signature's rows are dealt to tasks of DEAL
documents, hot tokens are combined before each shuffle. Tokens and sets have 64-bit hashes without fixed collisions
(`textnum`): of N different sets some two meet with odds of about N**2 / 2**65, 3e-8 at 1e6 documents.

Defined results: null, empty and blank texts have no tokens, n_shingles 0 and link with nothing; rows that repeat a
doc_id and text are one node; rows that share only a doc_id stay apart but both carry their own class; null doc_ids are
never a component_id unless a class has no other; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import cut, fewer, release, salted_join, small_side, text_batches
from .components import components

WIDTH = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens of at most so many documents are indexed alone.
RARE = 8
#: Part of the hash space on which a document's own tokens are counted.
PART = 1 / 3
#: Ratio of size classes; sizes of linked documents differ by no more.
CLASS = 1.25
#: Frequent tokens are dealt to about this many cells for each token of a document.
CELLS = 0.1


def errors(n: Column) -> Column:
    """Tokens of a set of n that a linked document may lack: n - ceil(0.8 n)."""
    return n - F.floor((n * PERCENT + 99) / 100).cast("int")


def linked(n_a: Column, n_b: Column, common: Column) -> Column:
    return common * (100 + PERCENT) >= (n_a + n_b) * PERCENT


def _sets(texts: list, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, token set) of each text."""
    at = 0
    for group in textnum.batches(texts):
        words, bounds = textnum.word_hashes(group)
        for i in range(len(group)):
            yield at, textnum.shingles(words[bounds[i] : bounds[i + 1]], width)
            at += 1


def _node(tokens: np.ndarray) -> int:
    total = (int(np.add.reduce(tokens)) + len(tokens) * 0xC2B2AE3D27D4EB4F) % 2**64
    return int(textnum.mix64(np.array([total], np.uint64)).view(np.int64)[0])


def membership(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, node, __nj_text) of each row; node, the hash of the set, is null without tokens; __nj_text tells rows of one doc_id apart."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, node = [], []
            for _, tokens in _sets(part.column(1).to_pylist(), width):
                n.append(len(tokens))
                node.append(_node(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(node, pa.int64()), part.column(2)], ["doc_id", "n", "node", "__nj_text"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__nj_text")).mapInArrow(run, "doc_id long, n int, node long, __nj_text long")


def tokens(docs: DataFrame, width: int = WIDTH, part: float = 1.0) -> DataFrame:
    """(token, node) for each text's tokens in the first `part` of the hash space."""
    last = np.uint64(min(int(part * 2**64), 2**64 - 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found, nodes, size = [], [], 0
            for _, own in _sets(batch.column(0).to_pylist(), width):
                if len(own):
                    kept = own[: np.searchsorted(own, last, "right")]
                    found.append(kept)
                    nodes.append(np.full(len(kept), _node(own)))
                    size += len(kept)
                if size > 200_000:
                    yield _pairs(found, nodes)
                    found, nodes, size = [], [], 0
            if size:
                yield _pairs(found, nodes)

    return docs.select("text").mapInArrow(run, "token long, node long")


def _pairs(found: list, nodes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])


def survivors(docs: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, n, rep) of the nodes that can have a link; rep is the smallest doc_id of the node."""
    nodes = rows.where("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep"))
    # A token is a node's own if the smallest and the largest node that hold it are the same.
    own = tokens(docs, width, PART).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    return nodes.join(own, "node", "left").where(F.coalesce("own", F.lit(0)) <= errors(F.col("n"))).select("node", "n", "rep")


def shared_tokens(docs: DataFrame, kept: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, n, tokens: array of struct<df, token>): what each surviving node shares with others, most seldom first."""
    side, _ = small_side(kept, 24)
    texts = docs.select("doc_id", "text").join(side, docs["doc_id"].eqNullSafe(side["rep"])).select("text")
    every = tokens(texts, width)
    often = every.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("df")).where("a != b").select("token", F.col("df").cast("int"))
    lists = every.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("tokens"))
    return kept.select("node", "n").join(lists, "node").where((F.col("n") - F.size("tokens")) <= errors(F.col("n")))


def size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(CLASS) + 1e-9))


def signatures(df: np.ndarray, token: np.ndarray, n: int, k: int = 2) -> np.ndarray:
    """Signatures of a set of n tokens whose shared ones are given, most seldom first.

    n - len(token) tokens are the set's own; of the first `missing` shared tokens a linked set must hold one. For k = 1
    these are the signatures, and for k = 2 as well if they are rare. Else all rare ones are, and the prefix goes on over
    frequent tokens until, with one token of each cell allowed to be common without a signature, still `missing` are
    covered: then a linked set must share two of a cell. Cells depend on the size class; a set signs for its own class
    and the next, so that any two sets whose sizes differ by no more than a class meet in one.
    """
    if n < 2:
        return np.empty(0, np.uint64)
    missing = n - (n * PERCENT + 99) // 100 + 1 - (n - len(token))
    rare = int(np.searchsorted(df, RARE, "right"))
    if k == 1 or rare >= missing:
        return token[:missing]
    out = [token[:rare]]
    often, left = token[rare:], missing - rare
    own = size_class(n)
    for size in (own, own + 1):
        cells = max(1, int(CELLS * CLASS**size))
        cell = often % np.uint64(cells)
        first = np.zeros(len(often), bool)
        first[np.unique(cell, return_index=True)[1]] = True
        covered = np.cumsum(~first)
        end = int(np.searchsorted(covered, left)) + 1
        order = np.argsort(cell[:end], kind="stable")
        sorted_cell, sorted_token = cell[:end][order], often[:end][order]
        for gap in range(1, end):
            same = sorted_cell[gap:] == sorted_cell[:-gap]
            if not same.any():
                break
            a, b = sorted_token[:-gap][same], sorted_token[gap:][same]
            out.append(textnum.mix64(textnum.mix64(a + np.uint64(size)) * np.uint64(0x9FB21C651E98DF25) + b))
    return np.unique(np.concatenate(out))


def signed(lists: DataFrame, k: int = 2) -> DataFrame:
    """(sig, node, n, s): each node's signatures; s is how many tokens it shares with others."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            node, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            arrays = part.column(2)
            bounds = arrays.offsets.to_numpy()
            df, token = arrays.values.field("df").to_numpy(), arrays.values.field("token").to_numpy().view(np.uint64)
            sigs = [signatures(df[a:b], token[a:b], int(m), k) for a, b, m in zip(bounds[:-1], bounds[1:], n, strict=True)]
            many = [len(x) for x in sigs]
            if sum(many):
                columns = [np.concatenate(sigs).view(np.int64), np.repeat(node, many), np.repeat(n, many), np.repeat(np.diff(bounds).astype(np.int32), many)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "node", "n", "s"])

    return lists.mapInArrow(run, "sig long, node long, n int, s int")


def verified(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, by exact intersection of their shared tokens.

    b first: it hardly repeats, and a hot a then meets the lists in a join whose skew adaptive execution can split.
    """
    one = lists.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.transform("tokens", lambda t: t["token"]).alias("t_a"))
    two = lists.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.transform("tokens", lambda t: t["token"]).alias("t_b"))
    rows = pairs.select("a", "b").join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return rows.where(linked(F.col("n_a"), F.col("n_b"), common)).select("a", "b")


def _possible(n_a: str, s_a: str, n_b: str, s_b: str) -> Column:
    return linked(F.col(n_a), F.col(n_b), F.least(s_a, s_b))


#: Tokens of a combination, and rounds of holding each signature's documents against a head before the rest of the pairs
#: of different classes is taken: first for all documents, then for those that still meet in heavy signatures.
LEVELS = ((2, 2), (1, 1))
#: Open signatures of more documents than this sign again or are taken block by block rather than as a list of pairs.
HEAVY = 64
#: Documents of a signature that one task takes.
DEAL = 256
#: Documents of a block, about.
BLOCK = 512


def _dealt(rows: DataFrame, per_sig: DataFrame) -> DataFrame:
    """rows (sig, node, parts, ..) joined to per_sig (sig, parts, ..: a row for each signature): a hot one is dealt to `parts` tasks."""
    side = per_sig.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(side, ["sig", "deal"]).drop("deal")


def _posts(lists: DataFrame, k: int) -> tuple[DataFrame, int]:
    """((sig, node, n, s, parts) of the signatures that several nodes have, their number)."""
    every = signed(lists, k)
    often = every.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("c")).where("x != y")
    posts = cut(every.join(often.select("sig", F.ceil(F.col("c") / DEAL).cast("int").alias("parts")), "sig"))
    return posts, posts.count()


def _star(rows: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """(a, b): links of documents with heads; each b has at most one a, and a comes before b in the order of the turn."""
    # First heads: those with the fewest tokens of their own, as what copies were made from has.
    own = (F.col("n") - F.col("s")) / F.col("n") if turn == 0 else F.lit(0.0)
    key = F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("k"), "node", "n", "s", "label")
    heads = rows.groupBy("sig").agg(F.max("parts").alias("parts"), F.min(key).alias("h"))
    heads = heads.select("sig", "parts", F.col("h.node").alias("a"), F.col("h.n").alias("n_a"), F.col("h.s").alias("s_a"), F.col("h.label").alias("label_a"))
    star = _dealt(rows, heads).where((F.col("label") != F.col("label_a")) & _possible("n", "s", "n_a", "s_a"))
    star = star.groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("c"))
    # Of its heads, each document is held against the one it shares most signatures with.
    best = star.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    return verified(best, lists)


def _climbed(links: DataFrame) -> DataFrame:
    """(node, label): the head of each b, two steps further up where heads have heads of their own."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    above = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
    side, small = small_side(above, 16)
    for _ in range(2):
        found = up.join(side, "label", "left") if small else salted_join(up, above, "label")
        up = found.select("node", F.coalesce("top", "label").alias("label"))
    return up


def classes(lists: DataFrame) -> DataFrame:
    """(node, label) for nodes with links."""
    labels, found, rest, turn = None, None, lists, 0
    for level, (k, turns) in enumerate(LEVELS):
        posts, n = _posts(rest, k)
        few = lambda df, n=n: cut(fewer(df, n, 20_000))  # noqa: E731  everything below is smaller than posts
        for last in range(turns):
            rows = posts.withColumn("label", F.col("node")) if labels is None else few(_open(posts, labels))
            links = few(_star(rows, rest, turn))
            found = links if found is None else found.union(links)
            # At first a step or two up to the heads is enough to tell which signatures are open.
            labels = few(_climbed(links)) if turn == 0 and last < turns - 1 else few(components(found, "a", "b"))
            turn += 1
        release(lists.sparkSession)
        rows = few(_open(posts, labels))
        sizes = rows.groupBy("sig").agg(F.count("*").alias("c"), F.max("parts").alias("parts"))
        rows = few(_dealt(rows, sizes).withColumn("parts", F.ceil(F.col("c") / DEAL).cast("int")))
        if not rows.limit(1).count():
            return labels
        found = found.union(few(verified(_listed(rows.where(F.col("c") <= HEAVY)), rest)))
        heavy = few(rows.where(F.col("c") > HEAVY))
        if not heavy.limit(1).count():
            break
        if level < len(LEVELS) - 1:
            rest = cut(rest.join(heavy.select("node").distinct(), "node", "left_semi"))
        else:
            found = found.union(few(_by_blocks(heavy, rest)))
    return cut(components(found, "a", "b"))


def _listed(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs of different classes that share one of the signatures, each of at most HEAVY documents."""
    ends = rows.select("sig", "label").distinct()
    crossed = ends.join(ends.withColumnRenamed("label", "label_b"), "sig").where("label < label_b")
    left = crossed.join(rows.select("sig", "label", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("s").alias("s_x")), ["sig", "label"])
    both = left.join(rows.select("sig", F.col("label").alias("label_b"), F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("s").alias("s_y")), ["sig", "label_b"])
    return both.where(_possible("n_x", "s_x", "n_y", "s_y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _by_blocks(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b): links between different classes among the documents that heavy signatures connect.

    Documents connected by heavy signatures form groups; a group is dealt to blocks by size class and hash, and every
    two blocks of neighbouring classes are one task's work: exact intersections by matrix product, of which only links
    that connect something new leave the task.
    """
    # Documents and signatures are the two kinds of ends of this graph.
    end = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("id"))
    group = components(rows.select(end(0, "node").alias("src"), end(1, "sig").alias("dst")))
    group = group.where("node.kind = 0").select(F.col("node.id").alias("node"), F.col("label.id").alias("g"))
    nodes = rows.select("node", "n", "label").distinct().join(group, "node")
    nodes = nodes.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / float(np.log(CLASS)) + 1e-9).cast("int"))
    counts = nodes.groupBy("g", "k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    nodes = cut(nodes.join(counts, ["g", "k"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    blocks = nodes.select("g", "k", "i").distinct()
    other = blocks.select("g", F.col("k").alias("k2"), F.col("i").alias("i2"))
    duels = cut(blocks.join(other, "g").where("(k2 = k and i2 >= i) or k2 = k + 1"))
    full = cut(nodes.join(lists.select("node", F.transform("tokens", lambda t: t["token"]).alias("t")), "node").select("g", "k", "i", "node", "n", "label", "t"))
    keys, columns = ["g", "k", "i", "k2", "i2"], ["node", "n", "label", "t"]
    left = full.join(duels, ["g", "k", "i"]).select(*keys, *columns)
    other = full.select(F.col("g").alias("g_"), F.col("k").alias("k2_"), F.col("i").alias("i2_"), *[F.col(c).alias(f"{c}_") for c in columns])
    met = duels.select(*[F.col(c).alias(f"{c}_") for c in keys])
    right = other.join(met, ["g_", "k2_", "i2_"]).select(*[f"{c}_" for c in keys], *[f"{c}_" for c in columns])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = _connecting(one, two.rename_columns(one.column_names)) if len(one) and len(two) else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"{c}_" for c in keys])).applyInArrow(run, "a long, b long")


def _incidence(table: pa.Table, tokens: np.ndarray) -> np.ndarray:
    """Rows of table by tokens: 1 where a row holds the token."""
    column = table.column("t").combine_chunks()
    values, bounds = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(column).to_numpy())))
    at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
    hit = tokens[at] == values
    out = np.zeros((len(table), len(tokens)), np.float32)
    out[np.repeat(np.arange(len(table)), np.diff(bounds))[hit], at[hit]] = 1
    return out


def _connecting(one: pa.Table, two: pa.Table) -> tuple[list[int], list[int]]:
    """Links between rows of one and two of different labels, as few as connect what all of them connect."""
    held = [np.unique(t.column("t").combine_chunks().flatten().to_numpy()) for t in (one, two)]
    tokens = np.intersect1d(*held, assume_unique=True)
    common = np.zeros((len(one), len(two)))
    for a in range(0, len(tokens), 8192):
        part = tokens[a : a + 8192]
        common += _incidence(one, part) @ _incidence(two, part).T
    n_a, n_b = one.column("n").to_numpy().astype(np.int64), two.column("n").to_numpy().astype(np.int64)
    l_a, l_b = one.column("label").to_numpy(), two.column("label").to_numpy()
    link = (common * (100 + PERCENT) >= (n_a[:, None] + n_b) * PERCENT) & (l_a[:, None] != l_b)
    node_a, node_b = one.column("node").to_numpy(), two.column("node").to_numpy()
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out_a, out_b = [], []
    for i in np.flatnonzero(link.any(1)):
        where = np.flatnonzero(link[i])
        # One link to each class is enough.
        for j in where[np.unique(l_b[where], return_index=True)[1]]:
            x, y = find(int(l_a[i])), find(int(l_b[j]))
            if x != y:
                parent[x] = y
                out_a.append(int(node_a[i]))
                out_b.append(int(node_b[j]))
    return out_a, out_b


def _open(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """posts with their class, of the signatures whose documents aren't all in one class."""
    side, _ = small_side(labels, 16)
    rows = posts.join(side, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = rows.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("parts").alias("parts")).where("x != y").select("sig", "parts")
    return _dealt(rows, split)


def join(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (columns doc_id and text are read)."""
    return _classed(docs, width).drop("__nj_text")


def _classed(docs: DataFrame, width: int) -> DataFrame:
    """As join, with __nj_text."""
    docs = docs.select("doc_id", "text")
    text_batches(docs.sparkSession)
    rows = cut(membership(docs, width))
    kept = cut(survivors(docs, rows, width))
    release(docs.sparkSession)
    lists = cut(shared_tokens(docs, kept, width))
    release(docs.sparkSession)
    labels = classes(lists)
    release(docs.sparkSession)
    side, _ = small_side(labels, 32)
    rows = rows.join(side, "node", "left").withColumn("class", F.coalesce("label", "node"))
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "class", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "__nj_text")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with one document of each class: the one of smallest doc_id; rows without tokens and with null ids stay."""
    found = cut(_classed(docs, width))
    dropped = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias("__nj_id"), "__nj_text").distinct())
    twice = cut(found.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select(F.col("doc_id").alias("__nj_id")))
    side, _ = small_side(dropped, 32)
    rows = docs.join(side, (docs["doc_id"] == side["__nj_id"]) & (F.xxhash64(docs["text"]) == side["__nj_text"]), "left_anti")
    if not twice.limit(1).count():
        return rows
    again, _ = small_side(twice, 16)
    # Rows that repeat an id: one of each id and text.
    once = rows.join(again, rows["doc_id"] == again["__nj_id"], "left_anti")
    more = rows.join(again, rows["doc_id"] == again["__nj_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more)
