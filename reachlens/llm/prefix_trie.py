"""Conversation prefix trie, rolled up by centroid decomposition.

Conversations that begin alike share the nodes of a trie: a node is a distinct sequence of
first turns. A prefix is known by two 64-bit words, the exclusive or of hashes of its turns
and their places, so that prefixes of a conversation of any length come from sums of parts and
the key of the parent is the key without the last turn. One aggregation makes the nodes; it
also gives each node the number of turns that its members have from there on, its weight.

Totals over subtrees come from the centroid decomposition of the parent-edge forest. Removing
the centroid of a component (the deepest node with more than half of it below) leaves
components of at most half the size; what lies at and below the centroid is added to it and to
every node on the path from it up to the top of its component, and the parts go on alike. It
takes a logarithmic number of rounds, however deep the trie is.

* Subtrees of at most ``most`` turns are components of their own, dealt out to tasks and
  decomposed there in numpy (:func:`subtree_totals`), many at a time.
* The nodes above them form the upper forest, with the totals of those subtrees as values of
  the nodes they hang from. While a component of it has more than ``most`` nodes, rounds of
  joins split it at its centroid; what is left is again decomposed inside tasks.

A node's members that end there are ordered by ranges of (node, conversation), joined into
bounded texts, and hashed as a stream.

Defined results: null role and text are empty; turns of a conversation are ordered by turn
(nulls first), then role and text in code-point order; repeated rows are turns each; rows
without a conversation id belong to no conversation and are left out; an empty table gives no
nodes, not even a root; columns besides the four are not read, whatever their names. Texts are
only hashed and measured where they are read. Prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reachlens.llm.ordering import numbered, whole_groups
from reachlens.operators.common import left_join_unique
from reachlens.sources.shared import written

_BLOCK = 1024  # turns whose prefixes one window adds up
_CHUNK_IDS = 1 << 14
NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, t1, t2, bytes``: every turn with its place, hashed and measured."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "*", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    cuts = [*order[:2], F.substring("text", 1, 32)]
    return numbered(rows, "conv_id", order, cuts, ["t1", "t2", "bytes"])


def _opening(conv: Column) -> Column:
    """How many first turns a conversation takes from the one it is rebuilt on."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: conversation c has the first h turns of conversation
    c - c % 5 (h is the CRC-32 of c in decimal, modulo 9) and then its own after its first h.

    Gives the turns ``conv_id, depth, length, t1, t2, bytes`` and the conversations ``conv_id,
    length``, also those without a turn.
    """
    lengths = placed.groupBy("conv_id").agg(F.max("place").alias("own"))
    lengths = lengths.select("conv_id", "own", _opening(F.col("conv_id")).alias("h"), F.expr("conv_id - conv_id % 5").alias("base"))
    bases = lengths.filter("conv_id % 5 = 0").select("base", F.col("own").alias("base_own"))
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    members = written(left_join_unique(lengths, bases, [("base", "base")]).select(
        "conv_id", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "members")
    own = left_join_unique(placed, members, [("conv_id", "conv_id")]).filter("place > h").select(
        "conv_id", F.expr("taken + place - h").alias("depth"), "length", "t1", "t2", "bytes")
    # The first eight turns of a base go to the (at most nine) ids that are rebuilt on it.
    near = "filter(transform(sequence(-4, 4), i -> try_add(conv_id, CAST(i AS BIGINT))), c -> c - c % 5 = conv_id)"
    given = placed.filter("conv_id % 5 = 0 AND place <= 8").select(F.explode(F.expr(near)).alias("c"), "place", "t1", "t2", "bytes")
    borrowed = given.filter(F.col("place") <= _opening(F.col("c"))).join(members, F.col("c") == F.col("conv_id")).select(
        "conv_id", F.col("place").alias("depth"), "length", "t1", "t2", "bytes")
    return own.unionByName(borrowed), members.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, length, bytes``, the key ``k1, k2`` of the prefix that ends with the
    turn, and that of the prefix before, ``p1, p2``."""
    marked = rows.select(
        "conv_id", "depth", "length", "bytes", F.expr(f"depth DIV {_BLOCK}").alias("block"),
        F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("e1"), F.xxhash64(F.lit(2), "depth", "t2", "t1").alias("e2"))
    marked = written(marked, "turns")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = marked.select("*", F.bit_xor("e1").over(inside).alias("k1"), F.bit_xor("e2").over(inside).alias("k2"))
    # Only conversations of more than a block have earlier blocks: a row for each thousand turns.
    blocks = marked.filter(f"length >= {_BLOCK}").groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", F.bit_xor("x1").over(earlier).alias("x1"), F.bit_xor("x2").over(earlier).alias("x2")).filter("block > 0")
    whole = keyed.join(before, ["conv_id", "block"], "left").select(
        "conv_id", "depth", "length", "bytes", "e1", "e2",
        *[F.col(f"k{i}").bitwiseXOR(F.coalesce(f"x{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)])
    return whole.select(
        "conv_id", "depth", "length", "bytes", "k1", "k2",
        *[F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)])


def subtree_totals(parent: np.ndarray, level: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` over the subtree of each node of a forest.

    ``parent`` is the index of the parent (-1: a top), ``level`` grows by one from parent to
    child, and nodes come in order of level. Components are split at their centroids, all
    components of the forest together.
    """
    n = len(parent)
    size, order = np.ones(n, np.int64), np.searchsorted(level, np.arange(level[0], level[-1] + 2)) if n else []
    for low, high in zip(order[-2::-1], order[:0:-1]):
        inner = np.arange(low, high)[parent[low:high] >= 0]
        np.add.at(size, parent[inner], size[inner])
    up = np.where(parent < 0, np.arange(n), parent)  # inside its component; a top leads to itself
    top, live, totals = _ends(up, np.arange(n)), np.arange(n), np.zeros_like(values)
    while len(live):
        centroid = np.full(n, -1)
        heavy = live[2 * size[live] > size[top[live]]]
        np.maximum.at(centroid, top[heavy], heavy)  # a path down from the top: the last is the deepest
        own = centroid[top[live]]
        removed = np.zeros(n, bool)
        removed[own] = True
        # Nodes on the way from the centroid to the top of its component.
        above, hop = removed.copy(), up.copy()
        while True:
            marked = live[above[live]]
            more = hop[marked][~above[hop[marked]]]
            if not len(more):
                break
            above[more] = True
            hop[live] = hop[hop[live]]
        # Its children become tops.
        rest = live[~removed[live]]
        cut = rest[removed[up[rest]]]
        up[cut] = cut
        old_top = top[rest]
        top[rest] = _ends(up, rest)
        part = np.zeros_like(values)
        np.add.at(part, top[rest], values[rest])
        below = np.zeros_like(values)
        centroids = np.flatnonzero(removed)
        below[centroids] = values[centroids]
        np.add.at(below, parent[cut], part[cut])
        totals[centroids] += below[centroids]
        path = above[rest]
        totals[rest[path]] += below[centroid[old_top[path]]]
        size[rest[path]] -= size[centroid[old_top[path]]]
        live = rest
    return totals


def _ends(up: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where pointers lead in the end, by doubling their reach."""
    hop = up.copy()
    while True:
        further = hop[hop[of]]
        if np.array_equal(further, hop[of]):
            return further
        hop[of] = further


_NODE = ("conv_id", "depth", "parent_conv_id")


def in_tasks(forest: DataFrame, measures: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Subtree totals of components ``top_conv, top_depth`` that each fit a task: the node, its
    component, ``kept``, the sum of each measure over its subtree in the component, and ``inner``,
    its children there."""
    names = [*_NODE, "top_conv", "top_depth", *kept, *measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["top_conv", "top_depth"]):
            table = table.sort_by("depth")
            conv, depth, parent_conv, top_conv, top_depth = (table[c].to_numpy() for c in names[:5])
            convs, at = np.unique(conv, return_inverse=True)
            width = int(depth[-1]) + 2
            place = at * width + depth
            order = np.argsort(place)
            inner = np.flatnonzero((conv != top_conv) | (depth != top_depth))
            parent = np.full(len(conv), -1)
            wanted = np.searchsorted(convs, parent_conv[inner].astype(np.int64)) * width + depth[inner] - 1
            parent[inner] = order[np.searchsorted(place, wanted, sorter=order)]
            totals = subtree_totals(parent, depth, np.stack([table[m].to_numpy() for m in measures], 1).astype(np.int64))
            for i, m in enumerate(measures):
                table = table.set_column(names.index(m), m, pa.array(totals[:, i]))
            table = table.append_column("inner", pa.array(np.bincount(parent[inner], minlength=len(conv)).astype(np.int64)))
            yield from table.to_batches(max_chunksize=1 << 16)

    schema = ", ".join(f"{c} long" for c in [*names, "inner"])
    dealt = forest.select(*[F.col(c).cast("long").alias(c) for c in names]).repartition("top_conv", "top_depth")
    return dealt.sortWithinPartitions("top_conv", "top_depth").mapInArrow(run, schema)


def split_at_centroids(forest: DataFrame, paths: DataFrame, measures: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rounds over components of more than ``most`` nodes.

    ``forest`` has the node, its component ``top_conv, top_depth`` and its ``weight``, which
    is its own and all below it in the component; ``paths`` says for a conversation and a depth
    which node its prefix is (``at_conv``). Gives the forest of small components with what is
    owed to each node so far in ``owed_<measure>``, and the totals of the removed centroids.
    """
    state = forest.select("*", *[F.lit(0).cast("long").alias(f"owed_{m}") for m in measures])
    columns, done = state.columns, None
    comp = ["top_conv", "top_depth"]
    while True:
        sizes = state.groupBy(*comp).agg(F.count("*").alias("nodes"), F.max(F.expr("CASE WHEN depth = top_depth THEN weight END")).alias("all"))
        large = sizes.filter(F.col("nodes") > most)
        if large.isEmpty():
            return state, done
        inside = left_join_unique(state, large, [(c, c) for c in comp]).filter("nodes IS NOT NULL")
        deepest = inside.filter("2 * weight > all").groupBy(*comp).agg(
            F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("c"))
        deepest = deepest.select(*comp, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
        marked = left_join_unique(state, deepest, [(c, c) for c in comp])
        # Below the centroid: the node's own path passes it, and the next node on it is the new top.
        lookup = lambda name: paths.select(F.col("conv_id").alias("l_conv"), F.col("depth").alias("l_depth"), F.col("at_conv").alias(name))
        marked = left_join_unique(marked, lookup("own_at"), [("conv_id", "l_conv"), ("c_depth", "l_depth")])
        marked = left_join_unique(marked.withColumn("next_depth", F.expr("c_depth + 1")), lookup("next_at"), [("conv_id", "l_conv"), ("next_depth", "l_depth")])
        # Above it: the centroid's path passes the node.
        marked = left_join_unique(marked, lookup("path_at"), [("c_conv", "l_conv"), ("depth", "l_depth")])
        marked = written(marked.select(
            *columns, "c_conv", "c_depth", "c_weight", "next_at",
            F.expr("coalesce(depth >= c_depth AND own_at = c_conv, false)").alias("below"),
            F.expr("coalesce(depth < c_depth AND path_at = conv_id, false)").alias("above")), "round")
        sums = marked.filter("below").groupBy(*comp).agg(*[F.sum(m).alias(f"sum_{m}") for m in measures])
        owing = left_join_unique(marked, sums, [(c, c) for c in comp])
        gets = F.expr("above OR (below AND depth = c_depth)")
        owing = owing.select(
            *[c for c in columns if c not in (*comp, "weight", *(f"owed_{m}" for m in measures))],
            F.expr("CASE WHEN below AND depth > c_depth THEN next_at ELSE top_conv END").alias("top_conv"),
            F.expr("CASE WHEN below AND depth > c_depth THEN c_depth + 1 ELSE top_depth END").alias("top_depth"),
            F.expr("CASE WHEN above THEN weight - c_weight ELSE weight END").alias("weight"),
            *[F.expr(f"owed_{m}").__add__(F.when(gets, F.col(f"sum_{m}")).otherwise(0)).alias(f"owed_{m}") for m in measures],
            F.expr("below AND depth = c_depth").alias("centroid"))
        owing = written(owing, "round")
        found = owing.filter("centroid").select(*columns)
        done = found if done is None else done.unionByName(found)
        state = owing.filter("NOT centroid").select(*columns)


def ends(members: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: of each node, the hash of the ids (``member``) that end there."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            new = np.append(True, (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1]))
            starts = np.flatnonzero(new)
            starts = np.unique(np.concatenate([np.arange(a, b, _CHUNK_IDS) for a, b in zip(starts, [*starts[1:], len(conv)])])) if len(conv) > _CHUNK_IDS else starts
            ids = list(map(str, member.tolist()))
            texts = [",".join(ids[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)])]
            yield pa.record_batch([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array(texts, pa.string())], ["conv_id", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (conv, depth) == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = (conv, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done)], ["conv_id", "depth", "ends_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([x]) for x in (*last, digest.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    key = ["conv_id", "depth", "member"]
    dealt = members.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    chunks = dealt.mapInArrow(joined, "conv_id long, depth long, first long, ids string")
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame, most: int = 1 << 16) -> DataFrame:
    """All nodes over the turns and conversations that :func:`rebuilt` gives; see ``COLUMNS``."""
    paths = written(prefixes(rows), "paths")
    made = paths.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.first("bytes").alias("bytes"), F.sum(F.expr("length - depth + 1")).alias("weight"), F.max("length").alias("longest"))
    root = members.agg(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"),
        F.lit(0).cast("long").alias("bytes"), F.sum(F.expr("length + 1")).alias("weight"), F.max("length").alias("longest")).filter("conv_id IS NOT NULL")
    nodes = written(made.unionByName(root), "nodes")
    # The node of every prefix of every conversation, and of every conversation's parent.
    known = nodes.select(F.col("depth").alias("n_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("conv_id").alias("at_conv"), "weight")
    on = lambda depth, a, b: [(depth, "n_depth"), (a, "n1"), (b, "n2")]
    located = written(left_join_unique(paths.select("conv_id", "depth", "length", "k1", "k2"), known, on("depth", "k1", "k2")).drop("k1", "k2"), "located")
    first_small = located.filter(F.col("weight") <= most).groupBy(F.col("conv_id").alias("owner")).agg(F.min(F.struct("depth", "at_conv")).alias("t"))
    parents = known.drop("weight").withColumnRenamed("at_conv", "parent_conv_id")
    placed = left_join_unique(nodes.withColumn("up", F.expr("depth - 1")), parents, on("up", "p1", "p2"))
    placed = left_join_unique(placed, first_small, [("conv_id", "owner")])
    # The root, one row: the node of all conversations, whose weight is that of all turns.
    top, all_weight = nodes.filter("depth = 0").agg(F.min("conv_id"), F.min("weight")).first()
    all_small = (all_weight or 0) <= most
    forest = written(placed.select(
        *_NODE, "n_convs", "weight", F.expr("CAST(longest = depth AS BIGINT)").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        # If the whole is small, the root is the top of all.
        (F.lit(top).cast("long") if all_small else F.expr(f"CASE WHEN weight <= {most} THEN t.at_conv END")).alias("top_conv"),
        (F.lit(0).cast("long") if all_small else F.expr(f"CASE WHEN weight <= {most} THEN t.depth END")).alias("top_depth")), "forest")
    measures = ["n_leaves", "saved_tokens"]
    everything = [small_subtrees := written(in_tasks(forest.filter("top_conv IS NOT NULL"), measures, ["n_convs"]), "small").withColumnRenamed("inner", "n_children")]
    if not forest.filter("top_conv IS NULL").isEmpty():
        everything += _upper(forest.filter("top_conv IS NULL"), small_subtrees, located.filter(F.col("weight") > most), top, measures, most)
    whole = everything[0].select(*_NODE, "n_convs", "n_children", *measures)
    for part in everything[1:]:
        whole = whole.unionByName(part)
    ended = located.filter("depth = length").select(F.col("at_conv").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    at_root = members.filter("length = 0").select(
        F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    digests = ends(ended.unionByName(at_root)).withColumnsRenamed({"conv_id": "e_conv", "depth": "e_depth"})
    full = left_join_unique(whole, digests, [("conv_id", "e_conv"), ("depth", "e_depth")])
    return full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*COLUMNS)


def _upper(upper: DataFrame, small: DataFrame, paths: DataFrame, top: int, measures: Sequence[str], most: int) -> list[DataFrame]:
    """Totals of the nodes above the small subtrees; the root is the node of ``top`` at depth 0."""
    tops = small.filter("conv_id = top_conv AND depth = top_depth").groupBy(
        F.col("parent_conv_id").alias("h_conv"), F.expr("depth - 1").alias("h_depth")).agg(
        *[F.sum(m).alias(f"h_{m}") for m in measures], F.count("*").alias("h_children"))
    children = upper.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("u_conv"), F.expr("depth - 1").alias("u_depth")).agg(F.count("*").alias("u_children"))
    hung = left_join_unique(left_join_unique(upper, tops, [("conv_id", "h_conv"), ("depth", "h_depth")]), children, [("conv_id", "u_conv"), ("depth", "u_depth")])
    forest = written(hung.select(
        *_NODE, "weight", "n_convs", (F.coalesce("h_children", F.lit(0)) + F.coalesce("u_children", F.lit(0))).alias("n_children"),
        F.lit(top).cast("long").alias("top_conv"), F.lit(0).cast("long").alias("top_depth"),
        *[(F.col(m) + F.coalesce(f"h_{m}", F.lit(0))).alias(m) for m in measures]), "upper")
    owners = forest.select(F.col("conv_id").alias("o")).distinct()
    above = paths.join(owners, F.col("conv_id") == F.col("o"), "left_semi").select("conv_id", "depth", "at_conv")
    at_top = owners.select(F.col("o").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(top).cast("long").alias("at_conv"))
    left, done = split_at_centroids(forest, written(above.unionByName(at_top), "above"), measures, most)
    rolled = in_tasks(left, measures, ["n_convs", "n_children", *[f"owed_{m}" for m in measures]])
    totals = [rolled.select(*_NODE, "n_convs", "n_children", *[(F.col(m) + F.col(f"owed_{m}")).alias(m) for m in measures])]
    if done is not None:
        totals.append(done.select(*_NODE, "n_convs", "n_children", *[F.col(f"owed_{m}").alias(m) for m in measures]))
    return totals


def conversation_trie(conversations: DataFrame, most: int = 1 << 16) -> DataFrame:
    """The trie of conversations rebuilt on shared openings."""
    rows, members = rebuilt(written(turns(conversations), "placed"))
    return trie(rows, members, most)
