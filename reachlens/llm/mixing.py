"""Mixing sources to target weights: flow from membership patterns to source quotas.

Documents are aggregated by membership pattern (the set of sources they may be counted
for); every pattern can send each of its words once per epoch, and a later epoch costs more
than an earlier one (convex repetition costs), so a word is repeated only when no fresh one
can serve the quota. The minimum-cost flow on the small graph patterns x epochs -> sources
says how many words of each pattern each source takes. Documents are then selected inside
each pattern in the order of a seeded hash: all of them once per full epoch, and those in
front for the rest. Where the rest ends inside a document, only that part of it is taken.

Nothing but the graph reaches the driver: one row per pattern, at most ``max_patterns``
(an error beyond, never a cut). The order inside a pattern is a distributed running sum:
documents fall into 4,096 hash buckets, bucket totals are summed per pattern, and only the
bucket in which a rest ends is put in order.

Defined results: a null text has size 0; a null source is a source of its own that comes
last; rows with one id share a place in the order, and a rest that ends there is shared by
size; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from math import floor

from pyspark.sql import DataFrame, Window, functions as F

from reachlens.llm.names import free_names
from reachlens.sources.shared import written

# Fixed values of the mix: weights in turn, share of all words, repeats at most.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
EPOCHS = 2


def size_sql(text: str = "text") -> str:
    """Words of a text, separated by spaces and the controls 09 to 0D."""
    return f"CAST(size(array_remove(split(coalesce({text}, ''), r'[\\x20\\x09-\\x0D]+'), '')) AS BIGINT)"


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> list[Fraction]:
    """Target of each source (sizes in source order): ``share`` of all words by weight, none
    above ``epochs`` times its size; what is cut off is shared again by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total = Fraction(sum(sizes)) * share
    capped: set[int] = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(epochs * sizes[i] for i in capped)
        per_weight = left / sum(weight[i] for i in free) if free else Fraction(0)
        above = {i for i in free if per_weight * weight[i] > epochs * sizes[i]}
        if not above:
            return [Fraction(epochs * sizes[i]) if i in capped else per_weight * weight[i] for i in range(len(sizes))]
        capped |= above


def _augment(to: list[int], left: list[int], out: list[list[int]], start: int, end: int) -> None:
    """Raise the flow to its maximum: in every round all shortest paths with capacity left are
    filled at once, so rounds are few however many nodes there are. Edge ``e ^ 1`` reverses ``e``."""
    while True:
        level = [-1] * len(out)
        level[start], front = 0, [start]
        while front and level[end] < 0:
            after = []
            for a in front:
                for e in out[a]:
                    if left[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        after.append(to[e])
            front = after
        if level[end] < 0:
            return
        tried = [0] * len(out)
        path: list[int] = []
        at = start
        while True:
            if at == end:
                amount = min(left[e] for e in path)
                for e in path:
                    left[e] -= amount
                    left[e ^ 1] += amount
                full = next(i for i, e in enumerate(path) if not left[e])
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            edges = out[at]
            while tried[at] < len(edges):
                e = edges[tried[at]]
                if left[e] and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            else:
                if not path:
                    break
                at = to[path.pop() ^ 1]
                tried[at] += 1
                continue
            path.append(e)
            at = to[e]


def min_cost_flow(supply: dict[tuple, int], quota: dict, epochs: int = EPOCHS) -> dict[tuple[tuple, object], int]:
    """Words each pattern sends to each source, at least cost.

    A pattern may send its size once per epoch; the e-th epoch costs e a word, to any of the
    sources in the pattern. Sending on costs nothing else, so the flow fills quotas as far
    as capacity allows and repeats as little as possible. Every path costs what its first edge
    costs, so the cheapest paths of all are those of the first epoch, then those of the second,
    and so on: one maximum flow per cost, in which earlier words may be sent elsewhere but
    never withdrawn. Edges are tried in the order of patterns and sources, which makes reruns agree.
    """
    patterns, sources = list(supply), list(quota)
    n = len(patterns)
    start, end = n + len(sources), n + len(sources) + 1
    place = {s: n + i for i, s in enumerate(sources)}
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def add(a: int, b: int, capacity: int) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(capacity)
        out[b].append(len(to))
        to.append(a)
        left.append(0)

    for i in range(n):
        add(start, i, 0)
    for i, p in enumerate(patterns):
        for s in p:
            if s in place:
                add(i, place[s], epochs * supply[p])
    for s in sources:
        add(place[s], end, quota[s])
    for _ in range(epochs):
        for i, p in enumerate(patterns):
            left[2 * i] += supply[p]
        _augment(to, left, out, start, end)
    return {
        (p, sources[to[e] - n]): left[e ^ 1]
        for i, p in enumerate(patterns) for e in out[i] if e % 2 == 0 and left[e ^ 1]
    }


def _ordered(docs: DataFrame, members: str, seed: int, key: Sequence[str]) -> DataFrame:
    """With the pattern as text, a seeded hash (the same in every run and partitioning) and its bucket."""
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return docs.withColumn("_p", F.to_json(F.array_sort(members))).withColumn("_o", seeded).withColumn(
        "_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))


def mixed(
    docs: DataFrame, members: str, size: str, quota: dict | None = None, key: Sequence[str] = ("doc_id",), seed: int = 17,
    weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, max_patterns: int = 100_000, taken_col: str = "taken",
) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the words taken per row as ``taken_col``, and a frame of ``source, source_size, target``.

    ``members`` names an array column of sources a row may serve, ``size`` its words. Without
    a ``quota`` the targets follow from ``weights`` over the sizes of the sources; a word in
    several sources counts for each. Rows are never shuffled: patterns and cuts, one row per
    pattern and so within ``max_patterns``, are broadcast to them. Columns of ``docs`` may have
    any names but ``taken_col``: inside they go by their places.
    """
    spark = docs.sparkSession
    if free_names(docs.columns, taken_col) != [taken_col]:
        raise ValueError(f"the documents have a column {taken_col}")
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = dict(zip(docs.columns, placed.columns))
    members, size = own[members], own[size]
    ordered = _ordered(placed, members, seed, [own[k] for k in key])
    buckets = written(ordered.groupBy("_p", "_b").agg(
        F.first(F.array_sort(members)).alias("_m"), F.sum(size).alias("_n")), "mix-buckets")
    patterns = buckets.groupBy("_p").agg(F.first("_m").alias("m"), F.sum("_n").alias("n")).limit(max_patterns + 1).collect()
    if len(patterns) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    last = lambda s: (s is None, s or "")  # noqa: E731  null comes last, text by code point
    supply = {tuple(r.m): int(r.n or 0) for r in sorted(patterns, key=lambda r: [last(s) for s in r.m])}
    sources = sorted({s for p in supply for s in p}, key=last)
    sizes = [sum(n for p, n in supply.items() if s in p) for s in sources]
    goal = dict(zip(sources, targets(sizes, weights, share, epochs))) if quota is None else quota
    sent = min_cost_flow(supply, {s: floor(x) for s, x in goal.items()}, epochs)
    words = dict.fromkeys(supply, 0)
    for (p, _), n in sent.items():
        words[p] += n
    rows = [(r._p, *divmod(words[tuple(r.m)], r.n or 1)) for r in patterns]
    plan = spark.createDataFrame(rows, "_p string, _full long, _rest long")

    # The bucket a rest ends in, then the place inside it; only that bucket is put in order.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket_cuts = (
        buckets.join(F.broadcast(plan), "_p").withColumn("_before", before)
        .filter("_before < _rest AND _before + _n >= _rest").select("_p", "_b", "_full", F.expr("_rest - _before").alias("_left"))
    )
    rest = F.col("_left") - F.coalesce(
        F.sum("_n").over(Window.partitionBy("_p").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = (
        ordered.join(F.broadcast(bucket_cuts), ["_p", "_b"]).groupBy("_p", "_o", "_left").agg(F.sum(size).alias("_n"))
        .withColumn("_part", rest).filter("_part > 0 AND _part <= _n")
        .select("_p", F.col("_o").alias("_cut"), F.col("_n").alias("_cut_size"), "_part")
    )
    taken = F.expr(f"""_full * {size} + CASE WHEN _o < _cut THEN {size}
        WHEN _o = _cut THEN {size} * _part DIV _cut_size ELSE 0 END""")
    result = (
        ordered.join(F.broadcast(plan), "_p").join(F.broadcast(cuts), "_p", "left")
        .select(*[F.col(c).alias(name) for name, c in own.items()], F.coalesce(taken, F.lit(0)).cast("long").alias(taken_col))
    )
    figures = spark.createDataFrame(
        [(s, n, float(goal.get(s, 0))) for s, n in zip(sources, sizes)], "source string, source_size long, target double")
    return result, figures


def repeated(mix: DataFrame, size: str, columns: Sequence[str], taken_col: str = "taken") -> DataFrame:
    """Whole documents as often as taken: once per full size, once more from half a size on."""
    copies = F.expr(f"CAST(floor(`{taken_col}` / nullif(`{size}`, 0) + 0.5) AS INT)")
    (copy,) = free_names(columns, "_copy")
    return mix.filter(copies > 0).select(*columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(copy)).select(*columns)
