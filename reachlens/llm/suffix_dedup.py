"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

Which windows of ``length`` bytes repeat is decided by suffix arrays; the rest is dealing the
windows out so that equal ones meet and no text is compared with all others.

1. Segments. Every window has a minimizer, the least hash of its 50-byte strings (leftmost of
   equals). Neighbouring windows with one minimizer form a segment, about 75 windows. Equal
   windows have equal minimizers, so a minimizer seen once can be left at once: a count over
   16 bytes a segment does it. Of the others, segments equal byte for byte (a digest tells)
   are counted, and one of them stands for all.
2. Shards. The different segments are fetched once each and dealt to shards by minimizer,
   with their counts. A shard sorts all suffixes by Larsson-Sadakane refinement (groups of
   equal rank are split by the rank ``h`` places on, h doubling) and takes the common
   prefixes by Kasai's rule. Neighbours in the suffix array that agree in ``length`` bytes
   are one window; it repeats if the counts of their segments sum to two or more.
3. Crowded minimizers. A minimizer with more segments than fit a shard is cut into blocks.
   Each block is sorted by itself, and pairs of blocks are merged by binary search of one
   block's windows in the other's sorted ones.
4. Repeated windows become spans of their documents; overlapping spans are joined.

Minimizers and segments that hold more than a thousandth of all rows, so fewer than a thousand
of them, are joined by broadcast; no task takes the rows of one alone.

Defined results: a null text is empty, a text shorter than ``length`` loses nothing; equal
rows, and rows with one id, are documents of their own, so each is elsewhere for the other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reachlens.llm.graph import grouped
from reachlens.sources.shared import written

LENGTH = 200
_GRAM = 50
_SIGNS = 7
_BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, from running minima of blocks."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, _MASK, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def segments(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of the documents ``data[bounds[i]:bounds[i + 1]]``: document number, first
    byte in it, number of windows, minimizer, and a digest of all bytes of the segment."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    up, down = _powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])

    def digest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * down[start])

    grams = np.arange(len(data) - _GRAM + 1)
    hashes = digest(grams, grams + _GRAM)
    low = np.uint64((1 << 28) - 1)
    least = _sliding_least((hashes & ~low) | grams.astype(np.uint64), length - _GRAM + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.arange(len(least))
    valid = starts + length <= bounds[1:][owner[:len(least)]]
    starts, least = starts[valid], least[valid]
    if not len(starts):
        return empty, empty, empty, empty, empty
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    windows = np.diff(np.append(new, len(starts)))
    first = starts[new]
    return (
        owner[first], first - bounds[:-1][owner[first]], windows,
        hashes[(least[new] & low).astype(np.int64)].view(np.int64), digest(first, first + windows + length - 1).view(np.int64),
    )


def suffix_array(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array over the parts end to end, each closed by a sentinel of its own; with it
    the rank of every place, and the text as small numbers (sentinels are below all bytes).

    The first order is by seven signs at once. A rank is the place of the last of its group,
    so that splitting a group leaves the others as they are.
    """
    sign = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    n = len(sign)
    size = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(size) - 1
    sign[ends] = 0
    left = np.repeat(ends, size) - np.arange(n)  # signs before the sentinel
    first = sign.copy()
    for k in range(1, min(_SIGNS, n)):
        first <<= 9
        first[:n - k] |= np.where(left[:n - k] >= k, sign[k:], 0)
    order = np.argsort(first)
    short = np.flatnonzero(left[order] < _SIGNS)
    order[short] = order[short][np.lexsort((order[short], first[order[short]]))]
    ordered = first[order]
    same = np.append((ordered[1:] == ordered[:-1]) & (left[order[:-1]] >= _SIGNS), False)
    rank = np.empty(n, np.int64)
    last = np.flatnonzero(~same)
    rank[order] = np.repeat(last, np.diff(last, prepend=-1))
    h = _SIGNS
    while True:
        loose = np.flatnonzero(same | np.append(False, same[:-1]))
        if not len(loose):
            break
        at = order[loose]
        key = rank[at] << 32 | rank[np.minimum(at + h, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[loose] = at
        equal = np.append(key[1:] == key[:-1], False)
        same[loose] = equal
        last = np.flatnonzero(~equal)
        rank[at] = np.repeat(loose[last], np.diff(last, prepend=-1))
        h *= 2
    text = sign + len(parts)
    text[ends] = np.arange(len(parts))
    return order, rank, text


def common_prefixes(order: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For every place its common prefix with the suffix before it in the suffix array.

    Kasai's rule says the value falls by at most one from a place to the next, and by exactly
    one where both suffixes have equal signs in front. Only the other places are compared, in
    strides; the rest follow as a running maximum of value plus place.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.arange(n)
    inner = (places > 0) & (before > 0)
    reducible = np.zeros(n, bool)
    reducible[inner] = text[places[inner] - 1] == text[before[inner] - 1]
    value = np.zeros(n, np.int64)
    active = np.flatnonzero(~reducible & (before >= 0))
    while len(active):
        i, j = active + value[active], before[active] + value[active]
        go = np.ones(len(active), bool)
        for _ in range(16):
            go &= (i < n) & (j < n)
            go[go] = text[i[go]] == text[j[go]]
            value[active[go]] += 1
            i, j = i + go, j + go
        active = active[go]
    return np.maximum.accumulate(value + places) - places


def repeated_starts(parts: list[bytes], length: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Places in the parts end to end (a sentinel after each) whose next ``length`` bytes
    also start at another place, or stand in a part that counts for several."""
    order, _, text = suffix_array(parts)
    window = np.cumsum(common_prefixes(order, text)[order] < length)  # one number for suffixes that agree so far
    size = np.array([len(p) + 1 for p in parts])
    weight = np.repeat(np.ones(len(parts), np.int64) if counts is None else counts, size)
    weight[np.repeat(np.cumsum(size) - 1, size) - np.arange(len(order)) < length] = 0
    total = np.bincount(window, weight[order])
    return np.sort(order[(total[window] > 1) & (weight[order] > 0)])


def _sorted_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the parts in suffix order as fixed-width strings, and their places. All
    are equally wide, so ignoring zero bytes at the end does no harm."""
    order, _, _ = suffix_array(parts)
    whole = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    left = np.concatenate([np.arange(len(p), -1, -1) for p in parts])
    order = order[left[order] >= length]
    view = np.lib.stride_tricks.sliding_window_view(whole, length)
    return np.ascontiguousarray(view[order]).view(f"S{length}").ravel(), order


def merged_starts(a: list[bytes], b: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``a`` and of ``b`` whose windows the other has too, by binary search of the
    sorted windows of ``b`` in those of ``a``."""
    (left, at_left), (right, at_right) = (_sorted_windows(p, length) for p in (a, b))
    low, high = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
    hit = high > low
    marks = np.zeros(len(left) + 1, np.int64)
    np.add.at(marks, low[hit], 1)
    np.add.at(marks, high[hit], -1)
    return np.sort(at_left[np.cumsum(marks[:-1]) > 0]), np.sort(at_right[hit])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def _all_segments(texts: DataFrame, length: int) -> DataFrame:
    """One row per document: its key, and its segments as arrays."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
            group = np.cumsum(size) // _BATCH_BYTES
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(start, end - start)
                owner, *columns = segments(*_bytes_of(part.column("text")), length)
                offsets = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("th"), *[pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int64))) for c in columns]],
                    ["doc_id", "th", "first", "windows", "minimizer", "digest"])

    return texts.mapInArrow(cut, "doc_id long, th long, first array<long>, windows array<long>, minimizer array<long>, digest array<long>")


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of every stretch of consecutive places."""
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])]


def _joined(rows: DataFrame, side: DataFrame, keys: list[str], heavy: float) -> DataFrame:
    """``rows`` with the stored ``side``, whose keys have ``n`` rows each; those with more than
    ``heavy``, a thousandth of all, are broadcast."""
    few = side.filter(F.col("n") > heavy)
    others = rows.join(F.broadcast(few.select(*keys).distinct()), keys, "left_anti").join(side.filter(F.col("n") <= heavy), keys)
    return rows.join(F.broadcast(few), keys).unionByName(others)


def _in_shards(fetched: DataFrame, n_shards: int, length: int) -> DataFrame:
    """``minimizer, digest, n, low, high``: runs of repeated windows inside different segments,
    from rows ``minimizer, digest, n, blocks, bytes``."""
    # A minimizer of one block goes to a shard with others; a crowded one to pairs of its blocks.
    rows = fetched.withColumn("blk", F.expr("CAST(pmod(xxhash64(digest), blocks) AS INT)")).withColumn(
        "o", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o"))
    rows = rows.withColumn("shard", F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(minimizer), {n_shards})")).otherwise(F.xxhash64("minimizer")))
    rows = rows.withColumn("crowded", F.when(F.col("blocks") > 1, F.col("minimizer")).otherwise(F.lit(0)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["shard", "crowded", "bi", "bj"]):
            parts = group.column("bytes").to_pylist()
            blk, bi, bj = group.column("blk").to_numpy(), group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            found = []
            if bi == bj:
                found.append((np.arange(len(parts)), repeated_starts(parts, length, group.column("n").to_numpy())))
            else:
                sides = [np.flatnonzero(blk == x) for x in (bi, bj)]
                hits = merged_starts(*[[parts[i] for i in side] for side in sides], length)
                found += list(zip(sides, hits))
            low, high, row = [], [], []
            for side, places in found:
                ends = np.cumsum([len(parts[i]) + 1 for i in side])
                part = np.searchsorted(ends, places, "right")
                inside = places - np.concatenate([[0], ends])[part]
                for p in np.unique(part):
                    a, b = _runs(inside[part == p])
                    low.append(a)
                    high.append(b)
                    row.append(np.full(len(a), side[p]))
            if not row:
                continue
            row = np.concatenate(row)
            yield pa.record_batch([
                *[pa.array(group.column(c).to_numpy()[row]) for c in ("minimizer", "digest", "n")],
                pa.array(np.concatenate(low)), pa.array(np.concatenate(high)),
            ], ["minimizer", "digest", "n", "low", "high"])

    dealt = rows.select("shard", "crowded", "bi", "bj", "blk", "minimizer", "digest", "n", "bytes")
    keys = ["shard", "crowded", "bi", "bj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "minimizer long, digest long, n long, low long, high long")


def removed(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = 512 << 10, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the
    removed ``spans`` as an array of (start, end). Minimizers share shards of ``shard_bytes``;
    one with more than ``block_bytes`` is cut into blocks."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")) \
        .select("doc_id", F.xxhash64("text").alias("th"), "text")
    stored = written(_all_segments(texts, length), "segments")
    flat = stored.select("doc_id", "th", F.inline(F.arrays_zip("first", "windows", "minimizer", "digest")))
    kinds = written(flat.groupBy("minimizer").agg(F.count("*").alias("n")).filter("n > 1"), "kinds")
    heavy = (kinds.agg(F.sum("n")).first()[0] or 0) / 1000
    repeats = written(_joined(flat, kinds, ["minimizer"], heavy).drop("n"), "repeats")
    distinct = written(repeats.groupBy("minimizer", "digest").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first", "windows")).alias("at")), "distinct")
    sizes = distinct.groupBy("minimizer").agg(F.sum(F.col("at.windows") + (length - 1)).alias("size"))
    n_shards = max(1, ceil((sizes.agg(F.sum("size")).first()[0] or 0) / shard_bytes))
    crowded = sizes.filter(F.col("size") > block_bytes).select("minimizer", F.ceil(F.col("size") / block_bytes).cast("int").alias("blocks"))
    wanted = (
        distinct.join(crowded, "minimizer", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.th").alias("w_th"))
        .agg(F.collect_list(F.struct("minimizer", "digest", "n", "blocks", "at.first", "at.windows")).alias("cuts"))
    )
    fetched = (
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
        .select(F.explode(F.expr(f"""transform(cuts, c -> struct(c.minimizer, c.digest, c.n, c.blocks,
            substring(text, CAST(c.first AS INT) + 1, CAST(c.windows AS INT) + {length - 1}) AS bytes))""")).alias("c"))
        .select("c.*").dropDuplicates(["minimizer", "digest"])
    )
    runs = written(_in_shards(fetched, n_shards, length), "runs")
    found = _joined(repeats.select("doc_id", "th", "first", "minimizer", "digest"), runs, ["minimizer", "digest"], heavy)
    spans = found.selectExpr("doc_id", "th", "first + low AS a", f"first + high + {length} AS b")
    # The spans of one document; equal rows bring the same ones.
    by_doc = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marked in zip(batch.column("text"), batch.column("spans")):
                text, joined = text.as_py(), []
                for span in sorted((s["a"], s["b"]) for s in marked.as_py() or ()):
                    if joined and span[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], span[1])
                    else:
                        joined.append(list(span))
                sha, at = hashlib.sha256(), 0
                for a, b in joined:
                    sha.update(text[at:a])
                    at = b
                sha.update(text[at:])
                out.append((len(text), sum(b - a for a, b in joined), len(joined), sha.hexdigest(), [{"start": a, "end": b} for a, b in joined]))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("th") == F.col("s_th"))
    return texts.join(by_doc, same, "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
