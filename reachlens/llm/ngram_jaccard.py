"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles are at least 0.8 alike.

1. Every text gets 128 MinHash values (16 bits each are kept). Equal texts become one
   representative with a number of copies; copies are never paired.
2. Texts that agree in one of 32 bands of four values are candidates. A pair at the threshold
   agrees in none of them with a chance of 5e-8. A band key held by many texts is cut into
   blocks, and a task compares two blocks.
3. Candidates are pruned the Bayesian way: values are compared 16 at a time, and a pair is
   dropped as soon as the posterior chance that its similarity reaches the threshold (uniform
   prior, binomial agreement) is below ``tolerance``. A task returns only links that span what
   survived, so a group of n texts gives n rows, not n * n.
4. Survivors form components. Inside a component, again in pairs of blocks, all similarities
   are computed exactly from the shingle sets, as products of 0/1 matrices. This yields the
   number of links of each text and the links that span the classes.

Words are separated by spaces and the controls 09 to 0D and compared as they are. A text of
one to four words is one shingle. Defined results: a null text or one without words has no
shingles, no links and a class of its own; equal rows are copies of each other, and each
counts as a link of the other; null ids belong to classes, whose id is the least id that is
not null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reachlens.llm.graph import components, grouped
from reachlens.llm.names import free_names
from reachlens.operators.common import left_join_unique
from reachlens.sources.shared import written

SHINGLE = 5
BANDS, ROWS = 32, 4
STEP = 16
_HASHES = BANDS * ROWS
_FLAT = 1 << 20

_random = np.random.default_rng(20240601)
_FACTORS = _random.integers(1, 1 << 31, _HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, _HASHES, np.uint32)


def _word_hashes(text: str) -> Column:
    return F.expr(f"transform(array_remove(split(coalesce({text}, ''), r'[\\x20\\x09-\\x0D]+'), ''), w -> xxhash64(w))")


def _text_keys(text: str = "text") -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t1"), F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit(""))).alias("t2")]


def shingles(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle values of texts given as word hashes end to end, and their bounds."""
    h = hashes.astype(np.uint64)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - ends[:-1], count) + np.arange(ends[-1])
    width = np.repeat(np.minimum(n, SHINGLE), count)
    value = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = width > k
        word = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else value
        value = np.where(inside, value * np.uint64(0x9E3779B97F4A7C15) + word, value)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    return value, ends


def minhash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The low 16 bits of the 128 least hash values of each non-empty set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, _HASHES), np.uint16)
    for i in range(_HASHES):
        out[:, i] = np.minimum.reduceat(x * _FACTORS[i] + _OFFSETS[i], bounds[:-1]).astype(np.uint16)
    return out


def least_agreement(threshold: float, tolerance: float, step: int = STEP) -> list[int]:
    """For n = step, 2 * step, ... compared values the fewest agreements m with which the
    posterior chance of a similarity of ``threshold`` or more is still ``tolerance``. With a
    uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail above t is the chance of
    at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(step, _HASHES + 1, step):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


def _survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of ``b`` that are not pruned against those of ``a`` (or its one row)."""
    alive = np.arange(len(b))
    agreed = np.zeros(len(b), np.int32)
    for k, m in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        left = a[alive, cols] if a.ndim == 2 else a[cols]
        agreed = agreed + (left == b[alive, cols]).sum(1)
        keep = agreed >= m
        alive, agreed = alive[keep], agreed[keep]
    return alive


def _spanning(signatures: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (two row arrays) that span the surviving pairs: each row, once reached, is
    compared with the rows not reached so far."""
    left, right, rest = [], [], np.arange(len(signatures))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            hit = _survivors(signatures[a], signatures[rest], least)
            found = rest[hit]
            left += [a] * len(found)
            right += found.tolist()
            queue += found.tolist()
            rest = np.delete(rest, hit)
    return np.array(left, np.int64), np.array(right, np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, text key, number of shingle places and signature (null without words)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            offsets = np.asarray(lists.offsets, np.int64)
            hashes = np.asarray(lists.values)
            group = (offsets[1:] - offsets[0]) // _FLAT
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                own = offsets[start:end + 1]
                values, bounds = shingles(hashes[own[0]:own[-1]], own - own[0])
                full = np.diff(bounds) > 0
                kept = np.concatenate([bounds[:-1][full], bounds[-1:]])
                rows = iter(minhash(values, kept) if full.any() else ())
                signature = pa.array([next(rows).tobytes() if f else None for f in full], pa.binary())
                part = batch.slice(start, end - start)
                yield pa.record_batch(
                    [*[part.column(c) for c in ("doc_id", "t1", "t2")], pa.array(np.diff(bounds)), signature],
                    ["doc_id", "t1", "t2", "places", "signature"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_keys(text_col), _word_hashes(text_col).alias("words"))
    return narrow.mapInArrow(sign, "doc_id long, t1 long, t2 long, places long, signature binary")


def _paired_blocks(df: DataFrame, n_blocks: Column, within: bool) -> DataFrame:
    """Rows copied to every pair of blocks ``bi <= bj`` their own block ``blk`` is in; with
    ``within`` also the pair of a block with itself, which else only a single block has."""
    df = df.withColumn("_n", n_blocks).withColumn("blk", F.expr("CAST(pmod(xxhash64(rid), _n) AS INT)"))
    others = F.sequence(F.lit(0), F.col("_n").cast("int") - 1)
    if not within:
        others = F.filter(others, lambda x: (x != F.col("blk")) | (F.col("_n") == 1))
    other = df.withColumn("_o", F.explode(others))
    return other.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_n", "_o")


def _candidate_links(reps: DataFrame, least: list[int], block: int) -> DataFrame:
    """``a, b``: links of representatives that span what the pruning leaves in each bucket."""
    bands = F.array(*[
        F.xxhash64(F.lit(b), F.substring("signature", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)
    ])
    keys = reps.select("rid", F.explode(bands).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(shared, "key").join(reps.select("rid", "signature"), "rid")
    blocks = _paired_blocks(members, F.ceil(F.col("n") / block), within=False).select("key", "bi", "bj", "rid", "signature")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, matrix, sizes in _merged(grouped(batches, ["key", "bi", "bj"])):
            left, right = [], []
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            small = sizes == 2
            first = bounds[:-1][small]
            hit = _survivors(matrix[first], matrix[first + 1], least)
            left.append(first[hit])
            right.append(first[hit] + 1)
            for a, b in zip(bounds[:-1][~small], bounds[1:][~small]):
                x, y = _spanning(matrix[a:b], least)
                left.append(a + x)
                right.append(a + y)
            yield pa.record_batch([pa.array(rids[np.concatenate(left)]), pa.array(rids[np.concatenate(right)])], ["a", "b"])

    ordered = blocks.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return ordered.mapInArrow(links, "a long, b long").distinct()


def _merged(tables: Iterator[pa.Table], rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Several groups at a time: row ids and signatures end to end, and the group sizes."""
    kept, sizes = [], []

    def out():
        whole = pa.concat_tables(kept)
        matrix = np.frombuffer(b"".join(whole.column("signature").to_pylist()), np.uint16).reshape(-1, _HASHES)
        return whole.column("rid").to_numpy(), matrix, np.array(sizes)

    for t in tables:
        kept.append(t)
        sizes.append(t.num_rows)
        if sum(sizes) >= rows:
            yield out()
            kept, sizes = [], []
    if kept:
        yield out()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over the values that
    more than one set holds."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        total += matrix @ matrix.T
    return total.astype(np.int64)


def _exact(components_of: DataFrame, threshold: float, block: int, block_places: int) -> DataFrame:
    """``rid, links, root``: for rows ``comp, rid, copies, places, words`` the copies that each
    text is linked to, and a text of the same block pair it is connected with."""
    share = Fraction(str(threshold))
    top, bottom = share.numerator, share.denominator
    sizes = components_of.groupBy("comp").agg(F.count("*").alias("n"), F.sum("places").alias("p"))
    rows = components_of.join(sizes, "comp")
    n_blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("p") / block_places))
    blocks = _paired_blocks(rows, n_blocks, within=True).select("comp", "bi", "bj", "blk", "rid", "copies", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["comp", "bi", "bj"]):
            rid, first = np.unique(group.column("rid").to_numpy(), return_index=True)  # repeated rows once
            lists = group.column("words").combine_chunks()
            offsets, hashes = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
            sets = []
            for i in first:
                own = hashes[offsets[i]:offsets[i + 1]]
                sets.append(np.unique(shingles(own, np.array([0, len(own)]))[0]))
            copies, blk = group.column("copies").to_numpy()[first], group.column("blk").to_numpy()[first]
            size = np.array([len(s) for s in sets])
            common = _intersections(sets)
            linked = bottom * common >= top * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            if group.column("bi")[0] != group.column("bj")[0]:  # pairs inside a block, even the only one with rows, are counted elsewhere
                linked &= blk[:, None] != blk[None, :]
            root = np.arange(len(rid))
            while True:
                least = np.minimum(root, np.where(linked, root[None, :], len(rid)).min(1))
                least = least[least]
                if (least == root).all():
                    break
                root = least
            yield pa.record_batch([pa.array(rid), pa.array(linked @ copies), pa.array(rid[root])], ["rid", "links", "root"])

    ordered = blocks.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return ordered.mapInArrow(verify, "rid long, links long, root long")


def _labelled(
    docs: DataFrame, threshold: float, tolerance: float, block: int, block_places: int, id_col: str, text_col: str,
) -> tuple[DataFrame, DataFrame]:
    """Per row ``doc_id, t1, t2, places``; per text its class (``root``), links and copies."""
    rows = written(signed(docs, id_col, text_col), "signatures")
    reps = written(
        rows.filter("signature IS NOT NULL").groupBy("t1", "t2").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("signature").alias("signature"), F.min("places").alias("places"),
        ).withColumn("rid", F.monotonically_increasing_id()), "texts")
    candidates = components(_candidate_links(reps, least_agreement(threshold, tolerance), block))
    chosen = reps.drop("signature").join(candidates.withColumnsRenamed({"node": "rid", "root": "comp"}), "rid")
    # The text of one row per representative, found by its id and both halves of its key.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_keys(text_col), F.col(text_col).alias("_text"))
    same = (F.col("doc_id").eqNullSafe(F.col("first_id"))) & (texts.t1 == chosen.t1) & (texts.t2 == chosen.t2)
    with_words = texts.join(chosen, same).select("comp", "rid", "copies", "places", _word_hashes("_text").alias("words"))
    exact = written(_exact(written(with_words, "candidates"), threshold, block, block_places), "links")
    roots = components(exact.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("rid").agg(F.sum("links").alias("links"))
    labelled = (
        reps.select("rid", "t1", "t2", "first_id", "copies")
        .join(roots.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left")
        .select("t1", "t2", "first_id", F.coalesce("root", "rid").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return rows.select("doc_id", "t1", "t2", "places"), written(labelled, "classes")


def classes(
    docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-8, block: int = 1000, block_places: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least id of all it is linked to,
    over any number of links) and ``n_links``, the documents at or above the threshold."""
    rows, texts = _labelled(docs, threshold, tolerance, block, block_places, id_col, text_col)
    least = texts.groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_text = texts.join(least, "root").select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "class_id", "n_links")
    joined = left_join_unique(rows, by_text, [("t1", "k1"), ("t2", "k2")])
    single = F.col("places") == 0
    return joined.select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def kept_documents(
    docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-8, block: int = 1000, block_places: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without all but one document of each class: the one with the least
    id (a null id last), then the least text key. Of rows equal in both, the one with the least
    hash of its other columns (maps and variants, which have none, apart); rows equal in all are
    alike. Documents without words all stay."""
    rows, texts = _labelled(docs, threshold, tolerance, block, block_places, id_col, text_col)
    chosen = texts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "t1", "t2")).alias("k"))
    names = free_names(docs.columns, "_k0", "_k1", "_k2", "_c0", "_c1", "_c2", "_digest", "_rank")
    keys, of_class, (digest, rank) = names[:3], names[3:6], names[6:]
    chosen = chosen.select(*[F.col(f"k.{k}").alias(c) for k, c in zip(("first_id", "t1", "t2"), of_class)])
    t1, t2 = _text_keys(text_col)
    keyed = docs.select("*", F.col(id_col).cast("long").alias(keys[0]), t1.alias(keys[1]), t2.alias(keys[2]))
    has_words = F.expr(f"coalesce(`{text_col}`, '') rlike r'[^\\x20\\x09-\\x0D]'")
    same = F.col(keys[0]).eqNullSafe(F.col(of_class[0])) & (F.col(keys[1]) == F.col(of_class[1])) & (F.col(keys[2]) == F.col(of_class[2]))
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    found = keyed.filter(has_words).withColumn(digest, F.xxhash64(*told)).join(chosen, same)
    first = found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(digest))).filter(F.col(rank) == 1)
    return first.select(*docs.columns).unionByName(docs.filter(~has_words))
