"""Benchmark decontamination: pigeonhole pieces found exactly, verified with Myers distance.

Texts and items are lower-cased and everything but letters and digits becomes one space. An
item of m characters may differ by k = ``error_share`` * m edits. Cut into k + 1 pieces, at
least one piece must then stand unchanged, so the pieces of all items are searched for with
one Aho-Corasick automaton; each hit names the window the item would lie in, and Myers'
bit-parallel recurrence gives the smallest distance of the item to any stretch of it.

Items are the stated query set. They reach the tasks in blocks of about ``block_chars``
characters, one pass over the documents per block, so memory is bounded however many there
are. Documents are not shuffled.

Defined results: a null or empty text, and an item without letters or digits, match nothing;
an item too short for one edit must stand exactly; repeated documents are reported row by
row, equal items once; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reachlens.llm.names import free_names
from reachlens.sources.shared import written

_SEARCHERS: dict[str, Searcher] = {}


def normalized(text: str) -> Column:
    return F.expr(f"trim(regexp_replace(lower(coalesce(CAST(`{text}` AS STRING), '')), r'[^\\p{{L}}\\p{{N}}]+', ' '))")


def budget(length: int, error_share: float) -> int:
    return int(length * error_share)


def myers(pattern: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of ``text``, and where the first
    such stretch ends. ``pattern`` has for each character the bits of its places."""
    full, last = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best, end = full, 0, length, length, 0
    for i, c in enumerate(text):
        here = pattern.get(c, 0)
        vertical = here | down
        across = (((here & up) + up) ^ up) | here
        plus = down | (~(across | up) & full)
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
            if score < best:
                best, end = score, i + 1
        plus <<= 1
        minus <<= 1
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
    return best, end


class Searcher:
    def __init__(self, items: list[tuple[int, str]], error_share: float):
        import ahocorasick

        self.items = [(i, s, budget(len(s), error_share)) for i, s in items if s]
        self.bits = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, k) in enumerate(self.items):
            masks: dict[str, int] = {}
            for p, c in enumerate(s):
                masks[c] = masks.get(c, 0) | 1 << p
            self.bits.append(masks)
            cuts = [j * len(s) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(s[a:b], []).append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item that a piece of it was found of, the merged stretches to look at."""
        found: dict[int, list[list[int]]] = {}
        if not self.items:
            return found
        for end, places in self.automaton.iter(text):
            for n, b in places:
                _, s, k = self.items[n]
                start = end + 1 - b
                low, high = max(0, start - k), min(len(text), start + len(s) + k)
                spans = found.setdefault(n, [])
                if spans and low <= spans[-1][1] and spans[-1][0] <= high:
                    spans[-1] = [min(low, spans[-1][0]), max(high, spans[-1][1])]
                else:
                    spans.append([low, high])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Item, distance, end and item length for every item within its budget."""
        out = []
        for n, spans in self.windows(text).items():
            item, s, k = self.items[n]
            best = min((d, a + end) for a, b in spans for d, end in [myers(self.bits[n], len(s), text[a:b])])
            if best[0] <= k:
                out.append((item, *best, len(s)))
        return out


def _searcher(token: str, items: list[tuple[int, str]], error_share: float) -> Searcher:
    """The worker's automaton for a block of items; only the newest is kept."""
    if token not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[token] = Searcher(items, error_share)
    return _SEARCHERS[token]


def _blocks(items: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """The normalized items, some ``block_chars`` characters at a time."""
    clean = written(items.select(F.col(id_col).cast("long").alias("id"), normalized(text_col).alias("s")).filter("s <> ''").distinct(), "items")
    total = clean.agg(F.sum(F.length("s"))).first()[0] or 0
    n = ceil(total / block_chars)
    for b in range(n):
        rows = clean.filter(F.expr(f"pmod(xxhash64(id, s), {n})") == b).collect()
        yield uuid.uuid4().hex, sorted(((r.id, r.s) for r in rows), key=lambda x: (x[0] is None, x))


def matches(
    docs: DataFrame, items: DataFrame, error_share: float = 0.08, block_chars: int = 1_000_000,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, distance, item_chars, end_char`` for every document and item within
    the item's budget; the end is a place in the normalized text."""
    schema = "doc_id long, item_id long, distance long, item_chars long, end_char long"
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalized(text_col).alias("s"))

    def search(token, block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(token, block, error_share)
            for batch in batches:
                found = [
                    (doc.as_py(), item, distance, chars, end)
                    for doc, text in zip(batch.column("doc_id"), batch.column("s"))
                    for item, distance, end, chars in searcher.matches(text.as_py())
                ]
                columns = list(zip(*found)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "item_chars", "end_char"])

        return run

    result = docs.sparkSession.createDataFrame([], schema)
    for token, block in _blocks(items, block_chars, item_id_col, item_text_col):
        result = result.unionByName(narrow.mapInArrow(search(token, block), schema))
    return result


def clean_documents(
    docs: DataFrame, items: DataFrame, error_share: float = 0.08, block_chars: int = 1_000_000,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with the columns they came with."""
    (extra,) = free_names(docs.columns, "_s")

    def search(token, block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(token, block, error_share)
            for batch in batches:
                clean = [not searcher.matches(text.as_py()) for text in batch.column(batch.num_columns - 1)]
                rows = batch.filter(pa.array(clean, pa.bool_()))
                yield rows.select(list(range(batch.num_columns - 1)))

        return run

    for token, block in _blocks(items, block_chars, item_id_col, item_text_col):
        docs = docs.withColumn(extra, normalized(text_col)).mapInArrow(search(token, block), docs.schema)
    return docs
