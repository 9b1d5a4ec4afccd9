"""BPE encoding and decoding with a tokenization automaton.

:class:`Automaton` compiles a byte-level merge list into a deterministic automaton over token
labels whose accepted label sequences are the tokenizations BPE makes. It starts with one
state that every byte label leads back to, and applies a merge gadget for each merge u + v -> w
in order: the state q that u leads to is split, u now leads to a copy of q without the arc v,
and where a label u and then v could be followed there is now an arc w to where v leads. The
target of an arc depends on its label alone, so a state is "what may not follow", and a copy is
its original and one arc less. Arcs made later for tokens that begin with v go with v; numbering
the tokens by their left parts, newest first, makes what a merge forbids one interval of numbers.
The compiled table holds the disjoint forbidden intervals of every state, sorted, so a
transition is one binary search.

A pre-split piece has exactly one accepted label sequence, and so has each of its prefixes.
Encoding finds for every place the one arc that may end there, all pieces of a batch together:
labels that stand at a place come from a byte trie, transitions from the table. Decoding puts
the byte labels of the arcs end to end.

Pieces come from the shared splitter; texts it leaves whole (characters of uncertain class,
strings treated apart) are split by the tokenizer's own pre-tokenizer, not encoded by it.

Defined results: a null or empty text has no ids and decodes to an empty text; null and
repeated ids and repeated rows are encoded row by row; an empty table gives an empty result;
columns besides id and text are not read, whatever their names. A long text is encoded in
segments (see ``tokens``); a task holds the ids of one text, four bytes each. Decoding gives
for any ids the text their bytes spell, with U+FFFD for what is not UTF-8.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reachlens.llm.tokens import Splitter, is_plain, small_batches, spread

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    signs, free = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            signs[chr(free)] = b
            free += 1
    return signs


class Automaton:
    """Table-driven encoder of pieces, from a byte vocabulary and merges (pairs of ids, in order)."""

    def __init__(self, labels: Sequence[bytes], merges: Sequence[tuple[int, int, int]]):
        """``labels`` are the bytes of each id (None where an id has none), ``merges`` are
        ``(left, right, made)`` ids in order of priority."""
        self.labels = list(labels)
        self._apply_gadgets(merges)
        self._compile_trie()

    def _apply_gadgets(self, merges: Sequence[tuple[int, int, int]]) -> None:
        n = len(self.labels)
        state_of = [0] * n  # where a label leads; state 0 forbids nothing
        origin, removed = [-1], [(-1, -1)]  # of each state: what it is a copy of, the arc it lost and when
        made_by, parts = [[] for _ in range(n)], {}
        rule: dict[tuple[int, int], int] = {}
        never = len(merges)

        def spine(token: int, side: int) -> Iterator[tuple[int, int]]:
            """The token, its part on one side, that one's part, ...; each with the time of the one before."""
            time = never
            while True:
                yield token, time
                if token not in parts:
                    return
                time = parts[token]
                token = merges[time][side]

        def reachable(left: int, right: int) -> bool:
            """Whether the state that ``left`` leads to has, so far, an arc ``right``."""
            ends = list(spine(right, 0))
            return not any(
                rule.get((a, b), never) < above_a and rule[a, b] <= above_b
                for a, above_a in spine(left, 1) for b, above_b in ends
            )

        dead = set()
        for time, (left, right, made) in enumerate(merges):
            if left in dead or right in dead or not reachable(left, right):
                dead.add(made)  # nothing is ever left to merge: the gadget finds no such path
                continue
            rule[left, right] = time
            target = state_of[right]
            origin.append(state_of[left])
            removed.append((right, time))
            state_of[left] = len(origin) - 1
            state_of[made] = target
            made_by[left].append((time, made))
            parts[made] = time
        # Numbers: a token, then what begins with it, newest first; so the arcs that go with a
        # removed arc v are v and its newest descendants, one interval.
        number, reach = np.zeros(n, np.int64), [0] * n
        born_after: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        count = 0
        for root in range(n):
            if root in parts or root in dead or self.labels[root] is None:
                continue
            stack = [(root, iter(reversed(made_by[root])))]
            number[root], count = count, count + 1
            while stack:
                token, rest = stack[-1]
                for time, child in rest:
                    number[child], count = count, count + 1
                    stack.append((child, iter(reversed(made_by[child]))))
                    born_after[token].append((time, child))
                    break
                else:
                    reach[token] = count
                    stack.pop()
        starts, ends = np.zeros(len(origin), np.int64), np.zeros(len(origin), np.int64)
        for state, (token, time) in enumerate(removed):
            if token < 0:
                continue
            # A label made from v when the arc was already gone never got one from here; a label
            # made from v before has its own arc, which other merges decide.
            starts[state], end = number[token], number[token] + 1
            lo, hi = 0, len(born_after[token])
            while lo < hi:  # newest first: those made at this time or after
                mid = (lo + hi) // 2
                if born_after[token][mid][0] >= time:
                    lo = mid + 1
                else:
                    hi = mid
            ends[state] = reach[born_after[token][lo - 1][1]] if lo else end
        self.labels = [None if i in dead else x for i, x in enumerate(self.labels)]
        self._number, self._state_of = number, np.array(state_of, np.int64)
        self._width = count + 1
        # Of every state that a label leads to, the intervals of it and its originals.
        used = np.unique(self._state_of)
        owner, at = used, used
        of, rows = [], []
        back = np.array(origin, np.int64)
        while len(at):
            alive = at > 0
            owner, at = owner[alive], at[alive]
            of.append(owner)
            rows.append(at)
            at = back[at]
        of, rows = np.concatenate(of), np.concatenate(rows)
        order = np.lexsort((-ends[rows], starts[rows], of))
        of, rows = of[order], rows[order]
        low, high = of * self._width + starts[rows], of * self._width + ends[rows]
        outer = np.maximum.accumulate(high)  # intervals are nested or apart
        kept = np.append(True, low[1:] >= outer[:-1]) if len(low) else np.zeros(0, bool)
        self._low, self._high = low[kept], high[kept]

    def follows(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state that label ``before`` leads to (-1: the first state) has an arc ``label``."""
        key = np.where(before >= 0, self._state_of[before], 0) * self._width + self._number[label]
        at = np.searchsorted(self._low, key, side="right") - 1
        return (at < 0) | (self._high[at] <= key) if len(self._low) else np.ones(len(key), bool)

    def _compile_trie(self) -> None:
        """Byte transitions of all labels; nodes that go on are numbered first, so that only
        they have a row."""
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for i, label in enumerate(self.labels):
            if not label:
                continue
            node = 0
            for sign in label:
                if sign not in children[node]:
                    children.append({})
                    token.append(-1)
                    children[node][sign] = len(children) - 1
                node = children[node][sign]
            token[node] = i
        inner = [i for i, c in enumerate(children) if c]
        new = np.empty(len(children), np.int64)
        new[inner] = np.arange(len(inner))
        outer = [i for i, c in enumerate(children) if not c]
        new[outer] = len(inner) + np.arange(len(outer))
        self._step = np.full((len(inner), 256), -1, np.int32)
        for row, node in enumerate(inner):
            for sign, child in children[node].items():
                self._step[row, sign] = new[child]
        self._token = np.empty(len(children), np.int32)
        self._token[new] = token

    def _arcs(self, data: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels that stand in the pieces: first byte, byte after the last, label."""
        at, out = np.arange(len(data)), []
        node, depth = self._step[0, data], 1
        while len(at):
            found = node >= 0
            at, node = at[found], node[found]
            token = self._token[node]
            full = token >= 0
            out.append((at[full], at[full] + depth, token[full]))
            more = (node < len(self._step)) & (at + depth < end_of[at])
            at, node = at[more], node[more]
            node = self._step[node, data[at + depth]]
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def encode(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the bounds of each piece."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:][:len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        start_of = np.repeat(offsets[:-1], size)
        first, after, label = self._arcs(data, np.repeat(offsets[1:], size))
        place = after - start_of[first]
        order = np.argsort(place, kind="stable")
        first, final, label = first[order], after[order] - 1, label[order].astype(np.int64)
        # For each byte: the one label that ends with it, where that begins, labels up to it.
        last, begin, count = (np.zeros(len(data), np.int64) for _ in range(3))
        at = 0
        for many in np.bincount(place)[1:].tolist() if len(place) else ():
            i, j, t = first[at:at + many], final[at:at + many], label[at:at + many]
            inside = i > start_of[i]
            good = self.follows(np.where(inside, last[i - 1], -1), t)
            i, j, inside = i[good], j[good], inside[good]
            last[j], begin[j], count[j] = t[good], i, 1 + np.where(inside, count[i - 1], 0)
            at += many
        some = np.flatnonzero(size)
        numbers = np.zeros(len(size), np.int64)
        numbers[some] = count[offsets[1:][some] - 1]
        bounds = np.append(0, np.cumsum(numbers))
        ids, byte, slot = np.zeros(bounds[-1], np.uint32), offsets[1:][some] - 1, bounds[1:][some] - 1
        while len(byte):
            ids[slot] = last[byte]
            more = begin[byte] > start_of[byte]
            byte, slot = begin[byte[more]] - 1, slot[more] - 1
        return ids, bounds


class Tokenizer:
    """Encoding of texts and decoding of ids for a plain byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        import tokenizers

        if not is_plain(path):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._signs = _byte_signs()
        vocabulary = spec["model"]["vocab"]
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        labels: list[bytes | None] = [None] * (1 + max([*vocabulary.values(), *self._special.values()]))
        for token, i in vocabulary.items():
            labels[i] = bytes(self._signs[c] for c in token)
        for token, i in self._special.items():
            labels[i] = None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        if len({m[2] for m in merges}) < len(merges):
            raise ValueError("two merges make one token")
        self.automaton = Automaton(labels, merges)
        self._splitter = Splitter(list(self._special))
        self._pre_tokenizer = tokenizers.Tokenizer.from_file(path).pre_tokenizer
        by_length = sorted(self._special, key=len, reverse=True)
        self._apart = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        for token, i in self._special.items():
            labels[i] = token.encode()
        self._spelled = _pool(x or b"" for x in labels)
        self._decimal = _pool(b"%d," % i for i in range(len(labels)))

    def _parts(self, text: str) -> list[bytes | int]:
        """Pieces of a text that the splitter leaves whole; an int is the id of a special string."""
        parts: list[bytes | int] = []
        for part in self._apart.split(text) if self._apart else [text]:
            if part in self._special:
                parts.append(self._special[part])
            elif part:
                parts += [bytes(self._signs[c] for c in piece) for piece, _ in self._pre_tokenizer.pre_tokenize_str(part)]
        return parts

    def _table(self, pieces: pa.LargeBinaryArray, whole: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in a pool, its bounds, and the entry of each piece in it."""
        entry = np.arange(len(pieces))
        if not whole:
            return *self.automaton.encode(pieces), entry
        left = pc.is_in(pieces, pa.array(list(whole), pa.large_binary()))
        rows = np.flatnonzero(left.to_numpy(zero_copy_only=False))
        parts = [self._parts(pieces[int(r)].as_py().decode()) for r in rows]
        inner = pa.array([x for p in parts for x in p if isinstance(x, bytes)], pa.large_binary())
        plain = pc.if_else(left, pa.scalar(b"", pa.large_binary()), pieces)
        ids, bounds = self.automaton.encode(pa.concat_arrays([plain, inner]))
        pool, at, sizes = [ids[:bounds[len(pieces)]]], len(pieces), []
        for p in parts:
            own = []
            for x in p:
                own.append(ids[bounds[at]:bounds[at + 1]] if isinstance(x, bytes) else np.array([x], np.uint32))
                at += isinstance(x, bytes)
            sizes.append(sum(map(len, own)))
            pool += own
        entry[rows] = len(pieces) + np.arange(len(rows))
        return np.concatenate(pool), np.append(bounds[:len(pieces) + 1], bounds[len(pieces)] + np.cumsum(sizes)), entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (a null is empty), and the bounds of each text."""
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for parts, owners in self._splitter.groups(texts):
            pieces, index, piece_bounds, whole = self._splitter.split(parts)
            pool, bounds, entry = self._table(pieces, whole)
            found, ends = spread(pool, bounds, entry[index])
            ids.append(found)
            np.add.at(counts, owners, np.diff(ends[piece_bounds]))
        return np.concatenate(ids), np.append(0, np.cumsum(counts))

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes that the labels of the ids spell."""
        return spread(*self._spelled, ids)[0].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(ids).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each with a comma after it."""
        return spread(*self._decimal, ids)[0].tobytes()


def _pool(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = list(parts)
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's compiled automaton for a file: fixed tables that do not grow with the input."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in small_batches(batches):
            ids, bounds = own.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), lists], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    bounds, flat = np.asarray(column.offsets), np.asarray(column.values)
    return (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:]))


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            texts = pa.array([own.decode(x) for x in _lists(batch.column("ids"))], pa.string())
            yield pa.record_batch([batch.column("doc_id"), texts], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(ids: DataFrame, path: str, chunk: int = 1 << 18) -> DataFrame:
    """``doc_id``, number of ids, and SHA-256 of the ids in decimal and of the decoded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            numbers, of_ids, of_text = [], [], []
            for x in _lists(batch.column("ids")):
                digest, text, decoder = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                for at in range(0, len(x), chunk):
                    part, final = x[at:at + chunk], at + chunk >= len(x)
                    digest.update(own.decimal(part)[:-1 if final else None])
                    text.update(decoder.decode(own.spelled(part), final).encode())
                numbers.append(len(x))
                of_ids.append(digest.hexdigest())
                of_text.append(text.hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids.select("doc_id", "ids").mapInArrow(run, SCHEMA)
