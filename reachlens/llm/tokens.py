"""Encoding of whole texts with a tokenizer file, in Arrow batches.

A byte-level BPE first splits a text into pieces (words with the space before them, numbers,
runs of other signs, white space) and encodes each piece by itself. :class:`Splitter` computes
that split for a whole batch at once from the class of every character; :class:`Encoder` has
the distinct pieces of the batch encoded once by the tokenizer and remembers pieces it met,
up to a number of bytes, until its task ends. The ids are those the tokenizer gives for the
whole text. Texts with characters whose class depends on the Unicode version, or with a string
that the tokenizer treats apart, are handed to it whole; so is every text if the file is not
of the plain byte-level kind (no normalizer, no added prefix, no post-processing).

A text of more than a few megabytes is encoded in segments that end where a piece ends
whatever stands around it: before white space that follows something visible, or between a
letter and a sign. A text without such a place is one segment.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The contractions that the byte-level split keeps as pieces.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
_REMEMBERED_BYTES = 24 << 20
_BATCH_BYTES = 3 << 20
_SEGMENT_CHARS = 1 << 20
_JOINED_PIECES = 4096


def _character_classes() -> np.ndarray:
    """Class of every code point; unsure where an old and the present Unicode disagree."""
    old, out = unicodedata.ucd_3_2_0, np.full(0x110000, _UNSURE, np.uint8)
    for code in range(0x30000):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind != old.category(char) or kind in ("Cn", "Cs"):
            continue
        out[code] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
        if kind[0] == "Z":
            out[code] = _SPACE
    out[list(range(9, 14)) + [0x85]] = _SPACE
    out[list(range(0x1C, 0x20)) + [0x180E, 0x200B]] = _UNSURE
    return out


def _byte_characters() -> dict[int, int]:
    """The character that a byte-level BPE spells each byte with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return dict(zip([*shown, *hidden], [*shown, *range(0x100, 0x100 + len(hidden))]))


_BYTE_CHARS = _byte_characters()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _offsets(pieces: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:][:len(pieces) + 1]


def is_plain(path: str) -> bool:
    """Whether the file is a byte-level BPE whose split is the one computed here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        not any(spec.get(part) for part in ("normalizer", "truncation", "padding"))
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        and (spec.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel" and model.get("type") == "BPE"
        and not any(model.get(part) for part in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t.get(part) for t in spec.get("added_tokens", ()) for part in ("single_word", "lstrip", "rstrip", "normalized"))
    )


class Splitter:
    """Cuts the texts of a batch into pieces. ``special`` are strings treated apart."""

    def __init__(self, special: Sequence[str] = (), plain: bool = True):
        self._special, self._plain = list(special), plain
        self._class = _character_classes()

    def _cuts(self, code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces begin. ``first`` marks the first character of each text."""
        space = kind == _SPACE
        last = np.append(first[1:], True)
        cut = first.copy()
        # A change of class begins a piece, except after a plain space, which joins what follows.
        cut[1:] |= (kind[1:] != kind[:-1]) & (code[:-1] != 0x20)
        # Of several white spaces before something visible, the last stands apart.
        cut[1:] |= space[1:] & space[:-1] & ~last[1:] & ~np.append(space[2:], True)
        for at in np.flatnonzero(code == 0x27):
            # Only where a piece begins at the apostrophe can it open a contraction.
            if not cut[at]:
                continue
            for short in CONTRACTIONS:
                end = at + len(short)
                if end <= len(code) and not first[at + 1:end].any() and all(code[at + i] == ord(c) for i, c in enumerate(short)):
                    cut[at + 1:end] = False
                    if end < len(code):
                        cut[end] = True
                    break
        return np.flatnonzero(cut)

    def segments(self, text: str) -> list[str]:
        """The text in parts of about a million characters whose pieces are its pieces."""
        if len(text) <= _SEGMENT_CHARS or not self._plain or any(c.isspace() for s in self._special for c in s):
            return [text]
        out, start, look = [], 0, _SEGMENT_CHARS
        while start + look < len(text):
            kind = self._class[_codes(text[start + look - 1:start + look + 4096])]
            before, here = kind[:-1], kind[1:]
            seen = (before == _LETTER) | (before == _NUMBER) | (before == _OTHER)
            places = np.flatnonzero(seen & (here == _SPACE))
            if not len(places) and not self._special:
                places = np.flatnonzero((before == _LETTER) & (here == _OTHER))
            if len(places):
                end = start + look + int(places[0])
                out.append(text[start:end])
                start, look = end, _SEGMENT_CHARS
            else:
                look += 4096
        return [*out, text[start:]]

    def split(self, texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, set[bytes]]:
        """Distinct pieces; for every piece of the batch its place among them; the bounds of
        each text in that; and those pieces that are texts left whole."""
        array = pa.array(texts, pa.large_string())
        joined = "".join(texts)
        data = joined.encode()
        code = _codes(joined)
        length = pc.utf8_length(array).to_numpy().astype(np.int64)
        size = pc.binary_length(array).to_numpy().astype(np.int64)
        start, offset = np.cumsum(length) - length, np.cumsum(size) - size
        if self._plain:
            kind = self._class[code]
            unsure = np.flatnonzero(kind == _UNSURE)
            whole = np.searchsorted(unsure, start + length) > np.searchsorted(unsure, start)
            for special in self._special:
                if special in joined:
                    whole |= pc.match_substring(array, special).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(len(texts), bool)
        first = np.zeros(len(code), bool)
        first[start[length > 0]] = True
        if whole.all():
            begins = np.flatnonzero(first)
        else:
            begins = self._cuts(code, kind, first)
            if whole.any():  # such texts are one piece each
                inside = np.repeat(whole, length)[begins]
                begins = begins[~inside | first[begins]]
        if len(data) > len(code):  # bytes that begin a character
            byte_at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[begins]
        else:
            byte_at = begins
        offsets = np.append(byte_at, len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        bounds = np.searchsorted(offsets[:-1], np.append(offset, len(data)))
        return coded.dictionary, coded.indices.to_numpy(), bounds, {texts[i].encode() for i in np.flatnonzero(whole)}

    def groups(self, texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
        """The texts of a batch (a null is empty) as segments, a few megabytes at a time, with
        the row each comes from."""
        parts, owners, held = [], [], 0
        for row, text in enumerate(texts):
            for part in self.segments(text.as_py() or ""):
                parts.append(part)
                owners.append(row)
                held += len(part)
                if held >= _BATCH_BYTES:
                    yield parts, owners
                    parts, owners, held = [], [], 0
        if parts:
            yield parts, owners


def spread(pool: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``index`` of a pool end to end, and where each ends (from 0 on)."""
    return _runs(pool, bounds[index], np.diff(bounds)[index])


def _runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    if not len(ends):
        return pool[:0], np.zeros(1, np.int64)
    places = np.arange(ends[-1])
    places += np.repeat(starts - (ends - lengths), lengths)
    return pool[places], np.append(0, ends)


class Remembered:
    """Ids of short pieces: keys of 16 bytes, sorted by a hash of theirs, and the ids of each in one
    pool. Of keys with one hash the first is found. When it would hold more than a number of
    bytes, it starts again from the newest pieces."""

    _WIDTH = 16

    def __init__(self):
        self._keys, self._hashes, self._pool = np.zeros(0, f"S{self._WIDTH}"), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self._starts, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _halves(self, keys: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        halves = self._halves(keys) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        return halves[:, 0] ^ (halves[:, 1] << np.uint64(31) | halves[:, 1] >> np.uint64(33))

    def keys(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """A key for each piece, and which pieces have one: no zero bytes, which keys cannot end in."""
        offsets, data = _offsets(pieces), np.frombuffer(pieces.buffers()[2], np.uint8)
        size, signs = np.diff(offsets), np.zeros((len(pieces), self._WIDTH), np.uint8)
        fits = (size > 0) & (size <= self._WIDTH)
        for place in range(self._WIDTH):
            rows = np.flatnonzero(fits & (size > place))
            signs[rows, place] = data[offsets[rows] + place]
        fits &= (signs != 0).sum(1) == size
        return signs.view(f"S{self._WIDTH}").ravel(), fits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        if not len(self._keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._hashes, self._hash(keys)), len(self._keys) - 1)
        return np.where((self._halves(self._keys)[at] == self._halves(keys)).all(1), at, -1)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _runs(self._pool, self._starts[entries], self._sizes[entries].astype(np.int64))

    def add(self, keys: np.ndarray, bounds: np.ndarray, pool: np.ndarray) -> None:
        if sum(x.nbytes for x in (self._keys, self._hashes, self._starts, self._sizes, self._pool)) > _REMEMBERED_BYTES:
            self.__init__()
        # Only the entries are sorted, the pool stays as it is.
        starts = np.concatenate([self._starts, len(self._pool) + bounds[:-1]])
        sizes = np.concatenate([self._sizes, np.diff(bounds).astype(np.uint32)])
        keys, hashes = np.concatenate([self._keys, keys]), np.concatenate([self._hashes, self._hash(keys)])
        order = np.argsort(hashes, kind="stable")
        self._keys, self._hashes, self._starts, self._sizes = keys[order], hashes[order], starts[order], sizes[order]
        self._pool = np.concatenate([self._pool, pool])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._splitter = Splitter([t.content for t in self._tokenizer.get_added_tokens_decoder().values()], is_plain(path))
        # Byte-level tokens are spelled with one character a byte.
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._id_bytes = np.zeros(1 + max([*vocabulary.values(), *self._tokenizer.get_added_tokens_decoder()], default=0), np.int64)
        for token, i in vocabulary.items():
            self._id_bytes[i] = len(token)
        self._model = self._tokenizer.model
        self._one_line_end = len(self._tokenizer.encode_batch_fast(["\n"], add_special_tokens=False)[0].ids) == 1
        self._remembered = Remembered()

    def _listed(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each encoded by itself, and how many each has."""
        pools, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(pieces), _JOINED_PIECES):
            texts = pieces.slice(start, _JOINED_PIECES).cast(pa.large_string()).to_pylist()
            found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            pools.append(np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(pools), np.concatenate(sizes)

    def _joined(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that are split where they were joined when they stand end to end; the
        bytes that the ids stand for tell where each piece ends."""
        pools, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(pieces), _JOINED_PIECES):
            some = pieces.slice(start, _JOINED_PIECES)
            offsets = _offsets(some)
            text = some.buffers()[2][int(offsets[0]):int(offsets[-1])].to_pybytes().decode()
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self._id_bytes[ids]), offsets[1:] - offsets[0]
            at = np.minimum(np.searchsorted(ends, wanted), max(len(ends) - 1, 0))
            if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():  # ids that do not stand for all bytes
                ids, counts = self._listed(some)
            else:
                counts = np.diff(at, prepend=-1)
            pools.append(ids)
            sizes.append(counts)
        return np.concatenate(pools), np.concatenate(sizes)

    def _modelled(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the tokenizer's model, which takes a piece spelled with one character a byte
        and leaves out what the tokenizer does to find pieces."""
        offsets, encode, pools, sizes = _offsets(pieces), self._model.tokenize, [np.zeros(0, np.uint32)], []
        for start in range(0, len(pieces), _JOINED_PIECES):
            ends = offsets[start:start + _JOINED_PIECES + 1]
            spelled = pieces.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes().decode("latin-1").translate(_BYTE_CHARS)
            ends, ids = (ends - ends[0]).tolist(), []
            for a, b in zip(ends, ends[1:]):
                found = encode(spelled[a:b])
                sizes.append(len(found))
                ids.extend([token.id for token in found])
            pools.append(np.array(ids, np.uint32))
        return np.concatenate(pools), np.array(sizes, np.int64)

    def _lines(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces of letters only: with a line end behind each, which is a piece by
        itself and one id."""
        ended = pc.binary_join_element_wise(pieces, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        ids, counts = self._joined(ended)
        return np.delete(ids, np.cumsum(counts) - 1), counts - 1

    def _table(self, pieces: pa.LargeBinaryArray, whole: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the given pieces in a pool, its bounds, and the place of each piece in those.
        ``whole`` are pieces that are texts left whole."""
        keys, fits = self._remembered.keys(pieces)
        entry = np.where(fits, self._remembered.find(keys), -1)
        known, missing = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        old, old_ends = self._remembered.ids(entry[known])
        new_pieces = pieces.take(pa.array(missing))
        strings = new_pieces.cast(pa.large_string())
        spaced = pc.match_substring_regex(strings, r"^ [^\s\x0b\x1c-\x1f\x85\pZ]").to_numpy(zero_copy_only=False)
        lines = pc.match_substring_regex(strings, r"^[A-Za-z]+$").to_numpy(zero_copy_only=False) & self._one_line_end
        if whole:
            apart = pc.is_in(new_pieces, pa.array(list(whole), pa.large_binary())).to_numpy(zero_copy_only=False)
            spaced, lines = spaced & ~apart, lines & ~apart
        kinds = spaced, lines, ~(spaced | lines)
        missing = np.concatenate([missing[kind] for kind in kinds])
        parts = [encode(new_pieces.filter(pa.array(kind))) for encode, kind in zip((self._modelled, self._lines, self._listed), kinds)]
        new, sizes = (np.concatenate(x) for x in zip(*parts))
        new_ends = np.append(0, np.cumsum(sizes))
        pool, ends = np.concatenate([old, new]), np.concatenate([old_ends, len(old) + new_ends[1:]])
        back = np.empty(len(pieces), np.int64)
        back[known], back[missing] = np.arange(len(known)), len(known) + np.arange(len(missing))
        kept = np.flatnonzero(fits[missing])
        kept_pool, kept_ends = spread(new, new_ends, kept)
        self._remembered.add(keys[missing[kept]], kept_ends, kept_pool)
        return pool, ends, back

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (a null is empty), and the bounds of each text."""
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for parts, owners in self._splitter.groups(texts):
            pieces, index, piece_bounds, whole = self._splitter.split(parts)
            pool, pool_ends, place = self._table(pieces, whole)
            found, ends = spread(pool, pool_ends, place[index])
            ids.append(found)
            np.add.at(counts, owners, np.diff(ends[piece_bounds]))
        return np.concatenate(ids), np.append(0, np.cumsum(counts))

    def forget(self) -> None:
        self._remembered = Remembered()


_ENCODERS: dict[str, Encoder] = {}


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for a tokenizer file; what it remembers goes when the task ends."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    try:
        yield _ENCODERS[path]
    finally:
        _ENCODERS[path].forget()


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few megabytes of text; a longer text is a batch by itself."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        group = np.cumsum(size) // _BATCH_BYTES
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
