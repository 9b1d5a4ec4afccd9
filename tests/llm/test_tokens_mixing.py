"""Token counts, token files, mixing."""

import random
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlens.llm import mixing, token_counts, token_output, tokens
from reachlens.llm.tokens import Encoder
from reachlens.sources.shared import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "   ", "\n", "\t", " \n", "a", "don't", "'s", " 's", "é", "ñandu", "日本", "’", "—", "\u2003", "x're", "'", "'v", "'ll", "123",
         "½²", "!!", "_x", "\x1c", "\x85", "ß", "I'LL", "😀", "\u0301", "Ω", "١", "<|endoftext|>", "\ufeff", "\u200b"]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_encoding_equals_the_tokenizer():
    texts, own, whole = [*random_texts(4000), "", None, "a" * 30000, " " * 5000], Encoder(PATH), Tokenizer.from_file(PATH)
    ids, bounds = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert list(ids[bounds[i]:bounds[i + 1]]) == whole.encode(t or "", add_special_tokens=False).ids, t
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 1]


def test_new_pieces_reach_the_tokenizer_joined():
    class Counted:
        handed, most = 0, 0

        def encode_batch_fast(self, texts, **options):
            self.handed, self.most = self.handed + len(texts), max(self.most, len(texts))
            return whole.encode_batch_fast(texts, **options)

    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters for b in letters for c in letters]
    odd = ["a \u2003", "b \u2003", " \u2003 x", "c \xa0", " \xa0", "d \x85", "e \x1c", " '", " 's", " x's", " !'ll go", " ½", " 日本 語", " <|endoftext|>", " é"]
    texts, whole = [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)] + odd + ["".join(f".{w}" for w in words)], Tokenizer.from_file(PATH)
    wanted = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for lengths_known in (True, False):
        own = Encoder(PATH)
        own._tokenizer = counted = Counted()
        if not lengths_known:  # every piece by itself, then
            own._id_bytes[:] = 1
        ids, bounds = own.encode(pa.array(texts))
        assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == wanted
        # An encoding for each of 17,000 pieces at once was what filled a worker's memory.
        assert counted.most <= 4096
        assert not lengths_known or counted.handed < 1.2 * len(words)


def test_pieces_are_not_split_again():
    """Words with a space before go to the tokenizer's model; before, all were joined and split once more."""
    handed = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            handed.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    rnd, own, whole = random.Random(8), Encoder(PATH), Tokenizer.from_file(PATH)
    own._tokenizer = Counted()
    words = ["".join(rnd.choice("abcdeéß日語") for _ in range(rnd.randint(5, 9))) for _ in range(5000)]
    texts = [" ".join(words), " ".join(words[::2]), " ½ 01- \u2003é  x's"]
    ids, bounds = own.encode(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, handed)) < 0.01 * len(texts[0])


def test_token_counts(documents, rows):
    texts, whole = [*random_texts(80), "", None, "word " * 3000, "", "word " * 3000], Tokenizer.from_file(PATH)
    lengths = np.array([len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts])
    counts = token_counts.histogram(token_counts.encoded_lengths(documents(list(enumerate(texts))), PATH))
    sums = token_counts.suffix_sums(counts).cache()
    expected = [(
        int(n), int((lengths == n).sum()), int((lengths >= n).sum()), int(lengths[lengths >= n].sum()), len(lengths), int(lengths.sum()),
        int(np.minimum(lengths, n).sum()), float((lengths <= n).sum() / len(lengths)),
    ) for n in sorted(set(lengths))]
    assert rows(sums) == expected
    limits = [0, 1, 7, 1000, 10**6]
    assert rows(token_counts.at_limits(sums, limits)) == [
        (c, int((lengths > c).sum()), int(np.minimum(lengths, c).sum()), int(lengths.sum())) for c in limits]
    shares = [0.1, 0.5, 1.0]
    ranked = np.sort(lengths)
    assert rows(token_counts.quantiles(sums, shares)) == [(q, int(ranked[int(np.ceil(q * len(ranked))) - 1])) for q in shares]
    assert token_counts.suffix_sums(counts.limit(0)).count() == 0


def test_token_files(session, documents, rows):
    made = [(i, t) for i, t in enumerate(random_texts(50))] + [(3, "again"), (3, "again"), (7, None), (None, "x"), (60, "long " * 5000)]
    path, whole = new_path(session, "ids"), Tokenizer.from_file(PATH)
    token_output.write(documents(made).repartition(5), PATH, path)
    got = token_output.digests(token_output.read(session, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in made), key=lambda i: (i is not None, i or 0))
    expected = Counter()
    for i, t in made:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    empty = new_path(session, "ids")
    token_output.write(documents([]), PATH, empty)
    assert token_output.digests(token_output.read(session, empty)).count() == 0


def test_token_file_layout(session, documents, tmp_path):
    token_output.write(documents([(i, "some words " * 50) for i in range(200)]).coalesce(1), PATH, str(tmp_path / "t"))
    group = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    (ids,) = [c for name, c in columns.items() if name.startswith("ids")]
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index


def test_targets():
    assert mixing.targets([10, 10, 10]) == [Fraction(20), Fraction(25, 3), Fraction(50, 3)]
    assert mixing.targets([100]) == [150]
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0, Fraction(15, 2)]
    for sizes in ([1, 1000, 3, 50], [7] * 11, [0, 0, 9, 400, 2]):
        got = mixing.targets(sizes)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes))


def test_flow_of_overlapping_sources_repeats_as_little_as_possible():
    supply = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    sent = mixing.min_cost_flow(supply, {"a": 150, "b": 60})
    per = {p: sum(n for (q, _), n in sent.items() if q == p) for p in supply}
    assert sum(n for (_, s), n in sent.items() if s == "a") == 150 and sum(n for (_, s), n in sent.items() if s == "b") == 60
    assert per == {("a",): 100, ("a", "b"): 100, ("b",): 10}  # all once, nothing twice
    sent = mixing.min_cost_flow({("a",): 10}, {"a": 15})
    assert sent == {(("a",), "a"): 15}
    assert sum(mixing.min_cost_flow({("a",): 10}, {"a": 50}).values()) == 20  # capacity ends at two epochs


def cheapest_by_force(supply, quota, epochs):
    """Total flow and cost, one cheapest path of one word after another (plain relaxation)."""
    arcs = {}
    for p, n in supply.items():
        for e in range(1, epochs + 1):
            arcs["start", (p, e)], arcs[(p, e), p] = [n, e], [n, 0]
        for s in p:
            if s in quota:
                arcs[p, ("to", s)] = [epochs * n, 0]
    for s, n in quota.items():
        arcs[("to", s), "end"] = [n, 0]
    arcs.update({(b, a): [0, -c] for (a, b), (_, c) in list(arcs.items())})
    flow = cost = 0
    while True:
        best, came = {"start": 0}, {}
        for _ in range(len(arcs)):
            moved = False
            for (a, b), (n, c) in arcs.items():
                if n and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], came[b], moved = best[a] + c, a, True
            if not moved:
                break
        if "end" not in best:
            return flow, cost
        flow, cost, at = flow + 1, cost + best["end"], "end"
        while at != "start":
            arcs[came[at], at][0] -= 1
            arcs[at, came[at]][0] += 1
            at = came[at]


def checked(supply, quota, sent, epochs):
    """Flow and cost of a plan that keeps all capacities."""
    per = {p: sum(n for (q, _), n in sent.items() if q == p) for p in supply} if len(supply) < 100 else Counter()
    if not per:
        for (p, _), n in sent.items():
            per[p] += n
    got = Counter()
    for (p, s), n in sent.items():
        assert n > 0 and s in p
        got[s] += n
    assert all(per[p] <= epochs * n for p, n in supply.items()) and all(n <= quota[s] for s, n in got.items())
    cost = sum(sum(max(0, per[p] - e * n) for e in range(epochs)) for p, n in supply.items())
    return sum(per.values()), cost


def test_flow_costs_as_little_as_word_by_word():
    rnd = random.Random(6)
    for _ in range(60):
        names, epochs = "abcde"[:rnd.randint(1, 5)], rnd.randint(1, 3)
        supply = {tuple(sorted(rnd.sample(names, rnd.randint(1, len(names))))): rnd.randint(0, 6) for _ in range(rnd.randint(0, 7))}
        quota = {s: rnd.randint(0, 15) for s in rnd.sample(names, rnd.randint(1, len(names)))}
        sent = mixing.min_cost_flow(supply, quota, epochs)
        assert checked(supply, quota, sent, epochs) == cheapest_by_force(supply, quota, epochs)
        assert sent == mixing.min_cost_flow(supply, quota, epochs)


def test_flow_of_many_patterns():
    rnd = random.Random(7)
    names = [f"s{i:02}" for i in range(30)]
    supply = {}
    while len(supply) < 20_000:
        supply[tuple(sorted(rnd.sample(names, rnd.choice([2, 3, 4, 5]))))] = rnd.randint(1, 10_000)
    total = sum(supply.values())
    quota = {s: int(total * 1.5 * (1 + i) / 465) for i, s in enumerate(names)}
    began = time.monotonic()
    sent = mixing.min_cost_flow(supply, quota)
    assert time.monotonic() - began < 60
    flow, cost = checked(supply, quota, sent, 2)
    assert flow == sum(quota.values()) and cost >= total + 2 * (flow - total)


def test_mix(session, documents, rows):
    rnd = random.Random(5)
    made = [(i, " ".join("w" * 3 for _ in range(rnd.randint(0, 40))), rnd.choice(["hot", "hot", "hot", "é", "b", None])) for i in range(400)]
    made += [(7, "same text", "hot")] * 3 + [(None, None, "b"), (900, "w " * 20000, "b")]
    docs = documents(made).withColumn("members", F.array("source")).withColumn("size", F.expr(mixing.size_sql()))
    mix, figures = mixing.mixed(docs, "members", "size")
    got = mix.select("doc_id", "source", "size", "taken").collect()
    assert len(got) == len(made)
    goal = {r.source: r for r in figures.collect()}
    assert list(goal) == ["b", "hot", "é", None]
    for source, r in goal.items():
        own = [x for x in got if x.source == source]
        assert r.source_size == sum(x.size for x in own)
        assert abs(sum(x.taken for x in own) - r.target) <= 3 and all(0 <= x.taken <= 2 * x.size for x in own)
    again, _ = mixing.mixed(docs.repartition(7), "members", "size")
    assert rows(again, "doc_id", "source", "taken") == rows(mix, "doc_id", "source", "taken")
    assert mixing.mixed(docs.limit(0), "members", "size")[0].count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, "members", "size", max_patterns=2)


def test_overlapping_mix_and_repeats(documents, rows):
    docs = documents([(i, "one two three four") for i in range(30)]).selectExpr(
        "*", "CASE WHEN doc_id < 10 THEN array('a') WHEN doc_id < 20 THEN array('b', 'a') ELSE array('b') END AS members", "4L AS size")
    mix, figures = mixing.mixed(docs, "members", "size", quota={"a": 70, "b": 60})
    assert mix.agg(F.sum("taken")).first()[0] == 130
    out = mixing.repeated(mix, "size", docs.columns)
    assert out.columns == docs.columns and 30 <= out.count() <= 35


def test_long_texts_are_encoded_in_segments(monkeypatch):
    monkeypatch.setattr(tokens, "_SEGMENT_CHARS", 50)
    monkeypatch.setattr(tokens, "_BATCH_BYTES", 120)
    own, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["".join(random_texts(60, s)) for s in range(20)] + ["x" * 9000 + " y" * 300, None, "a  b" * 500, "é—" * 400]
    ids, bounds = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert "".join(own._splitter.segments(t or "")) == (t or "")
        assert list(ids[bounds[i]:bounds[i + 1]]) == whole.encode(t or "", add_special_tokens=False).ids, t


def test_remembered_pieces_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED_BYTES", 2000)
    own, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    for text in [*random_texts(300, 8), "a\0b \0 c\0", "\0" * 20, "longer than sixteen bytes: " + "q" * 40]:
        ids, _ = own.encode(pa.array([text]))
        assert list(ids) == whole.encode(text, add_special_tokens=False).ids
        assert own._remembered._keys.nbytes < 6000


def test_a_file_of_another_kind_is_left_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = Encoder(path), Tokenizer.from_file(path)
    texts = ["Some Words, here", "", "don't  stop", "é ñ"]
    ids, bounds = own.encode(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(bounds, bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.is_plain(PATH) and not tokens.is_plain(path)


def test_what_a_task_remembers_ends_with_it():
    with tokens.encoder(PATH) as own:
        own.encode(pa.array(["some words"]))
        assert len(own._remembered._keys)
    with tokens.encoder(PATH) as again:
        assert again is own and not len(own._remembered._keys)
