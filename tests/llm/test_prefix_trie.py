"""The prefix trie against a plain tree, and the centroid rollup by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachlens.llm import ordering, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, bytes string, k1 string"


@pytest.fixture
def conversations(session):
    """Conversations with extra columns whose names clash."""
    return lambda rows: session.createDataFrame([(*r, 1, "b", "k") for r in rows], SCHEMA)


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c in own:
        base, h = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        full = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, len(full)))
    out, totals = [], {}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        n = len(members[p])
        saved = (n - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(totals[x][0] for x in children[p]) or 1, saved + sum(totals[x][1] for x in children[p]))
    for p, m in members.items():
        ended = sorted(c for c, length in m if length == len(p))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(children[p]), *totals[p],
                    hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return out


def some(seed, n, turns=7, vocabulary=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(3 * n), n):
        for turn in range(rnd.randint(1, turns)):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é" * 3, "", None, "long text"][:vocabulary])))
    rnd.shuffle(rows)
    return rows


def test_subtree_totals():
    rnd = np.random.default_rng(3)
    for n, reach in [(1, 1), (2, 1), (50, 1), (300, 2), (300, 300), (700, 12), (40, 40)]:
        parent = np.array([-1 if i == 0 or rnd.random() < 0.05 else int(rnd.integers(max(0, i - reach), i)) for i in range(n)])
        level = np.zeros(n, np.int64)
        for i in range(n):
            level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
        order = np.argsort(level, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        parent = np.where(parent[order] >= 0, back[parent[order]], -1)
        values = rnd.integers(-5, 2**60 // n, (n, 2))
        plain = values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                plain[parent[i]] += plain[i]
        assert np.array_equal(prefix_trie.subtree_totals(parent, level[order], values), plain)


@pytest.mark.parametrize("most", [1 << 16, 3, 25])
def test_trie(conversations, rows, most):
    made = some(1, 60) + [(None, 1, "user", "x"), (2, None, "user", "first"), (2, 1, "user", "x"), (2, 1, "user", "x"), (2, 1, "user", "x")]
    made += [(c, 0, "user", "hot") for c in range(500, 560)] + [(c, 1, "user", "hot") for c in range(500, 540)] + [(-7, 0, "a", "b"), (-5, 1, "c", "d"), (0, 9, "u", "v")]
    made += [(1000, t, "user", f"long {t % 5}") for t in range(70)] + [(2**63 - 1, 1, "a", "b"), (-(2**63), 1, "a", "b")]
    got = prefix_trie.conversation_trie(conversations(made), most)
    key = lambda r: tuple((x is None, x) for x in r)
    assert rows(got) == sorted(expected(made), key=key)


def test_blocks_of_long_conversations(conversations, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "_CHUNK_IDS", 3)
    made = [(c, t, "user", f"{t % 2}") for c in (5, 6, 7) for t in range(30 + c)] + some(5, 30, vocabulary=2) + [(c, 0, "user", "same") for c in range(300, 350)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert rows(prefix_trie.conversation_trie(conversations(made), 8)) == sorted(expected(made), key=key)


def test_no_conversations(conversations):
    assert prefix_trie.conversation_trie(conversations([])).count() == 0
    assert prefix_trie.conversation_trie(conversations([(None, 1, "user", "x")])).count() == 0


def test_places_in_a_group_over_many_ranges(session):
    made = [(None if i % 9 == 0 else 1 if i % 3 else 2, i % 50, f"t{i % 7}") for i in range(2000)]
    frame = session.createDataFrame(made, "g long, x long, t string").repartition(6)
    got = ordering.numbered(frame, "g", [F.col("x"), F.col("t")], [F.col("x")], ["x", "t"])
    assert got.select(F.count("*"), F.countDistinct("g", "place")).first()[0] == 2000
    found = sorted((r.g is None, r.g or 0, r.place, r.x, r.t) for r in got.collect())
    plain = sorted((g is None, g or 0, x, t) for g, x, t in made)
    places, wanted = {}, []
    for n, g, x, t in plain:
        places[n, g] = places.get((n, g), 0) + 1
        wanted.append((n, g, places[n, g], x, t))
    assert found == sorted(wanted)
