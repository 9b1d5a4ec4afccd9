"""Repairs against trying all sequences of edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from reachlens.llm import structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, copy int, place long, c string"


@pytest.fixture
def conversations(session):
    """Conversations with extra columns whose names clash."""
    return lambda rows: session.createDataFrame([(*r, 7, 1, "c") for r in rows], SCHEMA)


def all_repairs(rows, bound):
    """Every sequence of edits up to a cost: cost, letters, repaired turns. rows: initial, must go, truncated."""
    def grow(i, cost, letters, turns):
        if cost > bound:
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", "".join(r for r, _ in turns)):
                yield cost, letters, turns
        else:
            initial, gone, truncated = rows[i]
            yield from grow(i + 1, cost + 2, letters + "D", turns)
            if not gone:
                yield from grow(i + 1, cost + 5 * truncated, letters + "K", [*turns, (initial, i)])
                for r in "ua":
                    yield from grow(i + 1, cost + 1 + 5 * truncated, letters + "R", [*turns, (r, i)])
        for r in "ua":
            yield from grow(i, cost + 5, letters + "I", [*turns, (r, None)])

    return grow(0, 0, "", [])


def plain(rows):
    """The contract read row by row; rows: role, text of one conversation after the damage."""
    faults, seen = [], set()
    for role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    lattice = [(role[:1] or "-", f in ("blank", "duplicate"), f == "truncated") for (role, _), f in zip(rows, faults)]
    cost, letters, turns = min(all_repairs(lattice, 2 * len(rows)), key=lambda x: x[:2])
    made = []
    for place, (r, i) in enumerate(turns):
        given = {"u": "user", "a": "assistant"}.get(r)
        made.append(f"{given}:" if i is None else f"{rows[i][0] if rows[i][0][:1] == r and _kept(letters, i) else given}:{rows[i][1]}")
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (*[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters,
            hashlib.sha256("\n".join(made).encode()).hexdigest())


def _kept(letters, row):
    return letters.replace("I", "")[row] == "K"


def expected(rows):
    kept, ids = defaultdict(list), {r[0] for r in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [] if kind == 0 else [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv in ids:
        own = sorted(kept[conv])
        turns = {t for known, t, *_ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *plain([r[2:] for r in own])))
    return out


def test_lattice_against_all_repairs():
    codes = list(range(9))
    rnd = random.Random(2)
    cases = [*itertools.product(codes, repeat=2), *([rnd.choice(codes) for _ in range(n)] for n in (0, 1, 3, 4, 5) for _ in range(60))]
    for case in cases:
        rows = [("suao"[(c - 1) % 4], c == 0, c > 4) for c in case]
        cost, letters, turns = min(all_repairs(rows, 2 * len(rows)), key=lambda x: x[:2])
        assert sr.solve(case) == (cost, letters), case
        auction = sr.Auction(case, sr.at_last())
        for place, code in enumerate(case):  # prices are feasible: no arc is cheaper than the fall in price
            for state in range(4):
                assert auction.prices[place][state] <= 5 + auction.prices[place][sr._AFTER[state]]
                assert all(auction.prices[place][state] <= c + auction.prices[place + 1][to] for _, c, to in sr.row_arcs(code)[state])
        roles = ["system user assistant other".split()["suao".index(r)] for r, *_ in rows]
        assert [(i, r[0]) for i, r in sr.repaired_roles(letters, roles)] == [(i, r) for r, i in turns]


def made(seed, n, length=4):
    rnd = random.Random(seed)
    texts = ["a.", "b", "b ", "c!", " \n", "", "same?", None, "e.  ", "x. ", "é。"]
    rows = []
    for conv in rnd.sample(range(-50, 5 * n), n):
        for turn in range(rnd.randint(1, length)):
            rows.append((conv, turn * rnd.randint(1, 2), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "usage", ""]), rnd.choice(texts)))
    return rows + [(None, 1, "user", "hi."), (None, None, "assistant", "ho."), (9999, None, None, None), (9999, None, "user", "x."), (9998, 3, "user", "x"), (9998, 3, "user", "x")]


KEY = lambda r: tuple((x is None, str(type(x)), x) for x in r)


def test_short_conversations(conversations, rows):
    table = made(1, 250)
    assert rows(sr.repaired(conversations(table))) == sorted(expected(table), key=KEY)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_long_conversations_in_blocks(conversations, rows, block):
    table = made(block, 40, 6)
    assert rows(sr.repaired(conversations(table), long_rows=block, long_bytes=0)) == sorted(expected(table), key=KEY)


def test_both_ways_agree_on_long_conversations(conversations, rows):
    rnd = random.Random(8)
    table = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", f"{t}."])) for c in (1, 2) for t in range(900)]
    assert rows(sr.repaired(conversations(table))) == rows(sr.repaired(conversations(table), long_rows=64))


def test_no_conversations(conversations):
    assert sr.repaired(conversations([])).count() == 0
