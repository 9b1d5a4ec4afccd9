"""Conversation structure repair by the auction shortest-path algorithm.

A conversation is repaired by keeping, re-roling, deleting and inserting turns until its role
initials read ``(s?(ua)+)?``. The edits are arcs of a lattice whose nodes are a place between
rows and what has been read so far (nothing, a system turn, a user turn, an assistant turn);
costs are integers. :class:`Auction` finds shortest ways to the end: nodes carry prices that
never exceed the cost of an arc plus the price it leads to; a path grows from an origin along
tight arcs, and where none is tight the price of its last node is raised and the path
contracts. Origins are taken from the end of the lattice on, so a path stops at the first node
with a converged price. Converged prices expose the tight arcs, and the repair is read off them
from the start: at every node the arc whose letter (D, I, K, R) sorts first. A letter leads
to one node only, so that is the least of all cheapest repairs in ASCII order.

Conversations are dealt out by id and each is solved where its rows are, a batch of rows and
one conversation at a time in memory. One of more than ``long_rows`` rows or ``long_bytes``
bytes is not gathered: its rows are numbered over ranges (``ordering.numbered``), its lattice is
cut into blocks, each block's shortest distances from all entry to all exit nodes are found by
auctions in separate tasks, a short scan over blocks carries exit prices back and entry nodes
forward, and each block is then traced by itself. Only the hash of the repaired texts, which
no task can split, and the letters of the audit, a value of the result, follow such a
conversation row by row, as a stream.

Defined results: a null role or text is one space, and a null id or turn one space in the
text that decides the damage; rows with a null ``conv_id`` are one conversation; turns are
ordered nulls first, rows of one turn by role and text (in code-point order, after the damage);
repeated rows are rows each; a conversation without rows after the damage has zeros, an empty
audit and the hash of nothing; an empty table gives an empty result; columns besides the four
are not read, whatever their names. A row whose role has another initial, or none, is re-roled
or deleted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reachlens.llm.ordering import numbered, whole_groups
from reachlens.operators.common import left_join_unique
from reachlens.sources.shared import written

# Costs of the edits, and the roles a turn may be given.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GIVEN = {"u": "user", "a": "assistant"}

# States: nothing read, s, u, a. A repair may end where nothing or an a was read last.
_START, _S, _U, _A = range(4)
_AFTER = {_START: _U, _S: _U, _U: _A, _A: _U}  # where the next user or assistant turn leads
_ENDS = (_START, _A)
_FAR = 1 << 40

# Codes of rows: 0 deleted in any case; else 1 + initial (s, u, a, other) + 4 if truncated.
MUST_GO = 0
_INITIALS = {"s": 0, "u": 1, "a": 2}

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NOTHING = hashlib.sha256(b"").hexdigest()
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def row_arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state, the arcs over a row: letter, cost, state after it."""
    arcs: list[list[tuple[str, int, int]]] = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if code != MUST_GO:
            more = TRUNCATED if code > 4 else 0
            initial = (code - 1) % 4
            if initial == 0 and state == _START:
                own.append(("K", KEEP + more, _S))
            if initial in (1, 2) and _AFTER[state] == initial + 1:
                own.append(("K", KEEP + more, _AFTER[state]))
            own.append(("R", REROLE + more, _AFTER[state]))
        arcs.append(own)
    return arcs


_ARCS = [row_arcs(code) for code in range(9)]


def _floor(after: Sequence[int]) -> list[int]:
    """Prices to start from: of the nodes that a way must pass next, the cheapest."""
    turn = min(after[_U], after[_A])
    return [min(after), min(after[_S], turn), turn, turn]


class Auction:
    """Prices of all nodes of the lattice over ``codes``, given prices at its end."""

    def __init__(self, codes: Sequence[int], at_end: Sequence[int]):
        self.codes = codes
        self.prices = [[0] * 4 for _ in codes] + [list(at_end)]
        self._close(len(codes))
        for place in range(len(codes) - 1, -1, -1):
            self.prices[place] = _floor(self.prices[place + 1])
            self._converge(place, _ARCS[codes[place]], self.prices[place + 1])

    def _close(self, place: int) -> None:
        """The last nodes lead to the end at the given prices, or to each other by an insertion."""
        given = self.prices[place]
        self.prices[place] = _floor(given)
        self.ends = list(given)
        self._converge(place, [[("", price, state)] for state, price in enumerate(given)], [0] * 4)

    def _converge(self, place: int, rows: list[list[tuple[str, int, int]]], after: list[int]) -> None:
        """Auctions from the four nodes of a place; what they lead to over a row has converged."""
        price, settled = self.prices[place], [False] * 4
        for origin in range(4):
            path = [origin]
            while not settled[path[-1]]:
                node = path[-1]
                inserted = INSERT + price[_AFTER[node]]
                onward = min(cost + after[state] for _, cost, state in rows[node])
                best = min(inserted, onward)
                if price[node] < best:
                    price[node] = best  # raise, and contract
                    if len(path) > 1:
                        path.pop()
                elif onward == best:
                    settled[node] = True  # extended to a converged node
                else:
                    path.append(_AFTER[node])
            for node in path:
                settled[node] = True

    def trace(self, state: int) -> tuple[str, int]:
        """Letters from an entry node to the end, least in ASCII order, and the exit node."""
        letters, place, last = [], 0, len(self.codes)
        while True:
            price = self.prices[place]
            tight = []
            if price[state] == INSERT + price[_AFTER[state]]:
                tight.append(("I", place, _AFTER[state]))
            if place < last:
                after = self.prices[place + 1]
                tight += [(letter, place + 1, to) for letter, cost, to in _ARCS[self.codes[place]][state] if price[state] == cost + after[to]]
            elif price[state] == self.ends[state]:
                # The block ends here: insertions on its right border belong to what follows.
                return "".join(letters), state
            letter, place, state = min(tight)
            letters.append(letter)


def at_last() -> list[int]:
    return [0 if state in _ENDS else _FAR for state in range(4)]


def solve(codes: Sequence[int]) -> tuple[int, str]:
    """Cost of the cheapest repair and the least of its audits."""
    auction = Auction(codes, at_last())
    return auction.prices[0][_START], auction.trace(_START)[0]


def repaired_roles(letters: str, roles: Sequence[str]) -> Iterator[tuple[int | None, str]]:
    """For each turn of the repaired conversation, the row it comes from (None: inserted) and its role."""
    state, row = _START, 0
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        kept_system = letter == "K" and roles[row][:1] == "s"
        state = _S if kept_system else _AFTER[state]
        given = GIVEN["u" if state == _U else "a"]
        if letter == "I":
            yield None, given
        else:
            yield row, roles[row] if letter == "K" else given
            row += 1


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that CRC-32 of ``conv_id:turn`` decides."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.expr("CASE WHEN kind = 4 THEN 'user' ELSE role END").alias("role"),
        F.expr("CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("CASE WHEN kind = 3 THEN array(0, 1) ELSE array(0) END")).alias("copy"))


def _fault(text: str, seen: bool) -> str:
    last = next((c for c in reversed(text) if _VISIBLE.match(c)), None)
    return "blank" if last is None else "duplicate" if seen else "truncated" if last not in ".!?" else ""


def _code(role: str, fault: str) -> int:
    return MUST_GO if fault in ("blank", "duplicate") else 1 + _INITIALS.get(role[:1], 3) + 4 * (fault == "truncated")


def _illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def short_conversations(rows: DataFrame) -> DataFrame:
    """``SCHEMA`` for the conversations of damaged rows, each solved by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["conv_id"], 1 << 12):
            conv, turn, role, text = (table[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))
            out, start = [], 0
            for i in range(1, len(conv) + 1):
                if i == len(conv) or conv[i] != conv[start]:
                    out.append((conv[start], *_repaired(turn[start:i], role[start:i], text[start:i])))
                    start = i
            yield pa.record_batch([pa.array(x, pa.int64() if k not in (7, 8) else pa.string()) for k, x in enumerate(zip(*out))],
                                  [c.split()[0] for c in SCHEMA.split(", ")])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def _repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    seen, codes, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", ""), 0)
    for role, text in zip(roles, texts):
        fault = _fault(text, (role, text) in seen)
        seen.add((role, text))
        counts[fault] += 1
        codes.append(_code(role, fault))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    cost, audit = solve(codes)
    lines = (f"{role}:{'' if row is None else texts[row]}" for row, role in repaired_roles(audit, roles))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], _illegal([r[:1] for r in roles]), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def long_conversations(rows: DataFrame, block: int = 4096) -> DataFrame:
    """``SCHEMA`` for the conversations of damaged rows, none of them gathered in one place."""
    rows = rows.withColumn("conv", F.coalesce("conv_id", F.lit(0))).withColumn("none", F.col("conv_id").isNull())
    # Ids and the null id are numbered first, as one column of no nulls.
    ids = written(rows.select("conv", "none").distinct().withColumn("c", F.monotonically_increasing_id()), "ids")
    rows = rows.join(ids, ["conv", "none"]).drop("conv", "none")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    placed = written(numbered(rows, "c", order, [order[0], order[1], F.substring("text", 1, 32)], ["conv_id", "turn", "role", "text"]), "placed")
    # A row is a duplicate unless it is the first of its role and text; two digests stand for them.
    marked = placed.select(
        "c", "turn", "place", F.substring("role", 1, 1).alias("initial"), F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("last"))
    first = marked.groupBy(F.col("c").alias("f_c"), F.col("t1").alias("f1"), F.col("t2").alias("f2")).agg(F.min("place").alias("first"))
    marked = left_join_unique(marked, first, [("c", "f_c"), ("t1", "f1"), ("t2", "f2")])
    fault = "CASE WHEN last = '' THEN 'blank' WHEN place > first THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END"
    code = f"CASE WHEN fault IN ('blank', 'duplicate') THEN {MUST_GO} ELSE 1 + CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN fault = 'truncated' THEN 4 ELSE 0 END END"
    coded = marked.select("c", "turn", "place", "initial", F.expr(fault).alias("fault"))
    coded = written(coded.select("*", F.expr(f"CAST({code} AS INT)").alias("code"), F.expr(f"(place - 1) DIV {block}").alias("block")), "coded")
    counts = coded.groupBy("c").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"),
        *[F.count(F.expr(f"CASE WHEN fault = '{f}' THEN 1 END")).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = coded.filter("turn IS NOT NULL").select("c", "turn").distinct().groupBy("c").agg(F.count("*").alias("turns"))
    # Blocks of bounded size: their codes, initials in order, and what the next block begins with.
    blocks = coded.groupBy("c", "block").agg(F.sort_array(F.collect_list(F.struct("place", "code", "initial"))).alias("r")).select(
        "c", "block", F.col("r.code").alias("codes"), F.col("r.initial").alias("initials"))
    by_block = Window.partitionBy("c").orderBy("block")
    next_initial = F.lead(F.expr("initials[0]")).over(by_block)
    blocks = written(blocks.select("c", "block", "codes", "initials"), "blocks")
    pairs = "size(filter(sequence(1, size(i) - 1), k -> NOT coalesce(array_contains(array('su', 'ua', 'au'), concat(i[k - 1], i[k])), false)))"
    illegal = blocks.select("c", "block", "initials", next_initial.alias("n")).select(
        "c", F.expr("CASE WHEN n IS NULL THEN initials ELSE array_append(initials, n) END").alias("i")).groupBy("c").agg(
        F.sum(F.expr(f"CASE WHEN size(i) < 2 THEN 0 ELSE {pairs} END")).alias("illegal"))
    traced = written(_traced(blocks), "traced")
    audits = traced.groupBy("c").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "letters"))).getField("letters"), "").alias("audit"),
        F.max(F.expr("CASE WHEN block = 0 THEN price END")).alias("cost"))
    texts = _hashed(placed, traced, block)
    full = counts
    for part in (turns, illegal, audits, texts):
        full = full.join(part, "c", "left")
    ids = ids.select("c", F.expr("CASE WHEN NOT none THEN conv END").alias("conv_id"))
    return full.join(ids, "c").select(
        "conv_id", F.coalesce(F.expr("high - low + 1 - turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
        F.coalesce("illegal", F.lit(0)).cast("long").alias("illegal"), F.col("cost").cast("long").alias("cost"), "audit", "repaired_sha256")


def _traced(blocks: DataFrame) -> DataFrame:
    """``c, block, entry, price, letters``: each block's part of the audit and the state it is entered in."""
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes in batch.column("codes").to_pylist():
                to = [Auction(codes, [0 if s == end else _FAR for s in range(4)]).prices[0] for end in range(4)]
                out.append([to[end][entry] for entry in range(4) for end in range(4)])
            yield pa.record_batch([batch.column("c"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], ["c", "block", "d"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of a conversation come last first; a row of them is all that is held.
        last, price = object(), at_last()
        for batch in batches:
            out = []
            for c, d in zip(batch.column("c").to_pylist(), batch.column("d").to_pylist()):
                price = at_last() if c != last else price
                out.append(price)
                price, last = [min(min(d[4 * entry + end] + price[end] for end in range(4)), 2 * _FAR) for entry in range(4)], c
            yield pa.record_batch([batch.column("c"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], ["c", "block", "exit"])

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, exit_prices in zip(batch.column("codes").to_pylist(), batch.column("exit").to_pylist()):
                auction = Auction(codes, exit_prices)
                ways = [auction.trace(state) for state in range(4)]
                out.append((auction.prices[0], [w[0] for w in ways], [w[1] for w in ways]))
            prices, texts, ends = zip(*out) if out else ((), (), ())
            yield pa.record_batch([
                batch.column("c"), batch.column("block"), pa.array(prices, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string())),
                pa.array(ends, pa.list_(pa.int32()))], ["c", "block", "prices", "letters", "ends"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), _START
        for batch in batches:
            out = []
            for c, ends in zip(batch.column("c").to_pylist(), batch.column("ends").to_pylist()):
                state = _START if c != last else state
                out.append(state)
                state, last = ends[state], c
            yield pa.record_batch([batch.column("c"), batch.column("block"), pa.array(out, pa.int32())], ["c", "block", "entry"])

    found = written(blocks.select("c", "block", "codes").mapInArrow(distances, "c long, block long, d array<long>"), "distances")
    priced = found.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInArrow(exits, "c long, block long, exit array<long>")
    ways = written(blocks.select("c", "block", "codes").join(priced, ["c", "block"]).mapInArrow(
        letters, "c long, block long, prices array<long>, letters array<string>, ends array<int>"), "ways")
    entered = ways.select("c", "block", "ends").repartition("c").sortWithinPartitions("c", "block").mapInArrow(entries, "c long, block long, entry int")
    return ways.join(entered, ["c", "block"]).select(
        "c", "block", "entry", F.expr("prices[entry]").alias("price"), F.expr("letters[entry]").alias("letters"))


def _hashed(placed: DataFrame, traced: DataFrame, block: int) -> DataFrame:
    """``c, repaired_sha256``, the rows of a conversation taken as a stream in order."""
    # Of each row: the letters from the one before it (insertions, then its own); after the last
    # row of a block come the insertions that end the block's letters, as a place of its own.
    pieces = traced.select("c", "block", F.expr("regexp_extract_all(concat(letters, '.'), '(I*[DKR.])', 1)").alias("p")).select(
        "c", F.posexplode("p").alias("i", "edit"), "block").select(
        "c", F.expr(f"block * {block} + i + 1").alias("place"), F.expr("edit LIKE '%.'").alias("tail"), F.regexp_replace("edit", r"\.", "").alias("edit"))
    pieces = pieces.filter("NOT tail OR edit <> ''")
    own = placed.select("c", "place", "role", "text").join(pieces.filter("NOT tail").select("c", "place", "edit"), ["c", "place"])
    tails = pieces.filter("tail").select("c", (F.col("place") - 1).alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), "edit")
    stream = own.withColumn("tail", F.lit(0)).unionByName(tails.withColumn("tail", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, digest, some = None, _START, None, False
        for batch in batches:
            done = []
            for c, role, text, edit in zip(*(batch.column(k).to_pylist() for k in ("c", "role", "text", "edit"))):
                if c != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, state, digest, some = c, _START, hashlib.sha256(), False
                for letter in edit:
                    if letter == "D":
                        continue
                    state = _S if letter == "K" and role[:1] == "s" else _AFTER[state]
                    given = GIVEN["u" if state == _U else "a"]
                    line = f"{given}:" if letter == "I" else f"{role if letter == 'K' else given}:{text}"
                    digest.update(("\n" * some + line).encode())
                    some = True
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done)], ["c", "repaired_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([last]), pa.array([digest.hexdigest()])], ["c", "repaired_sha256"])

    dealt = stream.select("c", "place", "tail", "role", "text", "edit").repartition("c").sortWithinPartitions("c", "place", "tail")
    return dealt.mapInArrow(run, "c long, repaired_sha256 string")


def repaired(conversations: DataFrame, long_rows: int = 4096, long_bytes: int = 8 << 20) -> DataFrame:
    """One row per original ``conv_id``: faults, cheapest repair and the hash of its turns."""
    rows = damaged(conversations)
    all_ids = conversations.select(F.col("conv_id").cast("long").alias("o")).distinct()
    sizes = conversations.groupBy(F.col("conv_id").cast("long").alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(1)).cast("long")).alias("b"))
    # At most one conversation for every ``long_rows / 2`` rows or ``long_bytes / 2`` bytes.
    large = written(sizes.filter((F.col("n") * 2 > long_rows) | (F.col("b") * 2 > long_bytes)).select("s"), "large")
    same = F.col("conv_id").eqNullSafe(F.col("s"))
    done = short_conversations(rows.join(large, same, "left_anti"))
    if not large.isEmpty():
        done = done.unionByName(long_conversations(rows.join(large, same, "left_semi"), max(1, long_rows)))
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(NOTHING)}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out = all_ids.join(done, F.col("o").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("o").alias("conv_id"), *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:]])
