"""Decontamination, toxicity, n-gram Jaccard join, suffix-array dedup."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reachlens.llm import decontamination, ngram_jaccard, suffix_dedup, toxicity
from reachlens.llm.graph import components

VOCABULARY = [f"{a}{b}" for a in ("sto", "riv", "clou", "mos", "wi", "sa") for b in ("ne", "er", "d", "ss", "nd", "le", "ra")]


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


# --- decontamination -------------------------------------------------------------------


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def distance_inside(item, text):
    """Least edit distance of the item to a stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_the_plain_recurrence():
    rnd = random.Random(2)
    for _ in range(200):
        item, text = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, n))) for n in (20, 60))
        bits = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in item}
        assert decontamination.myers(bits, len(item), text)[0] == min(len(item), distance_inside(item, text))


def test_decontamination_against_brute_force(session, documents, rows):
    rnd = random.Random(3)
    items = [(i, prose(rnd, rnd.randint(8, 25)).capitalize() + ".") for i in range(12)]
    items += [(3, items[3][1]), (50, None), (51, "..."), (52, "zq"), (53, items[0][1])]

    def edited(text, edits):
        text = list(text)
        for _ in range(edits):
            at = rnd.randrange(len(text))
            rnd.choice([lambda: text.insert(at, "x"), lambda: text.pop(at), lambda: text.__setitem__(at, "y")])()
        return "".join(text)

    made = []
    for i in range(60):
        leak = edited(rnd.choice(items[:12])[1], rnd.randint(0, 16)) if i % 2 else ""
        made.append((i, f"{prose(rnd, rnd.randint(0, 30))}\n {leak}, {prose(rnd, rnd.randint(0, 30))}"))
    made += [(1, made[1][1]), (70, None), (71, ""), (72, "ZQ!"), (73, prose(rnd, 20000)), (None, items[5][1])]
    expected = Counter()
    for d, text in made:
        for item, s in {(i, normal(t)) for i, t in items}:
            k = int(len(s) * 0.08)
            if s and len(text or "") < 10000 and (found := distance_inside(s, normal(text))) <= k:
                expected[d, item, found, len(s)] += 1
    docs, bench = documents(made), session.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    for block in (1_000_000, 500):
        got = decontamination.matches(docs, bench, block_chars=block)
        assert Counter(rows(got.filter("doc_id IS NULL OR doc_id <> 73"), "doc_id", "item_id", "distance", "item_chars")) == expected
        clean = decontamination.clean_documents(docs, bench, block_chars=block)
        dirty = {d for d, *_ in expected}
        assert clean.columns == docs.columns
        assert rows(clean, "doc_id", "words") == sorted([(d, "w") for d, _ in made if d not in dirty])
    assert decontamination.matches(docs, bench.limit(0)).count() == 0 and decontamination.matches(docs.limit(0), bench).count() == 0
    assert decontamination.clean_documents(docs, bench.limit(0)).count() == len(made)


# --- toxicity --------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(session, documents):
    rnd = random.Random(4)
    bad = ["grumf", "blarg", "snerk", "vlop", "drix", "quazz"]
    made, truth = [], {}
    for i in range(1200):
        words = [w + str(rnd.randint(0, 9)) for w in prose(rnd, rnd.randint(20, 80)).split()]
        n = rnd.randint(1, 6) if i % 4 == 0 else 0
        for w in rnd.sample(bad, n):
            words.insert(rnd.randrange(len(words)), w.upper() if rnd.random() < 0.3 else w)
        made.append((i, " ".join(words)))
        truth[i] = n
    labels = session.createDataFrame(
        [(i, int(truth[i] > 0), 1) for i in range(900)] + [(None, 1, 1), (5, None, 1), (10**6, 0, 1)], "doc_id long, toxic int, text int")
    docs = documents(made + [(2000, None), (2001, ""), (None, "grumf " * 5000), (7, made[7][1])])
    model = toxicity.trained(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 1204
    held_out = [r for r in got if r.doc_id is not None and 900 <= r.doc_id < 1200]
    assert sum(r.toxic == (truth[r.doc_id] > 0) for r in held_out) >= 0.95 * len(held_out)
    by_count = [np.mean([r.severity for r in held_out if low <= truth[r.doc_id] <= high]) for low, high in ((0, 0), (1, 1), (2, 4), (5, 6))]
    assert by_count == sorted(by_count) and by_count[0] < 0.3 and by_count[-1] > 2
    assert all(r.severity < 0.5 for r in got if r.doc_id in (2000, 2001))
    again = toxicity.trained(docs.repartition(5), labels)
    assert again.weights.keys() == model.weights.keys() and np.allclose(again.thresholds, model.thresholds)
    assert list(model.thresholds) == sorted(model.thresholds)
    assert {r.severity for r in toxicity.scored(docs, toxicity.trained(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_one_set_of_weights_serves_all_grades():
    rnd = np.random.default_rng(1)
    x = (rnd.random((3000, 4)) < 0.4).astype(int)
    score = x @ np.array([2.0, 1.0, 0.0, -1.5]) + rnd.logistic(size=3000)
    grade = (score > 0).astype(int) + (score > 2)
    rows, cols = np.nonzero(x)
    weights, thresholds = toxicity.fit(rows, cols, grade, np.ones(3000), 4, l1=0, steps=2000)
    assert np.allclose(weights, [2, 1, 0, -1.5], atol=0.25) and np.allclose(thresholds, [0, 2], atol=0.25)


def loss(x, grade, weight, w, theta, l1):
    """Penalized mean negative log likelihood, grade by grade as the model states it."""
    total = 0.0
    for row, g, share in zip(x, grade, weight / weight.sum()):
        at_least = [1.0, *(1 / (1 + np.exp(t - row @ w)) for t in theta), 0.0]
        total -= share * np.log(at_least[g] - at_least[g + 1])
    return total + l1 * np.abs(w).sum()


@pytest.mark.parametrize("l1", [0.0, 0.02])
def test_fit_reaches_the_likelihood_of_a_plain_search(l1):
    rnd = np.random.default_rng(2)
    x = (rnd.random((60, 3)) < 0.5).astype(int)
    grade = np.clip(np.floor(x @ np.array([1.5, 0.8, -0.7]) + rnd.logistic(size=60)), 0, 2).astype(int)
    weight = rnd.uniform(0.5, 2, 60)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit(rows, cols, grade, weight, 3, l1=l1)
    # One parameter after another is moved by a step that halves when no move helps; the loss is convex.
    at, step = np.array([0.0, 0.0, 0.0, -0.5, 0.5]), 0.5
    value = loss(x, grade, weight, at[:3], at[3:], l1)
    while step > 1e-4:
        moved = False
        for move in [s * step * e for e in np.eye(5) for s in (1, -1)]:
            new = at + move
            if new[3] < new[4] and (v := loss(x, grade, weight, new[:3], new[3:], l1)) < value:
                at, value, moved = new, v, True
        step = step if moved else step / 2
    assert loss(x, grade, weight, w, theta, l1) <= value + 1e-7
    assert np.allclose(np.concatenate([w, theta]), at, atol=0.02)


def test_severity_follows_an_order_the_model_never_sees(session, documents):
    """Severity against a hidden strength, told to the model only as toxic or not."""
    rnd = random.Random(11)
    strength = {"grumf": 1, "blarg": 1, "snerk": 2, "vlop": 2, "drix": 3, "quazz": 3}
    made, hidden = [], {}
    for i in range(1500):
        words = prose(rnd, rnd.randint(20, 60)).split()
        held = rnd.sample(sorted(strength), rnd.randint(1, 6)) if i % 3 == 0 else []
        made.append((i, " ".join(words + held)))
        hidden[i] = sum(strength[w] for w in held)
    labels = session.createDataFrame([(i, int(hidden[i] > 0)) for i in range(1000)], "doc_id long, toxic int")
    docs = documents(made)
    got = {r.doc_id: r.severity for r in toxicity.scored(docs, toxicity.trained(docs, labels)).collect() if r.doc_id >= 1000}
    toxic = [i for i in got if hidden[i]]
    pairs = [(a, b) for a in toxic for b in toxic if hidden[a] < hidden[b]]
    assert sum(got[a] < got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert max(got[i] for i in got if not hidden[i]) < min(got[i] for i in toxic)


# --- n-gram Jaccard join ---------------------------------------------------------------


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def joined_by_force(made):
    sets = [shingle_set(t) for _, t in made]
    parent, links = list(range(len(made))), [0] * len(made)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(made)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 5 * common >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(made):
        least[find(i)].append(d)
    ids = [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(made))]
    return [(d, ids[i], links[i]) for i, (d, _) in enumerate(made)], [find(i) for i in range(len(made))]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(6)
    made = [(i, prose(rnd, rnd.randint(0, 120))) for i in range(60)]
    hot = prose(rnd, 150).split()
    for i in range(100, 180):  # one large group of near copies around the threshold
        words = list(hot)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(150)] = f"x{rnd.randint(0, 9)}"
        made.append((i, " ".join(words)))
    made += [(200 + i, made[5][1]) for i in range(30)] + [(5, made[5][1])] * 2 + [(None, made[6][1]), (300, None), (301, ""), (302, " \n")]
    made += [(310, "one two"), (311, "one  two"), (312, "one two three"), (313, prose(rnd, 20000)), (None, "only null id"), (9, "twice this id")]
    return made


@pytest.mark.parametrize("block, places", [(1000, 1_000_000), (7, 2000)])
def test_jaccard_join_against_brute_force(documents, rows, copies, block, places):
    expected, _ = joined_by_force(copies)
    got = ngram_jaccard.classes(documents(copies), block=block, block_places=places)
    assert Counter(rows(got, "doc_id", "class_id", "n_links")) == Counter(expected)


@pytest.mark.parametrize("n", [2, 3])
def test_jaccard_of_few_long_texts_with_empty_blocks(documents, rows, n):
    rnd = random.Random(12)
    made = []
    for g in range(8):  # more blocks than texts in each component, so some are empty whatever the hashes
        text = prose(rnd, 400)
        made += [(10 * g + i, f"{text} end{i}") for i in range(n)]
    expected, _ = joined_by_force(made)
    assert {links for _, _, links in expected} == {n - 1}
    got = ngram_jaccard.classes(documents(made), block_places=100)
    assert Counter(rows(got, "doc_id", "class_id", "n_links")) == Counter(expected)


def test_jaccard_keeps_one_of_each_class(documents, copies):
    _, group = joined_by_force(copies)
    docs = documents(copies)
    kept = ngram_jaccard.kept_documents(docs)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    members = defaultdict(list)
    for i, row in enumerate(copies):
        members[group[i] if shingle_set(row[1]) else ("empty", i)].append(row)
    assert sum(left.values()) == len(members)
    for own in members.values():
        assert min(own, key=lambda r: (r[0] is None, r[0] or 0)) in left
    assert ngram_jaccard.classes(docs.limit(0)).count() == 0 and ngram_jaccard.kept_documents(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_jaccard.least_agreement(0.8, 1e-8)
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 16, 128).astype(np.uint16)
    for share, kept in ((0.8, True), (0.4, False)):
        others = np.where(rnd.random((20000, 128)) < share, base, rnd.integers(0, 1 << 16, (20000, 128))).astype(np.uint16)
        assert (len(ngram_jaccard._survivors(base, others, least)) == 20000) is kept or not kept
        assert kept or len(ngram_jaccard._survivors(base, others, least)) < 20


def test_components_of_a_long_chain_and_a_star(session):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(session.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 2000: 2000, 2001: 2000}


# --- suffix-array dedup ----------------------------------------------------------------


def removed_by_force(made, length):
    data = [(t or "").encode() for _, t in made]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(made, data):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_against_sorted_suffixes():
    rnd = random.Random(8)
    for _ in range(150):
        length = rnd.randint(1, 6)
        a, b = ([bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))] for _ in range(2))

        def windows(parts):
            at = np.cumsum([0] + [len(p) + 1 for p in parts])
            return [(int(s) + i, p[i:i + length]) for s, p in zip(at, parts) for i in range(len(p) - length + 1)]

        count = Counter(w for _, w in windows(a))
        assert suffix_dedup.repeated_starts(a, length).tolist() == [i for i, w in windows(a) if count[w] > 1]
        # A part that stands for several gives what the parts written out would give.
        times = np.array([rnd.randint(1, 3) for _ in a])
        count = Counter(w for p, n in zip(a, times) for _, w in windows([p]) * int(n))
        assert suffix_dedup.repeated_starts(a, length, times).tolist() == [i for i, w in windows(a) if count[w] > 1]
        if windows(a) and windows(b):
            left, right = suffix_dedup.merged_starts(a, b, length)
            assert left.tolist() == [i for i, w in windows(a) if w in {x for _, x in windows(b)}]
            assert right.tolist() == [i for i, w in windows(b) if w in {x for _, x in windows(a)}]


@pytest.mark.parametrize("block_bytes", [4 << 20, 3000])
def test_suffix_dedup_against_brute_force(documents, rows, block_bytes):
    rnd = random.Random(9)
    common = [prose(rnd, 60), "ü" + prose(rnd, 45), prose(rnd, 38)]
    made = []
    for i in range(70):
        text = prose(rnd, rnd.randint(0, 60))
        for c in common:
            if rnd.random() < 0.5:
                cut = rnd.randint(0, 150)
                text += " " + c[cut:cut + rnd.randint(190, 400)] + prose(rnd, rnd.randint(0, 20))
        made.append((i, text))
    made += [(80, made[3][1]), (3, made[3][1]), (3, made[3][1]), (3, prose(rnd, 80)), (None, made[9][1]), (81, None), (82, ""), (83, "x" * 199)]
    made += [(84, "ab" * 300), (85, "y" * 200), (86, "z" * 201), (87, prose(rnd, 6000)), (88, "é" * 150), (89, "short")]
    got = suffix_dedup.removed(documents(made), shard_bytes=9000, block_bytes=block_bytes)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(rows(got, *columns)) == Counter(removed_by_force(made, 200))
    assert suffix_dedup.removed(documents([])).count() == 0


def test_crowded_and_wholly_equal_segments_go_through_the_shards(documents, rows, monkeypatch):
    rnd = random.Random(10)
    shared = prose(rnd, 70)
    made = [(i, prose(rnd, rnd.randint(40, 60)) + shared + prose(rnd, 40)) for i in range(40)] + [(100 + i, prose(rnd, 90)) for i in range(3)] * 30
    seen = []
    search = suffix_dedup._in_shards
    monkeypatch.setattr(suffix_dedup, "_in_shards", lambda fetched, *more: seen.append(fetched.count()) or search(fetched, *more))
    got = suffix_dedup.removed(documents(made))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(rows(got, *columns)) == Counter(removed_by_force(made, 200))
    assert seen[0] > 15  # the copies' segments, equal in all rows, go through the suffix arrays too


def test_long_segments_of_one_byte_count_by_interval():
    part = b"a" * 500
    assert suffix_dedup.repeated_starts([part], 200).tolist() == list(range(301))
    assert suffix_dedup.repeated_starts([b"a" * 200], 200).tolist() == []
    assert suffix_dedup.repeated_starts([b"a" * 200, b"b" * 199], 200, np.array([2, 5])).tolist() == [0]
