"""Quality rules, licence scan, URL filters."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from reachlens.llm import license_scan, quality_rules, url_filters

RANDOM = random.Random(7)
WORDS = ["the", "of", "and", "tree", "stone", "river", "é", "a", "cloud", "$x", "wind|", "sand", "moss", "CC", "By"]
EDGES = ["", " \t\n", "one", "one two", "one two three", "a b c a b c", "\n\nx\nx\n x\n", "no\u00a0break space", "\x0b\x0cx\x0by", "é" * 500]


def texts(n=60):
    made = ["".join(RANDOM.choice(WORDS) + RANDOM.choice([" ", " ", "\n", "  "]) for _ in range(RANDOM.randint(0, 120))) for _ in range(n)]
    return [*EDGES, *made, "w" + " w" * 20000]


def quality_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(documents, rows):
    made = [*enumerate(texts()), (5, "again"), (5, "again"), (None, None)]
    got = rows(quality_rules.judged(documents(made)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(got) == Counter((i, *quality_of(t)) for i, t in made)


def test_quality_verdict_and_kept_rows(documents, rows):
    clean = " ".join(f"the{i} of and tree river{i}" if i % 2 else f"the of stone{i}" for i in range(40))
    soup = " ".join(f"w{i}### the{i}$$$" for i in range(60))
    docs = documents([(1, clean), (1, clean), (2, soup), (3, None), (4, "short")])
    assert rows(quality_rules.judged(docs), "doc_id", "kept") == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text", "words") == [(1, clean, "w")] * 2
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0


def test_quality_rule_table_is_native(documents):
    plan = quality_rules.judged(documents([(1, "x")]), [quality_rules.Rule("symbol_ratio", high=0.5)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def licence_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licence_base_columns(documents, rows):
    made = [*enumerate([*texts(), "CC-BY cc.by", "ALL rights  reserved é general Public\nlicense", "É cc byé by"]), (1, "cc by"), (None, None)]
    got = license_scan.scanned(documents(made))
    assert Counter(rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == \
        Counter((i, *licence_of(t)) for i, t in made)
    assert license_scan.scanned(documents([])).count() == 0


@pytest.mark.parametrize("text, labels, score", [
    ("x y Released under the MIT License. z", "mit", 1.0),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0", 1.0),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 1.0),
    ("the GNU General Public License, version 3", "gpl,gpl-3.0", 1.0),
    ("the mit of the license", "", 0.0),
    ("apache version license", "", 0.0),
    ("mit license " * 3000, "mit", None),
])
def test_licence_templates(documents, rows, text, labels, score):
    filler = [(i, f"plain words about river stones {i}") for i in range(20)]
    (got,) = [r for r in rows(license_scan.scanned(documents([*filler, (99, text)])), "doc_id", "labels", "score") if r[0] == 99]
    assert got[1] == labels and 0 <= got[2] <= 1 and (score is None or got[2] == score)


def licences_by_force(words, idf):
    """Best score of each label, with every template tried at every place."""
    best = {}
    for t in license_scan.TEMPLATES:
        own = t.text.split()
        if not set(words).issuperset(" ".join(t.phrases).split()):
            continue
        for start in range(-len(own), len(words)):
            there = [words[start + p] if 0 <= start + p < len(words) else None for p in range(len(own))]
            if all(any(there[p:p + len(q)] == q == own[p:p + len(q)] for p in range(len(own))) for q in (x.split() for x in t.phrases)):
                score = sum(idf(w) for w, x in zip(own, there) if w == x) / sum(map(idf, own))
                best[t.label] = max(best.get(t.label, 0.0), min(1.0, score))
    return best


def test_licence_files_of_many_notices(documents, rows):
    notices = [t.text for t in license_scan.NOTICES]
    files = [" ".join(c) for k in (1, 2, 3, 4) for c in itertools.combinations(notices, k)]
    notices = [t.text for t in license_scan.TEMPLATES[len(license_scan.BASE):]]
    files += [" ".join(notices), " ".join(notices[::-1]), " x ".join(t.phrases[0] for t in license_scan.TEMPLATES)]
    docs = [f.split() for f in files]
    frequency = Counter(w for d in docs for w in set(d))
    got = rows(license_scan.scanned(documents([*enumerate(files)])), "doc_id", "labels", "score")
    assert [i for i, _, _ in got] == list(range(len(files)))
    for (_, labels, score), words in zip(got, docs):
        best = licences_by_force(words, lambda w: math.log((len(docs) + 1) / (frequency[w] + 1)) + 1e-6)
        assert labels == ",".join(sorted(best)) and score == pytest.approx(max(best.values()))
    assert set(got[-3][1].split(",")) == {t.label for t in license_scan.TEMPLATES} - {"reserved"}


def test_licence_bodies_and_lines_among_their_own_words(documents, rows):
    """Whole, cut, doubled and disturbed clauses, and files full of the rarest words of a clause."""
    made = random.Random(7)
    templates = license_scan.TEMPLATES[len(license_scan.BASE) + len(license_scan.NOTICES):]
    files = []
    for t in templates:
        own = t.text.split()
        cut = made.randrange(1, len(own))
        files += [t.text, " ".join(own[:cut]), " ".join(own[cut:]), " ".join(own[:cut] + ["x"] + own[cut:]), " ".join(own[:-1] * 2 + own)]
        common = made.choice(t.phrases[0].split())
        files += [" ".join([common] * 200 + own + [common] * 200), " ".join(made.sample(own, len(own)))]
        at = made.randrange(len(own))
        files.append(" ".join(own[:at] + ["other"] + own[at + 1:]))
    docs = [f.split() for f in files]
    frequency = Counter(w for d in docs for w in set(d))
    got = rows(license_scan.scanned(documents([*enumerate(files)])), "doc_id", "labels", "score")
    for (i, labels, score), words in zip(got, docs):
        best = licences_by_force(words, lambda w: math.log((len(docs) + 1) / (frequency[w] + 1)) + 1e-6)
        assert labels == ",".join(sorted(best)) and score == pytest.approx(max(best.values(), default=0.0)), files[i]
    assert all(t.label in got[8 * i][1].split(",") for i, t in enumerate(templates))


def test_licence_starts_come_from_several_words():
    index = license_scan.Index(license_scan.TEMPLATES, 10, {})
    mit = next(t for t, x in enumerate(license_scan.TEMPLATES) if x.text == "released under the mit license")
    assert index.starts(b"mit x license mit license mit mit".split())[mit] == {0}
    assert index.starts(b"license mit x license".split()) == {}


URLS = [
    "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://example.com", "http://example.com/",
    "http://notexample.com/en/", "x.net/es/", "http://x.net/es/a", "http://net/fr/", "http://x.net/es", None, "", "://", "http:///p", "a://b://c.com/en/",
    "http://example.com?x=/en/", "http://user@example.com/en/", "http://x.example.com/en/#/fr/", "http://long.com/" + "p/" * 5000,
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judged_by(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and p is not None and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:1:-1] if fits else (None, default)))


@pytest.mark.parametrize("rules", [RULES, [], [*RULES, ("com", "/e", "block"), ("com", "/e", "allow"), (None, "/", "block"), ("com", None, "block")]])
def test_urls(session, rows, rules):
    pages = session.createDataFrame([(i, u, "h", "x") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, rule string")
    frame = session.createDataFrame(rules, "host string, path string, verdict string")
    got = url_filters.filtered(pages, frame)
    assert rows(got) == [(i, *judged_by(u, rules)) for i, u in enumerate([*URLS, URLS[0]])]
    assert url_filters.filtered(pages.limit(0), frame).count() == 0
