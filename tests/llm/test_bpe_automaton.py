"""The tokenization automaton against merging by hand and against the tokenizers library."""

import hashlib
import itertools
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reachlens.llm import bpe_automaton
from reachlens.llm.bpe_automaton import Automaton

from test_tokens_mixing import random_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def merged(word, labels, merges):
    """BPE as defined: the first merge in the list that fits anywhere, at its leftmost place."""
    ids = [labels.index(bytes([b])) for b in word]
    while True:
        found = [(rank, i, made) for rank, (a, b, made) in enumerate(merges) for i in range(len(ids) - 1) if (ids[i], ids[i + 1]) == (a, b)]
        if not found:
            return ids
        _, i, made = min(found)
        ids[i:i + 2] = [made]


@pytest.mark.parametrize("seed", range(60))
def test_automaton_of_random_merges(seed):
    rnd = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(labels) < rnd.choice([3, 4, 9, 20]):
        a, b = rnd.randrange(len(labels)), rnd.randrange(len(labels))
        if labels[a] + labels[b] not in labels:
            merges.append((a, b, len(labels)))
            labels.append(labels[a] + labels[b])
    own = Automaton(labels, merges)
    words = [bytes(w) for n in range(7) for w in itertools.product(b"abc", repeat=n)]
    ids, bounds = own.encode(pa.array(words, pa.large_binary()))
    for i, word in enumerate(words):
        assert list(ids[bounds[i]:bounds[i + 1]]) == merged(word, labels, merges), (word, merges)


def test_every_label_pair_that_bpe_makes_is_an_arc_and_no_other():
    labels, merges = [b"a", b"b", b"aa", b"ab", b"aab", b"ba"], [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5)]
    own = Automaton(labels, merges)
    for x, y in itertools.product(range(len(labels)), repeat=2):
        stable = merged(labels[x] + labels[y], labels, merges) == [x, y]
        assert own.follows(pa.array([x]).to_numpy(), pa.array([y]).to_numpy())[0] == stable, (labels[x], labels[y])


def test_texts_against_the_library():
    own, whole = bpe_automaton.tokenizer(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(4)
    texts = [*random_texts(3000, 9), "", None, "a" * 20000, " " * 5000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y​"]
    texts += ["".join(rnd.choice("aabestheinrou ") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    ids, bounds = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        expected = whole.encode(text or "", add_special_tokens=False).ids
        assert list(ids[bounds[i]:bounds[i + 1]]) == expected, text
        assert own.decode(ids[bounds[i]:bounds[i + 1]]) == whole.decode(expected, skip_special_tokens=False)
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 1]


def test_any_ids_decode_as_the_library_does():
    own, whole, rnd = bpe_automaton.tokenizer(PATH), Tokenizer.from_file(PATH), random.Random(6)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(50257), rnd.randrange(256), 50256]) for _ in range(rnd.randint(0, 12))]
        assert own.decode(pa.array(ids, pa.uint32()).to_numpy()) == whole.decode(ids, skip_special_tokens=False)


def test_another_kind_of_file_is_refused():
    with pytest.raises(ValueError):
        bpe_automaton.Tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_query_rows(documents, rows):
    made = [*enumerate(random_texts(60, 3)), (7, "again"), (7, "again"), (None, "x"), (90, None), (91, ""), (92, "long words " * 4000)]
    whole = Tokenizer.from_file(PATH)
    docs = documents(made)
    ids = bpe_automaton.encoded(docs, PATH)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, text in made:
        x = whole.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(x), sha(",".join(map(str, x))), sha(whole.decode(x, skip_special_tokens=False))))
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    assert rows(bpe_automaton.digests(ids, PATH, chunk=7)) == rows(bpe_automaton.digests(ids, PATH)) == sorted(expected, key=key)
    assert rows(bpe_automaton.decoded(ids, PATH)) == sorted(((i, t or "") for i, t in made), key=key)
    assert bpe_automaton.digests(bpe_automaton.encoded(documents([]), PATH), PATH).count() == 0
