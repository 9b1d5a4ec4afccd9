"""The pipeline's stages and the registered queries."""

import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from reachlens.llm import tokens
from reachlens.sources.shared import new_path

VOCABULARY = "the of and in is on tree stone river cloud wind moss sand leaf root hill lake path bird rain".split()


def prose(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 9)) if rnd.random() < 0.6 else rnd.choice(VOCABULARY[:6]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(session):
    rnd = random.Random(11)
    bench = prose(rnd, 30)
    made = [(i, prose(rnd, rnd.randint(60, 150)), "en", f"s{i % 3}", 0) for i in range(40)]
    near = made[4][1] + " end"
    made += [(100, near, "en", "s0", 0), (101, made[5][1], "en", "s1", 0), (102, f"{prose(rnd, 60)} {bench.upper()}!", "en", "s2", 0),
             (103, "short", "en", "s0", 0), (104, "w### " * 80, "en", "s0", 0), (105, None, None, None, None), (106, prose(rnd, 80), None, None, 1)]
    path = new_path(session, "pipeline-input")
    session.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    session.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(session, folder):
    docs = session.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(session, docs, folder), name)
        assert docs.columns == columns
        left[name] = Counter(r.doc_id for r in docs.collect())
    clean = set(range(40)) | {106}
    assert set(left["quality"]) == clean | {100, 101, 102}
    assert set(left["near_duplicates"]) == clean | {102}
    assert set(left["decontaminate"]) == clean
    assert set(left["mix"]) <= clean and set(left["mix"].values()) <= {1, 2} and sum(left["mix"].values()) > 45


def test_stages_hand_on_columns_of_any_name(session, folder, tmp_path):
    names = ["taken", "_full", "_rest", "_left", "_Cut", "_part", "_cut_size", "_p", "_o", "_b", "_members", "_size", "_copy", "c0", "c1", "c2", "_k0", "_c1",
             "_S", "_QUALITYn_words", "_Quality_words", "_digest", "_Rank"]
    docs = plain = session.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 20 OR doc_id = 100")
    docs = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = (corpus_pipeline.written(stage(session, x, folder), name) for x in (docs, plain))
        assert docs.columns == columns
        got = docs.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in plain.collect())
    assert corpus_pipeline.STAGES[-1][1](session, docs, folder).count() == docs.count() > 0


def test_a_tie_of_equal_texts_is_settled_by_the_other_columns(session):
    text = " ".join(f"word{i}" for i in range(60))
    made = [(7, text, "en", f"s{i}", 0) for i in range(12)] + [(9, text + " end", "en", "s", 0)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    kept = []
    for order, parts in ((made, 3), (made[::-1], 5), (sorted(made, key=lambda r: r[3][::-1]), 1)):
        docs = session.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        kept.append([tuple(r) for r in stage(session, docs, "").collect()])
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 1


def test_pipeline_against_its_parts(session, folder):
    got = corpus_pipeline.run(session, folder).orderBy("start").collect()
    docs = session.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    place = 0
    for r in got:
        assert r.start == place and r.n_tokens == 1 + len(whole.encode(texts[r.doc_id], add_special_tokens=False).ids)
        place += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_pipeline_over_nothing(session, folder, tmp_path):
    for name in ("documents", "benchmark"):
        session.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(session, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in entry_point.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_point.queries()


@pytest.mark.parametrize("name", ["op3_quality_rules", "op10_url_filters"])
def test_native_plans_have_no_python(session, name):
    plan = entry_point.queries()[name](session, "/root/testdata/sf0.001").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_token_stage_holds_few_encodings():
    """At most some thousand new pieces of a batch become encodings at a time."""
    own, most = tokens.Encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER)), []
    whole = own._tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **options):
            most.append(len(texts))
            return whole.encode_batch_fast(texts, **options)

    rnd = random.Random(5)
    text = "\n".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(20000))
    own._tokenizer = Counted()
    ids, bounds = own.encode(pa.array([text]))
    assert list(ids) == whole.encode(text, add_special_tokens=False).ids and bounds[-1] == len(ids)
    assert len(most) > 4 and max(most) <= 4096
