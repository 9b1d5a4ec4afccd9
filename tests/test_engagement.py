import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import A, AS_OF, B, D, T, analysis, by_key, post, posts
from reachlens.fixed_values import TIME_BUCKETS, WEEKDAYS
from reachlens.operators import audience, cards, engagement, terms
from reachlens.sources import schemas


def test_join_keeps_each_post_once_and_the_post_side(spark):
    p = engagement.with_like_rate(posts(spark, [
        post(A, "1", T(2024, 3, 1, 9), 200, 15, saved=4), post(A, "2", T(2024, 3, 2), 0, 5), post(A, None, T(2024, 3, 3)),
    ]))
    a = analysis(spark, [
        {"video_id": "1", "created_time": T(2024, 1, 1), "reach": 1, "saved": 9, "main_theme": "old", "speech_rate": 1.0},
        {"video_id": "1", "created_time": T(2024, 2, 1), "reach": 2, "saved": 9, "main_theme": "new", "speech_rate": 2.345},
        {"video_id": "9", "main_theme": "lonely"}, {"video_id": None, "main_theme": "no id"},
    ])
    rows = by_key(engagement.join_analysis(p, a), "post_id")
    assert len(rows) == 3
    one = rows["1"]
    assert (one.main_theme, one.reach, one.saved, one.like_rate, one.speech_rate) == ("new", 200, 4, 7.5, np.round(2.345, 2))
    assert (one.post_date, one.created_time) == (D(2024, 3, 1), T(2024, 3, 1, 9))
    assert rows["2"].like_rate == float("inf") and rows["2"].main_theme is None and rows[None].main_theme is None
    assert engagement.join_analysis(p, a, repeats="all").count() == 4
    narrow = engagement.join_analysis(p, a, ["main_theme"])
    assert set(narrow.columns) - set(p.columns) == {"video_id", "main_theme"} and by_key(narrow, "post_id")["1"].main_theme == "new"
    with pytest.raises(ValueError):
        engagement.join_analysis(p, a, repeats="some")


def test_recent_is_inclusive_and_newest_first(spark):
    p = posts(spark, [post(A, str(i), t) for i, t in enumerate(
        (T(2024, 2, 13, 23, 59), T(2024, 2, 14), T(2024, 3, 1), None, T(2023, 9, 15), T(2023, 9, 14, 23)))])
    assert [r.post_id for r in engagement.recent(p, AS_OF, "30d").collect()] == ["2", "1"]
    assert [r.post_id for r in engagement.recent(p, AS_OF, "6m").collect()] == ["2", "1", "0", "4"]
    assert [r.post_id for r in engagement.recent(p, AS_OF, None).collect()] == ["2", "1", "0", "4", "5", "3"]
    with pytest.raises(ValueError):
        engagement.recent(p, AS_OF, "1y")


def test_top_posts_put_nulls_last_and_break_ties_by_id(spark):
    p = posts(spark, [post(A, "c", T(2024, 3, 1), 5), post(A, "a", T(2024, 3, 1), 5), post(A, "b", T(2024, 3, 1), None),
                      post(B, "d", T(2024, 3, 1), 1)])
    assert [r.post_id for r in engagement.top_posts(p, "reach", 2, per_page=False).collect()] == ["a", "c"]
    assert sorted(r.post_id for r in engagement.top_posts(p, "reach", 2).collect()) == ["a", "c", "d"]
    assert engagement.newest_posts(p, 25).count() == 4


def _many(spark, seed=1):
    rng = random.Random(seed)
    return posts(spark, [
        post(rng.choice([A, B]), str(rng.randrange(40)), T(2024, 3, rng.randint(1, 14), rng.randrange(24)),
             rng.choice([None, rng.randint(1, 500)]), rng.randint(0, 50)) for _ in range(400)
    ])


@pytest.mark.parametrize("dimension,labels", [("time_bucket", TIME_BUCKETS), ("weekday", WEEKDAYS)])
def test_timing_means_are_dense_and_equal_categorical_grouping(spark, dimension, labels):
    p = engagement.with_timing(_many(spark).filter(~F.hour("created_time").isin(12, 9)))
    pdf = p.toPandas()
    pdf[dimension] = pd.Categorical(pdf[dimension], categories=labels, ordered=True)
    expected = pdf.groupby(dimension, observed=False)["reach"].mean()
    rows = engagement.timing_means(p, dimension, "reach").collect()
    assert [r[dimension] for r in rows] == list(labels)
    assert [r.mean_reach for r in rows] == pytest.approx([None if pd.isna(v) else v for v in expected])
    by_page = engagement.timing_means(p, dimension, "like_count", ("page_id",))
    assert by_page.count() == 2 * len(labels)


def test_timing_means_ignore_unknown_labels_but_keep_the_account(spark):
    p = posts(spark, [post(A, "1", T(2024, 3, 1))]).withColumn("time_bucket", F.lit("noon-ish"))
    rows = engagement.timing_means(p, "time_bucket", "reach", ("page_id",)).collect()
    assert len(rows) == 17 and all(r.mean_reach is None for r in rows)
    with pytest.raises(ValueError):
        engagement.timing_means(p, "post_id", "reach")


def test_mean_by_attribute_equals_mean_by_on_the_join(spark):
    p = _many(spark, 2)
    a = analysis(spark, [{"video_id": str(i), "main_theme": ["x", "y", None][i % 3], "shot_count": i % 5} for i in range(35)] * 2)
    for key in ("main_theme", "shot_count"):
        left = engagement.mean_by_attribute(p, a, key, by=("page_id",))
        right = engagement.mean_by(engagement.join_analysis(p, a), key, by=("page_id",))
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.select(left.columns).collect()))


def test_mean_by_drops_null_keys_skips_null_values_and_can_drop_rows(spark):
    frame = spark.createDataFrame(
        [("a", 10, 1, 1), ("a", None, 3, 1), ("b", None, 2, 1), (None, 5, 5, 1), ("a", 4, 5, None)],
        "video_len string, reach bigint, like_count bigint, other int")
    rows = by_key(engagement.mean_by(frame, "video_len"), "video_len")
    assert set(rows) == {"a", "b"} and rows["a"].mean_reach == 7.0 and rows["b"].mean_reach is None
    full = by_key(engagement.video_structure_means(frame, "video_len", complete_rows=True), "video_len")
    assert set(full) == {"a"} and full["a"].mean_reach == 10.0
    ordered = engagement.ordered_means(engagement.mean_by(frame, "video_len", ["reach"]), "mean_reach", ascending=False)
    assert [r.video_len for r in ordered.collect()] == ["a", "b"]


def test_cards_and_points(spark):
    p = engagement.with_like_rate(posts(spark, [
        post(A, "1", T(2024, 3, 1, 9), caption="a caption with more letters", media="IMAGE"),
        post(A, "2", T(2024, 3, 2), caption=None, media="CAROUSEL"), post(A, "3", T(2024, 3, 2), caption="short")]))
    joined = engagement.join_analysis(p, analysis(spark, [{"video_id": "1", "caption_length": 7, "polarity": 0.5, "tone": "warm"}]))
    card = by_key(cards.post_cards(joined), "post_id")
    assert (card["1"].media_kind, card["2"].media_kind, card["3"].media_kind) == ("image", None, "video")
    detail = by_key(cards.post_details(joined), "post_id")
    assert detail["1"].tone_tone == "warm" and detail["1"].text_caption_length == 7 and len(detail["1"]) == 36
    events = by_key(cards.calendar_events(p), "post_id")
    assert (events["1"].title, events["1"].start, events["2"].title, events["3"].title) == (
        "Past Post: a caption ", "2024-03-01", "Past Post: ", "Past Post: short")
    assert engagement.engagement_points(joined, "caption_length").filter("caption_length = 7").first().reach == 100
    assert engagement.word_points(joined).count() == 3
    with pytest.raises(ValueError):
        engagement.engagement_points(joined, "caption")


def test_term_counts_read_missing_text_as_empty(spark):
    frame = spark.createDataFrame(
        [(A, "The cat", "cat's Cat"), (A, None, "dog"), (B, "cat", None)], "page_id bigint, processed_speech string, caption string")
    got = {(r.page_id, r.term): r.occurrences for r in terms.term_counts(frame).collect()}
    assert got == {(A, "cat"): 2, (A, "cat's"): 1, (A, "dog"): 1, (B, "cat"): 1}
    top = terms.cloud_terms(terms.term_counts(frame), 1).collect()
    assert sorted((r.page_id, r.term) for r in top) == [(A, "cat"), (B, "cat")]


def test_demographics(spark):
    rows = [(A, "city", "X", 30), (A, "city", "X", 30), (A, "city", "Y", 40), (A, "age", "18", 0), (A, "city", None, 9), (B, "city", "X", None)]
    frame = spark.createDataFrame(rows, schemas.DEMOGRAPHICS)
    got = {(r.page_id, r.breakdown, r.value): (r.followers, r.percent) for r in audience.demographic_share(frame).collect()}
    assert got == {(A, "city", "X"): (60, 60.0), (A, "city", "Y"): (40, 40.0), (A, "age", "18"): (0, None), (B, "city", "X"): (0, None)}
    assert audience.followers_by_value(frame, "age").count() == 1
    assert audience.breakdown_list(frame).count() == 3


def test_shares_add_up_to_one_hundred(spark):
    rng = random.Random(4)
    rows = [(rng.choice([A, B]), rng.choice("uvw"), str(rng.randrange(9)), rng.randint(1, 99)) for _ in range(300)]
    shares = audience.demographic_share(spark.createDataFrame(rows, schemas.DEMOGRAPHICS))
    for r in shares.groupBy("page_id", "breakdown").agg(F.sum("percent").alias("s")).collect():
        assert r.s == pytest.approx(100.0)


def test_ads(spark):
    rows = [(A, "Post 1", 10.1, 100, 10), (A, "repost", 20.2, 50, 15), (A, "x", 99.0, 9, 9), (A, None, 99.0, 9, 9), (B, "post", 5.0, 1, 0)]
    totals = by_key(audience.ad_totals(spark.createDataFrame(rows, schemas.ADS)), "page_id")
    assert tuple(totals[A])[1:] == (30.3, 150, 5.0, 30.3 / 5)
    assert (totals[B].boosted_follows, totals[B].cost_per_follow) == (0.0, float("inf"))
    overall = audience.ad_totals(spark.createDataFrame(rows, schemas.ADS), by=()).first()
    assert overall.spend == 35.3
    card = by_key(audience.ad_scorecards(audience.ad_totals(spark.createDataFrame(rows, schemas.ADS))), "page_id")[A]
    assert (card.ad_spend, card.reach, card.boosted_follows, card.cost_per_follow) == ("$30.3", "150", "5.0", "$6.06")


def test_any_choice_of_columns_comes_from_the_same_analysis(spark):
    rnd = random.Random(3)
    rows = [(str(v), "2024-01-01", rnd.choice("abc"), rnd.choice("xyz"), rnd.randint(1, 3)) for v in range(40) for _ in range(4)]
    frame = spark.createDataFrame(rows, "video_id string, created_time string, main_theme string, main_focus string, loaded int")
    for ties in (None, ["loaded", "main_theme", "main_focus"]):
        whole = {r.video_id: r for r in engagement.current_analysis(frame, ties=ties).collect()}
        for columns in (["main_theme"], ["main_focus"], ["loaded", "main_focus"]):
            for r in engagement.current_analysis(frame.repartition(3), columns, ties).collect():
                assert all(r[c] == whole[r.video_id][c] for c in columns)


def plain_phrases(rows, stop_words, threshold):
    """A word cloud's counts, in plain Python; each text stands by itself."""
    import math
    import re
    from collections import Counter, defaultdict

    def stem(word):
        return word[:-1] if re.search("(^|[^s])s$", word) else word

    def fused(spellings):
        groups = defaultdict(Counter)
        for word in spellings:
            groups[word.rsplit(" ", 1)[0].lower() if " " in word else "", stem(word.lower().rsplit(" ", 1)[-1])][word] += 1
        out = {}
        for (head, s), cases in groups.items():
            known = any(c.lower().rsplit(" ", 1)[-1] == s for c in cases)
            shown = Counter()
            for c, n in cases.items():
                shown[c[:-1] if known and c.lower().rsplit(" ", 1)[-1] != s else c] += n
            out[head, s] = (sum(cases.values()), min(shown, key=lambda c: (-shown[c], c)))
        return out

    singles, pairs = [], []
    for text in rows:
        words = [w[:-2] if w.lower().endswith("'s") else w for w in re.findall(r"\w[\w']*", text)]
        words = [w for w in words if not w.isdigit()]
        singles += [w for w in words if w.lower() not in stop_words]
        pairs += [f"{a} {b}" for a, b in zip(words, words[1:]) if not {a.lower(), b.lower()} & set(stop_words)]
    words, total = fused(singles), len(singles)
    left, out = {s: n for (_, s), (n, _) in words.items()}, {}
    log = lambda k, n, x: math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)
    for (head, s), (n, shown) in fused(pairs).items():
        a, b = words["", stem(head)][0], words["", s][0]
        if total <= a or total <= b:
            continue
        p, p1, p2 = b / total, n / a, (b - n) / (total - a)
        if -2 * (log(n, a, p) + log(b - n, total - a, p) - log(n, a, p1) - log(b - n, total - a, p2)) > threshold:
            out[shown] = n
            left[stem(head)] -= n
            left[s] -= n
    return out | {shown: left[s] for (_, s), (_, shown) in words.items() if left[s] > 0}


def test_phrases_and_plurals(spark):
    import random

    rnd = random.Random(2)
    vocabulary = ["cat", "Cat", "cats", "Cats", "dogs", "bus", "buss", "Glass", "New York", "new york", "NEW yorks", "it's", "Ann's", "the", "of", "12", "3rd", "São", "is", "S"]
    made = [(i % 2, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))), None if i % 7 == 0 else "Best coffee's beans") for i in range(60)] + [(3, None, None), (4, "one one one", "")]
    posts = spark.createDataFrame(made, "page_id long, processed_speech string, caption string")
    for threshold in (30.0, 2.0):
        got = {}
        for r in terms.phrase_counts(posts, stop_words=("the", "of"), threshold=threshold).collect():
            assert (r.page_id, r.term) not in got
            got[r.page_id, r.term] = r.occurrences
        wanted = {}
        for page in {r[0] for r in made}:
            texts = [f"{a or ''} {b or ''}" for p, a, b in made if p == page]
            wanted |= {(page, t): n for t, n in plain_phrases(texts, ("the", "of"), threshold).items()}
        assert got == wanted


@pytest.mark.parametrize("held, crowded, places", [(0, 1, 100), (3, 1, 100), (25, 20, 2_000_000), (1000, 1, 100), (1000, 10**9, 100)])
def test_phrases_are_the_same_however_the_work_is_dealt_out(spark, monkeypatch, held, crowded, places):
    for name, value in (("HELD", held), ("CROWDED", crowded), ("PLACES_A_TASK", places)):
        monkeypatch.setattr(terms, name, value)
    rnd = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ra", "Ra", "ko", "mis", "the", "of") for b in ("", "s", "ss", "n", "'s", "lu")]
    made = [(rnd.choice((0, 0, 1, None)), " ".join(rnd.choice(vocabulary[:rnd.choice((4, 36))]) for _ in range(rnd.randint(0, 40))), None) for _ in range(90)]
    made += [(1, "rare word", "x x x"), (1, "one one", ""), (2, "a a", "b")]
    posts = spark.createDataFrame(made, "page_id long, processed_speech string, caption string")
    got = [tuple(r) for r in terms.phrase_counts(posts, stop_words=("the", "of"), threshold=3.0).collect()]
    wanted = set()
    for page in {r[0] for r in made}:  # rows without an account have words, but no phrases
        texts = [f"{a or ''} {b or ''}" for p, a, b in made if p == page]
        wanted |= {(page, t, n) for t, n in plain_phrases(texts, ("the", "of"), 3.0 if page is not None else float("inf")).items()}
    assert len(got) == len(set(got)) and set(got) == wanted and any(" " in t for _, t, _ in got)


def test_few_pairs_are_joined_with_the_counts_of_words(spark, monkeypatch):
    """Pairs that cannot be phrases are dropped where their spellings meet; before, every pair was
    sent twice more to be scored."""
    rnd, sent = random.Random(6), []
    vocabulary = ["".join(rnd.choice("aeioukmnrt") for _ in range(6)) for _ in range(2000)]
    made = [(i % 2, " ".join([*rnd.choices(vocabulary, k=60), *["New York"] * (i % 9 == 0)]), "") for i in range(300)]
    whole = terms.left_join_unique

    def counted(left, right, on):
        sent.append(left.count())
        return whole(left, right, on)

    monkeypatch.setattr(terms, "left_join_unique", counted)
    got = {(r.page_id, r.term): r.occurrences for r in terms.phrase_counts(spark.createDataFrame(made, "page_id long, processed_speech string, caption string")).collect()}
    assert got[0, "New York"] == 17 and got[1, "New York"] == 17 and (0, "New") not in got
    assert max(sent[:2]) < 1800  # of some 17,700


def test_phrase_counts_after_one_reading_of_the_texts(spark):
    posts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("source AS page_id", "text AS processed_speech", "lang AS caption")
    plan = terms.phrase_counts(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "regexp_extract_all" not in plan  # only counts are read from here on
