import json

import pytest
from pyspark.sql import functions as F

from fixtures import A, AS_OF, B, C, D, T, by_key, ideas as idea_rows, post, posts
from reachlens import fixed_values as fv
from reachlens.operators import conversation, ideas, media
from reachlens.sources import schemas


@pytest.fixture(scope="module")
def planned(spark):
    rows = [{"page_id": A, "date": f"2024-03-0{i}", "post_summary": f"s{i}", "caption": f"c{i}", "themes": f"t{i}",
             "post_type": "Reel", "tone": "warm", "source": "User"} for i in range(1, 8)]
    rows += [{"page_id": B, "date": "2024-04-01", "post_summary": None, "caption": "c1", "themes": "x", "post_type": "Story",
              "tone": "dry", "source": "User"},
             {"page_id": B, "date": "2024-04-02", "post_summary": "nocap", "caption": None, "themes": "x", "post_type": None,
              "tone": None, "source": "User"}]
    return idea_rows(spark, rows)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(A, "plan", "summer"), (B, "plan", ""), (C, "plan", None)], "page_id bigint, strategy string, ctx string")


def test_numbered_lists(planned):
    rows = by_key(ideas.numbered_ideas(planned), "page_id")
    assert rows[A].past_ideas == "1. s1\n2. s2\n3. s3\n4. s4\n5. s5"
    assert rows[B].past_ideas == "1. None\n2. nocap"
    themed = by_key(ideas.numbered_ideas(planned, ideas.theme_line(), 2), "page_id")
    assert themed[A].past_ideas == "1. t1 (Reel)\n2. t2 (Reel)" and themed[B].past_ideas == "1. x (Story)\n2. x (None)"
    assert ideas.shown_ideas(planned).groupBy("page_id").count().filter(f"page_id = {A}").first()["count"] == 3


def test_next_slots(planned, pages):
    rows = by_key(ideas.next_slots(planned, AS_OF, pages), "page_id")
    assert (rows[A].next_date, rows[B].next_date, rows[C].next_date) == (D(2024, 3, 10), D(2024, 4, 5), D(2024, 3, 18))
    assert ideas.next_slot_overall(planned, AS_OF).first().next_date == D(2024, 4, 5)
    assert ideas.next_slot_overall(planned.limit(0), AS_OF).first().next_date == D(2024, 3, 18)


def test_oldest_and_latest_rows(spark):
    frame = spark.createDataFrame([(A, D(2024, 1, 1), "old"), (A, D(2024, 2, 1), "new"), (B, None, "undated"), (B, D(2024, 1, 1), "dated")],
                                  "page_id bigint, date date, summary string")
    assert {r.page_id: r.summary for r in ideas.one_row_per_page(frame, "date", "oldest").collect()} == {A: "old", B: "undated"}
    assert {r.page_id: r.summary for r in ideas.one_row_per_page(frame, "date", "latest").collect()} == {A: "new", B: "dated"}
    with pytest.raises(ValueError):
        ideas.one_row_per_page(frame, "date", "any")
    summaries = frame.withColumn("summary", F.lit("• one • two • three"))
    assert by_key(ideas.latest_summary(summaries), "page_id")[A].bullet_2 == "two"


def test_context_and_prompts(spark, planned, pages):
    inspiration = spark.createDataFrame([(A, D(2024, 1, 1), "hook", None), (A, D(2024, 2, 1), "later", "x")], schemas.INSPIRATION)
    concepts = spark.createDataFrame([(A, D(2024, 1, 1), "concept")], schemas.PAST_CONCEPTS)
    insights = spark.createDataFrame([(B, D(2024, 1, 1), "insight")], schemas.INSIGHTS)
    context = ideas.account_context(pages, planned, inspiration, concepts, insights)
    rows = by_key(context, "page_id")
    assert rows[A].inspiration == "Post structure: hook. Post ideas: None."
    assert (rows[A].past_concepts, rows[A].insights) == ("concept", "No account insights found.")
    assert (rows[B].inspiration, rows[B].past_concepts, rows[B].insights) == (
        "No inspiration data found.", "No past post ideas found.", "insight")
    assert rows[C].past_ideas == "No past posts found."
    latest = by_key(ideas.account_context(pages, planned, inspiration, concepts, insights, "latest"), "page_id")
    assert latest[A].inspiration == "Post structure: later. Post ideas: x."
    prompts = by_key(ideas.idea_prompts(context, user_context="ctx"), "page_id")
    expected = (fv.IDEA_PROMPT_CONTEXT + fv.IDEA_PROMPT_USER + fv.IDEA_PROMPT_REQUEST).format(
        strategy="plan", past_concepts="concept", inspiration=rows[A].inspiration, past_ideas=rows[A].past_ideas,
        insights=rows[A].insights, user_context="summer")
    assert prompts[A].prompt == expected
    assert "Additional user-provided" not in prompts[B].prompt + prompts[C].prompt
    tweaks = spark.createDataFrame([(A, "c2", "shorter"), (A, "c3", "  "), (B, "c2", "other account")], schemas.TWEAKS)
    tweak = ideas.tweak_prompts(planned, tweaks).collect()
    assert [(r.page_id, r.caption) for r in tweak] == [(A, "c2")]
    assert tweak[0].prompt == fv.TWEAK_PROMPT.format(
        post_summary="s2", caption="c2", post_type="Reel", themes="t2", tone="warm", feedback="shorter")
    business = spark.createDataFrame([(A, "a shop")], schemas.BUSINESS_CONTEXT)
    summaries = spark.createDataFrame([(A, "up"), (B, "down")], "page_id bigint, summary string")
    perf = by_key(ideas.performance_prompts(summaries, business), "page_id")
    assert perf[A].prompt == fv.PERFORMANCE_PROMPT.format(description="a shop", summary="up")
    assert "context: None\n" in perf[B].prompt


def test_replies(spark, planned):
    whole = {"post_summary": "s", "caption": "c", "post_type": "Reel", "themes": ["a", "b"], "tone": "t", "more": {"x": 1}}
    replies = [
        (A, "Sure!\n```json\n" + json.dumps(whole, indent=2) + "\n```"), (A, "no object here"), (A, '{"caption": "cut'),
        (B, '{"caption": "only"}'), (B, None), (C, "x {not json} y"), (C, '{"caption": "{braces}"}'), (C, '["{"]'),
    ]
    frame = spark.createDataFrame(replies, schemas.MODEL_REPLIES)
    rows = sorted((r.page_id, r.caption) for r in ideas.parsed_replies(frame).collect())
    assert rows == [(A, "c"), (B, "only"), (C, "{braces}")]
    made = by_key(ideas.reply_ideas(frame, ideas.next_slots(planned, AS_OF), AS_OF), "page_id")
    assert made[A].themes == json.dumps(["a", "b"]) and made[A].date == "2024-03-10" and made[A].source == "ChatGPT"
    assert made[B].post_summary is None and made[C].date == "2024-03-18"


def test_replies_are_read_as_strictly_as_json(spark):
    texts = [
        "{'caption': 'c'}", '{"caption":"a"} and {"caption":"b"}', '{"caption":"a"} {"caption":"b"}', '{"caption": "x",}',
        '{"caption": "[1,2]", "themes": [1, 2.5, true, null], "tone": ["é, \\"ü\\": 😀", "b:c"]}', '{"themes": [{"x": [1, "a,b"]}, []], "caption": "[]"}',
        '{"themes": [], "tone": "[", "caption": "plain é"}', 'before {"caption": 5} after',
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schemas.MODEL_REPLIES)
    slots = spark.createDataFrame([], "page_id long, next_date date")
    got = by_key(ideas.reply_ideas(frame, slots, AS_OF), "page_id")
    for i, text in enumerate(texts):
        try:
            whole = json.loads(text[text.index("{"):text.rindex("}") + 1])
        except json.JSONDecodeError:
            assert i not in got, text
            continue
        for name, value in whole.items():
            assert got[i][name] == (json.dumps(value) if isinstance(value, list) else str(value)), (text, name)


def test_manual_ideas(spark):
    entries = spark.createDataFrame([(A, D(2024, 3, 1), "s", "c", "Reel", "a, b", "t")],
                                    "page_id bigint, date date, post_summary string, caption string, post_type string, themes string, tone string")
    row = ideas.manual_ideas(entries).first()
    assert (row.date, row.themes, row.source) == ("2024-03-01", json.dumps(["a", " b"]), "User")


def test_deletes(spark, planned):
    assert ideas.without_caption(planned, "c1").count() == 7
    assert ideas.without_caption(planned, "c1", A).count() == 8
    gone = spark.createDataFrame([(A, "c1"), (A, "c2"), (A, "c2"), (B, None)], "page_id bigint, caption string")
    left = ideas.without_captions(planned, gone)
    assert left.count() == 7 and left.filter("caption IS NULL").count() == 1
    assert ideas.without_captions(planned, gone, "all").count() == 6
    removed = planned.exceptAll(left)
    assert left.unionAll(removed).exceptAll(planned).count() == 0 and removed.count() == 2
    with pytest.raises(ValueError):
        ideas.without_captions(planned, gone, "x")


def test_updates(spark, planned):
    def updates(rows):
        return spark.createDataFrame(rows, "page_id bigint, previous_caption string, post_summary string, caption string, "
                                           "post_type string, themes array<string>, tone string, seq int")
    change = updates([(A, "c1", "n", "first", "Story", ["a", "b"], "t", 1), (A, "c1", "n", "second", "Story", [], "t", 2),
                      (A, "c2", None, "c2b", "Reel", None, None, 3), (A, None, "n", "never", "Story", [], "t", 4)])
    out = ideas.with_updates(planned, change, AS_OF)
    assert out.columns == planned.columns and out.count() == 9
    rows = {(r.page_id, r.caption): r for r in out.collect()}
    assert rows[(A, "first")].date == "2024-03-15" and rows[(A, "first")].themes == "a,b"
    assert rows[(A, "c2b")].post_summary is None and rows[(A, "c2b")].source == "User"
    assert rows[(B, "c1")].date == "2024-04-01" and (A, "second") not in rows and (B, None) in rows
    everywhere = ideas.with_updates(planned, change, AS_OF, scope="all")
    assert everywhere.filter("caption = 'first'").count() == 2
    replies = spark.createDataFrame([(A, "c3", '{"caption": "c3", "themes": ["k", "[l]"], "tone": "dry"}')],
                                    "page_id bigint, previous_caption string, reply string")
    reworked = ideas.with_updates(planned, ideas.updates_from_replies(replies), AS_OF).filter(f"tone = 'dry' AND page_id = {A}")
    assert [(r.caption, r.themes, r.date) for r in reworked.collect()] == [("c3", "k,[l]", "2024-03-15")]
    plain_text = change.withColumn("themes", F.lit("one,two"))
    assert ideas.with_updates(planned, plain_text, AS_OF).filter("themes = 'one,two'").count() == 2


def test_media(spark):
    listing = spark.createDataFrame(
        [("p1.mov", "u-mov", ""), ("p1.mp4", "u-mp4", ""), ("a.b.mov", "u-ab", ""), ("nodot", "u-nodot", "")], schemas.MEDIA_LISTING)
    p = posts(spark, [post(A, i, T(2024, 3, 1)) for i in ("p1", "a.b", "nodot", "", "zz")])
    got = {r.post_id: r.video_url for r in media.post_media(p, listing).collect()}
    assert got == {"p1": "u-mov", "a.b": "u-ab", "nodot": None, "": "u-nodot", "zz": None}
    clips = spark.createDataFrame([(i, f"k-{i}", "s", "n", "f") for i in ("p1", "p1", "nodot", "gone")], schemas.CLIP_ANALYSIS)
    assert media.listed_analyses(clips, listing).count() == 3
    urls = {r.video_id: r.public_url for r in media.gallery(clips, listing).collect()}
    assert urls == {"p1": "u-mp4", "nodot": "u-nodot"}


def test_upload_gate_and_clip_rows(spark):
    rows = [(A, "a.mp4", "video/mp4", "why"), (A, "a.png", "image/png", "why"), (A, "b.mp4", "video/mp4", ""),
            (None, "c.mp4", "video/mp4", "why"), (A, "f.mp4", "video/mp4", None), (0, "g.mp4", "video/mp4", "why"), (A, "d.mov", None, "why"), (B, "e.tar.mov", "video/quicktime", "y")]
    uploads = spark.createDataFrame(rows, "page_id bigint, name string, mime string, inspiration_context string")
    clips = media.stored_names(media.clip_rows(uploads, AS_OF)).collect()
    assert sorted(r.name for r in clips) == ["a.mp4", "e.tar.mov"]
    assert all(r.stored_name == r.video_id + "." + r.name.split(".")[-1] and len(r.video_id) == 36 for r in clips)
    assert {r.uploaded_date for r in clips} == {D(2024, 3, 15)}


def test_visible_turns(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "assistant", "b"), (0, 5, None, "d")]
    out = conversation.visible_turns(spark.createDataFrame(rows, schemas.CONVERSATION)).collect()
    assert [r.text for r in out] == ["d", "b", "c"]


def test_replies_read_and_stored_as_python_does(spark):
    import json

    from reachlens.functions.replies import read_replies

    big = "1" * 41
    themes = ['[{"b":1,"a":2}]', "[1.0]", f"[{big}]", "[NaN, -Infinity, 1e5, -0, -0.0, 1.50, true, null]", r'["é\/", "é😀"]', '[ ]', '[[1,[2.0]], {"x": {"y": [1]}, "x": 2}]',
              '"[1, 2]"', "null", "7", "1.50", "true", '"\\ud800"']
    replies = [f'text {{"caption": "c", "caption": "last", "themes": {t}}} more' for t in themes]
    bad = ["{'caption': 1}", '{"caption": "c",}', '{"a": 01}', '{"a": "b\nc"}', '{"a": 1} x {"b": 2}']
    none = ["no braces", None, "} {", "", "{" + '"a":' * 9]
    made = [(i, r) for i, r in enumerate([*replies, *bad, *none])]
    frame = spark.createDataFrame(made, "page_id long, reply string").repartition(3)
    got = by_key(ideas.reply_ideas(frame, spark.createDataFrame([], "page_id long, next_date date"), AS_OF), "page_id")
    assert sorted(got) == list(range(len(replies)))
    for i, reply in enumerate(replies):
        value = json.loads(reply[5:-5])
        wanted = value["themes"]
        if isinstance(wanted, list):
            assert got[i].themes == json.dumps(wanted)
        elif isinstance(wanted, str):
            assert got[i].themes == wanted.encode("utf-8", "replace").decode()
        else:
            assert got[i].themes == (None if wanted is None else themes[i])
        assert got[i].caption == "last" and got[i].tone is None
    rejects = {r.page_id: r.reason for r in ideas.rejected_replies(frame).collect()}
    assert rejects == {len(replies) + i: "invalid JSON" if i < len(bad) else "no object" for i in range(len(bad) + len(none))}
    from pyspark.sql import Observation
    seen = Observation("replies")
    ideas.counted_replies(read_replies(frame), seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"accepted": len(replies), "refused": len(bad) + len(none)}
