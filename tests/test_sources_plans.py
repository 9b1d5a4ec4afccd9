import re
from urllib.parse import quote

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry_point
from checks import compare, engagement_queries, ideas_queries, overview_queries
from fixtures import A, AS_OF, B, C, D, T as Time, account, analysis, ideas as idea_rows, post, posts
from reachlens.operators import common, engagement
from reachlens.plans import pages
from reachlens.session import SETTINGS
from reachlens.sources import listing, schemas, shared, sinks, tables

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The queries of the package itself; those of the optional subpackage have their own tests.
BASE = {name: query for part in (overview_queries, engagement_queries, ideas_queries) for name, query in part.QUERIES.items()}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# --- sources -----------------------------------------------------------------------------


def test_conform(spark):
    good = spark.createDataFrame([(1, D(2024, 1, 1), 2, 3, 4, 5, "extra")],
                                 "page_id int, date date, follower_count int, total_followers bigint, reach bigint, impressions bigint, more string")
    out = schemas.conform(good, schemas.ACCOUNT_DAILY)
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.ACCOUNT_DAILY]
    with pytest.raises(schemas.SchemaError, match="missing columns: reach"):
        schemas.conform(good.drop("reach"), schemas.ACCOUNT_DAILY)
    with pytest.raises(schemas.SchemaError, match="page_id: double"):
        schemas.conform(good.withColumn("page_id", F.lit(1.0)), schemas.ACCOUNT_DAILY)


def test_scans_and_partition_pruning(spark, tmp_path):
    root = str(tmp_path)
    for load in (D(2024, 3, 13), D(2024, 3, 14)):
        sinks.write_snapshot(posts(spark, [post(p, "1", Time(2024, 3, 1), load=load) for p in (A, B)]), f"{root}/postdata")
    stored = tables.read_table(spark, root, "postdata")
    day = tables.snapshot(stored, AS_OF)
    assert day.count() == 2 and "PartitionFilters: [isnotnull(insert_date" in plan(day)
    one = tables.one_page(day, A)
    assert [r.page_id for r in one.collect()] == [A] and f"EqualTo(page_id,{A})" in plan(one)
    registry = spark.createDataFrame([(B,)], "page_id bigint")
    assert [r.page_id for r in tables.registered_pages(day, registry).collect()] == [B]
    assert tables.run_query(spark, "SELECT :a + 1 AS b", {"a": 1}).first().b == 2


def test_snapshot_on_a_timestamp_is_pushed_as_a_range(spark):
    frame = spark.read.parquet(f"{SMALL}/orders.parquet").withColumnRenamed("o_orderdate", "insert_date")
    assert "GreaterThanOrEqual" in plan(tables.snapshot(frame, "1998-07-01"))


def test_media_listing_never_reads_the_bytes(spark, tmp_path):
    names = ["_draft.mp4", "a b.mov", "p1.mp4", "sub/.hidden", "sub/deep/p1.mp4"]
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in names:
        (tmp_path / name).write_bytes(b"12345")
    rows = sorted(listing.list_media(spark, str(tmp_path), "clips").filter("name NOT LIKE '%.crc'").collect())
    assert [r.name for r in rows] == names and {r.length for r in rows} == {5}
    assert rows[4].url == "https://storage.googleapis.com/clips/sub/deep/p1.mp4"


def test_folders_are_listed_by_tasks_of_their_own(spark, tmp_path):
    folder = tmp_path / "media"
    made = [(f"r{i % 3}/n {i % 5}/{i}.mp4", b"x" * i) for i in range(30)] + [("top.mp4", b""), ("r0/é~*+%2F &!.mp4", b"12")]
    stored = listing.put_media(spark.createDataFrame(made, "name string, content binary").repartition(3), f"file://{folder}")
    assert sorted(tuple(r) for r in stored.collect()) == sorted((n, len(c)) for n, c in made)
    for path, depth, tasks in ((f"file://{folder}", 1, 4), (str(folder), 2, 19), (f"{folder}/", 0, 1)):
        got = listing.list_media(spark, path, "b", depth=depth)
        assert got.rdd.getNumPartitions() == tasks
        assert sorted((r.name, r.length) for r in got.collect()) == sorted((n, len(c)) for n, c in made)
    urls = {r.name: r.url for r in listing.list_media(spark, str(folder), "b", base="s:/", quoted=True).collect()}
    assert urls == {n: "s://b/" + quote(n, safe="/~") for n, _ in made}
    (tmp_path / "empty").mkdir()
    assert listing.list_media(spark, str(tmp_path / "empty"), "b").count() == 0
    for name in ("../x", "/x", "", None):
        with pytest.raises(Exception, match="cannot be stored"):
            listing.put_media(spark.createDataFrame([(name, b"")], "name string, content binary"), str(folder)).collect()


def test_memo_writes_once_per_key_and_input(spark, tmp_path):
    source, kept = str(tmp_path / "in put=1"), tmp_path / "memo"
    spark.range(5).write.parquet(source)
    files = lambda: {f: f.stat().st_mtime_ns for f in kept.rglob("*.parquet")}
    query = lambda: spark.read.parquet(source).filter("id > 1")
    with shared.Memo(spark, str(kept)) as memo:
        assert memo.frame(query(), "q").count() == 3
        before = files()
        assert memo.frame(query(), "q").count() == 3 and files() == before
        assert shared.Memo(spark, str(kept)).frame(query(), "q").count() == 3 and files() == before
        assert memo.frame(query().filter("id > 3"), "q").count() == 1 and len(files()) > len(before)
        spark.range(5, 7).write.mode("append").parquet(source)  # changed input
        changed = len(files())
        assert memo.frame(query(), "q").count() == 5 and len(files()) > changed
        (next(kept.rglob("_SUCCESS"))).unlink()  # broken off
        assert memo.frame(query(), "q").count() == 5 and memo.frame(query().filter("id > 3"), "q").count() == 3
        with pytest.raises(ValueError, match="over files"):
            memo.frame(spark.range(3).toDF("id"), "q")
    assert not kept.exists()


def test_versions(spark, tmp_path):
    root = str(tmp_path / "ideas")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, root)
    sinks.write_version(idea_rows(spark, [{"page_id": A, "caption": "a"}, {"page_id": A, "caption": None}]), root)
    from reachlens.operators.ideas import without_caption
    sinks.write_version(without_caption(sinks.read_version(spark, root), "a"), root)
    assert [r.caption for r in sinks.read_version(spark, root).collect()] == [None]
    (tmp_path / "ideas" / "version=000003").mkdir()          # a write that never finished
    assert sinks.read_version(spark, root).count() == 1
    assert sinks.write_version(sinks.read_version(spark, root), root).endswith("version=000004")


def test_a_second_writer_fails_without_loss(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ideas")
    one, two = (idea_rows(spark, [{"page_id": A, "caption": c}]) for c in ("first", "second"))
    monkeypatch.setattr(sinks, "_versions", lambda *_, **__: [])  # both look before either writes
    sinks.write_version(one, root)
    with pytest.raises(AnalysisException):
        sinks.write_version(two, root)
    monkeypatch.undo()
    assert [r.caption for r in sinks.read_version(spark, root).collect()] == ["first"]


def test_appended_clip_ids_are_final(spark, tmp_path):
    from reachlens.operators.media import clip_rows
    uploads = spark.createDataFrame([(A, f"{i}.mp4", "video/mp4", "why") for i in range(20)],
                                    "page_id bigint, name string, mime string, inspiration_context string")
    stored = sinks.append_clips(clip_rows(uploads, AS_OF), str(tmp_path / "clips"))
    once = {r.name: r.video_id for r in stored.collect()}
    assert once == {r.name: r.video_id for r in stored.collect()} and len(set(once.values())) == 20
    assert once == {r.name: r.video_id for r in spark.read.parquet(str(tmp_path / "clips")).collect()}


def test_ideas_append(spark, tmp_path):
    path = str(tmp_path / "ideas")
    rows = idea_rows(spark, [{"page_id": A, "caption": "a"}, {"page_id": B, "caption": "b"}])
    sinks.append_ideas(rows, path)
    sinks.append_ideas(rows, path)
    assert spark.read.parquet(path).count() == 4


def test_shared_folder_follows_the_setting(spark):
    assert shared.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared.new_path(spark, "x") != shared.new_path(spark, "x")


def test_a_local_warehouse_is_refused_on_a_cluster(spark, tmp_path):
    for master in ("local", "local[4]"):
        shared.check_reachable(spark, str(tmp_path), master)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.check_reachable(spark, f"file:{tmp_path}", master)


# --- skew -----------------------------------------------------------------------------------


def test_skewed_left_join_is_split(spark):
    """A third of the posts share one id: adaptive execution cuts that partition."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 60000, 1, 8).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS post_id", "repeat(CAST(id AS STRING), 5) AS pad")
        a = spark.range(30000).selectExpr(
            "CASE WHEN id = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS video_id", "CAST(NULL AS TIMESTAMP_NTZ) AS created_time",
            "id AS shot_count")
        joined = engagement.join_analysis(left, a)
        rows = joined.groupBy().agg(F.count("*"), F.count("shot_count"), F.count_if(F.col("post_id") == "hot"))
        # 20,000 hot posts, and the ids below 30,000 that are no multiples of 3
        assert tuple(rows.first()) == (60000, 40000, 20000)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_group_limit_runs_before_the_shuffle(spark):
    p = posts(spark, [post(A, "1", Time(2024, 3, 1))])
    text = plan(common.first_rows(p, ["page_id"], [F.col("reach").desc()], 10))
    assert "row_number(), 10, Partial" in text or "10, Partial" in text
    assert "TakeOrderedAndProject" in plan(engagement.top_posts(p, "reach", per_page=False))


# --- pages -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def site(spark):
    p = posts(spark, [post(A, str(i), Time(2024, 3, 1 + i, i), caption=f"post {i}") for i in range(12)]
              + [post(B, "b", Time(2024, 3, 12)), post(A, "0", Time(2024, 3, 1), load=D(2024, 3, 13))])
    acc = account(spark, [(A, D(2024, 3, d), 1, 100 + d, 5, 6) for d in (1, 3, 9)] + [(B, D(2024, 3, 2), 1, 7, 1, 1)])
    a = analysis(spark, [{"video_id": str(i), "main_theme": "x", "main_focus": "y", "call_to_action": "go", "shot_count": 2,
                          "video_len": 3.0, "object_count": 1, "avg_shot_len": 1.5, "polarity": 0.1, "processed_speech": "words here"} for i in range(6)])
    make = spark.createDataFrame
    return {
        "postdata": p, "accountdata": acc, "post_analysis": a,
        "demographicdata": make([(A, "city", "X", 3)], schemas.DEMOGRAPHICS),
        "ads": make([(A, "Post 1", 1.0, 2, 5)], schemas.ADS),
        "summarytable": make([(A, D(2024, 3, 1), "• up • more")], schemas.ACCOUNT_SUMMARY),
        "businesscontext": make([(A, "shop")], schemas.BUSINESS_CONTEXT),
        "postideas": idea_rows(spark, [{"page_id": A, "date": "2024-03-20", "caption": "c", "post_type": "Reel", "post_summary": "s"}]),
        "accountinspiration": make([], schemas.INSPIRATION), "accountpastconcepts": make([], schemas.PAST_CONCEPTS),
        "accountinsights": make([], schemas.INSIGHTS),
        "media_listing": make([("0.mp4", "u0", "video/mp4")], schemas.MEDIA_LISTING),
        "inspiration_analysis": make([("0", "k", "s", "n", "f")], schemas.CLIP_ANALYSIS),
        "model_replies": make([(A, '{"caption": "new"}')], schemas.MODEL_REPLIES),
        "tweaks": make([(A, "c", "shorter")], schemas.TWEAKS),
    }


def test_account_overview(spark, site):
    frames = pages.account_overview(site, AS_OF)
    counts = {name: frame.count() for name, frame in frames.items()}
    assert counts["period_kpis"] == 2 and counts["changes"] == 16 and counts["series"] == 9 + 1
    assert counts["calendar"] == 13 and counts["ads"] == counts["insight_bullets"] == counts["prompts"] - 1 == 1


def test_posts_overview(site):
    frames = pages.posts_overview(site, AS_OF)
    assert frames["newest"].count() == 13 and frames["top_reach"].count() == 11
    assert {r.post_id: r.video_url for r in frames["media"].collect()}["0"] == "u0"
    assert frames["details"].filter("video_shot_count = 2").count() == 6 and frames["last_30_days"].count() == 13


def test_deep_dive_and_report_share_one_stored_frame(site):
    frames = pages.post_deep_dive(site, AS_OF, frame="30d")
    assert frames["rows"].count() == 13 and frames["timing"].count() == 14 and frames["structure"].first().mean_reach == 100
    assert frames["terms"].filter("term = 'words'").first().occurrences == 6
    assert "deep-dive-" in plan(frames["calls_to_action"]) and "Join" not in plan(frames["calls_to_action"])
    report = pages.report(site, AS_OF)
    assert {name: f.count() for name, f in report.items()}["timing"] == 34


def test_scheduler_and_gallery(spark, site):
    registry = spark.createDataFrame([(A, "plan"), (C, "plan")], "page_id bigint, strategy string")
    frames = pages.scheduler(site, registry, AS_OF)
    assert {r.page_id: r.next_date for r in frames["slots"].collect()} == {A: D(2024, 3, 23), C: D(2024, 3, 18)}
    assert frames["labels"].first().label == "2024-03-20, Reel: c..."
    assert frames["new_ideas"].first().date == "2024-03-23" and frames["tweak_prompts"].count() == 1
    assert frames["idea_prompts"].count() == 2 and frames["schedule"].count() == 1
    assert pages.inspiration_gallery(site)["gallery"].first().public_url == "u0"


# --- registered queries ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(BASE))
def test_query_equals_its_sql(spark, duck, name):
    query, sql = BASE[name], entry_point.oracle_sql()[name]
    assert compare.difference(spark, duck, name, query, sql, SMALL) is None


def test_plans_stay_in_the_jvm_and_distributed(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in BASE.items():
            text = plan(query(spark, SMALL))
            for unwanted in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "FlatMapGroups"):
                assert unwanted not in text, (name, unwanted)
            lines = text.split("\n")
            for above, line in zip(lines, lines[1:]):
                # one task may merge partial aggregates, but never sort or rank rows
                assert "Exchange SinglePartition" not in line or "Aggregate" in above, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_filters_reach_the_scan_and_columns_are_pruned(spark):
    text = plan(entry_point.queries()["period_kpis"](spark, SMALL))
    assert text.count("PushedFilters: [Or(") == 2 and "event_type" not in "".join(re.findall(r"ReadSchema: \S+", text))
    text = plan(entry_point.queries()["mean_by_theme_desc"](spark, SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double>" in text and "p_brand" not in text  # ties named


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0 and set(BASE) <= set(entry_point.oracle_sql())
    assert SETTINGS["spark.sql.adaptive.skewJoin.enabled"] == "true"


# --- repeated appends, rewritten buckets ------------------------------------------------------


def _files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    from reachlens.operators.ideas import with_updates, without_captions
    root = tmp_path / "ideas"
    rows = idea_rows(spark, [{"page_id": A + i, "caption": c} for i in range(40) for c in ("a", "b", None)] + [{"page_id": None, "caption": "a"}])
    sinks.write_bucketed(rows, str(root), 8)
    before = _files(root)
    gone = spark.createDataFrame([(A + 3, "a"), (A + 3, "nothing"), (A + 700, "a")], "page_id bigint, caption string")
    touched = sinks.rewrite_touched(spark, str(root), gone, ["page_id", "caption"], lambda r: without_captions(r, gone))
    after = _files(root)
    assert len(touched) == 1 and {f for f in before if after.get(f) != before[f]} == {f for f in before if f.startswith(f"_bucket={touched[0]}/")}
    left = sinks.read_bucketed(spark, str(root))
    assert left.count() == 120 and left.filter(F.col("page_id") == A + 3).count() == 2 and left.filter("page_id IS NULL").count() == 1
    change = spark.createDataFrame([(A + 5, "b", "s", "new", "t", ["x"], "calm")], "page_id bigint, previous_caption string, post_summary string, caption string, post_type string, themes array<string>, tone string")
    keys = change.select("page_id", F.col("previous_caption").alias("caption"))
    sinks.rewrite_touched(spark, str(root), keys, ["page_id", "caption"], lambda r: with_updates(r, change, AS_OF))
    assert {r.caption for r in sinks.read_bucketed(spark, str(root)).filter(F.col("page_id") == A + 5).collect()} == {"a", "new", None}
    before = _files(root)
    assert sinks.rewrite_touched(spark, str(root), gone, ["page_id", "caption"], lambda r: without_captions(r, gone)) == [] and _files(root) == before
    # A bucket of which nothing is left loses its folder.
    few = str(tmp_path / "few")
    sinks.write_bucketed(idea_rows(spark, [{"page_id": A + i, "caption": "x"} for i in range(9)]), few, 4)
    gone = spark.createDataFrame([(A + i, "x") for i in range(8)], "page_id bigint, caption string")
    sinks.rewrite_touched(spark, few, gone, ["page_id", "caption"], lambda r: without_captions(r, gone))
    assert [r.page_id for r in sinks.read_bucketed(spark, few).collect()] == [A + 8]


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "ideas")
    one, two = (idea_rows(spark, [{"page_id": A, "caption": c}]) for c in "ab")
    with pytest.raises(FileNotFoundError):
        sinks.read_batches(spark, path)
    assert sinks.append_batch(one, path, "1") and not sinks.append_batch(two, path, "1") and sinks.append_batch(two, path, "2")
    (tmp_path / "ideas" / "batch=2" / "_SUCCESS").unlink()  # broken off
    assert [r.caption for r in sinks.read_batches(spark, path).collect()] == ["a"]
    assert sinks.append_batch(two, path, "2") and sorted(r.caption for r in sinks.read_batches(spark, path).collect()) == ["a", "b"]
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            sinks.append_batch(one, path, name)


def test_clip_ids_of_a_batch_do_not_change(spark):
    from reachlens.operators.media import clip_rows
    made = [(A, f"{i % 7}.mp4", "video/mp4", "why") for i in range(20)]
    uploads = lambda rows, n: spark.createDataFrame(rows, "page_id bigint, name string, mime string, inspiration_context string").repartition(n)
    ids = lambda frame: sorted(r.video_id for r in frame.collect())
    first = ids(clip_rows(uploads(made, 3), AS_OF, "m"))
    assert first == ids(clip_rows(uploads(made[::-1], 5), AS_OF, "m")) and len(set(first)) == 20 and len(first[0]) == 36
    assert not set(first) & set(ids(clip_rows(uploads(made, 3), AS_OF, "n")))


# --- tables laid out for their join ---------------------------------------------------------


def test_join_of_stored_tables_moves_no_row(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, current = engagement_queries.stored_for_join(spark, SMALL, 4)
        text = plan(engagement.join_stored(stored, current))
        assert "SortMergeJoin" in text and "Exchange" not in text and "Window" not in text
        narrow = plan(engagement.join_stored(stored, current, ["mood"]))
        assert "Exchange" not in narrow and "raw_speech" not in narrow and "xxhash64" not in narrow
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_storing_shuffles_long_texts_once(spark):
    from checks import standins
    wide = standins.table(spark, SMALL, "documents").selectExpr("CAST(doc_id AS STRING) AS video_id", "source AS created_time", "text")
    text = plan(engagement.current_analysis(wide).repartition(4, "video_id"))  # as many as shuffle partitions
    assert text.count("Exchange hashpartitioning(video_id") == 1 and "WindowGroupLimit" in text.split("Exchange")[1]


def test_stored_join_equals_the_join(spark, tmp_path):
    p = posts(spark, [post(A, i, Time(2024, 3, 1)) for i in ("1", "1", "2", None, None, "")])
    a = analysis(spark, [{"video_id": v, "mood": m, "speech_rate": 1.005} for v, m in (("1", "x"), ("1", "y"), ("2", "z"), (None, "n"), ("3", "q"))])
    stored = engagement.store_for_join(p, a, "keyed_posts", "keyed_analysis", str(tmp_path), 3)
    shown = lambda frame: sorted(map(str, frame.collect()))
    got = engagement.join_stored(*stored)
    assert got.columns == engagement.join_analysis(p, a).columns
    assert shown(got) == shown(engagement.join_analysis(p, a)) and len(shown(got)) == 6
    empty = engagement.store_for_join(p.limit(0), a.limit(0), "empty_posts", "empty_analysis", str(tmp_path / "none"), 3)
    assert engagement.join_stored(*empty).count() == 0
