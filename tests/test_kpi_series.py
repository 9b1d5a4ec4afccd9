import datetime as dt
import random

import pandas as pd
import pytest

from fixtures import A, AS_OF, B, C, D, T, account, by_key, post, posts
from reachlens.operators import kpi, series


@pytest.fixture(scope="module")
def small(spark):
    """Windows for 2024-03-15 00:00: current from 03-08, previous 03-01 to 03-07 00:00."""
    post_rows = [
        post(A, "1", T(2024, 3, 8), 100, 10, 1),
        post(A, "2", T(2024, 3, 15), 300, None, 2),
        post(A, "3", T(2024, 3, 15, 0, 0, 1), 999, 99, 9),      # after as_of
        post(A, "4", T(2024, 3, 7, 12), 999, 99, 9),            # the day counted in neither
        post(A, "5", T(2024, 3, 7), 100, 20, 4),
        post(A, "6", T(2024, 3, 1), 100, 20, None),
        post(B, "7", T(2024, 3, 10), 0, 5, 0),
    ]
    account_rows = [
        (A, D(2024, 3, 8), 5, 105, 1, 1), (A, D(2024, 3, 15), 7, 112, 1, 1), (A, D(2024, 3, 15), 7, 112, 1, 1),
        (A, D(2024, 3, 7), 3, 100, 1, 1), (A, D(2024, 3, 1), None, 97, 1, 1), (A, D(2024, 2, 29), 50, 90, 1, 1),
        (C, D(2024, 3, 9), 2, 20, 1, 1),
    ]
    return posts(spark, post_rows), account(spark, account_rows)


def test_reference_windows(small):
    rows = by_key(kpi.period_kpis(*small, AS_OF), "page_id")
    a = rows[A]
    assert (a.cur_total_posts, a.cur_total_reach, a.cur_total_likes, a.cur_total_comments) == (2, 400, 10, 3)
    assert (a.prev_total_posts, a.prev_total_reach, a.prev_total_likes, a.prev_total_comments) == (2, 200, 40, 4)
    assert (a.cur_followers_gained, a.prev_followers_gained) == (12, 3)
    assert (a.cur_like_rate, a.cur_average_reach, a.cur_average_likes) == (10 / 400, 200.0, 5.0)
    b = rows[B]
    assert (b.cur_total_posts, b.cur_like_rate, b.cur_average_likes, b.prev_average_reach) == (1, 0.0, 5.0, 0.0)
    assert b.cur_followers_gained == 0
    assert (rows[C].cur_total_posts, rows[C].cur_followers_gained) == (0, 2)


def test_balanced_windows_have_no_gap(small):
    a = by_key(kpi.period_kpis(*small, AS_OF, mode="balanced"), "page_id")[A]
    assert (a.cur_total_posts, a.prev_total_posts) == (1, 3)   # 03-08 00:00 ends the previous period
    assert (a.cur_followers_gained, a.prev_followers_gained) == (7, 8)
    with pytest.raises(ValueError):
        kpi.period_kpis(*small, AS_OF, mode="x")


def test_as_of_moment_moves_the_post_window(small):
    a = by_key(kpi.period_kpis(*small, "2024-03-15 12:00:00"), "page_id")[A]
    assert a.cur_total_posts == 2 and a.cur_total_reach == 1299


def test_differences_summary_and_cards(small):
    kpis = kpi.with_differences(kpi.period_kpis(*small, AS_OF))
    a = by_key(kpis, "page_id")[A]
    assert (a.diff_total_posts, a.diff_total_reach, a.diff_followers_gained) == (0.0, 100.0, 300.0)
    assert a.diff_like_rate == round((0.025 - 0.2) / 0.2 * 100, 2)
    summary = by_key(kpi.static_summary(kpis), "page_id")
    assert summary[A].summary.split("\n") == [
        "Total Posts: 2 (+0.00% from the previous period)",
        "Followers Gained: 12 (+300.00% from the previous period)",
        "Total Reach: 400 (+100.00% from the previous period)",
        "Total Likes: 10 (-75.00% from the previous period)",
        "Total Comments: 3 (-25.00% from the previous period)",
        "Like Rate: 0.025 (-87.50% from the previous period)",
        "Average Reach: 200.0 (+100.00% from the previous period)",
        "Average Likes: 5.0 (-75.00% from the previous period)",
    ]
    lines = summary[B].summary.split("\n")
    assert lines[0] == "Total Posts: 1 (N/A from the previous period)"
    assert lines[5] == "Like Rate: 0 (+0.00% from the previous period)"
    card = by_key(kpi.period_scorecards(kpis), "page_id")[A]
    assert (card.new_follows, card.avg_reach, card.avg_likes_change, card.avg_likes_style) == ("12", "200.00", "-75.00%", "negative")
    changes = [r for r in kpi.change_rows(kpis).collect() if r.page_id == B and r.metric == "Total Posts"]
    assert changes[0].difference is None and changes[0].style is None


def test_alltime(small):
    rows = by_key(kpi.alltime_kpis(*small), "page_id")
    assert (rows[A].total_followers, rows[A].total_posts) == (112, 6)
    assert rows[A].avg_likes == (10 + 99 + 99 + 20 + 20) / 5
    assert (rows[B].total_followers, rows[B].avg_reach) == (0, 0.0)
    assert (rows[C].total_followers, rows[C].total_posts, rows[C].avg_reach) == (20, 0, 0.0)
    cards = by_key(kpi.alltime_scorecards(kpi.alltime_kpis(*small)), "page_id")
    assert cards[A].followers == "112" and cards[C].avg_likes == "0.00"


def test_daily_counts_zero_inside_null_outside(spark):
    rows = [post(A, "1", T(2024, 3, 14, 0, 0)), post(A, "2", T(2024, 3, 14, 23, 59, 59, 999999)), post(A, "3", T(2024, 3, 15))]
    days = [(A, d, 1, 1, 1, 1) for d in (D(2024, 2, 12), D(2024, 2, 13), D(2024, 3, 14), D(2024, 3, 14), D(2024, 3, 15))]
    out = series.daily_counts(posts(spark, rows), account(spark, days), AS_OF)
    got = sorted((r.date, r.post_count) for r in out.collect())
    assert got == [(D(2024, 2, 12), None), (D(2024, 2, 13), 0), (D(2024, 3, 14), 2), (D(2024, 3, 15), None)]


def test_daily_counts_add_up(spark):
    rng = random.Random(5)
    moments = [T(2024, 2, 13) + dt.timedelta(minutes=rng.randrange(31 * 1440)) for _ in range(200)]
    days = [(A, D(2024, 2, 13) + dt.timedelta(i), 1, 1, 1, 1) for i in range(31)]
    out = series.daily_counts(posts(spark, [post(A, str(i), m) for i, m in enumerate(moments)]), account(spark, days), AS_OF)
    assert sum(r.post_count for r in out.collect()) == 200


@pytest.mark.parametrize("fill", ["ffill", None])
def test_fill_gaps_equals_reindex(spark, fill):
    rng = random.Random(9)
    rows = []
    for page in (A, B):
        for i in sorted(rng.sample(range(60), 20)):
            rows.append((page, D(2024, 1, 1) + dt.timedelta(i), 1, rng.choice([None, rng.randint(1, 99)]), 1, 1))
    rows.append((C, D(2024, 1, 5), 1, None, 1, 1))
    got = {(r.page_id, r.date): r.total_followers for r in series.fill_gaps(account(spark, rows), "total_followers", fill).collect()}
    expected = {}
    for page in (A, B, C):
        own = pd.Series({pd.Timestamp(r[1]): r[3] for r in rows if r[0] == page}, dtype="float")
        whole = own.reindex(pd.date_range(own.index.min(), own.index.max()))
        whole = whole.ffill() if fill else whole
        expected |= {(page, d.date()): None if pd.isna(v) else int(v) for d, v in whole.items()}
    assert got == expected


def test_fill_gaps_takes_repeated_days_once(spark):
    rows = [(A, D(2024, 1, 1), 1, 5, 1, 1)] * 3 + [(A, D(2024, 1, 1), 1, 7, 1, 1), (A, D(2024, 1, 3), 1, 9, 1, 1)]
    out = series.fill_gaps(account(spark, rows), "total_followers")
    assert sorted((r.date.day, r.total_followers) for r in out.collect()) == [(1, 7), (2, 7), (3, 9)]
    extent = series.series_extent(out, "total_followers").first()
    assert (extent.first_date, extent.last_date, extent.min_total_followers, extent.max_total_followers) == (
        D(2024, 1, 1), D(2024, 1, 3), 7, 9)
    with pytest.raises(ValueError):
        series.fill_gaps(account(spark, rows), "caption")


def test_post_markers_start_with_the_series(spark):
    rows = [post(A, str(i), T(2024, 3, d, 10)) for i, d in enumerate((1, 5, 5, 9))] + [post(B, "9", T(2024, 3, 9))]
    out = series.post_markers(posts(spark, rows), account(spark, [(A, D(2024, 3, 5), 1, 1, 1, 1)]))
    assert sorted((r.page_id, r.date) for r in out.collect()) == [(A, D(2024, 3, 5)), (A, D(2024, 3, 9))]


def test_history_holds_the_period_figures_of_every_day(spark):
    rnd = random.Random(4)
    p = posts(spark, [post(rnd.choice([A, B]), str(i), T(2024, 3, rnd.randint(1, 14), rnd.choice([0, 0, 9, 23])), reach=rnd.randint(0, 9)) for i in range(150)])
    acc = account(spark, [(A, D(2024, 3, d), rnd.randint(0, 5), 100, 5, 6) for d in (2, 3, 9, 9, 12)] + [(C, D(2024, 3, 5), 1, 7, 1, 1)])
    history = kpi.kpi_history(p, acc, "2024-03-16").collect()
    assert len(history) == len({(r.page_id, r.as_of) for r in history}) and max(r.as_of for r in history) == D(2024, 3, 16)
    for day in (1, 2, 8, 9, 15, 16):
        at_once = {r.page_id: r for r in kpi.period_kpis(p, acc, f"2024-03-{day:02d}").collect()}
        for r in history:
            if r.as_of == D(2024, 3, day):
                plain = at_once.get(r.page_id)
                for name, value in r.asDict().items():
                    if name != "as_of" and (plain is not None or name != "page_id"):
                        assert value == (plain[name] if plain is not None else 0), (r.page_id, day, name)
