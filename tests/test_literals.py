"""Results spelled out here, not taken from the package: labels, orders, one text of each kind."""

from fixtures import A, AS_OF, by_key
from reachlens.operators import engagement, ideas, kpi


def test_summary_lines_with_their_labels(spark):
    posts = spark.createDataFrame([], "page_id long, created_time timestamp, reach long, like_count long, comments_count long")
    days = spark.createDataFrame([], "page_id long, date date, follower_count long")
    accounts = spark.createDataFrame([(A,)], "page_id long")
    figures = kpi.with_differences(kpi.period_kpis(posts, days, AS_OF, accounts=accounts))
    assert kpi.static_summary(figures).first().summary.split("\n") == [
        "Total Posts: 0 (+0.00% from the previous period)",
        "Followers Gained: 0 (+0.00% from the previous period)",
        "Total Reach: 0 (+0.00% from the previous period)",
        "Total Likes: 0 (+0.00% from the previous period)",
        "Total Comments: 0 (+0.00% from the previous period)",
        "Like Rate: 0 (+0.00% from the previous period)",
        "Average Reach: 0 (+0.00% from the previous period)",
        "Average Likes: 0 (+0.00% from the previous period)",
    ]


def test_hours_and_days_in_display_order(spark):
    hours = spark.createDataFrame([(f"2024-01-0{1 + h % 7} {h:02d}:30:00",) for h in range(24)], "t string").selectExpr("CAST(t AS TIMESTAMP) AS created_time")
    rows = engagement.with_timing(hours).collect()
    assert {r.created_time.hour: r.time_bucket for r in rows} == {
        **{h: "1-8 AM" for h in range(1, 9)}, 0: "12 AM", 9: "9 AM", 10: "10 AM", 11: "11 AM", 12: "12 PM", 13: "1 PM", 14: "2 PM", 15: "3 PM",
        16: "4 PM", 17: "5 PM", 18: "6 PM", 19: "7 PM", 20: "8 PM", 21: "9 PM", 22: "10 PM", 23: "11 PM",
    }
    assert {r.created_time.day: r.weekday for r in rows} == {
        1: "Monday", 2: "Tuesday", 3: "Wednesday", 4: "Thursday", 5: "Friday", 6: "Saturday", 7: "Sunday"}


def test_prompts(spark):
    business = spark.createDataFrame([(A, "a shop")], "page_id long, description string")
    text = ideas.performance_prompts(spark.createDataFrame([(A, "up")], "page_id long, summary string"), business).first().prompt
    assert text.startswith("Here is the business context: a shop\nHere is a summary of recent performance: up\nGenerate a concise two-sentence summary")
    context = spark.createDataFrame([(A, "S", "C", "I", "P", "N", "more")],
                                    "page_id long, strategy string, past_concepts string, inspiration string, past_ideas string, insights string, extra string")
    text = by_key(ideas.idea_prompts(context, user_context="extra"), "page_id")[A].prompt
    assert text.startswith("You are a social media manager creating a post for an Instagram account based on the following context:\n\n"
                           "** Here is their Social Media Strategy:** S\n\n")
    assert "**Additional user-provided context for this post:** more\n\n**Generate 1 new post idea** based on this context." in text
    assert text.endswith("with the **exact** keys: 'post_summary', 'caption', 'post_type', 'themes', 'tone'.")
