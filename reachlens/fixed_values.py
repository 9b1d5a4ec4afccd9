"""Values that decide results and therefore must stay exactly as they are."""

from __future__ import annotations

# --- Fixed values: category orders -------------------------------------------
TIME_BUCKETS = (
    "9 AM", "10 AM", "11 AM", "12 PM", "1 PM", "2 PM", "3 PM", "4 PM", "5 PM",
    "6 PM", "7 PM", "8 PM", "9 PM", "10 PM", "11 PM", "12 AM", "1-8 AM",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# --- Fixed values: period metrics, column name and label, in display order -----
KPI_LABELS = (
    ("total_posts", "Total Posts"),
    ("followers_gained", "Followers Gained"),
    ("total_reach", "Total Reach"),
    ("total_likes", "Total Likes"),
    ("total_comments", "Total Comments"),
    ("like_rate", "Like Rate"),
    ("average_reach", "Average Reach"),
    ("average_likes", "Average Likes"),
)
# Ratio metrics and the total each is divided by.
KPI_RATIOS = {
    "like_rate": ("total_likes", "total_reach"),
    "average_reach": ("total_reach", "total_posts"),
    "average_likes": ("total_likes", "total_posts"),
}

# --- Fixed values: windows and sizes -------------------------------------------
KPI_FRAME_DAYS = 7
DAILY_COUNT_DAYS = 31
RECENT_DAYS = {"30d": 30, "6m": 182}
TOP_POSTS = 10
NEWEST_POSTS = 25
PAST_IDEAS = 5
SHOWN_IDEAS = 3
SLOT_GAP_DAYS = 3
CLICKS_PER_FOLLOW = 5
CLOUD_TERMS = 200
COLLOCATION_THRESHOLD = 30.0
CAPTION_LABEL_CHARS = 50
EVENT_TITLE_CHARS = 10
TENANT_ZONE = "America/Los_Angeles"

# --- Fixed values: headings of the account series --------------------------------
SERIES_HEADINGS = {
    "total_followers": "Total Followers",
    "follower_count": "Followers Gained",
    "reach": "Reach",
    "impressions": "Impressions",
}

# --- Fixed values: run-time choices the pages offer -----------------------------
ENGAGEMENT_METRICS = ("reach", "like_count")
TIMING_DIMENSIONS = ("time_bucket", "weekday")
VIDEO_METRICS = ("avg_shot_len", "shot_count", "video_len")

# --- Fixed values: texts shown when a lookup finds nothing ----------------------
NO_PAST_POSTS = "No past posts found."
NO_INSPIRATION = "No inspiration data found."
NO_PAST_CONCEPTS = "No past post ideas found."
NO_INSIGHTS = "No account insights found."
NO_DIFFERENCE = "N/A"

# --- Fixed values: stamps and display text --------------------------------------
GENERATED_SOURCE = "ChatGPT"
MANUAL_SOURCE = "User"
PAST_EVENT_PREFIX = "Past Post: "
PAST_EVENT_COLOR = "#FF6C6C"
BULLET = "•"
PUBLIC_URL_BASE = "https://storage.googleapis.com"
IDEA_FIELDS = ("post_summary", "caption", "post_type", "themes", "tone")

# --- Fixed values: prompt wording. {name} marks the column filled in ------------
PERFORMANCE_PROMPT = (
    "Here is the business context: {description}\n"
    "Here is a summary of recent performance: {summary}\n"
    "Generate a concise two-sentence summary of the recent performance. Return this summary in bullets. The first sentence should describe overal perfromance and the next should be a set of suggestions centered around the idea that more posts will enhance the account and its engagement."
)
IDEA_PROMPT_CONTEXT = (
    "You are a social media manager creating a post for an Instagram account based on the following context:\n\n"
    "** Here is their Social Media Strategy:** {strategy}\n\n"
    "** Here is past posts themes and types. Try to recommend similar ideas but avoid direct overlap:**\n{past_concepts}\n\n"
    "** Here is ideas about post structure / ideas that the user finds inspirational, factor this in:**\n{inspiration}\n\n"
    "** Here are the Past Post Ideas, don't recommend the same things:**\n{past_ideas}\n\n"
    "** Here is some Account Insights about what types of ideas and concepts have worked well for this account in the past. This should be weighted heavily as you decide which post to suggest:**\n{insights}\n\n"
)
IDEA_PROMPT_USER = "**Additional user-provided context for this post:** {user_context}\n\n"
IDEA_PROMPT_REQUEST = (
    "**Generate 1 new post idea** based on this context. Ensure the idea aligns with the strategy but also introduces a mix of concepts.\n"
    "Each idea should include:\n"
    "- **post_summary** - (e.g., Summarize this post)\n"
    "- **caption**\n"
    "- **post_type** (e.g., Reel, Story, Static Post)\n"
    "- **themes**\n"
    "- **tone**\n"
    "**Output the response as a JSON object** with the **exact** keys: 'post_summary', 'caption', 'post_type', 'themes', 'tone'."
)
TWEAK_PROMPT = (
    "You are a social media manager improving an existing Instagram post based on user feedback.\n\n"
    "**Here is the original post:**\n"
    "Post Summary: {post_summary}\n"
    "Caption: {caption}\n"
    "Post Type: {post_type}\n"
    "Themes: {themes}\n"
    "Tone: {tone}\n\n"
    "**User Feedback on Changes:** {feedback}\n\n"
    "Please generate an improved version of this post while retaining its core structure. Ensure the updated post aligns with the requested tweaks.\n"
    "Return the output as a JSON object with the exact keys: 'post_summary', 'caption', 'post_type', 'themes', 'tone'."
)

# --- Default word list of the term counts; callers may pass their own -----------
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "but", "by", "can", "do", "for", "from", "get", "had", "has",
    "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its",
    "just", "me", "more", "my", "no", "not", "of", "on", "or", "our", "out", "she",
    "so", "than", "that", "the", "their", "them", "then", "there", "they", "this",
    "to", "up", "was", "we", "were", "what", "when", "which", "who", "will", "with",
    "would", "you", "your",
)
