"""Term and phrase counts over the spoken and written text of posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reachlens.fixed_values import CLOUD_TERMS, COLLOCATION_THRESHOLD, STOP_WORDS
from reachlens.functions.text import cloud_words, singular, terms
from reachlens.operators.common import first_rows, left_join_unique
from reachlens.sources.shared import written


def term_counts(
    posts: DataFrame, texts: Sequence[str] = ("processed_speech", "caption"),
    by: Sequence[str] = ("page_id",), stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """How often each term occurs in the whole of the texts, missing texts read as "".

    Every map task counts before the shuffle, so frequent terms travel once per task.
    """
    # The outer form: for the inner one Spark adds a filter on the list being non-empty
    # and would run the pattern a second time to evaluate it.
    found = F.explode_outer(terms(*[F.coalesce(F.col(c), F.lit("")) for c in texts])).alias("term")
    words = posts.select(*by, found).filter("term IS NOT NULL")
    kept = words.filter(~F.col("term").isin(list(stop_words))) if stop_words else words
    return kept.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("occurrences"))


def cloud_terms(counts: DataFrame, k: int = CLOUD_TERMS, by: Sequence[str] = ("page_id",)) -> DataFrame:
    """The ``k`` most frequent terms of each account, those a word cloud shows."""
    return first_rows(counts, by, [F.col("occurrences").desc(), F.col("term")], k)


# --- phrases ----------------------------------------------------------------------------


def _log_likelihood(k: Column, n: Column, x: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.log(F.greatest(x, tiny)) * k + F.log(F.greatest(1 - x, tiny)) * (n - k)


def collocation_score(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's likelihood ratio of two words that stand together: how much better the
    counts are explained if the second word depends on the first. 0 if a word is all there is."""
    alone = second / total
    after, elsewhere = both / first, (second - both) / (total - first)
    score = (
        _log_likelihood(both, first, alone) + _log_likelihood(second - both, total - first, alone)
        - _log_likelihood(both, first, after) - _log_likelihood(second - both, total - first, elsewhere)
    )
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(-2 * score)


# Limits that decide how the work is dealt out, not what comes out: how many of the commonest
# words (and of the largest accounts) every task holds; from how many places on a pair of two
# such words is counted before it is dealt out; how many places of pairs a task takes.
HELD, CROWDED, PLACES_A_TASK = 200_000, 100_000, 2_000_000


def _words(posts: DataFrame, texts: Sequence[str], by: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """``spelled``: every word of the texts but stop words."""
    words = posts.select(*by, cloud_words(*[F.coalesce(F.col(c), F.lit("")) for c in texts]).alias("_w"))
    listed = words.select(*by, F.explode_outer("_w").alias("spelled")).filter("spelled IS NOT NULL")
    return listed.filter(~F.lower("spelled").isin(list(stop_words))) if stop_words else listed


def _pairs(posts: DataFrame, texts: Sequence[str], by: Sequence[str], stop_words: Sequence[str]) -> DataFrame:
    """``spelled``: every two words in a row, neither a stop word."""
    found = cloud_words(*[F.coalesce(F.col(c), F.lit("")) for c in texts])
    if stop_words:  # null in its place, and a pair with a null is null
        found = F.transform(found, lambda w: F.when(~F.lower(w).isin(list(stop_words)), w))
    both = F.expr("""zip_with(slice(_w, 1, greatest(size(_w) - 1, 0)), slice(_w, 2, greatest(size(_w) - 1, 0)), (v, w) -> concat(v, ' ', w))""")
    return posts.select(*by, found.alias("_w")).select(*by, F.explode_outer(both).alias("spelled")).filter("spelled IS NOT NULL")


def _head(spelled: Column) -> Column:
    """The first of two words in lower case; empty for one word."""
    return F.when(F.contains(spelled, F.lit(" ")), F.lower(F.substring_index(spelled, " ", 1))).otherwise(F.lit(""))


def _key(spelled: Column) -> Column:
    return F.lower(F.substring_index(spelled, " ", -1))


def _fused(counts: DataFrame, by: Sequence[str], places: int = 0) -> DataFrame:
    """``head, stem, n, has, v``: every word or pair with its spellings, from ``spelled, n``, where
    a spelling may come in several rows. All spellings of a group meet in one exchange, which
    carries them as they are and nothing besides."""
    head, stem, spark = _head(F.col("spelled")), singular(_key(F.col("spelled"))), counts.sparkSession
    parts = -(-places // PLACES_A_TASK)
    more = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = counts.repartition(*more, *by, head, stem).select(*by, head.alias("head"), stem.alias("stem"), "spelled", "n")
    once = dealt.groupBy(*by, "head", "stem", "spelled").agg(F.sum("n").alias("n"))
    # A stem's group holds the singular, the plural or both: one term in any case.
    return once.groupBy(*by, "head", "stem").agg(
        F.bool_or(_key(F.col("spelled")) == F.col("stem")).alias("has"), F.sum("n").alias("n"), F.collect_list(F.struct("spelled", "n")).alias("v"))


def _with_term(fused: DataFrame) -> DataFrame:
    """The spellings ``v`` of each group replaced by the commonest, ``term``."""
    bare = fused.withColumn("v", F.expr("""transform(v, x -> named_struct('n', x.n, 'w',
        if(has AND lower(substring_index(x.spelled, ' ', -1)) <> stem, left(x.spelled, length(x.spelled) - 1), x.spelled)))"""))
    return bare.withColumn("term", F.expr("""array_min(transform(array_distinct(transform(v, x -> x.w)), w -> named_struct(
        'n', -aggregate(filter(v, x -> x.w = w), 0L, (s, x) -> s + x.n), 'w', w))).w""")).drop("v", "has")


def _sizes(counts: DataFrame, column: str) -> list[tuple[int, int]]:
    """Each value that occurs, the largest first, and in how many rows. Different values that
    sum to the number of words are few."""
    return sorted(map(tuple, counts.groupBy(column).count().collect()), reverse=True)


def _floor(sizes: list[tuple[int, int]], most: int) -> int:
    """The least value from which on there are at most ``most`` rows; 0 if that is all rows."""
    floor = sizes[0][0] + 1 if sizes else 0
    for value, rows in sizes:
        most -= rows
        if most < 0:
            return floor
        floor = value
    return 0


def _may_exceed(n: Column, first: tuple[Column, Column], second: tuple[Column, Column], total: Column, threshold: float) -> Column:
    """Whether the score of two different words may exceed the threshold, if their counts lie
    between the given ones.

    While ``n * total`` exceeds the product of both counts, the score falls as a count grows; once
    it is less, it rises. So it is nowhere higher than at both lower or at both upper ends. The
    bound is used only where all four cells of the table are positive and, for the logarithms
    of tiny shares, below 10^9 words; what it cannot judge may exceed.

    The lambda keeps the score out of generated code, which would become longer than what Java compiles."""
    ends = F.array(*[F.struct(n.alias("n"), a.alias("a"), b.alias("b"), total.alias("t")) for a, b in zip(first, second)])
    exceeds = lambda x: F.when(
        (x.t < 10**9) & (x.a + x.b - x.n < x.t), collocation_score(x.n, x.a, x.b, x.t) > threshold - 1e-3)
    return F.coalesce(F.exists(ends, exceeds), F.lit(True))


def phrase_counts(
    posts: DataFrame, texts: Sequence[str] = ("processed_speech", "caption"), by: Sequence[str] = ("page_id",),
    stop_words: Sequence[str] = STOP_WORDS, threshold: float = COLLOCATION_THRESHOLD,
) -> DataFrame:
    """``term, occurrences`` of a word cloud with its default settings.

    Words that differ in case count as one, shown as spelled most often (equally often: the
    least in code-point order); a plural in ``s`` joins its singular where that occurs too. Two
    words in a row, neither a stop word, are a phrase if their likelihood ratio exceeds
    ``threshold``; its occurrences are then taken off both words, and words of which nothing is
    left are dropped. Pairs stay inside a post.

    Words are counted first. Most pairs occur once or twice, so a count in the map tasks saves
    them nothing: each place of a pair is sent once to where its spellings meet. Only pairs of
    two crowded words are counted before that. With the counts of the commonest words at hand,
    an upper bound of the score then drops most pairs; those left, before and after the first
    word's exact count is known, are joined with the words' counts. Spellings of one word are few.
    """
    by = list(by)
    counts = _words(posts, texts, by, stop_words).groupBy(*by, "spelled").agg(F.count(F.lit(1)).alias("n"))
    # Written: words are looked up three times.
    words = written(_with_term(_fused(counts, by)).select(*by, "stem", "n", "term"), "terms")
    totals = words.groupBy(*by).agg(F.sum("n").alias("total"))
    renamed = lambda df, tag, kept: df.select(*[F.col(c).alias(f"_{tag}_{c}") for c in (*by, *kept)])
    keys = lambda tag, own: [*[(c, f"_{tag}_{c}") for c in by], *([(own, f"_{tag}_stem")] if own else [])]

    def held(df: DataFrame, side: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
        same = [F.col(a) == F.col(b) for a, b in on]
        return df.join(F.broadcast(side), same, "left").drop(*[b for _, b in on])

    sizes, accounts = _sizes(words, "n"), _sizes(totals, "total")
    floor, account_floor = _floor(sizes, HELD), _floor(accounts, HELD)
    common = words.filter(F.col("n") >= floor)
    pairs = _pairs(posts, texts, by, stop_words)
    crowded = max(floor, CROWDED)
    if sizes and sizes[0][0] >= crowded:
        many = words.filter(F.col("n") >= crowded)
        marked = pairs.withColumn("stem", singular(_key(F.col("spelled")))).withColumn("left", singular(_head(F.col("spelled"))))
        marked = held(held(marked, renamed(many, "l", ["stem", "n"]), keys("l", "left")), renamed(many, "r", ["stem", "n"]), keys("r", "stem"))
        both = F.col("_l_n").isNotNull() & F.col("_r_n").isNotNull()
        counted = marked.filter(both).groupBy(*by, "spelled").agg(F.count(F.lit(1)).alias("n"))
        placed = marked.filter(~both).select(*by, "spelled", F.lit(1).cast("long").alias("n")).unionByName(counted)
    else:
        placed = pairs.withColumn("n", F.lit(1).cast("long"))
    fused = _fused(placed, by, sum(n * rows for n, rows in sizes)).withColumn("left", singular(F.col("head"))).drop("head")
    fused = held(fused, renamed(common, "l", ["stem", "n"]), keys("l", "left"))
    fused = held(fused, renamed(common, "r", ["stem", "n"]), keys("r", "stem"))
    fused = held(fused, renamed(totals.filter(F.col("total") >= account_floor), "t", ["total"]), keys("t", None))
    other = F.col("left") != F.col("stem")
    n, total = F.col("n").cast("double"), F.col("_t_total").cast("double")
    ends = lambda c: (F.coalesce(c.cast("double"), n), F.coalesce(c.cast("double"), F.greatest(n, F.lit(float(floor)))))
    likely = fused.filter(~other | _may_exceed(n, ends(F.col("_l_n")), ends(F.col("_r_n")), total, threshold)).drop("_l_n").withColumnRenamed("_r_n", "_held")
    scored = left_join_unique(_with_term(likely), renamed(words, "l", ["stem", "n"]), keys("l", "left"))
    scored = scored.filter(~other | _may_exceed(n, (F.col("_l_n").cast("double"),) * 2, ends(F.col("_held")), total, threshold))
    scored = left_join_unique(scored, renamed(words, "r", ["stem", "n"]), keys("r", "stem"))
    if account_floor:  # accounts that are not held
        scored = left_join_unique(scored.drop("_t_total"), renamed(totals, "t", ["total"]), keys("t", None))
    found = scored.filter(collocation_score(F.col("n"), F.col("_l_n"), F.col("_r_n"), F.col("_t_total")) > threshold)
    phrases = written(found.select(*by, "left", "stem", "n", "term"), "phrases")
    parts = phrases.select(*by, F.explode(F.array("left", "stem")).alias("stem"), "n").groupBy(*by, "stem").agg(F.sum("n").alias("inside"))
    rest = left_join_unique(words, renamed(parts, "p", ["stem", "inside"]), keys("p", "stem"))
    single = rest.select(*by, "term", (F.col("n") - F.coalesce("_p_inside", F.lit(0))).alias("occurrences")).filter("occurrences > 0")
    return single.unionByName(phrases.select(*by, "term", F.col("n").alias("occurrences")))
