"""Every operator bound to the whole table it is meant for, beside its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from reachlens.llm import (
    bpe_automaton, decontamination, license_scan, mixing, ngram_jaccard, prefix_trie, quality_rules, structure_repair, suffix_dedup, token_counts,
    token_output, toxicity, url_filters,
)
from reachlens.session import on_workers
from reachlens.sources.shared import new_path, written

QUERIES, SQL = {}, {}


def _pipeline(spark, folder):
    import corpus_pipeline  # at the repository's top, beside the entry module

    return corpus_pipeline.run(spark, folder)


QUERIES["pipeline"] = _pipeline


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(on_workers(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Written out, so that a change of the operator's rules shows.
_RATIO_SQL = """word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(word_chars, 0) AS symbol_ratio,
    n_capitals / nullif(word_chars, 0) AS capital_ratio, n_stop_words / nullif(n_words, 0) AS stop_word_ratio,
    n_repeat_words / nullif(n_words, 0) AS repeat_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio"""
_RULE_SQL = """coalesce(mean_word_chars BETWEEN 2 AND 15, true) AND coalesce(symbol_ratio <= 0.05, true)
    AND coalesce(capital_ratio <= 0.5, true) AND (n_words < 100 OR coalesce(stop_word_ratio >= 0.03, true))
    AND coalesce(dup_line_ratio <= 0.5, true)"""


@query("op3_quality_rules", rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
split AS (SELECT doc_id, r, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (SELECT r, p, struct_pack(a := words[p], b := words[p + 1], c := words[p + 2]) AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM split)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p + d) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(d) GROUP BY r),
counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(words, lambda w: list_contains(string_split('{quality_rules.STOP_WORDS}', ' '), lower(w)))) AS BIGINT) AS n_stop_words
  FROM split LEFT JOIN covered USING (r)),
ratios AS (SELECT *, {_RATIO_SQL},
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND {_RULE_SQL} AS kept FROM ratios""")
def op3_quality_rules(spark, folder):
    return quality_rules.judged(table(spark, folder, "documents"))


# The rules of the query.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


@query("op10_url_filters", f"""
WITH parts AS (SELECT page_id, coalesce(strpos(url, '://'), 0) > 0 AS has, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
urls AS (SELECT page_id, row_number() OVER () AS r,
    CASE WHEN has THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM parts),
rules(h, p, v) AS (VALUES {', '.join(map(str, URL_RULES))}),
fits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
    FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)""")
def op10_url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filtered(table(spark, folder, "pages"), rules)


@query("op9_mixing", r"""
WITH sized AS (SELECT doc_id, source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(list_extract([3, 1, 2], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)) AS DOUBLE) AS w,
    2.0::DOUBLE * source_size AS cap FROM sources),
steps AS (SELECT w, cap, 1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM weighed),
level AS (SELECT room, ws FROM steps WHERE room / ws <= cap / w ORDER BY cap / w LIMIT 1),
goals AS (SELECT source, source_size, least(cap, coalesce(room * w / ws, cap)) AS target FROM weighed LEFT JOIN level ON true),
placed AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS full_epochs,
    CAST(floor(target) AS BIGINT) % greatest(source_size, 1)
      - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5('17|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(full_epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM placed""")
def op9_mixing(spark, folder):
    sized = written(table(spark, folder, "documents").select("doc_id", "source", F.expr(mixing.size_sql()).alias("size")), "sized")
    mix, figures = mixing.mixed(sized.withColumn("members", F.array("source")), "members", "size")
    # One row per source, no more than the patterns the operator allows.
    figures = F.broadcast(figures.withColumnRenamed("source", "s"))
    return mix.join(figures, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


@query("op1_token_counts")
def op1_token_counts(spark, folder):
    lengths = token_counts.encoded_lengths(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    # Written, as three sums are taken of it and the texts should be encoded once.
    return token_counts.suffix_sums(written(token_counts.histogram(lengths), "lengths"))


@query("op7_token_ids")
def op7_token_ids(spark, folder):
    path = new_path(spark, "token-ids")
    token_output.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_output.digests(token_output.read(spark, path))


@query("op2_decontamination")
def op2_decontamination(spark, folder):
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_toxicity")
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, folder, "labels")))


@query("op5_license_scan")
def op5_license_scan(spark, folder):
    return license_scan.scanned(table(spark, folder, "documents"))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark, folder):
    return ngram_jaccard.classes(table(spark, folder, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, folder):
    return suffix_dedup.removed(table(spark, folder, "documents")).drop("spans")


@query("op12_bpe_automaton")
def op12_bpe_automaton(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_automaton.digests(bpe_automaton.encoded(table(spark, folder, "documents"), path), path)


@query("op11_prefix_trie")
def op11_prefix_trie(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op13_structure_repair")
def op13_structure_repair(spark, folder):
    return structure_repair.repaired(table(spark, folder, "conversations"))
