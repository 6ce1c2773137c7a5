"""The registered queries of this subpackage: thin steps from the given tables to the operators and back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_search, chosen_path, decontaminate, filter_audit, html_text, language, line_templates, note_rules, pieces, pseudo_likelihood, sharding, toxicity, whitening

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_of(docs: DataFrame) -> DataFrame:
    """Documents as reviewers' notes."""
    return docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("notes"))


def fold_of(id_col: str):
    """crc32 of the id as text, modulo 5; fold 0 is held out of every training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = labels.filter(fold_of("doc_id") != 0).select(F.col("doc_id").alias("record_id"), F.col("toxic").alias("abusive"))
    r = toxicity.score_notes(notes_of(docs), learn)
    return r.select(F.col("record_id").alias("doc_id"), (fold_of("record_id") == 0).alias("held_out"), "score", "predicted", "n_spans", "spans")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_templates.recurring_lines(notes_of(_table(spark, sf_dir, "documents")))
    return r.select(F.col("record_id").alias("doc_id"), "place", "n_tokens", "template", "n_notes")


SQL["op6_line_dedup"] = """
WITH cut AS (SELECT doc_id, md5(text) AS note, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, note, place, trim(regexp_replace(l, '[ \\t\\r\\f]+', ' ', 'g'), ' ') AS l FROM cut),
lines AS (SELECT doc_id, note, place, regexp_replace(l, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM plain WHERE len(string_split(l, ' ')) >= 3),
leafed AS (SELECT *, len(string_split(line, ' ')) AS n_tokens, array_to_string(string_split(line, ' ')[1:3], ' ') AS lead FROM lines),
busy AS (SELECT n_tokens, lead, count(DISTINCT note) AS leaf_notes, CASE WHEN n_tokens >= 8 THEN 2 WHEN n_tokens >= 5 THEN 3 ELSE 5 END AS few FROM leafed GROUP BY ALL HAVING count(DISTINCT note) >= few),
kept AS (SELECT * FROM leafed JOIN busy USING (n_tokens, lead)),
tok AS (SELECT n_tokens, lead, few, leaf_notes, note, line, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS pos
    FROM (SELECT DISTINCT n_tokens, lead, few, leaf_notes, note, line FROM kept)),
word AS (SELECT DISTINCT n_tokens, lead, few, leaf_notes, line, pos, token FROM tok),
-- the tree of 20 notes
fixed AS (SELECT n_tokens, lead, pos, token FROM tok WHERE leaf_notes >= 20 AND pos > 3 AND token <> '<*>' GROUP BY ALL HAVING count(DISTINCT note) >= 20),
marked AS (SELECT t.line, t.n_tokens, t.pos, CASE WHEN t.pos <= 3 OR f.token IS NOT NULL THEN t.token ELSE '<*>' END AS m FROM word t LEFT JOIN fixed f USING (n_tokens, lead, pos, token) WHERE leaf_notes >= 20),
shaped AS (SELECT line, n_tokens, string_agg(m, ' ' ORDER BY pos) AS template FROM marked GROUP BY ALL HAVING count(*) FILTER (m <> '<*>') >= 0.5 * n_tokens),
often AS (SELECT template, n_tokens, count(DISTINCT note) AS n_notes FROM (SELECT DISTINCT line, n_tokens, note FROM kept) JOIN shaped USING (line, n_tokens) GROUP BY ALL HAVING count(DISTINCT note) >= 20),
high AS (SELECT line, template, n_notes FROM shaped JOIN often USING (template, n_tokens)),
-- lines that are nearly all fixed: as they stand, then templates among the rest
sure AS (SELECT line, n_tokens, few FROM word GROUP BY ALL HAVING count(*) FILTER (token <> '<*>') >= ceil(0.8 * n_tokens - 1e-9)),
held AS (SELECT DISTINCT line, n_tokens, few, note FROM kept SEMI JOIN sure USING (line)),
own AS (SELECT line, n_tokens FROM held GROUP BY line, n_tokens, few HAVING count(DISTINCT note) >= few),
rest AS (SELECT * FROM tok SEMI JOIN sure USING (line) ANTI JOIN own USING (line)),
fixed2 AS (SELECT n_tokens, lead, pos, token FROM rest WHERE pos > 3 AND token <> '<*>' GROUP BY n_tokens, lead, pos, token, few HAVING count(DISTINCT note) >= few),
marked2 AS (SELECT t.line, t.n_tokens, t.pos, f.token IS NOT NULL AS hit, CASE WHEN t.pos <= 3 OR f.token IS NOT NULL THEN t.token ELSE '<*>' END AS m
    FROM (SELECT DISTINCT line, n_tokens, lead, pos, token FROM rest) t LEFT JOIN fixed2 f USING (n_tokens, lead, pos, token)),
near AS (SELECT line, n_tokens, string_agg(m, ' ' ORDER BY pos) AS template FROM marked2 GROUP BY ALL HAVING bool_or(hit) AND count(*) FILTER (m <> '<*>') >= ceil(0.8 * n_tokens - 1e-9)),
shaped2 AS (SELECT line, n_tokens, line AS template FROM own UNION ALL SELECT * FROM near),
often2 AS (SELECT template, n_tokens, count(DISTINCT note) AS n_notes FROM held JOIN shaped2 USING (line, n_tokens) GROUP BY template, n_tokens, few HAVING count(DISTINCT note) >= few),
low AS (SELECT line, template, n_notes FROM shaped2 JOIN often2 USING (template, n_tokens) ANTI JOIN high USING (line)),
found AS (SELECT * FROM high UNION ALL SELECT * FROM low)
SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(n_tokens AS INTEGER) AS n_tokens, template, n_notes FROM kept JOIN found USING (line)
"""


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chosen_path.linked_notes(notes_of(_table(spark, sf_dir, "documents")))
    return r.select(F.col("record_id").alias("doc_id"), "class_id", "text_id", "n_copies", "n_links")


def gold_of(items: DataFrame) -> DataFrame:
    """Benchmark items as held-out gold notes."""
    return items.select(F.col("item_id").alias("gold_id"), F.col("text").alias("notes"))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.leaked_notes(notes_of(_table(spark, sf_dir, "documents")), gold_of(_table(spark, sf_dir, "benchmark")))
    return r.withColumnsRenamed({"record_id": "doc_id", "gold_id": "item_id"})


# The public vocabulary's place; every node of a cluster has it at the path its driver names.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@_query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = pieces.sample_segmentations(notes_of(_table(spark, sf_dir, "documents")), PIECES, decoded="notes")
    return drawn.select(
        F.col("record_id").alias("doc_id"), "draw", "n_pieces", "log_prob", "perturbed", "log_inclusion",
        F.xxhash64("pieces").alias("pieces_hash"), F.crc32(F.col("notes").cast("binary")).alias("text_crc32"))


@_query
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("beat"))
    r = block_search.best_matches(units, F.col("unit_id") % 50 == 0)
    return r.withColumnRenamed("unit_id", "vec_id")


SQL["op2_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sharding.shard_records(notes_of(_table(spark, sf_dir, "documents")), 40)
    return r.select(F.col("record_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.filter(fold_of("doc_id") != 0).select(F.col("doc_id").alias("record_id"), F.col("text").alias("notes"), F.col("lang").alias("language"))
    r = language.note_languages(notes_of(docs), learn)
    return r.select(F.col("record_id").alias("doc_id"), (fold_of("record_id") == 0).alias("held_out"), F.col("language").alias("lang_pred"), "score", "accepted")


@_query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pseudo_likelihood.note_likelihoods(notes_of(_table(spark, sf_dir, "documents")))
    return r.withColumnRenamed("record_id", "doc_id")


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    r = html_text.page_texts(keyed, "page", "html")
    return r.select("page_id.page_id", "page_id.url", "text", "n_chars")


@_query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = note_rules.judge_notes(notes_of(_table(spark, sf_dir, "documents")))
    return r.select(F.col("record_id").alias("doc_id"), *note_rules.BASE, "base_failed", "kept")


SQL["op11_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS p FROM w WHERE len(words) >= 8),
grams AS (SELECT r, p, array_to_string(words[p:p + 7], ' ') AS g FROM pos),
twice AS (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
marked AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice WHERE n > 1) GROUP BY r),
top AS (SELECT r, max(n) AS most FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(words) AS x FROM w) GROUP BY ALL) GROUP BY r),
c AS (SELECT w.r, doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS caps, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS smalls, length(regexp_replace(t, '[^!]+', '', 'g')) AS marks,
    len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered, len(list_filter(lines, lambda x: suffix(x, '...'))) AS dotted,
    len(list_filter(lines, lambda x: prefix(x, '-') OR prefix(x, '*'))) AS bullets, coalesce(most, 0) AS most, len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutter
    FROM w LEFT JOIN marked USING (r) LEFT JOIN top ON w.r = top.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR caps > smalls
    OR 5 * marks > n_words OR 100 * lettered < 80 * n_words OR 100 * dotted > 30 * n_lines OR 100 * bullets > 90 * n_lines OR 100 * most > 30 * n_words OR 100 * stutter > 30 * n_words) AS kept
FROM f
"""


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("beat"))
    return whitening.whitened_beats(units).withColumnRenamed("unit_id", "vec_id")


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    notes = docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("notes"), F.col("lang").alias("class"))
    marks = labels.select(F.col("doc_id").alias("record_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit_filters(notes, marks)


SQL["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS bits FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM b GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS vs FROM f a, f b, f c, f d, f e WHERE a.v | b.v | c.v | d.v | e.v = 31),
s AS (SELECT filter_order, step, vs[step] AS own, CAST(coalesce(list_sum(vs[1:step - 1]), 0) AS INT) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (bits & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & own <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (bits & before <> 0 AND bits & own <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
    coalesce(sum(g) FILTER (bits & before = 0 AND bits & own <> 0), 0) AS good_lost, coalesce(sum(x) FILTER (bits & before = 0 AND bits & own <> 0), 0) AS toxic_lost
    FROM cells, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
