"""Queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, decontamination, language_model, licenses, mixing, near_duplicates, pii, quality, toxicity, urls

# The production rule list of URL filters.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"), Fraction(3, 2), (3, 1, 2), max_repeats=2)
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = licenses.train(licenses.sample_lines(docs, "doc_id", "text", licenses.SAMPLE_DOCS))
    return licenses.scan(docs, model)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, action)")
    found = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
WITH r(rhost, rpath, action) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES) + r"""),
u AS (SELECT row_number() OVER () AS k, page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
m AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
dup AS (SELECT k, g FROM win GROUP BY k, g HAVING count(*) > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM win JOIN dup USING (k, g), range(5) AS x(j) GROUP BY k),
good AS (SELECT k, l, """ + (
    "l = '' OR NOT regexp_matches(l, '[^\\x20\\x09-\\x0D]') OR NOT ("
    "regexp_matches(l, '^(?:[^|»›·•]*[|»›·•]){3}') OR regexp_matches(l, '(?i)"
    + "|".join(quality.BOILERPLATE)
    + "') OR (length(l) - length(regexp_replace(l, '[#*$%&|<>{}~^\\\\]', '', 'g'))) * 100 > length(l) * "
    + str(quality.MAX_SYMBOL_PERCENT)
    + " OR (length(l) - length(replace(l, '!!', ''))) * 100 > length(l) * "
    + str(quality.MAX_SYMBOL_PERCENT)
    + " OR (NOT regexp_matches(l, '[\\p{P}][\\x20\\x09-\\x0D]*$') AND len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) < "
    + str(quality.MIN_OPEN_LINE_WORDS)
    + ")) AS ok"
) + r""" FROM (SELECT k, unnest(ls) AS l FROM w)),
c AS (SELECT k, coalesce(sum(length(l)) FILTER (WHERE ok), 0) + greatest(count(*) FILTER (WHERE ok) - 1, 0) AS clean,
             count(*) FILTER (WHERE regexp_matches(l, '[^\x20\x09-\x0D]'))
               - count(DISTINCT l) FILTER (WHERE regexp_matches(l, '[^\x20\x09-\x0D]')) AS n_dup_lines
      FROM good GROUP BY k),
o AS (SELECT doc_id, t, clean, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN c USING (k) LEFT JOIN rep USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND clean * 100 >= length(t) * """ + str(quality.MIN_KEPT_PERCENT) + """ AS kept
FROM o
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.train(toxicity.sample(docs, labels, ~toxicity.held_out(F.col("doc_id"), 0)))
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), 0).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(table(spark, sf_dir, "documents"), width=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS k, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
e AS (SELECT a, b FROM c JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT k, k FROM w),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT r.a AS k, min(w.doc_id) AS component_id FROM r JOIN w ON w.k = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (k) JOIN m USING (k)
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", extra), (-1, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(probe))


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
                + length(regexp_extract_all(text, '<\||</?s>|\[/?INST\]')) AS text_out,
             length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, chr(10), '')))
                + length(regexp_extract_all(role, '<\||</?s>|\[/?INST\]')) AS role_out
      FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(text_out + role_out + length('<|im_start|>') + 1 + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outside = language_model.held_out(F.col("doc_id"), 1)
    model, counts = language_model.learn(docs.where(~outside).select("text"))
    scored = language_model.score(docs, model, counts)
    return scored.select("doc_id", outside.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT j, item_id, least(5, len(w)) AS n, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
t AS (SELECT j, item_id, count(*) AS n_shingles FROM s GROUP BY j, item_id),
g AS (SELECT DISTINCT k, doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM s) AS z, unnest(range(1, len(w) - n + 2)) AS r(i)),
h AS (SELECT k, doc_id, j, count(*) AS n_shared FROM g JOIN s USING (n, g) GROUP BY k, doc_id, j)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, n_shared::BIGINT AS n_shared, n_shared / n_shingles AS containment
FROM h JOIN t USING (j) WHERE n_shared >= 0.8 * n_shingles
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_licenses, op3_url_filters, op4_pii, op5_quality, op6_toxicity, op7_jaccard_join, op8_chat, op9_lm_scoring, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": OP3_SQL, "op5_quality": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_chat": OP8_SQL, "op10_decontamination": OP10_SQL}
