"""Registered queries over the driver's tables, with their SQL twins.

Names start with the operator's id in the inventory. Tables that the driver lacks are modelled on those it has:
documents stand for records (source: file, lang: family), labels for exploration marks and outcomes, embeddings for
logits, events for jobs, attempts and results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import masking, strict_json
from weftline.functions import text as T
from weftline.operators import conversations as C
from weftline.operators import decisions as D
from weftline.operators import graph as G
from weftline.operators import metrics as M
from weftline.operators import planning as P
from weftline.operators import records as R
from weftline.operators import selection as S
from weftline.operators import similarity as J
from weftline.plans.staging import shared_dir
from weftline.sources import jsonl

BUDGET = 2_000
SEED = 20260920
QUOTAS = [("de", 10), ("en", 20), ("es", 10), ("fr", 10)]
FRACTIONS = {"train": 0.5, "dev": 0.1, "test": 0.4}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL")


NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"
DOCS = "docs AS (SELECT doc_id, text, lang, source, " + NORM.format("text") + " AS norm FROM documents WHERE text IS NOT NULL)"
MESSAGES = "msgs AS (SELECT conv_id, list({'content': text, 'role': role} ORDER BY turn) AS m, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS users FROM conversations GROUP BY conv_id)"

# --- conversations ---


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS body FROM conversations GROUP BY conv_id")
def a1_assembly(spark, sf_dir):
    m = C.assemble(_conversations(spark, sf_dir))
    roles, texts = F.expr("transform(messages, x -> x.role)"), F.expr("transform(messages, x -> x.content)")
    return m.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(roles, ",").alias("roles"), T.digest(F.array_join(texts, "\n")).alias("body"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_users, coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0)::BIGINT AS user_chars FROM conversations GROUP BY conv_id")
def a2_role_filter(spark, sf_dir):
    users = C.user_texts(F.col("messages"))
    m = C.assemble(_conversations(spark, sf_dir)).withColumn("u", users)
    return m.select("conv_id", F.size("u").cast("long").alias("n_users"), F.length(F.array_join("u", "")).cast("long").alias("user_chars"))


BOUNDS = f"""run AS (SELECT conv_id, role, row_number() OVER w - 1 AS i, sum(length(text)) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
b AS (SELECT conv_id, min(i) AS first_index, max(i) AS last_index FROM run WHERE r <= {BUDGET} AND role = 'user' GROUP BY conv_id)"""


@query(f"WITH {BOUNDS} SELECT conv_id, first_index, last_index, CASE WHEN first_index = last_index THEN 1 ELSE 2 END AS n_prefixes FROM b")
def a3_prefix_bounds(spark, sf_dir):
    """Also A4: the first and the last eligible user turn."""
    return C.prefix_bounds(_conversations(spark, sf_dir), BUDGET)


@query(
    f"""WITH {BOUNDS}, p AS (SELECT conv_id, first_index AS x FROM b UNION SELECT conv_id, last_index FROM b),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, role, text FROM conversations)
SELECT p.conv_id, p.x AS prefix_index, count(*) AS n_messages, sha256(to_json(list({{'content': text, 'role': role}} ORDER BY turn))::VARCHAR) AS prefix_sha256
FROM p JOIN t ON t.conv_id = p.conv_id AND t.i <= p.x GROUP BY p.conv_id, p.x"""
)
def a5_prefixes(spark, sf_dir):
    p = C.prefixes(_conversations(spark, sf_dir), BUDGET)
    return p.select("conv_id", "prefix_index", F.size("messages").cast("long").alias("n_messages"), "prefix_sha256")


@query(
    """WITH x AS (SELECT conv_id, min(turn) FILTER (WHERE role IS NULL OR role NOT IN ('system', 'user', 'assistant') OR trim(coalesce(text, '')) = '') AS bad,
       bool_or(role = 'user') AS has_user FROM conversations GROUP BY conv_id),
v AS (SELECT x.conv_id, CASE WHEN bad IS NULL AND NOT has_user THEN 'missing_user_turn' WHEN bad IS NULL THEN NULL
       WHEN c.role IN ('system', 'user', 'assistant') THEN 'empty_or_nontext_message' ELSE 'unsupported_role' END AS reason
       FROM x LEFT JOIN conversations c ON c.conv_id = x.conv_id AND c.turn = x.bad)
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM v GROUP BY 1"""
)
def p1_validity(spark, sf_dir):
    """Also P2: how many conversations each reason rejects."""
    m = C.assemble(_conversations(spark, sf_dir))
    return m.groupBy(F.coalesce(C.reject_reason(F.col("messages")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {BOUNDS}, c AS (SELECT DISTINCT conv_id FROM conversations) SELECT c.conv_id, b.conv_id IS NULL AS no_prefix FROM c LEFT JOIN b USING (conv_id)")
def p3_no_prefix(spark, sf_dir):
    rows = _conversations(spark, sf_dir)
    have = C.prefix_bounds(rows, BUDGET).select("conv_id", F.lit(False).alias("no_prefix"))
    return rows.select("conv_id").distinct().join(have, "conv_id", "left").withColumn("no_prefix", F.coalesce("no_prefix", F.lit(True)))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') > 1 AS history_dependent, sum(length(text)) > 3000 AS oversized FROM conversations GROUP BY conv_id")
def p9_history(spark, sf_dir):
    """Also P4: records that are too long to be sampled."""
    g = _conversations(spark, sf_dir).groupBy("conv_id")
    return g.agg((F.count_if(F.col("role") == "user") > 1).alias("history_dependent"), (F.sum(F.length("text")) > 3000).alias("oversized"))


# --- text ---


@query(f"WITH {DOCS} SELECT doc_id, sha256(norm) AS norm_sha256, length(norm)::BIGINT AS norm_chars FROM docs")
def f4_normalize(spark, sf_dir):
    """The exact form (NFKC and case folding)."""
    n = _documents(spark, sf_dir).select("doc_id", T.normal(F.col("text")).alias("n"))
    return n.select("doc_id", T.digest(F.col("n")).alias("norm_sha256"), F.length("n").cast("long").alias("norm_chars"))


@query(f"WITH {DOCS} SELECT doc_id, sha256(norm) AS name_sha256 FROM docs")
def f5_normalize_names(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.digest(T.normalize_name(F.col("text"))).alias("name_sha256"))


@query(
    "WITH b AS (SELECT doc_id, regexp_extract(text || '?', '(?s)^(.*)\\n', 1) AS before FROM documents WHERE text IS NOT NULL AND contains(text, chr(10))), "
    "a AS (SELECT doc_id, " + NORM.format("before") + " AS anchor FROM b WHERE length(before) >= 160) SELECT doc_id, sha256(anchor) AS anchor_sha256 FROM a WHERE length(anchor) >= 80"
)
def f6_document_anchor(spark, sf_dir):
    """Documents made into prompts whose last line asks."""
    d = _documents(spark, sf_dir).select("doc_id", T.document_anchor(F.concat("text", F.lit("?"))).alias("anchor"))
    return d.where("anchor IS NOT NULL").select("doc_id", T.digest(F.col("anchor")).alias("anchor_sha256"))


@query(
    f"WITH {MESSAGES}, n AS (SELECT conv_id, list_transform(users, lambda x: {NORM.format('x')}) AS u FROM msgs WHERE len(users) > 0) "
    "SELECT conv_id, 'users' AS kind, sha256(to_json(u)::VARCHAR) AS key FROM n UNION ALL SELECT conv_id, 'first', sha256(u[1]) FROM n WHERE length(u[1]) >= 80"
)
def f7_exact_keys(spark, sf_dir):
    """All three kinds; the SQL lacks documents that conversations quote, of which the driver's tables have none."""
    return C.exact_keys(C.assemble(_conversations(spark, sf_dir)))


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[\\x{3400}-\\x{9fff}]') THEN 'no_cjk_not_necessarily_english' ELSE 'other' END AS profile FROM documents WHERE text IS NOT NULL")
def f8_script_profile(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.script_profile(F.col("text")).alias("profile"))


FLAGS_SQL = """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '\\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9_]{12,})\\b') THEN 'credential_pattern' END,
CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}') THEN 'email' END,
CASE WHEN regexp_matches(text, '(^|[^\\d.])(?:\\d{1,3}\\.){3}\\d{1,3}([^\\d.]|$)') THEN 'ip_address' END,
CASE WHEN regexp_matches(text, '(^|[^\\d])1[3-9]\\d{9}([^\\d]|$)') THEN 'mobile_number' END) AS flags FROM documents WHERE text IS NOT NULL"""


@query(FLAGS_SQL)
def f9_privacy_flags(spark, sf_dir):
    """Also P5: credential flags exclude a record from sampling, not from grouping."""
    return _documents(spark, sf_dir).select("doc_id", F.array_join(T.privacy_flags(F.col("text")), ",").alias("flags"))


@query()
def f10_masking(spark, sf_dir):
    """Also P6: masked prefixes, with categories counted and exclusions marked."""
    p = C.prefixes(_conversations(spark, sf_dir), BUDGET)
    masked = p.select("conv_id", "prefix_index", masking.sanitize_state(F.expr("transform(messages, x -> x.role)"), F.expr("transform(messages, x -> x.content)")).alias("s"))
    counts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("s.counts"))))
    return masked.select("conv_id", "prefix_index", T.digest(F.to_json("s.texts")).alias("masked_sha256"), counts.alias("counts"), "s.excluded")


@query(
    "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}')) AS v FROM documents) "
    "SELECT doc_id, 'EMAIL' AS category, count(DISTINCT v) AS n FROM e GROUP BY doc_id"
)
def ag9_redaction_counts(spark, sf_dir):
    """Distinct masked values of a category, from the masker."""
    d = _documents(spark, sf_dir).select("doc_id", F.array(F.lit("user")).alias("r"), F.array("text").alias("t"))
    counted = d.select("doc_id", masking.sanitize_state("r", "t").alias("s")).select("doc_id", F.explode("s.counts").alias("category", "n"))
    return counted.where("category = 'EMAIL'").select("doc_id", "category", F.col("n").cast("long").alias("n"))


@query("SELECT CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'json_object_required' ELSE 'invalid_json' END AS reason, count(*) AS n FROM events GROUP BY 1")
def f11_strict_json(spark, sf_dir):
    """Strict objects in the events' properties: bare, in a fence, and spoilt in three ways."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    spoilt = (
        F.when(F.col("event_id") % 5 == 0, F.col("props"))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_id") % 5 == 2, F.concat("props", F.lit(" {}")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise('{"a": 1e999}')
    )
    parsed = e.select("event_id", strict_json.parse_strict(spoilt).alias("r"))
    return parsed.groupBy(F.coalesce("r.reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {DOCS}, s AS (SELECT DISTINCT doc_id, substr(norm, i, 5) AS g FROM docs, unnest(range(1, length(norm) - 3)) AS r(i) WHERE length(norm) >= 5) SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id UNION ALL SELECT doc_id, 1 FROM docs WHERE length(norm) < 5")
def f13_shingles(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.count_normal_shingles(F.col("text")).alias("n_shingles"))


@query(
    "WITH w AS (SELECT doc_id, source, list_distinct(string_split(lower(text), ' ')) AS s FROM documents WHERE text IS NOT NULL), "
    "p AS (SELECT a.doc_id AS l, b.doc_id AS r, a.s AS x, b.s AS y FROM w a JOIN w b ON a.source = b.source AND b.doc_id = a.doc_id + 1 OR (a.source = b.source AND b.doc_id = a.doc_id + 20)) "
    "SELECT l, r, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard FROM p"
)
def f14_jaccard(spark, sf_dir):
    w = _documents(spark, sf_dir).select("doc_id", "source", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    steps = w.withColumn("r", F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 20)))
    other = w.select(F.col("doc_id").alias("r"), F.col("source").alias("source"), F.col("s").alias("y"))
    return steps.join(other, ["r", "source"]).select(F.col("doc_id").alias("l"), "r", F.round(T.jaccard(F.col("s"), F.col("y")), 9).alias("jaccard"))


@query("WITH s AS (SELECT item_id, sha256(text) AS h FROM benchmark) SELECT item_id, ('0x' || left(h, 8))::BIGINT AS seed, (('0x' || left(h, 8))::BIGINT + 3) % 2147483648 AS trace_seed, least(24000, greatest(4096, 80 * length(text)))::INT AS budget FROM benchmark JOIN s USING (item_id)")
def f18_seeds(spark, sf_dir):
    """Also F2, F19 and F20."""
    seed = T.seed_of(T.digest(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", seed.alias("seed"), T.trace_seed(seed, F.lit(3)).alias("trace_seed"), T.output_budget(F.length("text")).alias("budget"))


@query("SELECT event_id, replace(replace(props, 'mobile', '[REDACTED]'), '<', '\\u003c') AS scrubbed FROM events")
def f17_scrub(spark, sf_dir):
    """Also F3: serialisation without control openers."""
    return table(spark, sf_dir, "events").select("event_id", T.serialize(T.scrub(F.col("props"), ["mobile"])).alias("scrubbed"))


@query(
    "WITH m AS (SELECT conv_id, list(text) AS ts, string_agg(text, chr(10) ORDER BY turn) AS whole, max(length(text)) AS longest FROM conversations GROUP BY conv_id), "
    "q AS (SELECT conv_id, ts, [whole[5:40], whole[longest - 10:longest + 30]] AS qs FROM m) "
    "SELECT conv_id, len(list_filter(qs, lambda e: len(list_filter(ts, lambda t: contains(t, e))) = 0)) = 0 AS grounded FROM q"
)
def f16_evidence(spark, sf_dir):
    """Two quotes of each conversation's joined text: grounded where each lies within one message."""
    m = C.assemble(_conversations(spark, sf_dir)).select("conv_id", F.expr("transform(messages, x -> x.content)").alias("ts"))
    whole = m.withColumn("w", F.array_join("ts", "\n")).withColumn("n", F.array_max(F.transform("ts", F.length)))
    quotes = F.array(F.substring("w", 5, 36), F.substring(F.col("w"), F.col("n") - 10, F.lit(41)))
    return whole.select("conv_id", R.grounded(quotes, F.col("ts")).alias("grounded"))


# --- joins and groups ---


SETS = """s AS (SELECT DISTINCT doc_id, substr(norm, i, 5) AS g FROM docs, unnest(range(1, greatest(length(norm) - 3, 2))) AS r(i)),
cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS rep, len(l) AS n FROM (SELECT doc_id, list(g ORDER BY g) AS l FROM s GROUP BY doc_id)),
c AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM (SELECT s.* FROM s JOIN cl USING (doc_id) WHERE rep = doc_id) a JOIN (SELECT s.* FROM s JOIN cl USING (doc_id) WHERE rep = doc_id) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT l, r, c / (x.n + y.n - c) AS jaccard FROM c JOIN cl x ON x.doc_id = l JOIN cl y ON y.doc_id = r WHERE c * 100 >= (x.n + y.n - c) * 85 UNION ALL SELECT rep, doc_id, 1.0 FROM cl WHERE rep <> doc_id)"""


@query(f"""WITH {DOCS}, {SETS} SELECT l AS "left", r AS "right", round(jaccard, 9) AS jaccard FROM near""")
def j3_jaccard_join(spark, sf_dir):
    """Pairs between the first documents of equal sets, and these documents with their equals; prefixes by document frequency (AG13)."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return J.threshold_join(docs, 85, "doc_id", "text", T.normal_shingles).withColumn("jaccard", F.round("jaccard", 9))


@query("SELECT 0 AS wrong, true AS found_nine_tenths")
def j2_lsh_join(spark, sf_dir):
    """MinHash bands with exact verification against j3_jaccard_join: pairs that it lacks (none), and its recall."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    exact = J.threshold_join(docs, 85, "doc_id", "text", T.normal_shingles).select("left", "right", F.lit(1).alias("e"))
    both = J.lsh_join(docs, 85, node="doc_id", tokens="text", cut=T.normal_shingles).select("left", "right", F.lit(1).alias("f")).join(exact, ["left", "right"], "full")
    hits, all_ = F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()), F.count_if(F.col("e").isNotNull())
    return both.agg(F.count_if(F.col("e").isNull()).cast("int").alias("wrong"), (hits >= 0.9 * all_).alias("found_nine_tenths"))


def _keyed(spark, sf_dir):
    """Each document under the digest of its text and, if it has 80 characters, that of its first line, normalised."""
    n, first = T.normal(F.col("text")), T.normal(F.substring_index("text", "\n", 1))
    keys = F.array(T.digest(n), F.when(F.length(first) >= T.ANCHOR_CHARS, T.digest(F.concat(F.lit("first:"), first))))
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("node"), F.explode(F.array_compact(keys)).alias("key"))


KEYED = (
    DOCS
    + ", k AS (SELECT doc_id, sha256(norm) AS key FROM docs UNION ALL SELECT doc_id, sha256('first:' || f) FROM (SELECT doc_id, "
    + NORM.format("split_part(text, chr(10), 1)")
    + " AS f FROM docs) WHERE length(f) >= 80)"
)
ROOTS = KEYED + """, o AS (SELECT key, min(doc_id) AS o FROM k GROUP BY key), e AS (SELECT DISTINCT doc_id AS a, o AS b FROM k JOIN o USING (key)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
g AS (SELECT docs.*, x.root, sha256(text) AS raw_sha256, coalesce(quality = 0, false) AS explored
      FROM docs JOIN (SELECT a, min(b) AS root FROM r GROUP BY a) x ON x.a = docs.doc_id
      LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""


def _members(spark, sf_dir):
    """Documents with root, raw_sha256, n_chars of the text and explored (documents marked as poor stand for explored ones).

    What is read of a text is computed before the joins, so no text is shuffled.
    """
    edges = G.key_edges(_keyed(spark, sf_dir))
    own = _documents(spark, sf_dir).select("doc_id", "lang", "source", T.digest(F.col("text")).alias("raw_sha256"), F.length("text").alias("n_chars"))
    docs = G.labelled(own, edges, "doc_id")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    full = docs.join(marks, "doc_id", "left")
    return full.withColumn("explored", F.coalesce(F.col("_q") == 0, F.lit(False))).drop("_q")


@query(f"WITH {KEYED}, o AS (SELECT key, min(doc_id) AS o, count(*) AS n FROM k GROUP BY key) SELECT DISTINCT doc_id AS a, o AS b FROM k JOIN o USING (key) WHERE doc_id <> o")
def j1_key_edges(spark, sf_dir):
    return G.key_edges(_keyed(spark, sf_dir))


@query(f"WITH RECURSIVE {ROOTS} SELECT doc_id, root FROM g")
def g1_components(spark, sf_dir):
    return G.labelled(_documents(spark, sf_dir).select("doc_id"), G.key_edges(_keyed(spark, sf_dir)), "doc_id")


@query(f"WITH RECURSIVE {ROOTS} SELECT root, bool_or(explored) AS quarantine FROM g GROUP BY root")
def g2_quarantine(spark, sf_dir):
    return G.quarantined(_members(spark, sf_dir))


@query(f"WITH RECURSIVE {ROOTS} SELECT root, 'g_' || min(raw_sha256) AS group_id FROM g GROUP BY root")
def g3_group_ids(spark, sf_dir):
    """Also AG5."""
    return G.stable_group_id(_members(spark, sf_dir))


@query(f"WITH RECURSIVE {ROOTS}, i AS (SELECT root, lang, 'g_' || min(raw_sha256) AS group_id FROM g GROUP BY root, lang) SELECT lang AS root, 'rg_' || sha256(to_json(list(DISTINCT group_id ORDER BY group_id))::VARCHAR) AS reviewed_id FROM i GROUP BY lang")
def g4_reviewed_ids(spark, sf_dir):
    """Groups merged by family, as a review might."""
    ids = _members(spark, sf_dir).groupBy("root", "lang").agg(F.concat(F.lit("g_"), F.min("raw_sha256")).alias("group_id"))
    return G.reviewed_group_id(ids.select(F.col("lang").alias("root"), "group_id"))


@query(f"WITH RECURSIVE {ROOTS} SELECT root, string_agg(DISTINCT lang, ',' ORDER BY lang) AS families FROM g GROUP BY root HAVING count(DISTINCT lang) > 1")
def g10_mixed_families(spark, sf_dir):
    found = _members(spark, sf_dir).groupBy("root").agg(F.array_sort(F.collect_set("lang")).alias("f"))
    return found.where(F.size("f") > 1).select("root", F.array_join("f", ",").alias("families"))


@query(f"WITH RECURSIVE {ROOTS}, x AS (SELECT doc_id, root, source, row_number() OVER (PARTITION BY root ORDER BY explored DESC, source, doc_id) AS r FROM g) SELECT root, doc_id, source FROM x WHERE r = 1")
def g6_representatives(spark, sf_dir):
    """One member of each group of equal keys, explored ones first, then by source order."""
    return S.first_of_group(_members(spark, sf_dir), "root", F.desc("explored"), "source", "doc_id").select("root", "doc_id", "source")


@query(
    f"""WITH RECURSIVE {ROOTS}, x AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY explored DESC, source, doc_id) AS f FROM g),
{SETS.replace("FROM docs, unnest", "FROM (SELECT * FROM x WHERE f = 1), unnest").replace("AS r(i)", "AS q(i)")},
u2 AS (SELECT doc_id AS a, root AS b FROM g UNION SELECT root, doc_id FROM g UNION SELECT l, r FROM near UNION SELECT r, l FROM near),
r2 AS (SELECT a, b FROM u2 UNION SELECT r2.a, u2.b FROM r2 JOIN u2 ON r2.b = u2.a), m AS (SELECT a AS doc_id, min(b) AS root FROM r2 GROUP BY a)
SELECT m.doc_id, m.root, bool_or(explored) OVER (PARTITION BY m.root) AS quarantine FROM m JOIN g USING (doc_id)"""
)
def g5_two_phase(spark, sf_dir):
    """Documents by root and quarantine after both phases: equal keys, then similar representatives in the same components."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    docs = _documents(spark, sf_dir).join(marks, "doc_id", "left").withColumn("explored", F.coalesce(F.col("_q") == 0, F.lit(False)))

    def near(firsts):
        return J.threshold_join(firsts.select("doc_id", "text"), 85, "doc_id", "text", T.normal_shingles)

    order = (F.desc("explored"), "source", "doc_id")
    members = G.two_phase(docs, G.key_edges(_keyed(spark, sf_dir)), near, order, "doc_id")
    return members.join(G.quarantined(members), "root").select("doc_id", "root", "quarantine")


@query(f"WITH RECURSIVE {ROOTS}, v AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS kept FROM docs WHERE length(norm) >= 80) SELECT kept, count(*) AS views FROM v GROUP BY kept HAVING count(*) > 1")
def g7_view_dedup(spark, sf_dir):
    """Also P10: views of 80 normalised characters at least; equal ones leave the first."""
    n = _documents(spark, sf_dir).select("doc_id", T.normal(F.col("text")).alias("n")).where(F.length("n") >= 80)
    return n.groupBy(T.digest(F.col("n"))).agg(F.min("doc_id").alias("kept"), F.count("*").alias("views")).where("views > 1").select("kept", "views")


@query(
    f"WITH {MESSAGES}, x AS (SELECT conv_id, 'all' AS view, {NORM.format('array_to_string(users, chr(10))')} AS t FROM msgs WHERE len(users) > 0 "
    f"UNION ALL SELECT conv_id, 'turn', {NORM.format('text')} FROM conversations WHERE role = 'user') SELECT conv_id, view, sha256(t) AS sha256 FROM x WHERE length(t) >= 80"
)
def g8_views(spark, sf_dir):
    m = C.assemble(_conversations(spark, sf_dir)).withColumn("u", C.user_texts(F.col("messages"))).where(F.size("u") > 0)
    views = F.concat(
        F.array(F.struct(F.lit("all").alias("view"), F.array_join("u", "\n").alias("t"))), F.transform("u", lambda t: F.struct(F.lit("turn").alias("view"), t.alias("t")))
    )
    each = m.select("conv_id", F.explode(views).alias("v")).select("conv_id", "v.view", T.normal(F.col("v.t")).alias("t"))
    return each.where(F.length("t") >= 80).select("conv_id", "view", T.digest(F.col("t")).alias("sha256"))


@query(f"WITH RECURSIVE {ROOTS}, q AS (SELECT root FROM g GROUP BY root HAVING bool_or(explored)) SELECT doc_id, root FROM g WHERE root NOT IN (SELECT root FROM q)")
def j8_exclusion(spark, sf_dir):
    """Whole components that an explored member touches go."""
    return G.usable(_members(spark, sf_dir)).select("doc_id", "root")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def j4_prefix_parent(spark, sf_dir):
    """Rows without a parent are dropped, others inherit its columns."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT d.doc_id, 'family_' || lang AS family, coalesce(l.quality::VARCHAR, 'exploration_quarantine') AS assigned FROM documents d LEFT JOIN labels l USING (doc_id)")
def j13_assignment(spark, sf_dir):
    """Also J6: a small dimension by broadcast, then assignments with a default."""
    family = spark.sql("SELECT * FROM VALUES ('de'), ('en'), ('es'), ('fr') AS f(lang)").withColumn("family", F.concat(F.lit("family_"), "lang"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(family), "lang")
    assigned = F.coalesce(F.col("quality").cast("string"), F.lit("exploration_quarantine"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "family", assigned.alias("assigned"))


@query(f"WITH RECURSIVE {ROOTS}, s AS (SELECT root FROM g WHERE source = 'src3') SELECT doc_id, root FROM g WHERE root IN (SELECT root FROM s)")
def j9_members(spark, sf_dir):
    m = _members(spark, sf_dir)
    return m.join(m.where("source = 'src3'").select("root"), "root", "left_semi").select("doc_id", "root")


JOBS = "jobs AS (SELECT event_id AS job, user_id AS slot FROM events), res AS (SELECT event_id AS job, user_id AS slot, value > 50 AS accepted FROM events WHERE event_type = 'purchase')"


def _jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("job"), F.col("user_id").alias("slot"))
    return jobs, e.where("event_type = 'purchase'").select(F.col("event_id").alias("job"), F.col("user_id").alias("slot"), (F.col("value") > 50).alias("accepted"))


@query(f"WITH {JOBS} SELECT job, slot FROM jobs WHERE job NOT IN (SELECT job FROM res) AND slot NOT IN (SELECT slot FROM res WHERE accepted)")
def j10_pending(spark, sf_dir):
    """Also R5: jobs with results, then slots with accepted ones, are left out."""
    return R.pending(*_jobs(spark, sf_dir)).select("job", "slot")


@query("WITH a AS (SELECT user_id AS request, event_id AS attempt, CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 429 ELSE 404 END AS status FROM events) SELECT request, min(attempt) AS attempt FROM a WHERE status BETWEEN 200 AND 299 GROUP BY request")
def j11_first_ok(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "click", 429).otherwise(404)
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("attempt"), status.alias("status"))
    return R.first_ok(a).select("request", "attempt")


@query("WITH a AS (SELECT CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 429 WHEN 'view' THEN 503 ELSE 404 END AS s FROM events) SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (408, 429) OR s BETWEEN 500 AND 599 THEN 'retry' ELSE 'halt' END AS class, count(*) AS n FROM a GROUP BY 1")
def p18_status_class(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "click", 429).when(F.col("event_type") == "view", 503).otherwise(404)
    return table(spark, sf_dir, "events").groupBy(R.status_class(status).alias("class")).agg(F.count("*").alias("n"))


# --- counts ---


@query(
    "SELECT source, count(*) AS records, count(text) AS valid, count(*) - count(text) AS invalid, count(*) FILTER (WHERE length(text) > 10000) AS over_budget, "
    "count(*) FILTER (WHERE regexp_matches(text, '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_.-]+\\.[A-Za-z]{2,}')) AS flagged FROM documents GROUP BY source"
)
def ag1_source_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    flagged = F.array_contains(T.privacy_flags(F.col("text")), "email")
    return d.groupBy("source").agg(
        F.count("*").alias("records"), F.count("text").alias("valid"), F.count_if(F.col("text").isNull()).alias("invalid"), F.count_if(F.length("text") > 10000).alias("over_budget"), F.count_if(flagged).alias("flagged")
    )


@query(f"WITH {DOCS}, x AS (SELECT norm, count(*) AS n, count(DISTINCT source) AS s FROM docs GROUP BY norm) SELECT count(*) AS groups, (sum(n) - count(*))::BIGINT AS duplicates, count(*) FILTER (WHERE s > 1) AS cross_source FROM x")
def ag2_duplicates(spark, sf_dir):
    """Also AG3: groups that span several files."""
    n = _documents(spark, sf_dir).select("source", T.digest(T.normal(F.col("text"))).alias("k"))
    g = n.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return g.agg(F.count("*").alias("groups"), (F.sum("n") - F.count("*")).alias("duplicates"), F.count_if(F.col("s") > 1).alias("cross_source"))


@query(f"WITH RECURSIVE {ROOTS} SELECT doc_id, count(*) OVER (PARTITION BY root) AS group_size FROM g")
def ag4_group_size(spark, sf_dir):
    m = _members(spark, sf_dir).select("doc_id", "root")
    return m.join(m.groupBy("root").agg(F.count("*").alias("group_size")), "root").select("doc_id", "group_size")


@query("SELECT d.lang AS family, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE quality IS NULL) AS unmarked FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def ag8_split_family(spark, sf_dir):
    """Also AG6 and AG7: the matrix of families and splits."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    split = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unmarked")
    named = d.select(F.col("lang").alias("family"), split.alias("split"))
    return named.groupBy("family").pivot("split", ["good", "poor", "unmarked"]).count().na.fill(0)


@query("WITH x AS (SELECT CASE event_type WHEN 'click' THEN 'invalid_json' WHEN 'view' THEN 'state_too_long' WHEN 'purchase' THEN NULL ELSE 'something_else' END AS r FROM events) SELECT coalesce(CASE WHEN r IS NULL OR r IN ('invalid_json', 'state_too_long') THEN r ELSE 'format_or_budget_validation' END, 'accepted') AS reason, count(*) AS n FROM x GROUP BY 1")
def ag10_reasons(spark, sf_dir):
    """Also P17: unknown reasons collapse."""
    reason = F.when(F.col("event_type") == "click", "invalid_json").when(F.col("event_type") == "view", "state_too_long").when(F.col("event_type") != "purchase", "something_else")
    return table(spark, sf_dir, "events").groupBy(F.coalesce(R.public_reason(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "WITH w AS (SELECT len(string_split(text, ' ')) AS n FROM conversations), b(bin, lo, hi) AS (VALUES ('1-8', 1, 8), ('9-32', 9, 32), ('33-96', 33, 96), ('97-256', 97, 256)) "
    "SELECT bin, count(n) AS n FROM b LEFT JOIN w ON n BETWEEN lo AND hi GROUP BY bin"
)
def ag11_length_histogram(spark, sf_dir):
    n = F.size(F.split("text", " "))
    bin_ = F.when(n <= 8, "1-8").when(n <= 32, "9-32").when(n <= 96, "33-96").when(n <= 256, "97-256")
    counts = _conversations(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
    bins = spark.sql("SELECT * FROM VALUES ('1-8'), ('9-32'), ('33-96'), ('97-256') AS b(bin)")
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


@query("SELECT conv_id, max(length(text)) AS longest, sum(length(text))::BIGINT AS total, string_agg(length(text)::VARCHAR, ',' ORDER BY turn) AS lengths FROM conversations GROUP BY conv_id")
def ag12_path_metrics(spark, sf_dir):
    """Also AG16."""
    n = C.assemble(_conversations(spark, sf_dir)).select("conv_id", F.expr("transform(messages, x -> cast(length(x.content) AS bigint))").alias("n"))
    return n.select("conv_id", F.array_max("n").alias("longest"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_join("n", ",").alias("lengths"))


@query(f"WITH {DOCS}, t AS (SELECT DISTINCT doc_id, unnest(string_split(norm, ' ')) AS t FROM docs), f AS (SELECT t, count(*) AS df FROM t GROUP BY t) SELECT df, count(*) AS tokens FROM f GROUP BY df")
def ag13_token_frequency(spark, sf_dir):
    """How many tokens have each document frequency."""
    t = _documents(spark, sf_dir).select(F.explode(F.array_distinct(F.split(T.normal(F.col("text")), " "))).alias("t"))
    return t.groupBy("t").agg(F.count("*").alias("df")).groupBy("df").agg(F.count("*").alias("tokens"))


# --- selection ---

RANKED = f"ranked AS (SELECT doc_id AS node, lang AS source, sha256(to_json({{'raw_sha256': sha256(text), 'seed': {SEED}, 'source': lang}})::VARCHAR) AS rank FROM documents WHERE text IS NOT NULL)"


def _ranked(spark, sf_dir):
    rank = S.rank_digest(T.digest(F.col("text")), F.col("lang"), SEED)
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("node"), F.col("lang").alias("source"), rank.alias("rank"))


@query(f"WITH {RANKED}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, node DESC) AS cut FROM ranked) SELECT source, node, row_number() OVER (PARTITION BY source ORDER BY rank, node) AS position FROM c WHERE cut <= 40")
def w1_reservoir(spark, sf_dir):
    """Also W2."""
    return S.reservoir(_ranked(spark, sf_dir), 40).select("source", "node", "position")


def _greedy_sql() -> str:
    parts, before = [], []
    for i, (source, quota) in enumerate(QUOTAS):
        used = "".join(f" AND root NOT IN (SELECT root FROM s{j})" for j in before)
        parts.append(
            f"s{i} AS (SELECT source, node, root FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY position, node) AS f FROM cand WHERE source = '{source}'{used}) WHERE f = 1 ORDER BY position, node LIMIT {quota})"
        )
        before.append(i)
    cand = (
        f"WITH RECURSIVE {ROOTS}, {RANKED}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, node DESC) AS cut FROM ranked), "
        "p AS (SELECT source, node, row_number() OVER (PARTITION BY source ORDER BY rank, node) AS position FROM c WHERE cut <= 40), "
        "cand AS (SELECT p.*, g.root FROM p JOIN g ON g.doc_id = p.node)"
    )
    return f"{cand}, {', '.join(parts)} " + " UNION ALL ".join(f'SELECT source, node, root AS "group" FROM s{i}' for i in before)


@query(_greedy_sql())
def w3_greedy_quota(spark, sf_dir):
    """Sources in order, each with its first candidates of groups that are still free."""
    roots = _members(spark, sf_dir).select(F.col("doc_id").alias("node"), F.col("root").alias("group"))
    return S.greedy_quota(S.reservoir(_ranked(spark, sf_dir), 40).join(roots, "node"), QUOTAS).select("source", "node", "group")


DIGESTS = f"dig AS (SELECT conv_id AS id, (conv_id % 7)::VARCHAR AS source, sha256('[{SEED},' || conv_id || ']') AS digest FROM (SELECT DISTINCT conv_id FROM conversations))"


def _digested(spark, sf_dir):
    c = _conversations(spark, sf_dir).select("conv_id").distinct()
    d = T.digest(F.concat(F.lit(f"[{SEED},"), F.col("conv_id").cast("string"), F.lit("]")))
    return c.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 7).cast("string").alias("source"), d.alias("digest"))


@query(f"WITH {DIGESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest) AS turn FROM dig) SELECT id, source, turn FROM r ORDER BY turn, source LIMIT 30")
def w5_round_robin(spark, sf_dir):
    return S.round_robin(_digested(spark, sf_dir), 30).select("id", "source", "turn")


@query(f"WITH {DIGESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest) AS f FROM dig) SELECT id, source FROM r WHERE f = 1")
def w6_first_per_group(spark, sf_dir):
    return S.first_of_group(_digested(spark, sf_dir), "source", "digest").select("id", "source")


@query(
    "WITH s AS (SELECT lang AS name, count(*) / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY lang) AS place FROM documents GROUP BY lang), "
    "b AS (SELECT name, floor(share * 97) AS whole, round(share * 97 - floor(share * 97), 9) AS rest, place FROM s) "
    "SELECT name, (whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, place) <= 97 - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM b"
)
def w8_allocations(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    whole = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return S.allocations(whole.select(F.col("lang").alias("name"), "share", F.row_number().over(Window.orderBy("lang")).alias("place")), 97)


@query(
    f"""WITH RECURSIVE {ROOTS}, f AS (SELECT root, list(DISTINCT lang) AS families FROM g GROUP BY root), n AS (SELECT count(*) AS n FROM f),
x(split, frac) AS (VALUES ('train', 0.5::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.4::DOUBLE)),
fl AS (SELECT split, frac, floor(n * frac + 1e-9) AS c, n * frac AS ex, n FROM x, n),
ct AS (SELECT split, frac, c + CASE WHEN row_number() OVER (ORDER BY c - ex, split) <= n - sum(c) OVER () THEN 1 ELSE 0 END AS c FROM fl),
h AS (SELECT root FROM f WHERE list_contains(families, 'fr')),
p AS (SELECT root, row_number() OVER (ORDER BY sha256('[{SEED},"' || root || '"]'), root) AS i FROM f WHERE NOT list_contains(families, 'fr')),
q AS (SELECT 0 AS i, '' AS s, (SELECT c FROM ct WHERE split = 'train')::BIGINT AS a, (SELECT c FROM ct WHERE split = 'test')::BIGINT - (SELECT count(*) FROM h) AS b, (SELECT c FROM ct WHERE split = 'dev')::BIGINT AS d
 UNION ALL SELECT i + 1, CASE WHEN a >= b AND a >= d THEN 'train' WHEN b >= d THEN 'test' ELSE 'dev' END,
 a - CASE WHEN a >= b AND a >= d THEN 1 ELSE 0 END, b - CASE WHEN NOT (a >= b AND a >= d) AND b >= d THEN 1 ELSE 0 END, d - CASE WHEN NOT (a >= b AND a >= d) AND NOT b >= d THEN 1 ELSE 0 END
 FROM q WHERE i < (SELECT count(*) FROM p))
SELECT root::VARCHAR AS "group", 'test' AS split, 'source_holdout' AS evaluation_slice FROM h UNION ALL SELECT p.root::VARCHAR, q.s, 'in_distribution' FROM p JOIN q USING (i)"""
)
def w10_split_allocation(spark, sf_dir):
    """Also W11: the holdout family's components are all in its split."""
    groups = _members(spark, sf_dir).groupBy(F.col("root").cast("string").alias("group")).agg(F.collect_set("lang").alias("families"))
    return S.allocate_splits(groups, FRACTIONS, SEED, "fr", "test")


@query("WITH j AS (SELECT event_id AS job, user_id AS slot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT job, slot FROM j WHERE r = 1 ORDER BY job LIMIT 32")
def w12_slot_batch(spark, sf_dir):
    return S.exclusive_batch(_jobs(spark, sf_dir)[0], 32, "slot", "job")


def _recipes_sql() -> str:
    """Buckets in order with their numbers, dealt out in turns; what is drawn comes from digests."""
    drawn = lambda n, name: f"('0x' || left(sha256('[{SEED},' || slot || ',\"' || {name} || '\"]'), 12))::BIGINT % {n}"
    one = lambda name, values: f"{list(values)}[{drawn(len(values), repr(name))} + 1] AS {name}"
    return f"""WITH q(bucket, place, low, high, n) AS (VALUES ('129-255', 0, 129, 255, 4), ('65-128', 1, 65, 128, 8), ('33-64', 2, 33, 64, 12), ('9-32', 3, 9, 32, 20), ('2-8', 4, 2, 8, 36), ('noul', 5, 2, 2, 20)),
t AS (SELECT *, unnest(range(1, n + 1)) AS turn FROM q), s AS (SELECT *, row_number() OVER (ORDER BY turn, place) - 1 AS slot FROM t)
SELECT slot::INT AS slot, CASE WHEN bucket = 'noul' THEN 'noul' ELSE 'choice' END AS type, bucket,
CASE WHEN place = 0 AND turn <= 2 THEN 255 WHEN bucket = 'noul' THEN 2 ELSE low + {drawn("(high - low + 1)", "bucket")} END::INT AS k,
{one("language", P.LANGUAGES)}, {one("form", P.FORMS)}, {one("option_style", P.OPTION_STYLES)} FROM s"""


@query(_recipes_sql())
def w9_recipes(spark, sf_dir):
    """The planned question slots."""
    schema = "slot int, type string, bucket string, k int, language string, form string, option_style string"
    return spark.createDataFrame([tuple(r.values()) for r in P.recipes(100, SEED)], schema)


# --- set operations ---


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def st1_union(spark, sf_dir):
    """Also ST2."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT source, lang, count(*) AS n FROM (SELECT DISTINCT source, lang, n_chars FROM documents) GROUP BY source, lang")
def st3_locators(spark, sf_dir):
    d = table(spark, sf_dir, "documents").dropDuplicates(["source", "lang", "n_chars"])
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('page'))), ',') AS unknown_fields FROM events")
def st5_fields(spark, sf_dir):
    """Also A10: fields that a schema doesn't have."""
    keys = F.json_object_keys("props")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.array_except(keys, F.array(F.lit("page")))), ",").alias("unknown_fields"))


@query("WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents) SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'recomputed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def st6_replay(spark, sf_dir):
    """Rows on which a stored table and its recomputation differ."""
    a = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return R.differences(a, a.withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))))


# --- decisions: slices of the embeddings stand for logits ---

Z = "z AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::DOUBLE) AS z FROM embeddings), x AS (SELECT vec_id, z, list_max(z) AS t FROM z), e AS (SELECT vec_id, z, t, list_transform(z, lambda v: exp(v - t)) AS e FROM x), p AS (SELECT vec_id, z, t, list_transform(e, lambda v: v / list_sum(e)) AS p, list_sum(e) AS s FROM e)"


def _logits(spark, sf_dir, n=6):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(slice(embedding, 1, {n}), x -> cast(x AS double))").alias("z"))


@query(f"WITH {Z} SELECT vec_id, chr(96 + list_position(p, list_max(p))::INT) AS choice, round(list_max(p), 9) AS probability, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 9) AS margin FROM p")
def m2_choice(spark, sf_dir):
    """Also W13 and W14."""
    p = _logits(spark, sf_dir).select("vec_id", D.softmax(F.col("z")).alias("p"))
    c = p.select("vec_id", D.choice(F.col("p"), F.array(*map(F.lit, "abcdef"))).alias("c"))
    return c.select("vec_id", "c.choice", F.round("c.probability", 9).alias("probability"), F.round("c.margin", 9).alias("margin"))


@query(f"WITH {Z} SELECT vec_id, round(p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5] + 5 * p[6], 9) AS score FROM p")
def m3_score(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(D.score(D.softmax(F.col("z"))), 9).alias("score"))


@query("SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 9) AS p_true FROM embeddings")
def m4_noul(spark, sf_dir):
    return _logits(spark, sf_dir, 2).select("vec_id", F.round(D.noul(D.softmax(F.col("z"))), 9).alias("p_true"))


@query(f"WITH {Z} SELECT vec_id, round(t + ln(s), 9) AS lse FROM p")
def m5_logsumexp(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(D.logsumexp(F.col("z")), 9).alias("lse"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:6], lambda x: exp(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 9) AS mass FROM embeddings")
def m9_legal_mass(spark, sf_dir):
    all_ = F.expr("transform(embedding, x -> cast(x AS double))")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(D.legal_mass(F.slice(all_, 1, 6), all_), 9).alias("mass"))


TRACES = "tr AS (SELECT vec_id // 4 AS question, vec_id % 4 AS trace, i AS candidate, embedding[i]::DOUBLE AS logit FROM embeddings, unnest(range(1, 6)) AS r(i))"


def _traces(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 5)).alias("i", "v"))
    question = F.floor(F.col("vec_id") / 4)
    return e.select(question.alias("question"), (F.col("vec_id") % 4).alias("trace"), (F.col("i") + 1).cast("long").alias("candidate"), F.col("v").cast("double").alias("logit"))


@query(
    f"WITH {TRACES}, g AS (SELECT tr.*, t FROM tr, (VALUES (1), (2), (4)) v(t)), w AS (SELECT *, exp(logit / t) / sum(exp(logit / t)) OVER (PARTITION BY question, trace, t) AS p FROM g) "
    "SELECT question, m, t, candidate, round(avg(p), 9) AS p FROM w, (VALUES (1), (4)) u(m) WHERE trace < m GROUP BY question, m, t, candidate"
)
def m7_variants(spark, sf_dir):
    """Also M6, A12 and AG14: tempered, then averaged by candidate."""
    return D.variants(_traces(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(
    f"WITH {TRACES}, w AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY question, trace) AS p FROM tr) SELECT question, candidate, round(avg(p), 9) AS p FROM w GROUP BY question, candidate"
)
def m8_targets(spark, sf_dir):
    return D.variants(_traces(spark, sf_dir), (1,), (4,)).select("question", "candidate", F.round("p", 9).alias("p"))


@query("WITH x AS (SELECT vec_id // 4 AS question, list_sum(list_transform(embedding[1:6], lambda x: exp(x::DOUBLE))) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS mass FROM embeddings) SELECT question, round(min(mass), 9) AS least_mass FROM x GROUP BY question")
def ag15_least_mass(spark, sf_dir):
    all_ = F.expr("transform(embedding, x -> cast(x AS double))")
    m = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("question"), D.legal_mass(F.slice(all_, 1, 6), all_).alias("mass"))
    return m.groupBy("question").agg(F.round(F.min("mass"), 9).alias("least_mass"))


@query("SELECT vec_id, vec_id % 3 = 0 AS same, CASE vec_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unnormalized' ELSE 'candidate_coverage' END AS error FROM embeddings")
def p15_targets(spark, sf_dir):
    """Also M10: valid, unnormalised and incomplete distributions."""
    k = F.col("vec_id") % 3
    p = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.25), F.when(k == 1, 0.8).otherwise(0.75)))
    q = F.map_from_arrays(F.array(F.lit("b"), F.when(k == 2, "c").otherwise("a")), F.array(F.lit(0.75), F.lit(0.25)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), q.alias("q"))
    candidates = F.when(k == 2, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("a")))
    return e.select("vec_id", D.same_distribution(F.col("p"), F.col("q")).alias("same"), D.target_errors(F.col("p"), candidates).alias("error"))


@query(
    "SELECT event_id, CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'unknown_type' WHEN value < 20 THEN 'missing_instructions' WHEN event_type = 'click' AND event_id % 300 NOT BETWEEN 2 AND 255 THEN 'choice_size' "
    "WHEN event_type = 'purchase' AND event_id % 300 NOT BETWEEN 2 AND 10 THEN 'score_size' END AS error FROM events"
)
def p11_requests(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "choice").when(F.col("event_type") == "purchase", "score").otherwise("other")
    text = F.when(F.col("value") < 20, " ").otherwise("decide")
    n = F.col("event_id") % 300
    return table(spark, sf_dir, "events").select("event_id", D.request_errors(kind, text, n, F.lit(False)).alias("error"))


@query("SELECT item_id, len(c) AS n_paths, sha256(array_to_string(list_transform(c, lambda k: 'STATE ' || replace(text, '<', '\\u003c') || 'QUESTION {\"instructions\":\"pick\",\"type\":\"choice\"}[\"a\",\"b\"]CANDIDATE ' || k || 'DECISION'), chr(10))) AS paths_sha256 FROM benchmark, (SELECT ['a', 'b'] AS c)")
def m1_paths(spark, sf_dir):
    """One text for each candidate, shared parts first."""
    c = F.array(F.lit("a"), F.lit("b"))
    paths = D.paths(F.col("text"), F.lit("choice"), F.lit("pick"), F.to_json(c), c)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(paths).cast("long").alias("n_paths"), T.digest(F.array_join(paths, "\n")).alias("paths_sha256"))


@query("SELECT question, 'question_' || sha256('{\"candidate\":' || candidate || ',\"question\":' || question || '}') AS id FROM (SELECT DISTINCT vec_id // 4 AS question, 1 AS candidate FROM embeddings)")
def r1_records(spark, sf_dir):
    """Ids are digests of the canonical fields."""
    q = _traces(spark, sf_dir).where("candidate = 1").select("question", F.lit(1).alias("candidate")).distinct()
    return R.make_record(q, "question", "candidate").select("question", "id")


# --- evaluation ---

SCORED = "sc AS (SELECT vec_id, 1 / (1 + exp(-4 * embedding[1]::DOUBLE)) AS p, 4 * embedding[1]::DOUBLE AS z, label % 2 AS y FROM embeddings)"


def _scored(spark, sf_dir):
    z = 4 * F.get("embedding", F.lit(0)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", (1 / (1 + F.exp(-z))).alias("p"), z.alias("z"), (F.col("label") % 2).alias("y"))


@query(f"WITH {SCORED} SELECT count(*) AS n, round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 8) AS nll, round(avg((p - y) ** 2), 8) AS brier, round(avg((CASE WHEN p >= 0.5 THEN 1 ELSE 0 END = y)::INT), 8) AS accuracy FROM sc")
def x1_losses(spark, sf_dir):
    x = M.losses(_scored(spark, sf_dir))
    return x.select("n", *[F.round(c, 8).alias(c) for c in ("nll", "brier", "accuracy")])


@query(f"WITH {SCORED} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS mean_y FROM sc GROUP BY 1")
def x1_reliability(spark, sf_dir):
    x = M.reliability(_scored(spark, sf_dir))
    return x.select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("mean_y", 8).alias("mean_y"))


@query(f"WITH {SCORED}, b AS (SELECT least(floor(greatest(p, 1 - p) * 20), 19)::BIGINT AS step, count(*) AS n, sum(CASE WHEN (p >= 0.5) = (y = 1) THEN 0 ELSE 1 END) AS e FROM sc GROUP BY 1) SELECT step, round(sum(n) OVER w / sum(n) OVER (), 8) AS coverage, round(sum(e) OVER w / sum(n) OVER w, 8) AS risk FROM b WINDOW w AS (ORDER BY step DESC)")
def x1_coverage(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.greatest("p", 1 - F.col("p")).alias("confidence"), ((F.col("p") >= 0.5) != (F.col("y") == 1)).cast("int").alias("error"))
    x = M.coverage_curve(s, 20)
    return x.select("step", F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"))


@query(f"WITH {Z} SELECT vec_id, round(1 + list_sum(list_transform(p, lambda v: v * ln(v))) / ln(6), 8) AS concentration, round(p[5] + p[6], 8) AS tail, round(p[2] + 4 * p[3] + 9 * p[4] + 16 * p[5] + 25 * p[6] - (p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5] + 5 * p[6]) ** 2, 8) AS variance FROM p")
def x2_concentration(spark, sf_dir):
    """Also X3."""
    p = _logits(spark, sf_dir).select("vec_id", D.softmax(F.col("z")).alias("p"))
    c = F.col("p")
    return p.select("vec_id", F.round(M.entropy_concentration(c), 8).alias("concentration"), F.round(M.tail_mass(c, 4), 8).alias("tail"), F.round(M.score_variance(c), 8).alias("variance"))


@query(f"WITH {SCORED}, g AS (SELECT t, round(avg(ln(1 + exp(-CASE WHEN y = 1 THEN z ELSE -z END / t))), 9) AS nll FROM sc, (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)) v(t) GROUP BY t) SELECT t, round(nll, 7) AS nll FROM g ORDER BY nll, t LIMIT 1")
def x4_temperature(spark, sf_dir):
    return M.temperature_fit(_scored(spark, sf_dir), [0.5, 1.0, 2.0, 4.0, 8.0]).select("t", F.round("nll", 7).alias("nll"))


@query(f"WITH {SCORED} SELECT round(avg((greatest(p, 1 - p) >= 0.7)::INT), 8) AS coverage, round(count(*) FILTER (WHERE greatest(p, 1 - p) >= 0.7 AND (p >= 0.5) <> (y = 1)) / count(*) FILTER (WHERE greatest(p, 1 - p) >= 0.7), 8) AS error_rate, round(avg((greatest(p, 1 - p) < 0.7)::INT), 8) AS review_rate, round(quantile_cont(z, 0.5), 7) AS p50, round(quantile_cont(z, 0.95), 7) AS p95 FROM sc")
def x5_workflow(spark, sf_dir):
    x = M.workflow(_scored(spark, sf_dir), 0.7, latency="z")
    return x.select(*[F.round(c, 8).alias(c) for c in ("coverage", "error_rate", "review_rate")], F.round("p50", 7).alias("p50"), F.round("p95", 7).alias("p95"))


@query(f"WITH {TRACES}, w AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY question, trace) AS p FROM tr), a AS (SELECT question, candidate, avg(p) AS q, max(CASE WHEN trace = 0 THEN p END) AS p FROM w GROUP BY question, candidate) SELECT question, round(sum(-q * ln(p)), 8) AS loss FROM a GROUP BY question")
def x6_cross_entropy(spark, sf_dir):
    v = D.variants(_traces(spark, sf_dir), (1,), (1, 4))
    both = v.groupBy("question", "candidate").agg(F.max(F.when(F.col("m") == 4, F.col("p"))).alias("q"), F.max(F.when(F.col("m") == 1, F.col("p"))).alias("p"))
    return M.soft_cross_entropy(both).select("question", F.round("loss", 8).alias("loss"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(long::VARCHAR, 'all') AS long, count(*) AS n, round(avg(toxic), 8) AS toxic FROM (SELECT lang, n_chars > 2000 AS long, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY CUBE (lang, long)")
def x8_slices(spark, sf_dir):
    """Reports by slice; the cube is an extra."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") > 2000).cast("string").alias("long"), "toxic")
    c = d.cube("lang", "long").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 8).alias("toxic"))
    return c.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("long", F.lit("all")).alias("long"), "n", "toxic")


# --- files ---


@query("SELECT doc_id, lang, n_chars FROM documents")
def sc2_jsonl(spark, sf_dir):
    """Also SK1 and SK10: canonical lines written to the shared folder, read back with a schema."""
    path = f"{shared_dir(spark)}/weftline-lines-{uuid.uuid4().hex}"
    jsonl.write_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return jsonl.read(spark, path, "doc_id long, lang string, n_chars long, _corrupt string").select("doc_id", "lang", "n_chars")


@query("SELECT count(*) AS lines, count(*) AS found, count(DISTINCT item_id) AS digests FROM benchmark")
def sc1_located_scan(spark, sf_dir):
    """Also SC3 and SC4: lines with provenance, each found again by its file and digest."""
    path = f"{shared_dir(spark)}/weftline-lines-{uuid.uuid4().hex}"
    jsonl.write_lines(table(spark, sf_dir, "benchmark"), path)
    scan = jsonl.located(spark, f"{path}/*.json")
    anchors = jsonl.hashed(spark, path).select(F.col("raw_sha256"))
    found = jsonl.lookup(scan, anchors, "raw_sha256")
    both = found.agg(F.count("*").alias("found"), F.countDistinct("raw_sha256").alias("digests"), F.lit(1).alias("k"))
    return scan.agg(F.count("*").alias("lines"), F.lit(1).alias("k")).join(both, "k").select("lines", "found", "digests")


@query("SELECT lang AS split, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM documents GROUP BY lang")
def sk4_split_export(spark, sf_dir):
    """A folder for each split, written and read back."""
    path = f"{shared_dir(spark)}/weftline-splits-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("split"))
    jsonl.write_splits(rows, path)
    back = spark.read.schema("id long, split string").json(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


# --- plans of question runs ---


@query("SELECT vec_id AS job, sha256(to_json({'body': 'b' || label, 'job': vec_id, 'role': 'generate'})::VARCHAR) AS request FROM embeddings")
def m15_request_ids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rid = P.request_id(F.col("vec_id"), F.lit("generate"), F.concat(F.lit("b"), F.col("label").cast("string")))
    return e.select(F.col("vec_id").alias("job"), rid.alias("request"))


@query(
    f"WITH c AS (SELECT chr(65 + (i // 26)::INT) || chr(65 + (i % 26)::INT) AS code FROM range(676) r(i)), b AS (SELECT code, row_number() OVER (ORDER BY sha256('{SEED}:' || code), code) - 1 AS position FROM c ORDER BY position LIMIT 255), "
    "q AS (SELECT DISTINCT label AS question, vec_id::VARCHAR AS candidate FROM embeddings), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY candidate) - 1 AS place, ('0x' || left(sha256(question::VARCHAR), 8))::BIGINT % 255 AS turn FROM q) "
    "SELECT question, candidate, code FROM r JOIN b ON b.position = (turn + place) % 255"
)
def m11_task_codes(spark, sf_dir):
    """Also A9 and W15. A label has more vectors than there are codes: these come round again."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("question"), F.col("vec_id").cast("string").alias("candidate"))
    return P.tasks(e, P.codebook(P.letter_codes(spark), 255, SEED), repeat=True)


def _jobs_sql() -> str:
    """The greedy choice as a recursion over jobs: how many prefixes of each kind are gone, and what the job took."""
    plan = ", ".join(f"({r['slot']}, {str(r['form'] == 'history_dependent').upper()})" for r in P.recipes(100, SEED))
    return f"""WITH RECURSIVE {BOUNDS}, plan(slot, need) AS (VALUES {plan}),
jobs AS (SELECT row_number() OVER (ORDER BY attempt, slot) AS t, slot, attempt, need FROM plan, range(3) a(attempt)),
p AS (SELECT conv_id, last_index > 0 AS history, row_number() OVER (ORDER BY conv_id) AS i FROM b),
y AS (SELECT conv_id, i, row_number() OVER (ORDER BY i) - 1 AS k FROM p WHERE history),
n AS (SELECT conv_id, i, row_number() OVER (ORDER BY i) - 1 AS k FROM p WHERE NOT history),
s AS (SELECT 0 AS t, 0 AS gone_y, 0 AS gone_n, NULL::BIGINT AS took
  UNION ALL SELECT j.t, gone_y + coalesce((c.kind = 1)::INT, 0), gone_n + coalesce((c.kind = 0)::INT, 0), c.conv_id
  FROM s JOIN jobs j ON j.t = s.t + 1 LEFT JOIN LATERAL (SELECT * FROM (
    SELECT 1 AS kind, conv_id, i FROM y WHERE k = gone_y UNION ALL SELECT 0, conv_id, i FROM n WHERE k = gone_n AND NOT j.need) ORDER BY i LIMIT 1) c ON true)
SELECT slot::BIGINT AS slot, attempt::INT AS attempt, took AS prefix FROM s JOIN jobs USING (t) WHERE took IS NOT NULL"""


@query(_jobs_sql())
def w7_jobs(spark, sf_dir):
    """Prefixes of conversations assigned to slots."""
    bounds, plan = C.prefix_bounds(_conversations(spark, sf_dir), BUDGET), P.recipes(100, SEED)
    prefixes = P.eligible(bounds, len(plan) * P.RETRY_LIMIT, "conv_id", F.col("last_index") > 0)
    return P.assign(P.jobs_of(spark, plan), prefixes).select("slot", "attempt", F.col("id").alias("prefix"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
