"""Queries by name over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scalars as S
from gleaner.functions import unicode as U
from gleaner.operators import classify, cluster, layers, ledger, match, plan, scan, stats, survive, tree
from gleaner.plans.base import QUERIES, SQL, c, query
from gleaner.streaming import sessions

_CLUSTERS = """
WITH g AS (SELECT event_id, user_id, event_type, value,
    CASE WHEN value - lag(value) OVER w > 0.5 THEN 1 ELSE 0 END AS fresh FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value, event_id)),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g),
s AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type, cluster) AS cluster_size FROM n)
"""


def _clusters(t) -> DataFrame:
    return cluster.gap_clusters(t("events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "value", 0.5, ["event_id"])


@query(_CLUSTERS + "SELECT event_id, user_id, event_type, cluster, cluster_size FROM s WHERE cluster_size >= 2")
def dup_gap_clusters(t):
    return _clusters(t).select("event_id", "user_id", "event_type", "cluster", "cluster_size")


@query(_CLUSTERS + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, cluster ORDER BY value DESC, event_id) AS rank FROM s WHERE cluster_size >= 2)
SELECT user_id, count(*) AS members, count(*) FILTER (rank > 1) AS removals, round(sum(CASE WHEN rank > 1 THEN value ELSE 0 END), 6) AS freed FROM r GROUP BY user_id""")
def dup_cluster_survivors(t):
    ranked = survive.rank_survivors(_clusters(t), ["user_id", "event_type", "cluster"], [F.desc("value"), c("event_id")])
    return ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(c("rank") > 1).alias("removals"), F.round(F.sum(F.when(c("rank") > 1, c("value")).otherwise(0.0)), 6).alias("freed"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank,
CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) = 1 THEN 'keep' ELSE 'remove' END AS mark FROM orders""")
def dup_keeper(t):
    ranked = survive.rank_survivors(t("orders"), ["o_custkey"], [c("o_orderpriority"), F.desc("o_totalprice"), c("o_orderkey")])
    return ranked.select("o_orderkey", "o_custkey", "rank", F.when(c("rank") == 1, "keep").otherwise("remove").alias("mark"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS rank,
min(p_type) OVER (PARTITION BY p_brand, p_name) <> max(p_type) OVER (PARTITION BY p_brand, p_name) AS review FROM part)
SELECT p_partkey, review, rank, CASE WHEN review THEN '' WHEN rank = 1 THEN 'keep' ELSE 'remove' END AS mark FROM x""")
def dup_plan_review(t):
    return survive.plan_copies(t("part"), ["p_brand", "p_name"], [F.desc("p_retailprice"), F.desc("p_size"), c("p_partkey")], "p_type").select("p_partkey", "review", "rank", "mark")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS rank,
min(p_type) OVER (PARTITION BY p_brand, p_name) <> max(p_type) OVER (PARTITION BY p_brand, p_name) AS review FROM part)
SELECT count(DISTINCT p_brand || '|' || p_name) AS groups, count(*) FILTER (NOT review AND rank > 1) AS removals,
CAST(coalesce(sum(CASE WHEN NOT review AND rank > 1 THEN p_size END), 0) AS BIGINT) AS freed, count(DISTINCT CASE WHEN review THEN p_brand || '|' || p_name END) AS reviews FROM x""")
def dup_summary(t):
    marked = survive.plan_copies(t("part"), ["p_brand", "p_name"], [F.desc("p_retailprice"), c("p_partkey")], "p_type")
    return survive.summary(marked, ["p_brand", "p_name"], "p_size")


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS placed, o_orderpriority LIKE '1-%' AS lossless FROM orders),
y AS (SELECT *, bool_or(placed) OVER w AS a, bool_or(NOT placed) OVER w AS b, bool_or(placed AND lossless) OVER w AS g FROM x WINDOW w AS (PARTITION BY o_custkey))
SELECT o_orderkey, CASE WHEN placed THEN 'keep' WHEN lossless AND NOT g THEN 'held' ELSE 'delete' END AS plan FROM y WHERE a AND b""")
def dup_stray_plan(t):
    o = t("orders").withColumn("placed", c("o_orderstatus") == "F").withColumn("lossless", c("o_orderpriority").startswith("1-"))
    return survive.plan_strays(o, ["o_custkey"], "placed", "lossless").where(c("plan").isNotNull()).select("o_orderkey", "plan")


@query("""WITH k AS (SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS key, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') <> '' AS ok FROM documents)
SELECT key, count(*) AS n, min(doc_id) AS first_member FROM k WHERE ok GROUP BY key HAVING count(*) >= 2""")
def doc_duplicate_keys(t):
    docs = t("documents").select("doc_id", S.plain_key(c("text")).alias("k"))
    # a digest of the key is shuffled, never the text
    return cluster.duplicate_keys(docs.select("doc_id", F.when(c("k") != "", F.md5(c("k").cast("binary"))).alias("key")).na.fill("", ["key"]), "key", "doc_id")


_ENGLISH = ", ".join(f"'{w}'" for w in S.ENGLISH_WORDS)


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words, regexp_matches(text, '\\p{{L}}') AS letters FROM documents)
SELECT doc_id, CASE WHEN NOT letters THEN 'en' WHEN len(words) > 0 AND len(list_filter(words, lambda x: x IN ({_ENGLISH}))) / len(words) >= 0.25 THEN 'en' ELSE 'und' END AS lang FROM w""")
def doc_language_guess(t):
    return t("documents").select("doc_id", S.guess_language(c("text")).alias("lang"))


@query("""WITH w AS (SELECT p_partkey, p_brand, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS q FROM part),
s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.q = b.q THEN 1.0 ELSE least(len(list_intersect(a.q, b.q)) / len(list_distinct(list_concat(a.q, b.q))), 0.99) END AS score
FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.5""")
def part_token_match(t):
    w = t("part").select("p_partkey", "p_brand", S.words(F.lower("p_name")).alias("q"))
    return match.token_pairs(w, "p_partkey", "p_brand", "q", 0.5).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS gap FROM customer JOIN supplier ON c_nationkey = s_nationkey),
r AS (SELECT *, 3.0 - gap / 1000 AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY 3.0 - gap / 1000 DESC, s_suppkey) AS rank FROM x WHERE gap <= 2500 AND 3.0 - gap / 1000 > 0)
SELECT c_custkey, s_suppkey, round(score, 6) AS score FROM r WHERE rank = 1""")
def best_match_band(t):
    q = t("customer").select("c_custkey", c("c_nationkey").alias("nation"), "c_acctbal")
    h = t("supplier").select("s_suppkey", c("s_nationkey").alias("nation"), "s_acctbal")
    found = match.nearest_matches(q, h, ["nation"], "c_acctbal", "s_acctbal", lambda gap: F.lit(3.0) - gap / 1000, ["s_suppkey"], "c_custkey", 2500)
    return found.select("c_custkey", "s_suppkey", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT c_custkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) AS rank
FROM customer JOIN supplier ON c_nationkey = s_nationkey) SELECT c_custkey, s_suppkey, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 3""")
def top_candidates(t):
    q, h = t("customer").select("c_custkey", c("c_nationkey").alias("nation")), t("supplier").select("s_suppkey", "s_acctbal", c("s_nationkey").alias("nation"))
    return match.top_of_block(q, h, ["nation"], [F.desc("s_acctbal"), c("s_suppkey")], 3).select("c_custkey", "s_suppkey", "rank")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN u > p_retailprice * 1.5 OR u - p_retailprice > 60 THEN 'REJECT_MIX' WHEN u < p_retailprice * 0.4 THEN 'REJECT_SNIPPET' ELSE 'PASS' END AS status
FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def guardrail_status(t):
    both = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (c("l_extendedprice") / c("l_quantity")).alias("u")).join(t("part").select(c("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return both.select("l_orderkey", "l_linenumber", F.coalesce(classify.duration_status(c("u"), c("p_retailprice")), F.lit("PASS")).alias("status"))


@query("""WITH x AS (SELECT event_id, user_id % 7 <> 0 AS found, value AS ts, abs(value) AS l, 60 + event_id % 300 AS cat, event_id % 5 = 0 AS gen, event_id % 3 = 0 AS lr, event_id % 6 = 0 AS cr, event_id % 4 <> 0 AS ov,
CASE WHEN event_id % 2 = 0 THEN 'issue' END AS issue FROM (SELECT *, event_id % 11 * 0.01 AS skew FROM events)),
g AS (SELECT *, CASE WHEN l > 0 AND cat > 0 THEN abs(l - cat) END AS gap FROM x),
s AS (SELECT *, CASE WHEN NOT found THEN 'NO_MATCH' WHEN event_id % 11 * 0.01 > 0.05 THEN 'REJECT_SKEW' WHEN gap IS NOT NULL AND (l > cat * 1.5 OR l - cat > 60) THEN 'REJECT_MIX' WHEN gap IS NOT NULL AND l < cat * 0.4 THEN 'REJECT_SNIPPET'
WHEN gen THEN 'IDENTIFIED' WHEN lr AND NOT cr THEN 'POTENTIAL_REMIX' WHEN NOT ov THEN 'MISLABELED' ELSE 'CONFIRMED' END AS status,
CASE WHEN gap IS NULL THEN 0.85 WHEN gap <= 6 THEN 1.0 WHEN gap <= 15 THEN 0.88 ELSE 0.65 END AS base FROM g),
f AS (SELECT event_id, status, CASE WHEN status IN ('NO_MATCH', 'REJECT_MIX') THEN 0.0 WHEN status IN ('REJECT_SKEW', 'REJECT_SNIPPET') THEN 0.2 WHEN status = 'IDENTIFIED' AND base >= 0.85 THEN 1.0
WHEN status = 'POTENTIAL_REMIX' THEN least(base, 0.7) WHEN status = 'CONFIRMED' AND issue IS NOT NULL AND base >= 0.85 THEN 1.0 ELSE base END AS confidence FROM s)
SELECT event_id, status, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN status = 'NO_MATCH' THEN 'none' WHEN status LIKE 'REJECT%' THEN 'rejected' WHEN confidence >= 0.8 THEN 'high' ELSE 'unsure' END AS bucket FROM f""")
def match_evaluation(t):
    i = c("event_id")
    ev = classify.evaluate_match(
        c("user_id") % 7 != 0, (i % 11) * 0.01, F.lit(0.0), F.abs("value"), 60 + i % 300, i % 5 == 0, i % 3 == 0, i % 6 == 0, i % 4 != 0, F.when(i % 2 == 0, "issue")
    )
    e = t("events").select("event_id", ev.alias("e"))
    return e.select("event_id", "e.status", "e.confidence", classify.match_bucket(c("e.status"), c("e.confidence")).alias("bucket"))


@query("""WITH s AS (SELECT page_id, trim(regexp_extract(url, '([^/]*)/?$', 1)) AS s FROM pages)
SELECT page_id, CASE WHEN regexp_matches(s, '(?i)^(?:track|audiotrack|audio|song|sound|recording|videoplayback|untitled|new recording|voice)[\\s._-]*\\d*$') OR regexp_matches(s, '^[0-9a-fA-F_-]{1,16}$') THEN 'Generic or placeholder filename'
WHEN regexp_matches(s, '(?i)^(?:(?:cd|disc)?\\s*\\d{1,2}[-._\\s]+|\\d{1,3}[\\s._-]+|\\d{1,3}\\s+).*$') THEN 'Leading track number in filename'
WHEN regexp_matches(s, '(?i)\\b(?:www\\.[a-z0-9-]+\\.[a-z]{2,}|\\.com|\\.net|\\.org|\\.ru|\\.is|\\.cc)\\b') THEN 'Website/ripper tag in filename'
WHEN contains(s, '_') THEN 'Underscores in filename' ELSE 'Missing artist separator in filename' END AS issue FROM s""")
def filename_issue(t):
    stem = F.regexp_extract("url", "([^/]*)/?$", 1)
    return t("pages").select("page_id", F.coalesce(classify.name_issue(stem), F.lit("")).alias("issue"))


@query("""SELECT lang, count(*) AS total, count(*) FILTER (quality IS NOT NULL) AS have, count(*) FILTER (n_chars >= 200 AND quality IS NULL) AS missing, count(*) FILTER (n_chars < 200) AS incapable
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def coverage_by_lang(t):
    both = t("documents").select("doc_id", "lang", "n_chars").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return stats.coverage(both, ["lang"], c("quality").isNotNull(), c("n_chars") >= 200)


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def tree_rollup(t):
    n = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "n_name", "r_name")  # 25 rows
    both = t("customer").select("c_nationkey", "c_acctbal").join(F.broadcast(n), c("c_nationkey") == c("n_nationkey"))
    return tree.rollup_counts(both, ["r_name", "n_name"], customers=F.count(F.lit(1)), balance=F.round(F.sum("c_acctbal"), 2))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS parts FROM pages),
a AS (SELECT page_id, unnest(range(1, least(len(parts) - 1, 2) + 1)) AS i, parts FROM p)
SELECT array_to_string(parts[1:i], '/') AS folder, count(*) AS files, CAST(i AS INTEGER) AS depth, CAST(sum(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS audio FROM a GROUP BY ALL""")
def folder_depth_counts(t):
    p = t("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return tree.depth_counts(p, "path", c("page_id") % 2 == 0, 2)


@query("""SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def lines_exploded(t):
    return layers.lines(t("documents"), ["doc_id"], "text")


@query("""WITH e AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, trim(unnest(l)) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS b, max(CASE WHEN text <> '' THEN pos END) OVER (PARTITION BY doc_id) AS l FROM e)
SELECT doc_id, pos, text FROM w WHERE (text <> '' OR coalesce(b, '') <> '') AND pos <= l""")
def plain_line_rows(t):
    return layers.plain_lines(t("documents"), ["doc_id"], "text")


@query("SELECT p_partkey, CAST(round_even(ln(greatest(p_retailprice * 1.25, 1.0)) / ln(1.08), 0) AS BIGINT) AS level FROM part")
def quality_level(t):
    q = S.audio_quality(F.lit("m4a"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), c("p_retailprice") * 1000, F.lit(0), F.lit(0.0))
    return t("part").select("p_partkey", q["level"].alias("level"))


@query("""WITH k AS (SELECT substr(event_type, 1, 1) AS key, event_type, count(*) AS uses, min(event_id) AS first_seen FROM events GROUP BY ALL),
r AS (SELECT *, CAST(sum(uses) OVER (PARTITION BY key) AS BIGINT) AS total, row_number() OVER (PARTITION BY key ORDER BY uses DESC, first_seen) AS rank FROM k)
SELECT key, event_type, uses, first_seen, total FROM r WHERE rank = 1""")
def spelling_mode(t):
    return cluster.spelling_mode(t("events").withColumn("key", F.substring("event_type", 1, 1)), "key", "event_type", "event_id")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages""")
def title_and_host(t):
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("""WITH x AS (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def layer_runs(t):
    r = layers.runs(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


_NOW = "timestamp '2024-02-01 00:00:00'"


def _ledger(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


_LEDGER = "l AS (SELECT user_id, max_by(event_type, struct_pack(ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY user_id)"


@query(f"""WITH {_LEDGER} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l WHERE status NOT IN ('click', 'purchase') OR epoch({_NOW}) - epoch(ts) <= 2592000)""")
def ledger_pending(t):
    holds = ledger.settled(_ledger(t), F.expr(_NOW), 30, ("click", "purchase"))
    return ledger.pending(t("customer").select("c_custkey"), holds.select(c("user_id").alias("c_custkey")), "c_custkey")


@query(f"""WITH {_LEDGER}, h AS (SELECT user_id, status FROM l WHERE status NOT IN ('click', 'purchase') OR epoch({_NOW}) - epoch(ts) <= 2592000)
SELECT coalesce(status, CASE WHEN c_acctbal > 5000 THEN 'saved' ELSE 'pending' END) AS state, count(*) AS n FROM customer LEFT JOIN h ON c_custkey = user_id GROUP BY 1""")
def ledger_states(t):
    led = _ledger(t).withColumnRenamed("user_id", "c_custkey")
    return ledger.statuses(t("customer"), led, "c_custkey", F.expr(_NOW), 30, ("click", "purchase"), c("c_acctbal") > 5000).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LEDGER}, n AS (SELECT c_custkey AS user_id, c_mktsegment AS status, timestamp '2024-01-15 00:00:00' AS ts FROM customer WHERE c_acctbal > 0),
u AS (SELECT *, 0 AS s FROM l UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, s DESC) AS k FROM u)
SELECT user_id, status, CAST(floor(epoch(ts)) AS BIGINT) AS seen FROM r WHERE k = 1""")
def ledger_upsert(t):
    news = t("customer").select(c("c_custkey").alias("user_id"), c("c_mktsegment").alias("status"), F.expr("timestamp_ntz '2024-01-15 00:00:00'").alias("at"), (c("c_acctbal") > 0).alias("certain"))
    return ledger.upsert(_ledger(t), news, "user_id", certain="certain").select("user_id", "status", c("at").cast("timestamp").cast("long").alias("seen"))


@query(f"""WITH {_LEDGER}, m AS (SELECT c_custkey AS o, 3 * c_custkey + 7 AS n FROM customer), f AS (SELECT * FROM m WHERE n NOT IN (SELECT user_id FROM l))
SELECT coalesce(n, user_id) AS user_id, status FROM l LEFT JOIN f ON user_id = o""")
def ledger_rekey(t):
    moves = t("customer").select(c("c_custkey").alias("old"), (3 * c("c_custkey") + 7).alias("new"))
    return ledger.rekey(_ledger(t), moves, "user_id").select("user_id", "status")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3)")
def all_outputs(t):
    return ledger.with_all_outputs(t("customer").select("c_custkey"), "c_custkey", t("orders").select(c("o_custkey").alias("c_custkey"), "o_orderstatus"), "o_orderstatus", ("F", "O", "P"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def needed_lookups(t):
    return ledger.pending(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT conv_id, turn, length(text) AS shown FROM conversations")
def line_dictionary(t):
    looked = match.dictionary_join(t("conversations"), "text", lambda d: d.withColumn("shown", F.char_length("text").cast("long")), "shown")
    return looked.select("conv_id", "turn", "shown")


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS name FROM part) SELECT name, count(*) AS n, min(p_partkey) AS first_member FROM w GROUP BY name""")
def name_explode_counts(t):
    return cluster.explode_counts(t("part").withColumn("w", S.words(F.lower("p_name"))), "w", "p_partkey")


@query("""SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM (SELECT c_mktsegment || c_nationkey || '-' || c_custkey % 10 AS c_mktsegment, c_custkey FROM customer) GROUP BY 1 HAVING count(*) = 1""")
def unique_homes(t):
    return cluster.first_unique(t("customer").select(F.concat(c("c_mktsegment"), c("c_nationkey").cast("string"), F.lit("-"), (c("c_custkey") % 10).cast("string")).alias("c_mktsegment"), "c_custkey"), "c_mktsegment", "c_custkey")


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN p_name || '.mp3' ELSE p_name || ' (' || k || ').mp3' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)""")
def collision_names(t):
    return plan.collision_numbers(t("part"), F.lower("p_name"), [c("p_partkey")], c("p_name"), F.lit(".mp3")).select("p_partkey", "final")


@query("""WITH taken AS (SELECT DISTINCT lower(p_name) AS s, CAST(greatest(p_size, 2) AS INTEGER) AS n FROM part),
f AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY n) AS k FROM (SELECT DISTINCT lower(p_name) AS s FROM part) CROSS JOIN (SELECT unnest(range(1, 3000)) AS n)
WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.s = lower(s) AND 1 = 0) AND (s, n) NOT IN (SELECT s, n FROM taken)),
c AS (SELECT p_partkey, p_name, lower(p_name) AS s, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS final FROM c JOIN f USING (s, k)""")
def free_name_numbers(t):
    taken = t("part").select(F.concat("p_name", F.lit(" ("), F.greatest(c("p_size").cast("int"), F.lit(2)).cast("string"), F.lit(")")).alias("name"))
    return plan.free_names(t("part").select("p_partkey", "p_name"), "p_name", taken, "name", [c("p_partkey")]).select("p_partkey", "final")


@query("""SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS step, event_id, event_type AS "from", props AS "to" FROM events""")
def undo_replay(t):
    ops = t("events").withColumn("seq", F.struct("ts", "event_id"))
    return plan.undo_by(ops, ["user_id"], "seq", "props", "event_type").select("user_id", "step", c("seq.event_id").alias("event_id"), "from", "to")


@query("""SELECT event_id, CASE WHEN o.event_type IS NULL THEN 'moved' WHEN o.event_type = e.event_type THEN 'same' ELSE 'conflict' END AS status
FROM (SELECT event_id, event_id + 5 AS dest, event_type FROM events) e LEFT JOIN (SELECT 3 * event_id AS k, event_type FROM events) o ON dest = k""")
def move_statuses(t):
    moves = t("events").select("event_id", (c("event_id") + 5).alias("dest"), "event_type")
    there = t("events").select((3 * c("event_id")).alias("k"), c("event_type").alias("v"))
    return plan.move_status(moves, there, "dest", "event_type", "k", "v").select("event_id", "status")


@query("""SELECT o_orderkey, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o_orderpriority FROM orders""")
def canonical_spellings(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return plan.canonical_spelling(o, ["o_custkey"], "o_orderpriority", "seq").select("o_orderkey", "o_orderpriority")


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, count(*) AS n, CAST(epoch_us(min(ts)) AS BIGINT) AS started, CAST(epoch_us(max(ts)) AS BIGINT) AS ended FROM r GROUP BY user_id, s""")
def session_bridge(t):
    s = sessions.batch_sessions(t("events"), "user_id", "ts", "30 minutes")
    return s.select("user_id", "n", F.unix_micros(c("started").cast("timestamp")).alias("started"), F.unix_micros(c("ended").cast("timestamp")).alias("ended"))


_MARKERS = r"(?:re-?mix(?:ed)?|live|acoustic|instrumental|sped[\s-]?up|slowed|reverb|nightcore|8d|extended)"


@query(f"""WITH x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Song ' || page_id || ' (Live Remix)' WHEN 1 THEN 'Song - Sped Up' WHEN 2 THEN 'Nightcore song [re-mixed]' ELSE 'Live and let' END AS t FROM pages),
m AS (SELECT page_id, list_concat(list_concat(regexp_extract_all(t, '(?i)[\\(\\[][^\\)\\]]*\\b(?:re-?mix(?:ed)?|live|acoustic|instrumental)\\b[^\\)\\]]*[\\)\\]]'),
regexp_extract_all(t, '(?i)[\\s\\-–—]+(?:re-?mix(?:ed)?|live|acoustic|instrumental)\\s*$')), regexp_extract_all(t, '(?i)\\bslowed(?:\\s*[+&]\\s*|\\s+and\\s+)reverb\\b|\\bsped[\\s-]?up\\b|\\bslowed(?:\\s+down)?\\b|\\breverb\\b|\\bnightcore\\b|\\b8d(?:\\s+audio)?\\b|\\bextended(?:\\s+(?:mix|version|edit))?\\b')) AS spans FROM x)
SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(spans, lambda s: regexp_extract_all(s, '(?i)\\b{_MARKERS}\\b'))), lambda w: CASE WHEN starts_with(regexp_replace(lower(w), '[\\s-]', '', 'g'), 'remix') THEN 'remix' ELSE regexp_replace(lower(w), '[\\s-]', '', 'g') END))), ',') AS markers FROM m""")
def variant_markers(t):
    i = c("page_id")
    title = F.when(i % 4 == 0, F.concat(F.lit("Song "), i.cast("string"), F.lit(" (Live Remix)"))).when(i % 4 == 1, "Song - Sped Up").when(i % 4 == 2, "Nightcore song [re-mixed]").otherwise("Live and let")
    return t("pages").select("page_id", F.array_join(S.variant_markers(title), ",").alias("markers"))


@query("""WITH x AS (SELECT o_orderkey, o_totalprice * (o_orderkey % 4) * (o_orderkey % 4) * 2500 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', CAST(n AS BIGINT)) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size,
printf('%d:%02d', CAST(floor(CAST(o_orderkey AS BIGINT) / 60) AS BIGINT), o_orderkey % 60) AS length FROM x""")
def formatted_sizes(t):
    o = t("orders").select("o_orderkey", (c("o_totalprice") * (c("o_orderkey") % 4) * (c("o_orderkey") % 4) * 2500).alias("n"))
    return o.select("o_orderkey", S.human_size(c("n")).alias("size"), S.minutes_cut(c("o_orderkey")).alias("length"))


@query("""WITH l AS (SELECT DISTINCT doc_id, min(p) AS pos, x AS line FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS p, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) GROUP BY doc_id, x),
w AS (SELECT *, len(list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+'))) AS words FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos) AS rank FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(words AS INTEGER) AS words FROM r WHERE rank <= 6""")
def probe_lines(t):
    each = layers.lines(t("documents"), ["doc_id"], "text").groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))
    each = each.withColumn("words", F.size(F.array_distinct(S.words(F.lower("line")))))
    return survive.rank_survivors(each, ["doc_id"], [F.desc("words"), c("pos")]).where("rank <= 6").select("doc_id", "pos", "words")


@query("""WITH a AS (SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer GROUP BY 1), b AS (SELECT s_nationkey + 10 AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.id, b.id) AS id, CAST(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS priority FROM a FULL JOIN b ON a.k = b.k""")
def prioritized_union(t):
    a = t("customer").select(c("c_nationkey").alias("k"), c("c_custkey").alias("id"))
    b = t("supplier").select((c("s_nationkey") + 10).alias("k"), c("s_suppkey").alias("id"))
    return match.prioritized([a, b], "k", [c("id")])


@query("""WITH w AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) AS w FROM part), s AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS k FROM part WHERE p_size < 10)
SELECT p_partkey, bool_and(k IS NOT NULL) AS complete FROM (SELECT p_partkey, unnest(w) AS x FROM w) LEFT JOIN s ON x = k GROUP BY p_partkey""")
def combo_complete(t):
    store = t("part").where("p_size < 10").select(F.lower(F.split("p_name", " ")[0]).alias("k"))
    return match.all_parts_present(t("part").select("p_partkey", F.array_distinct(S.words(F.lower("p_name"))).alias("w")), "p_partkey", "w", store, "k")


@query("""WITH v AS (SELECT o_custkey, lower(o_orderpriority) AS cand, count(*) AS votes, min(o_orderkey) AS f FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) AS k FROM v)
SELECT r.o_custkey, o_orderpriority, votes FROM r JOIN orders ON o_orderkey = f WHERE k = 1""")
def album_vote(t):
    return match.vote(t("orders").withColumn("cand", F.lower("o_orderpriority")), "o_custkey", "cand", "o_orderpriority", "o_orderkey")


@query("""SELECT page_id, 'https://example' AS folder FROM pages WHERE starts_with(url, 'https://example/') UNION ALL SELECT page_id, 'https:/' FROM pages WHERE starts_with(url, 'https://') UNION ALL SELECT page_id, 'https:' FROM pages WHERE starts_with(url, 'https:/')""")
def scoped_folders(t):
    return stats.scoped(t("pages"), "url", ["https://example", "https:/", "https:"]).select("page_id", "folder")


@query("""WITH b AS (SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1) SELECT reason, n, (SELECT sum(n) > 6 AND count(*) <= 2 FROM b) AS collapsed FROM b""")
def failure_reasons(t):
    return stats.failure_reasons(t("events").withColumn("reason", c("event_type")), "reason")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12""")
def report_head(t):
    return stats.head_with_total(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), c("o_orderkey")])


@query("""WITH k AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(c_acctbal AS BIGINT) AS songs FROM customer)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY songs DESC, c_custkey) AS INTEGER) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM k) WHERE n > 1""")
def duplicate_folder_rank(t):
    k = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", c("c_acctbal").try_cast("long").alias("floor"), F.rint("c_acctbal").cast("long").alias("songs"), F.lit(0).alias("plain"), F.lpad(c("c_custkey").cast("string"), 12, "0").alias("name"))
    return tree.duplicate_folders(k, "c_nationkey", "c_mktsegment", "name", "songs", "plain").select("c_custkey", "rank")


# rules that SQL has no form for: rows are checked by unit tests


@query()
def seq_ratio_mismatch(t):
    # names meet types far less often than there are rows: each distinct pair is compared once
    pairs = t("part").select(c("p_name").alias("name"), c("p_type").alias("kind")).distinct()
    told = classify.severe_mismatch(pairs.select("name", "kind", U.strip_marks("name").alias("a"), U.strip_marks("kind").alias("b")), "a", "b").select("name", "kind", "severe")
    return t("part").join(told, c("p_name").eqNullSafe(c("name")) & c("p_type").eqNullSafe(c("kind"))).select("p_partkey", "severe")


@query()
def nfkc_key(t):
    return t("part").select("p_partkey", U.norm(c("p_name")).alias("key"), U.album_key(c("p_name"), c("p_brand")).alias("album"), U.sanitize_name(c("p_name")).alias("safe"))


@query()
def romaji_kana(t):
    return t("part").select("p_partkey", U.romaji_to_kana(F.lower("p_name")).alias("kana"))


@query()
def parsed_names(t):
    return t("part").select("p_partkey", S.parse_filename(F.concat(c("p_size").cast("string"), F.lit(" - "), c("p_brand"), F.lit(" - "), c("p_name"))).alias("p")).select("p_partkey", "p.*")


@query("""WITH RECURSIVE o AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS i FROM lineitem),
b AS (SELECT *, q AS used, CAST(0 AS BIGINT) AS batch FROM o WHERE i = 1
UNION ALL SELECT o.*, CASE WHEN used + o.q > 400 THEN o.q ELSE used + o.q END, batch + CASE WHEN used + o.q > 400 THEN 1 ELSE 0 END FROM b JOIN o ON o.l_suppkey = b.l_suppkey AND o.i = b.i + 1)
SELECT l_suppkey, l_orderkey, l_linenumber, q, batch FROM b""")
def size_batches(t):
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", c("l_quantity").cast("long").alias("q"))
    return scan.size_batches(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "q"], "q", 400)


@query("""WITH o AS (SELECT *, row_number() OVER w AS n, l_returnflag = 'R' AS bad FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity)),
s AS (SELECT *, n - coalesce(max(CASE WHEN NOT bad THEN n END) OVER (PARTITION BY l_suppkey ORDER BY n), 0) AS streak FROM o),
r AS (SELECT *, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS tried FROM s)
SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, streak, tried FROM r""")
def removal_stops(t):
    """Copies of each source are removed in turn; three failures in a row end the work on it."""
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return scan.stop_after(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_quantity"], c("l_returnflag") == "R").drop("l_quantity")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 2500""")
def pending_limit(t):
    """The first pending rows, as many as a run may take."""
    return scan.first_n(t("orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderdate", "o_orderkey"], 2500).drop("o_orderdate")


# the other modules of queries register theirs as well
from gleaner.plans import changes, lookups, services  # noqa: E402, F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records are near-duplicates, which copy stays, and what the others free."""
    return QUERIES["dup_cluster_survivors"](spark, sf_dir)
