"""Queries about changes to a tree of files: replayed logs, undo, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import replay
from gleaner.plans.base import c, query

# each user's events are a log of operations on twelve places of that user's
_LOG = """
WITH RECURSIVE o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
    CASE event_id % 7 WHEN 0 THEN 'copy' WHEN 1 THEN 'replace' WHEN 2 THEN 'remove' ELSE 'move' END AS op, CAST(event_id * 5 % 12 AS BIGINT) AS s, CAST((event_id // 12 + user_id) % 12 AS BIGINT) AS d FROM events),
l AS (SELECT user_id, 0 AS i, list_filter(range(12), lambda x: (user_id + x) % 2 = 0) AS there, CAST(NULL AS BIGINT) AS event_id, '' AS why FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, i, CASE WHEN why <> '' THEN there WHEN op = 'move' OR op = 'replace' THEN list_distinct(list_append(list_filter(there, lambda x: x <> s), d)) WHEN op = 'copy' THEN list_append(there, d) ELSE list_filter(there, lambda x: x <> s) END, event_id, why
FROM (SELECT o.user_id, o.i, l.there, o.event_id, op, s, d, CASE WHEN NOT list_contains(l.there, s) THEN 'source missing' WHEN (op IN ('move', 'copy') AND list_contains(l.there, d)) OR (op <> 'remove' AND s = d) THEN 'destination taken' ELSE '' END AS why
FROM l JOIN o ON o.user_id = l.user_id AND o.i = l.i + 1))
"""


def _place(user, place):
    return F.concat(user.cast("string"), F.lit("/"), place.cast("string"))


def _log(t) -> DataFrame:
    e = c("event_id")
    kind = F.when(e % 7 == 0, "copy").when(e % 7 == 1, "replace").when(e % 7 == 2, "remove").otherwise("move")
    ops = t("events").select(e.alias("seq"), kind.alias("op"), _place(c("user_id"), e * 5 % 12).alias("from"), _place(c("user_id"), (F.floor(e / 12) + c("user_id")) % 12).alias("to"))
    return ops.withColumn("to", F.when(c("op") != "remove", c("to")))


def _places(t) -> DataFrame:
    each = t("events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x"))
    return each.where((c("user_id") + c("x")) % 2 == 0).select(_place(c("user_id"), c("x")).alias("path"))


@query(_LOG + "SELECT event_id, why = '' AS done, why FROM l WHERE i > 0")
def plan_replay(t):
    """A log of dependent operations, each with its guards."""
    return replay.replay(_log(t), _places(t)).select(c("seq").alias("event_id"), "done", "why")


@query(_LOG + "SELECT user_id || '/' || unnest(there) AS path FROM l QUALIFY i = max(i) OVER (PARTITION BY user_id)")
def replay_listing(t):
    """What is there after the log."""
    return replay.listing_after(replay.replay(_log(t), _places(t)), _places(t))


_UNDO = _LOG.rstrip() + """,
e AS (SELECT l.user_id, l.i, l.event_id, o.s, o.d FROM l JOIN o USING (event_id) WHERE why = '' AND op = 'move'),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM e),
n AS (SELECT user_id, list_filter(there, lambda x: (user_id * 7 + x) % 5 <> 0) AS there FROM l QUALIFY i = max(i) OVER (PARTITION BY user_id)),
u AS (SELECT user_id, CAST(0 AS BIGINT) AS k, there, CAST(NULL AS BIGINT) AS event_id, '' AS why FROM n
UNION ALL SELECT user_id, k, CASE WHEN why <> '' THEN there ELSE list_append(list_filter(there, lambda x: x <> d), s) END, event_id, why
FROM (SELECT b.user_id, b.k, u.there, b.event_id, s, d, CASE WHEN NOT list_contains(u.there, d) THEN 'source missing' WHEN list_contains(u.there, s) THEN 'destination taken' ELSE '' END AS why FROM u JOIN b ON b.user_id = u.user_id AND b.k = u.k + 1))
SELECT event_id, why = '' AS done, why FROM u WHERE k > 0
"""


@query(_UNDO)
def undo_guarded(t):
    """The log's moves backwards, after some files have gone since."""
    log = replay.replay(_log(t), _places(t))
    there = replay.listing_after(log, _places(t)).withColumn("p", F.split("path", "/"))
    there = there.where((c("p")[0].cast("long") * 7 + c("p")[1].cast("long")) % 5 != 0).select("path")
    return replay.undo(log.where("done and op = 'move'"), there).select(c("seq").alias("event_id"), "done", "why")


_MERGE = """
WITH f AS (SELECT 'lib/' || p_brand || '/' || p_name || '.mp3' AS path, min(p_size) AS content, min(p_size) % 11 = 0 AS junk FROM part GROUP BY p_brand, p_name),
g AS (SELECT folder, first_value(folder) OVER w AS keep, row_number() OVER w AS rank FROM (SELECT DISTINCT 'lib/' || p_brand AS folder, left(p_brand, length(p_brand) - 1) AS k FROM part) WINDOW w AS (PARTITION BY k ORDER BY folder)),
m AS (SELECT g.folder, f.path, g.keep || substr(f.path, length(g.folder) + 1) AS dest, f.content, f.junk, g.rank FROM f JOIN g ON starts_with(f.path, g.folder || '/') AND g.folder <> g.keep),
h AS (SELECT m.*, f.path IS NOT NULL AS taken, f.content AS there, row_number() OVER (PARTITION BY dest, m.junk ORDER BY m.rank, m.path) AS n, first_value(m.content) OVER (PARTITION BY dest, m.junk ORDER BY m.rank, m.path) AS first FROM m LEFT JOIN f ON f.path = m.dest),
s AS (SELECT folder, path, dest, CASE WHEN junk THEN 'deleted' WHEN NOT taken AND n = 1 THEN 'moved' WHEN content = CASE WHEN taken THEN there ELSE first END THEN 'same' ELSE 'conflict' END AS status FROM h)
"""


def _merged(t) -> DataFrame:
    files = t("part").groupBy("p_brand", "p_name").agg(F.min("p_size").alias("content")).select(F.concat(F.lit("lib/"), "p_brand", F.lit("/"), "p_name", F.lit(".mp3")).alias("path"), "content", (c("content") % 11 == 0).alias("junk"))
    brands = t("part").select("p_brand").distinct().withColumn("k", F.expr("left(p_brand, length(p_brand) - 1)"))
    kept = brands.groupBy("k").agg(F.sort_array(F.collect_set("p_brand")).alias("all"))
    groups = kept.select(F.posexplode("all").alias("rank", "brand"), F.concat(F.lit("lib/"), c("all")[0]).alias("keep")).select(F.concat(F.lit("lib/"), "brand").alias("folder"), "keep", "rank")
    return replay.merge_folders(files, groups)


@query(_MERGE + 'SELECT folder, path AS "from", dest AS "to", status FROM s')
def folder_merge(t):
    """Files of folders that are spelled alike move into the first of them, and nothing is overwritten."""
    return _merged(t).drop("seq")


@query(_MERGE + """SELECT folder, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'same') AS same, count(*) FILTER (status = 'conflict') AS conflicts, count(*) FILTER (status = 'deleted') AS deleted,
count(*) FILTER (status = 'conflict') = 0 AS gone FROM s GROUP BY folder""")
def folder_merge_summary(t):
    return replay.emptied(_merged(t))
