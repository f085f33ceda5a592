"""Queries that resolve names: existing folders, results known by either of two keys, nested catalog answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import catalog, health, resolve
from gleaner.plans.base import c, query
from gleaner.sources import tags


@query("""WITH w AS (SELECT DISTINCT p_brand, CASE p_partkey % 3 WHEN 0 THEN upper(p_type) WHEN 1 THEN p_type || '!' ELSE p_name END AS name FROM part),
f AS (SELECT p_brand, p_type AS folder, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY ALL UNION ALL SELECT p_brand, p_type || '.', count(*) FROM part WHERE p_size % 5 = 0 GROUP BY ALL),
m AS (SELECT w.*, folder, n, CASE WHEN lower(name) = lower(folder) THEN 0 ELSE 1 END AS tier FROM w JOIN f USING (p_brand) WHERE lower(name) = lower(folder)
    OR (length(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) >= 3 AND regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(folder), '[^a-z0-9]+', '', 'g'))),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY tier, n DESC, length(folder), folder) AS k FROM m)
SELECT p_brand, name, coalesce(folder, name) AS folder, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'identity' ELSE 'new' END AS tier FROM w LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (p_brand, name)""")
def existing_folders(t):
    """The folder that each wanted album already has, spelled alike or written another way."""
    wanted = t("part").select("p_brand", F.when(c("p_partkey") % 3 == 0, F.upper("p_type")).when(c("p_partkey") % 3 == 1, F.concat("p_type", F.lit("!"))).otherwise(c("p_name")).alias("name"))
    count = F.count(F.lit(1)).alias("n")
    plain = t("part").where("p_size % 2 = 0").groupBy("p_brand", c("p_type").alias("name")).agg(count)
    dotted = t("part").where("p_size % 5 = 0").groupBy("p_brand", F.concat("p_type", F.lit(".")).alias("name")).agg(count)
    tiers = {"exact": (F.lower("name"), 1), "identity": (F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""), 3)}
    return resolve.existing_folder(wanted, plain.unionByName(dotted), "p_brand", "name", "n", tiers)


@query("""WITH RECURSIVE n AS (SELECT 0 AS part, c_custkey AS pos, CAST(c_custkey // 3 AS VARCHAR) AS id, CASE WHEN c_custkey % 12 < 6 THEN CAST((c_custkey + 2) // 4 AS VARCHAR) END AS link FROM customer
    UNION ALL SELECT 1, s_suppkey, CAST(s_suppkey * 3 AS VARCHAR), NULL FROM supplier),
e AS (SELECT a.part, a.pos, b.part AS p2, b.pos AS q2 FROM n a JOIN n b ON a.id = b.id UNION SELECT a.part, a.pos, b.part, b.pos FROM n a JOIN n b ON a.link = b.link),
r AS (SELECT part, pos, part AS p2, pos AS q2 FROM n UNION SELECT r.part, r.pos, e.p2, e.q2 FROM r JOIN e ON e.part = r.p2 AND e.pos = r.q2),
m AS (SELECT part, pos, min(p2 * 1000000000 + q2) AS root, count(*) AS members FROM r GROUP BY part, pos)
SELECT CAST(part AS INTEGER) AS part, pos, members FROM m WHERE root = part * 1000000000 + pos""")
def either_key_union(t):
    """Results of two searches, without those that share an id or a link with an earlier one."""
    k = c("c_custkey")
    link = F.when(k % 12 < 6, F.floor((k + 2) / 4).cast("string"))
    first = t("customer").select(k.alias("pos"), F.floor(k / 3).cast("string").alias("id"), link.alias("link"))
    second = t("supplier").select(c("s_suppkey").alias("pos"), (c("s_suppkey") * 3).cast("string").alias("id"), F.lit(None).cast("string").alias("link"))
    return resolve.union_by_either([first, second], ["id", "link"]).select("part", "pos", "members")


def _answers(t):
    """A catalog's answer for each order, made of its lines: results, and sections with metadata."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    result = F.transform("lines", lambda x: F.struct(
        F.when(x["l_returnflag"] != "N", F.concat(F.lit(" "), x["l_returnflag"], x["l_linenumber"].cast("string"))).alias("trackName"),
        F.when(x["l_linestatus"] == "F", F.concat(F.lit("S"), x["l_suppkey"].cast("string"))).alias("artistName"),
        (x["l_quantity"].cast("long") * 1000 - 1000).alias("trackTimeMillis"), x["l_partkey"].alias("trackId")))
    section = F.transform("lines", lambda x: F.struct(F.array(
        F.struct(F.when(x["l_returnflag"] == "A", "Album").otherwise("Label").alias("title"), F.concat(F.lit("P"), x["l_partkey"].cast("string")).alias("text")),
        F.struct(F.lit("Released").alias("title"), F.concat(F.lit("in "), (x["l_partkey"] % 300 + 1850).cast("string")).alias("text"))).alias("metadata")))
    return lines.select("l_orderkey", F.to_json(F.struct(result.alias("results"), section.alias("sections"))).alias("body"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F')
SELECT l_orderkey, l_returnflag || l_linenumber AS title, 'S' || l_suppkey AS artist, CASE WHEN l_quantity <> 1 THEN CAST(l_quantity - 1 AS DOUBLE) END AS seconds, CAST(nullif(l_partkey, 0) AS VARCHAR) AS track_id FROM x WHERE k = 1""")
def catalog_tracks(t):
    """The first valid result of each answer."""
    return catalog.first_track(_answers(t), "l_orderkey", "body").select("l_orderkey", "title", "artist", "seconds", "track_id")


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_returnflag, l_partkey % 300 + 1850 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT l_orderkey, 'P' || arg_min(l_partkey, k) FILTER (l_returnflag = 'A') AS album, CAST(arg_min(y, k) FILTER (y BETWEEN 1900 AND 2099) AS VARCHAR) AS year FROM x GROUP BY l_orderkey""")
def catalog_sections(t):
    """Album and year from the metadata of an answer's sections."""
    return catalog.section_fields(_answers(t), "l_orderkey", "body")


def _number(n, bits: int = 8):
    """Four bytes, of eight or seven bits each."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, bits * k).bitwiseAND((1 << bits) - 1)), 2, "0") for k in (3, 2, 1, 0))))


def _frame(name: str, body):
    return F.concat(F.encode(F.lit(name), "utf-8"), _number(F.octet_length(body).cast("long")), F.unhex(F.lit("0000")), body)


@query("""SELECT doc_id, lang AS title, source AS artist, md5(text) AS words, doc_id % 3 = 0 AS has_art, doc_id % 7 = 0 AS damaged FROM documents""")
def container_tags(t):
    """Tags of files that are made of the documents: language, source and the whole text as frames; some have a picture, some end within it."""
    utf8 = F.unhex(F.lit("03"))
    picture = F.when(c("doc_id") % 3 == 0, _frame("APIC", F.encode(F.repeat(F.lit("x"), 200), "utf-8"))).otherwise(F.unhex(F.lit("")))
    cut = F.when(c("doc_id") % 7 == 0, F.concat(F.encode(F.lit("TCON"), "utf-8"), F.unhex(F.lit("0000FFFF0000")), utf8)).otherwise(F.unhex(F.lit("")))
    words = F.concat(utf8, F.encode(F.lit("eng"), "utf-8"), F.unhex(F.lit("00")), F.encode("text", "utf-8"))
    frames = F.concat(_frame("TIT2", F.concat(utf8, F.encode("lang", "utf-8"))), _frame("TPE1", F.concat(utf8, F.encode("source", "utf-8"))), _frame("USLT", words), picture, cut)
    raw = F.concat(F.encode(F.lit("ID3"), "utf-8"), F.unhex(F.lit("030000")), _number(F.octet_length(frames).cast("long"), 7), frames)
    read = t("documents").select("doc_id", raw.alias("raw")).select("doc_id", tags.parsed("raw").alias("p"))
    return read.select("doc_id", c("p.tags")["TIT2"][0].alias("title"), c("p.tags")["TPE1"][0].alias("artist"), F.md5(F.encode("p.lyrics", "utf-8")).alias("words"), "p.has_art", c("p.error").isNotNull().alias("damaged"))


@query("""WITH x AS (SELECT o_orderkey, [CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'not urgent' END, CASE WHEN o_orderkey % 10 = 0 THEN 'tenth' END] AS e FROM orders),
y AS (SELECT o_orderkey, list_filter(e, lambda r: r IS NOT NULL) AS e FROM x)
SELECT reason, count(*) AS n, min(o_orderkey) AS first_member FROM (SELECT o_orderkey, unnest(CASE WHEN len(e) = 0 THEN ['ok'] ELSE e END) AS reason FROM y) GROUP BY reason""")
def run_reasons(t):
    """How many rows a run found in order, and how many for each reason it had."""
    rules = {"small": c("o_totalprice") < 50000, "not urgent": c("o_orderpriority").startswith("5"), "tenth": c("o_orderkey") % 10 == 0}
    return health.reasons(health.checked(t("orders"), rules), "o_orderkey")
