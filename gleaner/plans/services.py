"""Queries about services that may fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans.base import c, query
from gleaner.streaming import backends

# what each of three services says to an event, by its number; a run is a user, half an event a second
_SAYS = "CASE (event_id * {a} + {b}) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' WHEN 3 THEN 'same' WHEN 4 THEN 'unable' ELSE CASE WHEN event_id % 97 = {b} THEN 'fatal' ELSE 'fail' END END"
_SERVICES = {"g": (5, 1), "m": (3, 2), "d": (11, 0)}


def _next(n: int) -> str:
    began = f"CASE WHEN u{n} IS NULL THEN k{n} ELSE 2 END"
    return f"""CASE WHEN NOT a{n} THEN k{n} WHEN o{n} = 'ok' THEN 0 WHEN o{n} IN ('fail', 'fatal') THEN {began} + 1 ELSE {began} END,
CASE WHEN NOT a{n} THEN u{n} WHEN o{n} = 'fatal' THEN CAST(4611686018427387904 AS BIGINT) WHEN o{n} = 'fail' AND {began} + 1 >= 3 THEN ms + 180000 END"""


def _live(n: int) -> str:
    return f"(u{n} IS NULL OR u{n} <= o.ms)"


def _asked(n: int) -> str:
    return " AND ".join([_live(n), *(f"NOT ({_live(k)} AND o.o{k} = 'ok')" for k in range(n))]) + f" AS a{n}"


_FAILOVER = f"""
WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CAST(event_id * 9000 AS BIGINT) AS ms,
    {", ".join(f"{_SAYS.format(a=a, b=b)} AS o{n}" for n, (a, b) in enumerate(_SERVICES.values()))} FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0 AS k0, CAST(NULL AS BIGINT) AS u0, 0 AS k1, CAST(NULL AS BIGINT) AS u1, 0 AS k2, CAST(NULL AS BIGINT) AS u2,
    FALSE AS a0, FALSE AS a1, FALSE AS a2, '' AS o0, '' AS o1, '' AS o2 FROM events
UNION ALL SELECT user_id, i, event_id, {", ".join(_next(n) for n in range(3))}, a0, a1, a2, o0, o1, o2
FROM (SELECT o.user_id, o.i, o.event_id, o.ms, k0, u0, k1, u1, k2, u2, o.o0, o.o1, o.o2, {", ".join(_asked(n) for n in range(3))}
    FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT user_id, event_id, CASE WHEN a0 AND o0 = 'ok' THEN 'g' WHEN a1 AND o1 = 'ok' THEN 'm' WHEN a2 AND o2 = 'ok' THEN 'd' END AS served,
    CASE WHEN (a0 AND o0 = 'ok') OR (a1 AND o1 = 'ok') OR (a2 AND o2 = 'ok') THEN 'ok' WHEN NOT a0 AND NOT a1 AND NOT a2 THEN 'none'
    WHEN (NOT a0 OR o0 = 'same') AND (NOT a1 OR o1 = 'same') AND (NOT a2 OR o2 = 'same') THEN 'untranslatable' ELSE 'error' END AS status,
    concat_ws(',', CASE WHEN a0 THEN 'g' END, CASE WHEN a1 THEN 'm' END, CASE WHEN a2 THEN 'd' END) AS asked
FROM r WHERE i > 0
"""


@query(_FAILOVER)
def service_failover(t):
    """Requests of each user offered to three services in order, with strikes and cooldowns."""
    tried = F.array(*(F.struct(F.lit(name).alias("name"), F.expr(_SAYS.format(a=a, b=b)).alias("outcome")) for name, (a, b) in _SERVICES.items()))
    rows = t("events").select("user_id", c("event_id").alias("id"), (c("event_id") * 9000).alias("at"), c("event_id").cast("string").alias("text"), tried.alias("tried"))
    got = backends.batch_requests(rows, "user_id")
    return got.select("user_id", c("id").alias("event_id"), "served", "status", F.concat_ws(",", "asked").alias("asked"))
