"""The queries that SQL can express, as DuckDB SQL over the whole tables."""

from __future__ import annotations

from gleaner.llm.line_rules import MENU, PHRASES

_SAID = "<|im_end|><|im_start|>assistant ok"

OP1 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_DIGITS = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"


def _draw(level: str, child: int, weight: float) -> str:
    digits = _DIGITS.format(f"'{level}:{child}:' || key", 13)
    return f"(-ln(({digits} + 0.5) / 4503599627370496) / {weight})"


def _least(level: str, children: dict[int, float]) -> str:
    """The child with the smallest draw, the smaller one on a tie."""
    out = ""
    items = sorted(children.items())
    for i, (c, w) in enumerate(items[:-1]):
        rest = " AND ".join(f"{_draw(level, c, w)} <= {_draw(level, d, v)}" for d, v in items[i + 1 :])
        out += f"WHEN {rest} THEN {c} "
    return f"CASE {out}ELSE {items[-1][0]} END" if len(items) > 1 else str(items[0][0])


OP2 = f"""
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, length(h) // 2 + 1 AS size, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bytes FROM d),
k AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, tab[1 + (xor(x, y) & 255)])), 4294967295) AS text_crc32, coalesce('k' || doc_id, 'null') AS key FROM b, t),
r AS (SELECT *, {_least("region", {0: 4.0, 1: 4.0})} AS region, {_least("region", {0: 4.0, 1: 4.0, 2: 1.0})} AS new_region FROM k),
q AS (SELECT *, CASE WHEN region = 0 THEN {_least("rack", {0: 2.0, 1: 2.0})} ELSE {_least("rack", {2: 2.0, 3: 2.0})} END AS rack FROM r),
s AS (SELECT *, CASE rack WHEN 0 THEN {_least("shard", {0: 1.0, 1: 1.0})} WHEN 1 THEN {_least("shard", {2: 1.0, 3: 1.0})} WHEN 2 THEN {_least("shard", {4: 1.0, 5: 1.0})} ELSE {_least("shard", {6: 1.0, 7: 1.0})} END AS shard FROM q),
u AS (SELECT *, {_DIGITS.format("concat_ws(':', 'bucket', key, size, text_crc32)", 8)} % 256 AS bucket FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(region AS INTEGER) AS region, CAST(rack AS INTEGER) AS rack, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(CASE WHEN new_region = 2 THEN 8 ELSE shard END AS INTEGER) AS grown_shard
FROM u
"""

_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_AZ.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[a:a + m - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS a FROM i WHERE len(w) > 0)),
x AS (SELECT r, a, m, array_to_string(w[a:a + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM d, (SELECT DISTINCT m FROM p))),
h AS (SELECT r, a, m, item_id FROM x JOIN p USING (m, win)),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(a, a + m)) AS spot FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_PHRASE = "|".join(p.decode().replace("'", "''") for p in PHRASES)
_MENUS = "|".join(sorted(m.decode() for m in MENU))

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {_WORDS}) AS w FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
n AS (SELECT r, count(DISTINCT spot) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS spot FROM k WHERE n >= 2) GROUP BY r),
l AS (SELECT r, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT r, string_split(text, chr(10)) AS x FROM d)),
m AS (SELECT *, regexp_extract_all(line, {_WORDS}) AS v FROM l),
o AS (SELECT *, len(v) AS words, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again, coalesce(list_sum(list_transform(v, lambda x: length(x))), 0) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) + coalesce(list_sum(list_transform(regexp_extract_all(line, '!+'), lambda x: length(x) - 1)), 0) AS noise,
    len(list_filter(range(2, len(v) + 1), lambda i: v[i] = v[i - 1])) AS stutter, len(list_filter(v, lambda x: x = '|' OR x = '>')) AS alone FROM m WHERE len(v) > 0),
b AS (SELECT *, noise >= 0.3 * words OR (words >= 20 AND NOT regexp_matches(line, '[.,;:!?]')) OR 5 * alone >= words OR stutter >= 0.3 * words OR again
    OR (words <= 25 AND (regexp_matches({_AZ.format("line")}, '{_PHRASE}') OR regexp_matches({_AZ.format("line")}, '^[ \t]*(?:{_MENUS})(?:[ \t]+(?:{_MENUS})){{0,2}}[ \t]*$'))) AS bad FROM o),
s AS (SELECT r, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines, CAST(coalesce(sum(chars) FILTER (bad), 0) AS BIGINT) AS lost_chars FROM b GROUP BY r),
f AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(lost_chars, 0) AS lost_chars FROM w LEFT JOIN n USING (r) LEFT JOIN s USING (r)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept FROM e
"""

_NEAREST = """a{n} AS (SELECT r, part, any_value(p.x) AS x, min(CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + e) AS m FROM p JOIN c{n} c USING (part) GROUP BY r, part),
"""
_MEANS = """s{n} AS (SELECT part, e, list(mean ORDER BY pos) AS x FROM (SELECT part, m % 256 AS e, pos, floor(sum(y) / count(*)) AS mean FROM (SELECT part, m, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{n}) GROUP BY ALL) GROUP BY part, e),
c{next} AS (SELECT part, c.e, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN s{n} s USING (part, e)),
"""

OP13 = (
    """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS (SELECT part, e, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e, q FROM v), (SELECT unnest(range(4)) AS part) WHERE e < 256),
"""
    + "".join(_NEAREST.format(n=n) + _MEANS.format(n=n, next=n + 1) for n in range(4))
    + _NEAREST.format(n=4)
    + """b AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM c4)),
f AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (r), b
"""
)

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN f USING (term), n),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, n),
s AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
