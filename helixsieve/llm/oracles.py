"""SQL for DuckDB that gives the rows of those queries that SQL can express, by other means than the operators.

None for language ID (a learned model) and packing (a tokenizer): tests hold them against brute force.
"""

from __future__ import annotations

from functools import reduce

from helixsieve.llm.url_reputation import LOWER, RULES, UPPER

WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[]))"
LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""


def _rules() -> str:
    arms = []
    for verdict, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", -len(r[1]))):
        arms.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{verdict} {h}{p}'")
    return "CASE " + " ".join(arms) + " END"


def _strength(level: str, name: str) -> str:
    """The prior's strength of a level's table (n, b), and the overall rate."""
    return f"""{name} AS (SELECT CASE WHEN rho > 0 THEN greatest(1.0, least(1000.0, 1 / rho - 1)) WHEN rho <= 0 THEN 1000.0 ELSE 10.0 END AS k, (coalesce(b, 0) + 1) / (coalesce(n, 0) + 10) AS overall FROM (
SELECT *, CASE WHEN n > k AND b > 0 AND b < n THEN ((bb - n * m * m) / k - m * (1 - m)) / (m * (1 - m) * (n / k - 1)) END AS rho FROM (
SELECT *, b / n AS m FROM (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, sum(CAST(b * b AS DOUBLE) / n) AS bb FROM {level} WHERE n > 0) x) y) z)"""


OP3 = rf"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, {_rules()} AS fit FROM q),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL AND quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
a AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM f),
h AS (SELECT site, CASE WHEN ip THEN site ELSE regexp_extract(site, '([^.]*\.)?[^.]*$') END AS domain, CASE WHEN ip THEN site ELSE regexp_extract(site, '[^.]*$') END AS suffix, n, b FROM (
SELECT site, regexp_full_match(site, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}') AS ip, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM a LEFT JOIN o ON o.doc_id = a.page_id GROUP BY ALL) y),
d AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY ALL),
{_strength('s', 'k0')}, {_strength('d', 'k1')}, {_strength('h', 'k2')},
sr AS (SELECT suffix, (b + k * overall) / (n + k) AS rate FROM s, k0),
dr AS (SELECT domain, (b + k * rate) / (n + k) AS rate FROM d JOIN sr USING (suffix), k1),
hr AS (SELECT site, n, k, (b + k * rate) / (n + k) AS rate FROM h JOIN dr USING (domain), k2)
SELECT page_id, host, path, nullif(regexp_replace(fit, '^[a-z]* ', ''), '') AS rule,
coalesce(split_part(fit, ' ', 1), CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + k + 1)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM a JOIN hr ON hr.site = a.site
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


def _base32(hexed: str) -> str:
    """Base32 of 40 hexadecimal digits: four letters for each five of them."""
    value = f"CAST('0x' || substr({hexed}, 5 * i + 1, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({value} >> {s}) & 31) + 1 AS BIGINT), 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda i: {letters}), '')"


OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32('hex')} AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""

OP7 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own FROM documents),
g AS (SELECT own, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY own)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(own) AS text_sha256 FROM d JOIN g USING (own)
"""


def _crc32(data: str) -> str:
    """CRC-32 of hexadecimal digits, a byte a step; a byte's remainder is the exclusive or of its bits' remainders."""
    parts = []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        parts.append(f"((xor(c, b) >> {bit}) & 1) * {value}")
    step = f"xor(c >> 8, {reduce(lambda x, y: f'xor({x}, {y})', parts)})"
    bytes_ = f"list_transform(string_split(rtrim(regexp_replace({data}, '(..)', '\\1 ', 'g')), ' '), lambda x: CAST('0x' || x AS BIGINT))"
    return f"CASE WHEN {data} = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: {step}), 4294967295) END"


#: Boundary s is before the first row whose bytes, it included, reach s of 40 parts of all, or after it if that is nearer.
OP8 = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
r AS (SELECT *, row_number() OVER w - 1 AS n, sum(size) OVER w AS upto, sum(size) OVER () AS total FROM d WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT s, min_by(struct_pack(n := n, size := size, below := upto - size, total := total), n) AS c FROM r, range(1, 40) t(s) WHERE upto * 40 >= total * s GROUP BY s),
c AS (SELECT s, CASE WHEN 2 * c.total * s > (2 * c.below + c.size) * 40 THEN c.n + 1 ELSE c.n END AS first FROM f),
p AS (SELECT r.*, (SELECT count(*) FROM c WHERE c.first <= r.n) AS shard, coalesce((SELECT max(c.first) FROM c WHERE c.first <= r.n), 0) AS first FROM r)
SELECT doc_id, size, CAST({_crc32('x')} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(n - first AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""

#: The cut's time as num / den: at the last source's end that the budget outlasts, or 0, and on from there at the rate of the others.
OP9 = f"""
WITH s AS (SELECT doc_id, source, CAST(len({WORDS.format('text')}) AS HUGEINT) AS size, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS ticket FROM documents),
g AS (SELECT source, sum(size) AS own, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s GROUP BY source),
e AS (SELECT own, w FROM g WHERE own > 0 UNION ALL SELECT 0, 1),
v AS (SELECT e.own, e.w, sum(least(2 * g.own * e.w, g.w * 2 * e.own)) AS vw, sum(g.w) FILTER (g.own * e.w > e.own * g.w) AS r, sum(g.own) AS total FROM e, g GROUP BY ALL),
t AS (SELECT 4 * own * r + 3 * total * w - 2 * vw AS num, 2 * w * r AS den FROM v WHERE 2 * vw <= 3 * total * w ORDER BY own / w DESC LIMIT 1),
q AS (SELECT s.*, own, w, num, den, w * num // den AS quota, sum(size) OVER (PARTITION BY s.source ORDER BY ticket ROWS UNBOUNDED PRECEDING) - size AS before FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source, t)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(own AS BIGINT) AS source_size, least(CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE), CAST(2 * own AS DOUBLE)) AS target,
CAST(least(size, greatest(0, quota - before)) + least(size, greatest(0, quota - own - before)) AS BIGINT) AS taken FROM q
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d) y),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

ORACLES = {"op2_lsh_forest": OP2, "op3_url_reputation": OP3, "op4_ball_tree_topk": OP4, "op5_arc_to_warc": OP5, "op7_exact_dedup": OP7, "op8_histogram_sort": OP8, "op9_fair_queueing": OP9, "op10_suffix_trees": OP10}
