"""SQL twins of the operators that SQL can express: written from the definitions, not from the operators' methods."""

from __future__ import annotations

from gridloom.llm.sharding import PRIME, ROUNDS

NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS score
           FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

#: Every window of 50 bytes as hexadecimal text, its least document, and the gaps and islands of the windows that go.
REPEATS = """
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, i, substr(h, CAST(2 * i + 1 AS INTEGER), 100) AS s FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(k) AS k0 FROM w GROUP BY s HAVING min(k) < max(k)),
f AS (SELECT w.r, w.i FROM w JOIN m USING (s) WHERE w.k > m.k0),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM g) GROUP BY r, n),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
c AS (SELECT p.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS head FROM p JOIN d USING (r) GROUP BY p.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.r IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS INTEGER)) END)) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

#: The table of the CRC-32 of each byte, by its rule.
_CRC_TABLE = """t0 AS (SELECT i, list_reduce([CAST(i AS UBIGINT)] || [CAST(x AS UBIGINT) FOR x IN range(0, 8)], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS i)),
tabs AS (SELECT list(v ORDER BY i) AS tab FROM t0)"""


def _byte(hex_: str, i: str) -> str:
    return f"16 * (instr('0123456789ABCDEF', {hex_}[2 * {i} + 1]) - 1) + instr('0123456789ABCDEF', {hex_}[2 * {i} + 2]) - 1"


def _crc32(hex_: str) -> str:
    """CRC-32 of the bytes that a hexadecimal text spells; tab is the table."""
    steps = f"list_transform(range(0, length({hex_}) // 2), lambda i: CAST({_byte(hex_, 'i')} AS UBIGINT))"
    return f"CAST(xor(list_reduce([CAST(4294967295 AS UBIGINT)] || {steps}, lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT)"


MEDIA = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, coalesce(text, '') || repeat(' ', greatest(192, CAST(ceil(strlen(coalesce(text, '')) / 192.0) AS BIGINT) * 192) - strlen(coalesce(text, ''))) AS p FROM documents),
u AS (SELECT DISTINCT p, hex(encode(p)) AS h FROM d),
b AS (SELECT p, length(h) // 2 AS m, i, {_byte("h", "i")} AS v FROM (SELECT p, h, unnest(range(0, length(h) // 2)) AS i FROM u)),
k AS (SELECT p, v, count(*) AS c, any_value(m) AS m FROM b GROUP BY p, v),
f AS (SELECT p, any_value(m) AS m, sum(v * c) / any_value(m) AS mean, sum(v * v * c) / any_value(m) AS sq, -sum(c / m * log2(c / m)) AS ent FROM k GROUP BY p),
s AS (SELECT p, sum(abs(v - w)) / (any_value(m) // 192 * 191) AS step FROM (SELECT p, m, i, v, lag(v) OVER (PARTITION BY p ORDER BY i) AS w FROM b) WHERE i % 192 <> 0 GROUP BY p),
r AS (SELECT p, f.m, printf('mean=%.6f;var=%.6f;entropy=%.6f;step=%.6f;rows=%d', mean, sq - mean * mean, ent, step, f.m // 192) AS feature FROM f JOIN s USING (p)),
x AS (SELECT p, feature, m, sha256(p) AS ps, sha256('P5' || chr(10) || '192 ' || (m // 192) || chr(10) || '255' || chr(10) || p) AS ms, length('P5 192 ' || (m // 192) || ' 255 ') + m AS mb, {_crc32("right(hex(encode(p)), 32)")} AS tail FROM r, tabs)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, ps AS payload_sha256, tail AS tail_crc32, mb AS media_bytes, ms AS media_sha256, feature FROM d JOIN x USING (p)
"""


def _mix(value: str, key: tuple[int, int, int], seed: int) -> str:
    a, b, c = key
    x = f"(({value}) * {a} + {b + seed}) % {PRIME}"
    return f"(((({x}) * ({x})) % {PRIME}) * {c} + {x}) % {PRIME}"


def _permuted(source: str, seed: int) -> str:
    """One pass of the network over the places pos of a relation with i, side, width and n."""
    q = f"SELECT i, side, width, n, pos // width AS l, pos % width AS r FROM {source}"
    for k, key in enumerate(ROUNDS):
        step = f"(l + {_mix('r', key, seed)}) % side AS l, r" if k % 2 == 0 else f"l, (r + {_mix('l', key, seed)}) % width AS r"
        q = f"SELECT i, side, width, n, {step} FROM ({q})"
    return f"SELECT i, side, width, n, l * width + r AS pos FROM ({q})"


def sharding_sql(shards: int = 24, seed: int = 7) -> str:
    return f"""
WITH RECURSIVE {_CRC_TABLE},
e AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc32("h")} AS text_crc32 FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), tabs),
g AS (SELECT n, CAST(greatest(1, floor(sqrt(n))) AS BIGINT) AS side, CAST(ceil(n / greatest(1, floor(sqrt(n)))) AS BIGINT) AS width FROM (SELECT count(*) AS n FROM documents)),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS i FROM e),
walk AS ({_permuted("(SELECT i, i AS pos, side, width, n FROM o, g)", seed)} UNION ALL {_permuted("(SELECT * FROM walk WHERE pos >= n)", seed)})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos % {shards} AS INTEGER) AS shard, pos // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o JOIN walk USING (i) WHERE walk.pos < walk.n
"""


ORACLE_SQL = {"op1_suffix_dedup": REPEATS, "op2_media_chunks": MEDIA, "op7_nearest_neighbours": NEAREST, "op10_sharding": sharding_sql()}
