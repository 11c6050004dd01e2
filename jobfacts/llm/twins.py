"""SQL twins of the mixture, the clustering and the prefix trie."""

from __future__ import annotations

MIXING = r"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
        FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [3.0::DOUBLE, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
    t AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget FROM s),
    r(price) AS (SELECT 0::DOUBLE UNION
        SELECT (any_value(budget) - sum(CASE WHEN price * w > 2 * source_size THEN 2 * source_size::DOUBLE ELSE 0 END))
            / sum(CASE WHEN price * w > 2 * source_size THEN 0 ELSE w END) FROM r, s, t GROUP BY price),
    g AS (SELECT source, source_size, least(2 * source_size::DOUBLE, (SELECT max(price) FROM r) * w) AS target,
        ('0x' || md5('0:' || coalesce(source, ''))[1:10])::BIGINT AS random FROM s),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1099511627776)::BIGINT ELSE 0 END AS e FROM g),
    p AS (SELECT doc_id, size, source_size, target, e, (random + coalesce(sum(e) OVER (PARTITION BY d.source
            ORDER BY size, md5('0:' || coalesce(doc_id::VARCHAR, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            0)) % 1099511627776 AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies
    FROM (SELECT *, ((before + e) // 1099511627776)::BIGINT AS copies FROM p)"""

_ASSIGNED = """
    a{i} AS MATERIALIZED (SELECT k, min([list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j])))::BIGINT, c])
        AS best FROM v, c{i} GROUP BY k)"""

_MOVED = """
    c{n} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM c{i} LEFT JOIN (
        SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS moved FROM (
            SELECT best[2] AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (k), range(1, 65) AS u(j) GROUP BY ALL)
        GROUP BY c) USING (c))"""


def centroids(rounds: int) -> str:
    """Assignments and moved centroids in turn, each a step of its own."""
    steps = "".join(_ASSIGNED.format(i=i) + "," + _MOVED.format(i=i, n=i + 1) + "," for i in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id,
        list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (
        SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h, v LIMIT 8)),{steps}{_ASSIGNED.format(i=rounds)},
    f AS (SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance FROM a{rounds} JOIN v USING (k))
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
        (sum(distance) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(list_transform(m, lambda x: x::VARCHAR), ',')) AS centroid_sha256
    FROM f JOIN c{rounds} ON cluster = c"""


PREFIX_TRIE = """
    WITH tab AS (SELECT list_transform(range(256), lambda i:
        list_reduce(list_concat([i], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, u) AS i, u, n
        FROM (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS u, length(text) AS n
            FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations))
        WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295],
            list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM t), tab),
    r AS (SELECT c.conv_id, 0 AS part, i, u, n FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
        UNION ALL SELECT conv_id, 1, i, u, n FROM c JOIN t USING (conv_id) WHERE i > h),
    p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, u, n FROM r),
    q AS MATERIALIZED (SELECT conv_id, d, n, md5(string_agg(u, '') OVER (PARTITION BY conv_id ORDER BY d)) AS name FROM p
        UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    g AS MATERIALIZED (SELECT name, any_value(d) AS d, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs
        FROM q GROUP BY name),
    o AS MATERIALIZED (SELECT g.*, q.name AS parent FROM g LEFT JOIN q ON q.conv_id = g.conv_id AND q.d = g.d - 1),
    k AS (SELECT parent AS name, count(*) AS n_children FROM o WHERE parent IS NOT NULL GROUP BY ALL),
    s AS (SELECT q.name, sum((n_convs - 1) * g.n)::BIGINT AS saved_tokens, count(*) FILTER (k.name IS NULL) AS n_leaves
        FROM g LEFT JOIN k USING (name) JOIN q ON q.conv_id = g.conv_id AND q.d <= g.d GROUP BY q.name),
    e AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, arg_max(name, d) AS name FROM q GROUP BY conv_id) GROUP BY name)
    SELECT o.conv_id, o.d::BIGINT AS depth, f.conv_id AS parent_conv_id, o.n_convs, coalesce(n_children, 0) AS n_children,
        n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM o JOIN s USING (name) LEFT JOIN k USING (name) LEFT JOIN e USING (name) LEFT JOIN g AS f ON f.name = o.parent"""
