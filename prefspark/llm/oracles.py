"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

# crc32 of a word: one step a byte, through the table of the 256 remainders of the polynomial
_CRC = """
table256 AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
"""

OP13_SQL = f"""
WITH {_CRC}
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest(words) AS w FROM b),
distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hashed AS (SELECT w, xor(4294967295, list_reduce(
               list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(w))),
                   lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT)),
               lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket
           FROM distinct_words, table256),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw)::DOUBLE + 10000 AS big_s, (SELECT count(*) FROM bw)::DOUBLE + 10000 AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * big_s
                                        / ((s::DOUBLE + 1) * big_t)))::BIGINT AS gain
         FROM s LEFT JOIN t USING (bucket), total),
per_doc AS (SELECT r, count(*) AS n, sum(gain)::DOUBLE AS g FROM dw JOIN hashed USING (w) JOIN gain USING (bucket)
            GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
                  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                        + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
           FROM d LEFT JOIN per_doc USING (r)),
placed AS (SELECT doc_id, n_features, weight, weight + noise AS score, n_features >= 20 AS long_enough,
                  row_number() OVER (PARTITION BY n_features >= 20
                                     ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features) AS place,
                  count(*) FILTER (n_features >= 20) OVER () AS big_n FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN long_enough AND place <= floor(10 * big_n / 100) THEN place END AS rank FROM placed
"""


def _op11_sql(rounds: int = 4, entries: int = 256) -> str:
    """Plain k-means, round by round: all distances, the nearest entry, floored means."""
    ctes = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label,
                          list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x
                   FROM v, range(4) AS parts(part)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN first USING (r) WHERE entry < {entries})"""]
    for k in range(rounds + 1):
        ctes.append(f"""
a{k} AS MATERIALIZED (SELECT r, part, min({{'d': d, 'e': entry}}) AS best FROM (
    SELECT r, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p JOIN c{k} ON p.part = c{k}.part) GROUP BY r, part)""")
        if k < rounds:
            ctes.append(f"""
m{k} AS (SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, floor(sum(val) / count(*)::DOUBLE)::BIGINT AS mean FROM (
        SELECT p.part, best.e AS entry, unnest(x) AS val, generate_subscripts(x, 1) AS pos FROM p JOIN a{k} USING (r, part))
    GROUP BY part, entry, pos) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))""")
    ctes.append(f"""
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT r, string_agg(lower(lpad(to_hex(best.e), 2, '0')), '' ORDER BY part) AS code,
                 sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
summed AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN coded USING (r) GROUP BY label)""")
    return "WITH " + ",".join(ctes) + """
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM v JOIN coded USING (r) JOIN summed ON v.label IS NOT DISTINCT FROM summed.label, digest
"""


OP11_SQL = _op11_sql()
