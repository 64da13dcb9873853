"""DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MARKED = r"regexp_replace(coalesce({}, '{}'), '<\|(im_start|im_end)\|>', '< |\1|>', 'g')"

OP6 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u,
                  regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT u, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT dw.u, dw.i, dw.n, win.item FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
cov AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT u, i, n FROM hit) h, unnest(range(i, i + n)) x(p) GROUP BY u),
it AS (SELECT u, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN cov USING (u) LEFT JOIN it USING (u)"""

OP7 = rf"""
WITH v AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM conversations WHERE role <> 'system'),
r AS (SELECT conv_id, perspective, turn, role, text,
             CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM conversations m JOIN v ON m.conv_id IS NOT DISTINCT FROM v.c),
n AS (SELECT *, CASE WHEN chat_role = 'user' THEN regexp_replace({MARKED.format('role', 'unknown')}, '\s', '_', 'g') END AS name FROM r),
h AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS head FROM n),
t AS (SELECT *, head || {MARKED.format('text', '')} || '<|im_end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, row_number() OVER o AS position,
             coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
      FROM t WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST))
SELECT conv_id, perspective, position, turn, chat_role, name, rendered, char_start,
       CASE WHEN chat_role = 'assistant' THEN char_start + length(head) END AS mask_start,
       CASE WHEN chat_role = 'assistant' THEN char_start + length(rendered) - 1 END AS mask_end
FROM s"""

OP8 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS u, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT u, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) t(i)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
cov AS (SELECT DISTINCT u, p FROM (SELECT u, i FROM win WHERE g IN (SELECT g FROM rep)) h, unnest(range(i, i + 35)) x(p)),
one AS (SELECT u, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT one.u, string_agg(word, ' ' ORDER BY one.p) AS t, count(*) AS k
         FROM one LEFT JOIN cov ON one.u = cov.u AND one.p = cov.p WHERE cov.u IS NULL GROUP BY one.u)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (u)"""



def _moves() -> str:
    """Every way to go over one row: state, rows put in (cost, audit, text), edit, its cost, role initial needed, state after."""
    follows = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    out = []
    for q in range(4):
        at, cost, audit, text = q, 0, "", ""
        for _ in range(3):
            edits = [("D", 2, "", at, ""), ("R", 1, "", *follows[at]), *(("K", 0, i, to, "") for i, to in keeps[at].items())]
            out += [f"({q}, {cost}, '{audit}', '{text}', '{e}', {c}, '{i}', {to}, '{role}')" for e, c, i, to, role in edits]
            at, role = follows[at]
            cost, audit, text = cost + 5, audit + "I", text + f"~{role}:"
    return ", ".join(out)


#: CRC-32 of an ASCII string: the bits of each character come in one by one.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({}, ''),
    lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

OP11 = rf"""
WITH RECURSIVE src AS (
    SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
hurt AS (
    SELECT conv, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
           CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM src, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text[1:64], sha256(text)) AS i FROM hurt),
said AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS again,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM ord),
r AS (SELECT *, last = '' AS blank, last <> '' AND again > 1 AS dup, last <> '' AND again = 1 AND last NOT IN ('.', '!', '?') AS cut,
             role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY conv ORDER BY i) AS ini0 FROM said),
m(q, ic, ia, it, e, ec, need, q2, new_role) AS (VALUES {_moves()}),
st AS (
    SELECT DISTINCT conv, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS x FROM r
    UNION ALL
    SELECT r.conv, r.i, m.q2, min({{'c': st.x.c + m.ic + m.ec + CASE WHEN r.cut AND m.e <> 'D' THEN 5 ELSE 0 END, 'a': st.x.a || m.ia || m.e,
        't': st.x.t || replace(m.it, '~', chr(10)) || CASE m.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
              ELSE chr(10) || m.new_role || ':' || r.text END}})
    FROM st JOIN r ON r.conv IS NOT DISTINCT FROM st.conv AND r.i = st.i + 1
    JOIN m ON m.q = st.q AND (m.e = 'D' OR NOT (r.blank OR r.dup) AND (m.e = 'R' OR m.need = r.ini))
    GROUP BY r.conv, r.i, m.q2),
num AS (SELECT conv, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
               count(*) FILTER (ini0 IS NOT NULL AND ini0 || ini NOT IN ('su', 'ua', 'au')) AS illegal,
               coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv),
best AS (
    SELECT st.conv, min({{'c': x.c + fin.c, 'a': x.a || fin.a, 't': x.t || replace(fin.t, '~', chr(10))}}) AS x
    FROM st JOIN num ON num.conv IS NOT DISTINCT FROM st.conv AND num.n = st.i
    JOIN (VALUES (0, 0, '', ''), (1, 10, 'II', '~user:~assistant:'), (2, 5, 'I', '~assistant:'), (3, 0, '', '')) fin(q, c, a, t) ON fin.q = st.q
    GROUP BY st.conv)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.x.c, 0)::BIGINT AS cost,
       coalesce(best.x.a, '') AS audit, sha256(coalesce(best.x.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN num ON num.conv IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv IS NOT DISTINCT FROM ids.conv_id"""

OP13 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:13])::BIGINT / 4503599627370496 AS draw
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
level(k, words) AS (
    SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM s
    UNION ALL
    SELECT k + 1, (sum(source_size) - coalesce(sum(3 * source_size) FILTER (3 * source_size < weight * words), 0))::DOUBLE
                  / sum(weight) FILTER (NOT 3 * source_size < weight * words)
    FROM level, s WHERE k < 100 GROUP BY k, words),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < weight * words THEN (3 * source_size)::DOUBLE ELSE weight * words END AS target
      FROM s, level WHERE k = 100),
x AS (SELECT d.*, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM x"""

ORACLES = {"op6_decontamination": OP6, "op7_chat_rotation": OP7, "op8_substring_dedup": OP8,
           "op11_conversation_repair": OP11, "op13_source_mix": OP13}
