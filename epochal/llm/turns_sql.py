"""DuckDB SQL of the queries on conversations and exact duplicates."""

#: crc32 of an ASCII string, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"

DEDUP = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

TRIE = rf"""
    WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos FROM o),
    c AS (SELECT conv_id, n, {_CRC.format("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS donor FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
    m AS (SELECT c.*, least(c.h, coalesce(d.n, 0)) AS taken FROM c LEFT JOIN c d ON d.conv_id = c.donor),
    r AS (SELECT conv_id, pos - h + taken AS pos, role, text FROM t JOIN m USING (conv_id) WHERE pos > h UNION ALL SELECT m.conv_id, pos, role, text FROM m JOIN t ON t.conv_id = m.donor WHERE pos <= taken),
    s AS (SELECT m.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns FROM m LEFT JOIN r ON r.conv_id = m.conv_id GROUP BY m.conv_id),
    p AS (SELECT conv_id, len(turns) AS len, d, turns[1:d] AS prefix, turns[d].t AS last FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM s)),
    n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(coalesce(any_value(last), ''), '[^\x20\x09-\x0D]+')) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '') AS ends FROM p GROUP BY d, prefix),
    q AS (SELECT p.conv_id AS member, d, n.conv_id AS node FROM p JOIN n USING (d, prefix)),
    k AS (SELECT n.d, n.conv_id, n_convs, words, ends, q.node AS parent FROM n LEFT JOIN q ON q.member = n.conv_id AND q.d = n.d - 1),
    u AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM k WHERE d > 0 GROUP BY ALL),
    v AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN u USING (d, conv_id)),
    z AS (SELECT q.d, q.node AS conv_id, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved FROM v JOIN q ON q.member = v.conv_id AND q.d <= v.d GROUP BY ALL)
    SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM v JOIN z USING (d, conv_id)"""

_NEXT = "CASE WHEN {} = 'u' THEN 'a' ELSE 'u' END"
_NAME = "CASE WHEN {} = 'u' THEN 'user' ELSE 'assistant' END"
#: The states after 0, 1 or 2 insertions from x(s, cost, audit, told).
_INSERTED = rf"""
    SELECT conv_id, i, s, cost, audit, told FROM f
    UNION ALL SELECT conv_id, i, {_NEXT.format("s")}, cost + 3, audit || 'I', list_append(told, {_NAME.format(_NEXT.format("s"))} || ':') FROM f
    UNION ALL SELECT conv_id, i, {_NEXT.format(_NEXT.format("s"))}, cost + 6, audit || 'II', told || [{_NAME.format(_NEXT.format("s"))} || ':', {_NAME.format(_NEXT.format(_NEXT.format("s")))} || ':'] FROM f"""

REPAIR = rf"""
    WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
    w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
    x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE kind <> 0),
    y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last, left(role, 1) AS who FROM x),
    t AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(who) OVER (PARTITION BY conv_id ORDER BY i) || who AS pair FROM y),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
    f AS (
      SELECT conv_id, 0::BIGINT AS i, '' AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS told FROM ids
      UNION ALL
      SELECT conv_id, i, s, cost, audit, told FROM (
        SELECT conv_id, i, s, cost, audit, told, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS best FROM (
          SELECT g.conv_id, t.i, CASE e.e WHEN 'D' THEN g.s WHEN 'K' THEN t.who ELSE {_NEXT.format("g.s")} END AS s,
            g.cost + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.e <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END AS cost, g.audit || e.e AS audit,
            CASE e.e WHEN 'D' THEN g.told WHEN 'K' THEN list_append(g.told, t.role || ':' || t.text) ELSE list_append(g.told, {_NAME.format(_NEXT.format("g.s"))} || ':' || t.text) END AS told
          FROM ({_INSERTED}) g JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i + 1, (VALUES ('K'), ('R'), ('D')) e(e)
          WHERE e.e = 'D' OR t.fault NOT IN ('blank', 'duplicate') AND (e.e = 'R' OR t.who = {_NEXT.format("g.s")} OR g.s = '' AND t.who = 's')))
      WHERE best = 1),
    h AS (SELECT conv_id, cost, audit, told, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM (SELECT g.* FROM ({_INSERTED}) g LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id WHERE g.i = coalesce(c.n, 0) AND g.s IN ('', 'a')))
    SELECT h.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(array_to_string(told, chr(10))) AS repaired_sha256
    FROM h LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM h.conv_id WHERE best = 1"""
