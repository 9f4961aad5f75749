"""DuckDB texts for the operators that SQL can express, written from their definitions."""

# The prefix sums, the offset and the water level of the mix, source by source.
OP4 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight
  FROM s),
t AS (
  SELECT a.*,
    (SELECT CAST(3 * sum(b.source_size) AS BIGINT) FROM w b) AS three_halves_twice,
    (SELECT CAST(coalesce(sum(4 * b.source_size), 0) AS BIGINT) FROM w b
     WHERE b.source_size * a.weight < a.source_size * b.weight) AS capped_twice,
    (SELECT CAST(sum(b.weight) AS BIGINT) FROM w b
     WHERE b.source_size * a.weight >= a.source_size * b.weight) AS weight_left
  FROM w a),
level AS (
  SELECT three_halves_twice - capped_twice AS left_twice, weight_left FROM t
  WHERE 4 * source_size * weight_left >= weight * (three_halves_twice - capped_twice)
  ORDER BY source_size / weight LIMIT 1),
target AS (
  SELECT w.source, w.source_size,
    CASE WHEN 4 * w.source_size * l.weight_left >= w.weight * l.left_twice
         THEN CAST(w.weight * l.left_twice AS DOUBLE) / CAST(2 * l.weight_left AS DOUBLE)
         ELSE CAST(2 * w.source_size AS DOUBLE) END AS target,
    CAST(('0x' || substr(md5('42:' || coalesce('=' || w.source, '')), 1, 8)) AS BIGINT) % 1024 / 1024.0::DOUBLE AS u
  FROM w, level l),
r AS (
  SELECT d.doc_id, d.size, g.source, g.source_size, g.target, g.u,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS step,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k
  FROM d JOIN target g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(floor(u + (k + 1) * step) - floor(u + k * step) AS BIGINT) AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""

# Every 400-byte string by its hash; the places that repeat make the spans, the rest is kept.
OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, encode(coalesce(text, '')) AS body FROM documents),
s AS (
  SELECT row_no, p, md5_number(array_slice(body, p, p + 399)) AS h
  FROM (SELECT row_no, body, unnest(range(1, octet_length(body) - 398)) AS p FROM d)),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (
  SELECT row_no, p, CASE WHEN p <= 400 + lag(p) OVER (PARTITION BY row_no ORDER BY p) THEN 0 ELSE 1 END AS new
  FROM s WHERE h IN (FROM twice)),
span AS (
  SELECT row_no, min(p) AS a, max(p) + 400 AS b
  FROM (SELECT *, sum(new) OVER (PARTITION BY row_no ORDER BY p) AS k FROM g) GROUP BY row_no, k),
cut AS (
  SELECT d.row_no, coalesce(lag(b) OVER w, 1) AS a, x.a AS b
  FROM d JOIN (FROM span UNION ALL SELECT row_no, octet_length(body) + 1, octet_length(body) + 1 FROM d) x
    USING (row_no)
  WINDOW w AS (PARTITION BY d.row_no ORDER BY x.a, x.b DESC)),
kept AS (
  SELECT row_no, string_agg(hex(array_slice(body, a, b - 1)), '' ORDER BY a) FILTER (WHERE b > a) AS bytes
  FROM cut JOIN d USING (row_no) GROUP BY row_no),
lost AS (SELECT row_no, sum(b - a) AS n, count(*) AS spans FROM span GROUP BY row_no)
SELECT doc_id, octet_length(body) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(bytes, ''))) AS kept_sha256
FROM d JOIN kept USING (row_no) LEFT JOIN lost USING (row_no)
"""

# Lines that are not blank; of five words or more also all variants with one word deleted, as word lists.
OP5 = r"""
WITH l AS (
  SELECT doc_id, line, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
k AS (SELECT doc_id, line, array_to_string(w, ' ') AS t, w FROM l WHERE len(w) > 0),
f AS (SELECT t, any_value(w) AS w, min((doc_id, line)) AS first FROM k GROUP BY t),
v AS (
  SELECT t, first, len(w) AS n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS cut
  FROM (SELECT t, first, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 5)),
same AS (SELECT n, i, cut, min(first) AS low FROM v GROUP BY n, i, cut HAVING count(*) > 1),
near AS (
  SELECT v.t FROM v JOIN same USING (n, i, cut) WHERE low < first
  UNION SELECT v.t FROM v JOIN f ON v.cut = f.t WHERE f.first < v.first AND len(f.w) >= 5
  UNION SELECT f.t FROM v JOIN f ON v.cut = f.t WHERE v.first < f.first AND len(f.w) >= 5),
gone AS (
  SELECT DISTINCT k.doc_id, k.line FROM k JOIN f USING (t)
  WHERE (k.doc_id, k.line) <> f.first OR t IN (SELECT t FROM near)),
o AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (WHERE g.doc_id IS NULL) AS kept,
    count(*) AS n_lines, count(g.doc_id) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN o.n_removed = 0 THEN d.text ELSE coalesce(o.kept, '') END AS text,
  o.n_lines, o.n_removed
FROM documents d JOIN o USING (doc_id)
"""

# All products of integer vectors, ranked.
OP9 = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row_no <> q.row_no AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Unsigned crc32 of an ASCII text, bit by bit.
def _crc32(text: str) -> str:
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(range(8), lambda x, i: {bit}, xor(a, b))"
    chars = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: CAST(ord(c) AS BIGINT))"
    return f"xor(list_reduce({chars}, lambda a, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

# Levels by a recursive climb, per language and then over the subroots; a second recursion carries every
# leaf, and its tampered one, up to the root.
OP12 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf,
    sha256({_LEAF} || CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0
      THEN {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {_field("text")} END) AS altered FROM documents),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS size FROM d),
n AS (
  SELECT 0 AS lvl, lang, pos, size, leaf AS h FROM l
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM n WHERE size > 1 GROUP BY lvl, lang, pos // 8),
s AS (
  SELECT lang, lvl AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
  FROM n WHERE size = 1),
m AS (
  SELECT 0 AS lvl, pos, size, subroot AS h FROM s
  UNION ALL
  SELECT lvl + 1, pos // 8, (any_value(size) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos))
  FROM m WHERE size > 1 GROUP BY lvl, pos // 8),
run AS (
  SELECT lvl, lang, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM n WHERE size > 1 GROUP BY lvl, lang, pos // 8
  UNION ALL
  SELECT s.height + x.lvl, s.lang, x.up, x.hs
  FROM s, (SELECT lvl, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM m WHERE size > 1 GROUP BY lvl, pos // 8) x
  WHERE s.pos // CAST(power(8, x.lvl + 1) AS BIGINT) = x.up),
w AS (
  SELECT l.doc_id, l.lang, l.pos AS no, l.leaf, l.altered AS h, '' AS proof, 0 AS lvl, l.pos AS pos, s.height, s.pos AS top
  FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, w.lang, no, leaf,
    sha256(array_to_string(hs[1:p % 8], '') || h || array_to_string(hs[p % 8 + 2:], '')),
    proof || array_to_string(hs[1:p % 8], '') || array_to_string(hs[p % 8 + 2:], ''),
    w.lvl + 1, p // 8, height, top
  FROM (SELECT *, CASE WHEN lvl = height THEN top ELSE pos END AS p FROM w) w
  JOIN run ON run.lvl = w.lvl AND run.lang IS NOT DISTINCT FROM w.lang AND run.up = w.p // 8),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY lang, no ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang, (SELECT h AS root FROM m WHERE size = 1)
"""

# Faults by windows; costs to the end by a recursion backwards over the turns, the audit by one forwards,
# a letter a step. States: 0 nothing yet, 1 system, 2 user, 3 assistant.
OP11 = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, role, text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations),
e AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE fault <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(
      coalesce(CAST(conv_id AS VARCHAR), '-') || ':' || {_field("role")} || ':' || coalesce(text, ''))) - 1 AS pos
  FROM e),
q AS (
  SELECT *, NOT regexp_matches(coalesce(text, ''), '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, coalesce(text, '') ORDER BY pos) > 1 AS again,
    NOT regexp_matches(coalesce(text, ''), '[.!?][ 	-
]*\z') AS open,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind,
    lag(coalesce(left(role, 1), '')) OVER (PARTITION BY conv_id ORDER BY pos) || coalesce(left(role, 1), '') AS pair
  FROM o),
r AS (
  SELECT conv_id, pos, role, text, kind, blank OR again AS gone,
    CASE WHEN open AND NOT blank AND NOT again THEN 5 ELSE 0 END AS cut FROM q),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM q GROUP BY conv_id),
b AS (
  SELECT conv_id, n AS pos, CAST([0, 10, 5, 0] AS BIGINT[]) AS c FROM n
  UNION ALL
  SELECT conv_id, pos, [least(x0, 5 + yu), least(x1, 5 + yu), yu, least(x3, 5 + yu)]
  FROM (
    SELECT *, least(x2, 5 + least(x3, 5 + x2)) AS yu
    FROM (
      SELECT r.conv_id, r.pos,
        least(2 + c[1], u, CASE WHEN kind = 1 AND NOT gone THEN cut + c[2] END) AS x0,
        least(2 + c[2], u) AS x1, least(2 + c[4], u) AS x3,
        least(2 + c[3], CASE WHEN NOT gone THEN cut + (kind <> 3)::BIGINT + c[4] END) AS x2
      FROM (SELECT r.*, b.c, CASE WHEN NOT gone THEN cut + (kind <> 2)::BIGINT + c[3] END AS u
            FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1) r))),
t AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS q, '' AS audit, '' AS fixed, false AS done FROM n
  UNION ALL
  SELECT conv_id, CASE WHEN x IN ('D', 'K', 'R') THEN pos + 1 ELSE pos END, CASE WHEN x IN ('', 'D') THEN q ELSE z END,
    audit || x,
    CASE WHEN x IN ('', 'D') THEN fixed ELSE CASE WHEN fixed = '' THEN '' ELSE fixed || chr(10) END
      || CASE WHEN x = 'K' THEN role WHEN z = 3 THEN 'assistant' ELSE 'user' END || ':'
      || CASE WHEN x = 'I' THEN '' ELSE text END END,
    x = ''
  FROM (
    SELECT *, CASE WHEN x = 'K' THEN CASE WHEN kind = 1 THEN 1 ELSE s END ELSE s END AS z
    FROM (
      SELECT t.conv_id, t.pos, t.q, t.audit, t.fixed, r.role, r.text, r.kind, s,
        CASE WHEN 2 + a.c[q + 1] = own THEN 'D'
          WHEN 5 + b.c[s + 1] = own THEN 'I'
          WHEN r.pos IS NULL THEN ''
          WHEN kind = 1 AND q = 0 AND cut + a.c[2] = own THEN 'K'
          WHEN kind = s AND cut + a.c[s + 1] = own THEN 'K'
          ELSE 'R' END AS x
      FROM (SELECT t.*, b.c[q + 1] AS own, CASE WHEN q = 2 THEN 3 ELSE 2 END AS s, b.c
            FROM t JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.pos = t.pos WHERE NOT done) t
      JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.pos = t.pos
      LEFT JOIN b a ON a.conv_id IS NOT DISTINCT FROM t.conv_id AND a.pos = t.pos + 1
      LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.pos)))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c[1], 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(fixed, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.pos = 0
LEFT JOIN (SELECT * FROM t WHERE done) t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""

ORACLE = {"op2_suffix_dedup": OP2, "op9_topk": OP9, "op4_source_mixing": OP4, "op5_line_dedup": OP5,
          "op11_conversation_repair": OP11, "op12_merkle_manifest": OP12}
