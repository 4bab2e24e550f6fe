"""DuckDB SQL with the results of the operators that SQL can express, over the whole tables."""

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, p, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
al AS (SELECT doc_id, p AS line_no, ls[p] AS line, len(regexp_extract_all(ls[p], '[^\x20\x09-\x0D]+')) AS n_words
       FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
l AS (
  SELECT doc_id, line_no, line, n_words, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq,
         sum(n_words) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto
  FROM al WHERE n_words > 0),
w AS (SELECT doc_id, list(line ORDER BY seq) AS lines FROM l GROUP BY doc_id),
r AS (
  SELECT x.doc_id, x.seq AS start, min(y.seq) - x.seq + 1 AS n
  FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.seq >= x.seq AND y.upto - x.upto + x.n_words >= 50 GROUP BY x.doc_id, x.seq
  UNION
  SELECT y.doc_id, max(x.seq) AS start, y.seq - max(x.seq) + 1 AS n
  FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.seq >= x.seq AND y.upto - x.upto + x.n_words >= 50 GROUP BY y.doc_id, y.seq),
t AS (SELECT doc_id, start, n, array_to_string(lines[start:start + n - 1], chr(10)) AS run FROM r JOIN w USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(start) OVER o AS fs
      FROM t WINDOW o AS (PARTITION BY n, run ORDER BY doc_id, start)),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS seq FROM f WHERE doc_id <> fd OR start >= fs + n),
gl AS (SELECT doc_id, line_no FROM g JOIN l USING (doc_id, seq)),
n AS (SELECT doc_id, count(*) AS n_removed FROM gl GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS rest FROM al ANTI JOIN gl USING (doc_id, line_no) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(rest, '') END AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + least(4, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * same >= 80 * (p.n + q.n - same)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

HOST_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wn AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
tw AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wn) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM tw) GROUP BY doc_id),
li AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM li GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(rw.n, 0) > 20 * len(w) AS base_failed
  FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
"""
_RULES = {
    "base": "base_failed", "few_words": "n_words < 10", "repeat_words": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > n_words",
    "dup_lines": "20 * n_dup_lines > n_words", "short_words": "word_chars < 2 * n_words",
}
for _r, _fails in _RULES.items():
    HOST_RULES += f"""
h_{_r} AS (SELECT source, count(*) AS n, count(*) FILTER ({_fails}) AS failed FROM c WHERE source IS NOT NULL GROUP BY source),
p_{_r} AS (SELECT count(*) AS hosts, sum(failed) / sum(n) AS mean, avg(1 / n) AS small, coalesce(var_samp(failed / n), 0) AS spread FROM h_{_r}),
s_{_r} AS (SELECT mean, CASE WHEN hosts < 2 THEN 2 WHEN spread - mean * (1 - mean) * small <= 0 THEN 1e6
  ELSE least(1e6, greatest(2, mean * (1 - mean) / (spread - mean * (1 - mean) * small) - 1)) END AS strength FROM p_{_r}),
v_{_r} AS (SELECT source, (failed + mean * strength) / (n + strength) <= 0.5 AS ok FROM h_{_r}, s_{_r}),"""
HOST_RULES += f"""
v AS (SELECT source, bool_and(ok) AS ok FROM ({" UNION ALL ".join(f"SELECT source, ok FROM v_{_r}" for _r in _RULES)}) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM c LEFT JOIN v USING (source)
"""

MERKLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, source, lang, n_chars, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
crc AS (
  SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, b, i + 1, list_reduce([c_in] || range(0, 8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
  FROM (SELECT *, xor(c, CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)) AS c_in FROM crc WHERE i < octet_length(b))),
bad AS (SELECT doc_id FROM crc WHERE i = octet_length(b) AND xor(c, 4294967295) % 5 = 0),
f AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM d),
l AS (
  SELECT tree, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS other,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, sha256(head || coalesce(strlen(text) || ':' || text, '-'))) - 1 AS pos FROM f),
low(tree, lvl, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM l
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM low) WHERE n > 1 GROUP BY tree, lvl, pos // 16),
tops AS (SELECT tree, h AS subroot FROM low QUALIFY row_number() OVER (PARTITION BY tree ORDER BY lvl DESC) = 1),
sub AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tops),
high(lvl, pos, h) AS (
  SELECT 0, pos, subroot FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, pos // 16),
root AS (SELECT h AS root FROM high ORDER BY lvl DESC LIMIT 1),
lowtop AS (SELECT tree, max(lvl) AS top FROM low GROUP BY tree),
hightop AS (SELECT max(lvl) AS top FROM high),
step AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS x,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS y
  FROM low a JOIN lowtop USING (tree) JOIN low b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.lvl < top GROUP BY ALL
  UNION ALL
  SELECT s.tree, t.top + a.lvl, -1, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM sub s JOIN lowtop t USING (tree) JOIN high a ON a.pos = s.pos // CAST(power(16, a.lvl) AS BIGINT) JOIN high b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16
  WHERE a.lvl < (SELECT top FROM hightop) GROUP BY s.tree, t.top, a.lvl),
path AS (
  SELECT tree, l.pos, list(x ORDER BY lvl) AS xs, list(y ORDER BY lvl) AS ys
  FROM l JOIN step USING (tree) WHERE step.pos = -1 OR step.pos = l.pos // CAST(power(16, lvl) AS BIGINT) GROUP BY tree, l.pos),
fold(tree, pos, i, h) AS (
  SELECT tree, pos, 0, CASE WHEN doc_id IN (SELECT doc_id FROM bad) THEN other ELSE leaf END FROM l
  UNION ALL
  SELECT tree, pos, i + 1, sha256(xs[i + 1] || h || ys[i + 1]) FROM fold JOIN path USING (tree, pos) WHERE i < len(xs))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(range(1, len(xs) + 1), lambda i: xs[i] || ys[i]), ''), '')) AS proof_sha256,
       fold.h AS folded_root, fold.h = root AS verified
FROM l JOIN sub USING (tree) CROSS JOIN root JOIN fold ON fold.tree = l.tree AND fold.pos = l.pos LEFT JOIN path ON path.tree = l.tree AND path.pos = l.pos
WHERE fold.i = coalesce(len(xs), 0)
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09\x0A-\x0D.,;:!?]+') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
x AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
      FROM (SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM c, range(2, 5) s(j) WHERE j < m)),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.phrase = c.phrase AND x.a >= c.a)),
s AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, m)) AS cut FROM k)),
v AS (SELECT s.lang, s.phrase, a, cut, h.f AS l, o.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(h.f AS HUGEINT) * o.f) AS score
      FROM s JOIN f h ON h.lang = s.lang AND h.phrase = s.head JOIN f o ON o.lang = s.lang AND o.phrase = s.rest JOIN t ON t.lang = s.lang),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM q WHERE rank <= 2000
"""

REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT id, s, md5(substr(x, 2 * s + 1, 800)) AS h FROM (SELECT id, x, unnest(range(0, len(x) // 2 - 399)) AS s FROM d WHERE len(x) >= 800)),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT id, s FROM w SEMI JOIN r USING (h)),
g AS (SELECT id, s, sum(CASE WHEN s - prev <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s) AS run
      FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY id ORDER BY s), -1000) AS prev FROM c)),
u AS (SELECT id, min(s) AS lo, max(s) + 400 AS hi FROM g GROUP BY id, run),
k AS (SELECT id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM u GROUP BY id),
e AS (SELECT d.id, doc_id, x, n_spans, n_removed, [0] || coalesce(his, []) AS f, coalesce(los, []) || [len(x) // 2] AS t FROM d LEFT JOIN k USING (id))
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(f) + 1), lambda i: substr(x, 2 * f[i] + 1, 2 * (t[i] - f[i]))), ''))) AS kept_sha256
FROM e
"""
