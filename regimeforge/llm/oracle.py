"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from . import line_dedup

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_AHEAD = ", ".join(f"lead(line, {j}) OVER o AS l{j}, lead(k_words, {j}) OVER o AS w{j}" for j in range(line_dedup.RUN))


def _windows(n: int) -> str:
    """Every window of n lines, if n is the whole run or the window holds enough words."""
    words = " + ".join(f"w{j}" for j in range(n))
    enough = "" if n == line_dedup.RUN else f" AND {words} >= {line_dedup.WORDS}"
    return f"SELECT doc_id, k, {n} AS n, [{', '.join(f'l{j}' for j in range(n))}] AS g FROM w WHERE l{n - 1} IS NOT NULL{enough}"


OP5 = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM d WHERE text IS NOT NULL),
f AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k_words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l
      WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')),
w AS (SELECT doc_id, k, {_AHEAD} FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
g AS ({" UNION ALL ".join(_windows(n) for n in range(1, line_dedup.RUN + 1))}),
r AS (SELECT doc_id, k, n, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS place FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM r WHERE place > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l
         LEFT JOIN f ON f.doc_id = l.doc_id AND f.i = l.i LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k
         WHERE g.k IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS lines_total FROM f GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS lines_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.lines_total, 0)::BIGINT AS lines_total, coalesce(m.lines_removed, 0)::BIGINT AS lines_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7 = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS c, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, i, c, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, a, b, c, count(*) OVER () AS n, count(*) OVER (PARTITION BY doc_id) AS nd FROM g),
one AS (SELECT c, count(*) AS k FROM s GROUP BY ALL), one_d AS (SELECT doc_id, c, count(*) AS k FROM s GROUP BY ALL),
two AS (SELECT b, c, count(*) AS k FROM s WHERE b IS NOT NULL GROUP BY ALL), two_d AS (SELECT doc_id, b, c, count(*) AS k FROM s WHERE b IS NOT NULL GROUP BY ALL),
three AS (SELECT a, b, c, count(*) AS k FROM s WHERE a IS NOT NULL GROUP BY ALL), three_d AS (SELECT doc_id, a, b, c, count(*) AS k FROM s WHERE a IS NOT NULL GROUP BY ALL),
x AS (SELECT s.*, one.k - one_d.k AS f1, two.k - two_d.k AS f2, three.k - three_d.k AS f3, lag(one.k - one_d.k) OVER o AS c1, lag(two.k - two_d.k) OVER o AS c2
      FROM s JOIN one USING (c) JOIN one_d USING (doc_id, c) LEFT JOIN two USING (b, c) LEFT JOIN two_d USING (doc_id, b, c)
      LEFT JOIN three USING (a, b, c) LEFT JOIN three_d USING (doc_id, a, b, c) WINDOW o AS (PARTITION BY s.doc_id ORDER BY s.i)),
y AS (SELECT doc_id,
        CASE WHEN f3 > 0 THEN 0 WHEN f3 IS NOT NULL AND f2 > 0 THEN 1 WHEN f3 IS NOT NULL THEN 2 WHEN f2 > 0 THEN 0 WHEN f2 IS NOT NULL THEN 1 ELSE 0 END AS depth,
        CASE WHEN f3 > 0 THEN log10(f3 / c2) WHEN f2 > 0 THEN log10(f2 / c1) ELSE log10(greatest(f1, 0.5::DOUBLE) / greatest(n - nd, 1)) END AS lg FROM x),
z AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (depth > 0) AS n_backed_off, sum(lg + depth * log10(0.4::DOUBLE)) AS score FROM y GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off,
       round(coalesce(score, 0), 6) AS score, round(score / n_words, 6) AS mean_score
FROM t LEFT JOIN z USING (doc_id)
"""

_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END"

OP8 = f"""
WITH u AS (SELECT page_id, {_REST} AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), ''), '&'),
             lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM h),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(regexp_replace(path, '/index[.]html?$', ''), '/+$', '')
             || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon FROM q),
listed AS (SELECT DISTINCT canon FROM c WHERE page_id % 50 = 0 AND canon IS NOT NULL),
r AS (SELECT c.*, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
             listed.canon IS NOT NULL AS listed FROM c LEFT JOIN listed ON listed.canon = c.canon)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP10 = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x AS doc_id, y AS other FROM both_ UNION SELECT reach.doc_id, both_.y FROM reach JOIN both_ ON both_.x = reach.other)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(min(reach.other), t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.doc_id = t.doc_id GROUP BY t.doc_id, n.n
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(text: str) -> str:
    """Bit by bit over the UTF-8 bytes: a byte comes in at every eighth step."""
    digit = lambda k: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {k}, 1)) - 1)"
    byte = f"(16 * {digit('2 * (k // 8) + 1')} + {digit('2 * (k // 8) + 2')})"
    came = f"CASE WHEN k % 8 = 0 THEN xor(acc, {byte}) ELSE acc END"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], range(8 * strlen({text}))), lambda acc, k: xor(({came}) // 2, CASE WHEN ({came}) % 2 = 1 THEN 3988292384 ELSE 0 END)))"


_TREE = """{t} AS (SELECT 0 AS k, g, row_number() OVER (PARTITION BY g ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h FROM {source}
      UNION ALL SELECT k + 1, g, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY k, g, i // 3)"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS cut, {_crc32('doc_id::VARCHAR')} % 2 = 0 AS odd FROM documents),
e AS (SELECT *, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_TREE.format(t="tree", order="doc_id NULLS FIRST, h", source="e")},
subs AS (SELECT g AS sub, '' AS g, h FROM tree WHERE n = 1),
{_TREE.format(t="over_", order="sub", source="subs")},
places AS (SELECT e.doc_id, e.leaf, e.g, e.i, coalesce(CASE WHEN odd THEN cut END, leaf) AS start, s.h AS subroot, r.h AS root, row_number() OVER (PARTITION BY e.g ORDER BY e.i) AS pos, s.j
           FROM e JOIN (SELECT sub, h, row_number() OVER (ORDER BY sub) - 1 AS j FROM subs) s ON s.sub = e.g CROSS JOIN (SELECT h FROM over_ WHERE n = 1) r),
pow AS (SELECT k, pow(3, k)::BIGINT AS p FROM range(14) t(k)),
way AS (SELECT g, i, k, p, 0 AS over FROM places JOIN (SELECT g, max(k) AS top FROM tree GROUP BY g) USING (g) JOIN pow ON k < top),
side AS (SELECT w.g, w.i, w.k, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < w.i // p), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > w.i // p), '') AS r
         FROM way w JOIN tree t ON t.g = w.g AND t.k = w.k AND t.i // 3 = w.i // p // 3 GROUP BY ALL),
up2 AS (SELECT j, pow.k, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < j // p), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > j // p), '') AS r
        FROM (SELECT DISTINCT j FROM places) JOIN pow ON k < (SELECT max(k) FROM over_) JOIN over_ t ON t.k = pow.k AND t.i // 3 = j // p // 3 GROUP BY ALL),
path AS (SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY over, k) AS s, l, r FROM
         (SELECT g, i, k, 0 AS over, l, r FROM side UNION ALL SELECT g, i, k, 1 AS over, l, r FROM places JOIN up2 USING (j))),
fold AS (SELECT g, i, 0 AS s, start AS h FROM places UNION ALL SELECT fold.g, fold.i, path.s, sha256(path.l || fold.h || path.r) FROM fold JOIN path ON path.g = fold.g AND path.i = fold.i AND path.s = fold.s + 1),
ends AS (SELECT g, i, arg_max(h, s) AS folded_root FROM fold GROUP BY g, i),
proof AS (SELECT g, i, string_agg(l || r, '' ORDER BY s) AS p FROM path GROUP BY g, i)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM places JOIN ends USING (g, i) LEFT JOIN proof USING (g, i)
"""

_PLAIN = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, {_PLAIN} AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS f FROM t), q AS (SELECT unnest({_PLAIN}) AS f FROM benchmark),
b AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT f FROM w UNION SELECT f FROM q)),
raw AS (SELECT b, count(*) AS s FROM w JOIN b USING (f) GROUP BY b), want AS (SELECT b, count(*) AS t FROM q JOIN b USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM q) + 10000)::DOUBLE)))::BIGINT AS gain FROM raw FULL JOIN want USING (b)),
m AS (SELECT rid, sum(gain)::BIGINT AS weight FROM w JOIN b USING (f) JOIN gain USING (b) GROUP BY rid),
h AS (SELECT doc_id, len(coalesce(ws, [])) AS n, coalesce(weight, 0) AS weight, list_reduce(list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1))::BIGINT - 1), lambda x, y: 16 * x + y) AS h FROM t LEFT JOIN m USING (rid)),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
r AS (SELECT *, CASE WHEN n >= 20 AND doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY n >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id, n) END AS k FROM s)
SELECT doc_id, n AS n_words, n AS n_features, weight, score, CASE WHEN k <= 10 * (SELECT count(*) FROM s WHERE n >= 20 AND doc_id IS NOT NULL) // 100 THEN k END AS rank FROM r
"""

OP13 = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, rid, list_transform(e, lambda x: x / len_) AS e FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len_ FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE len_ > 0),
p AS (SELECT a.rid AS x, b.rid AS y, b.vec_id AS other FROM u a JOIN u b ON a.rid <> b.rid AND list_dot_product(a.e, b.e) >= 0.95),
reach AS (SELECT x, y, other FROM p UNION SELECT reach.x, p.y, p.other FROM reach JOIN p ON p.x = reach.y)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) c ON c.x = v.rid LEFT JOIN (SELECT x, min(other) AS m FROM reach GROUP BY x) r ON r.x = v.rid
"""

ORACLE = {"op5_line_dedup": OP5, "op7_lm_scoring": OP7, "op8_url_filter": OP8, "op10_ngram_jaccard": OP10, "op11_merkle_manifest": OP11, "op12_importance_resampling": OP12, "op13_embedding_neardup": OP13}
