"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Rule list, frequent token combinations by enumeration of all subsets, pruning and matching.
OP1 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^?#]*[?]([^=&#]*)', 1), '') AS query FROM u
), t AS (
  SELECT *, string_split(host, '.') AS names,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
), k AS (
  SELECT page_id, host, path, rule,
    CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS said,
    CASE WHEN host = '' THEN [] ELSE list_sort(list_filter([
      CASE WHEN names[-1] <> '' THEN 'tld=' || names[-1] END,
      CASE WHEN array_to_string(names[greatest(len(names) - 1, 1):], '.') <> '' THEN 'domain=' || array_to_string(names[greatest(len(names) - 1, 1):], '.') END,
      'host=' || host,
      CASE WHEN len(names) > 2 AND names[1] <> '' THEN 'sub=' || names[1] END,
      CASE WHEN regexp_extract(path, '^/([^/]*)', 1) <> '' THEN 'dir=' || regexp_replace(regexp_extract(path, '^/([^/]*)', 1), '[0-9]+', '0', 'g') END,
      CASE WHEN regexp_extract(path, '^/[^/]*/([^/]*)', 1) <> '' THEN 'dir2=' || regexp_replace(regexp_extract(path, '^/[^/]*/([^/]*)', 1), '[0-9]+', '0', 'g') END,
      CASE WHEN regexp_extract(path, '[.]([a-zA-Z0-9]{{1,5}})$', 1) <> '' THEN 'ending=' || regexp_extract(path, '[.]([a-zA-Z0-9]{{1,5}})$', 1) END,
      CASE WHEN query <> '' THEN 'query=' || query END
    ], lambda x: x IS NOT NULL)) END AS tokens FROM t
), lab AS (SELECT tokens, said FROM k WHERE said IS NOT NULL AND len(tokens) > 0
), masks AS (SELECT unnest(range(1, 256)) AS mask
), subs AS (
  SELECT list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s, said FROM lab, masks WHERE mask < (1 << len(tokens))
), n AS (SELECT s, said, count(*) AS f, sum(count(*)) OVER (PARTITION BY s) AS whole FROM subs GROUP BY s, said
), rules AS (
  SELECT s, said, f, f / whole AS conf FROM n WHERE f >= ceil(0.005 * (SELECT count(*) FROM lab)) AND f / whole >= 0.9
), pruned AS (
  SELECT * FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules q WHERE q.said = r.said AND q.conf >= r.conf AND len(q.s) < len(r.s) AND list_has_all(r.s, q.s))
), best AS (
  SELECT tokens, first(p.said ORDER BY conf DESC, f DESC, s, p.said) AS mined, first(array_to_string(s, ' ') ORDER BY conf DESC, f DESC, s, p.said) AS mined_from
  FROM (SELECT DISTINCT tokens FROM k) d JOIN pruned p ON list_has_all(d.tokens, p.s) GROUP BY tokens
)
SELECT page_id, host, path, rule, coalesce(said, mined, 'allow') AS verdict, CASE WHEN said IS NULL THEN mined_from END AS mined_from
FROM k LEFT JOIN best USING (tokens)
"""

_WORDS = rf"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Exact windows by their words; near ones as the operator defines them, from the rarest pair of each window.
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, w[s + 1:s + 10] AS ws FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)
), wins AS (SELECT DISTINCT ws FROM win
), spot AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d
), lens AS (SELECT DISTINCT len(ws) AS n FROM wins
), hit AS (
  SELECT r, i, n, ws FROM (SELECT r, i, n, w[i:i + n - 1] AS ws FROM spot, lens WHERE i + n - 1 <= len(w)) JOIN wins USING (ws)
), n_hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hit JOIN win USING (ws)) GROUP BY r
), term AS (
  SELECT ws, o, ws[o + 1] AS w1, coalesce(ws[o + 2], '') AS w2, (o % 2 = 0 OR o = len(ws) - 2) AS cover
  FROM (SELECT ws, unnest(range(0, greatest(len(ws) - 1, 1))) AS o FROM wins)
), asked AS (SELECT DISTINCT w1, w2 FROM term
), post AS (
  SELECT r, i - 1 AS pos, w1, w2 FROM spot JOIN asked ON w[i] = w1 AND (w2 = '' OR w[i + 1] = w2)
), cnt AS (SELECT w1, w2, count(*) AS n FROM post GROUP BY w1, w2
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n, o) AS k, min(coalesce(n, 0)) OVER (PARTITION BY ws) AS low FROM term LEFT JOIN cnt USING (w1, w2)
), place AS (
  SELECT r, ws, pos - o AS s FROM ranked JOIN post USING (w1, w2) WHERE k = 1 AND low > 0
), met AS (
  SELECT pl.r, pl.ws, pl.s, count(DISTINCT t.o) AS nearby, count(DISTINCT CASE WHEN post.pos = pl.s + t.o THEN t.o END) AS same
  FROM place pl JOIN ranked t ON t.ws = pl.ws AND t.k > 1 AND t.cover
  JOIN post ON post.r = pl.r AND post.w1 = t.w1 AND post.w2 = t.w2 AND post.pos BETWEEN pl.s + t.o - 2 AND pl.s + t.o + 2
  GROUP BY 1, 2, 3
), near AS (
  SELECT r, count(DISTINCT met.ws) AS n_near FROM met JOIN (SELECT ws, count(*) AS need FROM ranked WHERE k > 1 AND cover GROUP BY ws) q ON q.ws = met.ws
  WHERE nearby = need AND same < need GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""

#: All pairs that share a shingle, by counts; components by walking the links.
OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i:i + 3] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)
), both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), walk AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT walk.x, both_ways.y FROM walk JOIN both_ways ON walk.y = both_ways.x
), comp AS (SELECT x AS doc_id, min(y) AS component_id FROM walk GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

#: All windows of up to four words, their counts, and every cut and containment by joins.
OP11 = rf"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS text FROM documents)
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30
), cand AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1
), cut AS (
  SELECT c.lang, c.phrase, c.words, c.a, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f) AS BIGINT) AS score, k
  FROM (SELECT *, unnest(range(1, words)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS whole
  FROM (SELECT *, unnest(range(1, words - size + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS size FROM cand)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_ i USING (lang, phrase) WHERE i.whole IS NULL OR 100 * i.whole::HUGEINT < 80 * a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: The damage by a bitwise CRC-32, then the cheapest edits row by row with the best audit of each grammar state.
OP13 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT),
      lambda v, b: list_reduce(range(8), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END, xor(v, b)), 4294967295), 4294967295) % 20 AS hit
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END))
  FROM c WHERE hit <> 0
), s AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS rn FROM s
), r AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM o
), put(q, paid, letters, said, q2) AS (
  VALUES (0, 0, '', [], 0), (0, 3, 'I', ['user:'], 2), (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 0, '', [], 1), (1, 3, 'I', ['user:'], 2),
    (1, 6, 'II', ['user:', 'assistant:'], 3), (2, 0, '', [], 2), (2, 3, 'I', ['assistant:'], 3), (3, 0, '', [], 3), (3, 3, 'I', ['user:'], 2)
), follow(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), move AS (
  SELECT q, q2, initial, 'K' AS edit, 0 AS paid FROM follow UNION ALL SELECT q, q2, initial, 'R', 3 FROM follow WHERE initial IN ('u', 'a')
  UNION ALL SELECT q, q, '', 'D', 4 FROM (SELECT unnest([0, 1, 2, 3]) AS q)
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM r
  UNION ALL
  SELECT * FROM (
    SELECT w.conv_id, w.i + 1 AS i, m.q2 AS q, w.cost + p.paid + m.paid + CASE WHEN m.edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost,
      w.audit || p.letters || m.edit AS audit,
      list_concat(w.said, p.said, CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END) AS said
    FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.i + 1 JOIN put p ON p.q = w.q JOIN move m ON m.q = p.q2
    WHERE m.edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = r.initial))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS m
  FROM r GROUP BY conv_id
), done AS (
  SELECT w.conv_id, cost + paid AS cost, audit || letters AS audit, sha256(coalesce(array_to_string(list_concat(w.said, p.said), chr(10)), '')) AS h
  FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = s.m JOIN put p ON p.q = w.q AND p.q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + paid, audit || letters) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""

SQL = {"op1_url_rules": OP1, "op8_decontamination": OP8, "op9_minhash_near_dedup": OP9, "op11_collocations": OP11, "op13_turn_repair": OP13}
