"""DuckDB SQL for the queries of this subpackage that SQL can express over the whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ASCII_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP9 = rf"""
WITH ws AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ASCII_WORDS}) AS w FROM documents),
its AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_ASCII_WORDS}) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, w[i : least(i + 9, len(w))] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM its WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT len(win) AS k FROM win),
dw AS (SELECT doc_id, k, i, w[i : i + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, lens WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN win USING (win)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(ni.n, 0) AS n_items,
       coalesce(ni.sha, sha256('')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM ws LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

OP10 = rf"""
WITH cutoff AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
fit AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
  END AS rule FROM hp
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM fit
"""

# Quotes linked to the first message of the conversation that says the same, whole, by paragraph or by line.
_NORMAL = "trim(regexp_replace(lower({}), '[ \t\r\n\f]+', ' ', 'g'))"
_MARKS = r"regexp_extract(line, '^[> 	]*')"
_LEVEL = f"(length({_MARKS}) - length(replace({_MARKS}, '>', '')))"
OP8 = rf"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations
),
leveled AS (SELECT conv_id, turn, i, {_LEVEL} AS level, CASE WHEN {_LEVEL} > 0 THEN substr(line, length({_MARKS}) + 1) ELSE line END AS line FROM lines),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM leveled),
quotes AS (
  SELECT conv_id, turn, level, {_NORMAL.format("string_agg(line, chr(10) ORDER BY i)")} AS t FROM islands WHERE level > 0 GROUP BY conv_id, turn, level, run
),
own AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), '^[
]+|[
]+$', '', 'g') AS text FROM leveled GROUP BY conv_id, turn),
parts AS (
  SELECT conv_id, turn, text AS t FROM own UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '
[ 	
]*
')) FROM own
  UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM own
),
origins AS (SELECT conv_id, {_NORMAL.format("t")} AS t, min(turn) AS origin FROM parts WHERE {_NORMAL.format("t")} <> '' GROUP BY ALL),
linked AS (SELECT q.conv_id, q.turn, q.level, origin FROM quotes q JOIN origins o ON o.conv_id = q.conv_id AND o.t = q.t AND origin < q.turn WHERE q.t <> ''),
answers AS (SELECT conv_id, turn, max(struct_pack(l := -level, o := origin)).o AS parent, count(*) AS n FROM linked GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM answers
  UNION ALL SELECT u.conv_id, u.turn, a.parent, u.depth + 1 FROM up u JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.root
),
roots AS (SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
nq AS (SELECT conv_id, turn, count(*) AS n FROM quotes WHERE t <> '' GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, o.text, a.parent AS parent_turn, coalesce(r.root, c.turn) AS root_turn, CAST(coalesce(r.depth, 0) AS INT) AS depth,
       row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(r.root, c.turn), c.turn) - 1 AS position, CAST(coalesce(nq.n, 0) AS INT) AS n_quotes, coalesce(a.n, 0) AS n_linked
FROM conversations c JOIN own o USING (conv_id, turn) LEFT JOIN answers a USING (conv_id, turn) LEFT JOIN roots r USING (conv_id, turn) LEFT JOIN nq USING (conv_id, turn)
"""

# Of equal texts the longest original stays; blanks do not count.
OP11 = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY length(text) DESC, doc_id NULLS LAST)
"""

#: crc32 of a text of ASCII characters, bit by bit.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"
)
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# The cheapest edits row by row: the least (cost, audit) of each grammar state after each row, inserts as a table of their closure.
OP12 = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC32.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed JOIN (VALUES (1), (2)) c(k) ON k = 1 OR kind = 3 WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN trim(text, {_SPACES}) = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(rtrim(text, {_SPACES}), 1) IN ('.', '!', '?') THEN 'clean' ELSE 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed
),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')) x(q, t, w, a)),
edits AS (
  SELECT * FROM (VALUES
    (0, 0, 2, 'D', NULL), (1, 1, 2, 'D', NULL), (2, 2, 2, 'D', NULL), (3, 3, 2, 'D', NULL),
    (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'), (3, 2, 0, 'K', 'u'),
    (0, 2, 1, 'R', NULL), (1, 2, 1, 'R', NULL), (2, 3, 1, 'R', NULL), (3, 2, 1, 'R', NULL)) x(q, t, w, a, need)
),
dp AS (
  SELECT conv_id, 0 AS i, 0 AS q, {{'cost': 0, 'audit': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, e.t, min({{'cost': best.cost + ins.w + e.w + CASE WHEN e.a <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, 'audit': best.audit || ins.a || e.a}})
  FROM dp JOIN ins ON ins.q = dp.q JOIN edits e ON e.q = ins.t
  JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 AND (e.need IS NULL OR e.need = left(role, 1)) AND (e.a = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY dp.conv_id, dp.i, e.t
),
sums AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(f.i) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
),
solved AS (
  SELECT s.conv_id, min({{'cost': best.cost + ins.w, 'audit': best.audit || ins.a}}) AS best
  FROM sums s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = s.n JOIN ins ON ins.q = dp.q AND ins.t IN (0, 3) GROUP BY s.conv_id
),
letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS e, unnest(range(1, length(best.audit) + 1)) AS k FROM solved WHERE best.audit <> ''),
walked AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM letters),
told AS (SELECT w.conv_id, k, e, role, text, row_number() OVER (PARTITION BY w.conv_id ORDER BY k) AS m FROM walked w LEFT JOIN faulty f ON e <> 'I' AND f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE e <> 'D'),
named AS (SELECT *, m - max(CASE WHEN m = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS j FROM told),
spoken AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM named GROUP BY conv_id
)
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(v.best.cost AS BIGINT) AS cost, v.best.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM sums s JOIN solved v ON v.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN spoken p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
"""


def _enc(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join([_enc("doc_id"), _enc("source"), _enc("lang"), _enc(n_chars), _enc("text")]) + ")"


# Trees level by level; every leaf is folded with its siblings, first in its own tree, then over the trees.
OP13 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC32.format("CAST(coalesce(doc_id, 0) AS VARCHAR)")} % 7 = 0 AND doc_id IS NOT NULL THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS held FROM documents
),
slots AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
lv AS (
  SELECT tree, 0 AS lvl, slot, leaf AS node, n FROM slots
  UNION ALL SELECT tree, lvl + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, lvl, slot // 2, n
),
tops AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS slot, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS lvl, slot, subroot AS node, n FROM tops
  UNION ALL SELECT lvl + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)), (n + 1) // 2 FROM tv WHERE n > 1 GROUP BY lvl, slot // 2, n
),
fold AS (
  SELECT rid, tree, 0 AS lvl, slot, n, held AS cur, '' AS path FROM slots
  UNION ALL SELECT f.rid, f.tree, f.lvl + 1, f.slot // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN cur WHEN f.slot % 2 = 1 THEN s.node || cur ELSE cur || s.node END), path || coalesce(s.node, '')
  FROM fold f LEFT JOIN lv s ON s.tree = f.tree AND s.lvl = f.lvl AND s.slot = xor(f.slot, 1) WHERE f.n > 1
),
over AS (
  SELECT rid, 0 AS lvl, t.slot, t.n, cur, path FROM fold f JOIN tops t ON t.tree = f.tree WHERE f.n = 1
  UNION ALL SELECT f.rid, f.lvl + 1, f.slot // 2, (f.n + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN cur WHEN f.slot % 2 = 1 THEN s.node || cur ELSE cur || s.node END), path || coalesce(s.node, '')
  FROM over f LEFT JOIN tv s ON s.lvl = f.lvl AND s.slot = xor(f.slot, 1) WHERE f.n > 1
)
SELECT l.doc_id, l.leaf, t.subroot, r.node AS root, sha256(o.path) AS proof_sha256, o.cur AS folded_root, o.cur = r.node AS verified
FROM leaves l JOIN tops t USING (tree) JOIN over o ON o.rid = l.rid AND o.n = 1, (SELECT node FROM tv WHERE n = 1) r
"""

ORACLES: dict[str, str] = {
    "op11_exact_dedup": OP11, "op12_structure_repair": OP12, "op13_merkle_manifest": OP13,
    "op8_quotation_linking": OP8, "op9_decontamination": OP9, "op10_url_filter": OP10}
