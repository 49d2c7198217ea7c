"""DuckDB texts for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')) END) AS t FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT r.id, l.y FROM reach r JOIN linked l ON l.x = r.other),
smallest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, smallest.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN smallest ON smallest.id = w.doc_id
"""

_LETTERS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_LETTERS}, []) AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, coalesce({_LETTERS}, []) AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 11), lambda k : array_to_string(w[k:k + 12], ' ')) END) AS t
  FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, sizes WHERE len(w) >= size),
occurs AS MATERIALIZED (
  SELECT p.doc_id, p.k, p.size, x.item_id
  FROM (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS t FROM places) p JOIN windows x ON x.t = p.t AND x.size = p.size),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS k FROM occurs) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurs) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x : x / sqrt(list_sum(list_transform(e, lambda y : y * y)))) AS e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x : x <> 0)) > 0),
linked AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM linked GROUP BY 1),
reach AS (SELECT vec_id AS id, vec_id AS other FROM v UNION SELECT r.id, l.y FROM reach r JOIN linked l ON l.x = r.other),
smallest AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, s.c AS component_id, v.vec_id = s.c AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id JOIN smallest s ON s.id = v.vec_id
"""

_CODED = r"replace(replace(replace(replace({}, '\', '\-'), '[', '\('), ']', '\)'), '<', '\{{')"

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(9 + length({_CODED.format('role')}) + length({_CODED.format('text')})) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM told
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
kept AS (SELECT html, max(page_id) AS keeper, count(*) AS n FROM p GROUP BY 1),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(CAST(('0x' || substr(h, g * 5 + 1, 5)) AS INTEGER) >> (15 - 5 * k) AS INTEGER) % 32 + 1, 1), '' ORDER BY g, k) AS d
  FROM p, range(8) a(g), range(4) b(k) GROUP BY 1)
SELECT p.page_id, strlen(p.html) AS payload_bytes, d.d AS payload_digest,
  CASE WHEN p.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN kept USING (html) JOIN digits d USING (page_id)
"""

_ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_LIVE = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*-----END [A-Z ]*PRIVATE KEY-----"
    "|eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"
    "|(?:gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}|[A-Za-z0-9+/_-]{24,}"
)


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT r, owner, source, '{kind}' AS kind, {rank} AS rank, f[i] AS whole, v[i] AS value,
    list_sum(list_transform(g[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x : length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
    SELECT r, owner, source, regexp_extract_all(t, '{pattern}', 0) AS f, regexp_extract_all(t, '{pattern}', {group}) AS v,
      string_split_regex(t, '{pattern}') AS g FROM d)) WHERE length(v[i]) >= {least}"""


SECRETS = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, split_part(source, '/', 1) AS owner, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED (
  {_matches("assign", 0, _ASSIGN, 2, 8)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 16)}
  UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 32)} UNION ALL {_matches("live", 3, _LIVE, 0, 20)}),
s AS (SELECT *, CAST(a + length(whole) AS BIGINT) AS b, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(whole) AS BIGINT) AS span FROM m),
o AS (SELECT value, count(*) AS n_owners FROM (SELECT DISTINCT value, owner FROM m) GROUP BY 1),
j AS MATERIALIZED (
  SELECT s.*, CASE WHEN n_owners >= 3 THEN 'example'
    WHEN n_owners = 1 AND length(s.value) >= 16 AND regexp_matches(s.value, '[A-Za-z]') AND regexp_matches(s.value, '[0-9]')
      AND len(list_distinct(string_split(s.value, ''))) >= 8
      AND NOT regexp_matches(lower(s.value), 'example|sample|placeholder|changeme|dummy|xxxx|test') THEN 'live' ELSE 'other' END AS verdict
  FROM s JOIN o USING (value)),
k AS (
  SELECT * FROM j WHERE kind <> 'live' OR (verdict = 'live' AND NOT EXISTS (
    SELECT 1 FROM j b WHERE b.r = j.r AND b.kind <> 'live' AND b.a < j.b AND b.b > j.a)))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (kind <> 'live'), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example, count(*) FILTER (kind = 'live') AS n_added
FROM d LEFT JOIN k USING (r) GROUP BY d.r, d.doc_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    steps = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k : xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i : CAST(ascii({text}[i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b : {steps}), 4294967295)"


RUNS = rf"""
WITH split AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
params AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 % 8 AS e FROM split),
planted AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i : CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] ELSE w[i + 1] END) ELSE w END AS w
  FROM params),
word AS MATERIALIZED (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted WHERE n >= 24),
same AS MATERIALIZED (
  SELECT x.r, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 3),
stretch AS MATERIALIZED (
  SELECT r, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
run AS MATERIALIZED (
  SELECT * FROM stretch t WHERE NOT EXISTS (
    SELECT 1 FROM stretch u WHERE u.r = t.r AND u.q < t.q AND t.q % u.q = 0 AND u.s <= t.s AND u.s + u.m >= t.s + t.m)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(m AS DOUBLE) / q DESC, s, q) AS k FROM run) WHERE k = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM run GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM run),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, CAST(1000 * b.m // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(CASE WHEN p.n < 24 THEN array_to_string(w, ' ') ELSE kept.t END) AS collapsed_sha256
FROM planted p LEFT JOIN best b USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([_field(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]) + ")"


_LOWERED = _field("text").replace("|| text", "|| translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

MERKLE = rf"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf(_field("text"))} AS h,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWERED)} ELSE {_leaf(_field("text"))} END AS changed FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaf),
low AS (
  SELECT 0 AS level, grp, i, n, h FROM placed UNION ALL
  SELECT level + 1, grp, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, grp, i // 16, n),
sub AS MATERIALIZED (
  SELECT grp, h, row_number() OVER (ORDER BY CAST(grp AS BLOB)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, n, h FROM sub UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 16, n),
runs AS MATERIALIZED (
  SELECT 0 AS tree, level, grp, i // 16 AS run, list(h ORDER BY i) AS hs FROM low WHERE n > 1 GROUP BY ALL UNION ALL
  SELECT 1, level, '', i // 16, list(h ORDER BY i) FROM high WHERE n > 1 GROUP BY ALL),
step AS (
  SELECT p.i AS leaf_i, p.grp, tree, level, array_to_string(hs[1:p.i // CAST(power(16, level) AS BIGINT) % 16], '') AS x,
    array_to_string(hs[p.i // CAST(power(16, level) AS BIGINT) % 16 + 2:], '') AS y
  FROM placed p JOIN runs r ON tree = 0 AND r.grp = p.grp AND r.run = p.i // CAST(power(16, level + 1) AS BIGINT) UNION ALL
  SELECT p.i, p.grp, tree, level, array_to_string(hs[1:s.i // CAST(power(16, level) AS BIGINT) % 16], ''),
    array_to_string(hs[s.i // CAST(power(16, level) AS BIGINT) % 16 + 2:], '')
  FROM placed p JOIN sub s USING (grp) JOIN runs r ON tree = 1 AND r.run = s.i // CAST(power(16, level + 1) AS BIGINT)),
path AS MATERIALIZED (
  SELECT leaf_i, grp, list(struct_pack(x := x, y := y) ORDER BY tree, level) AS path, string_agg(x || y, '' ORDER BY tree, level) AS said FROM step GROUP BY 1, 2),
fold AS (
  SELECT i, grp, 0 AS k, changed AS h FROM placed UNION ALL
  SELECT f.i, f.grp, k + 1, sha256(path[k + 1].x || h || path[k + 1].y) FROM fold f JOIN path p ON p.leaf_i = f.i AND p.grp = f.grp WHERE k < len(path)),
folded AS (SELECT i, grp, arg_max(h, k) AS h FROM fold GROUP BY 1, 2),
root AS (SELECT h FROM high WHERE n = 1)
SELECT p.doc_id, p.h AS leaf, sub.h AS subroot, root.h AS root, sha256(coalesce(path.said, '')) AS proof_sha256, folded.h AS folded_root,
  folded.h = root.h AS verified
FROM placed p JOIN sub USING (grp) CROSS JOIN root JOIN folded ON folded.i = p.i AND folded.grp = p.grp
LEFT JOIN path ON path.leaf_i = p.i AND path.grp = p.grp
"""

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op4_ngram_jaccard_join": JACCARD,
    "op7_chat_formatting": CHAT,
    "op8_warc_salvage": WARC,
    "op10_benchmark_decontamination": DECONTAMINATION,
    "op11_secret_scan": SECRETS,
    "op12_periodic_runs": RUNS,
    "op13_merkle_manifest": MERKLE,
}
