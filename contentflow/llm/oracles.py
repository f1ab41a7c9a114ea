"""DuckDB SQL for the queries whose results SQL can say on whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACHED = """r AS (SELECT id AS a, id AS b FROM points UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
    c AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    points AS (SELECT doc_id AS id FROM documents), {_REACHED}
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM documents JOIN c ON doc_id = id LEFT JOIN n USING (doc_id)"""

EMBEDDING_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
    u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
    points AS (SELECT vec_id AS id FROM embeddings), {_REACHED},
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a"""

_WORDS = f"regexp_extract_all({_LOW.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

BENCHMARK_WINDOWS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)),
        lambda k: array_to_string(w[k:k + 9], ' '))) AS words FROM i WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    place AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d CROSS JOIN sizes WHERE len(w) >= n)),
    occurs AS (SELECT doc_id, item_id, k, place.n FROM place JOIN win ON place.words = win.words AND place.n = win.n),
    hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) FROM occurs) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
        (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occurs WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_CUES = "account|Account|ACCOUNT|acct|Acct|ACCT|iban|Iban|IBAN|ssn|SSN|passport|Passport|PASSPORT"
# Kind, pattern, and what a text is cut into where the pattern does not match: never more than one place a match can begin at.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[A-Za-z0-9._%+-]+|[^A-Za-z0-9._%+-]+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]+|[^0-9]+"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", r"[0-9]|[^0-9]+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+|[^+]+"),
    ("url", r"(?:https|http|ftp|HTTPS|HTTP|FTP)://[A-Za-z0-9][A-Za-z0-9._~:/?#@!$&*+,;=%-]*", r"[hfHF]|[^hfHF]+"),
    ("account", rf"(?:{_CUES})(?: ?(?:no\.?|No\.?|number|Number))?[ :#=]{{0,3}}[0-9](?:[ -]?[0-9])+", r"[aAiIsSpP]|[^aAiIsSpP]+"),
)
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INT)
    ELSE 2 * CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INT) - CASE WHEN CAST({_DIGITS}[length({_DIGITS}) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_NUMBER = "regexp_extract(m, '[0-9](?:[ -]?[0-9])+$')"
# What a match must be, where its span begins and ends.
_VALID = {
    "email": ("true", "begin", "stop"),
    "ip": ("len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INT) > 255)) = 0", "begin", "stop"),
    "card": (f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", "begin", "stop"),
    "phone": (f"length({_DIGITS}) BETWEEN 9 AND 15", "begin", "stop"),
    "url": ("true", "begin", "stop - length(regexp_extract(m, '[.,;:!?]*$'))"),
    "account": (f"length(regexp_replace({_NUMBER}, '[^0-9]', '', 'g')) BETWEEN 6 AND 24", f"stop - length({_NUMBER})", "stop"),
}


def _spans(order: int, kind: str, pattern: str, rest: str) -> str:
    valid, begin, stop = _VALID[kind]
    cut = f"""SELECT doc_id, m, CAST(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM
        (SELECT doc_id, unnest(parts) AS m, generate_subscripts(parts, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s){pattern}|{rest}') AS parts FROM documents))"""
    return f"""SELECT doc_id, {order} AS kind_no, '{kind}' AS kind, {begin} AS s, {stop} AS e FROM
        (SELECT *, stop - length(m) AS begin FROM ({cut}) WHERE regexp_full_match(m, '{pattern}')) WHERE {valid}"""


_TEXT = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR)"
PERSONAL_SPANS = f"""WITH x AS ({' UNION ALL '.join(_spans(k, *one) for k, one in enumerate(_KINDS))}),
    a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
        string_agg({_TEXT}, ',' ORDER BY s, kind_no) FILTER (kind_no < 4) AS base, string_agg({_TEXT}, ',' ORDER BY s, kind_no) AS spans FROM x GROUP BY doc_id)
    SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""

_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ord(s)::BIGINT)),
        lambda x, b: list_reduce(list_concat([xor(x, b)], list_transform(range(8), lambda z: 0::BIGINT)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""

# A node's subtree are the nodes whose smallest member has the node on its way.
PREFIX_TRIE = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, count(*) AS has FROM t GROUP BY c), h AS (SELECT c, has, {_CRC} % 6 AS h FROM n),
    m AS (SELECT h.c, h.h, least(h.h, coalesce(b.has, 0)) AS taken, h.has FROM h LEFT JOIN n b ON b.c = h.c - h.c % 100),
    r AS (SELECT t.c, i - h + taken AS d, role, text FROM t JOIN m USING (c) WHERE i > h
        UNION ALL SELECT m.c, i, role, text FROM m JOIN t ON t.c = m.c - m.c % 100 WHERE i <= taken),
    p AS (SELECT c, d, length(text) AS len, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS k FROM r
        UNION ALL SELECT c, 0, 0, '' FROM n),
    w AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
    g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len, any_value(above) AS above,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM w GROUP BY k, d),
    kids AS (SELECT above AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY above),
    v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (k)),
    s AS (SELECT a.k, a.d, sum((v.n_convs - 1) * v.len) AS saved, sum(CAST(v.n_children = 0 AS BIGINT)) AS leaves FROM v JOIN p a ON a.c = v.conv_id AND a.d <= v.d GROUP BY a.k, a.d)
    SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(leaves AS BIGINT) AS n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
    FROM v JOIN s ON s.k = v.k AND s.d = v.d LEFT JOIN g u ON v.d > 0 AND u.k = v.above AND u.d = v.d - 1"""
