"""SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM words
), items AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id
FROM sets s JOIN least_id l ON s.doc_id = l.x
"""

LINES = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), repeated AS (
    SELECT k, max(doc_id) AS keeper FROM keyed
    WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (WHERE doc_id <> keeper) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id = keeper), ''))
        AS kept_sha256
FROM keyed LEFT JOIN repeated USING (k) GROUP BY doc_id
"""


def _encoded(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_encoded, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# crc32 of the decimal id: a code point is mixed in (>= 0), then eight shifts (-1).
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf('n_chars')} AS leaf,
        CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS other
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        row_number() OVER () AS r, count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
), sub(tree, level, pos, digest, n) AS (
    SELECT tree, 0, pos, leaf, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM sub WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sub WHERE n = 1
), top(level, pos, digest, n) AS (
    SELECT 0, pos, digest, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), climb(r, tree, level, pos, n, digest, proof) AS (
    SELECT r, tree, 0, pos, n, other, '' FROM placed
    UNION ALL
    SELECT c.r, c.tree, c.level + 1, c.pos // 2, (c.n + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 0 THEN c.digest || coalesce(s.digest, '') ELSE s.digest || c.digest END),
        c.proof || coalesce(s.digest, '')
    FROM climb c LEFT JOIN sub s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
    WHERE c.n > 1
), climb_top(r, level, pos, n, digest, proof) AS (
    SELECT c.r, 0, s.pos, s.n, c.digest, c.proof FROM climb c JOIN subroots s ON s.tree = c.tree WHERE c.n = 1
    UNION ALL
    SELECT c.r, c.level + 1, c.pos // 2, (c.n + 1) // 2,
        sha256(CASE WHEN c.pos % 2 = 0 THEN c.digest || coalesce(s.digest, '') ELSE s.digest || c.digest END),
        c.proof || coalesce(s.digest, '')
    FROM climb_top c LEFT JOIN top s ON s.level = c.level AND s.pos = xor(c.pos, 1)
    WHERE c.n > 1
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256,
    c.digest AS folded_root, c.digest = t.digest AS verified
FROM placed p JOIN climb_top c ON c.r = p.r AND c.n = 1 JOIN subroots s ON s.tree = p.tree
    CROSS JOIN (SELECT digest FROM top WHERE n = 1) t
"""

_TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
held AS (SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
weights AS (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, total GROUP BY t, docs
), scored AS (
    SELECT a.item_id, h.doc_id, CAST(sum(w.w * ((1000000000 * h.tf) //
        (1000 * h.tf + 8 * (10 + (90 * s.n * total.docs) // total.terms)))) AS BIGINT) AS score
    FROM asked a JOIN held h ON h.t = a.t JOIN weights w ON w.t = a.t JOIN sizes s ON s.doc_id = h.doc_id, total
    GROUP BY a.item_id, h.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
