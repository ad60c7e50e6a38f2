"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import license_scan
from .decontaminate import NEAR

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    """Lower-cased (A-Z only) words of the column text; none for null."""
    return (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
            f"'{pattern}')")


def _base32(digest: str) -> str:
    """A 40-digit hexadecimal text in base32, five digits to four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return " || ".join(
        f"substr('{letters}', CAST((CAST('0x' || substr({digest}, {at}, 5) AS BIGINT) >> {shift})"
        " & 31 AS INTEGER) + 1, 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0))


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: a byte, then eight ticks, and so on."""
    steps = (f"flatten(list_transform(range(1, length({text}) + 1), lambda k: "
             f"[CAST(ascii(substr({text}, CAST(k AS INTEGER), 1)) AS BIGINT), "
             + ", ".join(["-1"] * 8) + "]))")
    return (f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, e: "
            "CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) "
            "ELSE a >> 1 END), 4294967295)")


def _repair_sql() -> str:
    """One row after another: for each state the cheapest edits so far, as a text
    of cost (12 digits), initials, chr(1) and the repaired rows; the least such
    text is the best."""
    def add(v: str, cost: str, letter: str, tail: str = "''") -> str:
        return (f"CASE WHEN {v} = '~' THEN '~' ELSE lpad(CAST(CAST(substr({v}, 1, 12) AS BIGINT) "
                f"+ {cost} AS VARCHAR), 12, '0') || substr({v}, 13, strpos({v}, chr(1)) - 13) || "
                f"'{letter}' || substr({v}, strpos({v}, chr(1))) || {tail} END")

    def only(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE '~' END"

    t2 = "least(s2, " + ", ".join(add(v, "3", "I", "chr(10) || 'user:'")
                                  for v in ("s0", "s1", "s3")) + ")"
    t3 = f"least(s3, {add('t2', '3', 'I', chr(39).join(['chr(10) || ', 'assistant:', '']))})"
    kept = "chr(10) || role || ':' || text"
    key = ("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || "
           "coalesce(CAST(turn AS VARCHAR), ' '))")
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32(key)} % 20 AS m FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                  ELSE text END AS text
      FROM c JOIN (SELECT unnest([1, 2]) AS copy) ON copy = 1 OR m = 3 WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
             sha256(length(role) || ':' || role || text)) AS i,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM d),
f AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS l,
             CASE WHEN x = '' THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1
                  THEN 'duplicate'
                  WHEN right(x, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
      FROM o),
s(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000000' || chr(1), '~', '~', '~' FROM f
  UNION ALL
  SELECT conv_id, i, {add('s0', '4', 'D')},
         least({add('s1', '4', 'D')}, {only("ok AND l = 's'", add('s0', 'e', 'K', kept))}),
         least({add('t2', '4', 'D')}, {only("ok AND l = 'u'", add('u', 'e', 'K', kept))},
               {only("ok", add('u', '(3 + e)', 'R', "chr(10) || 'user:' || text"))}),
         least({add('t3', '4', 'D')}, {only("ok AND l = 'a'", add('t2', 'e', 'K', kept))},
               {only("ok", add('t2', '(3 + e)', 'R', "chr(10) || 'assistant:' || text"))})
  FROM (SELECT *, least(s0, s1, t3) AS u FROM (SELECT *, {t3} AS t3 FROM (
    SELECT s.conv_id, f.i, s0, s1, s2, s3, {t2} AS t2, role, text, l,
           fault NOT IN ('blank', 'duplicate') AS ok,
           CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS e
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)))),
n AS (SELECT conv_id, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before || l NOT IN ('su', 'ua', 'au')) AS illegal
      FROM f GROUP BY conv_id),
z AS (SELECT n.*, least(s0, t3) AS best FROM (SELECT *, {t3} AS t3 FROM (
        SELECT *, {t2} AS t2 FROM s)) q
      JOIN n ON n.conv_id IS NOT DISTINCT FROM q.conv_id AND n.i = q.i)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(best, 1, 12) AS BIGINT), 0) AS cost,
       coalesce(substr(best, 13, strpos(best, chr(1)) - 13), '') AS audit,
       sha256(coalesce(substr(best, strpos(best, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
     LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle_sql(),
    # Equal texts are grouped by the text itself; the smallest id stays.
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
           FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""",
    # All pairs that share a shingle, counted; components by reachability.
    "op5_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
       JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) m ON m.v = d.doc_id""",
    # Every window of every document against every window of every item. Near: all
    # words of a window at most two places behind a common start; a word that
    # stands in the window several times needs as many places.
    "op10_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g
      FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
x AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM q), unnest(range(1, len(w) - n + 2)) AS t(k)
      WHERE len(w) >= n),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN q ON x.n = q.n AND x.g = q.g),
p AS (SELECT doc_id, count(DISTINCT place) AS hit
      FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS items,
             sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS digest
      FROM h GROUP BY doc_id),
v AS (SELECT DISTINCT n, g, string_split(g, ' ') AS w FROM q),
vt AS (SELECT g, n, i, w[i] AS term FROM v, unnest(range(1, n + 1)) AS t(i)),
dt AS (SELECT doc_id, k, w[k] AS term FROM d, unnest(range(1, len(w) + 1)) AS t(k)),
b AS (SELECT doc_id, g, k - i - j AS b
      FROM vt JOIN dt ON vt.term = dt.term, unnest(range(0, {NEAR + 1})) AS t(j)
      GROUP BY doc_id, g, n, k - i - j HAVING count(DISTINCT i) = n),
e AS (SELECT x.g, x.term, x.i AS lo, y.i AS hi,
             len(list_filter(v.w[x.i:y.i], lambda z: z = x.term)) AS need
      FROM vt x JOIN vt y ON x.g = y.g AND x.term = y.term AND x.i < y.i JOIN v ON v.g = x.g),
f AS (SELECT DISTINCT doc_id, g, b
      FROM (SELECT b.doc_id, b.g, b.b, lo, hi FROM b JOIN e ON e.g = b.g
            LEFT JOIN dt ON dt.doc_id = b.doc_id AND dt.term = e.term
                            AND dt.k BETWEEN b.b + lo AND b.b + hi + {NEAR}
            GROUP BY b.doc_id, b.g, b.b, e.term, lo, hi, need HAVING count(dt.k) < need)),
r AS (SELECT doc_id, count(DISTINCT item) AS near
      FROM (SELECT DISTINCT doc_id, g FROM (SELECT * FROM b EXCEPT SELECT * FROM f)) JOIN q USING (g)
      GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit,
       coalesce(items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       hit IS NOT NULL AS contaminated, coalesce(near, 0) AS n_near
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
       LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op11_conversation_repair": _repair_sql(),
    # Of equal payloads the first by id (then address) is stored, the rest refer to it.
    "op12_warc": rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p
      WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST)),
d AS (SELECT *, sha1(html) AS h FROM r)
SELECT page_id, strlen(html) AS payload_bytes, {_base32('h')} AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = 1 THEN NULL ELSE f END AS refers_to
FROM d""",
    # Prefixes as lists; each node is added to all its prefixes.
    "op13_prefix_trie": rf"""
WITH o AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST,
                  sha256(length(r) || ':' || r || x)) AS t
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
                 FROM conversations) GROUP BY conv_id),
h AS (SELECT conv_id, t, CAST(CASE WHEN conv_id % 20 <> 0 THEN
             {_crc32("CAST(conv_id AS VARCHAR)")} % 4 ELSE 0 END AS INTEGER) AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(o.t, [])[1:h], h.t[h + 1:]) AS t
      FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, CAST(d AS BIGINT) AS d, t[1:d] AS p, len(t) = d AS ends
      FROM b, unnest(range(0, len(t) + 1)) AS u(d)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x,
                  '[^\x20\x09-\x0D]+')) END AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                             FILTER (ends), '')) AS ends_sha256
      FROM p GROUP BY d, p),
c AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c ON c.d = n.d AND c.p = n.p),
s AS (SELECT k AS d, p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves,
             CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
      FROM l, unnest(range(0, d + 1)) AS u(k) GROUP BY ALL)
SELECT l.conv_id, l.d AS depth, f.conv_id AS parent_conv_id, l.n_convs, l.n_children,
       s.n_leaves, s.saved_tokens, l.ends_sha256
FROM l JOIN s ON s.d = l.d AND s.p = l.p LEFT JOIN n f ON f.d = l.d - 1 AND f.p = l.p[1:l.d - 1]""",
}
