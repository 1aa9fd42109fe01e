"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         row_number() OVER () AS r
  FROM documents),
classes AS (
  SELECT *, [length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')), length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')),
             length(regexp_replace(text, '[^0-9]+', '', 'g')), length(regexp_replace(text, '[^.,;:!?]+', '', 'g')),
             length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g'))] AS six
  FROM rows),
counted AS (SELECT *, list_concat(six, [length(text) - list_sum(six)::BIGINT]) AS c FROM classes),
bins AS (SELECT r, lang, unnest(c) AS n, unnest(range(6)) AS k FROM counted),
windows AS (SELECT r, i, list_slice(words, i, i + 7) AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM rows WHERE len(words) > 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + o) AS n FROM again, range(8) AS t(o) GROUP BY r),
sound AS (SELECT rows.r FROM rows LEFT JOIN repeats p USING (r) WHERE NOT (len(words) < 20 OR 100 * coalesce(p.n, 0) > 30 * len(words))),
ref_bins AS (SELECT lang, k, sum(n) AS n FROM bins SEMI JOIN sound USING (r) GROUP BY lang, k),
vocabulary AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM rows SEMI JOIN sound USING (r)) GROUP BY lang, word),
totals AS (SELECT lang, sum(n) AS total FROM vocabulary GROUP BY lang),
listed AS (
  SELECT lang, word
  FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k
    FROM (SELECT DISTINCT r, lang, unnest(words) AS word FROM rows) WHERE regexp_full_match(word, '[\p{Ll}\p{Lo}]{1,4}') GROUP BY lang, word)
  WHERE k <= 16),
common AS (SELECT l.lang, l.word, coalesce(v.n, 0) AS n FROM listed l LEFT JOIN vocabulary v USING (lang, word)),
ref_words AS (
  SELECT lang, word, n FROM common
  UNION ALL
  SELECT t.lang, NULL, t.total - coalesce((SELECT sum(n) FROM common c WHERE c.lang = t.lang), 0) FROM totals t),
doc_words AS (
  SELECT d.r, d.lang, c.word, count(*) AS n
  FROM (SELECT r, lang, unnest(words) AS w FROM rows) d LEFT JOIN common c ON c.lang = d.lang AND c.word = d.w
  GROUP BY ALL),
word_pairs AS (
  SELECT d.r, w.n::DOUBLE / sum(w.n) OVER (PARTITION BY d.r) AS q, coalesce(x.n, 0)::DOUBLE / sum(coalesce(x.n, 0)) OVER (PARTITION BY d.r) AS p
  FROM (SELECT DISTINCT r, lang FROM doc_words) d JOIN ref_words w USING (lang)
  LEFT JOIN doc_words x ON x.r = d.r AND x.word IS NOT DISTINCT FROM w.word),
class_pairs AS (
  SELECT b.r, w.n::DOUBLE / sum(w.n) OVER (PARTITION BY b.r) AS q, b.n::DOUBLE / sum(b.n) OVER (PARTITION BY b.r) AS p
  FROM bins b JOIN ref_bins w ON w.lang = b.lang AND w.k = b.k
  WHERE b.r IN (SELECT r FROM counted WHERE length(text) > 0)),
word_distance AS (
  SELECT r, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS d
  FROM word_pairs GROUP BY r),
class_distance AS (
  SELECT r, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS d
  FROM class_pairs GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows),
dup_lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
joined AS (
  SELECT c.doc_id, len(c.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(c.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         six[1]::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         CASE WHEN coalesce(t.total, 0) >= 5000 AND length(c.text) >= 300 THEN cd.d END AS class_distance,
         CASE WHEN coalesce(t.total, 0) >= 5000 AND len(c.words) >= 50 THEN wd.d END AS word_distance
  FROM counted c LEFT JOIN totals t USING (lang) LEFT JOIN dup_lines l USING (r) LEFT JOIN repeats p USING (r)
  LEFT JOIN class_distance cd USING (r) LEFT JOIN word_distance wd USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= 0.28 AND coalesce(word_distance, 0) <= 0.312
         AND NOT (coalesce(class_distance, 0) > 0.125 AND coalesce(word_distance, 0) > 0.27) AS kept, class_distance, word_distance
FROM based
"""


LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, i, lines[i + 1] AS line, len(regexp_extract_all(lines[i + 1], '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM docs)),
summed AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM numbered),
-- all runs from a line with words to the first line, or to a line from the last line, that makes 50 words
spans AS (
  SELECT x.doc_id, x.i AS a, min(y.i) AS z FROM summed x JOIN summed y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 50
  WHERE x.n > 0 GROUP BY ALL
  UNION
  SELECT y.doc_id, max(x.i) AS a, y.i AS z FROM summed y JOIN summed x ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 50
  WHERE y.n > 0 GROUP BY y.doc_id, y.i),
runs AS (SELECT s.doc_id, a, z, array_to_string(d.lines[a + 1:z + 1], chr(10)) AS run FROM spans s JOIN docs d USING (doc_id)),
firsts AS (SELECT run, min({'d': doc_id, 'a': a}) AS f FROM runs GROUP BY run),
later AS (SELECT r.doc_id, a, z FROM runs r JOIN firsts USING (run) WHERE {'d': doc_id, 'a': a} > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later),
rest AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS kept, count(*) AS n_lines, count(g.i) AS n_removed
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN n_removed = 0 THEN d.text ELSE coalesce(kept, '') END AS text, n_lines, n_removed
FROM docs d JOIN rest USING (doc_id)
"""


#: 13 words with 2 substituted hold 4 in a row that agree, so those find all diagonals to be compared.
DECONTAMINATION = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
listed AS (
  SELECT kind, id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', '', 'g'), '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT kind, id, p, array_to_string(w[p:p + 3], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 2)) AS p FROM listed WHERE len(w) > 3)),
diagonals AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.p - i.p AS o
  FROM grams d JOIN grams i ON d.gram = i.gram WHERE d.kind = 'd' AND i.kind = 'i'),
lined AS (
  SELECT g.*, d.w AS dw, i.w AS iw, least(13, len(i.w)) AS width
  FROM diagonals g JOIN listed d ON d.kind = 'd' AND d.id = g.doc_id JOIN listed i ON i.kind = 'i' AND i.id = g.item_id WHERE len(i.w) >= 5),
places AS (
  SELECT doc_id, item_id, o, width, p, CASE WHEN dw[p + o] = iw[p] THEN 1 ELSE 0 END AS same
  FROM (SELECT *, unnest(range(greatest(1, 1 - o), least(len(iw), len(dw) - o) + 1)) AS p FROM lined)),
windowed AS (
  SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, o ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS s13,
         count(*) OVER (PARTITION BY doc_id, item_id, o ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n13,
         sum(same) OVER (PARTITION BY doc_id, item_id, o) AS s_all, count(*) OVER (PARTITION BY doc_id, item_id, o) AS n_all
  FROM places),
good AS (
  SELECT doc_id, item_id, o, width, p FROM windowed
  WHERE width = 13 AND n13 = 13 AND s13 >= 11 OR width < 13 AND n_all = width AND s_all = width AND p = 1),
covered AS (SELECT DISTINCT doc_id, item_id, o, unnest(range(p, p + width)) AS p FROM good),
sized AS (
  SELECT c.doc_id, c.item_id, c.o, sum(w.same) AS m, count(*) AS n, min(c.p) AS p
  FROM covered c JOIN places w ON w.doc_id = c.doc_id AND w.item_id = c.item_id AND w.o = c.o AND w.p = c.p GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, n, p + o, p) AS k FROM sized)
SELECT doc_id, item_id, m::BIGINT AS matched_words, n::BIGINT AS overlap_words, (p + o - 1)::BIGINT AS doc_start, (p - 1)::BIGINT AS item_start
FROM ranked WHERE k = 1
"""


WARC = r"""
WITH headers AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
digested AS (
  SELECT page_id, n, translate(concat(
    to_base(('0x' || h[1:10])::UBIGINT::BIGINT, 32, 8), to_base(('0x' || h[11:20])::UBIGINT::BIGINT, 32, 8),
    to_base(('0x' || h[21:30])::UBIGINT::BIGINT, 32, 8), to_base(('0x' || h[31:40])::UBIGINT::BIGINT, 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS d
  FROM headers),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM digested)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM ranked
"""

#: All pairs of different texts with a shingle in common are compared; a class is what links reach.
NGRAM_JOIN = r"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
listed AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM listed),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS id, least(a, min(b)) AS class_id FROM reached GROUP BY a),
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, t.id, d.doc_id) AS class_id, coalesce(t.id, d.doc_id) AS copy_id, coalesce(g.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN texts t ON t.text = d.text LEFT JOIN classes c ON c.id = t.id LEFT JOIN degrees g ON g.id = t.id
"""

#: The parts of a rendered turn besides role and text: 6 + 2 quotes + 1 + 8, and 8 for the mark of an escaped one.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 6 + 2 + length(role) + 1 + length(text) + 8
    + CASE WHEN contains(text, '</turn') OR contains(text, '<turn') THEN 8 + length(text) - length(replace(replace(text, '\', ''), '<', '')) ELSE 0 END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: Scores of all pairs of an anchor and a row; whole numbers, which doubles hold exactly.
HARD_NEGATIVES = r"""
WITH whole AS (
  SELECT DISTINCT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, s FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5),
pairs AS (
  SELECT p.anchor_id, positive_id, n.other AS negative_id, p.s AS positive_score, n.s AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.s DESC, n.other)::INTEGER AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 3
"""


def _codes(rounds: int = 2) -> str:
    """Rows are (row, part, components); a codebook is (part, entry, components). All numbers are whole."""
    near = "SELECT r, p.part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (SELECT p.r, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM parts p JOIN book{k} b USING (part)) p GROUP BY r, p.part"
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({near.format(k=k)})")
        steps.append(f"""means{k} AS (SELECT n.part, n.entry, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM near{k} n JOIN parts p USING (r, part), range(1, 5) AS t(i) GROUP BY ALL)""")
        steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b
  LEFT JOIN (SELECT part, entry, list(m::BIGINT ORDER BY i) AS v FROM means{k} GROUP BY ALL) m USING (part, entry))""")
    steps.append(f"near{rounds} AS MATERIALIZED ({near.format(k=rounds)})")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT r, part, v[4 * part + 1:4 * part + 4] AS v FROM whole, range(16) AS t(part)),
book0 AS MATERIALIZED (SELECT part, r AS entry, v FROM parts WHERE r < 64),
{", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS s FROM book{rounds}),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{rounds} JOIN whole USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, sha
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op2_warc_revisits": WARC, "op3_ngram_join": NGRAM_JOIN, "op7_chat_formatting": CHAT, "op10_decontamination": DECONTAMINATION, "op6_quality_rules": QUALITY, "op12_hard_negatives": HARD_NEGATIVES, "op13_vector_codes": _codes()}
