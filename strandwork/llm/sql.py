"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .embedding_dedup import COSINE
from .line_dedup import MIN_WORDS as MIN_RUN
from .mixing import BLOCK, REPEATS, SHARE, WEIGHTS
from .quality_rules import BANDS, CLASSES, COMMON, FAR_CHARS, FAR_WORDS, LEAST_CHARS, LEAST_WORDS, MAX_CHARS, MAX_WORDS, MIN_BAND, MIN_REFERENCE, MIN_WORDS, QUARTILE
from .source_divergence import BETWEEN, MIN_DOCS, SCALE, TOP

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    a, b = f"({p}[i] / nullif(list_sum({p}), 0)::DOUBLE)", f"({q}[i] / nullif(list_sum({q}), 0)::DOUBLE)"
    half = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(a)} + {half(b)})) / 2, 0)), 6) END"


QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams FROM d),
u AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM u) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
b AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
   list_transform({COMMON!r}, lambda k: len(list_filter(w, lambda x: lower(x) = k))::BIGINT) AS c,
   array_to_string(w, '') AS bare
  FROM g LEFT JOIN c USING (doc_id)),
h AS (
  SELECT * EXCLUDE (c, bare), list_append(c, n_words - list_sum(c)::BIGINT) AS common,
   length(bare) - length(regexp_replace(bare, '\p{{Ll}}', '', 'g')) AS lo, length(bare) - length(regexp_replace(bare, '\p{{Lu}}', '', 'g')) AS up,
   length(bare) - length(regexp_replace(bare, '[0-9]', '', 'g')) AS di, length(bare) - length(regexp_replace(bare, '[.,;:!?''"()-]', '', 'g')) AS ma
  FROM b),
f AS (SELECT *, [lo, up, di, ma, n_symbols, word_chars - lo - up - di - ma - n_symbols]::BIGINT[] AS chars FROM h),
s AS (
  SELECT lang AS ref_lang, sum(n_words) AS ref_words, [{', '.join(f'sum(chars[{i + 1}])' for i in range(len(CLASSES)))}]::BIGINT[] AS ref_chars,
   [{', '.join(f'sum(common[{i + 1}])' for i in range(len(COMMON) + 1))}]::BIGINT[] AS ref_common
  FROM f GROUP BY GROUPING SETS ((lang), ()) HAVING lang IS NOT NULL OR grouping(lang) = 1),
j AS (SELECT f.*, ref_words, {_distance('chars', 'ref_chars')} AS chars_js, {_distance('common', 'ref_common')} AS words_js FROM f LEFT JOIN s ON f.lang IS NOT DISTINCT FROM s.ref_lang),
-- limits: median and quartiles of the distances, by language and half octave of length; copies count once
o AS (SELECT DISTINCT lang, n_words, floor(log2(n_words) * {BANDS}) AS band, chars_js, words_js FROM j WHERE n_words >= {MIN_WORDS} AND ref_words >= {MIN_REFERENCE}),
q AS (
 SELECT lang, band, grouping(lang) = 1 AS whole, count(*) AS docs, quantile_cont(round(chars_js, 4), [0.25, 0.5, 0.75]) AS c, quantile_cont(round(words_js, 4), [0.25, 0.5, 0.75]) AS w
 FROM (SELECT * FROM o WHERE lang IS NOT NULL) GROUP BY GROUPING SETS ((lang, band), (band))
 UNION ALL SELECT NULL, band, false, count(*), quantile_cont(round(chars_js, 4), [0.25, 0.5, 0.75]), quantile_cont(round(words_js, 4), [0.25, 0.5, 0.75]) FROM o WHERE lang IS NULL GROUP BY band),
t AS (
 SELECT lang, band, whole, CASE WHEN docs >= {MIN_BAND} THEN c[2] + {FAR_CHARS} * greatest((c[3] - c[2]) / {QUARTILE}, {LEAST_CHARS} * c[2]) END AS far_chars,
  CASE WHEN docs >= {MIN_BAND} THEN w[2] + {FAR_WORDS} * greatest((w[2] - w[1]) / {QUARTILE}, {LEAST_WORDS} * w[2]) END AS far_words FROM q),
v AS (SELECT lang, band, last_value(far_chars IGNORE NULLS) OVER k AS far_chars, last_value(far_words IGNORE NULLS) OVER k AS far_words FROM t WHERE NOT whole WINDOW k AS (PARTITION BY lang ORDER BY band)),
m AS (SELECT v.lang, v.band, coalesce(v.far_chars, CASE WHEN v.lang IS NOT NULL THEN t.far_chars END) AS far_chars, coalesce(v.far_words, CASE WHEN v.lang IS NOT NULL THEN t.far_words END) AS far_words FROM v LEFT JOIN t ON t.whole AND t.band = v.band)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars_js, words_js,
 n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(n_words >= {MIN_WORDS} AND ref_words >= {MIN_REFERENCE} AND (chars_js > least({MAX_CHARS}, coalesce(far_chars, {MAX_CHARS})) OR words_js > least({MAX_WORDS}, coalesce(far_words, {MAX_WORDS}))), false) AS kept
FROM j LEFT JOIN m ON j.lang IS NOT DISTINCT FROM m.lang AND m.band = CASE WHEN n_words > 0 THEN floor(log2(n_words) * {BANDS}) END
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ({list(WEIGHTS)!r})[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {REPEATS}::DOUBLE AS cap FROM s),
-- the level of water: the only one at which min(cap, level * weight) adds up to the mix, found from the caps below it
c AS (SELECT a.weight, a.cap, a.source, ({SHARE} * (SELECT sum(source_size) FROM w)::DOUBLE - coalesce((SELECT sum(b.cap) FROM w b WHERE b.cap / b.weight < a.cap / a.weight), 0)) / (SELECT sum(b.weight) FROM w b WHERE b.cap / b.weight >= a.cap / a.weight) AS level FROM w a),
l AS (SELECT max(level) AS level FROM c WHERE level * weight <= cap),
t AS (SELECT w.source, source_size, round(least(cap, coalesce(level * weight, cap)), 6) AS target FROM w, l),
m AS (SELECT ceil(sum(target))::BIGINT AS mix FROM t),
n AS (SELECT mix, {BLOCK} AS block, (mix + {BLOCK - 1}) // {BLOCK} AS slots, greatest(1, length(bin((mix + {BLOCK - 1}) // {BLOCK} - 1))) AS bits FROM m),
p AS (SELECT source, ceil(source_size / block::DOUBLE)::BIGINT AS blocks, (sum(target) OVER (ORDER BY source NULLS LAST) - target) / mix AS low FROM t, n WHERE target > 0),
q AS (SELECT source, blocks, low, coalesce(lead(low) OVER (ORDER BY low), 2) AS high FROM p),
k AS (SELECT k, list_sum(list_transform(range(0, bits), lambda i: ((k >> i) & 1) << (bits - 1 - i)))::DOUBLE / (1 << bits) AS point FROM n, (SELECT unnest(range(0, slots)) AS k FROM n)),
r AS (SELECT q.source, blocks, k, row_number() OVER (PARTITION BY q.source ORDER BY k) - 1 AS rank FROM k JOIN q ON point >= low AND point < high),
u AS (SELECT source, rank % blocks AS block_no, count(*) AS times, min(k) AS first FROM r WHERE rank < blocks * {REPEATS} GROUP BY 1, 2),
e AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
x AS (SELECT e.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM e, n WHERE size > 0),
y AS (SELECT doc_id, x.source, start, sum((least(start + size, (x.block_no + 1) * block) - greatest(start, x.block_no * block)) * times) AS taken, min(first) AS first_slot, sum(times)::BIGINT AS n_slots FROM x JOIN u ON x.source IS NOT DISTINCT FROM u.source AND x.block_no = u.block_no GROUP BY 1, 2, 3),
-- what the schedule's blocks lack or have over the target, word for word: places of the stream, counted over the passes, that are taken still or given back
g AS (SELECT e.source, sum(coalesce(taken, 0))::BIGINT AS done FROM e LEFT JOIN y ON e.doc_id = y.doc_id AND e.start = y.start AND e.source IS NOT DISTINCT FROM y.source AND e.size > 0 GROUP BY 1),
z AS (SELECT t.*, done, least(round(target)::BIGINT, source_size * {REPEATS}) AS goal FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT e.doc_id, e.size, z.source_size, z.target,
 (coalesce(taken, 0) + sign(goal - done) * list_sum(list_transform(range(0, {REPEATS}), lambda i: greatest(0, least(e.start + size, greatest(done, goal) - i * source_size) - greatest(e.start, least(done, goal) - i * source_size)))))::BIGINT AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM e JOIN z ON e.source IS NOT DISTINCT FROM z.source LEFT JOIN y ON e.doc_id = y.doc_id AND e.start = y.start AND e.source IS NOT DISTINCT FROM y.source AND e.size > 0
"""

#: All pairs that share a shingle, counted exactly, and components by recursion.
NEAR = rf"""
SELECT * FROM (
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
u AS (SELECT doc_id, unnest(sh) AS x FROM g),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id))
"""

#: Runs of the fewest lines with enough words, from each line on and up to each line, by their text.
LINES = rf"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(parts))) AS no, unnest(parts) AS line FROM d),
k AS (SELECT *, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM k WHERE n > 0),
s AS (
 SELECT a.doc_id, a.i AS i, min(b.i) AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + {MIN_RUN} AND b.upto >= a.upto - a.n + {MIN_RUN} GROUP BY 1, 2
 UNION SELECT b.doc_id, max(a.i), b.i FROM w b JOIN w a ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - {MIN_RUN} AND b.i AND b.upto >= a.upto - a.n + {MIN_RUN} GROUP BY b.doc_id, b.i),
t AS (SELECT s.doc_id, s.i, s.j, min(w.no) AS no, string_agg(line, chr(10) ORDER BY w.i) AS name FROM s JOIN w ON w.doc_id = s.doc_id AND w.i BETWEEN s.i AND s.j GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, no) AS r FROM t),
x AS (SELECT DISTINCT w.doc_id, w.no FROM f JOIN w ON w.doc_id = f.doc_id AND w.i BETWEEN f.i AND f.j WHERE r > 1),
o AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) FILTER (x.no IS NULL) AS left_text, count(*)::BIGINT AS n_lines, count(x.no)::BIGINT AS n_removed FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.no = l.no GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_text, '') END AS text, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed FROM d JOIN o USING (doc_id)
"""

#: All pairs of a label in doubles; -1 as the label of what can't link.
VECTORS = f"""
SELECT * FROM (
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
k AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id))
"""

#: All groups with all kept terms of their language, and all pairs of them.
DIVERGENCE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM u GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, (1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s))::BIGINT AS p FROM a WINDOW s AS (PARTITION BY lang, source)),
w AS (SELECT lang, term, (1 + ({SCALE}::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) WINDOW s AS (PARTITION BY lang)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
h AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
t AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN w ON w.lang = p.lang AND w.term = p.term WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM h
UNION ALL SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM t) WHERE rank <= {TOP}
"""

ORACLES = {"op2_quality_rules": QUALITY, "op4_near_dedup": NEAR, "op6_mixing": MIXING, "op7_line_dedup": LINES, "op10_embedding_dedup": VECTORS, "op11_source_divergence": DIVERGENCE}
