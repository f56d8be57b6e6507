"""SQL of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM s1),
s3 AS (SELECT *, (SELECT arg_min(lvl, lim / w) FROM s2 WHERE lvl * w <= lim) AS fin FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN fin IS NULL OR lvl * w > lim OR fin * w > lim THEN lim ELSE fin * w END AS target FROM s3),
c AS (SELECT d.*, source_size, target, least(2.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS copies, (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p FROM c), r AS (SELECT *, CASE WHEN p > 0 THEN 1 / (1 + (p / (1 - p)) * (1 / u - 1)) END AS rank FROM p),
l AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
t AS (SELECT *, whole + CASE WHEN p > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END AS n FROM l)
SELECT doc_id, source, size, source_size, target, CAST(n AS BIGINT) AS copies, CAST(n * size AS BIGINT) AS taken FROM t"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 10 * g}, 10) AS BIGINT) >> {5 * i}) & 31 AS INTEGER) + 1, 1)" for g in range(4) for i in range(7, -1, -1))

WARC = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, coalesce(html, '') AS body FROM pages), f AS (SELECT body, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, n AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f USING (body)"""

_FITS = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULES = (("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("allow", "org/"))
_CASE = lambda k: "CASE " + " ".join(f"WHEN {_FITS(r.split('/', 1)[0], '/' + r.split('/', 1)[1])} THEN '{(v, r)[k]}'" for v, r in sorted(_RULES, key=lambda x: (-len(x[1]), x[1]))) + " END"
URLS = rf"""
WITH RECURSIVE a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, {_CASE(1)} AS rule, {_CASE(0)} AS v FROM b),
t AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
    CASE WHEN regexp_full_match(s, '(?:[0-9]+|[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?|[0-9a-fA-F-]{{16,}}|.*[0-9]{{3,}}.*)(?:\.[A-Za-z0-9]{{1,5}})?') THEN '*' ELSE s END) AS steps FROM r),
-- level by level, a name is a wildcard where more than 50 follow the same beginning
g AS (
  SELECT DISTINCT host, steps, 0::BIGINT AS i, []::VARCHAR[] AS done FROM t
  UNION ALL
  SELECT host, steps, i + 1, list_append(done, CASE WHEN count(DISTINCT steps[i + 1]) OVER (PARTITION BY host, done) > 50 THEN '*' ELSE steps[i + 1] END)
  FROM g WHERE i < len(steps)),
w AS (SELECT t.*, g.done FROM t JOIN g ON t.host = g.host AND t.steps = g.steps AND g.i = len(g.steps)),
leaf AS (SELECT host, done, count(v)::DOUBLE AS n, (count(*) FILTER (v = 'block'))::DOUBLE AS b FROM w GROUP BY 1, 2),
lv AS (
  SELECT host, done, n, b, i, done[1:i] AS parent, CASE WHEN i < len(done) THEN done[i + 1] ELSE '' END AS name
  FROM (SELECT *, unnest(range(0, len(done) + 1)) AS i FROM leaf)),
ch AS (SELECT host, parent, name, sum(n) AS n, sum(b) AS b FROM lv GROUP BY 1, 2, 3 HAVING sum(n) > 0),
eq AS (SELECT host, parent, b / n AS share, sum(n) AS n, sum(b) AS b, row_number() OVER (PARTITION BY host, parent ORDER BY b / n) AS k FROM ch GROUP BY 1, 2, 3),
-- names in order of their share of blocked urls; c counts the groups
cl AS (
  SELECT host, parent, k, 1 AS c, n, b FROM eq WHERE k = 1
  UNION ALL
  SELECT host, parent, k, CASE WHEN apart THEN c + 1 ELSE c END, CASE WHEN apart THEN n2 ELSE n + n2 END, CASE WHEN apart THEN b2 ELSE b + b2 END
  FROM (SELECT cl.host, cl.parent, eq.k, c, cl.n, cl.b, eq.n AS n2, eq.b AS b2, abs(cl.b / cl.n - eq.b / eq.n) >= 1.96 * sqrt(((cl.b + eq.b) / (cl.n + eq.n)) * (1 - (cl.b + eq.b) / (cl.n + eq.n)) * (1 / cl.n + 1 / eq.n)) AS apart
        FROM cl JOIN eq ON cl.host = eq.host AND cl.parent = eq.parent AND eq.k = cl.k + 1)),
gr AS (SELECT host, parent, c, max_by(n, k) AS gn, max_by(b, k) AS gb, max(c) OVER (PARTITION BY host, parent) AS groups FROM cl GROUP BY 1, 2, 3),
mem AS (
  SELECT ch.host, ch.parent, ch.name, gn, gb FROM ch
  JOIN eq ON ch.host = eq.host AND ch.parent = eq.parent AND ch.b / ch.n = eq.share
  JOIN cl ON cl.host = eq.host AND cl.parent = eq.parent AND cl.k = eq.k
  JOIN gr ON gr.host = cl.host AND gr.parent = cl.parent AND gr.c = cl.c WHERE gr.groups > 1),
h0 AS (SELECT host, sum(n) AS hn, sum(b) AS hb, regexp_extract(host, '([^.]*(?:\.[^.]*)?)$', 1) AS suffix FROM leaf GROUP BY 1),
su AS (SELECT suffix, sum(hn) AS sn, sum(hb) AS sb FROM h0 GROUP BY 1),
al AS (SELECT CASE WHEN sum(sn) > 0 THEN sum(sb) / sum(sn) ELSE 0 END AS prior FROM su),
h AS (SELECT h0.*, (hb + 4.0 * ((sb + 4.0 * prior) / (sn + 4.0))) / (hn + 4.0) AS hp FROM h0 JOIN su USING (suffix), al),
d AS (
  SELECT leaf.host, leaf.done, 0::BIGINT AS i, hp AS purity, hn AS support FROM leaf JOIN h ON leaf.host = h.host
  UNION ALL
  SELECT d.host, d.done, d.i + 1, CASE WHEN gn IS NULL THEN purity ELSE (gb + 4.0 * purity) / (gn + 4.0) END, coalesce(gn, support)
  FROM d JOIN lv ON lv.host = d.host AND lv.done = d.done AND lv.i = d.i LEFT JOIN mem ON mem.host = lv.host AND mem.parent = lv.parent AND mem.name = lv.name)
SELECT page_id, w.host, path, rule, coalesce(v, CASE WHEN purity >= 0.7 AND support >= 5 THEN 'block' ELSE 'allow' END) AS verdict,
  '/' || array_to_string(w.done, '/') AS template, round(purity, 6)::DOUBLE AS purity
FROM w JOIN d ON w.host = d.host AND w.done = d.done AND d.i = len(d.done) + 1"""

INTERACTIONS = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY 1),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS done
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (done | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & done <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & done = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r"""

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, pos, array_to_string(w[pos:pos + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1),
hit AS (SELECT r, pos FROM win JOIN first USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 50)) AS pos FROM hit),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT r, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, pos) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM x GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) AS p,
    1 + (1000000000 * (k.total + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 10"""

ORACLES = {
    "op2_mixing": MIXING, "op5_warc": WARC, "op6_url_filters": URLS,
    "op11_interactions": INTERACTIONS, "op12_substrings": SUBSTRINGS, "op13_divergence": DIVERGENCE,
}
