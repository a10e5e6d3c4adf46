"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express.

Each query is thin: it applies one operator, with its production parameters, to a whole table.
"""

from __future__ import annotations

from corpusmill.llm.common import table
from corpusmill.llm.divergence import source_divergence
from corpusmill.llm.exact_dedup import exact_dedup
from corpusmill.llm.hash_forest import nearest
from corpusmill.llm.langid import language_id
from corpusmill.llm.media import document_media
from corpusmill.llm.mixing import mix_sources
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.pii import find_personal_data
from corpusmill.llm.quality import quality
from corpusmill.llm.simhash import near_duplicates
from corpusmill.llm.spelling import spelling_variants
from corpusmill.llm.toxicity import toxicity
from corpusmill.llm.url_filters import judge_urls

#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_url_filters(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), certified=True, chunk=8_000_000, cache=450_000)


def op5_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_media(spark, sf_dir):
    return document_media(table(spark, sf_dir, "documents"))


def op8_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_hash_prefix_forest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w
  FROM docs GROUP BY source),
budget AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM sources),
levels AS (
  SELECT 0 AS round, CAST(-1 AS BIGINT) AS before, CAST(0 AS BIGINT) AS capped, (SELECT total * 1.5::DOUBLE / (SELECT sum(w) FROM sources) FROM budget) AS level
  UNION ALL
  SELECT * FROM (
    SELECT l.round + 1, l.capped, count(*) FILTER (WHERE s.w * l.level > 2 * s.source_size),
           (any_value(b.total) * 1.5::DOUBLE - coalesce(sum(2 * s.source_size) FILTER (WHERE s.w * l.level > 2 * s.source_size), 0)) / nullif(sum(CASE WHEN s.w * l.level > 2 * s.source_size THEN 0.0::DOUBLE ELSE s.w END), 0)
    FROM levels l, sources s, budget b WHERE l.capped <> l.before AND l.level IS NOT NULL GROUP BY l.round, l.capped) t),
final AS (SELECT level FROM levels ORDER BY round DESC LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL OR w * f.level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * f.level END AS target
  FROM sources, final f),
queued AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, coalesce('s' || d.source, 't') AS k, md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size) AS upto
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
items AS (
  SELECT doc_id, size, k, h, p, CAST(upto + p * source_size AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1)) passes(p) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, k, p, h, doc_id NULLS FIRST, size) AS running FROM items),
fits AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM ordered, budget b WHERE running <= least(b.total * 1.5, 2.0 * b.total) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(f.taken, 0) AS taken FROM queued q LEFT JOIN fits f ON q.doc_id IS NOT DISTINCT FROM f.doc_id
"""

_OP9 = f"""
WITH rows AS (SELECT doc_id, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM rows WINDOW w AS (PARTITION BY t)
"""

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mix_sources": op5_mix_sources,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_personal_data": op8_personal_data,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hash_prefix_forest": op12_hash_prefix_forest,
    "op13_source_divergence": op13_source_divergence,
}

_UPPER, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _sql_attribute(name: str) -> str:
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3)) + ")"


_OP1 = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM pages WHERE position('://' IN url) > 0),
said AS (
  SELECT url, {_sql_attribute("href")} AS t FROM tags WHERE lower(tag[2:5]) = 'link' AND regexp_matches(lower({_sql_attribute("rel")}), '(^|\s)canonical(\s|$)')
  UNION ALL SELECT url, regexp_extract({_sql_attribute("content")}, '(?i)url\s*=\s*[''"]?([^''"]+)', 1) FROM tags WHERE lower(tag[2:5]) = 'meta' AND lower(trim({_sql_attribute("http-equiv")})) = 'refresh'),
places AS (
  SELECT url, replace(trim(t), '&amp;', '&') AS t, split_part(url, '://', 1) AS scheme, split_part(url, '://', 1) || '://' || regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') AS base,
         regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM said),
raw AS (
  SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '/') THEN base || t WHEN starts_with(t, '?') OR starts_with(t, '#') THEN base || path || t
    ELSE base || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || t END AS b FROM places),
rest AS (SELECT url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM (SELECT url FROM pages UNION SELECT b FROM raw)),
parts AS (
  SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER}, {_LOW}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM rest),
judged AS (
  SELECT x.url, any_value(x.host) AS host, any_value(x.path) AS path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS own,
         any_value(CASE WHEN position('://' IN x.url) > 0 THEN translate(split_part(x.url, '://', 1), {_UPPER}, {_LOW}) || '://' || x.host || CASE WHEN x.tail = '' THEN '/' ELSE x.tail END END) AS k
  FROM parts x LEFT JOIN rules r ON (x.host = r.h OR ends_with(x.host, '.' || r.h)) AND starts_with(x.path, r.p) GROUP BY x.url),
edges AS (
  SELECT a.k AS u, b.k AS v, a.own = 'block' AS block_u, b.own = 'block' AS block_v FROM raw JOIN judged a ON raw.a = a.url JOIN judged b ON raw.b = b.url WHERE a.k <> b.k),
links AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
bad AS (
  SELECT u AS k FROM edges WHERE block_u UNION SELECT v FROM edges WHERE block_v
  UNION SELECT l.v FROM bad JOIN links l ON bad.k = l.u)
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.own, CASE WHEN b.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, b.k IS NOT NULL AS blocked_alias
FROM pages p JOIN judged j ON p.url IS NOT DISTINCT FROM j.url LEFT JOIN (SELECT DISTINCT k FROM bad) b ON j.k = b.k
"""

#: crc32 bit by bit; near words by one place left out or replaced.
_OP11 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295::UBIGINT, list_reduce(
    flatten(list_transform(range(0, length(h), 2), lambda i: [CAST('0x' || substr(h, i + 1, 2) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, e: xor(xor(c, e) >> 1, 3988292384::UBIGINT * (xor(c, e) & 1)), 4294967295::UBIGINT)) AS crc
  FROM (SELECT run, k, hex(encode(doc || ':' || run)) AS h FROM runs)),
told AS (
  SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
vocab AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM told GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab),
replaced AS (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM places),
deleted AS (SELECT DISTINCT p.word, v.word AS near FROM places p JOIN vocab v ON v.word = substr(p.word, 1, p.i - 1) || substr(p.word, p.i + 1)),
near AS (
  SELECT a.word, b.word AS near FROM replaced a JOIN replaced b ON a.k = b.k AND a.word <> b.word
  UNION SELECT word, near FROM deleted UNION SELECT near, word FROM deleted),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS form, max(m) AS form_n FROM (SELECT x.word, x.near, v.n AS m FROM near x JOIN vocab v ON x.near = v.word) GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * v.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * v.n THEN b.form_n END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
steps AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word) s USING (word)
"""

#: Each language's kept terms in every group, their shares, and all pairs of groups.
_OP13 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, {_LOWER} AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY ALL HAVING sum(d) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
  SELECT d.*, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM dense d JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50
"""

ORACLE_SQL = {"op1_url_filters": _OP1, "op5_mix_sources": _OP5, "op9_exact_dedup": _OP9, "op11_spelling_variants": _OP11, "op13_source_divergence": _OP13}
