"""SQL that must give the same rows as the queries of the same name."""

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing_sources"] = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS.format('text')}) AS size, sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, CAST((r - 1) % 3 + 1 AS DOUBLE) AS w, 3.0 * source_size AS most FROM sources
), ordered AS (
  SELECT *, coalesce(sum(most) OVER before, 0) AS spent, (SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER before, 0) AS left_w,
    (SELECT sum(source_size) FROM weighted) AS total
  FROM weighted WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(CAST(total - spent AS DOUBLE) / left_w, spent) AS level FROM ordered WHERE most / w > (total - spent) / left_w
), rates AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(level, 1e300) * w) AS target FROM weighted, level
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM rates
), drawn AS (
  SELECT d.doc_id, d.size, r.*, k, CAST('0x' || substr(d.h, 1 + 8 * k, 8) AS BIGINT) / 4294967296.0 AS u
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, (SELECT CAST(unnest(range(8)) AS INTEGER) AS k)
), off AS (
  SELECT source, k, abs(max(target) - max(floor(rate) * source_size) - sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END)) AS off FROM drawn GROUP BY source, k
), pick AS (
  SELECT source, k FROM (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY off, k) AS r FROM off) WHERE r = 1
)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN pick p ON d.source IS NOT DISTINCT FROM p.source AND d.k = p.k
"""

ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _url_sql() -> str:
    level = "SELECT *, '' AS template FROM paths"
    parts = [f"level0 AS ({level})"]
    for k in range(4):
        parts.append(f"""
child{k} AS (SELECT host, template, segments[{k + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM level{k} WHERE len(segments) > {k} GROUP BY ALL),
node{k} AS (SELECT host, template, sum(n) AS node_n, CAST(sum(labelled) AS DOUBLE) AS nl, CAST(sum(blocked) AS DOUBLE) AS nb FROM child{k} GROUP BY ALL),
kept{k} AS (SELECT c.host, c.template, c.segment FROM child{k} c JOIN node{k} USING (host, template)
  WHERE n >= 8 AND n >= 0.01 * node_n AND (labelled = 0 OR (nl > labelled
    AND pow(blocked * (nl - labelled) - (nb - blocked) * labelled, 2) > 2.576 * 2.576 * (nb / nl) * (1 - nb / nl) * nl * labelled * (nl - labelled)))),
level{k + 1} AS (SELECT l.* REPLACE (l.template || CASE WHEN len(segments) <= {k} THEN '' WHEN x.segment IS NOT NULL THEN '/' || x.segment ELSE '/*' END AS template)
  FROM level{k} l LEFT JOIN kept{k} x ON l.host = x.host AND l.template = x.template AND l.segments[{k + 1}] = x.segment)""")
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM parsed
), decided AS (
  SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM ruled
), paths AS (
  SELECT host, shape, list_filter(string_split(shape, '/'), lambda x: x <> '') AS segments, count(*) AS n, count(ruled) AS labelled,
    count(*) FILTER (ruled = 'block') AS blocked FROM decided GROUP BY host, shape
), {",".join(parts)}, named AS (
  SELECT host, shape, template || CASE WHEN len(segments) > 4 THEN '/**' ELSE '' END AS template, n, labelled, blocked FROM level4
), pure AS (
  SELECT host, template, sum(labelled) + CAST(4 AS DOUBLE) AS m,
    (sum(blocked) + 4 * coalesce((SELECT sum(blocked) / nullif(sum(labelled), 0) FROM paths), 0)) / (sum(labelled) + CAST(4 AS DOUBLE)) AS purity
  FROM named GROUP BY host, template
), bounded AS (
  SELECT *, (purity + z * z / (2 * m) - z * sqrt(purity * (1 - purity) / m + z * z / (4 * m * m))) / (1 + z * z / m) AS least FROM pure, (SELECT CAST(2.576 AS DOUBLE) AS z)
)
SELECT page_id, host, path, rule, template, CASE WHEN ruled IS NOT NULL THEN ruled WHEN least >= 0.8 THEN 'block' ELSE 'allow' END AS verdict
FROM decided JOIN named USING (host, shape) JOIN bounded USING (host, template)
"""


ORACLES["op4_url_filters"] = _url_sql()


ORACLES["op1_ngram_jaccard"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM worded)
), sized AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(node, other) AS (
  SELECT a, b FROM sides UNION SELECT r.node, t.b FROM reached r JOIN sides t ON r.other = t.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized s USING (doc_id) LEFT JOIN (SELECT node, min(other) AS low FROM reached GROUP BY node) c ON c.node = d.doc_id
"""

ORACLES["op8_substring_dedup"] = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM worded WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE doc_id > low
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM later) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, len(coalesce(ps, [])) AS k, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS words
  FROM worded LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n AS n_words, k AS n_removed, sha256(coalesce(array_to_string(words, ' '), '')) AS kept_sha256 FROM kept
"""

ORACLES["op12_filter_audit"] = r"""
WITH measured AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS low FROM measured GROUP BY t
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM measured JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL
), letters AS (
  SELECT unnest(range(1, 6)) AS i
), perms AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM perms
), judged AS (
  SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, f[o[step]] AS fails,
    len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS alone
  FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""

# The given pages hold their main text in one article element of headings and paragraphs.
ORACLES["op11_html_extraction"] = r"""
WITH main AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages
), plain AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:h1|p)>'), lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS b FROM main
), decoded AS (
  SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS b FROM plain
), joined AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS text FROM decoded
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM joined
"""
