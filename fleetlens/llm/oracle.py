"""Results of this package's queries as plain SQL over the given tables, written apart from the operators."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

# Listed rules as (name, host, path, verdict); of the fitting ones the longest counts.
LISTED = """
    listed(rule, rule_host, rule_path, listed_verdict) AS (
        VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
               ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
               ('com/de/', 'com', '/de/', 'block'))"""

LONG_SUFFIXES = """ac.uk co.uk gov.uk net.uk org.uk com.au net.au org.au co.nz co.za co.jp ne.jp or.jp co.kr co.in com.br com.mx
com.ar com.cn com.hk com.sg com.tr com.tw""".split()


def _level(above: str, level: str, keys: list[str]) -> str:
    """Posterior mean and weight of each group, from the means of the groups above."""
    by, up = ", ".join(keys), ", ".join(keys[:-1])
    return f"""
    {level}_sums AS (
        SELECT {by}, sum(n) AS n, sum(k) AS k, any_value(prior) AS p
        FROM counts JOIN (SELECT {up}, mean AS prior FROM {above}_mean) a USING ({up}) GROUP BY {by}),
    {level}_rho AS (
        SELECT greatest(0.001, least(0.5, coalesce(sum((k - n * p) * (k - n * p) / (p * (1 - p)) - n)
                                                   / nullif(sum(n * (n - 1)), 0), 0.5))) AS rho FROM {level}_sums),
    {level}_mean AS (
        SELECT {by}, (p * (1 / rho - 1) + k) / (1 / rho - 1 + n) AS mean, 1 / rho - 1 + n AS weight
        FROM {level}_sums, {level}_rho)"""


# Frequent words of four languages, as the rule on stop words knows them.
STOP_WORDS = """the of and to a in is that for with was it this are from have der die das und ist nicht von zu mit ein eine auf
im den des le la les et de un une est que qui dans pour du en sur el los las y una es por con para del se""".split()

OP3 = rf"""
WITH given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (
        SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
        FROM given),
    placed AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM cut),
    triples AS (
        SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL),
    repeated AS (
        SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS step(k) WHERE twice.n > 1 GROUP BY r),
    by_word AS (
        SELECT r, sum(length(w)) AS word_chars, count(*) FILTER (NOT regexp_matches(w, '\p{{L}}')) AS plain,
               count(*) FILTER (regexp_full_match(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '({"|".join(STOP_WORDS)})[.,;:!?]*')) AS stop
        FROM placed GROUP BY r),
    counted AS (
        SELECT doc_id, len(words) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(repeated.n, 0) AS n_repeat_words, coalesce(plain, 0) AS plain, coalesce(stop, 0) AS stop,
               len(regexp_extract_all(t, '\p{{Lu}}')) AS upper_chars, len(lines) AS n_lines,
               len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS bullets,
               len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*\z'))) AS ellipses
        FROM cut LEFT JOIN by_word USING (r) LEFT JOIN repeated USING (r)),
    ruled AS (
        SELECT *, concat_ws(',', CASE WHEN n_words < 50 THEN 'few_words' END,
            CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 'repeated_windows' END,
            CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 'word_length' END,
            CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END,
            CASE WHEN 100 * stop < n_words THEN 'stop_words' END,
            CASE WHEN 10 * plain > 3 * n_words THEN 'words_without_letter' END,
            CASE WHEN 10 * upper_chars > 3 * word_chars THEN 'capitals' END,
            CASE WHEN 2 * n_dup_lines > n_lines THEN 'duplicate_lines' END,
            CASE WHEN 10 * bullets > 9 * n_lines THEN 'bullet_lines' END,
            CASE WHEN 10 * ellipses > 3 * n_lines THEN 'ellipsis_lines' END) AS failed
        FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = '' AS kept, failed
FROM ruled"""


OP6 = rf"""
WITH addressed AS (
        SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
        FROM pages),
    shown AS (
        SELECT host, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'),
                                    '<[^>]*>', ' ', 'g') AS t
        FROM addressed),
    judged AS (
        SELECT host, NOT (10 * len(regexp_extract_all(t, '[#*$%&|<>]')) > len(regexp_extract_all(t, '{WORD}'))
                          OR len(regexp_extract_all(t, '[A-Z]')) > len(regexp_extract_all(t, '[a-z]'))) AS good
        FROM shown WHERE len(regexp_extract_all(t, '{WORD}')) > 0),
    named AS (
        SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS labels, count(*) AS n,
               CAST(sum(CAST(good AS INT)) AS BIGINT) AS k
        FROM judged GROUP BY host),
    counts AS (
        SELECT host, n, k, '' AS everything, array_to_string(labels[-s:], '.') AS suffix, array_to_string(labels[-s - 1:], '.') AS domain
        FROM (SELECT *, CASE WHEN array_to_string(labels[-2:], '.') IN ({', '.join(f"'{x}'" for x in LONG_SUFFIXES)})
                             THEN 2 ELSE 1 END AS s FROM named) x),
    everything_mean AS (SELECT '' AS everything, (sum(k) + 1) / (sum(n) + 2) AS mean FROM counts),
    {_level('everything', 'suffix', ['everything', 'suffix'])},
    {_level('suffix', 'domain', ['everything', 'suffix', 'domain'])},
    {_level('domain', 'host', ['everything', 'suffix', 'domain', 'host'])},
    {LISTED},
    fitting AS (
        SELECT page_id, rule, listed_verdict FROM addressed JOIN listed
          ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT a.page_id, a.host, a.path, f.rule,
       coalesce(f.listed_verdict, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.5 THEN 'block' ELSE 'allow' END)
           AS verdict
FROM addressed a LEFT JOIN fitting f ON f.page_id = a.page_id LEFT JOIN host_mean h ON h.host = a.host"""

OP8 = rf"""
WITH sized AS (
        SELECT doc_id, source IS NULL AS no_name, coalesce(source, '') AS name,
               CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
               md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h
        FROM documents),
    sources AS (
        SELECT no_name, name, CAST(sum(size) AS BIGINT) AS source_size,
               (row_number() OVER (ORDER BY no_name, name) - 1) % 3 + 1 AS weight
        FROM sized GROUP BY no_name, name),
    levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, no_name, name
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY source_size / weight, no_name, name
                                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources),
    targets AS (
        SELECT *, least(CAST(3 * source_size AS DOUBLE),
                        coalesce(weight * max(CASE WHEN 3 * source_size > level * weight THEN level END) OVER (),
                                 CAST(3 * source_size AS DOUBLE))) AS target
        FROM levels),
    queued AS (
        SELECT s.*, t.source_size, t.target,
               sum(size) OVER (PARTITION BY s.no_name, s.name ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ahead
        FROM sized s JOIN targets t ON t.no_name = s.no_name AND t.name = s.name)
SELECT doc_id, size, source_size, target,
       CAST(size * len(list_filter([0, 1, 2], lambda e: 2 * (e * source_size + ahead) - size <= 2 * target)) AS BIGINT) AS taken
FROM queued"""

OP13 = """
WITH whole AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    positive AS (
        SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3, "op6_url_filter": OP6, "op8_mixing": OP8, "op13_hard_negatives": OP13}
