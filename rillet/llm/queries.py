"""Registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillet.llm.common import table
from rillet.llm.divergence import divergence
from rillet.llm.exact_dedup import exact_dedup_in_ranges
from rillet.llm.language_id import language_id
from rillet.llm.lexical_search import ranked_search
from rillet.llm.line_dedup import host_of, line_dedup, lines_of_html
from rillet.llm.minhash_dedup import near_duplicates
from rillet.llm.quality_classifier import quality_classifier
from rillet.llm.quality_rules import quality_rules
from rillet.llm.sentencepiece_codec import encode_decode_digests
from rillet.llm.source_mix import BUDGET, LEAST, NAMED_SHARE, REST, SOURCE_POWER, TARGETS, mix_documents
from rillet.llm.suffix_dedup import repeated_spans
from rillet.llm.token_shards import tokenised
from rillet.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql.strip()
        return fn
    return register


def _mix_sql(rounds: int = 20) -> str:
    """Raking as a chain of window sums over the cells."""
    def klass(name: str, value: str) -> str:
        named = ", ".join(f"'{k}'" for k in TARGETS[name] if k != REST)
        return f"CASE WHEN {value} IN ({named}) THEN {value} ELSE '{REST}' END AS {name}_class"

    bars = "(length(t) - length(replace(t, '|', '')))"
    topic = (f"CASE WHEN {bars} > 0 AND 20 * {bars} >= length(t) THEN 'table' "
             "WHEN length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^a-z]', '', 'g')) "
             "THEN 'shout' ELSE 'prose' END")
    parts = [f"""WITH d AS (SELECT *, coalesce(text, '') AS t, CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS n_tokens
  FROM documents),
s AS (SELECT source, sum(n_tokens) AS n, pow(sum(n_tokens)::DOUBLE, {SOURCE_POWER}) AS weight FROM d GROUP BY source),
named AS (SELECT source AS k, weight / (SELECT sum(weight) FROM s) AS share FROM s
  WHERE source <> '{REST}' AND n > 0 AND n >= {NAMED_SHARE} * (SELECT sum(n) FROM s)),
r AS (SELECT doc_id, CASE WHEN source IN (SELECT k FROM named) THEN source ELSE '{REST}' END AS source_class,
  {klass('lang', 'lang')}, {klass('topic', topic)}, n_tokens FROM d),
c AS (SELECT source_class, lang_class, topic_class, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL),
w0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM c),
t_source AS (SELECT k, share / sum(share) OVER () AS share FROM (
  SELECT k, share FROM named UNION ALL SELECT '{REST}', 1 - (SELECT coalesce(sum(share), 0) FROM named))
  WHERE k IN (SELECT source_class FROM w0 WHERE tokens > 0))"""]
    for name, target in TARGETS.items():
        shares = ", ".join(f"('{k}', {v})" for k, v in target.items())
        left = max(0.0, 1 - sum(target.values()))
        rest = f"('{REST}', {left if left > 1e-12 else 'NULL'})"
        rows = shares if REST in target else f"{shares}, {rest}"
        parts.append(f"""t_{name} AS (SELECT k, share / sum(share) OVER () AS share FROM (
  SELECT k, coalesce(CAST(s AS DOUBLE), (SELECT sum(w) FROM w0 WHERE {name}_class = k)) AS share
  FROM (VALUES {rows}) AS v(k, s) WHERE k IN (SELECT {name}_class FROM w0 WHERE tokens > 0)))""")
    step = 0
    for _ in range(rounds):
        for name in ("source", *TARGETS):
            parts.append(f"""w{step + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (w), w * share / sum(w) OVER (PARTITION BY {name}_class) AS w
FROM w{step} x JOIN t_{name} ON {name}_class = k)""")
            step += 1
    # Cells in order of weight over tokens: the first that fits under 1 when those before it are held at 1.
    parts.append(f"""o AS (SELECT *, w / tokens AS r,
  greatest(least({BUDGET} * sum(tokens) OVER (), 1 / max(w / tokens) OVER ()), {LEAST} * sum(tokens) OVER ()) AS budget,
  coalesce(sum(tokens) OVER (ORDER BY w / tokens DESC, source_class, lang_class, topic_class
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY w / tokens DESC, source_class, lang_class, topic_class
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w{step}),
p AS (SELECT source_class, lang_class, topic_class, round(least(1.0, r * coalesce((SELECT (budget - held) / rest FROM o
  WHERE (budget - held) / rest * r <= 1 ORDER BY r DESC, source_class, lang_class, topic_class LIMIT 1), 1e300)), 9)
  AS probability FROM o)""")
    return ",\n".join(parts) + """
SELECT doc_id, source_class, lang_class, topic_class, n_tokens, probability,
  ('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < probability AS kept
FROM r JOIN p USING (source_class, lang_class, topic_class)"""


@query("op1_suffix_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return repeated_spans(table(spark, d, "documents"))


@query("op2_source_mix", _mix_sql())
def op2(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"))


@query("op3_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup_in_ranges(table(spark, d, "documents"))


@query("op4_minhash_dedup")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), n_words=2, threshold_pct=80)


@query("op5_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l
  FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g,
    unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
f AS (SELECT d.doc_id, host, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (100 * n_symbols > 10 * n_words)::INT + (100 * n_dup_lines > 30 * n_lines)::INT
    + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS n_rules_failed FROM f),
h AS (SELECT host, count(*) AS n, sum((base_failed OR n_rules_failed > 0)::INT) AS bad FROM b GROUP BY host),
m AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 1e-12 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM m),
r AS (SELECT host, round((bad + m * k) / (n + k), 6) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, n_rules_failed,
  host, host_rate, NOT (base_failed OR host_rate >= 0.5 OR (n_rules_failed > 0 AND host_rate >= 0.05)) AS kept
FROM b JOIN r USING (host)""")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules(table(spark, d, "documents"))


@query("op6_line_dedup", r"""
WITH a AS (SELECT page_id, coalesce(regexp_replace(regexp_extract(lower(url),
    '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '^www\.', ''), '') AS host, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
    '(?is)<script[^>]*>.*?</script>', chr(10), 'g'), '(?is)<style[^>]*>.*?</style>', chr(10), 'g'),
    '(?s)<!--.*?-->', chr(10), 'g'), '(?i)</?(?:b|i|em|strong|span|a)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)),
    lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS l FROM b),
hp AS (SELECT host, count(*) AS host_pages FROM c GROUP BY host),
u AS (SELECT host, unnest(list_distinct(l)) AS line FROM c),
f AS (SELECT host, line FROM u JOIN hp USING (host) GROUP BY host, line, host_pages
  HAVING count(*) >= 3 AND count(*) > 0.3 * host_pages),
s AS (SELECT host, list(line) AS gone FROM f GROUP BY host),
r AS (SELECT page_id, host, host_pages, l, list_filter(l, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept
  FROM c JOIN hp USING (host) LEFT JOIN s USING (host))
SELECT page_id, host, host_pages, len(l)::BIGINT AS n_lines, (len(l) - len(kept))::BIGINT AS n_dropped,
  coalesce(array_to_string(kept, chr(10)), '') AS text FROM r""")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup(table(spark, d, "pages"), "page_id", host_of(F.col("url")), lines_of_html(F.col("html")))


@query("op7_sentencepiece")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return encode_decode_digests(table(spark, d, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return language_id(table(spark, d, "documents"))


@query("op9_token_shards")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return tokenised(table(spark, d, "documents"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return quality_classifier(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op11_toxicity")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op12_source_divergence", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term, sum(n)::BIGINT AS lang_n FROM t GROUP BY lang, term HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM v GROUP BY lang),
c AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * g.v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * g.v) AS q
  FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return divergence(table(spark, d, "documents"))


@query("op13_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM x WHERE rank <= 50""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return ranked_search(table(spark, d, "documents"), table(spark, d, "benchmark"))
