"""One registered query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slidegrid.llm import attribution, extraction, language, likelihood, mixing, neighbours, notices, quality, search, segmentation, simhash, tries, urls
from slidegrid.queries.registry import Query
from slidegrid.session import table

LLM: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        LLM[name] = Query(name, "llm", fn, sql)
        return fn

    return keep


#: Words of a text as a list; ``{t}`` is the text. DuckDB form.
WORDS_SQL = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws.split()}))


def _rules_sql() -> str:
    ratio = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)",
        "stop_word_ratio": "n_stop_words / nullif(n_words, 0)", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    }
    tests = []
    for r in quality.RULES:
        tests += [f"coalesce({ratio[r.measure]} >= {r.low}, true)"] if r.low is not None else []
        tests += [f"coalesce({ratio[r.measure]} <= {r.high}, true)"] if r.high is not None else []
    return " AND ".join(tests)


QUALITY_CTE = f"""texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, {WORDS_SQL.format(t='t')} AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
placed AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS win FROM placed
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
counts AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda w: lower(w) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words
  FROM split s LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)"""
QUALITY_SQL = f"""WITH {QUALITY_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept, n_lines, n_stop_words FROM judged"""


@register("op7_quality", QUALITY_SQL)
def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


@register("op1_segmentation")
def op1_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Four best segmentations of every text, and whether the best one decodes to the text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return segmentation.encode(docs, n=4, verify=True).withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


@register("op9_simhash")
def op9_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@register("op10_notices")
def op10_notices(spark: SparkSession, d: str) -> DataFrame:
    return notices.scan(table(spark, d, "documents").select("doc_id", "text"))


@register("op2_likelihood")
def op2_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return likelihood.score(table(spark, d, "documents").select("doc_id", "text"))


@register("op3_neighbours")
def op3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "embeddings").select("vec_id", "embedding"))


@register("op4_language")
def op4_language(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(table(spark, d, "documents").select("doc_id", "text", "lang"))


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of source, language and every line of the text, from one encoding of each document."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return attribution.count_tokens(docs, fields=("source", "lang", "text"), lines_of=("text",))


@register("op6_mixing")
def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, d, "documents").select("doc_id", "text", "source"))


#: The five rules as the contract words them (verdict, host, path), longest first; written out so that the SQL does not rest on urls.RULES.
_CONTRACT_RULES = (
    ("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/fr/"), ("allow", "org", "/"),
)


def _rules_case(verdict: bool) -> str:
    cases = [
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{says if verdict else host + path}'"
        for says, host, path in _CONTRACT_RULES
    ]
    return "CASE " + " ".join(cases) + " END"


_PARTS_SQL = "(?s)^.*?://([^/?#]*)([^?#]*)"
URLS_SQL = f"""WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(coalesce(url, ''), '{_PARTS_SQL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{_PARTS_SQL}', 2) AS path FROM pages),
listed AS (SELECT DISTINCT host || path AS k FROM parts WHERE contains(u, 'utm_source=') AND host || path <> '')
SELECT page_id, host, path, {_rules_case(False)} AS rule,
  coalesce({_rules_case(True)}, CASE WHEN host <> '' AND host || path IN (SELECT k FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""


@register("op8_urls", URLS_SQL)
def op8_urls(spark: SparkSession, d: str) -> DataFrame:
    """Pages judged by the rules; else blocked if their host and path are among those reached with a campaign parameter."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return urls.judge(pages, urls.tracked_keys(pages))


#: CRC-32 of the decimal digits of ``c``, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda s, b: list_reduce(
      list_concat([xor(s, b)], list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""
TRIE_SQL = f"""WITH said AS (
  SELECT conv_id AS c, turn, length(coalesce("text", '')) AS n_chars,
    sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce("text", '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, n_chars, d, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM said),
convs AS (SELECT c, c - c % 100 AS base, {_CRC_SQL} % 6 AS h FROM (SELECT DISTINCT c FROM said)),
parts AS (
  SELECT v.c, 0 AS part, o.pos, o.d, o.n_chars FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h
  UNION ALL SELECT v.c, 1, o.pos, o.d, o.n_chars FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h),
placed AS (
  SELECT c, n_chars, row_number() OVER w AS depth, string_agg(d, '') OVER w AS p FROM parts
  WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
members AS (SELECT c, 0 AS depth, '' AS p, 0 AS n_chars FROM convs UNION ALL SELECT c, depth, p, n_chars FROM placed),
nodes AS (SELECT p, any_value(depth) AS depth, min(c) AS c, count(*) AS n_convs, any_value(n_chars) AS n_chars FROM members GROUP BY p),
kids AS (SELECT left(p, length(p) - 64) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p),
above AS (
  SELECT left(p, 64 * j) AS p, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * n_chars) AS saved
  FROM whole, LATERAL (SELECT unnest(range(depth + 1)) AS j) GROUP BY 1),
lasts AS (SELECT c, arg_max(p, depth) AS p FROM members GROUP BY c),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM lasts GROUP BY p)
SELECT w.c AS conv_id, w.depth AS depth, u.c AS parent_conv_id, w.n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
  CAST(a.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM whole w JOIN above a ON a.p = w.p LEFT JOIN whole u ON w.depth > 0 AND u.p = left(w.p, length(w.p) - 64) LEFT JOIN ends e ON e.p = w.p"""


@register("op11_trie", TRIE_SQL)
def op11_trie(spark: SparkSession, d: str) -> DataFrame:
    return tries.rebuilt_trie(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


_TERMS_SQL = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL.format(t='"text"')} AS ts FROM documents),
held AS (SELECT r, doc_id, ts, len(ts) AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS words FROM held),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM held) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS_SQL.format(t='"text"')} AS ts FROM (SELECT DISTINCT item_id, "text" FROM benchmark)),
asked AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY ALL),
weighed AS (
  SELECT a.*, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM asked a JOIN df USING (t), totals),
scored AS (
  SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // words))))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (t) JOIN held USING (r), totals GROUP BY i, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


@register("op12_search", SEARCH_SQL)
def op12_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@register("op13_extraction")
def op13_extraction(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extract(table(spark, d, "pages").select("page_id", "url", "html"))
