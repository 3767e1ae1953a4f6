"""Queries over addresses, pages and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.functions import dates, pages, text, urls
from citetrail.operators.consolidate import first_per_key, leaders
from citetrail.operators.similar import similar_texts
from citetrail.runtime import load
from citetrail.sources.corpus import flatten_links


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_corpus").select("url").unionByName(load(spark, d, "source_nodes").select("url")).where("url is not null").distinct()


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).withColumn("norm_url", urls.normalize_url(F.col("url")))


def url_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "crawl_corpus").select("crawl_id", urls.normalize_url(F.col("url")).alias("norm_url")).where("norm_url is not null")
    return first_per_key(rows, ["norm_url"], ["crawl_id"])


def url_admission(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).withColumn("analyzable", urls.is_analyzable_url(F.col("url")))


def url_title_publisher(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, d).select("url", urls.title_from_url(u).alias("title"), urls.publisher_from_url(u).alias("publisher"))


def _md(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_corpus").where("markdown <> ''")


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_corpus").select("crawl_id", pages.pick_title(F.col("metadata")).alias("page_title"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "crawl_corpus").select("crawl_id", F.posexplode(flatten_links(F.col("links"))).alias("pos", "l"))
    return rows.select("crawl_id", "pos", "l.href", "l.text", "l.internal")


def page_inline_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _md(spark, d).select("crawl_id", F.posexplode(text.inline_links(F.col("markdown"))).alias("pos", "l"))
    return rows.select("crawl_id", "pos", "l.url", "l.anchor")


def page_link_heavy(spark: SparkSession, d: str) -> DataFrame:
    return _md(spark, d).select("crawl_id", pages.is_link_heavy(F.col("markdown")).alias("link_heavy"))


def page_product(spark: SparkSession, d: str) -> DataFrame:
    return _md(spark, d).select("crawl_id", pages.is_product_page(F.col("url"), F.col("markdown")).alias("product"))


def page_knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    return _md(spark, d).select("crawl_id", pages.is_knowledge_base(F.col("url"), F.coalesce("title", F.lit("")), F.col("markdown")).alias("knowledge_base"))


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = pages.page_kind(*(F.col(c) for c in ("success", "url", "title", "markdown")))
    return load(spark, d, "crawl_corpus").select("crawl_id", kind.alias("kind"))


def page_strip_related(spark: SparkSession, d: str) -> DataFrame:
    return _md(spark, d).select("crawl_id", F.md5(pages.strip_related(F.col("markdown"))).alias("digest"))


def page_densest_block(spark: SparkSession, d: str) -> DataFrame:
    return _md(spark, d).select("crawl_id", F.md5(pages.densest_block(F.col("markdown"))).alias("digest"))


def page_best_content(spark: SparkSession, d: str) -> DataFrame:
    """The fitted text is here the page without related articles, and a page that failed has none."""
    fit = F.when(F.col("success"), pages.strip_related(F.col("markdown")))
    return pages.with_best_content(load(spark, d, "crawl_corpus"), fit, F.col("markdown")).select("crawl_id", F.md5("content").alias("digest"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of each address the last good fetch that is fresh at a fixed time."""
    now = F.lit("2023-06-01 00:00:00").cast("timestamp")
    rows = load(spark, d, "crawl_corpus").where(F.col("success") & dates.is_fresh(F.col("fetched_at"), now, 24 * 60) & (F.col("fetched_at") <= now))
    best = rows.groupBy(F.sha2("url", 256).alias("cache_key")).agg(F.max(F.struct("fetched_at", "crawl_id")).alias("m"))
    return best.select("cache_key", F.col("m.crawl_id").alias("crawl_id"))


def text_content_words(spark: SparkSession, d: str) -> DataFrame:
    w = text.content_words(F.col("text"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).alias("n_words"), F.array_join(F.array_sort(w), " ").alias("words"))


def text_shingle_count(spark: SparkSession, d: str) -> DataFrame:
    s = text.content_shingles(F.col("text"))
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("n_shingles"), F.md5(F.array_join(F.array_sort(s), "|")).alias("digest"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(text.chunk_markdown(F.col("text"))).alias("chunk", "t"))
    return rows.select("doc_id", "chunk", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def truncate_prompt(spark: SparkSession, d: str) -> DataFrame:
    t = text.truncated(F.col("text"), 6_000)
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def near_dup_links(spark: SparkSession, d: str) -> DataFrame:
    """set_doc, n_links: per different shingle set, by its least document, the number of other sets at a Jaccard of 0.8 or more."""
    _, pairs = similar_texts(_texts(spark, d), 0.8)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_doc"))
    return ends.groupBy("set_doc").agg(F.count(F.lit(1)).alias("n_links"))


def same_article_pairs(spark: SparkSession, d: str) -> DataFrame:
    """set_a, set_b, jaccard: different articles that are the same by runs of three words, over whole texts, at a Jaccard of 0.5 or more; copies are one set, by the least document."""
    _, pairs = similar_texts(_texts(spark, d), 0.5, 3)
    return pairs.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.round("jaccard", 6).alias("jaccard"))


def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, class_id for every document: the class is the first document greedy clustering gathers it to; texts under five words are gathered when equal."""
    rows, pairs = similar_texts(_texts(spark, d), 0.8, all_scripts=True)
    key = F.struct(F.col("n") > 0, "set_hash")
    firsts = rows.groupBy(key.alias("key")).agg(F.min("id").alias("id"))
    lead = leaders(firsts.select(F.lit(0).alias("scope"), "id", F.col("id").alias("ord")), pairs.select(F.lit(0).alias("scope"), "a", "b")).select("id", "leader")
    return rows.select(F.col("id").alias("doc_id"), key.alias("key")).join(firsts, "key").join(lead, "id").select("doc_id", F.col("leader").alias("class_id"))


_URL = r"'^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(:\d*)?([^?#]*)(\?[^#]*)?(#.*)?$'"
_U = "u AS (SELECT DISTINCT url FROM (SELECT url FROM crawl_corpus UNION ALL SELECT url FROM source_nodes) WHERE url IS NOT NULL)"
_SPLIT = f"""
p AS (SELECT url, regexp_matches(url, {_URL}) AS ok, lower(regexp_extract(url, {_URL}, 1)) AS scheme, lower(regexp_extract(url, {_URL}, 2)) AS host, regexp_extract(url, {_URL}, 3) AS port,
  CASE WHEN regexp_extract(url, {_URL}, 4) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 4) END AS path, regexp_extract(url, {_URL}, 5) AS query FROM u)
"""
_PARTS = f"{_U}, {_SPLIT}"
#: CTEs from u(url) to n(url, norm_url).
NORM_STEPS = f"""
{_SPLIT},
q AS (SELECT *, list_filter(string_split(ltrim(query, '?'), '&'), lambda x: x <> '' AND NOT (string_split(x, '=')[1] IN
  ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','mc_cid','mc_eid','ref','source') OR starts_with(x, 'utm_'))) AS kept FROM p),
s AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kept, lambda x, i: {{'k': string_split(x, '=')[1], 'i': i, 'p': x}})), lambda x: x.p), '&') AS qs FROM q),
w AS (SELECT url, ok, path, scheme || '://' || host || CASE WHEN port = ':' OR (scheme = 'http' AND port = ':80') OR (scheme = 'https' AND port = ':443') THEN '' ELSE port END || path || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS whole FROM s),
n AS (SELECT url, CASE WHEN NOT ok THEN url WHEN ends_with(whole, '/') AND path <> '/' THEN whole[:-2] ELSE whole END AS norm_url FROM w)
"""
_NORM = f"WITH {_U}, {NORM_STEPS}"
_SHINGLES = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2) AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d)
"""
def _sets_sql(words: str, kept: str, run: int, least: float) -> str:
    """CTEs to alike(a, b, k, an, bn): pairs of different shingle sets of documents, both ways, by the least document; under `run` words the exact text is the set."""
    return f"""
WITH d AS (SELECT doc_id, text, list_filter({words}, lambda w: {kept}) AS w FROM documents),
sh AS (SELECT doc_id, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, '|')) WHEN text IS NULL THEN 'id ' || doc_id ELSE 'text ' || md5(text) END AS key
  FROM (SELECT doc_id, text, CASE WHEN w IS NULL OR len(w) < {run} THEN [] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {run - 2}), lambda i: array_to_string(w[i:i+{run - 1}], ' ')))) END AS s FROM d)),
st AS (SELECT key, min(doc_id) AS id, any_value(s) AS s FROM sh GROUP BY 1), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM st),
alike AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2) WHERE k / (an + bn - k) >= {least} - 1e-12)"""


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _re2(pattern: str) -> str:
    return pattern.replace("{b}", r"\b").replace("{e}", r"\b")


def _count(col: str, patterns: list[str], flags: str) -> str:
    return " + ".join(f"regexp_matches({col}, '{flags}{_re2(p)}')::INT" for p in patterns)


_KINDS = f"""
k AS (SELECT crawl_id, success, coalesce(title, '') AS title, coalesce(markdown, '') AS markdown, url, lower(left(markdown, 4000)) AS head, left(markdown, 500) AS top FROM crawl_corpus),
f AS (SELECT crawl_id, success, markdown, list_max(list_transform(regexp_split_to_array(markdown, '\\[[^\\]]*\\]\\([^)]*\\)'), lambda c: length(regexp_replace(c, '^[\\s\\x{{A0}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{FEFF}}]+$', '', 'g')))) < 200 AS link_heavy,
  {_count("url", pages.PRODUCT_URLS, "(?i)")} > 0 OR ({_count("head", pages.CALLS_TO_ACTION, "")} >= 3 AND {_count("head", pages.JOURNALISM, "")} = 0)
    OR (len(regexp_extract_all(markdown, '(?m)^#{{1,3}}\\s')) >= 6 AND len(regexp_split_to_array(markdown, '\\s+')) / greatest(len(regexp_extract_all(markdown, '(?m)^#{{1,3}}\\s')), 1) < 80 AND {_count("head", pages.JOURNALISM, "")} = 0) AS product,
  {_count("url", pages.KNOWLEDGE_URLS, "(?i)")} > 0 OR (NOT (regexp_matches(top, '\\b20\\d{{2}}[-/]\\d{{2}}[-/]\\d{{2}}\\b') OR regexp_matches(top, '(?i)\\b({pages.MONTH_NAMES})\\s+\\d{{1,2}}'))
    AND ({" OR ".join(f"contains(lower(title), '{t}')" for t in pages.KNOWLEDGE_TITLES)})) AS knowledge_base FROM k)
"""

_SPACES = r"[\s\x{A0}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _strip_sql(source: str, name: str) -> str:
    """CTE of (crawl_id, y): the texts x of `source` without related articles."""
    heading = pages.RELATED_HEADING.replace("'", "''")
    return f"""{name}_l AS (SELECT crawl_id, x, string_split(x, chr(10)) AS ls FROM {source}),
      {name}_c AS (SELECT *, list_min(list_filter(range(1, len(ls) + 1), lambda i: i - 1 >= floor(len(ls) * 0.3) AND regexp_matches({_trim("ls[i]")}, '(?i){heading}'))) AS cut_at FROM {name}_l),
      {name} AS (SELECT crawl_id, CASE WHEN cut_at IS NULL THEN x ELSE {_trim("array_to_string(ls[:cut_at-1], chr(10))")} END AS y FROM {name}_c)"""


#: CTEs from t(crawl_id, k, x) to dense(crawl_id, k, y): the heaviest run of lines of each text x, by window sums.
_DENSE = f"""dense_l AS (SELECT crawl_id, k, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) - 1 AS i FROM t),
      dense_s AS (SELECT *, {_trim("line")} AS s FROM dense_l),
      dense_n AS (SELECT *, length(regexp_replace(regexp_replace(s, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[#*_`>|]', '', 'g')) AS n, len(regexp_extract_all(s, '\\[[^\\]]*\\]\\([^)]*\\)')) AS links FROM dense_s),
      dense_w AS (SELECT *, CASE WHEN s = '' THEN 0 WHEN n < 10 THEN -1000 ELSE round(1000 * (n - 3000.0::DOUBLE * links / n))::BIGINT END AS w FROM dense_n),
      dense_p AS (SELECT *, sum(w) OVER (PARTITION BY crawl_id, k ORDER BY i) AS upto, sum((w < 1000)::INT) OVER (PARTITION BY crawl_id, k ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AS barrier FROM dense_w),
      dense_g AS (SELECT *, sum(barrier::INT) OVER (PARTITION BY crawl_id, k ORDER BY i) AS part FROM dense_p),
      dense_m AS (SELECT *, min({{'total': upto - w, 'i': i}}) FILTER (WHERE w >= 5000) OVER (PARTITION BY crawl_id, k, part ORDER BY i) AS first_line FROM dense_g),
      dense_r AS (SELECT crawl_id, k, first_line.i AS b, i AS f, row_number() OVER (PARTITION BY crawl_id, k ORDER BY upto - first_line.total DESC, first_line.i, i) AS r FROM dense_m WHERE first_line IS NOT NULL),
      dense AS (SELECT t.crawl_id, t.k, CASE WHEN b < f THEN {_trim("array_to_string(string_split(x, chr(10))[b + 1 : f + 1], chr(10))")} ELSE x END AS y FROM t LEFT JOIN dense_r d ON d.crawl_id = t.crawl_id AND d.k = t.k AND r = 1)"""

SQL = {
    "url_normalize": _NORM + "SELECT url, norm_url FROM n",
    "url_dedupe": _NORM + "SELECT norm_url, min(crawl_id) AS crawl_id FROM crawl_corpus JOIN n USING (url) GROUP BY norm_url",
    "url_admission": f"""WITH {_PARTS} SELECT url, ok AND scheme IN ('http', 'https') AND lower(regexp_extract(path, '(\\.\\w+)$', 1)) NOT IN ({", ".join(f"'{x}'" for x in urls.BLOCKED_EXTENSIONS)})
      AND regexp_replace(host, '^www\\.', '') NOT IN ({", ".join(f"'{x}'" for x in urls.BLOCKED_HOSTS)}) AND NOT regexp_matches(path || query, '(?i){"|".join(urls.BLOCKED_PATHS)}') AS analyzable FROM p""",
    "url_title_publisher": f"""WITH {_PARTS}, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p)
      SELECT url, CASE WHEN NOT ok THEN left(url, 80) WHEN len(seg) = 0 THEN host ELSE left(regexp_replace(regexp_replace(seg[-1], '[-_]', ' ', 'g'), '\\.\\w+$', ''), 100) END AS title,
      CASE WHEN ok THEN regexp_replace(host, '^www\\.', '') ELSE '' END AS publisher FROM s""",
    "page_title": "SELECT crawl_id, coalesce(metadata['og:title'], metadata['title'], '') AS page_title FROM crawl_corpus",
    "page_links": """WITH l AS (SELECT crawl_id, list_filter(list_concat(list_filter(links, lambda x: x.internal), list_filter(links, lambda x: NOT coalesce(x.internal, false))), lambda x: x.href IS NOT NULL) AS l FROM crawl_corpus),
      e AS (SELECT crawl_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM l) SELECT crawl_id, pos::INT AS pos, x.href AS href, coalesce(x.text, '') AS text, coalesce(x.internal, false) AS internal FROM e""",
    "page_inline_links": r"""WITH m AS (SELECT crawl_id, regexp_extract_all(markdown, '\[([^\]]+)\]\((https?://[^)]+)\)', 1) AS a, regexp_extract_all(markdown, '\[([^\]]+)\]\((https?://[^)]+)\)', 2) AS u FROM crawl_corpus WHERE markdown <> ''),
      e AS (SELECT crawl_id, unnest(u) AS url, unnest(a) AS anchor, generate_subscripts(u, 1) AS i FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY crawl_id, url ORDER BY i) AS r FROM e)
      SELECT crawl_id, (row_number() OVER (PARTITION BY crawl_id ORDER BY i) - 1)::INT AS pos, url, anchor FROM f WHERE r = 1""",
    "page_link_heavy": f"WITH {_KINDS} SELECT crawl_id, link_heavy FROM f WHERE markdown <> ''",
    "page_product": f"WITH {_KINDS} SELECT crawl_id, product FROM f WHERE markdown <> ''",
    "page_knowledge_base": f"WITH {_KINDS} SELECT crawl_id, knowledge_base FROM f WHERE markdown <> ''",
    "page_kinds": f"""WITH {_KINDS} SELECT crawl_id, CASE WHEN NOT coalesce(success, false) THEN 'failed' WHEN length(markdown) < 200 THEN 'unscrapable' WHEN link_heavy THEN 'link-heavy' WHEN product THEN 'product'
      WHEN knowledge_base THEN 'knowledge-base' ELSE 'article' END AS kind FROM f""",
    "page_strip_related": f"WITH t AS (SELECT crawl_id, markdown AS x FROM crawl_corpus WHERE markdown <> ''), {_strip_sql('t', 's')} SELECT crawl_id, md5(y) AS digest FROM s",
    "page_densest_block": f"WITH t AS (SELECT crawl_id, 0 AS k, markdown AS x FROM crawl_corpus WHERE markdown <> ''), {_DENSE} SELECT crawl_id, md5(y) AS digest FROM dense",
    "page_best_content": f"""WITH t0 AS (SELECT crawl_id, coalesce(markdown, '') AS x FROM crawl_corpus), {_strip_sql("t0", "s0")},
      t AS (SELECT crawl_id, 0 AS k, CASE WHEN success AND markdown IS NOT NULL THEN y ELSE '' END AS x FROM s0 JOIN crawl_corpus USING (crawl_id) UNION ALL SELECT crawl_id, 1, x FROM t0), {_DENSE},
      b AS (SELECT crawl_id, max(y) FILTER (WHERE k = 0) AS f, max(y) FILTER (WHERE k = 1) AS r FROM dense GROUP BY 1),
      t1 AS (SELECT crawl_id, CASE WHEN length(f) > 500 THEN f WHEN length(r) > 500 THEN r WHEN f <> '' THEN f WHEN r <> '' THEN r ELSE coalesce(markdown, '') END AS x FROM b JOIN crawl_corpus USING (crawl_id)),
      {_strip_sql("t1", "s1")} SELECT crawl_id, md5(y) AS digest FROM s1""",
    "cache_lookup": """SELECT sha256(url) AS cache_key, max_by(crawl_id, struct_pack(a := fetched_at, b := crawl_id)) AS crawl_id FROM crawl_corpus
      WHERE success AND fetched_at <= TIMESTAMPTZ '2023-06-01 00:00:00+00' AND fetched_at + INTERVAL 1440 HOUR > TIMESTAMPTZ '2023-06-01 00:00:00+00' GROUP BY 1""",
    "text_content_words": f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS ws FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, len(ws)::INT AS n_words, array_to_string(ws, ' ') AS words FROM w""",
    "text_shingle_count": _SHINGLES + "SELECT doc_id, len(s)::INT AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM sh",
    "chunk_documents": r"""WITH RECURSIVE p AS (SELECT doc_id, text, regexp_split_to_array(text, '\n{2,}') AS ps FROM documents WHERE text IS NOT NULL),
      r AS (SELECT doc_id, ps, 1 AS i, ps[1] AS cur, NULL::VARCHAR AS done, 0 AS k FROM p WHERE length(text) > 8000
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN length(cur) + length(ps[i + 1]) > 3000 AND cur <> '' THEN right(cur, 200) || chr(10) || chr(10) || ps[i + 1] ELSE cur || CASE WHEN cur <> '' THEN chr(10) || chr(10) ELSE '' END || ps[i + 1] END,
          CASE WHEN length(cur) + length(ps[i + 1]) > 3000 AND cur <> '' THEN cur END, k + (length(cur) + length(ps[i + 1]) > 3000 AND cur <> '')::INT FROM r WHERE i < len(ps)),
      c AS (SELECT doc_id, 0 AS chunk, text AS t FROM p WHERE length(text) <= 8000
        UNION ALL SELECT doc_id, k - 1, regexp_replace(done, '^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$', '', 'g') FROM r WHERE done IS NOT NULL
        UNION ALL SELECT doc_id, k, regexp_replace(cur, '^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$', '', 'g') FROM r WHERE i = len(ps) AND trim(cur) <> '')
      SELECT doc_id, chunk::INT AS chunk, length(t)::INT AS n_chars, md5(t) AS digest FROM c""",
    "truncate_prompt": "WITH t AS (SELECT doc_id, CASE WHEN length(text) > 6000 THEN left(text, 6000) || chr(10) || '...[truncated]' ELSE text END AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS digest FROM t",
    "near_dup_links": _SHINGLES
    + """, st AS (SELECT list_sort(s) AS s, min(doc_id) AS id FROM sh WHERE len(s) > 0 GROUP BY 1), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM st),
      c AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2)
      SELECT a AS set_doc, count(*) AS n_links FROM c WHERE k / (an + bn - k) >= 0.8 - 1e-12 GROUP BY 1""",
    "same_article_pairs": _sets_sql("regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')", "length(w) > 2", 3, 0.5)
    + " SELECT a AS set_a, b AS set_b, round(k / (an + bn - k), 6) AS jaccard FROM alike WHERE a < b",
}

QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_dedupe, url_admission, url_title_publisher, page_title, page_links, page_inline_links, page_link_heavy, page_product, page_knowledge_base, page_kinds,
        page_strip_related, page_densest_block, page_best_content, cache_lookup, text_content_words, text_shingle_count, chunk_documents, truncate_prompt, near_dup_links, same_article_pairs, near_dup_classes,
    )
}
