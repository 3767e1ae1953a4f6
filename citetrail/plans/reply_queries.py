"""Queries over model replies and what prompts are made of: rows of the tables are written as replies and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citetrail.functions import jsonval, pages, text
from citetrail.plans import page_queries
from citetrail.runtime import load
from citetrail.schema import ENTITY_TYPES, SOURCE_TYPES
from citetrail.sources.corpus import flatten_links

#: Names looked for in links and pages.
NAMES = ["ministry", "council", "gewerkschaft", "sindicato"]


def reply_classification(spark: SparkSession, d: str) -> DataFrame:
    """What is read of a reply that says of each node what its row says; its publisher is an unlinked source."""
    unlinked = F.array(F.struct(F.col("publisher").alias("description"), F.col("phantom_key").alias("canonicalKey"), F.lit("interview").alias("sourceType")), F.struct(F.lit("d").alias("description"), F.lit("x").alias("canonicalKey"), F.lit("x").alias("sourceType")))
    raw = F.to_json(F.struct("title", F.col("source_type").alias("sourceType"), "publisher", "date", "snippet", F.array("url").alias("sourceUrls"), unlinked.alias("unlinkedSources")))
    c = jsonval.classification(raw)
    named = lambda u: F.concat_ws("|", u["description"], u["canonicalKey"], u["sourceType"])
    rows = load(spark, d, "source_nodes").select("id", c.alias("c"))
    return rows.select("id", "c.title", F.col("c.sourceType").alias("source_type"), "c.publisher", "c.date", "c.snippet", F.size("c.sourceUrls").alias("n_urls"), F.array_join(F.transform("c.unlinkedSources", named), ";").alias("unlinked")).distinct()


def reply_claims(spark: SparkSession, d: str) -> DataFrame:
    """What is read of a reply with each claim, a number among its entities and a triple of an unknown type."""
    words = F.split("claim_text", " ")
    triple = F.struct(F.col("attribution").alias("subject"), F.lit("person").alias("subjectType"), F.get(words, F.lit(1)).alias("predicate"), F.try_element_at(words, F.lit(-1)).alias("object"), F.lit("odd").alias("objectType"), F.lit("").alias("context"))
    raw = F.to_json(F.struct(F.array(F.struct(F.col("claim_text").alias("claim"), F.array(F.col("attribution"), F.get(words, F.lit(0))).alias("entities"), "attribution", F.array(triple).alias("triples")), F.struct(F.lit(None).cast("string").alias("claim"), F.array(F.lit("x"), F.lit("x")).alias("entities"), F.lit("x").alias("attribution"), F.array(triple).alias("triples"))).alias("claims")))
    rows = load(spark, d, "claims").where("claim_text is not null").select("id", F.posexplode(jsonval.claims(raw)).alias("pos", "c"))
    line = lambda t: F.concat_ws("|", t["subject"], t["subjectType"], t["predicate"], t["object"], t["objectType"], F.coalesce(t["context"], F.lit("-")))
    return rows.select("id", "pos", "c.claim", F.array_join("c.entities", "|").alias("entities"), "c.attribution", F.array_join(F.transform("c.triples", line), ";").alias("triples")).distinct()


def reply_matches(spark: SparkSession, d: str) -> DataFrame:
    """Positions read of a reply with numbers, a text and a repeat."""
    raw = F.concat(F.lit('{"matches": [1, "2", '), F.col("doc_id"), F.lit(", "), F.col("doc_id"), F.lit(", 3]}"))
    return load(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(jsonval.matches(raw)), ",").alias("matches"))


def page_link_list(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_corpus").where("links is not null").select("crawl_id", F.md5(jsonval.link_list(flatten_links(F.col("links")))).alias("digest"))


def _names() -> Column:
    return F.array(*[F.lit(n) for n in NAMES])


def page_naming_links(spark: SparkSession, d: str) -> DataFrame:
    links = text.links_naming(text.inline_links(F.col("markdown")), _names())
    return load(spark, d, "crawl_corpus").where("markdown <> ''").select("crawl_id", F.explode(links).alias("l")).select("crawl_id", "l.url", "l.anchor")


def page_topical(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page names one of a few names near its start, or its title shares two words with its address."""
    title = F.coalesce("title", F.lit(""))
    topical = pages.is_topical(F.col("title"), F.col("markdown"), _names(), text.content_words(title), text.content_words(F.col("url")))
    return load(spark, d, "crawl_corpus").where("url is not null").select("crawl_id", topical.alias("topical"))


def family_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """How alike each document of a family is to the one before it."""
    rows = load(spark, d, "documents").where("text <> '' and family_id is not null").select("family_id", "doc_id", text.content_shingles(F.col("text")).alias("s"))
    w = Window.partitionBy("family_id").orderBy("doc_id")
    pairs = rows.select("doc_id", "s", F.lag("doc_id").over(w).alias("before_id"), F.lag("s").over(w).alias("before")).where("before_id is not null")
    return pairs.select("before_id", "doc_id", F.round(text.jaccard(F.col("before"), F.col("s")), 6).alias("jaccard"))


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN (" + _listed(text.STOP_WORDS) + ")))"

SQL = {
    "reply_classification": f"""SELECT DISTINCT id, coalesce(title, '') AS title, CASE WHEN source_type IN ({_listed(SOURCE_TYPES)}) THEN source_type ELSE 'secondary-reporting' END AS source_type, coalesce(publisher, '') AS publisher,
      coalesce(date, '') AS date, left(coalesce(snippet, ''), 300) AS snippet, (url IS NOT NULL)::INT AS n_urls, CASE WHEN publisher IS NULL THEN 'd|x|secondary-reporting' ELSE publisher || '|' || coalesce(phantom_key, '') || '|interview;d|x|secondary-reporting' END AS unlinked FROM source_nodes""",
    "reply_claims": f"""WITH w AS (SELECT DISTINCT id, claim_text, attribution, string_split(claim_text, ' ') AS ws FROM claims WHERE claim_text IS NOT NULL)
      SELECT DISTINCT id, 0 AS pos, claim_text AS claim, concat_ws('|', attribution, ws[1]) AS entities, coalesce(attribution, '') AS attribution,
        CASE WHEN attribution IS NULL OR len(ws) < 2 THEN '' ELSE attribution || '|{ENTITY_TYPES[0]}|' || lower(ws[2]) || '|' || ws[-1] || '|{ENTITY_TYPES[-1]}|-' END AS triples FROM w""",
    "reply_matches": "SELECT doc_id, array_to_string(list_sort(list_distinct([0, doc_id - 1, 2])), ',') AS matches FROM documents",
    "page_link_list": """WITH l AS (SELECT crawl_id, list_filter(list_concat(list_filter(links, lambda x: x.internal), list_filter(links, lambda x: NOT coalesce(x.internal, false))), lambda x: x.href IS NOT NULL) AS l FROM crawl_corpus WHERE links IS NOT NULL),
      o AS (SELECT crawl_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: y.href), x.href) = i)[:50] AS o FROM l)
      SELECT crawl_id, md5(array_to_string(list_transform(o, lambda x: '- ' || x.href || CASE WHEN coalesce(x.text, '') <> '' THEN ' ("' || x.text || '")' ELSE '' END), chr(10))) AS digest FROM o""",
    "page_naming_links": f"WITH links AS ({page_queries.SQL['page_inline_links']}) SELECT crawl_id, url, anchor FROM links WHERE {' OR '.join(f'contains(lower(anchor), {chr(39)}{n}{chr(39)})' for n in NAMES)}",
    "page_topical": f"""SELECT crawl_id, {" OR ".join(f"contains(lower(concat_ws(' ', title, left(markdown, 1000))), '{n}')" for n in NAMES)}
      OR len(list_intersect({_WORDS.format("coalesce(title, '')")}, {_WORDS.format("url")})) >= 2 AS topical FROM crawl_corpus WHERE url IS NOT NULL""",
    "family_jaccard": page_queries._SHINGLES
    + """, f AS (SELECT family_id, doc_id, s FROM sh JOIN documents USING (doc_id) WHERE text <> '' AND family_id IS NOT NULL),
      p AS (SELECT doc_id, s, lag(doc_id) OVER (PARTITION BY family_id ORDER BY doc_id) AS before_id, lag(s) OVER (PARTITION BY family_id ORDER BY doc_id) AS b FROM f)
      SELECT before_id, doc_id, round(CASE WHEN len(s) + len(b) = 0 THEN 0 ELSE len(list_intersect(s, b)) / (len(s) + len(b) - len(list_intersect(s, b))) END, 6) AS jaccard FROM p WHERE before_id IS NOT NULL""",
}

QUERIES = {f.__name__: f for f in (reply_classification, reply_claims, reply_matches, page_link_list, page_naming_links, page_topical, family_jaccard)}
