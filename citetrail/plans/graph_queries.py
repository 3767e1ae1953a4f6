"""Queries over citation graphs, claims and entities, one batch of analyses at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.functions import dates, jsonval, levels, pages, urls
from citetrail.functions.text import STOP_WORDS, claim_key, content_words
from citetrail.operators import consolidate, corroboration, frontier, summary, tree
from citetrail.plans import page_queries, views
from citetrail.runtime import load
from citetrail.sources import store


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return views.live_edges(spark, d).select("scope", F.col("id").alias("edge_id"), "source", "target", "source_fidelity", "editorialization", "metric_source_type", "corroboration", "loaded_at")


def corroboration_levels(spark: SparkSession, d: str) -> DataFrame:
    claims = views.live_claims(spark, d)
    out = corroboration.corroboration(_edges(spark, d).drop("corroboration"), claims.select("scope", "node", "embedding"), views.claim_triples(claims))
    return out.select("scope", "edge_id", "corroboration")


def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    return corroboration.matched_pairs(_edges(spark, d).select("scope", "edge_id", "source", "target"), views.claim_triples(views.live_claims(spark, d))).select("scope", "edge_id", "matched")


def similar_claim_edges(spark: SparkSession, d: str) -> DataFrame:
    return corroboration.similar_claim_edges(_edges(spark, d), views.live_claims(spark, d).select("scope", "node", "embedding"), 0.85)


def shared_pair_context(spark: SparkSession, d: str) -> DataFrame:
    out = corroboration.shared_context(_edges(spark, d).select("scope", "edge_id", "source", "target"), views.claim_triples(views.live_claims(spark, d)))
    line = lambda x: F.concat_ws("|", x["lo"], x["hi"], F.array_join(x["source_predicates"], ","), F.array_join(x["target_predicates"], ","))
    return out.select("scope", "edge_id", F.array_join(F.transform("shared", line), ";").alias("shared"))


def temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    day = F.regexp_extract("date", r"^\s*(\d{4}-\d{2}-\d{2})(?:[T\s]|$)", 1).try_cast("date")
    nodes = views.live_nodes(spark, d).select("scope", "node", day.alias("day"))
    e = _edges(spark, d).join(nodes.select("scope", F.col("node").alias("source"), F.col("day").alias("a")), ["scope", "source"]).join(nodes.select("scope", F.col("node").alias("target"), F.col("day").alias("b")), ["scope", "target"])
    return e.where("a is not null and b is not null").select("edge_id", F.coalesce(dates.temporal_gap(F.col("a"), F.col("b")), F.lit("")).alias("gap"))


_PRIORITY = "CASE source_type WHEN 'primary-study' THEN 100 WHEN 'official-statement' THEN 100 WHEN 'data-source' THEN 10 ELSE 50 END"


def frontier_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = views.live_nodes(spark, d).where("url is not null").select("scope", "node", F.expr(_PRIORITY).alias("priority"), F.struct("loaded_at", "id").alias("ord"))
    return frontier.top_candidates(rows, 15).select("scope", "node", "priority", "rank")


def candidate_parents(spark: SparkSession, d: str) -> DataFrame:
    """New addresses per analysis and how many nodes link each: the address of the article itself is known and has no parent."""
    nodes = views.live_nodes(spark, d)
    links = _edges(spark, d).join(nodes.where("url is not null").select("scope", F.col("node").alias("source"), "url"), ["scope", "source"])
    links = links.select("scope", "url", F.col("target").alias("parent"), F.lit(100).alias("priority"), F.struct("loaded_at", "edge_id").alias("ord"))
    seen = load(spark, d, "analyses").where("article_url is not null").select(F.col("id").alias("scope"), urls.normalize_url(F.col("article_url")).alias("norm_url"))
    new, parents = frontier.gather_candidates(links, seen, seen.select("scope", "norm_url", F.lit("").alias("parent")).where("1 = 0"))
    n = parents.groupBy("scope", "norm_url").agg(F.count(F.lit(1)).alias("n_parents"))
    return new.join(n, ["scope", "norm_url"]).select("scope", "norm_url", "url", "n_parents")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.live_nodes(spark, d).where("phantom").select("scope", F.col("node").alias("source"), F.coalesce(F.trim("phantom_key"), F.lit("")).alias("key"), "title")
    return _edges(spark, d).join(nodes, ["scope", "source"]).select("scope", F.col("target").alias("parent"), F.col("target").alias("parent_ord"), F.struct("loaded_at", "edge_id").alias("pos"), "key", "title", "edge_id")


def phantom_budget(spark: SparkSession, d: str) -> DataFrame:
    return frontier.phantom_edges(_mentions(spark, d), 2, 15).select("scope", "parent", "key", "edge_id")


def phantom_first_mention(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.first_per_key(_mentions(spark, d).where("key <> ''"), ["scope", "key"], ["parent_ord", "pos"]).select("scope", "key", "title", "edge_id")


def phantom_merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.live_nodes(spark, d).where("phantom")
    sets = nodes.select("scope", F.col("node").alias("id"), F.col("node").alias("ord"), content_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("publisher", F.lit("")))).alias("items")).where(F.size("items") >= 2)
    return consolidate.similar_sets(sets, 0.4).select("scope", "a", "b", F.round("jaccard", 6).alias("jaccard"))


def phantom_leaders(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.live_nodes(spark, d).where("phantom").select("scope", F.col("node").alias("id"), F.col("node").alias("ord"))
    return consolidate.leaders(nodes, phantom_merge_pairs(spark, d)).select("scope", "id", "leader")


def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.live_nodes(spark, d).select("scope", F.col("node").alias("id"), F.struct("loaded_at", "id").alias("ord"), "phantom", "source_type")
    return frontier.match_candidates(nodes.where("phantom"), nodes.where("not phantom and id <> 'article' and source_type <> 'data-source'"))


def same_address_remap(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of an analysis at one address go to the least of them; edges follow."""
    nodes = views.live_nodes(spark, d).where("url is not null").select("scope", F.col("node").alias("id"), urls.normalize_url(F.col("url")).alias("u"))
    first = nodes.groupBy("scope", "u").agg(F.min("id").alias("leader"))
    moved = consolidate.redirect_edges(_edges(spark, d), nodes.join(first, ["scope", "u"]).select("scope", "id", "leader"))
    return consolidate.last_per_pair(moved, ["scope", "source", "target"], ["loaded_at", "edge_id"]).select("scope", "edge_id", "source", "target")


def edge_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("scope", "source", "target", "edge_id")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return views.live_nodes(spark, d).select("scope", F.col("node").alias("id"), (F.col("node") == "article").alias("is_root"), "phantom")


def noise_prune(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.noise_nodes(_nodes(spark, d), _edges(spark, d))


def unsubstantiated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.unsubstantiated_nodes(_nodes(spark, d), _edges(spark, d))


def unsubstantiated_claims(spark: SparkSession, d: str) -> DataFrame:
    weak = consolidate.unsubstantiated_nodes(_nodes(spark, d), _edges(spark, d)).withColumnRenamed("id", "node")
    return views.live_claims(spark, d).join(weak, ["scope", "node"], "left_semi").select("scope", "node", F.col("id").alias("claim_id"))


def edge_summary(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).withColumn("n_concerns", (F.col("editorialization") >= 0.6).cast("int"))
    scopes = load(spark, d, "analyses").select(F.col("id").alias("scope"))
    return summary.edge_summary(scopes, edges)


def edge_levels(spark: SparkSession, d: str) -> DataFrame:
    f, e = F.col("source_fidelity").cast("double"), F.col("editorialization").cast("double")
    return _edges(spark, d).select(
        "edge_id", levels.fidelity_level(f).alias("fidelity"), levels.editorial_level(e).alias("editorial"), (levels.editorial_level(e) != "low").alias("shows_editorial"), (F.col("corroboration") != "strong").alias("shows_corroboration"),
        levels.percent(f).alias("percent"), levels.label(F.col("metric_source_type")).alias("label"),
    )


def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = views.live_nodes(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("phantom").alias("n_unlinked"))
    edges = _edges(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("n_links"))
    out = nodes.join(edges, "scope", "full").fillna(0)
    return out.select("scope", levels.counted(F.col("n_sources"), "source").alias("sources"), levels.counted(F.col("n_links"), "link").alias("links"), "n_unlinked")


def recent_list(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "analyses").distinct().select("id", F.unix_micros("created_at").alias("created_us"), levels.first_text(F.col("article_title"), F.col("article_url")).alias("title"), levels.first_text(F.col("article_publisher"), F.lit("")).alias("publisher"))
    return rows.orderBy(F.desc("created_us"), "id").limit(10)


def relative_times(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "analyses").select("id", dates.relative_time(F.col("created_at"), F.lit("2025-12-31 12:00:00").cast("timestamp")).alias("ago")).distinct()


def analysis_reload(spark: SparkSession, d: str) -> DataFrame:
    """Each stored analysis put together by the store, its parts written as text."""
    order = F.struct("loaded_at", F.col("id").alias("_id")).alias("ord")
    head = load(spark, d, "analyses").groupBy("id").agg(F.min_by(F.struct(*[c for c in load(spark, d, "analyses").columns if c not in ("id", "created_at")]), F.struct("created_at", "article_url", "article_date", "summary_text")).alias("r"))
    tables = {
        "analyses": head.select(F.col("id").alias("scope"), "r.*"),
        "nodes": views.live_nodes(spark, d).select("scope", "node", "title", "url", "publisher", "date", "source_type", "snippet", "phantom", "phantom_key", order),
        "edges": views.live_edges(spark, d).select("scope", F.col("id").alias("edge_id"), "source", "target", "source_fidelity", "editorialization", "metric_source_type", "corroboration", order),
        "claims": views.live_claims(spark, d).select("scope", "node", "claim_text", "attribution", order),
    }
    empty = F.lit("")
    node = lambda n: F.concat_ws(":", n["id"], F.coalesce(n["url"], empty), F.coalesce(n["phantom_key"], empty), F.when(n["attributed_claims"].isNull(), "-").otherwise(F.size(n["attributed_claims"]).cast("string")))
    edge = lambda e: F.concat_ws(">", e["source"], e["target"], e["metrics"]["corroboration"], F.size(e["concerns"]).cast("string"))
    said = lambda e: F.concat_ws(":", e["key"], F.array_join(F.transform(e["value"], lambda c: F.md5(F.concat(F.coalesce(c["claim"], empty), F.lit("/"), F.coalesce(c["attribution"], empty)))), "+"))
    return store.reassemble(tables).select(
        "scope", "article_url", F.coalesce("summary.text", empty).alias("summary_text"), F.coalesce("summary.concern_count", F.lit(-1)).cast("long").alias("concern_count"), F.coalesce("summary.strong_corroboration", F.lit(-1)).cast("long").alias("strong_corroboration"),
        F.coalesce(F.array_join(F.transform("nodes", node), ","), empty).alias("nodes"), F.coalesce(F.array_join(F.transform("edges", edge), ","), empty).alias("edges"),
        F.coalesce(F.array_join(F.transform(F.map_entries("claims"), said), ","), empty).alias("claims"),
    )


def entity_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return store.entity_table(*views.extracted(spark, d))


def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Per analysis and entity the nodes whose claims name it."""
    return corroboration.entity_nodes(views.extracted(spark, d)[0]).select("scope", "entity", F.array_join("nodes", ",").alias("nodes"))


def extraction_counts(spark: SparkSession, d: str) -> DataFrame:
    triples, lists = views.extracted(spark, d)
    return summary.extraction_counts(views.live_claims(spark, d).select("scope"), store.entity_table(triples, lists), triples)


def request_check(spark: SparkSession, d: str) -> DataFrame:
    """Which of what may stand where an address should can be asked for, and why the rest cannot."""
    rows = load(spark, d, "analyses").select(F.col("article_url").alias("url")).unionByName(load(spark, d, "source_nodes").select(F.col("publisher").alias("url"))).distinct()
    good, rejects = urls.split_requests(rows)
    return good.withColumn("reason", F.lit("")).unionByName(rejects)


def entity_index(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "entities").where("canonical_name <> '' and analysis_id is not null")
    return rows.groupBy(F.lower("canonical_name").alias("entity")).agg(F.count_distinct("analysis_id").alias("n_analyses"))


def triple_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose ends are both in the analysis's dictionary of entities, by key."""
    triples, lists = views.extracted(spark, d)
    out = store.resolve_triples(triples, store.entity_table(triples, lists))
    return out.groupBy("scope", "subject_key", "object_key").agg(F.count(F.lit(1)).alias("n_triples"))


def claim_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = views.live_claims(spark, d).withColumn("key", claim_key(F.col("claim_text")))
    return consolidate.first_per_key(rows, ["scope", "node", "key"], ["loaded_at", "id"]).select("scope", "node", F.col("id").alias("claim_id"))


def node_names_entity(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node's title or snippet names someone its analysis's article quotes."""
    names = views.live_claims(spark, d).where("node = 'article' and attribution <> ''").groupBy("scope").agg(F.collect_set(F.lower("attribution")).alias("names"))
    nodes = views.live_nodes(spark, d).join(names, "scope")
    return nodes.select("scope", "node", pages.names_entity(F.lower(F.concat_ws(" ", "title", "snippet")), F.col("names")).alias("topical"))


def unverified_lists(spark: SparkSession, d: str) -> DataFrame:
    v = jsonval.parse_json(F.concat(F.lit('{"a":'), F.col("summary_unverified_claims"), F.lit("}")))
    items = jsonval.texts(v, "$.a")
    return load(spark, d, "analyses").where("summary_unverified_claims is not null").select("id", F.size(items).alias("n_items"), F.array_join(items, "|").alias("items")).distinct()


def event_numbers(spark: SparkSession, d: str) -> DataFrame:
    v = jsonval.parse_json(F.col("props"))
    return load(spark, d, "events").select("event_id", F.when(jsonval.is_number(jsonval.get(v, "$.k")), F.try_variant_get(v, "$.k", "double")).alias("k"), jsonval.unit_number(v, "$.k").alias("unit"), jsonval.text_at(v, "$.k").alias("as_text"))


def source_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.source_trees(_edges(spark, d).select("scope", "edge_id", "source", "target", F.col("loaded_at").alias("seq")))


_NODE_SQL = "WITH " + views.SQL
_ENDS = """ends AS (SELECT scope, source AS id, source_fidelity, corroboration FROM live_edges UNION ALL SELECT scope, target, source_fidelity, corroboration FROM live_edges)"""
_MATCH = """
dir AS (SELECT DISTINCT scope, node, lower(subject) AS s, lower(object) AS o FROM triples),
m AS (SELECT e.scope, e.id AS edge_id, count(*) AS matched FROM live_edges e JOIN dir a ON a.scope = e.scope AND a.node = e.source
  WHERE EXISTS (SELECT 1 FROM dir b WHERE b.scope = e.scope AND b.node = e.target AND ((a.s = b.s AND a.o = b.o) OR (a.s = b.o AND a.o = b.s))) GROUP BY ALL)"""
_CLOSE = """
ok AS (SELECT scope, node, embedding::DOUBLE[] AS v FROM live_claims WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
close AS (SELECT DISTINCT e.scope, e.id AS edge_id FROM live_edges e JOIN ok a ON a.scope = e.scope AND a.node = e.source JOIN ok b ON b.scope = e.scope AND b.node = e.target WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.85)"""
_MENTION_SQL = """
mention AS (SELECT e.scope, e.target AS parent, e.loaded_at, e.id AS edge_id, coalesce(trim(n.phantom_key), '') AS key, n.title FROM live_edges e JOIN live_nodes n ON n.scope = e.scope AND n.node = e.source WHERE n.phantom)"""

_PHANTOM_PAIRS = f"""w AS (SELECT scope, node, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(concat_ws(' ', coalesce(title, ''), coalesce(publisher, ''))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),
        lambda x: length(x) > 2 AND x NOT IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS s FROM live_nodes WHERE phantom), k AS (SELECT * FROM w WHERE len(s) >= 2),
      alike AS (SELECT a.scope, a.node AS a, b.node AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard
      FROM k a JOIN k b ON a.scope = b.scope AND a.node < b.node WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.4 - 1e-12)"""

SQL = {
    "matched_pairs": f"{_NODE_SQL}, {_MATCH} SELECT scope, edge_id, matched FROM m",
    "similar_claim_edges": f"{_NODE_SQL}, {_CLOSE} SELECT scope, edge_id FROM close",
    "corroboration_levels": f"""{_NODE_SQL}, {_MATCH}, {_CLOSE}, has AS (SELECT DISTINCT scope, node FROM live_claims)
      SELECT e.scope, e.id AS edge_id, CASE WHEN a.node IS NULL OR b.node IS NULL THEN 'unverified' WHEN matched >= 2 THEN 'strong' WHEN matched >= 1 OR c.edge_id IS NOT NULL THEN 'partial' ELSE 'none' END AS corroboration
      FROM live_edges e LEFT JOIN has a ON a.scope = e.scope AND a.node = e.source LEFT JOIN has b ON b.scope = e.scope AND b.node = e.target
      LEFT JOIN m ON m.scope = e.scope AND m.edge_id = e.id LEFT JOIN close c ON c.scope = e.scope AND c.edge_id = e.id""",
    "shared_pair_context": f"""{_NODE_SQL}, bp AS (SELECT scope, node, least(lower(subject), lower(object)) AS lo, greatest(lower(subject), lower(object)) AS hi, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS ps FROM triples GROUP BY ALL),
      h AS (SELECT e.scope, e.id AS edge_id, a.lo, a.hi, a.ps AS p1, b.ps AS p2, row_number() OVER (PARTITION BY e.scope, e.id ORDER BY a.lo, a.hi) AS r FROM live_edges e JOIN bp a ON a.scope = e.scope AND a.node = e.source JOIN bp b ON b.scope = e.scope AND b.node = e.target AND a.lo = b.lo AND a.hi = b.hi)
      SELECT scope, edge_id, string_agg(lo || '|' || hi || '|' || p1 || '|' || p2, ';' ORDER BY lo, hi) AS shared FROM h WHERE r <= 10 GROUP BY ALL""",
    "temporal_gaps": f"""{_NODE_SQL}, n AS (SELECT scope, node, try_cast(regexp_extract(date, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:[T\\s]|$)', 1) AS DATE) AS day FROM live_nodes),
      g AS (SELECT e.id AS edge_id, date_diff('day', a.day, b.day) AS k FROM live_edges e JOIN n a ON a.scope = e.scope AND a.node = e.source JOIN n b ON b.scope = e.scope AND b.node = e.target WHERE a.day IS NOT NULL AND b.day IS NOT NULL)
      SELECT edge_id, CASE WHEN k > 14 THEN CASE WHEN floor(k / 30 + 0.5) >= 2 THEN '~' || floor(k / 30 + 0.5)::INT || ' months older' ELSE '~' || floor(k / 7 + 0.5)::INT || ' weeks older' END
        WHEN k < -14 THEN '~' || floor(-k / 7 + 0.5)::INT || ' weeks newer' ELSE '' END AS gap FROM g""",
    "frontier_topk": f"""{_NODE_SQL} SELECT scope, node, priority, rank::INT AS rank FROM (SELECT scope, node, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY scope ORDER BY {_PRIORITY} DESC, loaded_at, id) AS rank FROM live_nodes WHERE url IS NOT NULL) WHERE rank <= 15""",
    "phantom_budget": f"""{_NODE_SQL}, {_MENTION_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY scope, parent ORDER BY loaded_at, edge_id) AS r FROM mention),
      b AS (SELECT *, row_number() OVER (PARTITION BY scope, parent, key ORDER BY loaded_at, edge_id) AS r2 FROM a WHERE r <= 2 AND key <> ''), c AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY parent, loaded_at, edge_id) AS r3 FROM b WHERE r2 = 1)
      SELECT scope, parent, key, edge_id FROM c WHERE r3 <= 15""",
    "phantom_first_mention": f"""{_NODE_SQL}, {_MENTION_SQL} SELECT scope, key, title, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY parent, loaded_at, edge_id) AS r FROM mention WHERE key <> '') WHERE r = 1""",
    "match_candidates": f"""{_NODE_SQL}, p AS (SELECT scope, node, row_number() OVER (PARTITION BY scope ORDER BY loaded_at, id) AS o FROM live_nodes WHERE phantom),
      r AS (SELECT scope, node, row_number() OVER (PARTITION BY scope ORDER BY loaded_at, id) AS o FROM live_nodes WHERE NOT phantom AND node <> 'article' AND source_type <> 'data-source')
      SELECT scope, phantom, real, place FROM (SELECT p.scope, p.node AS phantom, r.node AS real, row_number() OVER (PARTITION BY p.scope ORDER BY p.o, r.o) AS place FROM p JOIN r ON p.scope = r.scope) WHERE place <= 50""",
    "candidate_parents": f"""{_NODE_SQL}, u AS (SELECT DISTINCT url FROM (SELECT url FROM source_nodes UNION ALL SELECT article_url FROM analyses) WHERE url IS NOT NULL), {page_queries.NORM_STEPS},
      links AS (SELECT e.scope, x.url, e.target AS parent, e.loaded_at, e.id, n.norm_url FROM live_edges e JOIN live_nodes x ON x.scope = e.scope AND x.node = e.source JOIN n ON n.url = x.url),
      fresh AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM analyses a JOIN n m ON m.url = a.article_url WHERE a.id = l.scope AND m.norm_url = l.norm_url))
      SELECT scope, norm_url, arg_min(url, struct_pack(a := loaded_at, b := id)) AS url, count(DISTINCT parent) AS n_parents FROM fresh GROUP BY ALL""",
    "same_address_remap": f"""{_NODE_SQL}, u AS (SELECT DISTINCT url FROM source_nodes WHERE url IS NOT NULL), {page_queries.NORM_STEPS},
      a AS (SELECT x.scope, x.node, min(x.node) OVER (PARTITION BY x.scope, n.norm_url) AS leader FROM live_nodes x JOIN n ON n.url = x.url), m AS (SELECT * FROM a WHERE node <> leader),
      moved AS (SELECT e.scope, e.id AS edge_id, e.loaded_at, coalesce(s.leader, e.source) AS source, coalesce(t.leader, e.target) AS target FROM live_edges e LEFT JOIN m s ON s.scope = e.scope AND s.node = e.source LEFT JOIN m t ON t.scope = e.scope AND t.node = e.target)
      SELECT scope, edge_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY scope, source, target ORDER BY loaded_at DESC, edge_id DESC) AS r FROM moved WHERE source <> target) WHERE r = 1""",
    "phantom_merge_pairs": f"WITH {views.SQL}, {_PHANTOM_PAIRS} SELECT scope, a, b, round(jaccard, 6) AS jaccard FROM alike",
    "unverified_lists": """WITH l AS (SELECT DISTINCT id, CASE WHEN json_valid(summary_unverified_claims) THEN CASE WHEN json_type(summary_unverified_claims) = 'ARRAY'
        THEN list_transform(list_filter(json_extract(summary_unverified_claims, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) END END AS items FROM analyses WHERE summary_unverified_claims IS NOT NULL)
      SELECT id, coalesce(len(items), 0)::INT AS n_items, coalesce(array_to_string(items, '|'), '') AS items FROM l""",
    "edge_dedupe_last": f"{_NODE_SQL} SELECT scope, source, target, id AS edge_id FROM live_edges",
    "noise_prune": f"""{_NODE_SQL}, {_ENDS} SELECT n.scope, n.node AS id FROM live_nodes n LEFT JOIN ends e ON e.scope = n.scope AND e.id = n.node WHERE n.node <> 'article' AND NOT coalesce(n.phantom, false)
      GROUP BY ALL HAVING NOT coalesce(bool_or(coalesce(source_fidelity >= 0.2 OR corroboration <> 'none', false)), false)""",
    "unsubstantiated_nodes": f"""{_NODE_SQL}, w AS (SELECT scope, source, bool_and(corroboration IN ('none', 'unverified')) AS weak FROM live_edges GROUP BY ALL)
      SELECT n.scope, n.node AS id FROM live_nodes n LEFT JOIN w ON w.scope = n.scope AND w.source = n.node WHERE n.node <> 'article' AND (coalesce(n.phantom, false) OR coalesce(weak, true))""",
    "unsubstantiated_claims": f"""{_NODE_SQL}, w AS (SELECT scope, source, bool_and(corroboration IN ('none', 'unverified')) AS weak FROM live_edges GROUP BY ALL)
      SELECT c.scope, c.node, c.id AS claim_id FROM live_claims c JOIN live_nodes n ON n.scope = c.scope AND n.node = c.node LEFT JOIN w ON w.scope = n.scope AND w.source = n.node WHERE n.node <> 'article' AND (coalesce(n.phantom, false) OR coalesce(weak, true))""",
    "edge_summary": f"""{_NODE_SQL} SELECT a.id AS scope, coalesce(floor(avg(source_fidelity::DOUBLE) * 100 + 0.5) / 100, 0) AS overall_fidelity, coalesce(sum((editorialization >= 0.6)::INT), 0)::BIGINT AS concern_count,
      count(*) FILTER (WHERE corroboration = 'strong') AS strong_corroboration, count(*) FILTER (WHERE corroboration IN ('none', 'unverified')) AS weak_corroboration, count(e.id) AS n_edges
      FROM (SELECT DISTINCT id FROM analyses) a LEFT JOIN live_edges e ON e.scope = a.id GROUP BY a.id""",
    "edge_levels": f"""{_NODE_SQL} SELECT id AS edge_id, CASE WHEN source_fidelity::DOUBLE >= 0.75 THEN 'high' WHEN source_fidelity::DOUBLE >= 0.5 THEN 'medium' ELSE 'low' END AS fidelity,
      CASE WHEN editorialization::DOUBLE >= 0.6 THEN 'high' WHEN editorialization::DOUBLE >= 0.3 THEN 'medium' ELSE 'low' END AS editorial,
      CASE WHEN editorialization::DOUBLE >= 0.3 THEN true ELSE false END AS shows_editorial, corroboration <> 'strong' AS shows_corroboration, floor(source_fidelity::DOUBLE * 100 + 0.5)::BIGINT AS percent,
      CASE metric_source_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in levels.LABELS.items())} ELSE metric_source_type END AS label FROM live_edges""",
    "graph_counts": f"""{_NODE_SQL}, n AS (SELECT scope, count(*) AS n_sources, count(*) FILTER (WHERE phantom) AS n_unlinked FROM live_nodes GROUP BY 1), e AS (SELECT scope, count(*) AS n_links FROM live_edges GROUP BY 1),
      j AS (SELECT scope, coalesce(n_sources, 0) AS s, coalesce(n_links, 0) AS l, coalesce(n_unlinked, 0) AS n_unlinked FROM n FULL JOIN e USING (scope))
      SELECT scope, s || ' source' || CASE WHEN s = 1 THEN '' ELSE 's' END AS sources, l || ' link' || CASE WHEN l = 1 THEN '' ELSE 's' END AS links, n_unlinked FROM j""",
    "recent_list": "SELECT id, epoch_us(created_at) AS created_us, coalesce(nullif(article_title, ''), nullif(article_url, '')) AS title, coalesce(nullif(article_publisher, ''), NULL) AS publisher FROM (SELECT DISTINCT * FROM analyses) ORDER BY created_at DESC, id LIMIT 10",
    "relative_times": """WITH t AS (SELECT DISTINCT id, floor((epoch_us(TIMESTAMPTZ '2025-12-31 12:00:00+00') - epoch_us(created_at)) / 1000000)::BIGINT AS s FROM analyses)
      SELECT DISTINCT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM t""",
    "analysis_reload": f"""{_NODE_SQL}, n AS (SELECT scope, string_agg(node || ':' || coalesce(url, '') || ':' || CASE WHEN phantom THEN coalesce(phantom_key, '') ELSE '' END || CASE WHEN phantom THEN ':0' ELSE ':-' END, ',' ORDER BY loaded_at, id) AS nodes FROM live_nodes GROUP BY 1),
      e AS (SELECT scope, string_agg(concat_ws('>', source, target, corroboration, '0'), ',' ORDER BY loaded_at, id) AS edges FROM live_edges GROUP BY 1),
      k AS (SELECT scope, node, node || ':' || string_agg(md5(coalesce(claim_text, '') || '/' || coalesce(attribution, '')), '+' ORDER BY loaded_at, id) AS x FROM live_claims GROUP BY scope, node), c AS (SELECT scope, string_agg(x, ',' ORDER BY node) AS claims FROM k GROUP BY 1),
      h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, article_url, article_date NULLS FIRST, summary_text NULLS FIRST) AS r FROM analyses)
      SELECT h.id AS scope, article_url, CASE WHEN summary_text <> '' THEN summary_text ELSE '' END AS summary_text, CASE WHEN summary_text <> '' THEN coalesce(summary_concern_count, 0) ELSE -1 END::BIGINT AS concern_count,
        CASE WHEN summary_text <> '' THEN coalesce(summary_strong_corroboration, 0) ELSE -1 END::BIGINT AS strong_corroboration, coalesce(nodes, '') AS nodes, coalesce(edges, '') AS edges, coalesce(claims, '') AS claims
      FROM h LEFT JOIN n ON n.scope = h.id LEFT JOIN e ON e.scope = h.id LEFT JOIN c ON c.scope = h.id WHERE r = 1""",
    "entity_dictionary": f"{_NODE_SQL} SELECT scope, key, name, type FROM dictionary",
    "entity_nodes": f"{_NODE_SQL}, x AS (SELECT scope, lower(subject) AS entity, node FROM triples WHERE subject <> '' UNION SELECT scope, lower(object), node FROM triples) SELECT scope, entity, string_agg(node, ',' ORDER BY node) AS nodes FROM x GROUP BY 1, 2",
    "extraction_counts": f"""{_NODE_SQL}, x AS (SELECT scope, 'c' AS k FROM live_claims UNION ALL SELECT scope, 'e' FROM dictionary UNION ALL SELECT scope, 't' FROM triples)
      SELECT scope, count(*) FILTER (WHERE k = 'c') AS n_claims, count(*) FILTER (WHERE k = 'e') AS n_entities, count(*) FILTER (WHERE k = 't') AS n_triples FROM x GROUP BY 1""",
    "request_check": r"""WITH u AS (SELECT article_url AS url FROM analyses UNION SELECT publisher FROM source_nodes)
      SELECT url, CASE WHEN regexp_matches(coalesce(url, ''), '^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:\s]+)(:\d*)?([^?#]*)(\?[^#]*)?(#.*)?$') THEN '' WHEN trim(coalesce(url, '')) = '' THEN 'empty' ELSE 'not an address' END AS reason FROM u""",
    "entity_index": "SELECT lower(canonical_name) AS entity, count(DISTINCT analysis_id) AS n_analyses FROM entities WHERE canonical_name <> '' AND analysis_id IS NOT NULL GROUP BY 1",
    "triple_resolution": f"{_NODE_SQL} SELECT t.scope, lower(subject) AS subject_key, lower(object) AS object_key, count(*) AS n_triples FROM triples t JOIN dictionary a ON a.scope = t.scope AND a.key = lower(subject) JOIN dictionary b ON b.scope = t.scope AND b.key = lower(object) GROUP BY ALL",
    # A scope's phantoms in order, one more each round: a node leads if no leader so far is similar.
    "phantom_leaders": f"""WITH RECURSIVE {views.SQL}, {_PHANTOM_PAIRS}, o AS (SELECT scope, node, row_number() OVER (PARTITION BY scope ORDER BY node) AS i FROM live_nodes WHERE phantom),
      near AS (SELECT scope, b AS node, list(a ORDER BY a) AS before FROM alike GROUP BY 1, 2), q AS (SELECT o.*, coalesce(before, []) AS before FROM o LEFT JOIN near USING (scope, node)),
      s AS (SELECT scope, 0 AS i, []::VARCHAR[] AS lead, NULL::VARCHAR AS id, NULL::VARCHAR AS leader FROM o WHERE i = 1
        UNION ALL SELECT q.scope, q.i, CASE WHEN len(list_filter(q.before, lambda x: list_contains(s.lead, x))) = 0 THEN list_append(s.lead, q.node) ELSE s.lead END, q.node, coalesce(list_filter(q.before, lambda x: list_contains(s.lead, x))[1], q.node) FROM s JOIN q ON q.scope = s.scope AND q.i = s.i + 1)
      SELECT scope, id, leader FROM s WHERE id IS NOT NULL""",
    # A scope's walk, one node each round: the stack holds (node, edge, parent, depth), what is entered holds nodes.
    "source_tree": f"""WITH RECURSIVE {views.SQL}, kids AS (SELECT scope, target, list({{'node': source, 'edge': id}} ORDER BY loaded_at, id) AS below FROM live_edges GROUP BY 1, 2),
      s AS (SELECT DISTINCT scope, -1 AS place, [{{'node': 'article', 'edge': NULL::VARCHAR, 'parent': NULL::VARCHAR, 'depth': 0}}] AS stack, []::VARCHAR[] AS entered, NULL::STRUCT(node VARCHAR, edge VARCHAR, parent VARCHAR, depth INT) AS shown FROM live_edges
        UNION ALL SELECT t.scope, t.place + 1, list_concat(list_transform(list_filter(coalesce(below, []), lambda k: k.node <> t.top.node AND NOT list_contains(t.entered, k.node)), lambda k: {{'node': k.node, 'edge': k.edge, 'parent': t.top.node, 'depth': t.top.depth + 1}}), t.rest), list_append(t.entered, t.top.node), t.top
          FROM (SELECT scope, place, stack[1] AS top, stack[2:] AS rest, entered FROM s WHERE len(stack) > 0) t LEFT JOIN kids ON kids.scope = t.scope AND kids.target = t.top.node)
      SELECT scope, place, shown.depth AS depth, shown.node AS node_id, shown.edge AS edge_id, shown.parent AS parent_id FROM s WHERE shown IS NOT NULL""",
    "claim_dedupe": f"{_NODE_SQL} SELECT scope, node, id AS claim_id FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY scope, node, left(lower(claim_text), 80) ORDER BY loaded_at, id) AS r FROM live_claims) WHERE r = 1",
    "node_names_entity": f"""{_NODE_SQL}, a AS (SELECT scope, list(DISTINCT lower(attribution)) AS names FROM live_claims WHERE node = 'article' AND attribution <> '' GROUP BY 1)
      SELECT n.scope, n.node, len(list_filter(names, lambda e: contains(lower(concat_ws(' ', n.title, n.snippet)), e))) > 0 AS topical FROM live_nodes n JOIN a USING (scope)""",
    "event_numbers": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(props, '$.k')::DOUBLE END AS k, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN greatest(0, least(1, json_extract_string(props, '$.k')::DOUBLE)) ELSE 0.5 END AS unit, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') ELSE '' END AS as_text FROM events",
}

QUERIES = {
    f.__name__: f
    for f in (
        corroboration_levels, matched_pairs, similar_claim_edges, shared_pair_context, temporal_gaps, frontier_topk, candidate_parents, phantom_budget, phantom_first_mention, phantom_merge_pairs, phantom_leaders,
        match_candidates, same_address_remap, edge_dedupe_last, noise_prune, unsubstantiated_nodes, unsubstantiated_claims, edge_summary, edge_levels, graph_counts, recent_list, relative_times, analysis_reload,
        entity_dictionary, entity_nodes, extraction_counts, request_check, entity_index, triple_resolution, claim_dedupe, node_names_entity, unverified_lists, event_numbers, source_tree,
    )
}
