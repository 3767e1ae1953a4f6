"""A batch of analyses: from article addresses to scored citation graphs.

Every table is keyed by `scope`, so one run serves any number of articles; budgets hold within a scope. The loop over
depths is on the driver; each depth is written before the next, so lineage stays short. Order is fixed by (depth, rank),
where a service would number by what finished first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citetrail.config import PipelineConfig
from citetrail.functions import jsonval, pages, text, urls
from citetrail.functions.dates import temporal_gap
from citetrail.functions.levels import first_text
from citetrail.models.base import ModelClient, ask
from citetrail.operators import consolidate, corroboration, frontier, summary
from citetrail.runtime import materialise
from citetrail.sources.corpus import PageSource

STUB_CONCERN = "The page could not be read as an article."


def classify(rows: DataFrame, model: ModelClient, config: PipelineConfig) -> DataFrame:
    """Adds `c`, what the page is."""
    links = jsonval.link_list(F.coalesce("links", F.array().cast("array<struct<href:string,text:string,internal:boolean>>")))
    prompt = F.concat(F.col("url"), F.lit("\n"), F.col("page_title"), F.lit("\n\n"), text.truncated(F.col("markdown"), config.max_classify_chars), F.when(links != "", F.concat(F.lit("\n\nLinks:\n"), links)).otherwise(""))
    return ask(model, rows, "classify", prompt).withColumn("c", jsonval.classification(F.col("raw"))).drop("raw")


def extract_claims(rows: DataFrame, model: ModelClient, config: PipelineConfig) -> DataFrame:
    """scope, node, ord, claim, entities, attribution, triples, embedding: claims of each page, long pages by passages with repeats dropped."""
    chunks = text.chunk_markdown(F.col("markdown"), config.chunk_threshold, config.chunk_target, config.chunk_overlap)
    parts = rows.select("scope", "node", "title", F.size(chunks).alias("n"), F.posexplode(chunks).alias("chunk", "passage"))
    title = F.when(F.col("n") > 1, F.format_string("%s [part %d/%d]", "title", F.col("chunk") + 1, "n")).otherwise(F.col("title"))
    asked = ask(model, parts, "claims", F.concat(title, F.lit("\n\n"), text.truncated(F.col("passage"), config.max_extract_chars)))
    found = asked.select("scope", "node", "n", "chunk", F.posexplode(jsonval.claims(F.col("raw"))).alias("pos", "c")).select("scope", "node", "n", F.struct("chunk", "pos").alias("ord"), "c.*")
    key = F.when(F.col("n") > 1, text.claim_key(F.col("claim"))).otherwise(F.concat_ws(":", "ord.chunk", "ord.pos"))
    once = consolidate.first_per_key(found.withColumn("_key", key), ["scope", "node", "_key"], ["ord"]).drop("_key", "n")
    return model.embed(once)


def _candidates(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """scope, url, parent, priority, ord: addresses the model names, then inline links that name an entity."""
    named = nodes.select("scope", F.col("node").alias("parent"), "node_ord", F.lit(100).alias("priority"), F.posexplode("c.sourceUrls").alias("pos", "url"))
    inline = nodes.join(entities, "scope").select("scope", F.col("node").alias("parent"), "node_ord", F.lit(50).alias("priority"), F.posexplode(text.links_naming(text.inline_links(F.col("markdown")), F.col("entities"))).alias("pos", "l"))
    both = named.unionByName(inline.select("scope", "parent", "node_ord", "priority", "pos", F.col("l.url").alias("url")))
    return both.select("scope", "url", "parent", "priority", F.struct("node_ord", F.col("priority") * -1, "pos").alias("ord"))


def _triples(claims: DataFrame) -> DataFrame:
    return claims.select("scope", "node", "ord", F.posexplode("triples").alias("pos", "t")).select("scope", "node", "ord", "pos", "t.*")


def _score(edges: DataFrame, nodes: DataFrame, claims: DataFrame, model: ModelClient, config: PipelineConfig) -> DataFrame:
    """Edges with corroboration; only those with some are put to the model, with what both sides speak of and how far apart they are."""
    triples = _triples(claims)
    level = materialise(corroboration.corroboration(edges, claims.select("scope", "node", "embedding"), triples, config.corroboration_similarity))
    weak = level.where("corroboration in ('none', 'unverified')").select("*", F.lit(0.5).alias("source_fidelity"), F.lit(0.5).alias("editorialization"), F.array().cast("array<string>").alias("concerns"))
    page = nodes.select("scope", "node", F.col("markdown").alias("m"), F.col("c.date").alias("d"))
    todo = level.where("corroboration in ('partial', 'strong')")
    todo = todo.join(page.select("scope", F.col("node").alias("source"), F.col("m").alias("sm"), F.col("d").alias("sd")), ["scope", "source"]).join(page.select("scope", F.col("node").alias("target"), F.col("m").alias("tm"), F.col("d").alias("td")), ["scope", "target"])
    todo = todo.join(corroboration.shared_context(level.select("scope", "edge_id", "source", "target"), triples), ["scope", "edge_id"], "left")
    line = lambda x: F.concat(x["lo"], F.lit(" / "), x["hi"], F.lit(": "), F.array_join(x["source_predicates"], ", "), F.lit(" | "), F.array_join(x["target_predicates"], ", "))
    context = F.concat_ws("\n", F.array_join(F.transform("shared", line), "\n"), temporal_gap(F.col("sd").try_cast("date"), F.col("td").try_cast("date")))
    prompt = F.concat_ws("\n", "edge_id", context, text.truncated(F.col("sm"), config.max_edge_chars), text.truncated(F.col("tm"), config.max_edge_chars))
    strong = ask(model, todo, "edge", prompt).withColumn("e", jsonval.edge_scores(F.col("raw")))
    strong = strong.select(*level.columns, F.col("e.sourceFidelity").alias("source_fidelity"), F.col("e.editorialization").alias("editorialization"), F.col("e.concerns").alias("concerns"))
    return weak.unionByName(strong)


def _phantoms(nodes: DataFrame, model: ModelClient, config: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    """Nodes of sources that are named but not linked, and their edges, within the budgets."""
    open_ = nodes.where((F.col("depth") <= config.max_phantom_depth) & ((F.col("c.sourceType") != "data-source") | (F.col("node") == "article")))
    said = open_.select("scope", F.col("node").alias("parent"), F.col("node_ord").alias("parent_ord"), "markdown", F.posexplode("c.unlinkedSources").alias("pos", "u")).withColumn("key", F.col("u.canonicalKey"))
    kept = materialise(frontier.phantom_edges(said, int(config.max_phantom_per_parent), int(config.max_phantom_edges)))
    first = consolidate.first_per_key(kept, ["scope", "key"], ["parent_ord", "pos"])
    numbered = first.withColumn("node", F.concat(F.lit("p-"), F.row_number().over(Window.partitionBy("scope").orderBy("parent_ord", "pos"))))
    edges = kept.join(numbered.select("scope", "key", "node"), ["scope", "key"])
    scored = ask(model, edges, "phantom", F.concat_ws("\n", F.concat(F.col("node"), F.lit(" "), F.col("parent")), F.col("u.description"), text.truncated(F.col("markdown"), config.max_extract_chars))).withColumn("e", jsonval.edge_scores(F.col("raw")))
    scored = materialise(scored.drop("raw", "markdown"))
    said_by = scored.groupBy("scope", "node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("parent_ord", "pos", "e.attributedClaims"))), lambda x: x["attributedClaims"])).alias("attributed_claims"))
    out = numbered.join(said_by, ["scope", "node"]).select(
        "scope", "node", F.lit(None).cast("string").alias("url"), F.col("u.description").alias("title"), F.col("u.publisher").alias("publisher"), F.col("u.date").alias("date"), F.col("u.sourceType").alias("source_type"),
        F.substring(F.array_join(F.slice("attributed_claims", 1, 2), "; "), 1, 200).alias("snippet"), F.lit(True).alias("phantom"), F.lit(False).alias("unscrapable"), F.col("key").alias("phantom_key"), "attributed_claims", F.lit(None).cast("string").alias("markdown"),
        F.struct(F.lit(9).alias("depth"), F.substring("node", 3, 9).cast("int").alias("rank")).alias("node_ord"),
    )
    links = scored.select(
        "scope", F.concat_ws("-", "parent", "node").alias("edge_id"), F.col("node").alias("source"), F.col("parent").alias("target"), F.col("u.sourceType").alias("source_type"), F.lit("unverified").alias("corroboration"),
        F.col("e.sourceFidelity").alias("source_fidelity"), F.col("e.editorialization").alias("editorialization"), F.col("e.concerns").alias("concerns"), F.struct("parent_ord", "pos").cast("struct<a:struct<depth:int,rank:int>,b:int>").alias("seq"),
    )
    return out, links


def _node_rows(rows: DataFrame, unscrapable: Column) -> DataFrame:
    return rows.select(
        "scope", "node", "url", "title", F.col("c.publisher").alias("publisher"), F.col("c.date").alias("date"), F.col("c.sourceType").alias("source_type"), F.col("c.snippet").alias("snippet"), F.lit(False).alias("phantom"),
        unscrapable.alias("unscrapable"), F.lit(None).cast("string").alias("phantom_key"), F.array().cast("array<string>").alias("attributed_claims"), "markdown", "node_ord",
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def run(articles: DataFrame, source: PageSource, model: ModelClient, config: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """nodes, edges, claims, triples, summary, failed of each article(scope, url). Articles that cannot be read are in `failed`."""
    c = config
    fetched = materialise(source.fetch(articles.select("scope", "url").dropDuplicates(["scope"])))
    failed = fetched.where("not success").select("scope", "url")
    root = classify(fetched.where("success"), model, c)
    root = materialise(root.withColumns({"node": F.lit("article"), "depth": F.lit(0), "node_ord": F.struct(F.lit(0).alias("depth"), F.lit(0).alias("rank")), "title": first_text(F.col("c.title"), F.col("page_title"), F.col("c.publisher"), F.col("url"))}))
    root_claims = materialise(extract_claims(root, model, c))
    named = root_claims.select("scope", F.explode("entities").alias("e")).groupBy("scope").agg(F.collect_set(F.lower("e")).alias("entities"))
    entities = materialise(root.select("scope").join(named, "scope", "left").select("scope", F.coalesce("entities", F.array().cast("array<string>")).alias("entities")))
    topic = materialise(root.select("scope", text.content_words(F.concat_ws(" ", "title", "c.snippet")).alias("topic")))
    visited = root.select("scope", urls.normalize_url(F.col("url")).alias("norm_url"))
    parents = visited.where("1 = 0").withColumn("parent", F.lit(""))
    level, parents = frontier.gather_candidates(_candidates(root, entities), visited, parents)
    level, parents = materialise(level), materialise(parents)
    visited = materialise(visited.unionByName(level.select("scope", "norm_url")))
    done = root.select("scope", F.lit(0).alias("n_done"), F.lit(0).alias("n_nodes"))
    pages_, claims_, edges_, stubs_ = [root], [root_claims], [], []
    for depth in range(1, int(c.max_depth) + 1):
        w = Window.partitionBy("scope").orderBy(F.desc("priority"), "ord")
        chosen = level.join(done, "scope").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.least(F.lit(int(c.max_urls_per_level)), F.lit(int(c.max_urls)) - F.col("n_done"))).drop("n_done")
        got = source.fetch(chosen.select("scope", "norm_url", "url", "rank", "n_nodes")).where("success").join(entities, "scope").join(topic, "scope")
        kind = pages.page_kind(F.col("success"), F.col("url"), F.col("page_title"), F.col("markdown"))
        topical = pages.is_topical(F.col("page_title"), F.col("markdown"), F.col("entities"), text.content_words(F.col("page_title")), F.col("topic"), int(c.min_topic_overlap))
        got = got.withColumn("kind", kind).where((F.col("kind") == "unscrapable") | topical)
        got = materialise(got.withColumns({"depth": F.lit(depth), "node": F.concat(F.lit("s-"), F.col("n_nodes") + F.row_number().over(Window.partitionBy("scope").orderBy("rank"))), "node_ord": F.struct(F.lit(depth).alias("depth"), F.col("rank").cast("int").alias("rank"))}).drop("entities", "topic"))
        if got.isEmpty():
            break
        articles_ = classify(got.where("kind in ('article', 'knowledge-base')"), model, c)
        kb = F.when(F.col("kind") == "knowledge-base", F.lit("data-source")).otherwise(F.col("c.sourceType"))
        articles_ = articles_.withColumn("c", F.col("c").withField("sourceType", kb)).withColumn("title", first_text(F.col("c.title"), F.col("page_title"), F.col("c.publisher"), F.col("url")))
        articles_ = materialise(articles_)
        stub = got.where("kind not in ('article', 'knowledge-base')").withColumn("c", jsonval.classification(F.lit(None).cast("string")).withField("sourceType", F.lit("data-source")).withField("publisher", urls.publisher_from_url(F.col("url"))))
        stub = materialise(stub.withColumn("title", first_text(F.col("page_title"), urls.title_from_url(F.col("url")))))
        claims = materialise(extract_claims(articles_.where("c.sourceType <> 'data-source'"), model, c))
        pages_.append(articles_)
        stubs_.append(stub)
        claims_.append(claims)
        links = articles_.select("scope", "norm_url", F.col("node").alias("source"), F.col("c.sourceType").alias("source_type"), "node_ord").join(parents, ["scope", "norm_url"])
        known = _union([p.select("scope", "node", "markdown", "c") for p in pages_])
        links = links.join(known.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_semi").select("scope", F.concat_ws("-", "parent", "source").alias("edge_id"), "source", F.col("parent").alias("target"), "source_type", F.struct("node_ord", F.lit(0).alias("b")).cast("struct<a:struct<depth:int,rank:int>,b:int>").alias("seq"))
        scored = materialise(_score(links, known, _union(claims_), model, c))
        edges_.append(scored)
        edges_.append(stub.join(parents, ["scope", "norm_url"]).select("scope", F.concat_ws("-", "parent", "node").alias("edge_id"), F.col("node").alias("source"), F.col("parent").alias("target"), F.lit("data-source").alias("source_type"), F.struct("node_ord", F.lit(0).alias("b")).cast("struct<a:struct<depth:int,rank:int>,b:int>").alias("seq"), F.lit("unverified").alias("corroboration"), F.lit(0.5).alias("source_fidelity"), F.lit(0.5).alias("editorialization"), F.array(F.lit(STUB_CONCERN)).alias("concerns")))
        counts = got.groupBy("scope").agg(F.count(F.lit(1)).alias("k"))
        done = materialise(done.join(counts, "scope", "left").select("scope", (F.col("n_done") + F.coalesce("k", F.lit(0))).alias("n_done"), (F.col("n_nodes") + F.coalesce("k", F.lit(0))).cast("int").alias("n_nodes")))
        relevant = scored.where("corroboration <> 'none'").select("scope", F.col("source").alias("node")).distinct()
        follow = articles_.join(relevant, ["scope", "node"], "left_semi").where("c.sourceType <> 'data-source'").join(entities, "scope")
        follow = follow.where(pages.names_entity(F.lower(F.concat_ws(" ", "page_title", F.substring("markdown", 1, 1000))), F.col("entities"))).drop("entities")
        level, parents = frontier.gather_candidates(_candidates(follow, entities), visited, parents)
        level, parents = materialise(level), materialise(parents)
        visited = materialise(visited.unionByName(level.select("scope", "norm_url")))
    read = _union([p.select("scope", "node", "depth", "node_ord", "url", "title", "c", "markdown") for p in pages_])
    phantom_nodes, phantom_links = _phantoms(read, model, c)
    nodes = _union([_node_rows(read, F.lit(False)), *[_node_rows(s, F.col("kind") == "unscrapable") for s in stubs_], phantom_nodes])
    edges = _union([*edges_, phantom_links])
    return finish(materialise(nodes), materialise(edges), materialise(_union(claims_)), model, c) | {"failed": failed}


def merge_nodes(nodes: DataFrame, edges: DataFrame, claims: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged nodes go to their leaders with their edges, claims and attributed claims."""
    m = remap.where("id <> leader")
    moved = nodes.join(m.select("scope", F.col("id").alias("node"), "leader"), ["scope", "node"]).where(F.size("attributed_claims") > 0)
    more = moved.groupBy("scope", F.col("leader").alias("node")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "attributed_claims"))), lambda x: x["attributed_claims"])).alias("_more"))
    kept = nodes.join(m.select("scope", F.col("id").alias("node")), ["scope", "node"], "left_anti").join(more, ["scope", "node"], "left")
    kept = kept.withColumn("attributed_claims", F.when(F.col("_more").isNotNull(), F.concat("attributed_claims", "_more")).otherwise(F.col("attributed_claims"))).drop("_more")
    said = claims.join(m.select("scope", F.col("id").alias("node"), "leader"), ["scope", "node"], "left").withColumn("node", F.coalesce("leader", "node")).drop("leader")
    return materialise(kept), materialise(consolidate.redirect_edges(edges, remap)), materialise(said)


def finish(nodes: DataFrame, edges: DataFrame, claims: DataFrame, model: ModelClient, c: PipelineConfig) -> dict[str, DataFrame]:
    """Merge what is the same, prune noise, sum up."""
    real = nodes.where("not phantom and not unscrapable and node <> 'article' and markdown is not null").select("scope", F.col("node").alias("id"), F.col("node_ord").alias("ord"), text.content_shingles(F.col("markdown"), c.same_article_words).alias("items"))
    nodes, edges, claims = merge_nodes(nodes, edges, claims, materialise(consolidate.leaders(real, consolidate.similar_sets(real, c.same_article_jaccard))))
    ghosts = nodes.where("phantom").select("scope", F.col("node").alias("id"), F.col("node_ord").alias("ord"), text.content_words(F.concat_ws(" ", "title", "publisher")).alias("items")).where(F.size("items") >= 2)
    nodes, edges, claims = merge_nodes(nodes, edges, claims, materialise(consolidate.leaders(ghosts, consolidate.similar_sets(ghosts, c.same_phantom_jaccard))))
    ids = nodes.select("scope", F.col("node").alias("id"), F.col("node_ord").alias("ord"), "phantom", "unscrapable", "source_type", "title", "publisher")
    pairs = frontier.match_candidates(ids.where("phantom"), ids.where("not phantom and not unscrapable and id <> 'article' and source_type <> 'data-source'"), c.max_match_pairs)
    shown = pairs.join(ids.select("scope", F.col("id").alias("phantom"), F.col("title").alias("pt")), ["scope", "phantom"]).join(ids.select("scope", F.col("id").alias("real"), F.col("title").alias("rt"), F.col("publisher").alias("rp")), ["scope", "real"])
    listed = shown.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("place", "phantom", "real", "pt", "rt", "rp"))).alias("ps"))
    prompt = F.array_join(F.transform("ps", lambda x: F.concat_ws(" | ", x["place"].cast("string"), x["pt"], x["rt"], x["rp"])), "\n")
    same = ask(model, listed, "match", prompt).select("scope", F.explode(F.filter(F.transform("ps", lambda x, i: F.struct(x["phantom"].alias("id"), x["real"].alias("leader"), i.alias("i"))), lambda s: F.array_contains(jsonval.matches(F.col("raw")), s["i"]))).alias("m"))
    nodes, edges, claims = merge_nodes(nodes, edges, claims, materialise(consolidate.first_per_key(same.select("scope", "m.*"), ["scope", "id"], ["i"]).drop("i")))
    edges = materialise(consolidate.last_per_pair(edges, ["scope", "source", "target"], ["seq", "edge_id"]))
    flags = nodes.select("scope", F.col("node").alias("id"), (F.col("node") == "article").alias("is_root"), "phantom")
    noise = materialise(consolidate.noise_nodes(flags, edges, c.min_edge_relevance))
    nodes = materialise(nodes.join(noise.withColumnRenamed("id", "node"), ["scope", "node"], "left_anti"))
    edges = materialise(edges.join(noise.withColumnRenamed("id", "source"), ["scope", "source"], "left_anti").join(noise.withColumnRenamed("id", "target"), ["scope", "target"], "left_anti"))
    claims = materialise(claims.join(noise.withColumnRenamed("id", "node"), ["scope", "node"], "left_anti"))
    flags = nodes.select("scope", F.col("node").alias("id"), (F.col("node") == "article").alias("is_root"), "phantom")
    weak = consolidate.unsubstantiated_nodes(flags, edges).withColumnRenamed("id", "node")
    loose = claims.join(weak, ["scope", "node"], "left_semi").groupBy("scope").agg(F.array_sort(F.collect_list("claim")).alias("unverified_claims"))
    numbers = summary.edge_summary(nodes.select("scope"), edges.withColumn("n_concerns", F.size("concerns"))).join(loose, "scope", "left").withColumn("unverified_claims", F.coalesce("unverified_claims", F.array().cast("array<string>")))
    told = ask(model, numbers, "summary", F.to_json(F.struct(*[x for x in numbers.columns if x != "scope"]))).withColumn("text", jsonval.text_at(jsonval.parse_json(F.col("raw")), "$.text")).drop("raw")
    return {"nodes": nodes.drop("markdown"), "edges": edges, "claims": claims, "triples": _triples(claims), "summary": told}
