"""Multi-route retrieval over segments: routes, fusion, expansion, bundles and accounting.

A route is a DataFrame (id, route, pos): its hits with their position from 1. Each is made by filters, joins and top-k; only the chosen few (seeds and tops, whose numbers
are parameters) are broadcast into later routes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.functions.text import words
from sedimenta.operators import graph, lexical, ranking
from sedimenta.session import checkpoint

K = 60


def numbered(hits: DataFrame, route: str, order: list, limit: int | None = None) -> DataFrame:
    """(id, route, pos) of hits in order. The best `limit` are taken before they are numbered; without a limit, all are, in many tasks."""
    if limit:
        best = hits.orderBy(*order).limit(limit)
        return best.select("id", F.lit(route).alias("route"), F.row_number().over(W.orderBy(*order)).cast("bigint").alias("pos"))
    ranked = lexical.ranked(hits.withColumn("_all", F.lit(0)), order, ["_all"])
    return ranked.select("id", F.lit(route).alias("route"), F.col("rank").alias("pos"))


def lexical_route(index: lexical.Index, terms: list[str], limit: int) -> DataFrame:
    """Hits of each term ranked by BM25, their reciprocal ranks summed."""
    scores = lexical.bm25_scores(index, terms).withColumn("score", F.round("score", 9))
    ranked = lexical.reciprocal_ranks(scores, "id", [F.desc("score"), "id"], K, ["term"])
    return numbered(ranked.groupBy("id").agg(F.round(F.sum("rr"), 9).alias("s")), "lexical", [F.desc("s"), "id"], limit)


def literal_route(segments: DataFrame, probes: list[str], limit: int) -> DataFrame:
    """Segments that contain one of the probes."""
    found = reduce(lambda a, b: a | b, (F.col("text").contains(p) for p in probes))
    return numbered(segments.filter(found), "literal", ["id"], limit)


def identifier_route(segments: DataFrame, question: str, grammar: str, limit: int) -> DataFrame:
    """Segments with an identifier that the question names."""
    asked = F.regexp_extract_all(F.lit(question), F.lit(grammar), F.lit(0))
    return numbered(segments.filter(F.arrays_overlap(F.regexp_extract_all("text", F.lit(grammar), F.lit(0)), asked)), "identifier", ["id"], limit)


def fused(routes: DataFrame) -> DataFrame:
    """(id, score, routes): reciprocal ranks of all routes summed."""
    return routes.groupBy("id").agg(F.round(F.sum(1.0 / (K + F.col("pos"))), 9).alias("score"), F.count("*").alias("routes"))


def structural_route(segments: DataFrame, ranked: DataFrame, top: int) -> DataFrame:
    """The segments beside the best ones."""
    w = W.partitionBy("document").orderBy("ordinal", "id")
    beside = segments.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))
    best = ranked.orderBy(F.desc("score"), "id").limit(top).select("id", "score")
    around = beside.join(F.broadcast(best), "id").select("score", F.explode(F.array("before", "after")).alias("id")).filter("id IS NOT NULL")
    return numbered(around.groupBy("id").agg(F.max("score").alias("score")), "structural", [F.desc("score"), "id"])


def concept_route(segments: DataFrame, concepts: DataFrame, limit: int) -> DataFrame:
    """Segments by how many of a question's concepts they have, in whatever language. concepts: (concept, surface), lower-case wordings of what the question names."""
    listed = concepts.groupBy("concept").agg(F.collect_set("surface").alias("surfaces"))
    # A question names few concepts; each segment is tested against them in place.
    low = segments.select("id", F.lower("text").alias("low")).join(F.broadcast(listed), F.exists("surfaces", lambda x: F.contains(F.col("low"), x)))
    return numbered(low.groupBy("id").agg(F.count("*").alias("n")), "concept", [F.desc("n"), "id"], limit)


def dense_route(vectors: DataFrame, query: list[float] | DataFrame, limit: int) -> DataFrame:
    """The segments whose vectors are nearest to the question's; zero vectors have no hit. vectors: (id, vector), of a segment the best one counts; query: a one-row table (vector)."""
    q = query.select(F.col("vector").alias("q")) if isinstance(query, DataFrame) else vectors.sparkSession.createDataFrame([(query,)], "q array<double>")
    score = F.round(F.try_divide(ranking.dot(F.col("vector"), F.col("q")), ranking.norm(F.col("vector")) * ranking.norm(F.col("q"))), 6)
    best = vectors.crossJoin(F.broadcast(q)).select("id", score.alias("score")).filter("score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))
    return numbered(best, "dense", [F.desc("score"), "id"], limit)


def claim_route(ranked: DataFrame, claims: DataFrame, top: int, limit: int) -> DataFrame:
    """Segments with a claim on the same (entity, predicate) as one of the best segments. claims: (id, entity, predicate)."""
    best = ranked.orderBy(F.desc("score"), "id").limit(top)
    keys = claims.join(F.broadcast(best.select("id")), "id").select("entity", "predicate").distinct()
    related = claims.join(keys, ["entity", "predicate"]).select("id").distinct()
    scored = related.join(ranked.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return numbered(scored, "claim_context", [F.desc("score"), "id"], limit)


def reached_documents(segments: DataFrame, links: DataFrame, ranked: DataFrame, seeds: int, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, depth) of the documents within reach of the best ones' documents: the first `most` by (depth, node), and the rest, which are pending. links: (node, other), both directions."""
    documents = ranked.join(segments.select("id", "document"), "id").groupBy("document").agg(F.max("score").alias("s"))
    start = documents.orderBy(F.desc("s"), "document").limit(seeds).select(F.col("document").alias("node"))
    found = checkpoint(graph.levels(links, start, depth))
    kept = found.orderBy("depth", "node").limit(most)
    return kept, found.join(kept.select("node"), "node", "left_anti")


@dataclass(frozen=True)
class Hybrid:
    """Hits of all routes (id, route, pos), and the documents in reach that were left for later (node, depth)."""

    routes: DataFrame
    pending: DataFrame


def hybrid(segments: DataFrame, index: lexical.Index, links: DataFrame, concepts: DataFrame, vectors: DataFrame, query: DataFrame, claims: DataFrame, question: str, terms: list[str], probes: list[str], grammar: str, limit: int = 100, seeds: int = 12, depth: int = 2, most: int = 64, top: int = 32) -> Hybrid:
    """Eight routes: lexical, concept, literal, identifier and dense ones from the question; claim_context, explicit_graph and structural ones from what these found.

    Routes are short lists, or one document's neighbours, that later ones read several times: they are written once.
    """
    first = [lexical_route(index, terms, limit), concept_route(segments, concepts, limit), literal_route(segments, probes, limit), identifier_route(segments, question, grammar, limit), dense_route(vectors, query, limit)]
    routes = checkpoint(reduce(DataFrame.unionByName, first))
    routes = routes.unionByName(checkpoint(claim_route(fused(routes), claims, top, limit)))
    before = fused(routes)
    kept, pending = reached_documents(segments, links, before, seeds, depth, most)
    hits = segments.join(kept.filter("depth > 0"), segments.document == kept.node).select("id").distinct().join(before.select("id", "score"), "id", "left")
    explicit = numbered(hits.select("id", F.coalesce("score", F.lit(0.0)).alias("score")), "explicit_graph", [F.desc("score"), "id"])
    routes = routes.unionByName(checkpoint(explicit))
    return Hybrid(routes.unionByName(checkpoint(structural_route(segments, fused(routes), top))), pending)


def accounting(routes: DataFrame, everything: DataFrame, pending: DataFrame | None = None, unresolved: DataFrame | None = None, reranked: int = 128) -> DataFrame:
    """(route, n): hits of each route, of all together, what none has found, what is beyond the first `reranked`, documents left pending and links without an end."""
    per = routes.groupBy("route").agg(F.count("*").alias("n"))
    union = routes.select("id").distinct()
    total = union.agg(F.count("*").alias("n")).select(F.lit("union").alias("route"), "n")
    rest = everything.select("id").distinct().join(union, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("not discovered").alias("route"), "n")
    late = union.agg(F.greatest(F.count("*") - reranked, F.lit(0)).alias("n")).select(F.lit("unreranked").alias("route"), "n")
    out = per.unionByName(total).unionByName(rest).unionByName(late)
    for name, rows in (("pending", pending), ("unresolved links", unresolved)):
        if rows is not None:
            out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("route"), "n"))
    return out


def bundles(segments: DataFrame, ranked: DataFrame, claims: DataFrame, links: DataFrame, anchors: int = 24, size: int = 4) -> DataFrame:
    """(anchor, members): each of the best segments with a segment of each other polarity on the same (entity, predicate), the first segment of a linked document, and its neighbours, up to `size`.

    Equal sets of members stand once, under their best anchor. claims: (id, entity, predicate, polarity); links: (node, other).
    """
    w = W.partitionBy("document").orderBy("ordinal", "id")
    best = F.broadcast(ranked.orderBy(F.desc("score"), "id").limit(anchors).select(F.col("id").alias("anchor"), "score"))
    asked = best.join(segments.select(F.col("id").alias("anchor"), "document"), "anchor")
    role = claims.select(F.col("id").alias("anchor"), "entity", "predicate", F.col("polarity").alias("own")).join(best, "anchor").join(claims, ["entity", "predicate"])
    context = role.filter("id != anchor AND polarity != own").groupBy("anchor", "polarity").agg(F.min("id").alias("id")).select("anchor", "id", F.lit(1).alias("rank"))
    firsts = segments.groupBy("document").agg(F.min_by("id", F.struct(F.coalesce("ordinal", F.lit(-1)), "id")).alias("id"))
    linked = asked.join(links, asked.document == links.node).select("anchor", F.col("other").alias("document")).join(firsts, "document")
    endpoint = linked.filter("id != anchor").groupBy("anchor").agg(F.min("id").alias("id")).select("anchor", "id", F.lit(2).alias("rank"))
    around = segments.select(F.col("id").alias("anchor"), F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))
    beside = around.select("anchor", F.explode(F.array("before", "after")).alias("id")).filter("id IS NOT NULL").join(best, "anchor").select("anchor", "id", F.lit(3).alias("rank"))
    members = best.select("anchor", F.col("anchor").alias("id"), F.lit(0).alias("rank")).unionByName(context).unionByName(endpoint).unionByName(beside).groupBy("anchor", "id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(W.partitionBy("anchor").orderBy("rank", "id"))
    made = members.withColumn("place", place).filter(F.col("place") <= size).groupBy("anchor").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("members")).join(best, "anchor")
    return made.groupBy("members").agg(F.min_by("anchor", F.struct(-F.col("score"), "anchor")).alias("anchor")).select("anchor", "members")


def expansion(relevance: DataFrame, links: DataFrame, least: float = 0.5) -> DataFrame:
    """(document, score, reason): documents' own relevance, and what linked documents lend it: 0.95 of theirs plus a quarter of its own.

    relevance: (document, relevance); links: (node, other). One hop, from documents of at least `least`, never further."""
    own = relevance.select("document", F.col("relevance").alias("score"), F.lit("own").alias("reason"))
    strong = relevance.filter(F.col("relevance") >= least).select(F.col("document").alias("node"), F.col("relevance").alias("strength"))
    lent = links.join(strong, "node").groupBy(F.col("other").alias("document")).agg(F.max("strength").alias("strength"))
    lent = lent.join(relevance, "document", "left").select("document", (0.95 * F.col("strength") + 0.25 * F.coalesce("relevance", F.lit(0.0))).alias("score"), F.lit("link").alias("reason"))
    both = own.unionByName(lent)
    return both.groupBy("document").agg(F.round(F.max("score"), 6).alias("score"), F.max_by("reason", F.struct("score", "reason")).alias("reason"))


def question_terms(question: str, stop: set[str]) -> list[str]:
    """The distinct words of a question that aren't stop words, in order."""
    import re

    return sorted(set(re.findall(r"[^\W_]+", question.casefold())) - stop)


def coverage_rank(units: DataFrame, terms: list[str], document: str, key: str) -> DataFrame:
    """(`key`, matched, place): units by how many of the words they have, documents in turn."""
    have = F.size(F.array_intersect(words(F.col("text")), F.array(*(F.lit(t) for t in terms))))
    hits = units.select(key, document, have.cast("bigint").alias("matched")).filter("matched > 0")
    turn = F.row_number().over(W.partitionBy(document).orderBy(F.desc("matched"), key))
    return hits.withColumn("turn", turn.cast("bigint"))
