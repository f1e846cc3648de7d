"""Ranking policies over segments: term weights of documents, expansion along links and identifiers, candidates of a query plan.

Hits come from a frozen index, so only the postings of a question's terms are read; seeds expand by one hop along links and rare features, by joins on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import lexical

#: Relevance from which on a document expands, and what it lends along a link.
LEAST, LENT = 0.5, 0.95
#: Share of its score that a linked document inherits in a query plan.
INHERITED = 0.85


def term_weights(index: lexical.Index, units: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, document, term) of the hits, and (term, df, w) of all terms: w = 1 + ln((N + 1) / (df + 1)), N and df counting documents. units: (id, document)."""
    hits = index.hits(terms).join(units.select("id", "document"), "id")
    n = units.agg(F.countDistinct("document").alias("n"))
    df = hits.groupBy("term").agg(F.countDistinct("document").alias("df"))
    asked = units.sparkSession.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    counted = asked.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")).crossJoin(n)
    return hits, counted.select("term", "df", "n", (1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w"))


def discovery(index: lexical.Index, units: DataFrame, links: DataFrame, features: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score, reason, terms): each unit that has a term of the question, or whose document a relevant one leads to.

    relevance: the weight of the terms a unit has, of all terms. A document is as strong as its best unit. From those of at least `LEAST` a link lends 0.95 of their strength plus a quarter of the
    unit's own relevance; a feature that at least two documents and at most max(2, a tenth) share, strength (0.65 + 0.35 / degree) plus a quarter, if the document has a term
    that at most half of all have. One hop, never further; the best reason counts. units: (id, document); links: (node, other); features: (document, feature).
    """
    hits, weights = term_weights(index, units, terms)
    total = F.broadcast(weights.agg(F.sum("w").alias("total")))
    scored = hits.join(F.broadcast(weights), "term").crossJoin(total)
    rare = F.max((F.col("df") <= F.greatest(F.lit(1.0), F.col("n") / 2)).cast("int"))
    relevance = scored.groupBy("id", "document").agg((F.sum("w") / F.max("total")).alias("relevance"), F.count("*").alias("terms"), rare.alias("rare"))
    seeds = relevance.groupBy("document").agg(F.max("relevance").alias("strength"), F.max("rare").alias("rare")).filter(F.col("strength") >= LEAST)
    linked = links.join(seeds.select(F.col("document").alias("node"), "strength"), "node").filter("node != other").groupBy(F.col("other").alias("document")).agg(F.max(F.lit(LENT) * F.col("strength")).alias("lent"))
    n = F.broadcast(units.agg(F.countDistinct("document").alias("n")))
    degrees = features.select("document", "feature").distinct().groupBy("feature").agg(F.count("*").alias("degree")).crossJoin(n)
    degrees = degrees.filter((F.col("degree") >= 2) & (F.col("degree") <= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.1)))).select("feature", "degree")
    strong = features.select("document", "feature").distinct().join(degrees, "feature")
    from_seed = strong.join(seeds.filter("rare = 1"), "document").select("feature", F.col("document").alias("seed"), (F.col("strength") * (0.65 + 0.35 / F.col("degree"))).alias("lent"))
    shared = strong.join(from_seed, "feature").filter("document != seed").groupBy("document").agg(F.max("lent").alias("lent"))
    own = relevance.select("id", F.col("relevance").alias("score"), F.lit("own").alias("reason"), F.col("terms"))
    out = own
    for reason, rows in (("link", linked), ("feature", shared)):
        reached = units.select("id", "document").join(rows, "document").join(relevance.select("id", "relevance", "terms"), "id", "left")
        out = out.unionByName(reached.select("id", (F.col("lent") + 0.25 * F.coalesce("relevance", F.lit(0.0))).alias("score"), F.lit(reason).alias("reason"), F.coalesce("terms", F.lit(0)).alias("terms")))
    rounded = out.withColumn("score", F.round("score", 6))
    return rounded.groupBy("id").agg(F.max("score").alias("score"), F.max_by("reason", F.struct("score", "reason")).alias("reason"), F.max("terms").alias("terms"))


def plan_candidates(index: lexical.Index, units: DataFrame, links: DataFrame, terms: list[str], phrases: dict[str, int]) -> DataFrame:
    """(id, document, score, strong): units by the probes of a query plan, and all others of strong documents and of those linked with them, which inherit 0.85 of the score.

    Each term and phrase adds m w / (60 + rank), m being 3 for a phrase that stands in the question (phrases: wording -> m); then the share of the terms' weight that the unit has. A document is strong
    if one of its units has half of that weight, or a phrase. units: (id, document); links: (node, other).
    """
    hits, weights = term_weights(index, units, terms)
    total = F.broadcast(weights.agg(F.sum("w").alias("total")))
    bm25 = lexical.bm25_scores(index, terms).withColumn("s", F.round("score", 9)).select("id", "term", "s")
    ranked = lexical.ranked(bm25, [F.desc("s"), "id"], ["term"]).join(F.broadcast(weights), "term").crossJoin(total)
    by_term = ranked.select("id", (F.col("w") / (60 + F.col("rank"))).alias("score"), (F.col("w") / F.col("total")).alias("coverage"), F.lit(0).alias("phrase"))
    n = F.broadcast(units.agg(F.countDistinct("document").alias("n")))
    out = by_term
    for wording, m in phrases.items():
        found = lexical.phrase_matches(index, wording.split()).join(units.select("id", "document"), "id")
        w = found.agg(F.countDistinct("document").alias("df")).crossJoin(n).select((1 + F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("w"))
        placed = lexical.reciprocal_ranks(found, "id", [F.desc("hits"), "id"]).crossJoin(F.broadcast(w))
        out = out.unionByName(placed.select("id", (F.lit(m) * F.col("w") / (60 + F.col("rank"))).alias("score"), F.lit(0.0).alias("coverage"), F.lit(1).alias("phrase")))
    own = out.groupBy("id").agg((F.sum("score") + F.sum("coverage")).alias("score"), F.sum("coverage").alias("coverage"), F.max("phrase").alias("phrase")).join(units.select("id", "document"), "id")
    strong = own.groupBy("document").agg(F.max("score").alias("best"), F.max(((F.col("coverage") >= LEAST) | (F.col("phrase") == 1)).cast("int")).alias("strong")).filter("strong = 1")
    ends = links.join(strong.select(F.col("document").alias("node"), "best"), "node").filter("node != other").groupBy(F.col("other").alias("document")).agg(F.max(F.lit(INHERITED) * F.col("best")).alias("lent"))
    whole = units.select("id", "document").join(strong.select("document", F.lit(0.0).alias("lent")).unionByName(ends), "document").groupBy("id", "document").agg(F.max("lent").alias("lent"))
    both = own.select("id", "document", "score").join(whole, ["id", "document"], "full").join(strong.select("document", F.lit(True).alias("_s")), "document", "left")
    score = F.round(F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("lent", F.lit(0.0))), 6)
    return both.select("id", "document", score.alias("score"), F.coalesce("_s", F.lit(False)).alias("strong"))


def in_turn(candidates: DataFrame) -> DataFrame:
    """`candidates` (id, document, score) with turn and best: units of each document in order of score, documents by their best one."""
    w = W.partitionBy("document").orderBy(F.desc("score"), "id")
    return candidates.withColumns({"turn": (F.row_number().over(w) - 1).cast("bigint"), "best": F.max("score").over(W.partitionBy("document"))})


def reference_ranking(index: lexical.Index, units: DataFrame, links: DataFrame, strong: DataFrame, attributed: DataFrame, weak: DataFrame, terms: list[str]) -> DataFrame:
    """(id, document, tier, slot): units that have a term (tier 0), stand in a document linked with theirs or with a strong feature of theirs (1), have an attributed observation (2), or a weak feature of theirs (3).

    Within a tier, documents take turns, by rarity (sum of 1 / hits of the terms a unit has), number of terms and BM25. Slots: two of tier 0, then one of tiers 1 and 2, which alternate; tier 3 comes last.
    units: (id, document); links: (node, other); strong and weak: (id, feature); attributed: (id).
    """
    hits = index.hits(terms)
    counts = hits.groupBy("term").agg(F.count("*").alias("hits"))
    bm25 = lexical.bm25_scores(index, terms).groupBy("id").agg(F.round(F.sum("score"), 6).alias("bm25"))
    first = hits.join(F.broadcast(counts), "term").groupBy("id").agg(F.round(F.sum(1.0 / F.col("hits")), 9).alias("rarity"), F.count("*").alias("terms")).join(bm25, "id")
    found = units.select("id", "document").join(first, "id").withColumn("tier", F.lit(0))
    seeds = found.select("document").distinct()

    def shared(features: DataFrame) -> DataFrame:
        theirs = features.join(found.select("id"), "id", "left_semi").select("feature").distinct()
        return features.join(theirs, "feature", "left_semi").select("id").distinct()

    linked = links.join(seeds.withColumnRenamed("document", "node"), "node", "left_semi").select(F.col("other").alias("document")).distinct()
    near = units.join(linked, "document", "left_semi").select("id").unionByName(shared(strong)).select("id", F.lit(1).alias("tier"))
    others = near.unionByName(attributed.select("id", F.lit(2).alias("tier"))).unionByName(shared(weak).select("id", F.lit(3).alias("tier"))).groupBy("id").agg(F.min("tier").alias("tier"))
    rest = units.select("id", "document").join(others, "id").join(found.select("id"), "id", "left_anti").select("id", "document", F.lit(0.0).alias("rarity"), F.lit(0).cast("bigint").alias("terms"), F.lit(0.0).alias("bm25"), "tier")
    every = found.select("id", "document", "rarity", "terms", "bm25", "tier").unionByName(rest)
    order = [F.desc("rarity"), F.desc("terms"), F.desc("bm25"), "id"]
    turns = every.withColumn("turn", F.row_number().over(W.partitionBy("tier", "document").orderBy(*order)))
    placed = lexical.ranked(turns, ["turn", *order], ["tier"]).withColumn("k", F.col("rank") - 1)
    # Pools 1 and 2 alternate: the k-th of one comes after at most k + 1 of the other.
    sizes = placed.groupBy("tier").agg(F.count("*").alias("n")).groupBy().agg(*(F.coalesce(F.max(F.when(F.col("tier") == t, F.col("n"))), F.lit(0)).alias(f"n{t}") for t in range(4)))
    sized = placed.crossJoin(F.broadcast(sizes))
    k = F.col("k")
    other = F.when(F.col("tier") == 1, F.least(k, "n2")).otherwise(F.least(k + 1, "n1"))
    slot = F.when(F.col("tier") == 0, 3 * F.floor(k / 2) + k % 2).when(F.col("tier") == 3, 3 * (F.col("n0") + F.col("n1") + F.col("n2")) + k).otherwise(3 * (k + other) + 2)
    return sized.select("id", "document", F.col("tier").cast("bigint").alias("tier"), slot.cast("bigint").alias("slot"))
