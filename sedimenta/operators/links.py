"""Links between documents by their kinds, snapshot scopes, the claim graph and paging contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.operators import graph

#: Most bytes of a page.
PAGE_BYTES = 750_000


def document_links(versions: DataFrame, headers: DataFrame, references: DataFrame) -> DataFrame:
    """(relation_type, from_node, reference, status, target) of all kinds of links.

    versions: (id, parent, previous, blob, path), one row each; headers: (document, message_id, in_reply_to); references: (document, path). Attachments and versions resolve by id, replies by
    message id, references by exact path: one candidate is resolved, several are ambiguous, none is unresolved. A version is observed after another only
    where both have content and it differs.
    """
    ids = versions.select(F.col("id").alias("t"), F.col("id").alias("n"))
    found = []

    def link(kind: str, rows: DataFrame, targets: DataFrame) -> None:
        resolved = graph.resolve(rows, targets, "reference", "n", "t")
        found.append(resolved.select(F.lit(kind).alias("relation_type"), "from_node", "reference", "status", "target"))

    link("ATTACHMENT_OF", versions.filter("parent IS NOT NULL").select(F.col("id").alias("from_node"), F.col("parent").alias("reference")), ids)
    before = versions.select(F.col("id").alias("previous"), F.col("blob").alias("old"))
    changed = versions.join(before, "previous").filter("blob != old")
    link("OBSERVED_VERSION_AFTER", changed.select(F.col("id").alias("from_node"), F.col("previous").alias("reference")), ids)
    replies = headers.filter("in_reply_to IS NOT NULL").select(F.col("document").alias("from_node"), F.col("in_reply_to").alias("reference")).distinct()
    link("EMAIL_REPLY_REFERENCE", replies, headers.select(F.col("message_id").alias("n"), F.col("document").alias("t")).distinct())
    named = references.filter("path IS NOT NULL").select(F.col("document").alias("from_node"), F.col("path").alias("reference")).distinct()
    link("EXPLICIT_DOCUMENT_REFERENCE", named, versions.select(F.col("path").alias("n"), F.col("id").alias("t")))
    return reduce(DataFrame.unionByName, found)


def snapshot_members(versions: DataFrame, at: Column) -> DataFrame:
    """The versions that a snapshot at a time holds, with `current`: whether no other version of it has taken their place by then. versions: (id, previous, ingested_at)."""
    seen = versions.filter(F.col("ingested_at") <= at)
    replaced = seen.filter("previous IS NOT NULL").select(F.col("previous").alias("id")).distinct().withColumn("_old", F.lit(True))
    return seen.join(replaced, "id", "left").withColumn("current", F.col("_old").isNull()).drop("_old")


def claim_graph(segments: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind) and edges (source, type, target) of documents, segments, claims and the entities they are about.

    segments: (id, document); claims: (id, entity, predicate, polarity), id being the segment. A claim's node is a hash of these.
    """
    c = claims.withColumns({"claim": claim_id(), "e": F.concat(F.lit("entity:"), F.col("entity"))})
    part_of = segments.select(F.col("id").alias("source"), F.lit("PART_OF").alias("type"), F.col("document").alias("target"))
    stated = c.select(F.col("claim").alias("source"), F.lit("STATED_IN").alias("type"), F.col("id").alias("target"))
    about = c.select(F.col("claim").alias("source"), F.lit("ABOUT").alias("type"), F.col("e").alias("target"))
    groups = conflict_groups(claims)
    member = groups.select(F.col("claim").alias("source"), F.lit("MEMBER_OF").alias("type"), F.col("group_id").alias("target"))
    edges = part_of.unionByName(stated).unionByName(about).unionByName(member).distinct()
    kinds = (("document", segments.select("document")), ("segment", segments.select("id")), ("claim", c.select("claim")), ("entity", c.select("e")), ("group", groups.select("group_id")))
    nodes = reduce(DataFrame.unionByName, (x.toDF("node").distinct().withColumn("kind", F.lit(k)) for k, x in kinds))
    return nodes, edges


def claim_id() -> Column:
    return F.sha2(F.concat_ws("|", "id", "entity", "predicate", "polarity"), 256)


def conflict_groups(claims: DataFrame) -> DataFrame:
    """(group_id, claim, id): the members of each group of claims on the same (entity, predicate) that has both polarities. Counted before they are joined."""
    key = F.sha2(F.concat_ws("|", "entity", "predicate"), 256)
    both = claims.groupBy("entity", "predicate").agg(F.countDistinct("polarity").alias("n")).filter("n > 1").select("entity", "predicate")
    return claims.join(both, ["entity", "predicate"], "left_semi").select(key.alias("group_id"), claim_id().alias("claim"), "id").distinct()


def claim_context(groups: DataFrame, asked: DataFrame, most: int = 64) -> DataFrame:
    """(asked, id, omitted): for each asked segment (id) the segments of the groups it has claims in, at most `most`, and how many more there are. groups: as from `conflict_groups`."""
    mine = asked.select(F.col("id").alias("asked")).distinct().join(groups.select(F.col("id").alias("asked"), "group_id").distinct(), "asked")
    found = mine.join(groups.select("group_id", "id").distinct(), "group_id").filter("id != asked").select("asked", "id").distinct()
    counts = found.groupBy("asked").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("asked").orderBy("id"))).filter(F.col("_r") <= most).drop("_r")
    return best.join(counts, "asked")


def segment_edges(edges: DataFrame, segment: DataFrame) -> DataFrame:
    """The edges that touch one of the chosen segments (id), a claim stated in it, or a member of such a claim's group: three semi joins."""
    s = segment.select(F.col("id").alias("target")).distinct()
    claims = edges.filter("type = 'STATED_IN'").join(s, "target", "left_semi").select(F.col("source").alias("node"))
    groups = edges.filter("type = 'MEMBER_OF'").join(claims.withColumnRenamed("node", "source"), "source", "left_semi").select("target").distinct()
    members = edges.filter("type = 'MEMBER_OF'").join(groups, "target", "left_semi").select(F.col("source").alias("node"))
    nodes = s.select(F.col("target").alias("node")).unionByName(claims).unionByName(members).distinct()
    touched = [edges.join(nodes.withColumnRenamed("node", side), side, "left_semi") for side in ("source", "target")]
    return touched[0].unionByName(touched[1]).distinct()


def projected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, kind, degree): the nodes of a viewer. Ends of edges that are no node are there too, as unresolved."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("degree"))
    both = nodes.select("node", "kind").join(ends, "node", "full")
    return both.select("node", F.coalesce("kind", F.lit("unresolved")).alias("kind"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def page(rows: DataFrame, key: str, size: Column, scope: str, after, limit: int, most: int = PAGE_BYTES) -> DataFrame:
    """(`key`, bytes, total, remaining, next_cursor): the rows after a key that fit into `limit` rows and `most` bytes.

    The cursor names scope and last key, so it is of no use for another scope; it is null where nothing remains. A first row that is too large has no page: its row comes with `remaining` -1.
    """
    rest = rows.filter(F.col(key) > F.lit(after)) if after is not None else rows
    counts = rows.agg(F.count("*").alias("total")).crossJoin(rest.agg(F.count("*").alias("rest")))
    first = rest.select(key, size.cast("bigint").alias("bytes")).orderBy(key).limit(limit)
    w = W.orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    within = first.withColumn("_sum", F.sum("bytes").over(w)).withColumn("_n", F.row_number().over(W.orderBy(key)))
    kept = within.filter((F.col("_sum") <= most) | (F.col("_n") == 1))
    ends = kept.agg(F.count("*").alias("n"), F.max(key).alias("last"), F.max("bytes").alias("_b"), F.max("_sum").alias("_s"))
    remaining = F.when(F.col("_s") > most, -1).otherwise(F.col("rest") - F.col("n"))
    cursor = F.base64(F.encode(F.concat(F.sha2(F.lit(scope), 256), F.lit(":"), F.col("last").cast("string")), "UTF-8"))
    both = kept.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(ends.drop("_b")))
    return both.select(key, "bytes", "total", remaining.cast("bigint").alias("remaining"), F.when(remaining > 0, F.regexp_replace(cursor, "[\r\n]", "")).alias("next_cursor"))


def cursor_key(cursor: str, scope: str) -> str:
    """The key that a cursor stands for; an error if it was made for another scope."""
    import base64
    import hashlib

    made, _, key = base64.b64decode(cursor).decode().partition(":")
    if made != hashlib.sha256(scope.encode()).hexdigest():
        raise ValueError("the cursor belongs to another result")
    return key
