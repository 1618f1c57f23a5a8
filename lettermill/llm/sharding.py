"""Even shards with few cut links, by balanced label propagation in Spark joins; DataFrame operations only.

Documents with equal texts are linked: each to a hub of about `chunk` documents, and hubs to the group's first, so links
grow with the documents and not with the pairs. A group that no shard can hold falls into pieces that fill a shard, and a
rest; all others stay linked as one. Labels begin as the document itself. In each turn every document takes the label with
the most votes among its neighbours, if that is smaller than its own. Labels only fall, so this repeats until nobody
moves, and no label gathers more than a shard can hold. Then labels are given to shards by size, the largest first, each
whole to the first shard that has room for it. Only what finds no such shard is split, over those with the most room.
Unlinked documents have no edges to cut, so they are placed last, into the room that is left, which makes the counts of
shards equal to within one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm._common import Written, global_rank, join_by_key


def copy_links(nodes: DataFrame, *, group_col: str, most: int, chunk: int = 256) -> DataFrame:
    """nodes: node (long, unique) and group_col, written. Returns a, b, w: spokes to hubs (w 1) and hubs to their piece's
    first (w the documents of the hub, so that they outvote its spokes). Only a group of more than `most` is cut into
    pieces, of `most` each and a rest, without links between them. Nodes alone in their group or piece have no link. A
    group with a large part of all rows is met where its rows lie (join_by_key)."""
    total = nodes.count()
    groups = Written(nodes.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("of"), F.min("node").alias("first")).filter("n > 1"), "groups").df
    members = Written(join_by_key(nodes.select("node", group_col), groups, [group_col], "n", total), "members").df
    whole = members.filter(F.col("of") <= most).withColumn("piece", F.lit(0).cast("long"))
    cut = global_rank(members.filter(F.col("of") > most).select("node", group_col, "of"), [group_col], [F.col("node")], "at")
    cut = cut.withColumn("piece", F.floor(F.col("at") / most).cast("long")).withColumn("of", F.least(F.lit(most).cast("long"), F.col("of") - F.col("piece") * most))
    cut = Written(cut.select("node", group_col, "of", "piece"), "cut").df
    heads = Written(cut.groupBy(group_col, "piece").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "heads").df
    cut = join_by_key(cut, heads, [group_col, "piece"], "n", total)
    placed = Written(whole.unionByName(cut).filter("of > 1").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("of") / F.lit(chunk)))), "chunks").df
    hubs = Written(placed.groupBy(group_col, "piece", "chunk").agg(F.min("node").alias("hub"), F.min("first").alias("first"), F.count(F.lit(1)).cast("double").alias("w")), "hubs").df
    # About `chunk` rows share a key here.
    spokes = placed.select("node", group_col, "piece", "chunk").join(hubs.drop("w", "first"), [group_col, "piece", "chunk"]).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(1.0).alias("w"))
    tops = hubs.filter("hub <> first").select(F.col("hub").alias("a"), F.col("first").alias("b"), "w")
    return spokes.union(tops)


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def propagate(edges: DataFrame, *, rounds: int = 8) -> DataFrame:
    """edges: a, b, w over nodes (long). Returns node and hub (the label: the document that it gathers around) for every
    node that an edge names. The hubs of copy_links settle in four turns; edges that have not after `rounds` raise."""
    both = Written(edges.select("a", "b", "w").union(edges.select("b", "a", "w")), "links")
    labels = Written(both.df.select(F.col("a").alias("node")).distinct().withColumn("hub", F.col("node")), "labels")
    for _ in range(rounds):
        near = labels.df.select(F.col("node").alias("b"), F.col("hub").alias("to"))
        votes = both.df.join(near, "b").groupBy("a", "to").agg(F.sum("w").alias("votes"))
        best = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("to")).alias("to"))).alias("best"))
        step = labels.df.join(best, F.col("node") == F.col("a")).select("node", F.col("hub").alias("old"), F.least("hub", -F.col("best.to")).alias("hub"))
        new = Written(step, "labels")
        moved = new.df.filter("old <> hub").limit(1).count()
        labels.drop()
        labels = new
        if not moved:
            break
    else:
        raise RuntimeError(f"propagation did not settle in {rounds} rounds")
    both.drop()
    return labels.df.select("node", "hub")


def pack(sizes: dict[int, int], quota: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """sizes: how many labels have so many documents. First fit, the largest first: for each size the shards that take
    labels of it, and up to which of them (counted from 0) each does. Labels beyond the last fit no shard whole."""
    room = list(quota)
    plan = []
    for size in sorted(sizes, reverse=True):
        left, upto, to = sizes[size], [], []
        for s in range(len(room)):
            if n := min(left, room[s] // size):
                room[s] -= n * size
                left -= n
                upto.append(sizes[size] - left)
                to.append(s)
        plan.append((size, upto, to))
    return plan


def shard_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, chunk: int = 256, rounds: int = 8, overhead: int = 16) -> DataFrame:
    """id_col, size, text_crc32, law (`rows`), shard, slot (gapless from 0 in each shard) and grown_shard (null). Among
    documents that are alike to the method, their order as stored decides, so another file layout may give other shards.

    Defined results: null and empty texts have size `overhead`, checksum 0, and are equal to each other. Rows with null or
    repeated ids are rows of their own. With fewer rows than shards some shards are empty; an empty table gives an empty
    table. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text_key"), F.monotonically_increasing_id().alias("node"))
    rows = Written(rows, "rows").df
    quota = quotas(rows.count(), shards)
    links = copy_links(rows.select("node", "text_key"), group_col="text_key", most=max(1, min(quota)), chunk=chunk)
    labels = propagate(links, rounds=rounds)
    units = Written(labels.groupBy("hub").agg(F.count(F.lit(1)).alias("of")), "units").df
    # One row for each size. Sizes add up to no more than the rows, so there are at most sqrt(2 rows) different ones.
    plan = docs.sparkSession.createDataFrame(pack(dict(units.groupBy("of").count().collect()), quota), "of long, upto array<long>, to array<int>")
    units = global_rank(units, ["of"], [F.col("hub")], "nth").join(F.broadcast(plan), "of")
    units = units.select("hub", "of", F.get("to", F.size(F.filter("upto", lambda u: u <= F.col("nth")))).alias("shard"))
    linked = Written(labels.join(units, "hub"), "linked").df
    kept = global_rank(linked.filter("shard IS NOT NULL").select("node", "hub", "shard"), ["shard"], [F.col("hub"), F.col("node")], "slot").select("node", "shard", "slot")
    kept = Written(kept, "kept").df
    held = dict(kept.groupBy("shard").count().collect())  # one row for each shard
    room = [q - held.get(s, 0) for s, q in enumerate(quota)]
    # Labels that fit nowhere come first, the largest into the shards with the most room.
    open_ = sorted(range(shards), key=lambda s: (-room[s], s))
    upto = [sum(room[s] for s in open_[: i + 1]) for i in range(shards)]
    split = linked.filter("shard IS NULL").select("node", "hub", "of")
    lone = rows.select("node").join(linked.select("node"), "node", "left_anti").select("node", F.col("node").alias("hub"), F.lit(1).cast("long").alias("of"))
    rest = global_rank(split.union(lone), [], [F.desc("of"), F.col("hub"), F.col("node")], "place")
    at = F.size(F.filter(F.array(*map(F.lit, upto)), lambda u: u <= F.col("place")))
    shard = F.element_at(F.array(*map(F.lit, open_)), at + 1)
    base = F.element_at(F.array(*(F.lit(held.get(s, 0) - (upto[i] - room[s])) for i, s in enumerate(open_))), at + 1)
    filled = rest.select("node", shard.cast("int").alias("shard"), (F.col("place") + base).cast("long").alias("slot"))
    placed = kept.union(filled)
    out = rows.join(placed, "node")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
