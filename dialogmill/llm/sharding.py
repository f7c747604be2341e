"""Shards of even size that keep linked documents together, by balanced label propagation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dialogmill.llm.common import discard, settled, table
from dialogmill.tables import numbered

#: Movers to a shard are let in by buckets of whole neighbourhoods: so many sums for each shard, whatever the number of documents.
BUCKETS = 1024
#: The votes of a hub all of whose other members are in one shard.
WHOLE = 1 << 40
#: Share of the free documents' size, in the smallest of them, that is kept back to fill what the larger ones leave.
SMALL = 0.25
#: Documents of up to this share of a shard are small beside it.
FINE = 0.001


def _members(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(node, hub, n, size, home, chief, shard) of each node at each hub of two nodes or more; first shards are dealt by hash.

    ``home`` names a node's neighbourhood, by the least hash of its hubs; ``chief`` marks one row of each node.
    """
    linked = links.where("node IS NOT NULL AND hub IS NOT NULL").select("node", "hub").distinct()
    hubs = settled(linked.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    known = linked.join(hubs, "hub").join(nodes, "node")
    homes = known.groupBy("node").agg(F.min(F.xxhash64("hub")).alias("home"))
    first = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    marked = known.join(homes, "node").select("node", "hub", "n", "size", "home", (F.xxhash64("hub") == F.col("home")).alias("chief"), first.alias("shard"))
    members = settled(marked, "members")
    discard(hubs)
    return members


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    return [int(found.get(k) or 0) for k in range(shards)]


def _running(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``to``, the sum of sizes of the rows of one ``by`` up to each by node; summed range by range."""
    dealt = settled(rows.repartitionByRange(by, "node").withColumn("part", F.spark_partition_id()), "sizes")
    parts = dealt.groupBy(by, "part").agg(F.sum("size").alias("sum"))
    before = parts.select(by, "part", (F.sum("sum").over(Window.partitionBy(by).orderBy("part")) - F.col("sum")).alias("before"))
    within = F.sum("size").over(Window.partitionBy(by, "part").orderBy("node"))
    return dealt.join(before, [by, "part"]).withColumn("to", F.col("before") + within).drop("part", "before")


def _let_in(movers: DataFrame, rooms: Sequence[float], turn: int, in_part: bool = False) -> DataFrame:
    """Those of (node, size, home, shard) for which their shard has room, by whole buckets of neighbourhoods, small buckets first.

    A bucket that exceeds the room gets in as far as it goes, if none is let in before it or with ``in_part``.
    """
    movers = movers.withColumn("bucket", F.pmod(F.xxhash64("home", F.lit(turn)), F.lit(BUCKETS)))
    sums = movers.groupBy("shard", "bucket").agg(F.sum("size").alias("bytes"))
    to = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "bucket"))  # a row for each shard and bucket
    left = F.get(F.array(*[F.lit(float(room)) for room in rooms]), F.col("shard")) - F.col("to") + F.col("bytes")
    open_to = (F.col("left") > 0) & ((F.col("left") >= F.col("bytes")) | F.lit(in_part) | (F.col("to") == F.col("bytes")))
    buckets = settled(sums.withColumn("to", to).withColumn("left", left).where(open_to).select("shard", "bucket", "bytes", "left"), "buckets")
    let_in = movers.join(F.broadcast(buckets), ["shard", "bucket"])
    whole = let_in.where("bytes <= left").drop("bucket", "bytes", "left")
    if buckets.where("bytes > left").isEmpty():
        return whole
    some = _running(let_in.where("bytes > left").drop("bucket", "bytes"), "shard").where("to <= left")  # at most one bucket of a shard
    return whole.unionByName(some.drop("to", "left"))


def _asked(members: DataFrame, held: DataFrame, shards: int, loads: Sequence[int], room: float, turn: int) -> DataFrame:
    """(node, size, home, was, shard): who asks for another shard; ``held`` has the members of each hub by shard."""
    at = [F.col("shard") == k for k in range(shards)]
    weight = F.floor(F.lit(WHOLE) / (F.col("n") - 1))
    votes = [F.sum((F.get("held", F.lit(k)) - here.cast("long")) * weight).alias(f"v{k}") for k, here in enumerate(at)]
    asked = members.join(held, "hub").groupBy("node", "size", "home", "shard").agg(*votes, F.max(weight).alias("own"), F.count(F.lit(1)).alias("hubs"))

    def choice(k: int) -> Column:
        vote = F.col(f"v{k}") + F.when(at[k], F.col("own")).otherwise(0)
        asked_for = F.struct(vote.alias("vote"), F.pmod(F.xxhash64("home", F.lit(k)), F.lit(1 << 30)).alias("tie"), F.lit(k).alias("k"))
        return F.when(at[k], asked_for) if loads[k] >= room else asked_for

    best = F.array_max(F.array(*[choice(k) for k in range(shards)]))
    steady = (F.col("hubs") > 1) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
    return asked.where(~steady).select("node", "size", "home", F.col("shard").alias("was"), best["k"].alias("shard")).where("shard <> was")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, room: float, rounds: int = 12) -> DataFrame:
    """(node, size, home, shard) of all linked nodes: each moves to the shard that most of its neighbours are in while there is room.

    A round is a written table. A node's hubs vote for each shard by the share of their other members in it, and the node itself for its own
    like one of these; it asks for the shard of most votes among those with room (on ties that which a hash of its
    neighbourhood prefers). Members of a single hub all see the same votes and so agree at once; of nodes with several hubs only a
    half, drawn anew, asks in a round, so that neighbours don't swap for ever. Sizes of askers are summed by shard and bucket of
    neighbourhoods, and as many buckets get in as fit: no shard grows above ``room``. It ends with two rounds in which none moves, or
    after ``rounds``.
    """
    members, still = _members(nodes, links, shards), 0
    for turn in range(rounds):
        loads = _loads(members.where("chief"), shards)
        counts = [F.count_if(F.col("shard") == k) for k in range(shards)]
        held = settled(members.groupBy("hub").agg(F.array(*counts).alias("held")), "held")  # a table, so that Spark may split a large hub where it is joined
        movers = settled(_asked(members, held, shards, loads, room, turn), "asked")
        moved = settled(_let_in(movers, [room - load for load in loads], turn).select("node", F.col("shard").alias("now")), "moved")
        still = still + 1 if moved.isEmpty() else 0
        if not still:
            kept = settled(members.join(moved, "node", "left").withColumn("shard", F.coalesce("now", "shard")).drop("now"), "members")
            discard(members)
            members = kept
        discard(held, movers, moved)
        if still == 2:
            break
    return members.where("chief").select("node", "size", "home", "shard").dropDuplicates(["node"])


def _fill(placed: DataFrame, gaps: Sequence[float], totals: dict[int, int]) -> DataFrame:
    """Deals every class of sizes over the shards in proportion to their gaps, each document by the middle of its place along the class."""
    whole = sum(gaps)
    ends = [sum(gaps[: k + 1]) / whole if whole > 0 else (k + 1) / len(gaps) for k in range(len(gaps))]
    total = F.get(F.array(*[F.lit(float(totals.get(c, 0))) for c in range(64)]), F.col("class"))
    middle = F.col("to") - F.col("size") / 2.0
    shard = sum((F.when(middle >= total * end, 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    return placed.select("node", "size", shard.cast("int").alias("shard"))


def _levels(totals: dict[int, int], even: float) -> list[list[int]]:
    """Classes of sizes that are dealt together, in order: those of large documents one by one, those whose documents are small beside a shard at once, at last the smallest."""
    ordered, whole = sorted(totals), sum(totals.values())
    last = next((c for c in ordered if sum(totals[k] for k in ordered if k <= c) >= SMALL * whole), 0)
    single = [c for c in reversed(ordered) if c > last and 2 << c > FINE * even]
    levels = [*([c] for c in single), [c for c in ordered if c > last and c not in single], [c for c in ordered if c <= last]]
    return [level for level in levels if level]


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = 16, rounds: int = 12) -> DataFrame:
    """(node, size, shard): shards 0 to ``shards`` - 1 of nearly equal size that keep linked nodes together.

    ``nodes`` has unique ids ``node`` (long) and sizes of at least 1 (long); ``links`` has (node, hub), where nodes of one hub are linked (an edge is a hub
    of two). Both are stored tables. Linked nodes are moved by ``propagate`` with an even share as room; so a group larger than
    a shard fills some shards. The other nodes then fill the gaps: classes of like size are dealt over the shards in
    proportion to what they lack, the larger ones first and the smallest into what these leave, so that sizes end up apart by a few small
    documents (unless large or linked ones leave nothing to fill). With sizes of 1, numbers are at most one apart. Links of unknown nodes and null hubs link nothing; an empty table gives an empty one.
    """
    total = nodes.agg(F.sum("size")).first()[0] or 0
    even = total / shards
    linked = settled(propagate(nodes, links, shards, even, rounds), "linked")
    fixed = settled(_let_in(linked, [even] * shards, rounds, in_part=True), "fixed")
    free = nodes.join(fixed.select("node"), "node", "left_anti").withColumn("class", F.floor(F.log2("size")).cast("int"))
    placed = settled(_running(free, "class"), "free")
    totals = {r[0]: int(r[1]) for r in placed.groupBy("class").agg(F.sum("size")).collect()}  # at most 63 classes
    gaps = [max(even - load, 0.0) for load in _loads(fixed, shards)]
    parts = [fixed.select("node", "size", "shard")]
    for classes in _levels(totals, even):
        dealt = settled(_fill(placed.where(F.col("class").isin(classes)), gaps, totals), "dealt")
        gaps = [max(gap - load, 0.0) for gap, load in zip(gaps, _loads(dealt, shards), strict=True)]
        parts.append(dealt)
    out = settled(reduce(DataFrame.union, parts), "shards")
    discard(linked, fixed, placed, *parts[1:])
    return out


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``, a shard's numbers from 0 by node; numbered range by range."""
    sizes = assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row for each shard
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("start"))
    return numbered(assigned, ["shard", "node"], "no").join(F.broadcast(starts), "shard").withColumn("slot", F.col("no") - 1 - F.col("start")).drop("no", "start")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, law: str = "bytes", rounds: int = 12) -> DataFrame:
    """(id, size, text_crc32, shard, slot): a shard and a place in it for each row, equal texts linked.

    ``law`` is ``bytes`` (shards of nearly equal size) or ``rows`` (numbers of rows at most one apart). Size is the text's bytes in UTF-8 plus 1; a null
    text has none, so size 1 and checksum 0, and is linked with nothing, while empty texts are equal texts. Null ids and repeated rows each
    have a place of their own. Reruns agree. Other columns aren't read; an empty table gives an empty one.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), F.unhex(F.md5(text)).alias("hub"),
    )
    rows = settled(numbered(narrow, ["id", "hub"], "node"), "documents")
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    assigned = balanced_shards(rows.select("node", weight.alias("size")), rows.select("node", "hub"), shards, rounds)
    return rows.drop("hub").join(with_slots(assigned).drop("size"), "node").select("id", "size", "text_crc32", "shard", "slot")


def cut_links(assigned: DataFrame, links: DataFrame) -> DataFrame:
    """(hubs, cut_hubs, pairs, cut_pairs): how many hubs of two nodes or more, and pairs of their members, lie in more than one shard; no pair is made."""
    cells = links.where("hub IS NOT NULL").select("node", "hub").distinct().join(assigned, "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    n, same = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)
    hubs = cells.groupBy("hub").agg(F.count(F.lit(1)).alias("shards"), (n * (n - 1) / 2).alias("pairs"), same.alias("same")).where("pairs > 0")
    cut = F.col("pairs") - F.col("same")
    return hubs.agg(F.count(F.lit(1)).alias("hubs"), F.count_if(F.col("shards") > 1).alias("cut_hubs"), F.sum("pairs").alias("pairs"), F.sum(cut).alias("cut_pairs"))


def write_shards(docs: DataFrame, path: str, files: int = 8) -> None:
    """Rows with a column ``shard`` as a folder for each shard, each of about ``files`` files however large it is; rows of a file stand by ``slot``."""
    dealt = docs.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(files)))
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
