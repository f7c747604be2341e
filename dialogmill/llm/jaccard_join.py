"""N-gram Jaccard self-join over signature trees whose upper part is dealt out by token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dialogmill.llm.common import bit_filter, discard, group_arrow, map_arrow, passes, settled, table
from dialogmill.llm.components import components
from dialogmill.llm.text_hash import mix, shingle_sets

#: Shingles of one slice of the root, of the sets that a task puts together before it sends them, and of a block of a tree.
SLICE, HELD, BLOCK = 2_000_000, 1_000_000, 400_000
#: Bytes of a shingle's hash that the root compares, besides the slice's number.
ROOT_BYTES = 5
#: Sets for which a filter of rows is broadcast (16 bits each, so 16 MB at most), and texts that a task remembers to have sent.
FILTER_ROWS, SENT = 1 << 23, 1 << 20


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that follow from the set alone."""
    return int(mix(shingles).sum(dtype=np.uint64)), int(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))


def _sizes_and_digests(docs: DataFrame, width: int) -> DataFrame:
    """(id, row, n_shingles, digest_a, digest_b) of every row of (id, row, text)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *set_digest(s)) for _, s in shingle_sets(batch.column(2), width)]
            numbers = np.array(found, np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(numbers[:, k]) for k in range(3))], ["id", "row", "n_shingles", "digest_a", "digest_b"])

    longs = [T.StructField(c, T.LongType()) for c in ("row", "n_shingles", "digest_a", "digest_b")]
    return map_arrow(docs, look, T.StructType([docs.schema["id"], *longs]))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def pack_indices(index: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending indices of each run bound[k]..bound[k + 1] as bytes: the difference to the index before, 255 for each 255 of it; and the runs' byte bounds."""
    step = np.diff(index, prepend=0)
    first = bound[:-1][bound[1:] > bound[:-1]]
    step[first] = index[first]
    last = np.cumsum(step // 255 + 1)
    out = np.full(int(last[-1]) if len(last) else 0, 255, np.uint8)
    out[last - 1] = step % 255
    return out, np.concatenate([[0], last])[bound]


def unpack_indices(packed: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of runs of ``pack_indices`` one behind the other, and the runs' bounds among them."""
    total = np.concatenate([[0], np.cumsum(packed, dtype=np.int64)])
    ends = np.flatnonzero(packed != 255)
    run = np.searchsorted(bound, ends, "right") - 1
    return total[ends + 1] - total[bound[run]], np.searchsorted(ends, bound)


def _binaries(values: np.ndarray, bound: np.ndarray) -> pa.Array:
    """Bytes bound[k]..bound[k + 1] of ``values`` as binary k."""
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer(bound.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _tokens(shingles: np.ndarray) -> np.ndarray:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ROOT_BYTES]


#: What a task tells of each of its sets: digest, size, and how many of its shingles other sets of the task hold.
_NAMED = np.dtype([("digest", "<i8"), ("n", "<i4"), ("found", "<i4")])


def cells(sets: list[np.ndarray], digests: np.ndarray, chunk: int, slices: int) -> pa.RecordBatch:
    """What these different sets say to each slice: shingles of one set with its place among the sets, and those of several, once each."""
    shingles, which = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(shingles, kind="stable")
    shingles, which = shingles[order], which[order]
    fresh = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    alone = fresh & np.concatenate([fresh[1:], [True]])
    named = np.zeros(len(sets), _NAMED)
    named["digest"], named["n"] = digests.view(np.int64), [len(s) for s in sets]
    named["found"] = np.bincount(which[~alone], minlength=len(sets))

    def dealt(some: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = ((some >> np.uint64(8 * ROOT_BYTES)) % np.uint64(slices)).astype(np.int64)
        order = np.lexsort((place, part))
        return some[order], place[order], np.concatenate([[0], np.cumsum(np.bincount(part, minlength=slices))])

    single, who, bound = dealt(shingles[alone], which[alone])
    several, _, bound_several = dealt(shingles[fresh & ~alone], np.zeros(int((fresh & ~alone).sum()), np.int64))
    columns = [
        pa.array(np.arange(slices, dtype=np.int32)), pa.array(np.full(slices, chunk, np.int64)), _binaries(_tokens(single), bound * ROOT_BYTES),
        _binaries(_tokens(several), bound_several * ROOT_BYTES), _binaries(*pack_indices(who, bound)), pa.array([named.tobytes(), *[None] * (slices - 1)], pa.binary()),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["slice", "chunk", "tokens", "several", "who", "sets"])
    return batch.filter(pa.array((np.diff(bound) + np.diff(bound_several) > 0) | (np.arange(slices) == 0)))


def _root_cells(docs: DataFrame, width: int, slices: int) -> DataFrame:
    """The cells (slice, chunk) of all sets of (text): shingles dealt by hash, those of about HELD together."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), width):
                digest = set_digest(found)[0] if len(found) else None
                if digest is not None and digest not in sets:
                    sets[digest] = found
                    held += len(found)
                if held >= HELD:
                    yield cells(list(sets.values()), np.array(list(sets), np.uint64), chunk, slices)
                    sets, held, chunk = {}, 0, chunk + 1
        if sets:
            yield cells(list(sets.values()), np.array(list(sets), np.uint64), chunk, slices)

    return map_arrow(docs, send, "slice int, chunk long, tokens binary, several binary, who binary, sets binary")


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one behind the other, and their bounds."""
    values = [v or b"" for v in column.to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def shared_in_slice(group: pa.Table) -> pa.Table:
    """(chunk, hits, sets): for each cell, the sets whose shingles another cell or several sets of a cell hold too, once a shingle."""
    (single, bound), (several, _), (who, who_bound) = (_joined(group[c]) for c in ("tokens", "several", "who"))
    tokens = np.zeros((len(single) + len(several)) // ROOT_BYTES, "<u8")
    tokens.view(np.uint8).reshape(-1, 8)[:, :ROOT_BYTES] = np.concatenate([single, several]).reshape(-1, ROOT_BYTES)
    n = len(single) // ROOT_BYTES
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    again = np.concatenate([ordered[1:] == ordered[:-1], [False]]) if len(ordered) else np.zeros(0, bool)
    hit = np.zeros(len(tokens), bool)
    hit[order] = again | np.concatenate([[False], again[:-1]])[: len(again)]
    places, _ = unpack_indices(who, who_bound)
    hits = np.flatnonzero(hit[:n])
    packed = pack_indices(places[hits], np.searchsorted(hits, bound // ROOT_BYTES))
    return pa.table({"chunk": group["chunk"], "hits": _binaries(*packed), "sets": group["sets"]})


def near_in_chunk(group: pa.Table, percent: int) -> pa.Table:
    """Digests of the sets of a chunk of which enough shingles are shared for a link."""
    named = np.frombuffer(next(v for v in group["sets"].to_pylist() if v is not None), _NAMED)
    hits, _ = unpack_indices(*_joined(group["hits"]))
    shared = np.bincount(hits, minlength=len(named)) + named["found"]
    return pa.table({"digest_a": pa.array(np.ascontiguousarray(named["digest"][100 * shared >= percent * named["n"].astype(np.int64)]))})


def _near_digests(docs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """(digest_a) of the sets that may link: of their shingles, so many occur in another set (or in copies of the set itself) as any link needs.

    The table must give the same rows in the same partitions when read again, as files do.
    """
    sent = _root_cells(docs, width, max(1, -(-total // SLICE)))
    hits = group_arrow(sent, ["slice"], shared_in_slice, "chunk long, hits binary, sets binary").where("sets IS NOT NULL OR octet_length(hits) > 0")
    return group_arrow(hits, ["chunk"], lambda group: near_in_chunk(group, percent), "digest_a long").distinct()


def _near_shingles(texts: DataFrame, near: DataFrame, width: int) -> DataFrame:
    """(key, shingles) of the sets ``near``, from (row, text); a small filter on rows spares the shuffle of texts, beyond FILTER_ROWS sets they are joined."""
    n = near.count()
    if n > FILTER_ROWS:
        texts = texts.join(near.select("row"), "row", "left_semi")
        shared = None
    else:
        shared = texts.sparkSession.sparkContext.broadcast(bit_filter(near.select("row"), n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            rows = batch.column(0).to_numpy()
            if shared is not None:
                rows = rows[passes(shared.value, rows)]
            fresh = [r for r in dict.fromkeys(rows.tolist()) if r not in sent]
            if fresh:
                if len(sent) < SENT:
                    sent.update(fresh)
                first = pc.index_in(pa.array(fresh, pa.int64()), batch.column(0))
                found = [s for _, s in shingle_sets(batch.column(1).take(first), width)]
                bound = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.int64()), _lists(np.concatenate(found).view(np.int64), bound)], ["row", "shingles"])

    one = map_arrow(texts, cut, "row long, shingles array<long>").groupBy("row").agg(F.first("shingles").alias("shingles"))
    return one.join(near.select("row", "key"), "row").select("key", "shingles")


class SignatureTree:
    """Sets in order of size under nodes that hold the OR of their bitmaps, their sizes' range and the most shingles that share a bit."""

    FANOUT = 4
    #: 64-bit words of bitmaps that are compared together.
    WORDS = 1 << 20

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << max(8, min(17, int(8 * sizes.mean()).bit_length()))
        self.order = np.argsort(sizes, kind="stable")
        self.sets = [sets[i] for i in self.order]
        ordered = sizes[self.order]
        bitmap = np.zeros((len(sets), bits // 64), np.uint64)
        for row, shingles in zip(bitmap, self.sets, strict=True):
            at = shingles & np.uint64(bits - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self.levels = [(bitmap, ordered, ordered, ordered - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), self.FANOUT)
            bitmap, low, high, lost = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bitmap, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(lost, cut)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the largest overlap that nodes a and b of a level allow can make a link."""
        bitmap, low, high, lost = self.levels[level]
        near = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        at = np.flatnonzero(near)
        step = max(1, self.WORDS // bitmap.shape[1])
        for start in range(0, len(at), step):
            own = at[start : start + step]
            x, y = a[own], b[own]
            most = np.bitwise_count(bitmap[x] & bitmap[y]).sum(axis=1, dtype=np.int64) + np.minimum(lost[x], lost[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            near[own] = (100 + percent) * most >= percent * (low[x] + low[y])
        return near

    def _pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the leaf pairs that may link, by dual traversal from (root, root); depth first, so that few node pairs wait."""
        kid = np.arange(self.FANOUT)
        wait = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while wait:
            level, a, b = wait.pop()
            if len(a) > self.WORDS // 64:
                wait += [(level, a[k : k + self.WORDS // 64], b[k : k + self.WORDS // 64]) for k in range(0, len(a), self.WORDS // 64)]
                continue
            keep = (a == b) if level else a != b
            other = np.flatnonzero(a != b)
            keep[other] = self.may_link(level, a[other], b[other], percent)
            a, b = a[keep], b[keep]
            if level == 0:
                yield a, b
            elif len(a):
                n = len(self.levels[level - 1][0])
                x = np.repeat(a[:, None] * self.FANOUT + kid, self.FANOUT, axis=1).ravel()
                y = np.tile(b[:, None] * self.FANOUT + kid, (1, self.FANOUT)).ravel()
                fine = (x < n) & (y < n) & (x <= y)
                wait.append((level - 1, x[fine], y[fine]))

    def _link(self, x: int, y: int, percent: int) -> bool:
        s, t = self.sets[x], self.sets[y]
        place = np.searchsorted(t, s)
        both = int((t[np.minimum(place, len(t) - 1)] == s).sum())
        return 100 * both >= percent * (len(s) + len(t) - both)

    def links(self, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that connect what all links connect: a pair already connected isn't looked at again.

        ``side``: only sets of different sides are joined, besides the first set with all others, which goes first.
        """
        root = np.arange(len(self.sets))
        across = np.zeros(len(self.sets), np.int64) if side is None else side[self.order]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def judge(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                u, v = find(x), find(y)
                if u != v and self._link(x, y, percent):
                    root[u] = v
                    yield int(self.order[x]), int(self.order[y])

        hub = int(np.flatnonzero(self.order == 0)[0])
        rest = np.delete(np.arange(len(self.sets)), hub)
        near = self.may_link(0, np.full(len(rest), hub), rest, percent)
        yield from judge(np.full(int(near.sum()), hub), rest[near])
        for a, b in self._pairs(percent):
            while (deeper := root[root]).tobytes() != root.tobytes():
                root[:] = deeper
            keep = (root[a] != root[b]) & (across[a] != across[b] if side is not None else True)
            yield from judge(a[keep], b[keep])


def _tree_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each hub's sets; members: (hub, key, n, shingles).

    Hubs of up to BLOCK shingles are one tree each, and many of them one task. Larger ones are cut into blocks by key, and each two
    blocks are a tree and a task, so no task holds more than a few blocks.
    """
    per_hub = settled(members.groupBy("hub").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("hub", F.ceil(F.col("total") / BLOCK).alias("blocks"), "total"), "hubs")
    parts = max(1, -(-(per_hub.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // (2 * BLOCK)))
    blocks = F.col("blocks")
    dealt = members.join(per_hub, "hub").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    part = F.when(blocks == 1, F.pmod(F.xxhash64("hub"), F.lit(parts))).otherwise(-1 - F.pmod(F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other")), F.lit(1 << 62)))
    dealt = dealt.select(part.alias("part"), "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "shingles")

    def decide(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("hub", "i", "j", "key")]).combine_chunks()
        keys, block = group["key"].to_numpy(), group["block"].to_numpy()
        tree = np.stack([group[c].to_numpy() for c in ("hub", "i", "j")], axis=1)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]).any(axis=1)])), len(keys))
        lists = group["shingles"].combine_chunks()
        bound, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        found: list[tuple[int, int]] = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end - start > 1:
                sets = [values[bound[k] : bound[k + 1]] for k in range(start, end)]
                side = None if tree[start, 1] == tree[start, 2] else block[start:end]
                found += [(keys[start + x], keys[start + y]) for x, y in SignatureTree(sets).links(percent, side)]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return group_arrow(dealt, ["part"], decide, "a long, b long")


def _needed(n: Column, percent: int) -> Column:
    """Least overlap of a set of this size with any set that it links with."""
    return F.ceil(n * percent / 100)


def _members(sets: DataFrame, percent: int) -> DataFrame:
    """(hub, key, n): the sets that share a prefix shingle with the hub, which is the first set that has it; of (key, shingles)."""
    each = sets.select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    by_key = Window.partitionBy("key")
    ranked = each.join(often, "shingle").withColumns({"place": F.row_number().over(by_key.orderBy("often", "shingle")), "not_own": F.count(F.lit(1)).over(by_key)})
    own = F.col("n") - F.col("not_own")  # these come first in the order and meet nothing
    prefix = settled(ranked.where(own + F.col("place") <= F.col("n") - _needed(F.col("n"), percent) + 1).select("key", "n", "shingle"), "prefixes")
    hubs = prefix.groupBy("shingle").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("shingle", "hub")
    return prefix.join(hubs, "shingle").select("hub", "key", "n").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, row, n_shingles, component_id, lead) of every row; lead: the smallest (id, hash of the text) of its class."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    sets = settled(_sizes_and_digests(texts, width), "digests")
    digest = ["n_shingles", "digest_a", "digest_b"]
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    copies = settled(sets.where("n_shingles > 0").groupBy(*digest).agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("lead"), F.min("row").alias("row")), "copies")
    near = copies.join(_near_digests(texts.select("text"), width, percent, total), "digest_a", "left_semi")
    near = settled(near.select(*digest, "lead", "row", F.monotonically_increasing_id().alias("key")), "near")
    shingles = settled(_near_shingles(texts.select("row", "text"), near, width), "shingles")
    members = settled(_members(shingles, percent), "members")
    links = settled(_tree_links(members.join(shingles, "key"), percent), "links")
    discard(members, shingles)
    group = F.coalesce("component", "key")
    grouped = near.join(components(links, "a", "b").withColumnRenamed("id", "key"), "key", "left").withColumn("group", group)
    leads = grouped.groupBy("group").agg(F.min("lead").alias("class_lead"))
    named = settled(grouped.join(leads, "group").select(*digest, "class_lead"), "classes")
    whole = copies.join(named, digest, "left").select(*digest, F.coalesce("class_lead", "lead").alias("lead"))
    found = sets.join(whole, digest, "left")
    return found.select("id", "row", "n_shingles", F.coalesce("lead.id", "id").alias("component_id"), "lead")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row: classes of documents whose shingle sets link.

    A set holds the distinct runs of ``width`` words (A-Z as a-z); with fewer words, the whole run. Two
    documents link when 100 * |A and B| >= percent * |A or B|; component_id is the smallest id reachable. Null and empty
    texts, and those without words, have 0 shingles and link with nothing. Rows with a null id link as all do but name no class, so
    theirs is null where all ids of it are. Repeated rows are copies. Different texts under one id are documents of their own. An empty
    table gives an empty table.

    Copies are one set. The root of the tree is dealt out in slices of the shingles' hashes: each says which of a set's shingles
    occur elsewhere, and a set goes no further unless these make a link's least overlap. Below the root, a tree stands
    at each hub, the first of the sets that share a shingle of their prefixes (rarest first; of n shingles the
    first n - ceil(t * n) + 1, one of which any link shares), and holds all sets that do; in each tree, node pairs are
    pruned by OR-combined bitmaps and size ranges, and leaves are counted exactly. Pairs already connected aren't counted again.
    """
    return _classes(docs, id_col, text_col, width, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One document of each class, that with the smallest id (of several texts under it, the one with the smallest hash), all columns as they are.

    Documents without words are classes of their own. Of rows with the same id and text one stays. Rows with a null id stay.
    """
    found = _classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, percent)
    lead = found.where(F.col("lead").isNull() | ((F.col("lead.id") == F.col("id")) & (F.col("lead.row") == F.col("row")))).select(F.col("id").alias("__lead"), F.col("row").alias("__lead_row"))
    rows = docs.where(F.col(id_col).isNotNull()).withColumn("__row", F.xxhash64(text_col))
    kept = rows.join(lead, (F.col(id_col) == F.col("__lead")) & (F.col("__row") == F.col("__lead_row")), "left_semi").dropDuplicates([id_col, "__row"])
    return kept.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
