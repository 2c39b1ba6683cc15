"""Prefix trie of rebuilt conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by the exclusive or of hashes of (place, turn)
over its turns, 128 bits, so the names of all prefixes come from running sums that may be cut anywhere:
places and prefix names are found block by block, and one conversation may fill many tasks. A grouped sum
with map-side combine makes the nodes.

A node that one conversation alone has needs no tree: below it is that conversation. The nodes with several
members are sorted by shard and, within it, in reverse level order; a task streams over them, takes the
children's totals out of a priority queue, adds its own and leaves the sum in the queue for the parent. The
queue writes sorted runs beside the task when it grows. A shard is the part of the trie below a node with
few members whose parent has many. The totals of the shards' roots are summed by parent, and the nodes
with many members, of which each level has at most ``SHARDS``, pass them on to the root in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lurescope.session import broadcast_if_small, materialise

#: Conversations are joined to the opening of the one at the hundred below them; openings have fewer turns than this.
HOST_EVERY, OPENING = 100, 6
#: Turns whose places or prefixes one task works out together.
BLOCK_TURNS = 1 << 10
#: A node is in a shard if it has at most this many members, or one in ``SHARDS`` of all conversations if those are more.
FEW_MEMBERS = 1 << 12
SHARDS = 1 << 12
#: Messages a task's queue holds before it writes a run.
QUEUE_MESSAGES = 1 << 18
#: Rows up to which a side is broadcast, and ids in a packed run.
SMALL, RUN_IDS = 1 << 20, 1 << 15

TOTALS = "n_children long, n_leaves long, saved_tokens long"
NODE = "a long, b long, depth long, pa long, pb long, conv_id long, n_convs long, worth long"


# --- Conversations and their prefixes -------------------------------------------------------------


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, n, idx, ta, tb, chars) of every turn: its place in its conversation of n turns, from 0.

    Ordered by turn, null first; turns of equal number by role, then text. Null roles and texts are empty.
    Rows without a conv_id are left out.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce("block", F.lit(-(1 << 62))))
    counts = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("m"))
    so_far = Window.partitionBy("conv_id").orderBy("block")
    offsets = counts.select(
        "conv_id",
        "block",
        (F.sum("m").over(so_far) - F.col("m")).alias("offset"),
        F.sum("m").over(Window.partitionBy("conv_id")).alias("n"),
    )
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    local = rows.select(
        "conv_id",
        "block",
        (F.row_number().over(order) - 1).cast("long").alias("local"),
        F.xxhash64("role", "text").alias("ta"),
        F.xxhash64(F.lit(1), "text", "role").alias("tb"),
        F.length("text").cast("long").alias("chars"),
    )
    own = local.join(offsets, ["conv_id", "block"])
    return own.select("conv_id", "n", (F.col("offset") + F.col("local")).alias("idx"), "ta", "tb", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, length, ta, tb, chars) of all turns of the rebuilt conversations, and (conv_id, length) of all.

    Conversation c opens with the first h = crc32(decimal c) mod 6 turns of conversation c - c % 100 (the
    remainder has the sign of c), and goes on with its own turns from place h.
    """
    own = materialise(placed(turns), "turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % OPENING).cast("long")
    convs = own.where("idx = 0").select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % HOST_EVERY).alias("host"))
    hosts = convs.where("conv_id = host").select("host", F.col("n").alias("host_n"))
    known = convs.join(hosts, "host", "left")
    opened = F.least("h", F.coalesce("host_n", F.lit(0)))
    known = known.select("conv_id", "host", "h", opened.alias("k"), (opened + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    known = materialise(known, "conversations")
    first = own.where((F.col("conv_id") % HOST_EVERY == 0) & (F.col("idx") < OPENING)).select(
        F.col("conv_id").alias("host"), "idx", "ta", "tb", "chars"
    )
    openings = known.join(first, "host").where("idx < h").select("conv_id", F.col("idx").alias("pos"), "length", "ta", "tb", "chars")
    # Few hosts are shorter than the opening asked of them, so few conversations move.
    moved = broadcast_if_small(known.where("k < h").select("conv_id", (F.col("h") - F.col("k")).alias("less")), SMALL)
    less = F.coalesce("less", F.lit(0))
    rest = own.where(F.col("idx") >= h).join(moved, "conv_id", "left").select(
        "conv_id", (F.col("idx") - less).alias("pos"), (F.col("n") - less).alias("length"), "ta", "tb", "chars"
    )
    return openings.unionByName(rest), known.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars, last) for every prefix: its name and that of its parent."""
    named = rows.select(
        "conv_id",
        "pos",
        F.floor(F.col("pos") / BLOCK_TURNS).alias("block"),
        F.xxhash64("pos", "ta", "tb").alias("ha"),
        F.xxhash64("tb", "ta", "pos").alias("hb"),
        "chars",
        (F.col("pos") + 1 == F.col("length")).alias("last"),
    )
    blocks = named.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "conv_id", "block", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(s) for x, s in (("xa", "sa"), ("xb", "sb")))
    )
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = named.select("*", F.bit_xor("ha").over(within).alias("la"), F.bit_xor("hb").over(within).alias("lb"))
    whole = local.join(starts, ["conv_id", "block"])
    a, b = F.col("sa").bitwiseXOR(F.col("la")), F.col("sb").bitwiseXOR(F.col("lb"))
    return whole.select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        a.alias("a"),
        b.alias("b"),
        a.bitwiseXOR(F.col("ha")).alias("pa"),
        b.bitwiseXOR(F.col("hb")).alias("pb"),
        "chars",
        "last",
    )


# --- Time-forward processing ----------------------------------------------------------------------


class SpillingQueue:
    """A priority queue of (key, values) that writes sorted runs once it holds ``most`` messages.

    Runs are private to the task, in the folder that its executor names for such files; a task that is run
    again writes its own.
    """

    def __init__(self, most: int = QUEUE_MESSAGES):
        self.most, self.heap, self.runs = most, [], []

    def push(self, key: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (key, values))
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            for message in sorted(self.heap):
                pickle.dump(message, run)
            run.seek(0)
            self.heap = []
            self._next(run)

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def taken(self, key: tuple) -> tuple[int, int, int]:
        """The summed values of all messages to ``key``, which has to be the smallest key or absent."""
        sums = (0, 0, 0)
        while True:
            in_run = bool(self.runs) and (not self.heap or self.runs[0][0] < self.heap[0])
            smallest = self.runs[0][0] if in_run else self.heap[0] if self.heap else None
            if smallest is None or smallest[0] != key:
                return sums
            sums = tuple(x + y for x, y in zip(sums, smallest[1]))
            if in_run:
                self._next(heapq.heappop(self.runs)[2])
            else:
                heapq.heappop(self.heap)


def time_forward(most: int = QUEUE_MESSAGES):
    """A function over nodes sorted by (shard, depth from the deepest, name) that adds subtree totals.

    Columns: shard (sa, sb), node (a, b), depth, parent (pa, pb), conv_id, n_convs, worth (what the node saves
    itself), and kids, leaves, saved: totals of children that are in no shard.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, None
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            out = []
            for sa, sb, a, b, depth, up_a, up_b, worth, kids, leaves, saved in zip(
                *(columns[c] for c in ("sa", "sb", "a", "b", "depth", "pa", "pb", "worth", "kids", "leaves", "saved"))
            ):
                if (sa, sb) != shard:
                    shard, queue = (sa, sb), SpillingQueue(most)
                own = queue.taken((-depth, a, b))
                children = own[0] + kids
                totals = (children, own[1] + leaves if children else 1, own[2] + saved + worth)
                out.append(totals)
                if (a, b) != shard:
                    queue.push((1 - depth, up_a, up_b), (1, *totals[1:]))
            made = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("a", "b", "depth", "pa", "pb", "conv_id", "n_convs", "worth")), *map(pa.array, made.T.copy())],
                schema=pa.schema(
                    [
                        *((c, pa.int64()) for c in ("a", "b", "depth", "pa", "pb", "conv_id", "n_convs", "worth")),
                        *((c, pa.int64()) for c in ("n_children", "n_leaves", "saved_tokens")),
                    ]
                ),
            )

    return rows


def _with_totals(nodes: DataFrame, most: int) -> DataFrame:
    columns = ["sa", "sb", "a", "b", "depth", "pa", "pb", "conv_id", "n_convs", "worth", "kids", "leaves", "saved"]
    order = nodes.select(*columns).sortWithinPartitions("sa", "sb", F.desc("depth"), "a", "b")
    return order.mapInArrow(time_forward(most), f"{NODE}, {TOTALS}")


def _summed(children: DataFrame, kids: Column, leaves: Column, saved: Column) -> DataFrame:
    return children.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.sum(kids).alias("kids"), F.sum(leaves).alias("leaves"), F.sum(saved).alias("saved")
    )


# --- Ends -----------------------------------------------------------------------------------------


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted ids of a node as one text each."""
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_IDS):
            part = batch.slice(at, RUN_IDS)
            a, b, ids = (part.column(c).to_numpy() for c in ("a", "b", "conv_id"))
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            starts = np.concatenate(([0], cuts)).astype(int)
            ends = np.concatenate((cuts, [len(ids)])).astype(int)
            texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array(texts)], names=["a", "b", "first", "ids"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs, which come one after the other."""
    node, digest = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
            if (a, b) == node:
                digest.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((*node, digest.hexdigest()))
            node, digest = (a, b), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, digest.hexdigest())], names=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of ``ends`` (a, b, conv_id): the ids of each node in ascending order.

    The ids are cut by range, so those of a node with very many fill many tasks, which pack them; one task
    then reads a node's packed runs in order, as the digest demands, without keeping them.
    """
    packed = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    runs = packed.mapInArrow(_packed_ids, "a long, b long, first long, ids string")
    ordered = runs.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return ordered.mapInArrow(_digests, "a long, b long, ends_sha256 string")


# --- The trie -------------------------------------------------------------------------------------


def trie(turns: DataFrame, few: int | None = None, queue: int = QUEUE_MESSAGES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuilt``).

    Columns: conv_id (its smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (nodes
    without children in its subtree), saved_tokens (over its subtree, members beyond the first times the code
    points of the last text), ends_sha256 (of the ascending ids of the conversations that end there).
    Repeated rows are turns of their own; an empty table gives the root alone, without a conv_id or members.
    ``few`` sets the members up to which a node may be in a shard.
    """
    rows, convs = rebuilt(turns)
    paths = materialise(prefixes(rows), "prefixes")
    empty = hashlib.sha256(b"").hexdigest()
    nodes = paths.groupBy("a", "b", "depth", "pa", "pb").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
        F.bool_or(~F.col("last")).alias("goes_on"),
    )
    nodes = materialise(nodes.withColumn("worth", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).select(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("worth"),
    )
    few = few or max(FEW_MEMBERS, -(-convs.count() // SHARDS))
    alone = nodes.where("n_convs = 1")
    plain = [c.split()[0] for c in NODE.split(", ")]
    one = F.lit(1).cast("long")
    known = alone.select(*plain, F.col("goes_on").cast("long").alias("n_children"), one.alias("n_leaves"), (one - 1).alias("saved_tokens"))
    outside = materialise(_summed(alone, one, one, one - 1), "single_children")
    zero = F.lit(0).cast("long")
    several = nodes.where("n_convs > 1").select(*plain).unionByName(root).join(outside, ["a", "b"], "left")
    several = several.select(*plain, *(F.coalesce(c, zero).alias(c) for c in ("kids", "leaves", "saved")))
    # The shard of a node is the first node on the way to it, from the root, with few members.
    many = nodes.where(F.col("n_convs") > few).select("a", "b", "conv_id")
    marked = paths.join(broadcast_if_small(many.select("a", "b", F.lit(True).alias("many")), SMALL), ["a", "b"], "left")
    tops = marked.where("many is null").groupBy("conv_id").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    tops = tops.select("conv_id", F.col("top.a").alias("sa"), F.col("top.b").alias("sb"))
    sharded = several.where((F.col("n_convs") <= few) & (F.col("depth") > 0)).join(tops, "conv_id")
    within = materialise(_with_totals(sharded.repartition("sa", "sb"), queue), "shards")
    # A shard's root is the node whose parent has many members or is the root.
    ways = many.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    top = root.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    upper = broadcast_if_small(ways.unionByName(top), SMALL)
    sent = _summed(within.join(upper.drop("parent_conv_id"), ["pa", "pb"], "left_semi"), one, F.col("n_leaves"), F.col("saved_tokens"))
    above = several.where((F.col("n_convs") > few) | (F.col("depth") == 0))
    both = above.join(sent.toDF("a", "b", "k2", "l2", "s2"), ["a", "b"], "left").select(
        *plain, zero.alias("sa"), zero.alias("sb"),
        *((F.col(x) + F.coalesce(y, zero)).alias(x) for x, y in (("kids", "k2"), ("leaves", "l2"), ("saved", "s2"))),
    )
    # At most SHARDS nodes a level with many members: one task streams over them.
    across = _with_totals(both.repartition(1), queue)
    every = materialise(known.unionByName(within).unionByName(across), "totals")
    # Parents with many children have many members or are the root; those come from the broadcast side.
    first = every.join(upper, ["pa", "pb"], "left")
    near = first.where("parent_conv_id is not null or depth = 0")
    parents = nodes.where(F.col("n_convs") <= few).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    far = first.where("parent_conv_id is null and depth > 0").drop("parent_conv_id").join(parents, ["pa", "pb"])
    ends = paths.where("last").select("a", "b", "conv_id").unionByName(
        convs.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")
    )
    digests = end_digests(ends)
    return near.unionByName(far, allowMissingColumns=True).join(digests, ["a", "b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


#: The same in DuckDB's SQL; the table of CRC-32 remainders is worked out from its polynomial.
ORACLE = """with recursive bits as (select i, i as c, 0 as k from range(256) r(i)
 union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from bits where k < 8),
remainders as (select list(c order by i) as t from bits where k = 8),
own as (select conv_id::bigint as c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l
 from conversations where conv_id is not null group by 1),
crc as (select c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint)),
 lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 6 as h from own, remainders),
reb as (select own.c, list_concat(coalesce(host.l[1:h], []), own.l[h + 1:]) as l
 from own join crc using (c) left join own as host on host.c = own.c - own.c % 100),
paths as (select c, len(l) as n, d, l[1:d] as k from (select c, l, unnest(range(0, len(l) + 1)) as d from reb)),
nodes as (select k, d, min(c) as conv_id, count(*) as n_convs, coalesce(sha256(string_agg(c::varchar, ',' order by c) filter (where n = d)), sha256('')) as ends_sha256
 from paths group by k, d),
kids as (select k[1:d - 1] as k, count(*) as n_children from nodes where d > 0 group by 1),
leaf as (select nodes.k, nodes.d, (kids.k is null)::integer as is_leaf, case when d > 0 then (n_convs - 1) * length(k[d].x) else 0 end as worth from nodes left join kids using (k)),
sums as (select k[1:e] as k, sum(is_leaf)::bigint as n_leaves, sum(worth)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as e from leaf) group by 1)
select nodes.conv_id, nodes.d as depth, up.conv_id as parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::bigint as n_children,
 n_leaves, saved_tokens, nodes.ends_sha256
from nodes join sums using (k) left join kids using (k) left join nodes as up on nodes.d > 0 and up.k = nodes.k[1:nodes.d - 1]"""
