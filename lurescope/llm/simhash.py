"""SimHash fingerprints and near-duplicate groups through vantage-point trees over Hamming distance.

Fingerprints that differ in at most three bits differ in at most one bit of the lower or of the upper
half, so each half has a tree of its own with a tolerance of one bit. A node holds a vantage point and
a radius r: by the triangle inequality two linked halves are at distances from the vantage point that
differ by at most the tolerance, so the pair lies below r, or at r - tolerance and beyond. The first
group is one branch, the second the other; only the thin shell in between goes to both. The trees are
fitted on a bounded sample of distinct fingerprints and every distinct fingerprint is routed through
them; a shard holds the fingerprints of one leaf, splits them further by the same rule while it has
many, and compares the rest exactly on all 64 bits. Copies meet before, as one fingerprint.

A shard gives back one link per fingerprint, to the smallest of its group there, so a dense group
never becomes all its pairs. Links are then contracted to components round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text
from lurescope.session import materialise

SHINGLE = 3
SEED = 42
MOST_BITS = 3
HALF_TOLERANCE = 1
#: Distinct fingerprints a shard should hold, and below which a shard compares directly.
SHARD_SIZE = 4096
DIRECT = 1024
#: Most fingerprints the trees are fitted on; 16 for each shard.
MAX_SAMPLE = 1 << 17
_HALVES = (np.uint64(0), np.uint64(32))


def fingerprint(words: list[bytes]) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero if there is no word."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE - 1]
        runs = zip(*(part[i:] for i in range(SHINGLE))) if len(part) >= SHINGLE else [part]
        hashes = np.array([digest(b" ".join(run), SEED) for run in runs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the fingerprint (as a signed long) of every row; null texts are empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            texts = arrow_text.plain(block.column("text"))
            # bytes.lower and bytes.split know A-Z and the six ASCII spaces only.
            made = [fingerprint(t.as_py().encode().lower().split()) for t in texts]
            signed = np.array(made, dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("version"), pa.array(signed)],
                names=["doc_id", "version", "fingerprint"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    return keyed.mapInArrow(rows, "doc_id long, version long, fingerprint long")


def _distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _split(points: np.ndarray, tolerance: int, rng: np.random.Generator) -> tuple[np.uint64, int, int] | None:
    """(vantage point, radius, larger branch) of the best of a few vantage points."""
    best = None
    for vantage in points[rng.integers(0, len(points), 6)]:
        counts = np.bincount(_distances(points, vantage), minlength=65)
        below = np.cumsum(counts)
        for radius in range(1, 65):
            low = below[radius - 1]
            high = len(points) - (below[radius - 1 - tolerance] if radius > tolerance else 0)
            if best is None or max(low, high) < best[2]:
                best = (vantage, radius, int(max(low, high)))
    return best if best and best[2] < len(points) else None


def grow_tree(points: np.ndarray, leaf_size: int, tolerance: int, seed: int) -> dict[str, np.ndarray]:
    """A tree as arrays: vantage, radius (0 at a leaf), and the two children of each node."""
    rng = np.random.default_rng(seed)
    vantage, radius, near, far = [], [], [], []

    def grow(own: np.ndarray) -> int:
        me = len(vantage)
        for column in (vantage, radius, near, far):
            column.append(0)
        cut = _split(own, tolerance, rng) if len(own) > leaf_size else None
        if cut and cut[2] < 0.9 * len(own):
            distance = _distances(own, cut[0])
            vantage[me], radius[me] = cut[0], cut[1]
            near[me] = grow(own[distance < cut[1]])
            far[me] = grow(own[distance >= cut[1] - tolerance])
        return me

    grow(points)
    return {
        "vantage": np.array(vantage, np.uint64),
        "radius": np.array(radius, np.int16),
        "near": np.array(near, np.int32),
        "far": np.array(far, np.int32),
    }


def route(tree: dict[str, np.ndarray], points: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index of the point) for every leaf a point belongs to."""
    leaves, rows = [], []
    waiting = [(0, np.arange(len(points)))]
    while waiting:
        node, own = waiting.pop()
        if not len(own):
            continue
        radius = tree["radius"][node]
        if radius == 0:
            leaves.append(np.full(len(own), node, np.int32))
            rows.append(own)
            continue
        distance = _distances(points[own], tree["vantage"][node]).astype(np.int16)
        waiting.append((int(tree["near"][node]), own[distance < radius]))
        waiting.append((int(tree["far"][node]), own[distance >= radius - tolerance]))
    if not leaves:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(leaves), np.concatenate(rows)


def _direct_links(points: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Groups as (members, first member); every point is compared with those not yet reached."""
    groups, open_ = [], np.arange(len(points))
    while len(open_) > 1:
        first, open_ = int(open_[0]), open_[1:]
        frontier, reached = np.array([first]), []
        while len(frontier) and len(open_):
            hit = np.zeros(len(open_), dtype=bool)
            for at in range(0, len(frontier), 64):
                some = points[frontier[at : at + 64], None] ^ points[open_[~hit]][None, :]
                near = (np.bitwise_count(some) <= MOST_BITS).any(axis=0)
                hit[np.flatnonzero(~hit)[near]] = True
            frontier, open_ = open_[hit], open_[~hit]
            reached.append(frontier)
        if reached and sum(map(len, reached)):
            groups.append((np.concatenate(reached), first))
    return groups


def shard_links(points: np.ndarray, half: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), as indices, that connect all linked points of a shard of one half's tree."""
    rng = np.random.default_rng(seed)
    ends: list[np.ndarray] = [np.zeros(0, np.int64)]
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    waiting = [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        if len(own) > DIRECT:
            # The shard's own half, one bit of tolerance; else the other half, where three bits may differ.
            for shift, tolerance in ((_HALVES[half], HALF_TOLERANCE), (_HALVES[1 - half], MOST_BITS)):
                part = (points[own] >> shift) & np.uint64(0xFFFFFFFF)
                cut = _split(part, tolerance, rng)
                if cut and cut[2] < 0.85 * len(own):
                    break
            if cut and cut[2] < 0.85 * len(own):
                distance = _distances(part, cut[0]).astype(np.int16)
                waiting += [own[distance < cut[1]], own[distance >= cut[1] - tolerance]]
                continue
        for members, first in _direct_links(points[own]):
            ends.append(own[members])
            starts.append(np.full(len(members), own[first]))
    return np.concatenate(starts), np.concatenate(ends)


def links(groups: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of ``groups`` (fingerprint, id), enough to connect near ones."""
    n = groups.count()
    leaves = min(max(1, n // SHARD_SIZE), MAX_SAMPLE // 16)
    keep = max(1, n // (16 * leaves))
    picked = groups.where(F.pmod(F.xxhash64("fingerprint"), F.lit(keep)) == 0).select("fingerprint")
    sample = np.array([r[0] for r in picked.limit(MAX_SAMPLE).collect()], dtype=np.int64).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    leaf_size = max(8, len(sample) // leaves)
    trees = [grow_tree((sample >> s) & mask, leaf_size, HALF_TOLERANCE, i) for i, s in enumerate(_HALVES)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for half, tree in enumerate(trees):
                leaf, row = route(tree, (prints.astype(np.uint64) >> _HALVES[half]) & mask, HALF_TOLERANCE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(leaf), half, np.int32)),
                        pa.array(leaf),
                        pa.array(prints[row]),
                        pa.array(ids[row]),
                    ],
                    names=["half", "leaf", "fingerprint", "id"],
                )

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        points = table.column("fingerprint").to_numpy().astype(np.uint64)
        ids = table.column("id").to_numpy()
        a, b = shard_links(points, key[0].as_py())
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    shards = groups.mapInArrow(routed, "half int, leaf int, fingerprint long, id long")
    return shards.groupBy("half", "leaf").applyInArrow(compared, "a long, b long").where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b) that is not itself the smallest of its component.

    Each round points every id at its smallest neighbour and contracts the edges to those parents;
    rounds are stored, so the plan stays short and a lost executor costs one round at most.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).where("p < a")
        parents = materialise(parents.withColumnRenamed("a", "id"), "parents")
        to = lambda frame, name: (
            frame.join(parents.select(F.col("id").alias(name), "p"), name, "left")
            .withColumn(name, F.coalesce("p", name))
            .drop("p")
        )
        roots = parents.withColumnRenamed("p", "root") if roots is None else (
            to(roots, "root").unionByName(parents.withColumnRenamed("p", "root"))
        )
        roots = materialise(roots, "roots")
        moved = to(to(edges, "a"), "b").where("a != b")
        edges = materialise(
            moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
        )
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # An id that was another's parent can have had parents in several rounds; all lead to the same root.
    return roots.groupBy("id").agg(F.min("root").alias("root"))


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fingerprint, root, component_id) of every row; root is the component's smallest fingerprint."""
    prints = materialise(fingerprints(docs), "fingerprints")
    firsts = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "groups")
    # Fingerprints name themselves, so that those without a doc_id are linked like the others.
    roots = components(links(firsts.select("fingerprint", F.col("fingerprint").alias("id"))))
    named = firsts.join(roots.withColumnRenamed("id", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = materialise(named, "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.select("fingerprint", "root").join(ids, "root"), "fingerprint", "left")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most three bits. Repeated rows stay;
    rows without a doc_id link like others and get the same, null if no row of their component has an id;
    an empty table gives no rows; other columns are ignored.
    """
    written = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return _grouped(docs).select("doc_id", written, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id.

    Of several texts with that doc_id the one with the smaller hash stays, of repeated rows any one. Rows
    without a doc_id stay only where no row of their group has one, and then one of the group.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")).alias("first")
    kept = _grouped(docs).groupBy("root").agg(first).select("first.doc_id", "first.version")
    own = docs.withColumn("__version", F.xxhash64("text"))
    same = own["doc_id"].eqNullSafe(kept["doc_id"]) & (own["__version"] == kept["version"])
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__version"]).drop("__version")
