"""Prefix tries of conversations: double arrays per shard, upper nodes merged over all shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import SPACES, small_side, stored

#: Turns (and ends of conversations) that one shard holds at most, on average.
SHARD_TURNS = 1 << 17
#: Places tried for the children of a node before they go to the end of the arrays.
TRIES = 32
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = SPACES.replace("[", "[^")
PART = (
    "shard int, spine boolean, key binary, parent_key binary, chain array<binary>, depth long, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
)


def turn_paths(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, digests, words): the turns of each conversation in order, as 128-bit digests, and the words of each text.

    Texts are not shuffled, only digests and counts. A conversation is one row, so its
    turns must fit a task. Null turn numbers come first, equal ones in the order of their
    digests; a null role or text is empty; rows without a conversation id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conv.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("at"), F.unhex(F.substring(F.sha2(turn, 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
        ).alias("t"),
    ).filter("conv_id is not null")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"))


def graft(paths: DataFrame, every: int = 20, cuts: int = 4) -> DataFrame:
    """Conversations that begin alike: each takes over the first ``h`` turns of the nearest multiple of ``every`` below its id.

    ``h`` is the CRC-32 of the id as text modulo ``cuts``; the conversation's own turns
    after its first ``h`` follow. A conversation that is absent has no turns to give.
    """
    donor = F.col("conv_id") - F.col("conv_id") % every
    heads = paths.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_donor"), *[F.slice(c, 1, cuts - 1).alias(f"_{c}") for c in ("digests", "words")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cuts).cast("int")
    met = paths.withColumn("_h", h).join(heads, donor == F.col("_donor"), "left")

    def joined(c, kind):
        head = F.slice(F.coalesce(F.col(f"_{c}"), F.array().cast(kind)), F.lit(1), F.col("_h"))
        return F.concat(head, F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))).alias(c)

    return met.select("conv_id", joined("digests", "array<binary>"), joined("words", "array<bigint>"))


class DoubleArray:
    """A trie over dense turn ids in two arrays.

    The child of cell ``s`` by turn ``t`` is cell ``base[s] + t`` if ``check`` names ``s``
    there. The root is cell 0; free cells have check -1.
    """

    def __init__(self, parent: np.ndarray, turn: np.ndarray):
        """Packs nodes 1, 2, ... given by their parents' numbers (never falling) and turns; node 0 is the root."""
        nodes = len(parent) + 1
        cell = np.zeros(nodes, np.int64)
        base = np.zeros(nodes, np.int64)
        first = np.searchsorted(parent, np.arange(nodes + 1))
        kids = np.diff(first)
        used = np.zeros(2 * nodes + (int(turn.max()) if len(turn) else 0) + 2, bool)
        used[0] = True
        free, end = 1, 1
        # those with most children first; they are the hardest to place
        several = np.flatnonzero(kids > 1)
        for v in several[np.argsort(-kids[several], kind="stable")]:
            edges = turn[first[v] : first[v + 1]]
            while used[free]:
                free += 1
            spots = free + np.flatnonzero(~used[free : free + 8 * TRIES])[:TRIES] - edges[0]
            b = next((s for s in spots if not used[s + edges].any()), end - edges[0])
            if b + edges[-1] >= len(used):
                used = np.concatenate([used, np.zeros(int(b + edges[-1]) + len(used), bool)])
            used[b + edges] = True
            base[v], cell[first[v] + 1 : first[v + 1] + 1] = b, b + edges
            end = max(end, int(b + edges[-1]) + 1)
        # an only child fits any free cell
        single = np.flatnonzero(kids == 1)
        if len(single):
            spots = np.flatnonzero(~used)[: len(single)]
            spots = np.concatenate([spots, len(used) + np.arange(len(single) - len(spots))])
            base[single], cell[first[single] + 1] = spots - turn[first[single]], spots
        size = int(cell.max()) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[cell] = base
        self.check[cell[1:]] = cell[parent]

    def step(self, state: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Cells that ``turn`` leads to from ``state``; -1 where the trie has none."""
        at = self.base[state] + turn
        inside = (at >= 1) & (at < len(self.check))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.check[at] == state), at, -1)


def sorted_nodes(offsets: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, turn) of the nodes 1, 2, ... of sorted paths, level by level."""
    lengths = np.diff(offsets)
    state = np.zeros(len(lengths), np.int64)
    parents, edges, total = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1
    rows = np.flatnonzero(lengths > 0)
    level = 0
    while len(rows):
        t = turns[offsets[rows] + level]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (state[rows[1:]] != state[rows[:-1]]) | (t[1:] != t[:-1])
        parents.append(state[rows[fresh]])
        edges.append(t[fresh])
        state[rows] = total + np.cumsum(fresh) - 1
        total += int(fresh.sum())
        level += 1
        rows = rows[lengths[rows] > level]
    return np.concatenate(parents), np.concatenate(edges)


def shard_nodes(conv: np.ndarray, offsets: np.ndarray, digests: np.ndarray, words: np.ndarray, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: paths in sorted order, equal ones by conversation.

    Only a prefix of the first or of the last path can also stand in another shard: these
    nodes are the spine. Their rows carry what this shard adds; its other nodes are final.
    Counts below a spine node leave out the spine itself, which is added after the merge.
    """
    turns = np.unique(digests, return_inverse=True)[1].astype(np.int64)  # dense ids in the order of the digests
    trie = DoubleArray(*sorted_nodes(offsets, turns))
    size, lengths = len(trie.check), np.diff(offsets)
    n, low, told, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    state, rows, spine, ways = np.zeros(len(conv), np.int64), np.arange(len(conv)), np.zeros(size, bool), ([], [])
    n[0], low[0], depth[0], level, levels = len(conv), conv.min(), 0, 0, []
    while len(rows):
        for way, row in zip(ways, (0, len(conv) - 1), strict=True):
            if lengths[row] >= level:
                spine[state[row]] = True
                way.append(int(state[row]))
        rows = rows[lengths[rows] > level]
        at = offsets[rows] + level
        state[rows] = trie.step(state[rows], turns[at])
        cells = state[rows]
        np.add.at(n, cells, 1)
        np.minimum.at(low, cells, conv[rows])
        told[cells], depth[cells] = words[at], level + 1
        level += 1
        levels.append(np.unique(cells))
    own = np.where(spine, 0, (n - 1) * told)
    kids, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), own.copy()
    for cells in reversed(levels):
        leaves[cells] += (kids[cells] == 0) & ~spine[cells]
        up = trie.check[cells]
        np.add.at(kids, up, ~spine[cells])
        np.add.at(leaves, up, leaves[cells])
        np.add.at(saved, up, saved[cells])
    ends: dict[int, str] = {}
    cuts = np.flatnonzero(np.diff(state)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(state)], strict=True):
        ends[int(state[a])] = ",".join(map(str, conv[a:b].tolist()))
    keys: dict[int, bytes] = {}
    chains: dict[int, list[bytes]] = {}
    for way, row in zip(ways, (0, len(conv) - 1), strict=True):
        digest, chain = hashlib.sha256(), []
        for k, cell in enumerate(way):
            if k:
                digest.update(digests[offsets[row] + k - 1].ljust(16, b"\0"))
            keys[cell] = digest.digest()[:16]
            chain = [*chain, keys[cell]]
            chains[cell] = chain
    cells = np.flatnonzero(depth >= 0)
    for start in range(0, len(cells), 1 << 15):
        c = cells[start : start + (1 << 15)]
        up = trie.check[c]
        held, under = spine[c], (up >= 0) & spine[up]
        listed = c.tolist()
        values = {
            "shard": np.full(len(c), shard), "spine": held, "key": [keys.get(x) for x in listed],
            "parent_key": [keys[u] if s else None for u, s in zip(up.tolist(), under, strict=True)],
            "chain": [chains.get(x) for x in listed], "depth": depth[c], "conv_id": low[c],
            "parent_conv_id": pa.array(low[up], pa.int64(), mask=under | (up < 0)), "n_convs": n[c], "n_children": kids[c],
            "n_leaves": leaves[c], "saved_tokens": saved[c], "words": told[c],
            "ends": [ends.get(x) if s else hashlib.sha256(ends[x].encode()).hexdigest() if x in ends else EMPTY_SHA for x, s in zip(listed, held, strict=True)],
        }
        yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in values.items()], schema=schema)


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of all paths ``(conv_id, digests, words)``; each conversation has one path, which may be empty.

    1. Paths are range-partitioned by (path, conversation), so shards are even whatever
       many conversations share, and each shard is a stretch of the sorted paths.
    2. A shard packs BASE and CHECK over its dense turn ids, walks all its paths through
       them, and sums up its nodes from the leaves.
    3. Only the prefixes of a shard's first and last path can reach into other shards.
       These few nodes are merged by the digest of their prefix; the counts of merged
       nodes then go to their ancestors, which are merged nodes too.

    Returns per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null
    for the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of the
    subtree, and ``ends_sha256`` of the members that end here. No paths give no nodes.
    """
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    turns = paths.agg(F.sum(F.size("digests") + 1)).first()[0] or 0
    part = StructType.fromDDL(PART)
    schema = to_arrow_schema(part)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            conv = table.column("conv_id").to_numpy()
            lists = table.column("digests").combine_chunks()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            digests = np.frombuffer(b"".join(lists.flatten().to_pylist()), "S16")
            words = table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            yield from shard_nodes(conv, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), digests, words, TaskContext.get().partitionId(), schema)

    dealt = paths.repartitionByRange(shards, "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    parts = stored(dealt.mapInArrow(run, part), "nodes")
    upper = _merged(parts.filter("spine"))
    above = small_side(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above")))
    lower = parts.filter("not spine").join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    upper = upper.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("_above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return upper.select(columns).unionByName(lower.withColumnRenamed("ends", "ends_sha256").select(columns))


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes that several shards may share, whole."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("parent_key", "chain", "depth", "words")]
    nodes = stored(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *same), "upper")
    children = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_kids"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    own = nodes.select(F.explode("chain").alias("key"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    below = own.groupBy("key").agg(F.sum("leaf").alias("_leaves"), F.sum("own").alias("_saved"))
    parts_of = parts.filter("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    told = parts_of.mapInArrow(_ends, "key binary, ends_sha256 string")
    whole = nodes.join(below, "key").join(told, "key", "left")
    return stored(whole.select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    ), "upper")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key of its shards' lists, in order, list by list."""
    key, digest = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key"), batch.column("ends"), strict=True):
            if k.as_py() != key:
                if digest is not None:
                    yield told()
                key, digest = k.as_py(), hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
    if digest is not None:
        yield told()
