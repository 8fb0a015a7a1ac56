"""Merkle roots, proofs and hash chains over whole tables.

Leaves are ranked within their snapshot by a range partitioning and per-partition offsets, never by one task per
snapshot. The tree is folded in aligned chunks of ``2**CHUNK`` leaves; because an odd last node is promoted unchanged,
roots of aligned chunks are the nodes of the whole tree at that level, so a few rounds do for any size.

For roots, leaves are folded where they are: a task turns each run of neighbours into the roots of the largest aligned
subtrees in it, so that only those, some dozens a run and one a chunk, are shuffled. Proofs need a chunk's leaves together and
shuffle them once, as 32 bytes each. Leaves are text only where a result shows them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.records import sha256
from ..sources.shared import is_few, join_few, written

CHUNK = 12
EMPTY_ROOT = hashlib.sha256(b"sediment/empty").hexdigest()
GENESIS = hashlib.sha256(b"sediment/genesis/v1").hexdigest()
PROOF = "array<struct<side:string,hash:string>>"


def leaf_hash(uid: Column, content_hash: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.to_json(F.array(uid, content_hash)).cast("binary")), 256)


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def pair_hash(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(a), F.unhex(b)), 256)


def levels(nodes: list[bytes]) -> list[list[bytes]]:
    """The nodes of every level from the given one up to the root."""
    out = [nodes]
    while len(nodes) > 1:
        up = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() for i in range(0, len(nodes) - 1, 2)]
        nodes = up + nodes[len(up) * 2 :]
        out.append(nodes)
    return out


def ranked(observations: DataFrame, group: str = "snapshot_id", leaves: dict[str, str] | None = None, keep_uid: bool = True, digests: bool = False) -> DataFrame:
    """``group``, ``pos`` (0 for the least ``row_uid``), ``row_uid`` if it is kept, and leaves as bytes.

    ``leaves`` has the columns of hashes to commit to by the names of their leaves; all are ranked in one go.
    With ``digests``, hashes are known to be of 64 digits: they go as bytes, which compress where a hash stands in many
    rows, and become leaves where they are read.
    """
    leaves = leaves or {"leaf": "content_hash"}
    leaf = lambda h: F.unhex(leaf_hash(F.col("row_uid"), h))
    named = {name: (F.unhex(c) if digests else leaf(F.col(c))).alias(name) for name, c in leaves.items()}
    keep_written = keep_uid or digests
    ordered = observations.select(group, "row_uid", *named.values()).repartitionByRange(group, "row_uid").sortWithinPartitions(group, "row_uid")
    # written, so that the partitions are the same for the offsets and for the rows
    fixed = written(ordered.select(group, *(["row_uid"] if keep_written else []), *named, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "leaves")
    counts = fixed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select(group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")), "offsets")
    # a group and a part have one offset, and all rows of a part stand together: few rows to broadcast
    placed = fixed.join(F.broadcast(offsets) if is_few(offsets) else offsets, [group, "part"])
    done = [leaf(as_text(F.col(c))).alias(c) if digests else F.col(c) for c in named]
    return placed.select(group, (F.col("at") + F.col("shift")).alias("pos"), *(["row_uid"] if keep_uid else []), *done)


def ranked_leaves(observations: DataFrame, group: str = "snapshot_id") -> DataFrame:
    """``group``, ``pos`` (0 for the least ``row_uid``), ``row_uid`` and ``leaf``."""
    return ranked(observations, group).withColumn("leaf", as_text(F.col("leaf")))


def _bytes(leaves: DataFrame, columns: Sequence[str] = ("leaf",)) -> DataFrame:
    """Leaves as bytes, whichever form they have."""
    return leaves.withColumns({c: F.unhex(c) for c in columns if leaves.schema[c].dataType.simpleString() == "string"})


def subtrees(first: int, nodes: list[bytes], chunk: int) -> list[tuple[int, int, bytes]]:
    """Level, position and root of the largest aligned subtrees of up to ``2**chunk`` leaves in a run that begins at ``first``."""
    out, level = [], 0
    while nodes:
        if level == chunk:
            return out + [(level, first + k, x) for k, x in enumerate(nodes)]
        if first % 2:
            out.append((level, first, nodes[0]))
            first, nodes = first + 1, nodes[1:]
        if len(nodes) % 2:
            out.append((level, first + len(nodes) - 1, nodes[-1]))
            nodes = nodes[:-1]
        nodes = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() for i in range(0, len(nodes), 2)]
        first, level = first // 2, level + 1
    return out


def joined(parts: list[tuple[int, int, bytes]], chunk: int) -> bytes:
    """The root of a chunk that ``parts`` cover without a gap from its beginning; an odd last node is promoted."""
    by: dict[int, dict[int, bytes]] = {}
    for level, pos, node in parts:
        by.setdefault(level, {})[pos] = node
    row: dict[int, bytes] = {}
    for level in range(chunk):
        row |= by.get(level, {})
        up = {}
        for pos in sorted(row):
            if pos % 2 == 0:
                up[pos // 2] = hashlib.sha256(b"\x01" + row[pos] + row[pos + 1]).digest() if pos + 1 in row else row[pos]
        row = up
    (root,) = (row | by.get(chunk, {})).values()
    return root


def _fold_runs(group: str, columns: Sequence[str], chunk: int):
    def fold(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of other groups or parts of the file may be in the batch too
            keys, at = batch.column(group), batch.column("pos").to_numpy()
            named = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 1) | (np.diff(named) != 0)) + 1).tolist(), batch.num_rows]
            where, out = [], [[] for _ in range(2 + len(columns))]
            for a, b in itertools.pairwise(cuts):
                runs = [subtrees(int(at[a]), batch.column(c).slice(a, b - a).to_pylist(), chunk) for c in columns]
                where += [a] * len(runs[0])
                out[0] += [x[0] for x in runs[0]]
                out[1] += [x[1] for x in runs[0]]
                for k, run in enumerate(runs):
                    out[2 + k] += [x[2] for x in run]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(where)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *[pa.array(x, pa.binary()) for x in out[2:]]], [group, "level", "pos", *columns])

    return fold


def _fold(group: str, columns: Sequence[str], chunk: int):
    def fold(table: pa.Table) -> pa.Table:
        level, pos = table.column("level").to_pylist(), table.column("pos").to_pylist()
        roots = [joined(list(zip(level, pos, table.column(c).to_pylist(), strict=True)), chunk) for c in columns]
        at = pos[0] >> (chunk - level[0])
        return pa.table({group: table.column(group).slice(0, 1), "pos": pa.array([at], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(columns, roots, strict=True)}})

    return fold


def merkle_roots(leaves: DataFrame, group: str = "snapshot_id", chunk: int = CHUNK, columns: Sequence[str] = ("leaf",)) -> DataFrame:
    """``group`` and ``merkle_root`` of ranked leaves; with more than one column of leaves, each one's root by its name."""
    kind = leaves.schema[group].dataType.simpleString()
    cols = "".join(f", {c} binary" for c in columns)
    size = leaves.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    nodes = _bytes(leaves, columns).select(group, "pos", *columns)
    while True:
        parts = nodes.mapInArrow(_fold_runs(group, columns, chunk), f"{group} {kind}, level int, pos long{cols}")
        # the chunk's number, whatever the part's level is
        number = F.call_function("shiftright", F.col("pos"), F.lit(chunk) - F.col("level")).alias("chunk")
        nodes = parts.groupBy(group, number).applyInArrow(_fold(group, columns, chunk), f"{group} {kind}, pos long{cols}")
        size = -(-size >> chunk)
        if size <= 1:
            return nodes.select(group, *[as_text(F.col(c)).alias("merkle_root" if len(columns) == 1 else c) for c in columns])


def _paths(group: str, chunk: int):
    def fold(key, table: pa.Table, wanted: pa.Table) -> pa.Table:
        leaves = table.sort_by("pos").column("leaf").to_pylist()
        tree, first = levels(leaves), key[1].as_py() << chunk
        pos, leaf, own, paths = ([first >> chunk], [tree[-1][0]], [None], [None]) if leaves else ([], [], [], [])
        for at in wanted.column("asked").to_pylist():
            if not 0 <= (k := at - first) < len(leaves):
                continue
            pos.append(at)
            leaf.append(None)
            own.append(leaves[k])
            paths.append([{"side": "right" if i % 2 == 0 else "left", "hash": nodes[i ^ 1].hex()} for n, nodes in enumerate(tree) if (i := k >> n) ^ 1 < len(nodes)])
        kind = pa.list_(pa.struct([("side", pa.string()), ("hash", pa.string())]))
        return pa.table({group: pa.array([key[0].as_py()] * len(pos), key[0].type), "pos": pa.array(pos, pa.int64()), "leaf": pa.array(leaf, pa.binary()), "own": pa.array(own, pa.binary()), "path": pa.array(paths, kind)})

    return fold


def merkle_proofs(leaves: DataFrame, wanted: DataFrame, group: str = "snapshot_id", chunk: int = CHUNK) -> DataFrame:
    """Sibling paths of ``wanted`` (``group``, ``pos``): ``proof`` from the leaf up, and the ``merkle_root`` it leads to.

    The tree is folded chunk by chunk, and a chunk with wanted nodes gives their paths through it; a promoted node has no
    sibling. Leaves of a chunk meet what is wanted of it in one shuffle.
    """
    kind = leaves.schema[group].dataType.simpleString()
    by = lambda df, key, at: df.groupBy(key, F.shiftright(at, chunk).alias("chunk"))
    nodes = _bytes(leaves).select(group, "pos", "leaf")
    # names of their own, as both may come from the same leaves
    asked = wanted.select(F.col(group).alias("of"), F.col("pos").cast("long").alias("asked")).distinct()
    size = leaves.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] + 1
    paths = None
    while paths is None or size > 1:
        folded = written(by(nodes, group, "pos").cogroup(by(asked, "of", "asked")).applyInArrow(_paths(group, chunk), f"{group} {kind}, pos long, leaf binary, own binary, path {PROOF}"), "folded")
        step = folded.where("path IS NOT NULL").select(group, F.col("pos").alias("at"), "own", "path")
        if paths is None:
            paths = step.select(group, F.col("at").alias("leaf_index"), as_text(F.col("own")).alias("leaf"), "at", F.col("path").alias("proof"))
        else:
            paths = paths.join(step.drop("own"), [group, "at"]).select(group, "leaf_index", "leaf", "at", F.concat("proof", "path").alias("proof"))
        paths = paths.withColumn("at", F.shiftright("at", chunk))
        nodes = folded.where("path IS NULL").select(group, "pos", "leaf")
        asked = paths.select(F.col(group).alias("of"), F.col("at").alias("asked")).distinct()
        size = -(-size >> chunk)
    root = nodes.select(group, as_text(F.col("leaf")).alias("merkle_root"))
    return join_few(paths, root, group, "leaf_index").select(group, "leaf_index", "leaf", "proof", "merkle_root")


def proof_leads_to(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether folding the siblings into the leaf gives the root."""
    return F.aggregate(proof, leaf, lambda cur, s: F.when(s["side"] == "right", pair_hash(cur, s["hash"])).otherwise(pair_hash(s["hash"], cur))) == root


def chain_hash(previous: Column, root: Column, meta_json: Column) -> Column:
    """A snapshot's link: the hash of the JSON array of the link before, its root, and its metadata as JSON."""
    return sha256(F.concat(F.lit('["'), previous, F.lit('","'), root, F.lit('",'), meta_json, F.lit("]")))


def _links(batches):
    """Each row's link, batch after batch of rows in the order of their sources and snapshots."""
    source, link, begun = None, None, False
    for batch in batches:
        rows = zip(batch.column("source_key").to_pylist(), batch.column("merkle_root").to_pylist(), batch.column("meta_json").to_pylist())
        links = []
        for key, root, meta in rows:
            if not begun or key != source:
                source, link, begun = key, GENESIS, True
            # as in SQL, what is missing makes all links after it missing
            link = None if link is None or root is None or meta is None else hashlib.sha256(f'["{link}","{root}",{meta}]'.encode()).hexdigest()
            links.append(link)
        yield pa.RecordBatch.from_arrays([batch.column("source_key"), batch.column("snapshot_id"), pa.array(links, pa.string())], ["source_key", "snapshot_id", "chain_hash"])


def build_chain(snapshots: DataFrame) -> DataFrame:
    """``source_key``, ``snapshot_id`` and ``chain_hash`` of rows with ``merkle_root`` and ``meta_json``.

    A link needs the one before, so a source is one task; it takes one step a snapshot and holds one batch at a time.
    """
    kind = snapshots.schema["source_key"].dataType.simpleString()
    rows = snapshots.select("source_key", F.col("snapshot_id").cast("long").alias("snapshot_id"), "merkle_root", "meta_json")
    rows = rows.repartition("source_key").sortWithinPartitions("source_key", "snapshot_id", "merkle_root", "meta_json")
    return rows.mapInArrow(_links, f"source_key {kind}, snapshot_id long, chain_hash string")


def verify_chains(snapshots: DataFrame) -> DataFrame:
    """Per source: links checked, the first broken one, and the head; each link is checked against the stored one before."""
    w = Window.partitionBy("source_key").orderBy("snapshot_id")
    links = snapshots.select("source_key", "snapshot_id", "chain_hash", chain_hash(F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS)), F.col("merkle_root"), F.col("meta_json")).alias("expected"))
    broken = F.min(F.when(~F.col("chain_hash").eqNullSafe(F.col("expected")), F.col("snapshot_id")))
    return links.groupBy("source_key").agg(F.count(F.lit(1)).alias("snapshots"), broken.alias("broken_at"), F.max_by("chain_hash", "snapshot_id").alias("head")).withColumn("ok", F.col("broken_at").isNull())
