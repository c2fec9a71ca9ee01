"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.blas import one_thread
from quire.llm.components import components
from quire.llm.memory import lean
from quire.llm.store import prepare, written

#: Values of a document's signature; the tokens that paths are chosen from.
SIGNATURE = 64
#: Tokens that two sets at the threshold are expected to choose together at each level.
BRANCHING = 2.0
#: Buckets of a path above this size are split by further tokens.
BUCKET = 64
#: Equal signature values from which a member of a large bucket is a near copy of another one, its leader.
TIGHT = 58
#: Similarity that leaders of linked members have at least: the threshold less what each may be apart from its leader.
SLACK = 0.2
#: Mean similarity of a bucket's leaders from which further tokens hardly part them; they are compared in tiles.
DENSE = 0.3
#: Rows of a salted part of a large bucket, and of one side of a tile of leaders.
PART = 512
#: Leaders of a bucket that one task splits further by itself; more take further exchanges.
LOCAL = 8192
#: Members of a candidate group that one task compares at a time.
TILE = 256

_ODD = W.mix(np.arange(1, SIGNATURE + 1, dtype=W.U64)) | W.U64(1)
_ADD = W.mix(np.arange(1001, SIGNATURE + 1001, dtype=W.U64))


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has shared a full path with this probability.

    In one run a pair shares a path of k levels with p(k) = 1 - exp(-BRANCHING p(k - 1)), p(0) = 1;
    whatever the number of levels it is above their limit, which is taken here.
    """
    p = 1.0
    for _ in range(100):
        p = 1 - math.exp(-BRANCHING * p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word windows of each text.

    A text of fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    words = W.Words(*W.text_buffer(column))
    hashes = words.hashes()
    windows = W.window_hashes(hashes, width)
    sets = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(windows[a : b - width + 1]))
        else:
            sets.append(W.window_hashes(hashes[a:b], b - a) ^ W.U64(b - a) if b > a else windows[:0])
    return sets


def _signature(s: np.ndarray) -> bytes:
    """Minimum hashes of a set, 32 bits each."""
    out = np.full(SIGNATURE, 0xFFFFFFFF, W.U64)
    for i in range(0, len(s), 4096):
        values = (s[i : i + 4096, None] * _ODD + _ADD) >> W.U64(32)
        out = np.minimum(out, values.min(0))
    return out.astype(np.uint32).tobytes()


SETS = "id long, node long, size int, signature binary"


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                ids, nodes, sizes, signatures = part.column("id"), [], [], []
                for s in shingle_sets(part.column("text"), width):
                    nodes.append(_node(s) if len(s) else None)
                    sizes.append(len(s))
                    signatures.append(_signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], ["id", "node", "size", "signature"])

    return run


def _node(s: np.ndarray) -> int:
    """Key of a class of equal sets."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


PATHS = "path long, node long, used long"


def _chosen(signatures: np.ndarray, paths: np.ndarray, used: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, path, used) of the children: a path goes on with every unused token that its hash picks.

    Picks depend on path and token alone, so two sets choose a shared token together.
    """
    index = np.arange(SIGNATURE, dtype=W.U64)
    tokens = W.mix(signatures.astype(W.U64) << W.U64(8) | index)
    child = W.mix(tokens ^ paths.view(W.U64)[:, None])
    free = (used.view(W.U64)[:, None] >> index & W.U64(1)) == 0
    limit = W.U64(int(min(1.0, BRANCHING / (threshold * SIGNATURE)) * (2**64 - 1)))
    row, token = np.nonzero((W.mix(child) < limit) & free)
    return row, child[row, token].view(np.int64), (used.view(W.U64)[row] | W.U64(1) << token.astype(W.U64)).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _path_batch(rows: pa.RecordBatch, row: np.ndarray, path: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    nodes = rows.column("node").to_numpy(zero_copy_only=False)[row]
    return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(nodes, pa.int64()), pa.array(used, pa.int64())], ["path", "node", "used"])


def _roots(runs: int, threshold: float):
    """First level: every run starts from a path of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                signatures = _matrix(part.column("signature"))
                none = np.zeros(len(signatures), np.int64)
                for r in range(runs):
                    start = np.full(len(signatures), int(W.mix(np.array([r + 77], W.U64))[0] >> W.U64(1)), np.int64)
                    yield _path_batch(part, *_chosen(signatures, start, none, threshold))

    return run


def _children(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                paths, used = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("path", "used"))
                yield _path_batch(part, *_chosen(_matrix(part.column("signature")), paths, used, threshold))

    return run


EDGES = "a long, b long"


def _agree(threshold: float) -> int:
    """Equal signature values that a pair at the threshold has but for a chance of some 1 in 5,000."""
    return int(SIGNATURE * threshold - 3.5 * math.sqrt(SIGNATURE * threshold * (1 - threshold)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, signatures) of each path in rows sorted by path."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
        paths = table.column("path").to_numpy()
        edges = np.flatnonzero(paths[1:] != paths[:-1]) + 1
        last = int(edges[-1]) if len(edges) else 0
        if last:
            signatures = _matrix(table.slice(0, last).column("signature"))
            for a, b in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True):
                yield table.slice(a, b - a), signatures[a:b]
        left = table.slice(last)
    if left is not None and left.num_rows:
        yield left, _matrix(left.column("signature"))


def _stars(nodes: np.ndarray, signatures: np.ndarray, agree: int, a: list, b: list) -> None:
    """Compares every pair of signatures, and links what is connected to its smallest node."""
    root = np.arange(len(nodes))
    for i in range(len(nodes) - 1):
        same = np.flatnonzero((signatures[i + 1 :] == signatures[i]).sum(1) >= agree) + i + 1
        if len(same) and (root[same] != root[i]).any():
            joined = np.unique(root[np.append(same, i)])
            root[np.isin(root, joined)] = joined[0]
    for r in np.flatnonzero(np.bincount(root) > 1):
        group = nodes[root == r]
        least = int(group.min())
        a += [least] * (len(group) - 1)
        b += group[group != least].tolist()


def _brute_force(agree: int):
    """Links of small buckets and of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows, signatures in _groups(batches):
            _stars(rows.column("node").to_numpy(), signatures, agree, a, b)
            if len(a) > 50_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _split(agree: int, threshold: float):
    """Links of the leaders of large buckets: split by further tokens until what is left is small or dense, level by level in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows, signatures in _groups(batches):
            nodes = rows.column("node").to_numpy()
            at, path, used = np.arange(len(nodes)), rows.column("path").to_numpy(), rows.column("used").to_numpy()
            while len(at):
                order = np.argsort(path, kind="stable")
                at, path, used = at[order], path[order], used[order]
                edges = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
                on = np.zeros(len(at), bool)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if hi - lo > BUCKET and _close(signatures[at[lo:hi]]) < DENSE:
                        on[lo:hi] = True
                    elif hi - lo > 1:
                        _stars(nodes[at[lo:hi]], signatures[at[lo:hi]], agree, a, b)
                row, path, used = _chosen(signatures[at[on]], path[on], used[on], threshold)
                at = at[on][row]
            if len(a) > 50_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return run


def _close(signatures: np.ndarray) -> float:
    """Mean share of equal values of two different rows, from how often each value stands in its column."""
    n = len(signatures)
    same = sum(int((np.unique(column, return_counts=True)[1].astype(np.int64) ** 2).sum()) - n for column in signatures.T)
    return same / (SIGNATURE * n * (n - 1))


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


LEADERS = "a long, b long, path long, used long, close double, signature binary"


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large buckets, one salted part after another: members join the first leader they are a near copy of.

    Rows of joined members are links to their leaders; rows of leaders say how close they are to the
    leaders of their part before them.
    """
    now, leaders, names = None, np.zeros((PART * 2, SIGNATURE), np.uint32), []
    for batch in batches:
        paths, salts, nodes, used = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "salt", "node", "used"))
        signatures = _matrix(batch.column("signature"))
        rows = []
        for i in range(len(nodes)):
            if (paths[i], salts[i]) != now:
                now, names = (paths[i], salts[i]), []
            near = (leaders[: len(names)] == signatures[i]).sum(1)
            if names and near.max() >= TIGHT:
                rows.append((names[int(near.argmax())], int(nodes[i]), None, None, None, None))
                continue
            if len(names) == len(leaders):
                leaders = np.concatenate([leaders, np.zeros_like(leaders)])
            leaders[len(names)] = signatures[i]
            rows.append((int(nodes[i]), None, int(paths[i]), int(used[i]), float(near.mean()) / SIGNATURE if names else None, signatures[i].tobytes()))
            names.append(int(nodes[i]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in LEADERS.split(", ")])


def _tile_pairs(rows: DataFrame, size: int) -> DataFrame:
    """(path, node, signature) of every pair of parts of a bucket, the pair as path; ``rows`` has (path, members, node, signature)."""
    parts = F.ceil(F.col("members") / size).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "node", "signature")


def _compared(rows: DataFrame, agree: int) -> DataFrame:
    """Links of the members of each path, by brute force on their signatures."""
    return rows.repartition("path").sortWithinPartitions("path", "node").mapInArrow(_brute_force(agree), EDGES)


def candidate_edges(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(a, b): links between nodes that may reach the threshold, from chosen paths.

    ``nodes`` has (node, signature). Each run splits the nodes by the tokens that their path picks
    from their signatures; buckets of two to ``BUCKET`` are compared by brute force on signatures.
    In a larger bucket near copies are linked to a leader first, in salted parts, as no token would
    part them; its leaders are split by further tokens for as long as there are more than ``BUCKET``
    in a bucket, but for those so close to each other that tokens hardly part them, which are compared
    with each other. Up to ``LOCAL`` leaders are split in one task, more by further exchanges, and
    dense ones in tiles. Linked members are near their leaders, so that leaders are compared, and
    choose tokens, at a similarity lower by ``SLACK``. Runs repeat until a pair at the threshold is
    found with probability ``recall``.
    """
    signatures = nodes.select("node", "signature")
    loose = threshold - SLACK
    rows = signatures.mapInArrow(_roots(runs_for(recall), threshold), PATHS)
    edges, agree, level = [], _agree(threshold), 0
    while True:
        level += 1
        rows = written(rows, f"paths{level}")
        sizes = rows.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        shared = written(rows.join(sizes, "path").join(signatures, "node"), f"buckets{level}")
        edges.append(_compared(shared.where(F.col("members") <= BUCKET).select("path", "node", "signature"), agree))
        large = shared.where(F.col("members") > BUCKET)
        if not large.limit(1).count():
            break
        salted = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / PART))).select("path", "salt", "node", "used", "signature")
        lead = written(salted.repartition("path", "salt").sortWithinPartitions("path", "salt", "node").mapInArrow(_lead, LEADERS), f"leaders{level}")
        edges.append(lead.where("b is not null").select("a", "b"))
        heads = lead.where("b is null").select("path", F.col("a").alias("node"), "used", "signature", "close")
        about = heads.groupBy("path").agg(F.count("*").alias("members"), F.avg("close").alias("close")).where("members > 1")
        heads = heads.drop("close").join(about, "path")
        agree = _agree(loose)
        some = heads.where(F.col("members") <= LOCAL).select("path", "node", "used", "signature")
        edges.append(some.repartition("path").sortWithinPartitions("path", "node").mapInArrow(_split(agree, loose), EDGES))
        if not about.where(F.col("members") > LOCAL).limit(1).count():
            break
        many, dense = F.col("members") > LOCAL, F.coalesce(F.col("close"), F.lit(0.0)) >= DENSE
        edges.append(_compared(_tile_pairs(heads.where(many & dense), PART), agree))
        rows = heads.where(many & ~dense).select("path", "node", "used", "signature").mapInArrow(_children(loose), PATHS)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return written(out.distinct(), "edges")


VERIFIED = "node long, links long, root long"


def _links(nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact similarities of left members against right ones: boolean matrix of the links."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1]) if len(column) else np.zeros(0, np.int64)
    dense = np.zeros(len(column), np.int64)
    dense[edges] = 1
    dense = np.cumsum(dense) - 1
    shared = np.zeros((len(left), len(right)), np.float32)
    n_columns = int(dense[-1]) + 1 if len(dense) else 0
    for c in range(0, n_columns, 4096):
        lo, hi = np.searchsorted(dense, [c, c + 4096])
        block = np.zeros((len(sets), min(4096, n_columns - c)), np.float32)
        block[owner[lo:hi], dense[lo:hi] - c] = 1
        shared += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    return shared >= threshold * union - 1e-6 * union


def _verify(threshold: float):
    """Exact comparison of the members of a tile, or of each of several small groups."""

    def verify(table):
        one_thread()
        group = table.column("component").to_numpy()
        order = np.argsort(group, kind="stable")
        table, group = table.take(pa.array(order)), group[order]
        edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        out = [[], [], []]
        nodes_all, copies_all, side_all = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
        blobs = table.column("set").to_pylist()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            nodes, copies, side = nodes_all[a:b], copies_all[a:b], side_all[a:b]
            sets = [np.frombuffer(x, W.U64) for x in blobs[a:b]]
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            link = _links(nodes, copies, sets, left, right, threshold)
            link &= nodes[left][:, None] != nodes[right][None, :]
            count = np.zeros(b - a, np.int64)
            count[left] += link @ copies[right]
            root = nodes.copy()
            if (side == 0).all():
                again = True
                while again:  # smallest member that each one is connected with inside the tile
                    near = np.where(link, root[right][None, :], np.iinfo(np.int64).max).min(1)
                    again = bool((near < root).any())
                    root = np.minimum(root, near)
                out[0] += nodes.tolist()
                out[1] += count.tolist()
                out[2] += root.tolist()
            else:
                count[right] += link.T @ copies[left]
                for i, j in zip(*np.nonzero(_forest(link)), strict=True):
                    out[0].append(int(nodes[left[i]]))
                    out[1].append(0)
                    out[2].append(int(nodes[right[j]]))
                out[0] += nodes.tolist()
                out[1] += count.tolist()
                out[2] += nodes.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "root"])

    return verify


def _forest(link: np.ndarray) -> np.ndarray:
    """Enough links of a two-sided tile to keep its connections: a spanning forest."""
    keep = np.zeros_like(link)
    seen_left, seen_right = np.zeros(link.shape[0], bool), np.zeros(link.shape[1], bool)
    for start in np.flatnonzero(link.any(1)):
        if seen_left[start]:
            continue
        queue, seen_left[start] = [int(start)], True
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(link[i] & ~seen_right):
                seen_right[j] = keep[i, j] = True
                for k in np.flatnonzero(link[:, j] & ~seen_left):
                    seen_left[k] = keep[k, j] = True
                    queue.append(int(k))
    return keep


def _to_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                own = [len(s) > 0 and _node(s) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)]  # ids may repeat
                columns = [*[part.column(c) for c in ("node", "component", "copies", "members")], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "component", "copies", "members", "set"]).filter(pa.array(own, pa.bool_()))

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.998) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_copies.

    Sets are the shingles of ``width`` words (maximal runs of non-white-space in the ASCII sense); a
    shorter text is one shingle. Rows with equal sets are copies of one class member, joined once.
    Two texts are linked at a Jaccard similarity of ``threshold``; ``n_links`` counts the other rows
    that a row is linked with, copies included (``n_copies``: rows with its set, itself included), and
    ``class_id`` is the smallest id of the rows connected by links. Candidates come from chosen paths
    at the stated ``recall``; their similarities are exact, and all pairs within a candidate group are
    compared, in tiles, without being emitted; the tiles of a group of n different near copies are
    (n / ``TILE``)^2 / 2, as the number of its links asks for.

    Null and empty texts have no shingles: they form classes of their own with no links. A row with
    a null id is compared like any other; where no row of a class has an id, class_id is null. Rows
    sharing an id count as rows of their own. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(rows.mapInArrow(lean(_sketch(width)), SETS), "sets")
    classes = written(
        sets.where(F.col("size") > 0).groupBy("node").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("signature").alias("signature")),
        "classes",
    )
    groups = components(candidate_edges(classes, threshold, recall))
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    members = groups.join(sizes, "component").join(classes.select("node", "first_id", "copies"), "node")
    # one row per member gives its text; without an id it is found by its set
    texts = rows.join(members.where("first_id is not null").withColumnRenamed("first_id", "id"), "id")
    if sets.where("id is null").limit(1).count():
        unnamed = members.where("first_id is null").drop("first_id")
        blank = rows.where("id is null").withColumn("node", F.lit(None).cast("long"))
        texts = texts.unionByName(_with_nodes(blank, width).join(unnamed, "node").withColumn("id", F.lit(None).cast("long")).select(texts.columns))
    exact = texts.select("text", "node", "component", "copies", "members").mapInArrow(lean(_to_sets(width)), "node long, component long, copies long, members long, set binary")
    exact = exact.dropDuplicates(["node"]) if sets.groupBy("id").count().where("count > 1").limit(1).count() else exact
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    dealt = exact.withColumn("tiles", tiles).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "node", "component", "copies", "set",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        F.when(F.col("members") > TILE // 4, F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")))
        .otherwise(F.pmod(F.xxhash64("component"), F.lit(max(64, classes.count() // 2000)))).alias("tile"),
    )
    found = written(dealt.groupBy("tile").applyInArrow(_verify(threshold), VERIFIED), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.join(roots, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = named.join(least, "component").select("node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = sets.select("id", "node").join(named, "node", "left")
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def _with_nodes(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                nodes = [_node(s) if len(s) else None for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("text"), pa.array(nodes, pa.int64())], ["text", "node"])

    return rows.select("text").mapInArrow(lean(run), "text string, node long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class left: the one whose id is the class id; see ``jaccard_join``.

    Rows without an id stay. Of rows that share the class id, all stay.
    """
    classes = jaccard_join(docs, id_col, **options).where(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    return docs.join(classes, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
