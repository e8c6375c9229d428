"""N-gram Jaccard join by signature trees: nodes hold OR-combined token bitmaps and size ranges, and dual traversal prunes pairs of nodes.

Documents meet in a forest of trees, one for each MinHash value that several documents have; a link is missed by all
HASHES values with chance (1 - 0.75) ** 20 < 1e-12, that of a hash collision. Every reported link is verified on whole sets,
in the task that finds it, and only links that join two components leave the task: fewer than it has documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, numbered, stage, table, text_batches

#: Words of a shingle, least similarity in percent, MinHash values, children of a tree node.
SHINGLE, PERCENT, HASHES, FAN = 5, 75, 20, 8
#: Bits of a signature: the power of two that is this many times the shingles at least, so that bounds stay sharp at every size.
BITS_EACH, LEAST_BITS = 4, 256
#: Equal MinHash values with which a document is compared with a group's first one before any tree is built.
LIKELY = 6
#: Documents, and shingles of them, that a part of a group holds at most (twice that, for a pair of parts); pairs of nodes
#: visited, rows of groups taken, bytes of them and shingles compared at a time.
PART, PART_SHINGLES, VISIT, TAKEN, TAKEN_BYTES, COMPARED = 1024, 1 << 20, 1 << 16, 20_000, 64 << 20, 1 << 20
#: Groups of so few documents are compared without a tree.
FEW = 12
#: Broadcast at most so many document ids (8 bytes each), by their count; more are joined by shuffles.
BROADCAST_IDS = 500_000

_ODD = (np.random.default_rng(7).integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
_MIX = np.random.default_rng(8).integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text: A-Z lower-cased, words parted by ASCII white space; fewer words: all as one."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    total = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        total = mixed(total + h[i : len(h) - SHINGLE + 1 + i] * _MIX[i])
    return np.unique(total)


def node_id(found: np.ndarray) -> int:
    """One 64-bit name for a set: equal sets, equal names."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def bits_for(n: int) -> int:
    return max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length() if n else 0)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Signatures of fewer bits: neighbouring bits combined by or, as they stand for the leading bits of a hash."""
    while bits.shape[1] > words:
        on = np.unpackbits(bits.view(np.uint8), axis=1)
        bits = np.packbits(on[:, ::2] | on[:, 1::2], axis=1).view(np.uint64)
    return bits


def _features(batches):
    for batch in batches:
        ids, n, nodes, bits, least = [], [], [], [], []
        for row, text in zip(batch.column("_row"), batch.column("text").cast(pa.binary()).to_pylist()):
            found = shingles(text)
            ids.append(row.as_py())
            n.append(len(found))
            nodes.append(node_id(found) if len(found) else None)
            width = bits_for(len(found))
            on = np.zeros(width, bool)
            on[found >> np.uint64(64 - width.bit_length() + 1)] = True
            bits.append(np.packbits(on).tobytes())
            least.append(((found[:, None] * _ODD) ^ ((found[:, None] * _ODD) >> np.uint64(32))).min(0).astype(np.int64) if len(found) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["_row", "n", "node", "bits", "least"])


def _sets(batches):
    for batch in batches:
        found = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([node_id(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "set"])


def needed(a, b):
    """Least overlap of sets of sizes a and b that link: 100 * overlap >= PERCENT * (a + b - overlap)."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


class Tree:
    """A signature tree over rows sorted by size: level 0 are the rows, each node above covers FAN nodes."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, marked: np.ndarray | None = None):
        """n: sizes of the sets; marked: how many of their shingles the bitmaps stand for, if not all."""
        extra = (n if marked is None else marked) - np.bitwise_count(bits).sum(1).astype(np.int64)  # shingles that share a bit with another
        self.levels = [(bits, n, n, extra)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))

    def size(self, level: int) -> int:
        return len(self.levels[level][1])


def possible(a: Tree, x: np.ndarray, b: Tree, y: np.ndarray, level: int) -> np.ndarray:
    """Whether some rows under nodes x of a and y of b may link, by size ranges and the most that their bitmaps can overlap."""
    bits_a, low_a, high_a, extra_a = a.levels[level]
    bits_b, low_b, high_b, extra_b = b.levels[level]
    ok = (100 * high_a[x] >= PERCENT * low_b[y]) & (100 * high_b[y] >= PERCENT * low_a[x])
    at = np.nonzero(ok)[0]
    both = np.bitwise_count(bits_a[x[at]] & bits_b[y[at]]).sum(1).astype(np.int64) + np.minimum(extra_a[x[at]], extra_b[y[at]])
    ok[at] = both >= needed(low_a[x[at]], low_b[y[at]])
    return ok


def traverse(a: Tree, b: Tree, same: bool):
    """Pairs of rows that may link, in pieces (x, y): both trees are descended together from their roots; same: one tree, x < y."""
    top = max(len(a.levels), len(b.levels)) - 1
    for tree in (a, b):
        while len(tree.levels) <= top:
            tree.levels.append(tree.levels[-1])
    heap = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while heap:
        level, x, y = heap.pop()
        if len(x) > VISIT:
            half = len(x) // 2
            heap += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
            continue
        ok = possible(a, x, b, y, level)
        if level == 0 and same:
            ok &= x < y
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if level == 0:
            yield x, y
            continue

        def below(tree, nodes):
            if tree.size(level - 1) == tree.size(level):
                return nodes[:, None]
            return nodes[:, None] * FAN + np.arange(FAN)

        cx, cy = below(a, x), below(b, y)
        cx, cy = np.broadcast_arrays(cx[:, :, None], cy[:, None, :])
        cx, cy = cx.ravel(), cy.ravel()
        real = (cx < a.size(level - 1)) & (cy < b.size(level - 1))
        if same:
            real &= cx <= cy
        heap.append((level - 1, cx[real], cy[real]))


def _forest(n: np.ndarray, bits: list[bytes], at: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rows `at` by signature width (in 64-bit words): (rows by size, their signatures)."""
    width = np.array([len(bits[i]) // 8 for i in at])
    out = {}
    for w in np.unique(width).tolist():
        rows = at[width == w]
        rows = rows[np.argsort(n[rows], kind="stable")]
        out[w] = rows, np.frombuffer(b"".join([bits[i] for i in rows]), np.uint64).reshape(-1, w)
    return out


def _meetings(n: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray | None):
    """Pairs of rows that may link, within `left` or, if `right` is given, between the two; trees of neighbouring widths meet at the lesser."""
    forests = _forest(n, bits, left), _forest(n, bits, left if right is None else right)
    for w, (rows, own) in forests[0].items():
        for v, (others, theirs) in forests[1].items():
            if (right is None and v < w) or not w / 2 <= v <= 2 * w:
                continue
            same = right is None and v == w
            a = Tree(n[rows], folded(own, min(v, w)))
            b = a if same else Tree(n[others], folded(theirs, min(v, w)))
            for x, y in traverse(a, b, same):
                yield rows[x], others[y]


def _whole_groups(batches):
    """Batches sorted by key, i, j as (table, cuts) of whole groups: group g is the rows cuts[g] to cuts[g + 1]."""
    carried: list[pa.RecordBatch] = []

    def cuts_of(whole: pa.Table) -> list[int]:
        names = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
        return [0, *(np.nonzero((names[1:] != names[:-1]).any(1))[0] + 1).tolist(), len(names)]

    for one in batches:
        carried.append(one)
        if sum(b.num_rows for b in carried) < TAKEN and sum(b.nbytes for b in carried) < TAKEN_BYTES:
            continue
        whole = pa.Table.from_batches(carried)
        cuts = cuts_of(whole)
        if len(cuts) > 2:
            yield whole.slice(0, cuts[-2]), cuts[:-1]
            carried = whole.slice(cuts[-2]).to_batches()
    if carried:
        whole = pa.Table.from_batches(carried)
        if whole.num_rows:
            yield whole, cuts_of(whole)


def _sides(part: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows of the two parts of a group that meet; (all, None) where a part meets itself."""
    return (np.arange(len(part)), None) if i == j else (np.nonzero(part == i)[0], np.nonzero(part == j)[0])


def _few(left: np.ndarray, right: np.ndarray | None):
    if right is None:
        x, y = np.triu_indices(len(left), 1)
        return left[x], left[y]
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _open(batches):
    """Rows (key, i, j, node, n, comp, part, bits, least) by group to those that may link with one of another component.

    A pair counts in the group of the first MinHash value that both have, so most pairs are looked at once.
    """
    for whole, cuts in _whole_groups(batches):
        key, n, comp, part, i, j = (whole.column(c).to_numpy() for c in ("key", "n", "comp", "part", "i", "j"))
        bits, least = whole.column("bits").to_pylist(), whole.column("least").combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
        is_open = np.zeros(len(key), bool)
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                continue
            left, right = _sides(part[lo:hi], i[lo], j[lo])
            right = None if right is None else right + lo
            for x, y in _meetings(n, bits, left + lo, right) if hi - lo > FEW else [_few(left + lo, right)]:
                asked = (comp[x] != comp[y]) & ~(is_open[x] & is_open[y])
                x, y = x[asked], y[asked]
                first = least[x, (least[x] == least[y]).argmax(1)] == key[lo]
                is_open[x[first]] = is_open[y[first]] = True
        yield pa.RecordBatch.from_arrays([whole.column(c).combine_chunks().filter(pa.array(is_open)) for c in ("key", "i", "j", "node", "comp", "part")], names=["key", "i", "j", "node", "comp", "part"])


def _equal(ids: np.ndarray, start: np.ndarray, held: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x and y: set k is the sorted ids[start[k] : start[k] + held[k]]."""

    def laid_out(rows):
        long = held[rows]
        pair = np.repeat(np.arange(len(rows)), long)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(long) - long, long) + np.repeat(start[rows], long)
        return pair, pair * (int(ids.max()) + 1) + ids[at]

    if not len(ids):
        return np.zeros(len(x), np.int64)
    (pair, a), (_, b) = laid_out(x), laid_out(y)
    if not len(a) or not len(b):
        return np.zeros(len(x), np.int64)
    met = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
    return np.bincount(pair[met], minlength=len(x))


def _joining(flat: np.ndarray, n: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Links between rows of a group that join its components, fewer than it has rows: set k is the next n[k] of flat.

    Shingles that only one set holds are left out of the bitmaps, whose places are numbers of the others within the group;
    where these are few, bitmaps are exact. What the tree leaves is compared whole, unless a link has joined it by then.
    """
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    ids = (np.cumsum(count > 1) - 1)[number[shared]]
    owner = np.repeat(np.arange(len(n)), n)[shared]
    held = np.bincount(owner, minlength=len(n))
    start = np.cumsum(held) - held
    _, up = np.unique(comp, return_inverse=True)
    label, up = up, np.arange(up.max() + 1)
    out: list[tuple[int, int]] = []

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def compare(x, y):
        nonlocal up
        at = 0
        while at < len(x):
            open_ = up[label[x[at:]]] != up[label[y[at:]]]
            x, y, at = x[at:][open_], y[at:][open_], 0
            upto = max(1, int(np.searchsorted(np.cumsum(held[x] + held[y]), COMPARED)))
            a, b, at = x[:upto], y[:upto], upto
            both = _equal(ids, start, held, a, b)
            linked = 100 * both >= PERCENT * (n[a] + n[b] - both)
            for p, q in zip(a[linked].tolist(), b[linked].tolist()):
                r, s = root(label[p]), root(label[q])
                if r != s:
                    up[r] = s
                    out.append((p, q))
            while (up[up] != up).any():
                up = up[up]

    if len(n) <= FEW:
        compare(*_few(left, right))
        return out
    width = 1 << (max(64, min(int(ids.max()) + 1 if len(ids) else 1, BITS_EACH * int(held.mean() + 1))) - 1).bit_length()
    on = np.zeros((len(n), width), bool)
    on[owner, ids % width] = True
    bits = np.packbits(on, axis=1).view(np.uint64)

    def tree(rows):
        rows = rows[np.argsort(n[rows], kind="stable")]
        return rows, Tree(n[rows], bits[rows], held[rows])

    rows, a = tree(left)
    others, b = (rows, a) if right is None else tree(right)
    for x, y in traverse(a, b, right is None):
        compare(rows[x], others[y])
    return out


def _link(batches):
    """Rows (key, i, j, node, comp, part, set) by group to the links (a, b) that join components within each group."""
    for whole, cuts in _whole_groups(batches):
        node, comp, part, i, j = (whole.column(c).to_numpy() for c in ("node", "comp", "part", "i", "j"))
        sets = whole.column("set").combine_chunks()
        n = pa.compute.list_value_length(sets).to_numpy().astype(np.int64)
        flat, before = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
        links = []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                found = _joining(flat[before[lo] : before[hi]], n[lo:hi], comp[lo:hi], *_sides(part[lo:hi], i[lo], j[lo]))
                links += [(node[lo + x], node[lo + y]) for x, y in found]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def components(links: DataFrame, made: list | None = None) -> DataFrame:
    """Links (a, b) to (node, comp), comp the least node reachable, for the linked nodes: large-star and small-star steps until nothing changes."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges", made)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u != v").distinct(), "edges", made)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        state = now


def sets_of(asked: DataFrame, docs: DataFrame, nodes: DataFrame, made: list | None = None) -> DataFrame:
    """(node, set) for the nodes in `asked`: the sorted shingles, made anew from one row that stands for the node."""
    asked = stage(asked.select("node").distinct().join(nodes.select("node", F.col("row").alias("_id")), "node").select("_id"), "asked", made)
    if asked.count() <= BROADCAST_IDS:
        asked = F.broadcast(asked)
    return docs.join(asked, F.col("_row") == F.col("_id")).select("text").mapInArrow(_sets, "node long, set array<long>")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, made: list | None = None) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), docs, nodes, made)
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    sized = pairs.join(a, "a").join(b, "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return sized.select("a", "b", both.alias("both"), F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b")).filter(
        F.col("both") * 100 >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))
    ).select("a", "b")


def parted(meeting: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, i, j, node, n, comp, part): the nodes of each MinHash value that still has several components, by the tasks in which they meet.

    A small group is one task. Of a larger one, the nodes of its largest component are dealt to parts numbered from -1
    down, and those of all others to parts from 0 up. Parts i and j meet in a task of their own, but parts of the largest
    component only meet others.
    """
    rows = meeting.select("key", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("long"))
    of = each.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("size", "long", "comp")).alias("main"), F.sum("size").alias("size"), F.sum("long").alias("long"))
    fit = lambda size, long: F.greatest(F.ceil(size / PART), F.ceil(long / PART_SHINGLES)).cast("int")
    small = (F.col("size") <= PART) & (F.col("long") <= PART_SHINGLES)
    of = of.filter("comps > 1").select(
        "key",
        F.when(~small, F.col("main.comp")).alias("main"),
        F.when(small, 0).otherwise(fit(F.col("main.size"), F.col("main.long"))).alias("main_parts"),
        F.when(small, 1).otherwise(fit(F.col("size") - F.col("main.size"), F.col("long") - F.col("main.long"))).alias("parts"),
    )
    rows, in_main = rows.join(of, "key"), F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    dealt = lambda parts: F.pmod(F.xxhash64("node"), F.greatest(parts, F.lit(1))).cast("int")
    rows = rows.withColumn("part", F.when(in_main, -1 - dealt(F.col("main_parts"))).otherwise(dealt(F.col("parts"))))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.when(in_main, F.lit(0)).otherwise(-F.col("main_parts")), F.col("parts") - 1)))
    return rows.select("key", F.least("part", "mate").alias("i"), F.greatest("part", "mate").alias("j"), "node", "n", "comp", "part")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def classes(docs: DataFrame) -> DataFrame:
    """(_row, n, comp) for each row of docs (_row, text), staged: n shingles and the class of rows joined by links, null without shingles.

    Texts with equal sets are one node. Each node is first compared with the centre that most of its groups of equal
    MinHash values have in common; that links most copies. What remains in different components goes through the signature
    trees, of which a very large group has several, pairwise in tasks of their own: first on bitmaps made once, which
    leaves the nodes that may link at all, then on these nodes' whole sets, where links are verified. Components are
    joined. Texts without words have no shingles and are linked with nothing.
    """
    made: list = []
    with text_batches(docs.sparkSession):
        docs = docs.select("_row", "text")
        rows = stage(docs.mapInArrow(_features, "_row long, n long, node long, bits binary, least array<long>"), "shingled", made)
        nodes = rows.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("least").alias("least"), F.min("_row").alias("row"))
        nodes = stage(nodes, "nodes", made)
        keys = nodes.select("node", "n", F.explode("least").alias("key"))
        met = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        meeting = stage(keys.join(met, "key"), "meeting", made)
        # a group's centre meets more of the others than its copies do, so what is alike only through it is joined at once
        degree = meeting.groupBy("node").agg(F.sum("size").alias("degree"))
        centre = meeting.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("c")).select("key", F.col("c.node").alias("first"))
        stars = meeting.join(centre, "key").filter(F.col("node") != F.col("first")).groupBy("node", "first").agg(F.count("*").alias("equal")).filter(F.col("equal") >= LIKELY)
        stars = stars.groupBy("node").agg(F.max(F.struct("equal", "first")).alias("s")).select(F.col("node").alias("a"), F.col("s.first").alias("b"))
        comps = stage(components(verified(stage(stars, "stars", made), docs, nodes, made), made), "comps", made)

        names = "key long, i int, j int, node long, comp long, part int"
        rest = parted(meeting, comps).join(nodes.select("node", "bits", "least"), "node")
        rest = stage(_by_group(rest.select("key", "i", "j", "node", "n", "comp", "part", "bits", "least")).mapInArrow(_open, names), "open", made)
        whole = rest.join(sets_of(rest, docs, nodes, made), "node").select("key", "i", "j", "node", "comp", "part", "set")
        links = stage(_by_group(whole).mapInArrow(_link, "a long, b long").distinct(), "links", made)
        ends = links.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("comp_b")), "b", "left")
        joined = stage(components(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")), made), "joined", made)
        joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
        grown = comps.join(joined, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
        fresh = joined.select(F.col("comp").alias("node"), F.col("new").alias("comp")).join(comps, "node", "left_anti")
        comps = stage(grown.unionByName(fresh), "comps", made)

        named = rows.select("_row", "n", "node").join(comps, "node", "left")
        named = stage(named.select("_row", "n", F.coalesce("comp", "node").alias("comp")), "classes")
    dropped(docs.sparkSession, made)
    return named


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): the classes of documents joined by links.

    component_id is the least doc_id of the class. A row with a null doc_id is a document like any other and takes part
    in links; only a class of such rows alone has a null component_id. Repeated rows each get a row; extra columns are
    ignored; an empty table gives no rows.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    named = classes(rows.select("_row", "doc.text")).join(rows.select("_row", "doc.doc_id"), "_row")
    least = named.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the least doc_id, nulls last, and of repeated rows one; null, empty and blank texts are kept.

    An empty table gives no rows; other columns are passed on, whatever their names.
    """
    rows = numbered(docs)
    named = classes(rows.select("_row", "doc.text")).filter("comp is not null").join(rows.select("_row", "doc.doc_id"), "_row")
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("f"))
    gone = named.select("_row").join(first.select(F.col("f._row").alias("_row")), "_row", "left_anti")
    return rows.join(stage(gone, "gone"), "_row", "left_anti").select("doc.*")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
e AS (SELECT DISTINCT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
df AS (SELECT k FROM e GROUP BY k HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both FROM (SELECT * FROM e SEMI JOIN df USING (k)) a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*)))"""
ORACLE_SQL = "WITH RECURSIVE " + ORACLE_SQL.strip().removeprefix("WITH ") + """,
r(doc, reach) AS (SELECT a, b FROM p UNION SELECT r.doc, p.b FROM r JOIN p ON r.reach = p.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(reach) FROM r WHERE r.doc = s.doc_id), doc_id)) AS component_id FROM s
"""
