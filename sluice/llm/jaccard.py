"""Exact Jaccard similarity join of documents as sets of word shingles, in metric space.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric; documents link when d <= EPSILON. Documents
with equal sets are one point.

Regions. The first pivots are the sets of a single shingle: d(x, {s}) is 1 - 1/|x| if s is in x, else
1, so a point is nearest to the pivots made of its own shingles. With the shingles ranked by how many
documents have them, rarest first, two points that link must share one of the first
|x| - ceil(0.75 |x|) + 1 shingles of either: these regions, the boundary ones included, are all that
a point has to appear in. A shingle of one document has no region, so that a document whose rarest
shingles are all its own, as most are, is alone without being compared with anything.

Home rounds. In each of a few rounds a point goes, with its set, to one home region: of the pivots made
of its shared shingles the first in the round's order. Large regions are dealt into blocks, in every
round anew. In a block documents are the pivots: a pivot's distances to all of the block link its
ball, and a member of the ball is compared further only if the triangle inequality leaves a point
outside the ball's component that it could reach (d to the pivot at most 2 * EPSILON, and within
EPSILON of the member's own). Then the boundary: wherever a region holds points of more than one
component, its pairs from different components that pass the size and position bounds are verified on
their sets. Components of the verified links come from alternating star contractions, each round
written to the shared folder.

Results in special cases: null texts and texts without a word have an empty set and link with
nothing; with one to four words the whole sequence is the one shingle; a null doc_id stays null and
is never a component's name unless all its ids are null; repeated rows link with each other; rows
that share an id but not their words are points of their own. A text is one value of a chunk, so it may
have 2 GB at most. Points are told apart by 128 bits of their set, shingles by 64: that one false match
changes a verdict takes a pair that misses the bound by that shingle alone, so among n verified pairs of
k shingles each it is expected less than n * k**2 / 2**64 times.

Hot keys. How many documents have a shingle is known before any join, so rows that meet at a frequent
shingle, or in a set with many copies, are dealt into parts by that number, and what they meet is
repeated for each part. Joins on a component's name, whose size isn't known before, are dealt into
SALTS parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.exchange import Chunk, ChunkTable, Keys, totals
from sluice.llm.shared import keep_written, scratch, written
from sluice.llm.words import mixed, set_hashes, span_hashes, window_hashes, words_of

SHINGLE = 5
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
EPSILON = 1 - PERCENT / 100
#: Points of a block, and rounds of home regions.
BLOCK = 400
ROUNDS = 3
#: Rows of one key that a join takes into one part, and parts at most.
PART_ROWS, PARTS = 5000, 64
#: Parts of joins on a key of unknown size.
SALTS = 8
#: Rounds of star contraction; a component of n nodes takes about log2(n).
BOUND = 100
NO_ID = -(1 << 63)


def links(overlap: np.ndarray, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def shingle_sets(c: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, laid end to end, and the n + 1 places where texts begin."""
    w = words_of(c.offsets, c.raw, lower=True)
    n = np.diff(w.first)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(per)])
    grams = window_hashes(w.hash, k)
    out = np.empty(int(ends[-1]), np.uint64)
    long = np.flatnonzero(n >= k)
    if len(long):
        size = per[long]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends[long], size) + within] = grams[np.repeat(w.first[long], size) + within]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        out[ends[short]] = span_hashes(w.hash, w.first[short], w.first[short + 1])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][per > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[ends]


_POINT = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("parts", pa.int32()), ("homes", pa.list_(pa.int64())), ("own", pa.int32()), ("prefix", pa.binary()), ("shared_by", pa.binary()), ("shingles", pa.binary())])
POINT = "chunk long, at int, doc_id long, n long, set_a long, set_b long, parts int, homes array<long>, own int, prefix binary, shared_by binary, shingles binary"


def parts_for(rows: np.ndarray | int) -> np.ndarray:
    """Parts that the rows of a key are dealt into."""
    return np.clip(-(-np.asarray(rows, np.int64) // PART_ROWS), 1, PARTS)


def points(c: Chunk, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per text.

    Of texts that share a shingle of their prefix with another: set_a, set_b (name the set), parts (for
    joins on it), homes (its region of each round), own (shingles before the prefix part that is shared),
    prefix, shared_by (how many texts have each of these), shingles.
    """
    flat, ends = shingle_sets(c)
    count = total[Keys.of(flat).place].astype(np.int64)
    n = np.diff(ends)
    single = np.concatenate([[0], np.cumsum(count == 1)])
    own = single[ends[1:]] - single[ends[:-1]]
    prefix = n - (PERCENT * n + 99) // 100 + 1
    rows = {k: [None] * len(n) for k in ("set_a", "set_b", "parts", "homes", "own", "prefix", "shared_by", "shingles")}
    shared = np.flatnonzero((own < prefix) & (n > 0))
    if len(shared):
        names = [set_hashes(flat, ends, salt)[shared].view(np.int64) for salt in (7, 8)]
        deal = [mixed(names[0].view(np.uint64), 40 + r) for r in range(ROUNDS)]
        for k, i in enumerate(shared.tolist()):
            s, f = flat[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]
            order = np.argsort(f, kind="stable")[own[i] : prefix[i]]
            known = np.flatnonzero(f > 1)
            homes = []
            for r in range(ROUNDS):
                first = known[mixed(s[known], 20 + r).argmin()]
                block = deal[r][k : k + 1] % np.uint64(-(-int(f[first]) // BLOCK))
                homes.append(mixed(s[first : first + 1] + (block * np.uint64(ROUNDS) + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15), 6).view(np.int64)[0])
            rows["set_a"][i], rows["set_b"][i], rows["homes"][i], rows["own"][i] = names[0][k], names[1][k], homes, int(own[i])
            rows["parts"][i] = int(parts_for(f.min()))  # all copies of a set have all its shingles
            rows["prefix"][i], rows["shared_by"][i], rows["shingles"][i] = s[order].tobytes(), f[order].tobytes(), s.tobytes()
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c.chunk)), pa.array(range(len(n)), pa.int32()), pa.array(c.ids), pa.array(n, pa.int64()), *(pa.array(v, _POINT.field(k).type) for k, v in rows.items())], schema=_POINT)


class Block:
    """The exact components of a few points, given as sorted sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        names, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(names), np.int32)
        self.root = np.arange(len(sets))
        self.degree = np.zeros(len(sets), np.int64)

    def overlaps(self, i: int) -> np.ndarray:
        own = self.at[self.ends[i] : self.ends[i + 1]]
        self.flag[own] = 1
        out = np.add.reduceat(self.flag[self.at], self.ends[:-1])
        self.flag[own] = 0
        return out.astype(np.int64)

    def join(self) -> None:
        """Sets root (a component's smallest member)."""
        m = len(self.n)
        done = np.zeros(m, bool)
        for i in range(m):
            if done[i]:
                continue
            o = self.overlaps(i)
            d = 1 - o / (self.n + self.n[i] - o)
            ball = links(o, int(self.n[i]), self.n)
            self._merge(i, np.flatnonzero(ball))
            self.degree[i] = np.count_nonzero(ball)
            done[i] = True
            outside = np.flatnonzero((self.root != self.root[i]) & (d <= 2 * EPSILON + 1e-9))
            # A member of the ball is complete if no outside point is within its reach.
            members = np.flatnonzero(ball & ~done)
            if not len(outside):
                done[members] = True
            elif len(members):
                far = np.sort(d[outside])
                near = np.searchsorted(far, d[members] - EPSILON - 1e-9)
                reach = (near < len(far)) & (far[np.minimum(near, len(far) - 1)] <= d[members] + EPSILON + 1e-9)
                done[members[~reach]] = True

    def _merge(self, i: int, found: np.ndarray) -> None:
        roots = np.unique(self.root[found])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def centres(self) -> np.ndarray:
        """For each point the member of its component with the largest ball among those that were pivots."""
        order = np.lexsort((np.arange(len(self.n)), -self.degree, self.root))
        first = np.ones(len(order), bool)
        first[1:] = self.root[order][1:] != self.root[order][:-1]
        centre = np.empty(len(self.n), np.int64)
        centre[self.root[order][first]] = order[first]
        return centre[self.root]


def _block_centres(key, part):
    """(node, centre) for the points of a block that aren't their component's centre."""
    nodes = part.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    nodes = nodes[order]
    if len(nodes) == 1:
        return pa.table({"x": nodes[:0], "y": nodes[:0]})
    sets = part.column("shingles").to_pylist()
    block = Block([np.frombuffer(sets[i], np.uint64) for i in order])
    block.join()
    centre = nodes[block.centres()]
    away = centre != nodes
    return pa.table({"x": nodes[away], "y": centre[away]})


def _home_labels(nodes: DataFrame) -> DataFrame:
    """(node, label): components of the links found in the points' home regions of all rounds."""
    dealt = nodes.select("node", F.explode("homes").alias("region"), "shingles")
    edges = dealt.groupBy("region").applyInArrow(_block_centres, "x long, y long")
    roots = components(edges)
    return written(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")


_ENTRY = pa.schema([("s", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int32()), ("parts", pa.int32())])


def _entries(nodes: DataFrame) -> DataFrame:
    """(s, node, n, pos, parts): the regions of each point, and the parts that joins on a region deal its points into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.frombuffer(b, np.int64) for b in batch.column(3).to_pylist()]
            by = np.concatenate([np.frombuffer(b, np.int64) for b in batch.column(4).to_pylist()])
            size = np.array([len(k) for k in keys])
            own = batch.column(2).to_numpy()
            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(own, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.repeat(batch.column(1).to_numpy(), size)), pa.array(pos, pa.int32()), pa.array(parts_for(by), pa.int32())], schema=_ENTRY)

    return nodes.select("node", "n", "own", "prefix", "shared_by").mapInArrow(run, "s long, node long, n long, pos int, parts int")


def _could_link(t: dict[str, np.ndarray], i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    """Whether points of different components pass the size and position bounds."""
    n, m = t["n"][i], t["n"][j]
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    room = 1 + np.minimum(n - 1 - t["pos"][i], m - 1 - t["pos"][j])
    return (t["label"][i] != t["label"][j]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (room >= need)


def _distinct_pairs(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once, the smaller first."""
    if not x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(x), np.concatenate(y)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


_COLUMNS = ("s", "node", "n", "pos", "label")


def _region_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a region that could link, for all regions of rows sorted by region; no region has more than a few hundred rows."""

    def pairs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = np.concatenate([[0], np.flatnonzero(t["s"][1:] != t["s"][:-1]) + 1, [len(t["s"])]])
        end = np.repeat(cut[1:], np.diff(cut))
        xs, ys = [], []
        i, gap = np.flatnonzero(end - np.arange(len(end)) > 1), 1
        while len(i):
            j = i + gap
            ok = _could_link(t, i, j)
            if ok.any():
                xs.append(t["node"][i[ok]])
                ys.append(t["node"][j[ok]])
            gap += 1
            i = i[i + gap < end[i]]
        if xs:
            x, y = _distinct_pairs(xs, ys)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])

    held = {c: np.zeros(0, np.int64) for c in _COLUMNS}
    for batch in batches:
        held = {c: np.concatenate([held[c], batch.column(c).to_numpy().astype(np.int64)]) for c in _COLUMNS}
        # The last region may go on in the next batch.
        whole = int(np.searchsorted(held["s"], held["s"][-1])) if len(held["s"]) else 0
        if whole:
            yield from pairs({c: v[:whole] for c, v in held.items()})
            held = {c: v[whole:] for c, v in held.items()}
    if len(held["s"]):
        yield from pairs(held)


def _cell_pairs(key, part):
    """Pairs of two cells of a region that could link; a cell that meets itself comes once.

    Of each pair one is of the region's size class and the other of that class or the next.
    """
    t = {c: part.column(c).to_numpy() for c in ("node", "n", "pos", "label", "side", "home")}
    a, b = np.flatnonzero(t["side"] <= 1), np.flatnonzero(t["side"] >= 1)
    xs, ys = [], []
    for i in a.tolist():
        hit = b[_could_link(t, i, b) & (t["home"][b] | t["home"][i])]
        if len(hit):
            xs.append(np.full(len(hit), t["node"][i]))
            ys.append(t["node"][hit])
    x, y = _distinct_pairs(xs, ys)
    return pa.table({"x": x, "y": y})


def _dealt(df: DataFrame) -> DataFrame:
    """Each row once for every part that the rows it is joined with are dealt into."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _candidates(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y): pairs of points of different components that share a region and pass the size and position bounds."""
    entries = written(_entries(nodes).join(labels, "node"), "entries")
    regions = entries.groupBy("s").agg(F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("b"), F.max("parts").alias("parts"))
    regions = written(regions.filter("a <> b").select("s", "m", "parts"), "regions")
    rows = entries.withColumn("salt", F.expr("cast(pmod(xxhash64(node, 2), parts) as int)")).drop("parts")
    small = rows.join(_dealt(regions.filter(F.col("m") <= 2 * BLOCK)), ["s", "salt"]).select(*_COLUMNS)
    pairs = small.repartition("s").sortWithinPartitions("s").mapInArrow(_region_pairs, "x long, y long")
    large = regions.filter(F.col("m") > 2 * BLOCK)
    if not large.isEmpty():
        cells = _cells(rows.join(_dealt(large), ["s", "salt"]).drop("m"), large)
        pairs = pairs.unionAll(cells.groupBy("s", "g", "i", "j").applyInArrow(_cell_pairs, "x long, y long"))
    return pairs.distinct()


def _cells(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """The rows of large regions, each for every pair of cells in which it is compared: (s, g, i, j, side, ...).

    Sets can link only if neither is more than 4/3 of the other, so of a region's points only those of one
    size class, or of neighbouring ones, meet. A region's points of one class and the next are dealt into
    cells: by component, those of a component with many points into cells of its own that need not meet
    each other. Cells meet two by two.
    """
    wide = 2 * BLOCK
    # A little more than 4/3, so that rounding can't part what belongs together.
    rows = rows.withColumn("c", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int"))
    classes = F.array(F.struct(F.col("c").alias("g"), F.lit(True).alias("home")), F.struct((F.col("c") - 1).alias("g"), F.lit(False).alias("home")))
    rows = written(rows.withColumn("at", F.explode(classes)).select("s", "salt", "at.g", "at.home", "node", "n", "pos", "label"), "large")
    sizes = written(rows.groupBy("s", "g", "label").agg(F.count("*").alias("m"), F.max("home").alias("home")), "sizes")
    groups = sizes.groupBy("s", "g").agg(F.sum(F.when(F.col("m") <= wide, F.col("m"))).alias("m"), F.count("*").alias("labels"), F.max("home").alias("home")).filter("labels > 1 and home")
    groups = written(groups.join(regions.select("s", "parts"), "s").select("s", "g", "parts", F.expr(f"cast(ceil(m / {wide}) as int)").alias("cells")), "groups")
    # owner: a component that has cells of its own; null: the cells of all others.
    owned = sizes.filter(f"m > {wide}").join(groups.select("s", "g", "parts"), ["s", "g"]).select("s", "g", "parts", F.col("label").alias("owner"), F.expr(f"cast(ceil(m / {wide}) as int)").alias("cells"))
    cells = groups.filter("cells > 0").select("s", "g", "parts", F.lit(None).cast("long").alias("owner"), "cells").unionAll(owned)
    cells = cells.select("s", "g", "parts", "owner", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    cells = cells.select("s", "g", "parts", F.struct(F.coalesce("owner", F.lit(0)).alias("owner"), F.col("owner").isNotNull().alias("owned"), "cell").alias("there"))
    own = owned.select("s", "g", "parts", F.col("owner").alias("label"), F.col("cells").alias("own_cells"))
    rows = rows.join(_dealt(groups), ["s", "g", "salt"]).join(_dealt(own), ["s", "g", "salt", "label"], "left")
    owned_row = F.col("own_cells").isNotNull()
    cell = F.when(owned_row, F.expr("cast(pmod(xxhash64(node, 1), own_cells) as int)")).otherwise(F.expr("cast(pmod(xxhash64(label, 1), cells) as int)"))
    rows = rows.withColumn("here", F.struct(F.when(owned_row, F.col("label")).otherwise(F.lit(0)).alias("owner"), owned_row.alias("owned"), cell.alias("cell")))
    rows = rows.select("s", "g", "salt", "home", "node", "n", "pos", "label", "here").join(_dealt(cells), ["s", "g", "salt"]).filter("not (here.owned and there.owned and here.owner = there.owner)")
    side = F.when(F.col("here") == F.col("there"), 1).when(F.col("here") < F.col("there"), 0).otherwise(2)
    return rows.select("s", "g", "home", "node", "n", "pos", "label", F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"), side.alias("side"))


def _boundary_links(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y): labels of components joined by a verified pair."""
    pairs = written(_candidates(nodes, labels), "pairs")
    sets = nodes.select("node", "shingles")
    full = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("sy")), "y").select("x", "y", "sx", "sy")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sx, sy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(links(o, len(x), len(y))))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    found = full.mapInArrow(verify, "x long, y long")
    lab = labels.select("node", "label")
    return found.join(lab.toDF("x", "lx"), "x").join(lab.toDF("y", "ly"), "y").filter("lx <> ly").select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).distinct()


def salted(many: DataFrame, by: str, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has each key once; the rows of a key are dealt into SALTS parts by column `by`."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "salt"], how).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (x, y), root being a component's smallest node.

    Each round links every node's neighbours to the smallest of them: first those larger than the
    node, then the node and those smaller. Rounds end when nothing changes.
    """
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x").cast("decimal(38,0)"))).first())
    now = written(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct(), "edges")
    mark = sign(now)
    for _ in range(BOUND):
        both = now.select("x", "y").unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = salted(both, "y", least, "x").filter("y > x").select(F.col("m").alias("x"), "y").distinct()
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y")
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = salted(down, "y", least, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("x").alias("b")))
        new = written(small.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "edges")
        mark, old = sign(new), mark
        if mark == old:
            return now.select(F.col("y").alias("node"), F.col("x").alias("root")).unionAll(now.select(F.col("x").alias("node"), F.col("x").alias("root"))).distinct()
        now = new
    raise RuntimeError(f"components took more than {BOUND} rounds")


def _resolved(table: ChunkTable, drop: bool) -> DataFrame:
    """(chunk, at, doc_id, n, root, component): every text of the table, by its chunk and its place there. root: the class (null: the text is alone). drop: the table, as soon as its texts aren't needed."""

    def send(c: Chunk) -> Keys:
        return Keys.of(shingle_sets(c)[0])

    counted = totals(table, send, width=6, kind=np.uint32)
    rows = written(table.map_with(counted, points, POINT, kind=np.uint32).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID))), "points")
    if drop:
        table.drop()
    # A row's number stands for its set, which it has alone or is the first of.
    shared = rows.filter(F.col("set_a").isNotNull())
    one = shared.groupBy("set_a", "set_b").agg(F.min(F.col("chunk") + F.col("at")).alias("node"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("parts", "n", "homes", "own", "prefix", "shared_by", "shingles")))
    nodes = written(one, "nodes")
    labels = _home_labels(nodes)
    roots = components(_boundary_links(nodes, labels))
    rooted = salted(labels, "node", roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    final = written(nodes.select("node", "set_a", "set_b", "parts", "least").join(rooted, "node"), "rooted")
    first = final.groupBy("root").agg(F.min("least").alias("component"))
    named = salted(final, "node", first, "root").select("set_a", "set_b", "parts", "root", "component")
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    columns = ["chunk", "at", "doc_id", "n"]
    alone = rows.filter(F.col("set_a").isNull()).select(*columns, F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component"))
    dealt = shared.select(*columns, "set_a", "set_b", F.pmod(F.col("chunk") + F.col("at"), F.col("parts")).cast("int").alias("salt"))
    return alone.unionAll(dealt.join(named, ["set_a", "set_b", "salt"]).select(*columns, "root", "component"))


def _table(docs: DataFrame, keep: tuple[str, ...] = ()) -> ChunkTable:
    return ChunkTable(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), keep=keep)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    with scratch(docs.sparkSession):
        table = _table(docs)
        return keep_written(_resolved(table, True).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "classes")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns: of each class the one with the smallest doc_id, of several such rows one.

    Ids don't make classes: rows of one id with different words stay each in its own, and of a class
    without ids one row stays. A row without a word is a class of its own. Texts don't move: what stays
    is told to the chunks that hold the texts.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    with scratch(docs.sparkSession):
        table = _table(docs, keep)
        rows = written(_resolved(table, False), "resolved")
        order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "chunk", "at")
        first = rows.filter("root is not null").groupBy("root").agg(F.min(order).alias("w")).select("w.chunk", "w.at")
        stay = first.unionAll(rows.filter("root is null").select("chunk", "at")).groupBy("chunk").agg(F.collect_list("at").alias("places"))
        kinds = "".join(f", rest_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    c, at = Chunk(row), pa.array(sorted(row["places"]), pa.int64())
                    texts = [c.raw[c.offsets[k] : c.offsets[k + 1]].tobytes() for k in at.to_pylist()]
                    rest = c.rest().take(at) if keep else pa.table({})
                    arrays = [pa.array(c.ids).take(at), pa.array(texts, pa.binary()), *(x.combine_chunks() for x in rest.columns)]
                    yield pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=["doc_id", "text", *rest.column_names])

        joined = table.frame().join(stay.hint("shuffle_hash"), "chunk").select("chunk", "ids", "lens", "flags", "rest", "text", "places")
        out = joined.mapInArrow(run, "doc_id long, text binary" + kinds)
        back = {"doc_id": F.nullif(F.col("doc_id"), F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType), "text": F.col("text").cast("string")} | {c: F.col(f"rest_{i}") for i, c in enumerate(keep)}
        return keep_written(out.select(*[back[c].alias(c) for c in docs.columns]), "kept")
