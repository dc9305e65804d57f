"""Near-duplicate detection: 64-bit SimHash fingerprints, Golay-coded keys, connected classes.

Fingerprint: A-Z is lower-cased, words are runs of non-white-space, every 4-word shingle (repeats
included; with fewer words the whole sequence) votes with the bits of its XXH64, and a bit is set when
more than half of the shingles set it.  No words: zero, which links like any other fingerprint.

Links: two fingerprints link at ``RADIUS`` = 4 or fewer differing bits.  A fingerprint is cut into three
segments of 21, 21 and 22 bits.  Four errors fall on three segments in one of two ways:

* some segment has none: an exact-segment key finds the pair;
* all have at least one, so at least two have exactly one error each (1+1+1 or 1+1+2).  A segment,
  padded to 23 bits, is decoded in the perfect binary Golay code: every word is within distance 3 of
  exactly one codeword.  If x has the codeword c, a y at distance 1 is within distance 4 of c.  So x is
  filed under its one nearest codeword per segment, y looks under all codewords within distance 4 (one,
  or six when its own is three away), and a pair of such keys over two segments, together with both
  segments' parities (one error flips a parity), finds the pair.

Each ordered pair is found by exactly one of the six tables, by rules on the XOR of the two, so links are
counted by a partial sum and never stored twice.  Documents with equal fingerprints are one vertex with a
weight, so copies are not expanded.  Keys shared by many fingerprints are spread over blocks: each block
of the looking side meets every row filed under the key.

Defined results: null and empty texts have fingerprint zero; repeated rows are documents of their own
and link to each other; ids may repeat or be null (a null id is never the smallest unless alone).
Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import exact, shared, textkit

RADIUS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints under one key that meet in one task before the key is spread over blocks.
BLOCK = 4096


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Fingerprint of each document of a block, as uint64."""
    words = textkit.Words(buf, offs)
    counts = words.counts
    n_docs = len(counts)
    if not len(words):
        return np.zeros(n_docs, np.uint64)
    # The words of the block, joined by single spaces; a shingle is one slice of that.
    length = words.end - words.start
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    joined = np.full(begin[-1], 0x20, np.uint8)
    solid = np.ones(begin[-1], bool)
    solid[begin[1:] - 1] = False
    take = np.zeros(len(words.buf) + 1, np.int8)
    np.add.at(take, words.start, 1)
    np.add.at(take, words.end, -1)
    joined[solid] = words.buf[np.cumsum(take[:-1]) > 0] if (words.start[1:] > words.end[:-1]).all() else np.concatenate([words.buf[s:e] for s, e in zip(words.start, words.end)])
    shingles = np.where(counts > 0, np.maximum(1, counts - 3), 0)
    first = np.concatenate(([0], np.cumsum(shingles)))
    of = np.repeat(np.arange(n_docs), shingles)
    lead = words.first[:-1][of] + np.arange(len(of)) - first[:-1][of]
    last = np.minimum(lead + 4, words.first[1:][of])
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], 42) for a, b in zip(begin[lead].tolist(), (begin[last] - 1).tolist())), np.uint64, len(lead))
    votes = textkit.bit_votes(hashes, first)
    return textkit.pack_bits(votes * 2 > shingles[:, None])


def fingerprint_column(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and long ``fp``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    text = "text" if "text" in keep else "__text"

    def run(batches):
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column(text))
            got = [fingerprints(b, o) for _, _, b, o in textkit.blocks(buf, offs)]
            fp = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fp)], [*keep, "fp"])

    source = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["fp long"]))


# --- the code ---------------------------------------------------------------------------------

def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error of weight <= 3, and up to five of weight 4 (-1: none)."""
    syndrome = _column_syndromes()
    lead = np.full(2048, -1, np.int64)
    four: list[list[int]] = [[] for _ in range(2048)]

    def visit(weight: int, at: int, error: int, s: int) -> None:
        if weight == 4:
            four[s].append(error)
            return
        assert lead[s] < 0  # the code is perfect
        lead[s] = error
        for k in range(at, 23):
            visit(weight + 1, k + 1, error | (1 << k), s ^ int(syndrome[k]))

    visit(0, 0, 0, 0)
    weight3 = np.array([bin(e).count("1") == 3 for e in lead])
    extra = np.full((2048, 5), -1, np.int64)
    for s in np.flatnonzero(weight3):
        extra[s] = four[s]
    return lead, extra


def _column_syndromes() -> np.ndarray:
    """x**k modulo the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1."""
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value & 0x800:
            value ^= 0xC75
    return np.array(out, np.int64)


def syndromes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k, s in enumerate(_column_syndromes()):
        out ^= ((x >> k) & 1) * s
    return out


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, bits = SEGMENTS[k]
    return ((fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _parity(x: np.ndarray) -> np.ndarray:
    for k in (16, 8, 4, 2, 1):
        x = x ^ (x >> k)
    return x & 1


def _key(table: int, a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Table, the upper 12 bits of both codewords (a code is systematic in them), both parities."""
    return (((((table << 12) | (a >> 11)) << 12 | (b >> 11)) << 1 | pa_) << 1) | pb


def filed_keys(fp: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """(n, 6) keys a fingerprint is filed under: three exact segments, three pairs of codewords."""
    segs = [segment(fp, k) for k in range(3)]
    words = [s ^ lead[syndromes(s)] for s in segs]
    par = [_parity(s) for s in segs]
    out = [(k << 26 | s) for k, s in enumerate(segs)]
    out += [_key(3 + t, words[i], words[j], par[i], par[j]) for t, (i, j) in enumerate(PAIRS)]
    return np.stack(out, 1)


def sought_keys(fp: np.ndarray, lead: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys under which a fingerprint looks for others."""
    n = len(fp)
    segs = [segment(fp, k) for k in range(3)]
    par = [1 - _parity(s) for s in segs]
    near = []
    for s in segs:
        syn = syndromes(s)
        errors = np.concatenate([lead[syn][:, None], extra[syn]], axis=1)
        near.append((np.where(errors >= 0, s[:, None] ^ errors, -1)))
    rows, keys = [np.tile(np.arange(n), 3)], [np.concatenate([k << 26 | s for k, s in enumerate(segs)])]
    for t, (i, j) in enumerate(PAIRS):
        a, b = np.repeat(near[i], 6, axis=1), np.tile(near[j], (1, 6))
        row, col = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(_key(3 + t, a[row, col], b[row, col], par[i][row], par[j][row]))
    return np.concatenate(rows), np.concatenate(keys)


# --- links ------------------------------------------------------------------------------------

def _emit(batches, which: str):
    lead, extra = golay_tables()
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        n_docs = batch.column("n_docs").to_numpy(zero_copy_only=False)
        for lo in range(0, len(fp), 4096):
            part, weight = fp[lo : lo + 4096], n_docs[lo : lo + 4096]
            if which == "filed":
                keys = filed_keys(part, lead)
                row, key = np.repeat(np.arange(len(part)), keys.shape[1]), keys.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(weight[row])], ["key", "other", "other_docs"])
            else:
                row, key = sought_keys(part, lead, extra)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def links(vertices: DataFrame) -> DataFrame:
    """Ordered pairs (fp, other, other_docs) of different fingerprints at most RADIUS bits apart.

    ``vertices``: distinct fp with n_docs.
    """
    filed = vertices.select("fp", "n_docs").mapInArrow(lambda it: _emit(it, "filed"), "key long, other long, other_docs long")
    sought = vertices.select("fp", "n_docs").mapInArrow(lambda it: _emit(it, "sought"), "key long, fp long")
    # Keys that file more than BLOCK fingerprints are rare (their number is bounded by rows/BLOCK); their
    # lookers are cut into blocks and the filed rows are given to each block.
    heavy = shared.materialize(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts")))
    if not heavy.isEmpty():
        filed = filed.join(heavy, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        sought = sought.join(heavy, "key", "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))).drop("parts")
        on = ["key", "block"]
    else:
        on = ["key"]
    pairs = sought.join(filed, on)
    x = F.col("fp").bitwiseXOR(F.col("other"))
    seg = [F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift, bits in SEGMENTS]
    errors = [F.bit_count(s) for s in seg]
    # The one table that may report a pair: the first equal segment, else the first two segments of one error.
    table = (
        F.when(seg[0] == 0, 0).when(seg[1] == 0, 1).when(seg[2] == 0, 2)
        .when((errors[0] == 1) & (errors[1] == 1), 3).when((errors[0] == 1) & (errors[2] == 1), 4).otherwise(5)
    )
    return pairs.where((F.col("fp") != F.col("other")) & (F.bit_count(x) <= RADIUS) & (F.shiftrightunsigned("key", 26) == table)).select("fp", "other", "other_docs")


# --- classes ----------------------------------------------------------------------------------

def _forest(batches, limit: int = 1_000_000):
    """A spanning forest of the edges seen by a task: as many classes, at most one edge a vertex.

    The table of vertices is emptied whenever it holds ``limit`` of them, so memory is bounded.
    """
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    def flush():
        kids = [v for v, p in parent.items() if v != p]
        return pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array([find(v) for v in kids], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > limit:
            yield flush()
            parent = {}
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of the class of every vertex that has an edge.

    Tasks first shrink their edges to a spanning forest; then large-star and small-star rounds,
    each written to the shared folder, run until nothing changes (a number of rounds that grows with
    the logarithm of the longest chain).  Hot vertices are met by partial minima, not by collecting
    neighbours: each round is a grouped minimum and a join that spreads the edges of very large stars.
    """
    return _stars(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long"))


def _stars(forest: DataFrame) -> DataFrame:
    """The classes of edges (a, b) that tasks have shrunk to forests already."""
    now = shared.materialize(forest)
    if now.isEmpty():
        return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    while True:
        both = now.union(now.select("b", "a"))
        least = shared.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")))
        # large star: every larger neighbour of a vertex points to the vertex's least neighbour
        far = shared.salted(both, least.select("a", "m"), "a", shared.hot_keys(least, "a", "n"))
        large = far.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a vertex and its smaller neighbours point to the least of them
        small_least = shared.materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        close = shared.salted(large, small_least.select("a", "m"), "a", shared.hot_keys(small_least, "a", "n"))
        small = close.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        after = shared.materialize(small.distinct())
        # Done when the edges are stars: every vertex once on the left, no centre on the left.
        twice = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chain = after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi").limit(1)
        now = after
        if twice.isEmpty() and chain.isEmpty():
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def classes(fps: DataFrame) -> DataFrame:
    """Per distinct fingerprint of ``fps`` (doc_id, fp): fp, n_docs, n_near, component_id, root.

    root (the smallest fingerprint of the class) is the class's own key; component_id is none, as ids may repeat or be null.
    """
    vertices = shared.materialize(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least")))
    found = shared.materialize(links(vertices))
    near = found.groupBy("fp").agg(F.sum("other_docs").alias("linked"))
    roots = components(found.where("fp < other").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    placed = vertices.join(near, "fp", "left").join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = shared.materialize(placed)
    smallest = shared.materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return shared.salted(placed, smallest.drop("n"), "root", shared.hot_keys(smallest, "root", "n")).select("fp", "n_docs", (F.coalesce("linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_near"), "component_id", "root")


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    fps = shared.materialize(fingerprint_column(docs, ["doc_id"]))
    return joined(fps, classes(fps)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def joined(fps: DataFrame, by_fp: DataFrame) -> DataFrame:
    """Documents with their fingerprint's columns; fingerprints of very many documents are spread out."""
    return shared.salted(fps, by_fp, "fp", shared.hot_keys(by_fp, "fp", "n_docs"))


# --- the stage: wide fingerprints ----------------------------------------------------------------

#: A wide fingerprint is WIDE words of 64 bits.
WIDE = 8
#: Differing bits up to which two wide fingerprints are copies of each other (README: measured distances).
WIDE_RADIUS = 96
W = [f"w{k}" for k in range(WIDE)]
#: Fingerprints of a tile, and rows of a tile compared at a time.
TILE, STRIP = 4096, 16
#: Tiles of a partition: the first while that gives at most PARTS partitions, and never more than the second (75 MB).
TILES, PARTS = (4, 256), 64
#: Weight of a word by how often a text has it: four times the square root.
_WEIGHT = np.minimum(15, np.round(4 * np.sqrt(np.arange(32)))).astype(np.int64)


def wide_fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(n_docs, WIDE) uint64 of a block: SimHash of the distinct words."""
    words = textkit.Words(buf, offs)
    n_docs = len(offs) - 1
    out = np.zeros((n_docs, WIDE), np.uint64)
    if not len(words):
        return out
    doc, hashes = words.docs(), words.hashes()
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(fresh)
    hashes, doc = hashes[at], doc[at]
    weight = _WEIGHT[np.minimum(31, np.diff(np.concatenate((at, [len(order)]))))]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    for k in range(WIDE):
        votes = textkit.bit_votes(textkit.mix64(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))), first, weight)
        out[:, k] = textkit.pack_bits(votes * 2 > total[:, None])
    return out


def wide_column(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, h (a hash of the text) and the wide fingerprint w0, w1, ..."""
    source = docs.select(*keep, F.xxhash64("text").alias("h"), F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            buf, offs = textkit.text_buffers(batch.column("__text"))
            got = [np.zeros((0, WIDE), np.uint64)] + [wide_fingerprints(b, o) for _, _, b, o in textkit.blocks(buf, offs)]
            wide = np.concatenate(got).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(wide[:, k].copy()) for k in range(WIDE)], [*names, *W])

    return shared.in_arrow(source, run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{w} long" for w in W]))


def _tiles(batches, size: int):
    """Rows (tile, v, wide, own) of up to ``size`` vertices each, as bytes; own: the classes within the tile.

    A tile is named by its first vertex.
    """
    def tile(rows):
        own = np.arange(len(rows))
        wide = np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
        _connect(wide, wide, own, True)
        return pa.RecordBatch.from_arrays([pa.array(rows[:1, 0]), *(pa.array([x.tobytes()]) for x in (rows[:, 0], wide, own))], ["tile", "v", "wide", "own"])

    held = np.zeros((0, 1 + WIDE), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ["v", *W]], 1)])
        while len(held) >= size:
            yield tile(held[:size])
            held = held[size:]
    if len(held):
        yield tile(held)


def _fold(wide: np.ndarray) -> np.ndarray:
    """Half the bits, each the XOR of two: no pair is further apart so than it was."""
    return wide[:, : WIDE // 2] ^ wide[:, WIDE // 2 :]


def _connect(left: np.ndarray, right: np.ndarray, label: np.ndarray, same: bool) -> np.ndarray:
    """Merges the classes of vertices at most WIDE_RADIUS bits apart, by strips of rows of ``left``; both may be the ``same`` tile.

    ``label``, of the rows of left and then of right, is changed in place; the (2, n) labels that were joined are returned.
    Pairs of one class need no second look.  The count of the folded bits is kept in a byte: where it overflows it is too
    small, and the pair is told by all its bits.
    """
    ours, theirs = _fold(left), np.ascontiguousarray(_fold(right).T)
    room, bits, total, close = (np.empty(STRIP * len(right), t) for t in (np.uint64, np.uint8, np.uint8, bool))
    shift, merged = 0 if same else len(left), [np.zeros((2, 0), np.int64)]
    for lo in range(0, len(left), STRIP):
        rows, start = ours[lo : lo + STRIP], lo if same else 0
        m = len(right) - start
        x, n, far, ok = (a[: len(rows) * m].reshape(len(rows), m) for a in (room, bits, total, close))
        far[:] = 0
        for k in range(len(theirs)):
            np.bitwise_xor(rows[:, k : k + 1], theirs[k, start:], out=x)
            np.bitwise_count(x, out=n)
            np.add(far, n, out=far)
        np.less_equal(far, WIDE_RADIUS, out=ok)
        i, j = np.divmod(np.flatnonzero(ok), m)
        i, j = i + lo, j + start
        open_ = label[i] != label[j + shift]
        i, j = i[open_], j[open_]
        hit = np.bitwise_count(left[i] ^ right[j]).sum(1, dtype=np.int64) <= WIDE_RADIUS
        i, j = i[hit], j[hit]
        if not len(i):
            continue
        first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for at, js in zip(i[first].tolist(), np.split(j, first[1:])):
            met = np.unique(np.append(label[js + shift], label[at]))
            if len(met) > 1:
                label[label == met[1] if len(met) == 2 else np.isin(label, met)] = met[0]
                merged.append(np.stack([met[1:], np.full(len(met) - 1, met[0])]))
    return np.concatenate(merged, axis=1)


def _tile_edges(batches):
    """Edges (a, b) that connect what the near pairs of two tiles connect: fewer than the tiles have vertices."""
    for batch in batches:
        for row in range(batch.num_rows):
            # Views: a batch may hold a hundred pairs of tiles.
            view = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[row].as_buffer(), kind)  # noqa: B023, E731
            own = view("own")
            if batch.column("tile")[row] == batch.column("other_tile")[row]:
                ids = view("v")
                at = np.flatnonzero(own != np.arange(len(own)))
                edges = np.stack([at, own[at]])
            else:
                ids = np.concatenate([view("v"), view("other_v")])
                label = np.concatenate([own, view("other_own") + len(own)])
                edges = _connect(*(view(c, np.uint64).reshape(-1, WIDE) for c in ("wide", "other_wide")), label, False)
            if edges.size:
                yield pa.RecordBatch.from_arrays([pa.array(ids[edges[0]]), pa.array(ids[edges[1]])], ["a", "b"])


def wide_classes(vertices: DataFrame) -> DataFrame:
    """(v, root) of all vertices (v, w0, w1, ...): connected classes of wide fingerprints within WIDE_RADIUS.

    Every pair is compared, so no link is left out.  Complete keys would not be selective: 96 of 512 bits is so wide that segments
    short enough to be looked up within their share of the errors agree for many unrelated pairs (README).  Vertices are
    packed into tiles, every two tiles meet in one task (a Cartesian product of stored partitions, which shuffles nothing), and
    a task hands on a forest of what it connects, so a dense family gives no more edges than tiles have vertices.
    The work grows with the square of distinct fingerprints; README has figures.
    """
    n, size = vertices.count(), TILE
    few, many = (-(-n // (tiles * size)) for tiles in TILES)
    parts = max(1, min(few, PARTS), many)
    tiles = shared.materialize(shared.in_arrow(vertices.select("v", *W).repartition(parts, "v"), lambda it: _tiles(it, size), "tile long, v binary, wide binary, own binary"))
    other = tiles.select(*[F.col(c).alias(f"other_{c}") for c in tiles.columns])
    met = tiles.hint("shuffle_replicate_nl").join(other, F.col("tile") <= F.col("other_tile"))
    # One Python function per task: with two in a row an executor keeps twice as many workers.
    forest = shared.in_arrow(met, lambda it: _forest(_tile_edges(it)), "a long, b long")
    found = shared.materialize(_stars(forest).where("v <> root"))
    return vertices.select("v").join(found, "v", "left").select("v", F.coalesce("root", "v").alias("root"))


def filter_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class of near copies the document with the smallest id stays, with its columns.

    Near copies are found by wide fingerprints (512 bits, from single words, so that words changed at random places
    move few bits), of which every two are compared.  Null and empty texts are one class.  Null ids come
    last; of several rows with the smallest id in a class the one with the least hash of its text, then of its
    columns, stays.  Rows of different classes never stand for each other, whatever their ids.
    """
    docs, restore = shared.shield(docs)
    fps = shared.materialize(wide_column(docs, ["doc_id"]))
    vertices = shared.materialize(fps.groupBy(*W).agg(F.count(F.lit(1)).alias("n_docs")).withColumn("v", F.monotonically_increasing_id()))
    placed = shared.materialize(vertices.join(wide_classes(vertices), "v"))
    sizes = shared.materialize(placed.groupBy("root").agg(F.sum("n_docs").alias("size"), F.count(F.lit(1)).alias("n")).where("size > 1"))
    crowded = shared.salted(placed, sizes.select("root"), "root", shared.hot_keys(sizes, "root", "n"))
    crowded = shared.materialize(crowded.select(F.xxhash64(*W).alias("x"), "root", "n_docs", *[F.col(w).alias(f"_{w}") for w in W]))
    same = F.lit(True)
    for w in W:
        same = same & (F.col(w) == F.col(f"_{w}"))
    rows = shared.salted(fps.withColumn("x", F.xxhash64(*W)), crowded.drop("n_docs"), "x", shared.hot_keys(crowded, "x", "n_docs")).where(same)
    rows = shared.materialize(rows.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    judged = shared.salted(rows, best, "root", shared.hot_keys(sizes, "root", "size"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    return exact.settle(docs, judged.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "n", stays.alias("stays"))).select(*restore)
