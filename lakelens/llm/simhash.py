"""SimHash near-duplicates: tiled exact comparison of all distinct fingerprints with numpy exclusive-or and bit counts.

Documents with one fingerprint are one class, so groups of copies cost nothing. Classes are put in cells by population
count and cells are cut in tiles of bounded size. Fingerprints within the radius have population counts within the
radius, so only tiles of such cells meet; inside a pair of tiles the same rule is applied to runs of 128 fingerprints and
the population counts of their four 16-bit parts. Every remaining pair is compared exactly. A pair of tiles gives the
edges of a spanning forest of its links, not all links, so a large group of near copies gives no quadratic output; the
components of the forests' union are those of all links.

Where similarity decides (one_of_each), 256-bit fingerprints of the sets of different shingles only find candidates: the
first word goes through the tiles with its own radius, and the pairs that pass are held to the distance of all four. A
link is a pair of candidates whose sets have an exact Jaccard similarity of SIMILARITY or more. The sets of a component of
candidates are compared in one place, or in tiles of bounded size; pairs that links found so far join are left out.

Defined results: null or empty text has fingerprint 0 and links like any other; texts of any length count whole; a bit
that exactly half of the hashes have is 0; a null doc_id is never a component's least id unless it has no other; repeated
rows give repeated rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.common import arrow_schema, keeps_columns, map_arrow, per_row, read_documents, text_bytes
from lakelens.llm.components import connected_components
from lakelens.session import cut

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
TILE = 4096
#: Tiles of a cell that one task compares with the tiles of another cell.
SHARE = 1
RUN = 128
#: For links by similarity: 256-bit fingerprints of five-word shingle sets. At SIMILARITY they differ in 39 bits +- 6 (in
#: 48 +- 6 for sets of four and five), in a word in 10 +- 3; the radii leave room, as they only find candidates.
WIDE_WORDS = 5
SIMILARITY = 0.8
WIDE_RADIUS = 76
WORD_RADIUS = 24
#: Shingles and sets that a tile of a component's sets holds on average at most.
SET_TILE = 1 << 19
SETS = 4096
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 values of the text's word shingles, repeats included; the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have; 0 of none."""
    if not len(hashes):
        return 0
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the XXH64 values of the text's word shingles."""
    return majority(shingle_hashes(text, width))


def shingle_set(text: bytes, width: int = WIDE_WORDS) -> np.ndarray:
    """The different XXH64 values of the text's word shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """SimHash of 256 bits as four words: the shingles' hashes, and three remixings of them."""
    out = []
    for k in range(4):
        out.append(majority(hashes))
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1)
        hashes ^= hashes >> np.uint64(32)
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    out = "doc_id long, fp long"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")), per_row(lambda i, t: (i, signed(fingerprint(t))), out), out)


class Runs:
    """Fingerprints sorted by the population counts of their 16-bit parts, in runs with the range of each count.

    A row holds a fingerprint's words and then its node; a row of one word is its own node.
    """

    def __init__(self, rows: np.ndarray):
        values = rows[:, 0]
        parts = np.bitwise_count(np.ascontiguousarray(values).view(np.uint16).reshape(-1, 4)).astype(np.int16)
        order = np.lexsort(parts.T)
        self.values, self.rows, parts = values[order], rows[order], parts[order]
        starts = np.arange(0, len(values), RUN)
        self.low, self.high = np.minimum.reduceat(parts, starts), np.maximum.reduceat(parts, starts)


def linked(a: Runs, b: Runs, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the pairs within ``radius`` in each word and ``total`` in all, some at a time."""
    for r in range(len(a.low)):
        gap = np.maximum(0, np.maximum(a.low[r] - b.high, b.low - a.high[r])).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if not len(near):
            continue
        at = (near[:, None] * RUN + np.arange(RUN)).ravel()
        at = at[at < len(b.values)]
        mine = np.arange(r * RUN, min((r + 1) * RUN, len(a.values)))
        i, j = np.nonzero(np.bitwise_count(a.values[mine][:, None] ^ b.values[at][None, :]) <= radius)
        i, j = mine[i], at[j]
        for word in range(1, a.rows.shape[1] - 1):
            near = np.bitwise_count(a.rows[i, word] ^ b.rows[j, word]) <= radius
            i, j = i[near], j[near]
        if a.rows.shape[1] > 1:
            near = np.bitwise_count(a.rows[i, :-1] ^ b.rows[j, :-1]).sum(axis=1) <= total
            i, j = i[near], j[near]
        yield i, j


class Forest:
    """Union-find over positions; keeps the unions that joined two trees."""

    def __init__(self, n: int):
        self.parent, self.edges = np.arange(n), []

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            low = np.minimum(a, b)[first]
            self.parent[high] = low
            self.edges.append((high, low))


def tile_forest(first: np.ndarray, second: np.ndarray | None, radius: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (by node) of a spanning forest of the links between two tiles, or inside one."""
    a = Runs(first)
    b = a if second is None else Runs(second)
    forest, shift = Forest(len(first) + (0 if second is None else len(second))), 0 if second is None else len(first)
    for i, j in linked(a, b, radius, total):
        forest.add(i, j + shift)
    nodes = a.rows[:, -1] if second is None else np.concatenate([a.rows[:, -1], b.rows[:, -1]])
    if not forest.edges:
        return nodes[:0], nodes[:0]
    return nodes[np.concatenate([e[0] for e in forest.edges])], nodes[np.concatenate([e[1] for e in forest.edges])]


def link_forests(values: DataFrame, radius: int = RADIUS, total: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all links among the distinct fingerprints ``values``.

    The column fp is the node and the first word of a fingerprint; an array rest, where there is one, holds the others and
    a column node the node, and pairs link at ``radius`` bits or fewer in each word and ``total`` or fewer in all.
    """
    step = max(1, (radius + 1) // 5)  # population counts in a cell
    cell = F.floor(F.bit_count("fp") / step).cast("int")
    counts = values.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()  # 65 rows at most
    node = "node" if "rest" in values.columns else "fp"
    n_tiles = {r["cell"]: -(-r["n"] // TILE) for r in counts}
    if not n_tiles:
        return values.select(F.col(node).alias("u"), F.col(node).alias("v")).limit(0)
    tiles_of = F.create_map(*(F.lit(x).cast("int") for item in n_tiles.items() for x in item))
    spread = max(1, -(-max(n_tiles.values()) // SHARE))  # tasks that share the pairs of one cell
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(n, min(8 * n, len(n_tiles) * spread))  # stated, as the work is in the pairs and not in the bytes
    tile = F.pmod(F.xxhash64(node), tiles_of[cell]).cast("int")
    row = F.concat(F.array("fp"), "rest", F.array("node")) if node == "node" else F.array("fp")
    words = 5 if node == "node" else 1
    tiles = values.groupBy(cell.alias("cell"), tile.alias("tile")).agg(F.flatten(F.collect_list(row)).alias("fps"))
    left = tiles.select("cell", "tile", "fps", F.explode(F.array(*(F.lit(d) for d in range(-(-radius // step) + 1)))).alias("step"))
    left = left.select((F.col("cell") + F.col("step")).alias("meets"), F.pmod("tile", F.lit(spread)).alias("share"), "step", F.col("tile").alias("tile_a"), F.col("fps").alias("a"))
    right = tiles.select(F.col("cell").alias("meets"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("share"), F.col("tile").alias("tile_b"), F.col("fps").alias("b"))
    left, right = (side.repartition(tasks, "meets", "share") for side in (left, right))
    pairs = left.join(right.hint("shuffle_hash"), ["meets", "share"]).filter("step > 0 or tile_a <= tile_b")
    pairs = pairs.select(F.expr("step = 0 and tile_a = tile_b").alias("same"), "a", "b")
    schema = arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (batch.column(c)[n].values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words) for c in (1, 2))
                u, v = tile_forest(a, None if batch.column(0)[n].as_py() else b, radius, radius if total is None else total)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

    return map_arrow(pairs, run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row of ``docs`` (doc_id, text)."""
    rows = cut(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(link_forests(classes.select("fp"), radius))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(groups, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def similar_forest(sets: list[np.ndarray], prints: np.ndarray, side: np.ndarray | None, total: int) -> Forest:
    """A spanning forest of the pairs (of different sides, if there are sides) within ``total`` bits and of SIMILARITY or more."""
    forest, sizes = Forest(len(sets)), np.array([len(x) for x in sets])
    for i in range(len(sets) - 1):
        roots = forest.roots(np.arange(i, len(sets)))
        small, large = np.minimum(sizes[i], sizes[i + 1 :]), np.maximum(sizes[i], sizes[i + 1 :])
        open_ = (roots[1:] != roots[0]) & (small >= SIMILARITY * large)
        if side is not None:
            open_ &= side[i + 1 :] != side[i]
        j = i + 1 + np.flatnonzero(open_)
        j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(axis=1) <= total]
        j = j[sizes[j] > 0]
        if not len(j) or not sizes[i]:
            continue
        theirs = np.concatenate([sets[k] for k in j])
        found = sets[i][np.minimum(np.searchsorted(sets[i], theirs), sizes[i] - 1)] == theirs
        both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[j])[:-1])))
        j = j[both >= SIMILARITY * (sizes[i] + sizes[j] - both) - 1e-9]
        forest.add(np.full(len(j), i), j)
    return forest


def verified_links(named: DataFrame, members: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) whose components are those of the candidates that are similar.

    ``named`` has doc_id, th and text; ``members`` has root (the component of candidates), node, prints (the fingerprint's
    words), n (the set's size) and the doc_id k and text hash k_th of a row with that set.
    """
    tiles = members.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / SET_TILE, F.count("*") / SETS)).cast("int").alias("tiles"))
    placed = members.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    same = named["doc_id"].eqNullSafe(F.col("k")) & (named["th"] == F.col("k_th"))
    texts = named.join(placed.hint("shuffle_hash"), same).select("root", "node", "tile", "tiles", "prints", "text")
    out = "root long, node long, tile int, tiles int, prints array<long>, hashes binary"
    sets = map_arrow(texts, per_row(lambda *x: (*x[:5], shingle_set(x[5]).tobytes()), out), out)
    meets = sets.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = ["root", "low", "high"]
    pairs = meets.select("root", F.least("tile", "meets").alias("low"), F.greatest("tile", "meets").alias("high"), "tile", "node", "prints", "hashes")
    pairs = pairs.repartition(*key).sortWithinPartitions(*key)
    schema = arrow_schema("u long, v long")

    def edges(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        nodes = np.array([r[1] for r in rows], np.int64)
        sets, prints = [np.frombuffer(r[3], "<u8") for r in rows], np.array([r[2] for r in rows], np.int64).view(np.uint64)
        forest = similar_forest(sets, prints, None if key[1] == key[2] else np.array([r[0] for r in rows]), total)
        u, v = (np.concatenate([nodes[:0], *(nodes[e[k]] for e in forest.edges)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for root, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, low, high) != last:
                    if rows:
                        yield edges(last, rows)
                    last, rows = (root, low, high), []
                rows.append(row)
        if rows:
            yield edges(last, rows)

    return map_arrow(pairs, run, "u long, v long")


@keeps_columns
def one_of_each(docs: DataFrame, radius: int = WORD_RADIUS, total: int = WIDE_RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for a component: the least (doc_id, text hash) of each.

    Links are pairs of texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more; texts
    without words are equal to each other. 256-bit fingerprints of the sets find the candidates.
    Rows are named by doc_id and a hash of the text; only where such names repeat is one of the equal rows chosen.
    """
    th = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), text_bytes().alias("text"))
    out = "doc_id long, th long, node long, n long, fp long, rest array<long>"

    def wide(doc_id: int | None, th: int, text: bytes) -> tuple:
        hashes = shingle_set(text)
        first, *rest = map(signed, wide_fingerprint(hashes))
        return doc_id, th, signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)), len(hashes), first, rest

    rows = cut(map_arrow(named, per_row(wide, out), out))
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), "th", "doc_id"))
    classes = cut(rows.groupBy("node").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("rest").alias("rest"), least.alias("least")))
    candidates = connected_components(link_forests(classes.select("node", "fp", "rest"), radius, total))
    members = classes.join(candidates, "node").select("root", "node", F.concat(F.array("fp"), "rest").alias("prints"), "n", F.col("least.doc_id").alias("k"), F.col("least.th").alias("k_th"))
    roots = connected_components(verified_links(named, members, total))
    classes = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    stays = classes.select(F.col("least.doc_id").alias("__stay_id"), F.col("least.th").alias("__stay_th")).distinct()
    kept = docs.join(stays.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("__stay_id")) & (th == F.col("__stay_th")), "left_semi")
    if rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        return kept
    columns = kept.columns
    kept = kept.groupBy(F.col("doc_id").alias("one_id"), F.xxhash64("text").alias("one_th")).agg(F.first(F.struct(*columns)).alias("row"))
    return kept.select("row.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
