"""Vector codes by Lloyd rounds that filter codebook entries through kd-trees.

1. Vectors become integers, floor(256 * x), and blocks of at most `BLOCK_ROWS`; each partition makes
   its own.  A block holds one kd-tree for each part position: the parts in tree order, and for each
   node its bounding box, its sum and its count.  Blocks are written once; later passes read them.
2. A round sends every tree's nodes down with the entries that may be nearest.  An entry goes when
   another is nearer to every point of the node's box (or as near, with a lower index).  A node with
   one entry left gives its cached sum and count to it as a whole; a leaf with several compares its
   own parts with those only.  Comparisons are exact: all are integers.
3. Sums by part and entry (parts * entries rows, however many vectors there are) give the driver the
   next codebooks.  A last pass assigns the parts and returns codes and errors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import arrow_map, by_key, col, small_batches, table, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK_ROWS = 4096
LEAF = 16


class Forest:
    """kd-trees over the parts of a block, one for each part position, split level by level at medians.

    All trees of a block have the same shape, since it follows from the number of vectors.  points are
    (parts * n, width) in tree order; level j has edges[j] as the ends of its nodes over all trees.
    """

    def __init__(self, parts: int, points: np.ndarray, order: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray):
        self.parts, self.points, self.order, self.lows, self.highs, self.sums = parts, points, order, lows, highs, sums
        self.edges = _edges(len(points) // parts, parts)
        self.first = np.concatenate([[0], np.cumsum([len(e) - 1 for e in self.edges])])

    @staticmethod
    def build(vectors: np.ndarray, parts: int) -> Forest:
        n, dims = vectors.shape
        points = np.ascontiguousarray(vectors.reshape(n, parts, dims // parts).transpose(1, 0, 2)).reshape(parts * n, dims // parts)
        order = np.tile(np.arange(n), parts)
        lows, highs, sums = [], [], []
        for edges in _edges(n, parts):
            starts, sizes = edges[:-1], np.diff(edges)
            lo, hi = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
            lows, highs, sums = [*lows, lo], [*highs, hi], [*sums, np.add.reduceat(points, starts)]
            if sizes.max() > LEAF:  # sorted along the widest side, so that the next level's edges are medians
                side = np.repeat((hi - lo).argmax(1), sizes)
                by = np.lexsort((points[np.arange(len(points)), side], np.repeat(np.arange(len(sizes)), sizes)))
                points, order = points[by], order[by]
        return Forest(parts, points, order, *map(np.concatenate, (lows, highs, sums)))

    def to_bytes(self) -> bytes:
        out = []
        for a in (self.points, self.order, self.lows, self.highs, self.sums):
            least, most = (int(a.min()), int(a.max())) if a.size else (0, 0)
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
            out += [kind.encode(), a.size.to_bytes(8, "little"), a.astype(kind).tobytes()]
        return b"".join(out)

    @staticmethod
    def from_bytes(data: bytes, parts: int, width: int) -> Forest:
        at, arrays = 0, []
        for _ in range(5):
            kind, size = np.dtype(data[at : at + 3].decode()), int.from_bytes(data[at + 3 : at + 11], "little")
            arrays.append(np.frombuffer(data, kind, size, at + 11).astype(np.int64))
            at += 11 + size * kind.itemsize
        points, order, *nodes = arrays
        return Forest(parts, points.reshape(-1, width), order, *[a.reshape(-1, width) for a in nodes])

    def filter(self, books: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Nodes that go to one entry as a whole, as (first, end, node, entry), and other points, as (point, entry).

        books: (parts, entries, width).
        """
        per_tree, k = len(self.edges[0]) - 1, books.shape[1]
        node = np.repeat(np.arange(per_tree), k)
        entry = np.tile(np.arange(k), per_tree)
        whole, rest = [], []
        for level, edges in enumerate(self.edges):
            if not len(node):
                break
            at = self.first[level] + node
            z = books[node * self.parts // (len(edges) - 1), entry]
            lo, hi = self.lows[at], self.highs[at]
            starts, segment = _segments(node)
            best = _first_least(((2 * z - lo - hi) ** 2).sum(1), starts, segment)
            star = best[segment]
            z0 = z[star]
            corner = np.where(z > z0, hi, lo)  # the point of the box that favours z most
            farther = ((z - corner) ** 2).sum(1) - ((z0 - corner) ** 2).sum(1)
            stays = (farther < 0) | ((farther == 0) & (entry <= entry[star]))
            stays[best] = True
            node, entry, segment = node[stays], entry[stays], segment[stays]
            alone = np.bincount(segment, minlength=len(starts))[segment] == 1
            done = node[alone]
            whole.append((edges[done], edges[done + 1], self.first[level] + done, entry[alone]))
            node, entry = node[~alone], entry[~alone]
            if level + 1 < len(self.edges):
                node, entry = np.concatenate([2 * node, 2 * node + 1]), np.tile(entry, 2)
                by = np.lexsort((entry, node))
                node, entry = node[by], entry[by]
            else:
                rest.append(self._compared(edges, node, entry, books))
        empty = np.zeros(0, np.int64)
        wholes = tuple(np.concatenate(x) for x in zip(*whole, strict=True)) if whole else (empty,) * 4
        return wholes, rest[0] if rest else (empty, empty)

    def _compared(self, edges: np.ndarray, node: np.ndarray, entry: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of leaves with the nearest of their leaf's entries."""
        starts, _ = _segments(node)
        counts = np.diff(np.append(starts, len(node)))
        leaves = node[starts] if len(node) else node
        sizes = edges[leaves + 1] - edges[leaves]
        point = np.repeat(edges[leaves] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(leaves) else leaves
        pairs = np.repeat(counts, sizes)
        begin = np.concatenate([[0], np.cumsum(pairs)])[:-1]
        segment = np.repeat(np.arange(len(point)), pairs)
        candidate = entry[np.repeat(np.repeat(starts, sizes), pairs) + np.arange(len(segment)) - begin[segment]] if len(point) else entry
        p = point[segment] if len(point) else point
        z = books[p // (len(self.points) // self.parts), candidate]
        nearest = _first_least(((self.points[p] - z) ** 2).sum(1), begin, segment)
        return point, candidate[nearest] if len(point) else candidate

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts * entries) counts and their (.., width) sums."""
        (first, end, node, entry), (point, nearest) = self.filter(books)
        k, n = books.shape[1], len(self.points) // self.parts
        counts, sums = np.zeros(self.parts * k, np.int64), np.zeros((self.parts * k, self.points.shape[1]), np.int64)
        for key, c, s in ((first // n * k + entry, end - first, self.sums[node]), (point // n * k + nearest, np.ones(len(point), np.int64), self.points[point])):
            np.add.at(counts, key, c)
            np.add.at(sums, key, s)
        return counts, sums

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries and (n) squared distances, vectors in their own order."""
        (first, end, _, entry), (point, nearest) = self.filter(books)
        n = len(self.points) // self.parts
        label = np.empty(len(self.points), np.int64)
        label[_ranges(first, end)] = np.repeat(entry, end - first)
        label[point] = nearest
        part = np.repeat(np.arange(self.parts), n)
        code, error = np.empty((n, self.parts), np.uint8), np.zeros(n, np.int64)
        code[self.order, part] = label
        np.add.at(error, self.order, ((self.points - books[part, label]) ** 2).sum(1))
        return code, error


def _edges(n: int, parts: int) -> list[np.ndarray]:
    """The ends of the nodes of each level, over all trees: halves of the level before, down to leaves."""
    ends, out = np.array([0, n]), []
    while True:
        out.append(np.append((np.arange(parts)[:, None] * n + ends[:-1]).ravel(), parts * n))
        if np.diff(ends).max() <= LEAF:
            return out
        ends = np.append(np.stack([ends[:-1], (ends[:-1] + ends[1:]) // 2], 1).ravel(), n)


def _segments(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal nodes, and the run of each."""
    new = np.ones(len(node), bool)
    new[1:] = node[1:] != node[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _first_least(value: np.ndarray, starts: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """The position of each segment's least value, the first of equals."""
    if not len(value):
        return starts
    at = np.flatnonzero(value == np.minimum.reduceat(value, starts)[segment])
    return at[_segments(segment[at])[0]]


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - first
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(first) else first


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, vector) of rows that get a code, and the first codebooks (parts, entries, width)."""
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("vector"))
    whole = rows.filter((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = whole.orderBy(*order).limit(1).collect()
    if not first:
        return whole, np.zeros((parts, 0, 0), np.int64)
    dims = len(first[0]["vector"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    most = math.isqrt((1 << 63) // (16 * (dims // parts))) // SCALE
    whole = whole.filter((F.size("vector") == dims) & F.forall("vector", lambda x: F.abs(x) < most))
    start = [r["vector"] for r in whole.orderBy(*order).limit(ENTRIES).collect()]
    books = _whole(np.array(start).reshape(len(start), parts, -1).transpose(1, 0, 2)) if start else np.zeros((parts, 0, 0), np.int64)
    return whole, books


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE).astype(np.int64)


def blocks(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """(rows, forest): the ids and labels of at most BLOCK_ROWS vectors, and their trees."""
    own = StructType([StructField("vec_id", rows.schema["vec_id"].dataType), StructField("label", rows.schema["label"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                room = BLOCK_ROWS - sum(x.num_rows for x in held)
                held, b = [*held, b.slice(0, room)], b.slice(room)
                if sum(x.num_rows for x in held) == BLOCK_ROWS:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: pa.concat_arrays(t.column(c).chunks)
        vectors = column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        named = pa.StructArray.from_arrays([column("vec_id"), column("label")], ["vec_id", "label"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named)
        return pa.RecordBatch.from_arrays([lists, pa.array([Forest.build(_whole(vectors), parts).to_bytes()], pa.binary())], names=["rows", "forest"])

    kind = StructType([StructField("rows", ArrayType(own))]).add("forest", "binary")
    return rows.mapInArrow(run, kind)


def _next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry the floor of its parts' mean; an entry without parts stays."""
    parts, k, width = books.shape
    names = [f"s{j}" for j in range(width)]

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            counts, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
            for data in batch.column("forest"):
                c, s = Forest.from_bytes(data.as_py(), parts, width).totals(books)
                counts, sums = counts + c, sums + s
            return {"slot": np.arange(parts * k, dtype=np.int32), "n": counts} | {c: np.ascontiguousarray(sums[:, j]) for j, c in enumerate(names)}

        return f

    each = arrow_map(trees.select("forest"), "slot int, n long, " + ", ".join(f"{c} long" for c in names), make)
    out = books.reshape(parts * k, width).copy()
    for r in each.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect():
        if r["n"]:
            out[r["slot"]] = [int(r[c]) // r["n"] for c in names]
    return out.reshape(parts, k, width)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each kept vector, and the final codebooks (parts, entries, width).

    Null vectors, empty ones and those with null or non-finite components get no row.  Nor do vectors of
    another length than the first one's (by id), nor those with a component so large that a squared
    distance would pass 64 bits.  Rows that repeat an id or a vector are rows like others; null ids come
    last.  With fewer than ENTRIES vectors there are as many entries; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, BLOCK_ROWS)
    rows, books = kept_vectors(vectors, id_col, vector_col, label_col, parts)
    kind = StructType([rows.schema["vec_id"], rows.schema["label"]]).add("code", "string").add("error", "long")
    if not books.size:
        return spark.createDataFrame([], kind), books
    width = books.shape[2]
    trees = written(blocks(rows, parts, parts * width), "vector-blocks")
    for _ in range(rounds):
        books = _next_books(trees, books)
    final = books

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            code, error = [], []
            for data in batch.column("forest"):
                c, e = Forest.from_bytes(data.as_py(), parts, width).codes(final)
                code += [x.tobytes().hex() for x in c]
                error.append(e)
            own = batch.column("rows").flatten()
            return {"vec_id": own.field("vec_id"), "label": own.field("label"), "code": code, "error": np.concatenate(error)}

        return f

    return arrow_map(trees, kind, make), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings`, with their errors, those of their labels, and the codebooks' digest."""
    codes, books = encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = written(codes, "vector-codes")
    by_label = written(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    return by_key(codes, by_label, ["label"], "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_NEAREST = """SELECT p.vec_id, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), e := c.entry)) AS best FROM p JOIN {0} c USING (part) GROUP BY ALL"""
_MOVED = """SELECT part, entry, list(coalesce((s - ((s % n) + n) % n) // n, old) ORDER BY pos) AS x FROM (
  SELECT c.part, c.entry, c.pos, c.x AS old, m.s, m.n FROM (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM {0}) c
  LEFT JOIN (SELECT part, best.e AS entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT a.part, a.best, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS pos FROM {1} a JOIN p USING (vec_id, part)) GROUP BY ALL) m USING (part, entry, pos)) GROUP BY part, entry"""
SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER (ORDER BY vec_id) AS r FROM kept),
p AS (SELECT vec_id, label, r, i AS part, q[i * (len(q) // 16) + 1 : (i + 1) * (len(q) // 16)] AS x FROM v, range(16) t(i)),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
a1 AS ({_NEAREST.format("c0")}), c1 AS ({_MOVED.format("c0", "a1")}),
a2 AS ({_NEAREST.format("c1")}), c2 AS ({_MOVED.format("c1", "a2")}),
a3 AS ({_NEAREST.format("c2")}),
s AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
e AS (SELECT s.*, v.label FROM s JOIN v USING (vec_id)),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""
