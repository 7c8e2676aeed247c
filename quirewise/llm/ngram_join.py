"""Exact Jaccard join of word-shingle sets by PartEnum signatures, up to connected components.

Sets that differ in at most k elements agree on some part of the feature domain.  For each pair of
neighbouring size bands the domain is cut into groups and each group into parts; a set signs, in
each group, every subset of parts that leaves out as many as may differ there.  Two sets that are
similar enough and whose sizes fit share one signature at least; no similarity is lost.

Equal sets are one node.  First each node is compared with the bucket leader it meets most often; the
links found give classes.  Then only pairs of different classes that share a bucket are candidates, and
only those that a count sketch (a lower bound of the difference, as fine as the sets are large) lets
pass inside the bucket's task: first a spanning forest of each bucket's closest pairs, then, in those
buckets that had more pairs than that, what is left between the merged classes.  Every candidate is
verified on the full sets, so classes are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.ranking import numbered
from .common import HOT_SHARE, LEAST_HOT, arrow_map, by_key, col, lower_words, scratch, small_batches, table, texts, written
from .components import components
from .packing import Recent
from .perfect_hash import mix

#: Ranges of a sketch at least, as a power of two.
LEAST_BITS = 8
#: Cells in which signatures are counted; at most 1 / HOT_SHARE of them are hot.
CELLS = 1 << 16
#: Rows of a bucket that one task compares with as many others; larger buckets become a grid of blocks.
BLOCK = 2048
#: Pairs of rows, and 64-bit words of sketches, that a task looks at together.
PAIRS = 400_000
WORDS = 4_000_000
#: Rows of buckets that a task gathers before it compares them.
ROWS = 20_000
#: Comparisons with one leader that a task does; leaders of more nodes are copied to several tasks.
PER_LEADER = 5000
#: Comparisons (a few numbers each) that are broadcast to the documents; more are joined.
BROADCAST_ROWS = 300_000
#: Share of sets that may have more empty signatures than there are spare groups.
EMPTY_TAIL = 1e-3
_FACTOR = 0x9E3779B97F4A7C15


def shingle_set(text: str, n: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of all words if fewer; none without words."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w, seed) for w in words], np.uint64)
    n = min(n, len(words))
    total = np.full(len(h) - n + 1, n, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * _FACTOR & 0xFFFFFFFFFFFFFFFF
        total += h[k : len(h) - n + 1 + k] * np.uint64(factor)
    return np.unique(mix(total))


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    d = np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), "<i8")
    return int(d[0]), int(d[1])


def sketch(elements: np.ndarray) -> bytes:
    """Counts modulo 4 over ranges of the domain, a quarter as many as elements, in Gray code, four to a byte.

    Two Gray codes differ in as many bits as the counts differ around the cycle of 4, which is at
    most the number of elements by which the sets differ in that range.
    """
    bits = max(LEAST_BITS, (max(len(elements), 1) // 4 - 1).bit_length())
    counts = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 3
    return _packed(counts.astype(np.uint8)[None])[0].tobytes()


def _packed(counts: np.ndarray) -> np.ndarray:
    g = counts ^ counts >> 1
    return g[:, 0::4] | g[:, 1::4] << 2 | g[:, 2::4] << 4 | g[:, 3::4] << 6


def _counts(packed: np.ndarray) -> np.ndarray:
    g = np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], 2).reshape(len(packed), -1)
    return g ^ g >> 1


class Sketches:
    """The sketches of many sets, compared in bulk; the finer one of two is folded to the other's ranges."""

    def __init__(self, sketches: list[bytes]):
        self.sketches = sketches
        self.sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))

    def least_difference(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Lower bounds of the number of elements in which sets p[k] and q[k] differ."""
        size, out = np.minimum(self.sizes[p], self.sizes[q]), np.zeros(len(p), np.int64)
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            rows, place = np.unique(np.concatenate([p[at], q[at]]), return_inverse=True)
            words, (x, y) = self._folded(rows, s), place.reshape(2, -1)
            step = max(1, WORDS // words.shape[1])
            for lo in range(0, len(at), step):
                differ = words[x[lo : lo + step]] ^ words[y[lo : lo + step]]
                out[at[lo : lo + step]] = np.bitwise_count(differ).sum(1, dtype=np.int64)
        return out

    def _folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(rows), size), np.uint8)
        for s in np.unique(self.sizes[rows]).tolist():
            at = np.flatnonzero(self.sizes[rows] == s)
            own = np.frombuffer(b"".join([self.sketches[r] for r in rows[at].tolist()]), np.uint8).reshape(len(at), s)
            if s > size:
                counts = _counts(own)
                while counts.shape[1] > 4 * size:
                    counts = counts[:, 0::2] + counts[:, 1::2] & 3
                own = _packed(counts)
            out[at] = own
        return out.view(np.uint64)


class Bands:
    """Size bands and the PartEnum parameters of the instance for each band and the one below."""

    def __init__(self, percent: int):
        self.percent, self.tops, self.plans = percent, [0], {}

    def of(self, size: int) -> int:
        """Band i holds sizes from tops[i] + 1 to tops[i + 1]; linked sets are in equal or neighbouring bands."""
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, size)) - 1

    def plan(self, band: int) -> tuple[int, int, int, int]:
        """(groups, parts in a group, parts left out, spare groups) of the instance whose larger set is in `band`."""
        if band not in self.plans:
            while len(self.tops) < band + 2:
                self.of(self.tops[-1] + 1)
            k = 2 * (100 - self.percent) * self.tops[band + 1] // (100 + self.percent)
            self.plans[band] = (1, (1, 2, 4, 5)[k], k, 0) if k <= 3 else self._spared(ceil((k + 1) / 2), max(1, self.tops[band]))
        return self.plans[band]

    @staticmethod
    def _spared(groups: int, size: int) -> tuple[int, int, int, int]:
        """Two parts a group, one left out, and spare groups, so that few sets of `size` have more groups with an empty part.

        More groups make parts smaller and emptier, so there are a third more at most.
        """
        best = (2.0, 1)
        for spare in range(1, max(2, groups // 3) + 1):
            empty = (groups + spare) * (1 - (1 - exp(-size / (2 * (groups + spare)))) ** 2)
            term = below = exp(-empty)
            for i in range(1, spare + 1):
                term *= empty / i
                below += term
            best = min(best, (1 - below, spare))
            if best[0] < EMPTY_TAIL:
                break
        return groups + best[1], 2, 1, best[1]


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """The set's signatures for its own band's instance and the next one.

    With spare groups, linked sets agree in at least spare + 1 groups.  So a set that has an empty
    signature in at most `spare` groups needs no empty ones: some common signature has elements.
    """
    out, band = [], bands.of(len(elements))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(1)), dtype=np.uint64)])
    for instance in (band, band + 1):
        groups, parts, left_out, spare = bands.plan(instance)
        total = groups * parts
        edges = np.searchsorted(elements, (np.arange(1, total, dtype=np.float64) * (2.0**64 / total)).astype(np.uint64))
        at = np.concatenate([[0], edges, [len(elements)]])
        content = (sums[at[1:]] - sums[at[:-1]]).reshape(groups, parts)
        count = np.diff(at).reshape(groups, parts)
        base = np.arange(groups, dtype=np.uint64) + np.uint64(instance << 32)
        signed, filled = [], []
        for s, subset in enumerate(combinations(range(parts), parts - left_out)):
            tag = mix(base + np.uint64((s + 1) << 48))
            signed.append(mix(content[:, subset].sum(1, dtype=np.uint64) + tag))
            filled.append(count[:, subset].sum(1) > 0)
        signed, filled = np.stack(signed), np.stack(filled)
        out.append(signed.ravel() if (~filled.all(0)).sum() > spare else signed[filled])
    return np.concatenate(out).view(np.int64)


def _tasks(spark: SparkSession) -> int:
    """Partitions of work that is heavy for its bytes, and that adaptive execution shall not coalesce."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def close_enough(percent: int, a, b, difference):
    """Whether sets of sizes a and b that differ in at least `difference` elements can be linked."""
    return (100 - percent) * (a + b) >= (100 + percent) * difference


class NgramJoin:
    """One join: `words` per shingle, linked from `percent` similarity on."""

    def __init__(self, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent

    def described(self, docs: DataFrame, seed: int) -> DataFrame:
        """(doc_id, n, node, check, sketch) of each row; node and check name the set."""
        words = self.words

        def make():
            def f(batch: pa.RecordBatch) -> dict:
                sets = [shingle_set(t, words, seed) for t in texts(batch)]
                names = np.array([digest(s) for s in sets], np.int64)
                n = pa.array([len(s) for s in sets], pa.int64())
                return {"doc_id": batch.column("doc_id"), "n": n, "node": pa.array(names[:, 0]), "check": pa.array(names[:, 1]), "sketch": [sketch(s) for s in sets]}

            return f

        return arrow_map(docs, "doc_id long, n long, node long, check long, sketch binary", make)

    def signed(self, docs: DataFrame, seed: int) -> DataFrame:
        """(sig, node).  A task signs a set it has met lately once only."""
        words, percent = self.words, self.percent

        def make():
            bands, met = Bands(percent), Recent(100_000)

            def f(batch: pa.RecordBatch) -> dict:
                sigs, nodes, counts = [], [], []
                for t in texts(batch):
                    s = shingle_set(t, words, seed)
                    if len(s) and met.get(node := digest(s)[0]) is None:
                        met.put(node, True)
                        sigs.append(signatures(s, bands))
                        nodes.append(node)
                        counts.append(len(sigs[-1]))
                none = np.zeros(0, np.int64)
                return {"sig": pa.array(np.concatenate([none, *sigs])), "node": pa.array(np.repeat(np.array(nodes, np.int64), counts))}

            return f

        return arrow_map(docs, "sig long, node long", make)

    def sets_of(self, docs: DataFrame, nodes: DataFrame, seed: int, few: bool) -> DataFrame:
        """(node, elements) of the given (node, rep), and of other rows with such an id; a set may come more than once, from several tasks."""
        words = self.words

        def make():
            met = Recent(10_000)

            def f(batch: pa.RecordBatch) -> dict:
                names, sets = [], []
                for t in texts(batch):
                    s = shingle_set(t, words, seed)
                    if met.get(node := digest(s)[0]) is None:
                        met.put(node, True)
                        names.append(node)
                        sets.append(s.tobytes())
                return {"node": names, "elements": sets}

            return f

        wanted = nodes.select(F.col("rep").alias("doc_id")).distinct()
        read = docs.alias("d").join((F.broadcast(wanted) if few else wanted).alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
        return arrow_map(read, "node long, elements binary", make)

    def linked(self, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
        """The (a, b) of `pairs` that are linked, by full comparison.  pairs: distinct (a, b) with a != b.

        Each set goes once to every b it is compared with (and each b's own set first), where the sets
        stream past it; few pairs are broadcast to the sets, many are joined.
        """
        percent = self.percent
        salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_LEADER).cast("int").alias("salts"))
        leaders = salts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"))
        others = pairs.join(salts, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
        roles = written(leaders.unionByName(others), "join-roles")
        few = roles.count() <= BROADCAST_ROWS
        needed = written(nodes.join(roles.select("node").distinct(), "node").select("node", "rep"), "join-nodes")
        sets = self.sets_of(docs, needed, seed, few)

        def make():
            held: dict = {}

            def f(batch: pa.RecordBatch) -> dict:
                nonlocal held
                out = []
                for b, a, e in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "elements")), strict=True):
                    own = np.frombuffer(e, np.uint64)
                    if a is None:
                        held = {b: own}
                        continue
                    lead = held[b]  # the leader's own row comes first; without it this is an error
                    small, large = (own, lead) if len(own) < len(lead) else (lead, own)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                    if 100 * common >= percent * (len(own) + len(lead) - common):
                        out.append((a, b))
                x = np.array(out, np.int64).reshape(-1, 2)
                return {"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1])}

            return f

        met = sets.join(
            F.broadcast(roles) if few else roles, "node",
        ).select("b", "salt", "a", "elements").repartition(_tasks(docs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
        return written(arrow_map(met.drop("salt"), "a long, b long", make), "join-links")

    def across(self, buckets: DataFrame, labels: DataFrame, nodes: DataFrame, closest: bool) -> DataFrame:
        """Candidates (a, b, sig) of different classes that share a bucket.

        `closest`: a spanning forest of each bucket only, and sig (else null) where the bucket has
        more candidates.  A bucket of more than BLOCK rows becomes a grid of blocks, sorted by class,
        so that a task holds two blocks and blocks of one class only don't meet.  No task gathers a bucket before that.
        """
        percent = self.percent
        classed = written(buckets.join(labels, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root")), "join-classed")
        ends = classed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
        several = written(ends.filter("lo != hi").select("sig", "m", F.col("m").alias("rows")), "join-several")
        mixed = written(by_key(classed, several, ["sig"], "rows"), "join-mixed")
        one = mixed.filter(F.col("m") <= BLOCK).select("sig", "node", "root", *[F.lit(0).alias(c) for c in ("i", "j", "part")])
        placed = numbered(mixed.filter(F.col("m") > BLOCK), ["root"], ["sig"], "place")
        large = written(placed.select("sig", "node", "root", F.expr(f"(place - 1) div {BLOCK}").cast("int").alias("part")), "join-large")
        blocks = large.groupBy("sig", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        left, right = blocks.toDF("sig", "i", "lo", "hi"), blocks.toDF("sig", "j", "lo2", "hi2")
        grid = left.join(right, "sig").filter("i <= j and not (lo = hi and lo2 = hi2 and lo = lo2)").select("sig", "i", "j")
        dealt = grid.select("sig", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part")).join(large, ["sig", "part"])
        columns = ["sig", "i", "j", "part", "node", "root"]
        met = one.select(columns).unionByName(dealt.select(columns)).join(nodes.select("node", "n", "sketch"), "node")
        met = met.repartition(_tasks(buckets.sparkSession), "sig", "i", "j").sortWithinPartitions("sig", "i", "j", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            rows = 0
            for batch in batches:
                if rows >= ROWS:
                    other = (_bucket(batch) != _bucket(held[-1])[-1]).any(1)
                    if other.any():
                        cut = int(other.argmax())
                        yield _candidates(pa.Table.from_batches([*held, batch.slice(0, cut)]), percent, closest)
                        held, rows, batch = [], 0, batch.slice(cut)
                held.append(batch)
                rows += batch.num_rows
            if rows:
                yield _candidates(pa.Table.from_batches(held), percent, closest)

        return met.mapInArrow(run, "a long, b long, sig long")

    def run(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: bool = False) -> DataFrame:
        """(doc_id, n_shingles, component_id[, node, root]) for each input row; `named`: the set's and the class's name.

        component_id is the smallest id that links reach.  A null or empty text, or one without
        words, has no shingles and is linked with nothing: its component is its own id.  A null id
        sorts last: it is a component's id only where no other is.  Rows that repeat are equal sets
        and so linked.  An empty table gives an empty result.
        """
        spark = docs.sparkSession
        small_batches(spark, 1000)
        rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
        with scratch(spark) as keep:
            for seed in range(8):
                described = written(self.described(rows, seed), "join-rows")
                names = F.min("check").alias("lo"), F.max("check").alias("hi")
                sets = described.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), *names)
                nodes = written(sets, "join-nodes")
                if nodes.filter("lo != hi").isEmpty():  # else two sets share a 64-bit name: name them anew
                    break
            else:
                raise RuntimeError("set names collide")
            self.seed = seed
            labels = self._classes(rows, nodes, seed)
            keep += [described, nodes, labels]
        classed = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
        least = classed.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = classed.join(least, "root").select("node", "root", "component_id")
        out = described.join(ids, (described["node"] == ids["node"]) & (described["n"] > 0), "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(described["doc_id"]).alias("component_id")
        names = [described["node"], ids["root"]] if named else []
        return out.select(described["doc_id"].alias(id_col), F.col("n").alias("n_shingles"), component, *names)

    def _classes(self, rows: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
        """(node, root) of the linked nodes but the roots."""
        signed, own = written(self.signed(rows, seed), "join-signed"), Window.partitionBy("sig")
        # Signatures are nearly all unique; only those of a cell that holds many rows are aggregated before they are joined.
        cell, least = F.pmod(F.xxhash64("sig"), F.lit(CELLS)), max(LEAST_HOT, signed.count() * HOT_SHARE)
        hot = [r["cell"] for r in signed.groupBy(cell.alias("cell")).count().filter(F.col("count") >= least).collect()]
        met = signed.filter(~cell.isin(hot)).select("sig", "node", F.min("node").over(own).alias("lead"), F.max("node").over(own).alias("hi"))
        held = met.filter("lead != hi").drop("hi")
        if hot:
            many = signed.filter(cell.isin(hot))
            ends = many.groupBy("sig").agg(F.min("node").alias("lead"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("rows"))
            shared = written(ends.filter("lead != hi").drop("hi"), "join-shared")
            held = held.unionByName(by_key(many, shared, ["sig"], "rows"))
        held = written(held.distinct(), "join-held")
        # Copies that agree on many parts share as many buckets: buckets of the same members become
        # one, named by their members.  Should two names be equal, their buckets merge; no pair is lost.
        names = written(held.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("name"), F.count(F.lit(1)).alias("rows")), "join-names")
        named = by_key(held, names, ["sig"], "rows").select(F.col("name").alias("sig"), "node", "lead")
        buckets = written(named.distinct(), "join-buckets")
        often = buckets.filter("node != lead").groupBy("node", "lead").count().groupBy("node").agg(F.max(F.struct("count", "lead")).alias("best"))
        best = often.select(F.greatest("node", "best.lead").alias("a"), F.least("node", "best.lead").alias("b")).distinct()
        tested = written(self._plausible(best, nodes), "join-pairs")
        labels = written(components(self.linked(rows, nodes, tested, seed)), "join-labels")
        found = written(self.across(buckets, labels, nodes, closest=True), "join-found")
        labels, tested = self._joined(rows, nodes, labels, tested, found, seed)
        more = found.filter("sig is not null").select("sig").distinct()
        if not more.isEmpty():
            found = self.across(buckets.join(more, "sig", "left_semi"), labels, nodes, closest=False)
            labels, tested = self._joined(rows, nodes, labels, tested, found, seed)
        return labels

    def _joined(self, rows: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, found: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """Labels after comparing the pairs that have not been tested, and all tested pairs."""
        pairs = written(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "join-pairs")
        if pairs.isEmpty():
            return labels, tested
        links = self.linked(rows, nodes, pairs, seed)
        root = labels.select("node", "root")
        between = links.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
        merged = components(between.select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"),
        )).select(F.col("root").alias("top"), F.col("node").alias("root"))
        # Old labels follow their root; roots that joined another class get a label.
        moved = labels.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = written(moved.unionByName(merged.select(F.col("root").alias("node"), F.col("top").alias("root"))), "join-labels")
        return labels, tested.unionByName(pairs)

    def _plausible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The (a, b) that the sketches let pass."""
        percent = self.percent
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

        def make():
            def f(batch: pa.RecordBatch) -> dict:
                both = Sketches([*batch.column("sketch_a").to_pylist(), *batch.column("sketch_b").to_pylist()])
                x, n = np.arange(batch.num_rows), (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                ok = pa.array(close_enough(percent, *n, both.least_difference(x, x + batch.num_rows)))
                return {"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)}

            return f

        return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b"), "a long, b long", make)


def _bucket(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([rows.column(c).to_numpy() for c in ("sig", "i", "j")], 1)


def _candidates(rows: pa.Table, percent: int, closest: bool) -> pa.RecordBatch:
    """Of whole buckets' blocks, sorted: pairs of different classes that the sketches let pass."""
    sig, i, j, part, node, root, n = (rows.column(c).to_numpy() for c in ("sig", "i", "j", "part", "node", "root", "n"))
    sketches = Sketches(rows.column("sketch").to_pylist())
    new = np.flatnonzero((np.diff(sig) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    start, bucket = np.concatenate([[0], new]), np.zeros(len(sig), np.int64)
    bucket[new] = 1
    bucket = np.cumsum(bucket)
    end = np.append(new, len(sig))[bucket]
    # A row meets the rows behind it, or all rows of the other block.
    lefts = np.bincount(bucket, part == i).astype(np.int64)
    begin = np.where(i == j, np.arange(len(sig)) + 1, np.where(part == i, (start + lefts)[bucket], end))
    upto = np.concatenate([[0], np.cumsum(end - begin)])
    out, lo = [np.zeros((3, 0), np.int64)], 0
    while lo < len(sig):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, side="right")) - 1)
        counts = (end - begin)[lo:hi]
        x = np.repeat(np.arange(lo, hi), counts)
        y = np.arange(len(x)) - np.repeat(upto[lo:hi] - upto[lo], counts) + begin[x]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        sizes = np.abs(n[x] - n[y])
        ok = close_enough(percent, n[x], n[y], sizes)
        x, y, sizes = x[ok], y[ok], sizes[ok]
        far = np.maximum(sketches.least_difference(x, y), sizes)
        ok = close_enough(percent, n[x], n[y], far)
        out.append(np.stack([x[ok], y[ok], far[ok]]))
        lo = hi
    x, y, far = np.concatenate(out, 1)
    of = bucket[x]
    taken, more = np.arange(len(x)), np.zeros(len(start), bool)
    if closest:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
        picked = []
        for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            forest = [0]
            if hi - lo > 1:
                own = slice(int(start[of[lo]]), int(end[x[lo]]))
                local = np.stack([x[lo:hi] - own.start, y[lo:hi] - own.start, far[lo:hi]], 1)
                forest = _forest(np.unique(root[own], return_inverse=True)[1], local)
                more[of[lo]] = len(forest) < hi - lo
            picked += [lo + k for k in forest]
        taken = np.array(picked, np.int64)
    x, y = x[taken], y[taken]
    ends = np.sort(np.stack([node[x], node[y]]), 0)
    return pa.RecordBatch.from_arrays([pa.array(ends[1]), pa.array(ends[0]), pa.array(sig[x], mask=~more[bucket[x]])], names=["a", "b", "sig"])


def _forest(label: np.ndarray, pairs: np.ndarray) -> list[int]:
    """Rows of `pairs` (x, y, distance) that join all classes they can join, the closest first.

    Each round every class takes its closest pair to another class; distances rank uniquely, so
    there are no cycles, and at most one row fewer than classes is taken.
    """
    order = np.argsort(pairs[:, 2], kind="stable")
    x, y = label[pairs[order, 0]], label[pairs[order, 1]]
    parent = list(range(int(label.max()) + 1))
    taken: list[int] = []

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    rank = np.arange(len(order))
    while len(rank):
        best = np.full(len(parent), len(order))
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        for r in np.unique(best[best < len(order)]).tolist():
            a, b = top(int(label[pairs[order[r], 0]])), top(int(label[pairs[order[r], 1]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                taken.append(int(order[r]))
        now = np.array([top(c) for c in range(len(parent))])
        x, y = now[x], now[y]
        apart = x != y
        x, y, rank = x[apart], y[apart], rank[apart]
    return taken


def one_of_each_class(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id is the smallest of their class, with the columns of `docs`; those without words stay.

    Where an id repeats, each of its texts is judged by its own class, and of its rows in one class one
    stays (which, isn't defined).  A null id stays only where its class has no other.
    """
    join = NgramJoin(words, percent)
    found = written(join.run(docs, id_col, text_col, named=True), "join-classes")
    ids = found.select(F.col(id_col).alias("id"), "n_shingles", "component_id", "node", "root")
    least = ids.filter(F.col("id").eqNullSafe(F.col("component_id")))
    rows = ids.groupBy("id").count()
    single = least.join(rows.filter("count = 1"), "id").select("id")
    own_id = col(id_col).cast("long")
    kept = docs.join(single, own_id == F.col("id"), "left_semi")
    several = rows.filter("count > 1 or id is null")
    if several.isEmpty():
        return kept
    again = docs.join(several, own_id.eqNullSafe(F.col("id")), "left_semi").select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), own_id.alias("id"), col(text_col).alias("text"),
    )

    seed = join.seed

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            sets = [shingle_set(t, words, seed) for t in texts(batch)]
            return {"row": batch.column("row"), "id": batch.column("id"), "own": [digest(s)[0] for s in sets], "n": [len(s) for s in sets]}

        return f

    schema = StructType([again.schema["row"], again.schema["id"]]).add("own", LongType()).add("n", LongType())
    named = arrow_map(again, schema, make)
    classes = least.filter("n_shingles > 0").select(F.col("id").alias("least_id"), "node", "root").distinct()
    worded = named.filter("n > 0").join(classes, (F.col("own") == F.col("node")) & F.col("id").eqNullSafe(F.col("least_id"))).dropDuplicates(["id", "root"])
    for part in (worded, named.filter("n = 0")):
        kept = kept.unionByName(part.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return kept


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(4, 85).run(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
