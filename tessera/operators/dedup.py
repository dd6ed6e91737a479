"""Exact and near duplicates.

Near duplicates: MinHash signatures over character 5-grams, banding, candidates verified by the estimated Jaccard
similarity, clusters by connected components, the survivor being the smallest id. Texts with equal signatures (all
copies among them) are one node from the start, so a text that a third of all rows repeat makes neither a large
bucket nor pairs; candidates are made between distinct signatures only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.runtime import salted_join, spread, staged

#: Permutations, bands and rows a band for a threshold of 0.85 on the estimated similarity: a pair at the threshold shares a
#: bucket with probability 1 - (1 - 0.85 ** 8) ** 16 = 0.99. Candidates are verified, so short bands cost time only.
PERMUTATIONS, BANDS, ROWS, THRESHOLD, SHINGLE = 128, 16, 8, 0.85, 5

_PRIME = (1 << 31) - 1
_BASE = 1_000_003  # of the polynomial over code points that hashes a shingle


def permutation(i: int) -> tuple[int, int]:
    """Factor and addend of the i-th permutation of the hash values, below the prime 2 ** 31 - 1."""
    return 1 + (i + 1) * 48_271 * 7_919 % (_PRIME - 1), (i + 7) * 69_621 * 104_729 % _PRIME


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = np.array([permutation(i)[0] for i in range(PERMUTATIONS)], dtype=np.int64)
    addends = np.array([permutation(i)[1] for i in range(PERMUTATIONS)], dtype=np.int64)
    for batch in batches:
        out = np.zeros((batch.num_rows, PERMUTATIONS), dtype=np.int64)
        for r, (plain, word) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            grams = len(plain) >= 2 * SHINGLE - 1  # at least SHINGLE shingles; else the first word stands for the text
            codes = np.frombuffer((plain if grams else word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            width = SHINGLE if grams else len(codes)
            h = np.zeros(len(codes) - width + 1, dtype=np.int64)
            for k in range(width):
                h = (h * _BASE + codes[k : k + len(h)]) % _PRIME
            h = np.unique(h)
            least = np.full(PERMUTATIONS, _PRIME, dtype=np.int64)
            for a in range(0, len(h), 512):  # a block stays in the processor's cache
                x = h[a : a + 512, None] * factors
                x += addends
                for _ in range(2):  # modulo 2 ** 31 - 1 without division
                    high = x >> 31
                    x &= _PRIME
                    x += high
                x[x >= _PRIME] -= _PRIME
                np.minimum(least, x.min(axis=0), out=least)
            out[r] = least
        flat = pa.array(out.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PERMUTATIONS, dtype=np.int32)), flat)], names=["id", "signature"])


def minhash_signatures(df: DataFrame, id_column: str, text: Column) -> DataFrame:
    """``id, signature`` (128 numbers) of every text.

    A text of fewer than 5 shingles is represented by its first word, a blank one by a space. NULL counts as ''.
    """
    whole = F.coalesce(text, F.lit(""))
    first = F.coalesce(F.try_element_at(T.words(whole), F.lit(1)), F.lit(" "))
    return spread(df.select(F.col(id_column).cast("long").alias("id"), T.normalised(whole).alias("plain"), first.alias("word"))).mapInArrow(_signatures, "id long, signature array<long>")


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / PERMUTATIONS


class NearDuplicates:
    """Signatures, links and clusters of one table."""

    def __init__(self, df: DataFrame, id_column: str, text: Column, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.signed = staged(minhash_signatures(df, id_column, text).withColumn("key", F.md5(F.array_join("signature", ","))))
        # membership by a join on the partially aggregated minimum, not by a window: a key may hold a third of all rows
        least = self.signed.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        self.members = staged(salted_join(self.signed.select("id", "key"), staged(least), ["key"], "n", F.col("id")).select("id", "rep"))
        distinct = self.signed.join(self.members.where("id = rep").select("id"), "id").dropDuplicates(["id"])
        self.distinct = staged(distinct.select("id", "signature"))
        bands = self.distinct.select(
            "id",
            F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.md5(F.array_join(F.slice("signature", b * ROWS + 1, ROWS), ",")))).alias("band", "bucket"),
        )
        self.bands = staged(bands)

    def _verified(self, candidates: DataFrame) -> DataFrame:
        left = self.distinct.select(F.col("id").alias("lo"), F.col("signature").alias("a"))
        right = self.distinct.select(F.col("id").alias("hi"), F.col("signature").alias("b"))
        scored = candidates.distinct().join(left, "lo").join(right, "hi").select("lo", "hi", estimated_jaccard(F.col("a"), F.col("b")).alias("similarity"))
        return scored.where(F.col("similarity") >= self.threshold)

    def pairs(self) -> DataFrame:
        """``lo, hi, similarity``: every verified pair of distinct signatures that share a bucket."""
        other = self.bands.select("band", "bucket", F.col("id").alias("lo"))
        return self._verified(self.bands.withColumnRenamed("id", "hi").join(other, ["band", "bucket"]).where("lo < hi").select("lo", "hi"))

    def links(self) -> DataFrame:
        """``lo, hi``: verified pairs that connect whatever ``pairs`` connects, without making all pairs of a bucket.

        Every member of a bucket is compared with the bucket's first. Those alike are connected by it and needn't be
        compared with each other; only the others, few as a rule, are compared with the whole bucket.
        """
        leaders = self.bands.groupBy("band", "bucket").agg(F.min("id").alias("lo"), F.max("id").alias("last")).where("lo < last").drop("last")
        seated = staged(self.bands.withColumnRenamed("id", "hi").join(leaders, ["band", "bucket"]).where("lo < hi"))
        alike = staged(self._verified(seated.select("lo", "hi")).select("lo", "hi"))
        apart = seated.join(alike, ["lo", "hi"], "left_anti").select("band", "bucket", F.col("hi").alias("x"))
        rest = apart.join(self.bands, ["band", "bucket"]).where("x <> id").select(F.least("x", "id").alias("lo"), F.greatest("x", "id").alias("hi"))
        return alike.unionByName(self._verified(rest).select("lo", "hi")).distinct()

    def clusters(self) -> DataFrame:
        """``id, cluster``: the smallest id of each row's cluster."""
        roots = connected_components(self.links(), "lo", "hi")
        return self.members.join(roots, self.members["rep"] == roots["id"], "left").select(self.members["id"], F.coalesce("component", "rep").alias("cluster"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``id, component`` (smallest id) of every vertex of the edges, by alternating large-star and small-star.

    Each round halves paths and only touches edges, so it takes a number of rounds logarithmic in the diameter; the
    vertex of a hub meets its neighbours by aggregation and joins, never in one group. What isn't done after
    ``max_rounds`` raises RuntimeError.
    """
    pairs = staged(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        """Number and checksums of a set of distinct edges."""
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    before = mark(pairs)
    for _ in range(max_rounds):
        # large star: each vertex hands its smallest neighbour to its larger neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each vertex hands its smallest neighbour to its smaller neighbours and itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = staged(small)
        after = mark(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components aren't settled after {max_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def near_duplicate_clusters(df: DataFrame, id_column: str, text: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``id, cluster`` of every row; ``cluster`` is the smallest id of its near-duplicate cluster."""
    return NearDuplicates(df, id_column, text, threshold).clusters()


def keep_first(df: DataFrame, key: Column, order: str, columns: list[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` of each key, by an aggregation that combines before the shuffle.

    Only ``columns`` (all by default) come out and are shuffled, whatever the key is made of. Ties of ``order`` keep the
    row whose columns are least. NULL keys are one key.
    """
    columns = columns or df.columns
    narrow = df.select(key.alias("_key"), F.struct(F.col(order).alias("_order"), *[F.col(c) for c in columns]).alias("_row"))
    return narrow.groupBy("_key").agg(F.min("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])
