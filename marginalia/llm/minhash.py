"""Near-duplicate detection: banded MinHash, odd sketches, exact confirmation.

Texts with equal shingle sets form a class at once.  Classes that share a MinHash band
are candidates.  Odd sketches, parity bitmaps, tell most candidates apart without
their sets: the XOR of two of them, counted, gives the size of a symmetric difference.
One folds the MinHash samples and estimates the similarity; the other folds the whole
set, where the count can only fall short of the difference, so that it never loses a
link.  What is left is compared on full sets.

Only the components matter, so the pairs of a bucket aren't all formed.  First each
class of a bucket is compared with the bucket's smallest class; linked classes become
one component.  Then only classes of one bucket that are still in different components
are compared, in blocks of bounded size: those outside the bucket's largest component
with each other and with it.  Pairs that pass both sketches are confirmed.  Every
candidate pair thus ends in one component or was compared.

With 36 bands of 8 rows a link of similarity 0.85 fails to be a candidate with a
chance of about 1 in 100,000, one of 0.9 with 1 in 10**9.

Edge cases: null and empty texts, and texts without words, have the empty set and are
linked with nothing; a row whose doc_id stands in other rows too is placed by its own
text; rows without doc_id have no component and aren't kept; very long texts are
shingled whole, a batch at a time; an empty table gives an empty result; other columns,
also of the names used here, play no part.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, small_batches, table
from marginalia.llm.shingles import Shingler, mix
from marginalia.plans.components import connected_components, splittable_join

#: Ids that a semi-join may broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Classes of one block of a large bucket.
BLOCK = 1000


@dataclass(frozen=True)
class Setting:
    """Shingle width, threshold in hundredths, bands and rows, bits of the two sketches."""

    width: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 7
    sample_bits: int = 512
    set_bits: int = 512  # at least; doubled up to 16 times for large sets

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_apart(self) -> int:
        """XOR count of sample sketches that a pair at the threshold exceeds with a chance of some 1e-7."""
        j, n, k = self.percent / 100, self.sample_bits, self.samples
        far = min(1.0, 1 - j + 5.2 * (j * (1 - j) / k) ** 0.5)
        mean = n / 2 * (1 - (1 - 2 / n) ** (2 * k * far))
        return int(mean + 3 * (mean * (1 - mean / n)) ** 0.5 * 0.5) + 1


#: The contract's three words and 0.85; the default, five words and 0.8, is the pipeline's.
CONTRACT = Setting(width=3, percent=85, bands=36, rows=8)


@functools.lru_cache(maxsize=4)
def _tables(samples: int, width: int):
    rng = np.random.default_rng(samples)
    a = rng.integers(1, 2**32, samples, np.uint32, endpoint=False) | np.uint32(1)
    b = rng.integers(0, 2**32, samples, np.uint32, endpoint=False)
    return a[:, None], b[:, None], Shingler(width)


def parity(numbers: np.ndarray, bits: int) -> np.ndarray:
    """The odd sketch: bit i is the parity of how many numbers fall on it; as 64-bit words."""
    odd = (np.bincount((numbers & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sign(found: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, the sketch of the MinHash samples, the sketch of the whole set."""
    a, b, _ = _tables(s.samples, s.width)
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(s.samples, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):  # blocks that stay in cache
        np.minimum(least, (a * low[None, i : i + 2048] + b).min(1), out=least)
    m = mix(least.astype(np.uint64) + (np.arange(s.samples, dtype=np.uint64) << np.uint64(32)))
    keys = np.arange(1, s.bands + 1, dtype=np.uint64)
    for column in m.reshape(s.bands, s.rows).T:
        keys = mix(keys + column)
    bits = s.set_bits
    while bits < len(found) and bits < 16 * s.set_bits:
        bits *= 2
    return keys, parity(m, s.sample_bits), parity(mix(found), bits)


def signatures(docs: DataFrame, s: Setting, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, n_shingles, fa, fb, bands, sample, whole`` of each row; the last three null for the empty set; ``mark`` is a hash of the text."""
    longs = pa.list_(pa.int64())
    out = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("bands", longs), ("sample", longs), ("whole", longs)])

    def run(batches):
        shingler = _tables(s.samples, s.width)[2]
        for b in batches:
            rows: list[tuple] = []
            for t in b.column(1).to_pylist():
                found = shingler.shingles(t)
                fa, fb = (int(mix(found + np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (1, 2))
                rows.append((len(found), fa, fb, *(x.view(np.int64) for x in sign(found, s))) if len(found) else (0, 0, 0, None, None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[2:]))], schema=out) if rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in out], schema=out)

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("mark")).mapInArrow(run, "doc_id long, mark long, n_shingles long, fa long, fb long, bands array<long>, sample array<long>, whole array<long>")


def shingle_sets(docs: DataFrame, s: Setting, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, items array<long>``: the full set of each row, and a hash of it."""
    out = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        shingler = _tables(s.samples, s.width)[2]
        for b in batches:
            sets = [shingler.shingles(t) for t in b.column(1).to_pylist()]
            marks = [int(mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64()), pa.array([x.view(np.int64) for x in sets], out.field(2).type)], schema=out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, mark long, items array<long>")


def _pop(x: str, y: str, words: int):
    """Set bits of the XOR of two arrays, of which the longer is folded to ``words``."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return total


def _fold(column: str, words: int):
    """A sketch of more words folded to fewer: the XOR of its parts."""
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(F.filter(column, lambda _, k: k % words == i), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))


def _confirm(stage: Stage, docs: DataFrame, pairs: DataFrame, s: Setting, name: str, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    pairs = stage.put(pairs, f"{name}-pairs")
    ids = stage.put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = stage.put(shingle_sets(docs.join(wanted, docs[id_col] == ids["id"], "left_semi"), s, id_col, text_col).dropDuplicates(["doc_id", "mark"]), f"{name}-sets")
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("a_items", "b_items")))
    linked = both.where(100 * F.col("shared") >= s.percent * (F.size("a_items") + F.size("b_items") - F.col("shared")))
    out = stage.put(linked.select("a", "b").distinct(), f"{name}-links")
    stage.drop(f"{name}-sets")
    return out


def _compare(batches, s: Setting):
    """From rows sorted by (key, i, j), the pairs of each group that both sketches let pass."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    most, words = s.most_apart, s.set_bits // 64

    def group(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        comp = rows["comp"]
        names, inverse, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        first = np.flatnonzero(inverse != sizes.argmax())  # pairs inside the largest component needn't be compared
        a_out, b_out = [], []
        across = rows["i"][0] != rows["j"][0]
        for at in range(0, len(first), 64):
            f = first[at : at + 64]
            ok = comp[f][:, None] != comp[None, :]
            if across:
                ok &= rows["own"][f][:, None] != rows["own"][None, :]
            na, nb = rows["n"][f][:, None], rows["n"][None, :]
            ok &= 100 * np.minimum(na, nb) >= s.percent * np.maximum(na, nb)
            least_first = (inverse[f] != sizes.argmax())[:, None] & (inverse != sizes.argmax())[None, :]
            ok &= ~least_first | (rows["rep"][f][:, None] < rows["rep"][None, :])  # each pair once
            x, y = np.nonzero(ok)
            x = f[x]
            keep = np.bitwise_count(rows["sample"][x] ^ rows["sample"][y]).sum(1, dtype=np.int64) <= most
            x, y = x[keep], y[keep]
            limit = (100 - s.percent) * (rows["n"][x] + rows["n"][y]) // (100 + s.percent)
            keep = np.bitwise_count(rows["folded"][x] ^ rows["folded"][y]).sum(1, dtype=np.int64) <= limit
            x, y = x[keep], y[keep]
            keep = np.array([parts_apart(rows["whole"][p], rows["whole"][q]) <= n for p, q, n in zip(x, y, limit[keep])], bool)
            x, y = x[keep], y[keep]
            if len(x):
                here = (rows["bands"][x] == rows["bands"][y]).argmax(1) == rows["band"][0]  # a pair of many bands comes from its first
                x, y = x[here], y[here]
                a_out.append(rows["rep"][x])
                b_out.append(rows["rep"][y])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(a_out or none), np.concatenate(b_out or none)

    def parts_apart(p: np.ndarray, q: np.ndarray) -> int:
        n = min(len(p), len(q))
        return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, n)) ^ np.bitwise_xor.reduce(q.reshape(-1, n))).sum())

    def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        got = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "own", "band", "rep", "comp", "n")}
        for c, wide in (("bands", s.bands), ("sample", s.sample_bits // 64)):
            got[c] = b.column(c).flatten().to_numpy().view(np.uint64).reshape(-1, wide)
        got["whole"] = np.empty(b.num_rows, object)
        for k, v in enumerate(b.column("whole").to_pylist()):
            got["whole"][k] = np.array(v, np.int64).view(np.uint64)
        got["folded"] = np.array([np.bitwise_xor.reduce(v.reshape(-1, words)) for v in got["whole"]], np.uint64).reshape(-1, words)
        return got

    def emit(rows):
        a, b = group(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = columns(b)
        change = np.flatnonzero((np.diff(cols["key"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            part = {c: v[lo:hi] for c, v in cols.items()}
            if held and lo == 0 and all(held[-1][c][-1] == part[c][0] for c in ("key", "i", "j")):
                held.append(part)
                continue
            if held:
                yield emit({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held = [part]
    if held:
        yield emit({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def near_duplicates(docs: DataFrame, s: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row, and ``mark``, its text's hash, if asked for; see the module's text."""
    spark = docs.sparkSession
    stage = Stage(spark, "minhash")
    signed = stage.put(signatures(docs, s, id_col, text_col), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    best = F.min_by(F.struct("n_shingles", "bands", "sample", "whole"), "doc_id").alias("x")
    classes = stage.put(usable.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), best).select("fa", "fb", "rep", "size", "x.*"), "classes")
    entries = classes.select("rep", F.posexplode("bands").alias("band", "key"))

    # 1. each class against the smallest of its buckets
    hubs = entries.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub")
    star = splittable_join(entries, hubs, "key").where("rep <> hub").select(F.col("rep").alias("b"), F.col("hub").alias("a")).distinct()
    words = s.set_bits // 64
    slim = classes.select("rep", "n_shingles", "sample", F.when(F.size("whole") == words, F.col("whole")).otherwise(_fold("whole", words)).alias("whole"))
    sides = [slim.select(F.col("rep").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n_shingles", "sample", "whole"))) for c in "ab"]
    met = star.join(sides[0], "a").join(sides[1], "b")
    alike = 100 * F.least("a_n_shingles", "b_n_shingles") >= s.percent * F.greatest("a_n_shingles", "b_n_shingles")
    near = _pop("a_sample", "b_sample", s.sample_bits // 64) <= s.most_apart
    sure = _pop("a_whole", "b_whole", words) * (100 + s.percent) <= (100 - s.percent) * (F.col("a_n_shingles") + F.col("b_n_shingles"))
    first = _confirm(stage, docs, met.where(alike & near & sure).select("a", "b"), s, "star", id_col, text_col)
    one = stage.put(connected_components(first, stage.put, stage.drop), "one")

    # 2. what is left between different components of one bucket
    placed = entries.join(one.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "band", "key", F.coalesce("component", "rep").alias("comp"))
    placed = stage.put(splittable_join(placed, hubs.select("key"), "key", "left_semi"), "placed")
    # pairs inside the largest component of a bucket needn't be compared, so its members (blocks from ``na`` on) meet
    # only blocks of the others (0 to ``na`` - 1), which meet each other too
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top"))
    n_blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    # a bucket of one block's size is one block, which leaves out the pairs inside the largest component itself
    one_block = F.col("m") <= BLOCK
    mixed = sizes.where("comps > 1").select("key", F.col("top.comp").alias("big"), F.when(one_block, 1).otherwise(n_blocks(F.col("m") - F.col("top.m"))).alias("na"), F.when(one_block, 0).otherwise(n_blocks(F.col("top.m"))).alias("nb"))
    member = splittable_join(placed, mixed, "key").withColumn("h", F.xxhash64("rep", F.lit(5)))
    in_big = (F.col("comp") == F.col("big")) & (F.col("nb") > 0)
    member = member.withColumn("own", F.when(in_big, F.col("na") + F.pmod("h", F.greatest("nb", F.lit(1)))).otherwise(F.pmod("h", "na")).cast("int"))
    last = F.when(in_big, F.col("na")).otherwise(F.col("na") + F.col("nb")) - 1
    spread = member.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("key", "band", "rep", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = spread.join(classes.select("rep", F.col("n_shingles").alias("n"), "bands", "sample", "whole"), "rep")
    dealt = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(lambda batches: _compare(batches, s), "a long, b long").distinct()
    second = _confirm(stage, docs, pairs, s, "rest", id_col, text_col)
    a, b = (one.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp")) for c in "ab")
    across = second.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    two = stage.put(connected_components(across, lambda df, name: stage.put(df, f"two-{name}"), lambda name: stage.drop(f"two-{name}")), "two")

    # 3. back to the rows
    rep_one = classes.select("fa", "fb", "rep", "size").join(one.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c1", F.coalesce("component", "rep")).drop("component")
    rep_two = rep_one.join(two.withColumnRenamed("node", "c1"), "c1", "left").withColumn("c", F.coalesce("component", "c1"))
    moved = rep_two.where("size > 1 or c <> rep").select("fa", "fb", "c")
    out = signed.select("doc_id", "mark", "n_shingles", "fa", "fb").join(moved, ["fa", "fb"], "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), comp)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"), *(["mark"] if marked else []))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
