"""Document fingerprints: SimHash of 128 bits, in DataFrame functions only.

Each pair of successive words is a term; its hash of 64 bits, and a hash of that, vote
on every bit, once for each time it stands in the text, so a term's weight is its frequency.  A bit is set if more
than half of the weight votes for it.  Votes are counted four bits to a 64-bit sum, two for
long texts (the parts can't overflow below 2**15 and 2**31 terms), so a text is one row
of 32 or 64 sums after the map-side aggregation and never a row per bit.

``near_pairs`` finds all pairs of fingerprints within a Hamming radius by permuted
block tables: the bits are cut into more blocks than the radius; of two fingerprints
within it, some choice of blocks agrees, and the tables hold one key for each choice.
``neighbours`` serves a wider radius: fewer, longer parts, of which one nearly agrees.

Edge cases: null texts count as empty; texts without words have the fingerprint of
zeros; a text of one word is one term; equal texts have equal fingerprints; rows that
share a doc_id follow each other by a hash of their text; rows without doc_id come
first, by that hash; a single document is its own next one; very long texts are counted
whole, a term at a time; an empty table gives an empty result; other columns, also of
the names used here, play no part.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import Stage, table

#: Ids of one window group, rows that make a group hot, and narrow rows that a join may broadcast.
GROUP_IDS, HOT_ROWS, BROADCAST_IDS = 2048, 20_000, 500_000
#: Bits within which fingerprints count as near, and parts that they are cut into to find them.  At sf0.1 the pairs
#: of different texts with five-word similarity 0.8 or more are 4 to 19 bits apart, unlike texts seldom under 40.
RADIUS, PARTS = 20, 7
#: Texts of so many bytes have less than 2 ** 15 words.
SHORT_BYTES = 65_000


def terms(text: Column) -> Column:
    """The words of a text, which part at ASCII white space."""
    return F.array_remove(F.split(text, r"[\t-\r ]+"), "")


def pair_hashes(words: Column) -> Column:
    """A hash for each pair of successive words; of one word, its own."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(words[i], words[i + 1]))
    return F.when(F.size(words) > 1, pairs).when(F.size(words) == 1, F.array(F.xxhash64(words[0])))


def fingerprints(rows: DataFrame, text: str, keep: list[str], prefix: str = "") -> DataFrame:
    """``keep`` and the two halves ``{prefix}hi``, ``{prefix}lo`` of each row's fingerprint; rows equal in ``keep`` are one.

    Texts that can't have more terms than a quarter of a sum can count are counted four bits to a sum, longer ones two.
    """
    short = F.octet_length(F.coalesce(text, F.lit(""))) <= SHORT_BYTES
    return counted(rows.where(short), text, keep, prefix, 4).union(counted(rows.where(~short), text, keep, prefix, 2))


def counted(rows: DataFrame, text: str, keep: list[str], prefix: str, lanes: int) -> DataFrame:
    """Fingerprints by votes of ``lanes`` bits to a 64-bit sum."""
    width = 64 // lanes
    ones = F.lit(sum(1 << width * j for j in range(lanes)))
    worded = rows.select(*keep, terms(F.col(text)).alias("_w")).select(*keep, pair_hashes(F.col("_w")).alias("_p"))
    votes = worded.select(*keep, F.explode_outer("_p").alias("_x")).withColumn("_y", F.when(F.col("_x").isNotNull(), F.xxhash64("_x", F.lit(7))))
    sums = [F.sum(F.shiftright(f"_{h}", k).bitwiseAND(ones)).alias(f"_{h}{k}") for h in "xy" for k in range(width)]
    total = votes.groupBy(*keep).agg(F.count("_x").alias("_n"), *sums)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            votes_for = F.shiftrightunsigned(f"_{h}{bit % width}", bit // width * width).bitwiseAND(F.lit((1 << width) - 1))
            out = out.bitwiseOR(F.when(2 * votes_for > F.col("_n"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keep, half("x").alias(f"{prefix}hi"), half("y").alias(f"{prefix}lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def apart(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, mark) with ``grp, sub``, by which the order by doc_id and mark can be cut into parts.

    A group is a range of GROUP_IDS ids, or all rows without one.  Groups of more than
    HOT_ROWS rows, such as many rows of one id or of none, are cut further by id and by
    the first bits of the mark, which spread evenly and keep the order.
    """
    rows = docs.withColumn("grp", F.coalesce(F.floor(F.col("doc_id") / GROUP_IDS), F.lit(-(1 << 62))))
    hot = rows.groupBy("grp").agg(F.count("*").alias("m")).where(F.col("m") > HOT_ROWS).select("grp", F.lit(True).alias("hot"))
    n = hot.count()
    if not n:
        return rows.withColumn("sub", F.lit(0).cast("long"))
    hot = F.broadcast(hot) if n <= BROADCAST_IDS else hot  # a row for HOT_ROWS rows at least
    place = F.coalesce(F.pmod("doc_id", F.lit(GROUP_IDS)), F.lit(0))
    fine = F.shiftleft(place.cast("long"), 20) + F.shiftright("mark", 44) + (1 << 19)  # a signed mark's first 20 bits
    return rows.join(hot, "grp", "left").withColumn("sub", F.when(F.col("hot"), fine).otherwise(F.lit(0).cast("long"))).drop("hot")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text`` and ``next_id, next_mark, next_text`` of the next row by doc_id, after the last the first.

    The first row of each part is also sent to the part before, so that one exchange of
    the texts is enough.  Of the next text only the beginning that the edit takes goes on.
    """
    rows = groups(docs)
    key = F.struct("doc_id", "mark")
    firsts = rows.groupBy("grp", "sub").agg(F.min(key).alias("f"))
    order = Window.orderBy("grp", "sub")  # one narrow row for each part
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag(F.struct("grp", "sub")).over(order), F.last(F.struct("grp", "sub")).over(every))
    firsts = firsts.withColumn("to", to).select(F.col("grp").alias("g"), F.col("sub").alias("s"), F.col("f.doc_id").alias("d"), F.col("f.mark").alias("m"), "to")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts
    moved = rows.join(firsts, (rows["grp"] == firsts["g"]) & (rows["sub"] == firsts["s"]) & rows["doc_id"].eqNullSafe(firsts["d"]) & (rows["mark"] == firsts["m"]), "inner")
    # of rows equal in id and text any one will do; only the first is used
    moved = moved.select("doc_id", "mark", "text", F.col("to.grp").alias("grp"), F.col("to.sub").alias("sub"), F.lit(1).alias("extra"))
    both = rows.select("doc_id", "mark", "text", "grp", "sub", F.lit(0).alias("extra")).union(moved)
    w = Window.partitionBy("grp", "sub").orderBy("extra", F.col("doc_id").asc_nulls_first(), "mark")
    nxt = F.lead(F.struct("doc_id", "mark", "text")).over(w)
    led = both.withColumn("nxt", nxt).withColumn("nth", F.row_number().over(w)).where("extra = 0")
    return led.select("doc_id", "mark", "text", "grp", "sub", "nth", F.col("nxt.doc_id").alias("next_id"), F.col("nxt.mark").alias("next_mark"), F.col("nxt.text").alias("next_text"))


def block_keys(prints: DataFrame, radius: int, spare: int) -> DataFrame:
    """``prints`` with ``key``, once for each permuted table: each table keys on ``spare`` of ``radius + spare`` blocks.

    Two fingerprints within the radius differ in at most ``radius`` blocks, so the other
    ``spare`` agree and the pair meets in that table.
    """
    n = radius + spare
    cuts = [128 * k // n for k in range(n + 1)]
    bits = F.concat(F.lpad(F.bin("hi"), 64, "0"), F.lpad(F.bin("lo"), 64, "0"))
    keys = [F.xxhash64(F.lit(k), *(F.substring("_bits", cuts[c] + 1, cuts[c + 1] - cuts[c]) for c in chosen)) for k, chosen in enumerate(combinations(range(n), spare))]
    return prints.withColumn("_bits", bits).withColumn("key", F.explode(F.array(*keys))).drop("_bits")


def near_pairs(prints: DataFrame, radius: int = 3, spare: int = 2) -> DataFrame:
    """Pairs ``a, b, distance`` of distinct fingerprints (hi, lo) within ``radius``, as their texts."""
    tables = block_keys(prints.select("hi", "lo").distinct(), radius, spare)
    left, right = (tables.select("key", *(F.col(c).alias(f"{c}{s}") for c in ("hi", "lo"))) for s in "12")
    d = apart(F.col("hi1"), F.col("lo1"), F.col("hi2"), F.col("lo2"))
    met = left.join(right, "key").where("hi1 < hi2 or (hi1 = hi2 and lo1 < lo2)").withColumn("distance", d).where(F.col("distance") <= radius)
    return met.select(as_text(F.col("hi1"), F.col("lo1")).alias("a"), as_text(F.col("hi2"), F.col("lo2")).alias("b"), "distance").distinct()


def part(hi: Column, lo: Column, start: int, end: int) -> Column:
    """Bits ``start`` to ``end`` of a fingerprint, counted from its lowest."""
    if start >= 64:
        bits = F.shiftrightunsigned(hi, start - 64)
    else:
        bits = F.shiftrightunsigned(lo, start)
        bits = bits.bitwiseOR(F.shiftleft(hi, 64 - start)) if end > 64 else bits
    return bits.bitwiseAND(F.lit((1 << end - start) - 1).cast("long"))


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """``hi, lo, n``: for each distinct fingerprint of ``queries`` the sum of ``m`` over ``prints`` (hi, lo, m) within ``radius``, itself included.

    Two fingerprints within the radius differ in at most ``radius // parts`` bits of some
    part.  The queries ask for every value that near to each of their parts, so ``prints``
    stand once for each part only; a pair counts in the first part in which it meets.
    """
    cuts = [128 * k // parts for k in range(parts + 1)]
    most = radius // parts
    asked_keys, base_keys = [], []
    for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
        flips = [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(end - start), n)]
        flips = F.expr(f"array({', '.join(f'{x}L' for x in flips)})")
        named = lambda v, k=k: F.struct(F.lit(k).alias("part"), v.alias("value"))
        own = part(F.col("hi"), F.col("lo"), start, end)
        asked_keys.append(F.transform(flips, lambda x: named(own.bitwiseXOR(x))))  # noqa: B023
        base_keys.append(named(own))
    asked = queries.select("hi", "lo").distinct().select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.explode(F.concat(*asked_keys)).alias("_k"))
    base = prints.select("hi", "lo", "m", F.explode(F.array(*base_keys)).alias("_k"))
    asked, base = (df.select("*", "_k.part", "_k.value").drop("_k") for df in (asked, base))
    hi, lo = F.col("q_hi").bitwiseXOR(F.col("hi")), F.col("q_lo").bitwiseXOR(F.col("lo"))
    # the probes outgrow what the planner expects of a table this small, so none is broadcast
    near = asked.hint("merge").join(base, ["part", "value"]).where(F.bit_count(hi) + F.bit_count(lo) <= radius)
    first = F.lit(None).cast("int")
    for k in reversed(range(parts)):
        first = F.when(F.bit_count(part(hi, lo, cuts[k], cuts[k + 1])) <= most, F.lit(k)).otherwise(first)
    return near.where(F.col("part") == first).groupBy("q_hi", "q_lo").agg(F.sum("m").alias("n")).select(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo"), "n")


def with_neighbours(out: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """``out`` with ``n_near``: how many other rows have a fingerprint within ``radius``, for rows whose doc_id is divisible by ``every``; else null.

    Equal fingerprints count as one with a multiplicity, so a group of copies isn't expanded.
    """
    halves = [F.conv(F.substring("fingerprint", p, 16), 16, -10).cast("long") for p in (1, 17)]
    out = Stage(out.sparkSession, "neighbours").put(out.withColumn("_hi", halves[0]).withColumn("_lo", halves[1]), "rows")
    prints = out.groupBy(F.col("_hi").alias("hi"), F.col("_lo").alias("lo")).agg(F.count("*").alias("m"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = neighbours(out.where(asks).select(F.col("_hi").alias("hi"), F.col("_lo").alias("lo")), prints, radius)
    joined = out.withColumn("_asks", asks).join(found, asks & (F.col("_hi") == F.col("hi")) & (F.col("_lo") == F.col("lo")), "left")
    return joined.withColumn("n_near", F.when(F.col("_asks"), F.col("n") - 1)).drop("_hi", "_lo", "_asks", "hi", "lo", "n")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to it and to the next row's."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    stage = Stage(docs.sparkSession, "simhash")
    own = stage.put(fingerprints(rows, "text", ["doc_id", "mark"]), "own")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    led = with_next(rows).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    led = led.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keep = ["doc_id", "mark", "grp", "sub", "nth", "next_id", "next_mark", "n_chars", "edited_sha256"]
    seen = fingerprints(led, "edited", keep, "e_")
    nxt = own.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    mine = own.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "hi", "lo")
    out = seen.join(mine, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).drop("d", "m")
    out = out.join(nxt, F.col("next_id").eqNullSafe(F.col("d")) & (F.col("next_mark") == F.col("m"))).drop("d", "m")
    like = lambda hi, lo: 1 - apart(F.col("hi"), F.col("lo"), F.col(hi), F.col(lo)) / 128
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("hi"), F.col("lo")).alias("fingerprint"), as_text(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"), like("e_hi", "e_lo").alias("near_edited"), like("n_hi", "n_lo").alias("near_next"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(compare_edited(table(spark, sf_dir, "documents")))
