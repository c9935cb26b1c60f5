"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints within three bits, cut into two halves, have a half that
differs by at most one bit. Each distinct fingerprint is indexed by both halves
whole and by both halves with each one bit wild; an equality join on the variant
(opposite values of the wild bit) meets every such pair, and the pairs are
verified on all 64 bits. Documents meet only through distinct fingerprints, and
fingerprints of equal halves through one more exact index (see ``links``), so no
group is expanded into all of its pairs.

Null, empty and space-only texts have fingerprint zero and link like any other.
Rows may repeat: they share a component, and rows that share an identifier are
one document. A null identifier takes part in
linking, but is no component's name unless nothing else is in it (then null).
Extra columns are ignored or passed through. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, durable, fields, map_texts, texts, unused, with_results
from .components import components

#: A half shared by more fingerprints than this is split further; it bounds pairs tried for one fingerprint in one bucket.
CROWD = 64


def fingerprints(raw: list[bytes], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text as int64 bit patterns."""
    digest = xxhash.xxh64_digest
    out = np.zeros(len(raw), dtype=np.uint64)
    for r, b in enumerate(raw):
        w = b.translate(LOWER).split()
        if not w:
            continue
        if len(w) <= shingle:
            hashes = digest(b" ".join(w), 42)
        else:
            hashes = b"".join([digest(b"%b %b %b" % t, 42) for t in zip(w, w[1:], w[2:])] if shingle == 3 else [digest(b" ".join(t), 42) for t in zip(*(w[j:] for j in range(shingle)))])
        n = len(hashes) // 8
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8), axis=1)
        on = np.add.reduce(bits, axis=0, dtype=np.int64) * 2 > n
        out[r] = np.packbits(on).view(">u8")[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(identifier, fp) of each row."""
    out = with_results(docs, id_col, fields(fp=T.LongType()))

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(texts(b.column(1)), shingle))], names=out.names)

        return run

    return map_texts(docs.select(id_col, text_col), text_col, out, make)


def _near(a: str, b: str, most: int = 3) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct ``prints(fp, v)``: every pair within three bits is connected by them.

    Pairs with a half that differs in one bit meet on that bit's variant; if more
    than CROWD have the half, by looking up every fingerprint with at most one
    bit flipped in the other half, in those of the others. Pairs with an equal half H meet in the bucket of H; where more than CROWD
    fingerprints share H, they meet on the four bytes of the other half instead
    (three bits leave one byte equal), and where more than CROWD share H and
    that byte, by looking up every fingerprint at most three bits away with H
    and the byte fixed, in the pattern (one flip of it) = (two flips of the other).
    All of these are exact, and none tries more than a bounded number of pairs a fingerprint in one place.
    """
    half = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), h.alias("h"), o.alias("o")) for k, (h, o) in enumerate(_halves())]))
    sides = prints.select("fp", "v", half.alias("s")).select("fp", "v", "s.side", "s.h", "s.o")
    shared = durable(sides.groupBy("side", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # One wild bit: the side with the bit off meets the side with it on.
    wild = sides.select("fp", "v", "side", "h", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    wild = wild.select("fp", "v", F.expr("h & shiftleft(1L, bit)").alias("on"), F.expr("side * 32 + bit").cast("byte").alias("slot"), F.expr("(h & ~shiftleft(1L, bit)) - 2147483648L").cast("int").alias("rest"))
    # Where more than CROWD have one of the two halves, the other halves meet instead.
    many = shared.where(F.col("n") > CROWD).select("side", "h", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    many = many.select(F.expr("side * 32 + bit").cast("byte").alias("slot"), F.expr("(h & ~shiftleft(1L, bit)) - 2147483648L").cast("int").alias("rest")).distinct()
    wild = wild.join(many.withColumn("many", F.lit(True)), ["slot", "rest"], "left")
    crowded_wild = wild.where("many")
    wild = wild.where("many is null")
    off = wild.where("on = 0").select("slot", "rest", F.col("fp").alias("f1"), F.col("v").alias("a"))
    on = wild.where("on <> 0").select("slot", "rest", F.col("fp").alias("f2"), F.col("v").alias("b"))
    edges = off.join(on, ["slot", "rest"]).where(_near("f1", "f2")).select("a", "b")
    edges = edges.unionByName(_crowded_wild(crowded_wild))
    equal = durable(sides.join(shared, ["side", "h"]).select("fp", "v", F.expr("h * 2 + side").alias("k"), "o", "n"))
    edges = edges.unionByName(_pairs(equal.where(F.col("n") <= CROWD), ["k"]))
    crowded = equal.where(F.col("n") > CROWD).select("fp", "v", "k", "o", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at"))
    crowded = crowded.withColumn("byte", F.expr("shiftrightunsigned(o, at * 8) & 255"))
    sizes = crowded.groupBy("k", "at", "byte").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    crowded = crowded.join(sizes, ["k", "at", "byte"])
    edges = edges.unionByName(_pairs(crowded.where(F.col("m") <= CROWD), ["k", "at", "byte"]))
    dense = crowded.where(F.col("m") > CROWD).select("fp", "v", "k", "o").distinct()
    one = dense.select("fp", "v", "k", F.explode(F.array(F.col("o"), *[F.col("o").bitwiseXOR(F.lit(1 << i)) for i in range(32)])).alias("o"))
    flips = [0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i in range(32) for j in range(i))]
    two = dense.select("fp", "v", "k", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("o").bitwiseXOR(x))).alias("o"))
    met = one.select("k", "o", F.col("v").alias("a")).join(two.select("k", "o", F.col("v").alias("b")), ["k", "o"]).where("a < b")
    return edges.unionByName(met.select("a", "b"))


def _crowded_wild(rows: DataFrame) -> DataFrame:
    """Edges of (slot, rest, on, fp, v): the other halves differ in two bits at most, so some flip of one is some flip of the other."""
    low, high = (h for h, _ in _halves())
    other = F.when(F.col("slot") < 32, high).otherwise(low)
    flips = F.transform(F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]), lambda x: other.bitwiseXOR(x))
    each = rows.select("slot", "rest", "on", "v", F.explode(flips).alias("o"))
    off = each.where("on = 0").select("slot", "rest", "o", F.col("v").alias("a"))
    on = each.where("on <> 0").select("slot", "rest", "o", F.col("v").alias("b"))
    return off.join(on, ["slot", "rest", "o"]).select("a", "b")


def _halves() -> list[tuple]:
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return [(low, high), (high, low)]


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    left, right = rows.select(*keys, F.col("fp").alias("f1"), F.col("v").alias("a")), rows.select(*keys, F.col("fp").alias("f2"), F.col("v").alias("b"))
    return left.join(right, keys).where((F.col("a") < F.col("b")) & _near("f1", "f2")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row a document: fingerprint (hex), component_id (smallest identifier reachable), n_links.

    n_links counts the fingerprint's links to other fingerprints as the index found them.
    """
    prints = durable(with_fingerprint(docs, id_col, text_col, shingle))
    prints = prints.select(F.col(id_col).alias("id"), "fp")
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    # Fingerprints link, whoever has them; the smallest identifier of a component is looked for afterwards.
    edges = durable(links(distinct.select("fp", F.col("fp").alias("v"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n_links"))
    # The smallest fingerprint of a component has no root but itself.
    linked = distinct.join(degree.join(roots, "v", "left"), F.col("fp") == F.col("v")).select("fp", "least", F.coalesce("root", "fp").alias("root"), "n_links")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "root").select("fp", "component_id", "n_links")
    alone = distinct.join(degree, F.col("fp") == F.col("v"), "left_anti").select("fp", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named.unionByName(alone), "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id", "n_links")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One document of each component, all columns as they were: the one that names it.

    Rows without an identifier stay only where no row with one has their fingerprint.
    """
    named = near_duplicates(docs, id_col, text_col, shingle).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = durable(named.groupBy(F.col(id_col).alias("kept")).agg(F.count(F.lit(1)).alias("n")))
    (key,) = unused(docs, "kept")
    same = lambda some: docs.join(some.select(F.col("kept").alias(key)).hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col(key)), "left_semi")
    once, again = same(kept.where("n = 1")), kept.where("n > 1")
    if again.isEmpty():
        return once
    # Rows that repeat an identifier are one document: its first row by text.
    first = same(again).groupBy(F.col(id_col).alias("kept")).agg(F.min_by(F.struct("*"), F.coalesce(text_col, F.lit(""))).alias("r")).select("r.*")
    return once.unionByName(first)
