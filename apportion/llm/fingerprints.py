"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

Each paragraph (a stretch between line feeds) has a wide vector: EXACT lanes of
32 bits from xxhash64 under four seeds, and LANES counters that tell how many
hashes of its five-word shingles have a given bit set (a paragraph of one to
four words counts as one shingle). A document's fingerprint is the sum of its
paragraphs' vectors, the exact lanes modulo 2**32 and the counters modulo 2**31.
So it does not depend on the paragraphs' order, and a paragraph is inserted or
deleted by adding or subtracting its vector (``combine``).

Equality of texts up to paragraph order shows in the exact lanes. The counters
are a projection of the shingle counts onto random signs, so the cosine of two
centred counter vectors estimates the cosine of the two documents' shingle
counts, with a standard error of about LANES ** -0.5.

Defined cases: a null text is empty; an empty text has one empty paragraph, all
counters 0 and likeness 1 to an equal fingerprint, else 0. Rows with a null
doc_id come after all others. Rows with equal doc_id are separate documents, in
the order of the hash of their text. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.llm.common import let, plain, words, write_table

EXACT, LANES, SHINGLE = 8, 64, 5
#: doc_ids whose upper bits agree share a bucket of at most so many ids.
BUCKET_BITS = 6
#: Buckets whose upper bits agree are put in order together; only one row for each such set meets in one task.
SUPER_BITS = 14
#: Most rows of two numbers that are sent to all tasks.
FEW = 200_000
_LOW32 = 0xFFFFFFFF
_PAIR = (1 << 31) | 1  # one counter at bit 0, one at bit 31


def exact_lanes(text: Column) -> Column:
    """The exact lanes as 64 hex digits."""

    def lane(paragraphs: Column, seed: int, shift: int) -> Column:
        each = F.transform(paragraphs, lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), shift).bitwiseAND(F.lit(_LOW32)))
        total = F.aggregate(each, F.lit(0).cast("long"), lambda a, h: (a + h).bitwiseAND(F.lit(_LOW32)))
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    return let(F.split(text, "\n"), lambda ps: F.concat(*[lane(ps, s, k) for s in range(EXACT // 2) for k in (0, 32)]))


def shingle_hashes(text: Column) -> Column:
    """A 64-bit hash for each five-word shingle of each paragraph."""

    def of(paragraph: Column) -> Column:
        hashed = F.transform(words(paragraph), lambda w: F.xxhash64(w))
        many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        few = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return let(hashed, lambda h: F.when(F.size(h) >= SHINGLE, many(h)).otherwise(few(h)))

    return F.flatten(F.transform(F.split(text, "\n"), of))


def _counters(h: Column) -> list[Column]:
    """Sums of pairs of bits: k and k + 31 for k = 0..30, then 32 and 63."""
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR))) for k in [*range(31), 32]]


def unpack(packed: list[Column]) -> Column:
    """array<long> of LANES counters."""
    mask = F.lit((1 << 31) - 1)
    return F.array(*[x for p in packed for x in (p.bitwiseAND(mask), F.shiftrightunsigned(p, 31).bitwiseAND(mask))])


def likeness(a: Column, b: Column, same: Column, n_a: Column, n_b: Column) -> Column:
    """0 to 1 from the counters of two fingerprints with n_a and n_b shingles."""
    centred = lambda v, n: F.transform(v, lambda c: c.cast("double") * 2 - n)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    u, v = centred(a, n_a), centred(b, n_b)
    pair = let(F.struct(u.alias("u"), v.alias("v")), lambda s: F.struct(dot(s["u"], s["v"]).alias("d"), (dot(s["u"], s["u"]) * dot(s["v"], s["v"])).alias("n")))
    value = let(pair, lambda s: F.when(s["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["d"] / F.sqrt(s["n"])))).otherwise(0.0))
    return F.when(same, 1.0).otherwise(value)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Insert (sign 1) or delete (-1) the paragraphs of fingerprint ``b``; both as made by ``fingerprint_text``."""
    lane = lambda s, i: F.conv(F.substring(s, 8 * i + 1, 8), 16, 10).cast("long")
    total = EXACT + LANES + 1
    return F.concat(*[F.lpad(F.lower(F.hex((lane(a, i) + F.lit(sign) * lane(b, i)).bitwiseAND(F.lit(_LOW32)))), 8, "0") for i in range(total)])


def fingerprint_text(exact: Column, counters: Column, n: Column) -> Column:
    """Lower-case hex: the exact lanes, the counters, then the number of shingles, 32 bits each."""
    as_hex = lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_LOW32)))), 8, "0")
    return F.concat(exact, F.array_join(F.transform(counters, as_hex), ""), as_hex(n))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``next``, the text of the next document in descending doc_id (after the last: the first).

    Rows are dealt by the upper bits of the id, never to one task; the first row of
    the next bucket joins each bucket, so that ``lead`` never crosses buckets. Also
    returns b and rn (this row's place), and also, the bucket before if this row is its bucket's first.
    """
    low = F.lit(-(1 << 63)).cast("long")
    d = plain(docs).withColumn("k", F.coalesce("doc_id", low)).withColumn("home", F.shiftright("k", BUCKET_BITS))
    tops = d.groupBy("home").agg(F.max("k").alias("top")).withColumn("sup", F.shiftright("home", SUPER_BITS))
    sups = tops.groupBy("sup").agg(F.min("home").alias("low"))
    sups = sups.select("sup", F.coalesce(F.lag("low").over(Window.orderBy(F.desc("sup"))), F.min("low").over(Window.partitionBy(F.lit(0)))).alias("above"))
    within = F.lag("home").over(Window.partitionBy("sup").orderBy(F.desc("home")))
    joins = tops.select("sup", F.col("top").alias("k"), within.alias("before")).join(sups, "sup").select("k", F.coalesce("before", "above").alias("also"))
    joins = write_table(joins, "joins")
    # A number or two for each bucket: sent to all tasks while they are few, dealt out like the texts beyond that.
    d = d.join(F.broadcast(joins) if joins.count() <= FEW else joins, "k", "left")
    d = d.select("doc_id", "text", "k", "home", "also", F.posexplode(F.array("home", "also")).alias("extra", "b")).filter("b is not null")
    w = Window.partitionBy("b").orderBy("extra", F.desc("k"), F.xxhash64("text"))
    d = d.select("doc_id", "text", "b", "extra", "also", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next"))
    return d.filter("extra = 0").select("doc_id", "text", "next", "b", "rn", F.when(F.col("rn") == 1, F.col("also")).alias("also"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    d = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half)))
    d = d.select(
        "doc_id", "b", "rn", "also", "n_chars",
        F.unhex(F.concat(F.sha2("edited", 256), exact_lanes(F.col("text")), exact_lanes(F.col("edited")))).alias("digests"),
        F.transform(F.array(shingle_hashes(F.col("text")), shingle_hashes(F.col("edited"))), lambda a, i: F.struct(i.alias("kind"), a.alias("hs"))).alias("both"),
    )
    keys = ["doc_id", "b", "rn", "also", "n_chars", "digests"]
    e = d.select(*keys, F.explode("both").alias("x")).select(*keys, "x.kind", F.explode_outer("x.hs").alias("h"))
    # The rows are dealt by b, which is among the keys: neither grouping moves them again.
    g = e.groupBy(*keys, "kind").agg(*[c.alias(f"s{i}") for i, c in enumerate(_counters(F.col("h")))], F.count("h").alias("n"))
    packed = [F.coalesce(F.col(f"s{i}"), F.lit(0).cast("long")) for i in range(LANES // 2)]
    g = g.select(*keys, "kind", F.struct("n", unpack(packed).alias("c")).alias("v"))
    g = g.groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(f"v{k}") for k in (0, 1)])
    hexed = F.lower(F.hex("digests"))
    g = g.select("doc_id", "b", "rn", "also", "n_chars", F.substring(hexed, 1, 64).alias("edited_sha256"), F.substring(hexed, 65, 64).alias("x0"), F.substring(hexed, 129, 64).alias("x1"), *[F.col(f"v{k}.{c}").alias(f"{c}{k}") for k in (0, 1) for c in "nc"])
    g = g.select("*", likeness(F.col("c0"), F.col("c1"), F.col("x0") == F.col("x1"), F.col("n0"), F.col("n1")).alias("near_edited"))
    g = g.select("doc_id", "b", "rn", "also", "n_chars", "edited_sha256", "x0", "n0", "c0", fingerprint_text(F.col("x0"), F.col("c0"), F.col("n0")).alias("fingerprint"), fingerprint_text(F.col("x1"), F.col("c1"), F.col("n1")).alias("edited_fingerprint"), "near_edited")
    # The next document's counters: as in neighbours, a bucket's first row also goes to the bucket before.
    g = g.select("*", F.posexplode(F.array("b", "also")).alias("extra", "at")).filter("at is not null")
    nx = F.lead(F.struct("x0", "n0", "c0")).over(Window.partitionBy("at").orderBy("extra", "rn"))
    j = g.withColumn("nx", nx).filter("extra = 0")
    return j.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("c0"), F.col("nx.c0"), F.col("x0") == F.col("nx.x0"), F.col("n0"), F.col("nx.n0")).alias("near_next"))


def add_up(vectors: list[Column]) -> Column:
    """The fingerprint of all paragraphs of several fingerprints."""
    return reduce(combine, vectors)
