"""Scalar expressions: sequences, flags, CIGAR strings, quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base complements, bit flags of alignment records, CIGAR operations that consume the query and the reference.
COMPLEMENT = ("ACGTNacgtn", "TGCANtgcan")
FLAGS = {"PAIRED": 1, "PROPER_PAIR": 2, "UNMAP": 4, "MUNMAP": 8, "REVERSE": 16, "MREVERSE": 32, "READ1": 64, "READ2": 128, "SECONDARY": 256, "QCFAIL": 512, "DUP": 1024, "SUPPLEMENTARY": 2048}
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"
TINY = 1e-300


def round_half_up(x: Column, digits: int = 4) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits: the same on every engine."""
    s = 10.0**digits
    return F.floor(x * s + 0.5) / s


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def normalise_bases(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def soft_masked_bases(seq: Column) -> Column:
    """Case is kept: other upper-case letters become N, other lower-case ones n."""
    return F.regexp_replace(F.regexp_replace(seq, "[A-Z&&[^ACGT]]", "N"), "[a-z&&[^acgt]]", "n")


def pad_tail(seq: Column, length: int = 125, exempt: Column | None = None) -> Column:
    padded = F.concat(seq, F.repeat(F.lit("A"), length))
    return padded if exempt is None else F.when(exempt, seq).otherwise(padded)


def gc_fraction(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")) / F.length(seq)


def splice(seq: Column, exons: Column, strand: Column) -> Column:
    """Exons (structs of start and end, 1-based inclusive, ascending) cut out of seq and joined; reverse-complemented on '-'."""
    joined = F.array_join(F.transform(exons, lambda e: F.substring(seq, e["start"], e["end"] - e["start"] + 1)), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def has_flags(flag: Column, *names: str) -> Column:
    mask = sum(FLAGS[n] for n in names)
    return flag.bitwiseAND(F.lit(mask)) == mask


def any_flag(flag: Column, *names: str) -> Column:
    return flag.bitwiseAND(F.lit(sum(FLAGS[n] for n in names))) != 0


def flag_names(flag: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(any_flag(flag, n), n) for n in FLAGS]), lambda x: x.isNotNull()), ",")


def cigar_ops(cigar: Column) -> Column:
    """'3M2N' to an array of structs of op and len; '*' to an empty one."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"\d+", 0).cast("int").alias("len")))


def cigar_length(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["len"])


def single_match(ops: Column, query_length: Column) -> Column:
    """One M, = or X operation over the whole read."""
    return (F.size(ops) == 1) & ops[0]["op"].isin("M", "=", "X") & (ops[0]["len"] == query_length)


def mapq_from_posterior(p: Column) -> Column:
    """100 at an error of at most 1e-10, else the rounded Phred value of the error."""
    err = 1 - p
    return F.when(err <= 1e-10, 100).otherwise(F.floor(-10 * F.log10(F.greatest(err, F.lit(1e-10))) + 0.5).cast("int"))


def region_parts(text: Column) -> Column:
    """'chr:b-e' (1-based, inclusive; commas allowed) to name, 0-based start and end."""
    t = F.regexp_replace(text, ",", "")
    pat = r"^(.+?)(?::(\d+)(?:-(\d+))?)?$"
    b, e = F.regexp_extract(t, pat, 2), F.regexp_extract(t, pat, 3)
    return F.struct(F.regexp_extract(t, pat, 1).alias("name"), F.when(b != "", b.try_cast("int") - 1).otherwise(0).alias("start"), F.when(e != "", e.try_cast("int")).alias("end"))


def log10_floor(x: Column, floor: float = -4.0) -> Column:
    """log10, and ``floor`` where there is none."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(floor))


def cut_at_last_underscore(name: Column) -> Column:
    found = F.regexp_extract(name, r"^(.*)_[^_]*$", 1)
    return F.when(found != "", found).otherwise(name)


def natural_key(name: Column, width: int = 20) -> Column:
    """A key whose string order is that of names with their digit runs as numbers."""
    spaced = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(spaced, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), width, "0")).otherwise(x)), "")


def read_name(name: Column) -> Column:
    return F.split(name, r"\s")[0]


def low_quality(seq: Column, seed: int = 25) -> Column:
    """Too short, or nearly all A at its start (or T at its end): a read of a padded tail."""
    n = F.length(seq)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    least = F.floor(0.9 * n - 1.5 * F.sqrt(n.cast("double")) + 0.5)
    a, t = count(seq, "A") >= least, count(seq, "T") >= least
    tail = F.when(a, count(F.substring(seq, 1, 25), "A") >= 13).when(t, count(F.right(seq, F.lit(25)), "T") >= 13).otherwise(False)
    return (n < seed) | tail
