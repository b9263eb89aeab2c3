"""Depth tracks, mate repair, record summaries, paired peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.functions.scalar import FLAGS, any_flag, cigar_length
from apportion.operators import intervals


def record_depth(records: DataFrame, weight: str | None = None, kinds: str = "M") -> DataFrame:
    """Steps (rname, start, end, depth) of depth over records: only operations in kinds add, D and N advance. 0-based."""
    refs = "MDN=X"
    part = F.transform("cigar", lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("n"), F.aggregate(F.filter(F.slice("cigar", F.lit(1), i), lambda z: z["op"].isin(*refs)), F.lit(0), lambda a, z: a + z["len"]).alias("at")))
    x = records.filter(~any_flag(F.col("flag"), "UNMAP")).select(F.col("rname"), (F.col("pos") - 1).alias("p"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), F.explode(F.filter(part, lambda o: o["op"].isin(*kinds))).alias("o"))
    x = x.filter("w is not null").select("rname", (F.col("p") + F.col("o.at")).alias("start"), (F.col("p") + F.col("o.at") + F.col("o.n")).alias("end"), "w")
    return intervals.depth_steps(x, ["rname"], "w")


def wiggle(steps: DataFrame, least: float = 0.0095) -> DataFrame:
    """rname, start (1-based), values: a row for each run of positions whose depth is at least ``least``, two decimals."""
    o = Window.partitionBy("rname").orderBy("start")
    x = steps.filter(F.col("depth") >= least).withColumn("new", F.when(F.lag("end").over(o) == F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(o))
    g = x.groupBy("rname", "run").agg(F.min("start").alias("s"), F.sort_array(F.collect_list(F.struct("start", "end", "depth"))).alias("steps"))
    values = F.flatten(F.transform("steps", lambda t: F.array_repeat(F.format_string("%.2f", t["depth"].cast("double")), (t["end"] - t["start"]).cast("int"))))
    return g.select("rname", (F.col("s") + 1).alias("start"), values.alias("values"))


def read_depth(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """name, len, depth: one value a position, null for a target without reads."""
    g = steps.groupBy(F.col("rname").alias("name")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "depth"))).alias("s"))
    x = targets.join(g, "name", "left")
    gaps = F.transform("s", lambda t, i: F.concat(F.array_repeat(F.lit(0.0), (t["start"] - F.when(i > 0, F.get(F.col("s"), i - 1)["end"]).otherwise(0)).cast("int")), F.array_repeat(t["depth"].cast("double"), (t["end"] - t["start"]).cast("int"))))
    filled = F.flatten(gaps)
    return x.select("name", "len", F.when(F.col("s").isNotNull(), F.concat(filled, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.col("len") - F.size(filled))))).alias("depth"))


def to_bed(records: DataFrame, drop: int = FLAGS["UNMAP"] | FLAGS["MUNMAP"] | FLAGS["QCFAIL"] | FLAGS["DUP"]) -> DataFrame:
    end = F.col("pos") - 1 + cigar_length(F.col("cigar"), "MDN")
    return records.filter(F.col("flag").bitwiseAND(F.lit(drop)) == 0).select(F.col("rname").alias("chrom"), (F.col("pos") - 1).alias("start"), end.alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), F.when(any_flag(F.col("flag"), "REVERSE"), "-").otherwise("+").alias("strand"))


def fix_mates(records: DataFrame) -> DataFrame:
    """Primary records of a name, two by two in input order: rnext, pnext, tlen and the mate's flags from the other one; single records lose their pair flags. Others pass."""
    primary = ~any_flag(F.col("flag"), "SECONDARY", "SUPPLEMENTARY")
    p = records.filter(primary)
    w = Window.partitionBy("qname").orderBy("ord")
    mate = lambda c: F.when(F.col("rn") % 2 == 1, F.lead(c).over(w)).otherwise(F.lag(c).over(w))
    p = p.withColumn("ref_end", F.col("pos") + cigar_length(F.col("cigar"), "MDN=X")).withColumn("rn", F.row_number().over(w))
    for c in ("flag", "rname", "pos", "ref_end"):
        p = p.withColumn(f"m_{c}", mate(c))
    paired = F.col("m_flag").isNotNull()
    un, m_un = any_flag(F.col("flag"), "UNMAP"), any_flag(F.col("m_flag"), "UNMAP")
    five = lambda f, pos, end: F.when(any_flag(F.col(f), "REVERSE"), F.col(end) - 1).otherwise(F.col(pos))
    own, other = five("flag", "pos", "ref_end"), five("m_flag", "m_pos", "m_ref_end")
    clear = ~(FLAGS["MUNMAP"] | FLAGS["MREVERSE"])
    flag = F.col("flag").bitwiseAND(F.lit(clear)) + F.when(m_un, FLAGS["MUNMAP"]).otherwise(0) + F.when(any_flag(F.col("m_flag"), "REVERSE"), FLAGS["MREVERSE"]).otherwise(0)
    # Both mapped on one target, the left one forward and the right one reverse: else no proper pair.
    left = F.when(own <= other, ~any_flag(F.col("flag"), "REVERSE") & any_flag(F.col("m_flag"), "REVERSE")).otherwise(any_flag(F.col("flag"), "REVERSE") & ~any_flag(F.col("m_flag"), "REVERSE"))
    same = ~un & ~m_un & (F.col("rname") == F.col("m_rname"))
    flag = F.when(same & left, flag).otherwise(flag.bitwiseAND(F.lit(~FLAGS["PROPER_PAIR"])))
    single = F.col("flag").bitwiseAND(F.lit(~(FLAGS["PAIRED"] | FLAGS["PROPER_PAIR"] | FLAGS["MUNMAP"] | FLAGS["MREVERSE"] | FLAGS["READ1"] | FLAGS["READ2"])))
    span = F.when(same, F.when(other >= own, other - own + 1).otherwise(other - own - 1)).otherwise(0)
    # An unmapped mate stands where the mapped one does.
    rname, pos = F.when(paired & un & ~m_un, F.col("m_rname")).otherwise(F.col("rname")), F.when(paired & un & ~m_un, F.col("m_pos")).otherwise(F.col("pos"))
    m_rname, m_pos = F.when(m_un & ~un, F.col("rname")).otherwise(F.col("m_rname")), F.when(m_un & ~un, F.col("pos")).otherwise(F.col("m_pos"))
    new = {"flag": F.when(paired, flag).otherwise(single), "rname": rname, "pos": pos, "rnext": F.when(paired, F.when(m_rname == rname, "=").otherwise(m_rname)).otherwise("*"), "pnext": F.when(paired, m_pos).otherwise(0), "tlen": F.when(paired, span).otherwise(0)}
    fixed = p.select(*[new.get(c, F.col(c)).cast(records.schema[c].dataType).alias(c) for c in records.columns])
    return fixed.unionByName(records.filter(~primary))


def summary(records: DataFrame) -> DataFrame:
    """One row of summary numbers over primary records, and a checksum that does not depend on their order."""
    f = F.col("flag")
    primary, mapped = ~any_flag(f, "SECONDARY"), ~any_flag(f, "UNMAP")
    n = F.length("seq")
    x = records.filter(primary)
    return x.agg(
        F.count("*").alias("sequences"), F.count_if(mapped).alias("mapped"), F.count_if(any_flag(f, "DUP")).alias("duplicated"), F.count_if(mapped & (F.col("mapq") == 0)).alias("mapq0"),
        F.sum(n).alias("total_length"), F.max(n).alias("maximum_length"), F.floor(F.sum(n) / F.count("*")).alias("average_length"),
        F.sum(F.when(mapped, cigar_length(F.col("cigar"), "MI")).otherwise(0)).alias("bases_mapped_cigar"), F.sum(F.coalesce(F.col("tags")["NM"].try_cast("long"), F.lit(0).cast("long"))).alias("mismatches"),
        *[F.pmod(F.sum(F.crc32(F.col(c).cast("binary"))), F.lit(1 << 32)).alias(f"chk_{c}") for c in ("qname", "seq", "qual")],
    )


def matched_peaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Peaks of two replicates that overlap, directly or through others, as one row: chrom, start, end, sig_a, sig_b (means; 0 where a replicate has none)."""
    both = a.select("chrom", "start", "end", "signal", F.lit("a").alias("rep")).unionByName(b.select("chrom", "start", "end", "signal", F.lit("b").alias("rep")))
    w = Window.partitionBy("chrom").orderBy("start", "end")
    x = both.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), 1).otherwise(0)).over(w))
    sig = lambda r: F.coalesce(F.avg(F.when(F.col("rep") == r, F.col("signal"))), F.lit(0.0)).alias(f"sig_{r}")
    return x.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), sig("a"), sig("b")).drop("island")


def region(records: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """Records that overlap [start, end), 0-based; a table partitioned by rname prunes the rest."""
    stop = F.col("pos") - 1 + F.greatest(F.lit(1), cigar_length(F.col("cigar"), "MDN=X"))
    return records.filter((F.col("rname") == name) & (F.col("pos") <= end) & (stop > start))


def merged(*files: DataFrame) -> DataFrame:
    """Records of several files as one, by coordinate; records without a target last."""
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out.orderBy(F.col("rname") == "*", "rname", "pos", any_flag(F.col("flag"), "REVERSE"))


def mismatch_tag(records: DataFrame, genome: DataFrame) -> DataFrame:
    """records with nm: bases that differ from the reference, plus inserted and deleted ones. genome: name, seq."""
    x = records.join(genome.select(F.col("name").alias("rname"), F.col("seq").alias("g")), "rname")
    upto = lambda kinds: lambda i: F.aggregate(F.filter(F.slice("cigar", F.lit(1), i), lambda z: z["op"].isin(*kinds)), F.lit(0), lambda a, z: a + z["len"])
    part = F.transform("cigar", lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("n"), upto("MIS=X")(i).alias("q"), upto("MDN=X")(i).alias("r")))
    differ = lambda o: F.aggregate(F.sequence(F.lit(1), o["n"]), F.lit(0), lambda a, j: a + F.when(F.upper(F.substring(F.col("seq"), o["q"] + j, F.lit(1))) == F.upper(F.substring(F.col("g"), F.col("pos") - 1 + o["r"] + j, F.lit(1))), 0).otherwise(1))
    nm = F.aggregate(F.transform(part, lambda o: F.when(o["op"].isin("M", "=", "X"), differ(o)).when(o["op"].isin("I", "D"), o["n"]).otherwise(0)), F.lit(0), lambda a, v: a + v)
    return x.withColumn("nm", nm).drop("g")
