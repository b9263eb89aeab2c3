"""Expectation-maximisation and abundances on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from apportion.functions.scalar import round_half_up as r
from apportion.operators import em
from apportion.plans.base import HITS, TARGETS, Tables, query, rsql

#: Parts stand for targets: their table is a dimension, and its size is checked before it is sent to all tasks.
ROUNDS = 3


def _few(t: Tables) -> bool:
    return t.part.count() <= em.FEW_TARGETS


def _em_sql(rounds: int, noise: str = "") -> str:
    out = [f"hits as ({HITS}), t0 as (select sid, 1.0 / count(*) over () as theta from (select distinct sid from hits))"]
    for k in range(1, rounds + 1):
        out.append(f"p{k} as (select rid, sid, ord, w, sum(w) over (partition by rid){noise} as tot from (select rid, h.sid, ord, theta * conprb as w from hits h join t{k - 1} t on h.sid = t.sid))")
        out.append(f"c{k} as (select sid, sum(case when tot < 1e-300 then 0 else w / tot end) as cnt from p{k} group by sid)")
        out.append(f"t{k} as (select sid, cnt / sum(cnt) over () as theta from c{k})")
    return "with " + ", ".join(out)


@query(f"{_em_sql(2)} select sid, {rsql('theta * 1e6', 3)} as theta_ppm, {rsql('cnt')} as cnt from t2 join c2 using (sid)")
def em_theta_fixed_rounds(t: Tables):
    return em.with_theta(em.fixed_rounds(t.hits, 2, _few(t))[1]).select("sid", r(F.col("theta") * 1e6, 3).alias("theta_ppm"), r(F.col("cnt")).alias("cnt"))


@query(f"""{_em_sql(1, " + 0.0002")} select {rsql('sum(placed)')} as placed, {rsql('sum(1 - placed)')} as noise from (select rid, sum(w / tot) as placed from p1 group by rid)""")
def em_noise_slot(t: Tables):
    hits = em.by_record(t.hits)
    post = em.posteriors(hits, em.uniform_theta(hits), _few(t), noise=F.lit(0.0002))
    per = post.groupBy("rid").agg(F.sum("frac").alias("placed"))
    return per.agg(r(F.sum("placed")).alias("placed"), r(F.sum(1 - F.col("placed"))).alias("noise"))


def _results(t: Tables):
    """Targets with counts, theta, effective length (length + 9 stands for it), tpm and fpkm."""
    counts = em.with_theta(em.fixed_rounds(t.hits, ROUNDS, _few(t))[1])
    x = t.targets.join(counts, "sid", "left").fillna(0.0, ["cnt", "theta"])
    return em.abundances(x.withColumn("eel", (F.col("length") + 9).cast("double")))


_RESULTS = f"""{_em_sql(ROUNDS)}, x as (select p.*, coalesce(cnt, 0) as cnt, coalesce(theta, 0) as theta, cast(length + 9 as double) as eel
  from ({TARGETS}) p left join c{ROUNDS} using (sid) left join t{ROUNDS} using (sid)),
  f as (select *, theta / sum(theta) over () * 1e9 / eel as fpkm from x), res as (select *, fpkm / sum(fpkm) over () * 1e6 as tpm from f)"""


@query(f"""{_RESULTS} select gene, {rsql('sum(cnt)')} as cnt, {rsql('sum(tpm)')} as tpm, {rsql('sum(fpkm)', 2)} as fpkm,
  {rsql('case when sum(tpm) > 0 then sum(length * tpm) / sum(tpm) else avg(length) end')} as length,
  {rsql('case when sum(tpm) > 0 then sum(eel * tpm) / sum(tpm) else avg(eel) end')} as eel from res group by gene""")
def em_gene_expression(t: Tables):
    g = em.rollup_weighted(_results(t), "gene")
    return g.select("gene", r(F.col("cnt")).alias("cnt"), r(F.col("tpm")).alias("tpm"), r(F.col("fpkm"), 2).alias("fpkm"), r(F.col("length")).alias("length"), r(F.col("eel")).alias("eel"))


@query(f"{_RESULTS} select sid, {rsql('tpm')} as tpm, {rsql('fpkm', 2)} as fpkm from res")
def tpm_fpkm(t: Tables):
    return _results(t).select("sid", r(F.col("tpm")).alias("tpm"), r(F.col("fpkm"), 2).alias("fpkm"))


@query(f"{_RESULTS} select sid, gene, {rsql('case when sum(tpm) over (partition by gene) > 0 then tpm / sum(tpm) over (partition by gene) * 100 else 0 end')} as iso_pct from res")
def isoform_pct(t: Tables):
    x = _results(t).withColumn("iso_pct", em.share_of("tpm", "gene", "iso_pct"))
    return x.select("sid", "gene", r(F.col("iso_pct")).alias("iso_pct"))


@query("""with s as (select s_suppkey, s_nationkey, n_regionkey, sum(l_extendedprice) as tpm from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by all),
  n as (select s_nationkey, n_regionkey, sum(tpm) as tpm from s group by all)
  select s_suppkey, s.s_nationkey, s.n_regionkey, """ + rsql("s.tpm / n.tpm * 100") + " as allele_iso_pct, " + rsql("s.tpm / sum(s.tpm) over (partition by s.n_regionkey) * 100") + """ as allele_gene_pct,
  """ + rsql("n.tpm / (select sum(m.tpm) from n m where m.n_regionkey = s.n_regionkey) * 100") + " as iso_pct from s join n on s.s_nationkey = n.s_nationkey")
def allele_three_level(t: Tables):
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_suppkey", "s_nationkey", "n_regionkey").agg(F.sum("l_extendedprice").alias("tpm"))
    s = s.withColumn("allele_iso_pct", em.share_of("tpm", "s_nationkey", "x")).withColumn("allele_gene_pct", em.share_of("tpm", "n_regionkey", "x"))
    n = s.groupBy("s_nationkey", "n_regionkey").agg(F.sum("tpm").alias("tpm")).withColumn("iso_pct", em.share_of("tpm", "n_regionkey", "x")).select("s_nationkey", "iso_pct")
    return s.join(n, "s_nationkey").select("s_suppkey", "s_nationkey", "n_regionkey", *[r(F.col(c)).alias(c) for c in ("allele_iso_pct", "allele_gene_pct", "iso_pct")])


@query(f"""with hits as ({HITS}), sig as (select rid, list_sort(list(sid * 100 + cast(conprb * 50 as bigint))) as s from hits group by rid)
  select n_records, count(*) as n_classes from (select s, count(*) as n_records from sig group by s) group by n_records""")
def em_equivalence_classes(t: Tables):
    return em.equivalence_classes(t.hits).groupBy(F.col("n").alias("n_records")).agg(F.count("*").alias("n_classes"))


@query(f"""{_em_sql(1)} select mapq, count(*) as n from (select case when 1 - w / tot <= 1e-10 then 100 else cast(floor(-10 * log10(greatest(1 - w / tot, 1e-10)) + 0.5 + 1e-9) as int) end as mapq from p1) group by mapq""")
def posterior_mapq(t: Tables):
    hits = em.by_record(t.hits)
    post = em.posteriors(hits, em.uniform_theta(hits), _few(t))
    # The frac of a tie can fall on either side of a half: nudged up by one part in 1e9 on both engines.
    q = F.when(1 - F.col("frac") <= 1e-10, 100).otherwise(F.floor(-10 * F.log10(F.greatest(1 - F.col("frac"), F.lit(1e-10))) + 0.5 + 1e-9).cast("int"))
    return post.groupBy(q.alias("mapq")).agg(F.count("*").alias("n"))


@query("""select p_partkey as sid, """ + rsql("case when e < 1 then 0 else e end") + """ as eel from (select p_partkey, coalesce(sum(p * least(p_size + 5, p_size + 30 - l + 1)), 0) as e
  from part left join (select unnest([10, 20, 30, 40, 60]) as l, unnest([0.1, 0.2, 0.4, 0.2, 0.1]) as p) on l <= p_size + 30 group by p_partkey)""")
def effective_length(t: Tables):
    lengths = t.spark.createDataFrame([(10, 0.1), (20, 0.2), (30, 0.4), (40, 0.2), (60, 0.1)], "l int, p double")
    x = t.part.select(F.col("p_partkey").alias("sid"), (F.col("p_size") + 5).alias("full_len"), (F.col("p_size") + 30).alias("tot_len"))
    return em.effective_lengths(x, lengths).select("sid", r(F.col("eel")).alias("eel"))


@query("select o_orderstatus as cls, count(distinct o_orderkey) as n from orders group by 1")
def read_class_counts(t: Tables):
    return em.class_counts(t.orders.select(F.col("o_orderstatus").alias("cls"), F.col("o_orderkey").alias("rid")))


@query(f"""with m as (select rid, count(*) as h, count(distinct gene) as g from ({HITS}) join ({TARGETS}) using (sid) group by rid)
  select count(*) as n_aligned, count(*) filter (g > 1) as n_multi, count(*) filter (h > 1) as n_iso_multi, count(*) filter (g = 1) as n_unique, cast(sum(h) as bigint) as n_hits from m""")
def multiread_counts(t: Tables):
    return em.multi_counts(t.hits.join(t.targets, "sid"))


@query("""select bucket, count(*) as n from (select o_orderkey, case when count(l_orderkey) >= 8 then 'Inf' else cast(count(l_orderkey) as varchar) end as bucket
  from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey) group by bucket""")
def hits_histogram(t: Tables):
    n = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("h"))
    return n.groupBy(F.when(F.col("h") >= 8, "Inf").otherwise(F.col("h").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("select p_partkey as sid from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)")
def omit_list(t: Tables):
    seen = t.lineitem.filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(seen, "p_partkey", "left_anti").select(F.col("p_partkey").alias("sid"))


@query("select l_suppkey % 120 as target, count(*) as n from lineitem where l_suppkey % 120 not in (select s_suppkey from supplier where s_suppkey % 3 > 0) group by 1")
def unknown_target_check(t: Tables):
    x = t.lineitem.select((F.col("l_suppkey") % 120).alias("target"))
    return x.join(t.supplier.filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("target")), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@query("""select p_brand as gene, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as members from part group by p_brand""")
def gene_transcript_list(t: Tables):
    return em.ordered_members(t.targets.select("gene", "sid", F.col("sid").alias("tid")), "gene", "sid", "tid")


@query("""select l_partkey as sid, """ + rsql("avg(l_quantity)") + " as mean, " + rsql("case when count(*) > 1 then greatest(0, (sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / count(*)) / (count(*) - 1)) else 0 end", 2) + " as variance from lineitem group by l_partkey")
def posterior_moments(t: Tables):
    m = em.moments(t.lineitem.select(F.col("l_partkey").alias("sid"), "l_quantity"), "sid", "l_quantity")
    return m.select("sid", r(F.col("mean")).alias("mean"), r(F.col("variance"), 2).alias("variance"))


@query("""with v as (select l_suppkey as sid, l_extendedprice as x, row_number() over (partition by l_suppkey order by l_extendedprice) as rn, count(*) over (partition by l_suppkey) as n from lineitem),
  k as (select *, cast(floor(0.9 * n - 1e-8) as bigint) + 1 as k from v), w as (select a.sid, a.x as lo, b.x as hi from k a join k b on a.sid = b.sid and b.rn = a.rn + a.k - 1)
  select sid, lo, hi from (select *, row_number() over (partition by sid order by hi - lo, lo) as q from w) where q = 1""")
def hpd_interval(t: Tables):
    return em.shortest_interval(t.lineitem.select(F.col("l_suppkey").alias("sid"), "l_extendedprice"), "sid", "l_extendedprice", 0.9)


@query("""with a as (select l_suppkey as sid, list_sort(list(l_extendedprice)) as v, count(*) as n, count(*) // 4 as q from lineitem group by 1),
  b as (select sid, case n % 4 when 0 then (v[q] + v[q + 1]) / 2 when 3 then (v[q + 1] + v[q + 2]) / 2 else v[q + 1] end as q1,
  case n % 4 when 0 then (v[3 * q] + v[3 * q + 1]) / 2 when 3 then (v[3 * q + 2] + v[3 * q + 3]) / 2 else v[3 * q + 1] end as q3 from a)
  select sid, """ + rsql("case when q3 > q1 then (q3 - q1) / (q3 + q1) else 0 end", 6) + " as cqv from b")
def tukey_cqv(t: Tables):
    q = em.quartile_variation(t.lineitem.select(F.col("l_suppkey").alias("sid"), "l_extendedprice"), "sid", "l_extendedprice")
    return q.select("sid", r(F.col("cqv"), 6).alias("cqv"))

