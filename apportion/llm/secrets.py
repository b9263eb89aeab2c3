"""Secret scans: multipart credential linking, in DataFrame functions only.

Every text is searched for parts. Base parts (assign, access, hex) are reported
always. Weak parts are reported only when complementary parts lie within SCOPE
code points in the same text:

* ``value``, an unlabelled token that mixes letters and digits: with an
  identifier (access or login) or an endpoint near it;
* ``login``, a labelled account or key name: with a secret (assign, hex or a
  value) near it;
* ``endpoint``, an address of a service: with an identifier and a secret near it.

Weak parts that overlap a base part, or a login or endpoint in the case of a
value, are not candidates. Linking is an interval join by sweep: the parts of a
text are put in order of start, and running maxima of the ends of each role,
from either side, tell each part the nearest complement. No pairs are made.

Positions are code points, ends are exclusive, a kind's matches are leftmost
and do not overlap. Positions come from splitting at the matches: the lengths
of the gaps and of the matches add up.

Defined cases: a null text is empty, has no parts, and its digest is that of
the empty string; a null doc_id is kept; repeated rows are judged each on its
own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.llm.common import let, plain

#: Greatest gap between complementary parts, in code points.
SCOPE = 200
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
LOGIN = r"""(?i:access_?key(?:_?id)?|client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
ENDPOINT = r"""(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "value": VALUE, "login": LOGIN, "endpoint": ENDPOINT}
BASE = 3
#: Cheap tests that a text must pass before a kind's pattern is split at.
HINT = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": HEX, "value": r"[A-Za-z0-9+/_-]{16,}", "login": r"(?i:key|client|account|user|login)", "endpoint": "://"}
MASK = "[SECRET]"


def _spans(text: Column, rank: int, kind: str) -> Column:
    """array<struct<kind int, start int, stop int>> of one kind."""
    pattern = KINDS[kind]
    least = {"assign": 6}.get(kind, 0)

    def place(s: Column) -> Column:
        """s: the gaps, the matches, and their lengths summed up."""
        step = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
        zero = F.array(F.lit(0))
        sums = lambda xs: F.aggregate(xs, zero, step)
        both = F.struct(sums(F.transform(s["gaps"], F.char_length)).alias("g"), sums(F.transform(s["hits"], F.char_length)).alias("m"))
        return let(both, lambda c: F.transform(s["hits"], lambda h, i: F.struct(F.lit(rank).alias("kind"), (F.get(c["g"], i + 1) + F.get(c["m"], i)).alias("start"), (F.get(c["g"], i + 1) + F.get(c["m"], i + 1)).alias("stop"), h.alias("hit"))))

    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = let(cut, place)
    if least:
        found = F.filter(found, lambda x: F.char_length(F.regexp_extract(x["hit"], pattern, 1)) >= least)
    found = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    return F.when(F.regexp_like(text, F.lit(HINT[kind])), found).otherwise(none)


def parts(text: Column) -> Column:
    return F.flatten(F.array(*[_spans(text, i, k) for i, k in enumerate(KINDS)]))


def linked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys and parts. One row for each part that is reported, and for each text one of null kind: keys, kind, start, stop."""
    none = F.lit(None).cast("struct<kind:int,start:int,stop:int>")
    p = rows.select(*keys, F.explode(F.concat(F.array(none), "parts")).alias("p")).select(*keys, "p.*")
    kind, start, stop = (F.col(c) for c in ("kind", "start", "stop"))
    role = {"base": kind < BASE, "named": kind.isin(4, 5), "ident": kind.isin(1, 4), "secret": kind.isin(0, 2, 3), "place": kind == 5}
    before = Window.partitionBy(*keys).orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("stop"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    p = p.select("*", *[F.max(F.when(c, stop)).over(before).alias(f"{r}_l") for r, c in role.items()], *[F.min(F.when(c, start)).over(after).alias(f"{r}_r") for r, c in role.items()])
    near = lambda r: F.coalesce(start - F.col(f"{r}_l") <= SCOPE, F.lit(False)) | F.coalesce(F.col(f"{r}_r") - stop <= SCOPE, F.lit(False))
    over = lambda r: F.coalesce(F.col(f"{r}_l") > start, F.lit(False)) | F.coalesce(F.col(f"{r}_r") < stop, F.lit(False))
    value = (kind == 3) & ~over("base") & ~over("named") & (near("ident") | near("place"))
    login = (kind == 4) & ~over("base") & near("secret")
    place = (kind == 5) & ~over("base") & near("ident") & near("secret")
    return p.filter(kind.isNull() | (kind < BASE) | value | login | place).select(*keys, "kind", "start", "stop")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    rows = plain(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), parts(F.col("text")).alias("parts"))
    p = linked(rows, ["doc_id", "row"])
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    each = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", F.concat_ws(":", name, "start", "stop").alias("s"), (F.col("kind") < BASE).alias("base")))
    g = p.groupBy("doc_id", "row").agg(*[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(list(KINDS)[:BASE])], F.count_if(F.col("kind") >= BASE).alias("n_linked"), F.sort_array(F.collect_list(each)).alias("all"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    return g.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.filter("all", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_linked")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every reported span (those that touch or overlap as one) replaced by MASK. All rows and columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("h"), F.char_length(text).alias("n"), parts(text).alias("parts")).filter(F.size("parts") > 0).dropDuplicates(["doc_id", "h", "n"])
    keys = ["doc_id", "h", "n"]
    p = linked(rows, keys).filter("kind is not null")
    w = Window.partitionBy(*keys).orderBy("start", "stop", "kind")
    p = p.withColumn("new", F.coalesce(F.col("start") > F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    p = p.withColumn("island", F.sum(F.col("new").cast("int")).over(w))
    p = p.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    cuts = p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cuts = cuts.select(F.struct(*[F.col(k).alias(k) for k in keys]).alias("key"), "cuts")
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"))
    t = F.coalesce(F.col("doc.text"), F.lit(""))
    d = d.withColumn("key", F.struct(F.col("doc.doc_id").alias("doc_id"), F.xxhash64(t).alias("h"), F.char_length(t).alias("n")))
    d = d.join(cuts, d["key"].eqNullSafe(cuts["key"]), "left").select("doc", "cuts")
    k = F.size("cuts")
    piece = lambda i: F.substring(F.col("doc.text"), F.when(i == 0, 1).otherwise(F.get(F.col("cuts"), i - 1)["stop"] + 1), F.when(i == k, F.lit(2**31 - 1)).otherwise(F.get(F.col("cuts"), i)["start"]) - F.when(i == 0, 0).otherwise(F.get(F.col("cuts"), i - 1)["stop"]))
    clean = F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), k), piece), MASK))
    return d.select(*[clean.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
