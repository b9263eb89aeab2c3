"""MinHash near-dedup: bottom-k sketches from one hash function.

A text's set holds its distinct four-word shingles, each hashed to 64 bits.
Texts with equal sets are one node (keyed by a 64-bit sum over the set). Nodes
are linked if 100 * |A and B| >= 80 * |A or B|.

Retained values: with all nodes' values in one order, two linked nodes share a
value among the first n - ceil(0.8 n) + 1 of each, n being the set's size. So
each node retains that many values: a bottom-k sketch whose k follows the size,
which loses no link. The order is that of the hash, but values that are frequent
in the whole corpus come last; how frequent is read off 2**COUNTER_BITS counters,
an array of fixed size, summed over all documents and sent to the tasks. Rare
values that share a counter make it noisy; values that stand out of that noise
are told apart, so that a list of values from the front of the order is short
however often passages come.

Inverted lists of the retained values give candidate pairs, without all pairs of
a list: first each node of a list against the list's smallest node; then, with
the linked nodes merged, nodes outside a list's largest component against a few
of its members, and at last whatever is still in different components of a list,
one of the pair outside the largest. A pair passes the sizes, the
number of values left after the shared one, then the estimate from the union's
bottom-24 sketch (at least MARGIN, six standard errors below 0.8), and only then
do the texts of the pair meet for the exact Jaccard similarity of the full sets.

Defined cases: a null text, or one without words, has an empty set, is linked
with nothing and is kept; fewer than four words are one shingle; a null doc_id
counts as smallest in a component, and rows with the same doc_id are kept or
not alike; repeated rows link through their equal text; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm import exchange, seq
from apportion.llm.common import homes, part_of, passing, plain, tidy, write_bucketed, write_table

SHINGLE, PERCENT, SKETCH, MARGIN = 4, 80, 24, 0.3
COUNTER_BITS, BLOCK = 22, 1 << 14
#: Bytes of packed texts that are compared at once, and values of sets that a task keeps.
PACKED, KNOWN = 1 << 20, 1 << 21
#: Members of a component that an outsider meets in a round, and rounds before all that is left is paired.
HUBS, MOST_TURNS = 16, 4


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles, sorted by owner, then hash."""
    low = [t.lower() for t in texts]  # of bytes: A-Z alone
    _, starts, _, owner, w = seq.batch_words(low)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    grams = seq.gram_hashes(w, SHINGLE)
    at = np.flatnonzero(owner[: len(grams)] == owner[SHINGLE - 1 :]) if len(grams) else np.zeros(0, int)
    o, h = owner[at], grams[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = n[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            more = n[short] > k
            whole[more] = seq.mix(whole[more] * np.uint64(31) + w[first[short[more]] + k])
        o, h = np.concatenate((o, short)), np.concatenate((h, whole))
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[new], h[new]


def node_ids(o: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each set; 0 for an empty one."""
    sizes = np.bincount(o, minlength=n)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        sums = np.add.reduceat(seq.mix(h ^ np.uint64(0xA0761D6478BD642F)), (np.cumsum(sizes) - sizes)[full])
        out[full] = seq.mix(sums + sizes[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def retained(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def _narrow(counts: np.ndarray) -> bytes:
    """The counters of a block, each in as few bytes as all of them need."""
    most = int(counts.max())
    return counts.astype(next(f"<u{k}" for k in (1, 2, 4, 8) if most < 1 << 8 * k)).tobytes()


def _wide(block: bytes) -> np.ndarray:
    return np.frombuffer(block, f"<u{len(block) // BLOCK}").astype("<i8")


def _counters(docs: DataFrame) -> np.ndarray:
    """How many documents' sets hold values with given upper bits: 2**COUNTER_BITS sums, at most 2**32 - 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            texts = [t.encode() for t in b.text]
            for i, j in seq.groups(texts):
                h = shingles(texts[i:j])[1]
                np.add.at(total, (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        for k in range(0, len(total), BLOCK):
            part = total[k : k + BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [k // BLOCK], "counts": [_narrow(part)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf.block[:1], "counts": [_narrow(sum(map(_wide, pdf.counts)))]})

    out = np.zeros(1 << COUNTER_BITS, np.uint32)
    for r in docs.mapInPandas(lambda batches: tidy(count(batches)), "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect():  # 16 MB, or 32 MB if sums pass 2**32
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.minimum(_wide(r["counts"]), 0xFFFFFFFF)
    return out


def _classes(counts: np.ndarray) -> np.ndarray:
    """Of each counter, how far it stands over the mean: 0 up to twice the mean's square root, then one more for each such root, and from eight on four more for each doubling.

    Rare values spread evenly, so their sums vary by about the root of the mean.
    """
    mean = max(1.0, counts.mean())
    out = np.empty(len(counts), np.uint8)
    for k in range(0, len(counts), BLOCK):
        over = (counts[k : k + BLOCK] - mean) / np.sqrt(mean)
        out[k : k + BLOCK] = np.clip(np.where(over < 8, over - 1, 7 + 4 * np.log2(np.maximum(over, 8) / 8)), 0, 255)
    return out


CHUNKS = "chunk long, ids binary, nulls binary, n binary, nodes binary, keep binary, values binary, sketches binary, texts binary, lens binary"


def _chunks(docs: DataFrame, classes, buckets: int) -> DataFrame:
    """A row per chunk: its documents' ids, set sizes and nodes; for each node's first document the retained values and the packed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = classes.value
        pack = zstandard.ZstdCompressor(level=3)
        for chunk, b in exchange.numbered(batches, most=1 << 20, homes=buckets):
            texts = [t.encode() for t in b.text]
            o, h = shingles(texts)
            n = np.bincount(o, minlength=len(b))
            nodes = node_ids(o, h, len(b))
            rank = np.lexsort((order[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], o))  # stable: by hash within
            keep = np.minimum(retained(n), n)
            keep[np.setdiff1d(np.arange(len(b)), np.unique(nodes, return_index=True)[1])] = 0
            at = rank[seq.ragged(np.cumsum(n) - n, keep)]
            low = (h >> np.uint64(32)).astype("<u4")
            ends = np.cumsum(n)
            sketches = b"".join([low[e - m : e - m + min(m, SKETCH)].tobytes() for e, m, k in zip(ends, n, keep, strict=True) if k])
            packed = [pack.compress(t) if k else b"" for t, k in zip(texts, keep, strict=True)]
            ints = lambda x: [np.asarray(x).astype("<i8").tobytes()]
            yield pd.DataFrame({
                "chunk": [chunk], "ids": ints(b.doc_id.fillna(0)), "nulls": [np.packbits(b.doc_id.isna().to_numpy()).tobytes()], "n": ints(n), "nodes": ints(nodes), "keep": ints(keep),
                "values": [h[at].astype("<u8").tobytes()], "sketches": [sketches], "texts": [b"".join(packed)], "lens": ints([len(x) for x in packed]),
            })

    return docs.mapInPandas(lambda batches: tidy(run(batches)), CHUNKS)


_I = lambda x: np.frombuffer(x, "<i8")
_V = lambda x: np.frombuffer(x, "<u8")


def _members(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = _I(r.ids)
                yield pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").mask(np.unpackbits(np.frombuffer(r.nulls, np.uint8))[: len(ids)].astype(bool)), "n": _I(r.n), "node": _I(r.nodes)})

    return chunks.select("ids", "nulls", "n", "nodes").mapInPandas(run, "doc_id long, n long, node long")


def _nodes(chunks: DataFrame, bits: int) -> DataFrame:
    """node, n, its retained values that another node may retain (vs), their places among the retained (ps), its chunk and its bottom values (sk): only nodes that have such values."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                v = np.unique(_V(r.values))
                if len(v):
                    yield exchange.runs(r.chunk, v, bits)

    answers = exchange.masks(chunks.select("chunk", "values").mapInPandas(lambda batches: tidy(send(batches)), exchange.RUN))

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in left.itertuples():
            values, keep, n, nodes = _V(r.values), _I(r.keep), _I(r.n), _I(r.nodes)
            v, where, count = np.unique(values, return_inverse=True, return_counts=True)
            hit = (exchange.shared(v, bits, right) | (count > 1))[where]
            ends = np.cumsum(keep)
            size = np.minimum(n, SKETCH) * (keep > 0) * 4
            cut = np.cumsum(size)
            for i in np.flatnonzero(np.add.reduceat(np.append(hit, False), np.minimum(ends - keep, len(hit))) * (keep > 0)):
                ps = np.flatnonzero(hit[ends[i] - keep[i] : ends[i]])
                rows.append((nodes[i], n[i], values[ends[i] - keep[i] + ps].view(np.int64), ps, r.chunk, r.sketches[cut[i] - size[i] : cut[i]]))
        return pd.DataFrame(rows, columns=["node", "n", "vs", "ps", "chunk", "sk"])

    rows = chunks.select("chunk", "n", "nodes", "keep", "values", "sketches").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return rows.applyInPandas(pick, "node long, n long, vs array<long>, ps array<long>, chunk long, sk binary").dropDuplicates(["node"])


def _fits(na: Column, nb: Column) -> Column:
    return (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na)


def _texts(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """node, z: the packed texts of wanted nodes (node, chunk)."""

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        want, rows = set(right.node), []
        for r in left.itertuples() if want else ():
            nodes, lens = _I(r.nodes), _I(r.lens)
            ends = np.cumsum(lens)
            rows += [(nodes[i], r.texts[ends[i] - lens[i] : ends[i]]) for i in np.flatnonzero(lens) if nodes[i] in want]
        return pd.DataFrame(rows, columns=["node", "z"])

    return chunks.select("chunk", "nodes", "texts", "lens").groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(pick, "node long, z binary")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose union's sketch has at least MARGIN of its values in both."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b.sa, b.sb, strict=True):
                p, q = set(np.frombuffer(x, "<u4").tolist()), set(np.frombuffer(y, "<u4").tolist())
                union = sorted(p | q)[:SKETCH]
                ok.append(sum(v in p and v in q for v in union) >= MARGIN * len(union))
            yield b.loc[ok, ["a", "b"]]

    s = lambda side: nodes.select(F.col("node").alias(side), F.col("sk").alias(f"s{side}"))
    return pairs.join(s("a"), "a").join(s("b"), "b").select("a", "b", "sa", "sb").mapInPandas(test, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are linked. Texts travel packed, as they are smaller than their sets, and only those of the pairs."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "chunk"), "node")
    texts = write_table(_texts(wanted, chunks), "texts")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def sets(b: pd.DataFrame) -> None:
            """Into known, for the nodes of b."""
            new = {n: z for side in "ab" for n, z in zip(b[side], b[f"z{side}"], strict=True) if n not in known}
            names, texts = [*new], [unpack.decompress(z) for z in new.values()]
            for i, j in seq.groups(texts):
                o, h = shingles(texts[i:j])
                known.update(zip(names[i:j], np.split(h, np.cumsum(np.bincount(o, minlength=j - i))[:-1]), strict=True))

        for batch in batches:
            size = np.cumsum([len(x) + len(y) for x, y in zip(batch.za, batch.zb, strict=True)]) // PACKED
            for _, b in batch.groupby(size):
                if sum(map(len, known.values())) > KNOWN:
                    known.clear()
                sets(b)
                ok = []
                for x, y in zip(b.a, b.b, strict=True):
                    p, q = known[x], known[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
                yield b.loc[ok, ["a", "b"]]

    z = lambda side: texts.select(F.col("node").alias(side), F.col("z").alias(f"z{side}"))
    return pairs.join(z("a"), "a").join(z("b"), "b").select("a", "b", "za", "zb").mapInPandas(lambda batches: tidy(test(batches)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, comp): the smallest node reachable. Each round takes the least label of the neighbours, then that label's label."""
    both = write_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    at = write_table(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "labels")
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = at.join(near, at["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = at.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = write_table(step.join(jump, "comp").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        at = part_of(new, "node", "comp")
        if not new.filter("old != comp").limit(1).count():
            return at


def _linked(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, n, node), and each linked node's component (node, comp)."""
    spark = d.sparkSession
    classes = spark.sparkContext.broadcast(_classes(_counters(d)))  # 4 MB
    n = homes(spark)
    chunks = write_bucketed(_chunks(d, classes, n), "chunks", n)
    members = write_table(_members(chunks), "members")
    bits = exchange.bucket_bits((members.agg(F.sum("n")).first()[0] or 0) * 4 * (100 - PERCENT) / 100)
    nodes = write_table(_nodes(chunks, bits), "nodes")
    entries = nodes.select("node", "n", F.explode(F.arrays_zip("vs", "ps")).alias("e")).select("node", "n", F.col("e.vs").alias("v"), F.col("e.ps").alias("pos"))

    hubs = entries.groupBy("v").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("v", "hub")
    sizes = nodes.select(F.col("node").alias("hub"), F.col("n").alias("hn"))
    first = entries.join(hubs, "v").filter("node != hub").select("node", "n", "hub").distinct().join(sizes, "hub").filter(_fits(F.col("n"), F.col("hn")))
    first = write_table(first.select(F.col("hub").alias("a"), F.col("node").alias("b")), "pairs")
    near = write_table(_estimated(first, nodes), "pairs")
    links = write_table(_verified(near, nodes, chunks), "links")
    comp = components(links)

    # Nodes outside their list's largest component meet HUBS of its members, drawn anew each round, while pairing
    # them with the whole list would take many pairs; what is still apart then is paired in full.
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = 2 * nodes.count()
    for turn in range(MOST_TURNS + 1):
        with passing(spark) as kept:  # lists and texts are as large as what they are made of
            e = entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            parts = e.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("all"), F.max("c").alias("most")).filter("k > 1")
            e = write_table(e.join(parts, "v"), "lists")
            x = e.filter("comp != main").select("v", *[F.col(c).alias(f"x{c}") for c in ("node", "n", "pos", "comp")])
            full = turn == MOST_TURNS or (e.select("v", "all", "most").distinct().agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0) <= few
            y = e.select("v", "main", *[F.col(c).alias(f"y{c}") for c in ("node", "n", "pos", "comp")])
            if not full:
                drawn = F.xxhash64("ynode", F.lit(turn))
                y = y.filter("ycomp = main").groupBy("v", F.pmod(drawn, F.lit(HUBS)).alias("seat")).agg(F.min_by(F.struct("main", "ynode", "yn", "ypos", "ycomp"), drawn).alias("y")).select("v", "y.*")
            p = x.join(y, "v").filter("xcomp != ycomp and (ycomp = main or xnode < ynode)").filter(_fits(F.col("xn"), F.col("yn")))
            rest = 1 + F.least(F.col("xn") - F.col("xpos") - 1, F.col("yn") - F.col("ypos") - 1)
            p = p.filter((100 + PERCENT) * rest >= PERCENT * (F.col("xn") + F.col("yn")))
            pairs = write_table(p.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            near = write_table(_estimated(pairs, nodes), "pairs")
            more = write_table(_verified(near, nodes, chunks), "links")
            if more.limit(1).count():
                # The components so far stand for the links so far.
                links = comp.filter("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).union(more)
                comp = components(links)
            kept += [comp, pairs]
        if full:
            break
        tried = tried.union(pairs)
    return members, comp


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with passing(docs.sparkSession) as kept:  # of what the steps write, the rest goes
        members, comp = kept[:] = _linked(plain(docs))
    m = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = m.filter("n > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least"))
    m = m.join(least, "comp", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return m.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns."""
    kept = classes_of(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
