"""Near-duplicate groups by SetSketch bands, joint estimates and full verification.

1. One pass gives each text its shingle-set key, size and registers; texts with
   one set are one node from there on (its smallest id), however many there are.
2. Nodes meet in buckets of equal bands. Each bucket is a star: its members are
   compared with one centre (the member that meets most others), by the
   likelihood estimate of the registers; pairs that may reach the threshold are
   verified on full sets.
3. What a star alone would miss is not lost: members that are not of their
   centre's component are compared with all of the star that are of another
   component than theirs, on full sets, in blocks of bounded size that are dealt
   over tasks; only links leave a block.
4. Components by smallest-label propagation with pointer jumping over written
   tables; nothing of it reaches the driver but counts.

A pair at similarity 0.8 shares no band with chance (1 - 0.8^5)^40 = 1.3e-7.

Keys that many rows share (one text's copies, a crowded bucket, a large star's
centre, a large component's label) are dealt over copies of the one row they meet.

Edge cases: null and empty texts have no set and are linked with nothing; a very
long text is one row with a large set; of similar sets the smallest id names the group, and
ties of centres go to the larger id; rows with one doc_id count as one document's, each row is given; a null
doc_id is in no group; an empty table gives an empty one; only ``doc_id`` and ``text`` are
read, so columns of other names do not matter (``kept`` returns them all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm import sketch
from verdance.llm.common import discard, map_arrow, materialise, named, small_batches, split_by_filter, spread_join, texts

#: Standard deviation of an estimate near 0.8; pairs more than five of it below the threshold are not verified.
SIGMA = (0.8 * 0.2 / sketch.REGISTERS) ** 0.5
#: Shingles in a block of the side that is dealt out, and of the side that is copied.
BLOCK, COPIED = 1 << 14, 1 << 16
#: Rows of one key from which wide rows (registers, whole sets) are dealt over copies.
WIDE = 2_000
#: Rounds after which labels must have settled; each round at least halves the trees.
ROUNDS = 200


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, key, registers) of every row; key and registers are null for texts without words."""
    small_batches(docs.sparkSession)
    state: dict[str, sketch.WordHashes] = {}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = state.setdefault("h", sketch.WordHashes())
        sizes, keys, regs = [], [], []
        for t in texts(batch):
            own = sketch.shingles(t, hashes, width)
            sizes.append(len(own))
            keys.append(sketch.set_key(own) if len(own) else None)
            regs.append(sketch.registers(own).tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "key", "registers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles long, key binary, registers binary", state)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int = 2) -> DataFrame:
    """(id, hashes array<bigint>) of the nodes, worked out anew from their texts."""
    state: dict[str, sketch.WordHashes] = {}

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = state.setdefault("h", sketch.WordHashes())
        ids, sets = [], []
        for i, key, t in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), texts(batch), strict=True):
            own = sketch.shingles(t, hashes, width)
            if len(own) and sketch.set_key(own) == key:
                ids.append(i)
                sets.append(own.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    _, own = split_by_filter(docs.select(F.col("doc_id").alias("id"), "text"), "id", nodes.select("id"))
    own = own.join(nodes.select("id", "key"), "id")
    kind = nodes.schema["id"].dataType.simpleString()
    return map_arrow(own.select("id", "key", "text"), make, f"id {kind}, hashes array<bigint>", state)


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, centre, n, n_centre, guess) for pairs (id, centre)."""
    own = nodes.select("id", "n", F.col("registers").alias("r_own"))
    other = nodes.select(F.col("id").alias("centre"), F.col("n").alias("n_centre"), F.col("registers").alias("r_centre"))
    both = spread_join(pairs, other, "centre", "id", least=WIDE).join(own, "id")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, sketch.REGISTERS) for c in ("r_own", "r_centre")]
        sizes = [batch.column(c).to_numpy().astype(float) for c in ("n", "n_centre")]
        guess = sketch.estimate(*regs, *sizes)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "centre", "n", "n_centre")), pa.array(guess, pa.float64())], names=["id", "centre", "n", "n_centre", "guess"])

    kind = pairs.schema["id"].dataType.simpleString()
    return map_arrow(both.select("id", "centre", "n", "n_centre", "r_own", "r_centre"), make, f"id {kind}, centre {kind}, n long, n_centre long, guess double")


def _buckets(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, id, n) for buckets of n nodes, two or more, and (bucket, n)."""
    wide = 2 * sketch.ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(sketch.BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * wide + 1, F.lit(wide))))
    each = nodes.select("id", F.explode(keys).alias("bucket"))
    shared = materialise(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    return materialise(spread_join(each, shared, "bucket", "id", shared), "buckets"), shared


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimated pairs (id, centre, n, n_centre, guess), and the nodes that take part."""
    met, shared = _buckets(nodes)
    reach = met.groupBy("id").agg(F.sum("n").alias("reach"))
    part = materialise(nodes.join(reach, "id").select("id", "n", "key", "registers", "reach"), "part")
    members = met.select("bucket", "id").join(part.select("id", "reach"), "id")
    centres = members.groupBy("bucket").agg(F.max(F.struct("reach", "id")).alias("m")).select("bucket", F.col("m.id").alias("centre"))
    spokes = spread_join(met.select("bucket", "id"), centres, "bucket", "id", shared).filter("id != centre").select("id", "centre").distinct()
    spokes = materialise(spokes, "spokes")
    pairs = materialise(_estimated(spokes, part), "pairs")
    discard(met, shared, spokes)
    return pairs, part


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs whose full sets reach the threshold."""
    left = sets.select(F.col("id"), F.col("hashes").alias("own"))
    right = sets.select(F.col("id").alias("centre"), F.col("hashes").alias("other"))
    both = spread_join(pairs.select("id", "centre"), right, "centre", "id", least=WIDE).join(left, "id")
    inter = F.size(F.array_intersect("own", "other"))
    return both.withColumn("inter", inter).filter(F.lit(100) * F.col("inter") >= F.lit(percent) * (F.size("own") + F.size("other") - F.col("inter"))).select(F.col("id").alias("a"), F.col("centre").alias("b"))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, component): smallest id that is reachable, for every id of the edges (a, b)."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    if labels is None:
        labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    else:
        new = both.select(F.col("a").alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        labels = new.unionByName(labels.join(new.select("id"), "id", "left_anti"))
    labels = materialise(labels, "labels")
    for _ in range(ROUNDS):
        met = both.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("component").alias("m"))
        near = materialise(labels.join(met, F.col("id") == F.col("b"), "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component")), "near")
        # A label's own label: hooks whole trees, not only neighbours. Many rows share a label.
        hook = near.groupBy("was").agg(F.min("component").alias("to"))
        step = spread_join(near, hook, "was", "id", how="left").select("id", "was", F.least("component", "to").alias("component"))
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = spread_join(materialise(step, "hooked"), jump, "component", "id", how="left")
        step = materialise(step.select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        discard(labels, near)
        labels, same = step, step.filter("component != was").isEmpty()
        if same:
            discard(both)
            return labels.select("id", "component")
        labels = step
    raise RuntimeError(f"labels did not settle in {ROUNDS} rounds")


def _rest(pairs: DataFrame, part: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside stars between members of different components, found in blocks of bounded size."""
    own = labels.select(F.col("id").alias("_i"), "component")
    named = lambda df, c, to: df.join(own, F.col(c) == F.col("_i"), "left").withColumn(to, F.coalesce("component", c)).drop("_i", "component")
    star = pairs.select("centre", "id", "n")
    star = materialise(named(named(star, "id", "own"), "centre", "hub"), "stars")
    sums = star.groupBy("centre").agg(F.sum(F.when(F.col("own") != F.col("hub"), F.col("n"))).alias("apart"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("members"))
    sums = sums.filter("apart is not null and members > 1").select("centre", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil(F.col("apart") / COPIED).alias("copies"))
    star = star.join(sums, "centre")
    spread = lambda c, k: F.pmod(F.xxhash64(c, F.lit(3)), F.col(k))
    dealt = star.select("centre", "id", "own", F.lit(False).alias("driver"), spread("id", "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    drivers = star.filter("own != hub").select("centre", "id", "own", F.lit(True).alias("driver"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), spread("id", "copies").alias("copy"))
    rows = dealt.unionByName(drivers).join(sets, "id").select("centre", "block", "copy", "id", "own", "driver", "hashes")
    kind = part.schema["id"].dataType.simpleString()

    def links(table: pa.Table) -> pa.Table:
        ids, comp, driver = (np.array(table.column(c).to_pylist()) for c in ("id", "own", "driver"))
        column = table.column("hashes").combine_chunks()
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        sets_of = [flat[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
        rest = np.flatnonzero(~driver)
        a, b = [], []
        if len(rest):
            size = np.array([len(sets_of[i]) for i in rest])
            pool = np.concatenate([sets_of[i] for i in rest])
            owner = np.repeat(np.arange(len(rest)), size)
            for d in np.flatnonzero(driver):
                mine = sets_of[d]
                fit = (100 * np.minimum(size, len(mine)) >= percent * np.maximum(size, len(mine))) & (comp[rest] != comp[d])
                if not fit.any():
                    continue
                at = np.minimum(np.searchsorted(mine, pool), len(mine) - 1)
                both = np.bincount(owner[mine[at] == pool], minlength=len(rest))
                for j in np.flatnonzero(fit & (100 * both >= percent * (size + len(mine) - both))):
                    a.append(ids[d])
                    b.append(ids[rest[j]])
        to = table.schema.field("id").type
        return pa.table({"a": pa.array(a, to), "b": pa.array(b, to)})

    return rows.groupBy("centre", "block", "copy").applyInArrow(links, f"a {kind}, b {kind}")


def groups(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document row."""
    own = materialise(sketches(docs, width), "sketches")
    with_set = own.filter("key is not null and doc_id is not null")
    # The registers follow from the key, so any row's do.
    nodes = with_set.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "registers")).alias("m"))
    nodes = materialise(nodes.select("m.id", "m.n", "key", "m.registers"), "nodes")
    pairs, part = candidates(nodes)
    likely = pairs.filter((F.col("guess") >= percent / 100 - 5 * SIGMA) & (F.lit(100) * F.least("n", "n_centre") >= F.lit(percent) * F.greatest("n", "n_centre")))
    sets = materialise(full_sets(docs, part, width), "sets")
    edges = materialise(_verified(likely.select("id", "centre").distinct(), sets, percent), "links")
    labels = components(edges)
    more = materialise(_rest(pairs, part, sets, labels, percent).distinct(), "rest")
    if not more.isEmpty():
        labels = components(edges.unionByName(more), labels)
    discard(pairs, part, sets, edges, more)
    placed = nodes.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = spread_join(own, materialise(placed, "placed"), "key", "doc_id", how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def kept(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """Rows of ``docs``, one document of each group: the one with the smallest id. Rows with a null doc_id stay."""
    own = groups(docs, percent, width)
    gone = materialise(own.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    clear, others = split_by_filter(docs, "doc_id", gone)
    return clear.unionByName(others.join(gone, "doc_id", "left_anti").select(*named(docs)))
