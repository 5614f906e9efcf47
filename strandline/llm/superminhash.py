"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Each word shingle draws, in the order of its own random permutation of the slots, the values
``step + u``; a slot keeps its least value. The permutation makes the slots' ranks differ within an
element, which lowers the variance, and a document stops as soon as every slot holds a value below
the next step. Steps are taken for all elements of a chunk at once, which gives the same minima.

Defined results: null or wordless text has an empty set, links with nothing and is its own group;
equal sets always link, repeated rows among them; a doc_id with several texts is one document that links by any
of them; a null doc_id stands alone (component_id null, kept); texts of any length are read whole; among leads
that tie the least doc_id is taken; an empty table gives an empty table. Extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, chunks, mix, odd_constants, release, text_buffer
from .components import joined_components

SIGNATURE = "doc_id long, tag long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"
#: Cells of the parity sketch: in how many two sets differ is at most the size of their symmetric difference.
PARITY = 1024
SETS = "doc_id long, n_shingles long, shingles array<long>"


def document_sets(hasher, column, width: int):
    """The sorted distinct shingle hashes of each row of an Arrow string column, in order."""
    import numpy as np

    keys = odd_constants(width + 1, 77)
    raw, starts, ends = text_buffer(column)
    for i, j in chunks(starts, ends):
        h, _, _, count = hasher(raw, starts[i:j], ends[i:j])
        at = np.r_[0, np.cumsum(count)]
        n = max(0, len(h) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += h[k : k + n] * keys[k]
        rolled = mix(rolled)
        for d in range(j - i):
            a, words = int(at[d]), int(count[d])
            if words >= width:
                yield np.unique(rolled[a : a + words - width + 1])
            elif words:
                whole = (h[a : a + words] * keys[:words]).sum(dtype=np.uint64) + keys[width : width + 1] * np.uint64(words)
                yield mix(whole)
            else:
                yield np.zeros(0, np.uint64)


def superminhash(sets: list, slots: int, block: int = 1 << 15):
    """Signatures (documents x slots) of sets of 64-bit hashes; the top byte of a value is its step."""
    import numpy as np

    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    seeds = odd_constants(slots, 5)
    sizes = np.array([len(s) for s in sets], np.int64)
    i = 0
    while i < len(sets):
        j, total = i + 1, sizes[i]
        while j < len(sets) and total + sizes[j] <= block:
            total += sizes[j]
            j += 1
        if total:
            x, doc = np.concatenate(sets[i:j]), np.repeat(np.arange(i, j), sizes[i:j])
            sig = out.reshape(-1)
            order = None
            for step in range(slots):
                draw = mix(x * seeds[step] + np.uint64(step))
                pick = step + ((draw & np.uint64(0xFFFFFF)) % np.uint64(slots - step)).astype(np.int64)
                value = (np.uint64(step) << np.uint64(56)) | (mix(draw) >> np.uint64(8))
                if order is None:
                    first, slot = pick, pick
                else:
                    rows = np.arange(len(x))
                    slot = order[rows, pick].astype(np.int64)
                    order[rows, pick] = order[rows, step]
                np.minimum.at(sig, doc * slots + slot, value)
                unfilled = out[i:j].max(axis=1) >> np.uint64(56) > np.uint64(step)
                unfilled &= sizes[i:j] > 0
                if not unfilled.any():
                    break
                stay = unfilled[doc - i]
                x, doc = x[stay], doc[stay]
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
                    order[np.arange(len(x)), first[stay]] = 0
                elif not stay.all():
                    order = order[stay]
        i = j
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int, slots: int, tag: Column) -> DataFrame:
    """Set size, a 128-bit digest of the set, a hash of each band, and a sketch, for every row.

    The sketch has four bits of each slot, and for each of PARITY cells the parity of the elements in it.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher("space")
        salts = odd_constants(bands * rows, 9)
        for batch in batches:
            sets, at = document_sets(hasher, batch.column(1), width), 0
            while part := list(itertools.islice(sets, 256)):
                sig = superminhash(part, slots)
                keys = mix((sig[:, : bands * rows] * salts).reshape(len(part), bands, rows).sum(axis=2, dtype=np.uint64))
                nibbles = (mix(sig) >> np.uint64(60)).reshape(len(part), slots // 16, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
                sketch = nibbles.sum(axis=2, dtype=np.uint64)
                digest = [[int(mix(s + np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for s in part] for k in (1, 2)]
                listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1).view(np.int64))
                parity = np.stack([np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1) for s in part]).view(np.uint64)
                sketch = np.ascontiguousarray(np.c_[sketch, parity])
                packed = pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, sketch.shape[1], dtype=np.int32), sketch.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array([len(s) for s in part], pa.int64()), pa.array(digest[0], pa.int64()), pa.array(digest[1], pa.int64()), listed, packed],
                    ["doc_id", "tag", "n_shingles", "d1", "d2", "bands", "sketch"],
                )
                at += len(part)
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), tag.cast("long").alias("tag")).mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """The whole shingle set of every row, as hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher("space")
        for batch in batches:
            sets, at = document_sets(hasher, batch.column(1), width), 0
            while part := list(itertools.islice(sets, 256)):
                ends = np.r_[0, np.cumsum([len(s) for s in part])].astype(np.int32)
                listed = pa.ListArray.from_arrays(ends, np.concatenate(part).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len(s) for s in part], pa.int64()), listed], ["doc_id", "n_shingles", "shingles"])
                at += len(part)
            release()

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def differing_slots(a: str, b: str, longs: int) -> Column:
    """Slots whose four bits differ, of two sketches."""
    total = F.lit(0)
    for i in range(longs):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def differing_cells(a: str, b: str, first: int) -> Column:
    total = F.lit(0)
    for i in range(first, first + PARITY // 64):
        total = total + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return total


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, slots: int = 128, leads: int = 2, tag: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept (and ``tag``, a column of longs).

    Documents with equal sets collapse to their least doc_id. Representatives meet in buckets of equal
    bands: at a similarity of 0.8, 32 bands of 4 rows miss a pair with probability (1 - 0.8^4)^32, below
    1e-7. A bucket first compares its members with the one that meets most others, the likely origin of a
    group of near copies, at one comparison a member. For ``leads`` rounds, buckets whose members are still
    in different components take a further lead from another component; what is open then is compared
    across components in full, so no candidate is dropped. Before sets are compared, pairs go whose parity
    cells prove that their symmetric difference is too large (this loses nothing, and is sharp up to about
    a thousand shingles), or whose sketches differ in more slots than six standard deviations above the
    mean at the threshold (this misses a pair at the threshold with probability below 1e-7).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows_ = scratch.write(signatures(docs, width, bands, rows, slots, F.col(tag) if tag else F.lit(0)), "signatures")
    whole = rows_.where("n_shingles > 0 and doc_id is not null")
    reps = scratch.write(whole.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    first = whole.join(reps.select("d1", "d2", F.col("rep").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    members = first.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "hash"))
    members = scratch.write(members, "members")
    sizes = members.groupBy("band", "hash").agg(F.count("*").alias("size")).where("size > 1")
    shared = members.join(sizes, ["band", "hash"]).select("band", "hash", "v", "n", "size").distinct()
    shared = scratch.write(shared, "shared")
    scratch.drop("members")
    meets = shared.groupBy("v").agg(F.sum("size").alias("meets"))
    shared = scratch.write(shared.drop("size").join(meets, "v"), "buckets")
    sketches = scratch.write(first.join(meets.select(F.col("v").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["v"]), "sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    differ = (1 - percent / 100) * 15 / 16
    most = math.ceil(slots * differ + 6 * math.sqrt(slots * differ * (1 - differ)))
    similar = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    alike = similar & (differing_cells("ka", "kb", slots // 16) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)) & (differing_slots("ka", "kb", slots // 16) <= most)
    ka, kb = sketches.toDF("a", "na", "ka"), sketches.toDF("b", "nb", "kb")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough."""
        pairs = scratch.write(pairs, f"pairs-{name}")
        want = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
        sets = scratch.write(shingle_sets(texts.join(want, "doc_id", "left_semi"), width).where("n_shingles > 0"), f"sets-{name}")
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        # no distinct here: it would be computed in the join's own partitions, and a hot document in one task
        links = scratch.write(both.where(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select("a", "b"), f"links-{name}")
        scratch.drop(f"sets-{name}")
        return links

    comps, led = None, None
    for r in range(leads + 1):
        if comps is None:
            named = shared.withColumn("comp", F.col("v"))
        else:
            named = shared.join(comps, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        open_ = named.groupBy("band", "hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "hash")
        named = scratch.write(named.join(open_, ["band", "hash"]), f"open-{r}")
        if named.isEmpty():
            break
        x = named.select("band", "hash", F.col("v").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
        y = named.select("band", "hash", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
        if r < leads:
            fresh = named
            if led is not None:
                used = led.join(named.select("band", "hash", F.col("v").alias("a"), "comp"), ["band", "hash", "a"]).select("band", "hash", "comp").distinct()
                fresh = named.join(used, ["band", "hash", "comp"], "left_anti")
            new = fresh.groupBy("band", "hash").agg(F.max(F.struct("meets", -F.col("v"))).alias("m")).select("band", "hash", (-F.col("m.col2")).alias("a"))
            new = scratch.write(new, f"lead-{r}")
            led = new if led is None else led.unionAll(new)
            x = x.join(new, ["band", "hash", "a"], "left_semi")
            met = y.join(x, ["band", "hash"]).where((F.col("ca") != F.col("cb")) & similar).select("a", "b").distinct()
            pairs = met.join(kb, "b").join(ka, "a").where(alike)
        else:
            x, y = x.drop("na").join(ka, "a"), y.drop("nb").join(kb, "b")
            pairs = x.join(y, ["band", "hash"]).where((F.col("ca") < F.col("cb")) & alike)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = verified(pairs, str(r))
        if not new.isEmpty():
            comps = joined_components(comps, new, scratch, f"comps-{r}")
    if comps is None:
        comps = spark.createDataFrame([], "v long, comp long")
    final = reps.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("d1", "d2", F.coalesce("comp", "rep").alias("comp"))
    out = rows_.join(final, ["d1", "d2"], "left")
    scratch.keep("signatures", "classes", *[n for n in scratch.names if n.startswith("comps-")])
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *(["tag"] if tag else []), "n_shingles", comp.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
