"""Near-duplicate embeddings: NN-descent over a neighbour graph, kept to a cosine threshold.

Vectors are compared within (label, dimension) only. The first lists come from random-hyperplane
buckets, dealt into blocks of bounded size. Each round joins neighbours of neighbours: at every centre,
the vectors of its forward and reverse neighbours are compared with each other and improve both lists.
A vector whose list is full of links gets a longer one (``GROWTH`` times), up to ``max_list``. Equal vectors are
one vector with a weight. Components that still hold a full list are compared exactly, block by block, with
all vectors of their cell within the angle that links can span, which counts every link of theirs without
emitting pairs; the others are then linked among themselves. A bounded sample of these is audited against
brute force, each vector with links counting alike; below the target recall, further buckets and rounds are
added, and when these end below it, all vectors that are left are compared.

A vector that stands in many groups would get a list from each of them: a task merges its lists to the best ones
of each vector before they are shuffled, so a hub gets one list from each task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
with a null label, link with nothing; rows that repeat a vec_id count as one vector (the least label and
embedding); a null vec_id stands alone; vectors that tie are taken in order of vec_id; an empty table gives an
empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

BLOCK = 256
#: How many times longer a list gets when it is full of links.
GROWTH = 8
#: Into how many parts a bucket of more than two blocks is dealt before its size is known to its vectors.
DEAL = 64
LISTS = "v long, near array<struct<s:double,u:long>>"


def clean_vectors(df: DataFrame) -> DataFrame:
    """vec_id, cell (label and dimension) and the unit vector, for vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("x")).select("vec_id", "x.label", "x.e")
    fine = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("label is not null and e is not null").where(fine)
    top = F.array_max(F.transform("e", F.abs))
    rows = rows.where(top > 0).withColumn("e", F.transform("e", lambda x: x / top))  # no overflow in the norm
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("vec_id", F.concat_ws(":", F.size("e").cast("string"), "label").alias("cell"), F.transform("e", lambda x: x / norm).alias("x"))


def stack(column) -> np.ndarray:
    """A matrix of an Arrow column of equally long lists."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def first_lists(vectors: DataFrame, tables: int, seed: int, k: int, floor: float) -> DataFrame:
    """Lists of up to k neighbours from blocks of hyperplane buckets."""
    sizes = vectors.groupBy("cell").count()
    bits = F.greatest(F.ceil(F.log2(F.col("count") / BLOCK)), F.lit(0)).cast("int")
    keyed = vectors.join(sizes.select("cell", F.least(bits, F.lit(40)).alias("bits")), "cell")

    def codes(batches):
        import pyarrow as pa

        for batch in batches:
            x, bits = batch.column(2), np.asarray(batch.column(3))
            size = np.asarray(x.value_lengths())
            out = np.zeros((len(batch), tables), np.int64)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                m = stack(x.take(pa.array(rows)))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, dim]).standard_normal((dim, 40))
                    sign = (m @ planes > 0) * (1 << np.arange(40))
                    out[rows, t] = (sign * (np.arange(40) < bits[rows, None])).sum(axis=1)
            listed = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, listed], ["vec_id", "cell", "x", "codes"])

    coded = keyed.select("vec_id", "cell", "x", "bits").mapInArrow(codes, "vec_id long, cell string, x array<double>, codes array<long>")
    dealt = coded.select("vec_id", "cell", "x", F.posexplode("codes").alias("t", "code"))
    full = coded.select("cell", F.posexplode("codes").alias("t", "code")).groupBy("cell", "t", "code").count()
    parts = F.ceil(F.col("count") / (2 * BLOCK)).cast("long")
    large = full.withColumn("parts", parts).where("parts > 1").select("cell", "t", "code", "parts", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("deal"))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(DEAL)).cast("int"))
    salted = dealt.join(large, ["cell", "t", "code", "deal"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id", "t"), F.coalesce("parts", F.lit(1))))
    groups = salted.groupBy("cell", "t", "code", "salt").agg(F.collect_list(F.struct("vec_id", "x")).alias("g")).select(F.col("g.vec_id").alias("ids"), F.col("g.x").alias("xs"))
    return groups.where(F.size("ids") > 1).mapInArrow(all_pairs(k, floor), LISTS)


def all_pairs(k: int, floor: float):
    """For rows (ids, vectors) of bounded groups: every member's best k others of all groups of the task, from the floor up."""

    def best(parts):
        """Of (v, u, cosine) triples: each pair once, each vector's k best."""
        v, u, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((u, -s, v))
        v, u, s = v[by], u[by], s[by]
        again = np.lexsort((u, v))  # a pair's cosine may differ in its last bits between groups; the first is the best
        keep = np.ones(len(v), bool)
        keep[again[1:]] = (v[again][1:] != v[again][:-1]) | (u[again][1:] != u[again][:-1])
        v, u, s = v[keep], u[keep], s[keep]
        head = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
        rank = np.arange(len(v)) - np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))
        return v[rank < k], u[rank < k], s[rank < k]

    def run(batches):
        import pyarrow as pa

        parts, held, size = [], 0, 0

        def listed():
            v, u, s = best(parts)
            head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
            near = pa.ListArray.from_arrays(np.r_[head, len(v)].astype(np.int32), pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(u, pa.int64())], ["s", "u"]))
            return pa.RecordBatch.from_arrays([pa.array(v[head], pa.int64()), near], ["v", "near"])

        for batch in batches:
            for ids, xs in zip(batch.column(0), batch.column(1), strict=True):
                ids, m = np.asarray(ids.values), stack(xs.values)
                s = m @ m.T
                s[ids[:, None] == ids[None, :]] = -2
                if len(ids) > k + 1:  # no more than k of a row
                    low = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
                    i, j = np.nonzero(s >= np.maximum(low, floor)[:, None])
                else:
                    i, j = np.nonzero(s >= floor)
                parts.append((ids[i], ids[j], s[i, j]))
                held += len(i)
                if held > max(1 << 20, 2 * size):
                    parts = [best(parts)]
                    held = size = len(parts[0][0])
                    if size > 1 << 21:  # many vectors: what is merged so far goes on
                        yield listed()
                        parts, held, size = [], 0, 0
        if parts:
            yield listed()

    return run


def merged(lists: DataFrame, threshold: float, max_list: int, k: int) -> DataFrame:
    """Each vector's best neighbours of all its lists(v, near, cap), and the length of its list, longer where it is full of links."""
    one = lists.groupBy("v").agg(F.coalesce(F.max("cap"), F.lit(k)).alias("cap"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("near", lambda n: F.struct((-n["s"]).alias("s"), n["u"].alias("u"))))))).alias("all"))
    # a pair's cosine may differ in its last bits between blocks: a neighbour counts once
    first = F.filter("all", lambda n, i: ~F.exists(F.slice("all", F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), lambda m: m["u"] == n["u"]))
    one = one.withColumn("all", first)
    full = F.size(F.filter(F.slice("all", 1, F.col("cap")), lambda n: -n["s"] >= threshold)) >= F.col("cap")
    one = one.withColumn("full", full).withColumn("cap", F.when(F.col("full"), F.least(F.col("cap") * GROWTH, F.greatest("cap", F.lit(max_list)))).otherwise(F.col("cap")).cast("int"))
    return one.select("v", F.transform(F.slice("all", 1, F.col("cap")), lambda n: F.struct((-n["s"]).alias("s"), n["u"].alias("u"))).alias("near"), "cap", "full")


def link_edges(graph: DataFrame, threshold: float) -> DataFrame:
    return graph.select("v", F.explode("near").alias("n")).where(F.col("n.s") >= threshold).select(F.least("v", "n.u").alias("a"), F.greatest("v", "n.u").alias("b")).distinct()


def descend(graph: DataFrame, vectors: DataFrame, max_list: int, floor: float) -> DataFrame:
    """Lists from one round of neighbours of neighbours."""
    ahead = graph.select(F.col("v").alias("c"), F.explode("near").alias("n")).select("c", F.col("n.u").alias("u"), F.col("n.s").alias("s"))
    back = ahead.select(F.col("u").alias("c"), F.col("c").alias("u"), "s")
    # reverse neighbours are sampled by rank of a hash beyond the length of the longest list, as they are for a hub
    limited = back.groupBy("c", F.pmod(F.xxhash64("u"), F.lit(max_list)).alias("slot")).agg(F.min(F.struct(-F.col("s"), "u")).alias("m")).select("c", F.col("m.u").alias("u"))
    around = ahead.select("c", "u").unionAll(limited).unionAll(graph.select(F.col("v").alias("c"), F.col("v").alias("u")))
    # both lists are bounded, so a centre's set is; a centre with one neighbour has no pair to offer
    around = around.groupBy("c").agg(F.collect_set("u").alias("us")).where(F.size("us") > 2).select("c", F.explode("us").alias("u"))
    seen = around.join(vectors.select(F.col("vec_id").alias("u"), "x"), "u")
    groups = seen.groupBy("c").agg(F.collect_list(F.struct("u", "x")).alias("g")).select(F.col("g.u").alias("ids"), F.col("g.x").alias("xs"))
    return groups.mapInArrow(all_pairs(max_list, floor), LISTS)


def exact_links(members: DataFrame, live: DataFrame, threshold: float) -> DataFrame:
    """(v, n, root): all links between members(comp, vec_id, cell, x, w), which are among live, and live(vec_id, cell, x, w).

    n sums up to the weights of a vector's links, and edges (v, root) connect what is linked, given that a
    component is connected. Members are dealt into blocks; a vector meets a block only if its angle to the
    block's centre is at most the block's radius plus the threshold's angle, which no link exceeds.
    """
    size = members.groupBy("comp").count().select("comp", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    put = members.join(size, "comp").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    reach = math.acos(threshold)

    def centre(batches):
        import pyarrow as pa

        for batch in batches:
            out = {"comp": batch.column(0).to_pylist(), "block": batch.column(1).to_pylist(), "cell": batch.column(2).to_pylist(), "c": [], "low": []}
            for xs in batch.column(3):
                m = stack(xs.values)
                c = m.mean(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-6 else m[0]
                angle = math.acos(max(-1.0, min(1.0, float((m @ c).min())))) + reach
                out["c"].append(c.tolist())
                out["low"].append(math.cos(angle) - 1e-7 if angle < math.pi else -2.0)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("comp", pa.int64()), ("block", pa.int32()), ("cell", pa.string()), ("c", pa.list_(pa.float64())), ("low", pa.float64())]))

    # dealt by block, as a group that holds a third of all rows would else stay in the task that counted it
    held = put.repartition("comp", "block").groupBy("comp", "block").agg(F.min("cell").alias("cell"), F.collect_list("x").alias("xs"))
    centres = held.mapInArrow(centre, "comp long, block int, cell string, c array<double>, low double")
    parts = centres.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parts = parts.join(live.groupBy("cell").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("chunks")), "cell")
    asks = live.join(parts, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("comp"), F.lit(None).cast("int").alias("block"), F.col("vec_id").alias("u"), "x", F.lit(None).cast("double").alias("low"))
    told = centres.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("comp", "block"), F.col("parts")).cast("int").alias("part"), "comp", "block", F.lit(None).cast("long").alias("u"), F.col("c").alias("x"), "low")
    near = asks.unionAll(told).groupBy("cell", "chunk", "part").agg(F.collect_list(F.struct("comp", "block", "u", "x", "low")).alias("g")).select(*[F.col(f"g.{c}").alias(c) for c in ("comp", "block", "u", "x", "low")])

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            for comp, block, u, x, low in zip(*[batch.column(c) for c in range(5)], strict=True):
                m = stack(x.values)
                is_u = np.asarray(u.values.is_valid())
                a, b = np.flatnonzero(is_u), np.flatnonzero(~is_u)
                if not len(a) or not len(b):
                    continue
                i, j = np.nonzero(m[a] @ m[b].T >= np.asarray(low.values.take(pa.array(b)))[None, :])
                at = pa.array(b[j])
                yield pa.RecordBatch.from_arrays([comp.values.take(at), block.values.take(at), u.values.take(pa.array(a[i]))], ["comp", "block", "u"])

    met = near.mapInArrow(meet, "comp long, block int, u long")
    inside = members.select(F.col("vec_id").alias("u"), F.lit(True).alias("inside"))
    chunks = met.groupBy("comp", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    put = put.select("comp", "block", "vec_id", "x", "w").join(chunks, ["comp", "block"])
    others = met.join(chunks, ["comp", "block"]).join(live.select(F.col("vec_id").alias("u"), "x", "w"), "u").join(inside, "u", "left")
    others = others.select("comp", "block", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"), F.col("u").alias("id"), "x", "w", F.coalesce("inside", F.lit(False)).alias("inside"))
    sides = others.unionAll(put.select("comp", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False), "vec_id", "x", "w", F.lit(True)))
    groups = sides.groupBy("comp", "block", "chunk").agg(F.collect_list(F.struct("asks", "id", "x", "w", "inside")).alias("g")).select(*[F.col(f"g.{c}").alias(c) for c in ("asks", "id", "x", "w", "inside")])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for asks, ids, xs, w, inner in zip(*[batch.column(c) for c in range(5)], strict=True):
                asks, ids, w, inner, m = np.asarray(asks.values), np.asarray(ids.values), np.asarray(w.values), np.asarray(inner.values), stack(xs.values)
                a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
                hit = (m[a] @ m[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
                # members that ask are counted by their own question only
                n = np.r_[hit @ w[b], (hit & ~inner[a][:, None]).T @ w[a]]
                top, ra, rb = np.iinfo(np.int64).max, ids[a], ids[b]
                while True:
                    na = np.minimum(ra, np.where(hit, rb[None, :], top).min(axis=1, initial=top))
                    nb = np.minimum(rb, np.where(hit, na[:, None], top).min(axis=0, initial=top))
                    if (na == ra).all() and (nb == rb).all():
                        break
                    ra, rb = na, nb
                keep = np.r_[hit.any(axis=1), hit.any(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[a], ids[b]][keep], pa.int64()), pa.array(n[keep], pa.int64()), pa.array(np.r_[ra, rb][keep], pa.int64())], ["v", "n", "root"])

    return groups.mapInArrow(run, "v long, n long, root long")


def audit(vectors: DataFrame, found: DataFrame, threshold: float, queries: int) -> float:
    """The mean share of their true links that is found(v, n), over a bounded sample of vectors and those with links."""
    sample = vectors.select("vec_id", "cell", "x", F.xxhash64("vec_id", F.lit(17)).alias("h")).orderBy("h", "vec_id").limit(queries)
    rows = [(r["vec_id"], r["cell"], np.array(r["x"])) for r in sample.collect()]
    if not rows:
        return 1.0
    by_cell: dict[str, list] = {}
    for v, cell, x in rows:
        by_cell.setdefault(cell, []).append((v, x))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cells = np.array(batch.column(1).to_pylist(), object)
            n = {}
            for cell, ask in by_cell.items():
                at = np.flatnonzero(cells == cell)
                if len(at):
                    m, ids = stack(batch.column(2).take(pa.array(at))), np.asarray(batch.column(0))[at]
                    for v, x in ask:
                        n[v] = int(((m @ x >= threshold) & (ids != v)).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["v", "n"])

    true = vectors.select("vec_id", "cell", "x").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("true"))
    share = F.coalesce("n", F.lit(0)) / F.col("true")
    row = true.where(F.col("true") > 0).join(found, "v", "left").agg(F.avg(F.least(share, F.lit(1.0)))).first()
    return 1.0 if row[0] is None else float(row[0])


def tables_needed(count: int, threshold: float, chance: float) -> int:
    """Tables of hyperplane buckets in which a pair at the threshold meets at least once with the given chance."""
    bits = min(40, max(0, math.ceil(math.log2(max(count, 1) / BLOCK))))
    apart = 1 - (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - chance) / math.log(apart))) if apart > 0 else 1


def near_vectors(df: DataFrame, threshold: float = 0.93, k: int = 8, max_list: int = 64, tables: int = 4, rounds: int = 4, target: float = 0.97, queries: int = 256, retries: int = 3) -> DataFrame:
    """One row per row of df(vec_id, embedding, label): vec_id, n_links, component_id, kept, recall (as audited)."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(clean_vectors(df), "rows")
    vectors = scratch.write(rows.groupBy("cell", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w")).select("vec_id", "cell", "x", "w"), "vectors")
    floor = 2 * threshold * threshold - 1  # cosine of twice the angle: what a common neighbour guarantees
    live, lists, recall, step = vectors, None, 1.0, 0
    counts, bonds = [], []  # of vectors that were compared with all others

    def linked(graph: DataFrame) -> int:
        return graph.agg(F.sum(F.size(F.filter("near", lambda x: x["s"] >= threshold)))).first()[0] or 0

    def settle(members: DataFrame, name: str) -> None:
        hits = scratch.write(exact_links(members, live, threshold), name)
        counts.append(hits.select("v", "n"))
        bonds.append(hits.select(F.col("v").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())

    for again in range(retries + 1):
        largest = live.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        new = first_lists(live, max(tables, tables_needed(largest, threshold, target)), again, k, floor)
        new = new.withColumn("cap", F.lit(None).cast("int"))
        graph = scratch.write(merged(new if lists is None else new.unionAll(lists), threshold, max_list, k), f"graph-{step}")
        links = linked(graph)
        for _ in range(rounds):
            step += 1
            better = descend(graph, live, max_list, floor).withColumn("cap", F.lit(None).cast("int"))
            graph = scratch.write(merged(graph.select("v", "near", "cap").unionAll(better), threshold, max_list, k), f"graph-{step}")
            n = linked(graph)
            if n <= 1.001 * links:
                break
            links = n
        lists, step = graph.select("v", "near", "cap"), step + 1
        edges = scratch.write(link_edges(graph, threshold), f"edges-{again}")
        full = graph.where("full").select("v")  # at the length it had: rounds may have ended before it was tried with a longer one
        settled = not full.isEmpty()
        if settled:  # their lists may leave links out: compared with all that is left, then set apart
            comps = connected_components(edges, scratch, f"comps-{again}")
            dense = comps.join(full, "v", "left_semi").select("comp").distinct()
            members = scratch.write(comps.join(dense, "comp", "left_semi").withColumnRenamed("v", "vec_id").join(live, "vec_id").select("comp", "vec_id", "cell", "x", "w"), f"members-{again}")
            settle(members, f"exact-{again}")
            gone = members.select(F.col("vec_id").alias("a"))
            bonds.append(edges.join(gone, "a", "left_semi"))
            edges = edges.join(gone, "a", "left_anti")
            live = scratch.write(live.join(members, "vec_id", "left_anti"), f"live-{again}")
            ids = live.select(F.col("vec_id").alias("v"))
            lists = lists.join(ids, "v", "left_semi").select("v", "cap", F.explode("near").alias("n")).withColumn("u", F.col("n.u")).join(ids.toDF("u"), "u", "left_semi").groupBy("v").agg(F.collect_list("n").alias("near"), F.max("cap").alias("cap"))
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionAll(edges.select("b", "a"))
        listed = scratch.write(ends.join(live.select(F.col("vec_id").alias("u"), "w"), "u").groupBy("v").agg(F.count("*").alias("links"), F.sum("w").alias("n")), f"listed-{again}")
        recall = audit(live, listed.select("v", F.col("links").alias("n")), threshold, queries)
        if recall >= target and not settled:
            break
    if recall >= target:
        counts.append(listed.select("v", "n"))
        bonds.append(edges)
    else:  # all that is left is compared; a cell counts as one component, whose blocks need not be linked
        cells = live.groupBy("cell").agg(F.min("vec_id").alias("comp"))
        settle(live.join(cells, "cell").select("comp", "vec_id", "cell", "x", "w"), "exact")
        recall = 1.0
    total = functools.reduce(DataFrame.unionAll, counts).groupBy(F.col("v").alias("vec_id")).agg(F.sum("n").alias("n"))
    comps = connected_components(functools.reduce(DataFrame.unionAll, bonds), scratch, "comps").toDF("vec_id", "comp")
    classes = vectors.join(total, "vec_id", "left").join(comps, "vec_id", "left").select("cell", "x", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("comp", "vec_id").alias("comp"))
    each = scratch.write(rows.join(classes, ["cell", "x"]).select("vec_id", "n", "comp"), "each")
    scratch.keep("each")
    out = df.select(F.col("vec_id").cast("long").alias("vec_id")).join(each, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"), F.lit(recall).alias("recall")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).select("vec_id", "n_links", "component_id", "kept", "recall")
