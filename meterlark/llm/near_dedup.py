"""MinHash near-dedup with min-max hashing.

1. Each text becomes its set of distinct word shingles and a signature of minima and maxima (minhash.py); documents with equal
   sets form a class, represented by its smallest id.
2. Classes whose signatures agree in a band meet in a bucket. A bucket gives a star of candidate links, not all pairs;
   the components of these stars are the units of work. The sets of all classes that have a bucket are written once.
3. In a component of more than UNIT classes a few rounds hold each class against two pivots of its buckets, which settles most of
   a large group of near copies in a pass over it each. A bucket whose classes are joined by then is done.
   What is left of the component is compared bucket by bucket, each distinct one once, or as one unit, whichever takes fewer pairs.
4. In a unit, pairs are confirmed on full shingle sets: every pair, but for those inside the largest part that the
   pivots have joined, which needs no more links. A large unit is split into blocks (BLOCK classes or BLOCK_BYTES at most, about),
   and each pair of blocks is a task of its own, so no task holds more than two blocks. A task returns a spanning forest of the
   links it finds, which has the same components as all of them.
5. The components of the confirmed links, and each class's members, give the answer.

Tables in the shared folder are removed as soon as nothing reads them; only those that the result is read from stay.

A band has six values, and there are as many bands as keep the chance to miss a pair at the threshold below one in 100,000
(25 at 0.85, 38 at 0.8).

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is its own component. A
text with fewer words than a shingle has one shingle, the whole sequence. Rows that repeat an id and text share
its component, each is kept if the id is. A row with a null id gets a null component and is kept. An empty table gives an empty result. Columns beyond
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_parts, fresh_name, map_batches
from .graph import connected_components
from .minhash import band_codes, bands_for, shingle_set, signature

UNIT = 512
BLOCK = 2048
BLOCK_BYTES = 8 << 20
PIVOT_ROUNDS = 3
#: Up to so many ids (8 bytes each) are broadcast to pick the texts whose sets are needed.
BROADCAST_IDS = 1_000_000
#: Up to so many rows (40 bytes) of work are broadcast to the sets they need.
BROADCAST_WORK = 300_000
#: Up to so many bytes of pivots' sets are broadcast to the classes that are held against them.
BROADCAST_SETS = 16 << 20
#: Columns of the incidence matrix that are multiplied at once.
SLAB = 2048


def signatures(docs: DataFrame, shingle: int, count: int) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, bands) for each row; bands is null without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, hi, lo, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, shingle)
            code = set_code(s)
            n.append(len(s))
            hi.append(code[0])
            lo.append(code[1])
            bands.append(band_codes(signature(s, count)).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip((n, hi, lo, bands), list(schema)[1:]))], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, schema)


def set_code(items: np.ndarray) -> tuple[int, int]:
    high, low = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), dtype=np.int64)
    return int(high), int(low)


def shingle_sets(docs: DataFrame, reps: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(rep, items) for the classes in ``reps`` (rep, set_lo): their sets as sorted unsigned 64-bit numbers, read from the texts."""
    few = reps.select("rep", "set_lo")
    few = F.broadcast(few) if few.count() <= BROADCAST_IDS else few
    rows = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(few, "rep")
    schema = pa.schema([("rep", pa.int64()), ("items", pa.binary())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            made = [(rep, shingle_set(text, shingle), low) for rep, text, low in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns])]
            made = [(rep, items) for rep, items, low in made if set_code(items)[1] == low]  # an id may have another text as well
            yield pa.RecordBatch.from_arrays([pa.array([rep for rep, _ in made], pa.int64()), pa.array([items.tobytes() for _, items in made], pa.binary())], schema=schema)

    sets = scratch.keep(map_batches(rows.select("rep", "text", "set_lo"), run, schema))
    if sets.count() == reps.count():
        return sets
    once = scratch.keep(sets.dropDuplicates(["rep", "items"]))  # rows repeat an id and text
    scratch.drop(sets)
    return once


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, from slabs of their incidence matrices."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left]).reshape(len(left), len(right))
    owner_l = np.repeat(np.arange(len(left)), [len(s) for s in left])
    owner_r = np.repeat(np.arange(len(right)), [len(s) for s in right])
    items_l, items_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(items_l, items_r)
    place_l, place_r = np.searchsorted(shared, items_l), np.searchsorted(shared, items_r)
    in_l = (place_l < len(shared)) & (shared[np.minimum(place_l, len(shared) - 1)] == items_l) if len(shared) else np.zeros(len(items_l), bool)
    in_r = (place_r < len(shared)) & (shared[np.minimum(place_r, len(shared) - 1)] == items_r) if len(shared) else np.zeros(len(items_r), bool)
    place_l, owner_l, place_r, owner_r = place_l[in_l], owner_l[in_l], place_r[in_r], owner_r[in_r]
    order_l, order_r = np.argsort(place_l, kind="stable"), np.argsort(place_r, kind="stable")
    place_l, owner_l, place_r, owner_r = place_l[order_l], owner_l[order_l], place_r[order_r], owner_r[order_r]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), SLAB):
        sides = []
        for place, owner, count in ((place_l, owner_l, len(left)), (place_r, owner_r, len(right))):
            a, b = np.searchsorted(place, [at, at + SLAB])
            m = np.zeros((count, min(SLAB, len(shared) - at)), np.float32)
            m[owner[a:b], place[a:b] - at] = 1.0
            sides.append(m)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def forest(linked: np.ndarray, a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links that join the nodes of ``a`` (rows) and ``b`` (columns) as the matrix does."""
    nodes = sorted({*a, *b})
    at = {v: k for k, v in enumerate(nodes)}
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, row in enumerate(linked):
        for j in np.flatnonzero(row):
            x, y = find(at[a[i]]), find(at[b[j]])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((a[i], b[j]))
    return out


def confirm(first: list[tuple[int, np.ndarray]], second: list[tuple[int, np.ndarray]] | None, threshold: int) -> list[tuple[int, int]]:
    """Links inside a block, or between two: 100 * intersection >= threshold * union."""
    other = first if second is None else second
    if not first or not other:
        return []
    n, m = np.array([len(s) for _, s in first]), np.array([len(s) for _, s in other])
    common = common_counts([s for _, s in first], [s for _, s in other])
    linked = 100 * common >= threshold * (n[:, None] + m[None, :] - common)
    if second is None:
        linked = np.triu(linked, 1)
    return forest(linked, [k for k, _ in first], [k for k, _ in other])


def confirmed_links(units: DataFrame, sets: DataFrame, threshold: int, block: int, block_bytes: int, scratch: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the links in each unit (kind, unit, rep, size, main). Pairs of two ``main`` classes are joined already.

    The first ``rest`` blocks of a unit hold the other classes, the last ones the main classes; main blocks meet no main block.
    """
    bytes_of = lambda test: F.coalesce(F.sum(F.when(test, 8 * F.col("size"))), F.lit(0))
    blocks_of = lambda test: F.greatest(F.ceil(F.count_if(test) / block), F.ceil(bytes_of(test) / block_bytes)).cast("int")
    sizes = scratch.keep(units.groupBy("kind", "unit").agg(blocks_of(~F.col("main")).alias("rest"), blocks_of(F.col("main")).alias("mains")))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("main"), F.col("rest") + place(F.col("mains"))).otherwise(place(F.col("rest")))
    others = F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    rows = units.join(sizes, ["kind", "unit"]).withColumn("block", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    rows = scratch.keep(rows.select("kind", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep"))
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    keys = ["kind", "unit", "i", "j"]
    dealt = sets.join(F.broadcast(rows) if rows.count() <= BROADCAST_WORK else rows, "rep")
    dealt = dealt.select(*keys, "block", "rep", "items").repartition(parts, *keys).sortWithinPartitions(*keys, "block", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for *key, blk, rep, items in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    out += settle(now, held)
                    now, held = key, []
                held.append((blk, rep, np.frombuffer(items, dtype=np.uint64)))
            if len(out) > 50_000:
                yield links_of(out)
                out = []
        yield links_of(out + settle(now, held))

    def settle(key, held) -> list[tuple[int, int]]:
        if key is None:
            return []
        first = [(rep, s) for blk, rep, s in held if blk == key[2]]
        return confirm(first, None if key[2] == key[3] else [(rep, s) for blk, rep, s in held if blk != key[2]], threshold)

    def links_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def pivot_links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b): those of ``pairs`` (rep, pivots) that are linked, confirmed on full sets."""
    lone = pairs.select(F.explode("pivots").alias("rep")).distinct()
    wanted = sets.join(lone, "rep", "left_semi")
    total = wanted.agg(F.coalesce(F.sum(F.length("items")), F.lit(0))).first()[0]
    wanted = wanted.select(F.col("rep").alias("pivot"), F.col("items").alias("pivot_items"))
    both = sets.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_WORK else pairs, "rep").withColumn("pivot", F.explode("pivots"))
    both = both.join(F.broadcast(wanted) if total <= BROADCAST_SETS else wanted, "pivot")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for pivot, rep, items, other in zip(*[c.to_pylist() for c in batch.columns]):
            s, t = np.frombuffer(items, np.uint64), np.frombuffer(other, np.uint64)
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= threshold * (len(s) + len(t) - common):
                found.append((pivot, rep))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return map_batches(both.select("pivot", "rep", "items", "pivot_items"), run, schema)


def settled(inside: DataFrame, sets: DataFrame, threshold: int, unit: int, rounds: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rounds of pivots over ``inside`` (component, code, rep, size): the links found, and the rows of buckets still open, with the ``part``
    that the links have joined each class to. It ends early once the open buckets hold few pairs a class."""
    links, last = None, scratch.keep(inside.withColumn("part", F.col("rep")))
    for nth in range(rounds):
        # The pivot of a bucket is its smallest class, in later rounds one drawn by hash.
        drawn = F.col("rep") if nth == 0 else F.xxhash64("rep", F.lit(nth))
        best = last.groupBy("code").agg(F.min_by(F.struct("rep", "part"), drawn).alias("p"), F.count("*").alias("n"))
        chosen = F.array(F.max_by("p", F.struct("n", -F.col("p.rep"))), F.min("p"))
        pairs = last.join(best, "code").groupBy("rep", "part").agg(chosen.alias("ps"))
        pairs = pairs.select("rep", F.array_distinct(F.transform(F.filter("ps", lambda p: p["part"] != F.col("part")), lambda p: p["rep"])).alias("pivots")).where(F.size("pivots") > 0)
        pairs = scratch.keep(pairs)
        more = scratch.keep(pivot_links(pairs, sets, threshold) if links is None else pivot_links(pairs, sets, threshold).unionByName(links))
        scratch.drop(pairs, *([] if links is None else [links]))
        links = more
        parts = connected_components(links, scratch)
        joined = last.drop("part").join(parts.withColumnRenamed("node", "rep").withColumnRenamed("component", "part"), "rep", "left")
        joined = scratch.keep(joined.withColumn("part", F.coalesce("part", "rep")))
        open_ = joined.groupBy("code").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
        still = scratch.keep(joined.join(open_.select("code"), "code", "left_semi").select("component", "code", "rep", "size", "part"))
        scratch.drop(last, parts, joined)
        last = still
        state = last.agg(F.count_distinct("rep").alias("reps"), F.count("*").alias("n")).first()
        if state.reps <= unit:
            break
    return links, last


def open_units(left: DataFrame) -> DataFrame:
    """(kind, unit, rep, size, main) for the open buckets of ``left`` (component, code, rep, size, part): of a component either its distinct
    buckets (kind 1) or all of its classes together (kind 2), whichever has fewer pairs to compare."""
    pairs = lambda n, top: (n - top) * ((n - top) / 2 + top)
    parts = left.groupBy("component", "code", "part").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"))
    buckets = parts.groupBy("component", "code").agg(F.max_by("part", F.struct("n", "part")).alias("main_part"), F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    once = buckets.groupBy("component", "n", "s", "x").agg(F.min(F.struct("code", "main_part", "top")).alias("b")).select("component", "n", "b.*")
    classes = left.select("component", "rep", "size", "part").distinct()
    whole = classes.groupBy("component", "part").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("whole_part"), pairs(F.sum("n"), F.max("n")).alias("whole_pairs"))
    plan = once.groupBy("component").agg(F.sum(pairs(F.col("n"), F.col("top"))).alias("bucket_pairs")).join(whole, "component")
    together = F.col("whole_pairs") <= F.col("bucket_pairs")
    apart = left.join(once.join(plan.where(~together), "component").select("code", "main_part"), "code").select(F.lit(1).alias("kind"), F.col("code").alias("unit"), "rep", "size", (F.col("part") == F.col("main_part")).alias("main"))
    return apart.unionByName(classes.join(plan.where(together), "component").select(F.lit(2).alias("kind"), F.col("component").alias("unit"), "rep", "size", (F.col("part") == F.col("whole_part")).alias("main")))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, unit: int = UNIT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. Linked where 100 * intersection >= threshold * union."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(signatures(docs, shingle, bands_for(threshold)))
    filled = found.where(F.col("bands").isNotNull() & F.col("doc_id").isNotNull())
    classes = scratch.keep(filled.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))
    codes = classes.select("rep", "size", F.explode("bands").alias("code"))
    buckets = scratch.keep(codes.groupBy("code").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("code", "pivot"))
    members = scratch.keep(codes.join(buckets, "code"))
    scratch.drop(buckets)
    coarse = connected_components(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")), scratch)
    sizes = scratch.keep(coarse.groupBy("component").agg(F.count("*").alias("n")))
    reps = scratch.keep(classes.select("rep", "size", "set_lo").join(coarse.withColumnRenamed("node", "rep"), "rep"))
    sets = shingle_sets(docs, reps, shingle, scratch)
    small = reps.join(sizes.where(F.col("n") <= unit), "component").select(F.lit(0).alias("kind"), F.col("component").alias("unit"), "rep", "size", F.lit(False).alias("main"))
    large = sizes.where(F.col("n") > unit).select("component")
    links = None
    if large.isEmpty():
        units = scratch.keep(small)
    else:
        inside = members.select("code", "rep").join(reps.join(large, "component", "left_semi").drop("set_lo"), "rep")
        links, left = settled(inside, sets, threshold, unit, rounds, scratch)
        units = scratch.keep(small.unionByName(open_units(left)))
    confirmed = confirmed_links(units, sets, threshold, block, block_bytes, scratch)
    confirmed = scratch.keep(confirmed if links is None else confirmed.unionByName(links))
    components = connected_components(confirmed, scratch)
    ranked = classes.select("set_hi", "set_lo", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    ranked = scratch.keep(ranked.select(F.col("set_hi").alias("hi"), F.col("set_lo").alias("lo"), F.coalesce("component", "rep").alias("component")))
    scratch.drop_all_but(found, ranked)
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    joined = found.select("doc_id", "n_shingles", "set_hi", "set_lo").join(ranked, (F.col("set_hi") == F.col("hi")) & (F.col("set_lo") == F.col("lo")), "left")
    component = F.when(F.col("doc_id").isNotNull(), own)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose component has a document of a smaller id; all columns stay."""
    gone_id = fresh_name(docs, "gone_id")
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col(gone_id), "left_anti")
