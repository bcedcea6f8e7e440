"""Sharding by a k-d tree over document metadata.

A node that is to hold n shards is cut at the weighted n//2 : n quantile of bytes along its widest dimension, until
every leaf is one shard.  Dimensions are scaled to whole numbers over the table's range: sizes by their logarithm, labels
by the rank of their name among the table's distinct names.  A cut orders documents by
(dimension, hash of the text, hash of the id), so it falls within a document of the wanted byte and equal texts, which
share their group's metadata, stay neighbours: only a group on a cut is divided.

A weighted quantile is found by descending the 63-bit order key 16 bits at a time: each step sums bytes by node and
digit, and only the digit that holds the quantile goes on.  Nothing but one row of numbers per node reaches the driver:
100 TB in leaves of 1 GB make 100,000.  Joins with such rows are left to the planner, which knows their size.

Defined results: null text: size 1, checksum 0, and the empty text's group; null lang or source is its own value; ids
may be null or repeat, and rows with equal keys go to one side of a cut; a very long text is one row of its size like any
other; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from attestor.llm.frames import drop, keep

_DIGITS = (47, 31, 15, 0)  # shifts of the digits of a key of 31 + 16 + 16 bits


@dataclass(frozen=True)
class Tree:
    shards: int = 16
    #: If given, the number of shards is the table's bytes over it, rounded up.
    target_bytes: int | None = None
    dimensions: tuple[str, ...] = ("size", "lang", "source")
    #: Rows numbered by one task.
    slot_rows: int = 20_000


def _prepared(docs: DataFrame, tree: Tree, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    labels = [d for d in tree.dimensions if d != "size"]
    slim = docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        *(F.coalesce(F.col(d).cast("string"), F.lit("\x00")).alias(f"_{d}") for d in labels),
    )
    slim = keep(slim, "kd-slim")
    shared = slim.groupBy("group", "size").agg(*(F.min(f"_{d}").alias(f"_{d}") for d in labels))
    scratch = [slim]
    for d in labels:
        ranks = _ranked(slim.select(f"_{d}").distinct(), f"_{d}")
        shared = shared.join(ranks, f"_{d}").withColumnRenamed("_rank", f"_rank_{d}")
        scratch.append(ranks)
    rows = slim.select("doc_id", "size", "text_crc32", "group").join(shared, ["group", "size"])
    place = {d: F.col(f"_rank_{d}") for d in labels} | {"size": F.floor(F.log2("size") * 1048576).cast("long")}
    placed = keep(rows.select("doc_id", "size", "text_crc32", "group", *(place[d].alias(f"x{i}") for i, d in enumerate(tree.dimensions)), F.lit(0).alias("node")), "kd-rows")
    drop(*scratch)
    return placed


def _ranked(values: DataFrame, name: str) -> DataFrame:
    """(name, _rank): the number of lesser values.  Values are sorted in ranges; a range starts after those before it."""
    ranges = keep(values.repartitionByRange(name).withColumn("_range", F.spark_partition_id()), "kd-values")
    counts = ranges.groupBy("_range").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.orderBy("_range")) - F.col("count")).drop("count")  # a row per range
    at = F.row_number().over(Window.partitionBy("_range").orderBy(name)) - 1
    ranks = keep(ranges.withColumn("_at", at).join(before, "_range").select(name, (F.col("_before") + F.col("_at")).cast("long").alias("_rank")), "kd-ranks")
    drop(ranges)
    return ranks


def _key(dims: int):
    """The order key along column ``axis``, scaled by the table's low and high."""
    place = F.lit(None).cast("long")
    for i in range(dims):
        place = F.when(F.col("axis") == i, F.col(f"x{i}")).otherwise(place)
    scaled = F.when(F.col("high") > F.col("low"), F.floor((place - F.col("low")) * F.lit(float((1 << 31) - 1)) / (F.col("high") - F.col("low")))).otherwise(F.lit(0)).cast("long")
    text = F.pmod(F.col("group"), F.lit(65536))
    own = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(65536))
    return F.shiftleft(scaled, 32) + F.shiftleft(text, 16) + own


def _cuts(rows: DataFrame, plan: list[tuple], dims: int) -> list[tuple]:
    """(node, cut) for each planned split (node, axis, low, high, wanted bytes): the key from which rows go right."""
    spark = rows.sparkSession
    spec = "node int, axis int, low long, high long"
    keyed = rows.join(spark.createDataFrame([p[:4] for p in plan], spec), "node").select("node", "size", _key(dims).alias("key"))
    prefix = {p[0]: 0 for p in plan}
    wanted = {p[0]: p[4] for p in plan}
    for shift, above in zip(_DIGITS, (63, *_DIGITS)):
        state = spark.createDataFrame([(n, prefix[n], float(wanted[n])) for n in prefix], "node int, prefix long, wanted double")
        digit = F.shiftrightunsigned("key", shift)
        sums = keyed.join(state, "node").where(F.shiftrightunsigned("key", above) == F.col("prefix")).groupBy("node", "wanted", digit.alias("digit")).agg(F.sum("size").alias("bytes"))
        run = Window.partitionBy("node").orderBy("digit")
        at = sums.withColumn("through", F.sum("bytes").over(run)).withColumn("before", F.col("through") - F.col("bytes"))
        # the first digit whose running sum reaches the wanted bytes, else the last
        best = at.groupBy("node").agg(
            F.coalesce(F.min(F.when(F.col("through") >= F.col("wanted"), F.struct("digit", "before", "through"))), F.max(F.struct("digit", "before", "through"))).alias("b")
        ).select("node", "b.*").collect()
        for r in best:
            prefix[r.node] = r.digit
            if shift:
                wanted[r.node] -= r.before
            elif r.through - wanted[r.node] < wanted[r.node] - r.before:
                prefix[r.node] = r.digit + 1  # its rows go left: that is nearer
    return list(prefix.items())


def assign(docs: DataFrame, tree: Tree = Tree(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, group, shard, slot."""
    spark, dims = docs.sparkSession, len(tree.dimensions)
    rows = _prepared(docs, tree, id_column, text_column)
    bounds = [f(f"x{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *bounds).first()
    if not whole["n"]:
        return rows.select("doc_id", "size", "text_crc32", "group", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards = tree.shards if tree.target_bytes is None else max(1, -(-whole["bytes"] // tree.target_bytes))
    leaves, first_shard = {0: shards}, {0: 0}
    while any(n > 1 for n in leaves.values()):
        plan = []
        for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect():  # a row per node, shards at most
            n = leaves[r.node]
            if n > 1:
                width = [(r[f"hi{i}"] - r[f"lo{i}"]) / max(whole[f"hi{i}"] - whole[f"lo{i}"], 1) for i in range(dims)]
                axis = max(range(dims), key=lambda i: (width[i], -i))
                plan.append((r.node, axis, r[f"lo{axis}"], r[f"hi{axis}"], r.bytes * (n // 2) / n))
        if not plan:
            break
        planned = {p[0]: p for p in plan}
        splits = spark.createDataFrame([(*planned[node][:4], cut) for node, cut in _cuts(rows, plan, dims)], "node int, axis int, low long, high long, cut long")
        right = F.when(F.col("cut").isNull(), F.col("node") * 2).otherwise(F.col("node") * 2 + (_key(dims) >= F.col("cut")).cast("int"))
        before = rows
        rows = keep(rows.join(splits, "node", "left").withColumn("node", right).select(*rows.columns), "kd-rows")
        drop(before)
        new_leaves, new_first = {}, {}
        for node, n in leaves.items():
            half = n // 2 if node in planned else 0
            new_leaves[2 * node], new_first[2 * node] = (half, first_shard[node]) if half else (n, first_shard[node])
            if half:
                new_leaves[2 * node + 1], new_first[2 * node + 1] = n - half, first_shard[node] + half
        empty = {n for n in new_leaves if n >> 1 not in planned and new_leaves[n] > 1}
        leaves = {n: (1 if n in empty else c) for n, c in new_leaves.items()}
        first_shard = new_first
    names = spark.createDataFrame(list(first_shard.items()), "node int, shard int")
    placed = rows.join(names, "node").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, whole["n"] // (shards * tree.slot_rows)))))
    return _numbered(placed).select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def _numbered(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 in every shard: a running number within parts of a shard, after the rows of the parts before."""
    counts = placed.groupBy("shard", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).drop("count")
    order = Window.partitionBy("shard", "part").orderBy("group", "doc_id", "text_crc32")
    return placed.withColumn("at", F.row_number().over(order) - 1).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("at")).cast("long"))
