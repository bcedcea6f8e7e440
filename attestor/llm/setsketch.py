"""Near-duplicate groups by SetSketch registers.

A set's register i is ``floor(1 - log_b x_i)`` where x_i is the least of exponentially distributed hashes of
its elements, cut to 0 .. 65535.  Registers merge by maximum and two sets share a register value with a
probability that follows their Jaccard similarity.  Steps:

1. sketch: one row per document with its set's digest, size and registers; equal sets become one class;
2. bands of registers are grouped; each bucket names one hub (the least by a hash that differs from band to
   band), and every other class of the bucket is paired with it, so a bucket of g classes gives g - 1 pairs;
3. a pair is dropped if the likelihood of its registers puts its similarity clearly under the threshold;
   the others are confirmed on their full sets;
4. confirmed links are joined into components (min label over a star contraction, written each round);
5. classes that share a bucket but still lie in different components are compared all the same (by blocks),
   filtered by likelihood, confirmed and joined: no link between different sets in one bucket is left untested.

Band misses: a pair at Jaccard 0.8 shares none of 32 bands of 4 registers with probability
(1 - 0.8**4) ** 32 = 5e-8; the quantised registers agree slightly more often still.

Defined results: null texts and texts without words have an empty set, size 0, their own component.  Documents
with equal sets are one component; repeated rows give repeated result rows.  A null id stays null and its
row's component is the least known id it is linked to, or null.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestor.llm.frames import drop, keep, map_chunks
from attestor.llm.text import Texts, mix, shingle_sets, space_words
from attestor.operators.graph import components


@dataclass(frozen=True)
class Sketch:
    """words: words in a shingle; threshold: least Jaccard similarity of a link, in hundredths."""

    words: int = 5
    threshold: int = 80
    bands: int = 32
    rows: int = 4
    base: float = 1.001
    #: Standard deviations by which a pair's likeliest similarity may miss the threshold and still be confirmed.
    slack: float = 4.5
    #: Sets confirmed by one task together.
    block: int = 256
    #: Sets, and their elements, of either side that meet in one task of the second pass.
    meeting: int = 1024
    meeting_shingles: int = 2_000_000
    #: Classes of one bucket that meet in one task.
    crowd: int = 8192

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers(values: np.ndarray, offsets: np.ndarray, sketch: Sketch) -> np.ndarray:
    """uint16 registers [text, register]; a set without elements has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, sketch.registers), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    least = np.empty((sketch.registers, len(full)), dtype=np.uint64)
    step = 1 << 15  # elements a pass, so that a pass stays in the cache
    cuts = [0]
    while cuts[-1] < len(full):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets[full + 1], offsets[full[cuts[-1]]] + step, side="right"))))
        cuts[-1] = min(cuts[-1], len(full))
    odd = mix(np.arange(1, sketch.registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = offsets[full[a]], offsets[full[b - 1] + 1]
        part, at = values[lo:hi], offsets[full[a:b]] - lo
        work = np.empty_like(part)
        for i in range(sketch.registers):
            np.multiply(part, odd[i], out=work)
            work ^= work >> np.uint64(32)
            np.multiply(work, odd[i], out=work)
            least[i, a:b] = np.minimum.reduceat(work, at)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    # the least of n unit exponentials is about 1/n: 1 - log_b x is then above 1 and grows with log n
    level = np.floor(1.0 - np.log(x) / np.log(sketch.base))
    out[full] = np.clip(level, 1, 65535).T.astype(np.uint16)
    return out


def likeliest_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, jointly from how many registers are greater, equal and less.

    With u, v the shares of the union in only one set and j in both, P(a > b) = -log_b'(1 - u'(b-1)/b) ... whose
    limit for b near 1 is u / 1, v / 1 and j.  Sizes are known, so j is the one unknown: u = (n_a - j(n_b)) / (n_a + n_b)
    and v likewise.  The likelihood is concave in j and is solved by bisection of its derivative.
    """
    m = a.shape[1]
    up, down = (a > b).sum(1), (a < b).sum(1)
    equal = m - up - down
    total = (size_a + size_b).astype(float)
    # union share only in a: (n_a - i) / union with i = j * total / (1 + j), union = total / (1 + j)
    sa, sb = size_a / total, size_b / total
    lo, hi = np.zeros(len(a)), np.minimum(np.minimum(sa / sb, sb / sa), 1 - 1e-9)
    top = hi.copy()
    for _ in range(40):
        j = (lo + hi) / 2
        slope = equal / np.maximum(j, 1e-12) + up * (sa - 1) / np.maximum((1 + j) * sa - j, 1e-12) + down * (sb - 1) / np.maximum((1 + j) * sb - j, 1e-12)
        rise = slope > 0
        lo, hi = np.where(rise, j, lo), np.where(rise, hi, j)
    return np.minimum((lo + hi) / 2, top)


def sketches(docs: DataFrame, sketch: Sketch, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its id, the digest of its text, the size and digest of its set, its registers and its band keys."""
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"), _digest(docs[text_column]).alias("digest"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts.of(part.column(1)).lowered()
        values, offsets = shingle_sets(texts, space_words(texts), sketch.words)
        regs = registers(values, offsets, sketch)
        keys = np.full((texts.n, sketch.bands), 0, dtype=np.uint64)
        for j in range(sketch.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + regs[:, j :: sketch.rows])
        digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(offsets, offsets[1:])]
        flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, sketch.bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary()), flat],
            names=["doc_id", "digest", "n_shingles", "class", "registers", "bands"],
        )

    return map_chunks(slim, rows, f"doc_id {kind}, digest binary, n_shingles long, class binary, registers binary, bands array<long>")


def _digest(text):
    """Of a text as it stands: with the id it names a row, which the id alone does not where it is null or repeated."""
    return F.unhex(F.md5(text))


def likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b, salt) of classes whose likeliest similarity does not lie clearly under the threshold.

    A hub a may have a third of all pairs: it is met by (a, salt), of which there is one per ``block`` pairs.
    """
    slim = classes.select("class", "n_shingles", "registers")
    hubs = pairs.select("a", "salt").distinct().join(slim.toDF("a", "size_a", "registers_a"), "a")
    joined = (
        pairs.join(hubs, ["a", "salt"])
        .join(slim.toDF("b", "size_b", "registers_b"), "b")
        # sizes alone bound the similarity
        .where("100 * least(size_a, size_b) >= %d * greatest(size_a, size_b)" % sketch.threshold)
        .select("a", "b", "salt", "size_a", "size_b", "registers_a", "registers_b")
    )
    low = sketch.threshold / 100

    def run(batches):
        for part in batches:
            if not part.num_rows:
                continue
            regs = [np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(part.num_rows, -1) for k in (5, 6)]
            sizes = [part.column(k).to_numpy() for k in (3, 4)]
            j = likeliest_jaccard(*regs, *sizes, sketch)
            spread = np.sqrt(low * (1 - low) / sketch.registers)
            yield part.filter(pa.array(j >= low - sketch.slack * spread)).select([0, 1, 2])

    return joined.mapInArrow(run, "a binary, b binary, salt long")


def confirmed(pairs: DataFrame, texts: DataFrame, sketch: Sketch) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets.

    The pairs of one hub a meet in blocks, one per salt; its set is sent once per block, each b's once per pair.
    texts: (class, text), a text for every class of the pairs.
    """
    left = pairs.select("a", "salt").distinct().join(texts.toDF("a", "text_a"), "a").select("a", "salt", "text_a").toDF("a", "salt", "text_a")
    right = pairs.join(texts.toDF("b", "text_b"), "b").select("a", "salt", "b", "text_b").toDF("a", "salt", "b", "text_b")

    def run(left_table, right_table):
        if not left_table.num_rows or not right_table.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        hub = _set(left_table.column("text_a").slice(0, 1), sketch)[0]
        good = np.zeros(right_table.num_rows, dtype=bool)
        done = 0
        for part in right_table.select(["b", "text_b"]).combine_chunks().to_batches(max_chunksize=64):
            for other in _set(part.column(1), sketch):
                both = len(np.intersect1d(hub, other, assume_unique=True))
                good[done] = 100 * both >= sketch.threshold * (len(hub) + len(other) - both)
                done += 1
        return right_table.select(["a", "b"]).filter(pa.array(good))

    return left.groupBy("a", "salt").cogroup(right.groupBy("a", "salt")).applyInArrow(run, "a binary, b binary")


def _set(column, sketch: Sketch) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = Texts.of(column).lowered()
    values, offsets = shingle_sets(texts, space_words(texts), sketch.words)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _cross_links(buckets: DataFrame, classes: DataFrame, docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Confirmed pairs (a, b) of classes of one bucket that lie in different components.

    buckets: band, key, class, root, n (the classes of the bucket).  A bucket over ``crowd`` is dealt out in blocks
    and every two blocks meet in one task.  What passes the likelihood test leaves as (a, its partners), so a class
    beside a large group costs a few rows, not one per member; full sets meet by blocks as well.
    """
    all_open = classes.join(buckets.select("class").distinct(), "class", "left_semi").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    wide = max(1, -(-all_open[0] // sketch.meeting), -(-all_open[1] // sketch.meeting_shingles))
    blocks = F.ceil(F.col("n") / sketch.crowd)
    dealt = (
        buckets.withColumn("own", F.pmod(F.xxhash64("class"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .selectExpr("band", "key", "least(own, other) AS low", "greatest(own, other) AS high", "own", "class", "root")
        .join(classes.select("class", "n_shingles", "registers"), "class")
        .select("band", "key", "low", "high", "own", "class", "root", "n_shingles", "registers")
        .repartition("band", "key", "low", "high").sortWithinPartitions("band", "key", "low", "high")
    )
    found = keep(dealt.mapInArrow(_meetings(sketch, wide), "ka long, kb long, a binary, bs array<binary>"), "pairs")
    merged = F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs")
    mine = keep(found.where("a IS NOT NULL").groupBy("ka", "kb", "a").agg(merged), "partners")
    needed = found.where("a IS NULL").groupBy("ka", "kb").agg(merged).select("ka", "kb", F.explode("bs").alias("b"))
    texts = _with_text(classes, docs, mine.selectExpr("a", "a AS b").union(needed.selectExpr("b AS a", "b")))
    left = mine.join(texts.toDF("a", "text_a"), "a").select("ka", "kb", "a", "text_a", "bs")
    right = needed.join(texts.toDF("b", "text_b"), "b").select("ka", "kb", "b", "text_b")

    def run(left_table, right_table):
        a, b = [], []
        if right_table.num_rows:
            names = right_table.column("b").to_pylist()
            sets = dict(zip(names, _set(right_table.column("text_b"), sketch)))
            for name, mine, others in zip(left_table.column("a").to_pylist(), _set(left_table.column("text_a"), sketch), left_table.column("bs").to_pylist()):
                for other in others:
                    both = len(np.intersect1d(mine, sets[other], assume_unique=True))
                    if 100 * both >= sketch.threshold * (len(mine) + len(sets[other]) - both):
                        a.append(name)
                        b.append(other)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    links = keep(left.toDF("ka", "kb", "a", "text_a", "bs").groupBy("ka", "kb").cogroup(right.toDF("ka", "kb", "b", "text_b").groupBy("ka", "kb")).applyInArrow(run, "a binary, b binary"), "confirmed")
    drop(found, mine, texts)
    return links


def _meetings(sketch: Sketch, wide: int):
    """For mapInArrow over rows sorted by bucket and block pair: the likely pairs of classes of different roots."""
    low = sketch.threshold / 100
    floor = low - sketch.slack * np.sqrt(low * (1 - low) / sketch.registers)

    def groups(batches):
        """Batches cut where a group ends."""
        held = []
        for part in batches:
            if not part.num_rows:
                continue
            key = _key(part)
            if held and not (_key(held[-1])[:, -1] == key[:, 0]).all():
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if len(change):
                cut = int(change[-1]) + 1
                yield pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks().to_batches()[0]
                held, part = [], part.slice(cut)
            held.append(part)
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches):
        for part in groups(batches):
            key = _key(part)
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])
            own = part.column(4).to_numpy()
            names = part.column(5).to_pylist()
            roots = np.unique(np.array(part.column(6).to_pylist(), dtype="S16"), return_inverse=True)[1]
            sizes = part.column(7).to_numpy()
            regs = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint16).reshape(part.num_rows, -1)
            band = key[0]
            cross = key[2] != key[3]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            lengths = np.diff(starts)
            pairs = []
            small = np.repeat(lengths <= 64, lengths)
            for d in range(1, int(min(64, lengths.max()))):
                i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
                pairs.append((i, i + d))
            for g in np.flatnonzero(lengths > 64):
                rows = np.arange(starts[g], starts[g + 1])
                main = np.bincount(roots[rows]).argmax()
                odd = rows[roots[rows] != main]
                for x in odd:
                    y = rows[(roots[rows] == main) | (rows > x)]
                    pairs.append(_likely(np.full(len(y), x), y, roots, own, cross, sizes, regs, band, sketch, floor))
            if pairs:
                i, j = (np.concatenate(x) for x in zip(*pairs))
                i, j = _likely(i, j, roots, own, cross, sizes, regs, band, sketch, floor)
                yield from _packed(i, j, names, wide)

    return run


def _key(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(4)])


def _likely(i, j, roots, own, cross, sizes, regs, band, sketch, floor):
    """Of the pairs of rows those to be confirmed: of different roots, met in the first band they share only."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    ok = (roots[i] != roots[j]) & (~cross[i] | (own[i] != own[j])) & (100 * small >= sketch.threshold * large)
    i, j = i[ok], j[ok]
    out = []
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        a, b = regs[x], regs[y]
        first = (a == b).reshape(len(x), sketch.bands, sketch.rows).all(2).argmax(1)
        likely = likeliest_jaccard(a, b, sizes[x], sizes[y], sketch) >= floor
        out.append(np.stack([x, y])[:, (first == band[x]) & likely])
    found = np.concatenate(out, axis=1) if out else np.empty((2, 0), dtype=np.int64)
    return found[0], found[1]


def _packed(i, j, names, wide):
    """Rows (ka, kb, a, bs): for each a its partners by block of partners; with a null, those that a block pair needs."""
    out, needs = {}, {}
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = names[x], names[y]
        ka, kb = int.from_bytes(a[:4], "big") % wide, int.from_bytes(b[:4], "big") % wide
        out.setdefault((ka, kb, a), []).append(b)
        needs.setdefault((ka, kb), set()).add(b)
    rows = [(*key, bs) for key, bs in out.items()] + [(ka, kb, None, list(bs)) for (ka, kb), bs in needs.items()]
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["ka", "kb", "a", "bs"])


def _grouped(docs: DataFrame, sketch: Sketch, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """sketches() of docs, and of every class (class, least, root): its row with the least id and its component."""
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    rows = keep(sketches(slim, sketch), "sketches")
    full = rows.where("class IS NOT NULL")
    # the row that speaks for a class: of all documents with that set the one with the least id, nulls last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("least")
    classes = full.groupBy("class").agg(least, F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"), F.min_by("bands", F.coalesce("doc_id", F.lit(0))).alias("bands"))
    classes = keep(classes, "classes")
    buckets = classes.select("class", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("class", "band").alias("order"), F.col("class").alias("hub"))).alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "key", "least.hub", "n")
    shared = keep(buckets.join(hubs, ["band", "key"]), "buckets")
    star = shared.where("class <> hub").selectExpr("least(class, hub) AS a", "greatest(class, hub) AS b", "hub", "n", "band").groupBy("a", "b").agg(F.min(F.struct("hub", "n", "band")).alias("x"))
    star = star.selectExpr("x.hub AS a", "CASE WHEN x.hub = a THEN b ELSE a END AS b", "x.n AS n", "x.band AS band")
    # of each bucket of which a class is the hub, blocks of its pairs
    star = star.select("a", "b", (F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / sketch.block)) * sketch.bands + F.col("band")).alias("salt"))
    first = keep(likely(star, classes, sketch), "pairs")
    texts = _with_text(classes, slim, first)
    links = keep(confirmed(first, texts, sketch), "confirmed")
    drop(first, texts)
    labels = components(links)
    # second pass: buckets whose classes are still in more than one component
    labelled = shared.drop("n").join(labels.toDF("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_buckets = labelled.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "key", "n")
    left = keep(labelled.join(open_buckets, ["band", "key"]).select("band", "key", "class", "root", "n"), "open")
    drop(shared)
    more = _cross_links(left, classes, slim, sketch)
    drop(left)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return rows, classes.select("class", "least").join(labels.toDF("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, sketch: Sketch = Sketch(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    rows, named = _grouped(docs, sketch, id_column, text_column)
    ids = named.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
    found = rows.select("doc_id", "n_shingles", "class").join(named.select("class", "root").join(ids, "root").select("class", "component_id"), "class", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def _with_text(classes: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes that occur in pairs, with the text of the row that speaks for them."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    found = classes.join(wanted, "class", "left_semi").select("class", "least.doc_id", "least.digest")
    texts = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (_digest(docs["text"]) == found["digest"])).select("class", "text")
    return keep(texts.groupBy("class").agg(F.max("text").alias("text")), "texts")


def drop_copies(docs: DataFrame, sketch: Sketch = Sketch(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group, the one with the least id, with all columns; of rows with equal id and text, one.

    Rows are told apart by id and text: of a group whose least id is null or stands on several texts, one text is left.
    """
    rows, named = _grouped(docs, sketch, id_column, text_column)
    least = named.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.digest")
    kept = least.union(rows.where("class IS NULL").select("doc_id", "digest").distinct()).toDF("_kept", "_digest")
    left = docs.join(kept, docs[id_column].eqNullSafe(kept["_kept"]) & _digest(docs[text_column]).eqNullSafe(kept["_digest"]), "left_semi")
    repeated = docs.groupBy(id_column).count().where("count > 1").limit(1).count()
    return left.dropDuplicates([id_column, text_column]) if repeated else left
