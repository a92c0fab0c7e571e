"""Similarity join on word shingles: Jaccard 0.75 or more, by vertical partitioning.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Documents
with equal sets form a *class*; everything below works on classes, so exact copies
cost nothing.

1. Order. One pass counts in how many documents each shingle stands: packed hashes
   are dealt by range and counted there; the number of ranges follows the words of the
   input. A table of fixed size (``SLOT_BITS``) keeps
   log2 of the count of every shingle of two documents or more; rare shingles come
   first in the candidates' order, and those that the table shows as unique can't
   make a pair.
2. Candidates. Two sets with J >= 3/4 share a shingle among the first
   ``n - ceil(3n/4) + 1`` of each (prefix filter). Prefixes without their unique
   shingles are packed, dealt by shingle to fragments of about ``FRAGMENT_WORDS`` words
   of the input each, and each fragment finds the shingles that several classes share: the *buckets*.
3. Stars. Within a bucket every class is compared with one representative only, the
   one with the fewest unique shingles, so a bucket costs as many pairs as it
   has members, not their square.
4. Vertical partitions. The shingle order (the hash's) is cut into ``FRAGMENTS``
   equal ranges. The overlap of a pair is counted in each range on its own and
   summed per pair; n_a + n_b - overlap is the union. Two ranges are counted first:
   most pairs already miss more there than J >= 3/4 allows.
5. Pivots. After joining what is linked into components, a bucket whose members are
   all in one component is settled. In the others, members outside the largest
   component are compared with ``PIVOTS`` of its members: one link is enough.
6. The rest. In buckets that are still open, all pairs of different components are
   compared that may link: not those whose distances to the representative differ by
   more than 1/4 (the Jaccard distance is a metric), nor those that miss too much by
   their unique shingles and by how many they lost of the representative's, or by the
   bits in which their parity sketches differ. Members meet by bands of their size and,
   within a bucket, in blocks of ``REST_MEMBERS``, so one bucket is many tasks' work.
   Nothing is capped.

Classes in a bucket of more than ``HOT`` members get as many sub-buckets as keep these
below it, with their own representatives, which are compared among themselves. Classes
of very many copies take their component's name over salts.

Components come from alternating large-star and small-star steps over the links,
each step a table in the shared folder.

Defined cases: a document of 1 to 4 words has its whole sequence as its one
shingle; without words or text the set is empty, linked with nothing, and the
component is its own id; null ids are never the smallest; repeated rows are
copies; very long texts are one row of a batch; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.words import LOWER, WordHash, chunks, flatten, grams, mix, texts_of
from quire.session import written

SHINGLE = 5
SLOT_BITS = 25
PIVOTS = 16
FEW_LINKS = 500_000
FRAGMENTS = 8
EARLY = 2
#: A set's parity sketch, kept as fragment SKETCH of its segments: bit i is set if an odd number of its shingles falls
#: in cell i. Bits that differ between two sets are at most as many as the shingles that they don't share.
SKETCH, SKETCH_CELLS = -1, 1024
#: Words of the input (bytes / 6) for each range of the counting and for each fragment of the prefixes: one task's arrays.
COUNT_WORDS, FRAGMENT_WORDS = 4 << 20, 4 << 20
HOT = 1 << 14
#: Members of a block of an open bucket.
REST_MEMBERS = 512
#: Classes with more rows than 1 / HOT_SHARE of all (so at most HOT_SHARE of them) are spread over SALTS.
HOT_SHARE, SALTS = 1024, 64
LEVEL_BITS = np.uint64(58)
FILTER_BITS = 25


def shingle_sets(texts: list[bytes], hashes: WordHash) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.translate(LOWER).split() for t in texts]
    h, offsets = flatten(words, hashes)
    g = grams(h, SHINGLE)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(g[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _deal_hashes(n_parts: int):
    """Packed 32-bit pieces of the shingle hashes by part (the hash's top), and in how many of the task's classes each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = WordHash(), set(), [], 0

        def pack() -> Iterator[pa.RecordBatch]:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            part = (u >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(n_parts + 1, dtype=np.uint64))
            low = (u >> np.uint64(24)).astype(np.uint32)  # the bits below the part's and above the last 24
            counts = n.astype(np.uint32)
            spans = [slice(x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            rows = [(i, low[x].tobytes(), counts[x].tobytes()) for i, x in enumerate(spans) if x.start < x.stop]
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "low", "counts"])

        for batch in chunks(batches, "text"):
            for s in shingle_sets(texts_of(batch, "text"), hashes):
                if len(s) and (name := class_of(s)) not in seen:
                    seen.add(name)
                    held.append(s)
                    size += len(s)
            if size > 2_000_000:
                yield from pack()
                held, size = [], 0
        if held:
            yield from pack()

    return run


def _levels():
    """Slots of a part's shingles of two classes or more, and the largest log2 of a count in each."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        low, n = get("low", np.uint32), get("counts", np.uint32)
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        total = np.add.reduceat(n, start)
        twice = total > 1
        level = np.log2(total[twice]).astype(np.uint8)
        slot = _slot_of_low(low[start][twice])
        order = np.lexsort((level, slot))
        slot, level = slot[order], level[order]
        last = np.concatenate([slot[1:] != slot[:-1], [True]]) if len(slot) else np.zeros(0, bool)
        return pa.table({"slots": pa.array([slot[last].astype(np.uint32).tobytes()], pa.binary()), "levels": pa.array([level[last].tobytes()], pa.binary())})

    return run


def _slot_of_low(low: np.ndarray) -> np.ndarray:
    return (mix(low.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def levels(docs: DataFrame, n_words: int) -> np.ndarray:
    """For every slot 0, or log2 of how many classes share a shingle: a byte each, 32 MB."""
    dealt = docs.select("text").mapInArrow(_deal_hashes(max(1, -(-n_words // COUNT_WORDS))), "part bigint, low binary, counts binary")
    found = dealt.groupBy("part").applyInArrow(_levels(), "slots binary, levels binary")
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    # A part at a time; together they are at most one entry for each slot and part.
    for r in written(found, "jaccard-levels").toLocalIterator():
        at = np.frombuffer(r.slots, np.uint32)
        out[at] = np.maximum(out[at], np.frombuffer(r.levels, np.uint8))
    return out


def level_of(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[_slot_of_low((s >> np.uint64(24)).astype(np.uint32))]


def prefixes(docs: DataFrame, table: np.ndarray, n_fragments: int, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n, cls) of the documents, and packed prefix tuples (fragment, tokens, salts, owners, sizes, spares), each class once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()),
        ("fragment", pa.int64()), ("tokens", pa.binary()), ("salts", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("spares", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, table = WordHash(), set(), shared.value
        held, parts = 0, []

        def pack() -> Iterator[pa.RecordBatch]:
            t, c, n, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            level = t >> LEVEL_BITS
            spread = np.where((np.uint64(1) << level) >= np.uint64(hot), (np.uint64(2) << level) // np.uint64(hot), np.uint64(1))
            salt = c.view(np.uint64) % spread
            to = (mix(t + mix(salt + np.uint64(1))) % np.uint64(n_fragments)).astype(np.int64)
            order = np.lexsort((c, to))
            to = to[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            spans = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns = [x[order] for x in (t, salt.astype(np.uint32), c, n, w)]
            none = pa.nulls(len(spans), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.array(to[cut[:-1]], pa.int64()), *(pa.array([x[s].tobytes() for s in spans], pa.binary()) for x in columns)], schema=schema
            )

        for batch in chunks(batches, "text"):
            sets = shingle_sets(texts_of(batch, "text"), hashes)
            names = [class_of(s) for s in sets]
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                    pa.nulls(rows, pa.int64()), *(pa.nulls(rows, pa.binary()) for _ in range(5)),
                ], schema=schema,
            )
            for s, name in zip(sets, names, strict=True):
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                p, level = prefix_size(len(s)), level_of(s, table)
                left = p - int((level == 0).sum())
                if left <= 0:
                    continue  # the prefix is unique
                key = level[level > 0].astype(np.uint64) << LEVEL_BITS | s[level > 0] >> (np.uint64(64) - LEVEL_BITS)
                key = np.partition(key, left - 1)[:left] if left < len(key) else key
                spare = len(s) - 7 * int((level == 0).sum())
                parts.append((key, np.full(len(key), name, np.int64), np.full(len(key), len(s), np.uint32), np.full(len(key), spare, np.int32)))
                held += len(key)
            if held > 250_000:
                yield from pack()
                held, parts = 0, []
        if held:
            yield from pack()

    kinds = "doc_id bigint, n bigint, cls bigint, fragment bigint, tokens binary, salts binary, owners binary, sizes binary, spares binary"
    return written(docs.mapInArrow(run, kinds), "jaccard-prefixes")


def _find_buckets(table: pa.Table, hot_from: int = HOT) -> pa.Table:
    """The shingles that two or more classes share: a row for each member.

    ``bucket`` names the members: shingles with the same members make one bucket,
    but for hot shingles, whose bucket is the shingle (its parts lie in several fragments).
    """
    get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
    t, salt, c, n, w = get("tokens", np.uint64), get("salts", np.uint32), get("owners", np.int64), get("sizes", np.uint32), get("spares", np.int32)
    order = np.lexsort((c, -w.astype(np.int64), salt, t))  # the first of a bucket is its representative
    t, salt, c, n, w = t[order], salt[order], c[order], n[order], w[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1]) | (c[1:] != c[:-1])
    t, salt, c, n, w = t[fresh], salt[fresh], c[fresh], n[fresh], w[fresh]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])
    start = np.flatnonzero(first)
    size = np.diff(np.concatenate([start, [len(t)]]))
    hot = (np.uint64(1) << (t[start] >> LEVEL_BITS)) >= np.uint64(hot_from)
    members = np.add.reduceat(mix(c.view(np.uint64)), start) if len(start) else start.astype(np.uint64)
    name = np.where(hot, t[start], mix(members + size.astype(np.uint64))).view(np.int64)
    keep = (size > 1) | hot
    again = np.zeros(len(start), bool)
    _, unique = np.unique(name, return_index=True)
    again[unique] = True
    keep &= again | hot
    rows = np.repeat(keep, size)
    rep, rep_n, rep_spare = (np.repeat(x[start], size) for x in (c, n, w))
    return pa.table(
        {
            "bucket": pa.array(np.repeat(name, size)[rows], pa.int64()),
            "size": pa.array(np.repeat(np.where(hot, np.maximum(hot_from, 3), size), size)[rows], pa.int64()),
            "cls": pa.array(c[rows], pa.int64()),
            "n": pa.array(n[rows], pa.int64()),
            "rep": pa.array(rep[rows], pa.int64()),
            "rep_n": pa.array(rep_n[rows], pa.int64()),
            "spare": pa.array(w[rows], pa.int64()),
            "rep_spare": pa.array(rep_spare[rows], pa.int64()),
        }
    )


def buckets(packed: DataFrame, hot: int = HOT) -> DataFrame:
    found = packed.groupBy("fragment").applyInArrow(lambda table: _find_buckets(table, hot), "bucket bigint, size bigint, cls bigint, n bigint, rep bigint, rep_n bigint, spare bigint, rep_spare bigint")
    return written(found, "jaccard-buckets")


def _ordered_pairs(a: str, na: str, b: str, nb: str) -> list[Column]:
    """A pair with the smaller class name first."""
    swap = F.col(a) > F.col(b)
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return [pick(a, b).alias("a"), pick(na, nb).alias("na"), pick(b, a).alias("b"), pick(nb, na).alias("nb")]


def _possible(x: str, y: str, spare_x: str, spare_y: str) -> Column:
    """Neither the sizes nor the unique shingles rule J >= 3/4 out.

    A pair may miss (n_x + n_y) / 7 shingles, and the unique ones are all misses; with
    spare = n - 7 * unique, that is spare_x + spare_y >= 0.
    """
    return (4 * F.least(x, y) >= 3 * F.greatest(x, y)) & (F.col(spare_x) + F.col(spare_y) >= 0)


def star_pairs(found: DataFrame, hot: int = HOT) -> DataFrame:
    """Members with their representative, and representatives of a hot bucket's parts with the first of them."""
    own = found.where("cls != rep").where(_possible("n", "rep_n", "spare", "rep_spare")).select(*_ordered_pairs("cls", "n", "rep", "rep_n"))
    parts = found.where(F.col("size") >= hot).select("bucket", F.col("rep").alias("cls"), F.col("rep_n").alias("n"), F.col("rep_spare").alias("spare")).distinct()
    heads = parts.groupBy("bucket").agg(F.min(F.struct("cls", "n", "spare")).alias("h")).select("bucket", F.col("h.cls").alias("rep"), F.col("h.n").alias("rep_n"), F.col("h.spare").alias("rep_spare"))
    across = parts.join(heads, "bucket").where("cls != rep").where(_possible("n", "rep_n", "spare", "rep_spare"))
    return own.unionByName(across.select(*_ordered_pairs("cls", "n", "rep", "rep_n"))).distinct()


def segments(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, f, shingles): the sets of the given classes (cls, did), cut into ranges of the hash order.

    ``did`` is the class's smallest doc_id (the class itself where all ids are null).
    Only these documents are shingled again; they are picked by a bitmap of fixed
    size; a false hit adds a class that isn't asked for, or one a second time.
    """
    spark = docs.sparkSession
    size = 1 << FILTER_BITS
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))  # ids may share their low bits
    hits = classes.select(place("did").alias("place"))
    hits = hits.selectExpr("cast(floor(place / 64) AS int) AS w", "shiftleft(1L, cast(pmod(place, 64) AS int)) AS bits")
    words = hits.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, bitmap = WordHash(), set(), shared.value
        for batch in chunks(batches, "text"):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            at = np.asarray(batch.column(batch.schema.get_field_index("place")))
            hit = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            hit |= np.asarray(ids.is_null())
            batch = batch.filter(pa.array(hit))
            names, fs, rows = [], [], []
            for s in shingle_sets(texts_of(batch, "text"), hashes):
                if not len(s):
                    continue
                name = class_of(s)
                if name in seen:
                    continue
                seen.add(name)
                cuts = np.searchsorted(s >> np.uint64(61), np.arange(FRAGMENTS + 1, dtype=np.uint64))
                cells = np.bincount((mix(s) >> np.uint64(54)).astype(np.int64), minlength=SKETCH_CELLS) & 1
                names.append(name)
                fs.append(SKETCH)
                rows.append(np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64))
                for f in range(FRAGMENTS):
                    if cuts[f] < cuts[f + 1]:
                        names.append(name)
                        fs.append(f)
                        rows.append(s[cuts[f] : cuts[f + 1]].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            values = np.concatenate([*rows, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(fs, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(values))], ["cls", "f", "shingles"]
            )

    out = docs.select("doc_id", "text", place("doc_id").alias("place")).mapInArrow(run, "cls bigint, f int, shingles array<bigint>")
    return written(out, "jaccard-segments")


def _partial(pairs: DataFrame, parts: DataFrame, fragments: range) -> DataFrame:
    """``pairs`` with o and m: shared shingles and misses of each pair within some fragments."""
    own = parts.where(F.col("f").between(fragments.start, fragments.stop - 1))
    side = lambda c, s: own.select(F.col("cls").alias(c), "f", F.col("shingles").alias(s))
    both = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), ["b", "f"])
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    each = both.select("a", "b", "f", shared.alias("o"), (F.size("sa") + F.size("sb") - 2 * shared).cast("bigint").alias("m")).repartition("a", "b")
    # A class that was cut twice has equal segments: one count for each fragment.
    each = each.groupBy("a", "b", "f").agg(F.max("o").alias("o"), F.max("m").alias("m"))
    summed = each.groupBy("a", "b").agg(F.sum("o").alias("o"), F.sum("m").alias("m"))
    zero = F.lit(0).cast("bigint")
    return pairs.join(summed, ["a", "b"], "left").withColumn("o", F.coalesce("o", zero)).withColumn("m", F.coalesce("m", zero))


def overlaps(pairs: DataFrame, parts: DataFrame, early: int = EARLY) -> DataFrame:
    """(a, b, linked, near, far, o): each pair's verdict, bounds of its distance, and its overlap if it was counted whole.

    The first ``early`` fragments are counted for all pairs. J >= 3/4 allows at most
    (n_a + n_b) / 7 misses in all, so pairs that miss more there are done; the rest
    of the fragments is counted for the others only.
    """
    total, overlap = F.col("na") + F.col("nb"), F.col("o1") + F.col("o")
    distance = 1 - overlap / (total - overlap)
    verdict = [(100 * overlap >= 75 * (total - overlap)).alias("linked"), distance.alias("near"), distance.alias("far"), overlap.alias("o")]
    if not early:
        return _partial(pairs.withColumn("o1", F.lit(0).cast("bigint")), parts, range(FRAGMENTS)).select("a", "b", *verdict)
    seen = written(_partial(pairs, parts, range(early)), "jaccard-early")
    misses = F.col("m")
    lower = 2 * misses / (total + misses)  # the distance if everything else were shared
    gone = seen.where(7 * misses > total).select("a", "b", F.lit(False).alias("linked"), lower.alias("near"), F.lit(1.0).alias("far"), F.lit(None).cast("bigint").alias("o"))
    left = seen.where(7 * misses <= total).withColumnRenamed("o", "o1").drop("m")
    return gone.unionByName(_partial(left, parts, range(early, FRAGMENTS)).select("a", "b", *verdict))


def _open(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their component, of buckets that hold more than one."""
    members = found.where("size > 2").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    members = members.withColumn("root", F.coalesce("root", "cls"))
    open_ = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("bucket")
    return members.join(open_, "bucket")


def pivot_pairs(found: DataFrame, roots: DataFrame, checked: DataFrame, parts: DataFrame) -> DataFrame:
    """In open buckets: members outside the largest component, with a few of its members."""
    members = written(_open(found, roots), "jaccard-open")
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("m")).select("bucket", F.col("m.root").alias("main"))
    inside = members.join(main, "bucket")
    # The pivots: of each of PIVOTS hash classes the member with the fewest unique shingles.
    share = F.pmod(F.xxhash64("bucket", "cls"), F.lit(PIVOTS))
    lists = inside.where("root = main").groupBy("bucket", share.alias("share")).agg(F.max(F.struct("spare", F.col("cls").alias("p"), F.col("n").alias("pn"))).alias("x"))
    lists = lists.select("bucket", "x.p", "x.pn", F.col("x.spare").alias("pspare"))
    pairs = inside.where("root != main").select("bucket", "cls", "n", "spare").join(lists, "bucket").where(_possible("n", "pn", "spare", "pspare"))
    return pairs.select(*_ordered_pairs("cls", "n", "p", "pn")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")


def rest_pairs(found: DataFrame, roots: DataFrame, checked: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of different components in open buckets that the metric doesn't exclude."""
    members = _open(found, roots)
    rows = members.withColumn("a", F.least("cls", "rep")).withColumn("b", F.greatest("cls", "rep"))
    rows = rows.join(checked.select("a", "b", "near", "far", "o"), ["a", "b"], "left")
    own = F.col("cls") == F.col("rep")
    bound = lambda c, other: F.when(own, 0.0).otherwise(F.coalesce(c, F.lit(other)))
    rows = rows.select("bucket", "cls", "n", "spare", "root", "rep", bound("near", 0.0).alias("near"), bound("far", 1.0).alias("far"), (F.col("rep_n") - F.col("o")).alias("lost"))
    sketches = parts.where(F.col("f") == SKETCH).groupBy("cls").agg(F.first("shingles").alias("sketch"))
    rows = written(rows.join(sketches, "cls"), "jaccard-rest")
    # A small bucket is one block of one band. The members of others: block i of a band meets blocks j >= i of it, and
    # all blocks of the next band.
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / REST_MEMBERS).cast("int").alias("blocks"))
    rows = rows.join(sizes, "bucket").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A band is a trifle wider than 4/3, so that sizes that may link are at most one band apart.
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(4 / 3) * (1 + 1e-9))).cast("int")
    rows = rows.withColumn("band", F.when(F.col("blocks") > 1, band).otherwise(0))
    x = _dealt_left(rows).alias("x")
    y = _dealt_right(rows).alias("y")
    apart = F.greatest(F.col("x.near") - F.col("y.far"), F.col("y.near") - F.col("x.far"))
    # What one lost of the representative and the other didn't is missed as well, beside the unique shingles.
    misses = 7 * F.coalesce(F.abs(F.col("x.lost") - F.col("y.lost")), F.lit(0))
    near = ((apart <= 0.25 + 1e-9) & (F.col("x.spare") + F.col("y.spare") >= misses)) | (F.col("x.rep") != F.col("y.rep"))
    odd = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH_CELLS // 64)), F.lit(0))
    near = near & (7 * odd <= F.col("x.n") + F.col("y.n"))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "low", "high", "bi", "bj")]
    # Within a block each pair comes once; a pair of two blocks or bands meets in one of them only.
    once = (F.col("x.low") != F.col("x.high")) | (F.col("x.bi") != F.col("x.bj")) | (F.col("x.cls") < F.col("y.cls"))
    met = x.join(y, [*same, once, F.col("x.root") != F.col("y.root"), _possible("x.n", "y.n", "x.spare", "y.spare"), near])
    met = met.select(*_ordered_pairs("x.cls", "x.n", "y.cls", "y.n")).distinct()
    return met.join(checked.select("a", "b"), ["a", "b"], "left_anti")


def _dealt_left(rows: DataFrame) -> DataFrame:
    """Members as the left side of their blocks' meetings: bands (low, high) and blocks (bi, bj)."""
    own = F.transform(F.sequence(F.col("i"), F.col("blocks") - 1), lambda j: F.struct(F.col("band").alias("high"), j.alias("bj")))
    following = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct((F.col("band") + 1).alias("high"), j.alias("bj")))
    out = rows.withColumn("low", F.col("band")).withColumn("bi", F.col("i")).withColumn("to", F.explode(F.when(F.col("blocks") > 1, F.concat(own, following)).otherwise(own)))
    return out.withColumn("high", F.col("to.high")).withColumn("bj", F.col("to.bj")).drop("to")


def _dealt_right(rows: DataFrame) -> DataFrame:
    own = F.transform(F.sequence(F.lit(0), F.col("i")), lambda j: F.struct(F.col("band").alias("low"), j.alias("bi")))
    before = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct((F.col("band") - 1).alias("low"), j.alias("bi")))
    out = rows.withColumn("high", F.col("band")).withColumn("bj", F.col("i")).withColumn("to", F.explode(F.when(F.col("blocks") > 1, F.concat(own, before)).otherwise(own)))
    return out.withColumn("low", F.col("to.low")).withColumn("bi", F.col("to.bi")).drop("to")


def _union(table: pa.Table) -> pa.Table:
    """(node, root) of a bounded number of links, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([find(x) for x in nodes], pa.int64())})


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links: (a, b).

    Up to ``few`` links (counted first) are joined in one task. Beyond, alternating large-star and small-star steps; every step is written, and they
    end when a round leaves the links as they were.
    """
    if links.limit(few + 1).count() <= few:
        one = links.select("a", "b").coalesce(1).withColumn("k", F.lit(0)).groupBy("k").applyInArrow(_union, "node bigint, root bigint")
        return written(one, "roots")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if now == state:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        state = now


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_words = (slim.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) // 6
    both = prefixes(slim, levels(slim, n_words), max(1, -(-n_words // FRAGMENT_WORDS)), hot)
    rows = both.where("fragment IS NULL").select("doc_id", "n", "cls")
    found = buckets(both.where("fragment IS NOT NULL").drop("doc_id", "n", "cls"), hot)
    classes = written(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "jaccard-classes")
    named = classes.select("cls", F.coalesce("class_id", "cls").alias("did"))
    parts = segments(slim, named.join(found.select("cls").distinct(), "cls", "left_semi"))
    checked = written(overlaps(written(star_pairs(found, hot), "jaccard-pairs"), parts, early=0), "jaccard-overlaps")
    roots = components(checked.where("linked"))
    for more_pairs in (pivot_pairs, rest_pairs):
        more = written(more_pairs(found, roots, checked, parts), "jaccard-more")
        if more.limit(1).count():
            again = written(overlaps(more, parts, early=1), "jaccard-overlaps")
            checked = checked.unionByName(again)
            if again.where("linked").limit(1).count():
                roots = components(checked.where("linked"))
    rooted = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = rooted.join(firsts, "root").select("cls", "class_id", "component_id")
    out = _with_names(rows, named, classes)
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _with_names(rows: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with their class's names; the rows of the few very large classes are spread over salts."""
    n = rows.count()
    large = classes.where(F.col("copies") * HOT_SHARE > max(n, HOT_SHARE * SALTS)).select("cls", F.lit(SALTS).alias("salts"))
    large = F.broadcast(large)  # fewer than HOT_SHARE rows
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.withColumn("at", F.monotonically_increasing_id()).join(large, "cls", "left").withColumn("salt", salt).drop("salts", "at")
    named = named.join(large, "cls", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return rows.join(named, ["cls", "salt"], "left")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.session import table

    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, CAST(greatest(len(ws) - 4, 1) + 1 AS BIGINT))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON d.doc_id = c.node
"""
