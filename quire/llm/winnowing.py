"""Benchmark decontamination by winnowing.

A *window* is 8 consecutive words of a benchmark item (a shorter item is one
window). Winnowing keeps, of every 4 consecutive 5-gram hashes, the smallest: a
shared span of 8 words has exactly 4 five-grams, so equal spans always keep an
equal fingerprint. Fingerprints of documents are therefore looked up among the
benchmark's, and each hit is extended to the windows that contain it, whose
words are then compared themselves; what is returned rests on equal words, not
on equal hashes.

Size: the fingerprint filter is a bitmap of 8 to 16 places for each window, from
2 ** ``FILTER_BITS[0]`` to 2 ** ``FILTER_BITS[1]`` (128 MB); it comes to the driver as
64-bit words. Up to ``SMALL_WINDOWS`` pairs of window and item (counted first) are
broadcast and one pass over the documents finishes; beyond, the windows that pass the
filter are joined with the benchmark's by their text, salted, under a row key: the
documents' own columns stay where they are until the hits come back.

Defined cases: null, empty and wordless texts have no words, windows or hits;
repeated items count once by id; an item without an id marks words but is not
counted; repeated documents each get their row; a window held by very many items gives each of
its documents all of them; very long texts are one row of a batch; other columns are
ignored, whatever their names; an empty benchmark hits nothing, and an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import WordHash, alnum_words, chunks, covered, flatten, grams, starts, texts_of
from quire.session import written

WINDOW = 8
GRAM = 5
KEPT_OF = WINDOW - GRAM + 1
FILTER_BITS = (22, 30)
SMALL_WINDOWS = 200_000
SALTS = 16
CONTAMINATED_FROM = 2


def fingerprints(h: np.ndarray, offsets: np.ndarray, m: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of m words: start, owner, the place of their fingerprint and its value.

    For m < WINDOW the window is its own k-gram. At equal hashes the right-most is
    kept, so that neighbouring windows share a fingerprint and its place never falls.
    """
    at, owner = starts(offsets, m)
    if not len(at):
        return at, owner, at, np.zeros(0, np.uint64)
    if m < WINDOW:
        return at, owner, at, grams(h, m)[at]
    g = grams(h, GRAM)
    of_window = np.stack([g[at + j] for j in range(KEPT_OF - 1, -1, -1)])
    back = np.argmin(of_window, axis=0)
    place = at + (KEPT_OF - 1 - back)
    return at, owner, place, of_window[back, np.arange(len(at))]


def candidates(h: np.ndarray, offsets: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window size: starts and owners of the windows that a fingerprint hit extends to."""
    for m in sizes:
        at, owner, place, value = fingerprints(h, offsets, m)
        if not len(at):
            continue
        first = np.concatenate([[True], place[1:] != place[:-1]])  # the winnowed selection
        slot = (value[first] & np.uint64(len(bitmap) * 64 - 1)).astype(np.int64)
        hit = (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
        extended = hit[np.cumsum(first) - 1]
        yield m, at[extended], owner[extended]


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, m, window, fingerprint): every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in chunks(batches, "text", 1 << 20):
            ids = batch.column(0)
            words = [alnum_words(t) for t in texts_of(batch, "text")]
            h, offsets = flatten(words, hashes)
            flat = [w for ws in words for w in ws]
            sizes = np.diff(offsets)
            who, ms, texts, slots = [], [], [], []
            for m in sorted({min(int(n), WINDOW) for n in sizes if n}):
                at, owner, _, value = fingerprints(h, offsets, m)
                fits = (sizes[owner] >= WINDOW) if m == WINDOW else (sizes[owner] == m)
                for i, o, v in zip(at[fits].tolist(), owner[fits].tolist(), value[fits].view(np.int64).tolist(), strict=True):
                    who.append(o)
                    ms.append(m)
                    texts.append(b" ".join(flat[i : i + m]))
                    slots.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(who, pa.int64())), pa.array(ms, pa.int32()), pa.array(texts, pa.binary()), pa.array(slots, pa.int64())],
                ["item_id", "m", "window", "fingerprint"],
            )

    slim = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "item_id bigint, m int, window binary, fingerprint bigint")


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


OUT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, item_ids array<bigint>"


def filter_of(found: DataFrame) -> np.ndarray:
    """The fingerprints' places as 64-bit words of a bitmap."""
    n = found.count()
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], math.ceil(math.log2(n + 1)) + 3))
    place = F.col("fingerprint").bitwiseAND(F.lit((1 << bits) - 1))
    slots = found.select(place.alias("place")).selectExpr("shiftright(place, 6) AS w", "shiftleft(1L, cast(place & 63 AS int)) AS bits")
    words = slots.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), small_windows: int = SMALL_WINDOWS
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, item_ids and contaminated."""
    spark = docs.sparkSession
    found = written(windows(items), "winnowing-windows")
    sizes = sorted(r.m for r in found.select("m").distinct().collect())  # at most WINDOW
    bitmap = filter_of(found)
    few = found.select("window", "item_id").distinct().limit(small_windows + 1).count() <= small_windows
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("text"))
    keys = [f"k{i}" for i in range(len(keep))]
    out = (_by_dictionary if few else _by_join)(spark, slim, found, sizes, bitmap)
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(keys, keep, strict=True)],
        "n_words", "n_hit", "n_items", "items_sha256", "item_ids", (F.col("n_items") >= CONTAMINATED_FROM).alias("contaminated"),
    )


def _types(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes if c != "text")


def _others(batch: pa.RecordBatch) -> tuple[list, list[str]]:
    names = [c for c in batch.schema.names if c != "text"]
    return [batch.column(batch.schema.get_field_index(c)) for c in names], names


def _by_dictionary(spark, slim: DataFrame, found: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    rows = found.groupBy("window").agg(F.collect_set("item_id").alias("ids")).collect()
    shared = spark.sparkContext.broadcast((sizes, bitmap, {bytes(r.window): tuple(r.ids) for r in rows}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        sizes, bitmap, known = shared.value
        for batch in chunks(batches, "text"):
            words = [alnum_words(t) for t in texts_of(batch, "text")]
            h, offsets = flatten(words, hashes)
            hit = np.zeros(len(h) + 1, np.int64)
            ids: dict[int, set] = {}
            for m, at, owner in candidates(h, offsets, sizes, bitmap):
                base = offsets[owner]
                same = []
                for i, o, b in zip(at.tolist(), owner.tolist(), base.tolist(), strict=True):
                    got = known.get(b" ".join(words[o][i - b : i - b + m]))
                    if got is not None:
                        same.append(i)
                        ids.setdefault(o, set()).update(got)
                if same:
                    hit[:-1] |= covered(np.array(same), m, len(h))
            n_hit = np.concatenate([[0], np.cumsum(hit[:-1])])
            items = [sorted(ids.get(i, ())) for i in range(batch.num_rows)]
            cols, names = _others(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    *cols,
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(n_hit[offsets[1:]] - n_hit[offsets[:-1]], pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([_digest(x) for x in items], pa.string()),
                    pa.array(items, pa.list_(pa.int64())),
                ],
                [*names, *(x.split()[0] for x in OUT.split(", "))],
            )

    return slim.mapInArrow(run, f"{_types(slim)}, {OUT}")


def _by_join(spark, slim: DataFrame, found: DataFrame, sizes: list[int], bitmap: np.ndarray) -> DataFrame:
    shared = spark.sparkContext.broadcast((sizes, bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        sizes, bitmap = shared.value
        for batch in chunks(batches, "text"):
            words = [alnum_words(t) for t in texts_of(batch, "text")]
            h, offsets = flatten(words, hashes)
            places: list[list] = [[] for _ in words]
            for m, at, owner in candidates(h, offsets, sizes, bitmap):
                for i, o, b in zip(at.tolist(), owner.tolist(), offsets[owner].tolist(), strict=True):
                    places[o].append({"at": i - b, "m": m, "window": b" ".join(words[o][i - b : i - b + m])})
            cols, names = _others(batch)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("m", pa.int32()), ("window", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offsets), pa.int64()), pa.array(places, kind)], [*names, "n_words", "places"])

    keyed = slim.withColumn("row", F.monotonically_increasing_id())
    places = "places array<struct<at: int, m: int, window: binary>>"
    kept = [c for c in keyed.columns if c not in ("text", "row")]
    every = written(keyed.mapInArrow(run, f"{_types(keyed)}, n_words bigint, {places}"), "winnowing-rows")
    rows = every.select("row", F.explode("places").alias("p"))
    rows = rows.select("row", "p.at", "p.m", "p.window", F.pmod(F.xxhash64("row", "p.at"), F.lit(SALTS)).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    known = found.select("window").distinct().select("window", salts)
    hits = written(rows.join(known, ["window", "salt"]), "winnowing-hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("at", "m")).alias("spans"))
    # Pairs of row and window first, so that a window's items are met once for each document.
    of_items = found.where("item_id IS NOT NULL").select("window", "item_id").distinct().select("*", salts)
    pairs = hits.select("row", "window", "salt").distinct().join(of_items, ["window", "salt"]).select("row", "item_id").distinct()
    ids = pairs.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    none = F.array().cast("array<struct<at: int, m: int>>")
    grouped = every.drop("places").join(spans, "row", "left").join(ids, "row", "left")
    grouped = grouped.withColumn("spans", F.coalesce("spans", none)).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<bigint>")))
    # The spans in order of their start; the union's length grows by what lies past the furthest end so far.
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        end = (s["at"] + s["m"]).cast("bigint")
        more = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(acc["end"], s["at"].cast("bigint")))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    as_text = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return grouped.select(
        *kept,
        "n_words",
        F.aggregate(F.array_sort("spans"), state, step)["n"].alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(as_text, 256).alias("items_sha256"),
        "item_ids",
    )
