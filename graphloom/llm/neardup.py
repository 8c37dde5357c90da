"""Near-duplicate classes by Order MinHash (operator 1).

A text is its lower-cased words; its shingles are runs of five words (a shorter
text is one shingle), each labelled with the number of its earlier occurrences. For
each of ``hashes`` hash functions the ``order`` smallest labelled shingles are
taken and put back in text order; their ordered tuple is one sketch entry. Two
texts share an entry with probability near J**order where the order of what they
share is kept, so entries favour edits over rearrangement. With 16 entries of order
3, two texts of similarity 0.8 share none with probability 1e-5.

1. One pass over the texts writes (doc_id, text key, shingle count, sketch); texts
   with the same words collapse to their smallest doc_id before anything is paired.
2. Entries, and pairs of neighbouring entries, are bucket keys. A bucket's texts
   are paired with its hub, the member whose buckets are largest in sum, so a
   bucket of n texts makes n - 1 pairs, never n * n. A group of copies of one
   original meets that original as hub in most of its 31 buckets.
3. Candidates whose shingle counts allow the similarity are checked on whole
   texts, a hub's in blocks: a pair links at Jaccard similarity of the shingle sets;
   banded word alignment tells how much of both stands in the same order (null where
   the band closes first: rearranged rather than edited texts, which still link).
4. Classes are connected components. Texts of buckets that still hold several
   classes are then joined exactly: two texts of the similarity share a shingle
   among the rarest of each (prefix filter, with bounds by length and place). Only
   pairs of different classes are made, and none that could be a link is left out.

Only buckets of a text, sketches, prefixes and pairs are shuffled, and the texts of candidates.

Cases: null and empty texts have the same (no) words and form one class; copies and
repeated rows share a class; a row without doc_id gets the class of its words (null
if no row with these words has one); an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import tidy, written
from ..operators.components import weak_components
from .batches import small_batches

WORDS = 5
SIMILARITY = 0.8
HASHES = 16
ORDER = 3
#: Insertions and deletions up to which the alignment of a pair is followed.
BAND = 400
#: Members of a hub that are held against it by one task at a time.
HUB_BLOCK = 64
#: Ids of candidate texts that may be broadcast (16 bytes each: at most 16 MB).
BROADCAST_IDS = 1_000_000
#: Counters that order shingles by how common they are; the order only decides the work, never the pairs that hold.
_SLOT_BITS = 17
_CACHE_WORDS = 100_000

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Weights of the words of a shingle, and a seed a hash function: odd numbers from a fixed generator.
_WEIGHTS = np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(17).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = made = int.from_bytes(blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")
        return made


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    if len(_HASHES) > _CACHE_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each run of five words; one for a shorter text, none for none."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return _mixed((words * _WEIGHTS[:n]).sum(keepdims=True) + np.uint64(n))
    out = words[: n - WORDS + 1] * _WEIGHTS[0]
    for k in range(1, WORDS):
        out += words[k : n - WORDS + 1 + k] * _WEIGHTS[k]
    return _mixed(out)


def labelled(shingle: np.ndarray) -> tuple[np.ndarray, int]:
    """Shingles told apart by how often each occurred before, and the number of different ones."""
    order = np.argsort(shingle, kind="stable")
    ordered = shingle[order]
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    distinct = int(first.sum())
    if distinct == len(shingle):
        # as the first occurrence is labelled below
        return _mixed(shingle), distinct
    at = np.arange(len(ordered))
    occurrence = np.empty(len(ordered), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mixed(shingle + occurrence * _GOLD), distinct


def sketch(labels: np.ndarray, hashes: int = HASHES, order: int = ORDER) -> np.ndarray:
    """One entry a hash function: the ordered tuple of the smallest labelled shingles."""
    out = np.empty(hashes, np.uint64)
    for t in range(hashes):
        value = (labels ^ _SEEDS[t]) * _MIX1
        value ^= value >> np.uint64(29)
        value *= _MIX2
        if len(value) > order:
            chosen = np.sort(np.argpartition(value, order)[:order])
        else:
            chosen = np.arange(len(value))
        entry = _SEEDS[t]
        for x in labels[chosen]:
            entry = _mixed(entry * _GOLD + x)
        out[t] = entry
    return out.view(np.int64)


def sketches(docs: DataFrame, hashes: int = HASHES, order: int = ORDER) -> DataFrame:
    """(doc_id, text_key, n_shingles, sketch) of each row; texts without words have no sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, counts, made = [], [], []
                for text in batch.column(1).to_pylist():
                    words = word_hashes(text)
                    keys.append(blake2b(words.tobytes(), digest_size=16).digest())
                    if len(words):
                        labels, distinct = labelled(shingles(words))
                        counts.append(distinct)
                        made.append(sketch(labels, hashes, order))
                    else:
                        counts.append(0)
                        made.append(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(made, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n_shingles", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key binary, n_shingles int, sketch array<long>")


def aligned_share(a: list, b: list, band: int = BAND) -> float | None:
    """Share of both texts' words that an alignment keeps in order; None once it needs more than ``band`` changes.

    Furthest-reaching paths by number of insertions and deletions: after d of
    them only diagonals within d of the main one are open, so the work is a band
    around the diagonal, at most ``band`` squared beside the words themselves.
    """
    n, m = len(a), len(b)
    if n + m == 0:
        return 1.0
    reach = {1: 0}
    for d in range(min(band, n + m) + 1):
        for k in range(-d, d + 1, 2):
            x = reach.get(k + 1, -1) if k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)) else reach.get(k - 1, -1) + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return (n + m - d) / (n + m)
    return None


class Verifier:
    """One text that others are held against: its words and shingles are made once."""

    def __init__(self, text: str | None):
        with np.errstate(over="ignore"):
            self.words = word_hashes(text)
            self.shingles = np.unique(shingles(self.words))

    def jaccard(self, other: Verifier) -> float:
        a, b = self.shingles, other.shingles
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared / (len(a) + len(b) - shared)

    def compare(self, other: Verifier, at_least: float = SIMILARITY) -> tuple[float, float | None]:
        """Jaccard similarity of the shingle sets, and, where that is enough, the aligned share."""
        jaccard = self.jaccard(other)
        return jaccard, aligned_share(self.words.tolist(), other.words.tolist()) if jaccard >= at_least else None


def similarity(a: str | None, b: str | None, at_least: float = SIMILARITY) -> tuple[float, float | None]:
    return Verifier(a).compare(Verifier(b), at_least)


def _buckets(texts: DataFrame) -> DataFrame:
    """(key, id, n_shingles): every entry, and every two neighbouring entries, as a bucket key."""
    single = F.transform("sketch", lambda x: F.xxhash64(x))
    double = F.zip_with(F.slice("sketch", 1, F.size("sketch") - 1), F.slice("sketch", F.lit(2), F.size("sketch") - 1), lambda x, y: F.xxhash64(x, y))
    keys = texts.where("size(sketch) > 1").select("id", "n_shingles", F.explode(F.array_distinct(F.concat(single, double))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # merged by a hint: Spark takes the exploded rows for as small as the texts, and would broadcast millions of them
    return keys.hint("merge").join(shared, "key")


def _hub_pairs(members: DataFrame, at_least: float) -> DataFrame:
    """(hub, id): each bucket's members with its hub, where their sizes allow the similarity."""
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    # merged, as a bucket's rows are far larger than in their file
    hubs = (
        members.hint("merge").join(weight, "id")
        .groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("id"), F.col("n_shingles").alias("size"))).alias("hub"))
        .select("key", (-F.col("hub.id")).alias("hub"), F.col("hub.size").alias("hub_size"))
    )
    smaller, larger = F.least("n_shingles", "hub_size"), F.greatest("n_shingles", "hub_size")
    return (
        members.hint("merge").join(hubs, "key")
        .where((F.col("id") != F.col("hub")) & (smaller >= at_least * larger))
        .select("hub", "id")
        .distinct()
    )


def _slots(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def prefix(shingle: np.ndarray, common: np.ndarray, at_least: float) -> np.ndarray:
    """The rarest of a text's different shingles, so many that a text of the similarity shares one of its own."""
    n = len(shingle)
    size = n - int(np.ceil(at_least * n - 1e-9)) + 1
    return shingle[np.lexsort((shingle, common[_slots(shingle)]))[:size]]


def _prefixes(texts: DataFrame, at_least: float) -> DataFrame:
    """(token, id, component, n, place) of each text's prefix, rarest first by counts over all of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _SLOT_BITS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [np.unique(shingles(word_hashes(text))) for text in batch.column(2).to_pylist()]
                total += np.bincount(_slots(np.concatenate([np.empty(0, np.uint64), *made])), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["slot", "n"])

    # one row a counter, however many texts there are
    counted = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << _SLOT_BITS, np.int64)
    common[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made = [np.unique(shingles(word_hashes(text))) for text in batch.column(2).to_pylist()]
                tokens = [prefix(x, common, at_least) for x in made]
                each = np.repeat(np.arange(len(made)), [len(x) for x in tokens])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.empty(0, np.uint64), *tokens]).view(np.int64), pa.int64()),
                        batch.column(0).take(pa.array(each)),
                        batch.column(1).take(pa.array(each)),
                        pa.array(np.array([len(x) for x in made], np.int32)[each], pa.int32()),
                        pa.array(np.concatenate([np.empty(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in tokens)]), pa.int32()),
                    ],
                    ["token", "id", "component", "n", "place"],
                )

    return texts.mapInArrow(run, "token long, id long, component long, n int, place int")


def _exact_pairs(known: DataFrame, docs: DataFrame, at_least: float) -> DataFrame | None:
    """(hub, id) of different classes: all that can be links among texts of buckets with several classes; the larger id is ``id``."""
    mixed = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    left = written(known.join(mixed.select("key"), "key").select("id", "component").distinct(), "left")
    if left.isEmpty():
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = written(_prefixes(texts.join(_sized(left), "id").select("id", "component", "text"), at_least), "prefixes")
    sizes = tokens.groupBy("token", "component").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("classes"))
    # written, so that the joins stand alone and a common token's rows can be split between tasks; merged as the buckets are
    tops = written(tops.where("classes > 1").select("token", F.col("top.component").alias("top")), "tops")
    every = written(tokens.hint("merge").join(tops, "token"), "tokens")
    x = every.where("component <> top").select("token", *(F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "place")))
    y = every.select("token", *(F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "place")))
    # the first token that two texts share bounds what they share in all
    shared = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    fits = (F.least("x_n", "y_n") >= at_least * F.greatest("x_n", "y_n") - 1e-9) & (shared >= at_least / (1 + at_least) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    return (
        x.hint("merge").join(y, "token")
        .where((F.col("x_component") != F.col("y_component")) & fits)
        .select(F.least("x_id", "y_id").alias("hub"), F.greatest("x_id", "y_id").alias("id"))
        .distinct()
    )


def _verified(pairs: DataFrame, docs: DataFrame, at_least: float) -> DataFrame:
    """(a, b, jaccard, aligned) with a < b of the pairs (hub, id) that hold on their whole texts.

    A hub's pairs go in blocks: a block has the hub's text once and the text of
    each of its members, so a hub of very many pairs is spread over tasks.
    """
    wanted = written(pairs.select(F.col("hub").alias("id")).union(pairs.select("id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # written, so that the joins stand alone and stay splittable
    texts = written(texts.join(_sized(wanted), "id", "left_semi").dropDuplicates(["id"]), "candidates")
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_BLOCK).alias("blocks"))
    placed = written(pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id"), "placed")
    members = placed.join(texts, "id").select("hub", "block", "id", "text")
    hubs = placed.select("hub", "block").distinct().join(texts.withColumnRenamed("id", "hub"), "hub").select("hub", "block", F.lit(None).cast("long").alias("id"), "text")
    schema = "a long, b long, jaccard double, aligned double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, place = None, None
        for batch in batches:
            found = []
            for hub, block, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None:
                    centre, place = Verifier(text), (hub, block)
                    continue
                if place != (hub, block):
                    raise ValueError(f"the text of {hub} is missing")
                jaccard, aligned = centre.compare(Verifier(text), at_least)
                if jaccard >= at_least:
                    found.append((min(hub, key), max(hub, key), jaccard, aligned))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["a", "b", "jaccard", "aligned"]
            )

    dealt = members.union(hubs).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("id").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


def classes(docs: DataFrame, at_least: float = SIMILARITY, hashes: int = HASHES, order: int = ORDER) -> DataFrame:
    """(doc_id, class_id) of each row: the smallest doc_id of its class of near duplicates."""
    spark = docs.sparkSession
    small_batches(spark)
    made = written(sketches(docs, hashes, order), "sketches")
    texts = made.groupBy("text_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    texts = written(texts, "texts")
    members = written(_buckets(texts.where("id is not null")), "buckets")
    pairs = written(_hub_pairs(members, at_least), "pairs")
    tidy(spark)
    links = written(_verified(pairs, docs, at_least), "links")
    tidy(spark)
    found = written(weak_components(links, "a", "b"), "components")
    tidy(spark)
    known = members.join(_sized(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = _exact_pairs(known, docs, at_least)
    if more is not None:
        tried = pairs.union(pairs.select("id", "hub"))
        more = written(more.join(tried, ["hub", "id"], "left_anti"), "pairs")
        tidy(spark)
        if not more.isEmpty():
            # stars of the classes so far, and the new links
            stars = found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
            links = written(_verified(more, docs, at_least).select("a", "b").union(stars), "links")
            tidy(spark)
            found = written(weak_components(links, "a", "b"), "components")
            tidy(spark)
    whole = made.select("doc_id", "text_key").join(texts.select("text_key", "id"), "text_key", "left")
    return whole.join(_sized(found), "id", "left").select("doc_id", F.coalesce("component", "id").alias("class_id"))


def _sized(ids: DataFrame) -> DataFrame:
    """Ids of a written table, to be broadcast where a count shows that they are few, else merged (a file of many ids may look small)."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")


def keep_one(docs: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, one row each; rows without doc_id stay."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    found = written(classes(docs, at_least).where("doc_id is not null"), "classes")
    dropped = written(found.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    kept = docs.join(_sized(dropped), "doc_id", "left_anti").select(*columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(_sized(repeated), "doc_id", "left_anti").select(*columns)
    return once.union(kept.join(_sized(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns))
