"""Benchmark decontamination by latent semantic retrieval (operator 7).

1. One pass over all documents and items counts in how many texts each hashed word is
   and adds up passages, with random signs, for the range Q of the next step.
2. A randomised SVD of TF-IDF passages: the products A'(A Q) give singular values and
   vectors. The basis is fitted once, to all passages of the benchmark's items and of all
   documents; a task hands on terms x width numbers, whatever it reads, summed in slices.
3. Every document is cut into blocks of eight words; sums of 2, 4, 8, ... blocks are
   passages of 16, 32, 64, ... words (and blocks are passages of eight), each half a
   passage after the last. An item is compared with all passages of the next smaller and
   the next larger width; a cosine in the latent space of at least ``near`` makes a candidate.
4. A candidate counts if the longest common subsequence of the item's words and a
   stretch little longer than the item covers ``overlap`` of the item, and, for items
   that state an answer (after a last question mark or ``answer:``), if the answer's
   words are there as well. That finds verbatim and reworded passages alike.

The search is a map over the documents: nothing is shuffled. Items go to the tasks
in blocks of at most ``item_block``; a larger benchmark takes more passes.

Cases: null and empty texts and items without words match nothing; a null doc_id
is reported as null; repeated rows are reported once per distinct pair; without
items (or documents) there are no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import tidy
from .batches import small_batches

TERM_BITS = 13
TERMS = 1 << TERM_BITS
RANK = 128
NEAR = 0.4
#: Least number of tasks of the fit; there is one a core where there are more, so that few products are summed.
_FIT_TASKS = 8
_SLICES = 32
#: Columns of the range finder beyond the rank, and sums that a passage goes to.
_OVERSAMPLE, _SIGNS = 16, 2
OVERLAP = 0.7
ITEM_BLOCK = 5_000
BLOCK = 8
_FIT_WORDS = 32
#: Passages of the fit and blocks of the search at a time: their vectors stay in a core's cache.
_FIT_ROWS = 128
#: Words whose vectors are fetched at a time, for the same reason.
_ROOM = 16 * _FIT_WORDS
#: Occurrences among those from which a term counts as common.
_COMMON = 3
_ROWS = 1024

_ANSWER = re.compile(r"(?:^|\b)answer\s*:\s*(.+)$|\?\s*([^?]+)$", re.I | re.S)

#: Bytes of words: letters, digits, underscore, and all that UTF-8 needs beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
#: Bytes handled at a time (a longer word is cut there).
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PIECE, _BASE, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_PIECE, pow(_BASE, -1, 1 << 64), np.uint64)])


@dataclass(frozen=True)
class Words:
    """The lower-cased words of a text: where they stand in its bytes, and their hashed terms."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, text: str | None) -> Words:
        data = (text or "").lower().encode("utf-8")
        made, at = [], 0
        while at < len(data):
            stop = at + _PIECE
            if stop < len(data):
                # back to the last byte between words, if there is one
                while stop > at and _IN_WORD[data[stop - 1]]:
                    stop -= 1
                stop = stop if stop > at else at + _PIECE
            made.append(cls._piece(data, at, min(stop, len(data))))
            at = stop
        if not made:
            none = np.zeros(0, np.int64)
            return cls(data, none, none, none)
        return cls(data, *(np.concatenate(parts) for parts in zip(*made, strict=True)))

    @staticmethod
    def _piece(data: bytes, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A word's hash is the polynomial of its bytes: a difference of running sums, moved to power 0."""
        piece = np.frombuffer(data, np.uint8, stop - at, at)
        edge = np.flatnonzero(np.diff(_IN_WORD[piece].view(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * _POWERS[: len(piece)], out=sums[1:])
            value = (sums[ends] - sums[starts]) * _INVERSE[starts]
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return starts + at, ends + at, (value >> np.uint64(64 - TERM_BITS)).astype(np.int64)

    @classmethod
    def of_many(cls, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """The words of several texts together, and which text each is in."""
        parts = [(t or "").lower() for t in texts]
        sizes = np.array([len(p) if p.isascii() else len(p.encode("utf-8")) for p in parts], np.int64)
        words = cls.of("\n".join(parts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        return words, np.searchsorted(begins, words.starts, "right") - 1

    def __len__(self) -> int:
        return len(self.terms)

    def between(self, first: int, last: int) -> list[bytes]:
        spans = zip(self.starts[max(0, first) : last].tolist(), self.ends[max(0, first) : last].tolist(), strict=True)
        return [self.data[s:e] for s, e in spans]


def together(texts: list[str | None], size: int = _PIECE // 2) -> Iterator[list[str | None]]:
    """Texts in groups of about ``size`` characters (a longer text is a group of its own)."""
    group, total = [], 0
    for text in texts:
        if group and total + len(text or "") > size:
            yield group
            group, total = [], 0
        group.append(text)
        total += len(text or "")
    if group:
        yield group


def words_of(text: str | None) -> list[bytes]:
    words = Words.of(text)
    return words.between(0, len(words))


def term_ids(text: str | None) -> np.ndarray:
    return Words.of(text).terms


def _summed(parts: DataFrame, *wanted: tuple[tuple[int, ...], type]) -> list[np.ndarray]:
    """Sums of arrays that tasks give as rows (slice, v): slices are summed apart, and the driver gets the sums."""
    kinds = [kind for _, kind in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(v.as_buffer(), kinds[k // _SLICES])
                total[k] = total[k] + part if k in total else part
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["slice", "v"])

    dealt = parts.repartition(_SLICES, "slice").mapInArrow(run, "slice int, v binary")
    out = [np.zeros(shape, kind) for shape, kind in wanted]
    flat = [part for total in out for part in np.array_split(total.reshape(-1), _SLICES)]
    for row in dealt.toLocalIterator():
        flat[row["slice"]][:] = np.frombuffer(row["v"], kinds[row["slice"] // _SLICES])
    return out


def _sliced(*totals: np.ndarray) -> pa.RecordBatch:
    """Arrays as rows (slice, v)."""
    parts = [part for total in totals for part in np.array_split(total.reshape(-1), _SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "v"])


def _fit_rows(*tables: DataFrame) -> DataFrame:
    """The texts of tables, dealt to a bounded number of tasks, as each hands on a whole array."""
    rows = tables[0].select(F.col("text").cast("string").alias("text"))
    for table in tables[1:]:
        rows = rows.union(table.select(F.col("text").cast("string").alias("text")))
    return rows.coalesce(max(_FIT_TASKS, rows.sparkSession.sparkContext.defaultParallelism))


def _count_documents(total: np.ndarray, words: Words, text_of: np.ndarray, n: int) -> None:
    """Adds to ``total`` how many of n texts have each term, and at its end how many there are."""
    for first in range(0, n, 256):
        mine = (text_of >= first) & (text_of < first + 256)
        seen = np.zeros((min(256, n - first), TERMS), bool)
        seen[text_of[mine] - first, words.terms[mine]] = True
        total[:TERMS] += seen.sum(axis=0)
    total[TERMS] += n


def _passages(groups: Iterator[list[str | None]], idf: np.ndarray | None = None, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, term, weight) of the cells of unit TF-IDF passages (TF without ``idf``), a few thousand words at a time; passages count from 0.

    ``counts`` gets the numbers of texts with each term.
    """
    for group in groups:
        words, text_of = Words.of_many(group)
        if counts is not None:
            _count_documents(counts, words, text_of, len(group))
        if not len(words):
            continue
        sizes = np.bincount(text_of, minlength=len(group))
        passages = -(-sizes // _FIT_WORDS)
        at = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[text_of]
        row = (np.cumsum(passages) - passages)[text_of] + at // _FIT_WORDS
        for first in range(0, int(row[-1]) + 1, _FIT_ROWS):
            mine = slice(*np.searchsorted(row, [first, first + _FIT_ROWS]))
            cells, times = np.unique((row[mine] - first) * TERMS + words.terms[mine], return_counts=True)
            passage, term = cells // TERMS, cells % TERMS
            weight = times.astype(float) if idf is None else times * idf[term]
            norm = np.sqrt(np.bincount(passage, weight**2))
            yield passage, term, weight / np.maximum(norm, 1e-12)[passage]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x)[0]


def _add_products(total: np.ndarray, passage: np.ndarray, term: np.ndarray, weight: np.ndarray, table: np.ndarray, room: np.ndarray) -> None:
    """Adds A'(A table) to ``total`` for cells of A, in the order of their passages, of which each has one.

    A table is a product a passage; A' takes common terms as a small matrix, others one occurrence after another.
    Rows of the table go through ``room`` (of two halves), a few passages at a time, so that they stay in a core's cache.
    """
    cells = np.bincount(passage)
    widest, width = int(cells.max()), table.shape[1]
    place = passage * widest + np.arange(len(passage)) - (np.cumsum(cells) - cells)[passage]
    # passages of fewer cells are filled up with cells of no weight
    terms, weights = np.zeros(len(cells) * widest, np.int64), np.zeros(len(cells) * widest, np.float32)
    terms[place], weights[place] = term, weight
    seen = np.empty((len(cells), 1, width), np.float32)
    half, step = len(room) // 2, max(1, len(room) // 2 // widest)
    for k in range(0, len(cells), step):
        part = terms[k * widest : (k + step) * widest]
        rows = np.take(table, part, axis=0, out=room[: len(part)], mode="clip").reshape(-1, widest, width)
        np.matmul(weights[k * widest : (k + step) * widest].reshape(-1, 1, widest), rows, out=seen[k : k + step])
    seen = seen[:, 0]
    # numbers of 16 bits are sorted by their digits
    order = np.argsort(term.astype(np.uint16), kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(term[order]) != 0])
    times = np.diff(np.r_[starts, len(term)])
    is_common = times > _COMMON
    common = term[order[starts[is_common]]]
    mine = order[np.repeat(is_common, times)]
    dense = np.zeros((len(seen), len(common)), np.float32)
    dense[passage[mine], np.repeat(np.arange(len(common)), times[is_common])] = weight[mine]
    total[common] += dense.T @ seen
    starts, times = starts[~is_common], times[~is_common]
    for k in range(_COMMON):
        # each term once
        once = order[starts[times > k] + k]
        for first in range(0, len(once), half):
            cell = once[first : first + half]
            more = np.take(seen, passage[cell], axis=0, out=room[: len(cell)], mode="clip")
            more *= weight[cell, None]
            more += np.take(total, term[cell], axis=0, out=room[half : half + len(cell)], mode="clip")
            total[term[cell]] = more


def fitted(docs: DataFrame, items: DataFrame, rank: int = RANK, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the terms (``idf``, if given), and whitened right singular vectors (terms x rank) of the TF-IDF passages A.

    A distributed randomised SVD in two passes, both over all passages of documents and
    items alike. The first counts in how many texts each term is, and finds the range:
    each passage, scaled by its plain term counts, is added with random signs to a few
    random ones of ``width`` sums; weighted by term, these span Q. The second sums
    A'(A Q), which with Q'A'A Q gives the eigenvalues and vectors of A'A (Nystroem).
    Each vector is divided by its eigenvalue: what all passages share stops drowning
    what tells them apart, so that cosines of unrelated passages lie near zero.
    """
    rows, width = _fit_rows(docs, items), rank + _OVERSAMPLE

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros(TERMS * width), np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for passage, term, weight in _passages(together(batch.column(0).to_pylist()), counts=counts):
                # seeded by what is read, so that a task that runs again gives the same
                rng = np.random.default_rng([len(term), *term[:8].tolist(), *term[-8:].tolist()])
                place = rng.integers(0, width, (int(passage[-1]) + 1, _SIGNS))
                sign = rng.choice([-1.0, 1.0], place.shape)
                for k in range(_SIGNS):
                    np.add.at(total, term * width + place[passage, k], weight * sign[passage, k])
        yield _sliced(total.astype(np.float32), counts)

    sums, counts = _summed(rows.mapInArrow(sketch, "slice int, v binary"), ((TERMS, width), np.float32), ((TERMS + 1,), np.int64))
    if idf is None:
        idf = np.log((1 + counts[TERMS]) / (1 + counts[:TERMS])) + 1e-3
    sums = sums.astype(np.float64)
    sums *= idf[:, None]
    q = _orthonormal(sums)
    del sums
    table = q.astype(np.float32)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, width))
        room = np.empty((2 * _ROOM, width), np.float32)
        for batch in batches:
            part = np.zeros((TERMS, width), np.float32)
            for passage, term, weight in _passages(together(batch.column(0).to_pylist()), idf):
                _add_products(part, passage, term, weight.astype(np.float32), table, room)
            total += part
        yield _sliced(total.astype(np.float32))

    image = _summed(rows.mapInArrow(product, "slice int, v binary"), ((TERMS, width), np.float32))[0].astype(np.float64)
    # directions that nothing lies in are left out
    inner, across = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    held = inner > max(1e-9, 1e-7 * inner[-1])
    vectors, lengths, _ = np.linalg.svd(image @ (across[:, held] / np.sqrt(inner[held])), full_matrices=False)
    return idf, vectors[:, :rank] / np.maximum(lengths[:rank] ** 2, 1e-9)


def latent_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    return fitted(docs, items, rank, idf)[1]


def common_subsequence(positions: dict[bytes, int], size: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``positions`` has each word's bits in a text of ``size``."""
    full = (1 << size) - 1
    row = full
    get = positions.get
    for word in words:
        if mask := get(word):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _bits(words: list[bytes]) -> dict[bytes, int]:
    bits: dict[bytes, int] = {}
    for k, word in enumerate(words):
        bits[word] = bits.get(word, 0) | 1 << k
    return bits


@dataclass(frozen=True)
class Item:
    item_id: int | None
    words: tuple[bytes, ...]
    answer: tuple[bytes, ...]
    terms: np.ndarray

    @classmethod
    def of(cls, item_id: int | None, text: str | None) -> Item:
        found = _ANSWER.search(text or "")
        answer = words_of(next((g for g in found.groups() if g), "")) if found else []
        return cls(item_id, tuple(words_of(text)), tuple(answer), term_ids(text))

    def share(self, region: list[bytes], bits: dict[bytes, int]) -> float:
        return common_subsequence(bits, len(self.words), region) / len(self.words)


class Detector:
    """Finds a block of items in texts: latent retrieval, then subsequence and answer checks."""

    def __init__(self, items: list[Item], terms: np.ndarray, near: float = NEAR, overlap: float = OVERLAP):
        self.items, self.near, self.overlap = [i for i in items if i.words], near, overlap
        # the last term is no word: it fills texts up to whole blocks
        self.terms = np.vstack([terms, np.zeros((1, terms.shape[1]))]).astype(np.float32)
        self.bits = [_bits(list(i.words)) for i in self.items]
        self.tables: dict[int, np.ndarray] = {}
        self.buffer: np.ndarray | None = None
        # an item is sought at both widths (in blocks) next to its length: a narrow passage holds few
        # foreign words, a wide one most of the item
        self.spans: list[tuple[int, np.ndarray, np.ndarray]] = []
        widths = np.array([max(0, math.floor(math.log2(len(i.words) / BLOCK))) for i in self.items], int)
        for width in sorted({w + more for w in widths.tolist() for more in (0, 1)}):
            mine = np.flatnonzero((widths == width) | (widths + 1 == width))
            vectors = np.stack([self.terms[self.items[k].terms].sum(axis=0) for k in mine])
            self.spans.append((1 << width, mine, (vectors / self._norms(vectors)).T.copy()))

    @staticmethod
    def _norms(rows: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]

    def _sums(self, terms: np.ndarray) -> np.ndarray:
        """The sum of the vectors of each whole block of terms."""
        if self.buffer is None:
            # one buffer for all: fresh memory costs more than what is done with it
            self.buffer = np.empty((_ROOM, self.terms.shape[1]), np.float32)
        sums = np.empty((len(terms) // BLOCK, self.terms.shape[1]), np.float32)
        for first in range(0, len(sums), _ROOM // BLOCK):
            part = terms[first * BLOCK : first * BLOCK + _ROOM]
            words = np.take(self.terms, part, axis=0, out=self.buffer[: len(part)], mode="clip")
            words.reshape(-1, BLOCK, words.shape[1]).sum(axis=1, out=sums[first : first + _ROOM // BLOCK])
        return sums

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(items, first blocks, blocks of a passage) of the passages near an item, in a run of whole blocks of terms."""
        # a long run in stretches that overlap by the longest passage
        reach, step = self.spans[-1][0], _ROWS
        for start in range(0, len(terms) // BLOCK, step):
            sums, width, stride = self._sums(terms[start * BLOCK : (start + step + reach) * BLOCK]), 1, 1
            for span, items, vectors in self.spans:
                while width < span:
                    # passages of twice the width, half a passage apart: sums of two of half the width
                    wider = sums[:: max(1, width // stride)].copy()
                    beside = sums[width // stride :: max(1, width // stride)]
                    wider[: len(beside)] += beside
                    sums, stride, width = wider, width, width * 2
                # as one row: many times faster than rows and columns
                near = np.flatnonzero(sums @ vectors >= self.near * self._norms(sums))
                if len(near):
                    rows, cols = np.divmod(near, len(items))
                    yield items[cols], start + rows * stride, span

    def find_many(self, texts: list[str | None]) -> list[list[tuple[int | None, float]]]:
        """Of each text, the (item_id, share of its words in order) of the items that it holds."""
        found: list[list[tuple[int | None, float]]] = []
        for group in together(texts):
            found += self._find(group) if self.items else [[] for _ in group]
        return found

    def find(self, text: str | None) -> list[tuple[int | None, float]]:
        return self.find_many([text])[0]

    def _find(self, texts: list[str | None]) -> list[list[tuple[int | None, float]]]:
        words, text_of = Words.of_many(texts)
        counts = np.bincount(text_of, minlength=len(texts))
        first_word = np.cumsum(counts) - counts
        # texts start where passages of every width do
        stride = max(1, self.spans[-1][0] // 2)
        blocks = -(-counts // (BLOCK * stride)) * stride
        first_block = np.cumsum(blocks) - blocks
        terms = np.full(int(blocks.sum()) * BLOCK, TERMS)
        terms[first_block[text_of] * BLOCK + np.arange(len(words)) - first_word[text_of]] = words.terms
        best: list[dict[int, float]] = [{} for _ in texts]
        filled = np.flatnonzero(blocks)
        for items, at, span in self.candidates(terms):
                # a passage that runs into the next text adds nothing: its region ends with its own text
            texts_at = filled[np.searchsorted(first_block[filled], at, "right") - 1]
            for k, t, first in zip(items.tolist(), texts_at.tolist(), ((at - first_block[texts_at]) * BLOCK).tolist(), strict=True):
                item, base = self.items[k], int(first_word[t])
                size = len(item.words)
                if best[t].get(k, 0.0) >= 1.0:
                    continue
                start, stop = base + max(0, first - size), base + min(int(counts[t]), first + span * BLOCK + size)
                # a common subsequence can't be longer than the words that the item has at all
                if np.count_nonzero(self._has(k)[words.terms[start:stop]]) < self.overlap * size:
                    continue
                region = words.between(start, stop)
                share = item.share(region, self.bits[k])
                if share >= self.overlap and self._close(item, region, k) and self._answered(item, region):
                    best[t][k] = max(best[t].get(k, 0.0), share)
        order = lambda x: (x[0] is not None, x[0] or 0, x[1])
        return [sorted(((self.items[k].item_id, s) for k, s in b.items()), key=order) for b in best]

    def _has(self, k: int) -> np.ndarray:
        """Which terms an item has; made when the item is first met."""
        if k not in self.tables:
            self.tables[k] = np.zeros(TERMS, bool)
            self.tables[k][self.items[k].terms] = True
        return self.tables[k]

    def _close(self, item: Item, region: list[bytes], k: int) -> bool:
        """The common words stand together: some stretch a quarter longer than the item holds them."""
        size = len(item.words)
        width, stride = size + max(4, size // 4), max(1, size // 8)
        last = max(1, len(region) - width + stride)
        return any(item.share(region[s : s + width], self.bits[k]) >= self.overlap for s in range(0, last, stride))

    def _answered(self, item: Item, region: list[bytes]) -> bool:
        if not item.answer:
            return True
        return common_subsequence(_bits(list(item.answer)), len(item.answer), region) >= 0.5 * len(item.answer)


def detectors(docs: DataFrame, benchmark: DataFrame, near: float = NEAR, overlap: float = OVERLAP, rank: int = RANK, item_block: int = ITEM_BLOCK) -> Iterator[Detector]:
    """A detector for each block of at most ``item_block`` benchmark items (read block by block)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    count = rows.count()
    if not count:
        return
    small_batches(docs.sparkSession)
    idf, basis = fitted(docs, rows, rank)
    tidy(docs.sparkSession)
    terms = idf[:, None] * basis
    blocks = -(-count // item_block)
    for block in range(blocks):
        # hashing deals items out; a block holds item_block of them on average
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Detector([Item.of(r["item_id"], r["text"]) for r in mine], terms, near, overlap)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, overlap) of every document and item found in it."""
    schema = "doc_id long, item_id long, overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for detector in detectors(docs, benchmark, **options):
        part = rows.mapInArrow(_reporting(detector), schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))


def _reporting(detector: Detector) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = detector.find_many(batch.column(1).to_pylist())
            out = [(d, i, s) for d, pairs in zip(batch.column(0).to_pylist(), found, strict=True) for i, s in pairs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
                ["doc_id", "item_id", "overlap"],
            )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are."""
    at, kept = docs.columns.index("text"), docs
    for detector in detectors(docs, benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], detector: Detector = detector) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in detector.find_many(batch.column(at).to_pylist())], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
