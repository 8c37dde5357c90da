"""Byte-level BPE encoding and decoding (operator 8).

Merging one pre-token keeps, for each byte position where a live token starts,
the rank of the pair that token forms with its right neighbour. A segment tree
over the positions holds the minimum of ``rank * length + position``, so its
root is the leftmost pair of the lowest rank; a merge changes three leaves
(the merged token, the token swallowed, the left neighbour), each a logarithmic
walk to the root. A pre-token of n bytes costs O(n log n), also when a text has
no white space at all.

Words not seen lately are merged many at a time: their trees are rows of one array,
and each step makes one merge in every row that still has a pair. Pre-tokens over
``ROW_BYTES`` bytes are merged one by one, by the same steps on lists.

Cases: a null text counts as empty; an empty text gives no ids and the digest
of the empty string; repeated rows each give a row; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches

#: Bytes of a generation of a worker's cache of segments. A full generation becomes the old one and
#: what the old one still answers moves on, so memory is bounded and frequent words stay.
CACHE_BYTES = 24 << 20
#: Longer segments are forgotten at once.
CACHED_LENGTH = 200
#: What an entry takes beside its characters: two string heads and its place in the table.
_ENTRY = 220
#: Segments handled at a time, of one text or of several.
CHUNK = 50_000
#: Longest pre-token that is merged together with others, and cells of their trees at a time.
ROW_BYTES = 128
_CELLS = 1 << 17
#: Unicode white space, as \\s means it to the rank files' pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A text falls into segments that the pattern splits independently of each other: a run of
#: white space up to its last character (to its end, if the text ends), or at most one white
#: space followed by other characters. Words repeat, so most segments are answered by a cache.
SEGMENT = re.compile(rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]?[^{SPACE}]+")

_FREE = 1 << 62


class BytePairEncoder:
    """Encoder and decoder of one rank table (``token bytes -> rank``)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.split = regex.compile(pattern).findall
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.names = list(map(str, range(max(ranks.values(), default=0) + 1)))
        # tokens that are whole strings, with their ids as decimals
        self.whole = {}
        for b, i in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[b.decode("utf-8")] = str(i)
        self.cache: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.cached = 0
        self._index()

    def _index(self) -> None:
        """Tables of the pairs that join: of bytes by their values, of tokens as sorted keys."""
        ranks = self.ranks
        self.ids_of_bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.base = max(ranks.values(), default=0) + 1
        self.byte_pairs = np.full(1 << 16, -1, np.int64)
        joins: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = rank
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joins[left * self.base + right] = rank
        keys = np.array(sorted(joins), np.int64)
        # one key beyond all others, so that a search always ends on a key
        self.joins = np.append(keys, np.int64(_FREE))
        self.joined_ranks = np.array([joins[k] for k in keys.tolist()] + [-1], np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            return cls({base64.b64decode(p[0]): int(p[1]) for p in pairs if p}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, by lowest rank and then leftmost pair first."""
        ranks, n = self.ranks, len(piece)
        if n == 0:
            return []
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        width = 1 << (n - 1).bit_length()
        tree = [_FREE] * (2 * width)
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                tree[width + i] = rank * n + i
        for v in range(width - 1, 0, -1):
            left, right = tree[2 * v], tree[2 * v + 1]
            tree[v] = left if left < right else right
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        longest = self.longest
        get = ranks.get

        while (root := tree[1]) != _FREE:
            i = root % n
            j = ends[i]
            k = ends[i] = ends[j]
            if k < n:
                before[k] = i
            h = before[i]
            # the leaves that change: the swallowed token, the merged one, its left neighbour
            for at, start, stop in ((j, 0, 0), (i, i, ends[k] if k < n else 0), (h, h, k)):
                if at < 0:
                    continue
                value = _FREE
                if 0 < stop - start <= longest and (rank := get(piece[start:stop])) is not None:
                    value = rank * n + at
                v = width + at
                if tree[v] == value:
                    continue
                tree[v] = value
                while v > 1:
                    other = tree[v ^ 1]
                    v >>= 1
                    least = value if value < other else other
                    if tree[v] == least:
                        break
                    tree[v] = value = least
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return ids

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens join to; -1 for none."""
        keys = left * self.base + right
        at = np.searchsorted(self.joins, keys)
        return np.where(self.joins[at] == keys, self.joined_ranks[at], -1)

    def _merge_rows(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are rows of bytes (of a power of two in width), and how many each has."""
        rows, width = data.shape
        place = np.arange(width)
        ids = self.ids_of_bytes[data].ravel()
        pairs = self.byte_pairs[data[:, :-1].astype(np.int64) << 8 | data[:, 1:]]
        leaves = np.full((rows, width), _FREE, np.int64)
        leaves[:, :-1] = np.where((pairs >= 0) & (place[1:] < sizes[:, None]), pairs * width + place[:-1], _FREE)
        # the levels of all rows' trees, leaves first
        levels = [leaves.ravel()]
        while len(levels[-1]) > rows:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        live = (place < sizes[:, None]).ravel()
        after, before = np.tile(place + 1, rows), np.tile(place - 1, rows)
        roots = levels[-1]
        row = np.flatnonzero(roots != _FREE)
        while len(row):
            first, end = row * width, sizes[row]
            rank, i = np.divmod(roots[row], width)
            at_i = first + i
            at_j = first + after[at_i]
            k = after[at_j]
            ids[at_i], after[at_i], live[at_j] = rank, k, False
            right = np.flatnonzero(k < end)
            at_k = (first + k)[right]
            before[at_k] = i[right]
            h = before[at_i]
            left = np.flatnonzero(h >= 0)
            at_h = (first + h)[left]
            # the leaves that change: the swallowed token, the merged one, its left neighbour
            found = self._ranks_of(np.concatenate([rank[right], ids[at_h]]), np.concatenate([ids[at_k], rank[left]]))
            changed = np.concatenate([at_i[right], at_h])
            levels[0][at_j] = levels[0][at_i] = _FREE
            levels[0][changed] = np.where(found >= 0, found * width + changed % width, _FREE)
            node = np.concatenate([at_i, at_j, at_h])
            for below, above in zip(levels, levels[1:], strict=False):
                node >>= 1
                above[node] = np.minimum(below[2 * node], below[2 * node + 1])
            row = row[roots[row] != _FREE]
        return ids[live], live.reshape(rows, width).sum(axis=1)

    def merge_many(self, pieces: list[bytes]) -> list[str]:
        """Ids of each pre-token as decimals joined by commas; those of about the same length are merged together."""
        found, names = [""] * len(pieces), self.names
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(sizes > ROW_BYTES).tolist():
            found[k] = ",".join([names[i] for i in self.merge(pieces[k])])
        low, width = 0, 2
        while width <= ROW_BYTES:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            for start in range(0, len(mine), _CELLS // width):
                part = mine[start : start + _CELLS // width]
                chosen = [pieces[k] for k in part.tolist()]
                data = np.zeros((len(part), width), np.uint8)
                data[np.arange(width) < sizes[part, None]] = np.frombuffer(b"".join(chosen), np.uint8)
                ids, counts = self._merge_rows(data, sizes[part])
                flat, ends = list(map(names.__getitem__, ids.tolist())), np.cumsum(counts)
                for k, first, end in zip(part.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    found[k] = ",".join(flat[first:end])
            low, width = width, width * 2
        return found

    def _learn(self, segments: set[str]) -> list[str]:
        """Puts the ids of the segments that aren't there yet into the cache; returns those too long to stay."""
        cache, old, whole = self.cache, self.old, self.whole
        new = segments.difference(cache)
        known = new.intersection(old)
        cache.update(zip(known, map(old.__getitem__, known), strict=True))
        unknown = list(new.difference(known))
        splits = list(map(self.split, unknown))
        pieces = list(set(chain.from_iterable(splits)).difference(whole))
        texts = dict(zip(pieces, self.merge_many([p.encode("utf-8") for p in pieces]), strict=True))
        ids = [",".join([whole[p] if p in whole else texts[p] for p in mine]) for mine in splits]
        cache.update(zip(unknown, ids, strict=True))
        self.cached += (_ENTRY + 10) * len(new) + sum(map(len, new)) + sum(map(len, ids))
        return [s for s in unknown if len(s) > CACHED_LENGTH]

    def encode_many(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """(which text, ids as decimals joined by commas), in order; a long text comes in several parts."""
        for unit in _units(texts):
            long = self._learn(set().union(*[part for _, part in unit]))
            get = self.cache.__getitem__
            for k, part in unit:
                yield k, ",".join(map(get, part))
            for s in long:
                self.cached -= _ENTRY + 10 + len(s) + len(self.cache.pop(s))
            if self.cached > CACHE_BYTES:
                self.old, self.cache, self.cached = self.cache, {}, 0

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, part in self.encode_many([text]) for i in part.split(",")]

    def decode(self, ids: Iterable[int | str]) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids])


def _units(texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
    """Segments of texts, about ``CHUNK`` at a time; texts without any are left out."""
    unit, size = [], 0
    for k, text in enumerate(texts):
        if len(text) > 8 * CHUNK:
            matches = SEGMENT.finditer(text)
            parts = iter(lambda m=matches: [x.group() for x in islice(m, CHUNK)], [])
        else:
            parts = [SEGMENT.findall(text)]
        for part in parts:
            if part:
                unit.append((k, part))
                size += len(part)
            if size >= CHUNK:
                yield unit
                unit, size = [], 0
    if unit:
        yield unit


@lru_cache(maxsize=2)
def encoder_at(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder.load(path, pattern)


def _rank_file(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def tokens(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the token ids of each whole text and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(*_rank_file(rank_file))
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(value or "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()], pa.int64()),
                        pa.array([ids], pa.list_(pa.int32())),
                        pa.array([encoder.decode(ids).decode("utf-8")], pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


class _Digest:
    """Count and digest of ids, and digest of what they decode to, fed part by part."""

    def __init__(self, bytes_of: dict[str, bytes]):
        self.bytes_of, self.n, self.ids, self.decoded = bytes_of, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, joined: str) -> None:
        part = joined.split(",")
        self.ids.update((("," if self.n else "") + joined).encode())
        self.decoded.update(b"".join(map(self.bytes_of.__getitem__, part)))
        self.n += len(part)


def digests(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of each whole text.

    The hashes are fed part by part, so a text of any length needs only one
    chunk of its ids at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(*_rank_file(rank_file))
        for batch in batches:
            texts = [value or "" for value in batch.column(1).to_pylist()]
            found = [_Digest(encoder.bytes_of) for _ in texts]
            for k, joined in encoder.encode_many(texts):
                found[k].add(joined)
            decoded = [d.decoded.hexdigest() for d in found]
            same = [d == hashlib.sha256(t.encode("utf-8")).hexdigest() for d, t in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([d.n for d in found], pa.int64()),
                    pa.array([d.ids.hexdigest() for d in found], pa.string()),
                    pa.array(decoded, pa.string()),
                    pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    )
