"""Best-fit packing: hierarchical residual packing of token sequences.

Documents become token ids plus an end id; only documents longer than a sequence are cut. Pieces are packed best-fit
decreasing within bounded partitions; nearly full bins are emitted and underfull bins go up a tree as items for
further best-fit rounds with a growing allowance, until the last round emits all. The number of partitions of a round
follows its number of items, so no task gets more than ``items_a_task`` (and bins of the last round stay whole).

Defined results: null and empty text is the single end id; equal rows give equal pieces in places of their own; an
empty table gives an empty table; columns other than doc_id and text are ignored; ties go to the fuller bin.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, materialize, worker_cache
from .textops import word_bounds, word_hashes

CAPACITY = 2048
END = 0
#: Words that are letters and then signs, each one unit for the tokenizer's own pattern (a fixed value of the vocabulary
#: file); of alphabets that need no normalisation, and without signs that begin a special token or a contraction.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!-&(-/:;=-@\[-`{-~]*)")


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of words met, found by hash and confirmed by their bytes; all in flat arrays, about 40 bytes a word."""

    def __init__(self):
        self.keys, self.at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted hashes; their entries
        self.spelled, self.spelled_to = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        self.ids, self.ids_to = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each word (distinct hashes, with places in ``buf``), -1 if it is not there."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[i] == h)
        entry = self.at[i[hit]]
        size = ends[hit] - starts[hit]
        same = self.spelled_to[entry + 1] - self.spelled_to[entry] == size
        hit, entry, size = hit[same], entry[same], size[same]
        differ = buf[spread(starts[hit], size)] != self.spelled[spread(self.spelled_to[entry], size)]
        wrong = np.add.reduceat(differ, np.cumsum(size) - size) if len(size) else size
        out[hit[wrong == 0]] = entry[wrong == 0]
        return out

    def add(self, h: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        n = len(self.spelled_to) - 1
        self.spelled_to = np.concatenate([self.spelled_to, self.spelled_to[-1] + np.cumsum([len(w) for w in words])])
        self.ids_to = np.concatenate([self.ids_to, self.ids_to[-1] + np.cumsum([len(x) // 4 for x in ids])])
        self.spelled = np.concatenate([self.spelled, np.frombuffer(b"".join(words), dtype=np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), dtype="<u4")])
        i = np.searchsorted(self.keys, h)  # both are sorted and distinct
        new = np.ones(len(h), dtype=bool)  # of words with one hash the first is found, the other is encoded each time
        inside = i < len(self.keys)
        new[inside] = self.keys[i[inside]] != h[inside]
        self.keys, self.at = np.insert(self.keys, i[new], h[new]), np.insert(self.at, i[new], n + np.flatnonzero(new))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs of ``sizes`` from ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Encoder:
    """Token ids of texts, equal to the tokenizer's own, by words: merges never cross white space, so each distinct word
    of a group of texts is encoded once, from its letters and the signs behind them, and kept. A memory of over ``limit``
    words starts again, so what a worker holds is bounded."""

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words = Words()
        self.units: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn_units(self, units: set[str]) -> None:
        if len(self.units) > self.limit // 20:
            self.units = {"": b""}
        fresh = list(units.difference(self.units))
        for a in range(0, len(fresh), 500):
            part = fresh[a : a + 500]
            ids = self._ids(" ".join(part))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()  # one end of word a unit
            data = ids.tobytes()
            if len(cuts) == len(part) and cuts[-1] == len(data):
                self.units.update((u, data[i:j]) for u, i, j in zip(part, [0, *cuts], cuts, strict=False))
            else:
                self.units.update((u, self._ids(u).tobytes()) for u in part)

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        found: list = [SIMPLE.fullmatch(w.decode()) for w in words]
        pairs = [(m[1].lower(), m[2]) if m else None for m in found]
        self._learn_units({u for pair in pairs if pair for u in pair})
        units = self.units
        return [units[p[0]] + units[p[1]] if p else self._ids(w.decode()).tobytes() for p, w in zip(pairs, words, strict=True)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data = b"\n".join(raw)
        buf = np.frombuffer(data, dtype=np.uint8)
        starts, ends = word_bounds(buf)
        h, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.words) > self.limit:
            self.words = Words()
        s, e = starts[first], ends[first]
        entry = self.words.find(h, buf, s, e)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            spelled = [data[a:b] for a, b in zip(s[fresh].tolist(), e[fresh].tolist(), strict=True)]
            entry[fresh] = len(self.words.spelled_to) - 1 + np.arange(len(fresh))
            self.words.add(h[fresh], spelled, self._encode_words(spelled))
        a, n = self.words.ids_to[entry][which], np.diff(self.words.ids_to)[entry][which]
        ids = self.words.ids[spread(a, n)]
        first_word = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        return np.split(ids, np.concatenate([[0], np.cumsum(n)])[first_word[1:-1]]) if texts else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def groups(column: pa.Array, characters: int = 1 << 20):
    """Runs of a text column's rows, as lists of strings of about so many characters in all, at least one row each."""
    held, size = [], 0
    for v in column:
        held.append(v.as_py() or "")
        size += len(held[-1])
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoder(path: str) -> Encoder:
    return worker_cache(("encoder", path), lambda: Encoder(path))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of each document, at most ``capacity`` ids long."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(path)
        for rb in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            encoded = chain.from_iterable(enc.encode_many(g) for g in groups(rb.column("text")))
            for doc, data in zip(rb.column("doc_id").to_pylist(), encoded, strict=True):
                data = data.tobytes() + END.to_bytes(4, "little")
                for k, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    for c, v in zip(cols, (doc, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select("doc_id", "text"), run, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item positions. Free spaces are kept as a bit set, so an item costs O(1)."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
            bins[at].append(i)
            left = free - size
        else:
            at, left = len(bins), capacity - size
            bins.append([i])
        if left:
            by_free.setdefault(left, []).append(at)
            mask |= 1 << left
    return bins


_BINS = "fill long, row_id long, members binary"


def _round(capacity: int):
    """One best-fit round over a partition: items are (fill, row_id, members), members pairs of (row id, offset) or null
    for a row alone. A bin is named by its first member's row id, which no other bin has."""

    def run(batches):
        lengths, members = [], []
        for rb in batches:
            lengths += rb.column("fill").to_pylist()
            single = np.zeros((rb.num_rows, 1, 2), dtype="<i8")
            single[:, 0, 0] = rb.column("row_id").to_numpy(zero_copy_only=False)
            members += [np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 2) if x.is_valid else one for x, one in zip(rb.column("members"), single, strict=True)]
        sizes = np.array(lengths, dtype=np.int64)
        fills, names, out = [], [], []
        for b in best_fit(sizes, capacity):
            at, parts = 0, []
            for i in b:
                parts.append(members[i] + np.array([0, at], dtype="<i8"))
                at += lengths[i]
            fills.append(at)
            names.append(int(parts[0][0, 0]))
            out.append(np.concatenate(parts).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(fills, pa.int64()), pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["fill", "row_id", "members"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, items_a_task: int = 8192, allowances: tuple[int, ...] = (4, 16, 64, 256)) -> DataFrame:
    """(row_id, sequence_id, offset) of items (row_id, length), each at most ``capacity`` long.

    A round packs each partition best-fit, keeps bins with at most its allowance free, and hands the rest up. Rounds go
    on while more than one partition is needed and the underfull bins get fewer; the last round keeps everything.
    """
    items = items.select(F.col("length").alias("fill"), "row_id", F.lit(None).cast("binary").alias("members"))
    todo = items.filter(F.col("fill") < capacity)
    count = todo.count()
    kept: list[DataFrame] = []
    for level, allowance in enumerate((*allowances, capacity)):
        parts = max(1, -(-count // items_a_task))
        done = materialize(arrow_map(todo.repartition(parts), _round(capacity), _BINS), f"pack-{level}")
        if parts == 1 or allowance == capacity:
            kept.append(done)
            break
        kept.append(done.filter(F.col("fill") >= capacity - allowance))
        todo = done.filter(F.col("fill") < capacity - allowance)
        count = todo.count()
        if not count:
            break
    bins = kept[0]
    for k in kept[1:]:
        bins = bins.unionByName(k)
    alone = items.filter(F.col("fill") >= capacity).select("row_id", F.col("row_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(arrow_map(bins, _place, "row_id long, sequence_id long, offset long"))


def _place(batches):
    for rb in batches:
        members = [np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, 2) for x in rb.column("members")]
        cat = np.concatenate([np.zeros((0, 2), dtype="<i8"), *members])
        names = np.repeat(rb.column("row_id").to_numpy(zero_copy_only=False), [len(m) for m in members])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (cat[:, 0], names, cat[:, 1])], names=["row_id", "sequence_id", "offset"])


def report(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """The digest columns of query op10."""
    rows = materialize(pieces(docs, vocabulary, capacity).withColumn("row_id", F.monotonically_increasing_id()), "pack-pieces")
    placed = pack(rows, capacity, **options)
    return rows.join(placed, "row_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
