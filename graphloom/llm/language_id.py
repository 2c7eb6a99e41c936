"""Language identification: unigram piece models with the segmentation marginalised.

Each language has probabilities over the pieces of a fixed public vocabulary (a parameter; never trained). A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm, vectorised over the distinct
words of a batch; a text's is the product over its words, and the score is the posterior under equal priors.

Words are runs of letters, lower-cased; pieces never cross a word, and a word of any length is summed over as a whole.
Piece counts come from a bounded sample of labelled documents (``sample_docs`` of at most ``sample_chars`` characters); the
model holds the counted pieces of each language, so its size has the sample's bound, and languages are scored in blocks.

Defined results: null text and text without a letter give ``und`` with score 0; without labelled rows everything is
``und``; ties go to the language first by code point; equal rows give equal rows; an empty table gives an empty table;
a very long text is one task's work, linear in its length; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, worker_cache
from .textops import U64, mix64

WORDS = re.compile(r"[^\W\d_]+")
MARK = "▁"
SHORT = 32  # words up to here run together; longer ones one by one, rescaled on the way
LANGUAGES = 64  # scored at once
UNKNOWN = 1e-8
UNDETERMINED = "und"
_BASE = 0x9E3779B97F4A7C15
_P = np.cumprod(np.array([1] + [_BASE] * 64, dtype=U64))
_Q = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * 64, dtype=U64))


class Pieces:
    """The vocabulary as a vectorised set of string hashes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        usable = [(i, p) for i, p in enumerate(names) if not self.model.is_control(i) and not self.model.is_unknown(i) and not self.model.is_byte(i) and (p == MARK or WORDS.fullmatch(p.removeprefix(MARK)))]  # others are in no word
        self.size = len(names)
        self.longest = max(len(p) for _, p in usable)
        keys = np.array([string_hash(p) for _, p in usable], dtype=U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _ in usable])[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.keys >> U64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, piece ids) of the hashes that are pieces."""
        pos = np.flatnonzero(self.maybe[h >> U64(44)])
        at = np.searchsorted(self.keys, h[pos])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h[pos]
        return pos[hit], self.ids[at[hit]]


def string_hash(s: str) -> int:
    x = np.array([ord(c) for c in s], dtype=U64)
    return int(mix64(np.array([((x + U64(1)) * _P[: len(x)]).sum() + U64(len(x))], dtype=U64))[0])


def forward(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language: [words, languages].

    probs: [pieces, languages]. Words of equal length run together.
    """
    out = np.zeros((len(words), probs.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for length, rows in by_length.items():
        if length > SHORT:
            for i in rows:
                out[i] = forward_long(words[i], pieces, probs)
            continue
        for a in range(0, len(rows), 8192):
            part = rows[a : a + 8192]
            n, L = len(part), length + 1
            chars = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, L).astype(U64)
            g = np.zeros((n, L + 1), dtype=U64)
            np.cumsum((chars + U64(1)) * _P[:L], axis=1, out=g[:, 1:])
            alpha = np.zeros((L + 1, n, probs.shape[1]))
            alpha[0] = 1.0
            for i in range(1, L + 1):
                alpha[i] = alpha[i - 1] * UNKNOWN
                for size in range(1, min(i, pieces.longest) + 1):
                    h = mix64((g[:, i] - g[:, i - size]) * _Q[i - size] + U64(size))
                    pos, ids = pieces.find(h)
                    if len(pos):
                        alpha[i][pos] += alpha[i - size][pos] * probs[ids]
            out[part] = np.log(alpha[L])
    return out


def forward_long(word: str, pieces: Pieces, probs: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Log probability of one word under each language, in memory that does not grow with the word."""
    chars = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64) + U64(1)
    n, ring, scale = len(chars), np.zeros((pieces.longest + 1, probs.shape[1])), np.zeros(probs.shape[1])
    ring[0] = 1.0
    for a in range(0, n, block):
        b = min(n, a + block)
        low = max(0, a - pieces.longest)
        part = chars[low:b]
        rolling, sizes, stops, ids = np.zeros(len(part), dtype=U64), [], [], []
        for size in range(1, min(pieces.longest, len(part)) + 1):
            rolling = rolling[: len(part) - size + 1] + part[size - 1 :] * _P[size - 1]
            pos, found = pieces.find(mix64(rolling + U64(size)))
            stop = low + pos + size
            new = stop > a
            sizes.append(np.full(int(new.sum()), size))
            stops.append(stop[new])
            ids.append(found[new])
        stop, size, piece = np.concatenate(stops), np.concatenate(sizes), np.concatenate(ids)
        order = np.argsort(stop, kind="stable")
        stop, size, piece = stop[order], size[order], piece[order]
        cuts = np.searchsorted(stop, np.arange(a + 1, b + 2)).tolist()
        for i in range(a + 1, b + 1):
            x = ring[(i - 1) % len(ring)] * UNKNOWN
            c, d = cuts[i - a - 1], cuts[i - a]
            if d > c:
                x = x + (ring[(i - size[c:d]) % len(ring)] * probs[piece[c:d]]).sum(0)
            ring[i % len(ring)] = x
            if i % 16 == 0:
                ring /= x
                scale += np.log(x)
    return scale + np.log(ring[n % len(ring)])


def words_of(text: str | None) -> list[str]:
    found = WORDS.findall(text.lower()) if text else []
    if found and not any(c.isalpha() for c in found[0]):
        found = [w for w in found if any(c.isalpha() for c in w)]
    return found


def dense(columns: list[tuple[np.ndarray, np.ndarray, float]], size: int) -> np.ndarray:
    """[pieces, languages] probabilities from (piece ids, probabilities, probability of any other piece) a language."""
    out = np.empty((size, len(columns)))
    for k, (ids, values, rest) in enumerate(columns):
        out[:, k] = rest
        out[ids, k] = values
    return out


class Scorer:
    """Language posteriors of texts; keeps the scores of words it has met, up to ``limit`` numbers."""

    def __init__(self, path: str, languages: list[str], columns: list, limit: int = 1_000_000):
        self.pieces, self.languages, self.columns = Pieces(path), languages, columns
        self.limit = max(1000, min(120_000, limit // max(1, len(languages))))
        self.block = dense(columns, self.pieces.size) if len(languages) <= LANGUAGES else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 10, len(self.languages)))

    def learn(self, words: set[str]) -> None:
        fresh = sorted(words)
        n = len(self.known)
        while n + len(fresh) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.block is not None:
            self.table[n : n + len(fresh)] = forward(fresh, self.pieces, self.block)
        for a in range(0, len(self.languages) if self.block is None else 0, LANGUAGES):
            self.table[n : n + len(fresh), a : a + LANGUAGES] = forward(fresh, self.pieces, dense(self.columns[a : a + LANGUAGES], self.pieces.size))
        self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        """Log probability of the words, a stretch at a time."""
        out = np.zeros(len(self.languages))
        for a in range(0, len(words), self.limit):
            part = words[a : a + self.limit]
            fresh = set(part).difference(self.known)
            if fresh and len(self.known) + len(fresh) > 2 * self.limit:
                self.forget()
                fresh = set(part)
            if fresh:
                self.learn(fresh)
            out += self.table[[self.known[w] for w in part]].sum(0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for a in range(0, len(texts), 128):
            lists = [words_of(t) for t in texts[a : a + 128]]
            if not self.languages:
                out += [(UNDETERMINED, 0.0)] * len(lists)
                continue
            if len(self.known) > self.limit:
                self.forget()
            fresh = {w for ws in lists for w in ws if w not in self.known}
            whole = len(fresh) <= self.limit
            if fresh and whole:
                self.learn(fresh)  # many words at once are cheaper
            for ws in lists:
                if not ws:
                    out.append((UNDETERMINED, 0.0))
                    continue
                total = self.table[[self.known[w] for w in ws]].sum(0) if whole and len(ws) <= self.limit else self.total(ws)
                best = int(np.argmax(total))
                out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def is_held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = 4000, sample_chars: int = 1_000_000, smoothing: float = 0.5) -> tuple[list[str], list]:
    """(languages, columns of ``dense``) from at most ``sample_docs`` labelled documents, chosen by a hash of doc_id among
    those that are not held out (of rows with one doc_id the first by a hash); counting runs on the executors."""
    path = vocabulary or default_vocabulary()
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars)).select("doc_id", "lang", "text")
    chosen = labelled.filter(~F.coalesce(is_held_out(), F.lit(False))).select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = labelled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("r")).select("r.lang", "r.text")

    def count(batches):
        pieces = worker_cache(("pieces", path), lambda: Pieces(path))
        totals: dict[str, np.ndarray] = {}
        for rb in batches:
            for lang, text in zip(rb.column("lang"), rb.column("text"), strict=True):
                ids = pieces.model.encode(" ".join(words_of(text.as_py())))
                totals.setdefault(lang.as_py(), np.zeros(pieces.size, dtype=np.int64))
                totals[lang.as_py()] += np.bincount(ids, minlength=pieces.size)
        langs, ids, ns = [], [], []
        for lang, c in totals.items():
            at = np.flatnonzero(c)
            langs += [lang] * len(at)
            ids.append(at)
            ns.append(c[at])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(ids) if ids else [], pa.int32()), pa.array(np.concatenate(ns) if ns else [], pa.int64())], names=["lang", "piece", "n"])

    rows = arrow_map(sample, count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    size, found = Pieces(path).size, {}
    for r in rows:
        ids, ns = found.setdefault(r.lang, ([], []))
        ids.append(r.piece)
        ns.append(r.n)
    columns = []
    for lang in sorted(found):
        ids, ns = (np.array(x, dtype=np.int64) for x in found[lang])
        order, whole = np.argsort(ids), ns.sum() + smoothing * size
        columns.append((ids[order], (ns[order] + smoothing) / whole, smoothing / whole))
    return sorted(found), columns


def identify(docs: DataFrame, languages: list[str], columns: list, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) of each row with lang_pred and score."""
    path, spark = vocabulary or default_vocabulary(), docs.sparkSession
    model = spark.sparkContext.broadcast((languages, columns))  # pieces counted in a bounded sample
    keep = keep or ["doc_id"]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        key = ("scorer", path, *model.value[0], *(zlib.crc32(v) for _, v, _ in model.value[1]))
        scorer = worker_cache(key, lambda: Scorer(path, *model.value))
        for rb in batches:
            found = []
            for a in range(0, rb.num_rows, 128):  # a few texts at a time become Python strings
                found += scorer.predict(rb.column("text").slice(a, 128).to_pylist())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    need = list(dict.fromkeys([*keep, "text"]))
    return arrow_map(docs.select(*need), run, f"{types}, lang_pred string, score double")


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of query op6."""
    out = identify(docs, *train(docs, **options))
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def filter_identified(docs: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """Drop documents without a determinable language or with a posterior below ``min_score``; columns stay."""
    languages, columns = train(docs, **options)
    judged = identify(docs, languages, columns, keep=docs.columns)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select(*docs.columns)
