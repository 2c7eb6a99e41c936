"""Substring dedup: repeated-phrase automata.

1. Each document's phrases are its minimizers: of the phrases of ``PHRASE`` words inside each window of ``WINDOW``
   words, the one with the smallest hash. Equal windows choose the same phrase, so a window that recurs in another
   document has a phrase that recurs there too. Spark confirms the phrases that two documents or more have.
2. Only windows around confirmed phrases can recur. Their 96-bit hashes tell, for each, the first document (the smallest
   doc_id) that has it and which blocks of documents have it in a later one. Those first documents spell the passage of the
   window out: ``CHUNK`` windows and the words they cover.
3. A shard is a block of documents with all passages that its documents may repeat. It compiles the passages' phrases
   into Aho-Corasick automata of bounded size (pyahocorasick) and streams its documents through them, which locates
   every occurrence of every passage that an earlier document has; the windows there are compared word by word. Words
   go by what the automata find and by nothing else: hashes only choose which passages a shard gets.

Documents with the same word sequence are handled once: every copy but that of the smallest doc_id loses all words (if
it has a window at all).

Defined results: null text has no words; documents of fewer than ``WINDOW`` words lose nothing; windows are judged on
the input; a text's windows that recur only within it stay; rows that share a doc_id count as one document for
"smaller doc_id"; rows without a doc_id count as one document that comes last; an empty table gives an empty table;
a very long text is one task's work, linear in its length; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, discard, materialize, release, row_key
from .textops import U64, cover, mix64, window_hashes, word_bounds, word_hashes

WINDOW = 13
PHRASE = 6
STRIDE = WINDOW - PHRASE + 1  # of the starts of phrases, any STRIDE of which in a row give each window one
CHUNK = 32  # windows of a passage that travel together
START_BITS = 27  # a window's code is its document's rank, then its start
BLOCK_WORDS = 250_000
AUTOMATON_WINDOWS = 50_000
LAST = (1 << 63) - 1  # stands for a missing doc_id
_EMPTY = hashlib.sha256(b"").hexdigest()


def split(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, word starts, word ends and word hashes of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    buf = np.frombuffer(data, dtype=np.uint8)
    s, e = word_bounds(buf)
    return data, s, e, word_hashes(buf, s, e)


def minimizers(phrases: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest hash (the first of equals) of each run of ``span`` phrases."""
    n = len(phrases) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.sort(np.unique(np.lib.stride_tricks.sliding_window_view(phrases, span).argmin(1) + np.arange(n)))
    return at


_SCANNED = "doc_id long, key binary, n_words long, kept_sha256 string, phrases array<long>"


def _scan(batches):
    for rb in batches:
        ns, shas, phrases = [], [], []
        for v in rb.column("text"):
            data, s, e, h = split(v.as_py())
            ns.append(len(s))
            shas.append(hashlib.sha256(b" ".join(data.split())).hexdigest())
            p = window_hashes(h, PHRASE)
            phrases.append(np.unique(p[minimizers(p, WINDOW - PHRASE + 1)]).astype(np.int64, casting="unsafe"))
        flat = pa.array(np.concatenate(phrases) if phrases else np.zeros(0, dtype=np.int64), pa.int64())
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in phrases])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("key"), pa.array(ns, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "key", "n_words", "kept_sha256", "phrases"])


def _around(at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows hold a phrase that starts at one of the positions ``at``."""
    near = np.bincount(np.maximum(0, at - (WINDOW - PHRASE)), minlength=n + 1) - np.bincount(np.minimum(n, at + 1), minlength=n + 1)
    return np.cumsum(near[:-1]) > 0


def hashes_at(h: np.ndarray, pos: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the windows that start at the positions ``pos``."""
    acc, m = np.zeros(len(pos), dtype=U64), U64(seed | 1)
    for j in range(WINDOW):
        acc = (acc ^ h[pos + j]) * m
        acc ^= acc >> U64(29)
    return mix64(acc)


_WINDOWS = "h long, h2 int, code long, block long"


def _windows(batches):
    """The windows (96-bit hash, code, block) of each document that hold a phrase confirmed for it."""
    for rb in batches:
        parts = [np.zeros((4, 0), dtype=np.int64)]
        for text, wanted, rank, block in zip(rb.column("text"), rb.column("wanted"), rb.column("rank").to_pylist(), rb.column("block").to_pylist(), strict=True):
            h = split(text.as_py())[3]
            n = len(h) - WINDOW + 1
            if n <= 0:
                continue
            sorted_ = np.sort(wanted.values.to_numpy(zero_copy_only=False).astype(U64, casting="unsafe"))
            phrases = window_hashes(h, PHRASE)
            at = np.flatnonzero(sorted_[np.minimum(np.searchsorted(sorted_, phrases), len(sorted_) - 1)] == phrases)
            pos = np.flatnonzero(_around(at, n))
            first, once = np.unique(hashes_at(h, pos, 0xA0761D6478BD642F), return_index=True)  # a text's own repeats count once
            pos = pos[once]
            second = hashes_at(h, pos, 0xE7037ED1A0B428DB) >> U64(32)
            parts.append(np.stack([first.astype(np.int64, casting="unsafe"), second.astype(np.int64), (rank << START_BITS) + pos, np.full(len(pos), block)]))
        h, h2, code, block = np.concatenate(parts, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(code), pa.array(block)], names=["h", "h2", "code", "block"])


def _spell(batches):
    """The words of the chunks asked for of each first document."""
    for rb in batches:
        codes, words = [], []
        for text, chunks, rank in zip(rb.column("text"), rb.column("chunks"), rb.column("rank").to_pylist(), strict=True):
            have = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            for c in chunks.as_py():
                codes.append((rank << START_BITS) + c)
                words.append(b" ".join(have[c : c + CHUNK + WINDOW - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(words, pa.binary())], names=["code", "words"])


def automata(passages: list[tuple[int, int, bytes]]):
    """(automaton, numbers of its words, first) over the windows of passages (rank, which windows, words), at most about
    ``AUTOMATON_WINDOWS`` each.

    Every window of a passage holds the phrase that starts at the passage's next multiple of ``STRIDE``; the automaton has
    these phrases, and ``first`` the whole windows, word by word, with the smallest rank that spells them.
    """
    at, passages = 0, sorted(passages, key=lambda p: p[0], reverse=True)
    while at < len(passages):
        numbers: dict[bytes, int] = {}
        first: dict[tuple[int, ...], int] = {}
        auto = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        while at < len(passages) and len(first) < AUTOMATON_WINDOWS:
            rank, which, words = passages[at]
            ids = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words.split()])
            phrases = set()
            for i in range(min(CHUNK, len(ids) - WINDOW + 1)):
                if which >> i & 1:
                    first[ids[i : i + WINDOW]] = rank
                    phrases.add(-(-i // STRIDE) * STRIDE)
            for i in phrases:
                auto.add_word(ids[i : i + PHRASE])
            at += 1
        if first:
            auto.make_automaton()
            yield auto, numbers, first


def locate(passages: list[tuple[int, int, bytes]], docs: list[tuple[int, list[bytes]]]) -> list[np.ndarray]:
    """Start positions of the windows of each document (rank, words) that a passage of a smaller rank spells: the
    automata find the passages' phrases, and the windows around them are compared word by word."""
    found: list[set[int]] = [set() for _ in docs]
    for auto, numbers, first in automata(passages):
        number, spelled = numbers.get, first.get
        for where, (rank, words) in zip(found, docs, strict=True):
            ids = tuple([number(w, 0) for w in words])
            for end, _ in auto.iter(ids):
                for a in range(max(0, end - WINDOW + 1), end - PHRASE + 2):
                    if spelled(ids[a : a + WINDOW], rank) < rank:
                        where.add(a)
    return [np.array(sorted(w), dtype=np.int64) for w in found]


_CUT = "key binary, n_removed long, kept_sha256 string, kept_text string"


def _stream(with_text: bool):
    """Blocks in turn, each first its passages (no key) and then its documents."""

    def finish(passages, docs):
        ns, shas, texts = [], [], []
        for (_, words), starts in zip([d[1:] for d in docs], locate(passages, [d[1:] for d in docs]), strict=True):
            gone = cover(len(words), starts, WINDOW)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            ns.append(int(gone.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.binary()), pa.array(ns, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["key", "n_removed", "kept_sha256", "kept_text"])

    def run(batches):
        now, passages, docs = None, [], []
        for rb in batches:
            for block, key, rank, which, words in zip(*(rb.column(c).to_pylist() for c in ("block", "key", "rank", "which")), rb.column("words"), strict=True):
                if block != now:
                    if docs:
                        yield finish(passages, docs)
                    now, passages, docs = block, [], []
                if key is None:
                    passages.append((rank, which, words.as_py()))
                elif passages:  # a block that no passage is for loses nothing
                    docs.append((key, rank, words.as_py().split()))
        if docs:
            yield finish(passages, docs)

    return run


def ranked(ids: DataFrame) -> DataFrame:
    """(doc, rank): ranks from 0 of distinct ids, within range partitions and by the counts of those before."""
    dealt = materialize(ids.repartitionByRange("doc").withColumn("p", F.spark_partition_id()), "sub-ids")
    counts = dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("p").orderBy("doc"))
    return dealt.withColumn("i", inside).join(before, "p").select("doc", (F.col("before") + F.col("i") - 1).alias("rank"))


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and tells in ``n`` how many rows have it.

    Keys of a ten-thousandth of all rows or more, of which there are ten thousand at most, are broadcast, so a hot key is
    not one task's work. All others meet in a hash join whose tables hold about half a million keys each.
    """
    keys, total = keyed.agg(F.count(F.lit(1)), F.sum("n")).first()
    limit = max(10_000, (total or 0) // 10_000)
    hot, rest = keyed.filter(F.col("n") > limit), keyed.filter(F.col("n") <= limit)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys // 500_000)
    cold, rest = rows, rest.repartition(parts, *on)
    if hot.isEmpty():
        return cold.repartition(parts, *on).join(rest.hint("shuffle_hash"), on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").repartition(parts, *on).join(rest.hint("shuffle_hash"), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def dedup(docs: DataFrame, with_text: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_sha256, kept_text) of every row; kept_text only on demand and only where
    words go."""
    spark = docs.sparkSession
    scanned = materialize(arrow_map(docs.select("doc_id", "text", row_key().alias("key")), _scan, _SCANNED), "sub-scan")
    rows = materialize(scanned.drop("phrases"), "sub-rows")
    order = F.coalesce("doc_id", F.lit(LAST))
    # one row stands for each word sequence: that of the smallest doc_id
    sequences = rows.filter(F.col("n_words") >= WINDOW).groupBy("kept_sha256").agg(F.min(F.struct(order.alias("doc"), "key")).alias("r"), F.max("n_words").alias("n")).select("kept_sha256", F.col("r.doc").alias("doc"), F.col("r.key").alias("first_key"), "n")
    sequences = materialize(sequences, "sub-sequences")
    n_words = sequences.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, n_words // block_words)
    heads = sequences.select("doc", F.col("first_key").alias("key")).join(ranked(sequences.select("doc").distinct()), "doc").select("key", "rank").dropDuplicates(["key"])
    heads = materialize(scanned.select("key", "phrases").join(heads.hint("merge"), "key").dropDuplicates(["key"]), "sub-heads")
    discard(scanned)
    phrases = heads.select("rank", F.explode("phrases").alias("phrase"))
    recurring = phrases.groupBy("phrase").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("phrase", "n")
    recurring = materialize(recurring, "sub-recurring")
    release(spark)
    confirmed = join_counted(phrases, recurring, ["phrase"]).groupBy("rank").agg(F.collect_list("phrase").alias("wanted"))
    confirmed = materialize(heads.select("key", "rank").join(confirmed, "rank"), "sub-confirmed")
    discard(heads, recurring)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    texts = docs.select(row_key().alias("key"), "text").join(confirmed.hint("merge"), "key").select("key", "rank", block, "text", "wanted")
    texts = materialize(texts, "sub-texts")
    discard(confirmed)
    windows = materialize(arrow_map(texts.select("rank", "block", "text", "wanted"), _windows, _WINDOWS), "sub-windows")
    rank_of = lambda c: F.shiftright(c, START_BITS)
    start_of = lambda c: F.col(c).bitwiseAND(F.lit((1 << START_BITS) - 1))
    firsts = windows.groupBy("h", "h2").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count(F.lit(1)).alias("n")).filter(rank_of("low") < rank_of("high"))
    firsts = materialize(firsts.select("h", "h2", "low", "n"), "sub-firsts")
    release(spark)
    # which windows of which passages a block asks for, and the documents that repeat any
    needs = join_counted(windows, firsts, ["h", "h2"]).filter(rank_of("code") > rank_of("low"))
    offset = F.pmod(start_of("low"), F.lit(CHUNK))
    needs = needs.groupBy("block", rank_of("code").alias("rank"), (F.col("low") - offset).alias("code")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(low % {CHUNK} as int))")).alias("which"))
    needs = materialize(needs, "sub-needs")
    discard(windows, firsts)
    routes = materialize(needs.groupBy("block", "code").agg(F.bit_or("which").alias("which")), "sub-routes")
    asked = routes.select("code").distinct().groupBy(rank_of("code").alias("rank")).agg(F.collect_list(start_of("code")).alias("chunks"))
    passages = materialize(arrow_map(texts.select("rank", "text").join(asked.hint("merge"), "rank"), _spell, "code long, words binary"), "sub-passages")
    release(spark)
    sent = routes.hint("merge").join(passages, "code").select("block", F.lit(None).cast("binary").alias("key"), rank_of("code").alias("rank"), "which", "words")
    repeating = texts.join(needs.select("rank").distinct().hint("merge"), "rank", "left_semi")
    dealt = sent.unionByName(repeating.select("block", "key", "rank", F.lit(None).cast("long").alias("which"), F.col("text").cast("binary").alias("words")))
    parts = max(min(blocks, 200), blocks // 40)
    cut = arrow_map(dealt.repartition(parts, "block").sortWithinPartitions("block", F.col("key").isNotNull()), _stream(with_text), _CUT)
    cut = materialize(cut.dropDuplicates(["key"]), "sub-cut")
    discard(texts, needs, routes, passages)
    # copies: everything goes if a smaller doc_id has the same words; else what goes from the row that stands for them
    every = rows.join(sequences.select("kept_sha256", F.col("doc").alias("first_doc"), "first_key"), "kept_sha256", "left")
    cut = cut.select(F.col("key").alias("first_key"), "n_removed", F.col("kept_sha256").alias("cut_sha256"), "kept_text")
    copy = order > F.col("first_doc")
    return every.join(cut, "first_key", "left").select(
        "doc_id", "key", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op7."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
