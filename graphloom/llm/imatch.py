"""Document fingerprints: I-Match with randomised lexicons, in DataFrame functions only.

Terms are lower-cased runs of letters and digits, kept as 64-bit hashes. The lexicon holds the terms whose document
frequency lies in a band (so their inverse document frequency does); the band bounds its size. A text's fingerprint hashes
its sorted distinct lexicon terms, once for the whole lexicon and once for each random sub-lexicon: up to ``subsets``
that each keep one in 4,096, in 512, in 64 and in 16 of the terms. Likeness is the share of equal hashes over the
sub-lexicons that aren't empty for both texts, the sparsest first.

Defined results: null text is empty text; a text without lexicon terms is fingerprinted by its whole content, so
equal texts always have equal fingerprints; documents that share a doc_id are ordered by a hash of the text; rows
without a doc_id come last, in the order of that hash; an empty table gives an empty table; a single document is its own successor; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

#: Sub-lexicons of a level keep one in so many terms, picked by bits of the term's hash; sparsest first.
PARTS = (4096, 512, 64, 16)
SEPARATORS = r"[^\p{L}\p{N}]+"


def term_hashes(text):
    """Distinct 64-bit term hashes of a text."""
    words = F.array_distinct(F.split(F.lower(text), SEPARATORS))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = 0.002, high: float = 0.1, min_docs: int = 2, slots: int = 1 << 16) -> DataFrame:
    """One row, one column ``lex``: an array with the lexicon's term hashes of each slot, null where it has none.

    Document frequencies are counted over all rows. Every term of the band is kept: slots only speed up the lookup, and
    the band itself bounds the lexicon, as at most (terms a document) / ``low`` terms reach it.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    n_docs = n.scalar()
    kept = df.filter((F.col("df") >= F.greatest(F.lit(min_docs), F.ceil(n_docs * low))) & (F.col("df") <= F.greatest(F.lit(min_docs), n_docs * high)))
    per_slot = kept.groupBy(F.pmod("h", F.lit(slots)).alias("slot")).agg(F.array_sort(F.collect_list("h")).alias("h"))
    every = docs.sparkSession.range(slots).withColumnRenamed("id", "slot")
    dense = every.join(per_slot, "slot", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "h"))), lambda x: x["h"]).alias("lex"))


# lambdas given to Spark may not have parameters with defaults, as Spark fills a second one with the element's index
def _part(h, shift: int, parts: int):
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(parts - 1).cast("long"))


def _below(shift: int, parts: int, n: int):
    return lambda h: _part(h, shift, parts) < n


def _mark(level: str, shift: int, parts: int):
    """Sub-lexicon number -> its hash as 8 hex digits, nothing if no term of the text is in it."""

    def mark(k):
        found = F.filter(level, lambda h: _part(h, shift, parts) == k)
        return F.when(F.exists(level, lambda h: _part(h, shift, parts) == k), F.right(F.lpad(F.lower(F.hex(F.xxhash64(found))), 16, "0"), F.lit(8))).otherwise(F.lit(""))

    return mark


def fingerprint_columns(df: DataFrame, text: str, lex, slots: int, subsets: int, out: str) -> DataFrame:
    """Add ``out``: the hash of the whole lexicon's terms (16 hex digits), then of each sub-lexicon's (8, nothing if it has none), joined by '-'."""
    # a subquery may not stand inside a lambda; as a column used once it is folded into it and never becomes row data
    in_lexicon = lambda h: F.coalesce(F.array_contains(F.get("__lex", F.pmod(h, F.lit(slots)).cast("int")), h), F.lit(False))
    df = df.withColumn("__lex", lex).withColumn("__terms", F.array_sort(F.filter(term_hashes(F.coalesce(F.col(text), F.lit(""))), in_lexicon))).drop("__lex")
    hexed = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    whole = F.xxhash64(F.lit("text"), F.coalesce(F.col(text), F.lit("")))
    hashes, shift = [F.array(hexed(F.when(F.size("__terms") == 0, whole).otherwise(F.xxhash64(F.lit("all"), F.col("__terms")))))], 0
    for parts in PARTS:
        n, level = min(subsets, parts), f"__level{parts}"
        df = df.withColumn(level, F.filter("__terms", _below(shift, parts, n)))
        hashes.append(F.transform(F.array(*(F.lit(k).cast("long") for k in range(n))), _mark(level, shift, parts)))
        shift += parts.bit_length() - 1
    return df.withColumn(out, F.array_join(F.concat(*hashes), "-")).drop("__terms", *(f"__level{parts}" for parts in PARTS))


def likeness(a, b, subsets: int, enough: int = 16):
    """Share of equal hashes of two fingerprints over the sub-lexicons that are not empty for both, 0 to 1.

    The sparsest sub-lexicons are used first, denser ones only until ``enough`` are not empty for both, so long and short
    texts are compared with a few terms a sub-lexicon; if all are empty for both, the whole lexicon's hash decides.
    """
    pairs = F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b"))
    seen = lambda n: F.filter(F.slice(pairs, 2, n), lambda p: (p["a"] != "") | (p["b"] != ""))
    share = lambda n: F.size(F.filter(seen(n), lambda p: p["a"] == p["b"])) / F.size(seen(n))
    ends = [sum(min(subsets, p) for p in PARTS[: i + 1]) for i in range(len(PARTS))]
    out = F.when(F.size(seen(ends[0])) >= enough, share(ends[0]))
    for n in ends[1:-1]:
        out = out.when(F.size(seen(n)) >= enough, share(n))
    whole = F.when(F.substring_index(a, "-", 1) == F.substring_index(b, "-", 1), 1.0).otherwise(0.0)
    return out.when(F.size(seen(ends[-1])) > 0, share(ends[-1])).otherwise(whole)


def _rank(bounds, width: int, x):
    """Number of bounds up to ``x``; ``bounds`` are sorted, in rows of ``width``, so it takes two short scans."""
    row = F.size(F.filter(bounds, lambda r: F.get(r, 0) <= x))
    inner = F.size(F.filter(F.get(bounds, row - 1), lambda b: b <= x))
    return F.when(row == 0, 0).otherwise((row - 1) * width + inner)


def with_next(df: DataFrame, columns: list[str], prepare=lambda df: df, rows_a_bucket: int = 2000, max_buckets: int = 100_000) -> DataFrame:
    """``prepare(df)`` with ``next_<c>``: the columns of the next row by ascending (doc_id, hash of text); the last row
    gets the first's.

    Rows are dealt by ranges of doc_id, those without one by ranges of the hash; at 100 TB a range of a hundred thousand is
    a gigabyte. The first row of each range is also sent to the range before it, so no range needs another and nothing
    runs over all rows in one task. What is broadcast or held as a value is a few numbers a range.
    """
    n, n_null = df.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    buckets, extra = (min(max_buckets, max(1, k // rows_a_bucket)) for k in (n - n_null, n_null))
    ids = df.filter("doc_id IS NOT NULL").select("doc_id").repartitionByRange(buckets, "doc_id")
    lows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    width = max(1, int(buckets**0.5))
    order = Window.orderBy("low")  # one row a range
    rows = lows.withColumn("i", F.row_number().over(order) - 1).groupBy(F.floor(F.col("i") / width).alias("g")).agg(F.array_sort(F.collect_list("low")).alias("r"))
    table = materialize(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("b")), "imatch-bounds")
    # the table is a column first, as a subquery may not stand inside a lambda
    hashed = df.withColumn("__hash", F.xxhash64("text")).withColumn("__bounds", table.scalar())
    by_hash = F.least(F.lit(extra - 1), F.floor((F.col("__hash") / 2.0**64 + 0.5) * extra)) + buckets + 1
    dealt = hashed.withColumn("__bucket", F.when(F.col("doc_id").isNull(), by_hash).otherwise(_rank(F.col("__bounds"), width, F.col("doc_id"))).cast("long")).drop("__bounds")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__hash"))
    firsts = dealt.groupBy("__bucket").agg(F.min(place).alias("f"))
    around = Window.orderBy("__bucket")  # one row a range
    before = F.coalesce(F.lag("__bucket").over(around), F.max("__bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("f.doc_id").alias("f_id"), F.col("f.__hash").alias("f_hash"), F.col("__bucket").alias("f_bucket"), before.alias("f_before"))
    same = (F.col("__bucket") == F.col("f_bucket")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("__hash") == F.col("f_hash"))
    ghosts = dealt.join(F.broadcast(firsts), same).groupBy(F.col("f_before").alias("__bucket")).agg(F.first(F.struct(*df.columns, "__hash")).alias("r")).select("r.*", "__bucket")
    both = prepare(dealt.withColumn("__ghost", F.lit(0)).unionByName(ghosts.withColumn("__ghost", F.lit(1))))
    w = Window.partitionBy("__bucket").orderBy("__ghost", F.col("doc_id").asc_nulls_last(), "__hash")
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("__ghost = 0").drop("__ghost", "__bucket", "__hash")


def report(docs: DataFrame, slots: int = 1 << 16, subsets: int = 64) -> DataFrame:
    """The digest columns of query op3."""
    docs = docs.select("doc_id", "text")
    table = materialize(lexicon(docs, slots=slots), "imatch-lexicon")
    lex = table.scalar()
    mark = lambda df, text, out: fingerprint_columns(df, text, lex, slots, subsets, out)
    both = with_next(docs, ["text", "fingerprint"], lambda df: mark(df, "text", "fingerprint"))
    text, after = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half)).alias("edited"), "fingerprint", "next_fingerprint")
    both = mark(both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_fingerprint")
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), subsets).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), subsets).alias("near_next"))
