"""Text and vector search over nodes: inverted index, phrase match with BM25, keywords, rank fusion, boosts, cosine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.porter import stem_all
from ..functions.scalars import cosine, sanitize_name, split_identifier, text_hash

INDEXED = ("name", "qualified_name", "file_path", "signature")
K1, B = 1.2, 0.75  # the customary constants of BM25; columns weigh the same
RRF_K = 60.0
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
#: Identifiers inside a question, dotted, snake_case and PascalCase.
IDENTIFIERS = (r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b")


def tokens(text):
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: w != "")


def build_index(docs: DataFrame, key: str, columns: tuple[str, ...], stem: bool = False) -> DataFrame:
    """The inverted index: (key, col, pos, term), one row an occurrence. Built anew from the table, so never stale."""
    cols = [c for c in columns if c in docs.columns]
    stacked = docs.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in cols))).alias("x")).select(key, "x.col", tokens(F.col("x.text")).alias("words"))
    if stem:
        stacked = stacked.withColumn("words", stem_all("words"))
    return stacked.select(key, "col", F.posexplode("words").alias("pos", "term"))


def rebuild_fts(nodes: DataFrame, stem: bool = True) -> DataFrame:
    return build_index(nodes, "id", INDEXED, stem)


def query_terms(query: str, stem: bool) -> list[str]:
    from ..functions.porter import stem as stem_one

    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return [stem_one(w) for w in words] if stem else words


def fts_search(docs: DataFrame, query: str, limit: int = 20, key: str = "id", columns: tuple[str, ...] = INDEXED, stem: bool = True, index: DataFrame | None = None) -> DataFrame:
    """(key, score): rows that hold the whole query as a phrase in one column, by BM25 of the phrase.

    The phrase counts as one term: its frequency is the number of places where it starts, a row's length is its number
    of tokens. Only the query's terms are read from the index to find phrases.
    """
    words = query_terms(query, stem)
    idx = index if index is not None else build_index(docs, key, columns, stem)
    lengths = idx.groupBy(key).agg(F.count(F.lit(1)).alias("len"))
    totals = lengths.agg(F.avg("len").alias("avg_len"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    if not words:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*(F.struct(F.lit(w).alias("term"), F.lit(i).alias("i")) for i, w in enumerate(words)))
    hits = idx.filter(F.col("term").isin(words)).withColumn("q", F.explode(F.filter(wanted, lambda q: q["term"] == F.col("term"))))
    starts = hits.groupBy(key, "col", (F.col("pos") - F.col("q.i")).alias("at")).agg(F.count_distinct("q.i").alias("n")).filter(F.col("n") == len(words))
    tf = starts.groupBy(key).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.agg(F.count(F.lit(1)).alias("df"))
    one = F.broadcast(totals.crossJoin(n_docs).crossJoin(df))  # a single row
    scored = tf.join(lengths, key).crossJoin(one)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)


def keyword_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score): every word in name or qualified name; the limit (in id order) comes before the scores 3, 2 or 1."""
    words = query.lower().split()
    found = nodes
    for w in words:
        pattern = "%" + w.replace("\\", "\\\\") + "%"
        found = found.filter(F.lower("name").like(pattern) | F.lower("qualified_name").like(pattern))
    if not words:
        found = found.limit(0)
    q = query.lower()
    score = F.when(F.lower("name") == q, 3.0).when(F.lower("name").startswith(q), 2.0).otherwise(1.0)
    return found.orderBy("id").limit(limit).select("id", score.alias("score")).orderBy(F.desc("score"), "id")


def rrf_merge(*lists: DataFrame, k: float = RRF_K) -> DataFrame:
    """(id, score): sum of 1 / (k + rank + 1) over ranked lists (id, score), ranks from 0."""
    ranked = [df.select("id", (1.0 / (F.lit(k) + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("s")) for df in lists]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id")


def query_identifiers(query):
    """Identifiers in a question column, lower-cased, each once, three bytes or longer."""
    found = F.flatten(F.array(*(F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in IDENTIFIERS)))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.lower(x))), lambda x: F.octet_length(x) >= 3)


def query_kind_boost(query: str) -> dict:
    """Boosts that a question asks for by its shape."""
    q, out = query.strip(), {}
    if re.match(r"[A-Z][a-z]", q):
        out |= {"Class": 1.5, "Type": 1.5}
    if "_" in q and any(c.isalpha() for c in q):
        out["Function"] = 1.5
    if "." in q:
        out["_qualified"] = 2.0
    idents: list[str] = []
    for p in IDENTIFIERS:
        for m in re.finditer(p, q):
            x = m[0].lower()
            if len(x.encode()) >= 3 and x not in idents:
                idents.append(x)
    if idents:
        out["_qualified_identifiers"] = idents
    return out


def hybrid_search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20, context_files: list[str] | None = None, stem: bool = True) -> DataFrame:
    """Ranked phrase matches (keyword matches where there are none), boosted by the question's shape and context files.

    The kind filter comes after the boosts and works on the candidates that the limit left.
    """
    q = query.strip()
    shown = ["name", "qualified_name", "kind", "file_path", "line_start", "line_end", "language", "params", "return_type", "signature", "score"]
    have = nodes.select(*nodes.columns, *(F.lit(None).cast("string").alias(c) for c in ("params", "return_type") if c not in nodes.columns))
    fetch = limit * 3
    ranked = fts_search(nodes, q, fetch, stem=stem) if q else nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    phrase = rrf_merge(ranked)
    words = keyword_search(nodes, q, fetch)
    merged = phrase.unionByName(words.join(F.broadcast(phrase.agg(F.count(F.lit(1)).alias("n"))), F.col("n") == 0).select("id", "score"))
    boosts = query_kind_boost(q)
    factor = F.lit(1.0)
    for k in ("Class", "Type", "Function"):
        if k in boosts:
            factor = factor * F.when(F.col("kind") == k, boosts[k]).otherwise(1.0)
    lower = F.lower("qualified_name")
    if "_qualified" in boosts:
        factor = factor * F.when(lower.contains(q.lower()), 2.0).otherwise(1.0)
    if "_qualified_identifiers" in boosts:
        any_of = F.lit(False)
        for x in boosts["_qualified_identifiers"]:
            any_of = any_of | lower.contains(x)
        factor = factor * F.when(any_of, 2.0).otherwise(1.0)
    if context_files:
        factor = factor * F.when(F.col("file_path").isin(context_files), 1.5).otherwise(1.0)
    out = merged.join(have, "id").withColumn("final", F.col("score") * factor)
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    out = out.orderBy(F.desc("final"), "id").limit(limit)
    rounded = F.round(F.col("final") * 1_000_000) / 1_000_000
    return out.select("id", sanitize_name("name").alias("name"), sanitize_name("qualified_name").alias("qualified_name"), "kind", "file_path", "line_start", "line_end", "language", "params", "return_type", F.lit(None).cast("string").alias("signature"), rounded.alias("score")).select("id", *shown)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10, key: str = "qualified_name", vector: str = "vector", provider: str | None = None) -> DataFrame:
    """(key, similarity): the nearest stored vectors by cosine; the query is a literal, so nothing is joined."""
    v = vectors.filter(F.col("provider") == provider) if provider else vectors
    q = F.array(*(F.lit(float(x)) for x in query))
    return v.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(limit)


def get_vector(vectors: DataFrame, qualified_name: str) -> DataFrame:
    return vectors.filter(F.col("qualified_name") == qualified_name).select("vector")


def vector_count(vectors: DataFrame, provider: str | None = None) -> DataFrame:
    v = vectors.filter(F.col("provider") == provider) if provider else vectors
    return v.agg(F.count(F.lit(1)).alias("n"))


def minimal_context(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The few columns that a reader needs to go on, in the order of the phrase rank; names are cleaned."""
    hits = fts_search(nodes, query, limit).select("id", "score")
    found = nodes.join(hits, "id").orderBy(F.desc("score"), "id")
    return found.select(sanitize_name("name").alias("name"), sanitize_name("qualified_name").alias("qualified_name"), "kind", "file_path", "line_start")


def node_to_text():
    """What is embedded of a node: dotted and bare name, its words, kind, parent, signature, directory, language."""
    name, parent = F.col("name"), F.col("parent_name")
    split_n, split_p = split_identifier("name"), split_identifier("parent_name")
    directory = F.try_element_at(F.split("file_path", "/"), F.lit(-2))
    return F.concat_ws(
        " ",
        F.when(parent.isNotNull() & (F.col("kind") != "File"), F.concat(parent, F.lit("."), name)),
        name,
        F.when((split_n != "") & (F.lower(split_n) != F.lower(name)), split_n),
        F.when(F.col("kind") != "File", F.lower("kind")),
        F.when(parent.isNotNull(), F.concat(F.lit("in "), parent)),
        F.when((split_p != "") & (F.lower(split_p) != F.lower(parent)), split_p),
        F.when(F.col("params") != "", F.col("params")),
        F.when(F.col("return_type") != "", F.concat(F.lit("returns "), F.col("return_type"))),
        F.when(~directory.isin("", ".", "src", "lib"), directory),
        F.when(F.col("language") != "", F.col("language")),
    )


def hashing_encoder(text, dimensions: int = 64):
    """A deterministic encoder in column functions: signed hashed bag of words, unit length."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    # each word changes one place, and what is used again is a variable of a lambda: Spark would work an expression out
    # anew at each of its uses
    places = F.transform(tokens(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("by")))
    bump = lambda acc, i, by: F.concat(F.slice(acc, 1, i), F.array(F.get(acc, i) + by), F.slice(acc, i + 2, F.lit(dimensions - 1) - i))
    bumped = F.aggregate(places, zero, lambda acc, p: bump(acc, p["i"], p["by"]))
    scaled = F.transform(F.array(bumped), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return F.get(F.transform(scaled, lambda s: F.transform(s["v"], lambda x: F.when(s["norm"] == 0, 0.0).otherwise(x / s["norm"]).cast("float"))), 0)


def embed_nodes(nodes: DataFrame, stored: DataFrame | None = None, provider: str = "hashing", encoder=hashing_encoder) -> DataFrame:
    """(qualified_name, vector, text_hash, provider) of nodes whose text or provider changed; files are left out.

    encoder: column of text -> column of vector; a pandas UDF that calls a model serves as well.
    """
    full = nodes.filter("kind != 'File'")
    full = full.select(*full.columns, *(F.lit(None).cast("string").alias(c) for c in ("params", "return_type") if c not in full.columns))
    todo = full.select("qualified_name", node_to_text().alias("text")).withColumn("text_hash", text_hash("text")).withColumn("provider", F.lit(provider))
    if stored is not None:
        todo = todo.join(stored.select("qualified_name", "text_hash", "provider"), ["qualified_name", "text_hash", "provider"], "left_anti")
    return todo.select("qualified_name", encoder(F.col("text")).alias("vector"), "text_hash", "provider")


def store_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.join(fresh.select("qualified_name"), "qualified_name", "left_anti").unionByName(fresh)
