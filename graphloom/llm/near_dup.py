"""MinHash near-duplicates: a chosen-path similarity join over sets of word shingles.

Every distinct shingle set is a class. Independent trees branch the classes by minwise tokens (the coordinate that a
node branches by is chosen by a hash of the path to it) until a node is small; small nodes are compared exhaustively
on their signatures, which gives tentative components of everything that may be linked. Within a tentative component
the full sets decide: pairs in different components are compared exactly until none is left, so no link between
different components is lost. A component whose sets are too large for one task is dealt over tasks and compared with
rounds of pivots, which is exact too; so is a node that stays large down to the last depth.

A pair of similarity 0.85 shares a node of depth d with probability 0.85**d in a tree. ``TREES`` trees miss a pair of depth 3
or less with a chance of at most ``MISS``; classes that lie deeper (families of documents around one template) get as many
more trees as keep that chance. Besides, a signature is over four standard deviations low less than once in 100,000 pairs.
Sets hold 64-bit hashes of shingles.

Defined results: null or empty text has an empty set, is linked with nothing and is its own component; rows that share
a doc_id but not the text are linked by their sets only; rows without a doc_id have no component and are kept; an empty
table gives an empty table; a very long text is one task's work; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, discard, materialize, one_of_each, row_key
from .textops import U64, ascii_lower, mix64, window_hashes, word_bounds, word_hashes

WORDS = 5
COORDS = 128
TREES = 10
MISS = 1e-4
DEPTH = 8
NODE = 512
CHUNK = 16_384  # classes of a node that one task compares
TRIES = 256  # pivots by which a node of up to that many classes may be settled before it is branched further
BIG_SETS = 4_000_000
PIVOTS = 64
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, COORDS, dtype=np.uint64) * U64(2) + U64(1)
_B = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; the whole sequence if it has fewer words."""
    data = ascii_lower((text or "").encode("utf-8", "surrogatepass"))
    buf = np.frombuffer(data, dtype=np.uint8)
    s, e = word_bounds(buf)
    if not len(s):
        return np.zeros(0, dtype=U64)
    h = word_hashes(buf, s, e)
    return np.unique(window_hashes(h, k) if len(h) >= k else mix64(window_hashes(h, len(h)) + U64(len(h))))


def minhashes(x: np.ndarray) -> np.ndarray:
    """The 32-bit minimum of the set under each of ``COORDS`` hash functions."""
    out = np.full(COORDS, 0xFFFFFFFF, dtype=U64)
    for a in range(0, len(x), 2048):
        out = np.minimum(out, ((x[a : a + 2048, None] * _A + _B) >> U64(32)).min(0))
    return out.astype(np.uint32)


def tree_paths(mh: np.ndarray, first: int, trees: int, depth: int) -> np.ndarray:
    """Node keys [classes, trees, depth] of the trees from number ``first`` on: a path is extended by the minwise token at a coordinate that the path picks."""
    out = np.zeros((len(mh), trees, depth), dtype=U64)
    path = np.broadcast_to(mix64(np.arange(first + 1, first + trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)), (len(mh), trees)).copy()
    rows = np.arange(len(mh))[:, None]
    for d in range(depth):
        c = (mix64(path + U64(d + 1)) % U64(COORDS)).astype(np.int64)
        path = mix64(path * U64(0x100000001B3) + mh[rows, c].astype(U64) + U64(1))
        out[:, :, d] = path
    return out


_SIGNED = "doc_id long, key binary, n_shingles long, digest binary, mh binary"


def _sign(batches):
    for rb in batches:
        ns, digests, mhs = [], [], []
        for v in rb.column("text"):
            x = shingles(v.as_py())
            ns.append(len(x))
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            mhs.append(minhashes(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("key"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(mhs, pa.binary())], names=["doc_id", "key", "n_shingles", "digest", "mh"])


def _paths(tree: int, trees: int, depth: int):
    """Rows (cid, tree, node of that depth) of each class, for trees from number ``tree`` on."""

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            mh = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in rb.column("mh")])
            nodes = tree_paths(mh, tree, trees, depth)[:, :, depth - 1].reshape(-1).astype(np.int64, casting="unsafe")
            cid = np.repeat(rb.column("cid").to_numpy(zero_copy_only=False), trees)
            numbers = np.tile(np.arange(tree, tree + trees, dtype=np.int32), rb.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(numbers), pa.array(nodes)], names=["cid", "tree", "node"])

    return run


def link_groups(n: int, compare, tries: int | None = None) -> list[tuple[int, int]] | None:
    """Spanning links of the components of 0..n-1, where compare(i, others) tells which of others i is linked with.

    Members become pivots and are compared with all members of other components; once every member outside the largest
    component has been one, no pair in different components is left unseen. None if that takes over ``tries`` pivots.
    """
    label, links = np.arange(n), []
    done = np.zeros(n, dtype=bool)
    while True:
        counts = np.bincount(label, minlength=n)
        open_ = np.flatnonzero(~done & (label != int(counts.argmax())) | ~done & (counts[label] == 1))
        if not len(open_):
            return links
        if tries is not None and done.sum() >= tries:
            return None
        p = int(open_[0])
        done[p] = True
        others = np.flatnonzero(label != label[p])
        if not len(others):
            return links
        hit = others[compare(p, others)]
        for j in hit.tolist():
            if label[j] != label[p]:
                links.append((p, j))
                a, b = label[p], label[j]
                label[label == b] = a


def _grouped(batches, key: str):
    """Groups of consecutive rows with one key, as (key, table); a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), rb.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(rb.slice(a, b - a))
            last = k[a]
    if held:
        yield last, pa.Table.from_batches(held)


def _compare_nodes(least_equal: int, tries: int | None = None):
    """Tentative links in each node, from the signatures; (node, null) for one that ``tries`` pivots don't settle."""

    def run(batches):
        left, right = [], []
        for node, t in _grouped(batches, "node"):
            if t.num_rows < 2:
                continue
            cid = t.column("cid").to_numpy()
            sig = np.stack([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in t.column("mh")])
            if len(cid) == 2:
                links = [(0, 1)] if int((sig[0] == sig[1]).sum()) >= least_equal else []
            else:
                links = link_groups(len(cid), lambda p, o, s=sig: (s[o] == s[p]).sum(1) >= least_equal, tries)
            if links is None:
                left.append(int(node))
                right.append(None)
                continue
            for i, j in links:
                if cid[i] != cid[j]:
                    left.append(int(cid[i]))
                    right.append(int(cid[j]))
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


_PATHS = "cid long, tree int, node long"


def _leaves(classes: DataFrame, tree: int, trees: int, depth: int, node: int, chunk: int, least_equal: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame], list[DataFrame]]:
    """(cid, node, m, d) of the leaves of some trees, (cid, d) of the classes below the first depth, links that were found
    on the way, and tables to discard.

    A node of at most ``node`` classes is a leaf, and so is every one of the last depth. One of up to ``chunk`` classes that
    a few pivots settle, as they do with near copies, needs no branching. ``m`` is a node's size, ``d`` its depth.
    """
    rows = arrow_map(classes.select("cid", "mh"), _paths(tree, trees, 1), _PATHS)
    leaves, deep, links, used = None, None, [], []
    for d in range(1, depth + 1):
        rows = materialize(rows, f"near-rows-{d}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        sized = materialize(rows.join(sizes, "node"), f"near-nodes-{d}")
        discard(rows)
        used.append(sized)
        small = sized.filter(F.col("m") <= node) if d < depth else sized
        small = small.select("cid", "node", "m", F.lit(d).alias("d"))
        leaves = small if leaves is None else leaves.unionByName(small)
        large = sized.filter(F.col("m") > node)
        if d == depth or large.isEmpty():
            break
        middle = large.filter(F.col("m") <= chunk).select("cid", "node").join(classes.select("cid", "mh"), "cid")
        tried = materialize(arrow_map(middle.repartition("node").sortWithinPartitions("node"), _compare_nodes(least_equal, TRIES), "a long, b long"), "near-tried")
        links.append(tried.filter("b IS NOT NULL"))
        used.append(tried)
        open_ = tried.filter("b IS NULL").select(F.col("a").alias("node")).unionByName(large.filter(F.col("m") > chunk).select("node").distinct())
        large = materialize(large.join(open_, "node", "left_semi").select("cid", "tree"), "near-large")
        used.append(large)
        if large.isEmpty():
            break
        below = large.select("cid", F.lit(d + 1).alias("d"))
        deep = below if deep is None else deep.unionByName(below)
        deeper = arrow_map(classes.join(large.select("cid").distinct(), "cid", "left_semi").select("cid", "mh"), _paths(tree, trees, d + 1), _PATHS)
        rows = large.join(deeper, ["cid", "tree"])
    return leaves, deep, links, used


def trees_for(depth: int, miss: float = MISS) -> int:
    """Trees by which a pair of similarity 0.85 shares a node of that depth in one at least, but for a chance ``miss``."""
    return max(TREES, math.ceil(math.log(miss) / math.log(1 - 0.85**depth)))


def candidates(classes: DataFrame, depth: int = DEPTH, node: int = NODE, chunk: int = CHUNK, least_equal: int | None = None) -> DataFrame:
    """Tentative links (a, b) between classes (cid, mh)."""
    least_equal = least_equal or int(0.70 * COORDS)
    links, tree, todo = None, 0, classes
    trees, used = TREES, []
    while True:
        leaves, deep, early, tables = _leaves(todo, tree, trees, depth, node, chunk, least_equal)
        used += tables
        with_sig = leaves.select("cid", "node", "m").join(classes.select("cid", "mh"), "cid")
        one_task = with_sig.filter(F.col("m") <= max(node, chunk)).select("cid", "node", "mh").repartition("node").sortWithinPartitions("node")
        found = arrow_map(one_task, _compare_nodes(least_equal), "a long, b long")
        for more in (found, *early):
            links = more if links is None else links.unionByName(more)
        if not leaves.filter(F.col("m") > max(node, chunk)).isEmpty():
            large = with_sig.filter(F.col("m") > max(node, chunk)).select(F.col("node").alias("comp"), "cid", F.col("mh").alias("x"))
            labels = _pivot_rounds(large, _equal_signatures(least_equal), chunk * COORDS * 4)
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a != b"))
        tree += trees
        if deep is None:
            break
        # what lies deeper than these trees reach surely gets more of them
        depths = materialize(deep.groupBy("cid").agg(F.max("d").alias("d")), "near-depths")
        deepest = depths.agg(F.max("d")).first()[0]
        trees, need = trees_for(deepest) - tree, next((d for d in range(1, deepest + 1) if trees_for(d) > tree), None)
        if need is None:
            break
        todo = materialize(todo.join(depths.filter(F.col("d") >= need).select("cid"), "cid", "left_semi"), "near-deep")
        used += [depths, todo]
    out = materialize(links.dropDuplicates(), "near-links")
    discard(*used)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node reachable. Alternating large and small
    stars; every round is written to the shared folder."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").dropDuplicates(), "stars")
    mark = None
    while True:
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").dropDuplicates()
        large = materialize(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").dropDuplicates()
        small = materialize(small, "stars")
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now, large)
        now = small
        if state == mark:
            break
        mark = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).dropDuplicates())


def _linked(inter, a, b, percent):
    return 100 * inter >= percent * (a + b - inter)


def _exact_components(percent: int):
    """(cid, component_id) from whole tentative components: rows (comp, cid, min_doc, x), x the full set."""

    def run(batches):
        cids, comps = [], []
        for _, t in _grouped(batches, "comp"):
            cid = t.column("cid").to_numpy()
            doc = t.column("min_doc").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), dtype=U64) for x in t.column("x")]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            if len(sets) == 2:
                inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                links = [(0, 1)] if _linked(inter, n[0], n[1], percent) else []
            else:
                names, inv = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                flags = np.zeros(len(names), dtype=bool)

                def compare(p, others, inv=inv, starts=starts, n=n, flags=flags):
                    mine = inv[starts[p] : starts[p] + n[p]]
                    flags[mine] = True
                    inter = np.add.reduceat(flags[inv].astype(np.int32), starts)[others]
                    flags[mine] = False
                    return _linked(inter, n[others], n[p], percent)

                links = link_groups(len(sets), compare)
            root = list(range(len(sets)))

            def find(i, root=root):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in links:
                root[find(i)] = find(j)
            best: dict[int, int] = {}
            for i, d in enumerate(doc):
                r = find(i)
                if d is not None:
                    best[r] = min(d, best.get(r, d))
            cids += cid.tolist()
            comps += [best.get(find(i)) for i in range(len(sets))]
            if len(cids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(comps, pa.int64())], names=["cid", "component_id"])
                cids, comps = [], []
        yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(comps, pa.int64())], names=["cid", "component_id"])

    return run


def _linked_sets(percent: int):
    def linked(o: np.ndarray, s: np.ndarray) -> bool:
        o, s = o.view(U64), s.view(U64)
        if min(len(o), len(s)) * 100 < percent * max(len(o), len(s)):
            return False
        at = np.searchsorted(o, s)
        at[at == len(o)] = 0
        return bool(_linked(int((o[at] == s).sum()), len(o), len(s), percent))

    return linked


def _equal_signatures(least_equal: int):
    return lambda o, s: int((o.view(np.uint32) == s.view(np.uint32)).sum()) >= least_equal


def _pivot_links(linked):
    """Links between the pivots and the members of a salted part: rows (part, role, cid, x), pivots (role 0) first."""

    def run(batches):
        part, pivots = None, []
        for rb in batches:
            out = ([], [])
            for p, role, cid, x in zip(rb.column("part").to_pylist(), rb.column("role").to_pylist(), rb.column("cid").to_pylist(), rb.column("x"), strict=True):
                s = np.frombuffer(x.as_py(), dtype=np.uint8)
                if p != part:
                    part, pivots = p, []
                if role == 0:
                    pivots.append((cid, s))
                    continue
                for other, o in pivots:
                    if other != cid and linked(o, s):
                        out[0].append(other)
                        out[1].append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def _pivot_rounds(members: DataFrame, linked, part_bytes: int) -> DataFrame:
    """(node, label) of the members (comp, cid, x) of components that no task should hold: rounds of pivots over salted parts.

    Ends when every member outside a component's largest group has been a pivot, so all pairs in different groups were seen.
    """
    weights = members.groupBy("comp").agg(F.ceil(F.sum(F.length("x")) / part_bytes).alias("parts"))
    members = materialize(members.join(weights, "comp").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("parts"))), "giant-members")
    links, labels, used = None, None, None
    while True:
        state = members.select("comp", "cid", "salt")
        if labels is not None:
            state = state.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
            groups = state.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("m"))
            largest = groups.groupBy("comp").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"))
            state = state.join(largest, "comp").filter("label != main").join(used, ["comp", "cid"], "left_anti")
        per_part = Window.partitionBy("comp", "salt").orderBy(F.xxhash64("cid"))
        per_comp = Window.partitionBy("comp").orderBy(F.xxhash64("cid"))  # over PIVOTS rows a part
        chosen = state.withColumn("r", F.row_number().over(per_part)).filter(F.col("r") <= PIVOTS).withColumn("r", F.row_number().over(per_comp)).filter(F.col("r") <= PIVOTS)
        chosen = materialize(chosen.select("comp", "cid"), "giant-pivots")
        if chosen.isEmpty():
            break
        pivots = members.join(chosen, ["comp", "cid"], "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        both = pivots.withColumn("role", F.lit(0)).unionByName(members.withColumn("role", F.lit(1))).withColumn("part", F.xxhash64("comp", "salt")).select("part", "role", "cid", "x")
        fresh = arrow_map(both.repartition("part").sortWithinPartitions("part", "role"), _pivot_links(linked), "a long, b long")
        links = materialize(fresh if links is None else links.unionByName(fresh), "giant-links")
        labels = materialize(connected(links), "giant-labels")
        used = materialize(chosen if used is None else used.unionByName(chosen), "giant-used")
    out = members.select(F.col("cid").alias("node")).distinct()
    return (out if labels is None else out.join(labels, "node", "left")).withColumn("label", F.coalesce("label", "node") if labels is not None else F.col("node"))


def _giant_components(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, component_id) of tentative components (comp, cid, min_doc, x) that no task should hold."""
    labels = _pivot_rounds(sets.select("comp", "cid", "x"), _linked_sets(percent), BIG_SETS * 4)
    out = sets.select("cid", "min_doc").join(labels.withColumnRenamed("node", "cid"), "cid")
    best = out.groupBy("label").agg(F.min("min_doc").alias("component_id"))
    return out.join(best, "label").select("cid", "component_id")


def _full_sets(batches):
    for rb in batches:
        xs = [shingles(v.as_py()).tobytes() for v in rb.column("text")]
        yield pa.RecordBatch.from_arrays([rb.column("comp"), rb.column("cid"), rb.column("min_doc"), pa.array(xs, pa.binary())], names=["comp", "cid", "min_doc", "x"])


def components(docs: DataFrame, percent: int = 85, **options) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row; links are those with 100 * intersection >= percent * union."""
    signed = materialize(arrow_map(docs.select("doc_id", "text", row_key().alias("key")), _sign, _SIGNED), "near-signed")
    some = signed.filter("digest IS NOT NULL")
    grouped = some.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r"), F.first("mh").alias("mh"), F.max("n_shingles").alias("n"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "digest", F.col("r.doc_id").alias("min_doc"), F.col("r.key").alias("key"), "mh", "n"), "near-classes")
    links = candidates(classes, **options)
    comps = materialize(connected(links).select(F.col("node").alias("cid"), F.col("label").alias("comp")), "near-comps")
    members = classes.select("cid", "min_doc", "key", "n").join(comps, "cid")
    weights = members.groupBy("comp").agg(F.sum("n").alias("weight"))
    members = materialize(members.join(weights, "comp"), "near-members")
    # one row of each class brings its text; repeated rows meet as partial aggregates
    # (a sort-merge join at every size: the members grow with the documents, so they are never broadcast)
    texts = docs.select(row_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = texts.join(members.select("key", "comp", "cid", "min_doc", "weight").hint("merge"), "key")
    part = lambda cond: arrow_map(texts.filter(cond).select("comp", "cid", "min_doc", "text"), _full_sets, "comp long, cid long, min_doc long, x binary")
    exact = arrow_map(part(F.col("weight") <= BIG_SETS).repartition("comp").sortWithinPartitions("comp", "cid"), _exact_components(percent), "cid long, component_id long")
    if not members.filter(F.col("weight") > BIG_SETS).isEmpty():
        exact = exact.unionByName(_giant_components(part(F.col("weight") > BIG_SETS), percent))
    exact = materialize(exact, "near-exact")
    discard(links, comps, members)
    labels = classes.select("cid", "digest", "min_doc").join(exact, "cid", "left").select("digest", F.coalesce("component_id", "min_doc").alias("component_id"))
    return signed.select("doc_id", "key", "n_shingles", "digest").join(labels, "digest", "left").select("doc_id", "key", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of query op8."""
    out = components(docs, **options)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays (that of the smallest doc_id); columns stay. Equal rows stay once."""
    kept = components(docs, **options).filter((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull())
    one = kept.groupBy(F.col("component_id"), F.when(F.col("component_id").isNull() | F.col("doc_id").isNull(), F.col("key"))).agg(F.min("key").alias("k"))
    return one_of_each(docs, row_key()).join(one.select("k").distinct().hint("merge"), "k", "left_semi").select("row.*")
