"""Secret scans: base recognisers plus a character convolutional network in numpy.

Every candidate (a run of eight or more token characters) is scored with its surroundings: a long one by overlapping
windows over all of it, of which the highest score counts. The network is trained on the windows of all documents: those
that hold a base finding are positive, other candidates negative. A hash of the window holds every fifth out. Training
starts from ``start_each`` windows of either label; then each task trains on all its windows, beginning with these weights,
and the tasks' weights are averaged by their windows. What is held out in the whole table calibrates the scores (logistic
scaling) and sets the threshold: the most precise at which at least ``min_recall`` of held-out findings pass. For that,
scores are counted in steps of 1/256 of a logit.

Defined results: null text is empty text; a table without any finding or any other candidate leaves the base spans
alone, and one with fewer than ten of either trains and calibrates on all of it (both are logged); equal rows give equal
rows and count as often as they occur; an empty table gives an empty table; columns other than doc_id and text are
ignored; a candidate that overlaps a base span adds nothing. The weights depend on how the table is cut into tasks.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import logging
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, discard, materialize

LOG = logging.getLogger(__name__)
KINDS = ("assign", "access", "hex")
FOUND = "cnn"
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{7,}")
LEFT, BODY, RIGHT, WIDTH, FILTERS = 24, 56, 8, 5, 24
LENGTH = LEFT + BODY + RIGHT
STEP, BLOCK = BODY // 2, 4096  # between the windows of a long candidate; windows scored at once
ALPHABET = 98
BINS = 256  # steps of a logit in which held-out scores are counted
HASH = np.random.default_rng(3).integers(1, 2**63, LENGTH // 8, dtype=np.uint64) | np.uint64(1)


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, sorted. ``runs`` are the text's candidates, if these are known: a
    hex finding lies within one of 32 characters or more."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for a, b in [(0, len(text))] if runs is None else [r for r in runs if r[1] - r[0] >= 32]:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    found.sort()
    return found


class Spans:
    """Base findings by start, for overlap tests in logarithmic time."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in base]
        self.ends = list(itertools.accumulate((b for _, _, b in base), max))

    def overlap(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the runs that the network looks at."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The spans of a candidate that fill one window each: overlapping steps over all of it, the last one at its end."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in (*range(start, end - BODY, STEP), end - BODY)]


def coded(text: str) -> np.ndarray:
    """Character codes (0: nothing there, 97: beyond ASCII) with room for the windows at either end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.zeros(LEFT + len(codes) + BODY + RIGHT, dtype=np.uint8)
    out[LEFT : LEFT + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 31, 97)
    return out


def windows(codes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The pieces with their surroundings as rows of ``LENGTH`` codes."""
    at = np.array(spans, dtype=np.int64).reshape(-1, 2)
    out = np.empty((len(at), LENGTH), dtype=np.uint8)
    cut = lambda n: np.lib.stride_tricks.as_strided(codes, (len(codes) - n + 1, n), (1, 1), writeable=False)
    out[:, : LEFT + BODY] = cut(LEFT + BODY)[at[:, 0]]
    out[:, LEFT : LEFT + BODY] *= np.arange(BODY, dtype=np.uint8) < (at[:, 1] - at[:, 0]).astype(np.uint8)[:, None]
    out[:, LEFT + BODY :] = cut(RIGHT)[LEFT + at[:, 1]]
    return out


class Network:
    """Convolution over characters, rectifier, maximum over the left side and over candidate and right side, logit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.15, (WIDTH, ALPHABET, FILTERS))
        self.b = np.zeros(FILTERS)
        self.v = rng.normal(0, 0.2, 2 * FILTERS)
        self.c = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.precision, self.recall = float("nan"), float("nan")  # of the held-out part, at the threshold

    def _maps(self, x):
        n = x.shape[1] - WIDTH + 1
        z = np.zeros((len(x), n, FILTERS)) + self.b
        for k in range(WIDTH):
            z += self.e[k][x[:, k : k + n]]
        return z

    def _pooled(self, z):
        cut = LEFT - WIDTH + 1
        i, j = z[:, :cut].argmax(1), z[:, cut:].argmax(1) + cut
        rows, cols = np.arange(len(z))[:, None], np.arange(FILTERS)[None]
        h = np.concatenate([z[rows, i, cols], z[rows, j, cols]], 1)
        return np.maximum(h, 0), np.concatenate([i, j], 1)

    def _pairs(self, kind=float) -> list[np.ndarray]:
        """What the first and second, third and fourth, and the last character of a place add."""
        e = self.e.astype(kind)
        return [*((e[k][:, None] + e[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)), (self.e[4] + self.b).astype(kind)]

    def _scores(self, x: np.ndarray, where: bool = False, tables: list[np.ndarray] | None = None):
        """What ``_pooled`` gives of ``_maps``, place by place (``where``: for a step, in single precision). Rows go by the length of their candidates, so the empty
        columns behind these are looked at once a row: all their places have the same value."""
        used = np.count_nonzero(x[:, LEFT : LEFT + BODY], axis=1)
        order = np.argsort(-used, kind="stable")
        lengths = -used[order]
        codes = np.ascontiguousarray(x[order].T).astype(np.intp)
        tables, pair = tables or self._pairs(np.float32 if where else float), codes[:-1] * ALPHABET + codes[1:]
        h, at = np.empty((len(x), 2 * FILTERS)), np.zeros((len(x), 2 * FILTERS), dtype=np.intp)
        cut, empty = LEFT - WIDTH + 1, LEFT + BODY - WIDTH
        for half, (first, last) in enumerate(((0, cut), (cut, LENGTH - WIDTH + 1))):
            best = place = None
            for p in range(first, last):
                n = int(np.searchsorted(lengths, LEFT - p, side="right")) if LEFT < p <= empty else len(x)
                if not n:
                    continue
                z = tables[0].take(pair[p, :n], axis=0)
                z += tables[1].take(pair[p + 2, :n], axis=0)
                z += tables[2].take(codes[p + 4, :n], axis=0)
                if best is None:
                    best, place = z, np.full(z.shape, p, dtype=np.uint8)
                    continue
                if where:  # later places have higher numbers
                    np.maximum(place[:n], (z > best[:n]).view(np.uint8) * np.uint8(p), out=place[:n])
                np.maximum(best[:n], z, out=best[:n])
            cols = slice(half * FILTERS, (half + 1) * FILTERS)
            h[order, cols], at[order, cols] = np.maximum(best, 0), place
        return h, at

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of windows in any order; those of like length are taken together."""
        order, out = np.argsort(np.count_nonzero(x[:, LEFT : LEFT + BODY], axis=1), kind="stable"), np.zeros(len(x))
        tables = self._pairs()
        for a in range(0, len(x), 1024):
            rows = order[a : a + 1024]
            out[rows] = self._scores(x[rows], tables=tables)[0] @ self.v + self.c
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def weights(self) -> np.ndarray:
        return np.concatenate([self.e.ravel(), self.b, self.v, [self.c]])

    def load(self, weights: np.ndarray) -> None:
        n = self.e.size
        self.e, self.b, self.v = weights[:n].reshape(self.e.shape).copy(), weights[n : n + FILTERS].copy(), weights[n + FILTERS : -1].copy()
        self.c = float(weights[-1])

    def step(self, state: list, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step by Adam; ``state`` is an empty list at first."""
        params = [self.e, self.b, self.v]
        if not state:
            state += [[np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0]
        h, where = self._scores(x, where=True)
        p = 1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -50, 50)))
        d = (p - y) * weight / len(x)
        gh = d[:, None] * self.v * (h > 0)
        cols = np.tile(np.arange(FILTERS), 2)[None]
        rows = np.arange(len(x))[:, None]
        ge = np.stack([np.bincount((x[rows, where + k].astype(np.intp) * FILTERS + cols).ravel(), gh.ravel(), ALPHABET * FILTERS) for k in range(WIDTH)])
        grads = [ge.reshape(self.e.shape) + 1e-4 * self.e, gh[:, :FILTERS].sum(0) + gh[:, FILTERS:].sum(0), h.T @ d + 1e-4 * self.v]
        state[2] += 1
        self.c -= rate * d.sum()
        for p_, g, u, w in zip(params, grads, *state[:2], strict=True):
            u += 0.1 * (g - u)
            w += 0.001 * (g * g - w)
            p_ -= rate * (u / (1 - 0.9 ** state[2])) / (np.sqrt(w / (1 - 0.999 ** state[2])) + 1e-8)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, batch: int = 128, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        weight, state = balanced(y), []
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                self.step(state, x[rows], y[rows], weight[rows], rate)

    def go_on(self, blocks, start_x: np.ndarray, start_y: np.ndarray, rate: float = 0.001, batch: int = 1024, beside: int = 64, seed: int = 13) -> int:
        """Train on every window of the blocks (x, y) once; returns how many these were. Beside each part stand windows
        of either label: those of the start, which give way to what is read."""
        rng, state, n = np.random.default_rng(seed), [], 0
        known = [start_x[start_y == label] for label in (0, 1)]
        for x, y in blocks:
            order = rng.permutation(len(x))
            for rows in np.array_split(order, -(-len(x) // batch)):
                others = [k[rng.integers(0, len(k), beside)] for k in known]
                bx, by = np.concatenate([x[rows], *others]), np.r_[y[rows], np.zeros(beside), np.ones(beside)]
                self.step(state, bx, by, balanced(by), rate)
            n += len(x)
            known = [np.concatenate([k, x[y == label][-len(k) :]])[-len(k) :] for label, k in enumerate(known)]
        return n

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float) -> None:
        self.calibrate_counts(self.logits(x), y, np.ones(len(y)), min_recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, min_recall: float, width: float = 0.0) -> None:
        """Logistic scaling of the logits, then, of the thresholds at held-out findings' scores that keep ``min_recall``
        of them, the lowest of those with the best precision. The lowest score keeps all, so there always is one. The
        threshold is set half way (in logits) to the next lower held-out score, which changes nothing on these.
        A row stands for ``n`` windows of label y with logits from z up to less than z + width."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            d = (p - y) * n / n.sum()
            a, b = a - 0.1 * ((d * z).sum() + 0.001 * (a - 1)), b - 0.5 * d.sum()
        self.scale, self.shift = max(a, 1e-3), b
        scores, at = np.unique(z, return_inverse=True)
        passing = lambda w: np.bincount(at, w, len(scores))[::-1].cumsum()[::-1]
        good, every = passing(n * (y == 1)), passing(n)
        recall, precision = good / good[0], good / every
        own = np.bincount(at, n * (y == 1), len(scores)) > 0
        i = int(np.flatnonzero(own & (recall >= min_recall) & (precision == precision[own & (recall >= min_recall)].max()))[0])
        cut, self.precision, self.recall = scores[i], float(precision[i]), float(recall[i])
        cut = (cut + min(cut, scores[i - 1] + width)) / 2 if i else cut
        self.threshold = float(1 / (1 + np.exp(-np.clip(self.scale * cut + self.shift, -50, 50))))


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which either label counts half."""
    return np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)


def hashes(x: np.ndarray) -> np.ndarray:
    """A number of each window by its content."""
    mixed = (np.ascontiguousarray(x).view(np.uint64) * HASH).sum(1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(12)


def held_out(h: np.ndarray) -> np.ndarray:
    return h % np.uint64(5) == 0


def labelled(batches):
    """(windows, labels) of all texts, in blocks."""
    xs, ys, n = [], [], 0
    for rb in batches:
        for v in rb.column("text"):
            text = v.as_py() or ""
            runs = candidates(text)
            base = base_spans(text, runs)
            spans = [p for c in runs for p in ((c,) if c[1] - c[0] <= BODY else pieces(*c))]
            if not spans:
                continue
            codes, taken = coded(text), Spans(base)
            for i in range(0, len(spans), BLOCK):
                part = spans[i : i + BLOCK]
                xs.append(windows(codes, part))
                ys.append(np.array([taken.overlap(*p) for p in part], dtype=float) if base else np.zeros(len(part)))
                n += len(part)
                if n >= BLOCK:
                    yield np.concatenate(xs), np.concatenate(ys)
                    xs, ys, n = [], [], 0
    if n:
        yield np.concatenate(xs), np.concatenate(ys)


def beginning(texts: DataFrame, each: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Different windows with the lowest hashes, up to ``each`` of a label, their labels, and how many windows the table
    has of label 0 and 1."""

    def lowest(batches):
        kept, counts = ({}, {}), [0, 0]
        for x, y in labelled(batches):
            h = hashes(x)
            for label in (0, 1):
                rows = np.flatnonzero(y == label)
                counts[label] += len(rows)
                rows = rows[np.argsort(h[rows], kind="stable")[: 4 * each]]
                if len(kept[label]) >= each:
                    rows = rows[h[rows] < max(kept[label].values())]
                kept[label].update((x[i].tobytes(), int(h[i])) for i in rows)
                if len(kept[label]) > each:
                    few = heapq.nsmallest(each, kept[label].items(), key=lambda r: (r[1], r[0]))
                    kept[label].clear()
                    kept[label].update(few)
        for label in (0, 1):
            if counts[label]:
                rows = list(kept[label].items())
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(rows), pa.int32()), pa.array([h for _, h in rows], pa.int64()), pa.array([x for x, _ in rows], pa.binary()), pa.array([counts[label]] + [0] * (len(rows) - 1), pa.int64())], names=["label", "h", "x", "n"])

    found = materialize(arrow_map(texts, lowest, "label int, h long, x binary, n long"), "secrets")
    n = {r.label: r.n for r in found.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    once = found.select("label", "h", "x").dropDuplicates()
    rows = [r for y in (0, 1) for r in once.filter(F.col("label") == y).orderBy("h", "x").limit(each).collect()]
    discard(found)
    x = np.array([np.frombuffer(bytes(r.x), dtype=np.uint8) for r in rows], dtype=np.uint8).reshape(-1, LENGTH)
    return x, np.array([r.label for r in rows], dtype=float), (n.get(0, 0), n.get(1, 0))


def over_all(texts: DataFrame, net: Network, x: np.ndarray, y: np.ndarray, everything: bool) -> None:
    """Go on from the network's weights over all windows (without the held-out ones, unless ``everything``)."""
    model = texts.sparkSession.sparkContext.broadcast((net, x, y))  # a fixed number of weights and windows

    def run(batches):
        net, x, y = model.value
        own = Network()
        own.load(net.weights())
        picked = ((bx[k], by[k]) for bx, by in labelled(batches) if (k := np.ones(len(by), dtype=bool) if everything else ~held_out(hashes(bx))).any())
        if n := own.go_on(picked, x, y):
            yield row(TaskContext.get().partitionId(), n, own.weights() * n)

    def row(part, n, weights):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["part", "n", "w"])

    def added(rows):  # in the order of the tasks, so sums agree in every run
        rows = sorted(rows)
        return rows[0][0], sum(n for _, n, _ in rows), sum(np.frombuffer(w) for _, _, w in rows)

    def merge(batches):
        rows = [(r["part"], r["n"], r["w"]) for rb in batches for r in rb.to_pylist()]
        if rows:
            yield row(*added(rows))

    schema = "part int, n long, w binary"
    sums = arrow_map(arrow_map(texts, run, schema).repartition(8, "part"), merge, schema).collect()
    if sums:
        _, n, total = added([(r.part, r.n, bytes(r.w)) for r in sums])
        net.load(total / n)


def counted_scores(texts: DataFrame, net: Network, everything: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, number) of the held-out windows of all texts, logits rounded down to steps of 1 / ``BINS``."""
    model = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net, sums = model.value, {}
        for x, y in labelled(batches):
            if not everything:
                keep = held_out(hashes(x))
                x, y = x[keep], y[keep]
            if len(x):
                bins = np.floor(np.clip(net.logits(x), -100, 100) * BINS).astype(np.int64)
                for label in (0, 1):
                    for k, n in zip(*(v.tolist() for v in np.unique(bins[y == label], return_counts=True)), strict=True):
                        sums[label, k] = sums.get((label, k), 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["label", "bin", "n"])

    rows = arrow_map(texts, run, "label int, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    rows = np.array(sorted((r.bin, r.label, r.n) for r in rows), dtype=float).reshape(-1, 3)
    return rows[:, 0] / BINS, rows[:, 1], rows[:, 2]


def train(docs: DataFrame, start_each: int = 1500, min_recall: float = 0.95) -> Network | None:
    """Train on the windows of all documents; a fifth of them only calibrates."""
    texts = docs.select("text")
    x, y, totals = beginning(texts, start_each)
    if not all(totals):
        LOG.warning("no network: the table holds %d findings and %d other candidates", totals[1], totals[0])
        return None
    fit = ~held_out(hashes(x))
    few = min(totals) < 10 or any(not (fit & (y == label)).any() for label in (0, 1))
    if few:
        fit[:] = True
    net = Network()
    net.fit(x[fit], y[fit])
    if max(totals) > start_each:  # else the start holds every window
        over_all(texts, net, x[fit], y[fit], few)
    z, label, n = counted_scores(texts, net, few)
    if not few and len(set(label)) < 2:
        few, (z, label, n) = True, counted_scores(texts, net, True)
    net.calibrate_counts(z, label, n, min_recall, 1 / BINS)
    report = "threshold %.4f: recall %.3f, precision %.3f of %d findings and %d other candidates " + ("that it was also trained on" if few else "held out")
    LOG.log(logging.WARNING if few else logging.INFO, report, net.threshold, net.recall, net.precision, n[label == 1].sum(), n[label == 0].sum())
    return net


_SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """Base findings and the candidates that the network takes for secrets."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    def run(batches):
        net = model.value
        for rb in batches:
            rows, todo, owner, held = [], [], [], 0

            def score():
                p = net.probabilities(np.concatenate(todo))
                for at in np.flatnonzero(p >= net.threshold):
                    i, s, e = owner[at]
                    rows[i][1].add((s, e))

            for i, v in enumerate(rb.column("text")):
                text = v.as_py() or ""
                runs = candidates(text)
                base = base_spans(text, runs)
                rows.append([base, set()])
                if net is None:
                    continue
                codes, taken = coded(text), Spans(base)
                spans = [(p, c) for c in runs if not (base and taken.overlap(*c)) for p in ((c,) if c[1] - c[0] <= BODY else pieces(*c))]
                for a in range(0, len(spans), BLOCK):
                    part = spans[a : a + BLOCK]
                    todo.append(windows(codes, [p for p, _ in part]))
                    owner += [(i, *c) for _, c in part]
                    held += len(part)
                    if held >= BLOCK:
                        score()
                        todo, owner, held = [], [], 0
            if todo:
                score()
            cols: list[list] = [[] for _ in range(5)]
            for base, added in rows:
                named = [(s, k, e) for s, k, e in base] + [(s, 3, e) for s, e in added]
                both = [(s, (*KINDS, FOUND)[k], e) for s, k, e in sorted(named)]
                sha = hashlib.sha256(spans_text([(s, KINDS[k], e) for s, k, e in base]).encode()).hexdigest()
                for c, v in zip(cols, (*(sum(x[1] == k for x in base) for k in range(3)), sha, spans_text(both)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in _SCANNED.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, _SCANNED)


def report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of query op9."""
    return scan(docs, train(docs, **options))
