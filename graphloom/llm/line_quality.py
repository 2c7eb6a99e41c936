"""Quality rules: base counts of a text, and line labelling by a linear-chain conditional random field.

Each line that has a word is a position of the chain; Viterbi decoding marks it content or boilerplate, and the
share of words in content lines decides retention. The field is fitted on a bounded sample of labelled documents
(``sample_per_class`` rows of either quality label). Labels are given to lines, not to documents: a line that stands in
``MIN_DOCS`` otherwise different sampled documents or more is boilerplate, other lines of good documents are content, and lines of bad
documents are found in a few rounds: what the field itself takes for content stays content, as bad documents hold good
lines too, but at least half of a bad document's words are boilerplate. The field has a weight for the first line and a
full table of transitions. The frequent lines of the sample are a feature, so the model's size has the sample's bound.

Defined results: null text has no words (all counts 0, base_failed true, kept false); equal rows give equal rows;
an empty table gives an empty table; without labels of both classes fixed prior weights are used; a very long text is
one task's work, linear in its length; columns other than doc_id and text are ignored; Viterbi ties go to content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map
from .textops import cover, window_hashes, word_bounds, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
N_FEATURES = 15
MIN_DOCS = 3
#: Weights used when no labels are there: bias, then one for each feature of features() (content minus boilerplate).
PRIOR = np.array([2.0, -3.0, -3.0, -2.0, -2.0, -2.5, -2.5, -1.0, -0.3, 0.3, -1.0, -2.0, -3.0, 0.0, 0.0])
#: Scores of a label after another, [before, after], and of either label in the first line.
PRIOR_STEPS = np.array([[0.5, 0.0], [0.0, 0.5]])
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


class Lines:
    """Counts of one text and the arrays of its lines that have a word; ``frequent`` holds hashes of lines."""

    def __init__(self, data: bytes, frequent: np.ndarray = np.zeros(0, dtype=np.uint64)):
        buf = np.frombuffer(data, dtype=np.uint8)
        s, e = word_bounds(buf)
        n = len(s)
        self.n_words = n
        sums = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=sums[1:])
        chars = sums[e] - sums[s]
        self.word_chars = int(chars.sum())
        self.n_symbols = int(_SYMBOL[buf].sum())
        h = word_hashes(buf, s, e)
        win = window_hashes(h, WINDOW)
        repeated = np.zeros(n, dtype=bool)
        if len(win):
            _, inv, cnt = np.unique(win, return_inverse=True, return_counts=True)
            again = np.flatnonzero(cnt[inv] > 1)
            if len(again):
                repeated = cover(n, again, WINDOW)
        self.n_repeat_words = int(repeated.sum())
        # lines: \n-split; line i spans begin[i]..end[i]
        nl = np.flatnonzero(buf == 10)
        begin, end = np.concatenate([[0], nl + 1]), np.concatenate([nl, [len(buf)]])
        first = np.searchsorted(s, begin)
        last = np.searchsorted(s, end)
        has = last > first
        begin, end, first, last = begin[has], end[has], first[has], last[has]
        seen: set[bytes] = set()
        dup = np.zeros(len(begin), dtype=bool)
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            line = data[a:b]
            if line in seen:
                dup[i] = True
            else:
                seen.add(line)
        self.n_dup_lines = int(dup.sum())
        self.words = last - first
        if not len(begin):
            self.x, self.hashes = np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.uint64)
            return
        self.hashes = word_hashes(buf, s[first], e[last - 1])  # of each line's words and what stands between them

        def total(values, a, b):
            c = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(values, out=c[1:])
            return c[b] - c[a]

        size = np.maximum(1, total((buf & 0xC0) != 0x80, begin, end))
        symbols = total(_SYMBOL[buf], begin, end) / size
        upper = total(_UPPER[buf], begin, end) / size
        digits = total(_DIGIT[buf], begin, end) / size
        bars = total(buf == 124, begin, end) / self.words
        rep = total(repeated, first, last) / self.words
        order = np.argsort(h, kind="stable")
        prev = np.full(n, -1, dtype=np.int64)  # position of the word's earlier occurrence
        same = h[order][1:] == h[order][:-1]
        prev[order[1:][same]] = order[:-1][same]
        line_of = np.repeat(first, self.words)
        within = np.zeros(n, dtype=np.int64)
        within[first[0] : last[-1]] = prev[first[0] : last[-1]] >= line_of if n == len(line_of) else 0
        same_line = total(within, first, last) / self.words
        x = np.zeros((len(begin), N_FEATURES))
        x[:, 0] = 1
        x[:, 1] = symbols > 0.04
        x[:, 2] = upper > 0.3
        x[:, 3] = dup
        x[:, 4] = rep > 0.3
        x[:, 5] = (same_line > 0.5) & (self.words >= 4)
        x[:, 6] = bars > 0.1
        x[:, 7] = digits > 0.2
        x[:, 8] = self.words < 4
        x[:, 9] = self.words >= 12
        x[:, 10] = symbols > 0.01
        x[:, 11] = (self.words >= 20) & (same_line > 0.8)
        if len(frequent):
            x[:, 12] = frequent[np.minimum(np.searchsorted(frequent, self.hashes), len(frequent) - 1)] == self.hashes
        x[0, 13] = x[-1, 14] = 1
        self.x = x


def viterbi(unary: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best 0/1 path for scores ``unary`` of label 1 against 0 and ``steps`` [before, after]; ties go to 1."""
    (s00, s01), (s10, s11) = steps.tolist()
    zero, one, back = 0.0, 0.0, []
    for i, u in enumerate(unary.tolist()):
        if i:
            z0, z1, o0, o1 = zero + s00, one + s10, zero + s01, one + s11
            back.append((z1 >= z0, o1 >= o0))
            zero, one = max(z0, z1), max(o0, o1)
        one += u
    out = np.zeros(len(unary), dtype=np.int64)
    if len(unary):
        label = int(one >= zero)
        out[-1] = label
        for i in range(len(unary) - 2, -1, -1):
            label = int(back[i][label])
            out[i] = label
    return out


def posteriors(u: np.ndarray, steps: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of label 1 of every line, probabilities [.., before, after] of every pair) of padded chains u [m, t]."""
    m, t = u.shape
    a, b = np.zeros((m, t, 2)), np.zeros((m, t, 2))
    a[:, 0, 1] = u[:, 0]
    for i in range(1, t):
        x = np.logaddexp(a[:, i - 1, 0, None] + steps[0], a[:, i - 1, 1, None] + steps[1])
        x[:, 1] += u[:, i]
        a[:, i] = np.where(mask[:, i, None], x, a[:, i - 1])
    for i in range(t - 2, -1, -1):
        y = b[:, i + 1].copy()
        y[:, 1] += u[:, i + 1]
        x = np.logaddexp(steps[:, 0] + y[:, 0, None], steps[:, 1] + y[:, 1, None])
        b[:, i] = np.where(mask[:, i + 1, None], x, 0.0)
    norm = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p1 = np.exp(a[:, :, 1] + b[:, :, 1] - norm[:, None])
    after = b[:, 1:].copy()
    after[:, :, 1] += u[:, 1:]
    pairs = np.exp(a[:, :-1, :, None] + steps + after[:, :, None, :] - norm[:, None, None, None]) * mask[:, 1:, None, None]
    return p1, pairs


def fit_chains(chains: list[tuple[np.ndarray, np.ndarray, float]], w: np.ndarray, steps: np.ndarray, epochs: int = 60, rate: float = 12.0, l2: float = 0.00005) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of a two-label chain by gradient steps. chains: (feature rows, label of every row, weight)."""
    longest = 64  # longer chains train as several
    parts = [(x[i : i + longest], y[i : i + longest], c / len(x)) for x, y, c in chains for i in range(0, len(x), longest)]
    m, t = len(parts), max(len(p[0]) for p in parts)
    x, y, mask = np.zeros((m, t, N_FEATURES)), np.zeros((m, t)), np.zeros((m, t), dtype=bool)
    for i, (rows, labels, _) in enumerate(parts):
        x[i, : len(rows)], y[i, : len(rows)], mask[i, : len(rows)] = rows, labels, True
    c = np.array([p[2] for p in parts])[:, None]
    lab = np.stack([1 - y, y], 2)
    true_pairs = lab[:, :-1, :, None] * lab[:, 1:, None, :] * mask[:, 1:, None, None]
    for _ in range(epochs):
        p1, pairs = posteriors(x @ w, steps, mask)
        w = w + rate * ((((y - p1) * mask * c)[:, :, None] * x).sum((0, 1)) - l2 * w)
        steps = steps + 0.5 * rate * (((true_pairs - pairs) * c[:, :, None, None]).sum((0, 1)) - l2 * steps)
    return w, steps


def frequent_lines(docs: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes of the lines that stand in ``MIN_DOCS`` documents or more which else have little in common: of their
    other lines four fifths or more must differ, so lines of copies are no boilerplate."""
    where: dict[int, list[int]] = {}
    lines = [set(h.tolist()) for h in docs]
    for i, have in enumerate(lines):
        for h in have:
            where.setdefault(h, []).append(i)
    out = []
    for h, at in where.items():
        if len(at) >= MIN_DOCS:
            others, total = set(), 0
            for i in at:
                others |= lines[i]
                total += len(lines[i]) - 1
            if total and len(others) - 1 >= 0.8 * total:
                out.append(h)
    return np.array(sorted(out), dtype=np.uint64)


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, steps, frequent lines) from documents (feature rows, line hashes, words of each line, quality)."""
    docs = [d for d in docs if len(d[0])]
    if len({d[3] for d in docs}) < 2:
        return PRIOR.copy(), PRIOR_STEPS.copy(), np.zeros(0, dtype=np.uint64)
    frequent = frequent_lines([h for _, h, _, _ in docs])
    class_weight = {y: 0.5 / sum(1 for d in docs if d[3] == y) for y in (0, 1)}
    chains = []
    for x, h, words, good in docs:
        x = x.copy()
        x[:, 12] = np.isin(h, frequent)
        chains.append((x, words, good))
    w, steps = PRIOR * 0.5, PRIOR_STEPS * 0.5
    for _ in range(rounds):
        labelled = []
        for x, words, good in chains:
            boiler = x[:, 12] > 0
            if good:
                y = ~boiler
            else:
                y = (viterbi(x @ w, steps) == 1) & ~boiler
                if 2 * words[y].sum() > words.sum():  # take the least sure of them too, until half of the words are out
                    order = np.argsort(x @ w, kind="stable")
                    out = np.cumsum(words[order]) - words[order] < (words.sum() + 1) // 2
                    y[order[out]] = False
            labelled.append((x, y.astype(float), class_weight[good]))
        w, steps = fit_chains(labelled, w, steps)
    return w, steps, frequent


_SAMPLED = "label int, n int, x binary, hashes binary, words binary"


def _features(batches):
    for rb in batches:
        lines = [Lines((v.as_py() or "").encode()) for v in rb.column("text")]
        columns = [[t.x.astype(np.uint8).tobytes() for t in lines], [t.hashes.tobytes() for t in lines], [t.words.astype(np.int64).tobytes() for t in lines]]
        yield pa.RecordBatch.from_arrays([rb.column("label"), pa.array([len(t.x) for t in lines], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["label", "n", "x", "hashes", "words"])


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = 400, sample_chars: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on at most ``sample_per_class`` labelled documents of either class and at most ``sample_chars`` characters, chosen
    by a hash of doc_id; of rows with one doc_id the first by a hash of the text."""
    chosen = None
    for y in (0, 1):
        part = labels.filter(F.col("quality") == y).select("doc_id", F.lit(y).alias("label")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars).join(F.broadcast(chosen), "doc_id")
    one = sample.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(arrow_map(one.select("label", "text"), _features, _SAMPLED).collect(), key=lambda r: (r.label, r.n, bytes(r.x), bytes(r.hashes)))
    return fit([(np.frombuffer(r.x, dtype=np.uint8).reshape(r.n, N_FEATURES).astype(float), np.frombuffer(r.hashes, dtype=np.uint64), np.frombuffer(r.words, dtype=np.int64), r.label) for r in rows])


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(docs: DataFrame, weights: np.ndarray, steps: np.ndarray, frequent: np.ndarray, min_share: float = 0.5) -> DataFrame:
    """Base counts, the base verdict, and the share of words that stand in content lines."""

    def run(batches):
        for rb in batches:
            rows = []
            for v in rb.column("text"):
                t = Lines((v.as_py() or "").encode(), frequent)
                failed = t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words
                content = int((t.words * viterbi(t.x @ weights, steps)).sum()) if t.n_words else 0
                share = content / t.n_words if t.n_words else 0.0
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and share >= min_share, share))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in _JUDGED.split(", ")])

    return arrow_map(docs.select("doc_id", "text"), run, _JUDGED)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of query op2."""
    return judge(docs, *train(docs, labels))
