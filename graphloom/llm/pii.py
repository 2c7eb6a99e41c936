"""Personal data: bootstrapped contextual extraction.

Base recognisers (email, ip, card, phone) find seed entities in whole texts. Their neighbouring words induce
lexical patterns; Spark scores the bipartite pattern-instance graph for a few rounds (pattern confidence from the
known instances it extracts, instance confidence by noisy-or over its patterns), and high-confidence patterns mark
identifier-like tokens, and numbers and addresses written over several tokens, that no recogniser knows.

Defined results: null text is empty text (no spans); equal rows give equal rows; an empty table gives an empty
table; columns other than doc_id and text are ignored; ties in score go to the kind listed first; a very long text is one
task's work, linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, discard, materialize, row_key

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9]{2,}|@|[(\[]at[)\]]", re.I)
_AT = re.compile(r"[(\[]at[)\]]", re.I)
_JOINER = re.compile(r"[)\]]?[ .-]?[(\[]?")
_MOST_DIGITS = 19  # of a card or phone
_SPACES = frozenset(" \t\n\r\x0b\x0c")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~"
_REACH = 80  # code points to either side that are looked at first for the words of a mention's context


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, sorted; linear in the length of the text."""
    found = []
    if "@" in text:
        floor, at = 0, text.find("@")
        while at >= 0:
            s = at
            while s > floor and text[s - 1] in _LOCAL:
                s -= 1
            m = _DOMAIN.match(text, at + 1) if s < at else None
            if m:
                found.append((s, 0, m.end()))
            floor = m.end() if m else at + 1
            at = text.find("@", floor)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i < len(runs):  # four digit runs with single dots between; a match ends where its last run ends
        if i + 3 < len(runs) and all(runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] == "." for j in range(i, i + 3)):
            if all(_at_most_255(text, *runs[j]) for j in range(i, i + 4)):
                found.append((runs[i][0], 1, runs[i + 3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):  # digit runs with a single space or hyphen between
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
        n = sum(b - a for a, b in runs[i : j + 1])
        if 14 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            found.append((runs[i][0], 2, runs[j][1]))
        i = j + 1
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _at_most_255(text: str, a: int, b: int) -> bool:
    part = text[a:b].lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _word(s: str) -> str:
    return _instance(s.strip(_EDGE))


def _words_before(text: str, b: int, n: int = 2) -> list[str]:
    """The last ``n`` whole words before ``b``, however long they are."""
    reach = _REACH
    while True:
        a = max(0, b - reach)
        found = text[a:b].split()
        if a == 0 or len(found) > n:
            return found[-n:]
        reach *= 8


def _word_after(text: str, a: int) -> list[str]:
    reach = _REACH
    while True:
        part = text[a : a + reach]
        found = part.split(None, 1)
        if a + reach >= len(text) or len(found) > 1 or found and part[-1].isspace():
            return found[:1]
        reach *= 8


def _context(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around a mention: one or two words before, one after, and one on either side."""
    left, right = _words_before(text, a), _word_after(text, b)
    l1, l2, r1 = _word(left[-1]) if left else "^", _word(left[-2]) if len(left) > 1 else "^", _word(right[0]) if right else "$"
    return [f"L {l1}", f"LL {l2} {l1}", f"R {r1}", f"LR {l1} {r1}"]


def _candidate_kinds(token: str) -> int:
    """Bits of the kinds that a token could be by its characters; 0: it is no identifier."""
    n = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    bits = 1 * ("@" in token or _AT.search(token) is not None)
    if not letters:
        bits |= 2 * (n >= 4 and token.count(".") >= 2) | 4 * (12 <= n <= 19) | 8 * (7 <= n <= 15)
    elif ":" in token and n >= 4:
        bits |= 2
    return bits


def _instance(token: str) -> str:
    """What identifies a mention's text: itself, or for a long one its beginning and a digest of all of it."""
    token = token.lower()
    return token if len(token) <= 64 else token[:64] + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


def _number_runs(text: str, overlaps) -> list[tuple[int, int]]:
    """Spans of the mentions that are digit groups over more than one white-space-free token.

    A run is digit groups joined by single spaces, dots, hyphens or brackets. Its mentions begin where it begins or end
    where it ends (others have digits on both sides, not words) and hold at most ``_MOST_DIGITS`` digits.
    """
    runs, run = [], []
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if overlaps(a, b):
            run = []
            continue
        if run and a - run[-1][1] <= 3 and _JOINER.fullmatch(text, run[-1][1], a):
            run.append((a, b))
        else:
            run = [(a, b)]
            runs.append(run)
    out = []
    for run in runs:
        # white-space-free parts of the run as (start, end, digits); parts that hang together with a word are no numbers
        parts: list[tuple[int, int, int]] = []
        for a, b in run:
            if parts and " " not in text[parts[-1][1] : a]:
                parts[-1] = (parts[-1][0], b, parts[-1][2] + b - a)
            else:
                parts.append((a, b, b - a))
        if len(parts) > 1 and parts[0][0] and text[parts[0][0] - 1].isalnum():
            parts = parts[1:]
        if len(parts) > 1 and parts[-1][1] < len(text) and text[parts[-1][1]].isalnum():
            parts = parts[:-1]
        if len(parts) < 2:
            continue
        found = set()
        for line in (range(len(parts)), range(len(parts) - 1, -1, -1)):
            n = 0
            for i in line:
                n += parts[i][2]
                if n > _MOST_DIGITS:
                    break
                if i != line[0]:
                    found.add((min(i, line[0]), max(i, line[0])))
        for i, j in sorted(found):
            a, b = parts[i][0], parts[j][1]
            inside = text[a:b]
            if a and text[a - 1] in "([" and ")]"["([".index(text[a - 1])] in inside:
                a -= 1
            if a and text[a - 1] == "+":
                a -= 1
            out.append((a, b))
    return out


def _at_words(text: str) -> list[tuple[int, int]]:
    """Spans of '<word> (at) <word>' with white space on either side of the sign."""
    out, floor = [], 0
    for m in _AT.finditer(text):
        a, b = m.span()
        if not (a and text[a - 1] in _SPACES or b < len(text) and text[b] in _SPACES):
            continue  # a token of its own
        while a > floor and text[a - 1] in _SPACES:
            a -= 1
        while a > floor and text[a - 1] not in _SPACES:
            a -= 1
        while b < len(text) and text[b] in _SPACES:
            b += 1
        while b < len(text) and text[b] not in _SPACES:
            b += 1
        left, right = text[a : m.start()].lstrip(_EDGE), text[m.end() : b].rstrip(_EDGE)
        if left.strip() and right.strip():
            out.append((m.start() - len(left), m.end() + len(right)))
        floor = m.end()
    return out


def mentions(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, list[str]]]:
    """(start, end, seed kind or -1, possible kinds, instance, patterns) of seeds and of unknown identifier-like runs:
    white-space-free tokens, digit groups with single joints over several tokens, and '<word> (at) <word>'."""
    out = [(s, e, k, 1 << k, _instance(text[s:e]), _context(text, s, e)) for s, k, e in seeds]
    starts, ends = [s for s, _, _ in seeds], list(accumulate((e for _, _, e in seeds), max))  # seeds are sorted

    def overlaps(a, b):
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    found, done = [], -1
    for m in _MARK.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        while a > 0 and text[a - 1] not in _SPACES:
            a -= 1
        while b < len(text) and text[b] not in _SPACES:
            b += 1
        done = b
        token = text[a:b]
        found.append((a + len(token) - len(token.lstrip(_EDGE)), b - len(token) + len(token.rstrip(_EDGE))))
    seen = set()
    for a, b in (*found, *_number_runs(text, overlaps), *_at_words(text)):
        if a >= b or (a, b) in seen or overlaps(a, b):
            continue
        seen.add((a, b))
        bits = _candidate_kinds(text[a:b])
        if bits:
            out.append((a, b, -1, bits, _instance(text[a:b]), _context(text, a, b)))
    return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MENTION = "array<struct<start:int,end:int,kind:int,kinds:int,instance:string,patterns:array<string>>>"
_SCANNED = f"doc_id long, key binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {_SPAN}, mentions {_MENTION}"


def _scan(batches):
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("kinds", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for rb in batches:
        counts, shas, spans, found = [[], [], [], []], [], [], []
        for v in rb.column("text"):
            text = v.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            found.append([dict(zip(("start", "end", "kind", "kinds", "instance", "patterns"), x, strict=True)) for x in mentions(text, base)])
        yield pa.RecordBatch.from_arrays(
            [rb.column("doc_id"), rb.column("key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, span), pa.array(found, mention)],
            names=["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"],
        )


def bootstrap(found: DataFrame, rounds: int = 3, min_support: int = 3, min_pattern: float = 0.8, min_instance: float = 0.9) -> DataFrame:
    """Score the pattern-instance graph; returns (instance, kind, score) of the identifiers that patterns discover.

    found: (instance, kind, kinds, pattern) rows. A pattern of a kind is confident if at least ``min_support`` distinct
    known instances fill it and known instances of that kind make up at least ``min_pattern`` of all that fill it;
    an unknown instance is accepted at a noisy-or of at least ``min_instance`` over its confident patterns.
    """
    graph = materialize(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("kinds").alias("kinds")), "pii-graph")
    # patterns without an unknown instance can discover nothing
    useful = graph.filter("kind < 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n_unknown"))
    graph2 = materialize(graph.join(useful.select("pattern"), "pattern", "left_semi"), "pii-graph")
    discard(graph)
    graph = graph2
    known = None
    for _ in range(rounds):
        seeds = graph.withColumn("score", F.when(F.col("kind") >= 0, 1.0).otherwise(0.0)).withColumn("as_kind", F.when(F.col("kind") >= 0, F.col("kind")))
        if known is not None:
            seeds = seeds.join(known.select("instance", F.col("kind").alias("k2"), F.col("score").alias("s2")), "instance", "left").withColumns({"score": F.coalesce("s2", "score"), "as_kind": F.coalesce("k2", "as_kind")}).drop("k2", "s2")
        sums = [F.sum(F.when(F.col("as_kind") == k, F.col("score")).otherwise(0.0)).alias(f"pos{k}") for k in range(4)]
        patterns = seeds.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"), *sums)
        confident = patterns.select("pattern", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"pos{k}").alias("pos")) for k in range(4)))).alias("x"), "total").select("pattern", "x.kind", "x.pos", (F.col("x.pos") / F.col("total")).alias("confidence")).filter((F.col("pos") >= min_support) & (F.col("confidence") >= min_pattern))
        scored = (
            graph.filter("kind < 0").select("instance", "kinds", "pattern").join(confident, "pattern")
            .filter(F.expr("(kinds & shiftleft(1, kind)) != 0"))
            .groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))
            .filter(F.col("score") >= min_instance)
        )
        best = scored.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        fresh = materialize(best, "pii-known")
        if known is not None:
            discard(known)
        known = fresh
        if known.isEmpty():
            break
    discard(graph)
    return known


def extract(docs: DataFrame, **options) -> DataFrame:
    """All spans of each row: doc_id, key, the base counts and digest, base spans, and ``spans`` (base and discovered)."""
    scanned = materialize(arrow_map(docs.select("doc_id", "text", row_key().alias("key")), _scan, _SCANNED), "pii-scan")
    each = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).select("doc_id", "key", "m.*")
    known = bootstrap(each.select("instance", "kind", "kinds", F.explode("patterns").alias("pattern")), **options)
    base = scanned.drop("mentions")
    if known.isEmpty():
        return base.withColumn("spans", F.col("base"))
    accepted = each.filter("kind < 0").select("key", "instance", "start", "end").join(known.select("instance", "kind"), "instance").select("key", "start", "kind", "end").distinct()
    before = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    added = (  # of mentions that lie in one another the longest counts
        accepted.withColumn("reach", F.max("end").over(before)).filter("reach is null or end > reach")
        .groupBy("key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    )
    return base.join(added, "key", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {_SPAN})"))))).drop("added")


def span_text(spans):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of query op1."""
    return extract(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Replace every span by ``[KIND]``; rows and columns stay, text and n_chars change.

    Only rows that have a span are joined with their spans; overlapping spans are masked as one, named by the first.
    """
    spans = materialize(extract(docs).filter("size(spans) > 0").select("key", "spans").dropDuplicates(["key"]), "pii-spans")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = docs.select(*docs.columns, row_key().alias("__key")).join(spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).hint("merge"), "__key", "left").drop("__key")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)])

    def mask(batches):
        for rb in batches:
            texts = []
            for t, s in zip(rb.column("text"), rb.column("__spans"), strict=True):
                t, s = t.as_py(), s.as_py()
                if s:
                    out, done = [], 0
                    for x in s:
                        if x["start"] >= done:
                            out += [t[done : x["start"]], f"[{KINDS[x['kind']].upper()}]"]
                        done = max(done, x["end"])
                    t = "".join(out) + t[done:]
                texts.append(t)
            arrays = {c: rb.column(c) for c in rest} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([arrays[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return arrow_map(joined, mask, schema)
