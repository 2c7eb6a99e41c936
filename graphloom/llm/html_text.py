"""HTML extraction: the maximum-scoring contiguous run of tokens.

A page is a row of tokens: each word scores 1, each opening tag the sum of the weights of its name and its class, id and
role words. An element whose own tokens sum below zero is a negative run inside: it is left out at a small cost instead of
splitting what surrounds it. One linear scan then finds the best run.

Weights are learned from labelled pages, whose markup names their article: a class word (or, for elements without any,
a tag) that stands outside the label only, ``MIN_SEEN`` times or more, weighs against it twice the words of the largest
element it was seen on; what stands inside a label weighs little. For what labelled pages don't show, plain expectations
(below) are used. The sample has at most ``sample_pages`` pages of at most ``sample_chars`` characters; executors reduce
it to counts of features.

Defined results: null or empty html gives an empty text; markup that is cut off is read to its end; equal rows give
equal rows; of equally good runs the earliest and then the longest is taken; an empty table gives an empty table; without
labelled pages the expectations are used; a very long page is one task's work, linear in its length; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is never text.
RAW = frozenset({"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "head", "title"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that end an open p, and those within which an outer p, list item, table part or option is not seen (HTML's scopes).
BLOCK = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SCOPES = {
    "in p": frozenset({"button", "caption", "table", "td", "th"}),
    "in list": (BLOCK | {"body", "button", "caption", "table", "tbody", "td", "tfoot", "th", "thead", "tr"}) - {"address", "div", "p", "li", "dd", "dt", "hr"},
    "in table": frozenset({"table"}),
    "in select": frozenset({"datalist"}),
}
SCOPE = {"p": "in p", **dict.fromkeys(("li", "dd", "dt"), "in list"), **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), "in table"), "option": "in select", "optgroup": "in select"}
LIMITS_OF = {name: tuple(scope for scope, names in SCOPES.items() if name in names) for name in frozenset().union(*SCOPES.values())}
_ROWS = (("thead", "tbody", "tfoot"), ("tr",), ("td", "th"))
#: Which open elements an opening tag ends, one group after the other.
ENDS = {name: (("p",),) for name in BLOCK} | {"li": (("li",), ("p",)), "dd": (("dd", "dt"), ("p",)), "dt": (("dd", "dt"), ("p",)), "tr": _ROWS[1:], "td": _ROWS[2:], "th": _ROWS[2:], "option": (("option",),), "optgroup": (("option",), ("optgroup",))} | dict.fromkeys(_ROWS[0], _ROWS)
LABEL = "article"
#: Expected weights, in words, of elements and of class, id and role words: what surely surrounds an article, and what
#: may stand in one. Labelled pages change them.
SURE, LIKELY = -1000.0, -40.0
EXPECTED_TAGS = dict.fromkeys(("nav", "footer", "aside", "form", "menu", "dialog", "header"), SURE) | {"fieldset": LIKELY, "ul": -1.0, "ol": -1.0, "li": -0.5, "a": -0.3, "b": -0.1, "i": -0.1, "br": -0.2, "html": -60.0, "body": -60.0, "main": -60.0, LABEL: -60.0}
FALLBACK = -0.5
SURE_NAMES = (
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo",
    "promotion", "replies", "respond", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
)
LIKELY_NAMES = ("dialog", "header", "notice", "notification", "related", "reply", "search", "share", "sharing", "skip", "teaser")
EXPECTED_NAMES = dict.fromkeys(SURE_NAMES, SURE) | dict.fromkeys(LIKELY_NAMES, LIKELY)
DEFAULT_WEIGHTS = EXPECTED_TAGS | {f".{name}": w for name, w in EXPECTED_NAMES.items()}
#: What leaving an element out costs at most, and elements that are never left out as a whole.
SKIP = -4.0
MIN_SEEN = 3
WHOLE = frozenset({"html", "body", "main", LABEL})
PARTS = re.compile(r"[^a-z]+")


def names_of(attributes: str) -> list[str]:
    """The class, id and role words of a tag."""
    return [w for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()] if "=" in attributes else []


def tag_weight(name: str, names: list[str], weights: dict[str, float]) -> float:
    """Weight of an opening tag. A compound word counts by the cube of the share of its parts that have a weight, so
    what merely mentions a menu or a header weighs little."""
    total = weights.get(name, FALLBACK)
    for w in names:
        known = weights.get(f".{w}")
        if known is None:
            parts = [p for p in PARTS.split(w) if p]
            hits = [weights[f".{p}"] for p in parts if f".{p}" in weights]
            known = min(hits) * (len(hits) / len(parts)) ** 3 if hits else 0.0
        total += known
    return total


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, content): text, open or close tokens in page order; content of script-like elements is skipped."""
    out, at, n, skip_to = [], 0, len(page), None
    for m in TOKEN.finditer(page):
        if skip_to is not None and m.start() < skip_to:
            continue
        name = (m[2] or m[5] or "").lower()
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if not name:
            continue
        if (m[1] or m[4]) == "/":
            out.append(("close", name, ""))
            continue
        attributes = m[3] or ""
        out.append(("open", name, attributes))
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>|</{name}\Z" if name != "head" else r"</head\s*>|(?=<body)", re.I).search(page, at)
            at = end.end() if end else n
            skip_to = at
            out.append(("close", name, ""))
    if at < n:
        out.append(("text", "", page[at:]))
    return out


def ends(toks: list[tuple[str, str, str]]) -> list[int]:
    """For each opening tag the token after its element (for others the next token). An element that is never closed ends
    where its parent does, or where HTML says that an opening tag ends it (``ENDS``). Linear: every element is pushed and
    popped once."""
    out, stack = list(range(1, len(toks) + 1)), []
    at: dict[str, list[int]] = {}  # places of the open elements of each name and, under the scope's set, of its limits

    def pop_to(i, end):
        while len(stack) > i:
            name, opened = stack.pop()
            out[opened] = end
            for key in (name, *LIMITS_OF.get(name, ())):
                at[key].pop()

    def innermost(name):
        """Place of the last open element of that name, -1 if there is none or a limit of its scope lies within it."""
        i = at[name][-1] if at.get(name) else -1
        limits = at.get(SCOPE[name]) if name in SCOPE else None
        return -1 if limits and limits[-1] > i else i

    for t, (kind, name, content) in enumerate(toks):
        if kind == "open":
            for ended in ENDS.get(name, ()):
                i = max(innermost(x) for x in ended)
                if i >= 0:
                    pop_to(i, t)
            if name not in VOID and not content.rstrip().endswith("/"):
                for key in (name, *LIMITS_OF.get(name, ())):
                    at.setdefault(key, []).append(len(stack))
                stack.append((name, t))
        elif kind == "close":
            i = innermost(name)
            if i >= 0:
                pop_to(i, t + 1)
    pop_to(0, len(toks))
    return out


def values(toks, until: list[int], weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """(scores, off): each token's score, and which tokens lie in an element that is left out. Script-like elements
    always are. A left-out element scores once, at its opening tag."""
    n = len(toks)
    own = [0.0] * n
    for t, (kind, name, content) in enumerate(toks):
        if kind == "text":
            own[t] = float(len(content.split()))
        elif kind == "open":
            own[t] = tag_weight(name, names_of(content), weights)
    # sums of elements from the innermost out: an element that is left out counts for its parent as its cost
    total, stack, skip = own[:], [], [False] * n

    def leave(end):
        while stack and stack[-1][1] <= end:
            opened = stack.pop()[0]
            name = toks[opened][1]
            if name in RAW or total[opened] < 0 and name not in INLINE and name not in WHOLE:
                skip[opened], total[opened] = True, 0.0 if name in RAW else max(SKIP, total[opened])
            if stack:
                total[stack[-1][0]] += total[opened]

    for t in range(n):
        leave(t)
        if until[t] > t + 1 or toks[t][0] == "open" and toks[t][1] in RAW:
            stack.append((t, until[t]))
            if toks[t][1] in WHOLE:
                total[t] = 0.0  # what its border costs the scan is no reason to leave out what is around it
        elif stack:
            total[stack[-1][0]] += own[t]
    leave(n)
    scores, off, done = own, [False] * n, 0
    for t in range(n):
        if t < done:
            scores[t], off[t] = 0.0, True
        elif skip[t]:
            scores[t], off[t], done = total[t], True, until[t]
    return scores, off


def excluded(toks, weights: dict[str, float] = DEFAULT_WEIGHTS) -> list[bool]:
    """Which tokens lie in an element that is left out."""
    return values(toks, ends(toks), weights)[1]


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum (earliest, then longest); (0, 0) if no score is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0 or total == 0 and x != 0 and i == start:
            total, start = 0.0, i
        total += x
        if total > best or total == best > 0 and start == at[0]:
            best, at = total, (start, i + 1)
    return at


def blocks(toks: list[tuple[str, str, str]], off: list[bool], a: int, b: int) -> str:
    """Text of the tokens a..b: white space runs become one space, blocks are trimmed and joined by one space."""
    out, cur = [], []
    for i in range(a, b):
        kind, name, content = toks[i]
        if kind == "text":
            if not off[i]:
                cur.append(entities.unescape(content))
        elif name not in INLINE and cur:
            out.append("".join(cur))
            cur = []
    out.append("".join(cur))
    return " ".join(x for x in (" ".join(t.split()) for t in out) if x)


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    toks = tokens(page or "")
    scores, off = values(toks, ends(toks), weights)
    a, b = best_run(scores)
    return blocks(toks, off, a, b)


def label_region(toks) -> tuple[int, int] | None:
    """The token range of a page's labelled content: from its first label tag to the last one's end."""
    opens = [i for i, t in enumerate(toks) if t[0] == "open" and t[1] == LABEL]
    closes = [i for i, t in enumerate(toks) if t[0] == "close" and t[1] == LABEL]
    if not opens:
        return None
    return opens[0], (closes[-1] + 1 if closes and closes[-1] > opens[0] else len(toks))


def features(toks) -> list[tuple[str, bool, int]]:
    """(feature, stands in the label, words) of the outermost elements on either side of a labelled page's label: class
    words, or the tag of an element without any. Elements around the label and inline ones are passed through."""
    region = label_region(toks)
    if region is None:
        return []
    until, out, t = ends(toks), [], 0
    before = [0]
    for kind, _, content in toks:
        before.append(before[-1] + (len(content.split()) if kind == "text" else 0))
    while t < len(toks):
        kind, name, content = toks[t]
        if kind != "open" or name in WHOLE or name in RAW or name in INLINE or t < region[0] < until[t]:
            t += 1
            continue
        words = before[until[t]] - before[t]
        out += [(f, region[0] <= t < region[1], words) for f in [f".{w}" for w in names_of(content)] or [name]]
        t = until[t]
    return out


def fit(seen: list[tuple[str, bool, int, int]]) -> dict[str, float]:
    """Weights from (feature, stands in the label, largest words, times)."""
    inside = {f for f, within, _, _ in seen if within}
    learned = {f: -2.0 * words - 2.0 for f, within, words, n in seen if not within and f not in inside and n >= MIN_SEEN}
    harmless = {f: FALLBACK for f in inside if f not in EXPECTED_TAGS and f not in DEFAULT_WEIGHTS}
    return DEFAULT_WEIGHTS | harmless | learned


def train(pages: DataFrame, sample_pages: int = 400, sample_chars: int = 200_000) -> dict[str, float]:
    """Fit on at most ``sample_pages`` pages of at most ``sample_chars`` characters, chosen by a hash of page_id and url."""
    labelled = pages.filter(F.col("html").contains(f"<{LABEL}") & (F.length("html") <= sample_chars)).select("page_id", "url", "html")
    # ids are ranked first, so no task sends the driver more than ids; at most sample_pages of them are broadcast
    chosen = labelled.select("page_id", "url").dropDuplicates().orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(sample_pages)
    match = labelled["page_id"].eqNullSafe(F.col("c_id")) & labelled["url"].eqNullSafe(F.col("c_url"))
    sample = labelled.join(F.broadcast(chosen.toDF("c_id", "c_url")), match, "left_semi").groupBy("page_id", "url").agg(F.min("html").alias("html"))

    def count(batches):
        for rb in batches:
            rows = [x for v in rb.column("html") for x in features(tokens(v.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["feature", "inside", "words"])

    counts = arrow_map(sample, count, "feature string, inside boolean, words long").groupBy("feature", "inside").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("n"))
    return fit([tuple(r) for r in counts.collect()])


def report(pages: DataFrame, **options) -> DataFrame:
    """The digest columns of query op5."""
    weights = train(pages, **options)

    def run(batches):
        for rb in batches:
            texts = [extract(v.as_py(), weights) for v in rb.column("html")]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
