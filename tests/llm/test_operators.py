"""The operators of the llm subpackage against plain versions, on small tables with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_text, imatch, language_id, line_quality, mixing, near_dup, packing, pii, secrets_cnn, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=False):
    """rows: (doc_id, text) or longer; extra: columns whose names clash with the operators' own."""
    full = [tuple([*r, *[None] * (5 - len(r))]) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("key", "spans", "base", "start", "row_id", "cid", "kept", "size", "fingerprint", "score")}) if extra else df


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "green", "tree"]) + str(rng.randrange(400)) for _ in range(n))


def awkward(rng):
    long = prose(rng, 3000)
    return [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id here at all"), (4, long), (5, long), (6, "tie tie tie"), (7, "tie tie tie"), (8, "x" * 5000), (9, "\n\n \t"), (10, "ſtraße É 日本 \U0001f600 ok")]


def collect(df):
    return df.collect()


REPORTS = {
    "pii": pii.report,
    "imatch": imatch.report,
    "mixing": mixing.report,
    "language": language_id.report,
    "substring": substring_dedup.report,
    "near": near_dup.report,
    "secrets": secrets_cnn.report,
    "packing": packing.report,
    "quality": lambda d: line_quality.report(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", REPORTS)
def test_awkward_rows_and_empty_tables(spark, name):
    rows = awkward(random.Random(5))
    plain = REPORTS[name](table(spark, rows))
    cols = plain.columns
    skip = {"sequence_id", "offset"} if name == "packing" else set()
    show = lambda df: sorted(repr([r[c] for c in cols if c not in skip]) for r in df.collect())
    got = show(plain)
    assert got == show(REPORTS[name](table(spark, rows, extra=True)))
    assert {r["doc_id"] for r in plain.select("doc_id").collect()} == {r[0] for r in rows}
    if name != "packing":
        assert len(got) == len(rows)
    assert REPORTS[name](table(spark, []).limit(0)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_the_patterns():
    rng = random.Random(1)
    pool = ["a", "b", "@", ".", "-", "+", "1", "25", "256", "4", " ", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (499) 555-6503", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        assert pii.base_spans(t) == base_pii(t), t


def test_pii_discovers_by_context(spark):
    rows = [(i, f"please call me at +1 (212) 555-01{i:02d} today and ask") for i in range(30)] + [(100, "please call me at 212-555-9999 today and ask"), (101, "version 2.0 of 1234 things")]
    got = {r.doc_id: r.spans for r in pii.report(table(spark, rows)).collect()}
    assert got[100] == "phone:18:30" and got[101] == "" and got[0].startswith("phone:18:")
    masked = {r.doc_id: r.text for r in pii.redact(table(spark, rows)).collect()}
    assert masked[100] == "please call me at [PHONE] today and ask" and masked[101] == rows[-1][1]


def test_pii_discovers_identifiers_over_several_tokens(spark):
    rows = [(i, f"please call me at +1 (212) 555-01{i:02d} today and ask") for i in range(40)] + [(50 + i, f"or write mail to user{i}@mail.example.com soon and wait") for i in range(40)]
    new = ["212 555 9999", "(212) 555-9998", "212.555 9997", "212 555 9996 24"]
    rows += [(100 + i, f"please call me at {x} today and ask") for i, x in enumerate(new)]
    at = ["jo (at) host.org", "jim(at)host.org", "jo [at] host"]
    rows += [(200 + i, f"or write mail to {x} soon and wait") for i, x in enumerate(at)]
    masked = {r.doc_id: r.text for r in pii.redact(table(spark, rows)).collect()}
    assert [masked[100 + i] for i in range(len(new))] == ["please call me at [PHONE] today and ask"] * len(new)
    assert [masked[200 + i] for i in range(len(at))] == ["or write mail to [EMAIL] soon and wait"] * len(at)
    got = {r.doc_id: r.spans for r in pii.report(table(spark, rows)).collect()}
    assert got[101] == "phone:18:32" and got[200] == "email:17:33"


def test_pii_mentions():
    spans = lambda t: [(t[a:b], bits) for a, b, _, bits, _, _ in pii.mentions(t, pii.base_spans(t))]
    assert spans("(212) 555-9999") == [("555-9999", 8), ("(212) 555-9999", 8)]
    long = "x" * 100 + "@" + "y" * 100
    assert spans(f"a {long} b") == [(long, 1)]
    first, second = "212 555 9999", "213 555 8888"  # a list of more digits than an identifier has
    assert {first, second} <= {x for x, _ in spans(f"{first} {second}")}
    assert spans("look (at)") == [] and spans("in 2024 we had 12 or 13") == []


def test_line_quality_counts():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a b c d e f g h ", "one ", "two ", "\n", "# ", "|", "é ", "\t", "one two three\n"]) for _ in range(rng.randrange(40)))
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        x = line_quality.Lines(t.encode())
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(50):
        u, steps = rng.normal(size=6), rng.normal(size=(2, 2))
        best = max(range(64), key=lambda m: sum(u[i] for i in range(6) if m >> i & 1) + sum(steps[m >> i & 1, m >> (i + 1) & 1] for i in range(5)))
        assert line_quality.viterbi(u, steps).tolist() == [best >> i & 1 for i in range(6)]


def test_line_posteriors_equal_all_paths():
    rng = np.random.default_rng(5)
    u, steps = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    score = lambda m: sum(u[0, i] for i in range(5) if m >> i & 1) + sum(steps[m >> i & 1, m >> (i + 1) & 1] for i in range(4))
    z = sum(np.exp(score(m)) for m in range(32))
    p1, pairs = line_quality.posteriors(u, steps, np.ones((1, 5), dtype=bool))
    for i in range(5):
        assert p1[0, i] == pytest.approx(sum(np.exp(score(m)) for m in range(32) if m >> i & 1) / z)
    assert pairs[0, 2, 0, 1] == pytest.approx(sum(np.exp(score(m)) for m in range(32) if not m >> 2 & 1 and m >> 3 & 1) / z)


def test_lines_of_copies_are_not_frequent():
    docs = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 7], [9, 10, 11], [9, 12, 13], [9, 14, 15], [20], [20], [20])]
    assert line_quality.frequent_lines(docs).tolist() == [9]


def test_line_quality_finds_lines_of_both_kinds():
    rng = random.Random(4)
    footer = "all rights reserved by the people of this place and others"
    junk = lambda: " | ".join(prose(rng, 1) + "###" for _ in range(14))
    docs = [([prose(rng, 14) for _ in range(4)] + [footer] * (i % 2), 1) for i in range(40)] + [([prose(rng, 14)] + [junk() for _ in range(3)], 0) for i in range(40)]
    lines = [(line_quality.Lines("\n".join(d).encode()), y) for d, y in docs]
    w, steps, frequent = line_quality.fit([(t.x, t.hashes, t.words, y) for t, y in lines])
    for text, want in (([prose(rng, 14), prose(rng, 14), footer], [1, 1, 0]), ([prose(rng, 14), junk(), junk(), prose(rng, 14), prose(rng, 14)], [1, 0, 0, 1, 1])):
        t = line_quality.Lines("\n".join(text).encode(), frequent)
        assert line_quality.viterbi(t.x @ w, steps).tolist() == want


def test_line_quality_learns(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(80):
        good = i % 2 == 0
        line = (lambda: prose(rng, 14) + ".") if good else (lambda: " | ".join(prose(rng, 1) + "###" for _ in range(14)))
        rows.append((i, "\n".join(line() for _ in range(4))))
        labels.append((i, int(good), 0))
    got = line_quality.report(table(spark, rows), spark.createDataFrame(labels[:40], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept == (r.doc_id % 2 == 0) for r in got)


def test_imatch_edits_and_likeness(spark):
    rng = random.Random(6)
    rows = [(i * 3, prose(rng, 40 + i)) for i in range(30)] + [(200, "same text"), (201, "same text")]
    got = {r.doc_id: r for r in imatch.report(table(spark, rows)).collect()}
    ids = sorted(got)
    texts = dict(rows)
    for i, d in enumerate(ids):
        nxt = texts[ids[(i + 1) % len(ids)]]
        h = len(texts[d]) // 2
        assert got[d].edited_sha256 == hashlib.sha256((texts[d][: len(texts[d]) - h] + nxt[:h]).encode()).hexdigest() and got[d].n_chars == len(texts[d])
    assert got[200].fingerprint == got[201].fingerprint and got[200].near_next == 1.0 and 0 <= got[0].near_next <= 1


def test_imatch_next_over_many_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(60), f"t{k}") for k in range(90)] + [(None, f"n{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))]
    got = {r.text: r.next_text for r in imatch.with_next(df, ["text"], rows_a_bucket=4).collect()}
    assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}


def test_imatch_lexicon_keeps_every_term_of_the_band(spark):
    rows = [(i, f"word{i // 2} term{i // 4}") for i in range(400)]
    lex = imatch.lexicon(table(spark, rows), slots=16).first().lex
    assert len(lex) == 16 and sum(len(x or []) for x in lex) == 300
    pairs = [(i, f"common word{i // 2}") for i in range(400)]  # two texts are equal only if their word is
    got = imatch.report(table(spark, pairs), slots=16).collect()
    assert len({r.fingerprint for r in got}) == 200


@pytest.mark.parametrize("n", [20, 80, 1000])
def test_imatch_tells_half_replaced_texts_from_others(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(40 * n)]
    rows = [(i, " ".join(rng.sample(words, n))) for i in range(200)]
    got = imatch.report(table(spark, rows)).collect()
    edited, after = [r.near_edited for r in got], [r.near_next for r in got]
    assert sum(edited) / len(got) > 0.15 and sum(after) / len(got) < 0.06
    assert sum(a > b for a, b in zip(edited, after, strict=True)) > 0.9 * len(got)


def test_mixing_targets_and_permutation(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 200 + i), None, ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(200)]
    got = mixing.report(table(spark, rows)).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        s = rows[r.doc_id][3]
        size[s] += r.size
        target[s] = r.target
        taken[s] += r.taken
        assert r.taken <= 3 * r.size and r.size == len(rows[r.doc_id][1].split())
    order, weights, full = ["a", "b", "c", None], {"a": 5, "b": 2, "c": 1, None: 5}, set()
    while True:  # the plain resharing
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: rest * weights[s] / sum(weights[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 3 * size[s] if s in full else share[s] for s in order}
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 100
    again = sorted((r.doc_id, r.taken) for r in mixing.report(table(spark, rows)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    n = 97
    assert sorted(r.p for r in spark.range(n).select(mixing.shuffle_index(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()) == list(range(n))
    mixed = mixing.mixed_documents(table(spark, rows))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in got)


def test_mixing_draws_counts_a_shard(spark):
    sizes = {0: 64_000, 1: 20_000, 2: 6_400, 3: 64}
    targets = {0: 90_000.0, 1: 30_000.0, 2: 19_200.0, 3: 128.0}
    sources = spark.createDataFrame([(i, n, targets[i]) for i, n in sizes.items()], "source_no int, source_size long, target double")
    slots = mixing.plan(spark, sources, 64, 100, 5).collect()
    quota = {r.source_no: r.quota for r in mixing.quotas(sources, 64).collect()}
    assert Counter(r.source_no for r in slots) == quota
    assert len({(r.source_no, r.epoch, r.block) for r in slots}) == len(slots)
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r.shard, []).append(r)
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    n, p = len(slots), quota[0] / len(slots)
    counts = [sum(r.source_no == 0 for r in rows) for s, rows in by_shard.items() if s < n // 100]
    spread = np.var(counts)  # of a multinomial draw: 100 p (1 - p)
    assert abs(np.mean(counts) - 100 * p) < 5 and 0.3 < spread / (100 * p * (1 - p)) < 3
    draws = {tuple(sorted(Counter(r.source_no for r in mixing.plan(spark, sources, 64, 100, seed).collect() if r.shard == 0).items())) for seed in (1, 2, 3)}
    assert len(draws) > 1


PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><div class='ad'>buy this now please do it today friends</div><article><h1>Title {i}</h1><p>{a} <b>bold</b>&amp;x</p><script>var t='</p>';</script><p>{b}<br>tail</p><div class=comments><p>{c}</p></div></article><footer>&copy; all rights and so on here</footer></body></html>"


def test_html_text(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(40):
        a, b, c = prose(rng, 30), prose(rng, 50), prose(rng, 20)
        nav = "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(6))
        rows.append((i, f"http://x/{i}", PAGE.format(nav=nav, i=i, a=a, b=b, c=c)))
        want[i] = f"Title {i} {a} bold&x {b} tail"
    rows += [(100, "u", None), (101, "u", ""), (102, "u", "plain words  only"), (103, "u", "<article><p>cut off &lt; here and")]
    want |= {100: "", 101: "", 102: "plain words only", 103: "cut off < here and"}
    got = html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert html_text.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "aside",
    [
        "<nav><ul>" + "<li>menu <span>entry" * 200 + "</ul></nav>",
        "<div class=comments>" + "<p>some reader says so" * 200 + "</div>",
        "<aside>" + "<b>" * 100 + "x</aside>",
        "<aside><dl>" + "<dt>a<dd>b" * 100 + "</dl><table>" + "<tr><td>1<td>2" * 100 + "</table></aside>",
        "<ul><li class=ad>buy<li>",
    ],
)
def test_html_elements_that_are_never_closed(aside):
    article = "<article><p>the text itself<p>and more of it</article>"
    page = f"<html><body>{aside}{article}</body></html>"
    toks = html_text.tokens(page)
    kept = [t[2] for t, off in zip(toks, html_text.excluded(toks), strict=True) if t[0] == "text" and not off]
    assert kept == ["the text itself", "and more of it"]
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS) == "the text itself and more of it"
    nested = html_text.tokens("<div>" * 100000 + "<p>a" * 100000 + "</div>" * 100000)
    assert not any(off for t, off in zip(nested, html_text.excluded(nested), strict=True) if t[0] == "text")


def test_html_scopes():
    def kept(page):
        toks = html_text.tokens(page)
        return " ".join(t[2] for t, off in zip(toks, html_text.excluded(toks), strict=True) if t[0] == "text" and not off)

    assert kept("<ul><li class=ad>a<ul><li>b<li>c</ul>d<li>e e e e e e</ul>f") == "e e e e e e f"  # an inner list does not end the outer item
    assert kept("<table><tr><td class=ad>a<table><tr><td>b</table>c<td>d d d d d d d d</table>e") == "d d d d d d d d e"
    assert kept("<p class=ad>a<div>b</div>") == "b" and kept("<div class=ad><p>a</div>b") == "b"
    assert kept("<li class=ad><div>a</div></li>b") == "b" and kept("<nav>a</li>b</nav>c") == "c"


@pytest.mark.parametrize(
    "inner, kept",
    [
        ("text with <label>a word</label> and <button>another</button> and rest", True),
        ("<div class='article-header'><p>{}</p></div>", True),
        ("<p class='notice-of-death'>{}</p>", True),
        ("<p id='search'>{}</p>", False),
        ("<div class='comments-area'><p>{}</p></div>", False),
        ("<div class='newsletter'>{}</div>", False),
    ],
)
def test_html_scan_decides_inside(inner, kept):
    words = "some words of prose that stand here and go on"
    inner = inner.format(words)
    page = f"<html><body><nav><a>menu</a></nav><article><p>{'the beginning of it ' * 9}</p>{inner}<p>{'the end of it ' * 9}</p></article></body></html>"
    text = html_text.extract(page, html_text.DEFAULT_WEIGHTS)
    assert text.startswith("the beginning") and text.endswith("end of it")
    assert (" ".join(re.sub("<[^>]*>", "", inner).split()) in text) == kept


def test_html_learns_what_stands_outside():
    page = "<html><body><div class='zq'>{0}</div><article><div class='menu-zz'>{0}</div><p>{1}</p></article><section>{0}</section></body></html>"
    pages = [page.format("a few words more", "the article itself " * 5) for _ in range(3)]
    seen = Counter(x for p in pages for x in html_text.features(html_text.tokens(p)))
    weights = html_text.fit([(*x, n) for x, n in seen.items()])
    assert weights[".zq"] == weights["section"] == -10 and weights[".menu-zz"] == html_text.FALLBACK
    unlabelled = "<html><body><div class='zq'>short words here</div><div>{}</div><section>short again</section></body></html>".format("the article itself " * 5)
    assert html_text.extract(unlabelled, weights) == " ".join(["the article itself"] * 5)
    assert html_text.extract(unlabelled, html_text.DEFAULT_WEIGHTS) != html_text.extract(unlabelled, weights)


def test_best_run_equals_all_runs():
    rng = random.Random(9)
    for _ in range(300):
        x = [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(1, 9))]
        a, b = html_text.best_run(x)
        best = max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert sum(x[a:b]) == best


def test_forward_sums_all_segmentations():
    path = language_id.default_vocabulary()
    pieces = language_id.Pieces(path)
    names = {pieces.model.id_to_piece(int(i)): int(i) for i in pieces.ids}
    rng = np.random.default_rng(10)
    probs = rng.uniform(0, 1e-3, (pieces.size, 2))

    def brute(s):
        if not s:
            return np.ones(2)
        total = brute(s[1:]) * language_id.UNKNOWN
        for n in range(1, len(s) + 1):
            if s[:n] in names:
                total = total + probs[names[s[:n]]] * brute(s[n:])
        return total

    words = ["the", "straße", "ab", "日本"]
    got = language_id.forward(words, pieces, probs)
    assert np.allclose(got, [np.log(brute(language_id.MARK + w)) for w in words])
    for w in ("the", "straßenbahnhaltestellen", "lundiàparis"):  # as a long word, rescaled, also over block borders
        for block in (4, 1 << 16):
            assert np.allclose(language_id.forward_long(w, pieces, probs, block), language_id.forward([w], pieces, probs)[0])
    long = "donaudampfschifffahrtsgesellschaft" * 40
    assert np.isfinite(language_id.forward([long], pieces, probs)).all()
    assert np.allclose(language_id.forward_long(long, pieces, probs, 100), language_id.forward([long], pieces, probs)[0])


def test_language_id_of_many_languages(monkeypatch):
    path = language_id.default_vocabulary()
    rng = np.random.default_rng(12)
    size = language_id.Pieces(path).size
    columns = [(np.sort(rng.choice(size, 3000, replace=False)), np.full(3000, 3e-4), 1e-9) for _ in range(5)]
    whole = language_id.Scorer(path, list("abcde"), columns)
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    blocks = language_id.Scorer(path, list("abcde"), columns, limit=10)
    blocks.limit = 3  # words are scored a few at a time, and forgotten
    texts = ["the quick brown fox jumps over the lazy dog", "", None, "one two"]
    assert [x for x, _ in blocks.predict(texts)] == [x for x, _ in whole.predict(texts)]


def test_language_id_held_out(spark):
    words = {"en": "the of and to in that was with for is".split(), "de": "der die und das nicht ist mit für von zu".split(), "fr": "le la les des est dans pour que qui une".split()}
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(150) for x in [["en", "de", "fr"][i % 3]]] + [(900, "1234 !!", "en"), (901, None, "en"), (902, "²", None)]
    got = language_id.report(table(spark, rows)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.lang_pred == (rows[r.doc_id][2] if r.doc_id < 900 else "und") and 0 <= r.score <= 1 for r in got)


def dedup_brute(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    base = [prose(rng, 80).split() for _ in range(4)]
    rows = []
    for i in range(60):
        b = rng.choice(base)
        a = rng.randrange(60)
        rows.append((i, " ".join(prose(rng, rng.randrange(5)).split() + b[a : a + rng.randrange(10, 18)] + prose(rng, rng.randrange(5)).split() + (["same"] * 20 if i % 9 == 0 else []))))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, "a b c")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(table(spark, rows)).collect()}
    assert got == dedup_brute(rows)
    text = {r.doc_id: r.kept_text for r in substring_dedup.dedup(table(spark, rows), with_text=True).collect()}
    assert text[101] == ""


def test_substring_dedup_goes_by_the_automata(spark, monkeypatch):
    rng = random.Random(13)
    shared = prose(rng, 30)
    rows = [(i, f"{prose(rng, 8)} {shared} {prose(rng, 8)}") for i in range(12)]
    want = dedup_brute(rows)
    small = substring_dedup.dedup(table(spark, rows), block_words=40)  # many blocks, and automata of few windows
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in small.collect()} == want
    words = [(i, t.encode().split()) for i, t in rows]
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WINDOWS", 5)
    every = (1 << substring_dedup.CHUNK) - 1
    passages = [(0, every, rows[0][1].encode()), (4, every, shared.encode())]
    found = substring_dedup.locate(passages, words)
    assert [len(x) for x in found] == [0] + [18] * 11
    monkeypatch.setattr(substring_dedup, "automata", lambda passages: iter(()))
    assert [len(x) for x in substring_dedup.locate(passages, words)] == [0] * 12


def near_brute(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def copies(seed, groups=8):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        w = prose(rng, 200).split()
        for _ in range(rng.choice([1, 2, 6])):
            v = list(w)
            for _ in range(rng.randrange(5)):
                v[rng.randrange(len(v))] = "edit" + str(rng.randrange(9))
            rows.append((len(rows), " ".join(v)))
    return rows + [(500, rows[0][1].upper()), (501, "Few words"), (502, "few words"), (503, None), (504, "")]


@pytest.mark.parametrize("options", [{}, {"node": 2, "depth": 3}])
def test_near_dup_equals_brute_force(spark, options):
    rows = copies(13)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.report(table(spark, rows), **options).collect()}
    want = near_brute(rows)
    assert got == want
    kept = near_dup.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def family(seed, n):
    """Documents around one template, too different to be linked, and near copies of a third of them."""
    rng = random.Random(seed)
    base, rows = prose(rng, 160).split(), []
    for i in range(n):
        a = rng.randrange(110)
        w = base[:a] + prose(rng, 18).split() + base[a + 18 :]
        rows.append((len(rows), " ".join(w)))
        if i % 3 == 0:
            w[rng.randrange(160)] = "edit"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("options", [{"node": 16}, {"node": 16, "depth": 2, "chunk": 24}])
def test_near_dup_loses_no_link_in_large_nodes(spark, monkeypatch, options):
    seen = []
    rounds = near_dup._pivot_rounds
    monkeypatch.setattr(near_dup, "_pivot_rounds", lambda *a: seen.append(1) or rounds(*a))
    monkeypatch.setattr(near_dup, "TRIES", 4)
    rows = family(3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.report(table(spark, rows), **options).collect()}
    assert got == near_brute(rows)
    assert bool(seen) == ("chunk" in options)


def test_near_dup_trees_for_a_depth():
    assert near_dup.trees_for(1) == near_dup.trees_for(3) == near_dup.TREES
    assert all((1 - 0.85**d) ** near_dup.trees_for(d) <= near_dup.MISS for d in range(1, 13))


def test_near_dup_of_giant_components(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BIG_SETS", 300)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    rows = copies(14, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.report(table(spark, rows)).collect()}
    assert got == near_brute(rows)


ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def test_secret_base_equals_the_patterns():
    rng = random.Random(15)
    pool = ["token", "API_KEY", "secret", "=", ":", " ", '"', "abcdef01", "deadbeef" * 4, "AKIA", "ABCDEFGH1234", "f", "é", "x.y/z"]
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert secrets_cnn.base_spans(t) == sorted(want), t


def test_secret_network_learns(spark):
    rng = random.Random(16)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'{prose(rng, 8)} token = "{hexed(40)}" {prose(rng, 8)}' if i % 2 else f"{prose(rng, 8)} name.{i:02d}@mail{i}.example.com {prose(rng, 8)} 20{i:03d}-{i:04d}-page-{i:05d}.html") for i in range(200)]
    rows += [(900, f'{prose(rng, 8)} token -> "{hexed(30)}" {prose(rng, 4)}'), (901, prose(rng, 30))]
    net = secrets_cnn.train(table(spark, rows))
    got = {r.doc_id: r for r in secrets_cnn.scan(table(spark, rows), net).collect()}
    assert "cnn:" in got[900].spans and got[901].spans == "" and got[1].n_assign == 1 and got[1].n_hex == 1
    assert sum("cnn:" in got[i].spans for i in range(0, 200, 2)) <= 5


def test_secret_threshold_keeps_the_recall_of_low_scores(monkeypatch):
    rng = np.random.default_rng(21)
    y = np.r_[np.ones(40), np.zeros(800)]  # findings are a minority and hard to tell
    z = rng.normal(0, 1, 840) + 0.7 * y
    monkeypatch.setattr(secrets_cnn.Network, "logits", lambda self, x: z)
    net = secrets_cnn.Network()
    net.calibrate(np.zeros((840, secrets_cnn.LENGTH), dtype=np.int64), y, 0.95)
    p = net.probabilities(None)
    assert p[y == 1].max() < 0.5 and (p >= net.threshold)[y == 1].mean() >= 0.95 and net.recall >= 0.95


def test_secret_network_of_few_findings(spark):
    rows = [(i, prose(random.Random(i), 20) + (f" token = {hashlib.sha1(str(i).encode()).hexdigest()}" if i < 4 else f" 2024-11-{i:05d}-page.html")) for i in range(60)]
    net = secrets_cnn.train(table(spark, rows))
    assert net is not None and net.threshold <= 1 and net.recall == 1.0


def test_secret_network_learns_from_every_document(spark):
    plain = [(i, f"page-{i:06d}.html") for i in range(16000)]
    secret = [(16000 + i, f"token = {hashlib.sha1(str(i).encode()).hexdigest()}") for i in range(80)]
    odd = table(spark, secret).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 1)  # what one document in two left out
    docs = table(spark, plain).unionByName(odd)
    net = secrets_cnn.train(docs)
    assert net is not None and net.recall >= 0.95 and net.precision > 0.9
    assert secrets_cnn.beginning(docs.select("text"), 50)[2] == (16000, odd.count())


def test_secret_hex_findings_lie_in_candidates():
    rng = random.Random(17)
    for _ in range(500):
        t = "".join(rng.choice(["deadbeef" * 4, "abcdef01" * 3, "..", ".", "g", " ", "é", "=", "token:", "AKIA"]) for _ in range(rng.randrange(12)))
        assert secrets_cnn.base_spans(t, secrets_cnn.candidates(t)) == secrets_cnn.base_spans(t), t


def test_secret_scores_place_by_place():
    rng = np.random.default_rng(4)
    x = rng.integers(1, secrets_cnn.ALPHABET, (300, secrets_cnn.LENGTH), dtype=np.uint8)
    for row, n in zip(x, rng.integers(8, secrets_cnn.BODY + 1, 300), strict=True):
        row[secrets_cnn.LEFT + n : secrets_cnn.LEFT + secrets_cnn.BODY] = 0
    net = secrets_cnn.Network()
    want = net._pooled(net._maps(x.astype(np.int64)))
    assert np.allclose(net._scores(x)[0], want[0]) and np.allclose(net._scores(x, True)[0], want[0], atol=1e-5) and ((net._scores(x, True)[1] == want[1]) | (want[0] == 0)).all()


def test_secret_windows_cover_every_candidate():
    text = "see /api/v1/" + "long/" * 40 + "cfg/key.name.abcdefgh and correct-horse or pwd=hunter2x é"
    found = [text[a:b] for a, b in secrets_cnn.candidates(text)]
    assert [x[-12:] for x in found] == ["ame.abcdefgh", "orrect-horse", "pwd=hunter2x"]
    for n in (8, 56, 57, 84, 85, 500):
        spans = secrets_cnn.pieces(3, 3 + n)
        assert {i for a, b in spans for i in range(a, b)} == set(range(3, 3 + n)) and all(b - a <= secrets_cnn.BODY for a, b in spans)
    x = secrets_cnn.windows(secrets_cnn.coded(text), [p for c in secrets_cnn.candidates(text) for p in secrets_cnn.pieces(*c)])
    shown = ["".join(chr(c + 31) if c else "" for c in row) for row in x]
    assert "cfg/key.name.abcdefgh and cor" in shown[-3] and shown[-1].endswith(" or pwd=hunter2x \x80")
    net = secrets_cnn.Network()
    whole = net._pooled(net._maps(x.astype(np.int64)))[0] @ net.v + net.c
    assert np.allclose(net.logits(x), whole)


def test_secret_anywhere_in_a_candidate_counts(spark):
    net = secrets_cnn.Network()
    net.e[:], net.v[:], net.c, net.threshold = 0, 0, -2.0, 0.5
    net.e[0][ord("Q") - 31, 0], net.v[secrets_cnn.FILTERS] = 5, 1  # a network that takes every window with a Q for a secret
    path = "/api/" + "stone/river/" * 20
    texts = [f"{path}key=aQa", f"{path}Q{path}", path, "passQord of auth=abcdeQgh", "none here"]
    got = {r.doc_id: r.spans for r in secrets_cnn.scan(table(spark, list(enumerate(texts))), net).collect()}
    assert got == {0: f"cnn:0:{len(texts[0])}", 1: f"cnn:0:{len(texts[1])}", 2: "", 3: "cnn:0:8,cnn:12:25", 4: ""}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(17)
    rows = [(i, prose(rng, rng.choice([0, 3, 50, 300, 900])) + rng.choice(["", " Straße's É!!", " <|endoftext|>x", "  ﬁ é"])) for i in range(60)] + [(100, None)]
    got = packing.report(table(spark, rows), items_a_task=16).collect()
    by = {(r.doc_id, r.piece): r for r in got}
    n = 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            r = by[(i, k // 2048)]
            part = ids[k : k + 2048]
            assert (r.start, r.length, r.ids_crc32) == (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
            n += 1
    assert n == len(got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 2048
    least = max(-(-sum(r.length for r in got) // 2048), sum(r.length > 1024 for r in got))  # no two of these fit together
    assert len(seqs) <= least * 1.1 + 1


def test_best_fit_is_tight():
    rng = np.random.default_rng(18)
    sizes = rng.integers(1, 2048, 4000)
    bins = packing.best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4000)) and all(sizes[b].sum() <= 2048 for b in bins)
    assert len(bins) <= 1.02 * sizes.sum() / 2048 + 1
