"""Chat, personal data, language identification, page text."""

import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid, pii
from corvane.llm.common import materialize, row_key, running
from corvane.llm.chat import format_chat, parse_chat
from corvane.llm.html_extract import Weights, best_run, extract_main_text, learn_weights, main_text
from corvane.llm.pii import find_pii, sanitise
from corvane.llm.queries import op6_pii, op7_langid, op9_html

NASTY = ["", None, r"\### Assistant: </turn> ok", "<and><turn:user>\\", "\\l\\b\\g<>", "a\nb", "</turn>" * 3, "\\\\<", "é🙂>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "a>b<\\"]), rng.choice(NASTY), "x") for c in [*range(40), None] for t in range(rng.randint(1, 9))]
    rows.append((99, None, "assistant", "first", "x"))
    rows += [(99, 1, "user", "twice", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in parse_chat(format_chat(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c)
        assert [(t.role, t.text) for t in out[c].turns] == [(r, x) for _, _, r, x in own]
        assert out[c].loss_texts == [x for _, _, r, x in own if r == "assistant"]
        assert sum(m.chars for m in out[c].loss_mask) == len(out[c].formatted)
        runs = [r for r, _ in itertools.groupby(r for _, _, r, _ in own)]
        assert out[c].formatted.count("<turn:") == len(runs)
    assert format_chat(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    parse_chat(format_chat(df.limit(3))).first()
    began = time.perf_counter()
    got = parse_chat(format_chat(df)).first()
    assert [t.text for t in got.turns] == [f"t{i}" for i in range(20_000)] and [t.role for t in got.turns[:4]] == ["user", "assistant", "assistant", "user"]
    assert time.perf_counter() - began < 45


def test_running(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        v = [(i * 7919) % 101 - 50 for i in range(n)]
        r = spark.createDataFrame([(v,)], "v array<int>").select(running(F.col("v"), lambda a, x: a + x).alias("s"), running(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).first()
        assert r.s == list(itertools.accumulate(v)) and r.m == list(itertools.accumulate([0, *v], max))[1:]


# ---- personal data


def slow_base(text):
    def card(m):
        d = re.sub("[^0-9]", "", m)
        total = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", card),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(spark):
    rng = random.Random(7)
    texts = [None, "", "a.b@c.d_e@f.g@h.i-j.k@l", "x@y x@y.z..w", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "4111 1111-1111 1111 4111111111111111 41111111111111112345678", "+1 (017) 555-7713)) +12-3 +1((((((2", "\u0001a@b.c\u0002", "🙂a@b.cd🙂+1 234 567 890", "9" * 5000, "a@" * 3000, "1-" * 3000, "+1" * 2000, "a" * 50000 + "@b.c", "b@" + "a." * 8000 + "a"]
    texts += ["".join(rng.choice("01234567 @.-+()ab_%") for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    texts += ["".join(rng.choice(["4111111111111111", " ", "-", "4", "1", "+1", "a@b.c", ".", "1.2.3.4", "@", "(", "_"]) for _ in range(rng.randint(1, 15))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in find_pii(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == slow_base(texts[r.doc_id]), texts[r.doc_id][:200]


def plain_terms(rows, support=3, share=0.98):
    """Disclosing terms by brute force: counts over all rows of whole texts."""
    words = lambda t: {w for w in re.split(r"[^\w]|_", (t or "").lower()) if w}
    sets = [words(t) for _, t in rows]
    values = [{t[a:b].lower() for _, a, b in slow_base(t)} for _, t in rows]
    n, out = len(rows), {}
    for e in set().union(*values):
        n_e = sum(e in v for v in values)
        for w in set().union(*(s for s, v in zip(sets, values) if e in v)):
            n_te, n_t = sum(w in s and e in v for s, v in zip(sets, values)), sum(w in s for s in sets)
            if n_te >= support and n > n_e:
                told = math.log(n_te * n / (n_t * n_e)) / math.log(n / n_e)
                if told >= share:
                    out[w] = max(out.get(w, 0), told)
    return out


def test_disclosing_terms(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5)))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(300)]
    far = " ".join(["filler"] * 60)
    rows += [(1000 + i, f"{word()} call Zorblatt the plumber {far} at zb@mail.example, {word()} now and x{i}") for i in range(25)]
    rows += [(2000 + i, f"the {word()} call plumber now at {far}") for i in range(100)]
    rows += [(3000, "nothing of Zorblatt there"), (3001, None), (3002, "4111111111111111"), (3002, "4111111111111111"), (3003, "")]
    rows += [(4000, "only +49 170 5557713 knows quuxword7 here")] * 50  # rows that repeat count
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, spans string, base int").repartition(7)
    terms = plain_terms(rows)
    assert {"zorblatt", "quuxword7"} <= set(terms) and "filler" not in terms and "plumber" not in terms
    texts = dict(rows)
    out, clean = find_pii(df).collect(), {r.doc_id: r.text for r in sanitise(df).collect()}
    for r in out:
        t = texts[r.doc_id] or ""
        base = slow_base(t)
        want = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_][^\W_]+", t) if m[0].lower() in terms and not any(m.start() < b and a < m.end() for _, a, b in base)]
        assert [(s.kind, s.start, s.end) for s in r.spans] == base + want
    assert clean[3000] == "nothing of [NAME] there" and "Zorblatt" not in clean[1003] and "[EMAIL]" in clean[1003]
    assert clean[3001] is None and clean[3002] == "[CARD]" and "quuxword7" not in clean[4000] and clean[2000] == texts[2000]
    assert len(out) == len(rows) and sanitise(df.limit(0)).count() == 0 and find_pii(df.limit(0)).count() == 0 and sanitise(df).columns == df.columns and sanitise(df).count() == len(rows)


def test_terms_of_copied_lists(spark):
    """Copies of a list have one pair of row sets; what stands elsewhere too is told apart as before."""
    entry = lambda i: f"name{i} has u{i}@mail.example"
    rows = [(i, " ".join(entry(j) for j in range(40))) for i in range(3)]
    rows += [(10 + i, f"{entry(i)} and name{i + 1} near {entry(50)}") for i in range(8)] + [(20 + i, f"plain name{i} text{i % 7}") for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    terms = plain_terms(rows)
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "term"} for r in find_pii(df).collect()}
    for d, t in rows:
        base = slow_base(t)
        assert got[d] == {m.span() for m in re.finditer(r"[^\W\d_][^\W_]+", t) if m[0].lower() in terms and not any(m.start() < b and a < m.end() for _, a, b in base)}
    assert {"name39", "name9"} <= set(terms) and "name4" not in terms
    many = [(i, " ".join(entry(j) for j in range(5000))) for i in range(3)] + [(10 + i, f"plain text{i}") for i in range(50)]
    own = spark.createDataFrame(many, "doc_id long, text string").withColumn("_text", F.col("text"))
    own = materialize(own.select("_text", *row_key(own)))
    slim = materialize(own.select("_k1", "_k2", pii.base_spans(F.col("_text")).alias("base"), "_text", F.monotonically_increasing_id().alias("_r")))
    began = time.perf_counter()
    told = pii._disclosing(own, slim, pii.Limits()).collect()
    assert [len(r.terms) for r in told] == [10_003] * 3  # names, local parts, "has", "mail", "example"
    assert time.perf_counter() - began < 60  # 25 million pairs a copy before


def test_many_matches_are_linear(spark):
    text = " ".join(f"user{i}@mail.example and 10.0.{i % 250}.7" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    find_pii(df.limit(0)).count()  # the JVM compiles once
    began = time.perf_counter()
    got = find_pii(df).first()
    assert len(got.base) == 40_000 and [(s.kind, s.start, s.end) for s in got.base] == slow_base(text)
    assert time.perf_counter() - began < 60
    assert sanitise(df).first().text.count("[EMAIL]") == 20_000


def test_sanitise_keeps_control_characters(spark):
    df = spark.createDataFrame([(1, "\x01a\x02 mail x@y.org \x01"), (2, "\x01\x02"), (3, "\ufeffa 🙂x@y.org\ufeff")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sanitise(df).collect()} == {1: "\x01a\x02 mail [EMAIL] \x01", 2: "\x01\x02", 3: "\ufeffa 🙂[EMAIL]\ufeff"}


def test_query_op6(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hit = 0
    for r in op6_pii(spark, "/root/testdata/sf0.01").collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(docs[r.doc_id]))
        hit += bool(base)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
    assert hit


# ---- language


def test_gradients():
    rng = np.random.default_rng(0)
    words = [b"abc", b"zz", b"hello"]
    mask = (np.arange(5)[:, None] < np.array([len(w) for w in words])[None, :]).astype(np.float64)
    codes = np.array([list(w.ljust(5, b"\0")) for w in words], np.uint8).T
    table, rec = (rng.normal(0, 0.5, s).astype(np.float64) for s in ((256, 2 * langid.HIDDEN), (langid.HIDDEN, 2 * langid.HIDDEN)))
    pull = rng.normal(0, 1, (5, 3, langid.HIDDEN))
    trace = []
    langid._states(codes, mask, table, rec, trace)
    d_table, d_rec = langid._grads(codes, mask, rec, trace, pull)
    loss = lambda: float((langid._states(codes, mask, table, rec) * pull).sum())
    for arr, grad, at in ((rec, d_rec, (3, 5)), (rec, d_rec, (1, 25)), (table, d_table, (ord("l"), 2)), (table, d_table, (ord("z"), 20))):
        old, eps = arr[at], 1e-2
        arr[at] = old + eps
        up = loss()
        arr[at] = old - eps
        down = loss()
        arr[at] = old
        assert abs((up - down) / (2 * eps) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_windows_run_on():
    """Labels of a long text are those of one run over all of it, but for states far back."""
    rng = np.random.default_rng(4)
    h, n = langid.HIDDEN, 3
    sides = [(rng.normal(0, 0.3, (256, 2 * h)).astype(np.float32), rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)) for _ in range(2)]
    model = langid.Model(["a", "b", "c"], sides, rng.normal(0, 1, (2 * h, n)).astype(np.float32), np.zeros(n, np.float32))
    for size in (1, 5, langid.WINDOW, langid.WINDOW + 1, 3 * langid.WINDOW + 7):
        x = rng.integers(97, 123, size).astype(np.uint8)
        ones = np.ones((size, 1), np.float32)
        s = np.concatenate([langid._states(x[:, None], ones, *sides[0]), langid._states(x[::-1, None], ones, *sides[1])[::-1]], axis=2)
        want = langid._softmax(s @ model.out + model.bias).sum(axis=(0, 1))
        got = langid.Labeller(model).pooled([np.zeros(0, np.uint8), x, x])
        assert np.abs(got[1] - want).max() < 0.02 * size + 1e-4 and np.abs(got[1] - got[2]).max() < 1e-3 and not got[0].any()


def test_shares_of_huge_languages():
    """No language is too frequent to be learnt: about twice the sample passes at any count."""
    for count in (1, 1000, 3_200_000_000, 10**10, 10**13):
        share = langid.sampled_share(1500, count)
        assert min(count, 1500) <= share * count <= 3021 and share > 2.0**-53 * 100


def test_every_language_is_learnt(spark, monkeypatch):
    rows = [(i, f"{chr(97 + k)}{chr(98 + k)} " * 20, f"l{k}") for k in range(12) for i in range(k * 100, k * 100 + 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df, sample_total=24).langs) == 12
    monkeypatch.setattr(langid, "MOST_LANGS", 5)
    with pytest.raises(ValueError):
        langid.fit(df)


def test_query_op7(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_langid(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(spark.read.parquet(f"{sf}/documents.parquet").collect()) and 250 < len(held) < 420
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_edges(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der Hund und die Katze", "de", 2), (3, None, "en", 3), (4, "12 !?", "de", 4), (None, "the dog", "en", 5), (6, "x" * 30000, None, 6), (6, "", None, 6)], "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert out[3].lang_pred == out[4].lang_pred == "und" and out[4].score == 0
    assert langid.identify(df, None).select("lang_pred").distinct().count() == 1
    assert langid.fit(df.limit(0)) is None and langid.identify(df.limit(0), None).count() == 0
    assert langid.train([("", "en")]) is None and langid.fit(df.where("lang IS NULL")) is None


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies here.</div><!-- ad <p>no</p> -->
<div id="wrap">%s</div><aside>Side words</aside><section class="comments"><p>Reader says a lot of words here indeed.</p></section>
<form><label>Search</label></form><div class='ad'>Buy now</div><footer>&copy; us</footer></body></html>"""
BODY = "<h1>A  title&amp;more</h1><p>First <b>bo</b>ld<br>line &lt;x&gt;\n of text.</p><div class='share'>Share this</div><p>A.</p><p>Last one with a <a href='/x'>link</a> in it.</p>"
WANT = "A title&more\nFirst bold line <x> of text.\nShare this\nA.\nLast one with a link in it."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "%s"])
def test_main_text(wrap):
    assert main_text(PAGE % (wrap % BODY), Weights()) == WANT.replace("Share this\n", "" if wrap == "%s" else "Share this\n")


INSIDE = """<div class="entry-header"><h1>The Title</h1></div><p>one</p><pre>x = 1</pre><section class="related-work"><p>Others did it.</p></section>
<p class="side-effects">None known.</p><h2 id="search-algorithms">Search</h2><table class="header"><tr><td>cell</td></tr></table><p class="notice">Mind this.</p>%s<p>end</p>"""
KEPT = "The Title\none\nx = 1\nOthers did it.\nNone known.\nSearch\ncell\nMind this.\nend"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="content with-sidebar"><main class="widget-area">%s</main></div>', '<div id="page" class="no-sidebar"><div class="widget-area main"><article class="post">%s</article></div></div>'])
def test_article_keeps_its_parts(wrap):
    """Names that only look like menus or adverts cost an article nothing; adverts and comments go."""
    out = "<div class='ad'>Buy it now today</div><section id='comments'><p>I like it so very much.</p></section><nav>menu</nav>"
    assert main_text("<body><div class='menu'>Home</div>" + wrap % (INSIDE % out) + "<div class='sidebar'>side words of some length here</div></body>", Weights()) == KEPT


def test_marks_are_learnt(spark):
    """A name that stands outside labelled articles marks the same on pages without a label."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    page = lambda label: f"<body><div class='x-promo9'>{text(12)}</div><{label}><h1>{text(3)}</h1><p class='menu'>{text(40)}</p></{label}></body>"
    df = spark.createDataFrame([(i, page("article")) for i in range(30)] + [(100, page("div"))], "page_id long, html string")
    w = learn_weights(df)
    assert w.marks["x-promo9"] and not w.marks["menu"]
    source = page("div")
    assert main_text(source, w) == "\n".join(re.search("<h1>(.*)</h1><p class='menu'>(.*)</p>", source).groups())


def test_many_headers_are_linear():
    began = time.process_time()
    assert main_text("<header>a</header>" * 50_000 + "<p>only text</p>" + "<div class='ad'>x</div>" * 50_000, Weights()) == "only text"
    assert time.process_time() - began < 20


def test_best_run():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        best = max([0, *(sum(s[i : j + 1]) for i in range(len(s)) for j in range(i, len(s)))])
        found = best_run(s)
        assert (sum(s[found[0] : found[1] + 1]) if found else 0) == best


def test_pages_frame(spark):
    hostile = ["<" * 20000, "<a href='" * 5000, "<!--" * 3000, "<div class=ad>" * 3000 + "x", "<p>" * 50000 + "word", "&amp" * 1000, "<script>" * 100]
    rows = [(1, PAGE % ("<article>" + BODY + "</article>")), (2, None), (3, ""), (4, "plain words only"), (4, "plain words only"), (5, "<nav>menu</nav>"), (6, "<p>" + "w " * 200000)] + [(10 + i, h) for i, h in enumerate(hostile)]
    df = spark.createDataFrame([(i, h, "u", 1) for i, h in rows], "page_id long, html string, url string, text int")
    out = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert out[1] == WANT and out[2] == out[3] == out[5] == "" and out[4] == "plain words only" and len(out[6]) == 399999
    assert extract_main_text(df.limit(0)).count() == 0 and learn_weights(df.limit(0)) == Weights()


def test_query_op9(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op9_html(spark, sf_dir).collect():
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("<br>", " ", inner))
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in blocks]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)
