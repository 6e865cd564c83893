"""Main text of web pages as the maximum-scoring run of a token stream."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import map_text, materialize, slices

# HTML element names by their role in the standard.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold no article text, unless they wrap it.
ASIDE = frozenset("head nav footer aside form button select textarea noscript template iframe object svg canvas audio video map menu dialog datalist input".split())
#: Words of class, id and role that name what is not the article, until labelled pages say otherwise.
#: A name counts if all parts between hyphens are such words or ``PLAIN`` ones.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments commentlist disqus replies respond related recommended share sharing social newsletter subscribe subscription signup login pagination pager widget complementary contentinfo".split())
#: Of these, the ones that are no article text inside an article either.
NEVER = frozenset("ad ads advert adverts advertisement advertising adbox adsense sponsored comment comments commentlist disqus replies respond".split())
PLAIN = frozenset("area bar block bottom box container form item items left links list message panel right section top wrap wrapper".split())
#: Names that mark the article's own elements and wrappers.
OWN_WORDS = frozenset("article body content entry main page post story text".split())
LABELS = ("article", "main")
#: Elements that are no part of a menu, form or the like around them.
HELD = frozenset("article main h1".split())
#: Elements that some pages put around everything: one with most of the page's words is a wrapper.
WRAPS = frozenset("form object dialog menu noscript".split())

_TOKEN = re.compile(r"""(<!--.*?(?:-->|\Z)|<(?:script|style|xmp)\b[^>]*>.*?(?:</(?:script|style|xmp)\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+[^>]*>)""", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")

#: Scores where no page is labelled: of words, of words in links and in elements with a mark, of tags.
DEFAULT = {"word": 1.0, "title": 4.0, "linked": 0.1, "marked": -1.0, "tag": -0.5, "tag:hr": -0.5} | {f"tag:{t}": -0.05 for t in sorted(INLINE)} | {f"tag:{t}": -0.1 for t in sorted(BLOCK | VOID)} | {f"tag:{t}": -1.0 for t in ("div", "section", "table", "ul", "ol", "li", "td", "tr")}
#: Scores on a page that labels its article: words inside, words outside, tags inside.
LABELLED = (3.0, -1.0, -0.001)
SMOOTH = 5.0
#: Marks are learnt if one in ``MARK_PAGES`` labelled pages has them, the most frequent ``MARKS`` of
#: them; a mark of the article's outside has at most the share ``MARK_INSIDE`` inside articles.
MARKS, MARK_PAGES, MARK_INSIDE = 5000, 1000, 0.1


@dataclass(frozen=True)
class Weights:
    """``score``: of classes of tokens; ``marks``: learnt names and whether they mark the outside."""

    score: dict[str, float] = field(default_factory=lambda: dict(DEFAULT))
    marks: dict[str, bool] = field(default_factory=dict)


def names_of(tag: str) -> list[str]:
    """The names in class, id and role of a start tag, in lower case."""
    return [w for m in _MARKS.finditer(tag) for v in m.groups() if v for w in v.lower().split()] if "=" in tag else []


def _aside(name: str, words: frozenset) -> bool:
    parts = re.split("[-_]+", name)
    return any(p in words for p in parts) and all(p in ASIDE_WORDS or p in PLAIN for p in parts)


class Page:
    """A page's tokens: ``kind`` (a tag's name, '' for text), ``text``, ``open`` (a start tag), ``close_at``."""

    __slots__ = ("kind", "text", "open", "close_at", "words", "held", "_label")

    def __init__(self, source: str) -> None:
        self.kind, self.text, self.open = [], [], []
        stacks: dict[str, list[int]] = {}
        self.close_at: dict[int, int] = {}
        for i, part in enumerate(_TOKEN.split(source)):
            if not part:
                continue
            if i % 2 == 0:
                self._add("", part, False)
                continue
            m = _NAME.match(part)
            name = m[1].lower() if m else "!"
            if name in ("!", "script", "style", "xmp"):
                continue
            at, start = len(self.kind), part[1] != "/"
            self._add(name, part, start)
            if start and name not in VOID:
                stacks.setdefault(name, []).append(at)
            elif not start and stacks.get(name):
                self.close_at[stacks[name].pop()] = at
        self.words = [0, *accumulate(0 if k else len(t.split()) for k, t in zip(self.kind, self.text))]
        self.held = [i for i, k in enumerate(self.kind) if k in HELD and self.open[i]]

    def _add(self, kind: str, text: str, start: bool) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.open.append(start)

    def cut(self, at: int, label: tuple[int, int] | None) -> int | None:
        """The last token of an element that by its name is no article text, else None. A header may
        belong to the labelled article, or by its names to any; a footer without an end reaches to
        the page's. What holds an article or a title is a wrapper whatever its name, and so is a form or
        the like with most of the page's words; a header's title counts only with the header's names."""
        name = self.kind[at]
        inside = label is not None and label[0] < at < label[1]
        if not self.open[at] or name in VOID or not (name in ASIDE or name == "header" and not inside):
            return None
        end = self.close_at.get(at, len(self.kind) - 1 if name == "footer" else None)
        if end is None or name == "head":
            return end
        if name in WRAPS and 2 * (self.words[end] - self.words[at]) > self.words[-1]:
            return None
        if name == "header" and any(OWN_WORDS & set(re.split("[-_]+", x)) for x in names_of(self.text[at])):
            return None
        k = bisect_left(self.held, at)
        while k < len(self.held) and self.held[k] < end:
            if name != "header" or self.kind[self.held[k]] != "h1":
                return None
            k += 1
        return end

    def label(self) -> tuple[int, int] | None:
        """The range of the page's only article (else main) element, if it has exactly one."""
        if not hasattr(self, "_label"):
            ranges = [[(a, b) for a, b in self.close_at.items() if self.kind[a] == name] for name in LABELS]
            self._label = next((own[0] for own in ranges if len(own) == 1), None)
        return self._label


def _marked(page: Page, at: int, inside: bool, marks: dict[str, bool], titles: list[int]) -> bool:
    """Whether an element's names mark the article's outside. Learnt names go first, then the fixed
    ones; an element that holds a title, or has one of the article's names, is a wrapper."""
    name = page.kind[at]
    if name in LABELS or name in ("html", "body") or at not in page.close_at or not (own := names_of(page.text[at])):
        return False
    told = [marks[x] if x in marks else _aside(x, NEVER if inside else ASIDE_WORDS) for x in own]
    if not any(told) or OWN_WORDS & set(own):
        return False
    k = bisect_left(titles, at)
    return not (k < len(titles) and titles[k] < page.close_at[at])


def classes(page: Page, marks: dict[str, bool]) -> list[tuple[str, int, int, int]]:
    """(class of score, how often, token, outermost marked element or -1) of the stream. Elements
    that are cut by name are one gap."""
    label, out, linked, title, at = page.label(), [], 0, 0, 0
    titles = [i for i, k in enumerate(page.kind) if k == "h1" and page.open[i]]
    mark, mark_end = -1, -1
    while at < len(page.kind):
        if at > mark_end:
            mark = -1
        name = page.kind[at]
        if name:
            if (end := page.cut(at, label)) is not None:
                out.append(("gap", 1, at, mark))
                at = end + 1
                continue
            if name == "h1":
                title = page.close_at.get(at, -1) if page.open[at] else -1
            if name == "a":
                linked = linked + 1 if page.open[at] else max(0, linked - 1)
            elif mark < 0 and page.open[at] and name not in VOID and _marked(page, at, label is not None and label[0] < at < label[1], marks, titles):
                mark, mark_end = at, page.close_at[at]
            known = name in BLOCK or name in VOID or name in INLINE
            out.append((f"tag:{name}" if known else "tag", 1, at, mark))
        elif n := len(page.text[at].split()):
            out.append(("marked" if mark >= 0 else "title" if at < title else "linked" if linked else "word", n, at, mark))
        else:
            out.append(("space", 0, at, mark))
        at += 1
    return out


def scores(page: Page, stream: list[tuple[str, int, int, int]], score: dict[str, float]) -> list[float]:
    """The score of each token. On a page that labels its article the label decides."""
    other = score.get("tag", DEFAULT["tag"])
    if (label := page.label()) is None:
        return [0.0 if c in ("gap", "space") else n * score.get(c, other) for c, n, _, _ in stream]
    inner, outer, tag = LABELLED
    out = []
    for c, n, at, _ in stream:
        inside = label[0] < at < label[1]
        if c in ("gap", "space"):
            out.append(0.0)
        elif c.startswith("tag"):
            out.append(tag if inside else score.get(c, other))
        else:
            out.append(n * (inner if inside and c != "marked" else outer))
    return out


def best_run(scores: list[float]) -> tuple[int, int] | None:
    """First and last place of the contiguous run with the largest sum above 0, in one scan.
    Of equal sums the first run stays."""
    best, run, start, found = 0.0, 0.0, 0, None
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i)
    return found


def main_text(source: str | None, weights: Weights) -> str:
    """The text of the best run's blocks, one per line, without marked elements of a negative
    score, which the run may span."""
    if not source:
        return ""
    page = Page(source)
    stream = classes(page, weights.marks)
    score = scores(page, stream, weights.score)
    of_mark: dict[int, float] = {}
    for (_, _, _, mark), x in zip(stream, score):
        of_mark[mark] = of_mark.get(mark, 0.0) + x
    gone = [mark >= 0 and of_mark[mark] < 0 for _, _, _, mark in stream]
    found = best_run([0.0 if g else x for g, x in zip(gone, score)])
    if found is None:
        return ""
    blocks, own = [], []
    for (c, _, at, _), out in zip(stream[found[0] : found[1] + 1], gone[found[0] : found[1] + 1]):
        name = page.kind[at]
        if name in BLOCK:  # a gap of another name stands within its block
            blocks.append("".join(own))
            own = []
        elif out:
            continue
        elif not name:
            text = page.text[at]
            own.append(html.unescape(text) if "&" in text else text)
        elif name in ("br", "wbr", "img"):
            own.append(" " if name != "wbr" else "")
    blocks.append("".join(own))
    return "\n".join(b for b in (_SPACE.sub(" ", b).strip() for b in blocks) if b)


def learn_weights(pages: DataFrame, html_col: str = "html") -> Weights:
    """Scores of words and tags, and marks, from all pages that label their article themselves.

    A page with exactly one article (else main) element is labelled by it. Each task counts the
    classes of its tokens, and the names of its elements, in and out of that element. A score is
    the log odds of in against out, held above 0 for words and below 0 for tags; a name that
    stands nearly always outside is a mark. Only the fixed set of classes and the most frequent
    names reach the driver. Without labelled pages the default scores are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer = Counter(), Counter()

        def told() -> pa.RecordBatch:
            names = sorted(set(inner) | set(outer))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inner[c] for c in names], pa.int64()), pa.array([outer[c] for c in names], pa.int64())], names=["c", "inner", "outer"])
            inner.clear()
            outer.clear()
            return out

        for whole in batches:
            for b in slices(whole, "html"):
                for source in b.column("html").to_pylist():
                    if not source:
                        continue
                    page = Page(source)
                    if (own := page.label()) is None:
                        continue
                    inner["pages"] += 1
                    for c, n, at, _ in classes(page, {}):
                        (inner if own[0] < at < own[1] else outer)["word" if c == "marked" else c] += n
                    for at, end in page.close_at.items():
                        if not at <= own[0] < end:  # wrappers of the article tell nothing
                            for x in set(names_of(page.text[at])):
                                (inner if own[0] < at < own[1] else outer)["name " + x] += 1
                if len(inner) + len(outer) > 100_000:
                    yield told()
        yield told()

    counts = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "c string, inner long, outer long").groupBy("c").agg(F.sum("inner").alias("inner"), F.sum("outer").alias("outer"))
    counts = materialize(counts)
    named = F.startswith("c", F.lit("name "))
    rows = {c: (a, b) for c, a, b in counts.where(~named).collect() if c not in ("gap", "space")}
    total = rows.pop("pages", (0, 0))[0]
    if not sum(a for a, _ in rows.values()):
        return Weights()
    often = counts.where(named & (F.col("inner") + F.col("outer") >= max(3, total / MARK_PAGES))).orderBy(F.desc(F.col("inner") + F.col("outer")), "c").limit(MARKS).collect()
    marks = {r.c[5:]: (r.inner + 1) / (r.inner + r.outer + 2) <= MARK_INSIDE or r.inner == 0 for r in often}
    words = {c: v for c, v in rows.items() if not c.startswith("tag")}
    tags = {c: v for c, v in rows.items() if c.startswith("tag")}
    out = dict(DEFAULT)
    for own in (words, tags):
        total = [sum(v[i] for v in own.values()) + SMOOTH * len(own) for i in (0, 1)]
        for c, v in own.items():
            odds = math.log((v[0] + SMOOTH) / total[0]) - math.log((v[1] + SMOOTH) / total[1])
            out[c] = min(3.0, max({"word": 0.5, "title": 2.0}.get(c, 0.1), odds)) if own is words else min(-0.02, max(-3.0, odds - 0.5))
    return Weights(out, marks)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: Weights | None = None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text_col``: the main text of each whole page.

    Words score positive and tags negative, words in elements with a mark of the outside
    (learnt, or a fixed one) negative too; the contiguous run with the largest sum is the
    article. Elements that hold no article text by their name (menus, footers, asides, forms,
    scripts, styles; not if they wrap an article, a title or, as forms may, most of the page), and marked
    ones of a negative score, are left out of the stream, so the run may span them. Words of a
    title score higher than others. Character references are decoded, white space in a block becomes
    one space, blocks are joined by a line feed; br is white space. Null, empty and
    wordless pages give an empty text. Rows and columns pass through; a column named as the
    output is replaced. ``weights``: by default learnt from ``pages``.
    """
    own = learn_weights(pages, html_col) if weights is None else weights

    def start():
        return lambda sources: [pa.array([main_text(s, own) for s in sources], pa.string())]

    return map_text(pages, html_col, [T.StructField(text_col, T.StringType())], start, keep)
