"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, and one
linear scan finds the contiguous stretch of the highest sum: the content region. Its
blocks are the text, without those of elements that are no content wherever they stand.
Short blocks beside rules and other tags may fall out of the best stretch, so the region
grows to the element that it is the content of: the whole `article` (or `main`) of a page
that marks one, else the paragraphs and headings that follow each other in one parent.

Fixed class words name no content only as a whole class or joined with words of place and
form (`cookie-banner`, `sidebar-left`, but not `ad-free` or `has-sidebar`). The most that they
could hold is checked: in a mark, or on a page without one, an element with `MOST_WORDS`
of the words is content whatever its class. So is a form around a whole page, and a `header`
with the page's heading.

Weights come from labelled pages: those that mark their article themselves with one
`article` or `main` element. Over all of them, tags and class or id words are counted
inside and outside the mark, the elements that the mark stands in as neither; a tag's
penalty is the log-odds of standing outside, and class words found (nearly) only outside
make their elements no content, as fixed element names and class words do. The table of
weights holds every tag, and every class word that Spark finds to be of that kind.

Defined results: null and empty pages have an empty text; a page without content
words too; unclosed elements end where HTML ends them, at
the latest with their parent, page or article; repeated rows
each have their row.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import read

#: Occurrences that a class word needs before it alone makes an element no content, and times that it must be outside for each time inside.
SUPPORT, RATIO = 20, 50
#: The share of the words of a mark, or of a page without one, beyond which an element is content whatever its class.
MOST_WORDS = 0.8

# Element names.
RAW = ("script", "style", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "select", "object", "audio", "video", "canvas")
NO_CONTENT = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "title", "header"}
MARKS = {"article", "main"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Words in class, id or role that name what is no content.
NO_CONTENT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}

COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "reply"}
# Words of place and form that may stand beside them in a class of several words.
PLACE_WORDS = {"area", "article", "bar", "block", "bottom", "box", "container", "entry", "form", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "post", "primary", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "wrap", "wrapper"}
# Elements of running text.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")
_PART = re.compile(r"[a-z]+")

# What an opening tag ends without an end tag, each as (elements ended, elements that it doesn't look beyond).
_SCOPE = {"html", "table", "td", "th", "caption", "button", "object", "marquee", "applet", "template"}
_BLOCKS = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
_LIST = _SCOPE | _BLOCKS - {"address", "div", "p"} | {"body", "li", "dt", "dd", "tr", "tbody"}
_P = ({"p"}, _SCOPE)
_CELLS, _GROUPS = {"td", "th"}, {"tbody", "thead", "tfoot", "caption", "colgroup"}
ENDS = {n: [_P] for n in _BLOCKS} | {"li": [({"li"}, _LIST), _P], **dict.fromkeys(("dt", "dd"), [({"dt", "dd"}, _LIST), _P])}
ENDS |= {"option": [({"option"}, {"datalist"})], "optgroup": [({"option", "optgroup"}, {"datalist"})]}
ENDS |= dict.fromkeys(_CELLS, [(_CELLS, {"table"})]) | {"tr": [(_CELLS | {"tr"}, {"table"})]} | dict.fromkeys(_GROUPS, [(_CELLS | {"tr"} | _GROUPS, {"table"})])
_IN_HEAD = {"base", "link", "meta", "title"}

DEFAULT_PENALTY = 0.3
LEAST, MOST = 0.1, 2.0


def tokens(page: str) -> Iterator[tuple[str, str, list[str]]]:
    """("text", text, []), ("open" or "close", name, class words) in page order."""
    for m in _TOKEN.finditer(page):
        if m["text"]:
            yield "text", m["text"], []
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, []
            else:
                words = sorted({w for found in _ATTR.findall(m["attrs"]) for w in _WORD.findall("".join(found).lower())}) if "=" in m["attrs"] else []
                yield "open", name, words


class Open:
    """The open elements at a place of a page; end tags that HTML lets be omitted are put in."""

    def __init__(self):
        self.names: list[str] = []
        self.places: list[int] = []
        self.count: Counter = Counter()

    def cut(self, n: int) -> None:
        while len(self.names) > n:
            self.count[self.names.pop()] -= 1
            self.places.pop()

    def ended_by(self, name: str) -> None:
        """End what an opening tag of `name` ends."""
        if self.count["head"] and name not in _IN_HEAD and self.names[-1] == "head":
            self.cut(len(self.names) - 1)
        for ended, beyond in ENDS.get(name, ()):
            if left := sum(self.count[n] for n in ended):
                last = None
                for at in range(len(self.names) - 1, -1, -1):
                    if not left:
                        break
                    if self.names[at] in ended:
                        last = at
                        left -= 1
                    elif self.names[at] in beyond:
                        break
                if last is not None:
                    self.cut(last)

    def push(self, name: str, place: int) -> None:
        if name not in VOID:
            self.names.append(name)
            self.places.append(place)
            self.count[name] += 1

    def close(self, name: str) -> None:
        """End the innermost element of `name` and what is open in it; an end tag that has none in reach ends nothing."""
        if not self.count[name]:
            return
        table = name in _CELLS | _GROUPS | {"table", "tr"}
        for at in range(len(self.names) - 1, -1, -1):
            inner = self.names[at]
            if inner == name:
                self.cut(at)
                return
            if name in INLINE and inner not in INLINE or (inner == "table" if table else inner in _SCOPE - {"html"} and name not in ("body", "html")):
                return


def marked(seen: list[tuple[str, str, list[str]]]) -> tuple[int, int] | None:
    """The range of tokens in the page's mark, if it has one that is closed and unique."""
    for name in ("article", "main"):
        opens = [i for i, t in enumerate(seen) if t[:2] == ("open", name)]
        closes = [i for i, t in enumerate(seen) if t[:2] == ("close", name)]
        if len(opens) == len(closes) == 1 and opens[0] < closes[0]:
            return opens[0], closes[0]
    return None


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, inside, outside) of the labelled pages of the task."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            seen = list(tokens(page or ""))
            mark = marked(seen)
            if not mark:
                continue
            around = Open()
            for i, (kind, name, _) in enumerate(seen[: mark[0]]):
                if kind == "open":
                    around.ended_by(name)
                    around.push(name, i)
                elif kind == "close":
                    around.close(name)
            around.ended_by(seen[mark[0]][1])
            own = set(around.places)
            for i, (kind, name, words) in enumerate(seen):
                if kind == "open" and i not in own:
                    (inside if mark[0] <= i <= mark[1] else outside).update([f"<{name}", *(f".{w}" for w in words)])
    features = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays(
        [pa.array(features, pa.string()), pa.array([inside[f] for f in features], pa.int64()), pa.array([outside[f] for f in features], pa.int64())],
        names=["feature", "inside", "outside"],
    )


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, tuple[int, int]]:
    """feature: (times inside, times outside the mark) over all labelled pages, of all tags and of the class words that are no content."""
    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(_label_counts, "feature string, inside long, outside long")
    counts = counts.groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    counts = counts.filter(F.col("feature").startswith("<") | (F.col("outside") >= SUPPORT) & (F.col("outside") >= RATIO * F.col("inside")))
    return {r["feature"]: (r["inside"], r["outside"]) for r in counts.collect()}


def names_no_content(word: str) -> bool:
    """Whether a class word is a fixed word for no content, alone or among words of place and form."""
    parts = _PART.findall(word)
    return any(p in NO_CONTENT_WORDS for p in parts) and all(p in NO_CONTENT_WORDS or p in PLACE_WORDS for p in parts)


class Elements:
    """The elements of a page, each named by the place of its opening tag.

    parent, end: of each; words: in it, those of a mark only for elements in that mark; mark: the
    outermost mark that an element lies in or is; headed: headers with an h1 and no nav; prose: elements
    with running text. total: words of a page without what element names exclude (forms count).
    """

    def __init__(self, seen: list[tuple[str, str, list[str]]]):
        self.seen, self.parent, self.end, self.mark = seen, {}, {}, {}
        self.words, self.inner, self.total = Counter(), Counter(), 0
        self.title = ""
        open_, stack, left_out = Open(), [], 0

        def cut(place: int) -> None:
            nonlocal left_out
            while len(stack) > len(open_.names):
                e = stack.pop()
                self.end[e] = place
                name = seen[e][1]
                left_out -= name in NO_CONTENT and name != "form"
                if stack:
                    for what in ("h1", "nav", "run"):
                        self.inner[stack[-1], what] += self.inner[e, what]
                    if self.mark[e] != e:
                        self.words[stack[-1]] += self.words[e]

        for i, (kind, name, _) in enumerate(seen):
            if kind == "text":
                n = len(name.split())
                self.total += 0 if left_out else n
                if stack:
                    self.words[stack[-1]] += n
                    if seen[stack[-1]][1] == "title":
                        self.title += name
                continue
            if kind == "close":
                open_.close(name)
                cut(i)
                continue
            open_.ended_by(name)
            cut(i)
            if name in VOID:
                continue
            self.parent[i] = stack[-1] if stack else -1
            around = self.mark[stack[-1]] if stack else -1
            self.mark[i] = around if around >= 0 else i if name in MARKS else -1
            left_out += name in NO_CONTENT and name != "form"
            open_.push(name, i)
            stack.append(i)
            self.inner[i, "h1"] += name == "h1"
            self.inner[i, "nav"] += name == "nav"
            self.inner[i, "run"] += name in RUNNING
        open_.cut(0)
        cut(len(seen))
        self.title = " ".join(html.unescape(self.title).split())
        self.marks = [e for e, m in self.mark.items() if m == e]

    def text(self, e: int) -> str:
        return " ".join(html.unescape("".join(n if k == "text" else "" if n in INLINE else " " for k, n, _ in self.seen[e : self.end[e]])).split())

    def holds_most(self, e: int) -> bool:
        mark = self.mark[e]
        if mark < 0 and self.marks:
            return False  # the page says itself that its content is elsewhere
        return self.words[e] >= MOST_WORDS * (self.words[mark] if mark >= 0 else self.total)

    def heading(self, e: int) -> bool:
        """Whether a header is that of the content: it stands in a mark, or has the heading of a post or of the page's title."""
        if self.mark[e] >= 0:
            return True
        if self.marks or not self.inner[e, "h1"] or self.inner[e, "nav"]:
            return False
        around = self.parent[e]
        if around >= 0 and self.seen[around][1] not in ("html", "body"):
            return True
        first = next(i for i in range(e, self.end[e]) if self.seen[i][:2] == ("open", "h1"))
        return bool(said := self.text(first)) and self.title.startswith(said)

    def no_content(self, e: int, learned: set[str]) -> bool:
        _, name, words = self.seen[e]
        if name == "header":
            if not self.heading(e):
                return True
        elif name in NO_CONTENT and not (name == "form" and self.inner[e, "run"] and self.holds_most(e)):
            return True
        if learned.intersection(words):
            return True
        fixed = [w for w in words if names_no_content(w)]
        if not fixed or not self.holds_most(e):
            return bool(fixed)
        # reader comments may be longer than what they are about
        about = any(p in COMMENT_WORDS for w in fixed for p in _PART.findall(w))
        return about and self.words[e] < (self.words[self.mark[e]] if self.mark[e] >= 0 else self.total)


class Extractor:
    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.penalty = {f[1:]: min(MOST, max(LEAST, math.log((o + 1) / (i + 1)) / 2)) for f, (i, o) in counts.items() if f[0] == "<"}
        self.no_words = {f[1:] for f, (i, o) in counts.items() if f[0] == "." and o >= SUPPORT and o >= RATIO * i}

    def text(self, page: str) -> str:
        seen = list(tokens(page))
        elements = Elements(seen)
        blocks: list[Piece] = []
        scores: list[float] = []
        open_, marks = Open(), 0
        skip = -1  # the depth of the element that is no content, or -1
        new = True
        for i, (kind, name, _) in enumerate(seen):
            if kind == "text":
                if skip >= 0:
                    continue
                n = len(name.split())
                if new and n:
                    around = next((k for k in range(len(open_.names) - 1, -1, -1) if open_.names[k] not in INLINE), -1)
                    blocks.append(Piece(i, open_.places[around] if around >= 0 else -1))
                    new = False
                if not new:
                    blocks[-1].places.append(len(scores))
                    blocks[-1].texts.append(name)
                    blocks[-1].plain |= n > 0 and not open_.count["a"]
                scores.append(float(n))
                continue
            if name in MARKS:
                marks = max(0, marks + (1 if kind == "open" else -1))
                skip = -1 if kind == "open" or not marks else skip
            if kind == "open":
                open_.ended_by(name)
            else:
                open_.close(name)
            if len(open_.names) <= skip or name == "body":
                skip = -1
            if kind == "open":
                if skip < 0 and name not in VOID and name not in MARKS | {"html", "body"} and elements.no_content(i, self.no_words):
                    skip = len(open_.names)
                open_.push(name, i)
            if name not in INLINE:
                new = True
            scores.append(-self.penalty.get(name, LEAST if name in INLINE else DEFAULT_PENALTY))
        lo, hi = best_region(scores)
        # a block of which the region has a part belongs to it as a whole
        chosen = [b.places[0] < hi and b.places[-1] >= lo for b in blocks]
        parts = (" ".join(html.unescape("".join(b.texts)).split()) for b, c in zip(blocks, whole(blocks, chosen, elements)) if c)
        return " ".join(p for p in parts if p)


class Piece:
    """A block of text: the token it begins with, its element, the places of its pieces in the scores, and the pieces."""

    def __init__(self, token: int, element: int):
        self.token, self.element, self.plain = token, element, False
        self.places: list[int] = []
        self.texts: list[str] = []


def whole(blocks: list[Piece], chosen: list[bool], elements: Elements) -> list[bool]:
    """The chosen blocks, grown to the content element that they are of."""
    if not any(chosen):
        return chosen
    starts = [b.token for b in blocks]
    for name in ("article", "main"):
        grown, last = list(chosen), -1
        for e in (e for e in elements.parent if elements.seen[e][1] == name):
            if e < last:
                continue  # in the one before
            last = elements.end[e]
            a, b = bisect_left(starts, e), bisect_left(starts, last)
            if any(chosen[a:b]):
                grown[a:b] = [True] * (b - a)
        if grown != chosen or any(elements.seen[e][1] == name for e in elements.marks):
            return grown
    at = [k for k, c in enumerate(chosen) if c]
    for k, step in ((at[0], -1), (at[-1], 1)):
        around = elements.parent.get(blocks[k].element, -1)
        k += step
        while 0 <= k < len(blocks) and blocks[k].plain and (e := blocks[k].element) >= 0 and elements.seen[e][1] in RUNNING and elements.parent[e] == around:
            chosen[k] = True
            k += step
    return chosen


def best_region(scores: list[float]) -> tuple[int, int]:
    """The range of the highest sum (the first of equal ones); empty if none is positive."""
    best, range_ = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, range_ = total, (start, i + 1)
    return range_


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with text and n_chars; input columns of these names give way."""
    extractor = Extractor(learn(pages, html_col))
    rest = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extractor.text(p) if p else "" for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*rest, "text", "n_chars"],
            )

    return pages.select(*rest, html_col).mapInArrow(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_html_extract": op10_html_extract}
