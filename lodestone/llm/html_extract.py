"""Main text of pages by template deduction from equivalence classes.

Pages of one host are taken together in groups of bounded size. A page is a
sequence of tokens: tags with the path of elements they stand in, and words.
Tokens that occur equally often on every page of the group (one occurrence
vector) form an equivalence class. The class that occurs once a page, as far
as its tokens come in one order on every page, is the template's root. It cuts
pages into slots; in each slot classes are sought again, and in each
repetition of a class that occurs several times there in one order without
interleaving, so that classes nest until a slot has none. What is left in the
slots is the pages' own; the text of class tokens is the template's.

The text of a page is that of its slots: a block (text between breaks) of
class tokens alone is left out, on every page, inside an article too; a block
that a slot fills in part stays whole, because words of an article recur on
other pages by chance. Elements choose among the slots: one is never the
article in menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and styles, by element, role, class or id. Where the page has
an article element its slots are taken, else the slots of its main element,
else all others. An article of class tokens alone is one that its near copies
share, and stays.

Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Nulls: a null html is an empty one and gives an empty text; a null url is a
host of its own. Repeated rows give a row each. Other columns are ignored;
empty tables give empty results; very long pages are whole. Broken markup is
read as browsers do: elements never closed end with what holds them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Pages of a group about.
GROUP = 48

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template noscript iframe svg math xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head nav header footer aside form script style noscript template iframe svg math button select textarea input dialog menu title object canvas audio video".split())
_NEVER_NAME = re.compile(
    r"(?:^|[-_\s])(?:nav\w*|menu\w*|header|masthead|footer|side-?bar\w*|aside|ads?|adv|adverts?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|comments?|commentlist|disqus|replies|responses|breadcrumbs?|pagination|pager|share|sharing|social|related(?:[-_](?:posts?|articles?|links?|stories|content|items?|pages?|reading|news|topics?))?(?=$|\s)|recommended|widget\w*|skip|toolbar|tags|toc|search)(?:$|[-_\s])",
    re.I,
)
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element that starts ends open ones of these.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div footer form header html li main nav ol section table td th tr ul".split())


class Page:
    """Tokens of a page: (name, place) with place the index of an event; events carry text and region."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        #: kind (0 break, 1 text), text, region (2 article, 1 main, 0 elsewhere, -1 never the article), tokens so far
        self.events: list[tuple[int, str, int, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, str, int]] = []  # name, path, region
        at, n = 0, len(source)

        def region() -> int:
            return stack[-1][2] if stack else 0

        def text(raw: str) -> None:
            value = html.unescape(raw)
            path = stack[-1][1] if stack else ""
            self.tokens += [f"{path} {word}" for word in value.split()]
            self.events.append((1, value, region(), len(self.tokens)))

        def close(k: int) -> None:
            while len(stack) > k:
                name, path, r = stack.pop()
                self.tokens.append(f"</{path}")
                if name not in _INLINE:
                    self.events.append((0, "", r, len(self.tokens)))

        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if found is not None and not (name in _INLINE and any(s[0] in _SCOPE for s in stack[found + 1 :])):
                    close(found)
                elif name == "p":
                    self.events.append((0, "", region(), len(self.tokens)))
                continue
            if name in _CLOSES_P or name in _ENDS:
                ends = _ENDS.get(name, set()) | ({"p"} if name in _CLOSES_P else set())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        # Inline elements left open inside go on in the new block for a browser; for the text it's the same.
                        close(i)
                        break
                    if stack[i][0] in _SCOPE and stack[i][0] not in ends:
                        break
            names = ""
            r = region()
            own = 2 if name == "article" else 1 if name == "main" else r
            r = max(r, own) if r >= 0 else -1
            if m[3].strip():
                values = {}
                for a in _ATTRIBUTE.finditer(m[3]):
                    values[a[1].lower()] = a[2] or a[3] or a[4] or ""
                names = " ".join(values.get("class", "").split())
                label = f"{names} {values.get('id', '')}"
                # A whole page or article may be named after what it holds beside the text ("with-sidebar"), an article alone after what it is.
                bare, whole = name in ("html", "body"), name in ("article", "main")
                never = any(_NEVER_NAME.fullmatch(x) for x in label.split()) if whole else _NEVER_NAME.search(label)
                if not bare and (never or values.get("role", "").lower() in _NEVER_ROLE or "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", ""))):
                    r = -1
            if name in _NEVER and not (name == "header" and r == 2):
                r = -1
            path = f"{stack[-1][1] if stack else ''}/{name}{'.' + names if names else ''}"
            self.tokens.append(f"<{path}")
            if name not in _INLINE:
                self.events.append((0, "", r, len(self.tokens)))
            if name in _VOID or m[3].rstrip().endswith("/"):
                continue
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            stack.append((name, path, r))
        close(0)


def _ordered(spans: list[list[str]], members: set[str]) -> list[str]:
    """Of tokens that each span has once, the most that come in one order on all of them, pairwise: a longest common chain."""
    order = [t for t in spans[0] if t in members]
    for tokens in spans[1:]:
        place = {t: i for i, t in enumerate(tokens) if t in members}
        at = [place[t] for t in order]
        tails: list[int] = []  # places; ends[i] is the token of tails[i]
        ends: list[int] = []
        before = [-1] * len(at)
        for i, x in enumerate(at):
            k = bisect_left(tails, x)
            before[i] = ends[k - 1] if k else -1
            tails[k : k + 1], ends[k : k + 1] = [x], [i]
        chain, i = [], ends[-1] if ends else -1
        while i >= 0:
            chain.append(order[i])
            i = before[i]
        order = chain[::-1]
    return order


def _repeated(spans: list[list[str]], classes: dict[tuple[int, ...], list[str]]) -> list[str]:
    """The largest class that comes again and again in one order without interleaving, its tokens in that order."""
    for vector, members in sorted(classes.items(), key=lambda c: (-len(c[1]), c[0])):
        names = set(members)
        order = [t for t in spans[0] if t in names][: len(members)]
        if len(members) > 1 and len(set(order)) == len(order) and all([t for t in s if t in names] == order * n for s, n in zip(spans, vector, strict=True)):
            return order
    return []


def template(pages: list[Page], least: int = 2) -> dict[tuple[str, ...], bytearray]:
    """Which tokens of each page are the template's; what lies between them are its slots.

    The tokens that come once on every page are the root class. Each slot between two of them is taken by itself
    on all pages, and so is each repetition of a class that comes several times in a slot: the classes found there
    nest in it. Pages of the same tokens count once. Of fewer than ``least`` no word can be told from the template.
    """
    texts = [list(t) for t in dict.fromkeys(tuple(p.tokens) for p in pages)]
    marks = [bytearray(len(t)) for t in texts]
    if len(texts) < least:
        for t, m in zip(texts, marks, strict=True):
            m[:] = bytes(x[0] == "<" for x in t)
        todo = []
    else:
        todo = [[(i, 0, len(t)) for i, t in enumerate(texts)]]
    while todo:
        places = todo.pop()
        if len(places) < 2 or any(lo >= hi for _, lo, hi in places):
            continue  # a slot that is empty somewhere holds nothing that every page repeats
        spans = [texts[i][lo:hi] for i, lo, hi in places]
        common = set(min(spans, key=len)).intersection(*spans)
        counts = [Counter(t for t in s if t in common) for s in spans]
        classes: dict[tuple[int, ...], list[str]] = defaultdict(list)
        for t in common:
            classes[tuple(c[t] for c in counts)].append(t)
        once = classes.pop((1,) * len(spans), [])
        chain = _ordered(spans, set(once))
        cuts: list[list[int]] = []  # of each span, where the tokens of the class are
        if chain:
            names = set(chain)
            for (i, lo, _), s in zip(places, spans, strict=True):
                cuts.append([lo + k for k, t in enumerate(s) if t in names])
                for k in cuts[-1]:
                    marks[i][k] = 1
            for k in range(len(chain) + 1):
                todo.append([(i, at[k - 1] + 1 if k else lo, at[k] if k < len(chain) else hi) for (i, lo, hi), at in zip(places, cuts, strict=True)])
        elif again := _repeated(spans, classes):
            cuts = [[lo + k for k, t in enumerate(s) if t == again[0]] for (_, lo, _), s in zip(places, spans, strict=True)]
            todo.append([(i, lo, at[0]) for (i, lo, _), at in zip(places, cuts, strict=True)])
            todo.append([(i, a, b) for (i, _, hi), at in zip(places, cuts, strict=True) for a, b in zip(at, [*at[1:], hi], strict=True)])
    return {tuple(t): m for t, m in zip(texts, marks, strict=True)}


def extract(page: Page, own: dict[tuple[str, ...], bytearray], many: bool) -> str:
    """The text of the slots that are content."""
    mine = own.get(tuple(page.tokens), b"") if many else b""
    blocks: list[tuple[str, int, bool]] = []  # text, region, whether a slot fills any of it
    parts: dict[int, list[str]] = defaultdict(list)
    filled: set[int] = set()
    at = 0

    def close() -> None:
        for r, part in parts.items():
            words = " ".join("".join(part).split())
            if words:
                blocks.append((words, r, r in filled))
        parts.clear()
        filled.clear()

    for kind, value, r, end in page.events:
        if not kind:
            close()
        elif r >= 0:
            parts[r].append(value)
            if not mine or not all(mine[i] for i in range(at, end) if page.tokens[i][0] != "<"):
                filled.add(r)
        at = end
    close()
    best = max((r for _, r, _ in blocks), default=0)
    found = [b for b in blocks if b[1] == best]
    # An article that repeats as a whole is that of near copies, not the template's.
    return " ".join(words for words, _, fills in found if fills or not any(f for _, _, f in found))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """page id, url and text of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    # A host of many pages is dealt to groups of about ``group``. Their numbers are written first, so that
    # Spark knows their size: it broadcasts them where they are few, and joins by host, which it may split, where not.
    large = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > group)
    large = Scratch(pages.sparkSession, "hosts").cut(large.select("host", F.ceil(F.col("n") / F.lit(group)).cast("int").alias("groups")), "large")
    dealt = rows.join(large, "host", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("page_id", "url"))

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        read = [Page(h or "") for h in t.column("html").to_pylist()]
        own = template([p for p in read if p.tokens])
        texts = [extract(p, own, len(read) > 1) for p in read]
        yield pa.RecordBatch.from_arrays([t.column("page_id").combine_chunks(), t.column("url").combine_chunks(), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return dealt.groupBy("host", "part").applyInArrow(run, f"{fields}, text string")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
