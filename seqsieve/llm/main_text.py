"""The main text of raw web pages by tag-path ratios.

A page is read into blocks of text, each with the path of block-level elements from the root to it. For each path the text outside links and the
punctuation marks of its blocks are added up and divided by the number of its blocks; both ratios, each as a share of the
page's largest, are fused by their mean and weighted by the share of text outside links. The values are smoothed over neighbouring
blocks, the more the longer the part of the path that they share, and averaged by path again. Paths whose value reaches the
standard deviation over the page's blocks (half of the largest value at most) are content.

What markup says outright comes first: elements that hold no article text (navigation, page header and footer, aside, form, script, ...), that
are hidden, or whose class, id or role has a word of MARKED make no blocks, nor does a section under a heading of HEADED; where
a page has `article` elements (`main`, if none) with text, paths outside them are not candidates. Content is completed within the
deepest element that holds nine tenths of the content paths' text: headings, paragraphs, items, cells and quotations in it belong to
the article unless most of the text on their path is links.

Markup is read as browsers do where it matters: raw text elements, comments, unquoted and quoted attributes, omitted end tags, end tags without
a start, a page that ends anywhere. Reading is linear in the page's length, whatever the markup.

Cases: a null or empty page, or one without article text, has the empty text and 0 characters; text outside any element counts as
inside the body; a line break is white space inside its block; invalid UTF-8 is replaced; repeated rows are answered alike; a very long page is
read whole, in its task; rows with null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul "
    "button canvas audio video object svg math label".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("button label option optgroup svg math canvas audio video object noscript template select".split())
#: An opening tag ends an open element of these kinds, looked for up to the nearest of the second ones.
OMITTED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
    **{h: (set(HEADINGS), BLOCK - HEADINGS) for h in HEADINGS},
}
#: Elements without article text.
EMPTY_KINDS = frozenset("aside audio button canvas dialog fieldset footer form head label legend math menu nav noscript object option optgroup search select svg template video".split()) | RAW
#: Completed within the content's element.
PARTS = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre address summary".split())

#: Words of class, id and role that mark what is not the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertise advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion promotions "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar masthead toolbar pagination pager skip footer colophon contentinfo banner "
    "sidebar sidebars aside complementary rail cookie cookies consent gdpr notice notices alert popup modal overlay dialog tooltip "
    "newsletter subscribe subscription signup signin login search form share sharing social follow related recommended recommendations trending "
    "comment comments commentlist disqus respond reply replies copyright disclaimer hidden".split()
)
#: These mark it only outside the article.
MARKED_OUTSIDE = frozenset(["header"])
OWN_WORDS = frozenset("article post entry story content".split())
#: First heading of a section that is not the article.
HEADED = re.compile(
    r"(\d+\s+)?(reader\s+|leave\s+a\s+)?(comments?|repl(y|ies)|responses?|related( (articles?|posts?|stories))?|share( this)?|advertisement|kommentare?|ähnliche artikel|werbung|anzeige"
    r"|commentaires?|articles? (liés|similaires)|publicité|comentarios?|artículos relacionados|publicidad)(\s*\(\d+\))?\W*",
    re.IGNORECASE,
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag, to the first > outside quoted values. Possessive, so each character is looked at once.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+>""")
_ATTRIBUTES = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
#: Blocks on each side that smooth a block's value.
REACH = 2
#: Open elements among which a tag looks for one that it ends by omission.
NEAR = 256


def _tokens(page: str):
    """(text, name of the tag after it or None, True for an end tag, source of its attributes), in page order."""
    at = begin = 0
    ends: dict[str, re.Pattern] = {}
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            yield page[begin:at], None, False, ""
            end = page.find("-->", at + 2)  # <!--> is a comment, too
            if end < 0:
                return
            begin = at = end + 3
            continue
        is_end = after == "/"
        name = _NAME.match(page, at + 1 + is_end)
        if name is None:
            if after in ("!", "?", "/"):  # a declaration or a bogus comment
                yield page[begin:at], None, False, ""
                end = page.find(">", at)
                if end < 0:
                    return
                begin = at = end + 1
            else:
                at += 1  # a less-than sign in the text
            continue
        kind, rest = name.group().lower(), _REST.match(page, name.end())
        yield page[begin:at], kind, is_end, page[name.end() : rest.end() - 1] if rest else ""
        if rest is None:
            return  # the page ends inside a tag
        begin = at = rest.end()
        if kind in RAW and not is_end:
            end = ends.setdefault(kind, re.compile(f"</{kind}", re.IGNORECASE)).search(page, at)
            if end is None:
                return
            begin = at = end.start()
    yield page[begin:], None, False, ""


class _Element:
    __slots__ = ("kind", "parent", "path", "depth", "skipped", "marked", "in_article", "in_main", "first", "freed", "own")

    def __init__(self, kind, parent, path, depth):
        self.kind, self.parent, self.path, self.depth = kind, parent, path, depth
        self.skipped = self.marked = self.in_article = self.in_main = self.freed = self.own = False
        self.first = True  # no block in it so far


class _Block:
    __slots__ = ("element", "text", "link_chars", "low")

    def __init__(self, element, text, link_chars, low):
        self.element, self.text, self.link_chars, self.low = element, text, link_chars, low


class _Reader:
    """Blocks of a page in order. A block's `low` is the depth of the nearest element that it shares with the block before."""

    def __init__(self, page: str):
        self.blocks: list[_Block] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._open = [_Element("#page", None, 0, 0)], {}
        self._pieces: list[tuple[str, bool]] = []
        self._link = self._low = 0  # depth of the stack at the open link (0: none); least depth since the last block
        for text, kind, is_end, source in _tokens(page):
            if text:
                self._pieces.append((text, self._link > 0))
            if kind == "a":
                self._link = 0 if is_end else len(self._stack)
            elif kind == "br":
                self._pieces.append((" ", False))
            elif kind is not None and (kind in BLOCK or kind in RAW or "-" in kind):
                self._flush()
                if is_end:
                    if kind not in ("html", "body") and self._open.get(kind):
                        self._close({kind})
                elif kind not in VOID and not (kind in ("html", "body") and self._open.get(kind)):
                    self._start(kind, source)
        self._flush()

    def _flush(self) -> None:
        if not self._pieces:
            return
        text = " ".join(entities.unescape("".join(p for p, _ in self._pieces)).split())
        if text:
            linked = " ".join(entities.unescape("".join(p for p, is_link in self._pieces if is_link)).split())
            top = self._stack[-1]
            self.blocks.append(_Block(top, text, len(linked), self._low))
            self._low = top.depth
            holder = top.parent
            if top.kind in HEADINGS and holder.first and holder.kind not in ("#page", "html", "body", "article", "main") and HEADED.fullmatch(text):
                holder.marked = True
            for e in reversed(self._stack):
                if not e.first:
                    break
                e.first = False
        self._pieces.clear()

    def _pop(self) -> None:
        self._open[self._stack.pop().kind] -= 1
        self._low = min(self._low, len(self._stack) - 1)
        if self._link > len(self._stack):
            self._link = 0

    def _close(self, kinds, until=()) -> None:
        """Close the innermost open element of the kinds, unless one of `until` is nearer, or NEAR others are."""
        for e in islice(reversed(self._stack), NEAR if until else None):
            if e.kind in kinds:
                while self._stack[-1] is not e:
                    self._pop()
                self._pop()
                return
            if e.kind in until:
                return

    def _start(self, kind: str, source: str) -> None:
        if kind == "body" and self._open.get("head"):
            self._close({"head"})
        if kind in CLOSES_P and self._open.get("p"):
            self._close({"p"}, ("table", "td", "th", "button", "object"))
        if kind in OMITTED and any(self._open.get(k) for k in OMITTED[kind][0]):
            self._close(*OMITTED[kind])
        top = self._stack[-1]
        own = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTES.findall(source)} if source else {}
        label = f"{kind}.{re.sub('[0-9]+', '#', own.get('class', ''))}"
        e = _Element(kind, top, self._paths.setdefault((top.path, label), len(self._paths) + 1), len(self._stack))
        e.in_article, e.in_main = top.in_article, top.in_main or kind == "main" or own.get("role") == "main"
        e.skipped = kind in EMPTY_KINDS or kind == "header" and not (top.in_article or e.in_main or top.own) or "hidden" in own or own.get("aria-hidden") == "true" or bool(_HIDDEN.search(own.get("style", "")))
        if own and kind not in ("html", "body"):
            words = {w.lower() for w in _WORDS.findall(" ".join(own.get(x, "") for x in ("class", "id", "role")))}
            e.own = bool(words & OWN_WORDS)
            e.marked = bool(words & MARKED) or bool(words & MARKED_OUTSIDE) and not (words & OWN_WORDS or top.in_article or e.in_main)
        e.in_article = e.in_article or kind == "article" and not e.marked
        if kind in ("h1", "main") or kind == "article" and not e.marked and not top.in_article:
            for x in reversed(self._stack):  # what holds the article is neither a form nor what its name says
                if x.freed:
                    break
                if x.skipped and x.kind != "form":
                    break
                x.skipped = False
                if kind != "article":
                    x.marked, x.freed = False, True
        self._stack.append(e)
        self._open[kind] = self._open.get(kind, 0) + 1
        if source.rstrip().endswith("/") and kind == "svg":
            self._pop()


def _allowed(blocks: list[_Block]) -> list[_Block]:
    """The blocks outside all excluded elements."""
    state: dict[_Element, bool] = {}
    out, low = [], 1 << 30
    for b in blocks:
        chain, e = [], b.element
        while e is not None and e not in state:
            chain.append(e)
            e = e.parent
        excluded = state[e] if e is not None else False
        for e in reversed(chain):
            excluded = state[e] = excluded or e.skipped or e.marked
        low = min(low, b.low)
        if not excluded:
            b.low, low = low, 1 << 30
            out.append(b)
    for inside in ("in_article", "in_main"):
        if any(getattr(b.element, inside) for b in out):
            kept, low = [], 1 << 30
            for b in out:
                low = min(low, b.low)
                if getattr(b.element, inside):
                    b.low, low = low, 1 << 30
                    kept.append(b)
            return kept
    return out


def content_paths(blocks: list[_Block]) -> tuple[np.ndarray, np.ndarray]:
    """(True for blocks on content paths, share of text outside links by the block's path)."""
    _, path = np.unique([b.element.path for b in blocks], return_inverse=True)
    size, links = np.array([len(b.text) for b in blocks], float), np.array([b.link_chars for b in blocks], float)
    marks = np.array([len(_MARKS.findall(b.text)) for b in blocks], float)
    n = np.bincount(path)
    plain = np.bincount(path, size - links)
    share = plain / np.bincount(path, size)
    ratios = [plain / n, np.bincount(path, marks) / n]
    fused = sum(r / r.max() if r.max() > 0 else np.zeros(len(n)) for r in ratios) / 2 * share
    value = fused[path]
    # Neighbours count by distance and by the part of the longer path that both share.
    base = min(b.low for b in blocks[1:]) if len(blocks) > 1 else 0  # all blocks share so much
    depth, low = np.array([b.element.depth for b in blocks]) - base, np.array([b.low for b in blocks]) - base
    total, weight, shared = value.copy(), np.ones(len(value)), None
    for step in range(1, min(REACH, len(value) - 1) + 1):
        shared = low[1:] if shared is None else np.minimum(shared[:-1], low[step:])
        w = np.exp(-(step**2) / 2) * shared / np.maximum(np.maximum(depth[step:], depth[:-step]), 1)
        total[step:] += w * value[:-step]
        weight[step:] += w
        total[:-step] += w * value[step:]
        weight[:-step] += w
    smooth = total / weight
    by_path = np.bincount(path, smooth) / n
    return (by_path >= min(smooth.std(), by_path.max() / 2))[path] & (share > 0)[path], share[path]


def extract(page: str) -> str:
    """The main text of a page, blocks joined by line feeds."""
    blocks = _allowed(_Reader(page).blocks)
    if not blocks:
        return ""
    chosen, share = content_paths(blocks)
    sums: dict[_Element, int] = {}
    for b, c in zip(blocks, chosen.tolist()):
        e = b.element
        if c:
            sums[e] = sums.get(e, 0) + len(b.text)
    total, by_depth = sum(sums.values()), {}
    for e in sums:
        by_depth.setdefault(e.depth, set()).add(e)
    root = None
    for depth in range(max(by_depth, default=-1), -1, -1):
        for e in by_depth.get(depth, ()):
            if 10 * sums[e] >= 9 * total and e.kind not in PARTS:
                root = e
            if e.parent is not None:
                if e.parent not in sums or e.parent not in by_depth.get(depth - 1, ()):
                    by_depth.setdefault(depth - 1, set()).add(e.parent)
                sums[e.parent] = sums.get(e.parent, 0) + sums[e]
        if root is not None:
            break
    inside: dict[_Element, bool] = {}
    out = []
    for b, c, s in zip(blocks, chosen.tolist(), share.tolist()):
        if not c and b.element.kind in PARTS and s > 0.5 and root is not None:
            chain, e = [], b.element
            while e is not None and e is not root and e not in inside:
                chain.append(e)
                e = e.parent
            c = e is root or e is not None and inside[e]
            inside.update(dict.fromkeys(chain, c))
        if c:
            out.append(b.text)
    return "\n".join(out)


def main_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for value in batch.column("page").cast(pa.large_binary()).to_pylist():
                texts.append(extract((value or b"").decode("utf-8", "replace")).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
