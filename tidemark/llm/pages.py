"""Main text of web pages by composite text density.

Each node of a page's tree has a density: characters per tag, lowered by the links among them. A node's density sum is the
sum of its children's densities; the subtree with the largest one is the article. The least density on the path from there
to the body is the threshold that other subtrees must reach to count as well, as do the texts beside that path that are not mostly
links. Where the article or main element holds the densest part, it is taken whole, with others beside it. Parts that their tag or role names as something
else than the article take no part, nor do those whose whole class or id is such a name, unless the article lies in them. Where
the name is only a piece of a class (no-sidebar, elementor-widget-text-editor), it lowers the density and no more; such a part
that is mostly links and apart from the article is dropped.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import map_texts

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th
    thead tr ul""".split())
# a start tag ends these open elements, up to a border
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Parts of a page that are not its article.
OTHER_TAG = frozenset("""head nav aside footer script style title noscript template iframe button select option textarea input
    svg canvas object audio video dialog menu xmp noembed noframes search""".split())
OTHER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OTHER_NAME = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr privacy notice notification alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer
    share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay
    widget toolbar pagination pager skip form search""".split())
COMMENT_NAME = frozenset("comment comments commentlist discussion replies reply respond disqus".split())

TOKEN = re.compile(r"""<!--(?:(?!-->).)*+(?:-->)?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>"']|$)""", re.I)
# beside a comment's name, these tell of a setting and not of the part's content
SETTING = frozenset("no not non has have with without hide open opened closed off on disabled enabled allowed count".split())
LOWERED = 0.5
NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def named_otherwise(tag: str, attributes: str) -> str:
    """'' for a part of the article, else what makes it something else: a tag, a name, a piece of a name or a comment."""
    if tag in OTHER_TAG:
        return "tag"
    # a form is a part like a named one: older servers wrap whole pages in it
    out = "name" if tag == "form" else ""
    if not attributes or tag in ("html", "body"):
        return out
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return "tag"
        if key == "role" and value.lower() in OTHER_ROLE:
            return "tag"
        if key in ("class", "id"):
            for one in value.split():
                names = {x.lower() for x in NAME.findall(one)}
                if names & COMMENT_NAME and not names & SETTING:
                    return "comment"
                if tag not in ("article", "main") and names & OTHER_NAME:
                    if names <= OTHER_NAME:
                        out = "name"
                    elif not out and not names & SETTING:
                        out = "piece"
    return out


class Page:
    """The tree of a page: parallel lists by node, and its texts in order as (node, text)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.other = ["#page"], [-1], [""]
        self.texts: list[tuple[int, str]] = []
        self.stack = [0]
        # no tag can end behind the last bracket, and one that does not end is dropped
        full = html.rfind(">") + 1
        unfinished = re.search("<[a-zA-Z/!?]", html[full:])
        html = html[: full + unfinished.start()] if unfinished else html
        at, raw = 0, ""
        for m in TOKEN.finditer(html, 0, full):
            if raw:
                # the content of a raw element ends with its own end tag only
                if not (m[1] and m[2].lower() == raw):
                    continue
                raw = ""
                at = m.end()
                self.close(m[2].lower())
                continue
            if m.start() > at:
                self.texts.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
            else:
                self.open(tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    raw = tag
        if not raw and at < len(html):
            self.texts.append((self.stack[-1], html[at:]))

    def open(self, tag: str, attributes: str) -> None:
        stack, tags = self.stack, self.tag
        if tag in BLOCK:
            self.end({"p"}, {"table", "td", "th", "button", "article", "section", "div", "body"})
        if tag in IMPLIED:
            self.end(*IMPLIED[tag])
        if tag == "body":
            self.end({"head"}, set())
        node = len(tags)
        other = named_otherwise(tag, attributes)
        if tag == "header" and not any(tags[i] in ("article", "main") for i in stack):
            other = "tag"
        if tag in ("article", "main") and not other:
            # a wrapper with a telling name around the article itself is no part of its own
            for i in stack:
                if self.other[i] in ("name", "piece"):
                    self.other[i] = ""
        tags.append(tag)
        self.parent.append(stack[-1])
        self.other.append(other)
        if tag in VOID:
            self.texts.append((node, " "))
        else:
            stack.append(node)

    def end(self, names: set[str], border: set[str]) -> None:
        """Closes the outermost open element of these names within the nearest border."""
        cut = 0
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in names:
                cut = k
            elif tag in border:
                break
        if cut:
            del self.stack[cut:]

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == tag:
                del self.stack[k:]
                return

    def measured(self, sizes: list[int], link: list[bool], but: frozenset[str]) -> tuple:
        """(taking no part, characters, link characters, density, densest subtree) of the nodes; the kinds `but` take part as others do."""
        tag, parent = self.tag, self.parent
        n = len(tag)
        gone, low = [False] * n, [False] * n
        for i in range(1, n):
            gone[i] = gone[parent[i]] or (self.other[i] not in ("", "piece") and self.other[i] not in but)
            low[i] = low[parent[i]] or self.other[i] == "piece"
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for (i, _), size in zip(self.texts, sizes, strict=True):
            if not gone[i]:
                chars[i] += size
                link_chars[i] += size * link[i]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                up = parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + (tag[i] == "a")
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        ratio = link_chars[body] / max(chars[body], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if not gone[i] and chars[i]:
                c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
                base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + ratio * c + math.e)
                density[i] = max(0.0, c / t * (math.log(max(c / lc * t / lt, 1.0)) / base)) * (LOWERED if low[i] else 1)
                if i:
                    total[parent[i]] += density[i]
        best = max(range(n), key=lambda i: (total[i], -i))
        return gone, chars, link_chars, density, best if total[best] else body

    def main_text(self) -> str:
        tag, parent = self.tag, self.parent
        n = len(tag)
        link = [False] * n
        for i in range(1, n):
            link[i] = link[parent[i]] or tag[i] == "a"
        sizes = [len("".join(text.split())) for _, text in self.texts]
        gone, chars, link_chars, density, best = self.measured(sizes, link, frozenset())
        if "name" in self.other and not any(tag[i] in ("article", "main") and chars[i] and not gone[i] for i in range(n)):
            # a named part that has the densest subtree and more text than the rest is the article
            _, whole, _, _, dense = self.measured(sizes, link, frozenset(["name"]))
            named = []
            while dense > 0:
                if self.other[dense] == "name":
                    named.append(dense)
                dense = parent[dense]
            if named and 2 * whole[named[-1]] > whole[0]:
                # of names inside each other, those take part that hold most of the text
                for i in named:
                    if 2 * whole[i] > whole[0]:
                        self.other[i] = ""
                gone, chars, link_chars, density, best = self.measured(sizes, link, frozenset())
        if not chars[0]:
            return ""
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        path = [best]
        while path[-1] not in (0, body):
            path.append(parent[path[-1]])
        threshold = min(density[i] for i in path)
        if "piece" in self.other:
            above = set(path)
            for i in range(1, n):
                gone[i] = gone[i] or gone[parent[i]] or (self.other[i] == "piece" and i not in above and 2 * link_chars[i] > chars[i])
        # the article as a whole, if the densest part lies in one: the outermost on the path, and others beside it that are text
        roots = [i for i in path if tag[i] in ("article", "main")]
        text = [not gone[i] and 0 < chars[i] >= 2 * link_chars[i] for i in range(n)]
        above = set(path)
        if roots:
            chosen = {roots[-1], *(i for i in range(1, n) if tag[i] in ("article", "main") and text[i])}
            between = set(path[path.index(roots[0]) + 1 : path.index(roots[-1]) + 1])
            for i in range(1, n):
                # of the outer one, parts around the inner one that are mostly links are no article
                gone[i] = gone[i] or gone[parent[i]] or (parent[i] in between and i not in above and not text[i])
            plain: set[int] = set()
        else:
            chosen = {best, *(i for i in range(n) if not gone[i] and density[i] >= threshold and tag[i] in BLOCK and i not in above)}
            # nothing tells that the other texts along the path are something else, unless they are mostly links
            chosen.update(i for i in range(1, n) if parent[i] in above and i not in above and text[i])
            plain = above
        inside = [False] * n
        block = list(range(n))
        for i in range(n):
            inside[i] = not gone[i] and (i in chosen or (i > 0 and inside[parent[i]]))
            if i and tag[i] not in BLOCK:
                block[i] = block[parent[i]]
        out: list[list[str]] = []
        last = -1
        for i, piece in self.texts:
            if inside[i] or i in plain:
                if block[i] != last:
                    out.append([])
                    last = block[i]
                out[-1].append(piece)
            elif not gone[i] or block[i] != last:
                last = -1
        lines = (" ".join(unescape("".join(parts)).split()) for parts in out)
        return "\n".join(line for line in lines if line)


def main_text(html: str) -> str:
    return Page(html).main_text()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    A null or empty page has an empty text, and so has one without text outside menus and the like. Repeated rows stay; an
    empty table gives none; other columns are not read. Each page is read whole.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        made = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(made, names=["page_id", "url", "text", "n_chars"])

    return map_texts(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), "html", schema, run)
