"""HTML extraction by consensus host paths."""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import arrow_columns, durable, field, strings
from auditlake.llm.url_filter import LOWER, PARTS, UPPER

#: Hosts whose paths may be broadcast, some hundred bytes each; for more, pages are joined by shuffle with salted hosts.
BROADCAST_HOSTS, SALTS = 100_000, 32
#: A winning path counts on a page where its containers hold at least this share of what the page would take by itself; and
#: for a host if at least this many pages, and this share of them, vote for it.
LEAST_SHARE, LEAST_VOTES, LEAST_SUPPORT = 0.5, 3, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text, whatever they hold; the raw ones end at their end tag alone.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
UNSHOWN = frozenset("head template select svg canvas object".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CONTAINERS = frozenset("html body main article section div table td center".split())
STACKED = CONTAINERS | UNSHOWN | frozenset("nav header footer aside form button dialog menu ul ol dl tbody thead tfoot tr th figure fieldset details blockquote".split())
BLOCKS = STACKED | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre address figcaption caption summary option legend".split())
#: Open elements that a start tag ends, up to the nearest of the second set.
_CELLS, _ROWS = ("td", "th"), ("td", "th", "tr")
IMPLIED = {
    "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tr": (_ROWS, ("table",)), "tbody": (("tbody", "thead", "tfoot", *_ROWS), ("table",)),
    "thead": (("tbody", "thead", "tfoot", *_ROWS), ("table",)), "tfoot": (("tbody", "thead", "tfoot", *_ROWS), ("table",)),
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
KEPT = frozenset("html body".split())
#: Elements whose own headers belong to the article, and headings, whose ids are made of their words.
SECTIONS, HEADINGS = ("main", "section", "blockquote"), frozenset("h1 h2 h3 h4 h5 h6".split())
#: What readers fill in.
INPUTS = frozenset("input select textarea button".split())
#: How sure it is that an element isn't the article: 1 may be a wrapper of it, 2 is taken back only if nothing else has
#: text, 3 never is.
MAYBE, LIKELY, SURE = 1, 2, 3
DOUBTFUL = {"form": MAYBE, "aside": LIKELY, "header": LIKELY, "nav": SURE, "footer": SURE, "menu": SURE, "dialog": SURE, "button": SURE}
#: Words of class, id and role that mark what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar"
    " toolbar social share sharing comment comments disqus reply replies respond related recommended recommendations pagination pager copyright disclaimer search contentinfo complementary".split()
)
READERS = frozenset("comment comments disqus reply replies respond".split())
#: What may follow such a word in a name that still means it, as in comments-area.
PLACES = frozenset("area articles bar block bottom box container content form inner item items left link links list main posts primary right section slot top unit wrap wrapper".split())
GOOD = frozenset("article content post story entry main body text".split())
BONUS = {"article": 1.5, "main": 1.3, "body": 0.5, "html": 0.4}

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"(?i)\b(?:class|id|role|hidden|aria-hidden|style)\b")
_SPLIT = re.compile(r"[^a-z]+")
_STATE = re.compile(r"(?:has|with|no|without|is)[-_]")


def doubt_of(names: list[str], marks: frozenset, tag: str) -> int:
    """How much the class, id and role names say that an element isn't the article. A name that is, ends with or starts
    with a word of BOILERPLATE is likely to mean it; one that holds such a word elsewhere may, and so may any on an
    element that is called an article as well."""
    most = 0
    for name in names:
        parts = [x for x in _SPLIT.split(name) if x]
        if BOILERPLATE.isdisjoint(parts):
            continue
        joined = "with" in parts or "without" in parts or "has" in parts or "no" in parts
        whole = len(parts) == 1 or (parts[-1] in BOILERPLATE and not joined) or (len(parts) == 2 and parts[0] in BOILERPLATE and parts[1] in PLACES)
        readers = not READERS.isdisjoint(parts)
        most = max(most, MAYBE if not whole or (not readers and (tag in ("article", "main") or not GOOD.isdisjoint(marks))) else SURE if readers else LIKELY)
    return most


class Page:
    """A page's elements that may hold or not be the article, in page order: path (a hash of the tags and names down to
    it), parent, last descendant, doubt, whether only its names raise it; and its text pieces (element, text or None for the edge of a block, whether it
    is a link's). Nothing is left out while parsing but what a browser doesn't show."""

    def __init__(self, source: str):
        self.paths, self.parents, self.tags, self.good, self.doubts, self.depths, self.ends = [path_hash(0, "html")], [-1], ["html"], [False], [0], [0], [0]
        self.containers, self.named, self.in_good, self.inputs = [True], [False], [False], [0]
        self.heads: list[int] = []  # headers in an article's section or wrapper
        self.pieces: list[tuple[int, str | None, bool]] = []
        self.titled: set[int] = set()
        self._parse(source)
        n = len(self.paths)
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            self.ends[up] = max(self.ends[up], self.ends[i])
        self.own_text, self.own_links = [0] * n, [0] * n
        for node, piece, link in self.pieces:
            if piece:
                size = len(piece) - piece.count(" ") - piece.count("\n")
                self.own_text[node] += size
                self.own_links[node] += size * link
        self._own_headers()
        self.cut = self._doubts_settled()
        self.text, self.links = self._sums(self.cut)

    def _sums(self, cut: list[bool]) -> tuple[list[int], list[int]]:
        """Text and link text of each element and all in it, without the cut ones."""
        text, links = [0 if c else x for x, c in zip(self.own_text, cut)], [0 if c else x for x, c in zip(self.own_links, cut)]
        for i in range(len(text) - 1, 0, -1):
            text[self.parents[i]] += text[i]
            links[self.parents[i]] += links[i]
        return text, links

    def _within(self, marked: list[bool]) -> list[bool]:
        """Elements that are marked or in one that is."""
        out = list(marked)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out

    def _own_headers(self) -> None:
        """A header in a section or wrapper of an article belongs to it if it holds a heading."""
        if self.heads:
            before = [0]  # elements with a heading, up to each
            for i in range(len(self.paths)):
                before.append(before[-1] + (i in self.titled))
            for i in self.heads:
                if before[self.ends[i] + 1] > before[i]:
                    self.doubts[i] = 0

    def _lists_or_forms(self) -> list[bool]:
        """Elements that are mostly links or that readers fill in."""
        text, links = self._sums([False] * len(self.paths))
        inputs = list(self.inputs)
        for i in range(len(inputs) - 1, 0, -1):
            inputs[self.parents[i]] += inputs[i]
        return [2 * l > t or n > 0 for t, l, n in zip(text, links, inputs)]

    def _doubts_settled(self) -> list[bool]:
        """Which elements are cut: the likely ones, and those that may be unless they hold most of the text that isn't
        likely to be something else; of those that may be by a name alone, only what is mostly links or a form. If that leaves no text but links, first what may be is taken back, then what is
        likely and holds most of the page."""
        prose = lambda cut: [t - l for t, l in zip(*self._sums(cut))]
        if any(self.named):
            odd = self._lists_or_forms()
            self.doubts = [0 if n and d == MAYBE and not o else d for d, n, o in zip(self.doubts, self.named, odd)]
        sure = self._within([d >= LIKELY for d in self.doubts])
        held = prose(sure)
        cut = self._within([d >= LIKELY or (d == MAYBE and 2 * held[i] <= held[0]) for i, d in enumerate(self.doubts)])
        if MAYBE in self.doubts and not prose(cut)[0]:
            cut = sure
        if LIKELY in self.doubts and not held[0]:
            held = prose(self._within([d == SURE for d in self.doubts]))
            cut = self._within([d == SURE or (d > 0 and 2 * held[i] <= held[0]) for i, d in enumerate(self.doubts)])
        return cut

    def _tag_end(self, s: str, at: int) -> int:
        """Index after the tag's >, which may stand in quotes; an unclosed quote doesn't hide it."""
        while True:
            close = s.find(">", at)
            if close < 0:
                return len(s)
            quote = min((q for q in (s.find('"', at, close), s.find("'", at, close)) if q >= 0), default=-1)
            if quote < 0:
                return close + 1
            ends = self._quotes[s[quote]]
            shut = s.find(s[quote], quote + 1) if quote < ends else -1
            if shut < 0:
                self._quotes[s[quote]] = 0  # none from here on
                return close + 1
            at = shut + 1

    def _parse(self, s: str) -> None:
        low = s.lower()
        if len(low) == len(s):
            end_tag = lambda tag, at: low.find(f"</{tag}", at)
        else:  # some letters have longer lower-case forms, so places in s and low differ
            end_tag = lambda tag, at: found.start() if (found := re.compile(f"</{tag}", re.I | re.A).search(s, at)) else -1
        self._quotes = {'"': len(s), "'": len(s)}
        missing: set[str] = set()
        stack: list[tuple[str, int, bool]] = []  # tag, element to go back to, not shown
        open_: dict[str, list[int]] = {}  # tag -> its places in the stack
        node, unshown, link, at, pieces = 0, 0, None, 0, self.pieces
        last = lambda tags: max((open_[t][-1] for t in tags if open_.get(t)), default=-1)

        def close(k: int) -> None:
            nonlocal node, unshown, link
            node = stack[k][1]
            for tag, _, dark in stack[k:]:
                open_[tag].pop()
                unshown -= dark
            del stack[k:]
            if link is not None and link > k:
                link = None  # an open link doesn't outlive the element it started in

        while m := _TAG.search(s, at):
            start = m.start()
            if start > at and not unshown:
                pieces.append((node, s[at:start], link is not None))
            tag = m[2]
            if tag is None:
                end = s.find("-->", m.end()) + 3 if m[0] == "<!--" else s.find(">", m.end()) + 1
                at = end if end > (2 if m[0] == "<!--" else 0) else len(s)
                continue
            at = self._tag_end(s, m.end())
            tag = tag.lower()
            if tag in BLOCKS and not unshown:
                pieces.append((node, None, False))
            if m[1]:
                if tag == "a":
                    link = None
                # an end tag ends nothing outside of the cell or table it stands in
                elif open_.get(tag) and (tag == "table" or tag in _ROWS or open_[tag][-1] > last(("td", "th", "table"))):
                    close(open_[tag][-1])
                continue
            if open_.get("head") and tag not in IN_HEAD:
                close(open_["head"][-1])
            if tag in BLOCKS and stack and stack[-1][0] == "p":  # a block ends an open paragraph
                close(len(stack) - 1)
            if tag in IMPLIED:
                ended, around = IMPLIED[tag]
                k = min((open_[t][-1] for t in ended if open_.get(t) and open_[t][-1] > last(around)), default=-1)
                if k >= 0:
                    close(k)
            if tag in INPUTS and not unshown:
                self.inputs[node] += 1
            if tag in VOID:
                continue
            if tag in RAW:
                shut = -1 if tag in missing else end_tag(tag, at)
                if shut < 0:
                    missing.add(tag)
                    at = len(s) if tag in ("script", "style") else at
                else:
                    at = self._tag_end(s, shut + 2)
                continue
            attributes = s[m.end() : at - 1]
            if tag == "a":
                link = len(stack) if "href" in attributes.lower() else None
            names, hidden = [], False
            if attributes and _NAMES.search(attributes):
                found = {a.lower(): (b or c or d) for a, b, c, d in reversed(_ATTRIBUTE.findall(attributes))}
                hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
                own = f"{found.get('class', '')} {'' if tag in HEADINGS else found.get('id', '')} {found.get('role', '')}"
                names = [x for x in own.lower().split() if not _STATE.match(x)]
            marks = frozenset(x for name in names for x in _SPLIT.split(name) if x)
            doubt, by_tag = 0, 0
            if tag not in KEPT and not unshown:
                own = (tag == "header" and open_.get("article")) or (tag in ("header", "footer") and last(("blockquote",)) > last(("article", "section", "main")))
                by_tag = max(LIKELY if hidden else 0, 0 if own else DOUBTFUL.get(tag, 0))
                doubt = max(by_tag, doubt_of(names, marks, tag) if names else 0)
            if tag in ("h1", "h2") and not unshown:
                self.titled.add(node)
            if not (doubt or tag in STACKED):
                continue
            open_.setdefault(tag, []).append(len(stack))
            dark = tag in UNSHOWN
            stack.append((tag, node, dark))
            unshown += dark
            if not unshown and tag != "html" and (doubt or tag in CONTAINERS):
                self.paths.append(path_hash(self.paths[node], ".".join([tag, *sorted(marks)])))
                self.parents.append(node)
                self.tags.append(tag)
                self.good.append(not GOOD.isdisjoint(marks))
                self.doubts.append(doubt)
                self.named.append(doubt > by_tag)
                good = self.in_good[node] or (self.good[-1] and tag not in KEPT)
                self.in_good.append(good)
                self.inputs.append(0)
                if tag == "header" and doubt == LIKELY and not hidden and not self.named[-1] and (good or any(open_.get(t) for t in SECTIONS)):
                    self.heads.append(len(self.paths) - 1)
                self.depths.append(self.depths[node] + 1)
                self.containers.append(tag in CONTAINERS)
                node = len(self.paths) - 1
                self.ends.append(node)
        if at < len(s) and not unshown:
            pieces.append((node, s[at:], link is not None))

    def best(self) -> int:
        """The container with most text, links counting against it, articles and the like preferred, of equals the
        deeper; or the outermost one around it that adds text of its own or of a part that isn't mostly links. Such
        parts that it passes on the way are cut."""
        score = lambda i: (self.text[i] - 2 * self.links[i]) * BONUS.get(self.tags[i], 1.0) * (1.2 if self.good[i] else 1.0)
        fit = [i for i, c in enumerate(self.containers) if c and not self.cut[i]]
        at = found = max(fit, key=lambda i: (score(i), self.depths[i], -i))
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.parents)):
            children.setdefault(self.parents[i], []).append(i)
        menus: list[int] = []
        while (up := self.parents[at]) >= 0:
            beside = [i for i in children[up] if i != at and not self.cut[i] and self.text[i]]
            linked = [i for i in beside if 2 * self.links[i] > self.text[i]]
            own = self.own_text[up] - 2 * self.own_links[up]
            menus += linked
            if len(beside) > len(linked) or own > 0:
                found = up
            at = up
        self.menus = [i for i in menus if found <= i <= self.ends[found]]
        return found

    def read(self, nodes: list[int]) -> str:
        """The text of some containers in page order, without what is cut."""
        kept = [False] * len(self.paths)
        for i in nodes:
            kept[i : self.ends[i] + 1] = [True] * (self.ends[i] + 1 - i)
        for i in self.menus:
            kept[i : self.ends[i] + 1] = [False] * (self.ends[i] + 1 - i)
        out = []
        for node, piece, _ in self.pieces:
            if kept[node] and not self.cut[node]:
                out.append(" " if piece is None else html.unescape(piece) if "&" in piece else piece)
        return " ".join("".join(out).split())

    def vote(self) -> int | None:
        """The path of the page's best container; None for a page without text."""
        best = self.best()
        return self.paths[best] if self.text[best] else None

    def main_text(self, path: int | None) -> str:
        """The text of the containers with the host's path, if they hold the page's best one, or lie elsewhere, or inside of
        it where that is the whole body, and have LEAST_SHARE of its text; else of the page's best one."""
        own = self.best()
        nodes, done = [], -1
        for i, p in enumerate(self.paths):
            if p == path and i > done and not self.cut[i] and 2 * self.links[i] <= self.text[i]:
                nodes.append(i)
                done = self.ends[i]
        held = sum(self.text[i] for i in nodes)
        if any(i <= own <= self.ends[i] for i in nodes):
            return self.read(nodes)
        inside = [i for i in nodes if own <= i <= self.ends[own]]
        if not nodes or held < LEAST_SHARE * self.text[own] or (inside and self.tags[own] not in KEPT):
            nodes = [own]
        return self.read(nodes)


def path_hash(above: int, kind: str) -> int:
    """A path's hash, from that of the path above: paths of deep pages cost no more than those of flat ones."""
    return xxhash.xxh64_intdigest(kind.encode("utf-8", "replace"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def host_of(url) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the container path that most pages of the host vote for, where they are LEAST_VOTES and LEAST_SUPPORT
    of them; ties go to the larger path."""

    def vote(batch):
        return [[Page(s).vote() if s else None for s in strings(batch.column(1))]]

    votes = arrow_columns(pages.select(host_of(pages[url]).alias("host"), pages[source].alias("html")), vote, [field("path", T.LongType())], drop=("html",))
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"))
    won = counted.groupBy("host").agg(F.max(F.struct("n", "path")).alias("won"), F.sum("n").alias("votes"))
    return won.where((F.col("won.n") >= LEAST_VOTES) & (F.col("won.n") >= F.col("votes") * LEAST_SUPPORT)).select("host", F.col("won.path").alias("path"))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of pages.

    Each page scores its containers (text less links, without menus, headers, footers, asides, forms, adverts, notices
    and comments; see Page for how sure those must be) and votes for the best one's path of tags and classes, digits
    left out. Votes are combined before they are shuffled by host. Then each page reads the containers of its host's
    path, or its own best one (see Page.main_text). Null and empty sources give empty text, those without markup
    themselves; null urls are one host. Repeated rows each come back.
    """
    winners = durable(host_paths(pages, url, source))
    slim = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[source].alias("html")).withColumn("_host", host_of(F.col("url")))
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = slim.join(F.broadcast(winners), F.col("_host") == F.col("host"), "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        slim = slim.withColumn("_salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
        joined = slim.join(salted, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("salt")), "left")

    def read(batch):
        texts = [Page(s).main_text(p) if s else "" for s, p in zip(strings(batch.column(2)), batch.column(3).to_pylist())]
        return [texts, [len(t) for t in texts]]

    fields = [field("text", T.StringType()), field("n_chars", T.LongType())]
    return arrow_columns(joined.select("key", "url", "html", "path"), read, fields, drop=("html", "path")).withColumnRenamed("key", key)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
