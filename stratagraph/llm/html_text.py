"""Main text of web pages by host consensus.

A first pass scores the containers of each page: a block's text, less what lies in links, counts in full for its nearest
container and by half for each one further out. From the best one it climbs to the outermost article or main, else to the
last container, short of body, whose text is mostly the best one's, so that a title or lede beside it stays. A page votes
for that container's path of tags and classes, with numbers generalised. Spark counts votes by host, and a second pass extracts from the containers on the host's winning
path; a page that has none uses its own best container, and so does one whose own best lies outside of the winning path,
holds more than twice its text, and isn't on a path that other pages of the host turned down. Only (host, path) counts are
shuffled for the vote.

Inside the container, elements that are never main text are left out: by tag (menus, headers but for those of an article,
footers, sidebars, forms, scripts, styles) and by a class, id or role that is such a word or joins one to words of place (ad, site-promo,
comment-list; not with-sidebar, ad-free, related-work, share-price). Running text is never dropped by words. An element marked by a word stays if it holds an article, main or most of the page's
unlinked text, unless another article or main with text stands beside it: threads and teasers are made of articles too.

Edge cases: null and empty pages have an empty text; unclosed and stray tags, unclosed comments and very deep nesting are
accepted; a very long page is read whole, in one row; a null URL belongs to the host ""; repeated rows are extracted each;
ties between paths go to the one with more text, then to the smaller path; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, gentle, map_frames

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_GAPS = re.compile(r"\s+")
_WORDS = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")

#: Winning paths of up to so many bytes are broadcast; beyond it they are joined, each host in SALTS parts.
BROADCAST_BYTES, SALTS = 32_000_000, 64

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form header li main nav ol section table tbody td tr ul".split())
#: Opening one of these ends an open element of the named kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Elements that are never main text: by tag, and by words that start or end a class, id or role.
DROPPED = frozenset("nav header footer aside form head menu button dialog".split()) | RAW
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion "
    "related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside them in a class or id ("site-promo", "share-buttons", "comment-list"): they say where or how
#: large a part of the page is, and not what it is about. Any other word beside them leaves the element alone.
PLACES = frozenset(
    "area bar body bottom box button buttons center column container content end fixed global group header icon icons inner item items label left line "
    "link links list lists main media message middle mobile outer overlay page panel post posts right row section side site slot small start sticky "
    "tab thread title top unit user users reader readers visitor visitors widgets wrap wrapper".split()
)
#: Elements of running text are never dropped for their class.
RUNNING = frozenset("html body article main p span em strong b i u a abbr cite code mark small sub sup q time h1 h2 h3 h4 h5 h6 pre blockquote td th tr".split())


def _marked(token: str) -> bool:
    words = _WORDS.findall(token)
    return not DROPPED_WORDS.isdisjoint(words) and DROPPED_WORDS.union(PLACES).issuperset(words)


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised label of an element, and whether words mark it as no main text."""
    label, drop = tag, False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "class":
                label += "".join("." + c for c in sorted({_NUMBER.sub("#", c) for c in value.split()}))
            if tag not in RUNNING and not DROPPED_WORDS.isdisjoint(_WORDS.findall(value)):
                drop = drop or any(map(_marked, value.split()))
    return label, drop


class Page:
    """nodes: (parent, path, tag, dropped by tag); blocks: (node, text, characters in links)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str, bool]] = [(-1, "", "", False)]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._in_links, self._in_articles = [0], [], 0, 0
        self._marked, self._raw = [], []  # elements marked by words; blocks as (node, [(node, text, in a link)])
        at = 0
        while at < len(source):
            found = _TAG.search(source, at)
            self._add(source[at : found.start() if found else len(source)])
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3] or "")
            if tag in RAW and not (found[3] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._end(tag)
        self._flush()
        self._settle()

    def _add(self, text: str) -> None:
        if text and not self.nodes[self._stack[-1]][3]:
            text = entities.unescape(text) if "&" in text else text
            self._text.append((self._stack[-1], text, self._in_links > 0))

    def _flush(self) -> None:
        if self._text:
            self._raw.append((self._stack[-1], self._text))
            self._text = []

    def _settle(self) -> None:
        """Decides which marked elements are dropped, and makes the blocks of the rest."""
        lost = self._lost() if self._marked else ()
        for node, pieces in self._raw:
            if lost:
                pieces = [p for p in pieces if not lost[p[0]]]
            text = _GAPS.sub(" ", "".join([p[1] for p in pieces])).strip()
            if text:
                self.blocks.append((node, text, sum([len(p[1].strip()) for p in pieces if p[2]])))
        self._raw = []

    def _lost(self) -> list[bool]:
        """Whether a node lies in a dropped marked element. The elements with most text are settled first."""
        count = len(self.nodes)
        size, last = [0] * count, list(range(count))
        for _, pieces in self._raw:
            for n, text, linked in pieces:
                if not linked:
                    size[n] += len(text.strip())
        for n in range(count - 1, 0, -1):
            parent = self.nodes[n][0]
            size[parent] += size[n]
            last[parent] = max(last[parent], last[n])
        articles = [n for n in range(count) if self.nodes[n][2] in ("article", "main") and not self.nodes[n][3] and size[n]]
        within = lambda a, n: n <= a <= last[n]
        over = {a: 0 for a in articles}  # marked elements around it
        candidates = []
        for n in self._marked:
            held = articles[bisect_left(articles, n) : bisect_right(articles, last[n])]
            for a in held:
                over[a] += 1
            if held or 2 * size[n] > size[0]:
                candidates.append(n)
        kept = set()
        for n in sorted(candidates, key=lambda n: (-size[n], n)):
            if not any(over[a] == 0 and not within(a, n) and not within(n, a) for a in articles):
                kept.add(n)
                for a in articles[bisect_left(articles, n) : bisect_right(articles, last[n])]:
                    over[a] -= 1
        dropped = set(self._marked) - kept
        lost = [False] * count
        for n in range(1, count):
            lost[n] = n in dropped or lost[self.nodes[n][0]]
        return lost

    def _pop(self) -> None:
        tag = self.nodes[self._stack.pop()][2]
        self._in_links -= tag == "a"
        self._in_articles -= tag in ("article", "main")

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in BLOCK:
            self._flush()
            closes = ENDS.get(tag, set()) | {"p"}
            for i in range(len(self._stack) - 1, 0, -1):
                name = self.nodes[self._stack[i]][2]
                if name in closes:
                    while len(self._stack) > i:
                        self._pop()
                elif name in CONTAINER and not (tag in ("td", "th", "tr") and name == "tr" and tag == "tr"):
                    break
        if tag not in BLOCK and tag not in RAW and tag != "a" and not attributes:
            parent = self._stack[-1]  # a plain inline element needs no node of its own
            self._stack.append(self._plain(parent, tag))
            return
        parent = self._stack[-1]
        label, marked = _describe(tag, attributes)
        headline = tag == "header" and self._in_articles > 0  # an article's own header holds its title
        path = f"{self.nodes[parent][1]}>{label}" if tag in CONTAINER else self.nodes[parent][1]
        self.nodes.append((parent, path, tag, tag in DROPPED and not headline or self.nodes[parent][3]))
        self._stack.append(len(self.nodes) - 1)
        if marked and not headline and not self.nodes[-1][3]:
            self._marked.append(len(self.nodes) - 1)
        self._in_links += tag == "a"
        self._in_articles += tag in ("article", "main")

    def _plain(self, parent: int, tag: str) -> int:
        self.nodes.append((parent, self.nodes[parent][1], tag, self.nodes[parent][3]))
        return len(self.nodes) - 1

    def _end(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            name = self.nodes[self._stack[i]][2]
            if name == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            if not block and name in BLOCK:
                return

    def _weights(self) -> list[int]:
        """Unlinked text of each node, with all that lies in it."""
        whole = [0] * len(self.nodes)
        for n, text, links in self.blocks:
            whole[n] += max(len(text) - 2 * links, 0)
        for n in range(len(whole) - 1, 0, -1):
            whole[self.nodes[n][0]] += whole[n]
        return whole

    def _around(self, node: int) -> list[int]:
        """The node and all that it lies in."""
        out = []
        while node > 0:
            out.append(node)
            node = self.nodes[node][0]
        return out

    def best(self) -> tuple[int, float] | None:
        """The container to take: from the one with the highest score up to all of its article. With its text's length."""
        score: dict[int, float] = {}
        for node, text, links in self.blocks:
            value = max(len(text) - 2 * links, 0)
            while node > 0 and value >= 1:
                if self.nodes[node][2] in CONTAINER:
                    score[node] = score.get(node, 0.0) + value
                    value /= 2
                node = self.nodes[node][0]
        if not score:
            return None
        node, whole = min(score, key=lambda n: (-score[n], n)), self._weights()
        main = outer = node
        named = False
        for at in self._around(node):
            tag = self.nodes[at][2]
            if tag in ("article", "main"):
                main, named = at, True
            elif tag in CONTAINER and tag != "body" and 2 * whole[node] > whole[at]:
                outer = at
        top = main if named else outer
        return top, float(whole[top])

    def passed_over(self, chosen: int) -> set[str]:
        """Paths of the containers beside the chosen one that hold text."""
        whole, ours = self._weights(), set(self._around(chosen))
        apart = [False] * len(self.nodes)
        for n in range(1, len(self.nodes)):
            parent = self.nodes[n][0]
            apart[n] = n not in ours and parent != chosen and (parent in ours or apart[parent] or parent == 0)
        return {path for n, (_, path, tag, _) in enumerate(self.nodes) if apart[n] and whole[n] and tag in CONTAINER}

    def main_text(self, path: str | None, refused: frozenset) -> str:
        """The text on the host's path, else that of the page's own best container."""
        chosen = {i for i, n in enumerate(self.nodes) if n[1] == path and n[2] in CONTAINER} if path else set()
        text, best = self.within(chosen) if chosen else "", self.best()
        if text and best and chosen.isdisjoint(self._around(best[0])) and self.nodes[best[0]][1] not in refused:
            whole = self._weights()
            tops = [n for n in chosen if chosen.isdisjoint(self._around(self.nodes[n][0]))]
            if best[1] > 2 * sum(whole[n] for n in tops):
                text = ""
        bare = not best and any(len(t) > 2 * links for _, t, links in self.blocks)  # text in no container at all
        return text or (self.within({best[0] if best else 0}) if best or bare else "")

    def within(self, chosen: set[int]) -> str:
        """Text of the blocks that lie in one of the nodes."""
        inside, out = {n: True for n in chosen}, []
        for node, text, _ in self.blocks:
            trail, at = [], node
            while at >= 0 and at not in inside:
                trail.append(at)
                at = self.nodes[at][0]
            found = at >= 0 and inside[at]
            for n in trail:
                inside[n] = found
            if found:
                out.append(text)
        return "\n".join(out)


def _votes(batches):
    """Each page's vote, and the paths that it passes over."""
    for pdf in batches:
        rows = []
        for host, source in zip(pdf.host, pdf.html):
            page = Page(source or "")
            best = page.best()
            if best:
                rows.append((host, page.nodes[best[0]][1], 1, best[1]))
                rows += [(host, path, 0, 0.0) for path in page.passed_over(best[0])]
        if rows:
            yield pd.DataFrame(rows, columns=["host", "path", "votes", "score"])


def _texts(batches):
    for pdf in batches:
        rows = []
        for page_id, url, source, path, refused in zip(pdf.page_id, pdf.url, pdf.html, pdf.path, pdf.refused):
            text = Page(source or "").main_text(path, frozenset(refused if refused is not None else ()))
            rows.append((page_id, url, text, len(text)))
        yield columns(rows, "page_id url text n_chars")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, refused): the container path that most pages of a host vote for, and the paths that some of its pages
    vote for and others pass over."""
    votes = pages.select("host", "html").mapInPandas(_votes, "host string, path string, votes int, score double")
    totals = votes.groupBy("host", "path").agg(F.sum("votes").alias("n"), F.count("*").alias("seen"), F.sum(F.round("score").cast("long")).alias("score")).where("n > 0")
    first = F.min_by("path", F.struct(-F.col("n"), -F.col("score"), F.col("path"))).alias("path")
    return totals.groupBy("host").agg(first, F.collect_list(F.when(F.col("seen") > F.col("n"), F.col("path"))).alias("refused"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    pages = gentle(pages).select("page_id", "url", "html", F.lower(host).alias("host"))
    paths = cut(host_paths(pages))
    size = paths.agg(F.sum(F.length("host") + F.length("path") + F.length(F.array_join("refused", "")) + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(paths), "host", "left")  # pages stay where they were read
    else:  # a host's pages are dealt to several tasks, with its path beside each
        paths = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("salt", salt).join(paths, ["host", "salt"], "left")
    return map_frames(joined, _texts, "page_id long, url string, text string, n_chars long")
