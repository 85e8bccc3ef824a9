"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their parent and, by half, to further ancestors; links
and unwanted names take points away. The best container and those of its siblings that read like it are kept, without menus,
notices, forms and other parts that are never text.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from railspan.llm.common import bound_batches, only

OPENS = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([A-Za-z][A-Za-z0-9:_-]*))")
STOPS = re.compile(r"[>=]")
SPACES = re.compile(r"[\x20\t\n\f\r]*")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
DROPPED = frozenset(
    "nav aside footer form script style noscript template textarea title head button select input iframe svg canvas object dialog menu "
    "xmp noembed noframes audio video".split())
CLOSES_P = BLOCK - {"option", "optgroup", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
FENCES = frozenset("ul ol dl table article section main body div td th blockquote".split())
ENDED = (  # elements that end without an end tag: which start tags end which open elements, but not beyond which others
    (CLOSES_P, frozenset({"p"}), FENCES), (frozenset({"li"}), frozenset({"li"}), FENCES), (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), FENCES),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), FENCES - {"td", "th"}), (frozenset({"td", "th"}), frozenset({"td", "th"}), FENCES),
    (frozenset({"option"}), frozenset({"option"}), FENCES))
# What is another's text by its name, wherever the word stands; what is unwanted where it is the whole name; what is made of links, and judged by them.
SURE_WORDS = r"advert\w*|sponsor\w*|promo\w*|consent|gdpr|popup|modal|newsletter|subscri\w*|sidebar|masthead|footer|comments?|disqus|repl(?:y|ies)|signup"
PLAIN_WORDS = r"ads?|banner|cookies?|notices?|side|rail|header|foot|respond|social|widgets?|login|search|toolbar|skip|legal|copyright|hidden|overlay|related|recommend\w*|shar(?:e|ing)"
LINK_WORDS = r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager"
UNWANTED = re.compile(rf"(?:^|[\s_-])(?:{SURE_WORDS}|{PLAIN_WORDS}|{LINK_WORDS})(?=$|[\s_-])", re.I)
LINKS = re.compile(rf"(?:^|[\s_-])(?:{LINK_WORDS})(?=$|[\s_-])", re.I)
SURE = re.compile(rf"(?:^|[\s_-])(?:{SURE_WORDS})(?=$|[\s_-])|(?:^|\s)(?:{PLAIN_WORDS})(?=$|\s)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WANTED = re.compile(r"article|content|entry|post|story|main|text|body", re.I)
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body figcaption".split())


CLASSED = frozenset().union(*[ends | fence for _, ends, fence in ENDED])
SENTENCE = (".", "!", "?", "…", "。", ":")
#: Code points of few links that make an element with an unwanted name text; and one with a name of links, or a block beside the best container.
READS, LONG = 25, 80
#: Elements whose own text a label may stand in; elsewhere it names a field.
PROSE = frozenset("p li td dd dt blockquote figcaption h1 h2 h3 h4 h5 h6".split())
#: Share of its points that text keeps inside an element with an unwanted name.
DOUBT = 0.2


def _overruled(label: str) -> bool:
    """Whether another of the names says text ("content with-sidebar") and none is an unwanted word alone."""
    names = label.split()
    unwanted = [n for n in names if UNWANTED.search(n)]
    return not any(UNWANTED.fullmatch(n) for n in unwanted) and any(WANTED.search(n) for n in names if n not in unwanted)


class Page:
    """A light tree: for each element its tag, parent, whether it is dropped, and bonus; text pieces in page order.

    Every element is opened and closed once and knows its nearest block and the open elements that a start tag may
    end, so reading takes time in proportion to the page, whatever its markup.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.drop, self.bonus, self.doubt = ["#"], [0], [False], [0.0], [""]
        self.holder, self.ended, self.in_article = [0], [(0,) * len(ENDED)], [False]
        self.text: list[tuple[int, str, bool, int]] = []  # element, text, inside a link, number of the block
        self.block = self.here = self.links = 0
        self.open: dict[str, int] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        last = source.rfind(">")
        self.quotes = {q: source.rfind(q) for q in "\"'"}
        while at < size:
            m = OPENS.search(source, at)
            if m is None:
                self._add(self.here, source[at:], self.links)
                return
            if m.start() > at:
                self._add(self.here, source[at : m.start()], self.links)
            comment, cdata, other, slash, name = m.groups()
            if name is None:  # a comment or declaration
                mark = "-->" if comment else "]]>" if cdata else ">"
                end = source.find(mark, m.end())
                at = size if end < 0 else end + len(mark)
                continue
            end = self._tag_end(source, m.end(), last)
            if end < 0:  # a tag cut off by the page's end
                return
            at, name = end + 1, name.lower()
            if slash:
                self.block += name in BLOCK
                if self.open.get(name):
                    while self.tag[self.here] != name:
                        self._close()
                    self._close()
                continue
            if name in BLOCK:
                self.block += 1
            for k, (starts, _, _) in enumerate(ENDED):
                if name in starts and (node := self.ended[self.here][k]):
                    while self.here != self.parent[node]:
                        self._close()
            if name in VOID:
                if name == "br":
                    self._add(self.here, " ", self.links)
                continue
            self._open(name, source[m.end() : end], self.here)
            if name in RAW:
                close = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                at = size if close is None else close.start()

    def _tag_end(self, source: str, at: int, last: int) -> int:
        """Place of the tag's > outside quoted values; negative if there is none."""
        while at <= last:
            m = STOPS.search(source, at)
            if m.group() == ">":
                return m.start()
            at = SPACES.match(source, m.end()).end()
            quote = source[at : at + 1]
            if quote in self.quotes and at < self.quotes[quote]:  # a quote that nothing closes is a character like others
                at = source.find(quote, at + 1) + 1
        return -1

    def _close(self) -> None:
        name = self.tag[self.here]
        self.links -= name == "a"
        self.open[name] -= 1
        self.here = self.parent[self.here]

    def _open(self, name: str, attributes: str, parent: int) -> None:
        drop, bonus, doubt = self.drop[parent] or name in DROPPED, 0.0, ""
        drop = drop or (name == "header" and not self.in_article[parent]) or (name == "label" and self.tag[self.holder[parent]] not in PROSE)
        if name in ("article", "main"):
            bonus += 25
        if not drop and ("=" in attributes or "hidden" in attributes):
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            label = f"{found.get('class', '')} {found.get('id', '')}".strip()
            plain = name not in ("html", "body", "article", "main") or re.search(r"\bcomments?\b", label, re.I)
            if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
                drop = True
            elif plain and UNWANTED.search(label) and not _overruled(label):
                doubt = label
            elif WANTED.search(label):
                bonus += 25
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.drop.append(drop)
        self.bonus.append(bonus)
        self.doubt.append(doubt)
        self.holder.append(node if name in BLOCK else self.holder[parent])
        self.in_article.append(self.in_article[parent] or name in ("article", "main"))
        ended = self.ended[parent]
        if name in CLASSED:
            ended = tuple(node if name in ends else 0 if name in fence else old for old, (_, ends, fence) in zip(ended, ENDED, strict=True))
        self.ended.append(ended)
        self.open[name] = self.open.get(name, 0) + 1
        self.links += name == "a"
        self.here = node

    def _add(self, node: int, text: str, links: int) -> None:
        if not self.drop[node]:
            self.text.append((node, html.unescape(text) if "&" in text else text, links > 0, self.block))

    def _best(self, weight: list[float] | None = None) -> tuple[int, list[float], list[int], list[int]]:
        """The best container; score, length and length inside links of each element. Weights scale an element's points.

        Points are halved from one ancestor to the next; an article takes those of all its text in full.
        """
        n = len(self.tag)
        own, linked, commas = [0] * n, [0] * n, [0] * n
        for node, text, link, _ in self.text:
            node = self.holder[node]
            size = len(" ".join(text.split()))
            own[node] += size
            linked[node] += size * link
            commas[node] += text.count(",") + text.count("、") + text.count("،")
        score, whole, total, in_links = [0.0] * n, [0.0] * n, own[:], linked[:]
        for node in range(n - 1, -1, -1):
            up, factor = self.parent[node], weight[node] if weight else 1
            if own[node] and self.tag[node] in SCORED:
                points = (1 + commas[node] + min(own[node] / 100, 3)) * (1 - linked[node] / own[node]) * factor
                at = node if self.tag[node] in ("div", "section", "article", "main", "body") else up
                score[at] += points
                whole[at] += points
            if node:
                score[up] += (score[node] if self.tag[node] in BLOCK else 2 * score[node]) / 2
                whole[up] += whole[node]
                total[up] += total[node]
                in_links[up] += in_links[node]
            score[node] = (whole[node] if self.tag[node] == "article" else score[node]) + self.bonus[node] * factor
            score[node] *= (1 - in_links[node] / total[node]) if total[node] else 0
        return max(range(n), key=lambda i: (score[i], -i)), score, total, in_links

    def _settle_doubts(self) -> None:
        """Drops doubtful elements, but those that hold the best container, an article or main part, the title of one, or,
        where the name is doubtful only as a part of a longer one, text without many links."""
        n = len(self.tag)
        weight, holds, title = [1.0] * n, [False] * n, [False] * n
        for i in range(1, n):
            weight[i] = weight[self.parent[i]] if not self.doubt[i] or weight[self.parent[i]] < 1 else DOUBT
        best, _, total, in_links = self._best(weight)
        node = best
        while node:
            holds[node], node = True, self.parent[node]
        within = [False] * n
        for i in range(n):
            within[i] = i == best or (i > 0 and within[self.parent[i]])
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                holds[i] |= self.tag[i] in ("article", "main")
                title[i] |= self.tag[i] == "h1"
                holds[self.parent[i]] |= holds[i]
                title[self.parent[i]] |= title[i]
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]]
            if self.doubt[i] and not holds[i] and not gone[i]:
                named = WANTED.search(self.doubt[i]) is not None
                reads = within[i] and not SURE.search(self.doubt[i]) and total[i] >= (LONG if LINKS.search(self.doubt[i]) else READS) and in_links[i] < 0.25 * total[i]
                gone[i] = not reads and not (title[i] and (named or self.in_article[self.parent[i]]))
                self.bonus[i] += 25 * (named and not gone[i])
            self.drop[i] = self.drop[i] or gone[i]
        self.text = [x for x in self.text if not gone[x[0]]]

    def main_text(self) -> str:
        if any(self.doubt):
            self._settle_doubts()
        n = len(self.tag)
        best, score, total, in_links = self._best()
        keep = {best}
        if best:
            ends, titled = [False] * n, [False] * n  # elements whose text ends like a sentence; those that hold a heading
            for node, text, _, _ in self.text:
                ends[node] = text.rstrip().endswith(SENTENCE) if text.strip() else ends[node]
            for i in range(n - 1, 0, -1):
                titled[i] |= self.tag[i] in ("h1", "h2", "h3")
                ends[self.parent[i]] |= ends[i]
                titled[self.parent[i]] |= titled[i]
            for i in range(1, n):
                if self.parent[i] == self.parent[best] and i != best and total[i] and not self.drop[i]:
                    reads = in_links[i] < 0.25 * total[i] and (ends[i] or titled[i] or total[i] >= LONG and not self.in_article[best]) and self.tag[i] in BLOCK
                    if score[i] - self.bonus[i] >= max(10, 0.2 * score[best]) or reads:
                        keep.add(i)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in keep or (i > 0 and inside[self.parent[i]])
        blocks, last = [], None
        for node, text, _, block in self.text:
            if inside[node]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(text)
        return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def _run(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    A null or empty page has an empty text. Broken markup, unknown tags and cut-off pages are read as far as
    they go. Rows are judged one by one: repeated rows give repeated results; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    return only(pages, page_id="long", url="string", html="string").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
