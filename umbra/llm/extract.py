"""Main text of web pages by consensus host paths.

1. Every page is read once and its containers are scored: a text block counts in full for
   its parent, half for the grandparent, less its share of link text; elements that carry
   menus, headers, footers, notices, adverts, forms, comments and the like count nothing.
   A class name or id that is such a word, or speaks of comments or adverts, is enough. One
   that only contains such a word (`search-results-explained`) is not if the element holds
   most of the page's prose, or has a name of content beside it and few links.
2. The containers of each page vote, by their share of the page's best score, for their
   generalised path: tags with up to three class names in which digits are levelled. Votes
   are added up for each host in Spark; paths with 5 % of the host's votes win.
3. Every page is read again. Of its host's winning paths the one with the best score on the
   page is taken, with those beside it in the same container that got a fifth of its votes;
   the blocks below their elements are the text. A page where that path is absent, or holds
   less than a fifth of the best score, falls back to its own best container, a page without
   containers has no text.

Votes are pre-aggregated before the shuffle, so a host with a third of all pages is few
rows. Winners are broadcast only when counted to be few, else joined by a shuffle.

Character references are decoded, white space inside a block becomes one space, blocks
are trimmed, empty ones dropped, and the rest joined by an empty line. Null html is empty
and gives empty text; broken or cut markup is read as far as it goes. A null url has the
empty host. Further columns are ignored. Paths of more than PATH characters go on from a digest
of what was, so that a page nested to any depth takes memory and time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_or_shuffled, written
from .url_filter import parts

HOST_ROWS = 20_000  # hosts up to this count are broadcast (20 paths each at most, about 40 MB)
LEAST_VOTE = 0.1  # share of the page's best score that a container needs for a vote
LEAST_WIN = 0.05  # share of the host's votes that a winning path needs
BESIDE = 0.2  # of the winner's votes for a path beside it; of the page's best score for the winner

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes svg math".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address center details summary fieldset header footer nav aside form hr dialog menu".split())
CONTAINER = frozenset("body main article section div td blockquote center".split())
ENDS_PARAGRAPH = BLOCK - frozenset(["html", "body"])
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

AWAY_TAGS = frozenset("nav footer aside form dialog button select option menu head object audio video canvas".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_AWAY_WORDS = r"banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sign-up|share|sharing|social|related|recommend\w*|sidebar\w*|widgets?|menu\w*|nav\w*|breadcrumbs?|footer|site-?header|page-?header|masthead|replies|reply|respond|pagination|pager|toolbar|login|search\w*|copyright|disclaimer"
_ALWAYS_AWAY_WORDS = r"ads?|advert\w*|adsense|promo\w*|sponsor\w*|comments?|commentlist|disqus"
AWAY_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_AWAY_WORDS}|{_ALWAYS_AWAY_WORDS})(?:$|[\s_-])")
ALWAYS_AWAY_NAMES = re.compile(rf"(?:^|\s)(?:header|{_AWAY_WORDS})(?:$|\s)|(?:^|[\s_-])(?:{_ALWAYS_AWAY_WORDS})(?:$|[\s_-])")
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:content|article\w*|post|entry|main|story|text|body)(?:$|[\s_-])")


NO_DOUBT, DOUBT, SOME_DOUBT = 0, 1, 2  # some: a name that speaks for dropping beside one that speaks for content


class Element:
    """An open element: what it inherits, and the nearest elements of some kinds from itself upwards, so that no question walks a deep page."""

    __slots__ = ("tag", "path", "parent", "away", "doubt", "weight", "score", "depth", "block", "container", "stop", "doubtful", "sectioned", "chosen", "held")

    def __init__(self, tag: str, path: str, parent: "Element | None", away: bool, weight: float, doubt: int = NO_DOUBT):
        self.tag, self.path, self.parent, self.away, self.weight, self.score, self.doubt = tag, path, parent, away, weight, 0.0, doubt
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or not parent else parent.block
        self.container = self if tag in CONTAINER else parent and parent.container
        self.stop = self if tag == "p" or tag in CONTAINER else parent and parent.stop  # where an open paragraph is looked for no further
        self.doubtful = self if doubt else parent and parent.doubtful
        self.sectioned = tag in ("article", "main", "section") or bool(parent and parent.sectioned)
        self.chosen: bool | None = None
        self.held = [0, 0, 0]


PATH, LABEL = 512, 128  # characters: longer paths and labels go on from a digest of what was


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else "#" + hashlib.blake2b(text.encode(errors="replace"), digest_size=16).hexdigest()


def _below(parent: Element, label: str) -> str:
    return f"{_short(parent.path, PATH)}>{_short(label, LABEL)}" if parent.path else _short(label, LABEL)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _NAMED.findall(raw)}


def _element(tag: str, raw: str, parent: Element) -> Element:
    label, weight, doubt = tag, 1.5 if tag in ("article", "main") else 1.0, NO_DOUBT
    away = tag in AWAY_TAGS or parent.away
    if raw.strip():
        a = _attributes(raw)
        names = a.get("class", "").lower()
        if names:
            label = ".".join([tag, *sorted(re.sub(r"\d+", "0", x) for x in names.split())[:3]])
        if not away and tag not in ("html", "body", "article", "main"):
            both = f"{names} {a.get('id', '').lower()}"
            if ALWAYS_AWAY_NAMES.search(both):
                away = True
            elif AWAY_NAMES.search(both):
                away = tag not in BLOCK
                doubt = SOME_DOUBT if any(GOOD_NAMES.search(x) and not AWAY_NAMES.search(x) for x in both.split()) else DOUBT
            elif GOOD_NAMES.search(both):
                weight = 1.25
        style = a.get("style", "").replace(" ", "").lower()
        away = away or a.get("role", "").lower() in AWAY_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    if tag == "header":
        away = away or not parent.sectioned
    return Element(tag, _below(parent, label), parent, away, weight, doubt)


def _without_doubtful(blocks: list[tuple[str, int, Element]], doubtful: list[Element]) -> list[tuple[str, int, Element]]:
    """blocks less those in elements of doubtful names (given as they were opened), unless these hold most of the prose or look like content."""
    page = 0
    for text, links, owner in blocks:
        prose = max(0, len(text) - 2 * links)
        page += prose
        if owner.doubtful:
            _add(owner.doubtful.held, (prose, links, len(text)))
    for e in reversed(doubtful):  # inner ones first
        if e.parent.doubtful:
            _add(e.parent.doubtful.held, e.held)
    dropped = set()
    for e in doubtful:
        prose, links, n = e.held
        if not (2 * prose > page or (e.doubt == SOME_DOUBT and 5 * links <= n)) or e.parent.doubtful in dropped:
            dropped.add(e)
    return [b for b in blocks if b[2].doubtful not in dropped]


def _add(total: list[int], more: Iterable[int]) -> None:
    total[:] = (a + b for a, b in zip(total, more))


def read(page: str) -> list[tuple[str, int, Element]]:
    """The page's blocks outside of dropped elements, in order: text, characters in links, innermost element."""
    root = Element("", "", None, False, 1.0)
    stack, blocks, text, open_tags, doubtful = [root], [], [], Counter(), []
    owner, links, in_link, at, n = root, 0, 0, 0, len(page)

    def close_block() -> None:
        nonlocal links
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                blocks.append((joined, links, owner))
            text.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links, owner
        top = stack[-1]
        if top.away or not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        if not text:
            owner = top.block
        text.append(piece)
        if in_link:
            links += len(piece.strip())

    def pop_to(k: int) -> None:
        nonlocal in_link
        gone = Counter(e.tag for e in stack[k:])
        in_link -= gone["a"]
        open_tags.subtract(gone)
        del stack[k:]

    while at < n:
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close_block()
            if open_tags[tag]:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            close_block()
            if tag in ENDS_PARAGRAPH:
                stop = stack[-1].stop
                if stop and stop.tag == "p":
                    pop_to(stop.depth)
            if tag in SAME_ENDS and any(open_tags[t] for t in SAME_ENDS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in STOPS[tag]:
                        break
                    if stack[k].tag in SAME_ENDS[tag]:
                        pop_to(k)
                        break
        if tag in VOID or m[3].endswith("/"):
            continue
        top = stack[-1]
        if top.away and tag not in BLOCK and tag != "a":  # only its end matters
            new = Element(tag, top.path, top, True, 1.0)
        elif tag in BLOCK or m[3]:
            new = _element(tag, m[3], top)
        else:
            new = Element(tag, top.path, top, top.away or tag in AWAY_TAGS, 1.0)
        stack.append(new)
        open_tags[tag] += 1
        in_link += tag == "a"
        if new.doubt:
            doubtful.append(new)
    close_block()
    return _without_doubtful(blocks, doubtful) if doubtful else blocks


def _containers(e: Element | None) -> Iterator[Element]:
    """The containers around an element, the innermost first."""
    e = e and e.container
    while e:
        yield e
        e = e.parent and e.parent.container


def _is_chosen(e: Element, chosen: set[str]) -> bool:
    """Whether an element or one around it has a chosen path; what is found out is noted on the way."""
    way = []
    while e.tag and e.chosen is None and e.path not in chosen:
        way.append(e)
        e = e.parent
    found = bool(e.tag) and e.chosen is not False
    for x in way:
        x.chosen = found
    return found


def scores(blocks: list[tuple[str, int, Element]]) -> dict[str, float]:
    """Scores of the page's containers, added up by path; empty if there is no text in containers."""
    scored: dict[int, Element] = {}
    for text, links, owner in blocks:
        value = max(0, len(text) - 2 * links)
        for share, e in zip((1.0, 0.5, 0.25), _containers(owner)):
            e.score += share * value * e.weight
            scored[id(e)] = e
    paths: dict[str, float] = {}
    for e in scored.values():
        paths[e.path] = paths.get(e.path, 0.0) + e.score
    return paths


def _above(path: str) -> str:
    return path.rpartition(">")[0]


def text_of(blocks: list[tuple[str, int, Element]], votes: dict[str, int]) -> str:
    """The blocks below the elements of the host's winning paths, else below the page's own best container."""
    own = scores(blocks)
    if not own:
        return "\n\n".join(t for t, _, _ in blocks)
    best = min(own, key=lambda p: (-own[p], p))
    taken = min((p for p in votes if p in own), key=lambda p: (-own[p], -votes[p], p), default=None)
    if taken is None or own[taken] < BESIDE * own[best]:
        taken = best
    chosen = {taken} | {p for p, v in votes.items() if _above(p) == _above(taken) and v >= BESIDE * votes.get(taken, v)}
    return "\n\n".join(t for t, _, owner in blocks if _is_chosen(owner, chosen))


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        tally: dict[tuple[str, str], int] = {}
        for host, page in zip(f["host"], f["html"]):
            own = scores(read(page or ""))
            best = max(own.values(), default=0.0)
            for path, score in own.items():
                if best and score >= LEAST_VOTE * best:  # whole numbers: sums don't depend on their order
                    tally[host, path] = tally.get((host, path), 0) + round(score / best * 1000)
        yield pd.DataFrame([(h, p, v) for (h, p), v in tally.items()], columns=["host", "path", "votes"])


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        won = [dict(zip(x["path"], x["votes"])) if x is not None else {} for x in f["won"]]
        f["text"] = [text_of(read(page or ""), votes) for page, votes in zip(f["html"], won)]
        yield f[["page_id", "url", "host", "text"]]


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the winning paths of each host, twenty at most."""
    votes = pages.mapInPandas(_votes, "host string, path string, votes long")
    summed = written(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    every = summed.groupBy("host").agg(F.sum("votes").alias("every"))
    return summed.join(every, "host").where(F.col("votes") >= LEAST_WIN * F.col("every")).select("host", "path", "votes")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, text, n_chars) for every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", parts(F.col("url"))["host"].alias("host"), F.col("html").cast("string").alias("html"))
    winners = host_paths(rows.select("host", "html")).groupBy("host").agg(F.struct(F.collect_list("path").alias("path"), F.collect_list("votes").alias("votes")).alias("won"))
    joined = rows.join(small_or_shuffled(written(winners), HOST_ROWS), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = joined.select("page_id", "url", "host", "html", "won").mapInPandas(_texts, f"page_id {kind}, url string, host string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
