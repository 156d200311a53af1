"""Main text of HTML pages by line-block distribution.

A page is stripped of its markup to lines, one for each block of text. A line weighs the length of its text outside links; a heading above text, and a line inside ``article`` or
``main``, weighs a surge more. On every page weights are summed over a sliding window of lines. The text surges at a line of some weight whose window passes the threshold, and dives
behind the last such line; what lies between is the main text, lines of links and short ones included. At both ends it reaches on over the lines of the container that the
surging line is in, but not back over a heading that opens it.

Markup that names boilerplate takes lines out of the distribution: menus, headers, footers, sidebars and what isn't shown, by their elements and roles (but a pull quote inside an
article); forms, dialogs and containers whose class or id says nothing but what boilerplate is called (``cookie-notice`` or ``adbox``, not ``has-sidebar``), and those that begin with a
heading such as ``Comments`` or ``Related posts``, unless they wrap the main text: outside there is no text to speak of, or, comments aside, inside is more than four fifths of it in
several lines. Inline elements are out only where they are called adverts. A notice of copyright after the last other line outside an article is out as well. A class or id that only mentions such a name divides the weights of its lines by four, with the
same exception, and no more.

Defined cases: null html counts as empty and gives an empty text; broken markup is read leniently (an unclosed tag ends with the page, a stray
``<`` is text); character references are decoded, once; other columns pass through, and input columns named like an output column, in any letters, are
replaced; repeated rows are extracted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .common import Taken, portions, small_batches, text_of

#: Lines on each side of a line that its window takes in, and the least weights of a surge's window and of its first line.
REACH, SURGE, START = 1, 60, 20
#: What the weight of a line is divided by where a class or id mentions boilerplate.
DOUBT = 4
#: Times the free text that a container of boilerplate must hold, and its lines, to be taken for a wrapper.
MOST, SEVERAL = 4, 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it ends with their own end tag.
RAW = frozenset("script style noscript template iframe textarea title noembed canvas".split())
#: Start tags that leave an open head open; any other, and text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript noframes template".split())
BOILER = frozenset("nav aside footer head menu button select".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar".split())
#: Elements and roles that are boilerplate unless they wrap the text.
WRAPS, WRAP_ROLES = frozenset("form dialog fieldset".split()), frozenset("form dialog alertdialog alert".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Parts of class names and ids that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert"
    " newsletter subscribe subscription signup login sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pager pagination header masthead footer copyright"
    " comment comments respond disqus replies reply share sharing social related recommended widget toolbar cc adsbygoogle".split()
)
#: Those of them that are adverts.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion".split())
#: What an aside is called that quotes the text around it.
QUOTES = frozenset("quote pullquote pull quotation blockquote".split())
#: Headings of readers' comments and of links to other texts.
HEADED = re.compile(r"(?:\d+ +)?(?:reader |user |visitor |all )?(?:comments?|responses|repl(?:y|ies)|discussion)(?: *[(\d][\d)]*)?|(?:leave|post|write|add) an? (?:comment|reply|response)|join the (?:discussion|conversation)|related (?:articles?|posts?|stor(?:y|ies)|content|reading|links)|you (?:may|might) also (?:like|enjoy)|share this(?: \w+)?|sponsored(?: content)?|advertisements?", re.I)
RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b).*", re.I | re.S)
#: Those of them that are readers' comments.
COMMENTS = frozenset("comment comments respond disqus replies reply".split())
#: What stands beside such a name in a class that says nothing else.
FILL = frozenset(
    "area article articles bar block body box bottom button buttons card cards container content entry feed field fields footer form global google group holder icon icons inline inner item items layer"
    " left link links list main message mid middle module outer page pane panel post posts primary reader readers region right row secondary section site slot space story stories text thread title top unit"
    " user users window wrap wrapper zone".split()
)
#: A header of these holds a title.
TITLED = frozenset("article content entry post story".split())
#: Elements that a start tag of the key closes if one is open.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
LEVELS = frozenset(f"h{k}" for k in range(1, 7))
#: Elements that hold blocks of one text.
CONTAINERS = frozenset("article aside body details dialog div dd fieldset figure footer form header li main menu nav section table td".split())
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WHITE = re.compile(r"[\s\x00]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', raw text, ''), ('open', name, attributes) and ('close', name, ''); comments, declarations and raw content are left out."""
    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        if mark > at:
            yield "text", page[at:mark], ""
        if page.startswith("<!--", mark):
            # "<!-->" and "<!--->" are empty comments.
            end = page.find("-->", mark + 2)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
        elif hit := TAG.match(page, mark):
            name, end = hit[1].lower(), hit.end()
            while True:  # to the first > outside quotes
                stop = page.find(">", end)
                if stop < 0:
                    return
                quote = min((q for q in (page.find('="', end, stop), page.find("='", end, stop)) if q >= 0), default=-1)
                if quote < 0:
                    break
                end = page.find(page[quote + 1], quote + 2) + 1
                if not end:
                    end = stop
                    break
            at = stop + 1
            if page[mark + 1] == "/":
                yield "close", name, ""
                continue
            yield "open", name, page[hit.end() : stop]
            if name in RAW and page[stop - 1] != "/":
                ending = ENDS[name].search(page, at)
                if not ending:
                    return
                at = ending.start()
        else:
            yield "text", "<", ""
            at = mark + 1


def attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(said)} if said.strip(" /") else {}


#: What an element says of its lines.
FREE, HARD, CLEAR, REMARK, VAGUE = range(5)


def parts_of(token: str) -> list[str]:
    """The words of a class name or id; one that is put together of a name and what stands beside names is two."""
    out = []
    for w in re.split(r"[_\-:.]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()):
        w = re.sub(r"\d+$", "", w)
        if w and w not in NAMES and w not in FILL:
            two = next(((w[:k], w[k:]) for k in range(2, len(w) - 2) if w[:k] in NAMES and (w[k:] in FILL or w[k:] in NAMES)), None)
            out += two or [w]
        elif w:
            out.append(w)
    return out


def said_of(name: str, said: str, in_article: bool) -> int:
    """HARD: boilerplate; CLEAR and REMARK (comments): boilerplate but for a wrapper; VAGUE: doubtful; FREE: nothing."""
    if name == "aside" and in_article and QUOTES.intersection(re.findall(r"[a-z]+", attributes(said).get("class", "").lower())):
        return FREE
    if name in BOILER or name in RAW or (name == "header" and not in_article):
        return HARD
    found = CLEAR if name in WRAPS else FREE
    if not said or name in ("html", "body", "article", "main"):
        return found
    a = attributes(said)
    role = a.get("role", "").lower()
    if role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display:\s*none|visibility:\s*hidden", a.get("style", ""), re.I):
        return HARD
    if role in WRAP_ROLES:
        found = CLEAR
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = parts_of(token)
        names = NAMES.intersection(words)
        if name not in BLOCKS:
            if names & ADVERTS and all(w in FILL or w in NAMES for w in words):
                return HARD
            continue
        # A header inside an article, such as ``post-header``, holds its title.
        if "header" in names and (in_article or TITLED.intersection(words)):
            names -= {"header"}
        if not names:
            continue
        if any(w not in FILL and w not in NAMES for w in words):
            found = found or VAGUE
        elif names & COMMENTS:
            return REMARK
        else:
            found = CLEAR
    return found


class Line(NamedTuple):
    """A block of text: its characters outside links, whether it is boilerplate for certain, in ``article`` or ``main``, or a heading of the first two or of any level, the innermost of
    the nodes (containers that say something) it is in, and the lines from ``top`` to before ``end`` of its container."""

    text: str
    plain: int
    hard: bool
    marked: bool
    heading: bool
    headed: bool
    node: int
    top: int
    end: int


def lines_of(page: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """The lines of a page in order, and the nodes: what each says, and the node around it (-1: none)."""
    out: list[list] = []
    nodes: list[tuple[int, int]] = []
    stack: list[tuple[str, int, bool, int, int]] = []  # name, what it says, main, its node or the one around it, place of its container
    parts: list[str] = []
    linked = links = mute = hard = main = 0
    heading = headed = False
    opened: Counter[str] = Counter()  # of the stack, so that it isn't searched in vain
    spans: list[list[int]] = [[0, -1]]  # lines of the containers; the first is the page

    def close_line() -> None:
        nonlocal linked, heading, headed
        # References are decoded after joining: markup can't be inside one, but a stray < may cut a text in two.
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                node, span = (stack[-1][3], stack[-1][4]) if stack else (-1, 0)
                out.append([text, max(0, len(text) - linked), hard > 0, main > 0, heading, headed, node, span])
            parts.clear()
        linked, heading, headed = 0, False, False

    def pop() -> None:
        nonlocal hard, main, links, mute
        name, says, inside, _, span = stack.pop()
        opened[name] -= 1
        main, links = main - inside, links - (name == "a")
        if says == HARD:
            hard, mute = hard - (name in BLOCKS), mute - (name not in BLOCKS)
        if name in CONTAINERS:
            spans[span][1] = len(out)

    for kind, name, said in tokens(page):
        if stack and stack[-1][0] == "head" and (name.strip() if kind == "text" else kind == "open" and name not in IN_HEAD):
            close_line()
            pop()
        if kind == "text":
            if mute:
                continue
            parts.append(name)
            if links:
                linked += len(name.strip())
        elif kind == "open":
            if name == "br":
                parts.append(" ")
                continue
            if name in BLOCKS or name in RAW:
                close_line()
            if name in VOID:
                continue
            if name in CLOSES or name in BLOCKS:
                ends = CLOSES.get(name, ("p",))
                # An open element of the same list or row ends here, with the inline elements in it; a block ends an open paragraph.
                for k in range(len(stack) - 1, -1, -1) if any(opened[e] for e in ends) else ():
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BLOCKS and stack[k][0] not in ("td", "th"):
                        break
            heading, headed = heading or name in ("h1", "h2"), headed or name in LEVELS
            says, inside = said_of(name, said, main > 0), name in ("article", "main")
            node, span = (stack[-1][3], stack[-1][4]) if stack else (-1, 0)
            if says > HARD:
                nodes.append((says, node))
                node = len(nodes) - 1
            if name in CONTAINERS:
                spans.append([len(out), -1])
                span = len(spans) - 1
            stack.append((name, says, inside, node, span))
            opened[name] += 1
            main, links = main + inside, links + (name == "a")
            if says == HARD:
                hard, mute = hard + (name in BLOCKS), mute + (name not in BLOCKS)
        else:
            if name in BLOCKS or name in RAW:
                close_line()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if name not in BLOCKS and stack[k][0] in BLOCKS:
                    break  # an inline end tag closes nothing outside its block
    close_line()
    size = len(out)
    return [Line(*x[:7], spans[x[7]][0], spans[x[7]][1] if spans[x[7]][1] >= 0 else size) for x in out], nodes


def wrappers(lines: list[Line], nodes: list[tuple[int, int]]) -> list[bool]:
    """Which nodes wrap the main text, so that what they say doesn't count. The nodes not inside others that count are looked at from the one with most text on; the lines of
    one that wraps are free from then on, and the nodes in it are looked at as well."""
    mass, count, free, marked = [0] * len(nodes), [0] * len(nodes), 0, False
    own = [[0, False] for _ in nodes]
    for x in lines:
        if x.hard:
            continue
        if x.node < 0:
            free, marked = free + x.plain, marked or x.marked
        else:
            own[x.node][0] += x.plain
            own[x.node][1] = own[x.node][1] or x.marked
            mass[x.node] += x.plain
            count[x.node] += x.plain > 0
    inner: list[list[int]] = [[] for _ in nodes]
    # A node comes after the one around it.
    for k in range(len(nodes) - 1, -1, -1):
        if (around := nodes[k][1]) >= 0:
            mass[around] += mass[k]
            count[around] += count[k]
            inner[around].append(k)
    out = [False] * len(nodes)
    todo = [(-mass[k], k) for k, (_, around) in enumerate(nodes) if around < 0]
    heapq.heapify(todo)
    while todo:
        _, k = heapq.heappop(todo)
        alone = free < SURGE and not marked
        if mass[k] and (alone or nodes[k][0] != REMARK and mass[k] > MOST * free and count[k] >= SEVERAL):
            out[k] = True
            free, marked = free + own[k][0], marked or own[k][1]
            for i in inner[k]:
                heapq.heappush(todo, (-mass[i], i))
    return out


def weighed(lines: list[Line], nodes: list[tuple[int, int]]) -> list[float | None]:
    """Weights of the lines; None for boilerplate."""
    wraps = wrappers(lines, nodes)
    out_of, doubt = [False] * len(nodes), [False] * len(nodes)
    for k, (says, around) in enumerate(nodes):
        out_of[k] = (says in (CLEAR, REMARK) and not wraps[k]) or (around >= 0 and out_of[around])
        doubt[k] = (says == VAGUE and not wraps[k]) or (around >= 0 and doubt[around])
    plain = [None if x.hard or (x.node >= 0 and out_of[x.node]) else x.plain / (DOUBT if x.node >= 0 and doubt[x.node] else 1) for x in lines]
    beside(lines, plain)
    out: list[float | None] = []
    for k, (x, w) in enumerate(zip(lines, plain, strict=True)):
        above = x.heading and any(y is not None and y >= START for y in plain[k + 1 : k + 3])
        out.append(w if w is None else w + SURGE * x.marked + SURGE * above)
    return out


def beside(lines: list[Line], plain: list[float | None]) -> None:
    """Take out containers that begin with a heading of comments or links, unless most of the text is in one, and a notice of copyright at the end."""
    total = sum(w or 0 for w in plain)
    for k, x in enumerate(lines):
        # The page itself and what the article is in begin with it only if there is nothing before.
        if x.headed and plain[k] is not None and HEADED.fullmatch(x.text.strip(" :.")) and x.top == k and x.end - x.top < len(lines):
            inside = range(x.top, x.end)
            size = sum(plain[j] or 0 for j in inside)
            # Texts have sections of discussion, but none of comments.
            if total - size >= SURGE if "comment" in x.text.lower() else 2 * size < total:
                for j in inside:
                    plain[j] = None
    there = [k for k, w in enumerate(plain) if w is not None]
    if len(there) > 1 and not lines[there[-1]].marked and RIGHTS.fullmatch(lines[there[-1]].text):
        plain[there[-1]] = None


def main_lines(lines: list[Line], weights: list[float | None]) -> list[int]:
    """Positions of the lines of the main text: from its first surge to its last dive, less boilerplate."""
    heavy = [w or 0 for w in weights]
    # A page may be short as a whole.
    least = min(SURGE, max(heavy, default=0))
    surges = [k for k, w in enumerate(heavy) if w and w >= min(START, least) and sum(heavy[max(0, k - REACH) : k + REACH + 1]) >= least]
    if not surges:
        return []
    first, last = surges[0], surges[-1]
    top = first if lines[first].heading else lines[first].top
    return [k for k in range(top, max(last + 1, lines[last].end)) if weights[k] is not None]


def extract(page: str) -> str:
    lines, nodes = lines_of(page)
    return "\n".join(lines[k].text for k in main_lines(lines, weighed(lines, nodes)))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (its code points)."""
    own = Taken(pages)
    names = own.stay(("text", "n_chars"), (column,))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in portions(batches, "page"):
            out = x[names].copy()
            out["text"] = [extract(p) for p in x["page"]]
            out["n_chars"] = [len(t) for t in out["text"]]
            yield out

    return own.mapped(run, names, "text string, n_chars long", page=text_of(own.at(column)))


def op10(spark, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(spark)
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
