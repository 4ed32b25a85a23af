"""Main text of web pages by two-pass block rules.

Pass one looks at each block alone: its length, its share of link text and its density of stop words make it
good, bad, nearly good or short. Pass two lets the undecided blocks inherit from the nearest decided ones before
and after. Containers that aren't prose by their element, role or full name (``nav``, ``role=search``,
``class="cookie-notice"``) are bad beforehand; a name that only has such a word among others
(``related-work``) decides nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words of common languages (fixed values).
STOP_WORDS = frozenset(
    """a an and are as at be been but by can for from had has have he her his i if in into is it its me my no not of on or our she so
    than that the their them then there they this to up us was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die dies doch du durch ein eine einem einen einer es für hat ich
    ihr im in ist ja kein man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    à au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on
    ou où par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous
    al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto la las le les lo los más
    me mi muy nada ni no nos o para pero por que se ser sin sobre su sus también te tiene todo tu un una uno y ya yo
    che da dei del della di e gli il io non per più sono sul uno het een en van niet zijn dat voor met op te ook naar
    com da das do dos em mais mas na nas no nos não os ou para pela pelo são seu sua um uma""".split()
)
#: Blocks shorter than LONG characters may be short; stop-word densities; highest share of link text; how far a heading may lie before a good block.
SHORT, LONG, LOW, HIGH, MAX_LINKS, HEADING_REACH = 70, 200, 0.10, 0.18, 0.5, 200
#: Share of a page's text in blocks dense in stop words below which it is in no language that is listed.
LISTED = 0.1

_SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video textarea select option datalist head title".split())
#: Of these, elements whose content is no markup: without an end tag they reach to the end of the page.
_RAW = frozenset("script style noscript iframe textarea title".split())
_BOILER = frozenset("nav footer aside form menu button dialog fieldset label legend input".split())
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
    th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id names of boilerplate: sure ones, ones that the main text's containers may have as well, and
#: ones that may stand beside either. A name counts only if it is made of such words alone.
_STRONG = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments commentlist disqus replies reply
    respond cookie cookies consent gdpr newsletter subscribe signup popup modal overlay related recommended recommendations share sharing
    social breadcrumb breadcrumbs pagination pager copyright login notice alert paywall teaser teasers outbrain taboola skip""".split()
)
_WEAK = frozenset("sidebar side nav navbar navigation menu footer header masthead banner topbar toolbar widget widgets search tags meta".split())
_BESIDE = frozenset(
    """area articles bar bars block blocks box boxes btn btns button buttons col column container content div form group icons inner item items
    left right top bottom main site page primary secondary global link links list lists more news outer panel post posts read row section
    slot stories thread title unit us wrap wrapper you also popular latest follow sticky fixed mobile desktop""".split()
)
_MAIN = frozenset("article articlebody content main entry post story blog text body".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CLOSES_P = _BLOCKS - {"body", "html", "option", "optgroup"}

#: Attributes are read without going back, so that broken markup takes linear time.
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:_-]{0,60}+)(?P<attr>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:_-]{0,60}+)(?P<attr2>[^<>]*+)>",
    re.S,
)
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_OTHER_SCRIPT = re.compile(r"[^\x00-\u024f\u1e00-\u1eff]")  # beyond the blocks of Latin letters
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the content of each closed element of a name begins, and where its end tag ends; of nested ones
    without enough end tags the outer ones are open."""
    out: dict[int, int] = {}
    opened: list[int] = []
    raw = "|".join(sorted(_RAW))
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<({raw})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?P<close>/?){name}(?=[\s/>])", page, re.S | re.I):
        if m["close"] is None:
            continue
        if not m["close"]:
            if tag := _MARK.match(page, m.start()):
                if not (tag["attr"] or tag["attr2"] or "").rstrip().endswith("/"):
                    opened.append(tag.end())
        elif opened:
            end = page.find(">", m.end())
            out[opened.pop()] = end + 1 if end >= 0 else len(page)
    return out


def _open_end(page: str, at: int) -> int:
    """Where an element without an end tag ends: before the next block, or before the end tag of its container."""
    inside: list[str] = []
    open_: Counter[str] = Counter()
    for m in _MARK.finditer(page, at):
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            return m.start()
        if m["close"] or m["close2"]:
            if not open_[name]:
                return m.start()
            last = ""
            while last != name:
                last = inside.pop()
                open_[last] -= 1
        elif name not in _VOID:
            inside.append(name)
            open_[name] += 1
    return len(page)


class Block:
    """One block: its text, characters inside links, and where it lies."""

    __slots__ = ("boiler", "heading", "label", "links", "main", "text")

    def __init__(self, text: str, links: int, boiler: bool, main: bool, heading: bool) -> None:
        self.text, self.links, self.boiler, self.main, self.heading, self.label = text, links, boiler, main, heading, ""


def _place(name: str, attr: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it holds the main text."""
    boiler = name in _BOILER or (name == "header" and not in_main)
    main = name in ("article", "main")
    if not attr or name in ("html", "body"):
        return boiler, main
    values = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attr)}
    names = [{t.lower() for t in _TOKEN.findall(n)} for n in f"{values.get('class', '')} {values.get('id', '')}".split()]
    style = values.get("style", "").replace(" ", "").lower()
    role = values.get("role", "").lower()
    if re.search(r"(?:^|\s)hidden(?:\s|$)", attr) or values.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or role in _ROLES:
        return True, False
    if values.get("itemprop", "").lower() == "articlebody" or role in ("main", "article"):
        main = True
    if any(n & _STRONG and n <= _STRONG | _WEAK | _BESIDE for n in names):
        return True, False
    if any(n & _MAIN and not n & (_STRONG | _WEAK) for n in names) and name in ("div", "section", "td"):
        return boiler, True
    return boiler or (any(n & _WEAK and n <= _STRONG | _WEAK | _BESIDE for n in names) and not main), main


def blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order; white space inside a block becomes one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, boilerplate, main
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name
    parts: list[tuple[str, bool]] = []
    boiler = main = linked = broken = False
    heading = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                links = sum(len(" ".join(t.split())) for t, a in parts if a)
                out.append(Block(text, links, boiler, main, heading > 0))
            parts.clear()

    def pop_to(n: int) -> None:
        nonlocal boiler, main
        for x, _, _ in stack[n:]:
            places[x].pop()
        del stack[n:]
        boiler, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def push(name: str) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, boiler, main))

    def close(name: str, until: frozenset) -> None:
        if (own := places.get(name)) and all(not (x := places.get(u)) or x[-1] <= own[-1] for u in until):
            pop_to(own[-1])

    ends: dict[str, dict[int, int]] = {}
    at, size = 0, len(page)
    while at < size:
        m = _MARK.search(page, at)
        if m is None:
            parts.append((html.unescape(page[at:]), linked))
            break
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), linked))
            broken = broken and not page[at : m.start()].strip()
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending = bool(m["close"] or m["close2"])
        attr = m["attr"] or m["attr2"] or ""
        if name in _SKIPPED and not ending and not attr.rstrip().endswith("/"):
            if name == "head" or name in _VOID:
                continue
            if name not in _RAW:
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name][at] if at in ends[name] else _open_end(page, at)
                continue
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            parts.append((" ", linked))
            if broken:
                flush()
            broken = True
            continue
        broken = False
        if name == "a":
            linked = not ending
            continue
        if name not in _BLOCKS:
            if not ending and name not in _VOID and attr and (place := _place(name, attr, main))[0] and not attr.endswith("/"):
                flush()
                boiler = True
                push(name)
            elif ending and places.get(name):
                flush()
                close(name, frozenset())
            continue
        flush()
        linked = False
        if ending:
            close(name, frozenset())
            heading = 0 if name in _HEADING else heading
            continue
        if name in _CLOSES_P:
            close("p", frozenset(("td", "th", "table", "article", "section", "div", "li", "blockquote", "body")))
        if name == "li":
            close("li", frozenset(("ul", "ol", "menu")))
        elif name in ("dd", "dt"):
            close("dd", frozenset(("dl",)))
            close("dt", frozenset(("dl",)))
        elif name in ("td", "th", "tr"):
            close("td", frozenset(("table", "tr")))
            close("th", frozenset(("table", "tr")))
        heading = int(name in _HEADING)
        if name not in _VOID and not attr.endswith("/"):
            bad, good = _place(name, attr, main)
            boiler = boiler or bad
            main = (main or good) and not boiler
            push(name)
    flush()
    return out


def stop_density(text: str) -> float:
    """Share of a text's words that are stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _nearest(found: list[Block], labels: list[str], skip: tuple[str, ...], back: bool = False, own: bool = True) -> list[str]:
    """Of each block the label of the nearest block before it (or after) that isn't in ``skip``.

    Blocks of the main text look only among each other if ``own``; where there is none, theirs is good and
    that of the others bad.
    """
    out = [""] * len(found)
    last, last_main = "bad", "good"
    for i in range(len(found) - 1, -1, -1) if back else range(len(found)):
        out[i] = last_main if found[i].main and own else last
        if labels[i] not in skip:
            last = labels[i]
            if found[i].main:
                last_main = labels[i]
    return out


def _is_listed(found: list[Block]) -> bool:
    """Whether the stop words are those of a page's language.

    Told by its blocks of some length that aren't links: they aren't if most letters are of another script, or if next
    to nothing of a text of some length is dense in them (a language of which no words are listed).
    """
    length = dense = letters = other = 0
    for b in found:
        if not b.boiler and len(b.text) >= SHORT and b.links <= MAX_LINKS * len(b.text):
            length += len(b.text)
            dense += len(b.text) if stop_density(b.text) >= LOW else 0
            words = "".join(_WORD.findall(b.text))
            letters, other = letters + len(words), other + len(_OTHER_SCRIPT.findall(words))
    return 2 * other <= letters and (length < LONG or dense >= LISTED * length)


def classify(found: list[Block]) -> list[Block]:
    """Set the label of every block to good or bad."""
    listed = _is_listed(found)
    for b in found:
        n = len(b.text)
        if b.boiler or b.links > MAX_LINKS * n:
            b.label = "bad"
        elif not b.main and ("©" in b.text or "|" in b.text and b.links):
            b.label = "bad"
        else:
            dense = stop_density(b.text) if listed else HIGH if n >= SHORT else 0.0  # unlisted: length and links decide
            if b.main:
                b.label = "good" if n >= SHORT or dense >= LOW else "short"
            elif n < SHORT:
                b.label = "bad" if b.links else "short"
            elif dense >= HIGH:
                b.label = "good" if n > LONG else "near"
            elif dense >= LOW:
                b.label = "near"
            else:
                b.label = "bad"
    first = [b.label for b in found]
    before, after = _nearest(found, first, ("short", "near")), _nearest(found, first, ("short", "near"), back=True)
    before_near, after_near = _nearest(found, first, ("short",)), _nearest(found, first, ("short",), back=True)
    for i, b in enumerate(found):
        if first[i] == "short":
            sides = {before[i], after[i]}
            if b.main:
                b.label = "bad" if sides == {"bad"} else "good"
            elif len(sides) == 1:
                b.label = before[i]
            else:
                b.label = "good" if "near" in (before_near[i], after_near[i]) else "bad"
    second = [b.label for b in found]
    before, after = _nearest(found, second, ("near",), own=False), _nearest(found, second, ("near",), back=True, own=False)
    some = "good" in second
    for i, b in enumerate(found):
        if second[i] == "near":
            b.label = "bad" if some and before[i] == after[i] == "bad" else "good"
    for i, b in enumerate(found):
        if b.heading and b.label == "bad" and first[i] == "short":
            distance = 0
            for c in (found[k] for k in range(i + 1, len(found))):
                if distance > HEADING_REACH:
                    break
                if c.label == "good":
                    b.label = "good"
                    break
                distance += len(c.text)
    return found


def extract(page: str | None) -> str:
    """Main text of a page: its good blocks, joined by newlines."""
    return "\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *keep: str) -> DataFrame:
    """Per row of ``pages``: ``id``, the columns in ``keep``, ``text`` and ``n_chars``.

    Null and empty pages, and pages without a good block, have the empty text. Pages are independent of
    each other: there is no shuffle, and repeated rows give repeated results. Broken markup is read as
    far as it goes; whole pages are read, in linear time, whatever their length and nesting. ``keep`` may
    not name id, text or n_chars.
    """
    if clash := {"id", "text", "n_chars"} & set(keep):
        raise ValueError(f"rename the kept columns {sorted(clash)}: the result has columns of that name")
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("main_text_html"), *keep)
    names = [n for n in rows.columns if n != "main_text_html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(1).to_pylist()]
            cols = [c for i, c in enumerate(b.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "main_text_html")
    return rows.mapInArrow(run, f"{fields}, text string").withColumn("n_chars", F.length("text").cast("long"))
