"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass classifies a block by its
length, its share of characters in links and its share of stop words as good, bad, nearly
good, or short; what stands in navigation, footers, side bars, forms, adverts, notices or
reader comments (by tag, class, id or role) is bad at once.  In a class name or id the last
word that is no shape ("content", "list") counts: "post-comments" is boilerplate, "cookie-recipe"
is not.  Names of the page's state ("no-sidebar", "comments-open") and names on ``html``,
``body``, ``main`` and ``article`` say nothing, nor does a name on an element that holds the
page's main heading or article and most of its text.  Stop words of ``STOP_WORDS`` count; a page with next to
none of them is in another language, and there ends of sentences stand in for them.  In
the second pass nearly good and short blocks take the label of the nearest decided blocks before and after them;
a heading goes with the good block it precedes.  Where a page marks its article, blocks
outside it are bad and cannot pass labels into it, and a short block without decided
neighbours inside it is good.  A page without any good block keeps its nearly good ones or,
without those, its short ones.

Pages are independent, so this is one pass without a shuffle.

Defined results: null html counts as empty; a page without main text gives an empty text;
character references are decoded once; unclosed tags end with the element around them; an
unfinished tag or comment at the end is markup; repeated rows are extracted each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.05, 0.12
MAX_LINKS = 0.2
HEADING_REACH = 200

STOP_WORDS = {
    "en": "the of and to in a is it that for was on are with as be at this by from or an not have but",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus",
    "it": "di che e la il un a per in una non sono mi ho si lo ma con le ha i da del della come anche più gli nel",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem",
    "nl": "de het een en van ik te dat die in je niet zijn is was op aan met als voor had er maar om hem dan zou",
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du",
    "da": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde",
    "pl": "i w się z na nie do to że jest a o jak po za co ale od przez dla tak był tym już może tylko być jego",
    "cs": "a se v na je že o s z do i to k ve pro za by ale si po jako podle od jsem tak jen jeho který nebo už",
    "ro": "de și în a la cu pe care nu o din este un mai să au ce pentru s-a fost prin sunt dar lui ale după",
    "hu": "a az és hogy nem is egy ez de azt csak meg volt van ha mint már még el vagy ki kell lesz nagyon",
    "fi": "ja on ei että se hän oli en mutta ovat kun niin myös sen joka mitä kuin tai nyt vain jos ole",
    "tr": "ve bir bu da de için ile ne o ben mi çok gibi daha ama var olan olarak kadar sonra en her değil",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от о так для ты же все",
    "uk": "і в не на що я з до він у це та як за по від але про або його так для вона ми було який",
    "bg": "и на да се в за от е не с че по са до си като но ще това бе му са или при",
    "el": "και το να του η της με που την από για τα είναι των σε ο οι στο θα τη στην δεν ένα μια αυτό",
    "ar": "في من على أن إلى التي عن لا ما هذا هذه كان مع الذي أو بعد قد كما لم بين كل قال و هو هي",
    "he": "של את על לא זה הוא היא עם אני כי גם או אם יש כל אל מה היה הם אבל רק עד כך",
    "hi": "के में है की से को का और पर ने एक यह कि हैं नहीं इस भी हो था तो जो ही कर लिए",
    "vi": "và của là có không được cho trong các một người với những này để đã khi từ về như ra thì cũng",
    "id": "yang dan di ini itu dengan untuk tidak dari dalam akan pada juga saya ke karena bisa ada mereka atau",
}
STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title head".split())
BAD_TAGS = frozenset("nav aside footer form button dialog menu fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar sidenav widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus replies reply respond share sharing social"
    " related recommended newsletter subscribe subscription login signin signup search searchbox form copyright pager pagination toolbar skip".split()
)
#: Words right before or after another word of a class name that make it the page's state ("no-sidebar", "comments-open").
STATE_BEFORE = frozenset("no not has have with without is are layout template".split())
STATE_AFTER = frozenset("open opened closed enabled disabled hide hidden show active inactive".split())
#: Words of a class name that say where or what shape an element is, not what it holds.
SHAPE_NAMES = frozenset(
    "content contents wrapper wrap inner outer container area box section list block item items body main page post posts entry entries single title heading text"
    " link links left right top bottom button buttons icon icons bar bars article articles group row col column unit slot holder panel region zone module component count".split()
)
SAFE_TAGS = frozenset("html body main article".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Za-z]+")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "canvas", "audio", "video")}
PLAIN = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?…。！？।؟](?:\W|$)")
#: A page with a smaller share of stop words is in a language without a list.
STOP_KNOWN = 0.02
PART_LOW, PART_HIGH = 0.25, 0.6


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    heading: bool
    bad: bool  # inside boilerplate
    article: int  # number of the article around it, or -1
    named: int = -1  # the innermost element around it that is boilerplate by name only, or -1
    tag: str = ""  # the element that it stands in


def bad_name(name: str, inside: bool) -> bool:
    """Whether a class name or id says that its element is boilerplate: its last word that is no shape does."""
    words = [w for w in NAME.findall(name)]
    nouns = [k for k, w in enumerate(words) if w not in SHAPE_NAMES and w not in STATE_AFTER]
    if not nouns:
        return False
    k = nouns[-1]
    if words[k] not in BAD_NAMES and not (words[k] == "header" and not inside):
        return False
    return not (k and words[k - 1] in STATE_BEFORE) and not (k + 1 < len(words) and words[k + 1] in STATE_AFTER)


def _is_bad(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether only a name says so."""
    if tag in BAD_TAGS or (tag == "header" and not inside):
        return True, False
    if not attributes:
        return False, False
    named = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and tag not in SAFE_TAGS:
            named = named or any(bad_name(one, inside) for one in value.split())
        elif name == "role" and value in BAD_ROLES:
            return True, False
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True, False
    return named, named


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order.  The work is linear in the page, whatever its nesting."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, bad, article, element bad by name
    open_tags: Counter[str] = Counter()
    links, articles, headings = 0, 0, 0
    around: list[int] = []  # of each element bad by name, the one around it
    holders: set[int] = set()  # elements bad by name right around an article or the main heading

    def squeeze(parts: list[str]) -> str:
        return " ".join(html_lib.unescape("".join(parts)).split())

    def close() -> None:
        if text and (whole := squeeze(text)):
            tag, bad, article, named = stack[-1] if stack else ("", False, -1, -1)
            out.append(Block(whole, len(squeeze(linked)), headings > 0, bad, article, named, "pre" if open_tags["pre"] else tag))
        text.clear()
        linked.clear()

    def leave(tag: str) -> None:
        nonlocal headings
        open_tags[tag] -= 1
        headings -= tag in HEADINGS

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS or tag == "head":
            close()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if closing:
            while open_tags[tag]:
                top = stack.pop()[0]
                leave(top)
                if top == tag:
                    break
        elif tag in BLOCK_TAGS or tag in HIDDEN_TAGS or tag == "span":
            if tag == "p" and stack and stack[-1][0] == "p":
                leave(stack.pop()[0])  # a paragraph ends where the next begins
            bad, article, named = stack[-1][1:] if stack else (False, -1, -1)
            main = tag in ("article", "main") or 'role="main"' in attributes or "articlebody" in attributes.lower()
            if (main or tag == "h1") and named >= 0:
                holders.add(named)
            if main and not bad and article < 0:
                article, articles = articles, articles + 1
            ill, by_name = _is_bad(tag, attributes, article >= 0)
            if by_name:
                around.append(named)
                named = len(around) - 1
            else:
                bad = bad or tag in HIDDEN_TAGS or ill
            stack.append((tag, bad, article, named))
            open_tags[tag] += 1
            headings += tag in HEADINGS
    close()
    return judged(out, around, holders)


def judged(blocks: list[Block], around: list[int], holders: set[int]) -> list[Block]:
    """Blocks in elements that are boilerplate by name are bad, unless that element holds an
    article or the main heading and most of the text outside other boilerplate."""
    size, holds = [0] * len(around), [e in holders for e in range(len(around))]
    for b in blocks:
        if b.named >= 0 and not b.bad:
            size[b.named] += len(b.text)
    for e in range(len(around) - 1, -1, -1):  # elements come after those around them
        if around[e] >= 0:
            size[around[e]] += size[e]
            holds[around[e]] |= holds[e]
    total = sum(len(b.text) for b in blocks if not b.bad)
    ill: list[bool] = []
    for e, outer in enumerate(around):
        ill.append(not (holds[e] and 2 * size[e] > total) or (outer >= 0 and ill[outer]))
    for b in blocks:
        b.bad = b.bad or (b.named >= 0 and ill[b.named])
    return blocks


def stop_share(text: str) -> float:
    words = [w.lower() for w in PLAIN.findall(text)]
    return sum(w in STOP for w in words) / max(1, len(words))


def stop_limits(blocks: list[Block]) -> tuple[float, float] | None:
    """Low and high share of stop words on this page, or None if its language has no list.

    Languages differ in how many small words they need, so the limits are at most a part of
    what the page's longer blocks have together.
    """
    share = stop_share(" ".join(b.text for b in blocks if not b.bad and len(b.text) >= LENGTH_LOW and b.linked <= MAX_LINKS * len(b.text)))
    return None if share < STOP_KNOWN else (min(STOP_LOW, share * PART_LOW), min(STOP_HIGH, share * PART_HIGH))


def classify(block: Block, limits: tuple[float, float] | None = (STOP_LOW, STOP_HIGH)) -> str:
    """First pass: good, bad, near or short."""
    n = len(block.text)
    if block.bad:
        return "bad"
    if block.linked > MAX_LINKS * n or (n < LENGTH_LOW and block.linked):
        return "short" if block.tag == "p" and block.linked < n else "bad"  # a paragraph with a link in it is perhaps no list of links
    if block.tag == "pre":
        return "near"  # code has no stop words
    if n < LENGTH_LOW:
        return "short"
    if limits is None:
        return "near" if not SENTENCE_END.search(block.text) or n <= LENGTH_HIGH else "good"
    stop = stop_share(block.text)
    if stop >= limits[1]:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if stop >= limits[0] else "bad"


def label(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    marked = any(b.article >= 0 and not b.bad for b in blocks)
    limits = stop_limits(blocks)
    first = [classify(b, limits) for b in blocks]
    if marked:
        for k, b in enumerate(blocks):
            if b.article < 0:
                first[k] = "out"
            elif first[k] == "bad" and not b.bad and b.linked <= MAX_LINKS * len(b.text):
                first[k] = "near"  # few stop words are no ground against the marked article
    n = len(blocks)

    edge = "good" if marked else "bad"
    # one sweep each way finds the nearest decided block of all blocks
    before, after, seen = [""] * n, [""] * n, ""
    for k in range(n):
        before[k] = seen
        seen = "" if first[k] == "out" else first[k] if first[k] in ("good", "bad") and not (marked and blocks[k].bad) else seen
    seen = ""
    for k in range(n - 1, -1, -1):
        after[k] = seen
        seen = "" if first[k] == "out" else first[k] if first[k] in ("good", "bad") and not (marked and blocks[k].bad) else seen
    final = []
    for k, kind in enumerate(first):
        if kind in ("good", "bad", "out"):
            final.append(kind == "good")
            continue
        sides = {before[k] or edge, after[k] or edge}
        if kind == "near":
            final.append(sides != {"bad"})
        else:
            final.append(sides == {"good"})
    reach, good_below = 0, False
    for k in range(n - 1, -1, -1):  # headings above good blocks
        if blocks[k].heading and first[k] == "short" and not final[k] and good_below and reach <= HEADING_REACH:
            final[k] = True
        if final[k] and not blocks[k].heading:
            reach, good_below = 0, True
        elif first[k] == "out" or blocks[k].bad:
            good_below = False
        else:
            reach += len(blocks[k].text)
    return final


def rescued(blocks: list[Block]) -> list[bool]:
    """Main text of a page on which no block is good by itself: its nearly good blocks or, without any, its
    short ones without links, and what :func:`label` then gives their neighbours."""
    limits = stop_limits(blocks)
    kinds = [classify(b, limits) for b in blocks]
    wanted = "near" if "near" in kinds else "short"
    kept = [kind == wanted and not (wanted == "short" and b.linked) for kind, b in zip(kinds, blocks)]
    if wanted == "near":
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for k, (kind, b) in enumerate(zip(kinds, blocks)):
            above = b.heading and k < first and sum(len(x.text) for x in blocks[k + 1 : first]) <= HEADING_REACH and not any(x.bad for x in blocks[k:first])
            kept[k] = kept[k] or (kind == "short" and (first < k < last or above))
    return kept


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    kept = label(blocks)
    if not any(kept):
        kept = rescued(blocks)
    return "\n".join(b.text for b, good in zip(blocks, kept) if good)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
