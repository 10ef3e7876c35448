"""Main text of web pages by consensus of their hosts.

Each page is read into a flat list of text blocks, each with the path of the elements that are open there. A container's
score is the length of the text below it outside links, if that is dense enough, shared among the paths that generalise its
own: tag names with their class words, digits in them replaced. Spark adds the scores up per host, and the path with the
highest sum is the host's. Every page is then read again and its text taken from the containers on its host's path; a page
without such a container uses its own best one.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.common import prepare

# Element names of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
LEFT_OUT = frozenset("canvas datalist embed iframe input noscript option script select style svg template textarea title".split())
#: Left out as parts, unless they turn out to stand around the article.
PART_TAGS = frozenset("aside button dialog footer form head header label map menu nav object".split())
#: Class and id words of parts that are no article text.
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside banner banners breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies copyright disqus footer gdpr header masthead menu menus meta modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promoted promotion related reply replies respond share sharing "
    "sidebar sidebars signup skip social sponsor sponsored subscribe tags teaser toc toolbar widget widgets".split()
)
#: Of these, parts that can be longer than the article beside them.
LONG_PARTS = frozenset("aside comment comments consent cookie cookies disqus footer gdpr replies reply respond".split())
PART_ROLES = frozenset("banner navigation complementary contentinfo search form dialog menu menubar alert".split())
#: Elements that an opening tag closes, up to the nearest of the elements after the slash.
CLOSES = {
    **{t: (frozenset({"p"}), frozenset()) for t in BLOCKS | {"option"}},
    "li": (frozenset({"p", "li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"p", "dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"p", "dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"p", "tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"p", "td", "th"}), frozenset({"table", "tr"})),
    "th": (frozenset({"p", "td", "th"}), frozenset({"table", "tr"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Inline elements do not count as containers or stop a closing tag.
CONTAINERS = frozenset("article body div main section td blockquote center table tbody tr dd dl ul ol li figure".split())

TAG = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|$)"
    r"|!--(?:-?>|.*?(?:--!?>|$))|[!?/][^>]*(?:>|$))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
FLAGS = re.compile(r"(?<![^\s\"'])hidden(?![^\s])")
WORD = re.compile(r"[a-z]+|[0-9]+")
DEEP = 64
HOT_SHARE = 1000
#: Characters outside links from which on a text is more than a title or a line of a menu.
LONG = 80
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


class Part:
    """An element whose name says that it is no article text; the page itself stands as the outermost one.

    `text` counts the characters outside links below it, `own` those in no inner part, `widest` those of the largest block of
    these, `most` those of the largest article below it; `articles` counts the article and main elements with text, `longs` the
    stories of `LONG` text, and `told` says whether any story has text.
    """

    __slots__ = ("above", "story", "long", "inner", "text", "own", "widest", "most", "articles", "longs", "told", "main", "out")

    def __init__(self, above: "Part | None", story: "Story | None", long: bool):
        self.above, self.story, self.long = above, story, long
        self.inner: list[Part] = []
        self.text = self.own = self.widest = self.most = self.articles = self.longs = 0
        self.told = self.main = self.out = False


class Story:
    """An article or main element, or a container that is named so; `own` leaves out the text of parts below it.

    `articles` and `longs` count it and the stories around it within its part, as in Part.
    """

    __slots__ = ("tag", "part", "above", "text", "own", "articles", "longs", "under_long")

    def __init__(self, tag: str, part: Part, above: "Story | None"):
        self.tag, self.part, self.above = tag, part, above
        self.text = self.own = self.articles = self.longs = 0
        self.under_long = False


class Element:
    """An open element; `number` counts the containers of the page, `box` is the innermost container, itself included."""

    __slots__ = ("tag", "path", "depth", "out", "link", "number", "box", "above", "part", "story")

    def __init__(
        self, tag: str, path: str, out: bool, link: bool, number: int, above: "Element | None", part: Part, story: Story | None
    ):
        self.tag, self.path, self.out, self.link, self.number = tag, path, out, link, number
        self.part, self.story = part, story
        outer = above.box if above else None
        self.above, self.box = outer, self if number else outer
        self.depth = (outer.depth if outer else 0) + bool(number)


Block = tuple[str, Element | None, int, bool]


def deeper(above: Element, part: str) -> str:
    """The path one element further down. Beyond `DEEP` elements a number stands for it, so that paths stay short."""
    if above.depth < DEEP:
        return f"{above.path}/{part}"
    return f"~{crc32(f'{above.path}/{part}'.encode()):08x}"


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(next((g for g in m.groups()[1:] if g is not None), "")) for m in ATTRIBUTE.finditer(text)}


def step(tag: str, given: dict[str, str]) -> str:
    """A tag with its class words in order, digits replaced: the part of a path that pages of a host share."""
    if "class" not in given:
        return tag
    words = sorted({re.sub(r"[0-9]+", "#", c) for c in given["class"].lower().split()})
    return ".".join([tag, *words])


def left_out(tag: str, given: dict[str, str]) -> bool:
    """Whether an element is not shown or holds no text, whatever is below it."""
    if tag in LEFT_OUT:
        return True
    if not given or tag in ("html", "body", "article", "main"):
        return False
    if given.get("aria-hidden", "").lower() == "true" or "hidden" in given:
        return True
    return re.search(r"display\s*:\s*none", given.get("style", "").lower()) is not None


def part_words(tag: str, given: dict[str, str]) -> set[str]:
    """The words by which an element calls itself a part that is no article text."""
    words = {tag} & PART_TAGS
    if not given or tag in ("html", "body", "article", "main"):
        return words
    if given.get("role", "").lower() in PART_ROLES:
        words.add(given["role"].lower())
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{given.get('class', '')} {given.get('id', '')}").lower()
    return words.union(PART_WORDS.intersection(WORD.findall(named)))


Piece = tuple[str, Part, Story | None, bool]


def judge(lines: list[list[Piece]], parts: list[Part], stories: list[Story]) -> None:
    """Decide which parts are out; `parts` and `stories` come from the outside in, the page first.

    A part that stands around the article is judged by its inner parts instead. It does so if it holds main; or the largest
    article among the parts, larger than the text outside of them; or half of the page's text outside links. For the last two
    no article with text and no longer text that is named so may lie beside it. Comments, consent texts, footers and asides
    may be longer than the article, so besides them there must be nothing but short lines that no article holds.
    """
    for line in lines:
        sizes: dict[Part, int] = defaultdict(int)
        for text, part, story, link in line:
            if link:
                continue
            size = len(" ".join(entities.unescape(text).split()))
            sizes[part] += size
            if story:
                story.text += size
                story.own += size * (story.part is part)
        for part, size in sizes.items():
            part.text += size
            part.own += size
            part.widest = max(part.widest, size)
    for story in reversed(stories):
        if story.tag == "main":
            story.part.main = story.part.main or story.text > 0
        if story.tag == "article":
            story.part.most = max(story.part.most, story.text)
        if story.above:
            story.above.text += story.text
            story.above.own += story.own * (story.above.part is story.part)
    for story in stories:
        above = story.above if story.above and story.above.part is story.part else None
        article = story.tag in ("article", "main") and story.own > 0
        story.articles = (above.articles if above else 0) + article
        story.longs = (above.longs if above else 0) + (story.own >= LONG)
        story.under_long = (above is not None and above.under_long) or (article and story.own >= LONG)
        story.part.articles += article
        story.part.told = story.part.told or story.own > 0
        story.part.longs += story.own >= LONG
    for part in reversed(parts[1:]):
        above = part.above
        above.text += part.text
        above.main = above.main or part.main
        above.most = max(above.most, part.most)
        above.inner.append(part)
    total = parts[0].text
    for scope in parts:
        around = set() if scope.out else surrounding(scope, total)
        for part in scope.inner:
            part.out = part not in around


def surrounding(scope: Part, total: int) -> set[Part]:
    """The inner parts of `scope` that stand around the article."""
    if mains := {p for p in scope.inner if p.main}:
        return mains
    most = max((p.most for p in scope.inner), default=0)
    beside = max((p.text for p in scope.inner if not p.long and p.most < most), default=0)
    most = most if 2 * most >= beside else 0  # articles in a side column are teasers
    holders, large = set(), set()
    for part in scope.inner:
        over = part.story if part.story and part.story.part is scope else None
        if scope.longs > (over.longs if over else 0) or scope.articles > (over.articles if over else 0):
            continue
        if part.long and (scope.told or scope.widest >= LONG):
            continue
        if total and 2 * part.text >= total:
            large.add(part)
        if most and part.most == most >= scope.own and not (over and over.under_long):
            holders.add(part)
    return large if large and most < LONG else holders or large


def blocks(html: str) -> list[Block]:
    """The text blocks of a page outside left-out parts, in page order: (text, innermost container, characters in links,
    whether it is in h1)."""
    lines: list[list[Piece]] = []
    boxes: list[tuple[Element | None, bool]] = []
    parts = [Part(None, None, False)]
    stories: list[Story] = []
    stack = [Element("#", "", False, False, 0, None, parts[0], None)]
    open_tags: dict[str, int] = defaultdict(int)
    pieces: list[Piece] = []
    number = 0
    at = 0

    def push(element: Element) -> None:
        stack.append(element)
        open_tags[element.tag] += 1

    def pop_to(size: int) -> None:
        for element in stack[size:]:
            open_tags[element.tag] -= 1
        del stack[size:]

    def end_block() -> None:
        nonlocal pieces
        if pieces:
            lines.append(pieces)
            boxes.append((stack[-1].box, open_tags["h1"] > 0))
            pieces = []

    def put(text: str) -> None:
        top = stack[-1]
        if not top.out:
            pieces.append((text, top.part, top.story, top.link))

    while at < len(html):
        jump = len(html)
        for m in TAG.finditer(html, at):
            if m.start() > at:
                put(html[at : m.start()])
            at = m.end()
            ending, tag, rest = m.groups()
            if not tag:
                continue
            tag = tag.lower()
            is_block = tag in BLOCKS
            if is_block and pieces:
                end_block()
            if ending:
                for i in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                    if stack[i].tag == tag:
                        pop_to(i)
                        break
                    # An inline end tag does not close the block around it.
                    if not is_block and stack[i].tag in BLOCKS:
                        break
                continue
            if is_block:
                closed, fence = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1) if any(map(open_tags.__getitem__, closed)) else ():
                    if stack[i].tag in fence or (stack[i].tag in CONTAINERS and stack[i].tag not in closed):
                        break
                    if stack[i].tag in closed:
                        pop_to(i)
            if tag in VOID:
                if tag == "br":
                    put(" ")
                continue
            given = attributes(rest) if "=" in rest else {}
            if "hidden" in rest and FLAGS.search(rest):
                given["hidden"] = ""
            above = stack[-1]
            out = above.out or left_out(tag, given)
            part, story = above.part, above.story
            if not out and (words := part_words(tag, given)):
                part = Part(part, story, not LONG_PARTS.isdisjoint(words))
                parts.append(part)
            if tag in CONTAINERS:
                number += 1
                last = step(tag, given)
                if not out and (tag in ("article", "main") or named(last)):
                    story = Story(tag, part, story)
                    stories.append(story)
                push(Element(tag, deeper(above.box or above, last), out, above.link, number, above, part, story))
            else:
                push(Element(tag, above.path, out, above.link or tag == "a", 0, above, part, story))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.IGNORECASE).search(html, at)
                if close is None:
                    pop_to(len(stack) - 1)
                jump = close.start() if close else len(html)
                break
        else:
            if at < len(html):
                put(html[at:])
        at = jump
    end_block()
    if len(parts) > 1:
        judge(lines, parts, stories)
    found: list[Block] = []
    for line, (box, title) in zip(lines, boxes, strict=True):
        line = [piece for piece in line if not piece[1].out]
        text = " ".join(entities.unescape("".join([piece[0] for piece in line])).split())
        if text:
            found.append((text, box, sum(len(t) for t, _, _, link in line if link), title))
    return found


#: Weight of a vote for the path without class words: it wins where the class words differ from page to page.
BARE = 0.6


def generalised(path: str) -> list[str]:
    """The paths that a container's path votes for: itself, and itself without class words."""
    bare = "/".join(part.split(".")[0] for part in path.split("/"))
    return [path] if bare == path else [path, bare]


#: A container beside a named one belongs to the article as well if it has this share of the text outside links.
BELONGS = 0.1


def container_scores(found: list[Block]) -> dict[str, float]:
    """The scores of the container paths of a page that hold half of its text or more, characters in links not counted.

    A container scores its share of the text. An article or main element scores half a page more; so does a container that
    is named so, if it is in no article or main element and all that it would leave to the elements around it is links or
    small containers that are neither named so nor hold the page's title. So no container wins over one around it that has
    more of the article; of containers with the same blocks it does not matter which one wins.
    """
    size: dict[int, int] = defaultdict(int)
    own: dict[int, int] = defaultdict(int)
    boxes: dict[int, Element] = {}
    titled: set[int] = set()
    for text, box, linked, title in found:
        if box:
            size[box.number] += max(0, len(text) - 2 * linked)
            own[box.number] += max(0, len(text) - 2 * linked)
            if title:
                titled.add(box.number)
            while box and box.number not in boxes:
                boxes[box.number] = box
                box = box.above
    order = sorted(boxes, reverse=True)  # containers are numbered from the outside in
    for number in order:
        if above := boxes[number].above:
            size[above.number] += size[number]
            if number in titled:
                titled.add(above.number)
    total = sum(max(0, len(t) - 2 * k) for t, _, k, _ in found)
    # What a container has of the article besides each inner one: its own text, and inner containers that belong to it.
    belongs: dict[int, int] = defaultdict(int)
    share: dict[int, int] = {}
    for number in order:
        box = boxes[number]
        if size[number] and (size[number] >= BELONGS * total or number in titled or named(box.path)):
            share[number] = size[number]
        if box.above:
            belongs[box.above.number] += share.get(number, 0)
    whole: dict[int, bool] = {}
    scores: dict[str, float] = {}
    for number in reversed(order):
        box, above = boxes[number], boxes[number].above
        # Whether the elements around it have nothing more of the article.
        whole[number] = not above or (
            whole[above.number]
            and above.tag not in ("article", "main")
            and not own[above.number]
            and belongs[above.number] == share.get(number, 0)
        )
        if total and size[number] >= 0.5 * total:
            bonus = box.tag in ("article", "main") or (whole[number] and named(box.path))
            scores[box.path] = max(scores.get(box.path, 0.0), size[number] / total + 0.5 * bonus)
    return scores


@lru_cache(maxsize=10_000)
def named(path: str) -> bool:
    """Whether the last element says itself that it holds the article."""
    last = path.rsplit("/", 1)[-1].split(".")
    return last[0] in ("article", "main") or not {"article", "content", "post", "entry", "story"}.isdisjoint(
        w for c in last[1:] for w in WORD.findall(c)
    )


def best_path(found: list[Block]) -> str | None:
    scores = container_scores(found)
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def text_on(found: list[Block], path: str | None) -> list[str] | None:
    """The blocks in the containers on `path`, with or without class words; None if the page has none."""
    if path is None:
        return None
    known: dict[int, bool] = {}
    for _, box, _, _ in found:
        chain = []
        while box and box.number not in known:
            chain.append(box)
            box = box.above
        inside = known[box.number] if box else False
        for b in reversed(chain):
            inside = known[b.number] = inside or path in generalised(b.path)
    return [text for text, box, _, _ in found if box and known[box.number]] or None


def main_text(html: str, path: str | None) -> str:
    found = blocks(html)
    chosen = text_on(found, path)
    if chosen is None:
        chosen = text_on(found, best_path(found))
    return "\n".join(chosen if chosen is not None else [text for text, _, _, _ in found])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id, url, text and n_chars (code points).

    Null or empty html gives an empty text and no vote. Rows without a url, or with one that has no host, vote among
    themselves. Ties between paths go to the smaller path. Repeated rows vote and are extracted each for itself; an empty
    table gives an empty result; other columns are not looked at. Only blocks are joined; nothing else is dropped or cut.
    """
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), HOST, 1)), F.lit(""))
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for path, score in container_scores(blocks(page or "")).items():
                    for general in generalised(path):
                        hosts.append(name)
                        paths.append(general)
                        scores.append(round(score * (1 if general == path else BARE) * 10_000))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())],
                ["host", "path", "score"],
            )

    cast = given.select("host", "html").mapInArrow(votes, "host string, path string, score long")
    sums = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    winner = sums.groupBy("host").agg(F.max_by("path", F.struct("score", "path")).alias("path"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h or "", p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    # A host with a share of 1/HOT_SHARE of all pages or more is hot; there are HOT_SHARE of these at most, so they are
    # sent to every task. Their pages meet nobody in the shuffled join, where each has a key of its own.
    counts = given.groupBy("host").agg(F.count("*").alias("n"))
    hot = counts.filter(F.col("n") * HOT_SHARE >= F.lit(pages.count())).select("host")
    hot = winner.join(F.broadcast(hot), "host", "left_semi").select("host", F.col("path").alias("hot_path"))
    placed = given.join(F.broadcast(hot), "host", "left")
    key = F.when(F.col("hot_path").isNotNull(), F.concat(F.lit("\x00"), F.xxhash64("page_id", "url", "html").cast("string")))
    placed = placed.withColumn("key", F.coalesce(key, "host")).drop("host")
    found = placed.join(winner.select(F.col("host").alias("key"), "path"), "key", "left")
    found = found.select("page_id", "url", "html", F.coalesce("hot_path", "path").alias("path"))
    return found.mapInArrow(texts, schema)
