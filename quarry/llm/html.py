"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: tags with their path, and text nodes with their path. For every host, tokens that occur equally
often on the same pages share an occurrence vector and form an equivalence class. Classes that hold on most pages of the
host and have tags, or stand on just the pages of tags, make the host's template. The tags of a class in the order of one
page are its frame; a text of the class is furniture where it stands between the same two tags of the frame, whatever tags
hold it (paths are part of the tokens, so that these nest alike). All other text lies in the slots between the template's
tokens. Slots in elements of the standard for menus, footers, sidebars and forms are furniture. A class or id name such as
"ad" or "comments" makes a slot furniture only if its tag recurs on the host's pages and the slot is neither the page's
larger part nor around its article. The other slots are given as blocks of text.

An occurrence vector is kept as a sum over pages of the count times a hash of the page: equal vectors have equal sums,
and sums add up over tasks, so that no task has to hold the pages of a host. So are the pages of a token, without counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: A template needs so many different pages of a host, and its tokens this share of them.
MIN_PAGES, SUPPORT = 4, 0.5
#: Copies of a host's template, so that a host with a large share of the pages is met in many tasks.
SALTS = 32
MASK = (1 << 62) - 1

#: An attribute as HTML reads it: quotes open a value only right after its sign; elsewhere they are letters like others.
VALUE = r"(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*))"
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*)(?:\s*=\s*{VALUE}?)?")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[\s/]+|" + re.sub(r"\((?![?])", "(?:", ATTRIBUTE.pattern) + r")*+)(?:>|\Z)", re.S)
SPACE = re.compile(r"\s+")
# Fixed values of the HTML standard: elements without content, with raw text, and those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea select title head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th br option".split())
# Elements, roles and parts of class and id names that mark furniture.
FURNITURE_TAGS = frozenset("nav footer aside form button dialog menu search fieldset label input".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar footer masthead topbar comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login popup modal "
    "overlay widget widgets toolbar pagination pager skip tags teaser teasers outbrain taboola paywall".split()
)
#: Of these names, those of what readers write; it may well be longer than the article.
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies".split())
HEADER_NAMES = frozenset("header head".split())
CONTENT_NAMES = frozenset("article post entry content story body main page text".split())
#: First and last parts of names that tell a state of the element, not its kind: has-sidebar, tags-enabled.
STATES = frozenset("has have with without no not is hide show enabled disabled open closed on off active left right".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def name_parts(name: str) -> list[str]:
    """Parts of one class or id name: cookieNotice and cookie-notice are cookie, notice."""
    return [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]


def named_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id name says that the element is furniture. The kind stands last, or first if the last is no kind."""
    if tag in ("html", "body", "main"):
        return False
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = name_parts(name)
        if not parts or parts[0] in STATES or parts[-1] in STATES or parts[-1] in CONTENT_NAMES:
            continue
        if parts[-1] in FURNITURE_NAMES or parts[0] in FURNITURE_NAMES:
            return True
        if parts[-1] in HEADER_NAMES and not CONTENT_NAMES & set(parts) and not in_article and tag not in HEADINGS:
            return True
    return False


def named_comments(attrs: dict[str, str]) -> bool:
    """Whether a class or id name says that the element holds readers' comments."""
    kinds = (name_parts(x) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).split())
    return any(p and (p[-1] in COMMENT_NAMES or p[0] in COMMENT_NAMES) for p in kinds)


def is_furniture(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is furniture by its kind, role or state."""
    if tag in FURNITURE_TAGS or attrs.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return tag == "header" and not in_article


class Node:
    """One piece of text: its words, the block it belongs to, its token, and where it stands (named: elements named as furniture)."""

    __slots__ = ("text", "block", "token", "dropped", "article", "linked", "named")

    def __init__(self, text: str, block: int, token: int, dropped: bool, article: int, linked: bool, named: tuple[int, ...] = ()):
        self.text, self.block, self.token, self.dropped, self.article, self.linked, self.named = text, block, token, dropped, article, linked, named


class Page:
    """What is read from a page: text nodes in order, tokens of all tags and texts, and for each element named as furniture its token, whether it is around an article or the first heading, and whether it may hold more than half of the text: comments, and what stands outside the article or main element (landmark: there is one)."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.tokens: list[int] = []
        self.named: list[list] = []
        self.landmark = False


def token_id(kind: str, path: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{path}\0{value}") & MASK


def parsed(page: str) -> Page:
    """The text nodes, tokens and named elements of a page."""
    closers = Counter(m[2].lower() for m in TOKEN.finditer(page) if m[1])
    out, stack = Page(), []
    nodes, tokens = out.nodes, out.tokens
    block, at, articles, article = 0, 0, 0, 0
    end = len(page)

    def within() -> tuple[int, ...]:
        return tuple(s[3] for s in stack if s[3] >= 0)

    def text_until(stop: int) -> None:
        if stop <= at:
            return
        raw = page[at:stop]
        if not raw.strip():
            if nodes and nodes[-1].block == block and raw:
                nodes.append(Node(" ", block, 0, nodes[-1].dropped, article, False, nodes[-1].named))
            return
        value = html.unescape(raw)
        path = "/".join(s[0] for s in stack[-6:])
        token = token_id("text", path, SPACE.sub(" ", value).strip())
        tokens.append(token)
        nodes.append(Node(value, block, token, any(s[1] for s in stack), article, any(s[0] == "a" for s in stack), within()))

    pos = 0
    while True:
        m = TOKEN.search(page, pos)
        if m is None:
            text_until(end)
            break
        text_until(m.start())
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                inner = m[0][9:].removesuffix("]]>")
                nodes.append(Node(inner, block, 0, any(s[1] for s in stack), article, False, within()))
            continue
        if m[1]:  # a closing tag
            closers[tag] -= 1
            if tag in BLOCKS:
                block += 1
            elif tag in CELLS and nodes:
                nodes.append(Node(" ", block, 0, nodes[-1].dropped, article, False, nodes[-1].named))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if tag == "article":
                article = next((s[2] for s in reversed(stack) if s[0] == "article"), 0)
            tokens.append(token_id("close", "/".join(s[0] for s in stack[-6:]), tag))
            continue
        attrs = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3] or "")}
        path = "/".join(s[0] for s in stack[-6:])
        tokens.append(token_id("open", path, tag + " " + attrs.get("class", "") + " " + attrs.get("id", "")))
        if tag in BLOCKS:
            block += 1
        if tag in VOID or (m[3] or "").endswith("/"):
            if tag in CELLS or tag in BLOCKS:
                nodes.append(Node(" ", block, 0, True if not nodes else nodes[-1].dropped, article, False, nodes[-1].named if nodes else ()))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            if close is None and tag in ("head", "title"):
                continue  # an unclosed head: what follows is read as it comes
            at = pos = close.end() if close else end
            continue
        if tag == "p" or tag == "li":  # these end an open one of their kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS and stack[i][0] != "p":
                    break
        if closers[tag] <= sum(s[0] == tag for s in stack) and tag in FURNITURE_TAGS | {"header", "div", "section", "span"}:
            drop = named = False  # never closed: it cannot be told what it holds
        else:
            drop, named = is_furniture(tag, attrs, article > 0), named_furniture(tag, attrs, article > 0)
        number = 0
        if tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article"):
            articles += 1
            number = articles
            if not drop and not any(s[1] for s in stack):
                out.landmark = True
                if tag == "article" and not article:
                    article = number
        if tag == "header" and article:
            drop = False
        if tag in ("article", "main") or (tag == "h1" and not any(x[1] for x in out.named)):
            for s in stack:
                if s[3] >= 0:
                    out.named[s[3]][1] = True
        if named:
            inside = any(x[2] for x in stack) or bool(number)
            out.named.append([tokens[-1], False, named_comments(attrs), inside])
        stack.append((tag, drop, number, len(out.named) - 1 if named else -1))
    return out


class Template:
    """A host's frames (tags in order) and the places of its texts in them, from rows (token, frame, place, TAG, TEXT or NAMED)."""

    def __init__(self, rows: np.ndarray):
        self.tags: dict[int, list[tuple[int, int]]] = {}
        self.texts: dict[int, tuple[int, int]] = {}
        self.length: Counter[int] = Counter()
        self.named: set[int] = set()
        for token, frame, place, kind in rows.tolist():
            if kind == NAMED:
                self.named.add(token)
            elif kind == TEXT:
                self.texts[token] = (frame, place)
            else:
                self.tags.setdefault(token, []).append((frame, place))
                self.length[frame] += 1

    def standing(self, nodes: list[Node], tokens: list[int]) -> set[int]:
        """Positions in nodes of the texts that stand at their places: after the tag before and ahead of the tag behind."""
        found, last = set(), {}
        waiting: dict[int, list[tuple[int, int]]] = {}
        texts = iter([(i, n.token) for i, n in enumerate(nodes) if n.token])
        i, text = next(texts, (0, 0))
        for token in tokens:
            if token == text:
                frame, place = self.texts.get(token, (-1, 0))
                # Frames repeat on a page as often as their class: the first tag may follow the last.
                if frame >= 0 and last.get(frame, self.length[frame] - 1 if place == 0 else -1) == (place - 1) % self.length[frame]:
                    waiting.setdefault(frame, []).append((i, place % self.length[frame]))
                i, text = next(texts, (0, 0))
            for frame, place in self.tags.get(token, ()):
                found.update(k for k, behind in waiting.pop(frame, ()) if behind == place)
                last[frame] = place
        found.update(k for ks in waiting.values() for k, behind in ks if behind == 0)
        return found


def main_nodes(page: Page, known: Template | None = None) -> list[Node]:
    """The text nodes of the main part: the articles if there are any, else all that is not furniture.

    An element named as furniture is furniture if its tag is one of the host's (any, where the host has no template), if
    it is around neither an article nor the first heading, and if it holds at most half of the text; comments, and what
    stands beside the article or main element of a page, may hold more.
    """
    known_nodes = {id(page.nodes[i]) for i in known.standing(page.nodes, page.tokens)} if known else set()
    live = [n for n in page.nodes if not n.dropped]
    size = lambda ns: sum(len(n.text) for n in ns)
    held: Counter[int] = Counter()
    for n in live:
        for i in n.named:
            held[i] += len(n.text)
    whole = size(live)
    free = lambda comments, inside: comments or (page.landmark and not inside)
    out = {i for i, (token, around, comments, inside) in enumerate(page.named) if not around and (known is None or token in known.named) and (free(comments, inside) or 2 * held[i] <= whole)}
    live = [n for n in live if out.isdisjoint(n.named)] if out else live
    inside = [n for n in live if n.article]
    # An article that holds a small part of what is not furniture is a teaser among others, not the main part.
    use = inside if inside and size(inside) * 4 >= size([n for n in live if not n.linked]) else live
    return [n for n in use if n.article or id(n) not in known_nodes]


def blocks_text(nodes: list[Node]) -> str:
    """Blocks joined by an empty line, white space within a block as one space."""
    out: list[str] = []
    last, parts = None, []
    for n in nodes:
        if n.block != last and parts:
            out.append("".join(parts))
            parts = []
        last = n.block
        parts.append(n.text)
    out.append("".join(parts))
    return "\n\n".join(b for b in (SPACE.sub(" ", x).strip() for x in out) if b)


#: Kinds of tokens.
TAG, TEXT, NAMED = 0, 1, 2
TOKEN_ROWS = "host string, token long, kind int, pages long, vector long, held long, first_page long, first_at long"


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """TOKEN_ROWS: sums over the pages of a batch (held: of the pages without counts), and the place on the least page."""
    for f in frames:
        sums: dict[tuple[str, int], list[int]] = {}
        kinds: dict[int, int] = {}
        for host, page_hash, page in zip(f["host"], f["page_hash"], f["html"], strict=True):
            read = parsed(page or "")
            tokens = read.tokens
            kinds.update((n.token, TEXT) for n in read.nodes if n.token)
            kinds.update((x[0], NAMED) for x in read.named)
            mine, at = int(page_hash) & MASK, {t: i for i, t in zip(range(len(tokens) - 1, -1, -1), reversed(tokens), strict=True)}
            for token, count in Counter(tokens).items():
                s = sums.setdefault((host, token), [0, 0, 0, mine, at[token]])
                s[0] += 1
                s[1] = (s[1] + count * mine) & MASK
                s[2] = (s[2] + mine) & MASK
                if mine < s[3]:
                    s[3], s[4] = mine, at[token]
        keys = list(sums)
        names = ["pages", "vector", "held", "first_page", "first_at"]
        yield pd.DataFrame({"host": [k[0] for k in keys], "token": [k[1] for k in keys], "kind": [kinds.get(k[1], TAG) for k in keys], **{c: [sums[k][i] for k in keys] for i, c in enumerate(names)}})


def _template(f: pd.DataFrame) -> pd.DataFrame:
    """The Template rows of one host: texts whose class has tags, or whose pages are those of tags, with these as frames."""
    f = f.sort_values(["at", "token"])
    frames: dict[tuple[str, int], list[tuple[int, int]]] = {}
    tags = f[(f["kind"] != TEXT) & f["common"]]
    for token, vector, held, at in zip(tags["token"], tags["vector"], tags["held"], tags["at"], strict=True):
        # Tags of the class; those that stand once on each of their pages; all that have these pages.
        for key in (("class", vector), *((("once", held),) if vector == held else ()), ("pages", held)):
            frames.setdefault(key, []).append((at, token))
    rows, used = [], {}
    texts = f[(f["kind"] == TEXT) & f["common"]]
    for token, vector, held, at in zip(texts["token"], texts["vector"], texts["held"], texts["at"], strict=True):
        key = next((k for k in (("class", vector), ("once", held), ("pages", held)) if k in frames), None)
        if key is not None:
            rows.append((token, used.setdefault(key, len(used)), sum(x < at for x, _ in frames[key]), TEXT))
    rows += [(token, number, place, TAG) for key, number in used.items() for place, (_, token) in enumerate(frames[key])]
    rows += [(token, 0, 0, NAMED) for token in f["token"][f["kind"] == NAMED]]
    return pd.DataFrame({"host": [f["host"].iloc[0]], "known": [np.array(rows, np.int64).reshape(-1, 4).tobytes()]})


def templates(pages: DataFrame) -> DataFrame:
    """host, known: the Template rows of each host.

    pages(host, page_hash, html). Tokens of the template hold on at least SUPPORT of a host's pages; tags named as
    furniture on two at least. A text without tags in its class and on its pages is content, as it comes and goes by itself.
    """
    size = pages.select("host", "page_hash").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    seen = pages.dropDuplicates(["host", "page_hash"]).mapInPandas(_tokens, TOKEN_ROWS)
    wrap = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(MASK + 1)).cast("long").alias(c)
    # Tokens of one class, and all with the same pages, have their places on one page: the least.
    seen = seen.groupBy("host", "token").agg(F.max("kind").alias("kind"), F.sum("pages").alias("pages"), wrap("vector"), wrap("held"), F.min(F.struct("first_page", "first_at")).alias("first"))
    often = seen.where(F.col("pages") >= SUPPORT * MIN_PAGES)  # rarer tokens cannot hold on the share of any host's pages
    common = often.join(size, "host").withColumn("common", F.col("pages") >= SUPPORT * F.col("n_pages")).where((F.col("n_pages") >= MIN_PAGES) & (F.col("common") | (F.col("kind") == NAMED)))
    return common.select("host", "token", "kind", "common", "vector", "held", F.col("first.first_at").alias("at")).groupBy("host").applyInPandas(_template, "host string, known binary")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    text: the main text of the whole page, empty if there is none; references are decoded, white space inside a block is
    one space, blocks are joined by two newlines in page order. Null and empty pages have an empty text. Null urls are a
    host of their own. Repeated rows are extracted alike; an empty table gives no rows. Broken markup: elements never
    closed end with their parent, furniture never closed is no furniture, a page cut off in a tag ends there.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), host.alias("host"), F.xxhash64("page_id", "url").alias("row_hash"))
    # Copies of a page support its tokens once.
    known = stored(templates(rows.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("page_hash"), "html")), "html-templates")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "known_host")
    dealt = rows.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
    met = dealt.join(salted.withColumnRenamed("salt", "known_salt"), (F.col("host") == F.col("known_host")) & (F.col("salt") == F.col("known_salt")), "left")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read: dict[bytes, Template] = {}
        for f in frames:
            if len(read) > 256:
                read.clear()
            out = []
            for page, known in zip(f["html"], f["known"], strict=True):
                if known and known not in read:
                    read[known] = Template(np.frombuffer(known, np.int64).reshape(-1, 4))
                out.append(blocks_text(main_nodes(parsed(page or ""), read.get(known))))
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": out, "n_chars": [len(t) for t in out]})

    kind = dict(pages.dtypes)["page_id"]
    return stored(met.select("page_id", "url", "html", "known").mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long"), "html-texts", known)
