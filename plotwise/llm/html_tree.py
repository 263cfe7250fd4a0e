"""HTML extraction by site style trees.

Every page is parsed to element branches (paths of tags with their class words). The pages of a host are merged: per host
and path, the style tree counts which child-tag styles and which contents occur. Presentation importance of a node is
the entropy of its styles over pages; content importance of a leaf is one minus the mean share of pages that its contents
cover, both with logarithms to the base of the host's distinct pages; the two are combined bottom-up. Branches of low
importance, whole and in all their parts, are removed from each page, after the roles that markup declares (navigation, adverts, forms, comments).
Contents are counted over distinct pages, so copies of a page do not make its article look like a template. Branches inside
and outside declared article and main elements are scored alike; inside, the bound is lower (``MAIN_PRIOR``). A host of too few
pages gives no importance: there all text stays that markup does not declare to be noise.

Class and id words, and the form element, declare noise too, but never html, body, main or article, nor a branch that holds most of the text which
tags, roles and hidden elements leave: over ``MOST`` of it, or over ``MOST_BESIDE_MAIN`` where an article or main outside the
branch has text. Inside article and main a paragraph, list or other element that holds text itself needs a class word of nothing but noise and
layout; others (share-price, notice-text) are left to the tree.

Blocks: text between block-level tags; character references decoded, white space folded, empty blocks left out.

Defined results: null or empty html, and pages without text, give ''; a null or odd url is a host of its own (''); repeated
rows are rows of their own; an empty table gives no rows; pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, release, slices, small_side, table

#: A branch under this importance goes, on hosts with at least so many distinct pages. GAMMA weighs presentation against content.
LOW, LEAST_PAGES, GAMMA = 0.3, 4, 0.9
#: The bound for branches inside article and main, as a share of LOW.
MAIN_PRIOR = 0.5
#: Shares of a page's text over which class words alone don't remove a branch.
MOST, MOST_BESIDE_MAIN = 0.5, 0.9
#: Fixed values of HTML: elements without content, with raw text, that break a block, and that p ends before.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SCOPED = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "p": "div article section body main td li"}
NOISE_TAGS = frozenset("nav aside footer header button select textarea input script style noscript template iframe object embed svg canvas dialog menu head title audio video map math".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
WHOLE = MAIN | {"html", "body"}
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|header|masthead|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|pagination|pager|toolbar|skip|disclaimer|copyright)(?=$|[\s_-])",
    re.IGNORECASE,
)
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements that hold text themselves: inside article and main a class names them only if all its parts are words of noise or of layout.
LEAF = frozenset("p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table tr td th figure figcaption span b i em strong a".split())
LAYOUT = frozenset("box bar block list links link item items wrap wrapper inner container section area row col button buttons icons icon group panel message text-muted post posts article articles content by us now on the to".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class Node:
    """An open element: its path, whether its branch is noise, where the element starts whose class words alone make it so (else -1),
    whether it lies in a declared main element, its child tags and its own text."""

    __slots__ = ("tag", "path", "noise", "veil", "main", "children", "own")

    def __init__(self, tag: str, path: str, noise: bool, veil: int, main: bool):
        self.tag, self.path, self.noise, self.veil, self.main, self.children, self.own = tag, path, noise, veil, main, [], []


def all_noise(names: str) -> bool:
    """Whether one of the class words consists of words of noise and of layout only: share-buttons, but not share-price."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]", re.sub(r"\d+", "", name)) if p]
        if NOISE_WORDS.search(name) and all(p in LAYOUT or NOISE_WORDS.fullmatch(p) for p in parts):
            return True
    return False


def is_noise(tag: str, attrs: str, parent: Node) -> tuple[bool, bool, str]:
    """Whether the element is declared to be noise by tag, role or being hidden; by class words; its name with class words (digits left out)."""
    # A form may be the whole page's: like class words, its name does not decide where it holds most of the text.
    name, inside, worded = tag, parent.main, tag == "form"
    noise = tag in NOISE_TAGS and not (inside and tag == "header")
    if attrs and not attrs.isspace():
        for k, a, b, c in ATTRIBUTE.findall(attrs):
            k, v = k.lower(), unescape(a or b or c)
            if k in ("class", "id"):
                if k == "class":
                    name += "." + ".".join(re.sub(r"\d+", "", v).lower().split())
                words = NOISE_WORDS.findall(v)
                found = any(not (inside and w.strip(" _-\t\n").lower() in ("header", "masthead", "banner")) for w in words)
                worded |= tag not in WHOLE and found and not (inside and tag in LEAF and not all_noise(v))
            elif k == "role":
                noise |= v.strip().lower() in NOISE_ROLES
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and HIDDEN.search(v):
                noise = True
    return noise, worded, name


def blocks(html: str | None) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(text blocks that are not declared noise: path, text; branches: path, child style, own text)."""
    spared: frozenset[int] = frozenset()
    while True:
        found, branches, veiled = parse(html or "", spared)
        total = sum(len(x[1]) for x in found) + sum(veiled.values())
        bar = total * (MOST_BESIDE_MAIN if any(in_main(x[0]) for x in found) else MOST)
        most = {at for at, n in veiled.items() if n > bar}
        if not most:
            return found, branches
        spared |= most


def parse(html: str, spared: frozenset[int]) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]], dict[int, int]]:
    """The blocks and branches of ``blocks``, and the length of text by the element (its start) whose class words hide it; those of ``spared`` hide nothing."""
    veiled: dict[int, int] = {}
    out: list[tuple[str, str]] = []
    branches: list[tuple[str, str, str]] = []
    root = Node("", "", False, -1, False)
    stack, buffer, at = [root], [], 0

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            holder = next((n for n in reversed(stack) if n.tag in BLOCK), root)
            holder.own.append(text)
            out.append((holder.path, text))

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCK and not stack[-1].noise:
                flush()
            node = stack.pop()
            if not node.noise:
                branches.append((node.path, " ".join(node.children), "\n".join(node.own)))

    def add(text: str) -> None:
        if text and not stack[-1].noise:
            buffer.append(unescape(text) if "&" in text else text)
        elif text and stack[-1].veil >= 0:
            veiled[stack[-1].veil] = veiled.get(stack[-1].veil, 0) + len(" ".join(unescape(text).split()))

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if tag in BLOCK:
            if tag in SCOPED:
                bounds = SCOPED[tag].split()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag or tag in ("dt", "dd") and stack[depth].tag in ("dt", "dd") or tag in ("td", "th") and stack[depth].tag in ("td", "th"):
                        close(depth)
                        break
                    if stack[depth].tag in bounds:
                        break
            elif any(n.tag == "p" for n in stack[1:]):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        close(depth)
                        break
                    if stack[depth].tag in BLOCK:
                        break
            if not stack[-1].noise:
                flush()
        top = stack[-1]
        if tag in BLOCK and not top.noise and (not top.children or top.children[-1] != tag):
            top.children.append(tag)
        declared, worded, name = is_noise(tag, m[3], top)
        noise = declared or worded and m.start() not in spared
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            if tag == "br":
                add(" ")
            continue
        if noise and not top.noise and tag not in BLOCK:
            buffer.append(" ")
        veil = -1 if declared else top.veil if top.noise else m.start() if noise else -1
        stack.append(Node(tag, f"{top.path}/{name}", top.noise or noise, veil, top.main or tag in MAIN and not noise))
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
    add(html[at:])
    close(1)
    flush()
    return out, branches, veiled


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """The page's blocks that no low branch holds."""
    found, _ = blocks(html)
    kept = [b for b in found if not any(digest(p) in low for p in prefixes(b[0]))] if low else found
    return "\n".join(b[1] for b in kept)


def in_main(path: str) -> bool:
    return any(name.partition(".")[0] in MAIN for name in path.split("/"))


def prefixes(path: str) -> Iterator[str]:
    at = path.find("/", 1)
    while at > 0:
        yield path[:at]
        at = path.find("/", at + 1)
    yield path


def branch_table(pages: DataFrame) -> DataFrame:
    """(host, page, path, style, content) per branch of each page; page is the digest of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple] = []
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                found, branches = blocks(html)
                page = digest("\n".join(x[1] for x in found))
                merged: dict[str, list[set[str]]] = {}
                for path, style, own in branches:
                    s = merged.setdefault(path, [set(), set()])
                    s[0].add(style)
                    s[1].add(own)
                rows += [(host, page, path, digest(" | ".join(sorted(s[0]))), digest("\n".join(sorted(s[1]))), any(s[1])) for path, s in merged.items()]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["host", "page", "path", "style", "content", "has_text"])

    return pages.select("host", "html").mapInArrow(run, "host string, page bigint, path string, style bigint, content bigint, has_text boolean")


def composite(tree: pd.DataFrame, low: float = LOW) -> dict[str, tuple[float, bool]]:
    """Per path of one host its importance, and whether its branch is noise: the path and all below it are of low importance.

    Importance is (1 - g**l) * presentation + g**l * the mean of its parts, with l the number of styles; the parts are the children
    and the own text (by its content). A path without children has the importance of its content."""
    children: dict[str, list[str]] = {}
    for path in tree["path"]:
        children.setdefault(path.rpartition("/")[0], []).append(path)
    known: dict[str, tuple[float, bool]] = {}
    for r in tree.iloc[tree["path"].str.count("/").argsort(kind="stable").to_numpy()[::-1]].itertuples():
        parts = [known[k] for k in children.get(r.path, [])]
        bar = low * (MAIN_PRIOR if in_main(r.path) else 1)
        if r.has_text or not parts:
            text = float(r.content) if r.has_text else 0.0
            parts.append((text, text < bar))
        inner, share = sum(v for v, _ in parts) / len(parts), GAMMA ** float(r.styles)
        value = inner if len(parts) == 1 and not children.get(r.path) else (1 - share) * float(r.presentation) + share * inner
        known[r.path] = (value, value < bar and all(noise for _, noise in parts))
    return known


def low_branches(pages: DataFrame, low: float = LOW) -> DataFrame:
    """(host, low): per host the digests of the paths whose importance is low. Sums are partial before each shuffle."""
    seen = cut(branch_table(pages).distinct())
    n = lambda c: F.sum(c * F.log(c.cast("double")))
    by_content = seen.groupBy("host", "path", "content").agg(F.count("*").alias("c"), F.max("has_text").alias("has_text"))
    content = by_content.groupBy("host", "path").agg(F.sum("c").alias("pages"), n(F.col("c")).alias("clc"), F.max("has_text").alias("has_text"))
    by_style = seen.groupBy("host", "path", "style").agg(F.count("*").alias("c"))
    style = by_style.groupBy("host", "path").agg(F.count("*").alias("styles"), n(F.col("c")).alias("slc"))
    pages_of = seen.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("m")).where(F.col("m") >= LEAST_PAGES)
    tree = content.join(style, ["host", "path"]).join(pages_of, "host")
    base = F.log(F.col("m").cast("double"))
    tree = tree.select("host", "path", "has_text", "styles", (1 - F.col("clc") / (F.col("pages") * base)).alias("content"), ((F.log(F.col("pages").cast("double")) - F.col("slc") / F.col("pages")) / base).alias("presentation"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [digest(p) for p, (_, noise) in composite(pdf, low).items() if noise]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "low": [found]})

    return tree.groupBy("host").applyInPandas(judge, "host string, low array<bigint>")


def extract(pages: DataFrame, low: float = LOW) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    trees = cut(low_branches(pages, low))
    size = trees.agg(F.count("*"), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, low_paths in batches:
            yield pd.Series([main_text(h, frozenset(x) if x is not None else frozenset()) for h, x in zip(html, low_paths, strict=True)], dtype=object)
        release()

    joined = pages.join(small_side(trees, size[0] * 8 + size[1], 8), "host", "left")
    return joined.select("page_id", "url", text_of("html", "low").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``: page_id, url, text (blocks joined by one line feed; empty if none), n_chars."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
