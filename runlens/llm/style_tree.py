"""Main text of web pages with site style trees.

The DOM trees of a host's pages are merged into one style tree: pages that agree on a path
(element names and classes from the root) share its node.  For every node of the tree two
distributions over the host's pages are counted: presentation nodes by the sequences of
child elements they occur with, content nodes by their texts.  With m occurrences and
counts c the importance of a node is ``1 - sum(c ln c) / (m ln m)``: 0 where all pages show
the same, 1 where all differ (a node seen once counts as 1).  A branch weighs its own
presentation and, the deeper the more, the content beneath it; branches below
``LOW`` that were seen on ``MIN_PAGES`` pages are removed from each page.

Roles come first: menus, headers, footers, asides, notices, adverts, forms, comments and
the like, by element or by whole class or id name, have no importance.  A name counts as a
whole, on either side of an article: qualifiers aside it must be a word for furniture, a
pair of such words or a known compound (``cookie-notice``, ``post-share-bar``); names that
only hold such a word (``login-guide``, ``social-policy``) are left to the tree.

The article element (or main) is never removed for being alike on many pages, since copied
articles are articles: on a page that marks one, the tree judges the branches strictly below
the innermost mark, and none if the marked element as a whole is of low importance.  A mark
is trusted if the marked elements hold at least half of the page's running text (blocks of
``PROSE`` characters or more); else they are cards beside the main text, which is then what
stands outside them.  If all of a page is of low importance, nothing more is removed from it.

Pages are parsed by the task that reads them; only counts by host and path are shuffled,
combined before, so a host with a third of all pages is no task's burden.

Defined results: null html -> empty text; null or odd url -> host of its own name; broken
markup is read as browsers do in the main (implied ends of p, li, td and the like; ``/>``
closes svg, math and what stands in them, and an HTML block ends an svg left open).  Of
elements whose content is no markup, one without an end tag hides nothing but script and
style code, so a cut or self-closed one cannot swallow the rest of a page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import materialise

LOW, MIN_PAGES, DAMPING, DEPTH, PROSE = 0.2, 5, 0.9, 32, 60

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element and class names of the HTML standard and common usage.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
CODE, FOREIGN = set("script style".split()), set("svg math".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
DROPPED = set("head script style noscript template iframe svg math nav aside form footer menu dialog button select textarea input object".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table article section div main nav aside footer header form blockquote body html".split())
ENDS_FOREIGN = ENDS_P | set("body br code dd dt em embed head i img li b big s small span strike strong sub sup tt u var".split())
NOISE = re.compile(
    r"ad|ads|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|footer|masthead|banner|cookies?|consent|gdpr|notice|notification|popup|modal|"
    r"newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|commentlist|respond|replies|disqus|widget|pagination|pager|login|search|toolbar|skip"
)
#: Words with other senses: alone they are furniture outside an article only, in a pair with
#: another word for furniture everywhere.
SENSES = re.compile(r"menu\w*|notice|share|sharing|social|related|search|skip|recommended|login|banner|notification|replies|respond")
#: Words that say where or of what kind a piece of furniture is.
QUALIFIERS = set(
    "post page site article entry blog user reader readers main global top bottom left right middle center primary secondary upper lower sticky fixed mobile desktop js wp "
    "box bar section container wrapper wrap block area slot unit body list inner outer row col holder group header head title".split()
)
#: Compounds of an ambiguous word that are furniture.
FURNITURE = re.compile(
    r"(?:share|sharing|social|comment|ad|nav|menu|cookie|widget|sponsor|promo|newsletter)-(?:buttons?|links?|icons?|form|count|meta)|"
    r"(?:share|sharing|social)-(?:bar|box|block|section|share)|related-(?:posts?|articles?|stories|links|box|section)|"
    r"(?:search|login|signup)-(?:box|form|bar)|skip-(?:links?|nav)|leave-(?:a-)?(?:comment|reply)|you-may-(?:also-)?like"
)
ROLES = {"navigation", "banner", "menu", "menubar", "toolbar", "search", "complementary", "contentinfo", "dialog", "alert"}


def furniture(name: str, inside: bool) -> bool:
    """Whether a whole class or id name means furniture; ``inside`` an article an ambiguous
    word alone does not."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    core = [w for w in words if w not in QUALIFIERS]
    if not core:
        return False
    if FURNITURE.fullmatch("-".join(words)) or any(FURNITURE.fullmatch("-".join(words[k:])) for k in range(1, len(words)) if words[k - 1] in QUALIFIERS):
        return True
    if not all(NOISE.fullmatch(w) for w in core):
        return False
    return len(core) > 1 or not SENSES.fullmatch(core[0]) or not inside and len(words) == 1


def _kind(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool]:
    """Class names, whether the element is noise (``inside`` an article or not), whether it
    marks the article."""
    if not attrs.strip(" /"):
        return "", tag in DROPPED, tag in ("article", "main")
    got = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)}
    whole = f"{got.get('class', '')} {got.get('id', '')}".split()
    noise = tag in DROPPED or got.get("role") in ROLES or "hidden" in got or got.get("aria-hidden") == "true"
    noise = noise or "display:none" in got.get("style", "").replace(" ", "") or any(furniture(n, inside) for n in whole)
    if tag in ("html", "body", "article", "main"):  # an article may be a reader's comment or a teaser
        noise = tag == "article" and any(n in ("comment", "comments", "related", "promo") or furniture(n, True) for n in whole)
    return ".".join(sorted(got.get("class", "").split())), noise, tag in ("article", "main") or got.get("role") == "main"


_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


class _Node:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag: str, path: str, noise: bool, main: str):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []  # main: path of the innermost mark, else ""


def _below(path: str, step: str) -> str:
    """Path of a child; beyond ``DEPTH`` levels the rest is named by its hash, so that paths
    stay short and different branches stay apart."""
    if path.count("/") <= DEPTH:
        return f"{path}/{step}"
    base = path.rsplit("/", 1)[0]
    return f"{base}/{xxhash.xxh64_hexdigest(f'{path}/{step}')}"


def blocks(page: str) -> tuple[list[tuple[str, str, bool, str]], list[tuple[str, str]]]:
    """Text blocks (path, text, noise, path of the innermost article around it or "") in page
    order, and the presentation (path, sequence of child elements) of every element outside
    noise."""
    out: list[tuple[str, str, bool, str]] = []
    shown: list[tuple[str, str]] = []
    root = _Node("", "", False, "")
    stack, text = [root], []

    def flush() -> None:
        if text:
            line = " ".join(html_lib.unescape("".join(text)).split())
            text.clear()
            if line:
                top = stack[-1]
                out.append((top.path, line, top.noise, top.main))

    def close(k: int) -> None:
        for node in stack[k:]:
            if not node.noise and node.tag not in INLINE:
                shown.append((node.path, ",".join(node.children)))
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            k = len(stack) - 1
            while k > 0 and stack[k].tag != tag:
                if tag in INLINE and stack[k].tag not in INLINE:
                    k = 0  # an inline end tag does not close a block
                    break
                k -= 1
            if tag == "p" and k == 0:
                flush()
            if k > 0:
                if any(n.tag not in INLINE or n.noise for n in stack[k:]):
                    flush()
                close(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        names, noise, main = _kind(tag, m[3], bool(stack[-1].main))
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        closed = m[3].rstrip().endswith("/")
        foreign = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in FOREIGN), 0)
        if foreign and tag in ENDS_FOREIGN and not any(n.tag == "foreignobject" for n in stack[foreign:]):
            flush()
            close(foreign)
            foreign = 0
        if tag in RAW and not (foreign and closed):  # its content is not markup
            stop = _END[tag].search(page, at)
            if stop is None:  # cut off: code hides the rest, unless the element was closed at once
                at = end if tag in CODE and not closed else at
                continue
            tail = page.find(">", stop.start())
            at = end if tail < 0 else tail + 1
            continue
        if closed and (foreign or tag in FOREIGN):
            continue
        if tag not in INLINE or noise:
            flush()
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in ENDS_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS_SAME[tag]:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k].tag in SCOPE:
                    break
        top = stack[-1]
        if tag == "header":
            noise = noise or not top.main
        step = tag + ("." + names if names else "")
        if len(top.children) < 1 or top.children[-1] != step:  # a run of equal children counts once
            top.children.append(step)
        inline = tag in INLINE and not noise
        path = top.path if inline else _below(top.path, step)
        stack.append(_Node(tag, path, top.noise or noise, "" if noise else (path or "/") if main else top.main))
    flush()
    close(1)
    return out, shown


def prunable(block: tuple[str, str, bool, str]) -> list[str]:
    """The branches a block goes with if they are of low importance: all it stands in, or
    those strictly below the article around it."""
    steps = block[0].split("/")
    ups = ["/".join(steps[:k]) for k in range(2, len(steps) + 1)]
    return [p for p in ups if p.startswith(block[3] + "/")] if block[3] else ups


def kept_blocks(page: str | None, low: set[str] = frozenset()) -> list[tuple[str, str, bool, str]]:
    """The page's blocks that are left: of its article if it marks one that holds most of the
    running text, else what is no noise and no card; without those in a branch of low
    importance."""
    got = [b for b in blocks(page or "")[0] if not b[2]]
    marked = [b for b in got if b[3]]
    if marked:
        prose, inside = (sum(len(b[1]) for b in part if len(b[1]) >= PROSE) for part in (got, marked))
        got = marked if 2 * inside >= prose else [b for b in got if not b[3]]
    kept = [b for b in got if b[3] in low or not any(p in low for p in prunable(b))] if low else got
    return kept or got


def main_text(page: str | None, low: set[str] = frozenset()) -> str:
    """Text of the blocks that are left."""
    return "\n".join(b[1] for b in kept_blocks(page, low))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or url or "").lower()
    except ValueError:
        return url or ""


# ------------------------------------------------------------------ Spark side


def style_counts(pages: DataFrame) -> DataFrame:
    """host, path, content (of a content node, else presentation), value hash, c."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for url, page in zip(b["url"], b["html"], strict=True):
                host, (texts, shown) = host_of(url), blocks(page or "")
                c.update((host, p, True, xxhash.xxh64_intdigest(t) >> 1) for p, t, noise, _ in texts if not noise)
                c.update((host, p, False, xxhash.xxh64_intdigest(s) >> 1) for p, s in shown)
            rows = [(*k, n) for k, n in c.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "content", "value", "c"])

    rows = pages.select("url", "html").mapInPandas(run, "host string, path string, content boolean, value long, c long")
    return rows.groupBy("host", "path", "content", "value").agg(F.sum("c").alias("c"))


def importance(counts: DataFrame) -> DataFrame:
    """host, path, content, m, importance of every node of the style trees."""
    c = F.col("c").cast("double")
    node = counts.groupBy("host", "path", "content").agg(F.sum("c").alias("m"), F.sum(c * F.log(c)).alias("s"))
    m = F.col("m").cast("double")
    value = F.when(F.col("m") > 1, 1 - F.col("s") / (m * F.log(m))).otherwise(F.lit(1.0))
    return node.select("host", "path", "content", "m", F.greatest(value, F.lit(0.0)).alias("importance"))


def low_branches(nodes: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, path of branches of low importance: of every content node, each ancestor takes
    ``(1 - g) * own presentation + g * content`` with ``g = DAMPING ** levels between``."""
    steps = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), "/").alias("up"), (F.size(steps) - k).alias("levels")))
    under = nodes.filter("content and path != ''").select("host", "m", "importance", F.explode(ups).alias("u")).select("host", "m", "importance", "u.*")
    own = nodes.filter("not content").select("host", F.col("path").alias("up"), F.col("m").alias("seen"), F.col("importance").alias("style"))
    g = F.pow(F.lit(DAMPING), F.col("levels"))
    both = under.join(own, ["host", "up"]).withColumn("v", (1 - g) * F.col("style") + g * F.col("importance"))
    branch = both.groupBy("host", "up").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("v"), F.max("seen").alias("seen"))
    return branch.filter((F.col("v") < low) & (F.col("seen") >= min_pages)).select("host", F.col("up").alias("path"))


def open_paths(pages: DataFrame) -> DataFrame:
    """page (hash), host, path of the branches the tree may judge on each page, and of the
    articles around them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, url, page in zip(b["page"], b["url"], b["html"], strict=True):
                got = {(x[0], "", False, x[3]) for x in kept_blocks(page)}
                ups = {p for x in got for p in (*prunable(x), x[3]) if p}
                rows += [(key, host_of(url), p) for p in ups]
            yield pd.DataFrame(rows, columns=["page", "host", "path"])

    return pages.mapInPandas(run, "page string, host string, path string")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    own = pages.select("page_id", "url", "html")
    # two 64-bit hashes name a row; rows equal in all three columns share it and its cuts
    name = F.concat_ws("-", F.hex(F.xxhash64("page_id", "url", "html")), F.hex(F.xxhash64(F.lit(1), "html", "url", "page_id")))
    keyed = own.select(name.alias("page"), "page_id", "url", "html")
    low = materialise(low_branches(materialise(importance(style_counts(own)), "style-nodes")), "style-low")
    cut = open_paths(keyed.select("page", "url", "html")).join(low, ["host", "path"]).groupBy("page").agg(F.collect_set("path").alias("low"))
    cut = materialise(cut.withColumnRenamed("page", "__page"), "style-cut")
    rows = keyed.join(cut, F.col("page") == F.col("__page"), "left").select("page_id", "url", "html", "low")

    @F.pandas_udf("string")
    def text(pages_: pd.Series, low_: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, set(x) if x is not None else frozenset()) for p, x in zip(pages_, low_, strict=True)])

    got = rows.select("page_id", "url", text("html", "low").alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))


ORACLE = r"""
WITH a AS (
  SELECT page_id, url,
         regexp_replace(coalesce(regexp_extract(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<article>(.*)</article>', 1, 's'), ''), '[ \t\r\n\f]+', ' ', 'g') AS h
  FROM pages),
b AS (SELECT page_id, url, unnest(string_split(regexp_replace(regexp_replace(replace(h, '<br>', ' '), '</?(h1|p)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10))) AS l,
             generate_subscripts(string_split(regexp_replace(regexp_replace(replace(h, '<br>', ' '), '</?(h1|p)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;?', '''', 'g'), '&amp;?', '&', 'g'), ' +', ' ', 'g')) AS l FROM b),
t AS (SELECT page_id, url, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE l <> ''), '') AS text FROM c GROUP BY page_id, url)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
