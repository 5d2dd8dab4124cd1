"""HTML extraction by consensus host paths.

1. Each page's containers are scored: the share of the page's good text (text that is
   neither in boilerplate elements nor in links) that they hold.
2. Containers are named by a generalised path of tags and classes (digits become
   ``#``), and the scores are votes, summed by host and path in Spark; semantic
   containers and deeper ones win over the wrappers around them.
3. Pages are extracted again from the containers at the winning path of their host; a
   page without such a container uses its own best one.
"""

from __future__ import annotations

import collections
import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_binary, fresh, pieces, stored

# Fixed values of the HTML standard: elements without content, with raw text, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video select noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br li dd dt td th tr tbody thead tfoot caption body html option optgroup summary figcaption".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"datalist"}}
#: Elements that never are main text.
DROPPED = frozenset("head nav footer aside form button dialog menu input label fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id names that mark boilerplate; a trailing * stands for any ending.
NOISE = (
    "nav* menu* footer* sidebar* aside* banner* cookie* consent* gdpr* notice* notification* alert* ad ads adv advert* adbox adslot sponsor* promo* comment comments commentlist commenter commentform disqus* respond reply replies "
    "share* sharing social* related* recommend* newsletter* subscri* signup* login* breadcrumb* pagination* pager popup* modal* overlay* widget* form forms search searchbox searchform toolbar* masthead* "
    "copyright* skip* tags taglist hidden toc outbrain* taboola* dfp* discussion* feedback*"
).split()
#: Words that may stand beside one of those; with any other word a name says something else ("notice-period", "form-factor").
NEUTRAL = frozenset(
    "a an and area article bar blog body bottom box btn button buttons block col column container content count cta custom element entry extra fixed float group has head header heading holder icon icons id image img in inline inner is item items js "
    "label large latest layer left level link links list main more new of off on one outer page panel part post primary reader right row secondary section single site slot small stack sticky tab text the title to top two unit user view web wrap wrapper zone".split()
)
_NOISE = re.compile("^(?:" + "|".join(w[:-1] + r"[a-z]*" if w.endswith("*") else w for w in NOISE) + ")$")
_HEADER = re.compile(r"^(?:header|topbar|sitehead)$")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CONTAINERS = frozenset("article main section div td body blockquote center table".split())
TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z]")
ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: A container that holds less of a page's good text than this share gets no vote.
LEAST_SHARE = 0.5
#: Longer paths are named by a hash of their beginning, so that deep pages take memory by their number of tags.
LONG_PATH = 1_000


class _Open:
    __slots__ = ("article", "dropped", "good", "link", "name", "node", "path")

    def __init__(self, name, path, dropped, link, article, node):
        self.name, self.path, self.dropped, self.link, self.article, self.node = name, path, dropped, link, article, node


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTR.findall(text)} if text.strip(" /\n\t") else {}


def _is_noise(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return any(_is_noise_name(x, in_article) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).split())


def _is_noise_name(name: str, in_article: bool) -> bool:
    words = [w.lower() for w in _NAME.findall(name)]
    noise = [bool(_NOISE.match(w)) or (not in_article and bool(_HEADER.match(w))) for w in words]
    if in_article and words[:1] == ["article"]:  # a part or a state of the article, such as "article-comments-off"
        return False
    return any(noise) and all(n or w in NEUTRAL or len(w) < 3 or w.isdigit() for n, w in zip(noise, words, strict=True))


def parse(page: str) -> tuple[list[tuple[str, int, str]], list[tuple[int, bool, str]]]:
    """(containers, pieces): a container is (generalised path, parent, tag); a piece of text is
    (its innermost container, whether a link holds it, text), in page order.  Text of
    dropped elements is left out; the text "\\n" stands for a block's edge."""
    containers: list[tuple[str, int, str]] = [("", -1, "root")]
    found: list[tuple[int, bool, str]] = []
    stack = [_Open("", "", False, False, False, 0)]
    opened: collections.Counter = collections.Counter()
    at, n = 0, len(page)

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.name] -= 1
        del stack[i:]

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not top.dropped:
            found.append((top.node, top.link, html.unescape(raw) if "&" in raw else raw))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        token = m.group()
        if token == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        name = m.group(2)
        if name is None:  # a declaration, or a tag that does not end as it should
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCK and not stack[-1].dropped:
                found.append((stack[-1].node, False, "\n"))
            for i in range(len(stack) - 1 if opened[name] > 0 else 0, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if name in CLOSES_P and opened["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in CONTAINERS or stack[i].name in ("td", "th", "li", "button"):
                    break
        elif name in SIBLINGS and any(opened[x] > 0 for x in SIBLINGS[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in FENCE[name]:
                    break
                if stack[i].name in SIBLINGS[name]:
                    close(i)
                    break
        top = stack[-1]
        if name in BLOCK and not top.dropped:
            found.append((top.node, False, "\n"))
        if name in VOID:
            continue
        attrs = _attributes(m.group(3))
        if m.group(3).endswith("/") and name in RAW:
            continue
        if name in RAW:
            end = re.compile("</" + re.escape(name) + r"[\s/>]", re.I).search(page, at)
            if end is None:
                at = n
            else:
                after = page.find(">", end.start())
                at = n if after < 0 else after + 1
            continue
        dropped = top.dropped or _is_noise(name, attrs, top.article)
        label = name
        if attrs.get("class"):
            label += "." + ".".join(sorted(re.sub(r"\d+", "#", attrs["class"]).split()))
        path, node = top.path + "/" + label, top.node
        if len(path) > LONG_PATH:
            path = f"#{xxhash.xxh3_64_hexdigest(path)}/{label[:LONG_PATH]}"
        if name in CONTAINERS and not dropped:
            containers.append((path, top.node, name))
            node = len(containers) - 1
        opened[name] += 1
        stack.append(_Open(name, path, dropped, top.link or name == "a", top.article or name in ("article", "main"), node))
    return containers, found


def scores(containers, found) -> list[int]:
    """Per mille of the page's good text that each container holds."""
    good = [0] * len(containers)
    for node, link, text in found:
        if not link:
            good[node] += len(text.strip())
    for i in range(len(containers) - 1, 0, -1):
        good[containers[i][1]] += good[i]
    return [1000 * g // good[0] if good[0] else 0 for g in good]


def _rank(share: float, path: str) -> float:
    """Semantic containers and deeper ones go before the wrappers that hold the same text."""
    tail = path.rpartition("/")[2].partition(".")[0]
    return share * (1.6 if tail == "article" else 1.3 if tail == "main" else 1.0) * (1 + 0.01 * path.count("/"))


def main_text(page: str, path: str | None) -> str:
    """Text of the containers at ``path``, or of the page's own best container without any."""
    containers, found = parse(page)
    share = scores(containers, found)
    inside = [path is not None and c[0] == path for c in containers]
    if not any(s and i for s, i in zip(share, inside, strict=True)):
        enough = [i for i, s in enumerate(share) if s >= 1000 * LEAST_SHARE] or [0]
        best = max(enough, key=lambda i: (_rank(share[i], containers[i][0]), -i))
        inside = [i == best for i in range(len(containers))]
    for i in range(1, len(containers)):
        inside[i] = inside[i] or inside[containers[i][1]]
    return " ".join("".join(t for node, _, t in found if inside[node]).split())


def votes(page: str) -> list[tuple[str, int]]:
    """(path, share per mille) of the containers that hold at least half of the good text."""
    containers, found = parse(page)
    best: dict[str, int] = {}
    for (path, _, _), s in zip(containers, scores(containers, found), strict=True):
        if path and s >= 1000 * LEAST_SHARE:
            best[path] = max(best.get(path, 0), s)
    return sorted(best.items())


def host_of(url):
    """Host of a URL column in lower case; '' for null or relative URLs."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning container path of each host."""

    def ballots(batches):
        for whole in batches:
            for part in pieces(whole, 256):
                hosts, paths, shares, ranks = [], [], [], []
                for host, page in zip(part.column(0).to_pylist(), as_binary(part.column(1)).to_pylist(), strict=True):
                    for path, share in votes((page or b"").decode("utf-8", "replace")):
                        hosts.append(host)
                        paths.append(path)
                        shares.append(share)
                        ranks.append(int(1000 * _rank(share, path)))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(ranks, pa.int64())], ["host", "path", "vote"])

    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(ballots, "host string, path string, vote long")
    counted = cast.groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    return counted.groupBy("host").agg(F.max(F.struct("vote", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and what else they carry) without html, with ``main_text``.

    Null and empty pages and pages of boilerplate only give ''.  Null URLs share the
    host ''.  Repeated pages are extracted each; an input column named ``main_text`` is
    replaced, other names do not matter.  Of paths with equal votes the last by code point
    wins.  Very long and very deep pages are taken whole.  An empty table gives no rows.
    Winners are written first, so that Spark knows their size when it
    chooses how to join them: a small table is broadcast, a large one is shuffled and
    its hot hosts split.
    """
    pages = pages.drop("main_text")
    carried = [c for c in pages.columns if c != "html"]
    its_host, its_html, its_path = (fresh(pages, c) for c in ("host", "html", "path"))
    winners = stored(host_paths(pages), "host_paths").select(F.col("host").alias(its_host), F.col("path").alias(its_path))
    joined = pages.withColumn(its_host, host_of(F.col("url"))).join(winners, its_host, "left").select(*[f"`{c}`" for c in carried], F.col("html").cast("string").alias(its_html), its_path)
    schema = joined.select(*[f"`{c}`" for c in carried]).schema.add("main_text", "string")
    k = len(carried)

    def extract(batches):
        for whole in batches:
            for part in pieces(whole, 256):
                texts = [main_text((h or b"").decode("utf-8", "replace"), p) for h, p in zip(as_binary(part.column(k)).to_pylist(), part.column(k + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string())], [*carried, "main_text"])

    return joined.mapInArrow(extract, schema)


def op4_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
