"""Main text of web pages as the maximum-scoring contiguous run of words and tags.

Words score positive and tags negative. The scores are log odds learned from labelled pages: those that mark their
article themselves (`article` or `main`), a sample of at most about `most_pages` of them, whose tokens inside the mark
are content and outside are not. A word or tag counts by its context: inside such a mark, outside it on a page that has
one, or on a page without any. Words in elements that are never content (menus, forms, scripts, adverts, comments, ...)
are left out of the result and score next to nothing, so that content goes on behind them. One linear scan finds the
best run; it is widened to whole blocks. Text keeps page order: references decoded, white space inside a block one
space, blocks joined by a line end.

Defined results: a null or empty page, or one without any scoring word, has the empty text; ties go to the earlier and
shorter run; unclosed and stray tags are mended as browsers do; repeated rows and further columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import keep_rate, portions, read
from telesift.llm.registry import query

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
NEVER = frozenset("nav footer aside form script style noscript template iframe svg select button textarea object canvas audio video dialog menu head title label".split())
MARKS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner promo promos promoted promotion sponsor sponsored nav navbar navigation menu "
    "menus submenu breadcrumb breadcrumbs pagination pager sidebar sidebars rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "disqus replies reply respond discussion widget widgets".split()
)
HOLDS = frozenset("article content main post entry story body text page wrapper container".split())
OUTER = frozenset("html body main".split())
MOST_PAGES, STRONGEST, WEAKEST, UNSEEN = 2000, 2.5, 0.01, 0.3
DEFAULT = {"word@in": 1.0, "word@out": -1.0, "word@none": 1.0}


def hinted(name: str) -> bool:
    """Whether a class or id names something that is no content (`post-comments`, but not `with-sidebar` or `ad-free-content`)."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or not HINTS.intersection(parts) or not {"with", "has", "no", "without", "not"}.isdisjoint(parts):
        return False
    return parts[-1] in HINTS or HOLDS.isdisjoint(parts)


def left_out(name: str, attributes: str, marked: bool) -> bool:
    """Whether an element never holds content. A `header` inside an article is the article's own."""
    if name in NEVER or (name == "header" and not marked):
        return True
    if not attributes.strip() or name in OUTER:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id") and any(hinted(v) for v in value.split()):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, int]]:
    """(kind, context, left out, block) with text tokens as ("=text", ...) and tags as (name, ...); contexts: in, out, none.

    `block` numbers the blocks of the page, so that texts of one block can be joined again. A page has contexts if an
    article or main element, as parsed, holds text that is not left out: marks in comments or scripts, empty ones, and
    articles that are reader comments by their class do not count.
    """
    said: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, left out, inside a mark
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each name is open; "" for blocks
    at, block = 0, 0

    def say(kind: str) -> None:
        marked, gone = (stack[-1][2], stack[-1][1]) if stack else (False, False)
        said.append((kind, marked, gone, block))

    def push(name: str, gone: bool, marked: bool) -> None:
        places[name].append(len(stack))
        if name in BLOCKS:
            places[""].append(len(stack))
        stack.append((name, gone, marked))

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCKS:
                places[""].pop()

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text.strip():
            say("=" + text)
        elif text:
            say("= ")
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say("=" + m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if name in BLOCKS:
            block += 1
        if name == "br":
            say("= ")
        if m[1]:
            if places[name]:
                close(places[name][-1])
            say(name)
            continue
        if name in BLOCKS and places[""] and stack[places[""][-1]][0] == "p":  # a block ends an open paragraph and what is open inside it
            close(places[""][-1])
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        gone, marked = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            say(name)
        elif name in VOID or m[3].rstrip().endswith("/") and name in ("svg", "path"):
            say(name)
        else:
            push(name, gone or left_out(name, m[3], marked), marked or name in MARKS)
            say(name)
    has_mark = any(marked and not gone and kind[0] == "=" and kind != "= " for kind, marked, gone, _ in said)
    return [(kind, ("in" if marked else "out") if has_mark else "none", gone, at_block) for kind, marked, gone, at_block in said]


def learned(pages: DataFrame, most_pages: int = MOST_PAGES) -> dict[str, float]:
    """Scores by token and context, from about `most_pages` pages that mark their article."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.col("html"), F.lit("extract")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = marked.where(draw < keep_rate(n, most_pages)).select("html")

    def count(batches):
        met = Counter()
        for batch in portions(batches, "html"):
            for page in batch.column("html").to_pylist():
                for kind, context, gone, _ in tokens(page):
                    text = kind[0] == "="
                    if context != "none" and not (text and gone):
                        met["word" if text else kind, context == "in"] += len(kind[1:].split()) if text else 1
        keys = list(met)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([met[k] for k in keys], pa.int64())], names=["token", "inside", "n"])

    rows = sample.mapInArrow(count, "token string, inside boolean, n long").groupBy("token", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(1000).collect()
    counts = {(r.token, r.inside): float(r.n) for r in rows}
    total = {side: sum(v for k, v in counts.items() if k[1] is side) for side in (True, False)}
    if not total[True]:
        return dict(DEFAULT)
    names = {k[0] for k in counts}
    scores = dict(DEFAULT)
    for t in names:
        inside, outside = ((counts.get((t, side), 0.0) + 0.5) / (total[side] + len(names)) for side in (True, False))
        odds = float(np.log(inside / outside))
        if t == "word":
            scores["word@in"] = scores["word@none"] = min(STRONGEST, max(WEAKEST, odds))
            scores["word@out"] = -scores["word@in"]
        else:
            scores[f"{t}@in"] = -WEAKEST
            scores[f"{t}@out"] = scores[f"{t}@none"] = -min(STRONGEST, max(WEAKEST, -odds))
    return scores


def best_run(scores: list[float]) -> tuple[int, int]:
    """(first, last + 1) of the maximum-scoring contiguous run; (0, 0) if no score is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += s
        if here > best:
            best, found = here, (start, i + 1)
    return found


def main_text(page: str | None, scores: dict[str, float]) -> str:
    if not page:
        return ""
    found = tokens(page)
    values = []
    for kind, context, gone, _ in found:
        if kind[0] == "=":
            word = scores[f"word@{context}"]
            values.append(len(kind[1:].split()) * (-WEAKEST if gone else word))
        else:
            values.append(scores.get(f"{kind}@{context}", -WEAKEST if context == "in" else -UNSEEN))
    first, last = best_run(values)
    if first == last:
        return ""
    lo, hi = found[first][3], found[last - 1][3]
    blocks: dict[int, list[str]] = {}
    for kind, context, gone, block in found:
        if kind[0] == "=" and not gone and lo <= block <= hi and scores[f"word@{context}"] > 0:
            blocks.setdefault(block, []).append(kind[1:])
    lines = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Adds text and n_chars to the pages, whose html goes."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string, n_chars long"])

    def run(batches):
        for batch in portions(batches, "html"):
            texts = [main_text(page, scores) for page in batch.column("html").to_pylist()]
            arrays = [batch.column(f.name) for f in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + ["text", "n_chars"])

    return pages.mapInArrow(run, schema)


@query("op4_extract")
def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), learned(pages))
