"""Main text of web pages by the best-scoring run of tokens.

A page is a sequence of words and tags. Words score by the section they stand in, tags score
below zero; the weights are log odds counted on labelled pages, those that mark their own
article with an ``article`` element, of which a bounded sample of SAMPLE pages is used. One
linear scan finds the contiguous region with the greatest sum. Within it, sections whose words
score below zero (adverts, forms, comments and the like) are left out.

Sections that the labelled pages do not show score by their kind: navigation, headers, footers,
sidebars, forms, what is hidden and what a class token, id or role names as advert, notice, comments
and so on are left out without cutting the region, other sections score like the one around them.
A name says nothing on a body, main, article, heading or inline tag, nor where the weights learned
for that section are positive.

Text is decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one line feed in page order. Pages are read in linear time, however long, nested or broken. Defined results: a null or empty page, or one without a positive
region, has the empty text; null ids and urls are kept; unclosed tags, comments and references
are read as far as they go; repeated rows are extracted one by one; an empty table gives an
empty table. Only the named columns are read, so other columns cannot clash. Pages are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallygrid.llm.textblock import blocks

#: Labelled pages that the weights are counted on.
SAMPLE = 1_000
#: Bounds of a weight.
MOST, LEAST = 8.0, -8.0
#: A tag scores at most this.
TAG = -0.05

_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _tokens(inside: str) -> re.Pattern:
    """The pattern of a page's parts; ``inside`` is what a tag may hold before its end."""
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<(?P<raw>script|style|noscript|template|svg|iframe|object|head|textarea|select)\b{inside}>.*?(?:</(?P=raw)\s*+>|\Z)"
        r"|<[!?][^>]*+(?:>|\Z)"
        rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{inside})>"
        r"|(?P<text>[^<]++|<)",
        re.S | re.I,
    )


_TOKEN, _UNQUOTED = _tokens(_QUOTED), _tokens("[^>]*+")
_OPENS = re.compile(r"<[a-zA-Z/]")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SECTIONS = frozenset("article main section div nav header footer aside form menu dialog body td table figure details ul ol".split())
_BOILERPLATE = frozenset("nav header footer aside form menu dialog button label fieldset".split())
_HINT = re.compile(
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|comment\w*|disqus|respond|"
    r"reply|replies|sidebar|side|menu|nav\w*|breadcrumb\w*|footer|header|masthead|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscri\w*|login|signup|search|widget|pager|pagination|tags|copyright|legal|disclaimer)\Z",
)
#: Words that a class token may hold beside those and still name a section as boilerplate.
_BESIDE = frozenset("area bar block bottom box container global left links list main page primary right secondary section site top wrapper".split())
#: Sections that hold the page's text, whatever they are called.
_WHOLE = frozenset("html body main article".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Tags inside a line say nothing about where a region ends.
_INLINE = frozenset("a abbr b br cite code del em font i ins kbd mark q s small span strong sub sup time u wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACES = frozenset("br td th wbr option img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _key(name: str, rest: str) -> str:
    marks = " ".join(a or b or c for a, b, c in _MARK.findall(rest)).lower()
    return f"{name}.{marks}" if marks else name


def _hidden(rest: str) -> bool:
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _names_boilerplate(marks: str) -> bool:
    for token in marks.split():
        parts = [x for x in re.split("[_-]+", token) if x]
        hints = [bool(_HINT.match(x)) for x in parts]
        if any(hints) and all(hint or x in _BESIDE for hint, x in zip(hints, parts)):
            return True
    return False


def _prior(key: str, rest: str) -> bool:
    """Whether a section names itself as boilerplate."""
    name, _, marks = key.partition(".")
    if name in _WHOLE:
        return False
    if name in _BOILERPLATE or _hidden(rest):
        return True
    return name not in _INLINE and name not in _HEADINGS and _names_boilerplate(marks)


def _parts(page: str) -> Iterator[re.Match]:
    """Tags, texts and what is passed over, in order and in linear time.

    A tag whose quotes are never closed ends at the next ``>``; from there on quotes mean nothing, so
    that no more than one look goes to the end of the page in vain. After the last ``>`` there is only text.
    """
    pattern, at, last = _TOKEN, 0, page.rfind(">")
    while at < len(page):
        m = pattern.match(page, at)
        if m["text"] == "<" and at < last and pattern is _TOKEN and _OPENS.match(page, at):
            pattern = _UNQUOTED
            m = pattern.match(page, at)
        if m["text"] is not None and at > last:
            yield _REST.match(page, at)
            return
        yield m
        at = m.end()


_REST = re.compile(r"(?P<raw>(?!))?(?P<close>(?!))?(?P<name>(?!))?(?P<rest>(?!))?(?P<text>.+)", re.S)


def read_page(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, bool, int]]]:
    """(tokens, sections) of a page. A token has a kind ("tag" or "text"), name or text, and its section's number.

    A section is its key, whether it names itself as boilerplate, and the section around it; number 0 is
    the page. A section's own tags stand outside it.
    """
    out: list[tuple[str, str, int]] = []
    sections: list[tuple[str, bool, int]] = [("", False, 0)]
    around = 0
    stack: list[tuple[str, int]] = []  # open tags, and the section outside each
    opened: Counter = Counter()
    for m in _parts(page):
        text = m["text"]
        if text is not None:
            out.append(("text", text, around))
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if opened[name]:
                while stack:
                    top, around = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
            out.append(("tag", "/" + name, around))
            continue
        out.append(("tag", name, around))
        if name not in _VOID and not m["rest"].endswith("/"):
            key = _key(name, m["rest"])
            prior = _prior(key, m["rest"])
            if name in _SECTIONS or prior or name in _BLOCKS:
                stack.append((name, around))
                opened[name] += 1
            if name in _SECTIONS or prior:
                sections.append((key, prior, around))
                around = len(sections) - 1
    return out, sections


def _labels(tokens: list) -> tuple[int, int] | None:
    """The tokens between the article's tags, if the page has just one article."""
    first = [i for i, t in enumerate(tokens) if t[1] == "article" and t[0] == "tag"]
    last = [i for i, t in enumerate(tokens) if t[1] == "/article" and t[0] == "tag"]
    return (first[0], last[0]) if len(first) == 1 and len(last) == 1 and first[0] < last[0] else None


def count_page(page: str) -> Counter:
    """(feature, inside the article): how often. Features are tags, and sections by their words."""
    tokens, sections = read_page(page)
    bounds = _labels(tokens)
    out: Counter = Counter()
    if bounds:
        for i, (kind, value, around) in enumerate(tokens):
            inside = bounds[0] < i < bounds[1]
            if kind == "tag":
                out["t:" + value, inside] += 1
            elif n := len(value.split()):
                out["w:" + sections[around][0], inside] += n
    return out


def page_text(page: str, weights: dict[str, float]) -> str:
    """Main text of a page under weights of features."""
    tokens, sections = read_page(page)
    # By section: the weight of its words, and whether it is boilerplate, which the innermost section decides
    # that has a name for it, or a positive weight of its own.
    word_weight, boilerplate = [weights.get("w:", 1.0)], [False]
    for key, prior, outer in sections[1:]:
        known, name = weights.get("w:" + key), key.partition(".")[0]
        if prior:
            boilerplate.append(known is None or known < 0)
        else:
            boilerplate.append(boilerplate[outer] and not ("." in key and known is not None and known > 0))
        if known is None and name in _WHOLE:
            known = weights.get("w:" + name)
        word_weight.append(word_weight[outer] if known is None else known)

    best, best_span, total, start = 0.0, None, 0.0, 0
    scores = []
    for i, (kind, value, around) in enumerate(tokens):
        if boilerplate[around]:
            score = -1e-6  # boilerplate inside the region neither adds nor, however long, cuts it off
        elif kind == "tag":
            name = value.lstrip("/")
            if name in _INLINE:
                score = TAG
            else:
                score = min(TAG, weights.get("t:" + value, LEAST / 8 if name in _BOILERPLATE else TAG))
        else:
            n = len(value.split())
            score = n * word_weight[around] if n else 0.0
        scores.append(score)
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_span = total, (start, i + 1)
    if best_span is None:
        return ""
    done, block = [], []
    for i in range(*best_span):
        kind, value, around = tokens[i]
        name = value.lstrip("/") if kind == "tag" else ""
        if kind == "text":
            if scores[i] >= 0:
                block.append(value)
        elif name in _SPACES:
            block.append(" ")
        elif name in _BLOCKS:
            done.append("".join(block))
            block = []
    done.append("".join(block))
    lines = (" ".join(html.unescape(x).split()) for x in done)
    return "\n".join(line for line in lines if line)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for page in batch.column(0).to_pylist():
            found.update(count_page(page))
        if found:
            names = [k[0] for k in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([k[1] for k in found]), pa.array(list(found.values()))], names=["feature", "inside", "n"]
            )


def fit_weights(pages: DataFrame, page_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Log odds of features inside the article, from at most ``sample`` labelled pages, drawn by content hash."""
    text = F.col(page_col).cast("string")
    labelled = pages.select(text.alias("page")).filter(F.lower("page").rlike(r"<article[\s>]"))
    # The bound comes from hashes alone, so that no task gathers pages; only equal pages tie.
    place = F.xxhash64("page")
    bound = labelled.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = labelled.filter(place <= F.lit(bound).cast("long")).limit(sample)
    counts = drawn.mapInArrow(_counts, "feature string, inside boolean, n long")
    rows = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o")
    )
    rows = rows.collect()  # features of the sampled pages alone
    # Tags alone at the article's edge decide where it ends, so a feature seen on one side only is firm.
    return {
        r["feature"]: (LEAST if r["i"] == 0 else MOST if r["o"] == 0 and r["feature"][0] == "w" else max(LEAST, min(MOST, math.log((r["i"] + 1) / (r["o"] + 1)))))
        for r in rows
    }


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", page_col: str = "html", weights: dict[str, float] | None = None
) -> DataFrame:
    """One row per row of ``pages``: id, url, text and n_chars (code points)."""
    weights = fit_weights(pages, page_col) if weights is None else weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in blocks(batches, "page"):
            texts = [page_text(p, weights) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(page_col).cast("string").alias("page"))
    kinds = [rows.schema[k].dataType.simpleString() for k in ("id", "url")]
    out = rows.mapInArrow(work, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
