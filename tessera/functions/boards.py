"""Job boards and career pages: the board that a URL names, and what a page holds. Expressions, but for the tokenizer of pages."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of, workplace

#: Host of each platform, in the order in which they are asked, and the path step that precedes a board.
PLATFORMS = (("greenhouse", "greenhouse.io", None), ("lever", "lever.co", "postings"), ("ashby", "ashbyhq.com", "job-board"), ("smartrecruiters", "smartrecruiters.com", None))

#: What marks a link of a page as one to postings.
HINTS = ("greenhouse", "lever.co", "ashbyhq", "smartrecruiters", "myworkdayjobs", "jobvite", "icims", "workable", "bamboohr", "/job", "/careers", "/positions")

#: Verdict on remote work by workplace.
VERDICTS = {"remote": "remote-eligible", "hybrid": "hybrid", "onsite": "onsite"}


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty for what is no URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def steps(url: Column) -> Column:
    """Non-empty steps of the path."""
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")


def parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, null without it."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def board(url: Column) -> Column:
    """struct(platform, token) of the board that a URL names; both null for other URLs and for null."""
    at, path = host(url), steps(url)
    first = F.get(path, F.lit(0))
    platform = token = None
    for name, domain, before in PLATFORMS:
        hit = at.contains(domain)
        if before:
            place = F.array_position(path, before)
            own = F.coalesce(F.when(place > 0, F.get(path, place.cast("int"))), first)
        else:
            own = first
        if name == "greenhouse":  # embedded boards name their token in a parameter, its interface in a third step
            listed = at.contains("boards-api") & (first == "v1") & (F.get(path, F.lit(1)) == "boards")
            own = F.coalesce(parameter(url, "for"), F.when(listed, F.get(path, F.lit(2))), first)
        platform = F.when(hit, name) if platform is None else platform.when(hit, name)
        token = F.when(hit, own) if token is None else token.when(hit, own)
    return F.struct(F.when(token.isNotNull(), platform).alias("platform"), token.alias("token"))


#: Elements without content, and those whose content is no text for readers.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = ("script", "style", "template")
#: A comment, declaration or tag. All repeats are possessive and what is not closed runs to the end, so time is linear in a page.
_MARKUP = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_EMPTY = re.compile(r"""(?:^|[\s"'])/$""")
_RAW_END = {t: re.compile(rf"(?i)</{t}(?=[\s/>])") for t in RAW}
_PARSED = "struct<title:string, head:string, excerpt:string, links:array<struct<label:string, href:string>>>"


def _flat(text: str) -> str:
    return " ".join(text.split())


def _strings(html: str):
    """(kind, value, attributes) in the order of a page: text, open and close; decoded, without comments and scripts."""
    at = 0
    while True:
        m = _MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            yield "text", unescape(text), ""
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if m[1]:
            yield "close", name, ""
        elif name:
            yield "open", name, m[3]
            if name in VOID or _EMPTY.search(m[3]):
                yield "close", name, ""
            elif name in RAW:
                end = _RAW_END[name].search(html, at)
                at = end.start() if end else len(html)


def read_page(html: str, label_width: int = 120) -> dict:
    """title, head (6,000 characters of visible text), excerpt and links of a page; see page()."""
    parts, depth, held, count = [], [], {}, {}
    wanted: list[tuple[str, str, int, int]] = []  # what is open now, by its place in the stack: kind, address, first part, number
    firsts, found, begun = {}, [], 0

    def close(entry: tuple[str, str, int, int]) -> None:
        kind, href, start, number = entry
        if kind == "a":
            label, i = "", start
            while i < len(parts) and len(label) < label_width:  # nested links share their parts, so no more than the label is read
                label, i = f"{label} {_flat(parts[i][: 4 * label_width])}".strip(), i + 1
            found.append((number, href, label[:label_width]))
        elif kind not in firsts:
            firsts[kind] = _flat(" ".join(parts[start:]))

    for kind, value, attributes in _strings(html):
        if kind == "text":
            if value.strip():
                parts.append(value.strip())
        elif kind == "open":
            href = None
            if value == "a":
                for m in _ATTRIBUTE.finditer(attributes):
                    if m[1].lower() == "href":
                        href = unescape(next((g for g in m.groups()[1:] if g is not None), ""))
            first = value in ("h1", "title") and value not in held
            if first:
                held[value] = True
            depth.append((value, len(wanted)))
            count[value] = count.get(value, 0) + 1
            if first or href is not None:
                wanted.append((value, href or "", len(parts), begun))
                begun += 1
        elif count.get(value):  # closes what is open inside as well; an end without a beginning is nothing
            while True:
                name, before = depth.pop()
                count[name] -= 1
                if len(wanted) > before:
                    close(wanted.pop())
                if name == value:
                    break
    while wanted:
        close(wanted.pop())
    links, seen = [], set()
    for _, href, label in sorted(found, key=lambda x: x[0]):
        if label and href not in seen:
            seen.add(href)
            links.append({"label": label, "href": href})
    text = " ".join(parts)
    plain = _flat(text)
    excerpt = plain[:400].rstrip() + "..." if len(plain) > 400 else plain
    return {"title": firsts.get("h1") or firsts.get("title") or None, "head": text[:6000], "excerpt": excerpt, "links": links}


def parsed(html: Column) -> Column:
    """read_page() of a column, in Arrow batches; null for null."""
    kind = pa.struct([("title", pa.string()), ("head", pa.string()), ("excerpt", pa.string()), ("links", pa.list_(pa.struct([("label", pa.string()), ("href", pa.string())])))])

    @F.arrow_udf(_PARSED)
    def run(pages: pa.Array) -> pa.Array:
        return pa.array((read_page(p.as_py()) if p.is_valid else None for p in pages), kind)

    return run(html)


def hinted(links: Column, hints: tuple[str, ...] = HINTS, most: int = 25) -> Column:
    """The first links whose address holds a hint."""
    return F.slice(F.filter(links, lambda p: any_of(F.lower(p["href"]), hints)), 1, most)


def page_of(p: Column) -> Column:
    """page() of what parsed() gives."""
    empty = F.lit("")
    return F.struct(p["title"].alias("title"), workplace(empty, p["head"], empty).alias("workplace"), p["excerpt"].alias("excerpt"), hinted(p["links"]).alias("links"))


def page(html: Column) -> Column:
    """struct(title, workplace, excerpt, links) of a career page.

    The first heading stands before the title. Text is what is visible, strings of different elements apart by a blank, all
    entities decoded; white space is collapsed. links: the first 25 that have a label and an
    address with a hint, each address once, in the order in which they begin. Elements that are not closed end with the one around them,
    tags that are not closed at the end of the page are dropped. Null pages have nulls only, empty ones an empty excerpt and no links.
    """
    return page_of(parsed(html))


def verdict(kind: Column) -> Column:
    """What a workplace says about remote work; unknown ones are ambiguous."""
    names = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, kind), F.lit("ambiguous"))
