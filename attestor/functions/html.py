"""Readable text, titles, links and structured data of HTML pages."""

from __future__ import annotations

import html as entities
import json

import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as Ty

from attestor.functions.exprs import canonical_url

# Elements that carry no prose, elements that end a block.
FURNITURE = "script|style|noscript|svg|iframe|form|nav|aside|footer|header"
BLOCKS = r"p|div|section|article|li|h[1-6]|blockquote|tr|br"


def extract_text(html: Column) -> Column:
    """The prose of a page: no comments or furniture, blocks as paragraphs, entities as characters, blanks squeezed."""
    s = F.coalesce(html, F.lit(""))
    for pattern, to in (
        (r"(?s)<!--.*?-->", ""), (rf"(?is)<({FURNITURE})\b[^>]*>.*?</\1>", " "), (rf"(?i)</({BLOCKS})\s*/?>", "\n\n"), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "),
    ):
        s = F.regexp_replace(s, pattern, to)
    s = F.when(F.contains(s, F.lit("&")), decode_entities(s)).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, "[ \\t\u00a0]+", " "), r"\n{3,}", "\n\n")
    lines = F.transform(F.split(s, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


@F.pandas_udf(Ty.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else entities.unescape(t))


def title_of(html: Column) -> Column:
    """The og:title, else the title element; null without either."""
    social = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1)
    plain = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.when(social != "", social).otherwise(plain), r"(?U)\s+", " ")), F.lit(""))


LINKS = Ty.ArrayType(Ty.StructType().add("href", Ty.StringType()).add("anchor", Ty.StringType()).add("place", Ty.StringType()).add("position", Ty.DoubleType()))
_LINK = regex.compile(r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>""")
_AREA = regex.compile(rf"(?i)<(/?)({FURNITURE})\b[^>]*>")
_BARE = regex.compile(r"\[([^\]]+)\]\((https?://[^\s)]+)\)|(https?://[^\s<>\")\]]+)")


def links_in(source: str | None) -> list[dict]:
    """Links of HTML, or of Markdown and plain text: target, words, body or boilerplate, how far down the source."""
    source = source or ""
    size = max(1, len(source))
    if not regex.search(r"(?i)<a\b", source):
        return [{"href": m.group(2) or m.group(3).rstrip(".,;"), "anchor": m.group(1) or "", "place": "body", "position": m.start() / size} for m in _BARE.finditer(source)]
    areas, depth, since = [], 0, 0
    for m in _AREA.finditer(source):
        if m.group(1):
            depth = max(0, depth - 1)
            if depth == 0:
                areas.append((since, m.end()))
        else:
            since = m.start() if depth == 0 else since
            depth += 1
    out = []
    for m in _LINK.finditer(source):
        outside = not any(a <= m.start() < b for a, b in areas)
        words = " ".join(entities.unescape(regex.sub(r"<[^>]+>", " ", m.group(2))).split())
        out.append({"href": entities.unescape(m.group(1)), "anchor": words, "place": "body" if outside else "boilerplate", "position": m.start() / size})
    return out


@F.pandas_udf(LINKS)
def links(sources: pd.Series) -> pd.Series:
    return sources.map(links_in)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def is_linked(url: Column, targets: Column) -> Column:
    """Whether url is one of the target pages or lies on one of their hosts."""
    return F.exists(targets, lambda t: (canonical_url(t) == canonical_url(url)) | (host_of(t) == host_of(url)))


def person_entries(html: str | None) -> tuple[list[dict], int]:
    """Person objects of the page's JSON-LD, also within graphs, and the number of blocks that do not parse."""
    people, broken = [], 0
    for block in regex.findall(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", html or ""):
        try:
            stack = [json.loads(block)]
        except ValueError:
            broken += 1
            continue
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(reversed(node))
            elif isinstance(node, dict):
                kinds = node.get("@type")
                if "Person" in (kinds if isinstance(kinds, list) else [kinds]):
                    same = node.get("sameAs") or []
                    people.append({"name": node.get("name"), "same_as": [same] if isinstance(same, str) else list(same)})
                stack.append(node.get("@graph") or [])
    return people, broken


PEOPLE = Ty.ArrayType(Ty.StructType().add("name", Ty.StringType()).add("same_as", Ty.ArrayType(Ty.StringType())))


@F.pandas_udf(Ty.StructType().add("people", PEOPLE).add("broken", Ty.IntegerType()))
def person_schema(pages: pd.Series) -> pd.DataFrame:
    found = [person_entries(p) for p in pages]
    return pd.DataFrame({"people": [f[0] for f in found], "broken": [f[1] for f in found]})
