"""Text and title of one HTML page: a small helper for the extraction job.

Every text node is kept in document order with a space wherever two nodes meet;
script and style contents are skipped; a title's text counts as page text.
"""

from __future__ import annotations

import re
from html import unescape

# Element classes of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SKIPPED = frozenset(("script", "style"))
RAW = frozenset(("iframe", "noembed", "noframes", "xmp"))
ESCAPABLE = frozenset(("title", "textarea"))
OUTER = frozenset(("html", "head", "body"))
CREATED_BY_END_TAG = frozenset(("p", "br"))

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?![a-zA-Z])(?:[^>]*+(?:>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)",
    re.DOTALL,
)
_CLOSERS: dict[str, re.Pattern] = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
    for name in SKIPPED | RAW | ESCAPABLE
}
_BLANK = re.compile(r"[ \t\n\r\f]*\Z")


def read_page(html: str) -> tuple[str, str]:
    """`(text, title)`; the last title with text wins, none gives ''."""
    parts: list[str] = []
    title = ""
    open_count: dict[str, int] = {}
    outer_seen: set[str] = set()
    at, size = 0, len(html)
    while at < size:
        tag = _MARKUP.search(html, at)
        if tag is None:
            parts.append(unescape(html[at:]))
            break
        if tag.start() > at:
            parts.append(unescape(html[at:tag.start()]))
        at = tag.end()
        if tag["name"] is None:
            if not tag[0].startswith(("<!doctype", "<!DOCTYPE", "</>")):
                parts.append(" ")
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if open_count.get(name):
                open_count[name] -= 1
                parts.append(" ")
            elif name in CREATED_BY_END_TAG:
                parts.append(" ")
            continue
        if name in OUTER:
            if name not in outer_seen:
                outer_seen.add(name)
                parts.append(" ")
            continue
        parts.append(" ")
        if name == "plaintext":
            parts.append(html[at:])
            break
        if name in _CLOSERS:
            closer = _CLOSERS[name].search(html, at)
            stop = closer.start() if closer else size
            inner = html[at:stop]
            if name in ESCAPABLE:
                inner = unescape(inner)
            if name == "title" and not _BLANK.match(inner):
                title = inner
            if name not in SKIPPED:
                parts.append(inner)
            parts.append(" ")
            end = html.find(">", stop)
            at = size if end < 0 else end + 1
        elif name not in VOID:
            open_count[name] = open_count.get(name, 0) + 1
    return "".join(parts), title
