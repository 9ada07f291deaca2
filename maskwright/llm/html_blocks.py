"""Cuts an HTML page into leaf blocks: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names by how they nest, after the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mfrac mi mmultiscripts mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text, up to the end tag or the page's end.
RAW = frozenset("script style title iframe noframes".split())
#: Ordinary elements whose content is not shown; their text is left out while they are open. Those of FENCED are not left by a tag in CLOSES.
HIDDEN = frozenset("noscript template svg object audio video canvas annotation annotation-xml".split())
FENCED = frozenset("template svg object".split())
#: A start tag of the key ends an open element of the values, as far up as the nearest element of the last set.
CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",),
} | {t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()}
SCOPE = frozenset("article aside body div dl fieldset footer form header html main menu nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # from the outermost ancestor to the innermost block element
    names: frozenset[str]  # parts of the ancestors' class, id and role values, in lower case without a plural s
    linked: int = 0  # characters in links
    inline: frozenset[str] = field(default_factory=frozenset)


def name_parts(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    return frozenset(p.lower().removesuffix("s") for m in _NAMED.finditer(attributes) for p in _PART.findall(m[1] or m[2] or m[3] or ""))


def leaf_blocks(page: str | None) -> list[Block]:
    """All leaf blocks with text, in page order. White space in a block is one space; references are decoded."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links, inside, hidden = 0, 0, 0
    seen: set[str] = set()

    def first_hidden() -> int:
        return next((k for k, (t, _) in enumerate(stack) if t in HIDDEN), len(stack)) if hidden else len(stack)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                shown = stack[: first_hidden()]
                tags = tuple(t for t, _ in shown if t not in INLINE)
                out.append(Block(text, tags, frozenset().union(*(n for _, n in shown)), min(links, len(text)), frozenset(seen)))
        parts.clear()
        seen.clear()
        links = 0

    def close_to(at: int) -> None:
        nonlocal inside, hidden
        if hidden and at < first_hidden():  # leaves the block around it
            flush()
        inside -= sum(t == "a" for t, _ in stack[at:])
        hidden -= sum(t in HIDDEN for t, _ in stack[at:])
        del stack[at:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not hidden:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if inside:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or tag in INLINE and stack[k][0] not in INLINE), None)
            if tag not in INLINE and tag not in VOID and tag not in HIDDEN:
                if not hidden:
                    flush()
            elif tag == "br":
                parts.append(" ")
            if k is not None and stack[k][0] == tag:
                close_to(k)
            continue
        if tag in RAW:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag not in ("script", "style", "title"):
                parts.append(" ")
            continue
        if tag in HIDDEN or tag == "math":
            if tag not in ("noscript", "template"):
                parts.append(" ")
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                hidden += tag in HIDDEN
                stack.append((tag, name_parts(m[3] or m[6] or "")))
            continue
        if tag in VOID:
            if tag == "hr" and not hidden:
                flush()
            elif tag != "wbr":
                parts.append(" ")
            continue
        if tag not in INLINE:
            if not hidden:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name in CLOSES.get(tag, ()):
                    close_to(k)
                elif name in SCOPE or name in FENCED:
                    break
        else:
            if not hidden:
                seen.add(tag)
            inside += tag == "a"
        stack.append((tag, name_parts(m[3] or m[6] or "")))
    flush()
    return out
