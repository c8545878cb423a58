"""Code and prose splitters, with a protocol for others.

``structural`` cuts source at definitions (Python by its syntax tree, other languages by
indentation and braces) and packs whole blocks to a size; ``sentences`` packs sentences with an
overlap, measured in white-space tokens.
"""

from __future__ import annotations

import ast
import re
from typing import Protocol

from tessera.operators.structured import runs

FALLBACK_OVERLAP = 200
CHUNK_LINES = 60


class Splitter(Protocol):
    """Source text and its language to chunk texts."""

    def __call__(self, text: str, language: str, capacity: int) -> list[str]: ...


def blocks(text: str, language: str) -> list[str]:
    """Top-level blocks: consecutive lines that belong to one definition or stretch."""
    lines = text.split("\n")
    starts = {0}
    if language == "python":
        for node in ast.parse(text).body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            starts.add(first - 1)
    else:
        depth, least = 0, None
        for k, line in enumerate(lines):
            bare = re.sub(r'"(\\.|[^"\\])*"|\'(\\.|[^\'\\])*\'|//.*', "", line)
            if bare.strip() and depth <= (1 if least is None else least + 1) and not bare.lstrip().startswith(("}", ")", "]")) and (k == 0 or not lines[k - 1].strip() or lines[k - 1].rstrip().endswith("}")):
                starts.add(k)
            depth = max(0, depth + bare.count("{") - bare.count("}"))
    order = sorted(starts)
    return ["\n".join(lines[a:b]) for a, b in zip(order, [*order[1:], len(lines)], strict=True)]


def structural(text: str, language: str, capacity: int) -> list[str]:
    parts: list[str] = []
    for block in blocks(text, language):
        lines = block.split("\n")
        if len(block) <= capacity and len(lines) <= CHUNK_LINES:
            parts.append(block)
        else:
            for a, b in runs([len(x) + 1 for x in lines], capacity):
                parts += ["\n".join(lines[k : k + CHUNK_LINES]) for k in range(a, b, CHUNK_LINES) for lines in [lines[:b]]]
    packed = ["\n".join(parts[a:b]) for a, b in runs([len(p) + 1 for p in parts], capacity)]
    return [p.strip("\n") for p in packed if p.strip()]


def sentences(text: str, capacity: int, overlap: int) -> list[str]:
    """Chunks of whole sentences of at most ``capacity`` tokens, repeating at most ``overlap`` tokens."""
    found = [s for s in re.split(r"(?<=[.!?])\s+|\n{2,}", text) if s.strip()]
    pieces: list[str] = []
    for s in found:
        tokens = s.split()
        pieces += [" ".join(tokens[k : k + capacity]) for k in range(0, len(tokens), capacity)] if len(tokens) > capacity else [s]
    size = [len(p.split()) for p in pieces]
    out, first = [], 0
    while first < len(pieces):
        last, total = first, 0
        while last < len(pieces) and (last == first or total + size[last] <= capacity):
            total += size[last]
            last += 1
        out.append(" ".join(pieces[first:last]).strip())
        if last >= len(pieces):
            break
        back, kept = last, 0
        while back - 1 > first and kept + size[back - 1] <= min(overlap, capacity - size[last]):
            back -= 1
            kept += size[back]
        first = back
    return out


def located(full: str, chunk: str) -> tuple[int, int]:
    """Lines of a chunk's first occurrence, from 1; (1, 1) if there is none."""
    at = full.find(chunk)
    if at < 0:
        return 1, 1
    start = full.count("\n", 0, at) + 1
    return start, start + chunk.count("\n")


def code_chunks(text: str, language: str | None, capacity: int, splitter: Splitter = structural) -> list[dict]:
    """Chunks of source with their lines. Blank text and unknown languages have none; a splitter that fails gives way to sentences."""
    if not text.strip() or not language:
        return []
    try:
        parts = splitter(text, language, capacity)
    except Exception:
        parts = sentences(text, capacity, FALLBACK_OVERLAP)
    out = []
    for part in parts:
        start, end = located(text, part)
        out.append({"text": part, "language": language, "chunk_type": "code", "start_line": start, "end_line": end})
    return out


def fallback_chunks(text: str, capacity: int, overlap: int) -> list[dict]:
    """Any text by sentences."""
    if not text.strip():
        return []
    return [{"text": p, "doc_type": "text", "chunk_type": "document", "parser_fallback": True} for p in sentences(text, capacity, overlap)]
