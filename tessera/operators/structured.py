"""JSON and XML chunkers. Order, duplicate keys and exact formatting need Python's own parsers.

A chunk is a dict of metadata with ``text``; a file's chunks come in order.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from dataclasses import dataclass

# Arrays and homogeneous children up to the first number stay whole; beyond, they
# come in groups of the second; an oversized array comes in groups of the third.
SMALL, GROUP, SPLIT_GROUP = 10, 50, 20


@dataclass
class Unit:
    name: str
    content: str
    kind: str = ""
    children: int = 0
    grouped: bool = False


def dumped(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def fill(sizes: list[int], capacity: int) -> list[tuple[int, int, bool]]:
    """Ranges [a, b) of items by greedy packing; one of over 1.5 capacities stands alone (True)."""
    out, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        large = n > 1.5 * capacity
        if first < k and (large or total + n > capacity):
            out.append((first, k, False))
            first, total = k, 0
        if large:
            out.append((k, k + 1, True))
            first, total = k + 1, 0
        else:
            total += n
    return out + ([(first, len(sizes), False)] if first < len(sizes) else [])


def runs(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Ranges by greedy packing, whatever the size of one item."""
    out, first, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > capacity:
            out.append((first, k))
            first, total = k, 0
        total += n
    return out + ([(first, len(sizes))] if first < len(sizes) else [])


def line_count(text: str) -> int:
    return text.count("\n") + 1


def by_lines(text: str, capacity: int, meta: dict) -> list[dict]:
    lines = text.split("\n")
    parts = ["\n".join(lines[a:b]) for a, b in runs([len(x) for x in lines], capacity)]
    return [{**meta, "text": p, "is_partial": True, "start_line": 1, "end_line": line_count(p)} for p in parts]


# ---------------------------------------------------------------- JSON


def json_units(value, raw: str) -> list[Unit]:
    if isinstance(value, dict):
        return [Unit(k, dumped({k: v}), type(v).__name__) for k, v in value.items()]
    if not isinstance(value, list):
        return [Unit("root", raw, type(value).__name__)]
    if len(value) <= SMALL:
        return [Unit("array", dumped(value), "list")]
    return [Unit(f"array_items_{i}_{i + len(part)}", dumped(part), "list") for i in range(0, len(value), GROUP) for part in [value[i : i + GROUP]]]


def json_chunks(raw: str, capacity: int, split_nested: bool = False) -> list[dict]:
    """Chunks of a JSON text. Invalid JSON is one chunk; ``split_nested`` also splits one large key by what it holds."""
    if not raw.strip():
        return []
    base = {"language": "json", "chunk_type": "structured"}
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return [{**base, "text": raw, "json_path": "$"}]
    units = json_units(value, raw)
    out = []
    for a, b, large in fill([len(u.content) for u in units], capacity):
        some = units[a:b]
        out += _json_split(some[0], capacity, base, split_nested) if large else [_json_whole(some, base)]
    return out


def _json_whole(units: list[Unit], base: dict) -> dict:
    merged: dict = {}
    for u in units:
        value = json.loads(u.content)
        if isinstance(value, dict):
            merged.update(value)
    text = dumped(merged) if merged else "\n".join(u.content for u in units)
    names = [u.name for u in units]
    one = units[0]
    meta = {
        **base,
        "text": text,
        "json_path": f"$.{names[0]}" if len(names) == 1 else "$.{" + ",".join(names) + "}",
        "keys": ", ".join(names),
        "json_type": one.kind,
        "is_array": str(one.kind == "list"),
        "is_object": str(one.kind == "dict"),
        "start_line": 1,
        "end_line": line_count(text),
    }
    return {**meta, "json_key": names[0]} if len(names) == 1 else meta


def _json_split(unit: Unit, capacity: int, base: dict, split_nested: bool) -> list[dict]:
    meta = {**base, "json_path": f"$.{unit.name}", "json_key": unit.name, "is_partial": True, "start_line": 1}
    value = json.loads(unit.content)
    if split_nested and isinstance(value, dict) and len(value) == 1:
        value = next(iter(value.values()))
    if isinstance(value, dict) and value:
        entries = list(value.items())
        cuts = runs([len(json.dumps({k: v}, ensure_ascii=False)) for k, v in entries], capacity)
        parts = [(dumped(dict(entries[a:b])), {"chunk_type": "json_split"}) for a, b in cuts]
    elif isinstance(value, list):
        parts = [
            (dumped(part), {"chunk_type": "json_array_split", "array_range": f"{i}-{i + len(part)}"})
            for i in range(0, len(value), SPLIT_GROUP)
            for part in [value[i : i + SPLIT_GROUP]]
        ]
    else:
        lines = {**base, "json_path": f"$.{unit.name}", "chunk_type": "json_split"}
        return by_lines(unit.content, capacity, lines)
    return [{**meta, **extra, "text": text, "end_line": line_count(text)} for text, extra in parts]


# ---------------------------------------------------------------- XML


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def serialised(element: ET.Element) -> str:
    return ET.tostring(element, encoding="unicode", method="xml")


def xml_units(root: ET.Element) -> list[Unit]:
    children = [c for c in root if isinstance(c.tag, str)]
    tags = [local(c.tag) for c in children]
    if len(children) > SMALL and len(set(tags)) == 1:
        cut = [children[i : i + GROUP] for i in range(0, len(children), GROUP)]
        return [Unit(tags[0], "\n".join(map(serialised, part)), children=len(part), grouped=True) for part in cut]
    return [Unit(t, serialised(c), children=len(c)) for t, c in zip(tags, children, strict=True)]


def xml_chunks(raw: str, capacity: int) -> list[dict]:
    """Chunks of an XML text; only the root's children are read. Invalid XML is one chunk."""
    if not raw.strip():
        return []
    base = {"language": "xml", "chunk_type": "structured"}
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return [{**base, "text": raw, "xml_path": "/"}]
    name = local(root.tag)
    base["xml_root"] = name
    units = xml_units(root)
    out = []
    for a, b, large in fill([len(u.content) for u in units], capacity):
        some = units[a:b]
        if large:
            out += _xml_split(some[0], capacity, base)
            continue
        tags = [u.name for u in some]
        same = len(set(tags)) == 1
        text = "\n".join(u.content for u in some)
        out.append(
            {
                **base,
                "text": text,
                "xml_path": f"/{name}/{tags[0]}" if same else f"/{name}/{{{','.join(tags)}}}",
                "xml_tag": tags[0] if same else ",".join(tags),
                "tag_count": len(some),
                "child_count": sum(u.children for u in some),
                "is_grouped": any(u.grouped for u in some),
                "start_line": 1,
                "end_line": line_count(text),
            }
        )
    return out


def _xml_split(unit: Unit, capacity: int, base: dict) -> list[dict]:
    lines = {**base, "xml_path": f"/{base['xml_root']}/{unit.name}", "xml_tag": unit.name, "chunk_type": "xml_split"}
    try:
        children = [c for c in ET.fromstring(unit.content) if isinstance(c.tag, str)]
    except ET.ParseError:
        children = []
    if not children:
        return by_lines(unit.content, capacity, lines)
    texts = [serialised(c) for c in children]
    out = []
    for a, b in runs([len(t) for t in texts], capacity):
        text, tag = "\n".join(texts[a:b]), local(children[a].tag)
        out.append({**lines, "text": text, "xml_path": f"{lines['xml_path']}/{tag}", "xml_tag": tag, "is_partial": True, "start_line": 1, "end_line": line_count(text)})
    return out
