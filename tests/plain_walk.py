"""Plain recursive flattening of one document, to hold the operators against."""

import json
from typing import Any

from tomegraph.model import STRUCTURAL_TYPES


def cell(x: Any) -> str:
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True) if isinstance(x, (dict, list)) else str(x)


class _Walk:
    def __init__(self, profile: str):
        if profile not in ("shadow", "indexed"):
            raise ValueError(f"no such profile: {profile}")
        self.indexed = profile == "indexed"
        self.nodes: list[dict] = []

    def structural(self, e: Any) -> bool:
        return isinstance(e, dict) and e.get("type") in STRUCTURAL_TYPES and (bool(e.get("id")) or not self.indexed)

    def top(self, entries: list) -> None:
        for i, e in enumerate(entries):
            if self.structural(e):
                self.section(e, [i], [])
            elif self.indexed and isinstance(e, dict):
                self.inside(e.get("entries") or [], None, [i], [])

    def section(self, e: dict, path: list[int], parent: list[int]) -> None:
        page = e.get("page")
        node = {"path": path, "parent_path": parent, "depth": len(path) if not parent else self.depth_of(parent) + 1, "node_id": str(e.get("id") or ""), "title": str(e.get("name") or "Untitled Section"), "type": e["type"], "page": page if isinstance(page, int) else None, "lines": [], "ignored": 0}
        if not parent:
            node["depth"] = 0
        self.nodes.append(node)
        self.inside(e.get("entries") or [], node, path, path)

    def depth_of(self, path: list[int]) -> int:
        return next(n["depth"] for n in reversed(self.nodes) if n["path"] == path)

    def inside(self, entries: list, node: dict | None, path: list[int], owner: list[int]) -> None:
        for i, e in enumerate(entries):
            if self.structural(e):
                self.section(e, [*path, i], owner)
            elif self.indexed and isinstance(e, dict) and isinstance(e.get("entries"), list) and e.get("type") != "quote":
                self.inside(e["entries"], node, [*path, i], owner)
            elif node is not None:
                self.content(e, node)

    def content(self, e: Any, node: dict) -> None:
        put = lambda text, prefix="", tagged=True: node["lines"].append({"prefix": prefix, "text": text, "tagged": tagged}) if text else None
        if isinstance(e, str):
            put(e)
            return
        kind = e.get("type") if isinstance(e, dict) else None
        if kind == "list":
            for item in e.get("items") or []:
                mark, text = "- ", item
                if isinstance(item, dict):
                    if "entry" not in item:
                        continue
                    mark, text = (f"- **{item['name']}**: " if item.get("name") else "- "), item["entry"]
                if isinstance(text, str):
                    put(text, mark) if self.indexed else put(mark + text)
        elif kind == "table":
            if e.get("caption"):
                put(f"**Table: {e['caption']}**", tagged=not self.indexed)
            for row in e.get("rows") or []:
                put(" | ".join(map(cell, row if isinstance(row, list) else [row])), tagged=not self.indexed)
        elif kind == "image":
            put(self.image(e))
        elif kind == "gallery":
            shown = [x for x in map(self.image, e.get("images") or []) if x]
            if shown or self.indexed:
                put("**Gallery:**")
            for x in shown:
                put(x)
        elif kind == "quote":
            for x in e.get("entries") or []:
                if isinstance(x, str):
                    put(f"> {x}")
        else:
            node["ignored"] += 1

    @staticmethod
    def image(e: Any) -> str:
        if not isinstance(e, dict) or not e.get("title"):
            return ""
        return f"[Image ({e['imageType']}): {e['title']}]" if e.get("imageType") else f"[Image: {e['title']}]"


def walk(body: str | None, profile: str = "shadow") -> list[dict]:
    """Sections of one JSON document; none for text that isn't JSON."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return []
    w = _Walk(profile)
    entries = data.get("data") if isinstance(data, dict) else data
    w.top(entries if isinstance(entries, list) else [])
    return w.nodes



def types(x: Any):
    if isinstance(x, dict):
        if isinstance(x.get("type"), str):
            yield x["type"]
        for v in x.values():
            yield from types(v)
    elif isinstance(x, list):
        for v in x:
            yield from types(v)
