"""Blocks and tables of one page from its spans and rule lines, where the page is at hand as a whole.

For readers and pipelines, which have a file in one task. For spans that lie in tables, operators.structure
and operators.tables have the same rules as joins and windows; tests hold one against the other.
"""

from __future__ import annotations

import re
from collections import Counter
from math import floor

from quire.functions.text import MARKER
from quire.operators.lines import fold_lines
from quire.operators.structure import HEADING_RATIO
from quire.operators.tables import MIN_COLS, MIN_GAP, MIN_ROWS, NEAR_BOUNDARY, SLACK, SNAP, cluster_points

_MARKER = re.compile(MARKER)
_BOLD = re.compile("bold|-bd|heavy")


def half_up(x: float) -> int:
    """To the nearest whole number, halves away from zero."""
    return floor(x + 0.5) if x >= 0 else -floor(-x + 0.5)


def lines_of(spans: list[dict]) -> list[dict]:
    """Lines of a page from the top: text, box, spans, size and font of the longest span."""
    out = []
    for i, line in enumerate(fold_lines(sorted(spans, key=lambda s: (s["text"] or "", s["font_name"] or "")))):
        text, before, own = "", None, line["spans"]
        for s in own:
            wide = before is not None and s["x"] - (before["x"] + before["width"]) > (before["font_size"] * 0.25 if before["font_size"] > 0 else 2.0)
            text += (" " if wide else "") + (s["text"] or "")
            before = s
        most = max(range(len(own)), key=lambda j: (len((own[j]["text"] or "").encode()), j))
        out.append({"line_idx": i, "spans": own, "text": text, "box": line["box"], "size": own[most]["font_size"], "font": own[most]["font_name"], "x": own[0]["x"]})
    return out


def given_lines(spans: list[dict]) -> list[dict]:
    """The same of spans that have their line_idx and span_idx, as far as tables need it."""
    lines: dict[int, list[dict]] = {}
    for s in sorted(spans, key=lambda s: (s["line_idx"], s["span_idx"])):
        lines.setdefault(s["line_idx"], []).append(s)
    box = lambda own: (min(s["x"] for s in own), min(s["y"] for s in own), max(s["x"] + s["width"] for s in own), max(s["y"] + s["font_size"] for s in own))
    return [{"line_idx": i, "spans": own, "box": box(own)} for i, own in lines.items()]


def sizes_of(spans: list[dict], ratio: float) -> tuple[float, list[int]]:
    """The body's font size, and the buckets of the sizes of headings, largest first."""
    per: dict[int, list] = {}
    for s in spans:
        said = (s["text"] or "").strip(" ") != ""
        n, lo, hi = per.get(half_up(s["font_size"] * 2), (0, float("inf"), None))
        size = s["font_size"]
        per[half_up(size * 2)] = [n + len(s["text"].encode()) * said if said else n, min(lo, size), max(hi if hi is not None else size, size) if said else hi]
    if not per:
        return 12.0, []
    n, _, body = max((v[0], -b, v[1]) for b, v in per.items())
    body = body if n else 12.0
    return body, sorted((b for b, v in per.items() if v[2] is not None and v[2] >= body * ratio), reverse=True)


def text_blocks(lines: list[dict], spans: list[dict], ratio: float = HEADING_RATIO) -> list[dict]:
    """Headings, list items and paragraphs of a page, as structure.extract() finds them."""
    body, heads = sizes_of(spans, ratio)
    margins = [x["x"] for x in lines if abs(x["size"] - body) < 1]
    margin = max(min(margins), 0.0) if margins else float("inf")
    out: list[dict] = []
    before = None
    for x in lines:
        b = half_up(x["size"] * 2)
        level = min(heads.index(b) + 1, 6) if b in heads else None
        plain = x["text"].strip(" ")
        if level is None and plain and _BOLD.search((x["font"] or "").lower()) and abs(x["size"] - body) < 1 and len(x["text"].encode()) < 100:
            level = min(min(len(heads), 6) + 1, 6)
        kind = "heading" if level is not None else "list_item" if _MARKER.match(x["text"]) else "paragraph"
        indent = half_up(max(x["x"] - margin, 0.0) / 36) if kind == "list_item" else None
        mid = (x["box"][1] + x["box"][3]) / 2
        same = before is not None and before[0] == kind and (kind == "heading" and before[1] == level or kind == "paragraph" and abs(before[2] - mid) <= body * 2)
        before = (kind, level, mid)
        if same:
            last = out[-1]
            last["text"] += " " + x["text"]
            last["box"] = (*(min(p, q) for p, q in zip(last["box"][:2], x["box"][:2])), *(max(p, q) for p, q in zip(last["box"][2:], x["box"][2:])))
        else:
            out.append({"type": kind, "text": x["text"], "level": level, "indent_level": indent, "box": x["box"]})
    return out


def _axis(values: set[float], snap: float) -> list[float]:
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] >= snap:
            out.append(v)
    return out


def ruled(segments: list[tuple[float, float, float, float]], lines: list[dict], snap: float = SNAP, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> list[dict]:
    """Tables (rows of texts, box) between rule lines, as tables.detect() finds them."""
    flat = {((ay + by) / 2, min(ax, bx) - snap, max(ax, bx) + snap) for ax, ay, bx, by in segments if abs(ay - by) < snap}
    up = {((ax + bx) / 2, min(ay, by) - snap, max(ay, by) + snap) for ax, ay, bx, by in segments if abs(ax - bx) < snap}
    points = sorted({(half_up(vx / snap) * snap, half_up(hy / snap) * snap) for hy, h0, h1 in flat for vx, v0, v1 in up if h0 <= vx <= h1 and v0 <= hy <= v1})
    labels = cluster_points(points, snap)
    many = Counter(labels)
    spans = [(s["x"] + s["width"] / 2, s["y"], s["text"]) for x in lines for s in x["spans"]]
    out = []
    for k in dict.fromkeys(labels):
        own = [p for p, q in zip(points, labels) if q == k]
        xs, ys = _axis({p[0] for p in own}, snap), _axis({p[1] for p in own}, snap)
        if many[k] < 4 or len(xs) - 1 < min_cols or len(ys) - 1 < min_rows:
            continue
        rows = []
        for lo, hi in reversed(list(zip(ys, ys[1:]))):
            rows.append([" ".join(t for x, y, t in spans if a <= x <= b and lo <= y <= hi and t is not None).strip(" ") for a, b in zip(xs, xs[1:])])
        out.append({"rows": rows, "box": (xs[0], ys[0], xs[-1], ys[-1]), "xs": xs, "ys": ys})
    return out


def added(values: list[float]) -> float:
    """The sum, one after another and rounded each time, as SQL and the reference add: sum() corrects for rounding."""
    total = 0.0
    for v in values:
        total += v
    return total


def aligned(lines: list[dict], min_gap: float = MIN_GAP, min_rows: int = MIN_ROWS, min_cols: int = MIN_COLS) -> list[dict]:
    """Tables without rules, as tables.detect() finds them."""
    found: list[list[tuple[float, float, str]]] = []
    for x in lines:
        words: list[list] = []
        for s in x["spans"]:
            gap = None if not words else s["x"] - words[-1][1]
            if gap is None or gap > min_gap:
                words.append([s["x"], s["x"] + s["width"], s["text"] or ""])
            else:
                words[-1][1] = s["x"] + s["width"]
                words[-1][2] += (" " if gap > s["font_size"] * 0.25 else "") + (s["text"] or "")
        found.append(words)
    counts = Counter(map(len, found))
    cols = max(counts, key=lambda n: (counts[n], n), default=0)
    if cols < min_cols:
        return []
    edges = sorted((w[0], i) for i, words in enumerate(found) if len(words) == cols for w in words)
    size = len(edges) // cols
    bounds = [added([e for e, _ in edges[c * size : (c + 1) * size]]) / size for c in range(cols)]
    ok = [len(words) >= min_cols and sum(any(abs(w[0] - b) < NEAR_BOUNDARY for b in bounds) for w in words) / len(words) > 0.5 for words in found]
    out, i = [], 0
    while i < len(found):
        j = i
        while j < len(found) and ok[j]:
            j += 1
        if j - i >= min_rows:
            rows = []
            for words in found[i:j]:
                row: list[list[str]] = [[] for _ in bounds]
                for a, b, t in words:
                    row[max((c for c, edge in enumerate(bounds) if (a + b) / 2 >= edge - SLACK), default=0)].append(t)
                rows.append([" ".join(r) for r in row])
            own = [x["box"] for x in lines[i:j]]
            out.append({"rows": rows, "box": (min(b[0] for b in own), min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own))})
        i = max(j, i + 1)
    return out


def page_of(spans: list[dict], segments: list[dict], strategy: str = "auto") -> tuple[str, list[dict]]:
    """(text, blocks) of a page. Tables are blocks with rows; a table stands where its top edge is,
    after blocks as high. Lines inside a table stay blocks too."""
    lines = lines_of(spans)
    found = ruled([(g["ax"], g["ay"], g["bx"], g["by"]) for g in segments], lines) if strategy != "stream" else []
    if strategy == "stream" or strategy == "auto" and not found:
        found = aligned(lines)
    blocks = text_blocks(lines, spans) + [{"type": "table", "text": "", "level": None, "indent_level": None} | t for t in found]
    return "\n".join(x["text"] for x in lines), sorted(blocks, key=lambda b: -b["box"][3])
