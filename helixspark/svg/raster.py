"""A raster subset of SVG in numpy: shapes, paths, transforms, style classes, rectangular clips.

Documents are read as a stream of elements. Text, images, references,
gradients, filters and patterns are left out.
"""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

# Pixels per unit, and the named colours.
UNITS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "pt": 96.0 / 72.0, "pc": 16.0, "q": 96.0 / 101.6}
NAMES = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "gray": (128, 128, 128)}

NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
STEPS = 4  # samples per pixel and side
_SAMPLES = 1 << 21  # held at a time
_READ = 1 << 16  # bytes of a document read at a time
SKIPPED = {"defs", "clipPath", "symbol", "pattern", "mask", "marker", "linearGradient", "radialGradient", "filter", "metadata", "title", "desc", "style"}


@dataclass(frozen=True)
class Style:
    fill: tuple[int, int, int] | None = (0, 0, 0)
    stroke: tuple[int, int, int] | None = None
    fill_opacity: float = 1.0
    stroke_opacity: float = 1.0
    stroke_width: float = 1.0
    opacity: float = 1.0
    shown: bool = True
    clip: np.ndarray | None = field(default=None, compare=False)
    matrix: np.ndarray = field(default_factory=lambda: np.eye(3), compare=False)


def length(text: str | None, default: float = 0.0) -> float:
    m = NUMBER.match(text.strip()) if text else None
    return float(m.group()) * UNITS.get(text.strip()[m.end() :].strip().lower(), 1.0) if m else default


def colour(text: str) -> tuple[int, int, int] | None:
    text = text.strip().lower()
    if text.startswith("#"):
        h = text[1:]
        h = "".join(c * 2 for c in h) if len(h) == 3 else h[-6:] if len(h) == 8 else h
        return tuple(int(h[k : k + 2], 16) for k in (0, 2, 4)) if re.fullmatch("[0-9a-f]{6}", h) else None
    if text.startswith("rgb"):
        parts = NUMBER.findall(text)
        return tuple(min(max(round(float(x)), 0), 255) for x in parts[:3]) if len(parts) >= 3 else None
    return NAMES.get(text)


def transform(text: str | None) -> np.ndarray:
    out = np.eye(3)
    for name, body in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in NUMBER.findall(body)]
        m = np.eye(3)
        if name == "matrix" and len(v) == 6:
            m[:2] = [[v[0], v[2], v[4]], [v[1], v[3], v[5]]]
        elif name == "translate" and v:
            m[0, 2], m[1, 2] = v[0], v[1] if len(v) > 1 else 0.0
        elif name == "scale" and v:
            m[0, 0], m[1, 1] = v[0], v[1] if len(v) > 1 else v[0]
        elif name == "rotate" and v:
            c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            x, y = (v[1], v[2]) if len(v) > 2 else (0.0, 0.0)
            m[:2] = [[c, -s, x - c * x + s * y], [s, c, y - s * x - c * y]]
        elif name in ("skewX", "skewY") and v:
            m[(0, 1) if name == "skewX" else (1, 0)] = math.tan(math.radians(v[0]))
        out = out @ m
    return out


def _curve(points: list[tuple[float, float]], n: int = 16) -> list[tuple[float, float]]:
    """Points after the first of a Bezier curve of any degree."""
    p = np.array(points)
    t = np.linspace(0, 1, n + 1)[1:, None]
    k = len(p) - 1
    out = sum(math.comb(k, i) * (1 - t) ** (k - i) * t**i * p[i] for i in range(k + 1))
    return [tuple(x) for x in out]


def path_lines(d: str) -> list[tuple[np.ndarray, bool]]:
    """Polylines of path data, with whether each is closed. Arcs become straight lines."""
    tokens = re.findall(r"[MmLlHhVvCcSsQqTtAaZz]|" + NUMBER.pattern, d or "")
    need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
    lines: list[tuple[np.ndarray, bool]] = []
    now: list[tuple[float, float]] = []
    x = y = 0.0
    bend: tuple[str, float, float] = ("", 0.0, 0.0)
    command, at = "", 0

    def end(closed: bool) -> None:
        if len(now) > 1:
            lines.append((np.array(now), closed))

    while at < len(tokens):
        if tokens[at].isalpha():
            command = tokens[at]
            at += 1
        elif command in ("", "Z", "z"):
            raise ValueError("path data has a number without a command")
        kind, rel = command.upper(), command.islower()
        n = need[kind]
        args = tokens[at : at + n]
        if len(args) < n or any(a.isalpha() for a in args):
            raise ValueError("path data ends inside a command")
        v = [float(a) for a in args]
        at += n
        ox, oy = (x, y) if rel else (0.0, 0.0)
        if kind == "Z":
            end(True)
            if now:
                x, y = now[0]
            now = [(x, y)]
        elif kind == "M":
            end(False)
            x, y = v[0] + ox, v[1] + oy
            now, command = [(x, y)], "l" if rel else "L"
        elif kind in "LHVA":
            x, y = {"L": lambda: (v[0] + ox, v[1] + oy), "H": lambda: (v[0] + ox, y), "V": lambda: (x, v[0] + oy), "A": lambda: (v[5] + ox, v[6] + oy)}[kind]()
            now.append((x, y))
        else:
            pts = [(v[k] + ox, v[k + 1] + oy) for k in range(0, n, 2)]
            if kind in "ST":
                same = bend[0] and bend[0] in ("CS" if kind == "S" else "QT")
                pts.insert(0, (2 * x - bend[1], 2 * y - bend[2]) if same else (x, y))
            now += _curve([(x, y), *pts])
            bend = (kind, *pts[-2])
            x, y = pts[-1]
            continue
        bend = ("", 0.0, 0.0)
    end(False)
    return lines


def shape_lines(tag: str, a: dict[str, str]) -> list[tuple[np.ndarray, bool]]:
    if tag == "rect":
        x, y, w, h = (length(a.get(k)) for k in ("x", "y", "width", "height"))
        return [(np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), True)] if w > 0 and h > 0 else []
    if tag in ("circle", "ellipse"):
        rx, ry = (length(a.get("r")),) * 2 if tag == "circle" else (length(a.get("rx")), length(a.get("ry")))
        t = np.linspace(0, 2 * np.pi, 73)[:-1]
        return [(np.stack([length(a.get("cx")) + rx * np.cos(t), length(a.get("cy")) + ry * np.sin(t)], axis=1), True)] if rx > 0 and ry > 0 else []
    if tag == "line":
        return [(np.array([(length(a.get("x1")), length(a.get("y1"))), (length(a.get("x2")), length(a.get("y2")))]), False)]
    if tag in ("polyline", "polygon"):
        v = [float(x) for x in NUMBER.findall(a.get("points", ""))]
        p = np.array(v[: len(v) // 2 * 2]).reshape(-1, 2)
        return [(p, tag == "polygon")] if len(p) > 1 else []
    return path_lines(a.get("d", "")) if tag == "path" else []


def stroke_lines(lines: list[tuple[np.ndarray, bool]], width: float) -> list[np.ndarray]:
    """A quadrilateral for each segment, and an octagon at each inner corner."""
    out = []
    turn = np.linspace(0, 2 * np.pi, 9)[:-1]
    ring = np.stack([np.cos(turn), np.sin(turn)], axis=1) * width / 2
    for points, closed in lines:
        p = np.concatenate([points, points[:1]]) if closed else points
        for a, b in zip(p[:-1], p[1:], strict=True):
            d = b - a
            size = float(np.hypot(*d))
            if size > 0:
                n = np.array([-d[1], d[0]]) / size * width / 2
                out.append(np.array([a + n, b + n, b - n, a - n]))
        out += [c + ring for c in (p[:-1] if closed else p[1:-1])] if width > 1.5 else []
    return out


def coverage(polygons: list[np.ndarray], height: int, width: int) -> tuple[int, np.ndarray]:
    """Share of each pixel inside the polygons, by the non-zero rule on a sample grid: the first row that they reach, and all rows from it on that they may reach."""
    edges = [np.concatenate([p, np.concatenate([p[1:], p[:1]])], axis=1) for p in polygons if len(p) > 2]
    e = np.concatenate(edges) * STEPS if edges else np.zeros((0, 4))
    e = e[e[:, 1] != e[:, 3]]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    if not len(e):
        return 0, np.zeros((0, width), dtype=np.float32)
    first, last = max(math.floor(low.min() / STEPS), 0), min(math.ceil(high.max() / STEPS), height)
    out = np.zeros((max(last - first, 0), width), dtype=np.float32)
    # An edge meets the sample lines from ``begin`` to before ``end``; line k lies at k + 0.5.
    begin, end = (np.minimum(np.maximum(np.ceil(y - 0.5), first * STEPS), last * STEPS).astype(np.int64) for y in (low, high))
    turn, wide = np.where(e[:, 3] > e[:, 1], 1, -1).astype(np.int32), width * STEPS
    x0, y0, slope, rise = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    step = max(1, _SAMPLES // (wide * STEPS))
    for top in range(first, last, step):
        rows = min(step, last - top)
        start = np.maximum(begin, top * STEPS)
        count = np.maximum(np.minimum(end, (top + rows) * STEPS) - start, 0)
        wind = np.zeros(rows * STEPS * (wide + 1), dtype=np.int32)
        for part in _bounded(count):
            n = count[part]
            own = part.start + np.repeat(np.arange(len(n)), n)
            line = np.arange(len(own)) + np.repeat(start[part] - np.cumsum(n) + n, n)
            x = x0[own] + (line + 0.5 - y0[own]) * slope[own] / rise[own]
            at = np.fmin(np.fmax(np.ceil(x - 0.5), 0), wide).astype(np.int64)
            np.add.at(wind, (line - top * STEPS) * (wide + 1) + at, turn[own])
        inside = np.cumsum(wind.reshape(rows * STEPS, wide + 1)[:, :-1], axis=1, dtype=np.int32) != 0
        out[top - first : top - first + rows] = inside.reshape(rows, STEPS, width, STEPS).sum(axis=(1, 3)) / np.float32(STEPS * STEPS)
    return first, out


def _bounded(count: np.ndarray) -> list[slice]:
    """Runs of edges that meet ``_SAMPLES`` lines or so together, so that any number of edges takes bounded memory."""
    total = np.cumsum(count)
    if total[-1] <= _SAMPLES:
        return [slice(0, len(count))]
    cuts = np.searchsorted(total, np.arange(_SAMPLES, int(total[-1]), _SAMPLES)) + 1
    ends = np.unique(np.concatenate(([0], cuts, [len(count)])))
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _declarations(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in text.split(";")) if v}


def class_rules(css: str) -> dict[str, dict[str, str]]:
    """Declarations of each class; later rules win."""
    out: dict[str, dict[str, str]] = {}
    for names, body in re.findall(r"([^{}]+)\{([^}]*)\}", re.sub(r"(?s)/\*.*?\*/", "", css)):
        for name in names.split(","):
            if name.strip().startswith("."):
                out.setdefault(name.strip()[1:], {}).update(_declarations(body))
    return out


def _styled(base: Style, own: dict[str, str]) -> Style:
    change: dict = {}
    for key, name in (("fill", "fill"), ("stroke", "stroke")):
        if key in own:
            change[name] = colour(own[key])
    for key in ("fill-opacity", "stroke-opacity", "stroke-width"):
        if key in own:
            change[key.replace("-", "_")] = length(own[key], 1.0)
    if "opacity" in own:
        change["opacity"] = base.opacity * length(own["opacity"], 1.0)
    if own.get("display") == "none":
        change["shown"] = False
    return replace(base, **change)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(content: bytes) -> Iterator[tuple[str, ET.Element]]:
    """Starts and ends of elements as they are read; raises where the document is not well-formed."""
    parser = ET.XMLPullParser(("start", "end"))
    for at in range(0, len(content), _READ):
        parser.feed(content[at : at + _READ])
        yield from parser.read_events()
    parser.close()
    yield from parser.read_events()


@dataclass(frozen=True)
class Head:
    """What must be known of a document before it is drawn."""

    width: float
    height: float
    root: dict[str, str]
    rules: dict[str, dict[str, str]]
    clips: dict[str, list[tuple[np.ndarray, bool]]]


def head_of(content: bytes, default: tuple[float, float] | None = None) -> Head:
    """Size in pixels of a well-formed document, its root's attributes, style classes and clips. Without sizes the view box counts, then ``default``."""
    root, rules, clips, clip_id = None, {}, {}, None
    for event, e in _events(content):
        tag = _local(e.tag)
        if root is None:
            root, kind = dict(e.attrib), tag
        if tag == "style" and event == "end":
            rules = class_rules(e.text or "")
        elif tag == "clipPath":
            clip_id = e.get("id") if event == "start" else None
        elif tag == "rect" and clip_id and event == "start":
            clips.setdefault(clip_id, []).extend(shape_lines("rect", dict(e.attrib)))
        if event == "end":
            e.clear()
    if root is None or kind != "svg":
        raise ValueError("no svg element")
    box = [float(x) for x in NUMBER.findall(root.get("viewBox", ""))]
    w, h = length(root.get("width")), length(root.get("height"))
    w = w or (box[2] if len(box) == 4 else 0.0)
    h = h or (box[3] if len(box) == 4 else 0.0)
    if (w <= 0 or h <= 0) and default:
        w, h = w if w > 0 else default[0], h if h > 0 else default[1]
    if w <= 0 or h <= 0:
        raise ValueError("no size")
    return Head(w, h, root, rules, clips)


def render(content: bytes, width: int, height: int, sx: float, sy: float, background: tuple[int, int, int, int], head: Head | None = None) -> np.ndarray:
    """Straight-alpha RGBA pixels of a document; ``head`` is its ``head_of`` where that is at hand."""
    canvas = np.empty((height, width, 4), dtype=np.float64)
    canvas[...] = [*(x / 255 * (background[3] / 255) for x in background[:3]), background[3] / 255]
    head = head or head_of(content, (float(width), float(height)))
    rules, clips = head.rules, head.clips
    start = np.diag([sx, sy, 1.0])
    stack: list[Style] = []
    hidden = 0
    for event, e in _events(content):
        tag = _local(e.tag)
        if event == "end":
            stack.pop()
            hidden -= tag in SKIPPED
            e.clear()
            continue
        base = stack[-1] if stack else Style(matrix=start)
        if not stack:
            box = [float(x) for x in NUMBER.findall(e.get("viewBox", ""))]
            if len(box) == 4 and box[2] > 0 and box[3] > 0:
                w, h = length(e.get("width")) or box[2], length(e.get("height")) or box[3]
                base = replace(base, matrix=start @ np.array([[w / box[2], 0, -box[0] * w / box[2]], [0, h / box[3], -box[1] * h / box[3]], [0, 0, 1]]))
        own: dict[str, str] = {}
        for name in e.get("class", "").split():
            own |= rules.get(name, {})
        own |= {k: v for k, v in e.attrib.items() if k in ("fill", "stroke", "fill-opacity", "stroke-opacity", "stroke-width", "opacity", "display", "clip-path")}
        own |= _declarations(e.get("style", ""))
        style = _styled(base, own)
        style = replace(style, matrix=base.matrix @ transform(e.get("transform")))
        link = re.search(r"url\(#([^)]+)\)", own.get("clip-path", ""))
        if link and link[1] in clips:
            mask = np.zeros((height, width), dtype=np.float32)
            first, rows = coverage([_moved(p, style.matrix) for p, _ in clips[link[1]]], height, width)
            mask[first : first + len(rows)] = rows
            style = replace(style, clip=mask if style.clip is None else mask * style.clip)
        stack.append(style)
        hidden += tag in SKIPPED
        if hidden or not style.shown:
            continue
        lines = shape_lines(tag, dict(e.attrib))
        if lines and style.fill and tag != "line":
            _paint(canvas, [_moved(p, style.matrix) for p, _ in lines], style, style.fill, style.fill_opacity)
        if lines and style.stroke and style.stroke_width > 0:
            _paint(canvas, [_moved(p, style.matrix) for p in stroke_lines(lines, style.stroke_width)], style, style.stroke, style.stroke_opacity)
    alpha = canvas[..., 3:]
    if not (alpha == 1).all():
        canvas[..., :3] = np.where(alpha > 0, canvas[..., :3] / np.maximum(alpha, 1e-9), 0)
    canvas *= 255
    np.rint(canvas, out=canvas)
    return np.minimum(np.maximum(canvas, 0, out=canvas), 255, out=canvas).astype(np.uint8)


def _moved(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return points @ matrix[:2, :2].T + matrix[:2, 2]


def _paint(canvas: np.ndarray, polygons: list[np.ndarray], style: Style, rgb: tuple[int, int, int], opacity: float) -> None:
    # Polygons of one stroke may turn either way; all count as inside.
    turned = [p if rgb is style.fill or np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]) >= 0 else p[::-1] for p in polygons]
    first, a = coverage(turned, *canvas.shape[:2])
    here = slice(first, first + len(a))
    a = a * min(max(opacity * style.opacity, 0.0), 1.0)
    if style.clip is not None:
        a = a * style.clip[here]
    a = a[..., None]
    canvas[here] *= 1 - a
    canvas[here] += a * np.array([*(x / 255 for x in rgb), 1.0])
