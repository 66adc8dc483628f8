"""Lengths, sides, borders and colours of inline styles."""

from __future__ import annotations

import re

#: Points of a unit, and the basic colours.
POINTS = {"rem": 12, "em": 12, "px": 0.75, "pt": 1, "pc": 12, "cm": 28.35, "mm": 2.835, "in": 72, "%": 0}
COLOURS = {
    "black": "000000", "silver": "c0c0c0", "gray": "808080", "grey": "808080", "white": "ffffff", "maroon": "800000",
    "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000",
    "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff", "transparent": "00000000",
}
_LENGTH = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)(rem|em|px|pt|pc|cm|mm|in|%)?", re.I)
WHITE, BLACK = (1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0)


def number(text: str) -> float | None:
    try:
        return float(text) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", text) else None
    except ValueError:
        return None


def points(value: str | None) -> float | None:
    """A length in points, a bare number taken as pixels; None for what cannot be read."""
    value = (value or "").strip()
    if value == "auto":
        return 0.0
    m = _LENGTH.fullmatch(value)
    return float(m[1]) * POINTS[m[2] or "px"] if m and (m[2] or "px") in POINTS else None


def sides(style: dict, kind: str) -> dict[str, float | None]:
    """top, right, bottom and left of margin or padding, None where nothing readable is set."""
    values = [points(v) for v in style.get(kind, "").split()] or [None]
    top = values[0]
    right = values[1] if len(values) > 1 else top
    found = {"top": top, "right": right, "bottom": values[2] if len(values) > 2 else top, "left": values[3] if len(values) > 3 else right}
    return found | {s: points(style[f"{kind}-{s}"]) for s in found if f"{kind}-{s}" in style}


def visible_border(value: str) -> bool:
    words = value.split()
    if not {"solid", "dashed", "dotted", "double", "groove", "ridge", "inset", "outset"} & set(words):
        return False
    return next((p for w in words if (p := points(w)) is not None), 1) > 0


def framed(style: dict) -> bool:
    """Whether a border closes in all four sides."""
    return all(visible_border(style.get(f"border-{s}", style.get("border", ""))) for s in ("top", "right", "bottom", "left"))


def colour(value: str) -> tuple[float, float, float, float] | None:
    """Red, green, blue and opacity from 0 to 1 of a name, #hex or rgb()."""
    value = value.strip().lower()
    digits = COLOURS.get(value) or (value[1:] if value.startswith("#") else "")
    if digits:
        if not re.fullmatch(r"[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8}", digits):
            return None
        pairs = [c + c for c in digits] if len(digits) < 5 else re.findall("..", digits)
        return tuple([int(p, 16) / 255 for p in pairs] + [1.0] * (4 - len(pairs)))
    m = re.fullmatch(r"rgba?\((.*)\)", value)
    parts = re.findall(r"[0-9.]+%?", m[1]) if m else []
    if len(parts) < 3:
        return None
    read = [number(p.rstrip("%")) for p in parts[:4]]
    if None in read:
        return None
    rgb = [x / 100 if p.endswith("%") else x / 255 for x, p in zip(read[:3], parts, strict=False)]
    alpha = 1.0 if len(parts) < 4 else read[3] / 100 if parts[3].endswith("%") else read[3]
    return (*rgb, alpha)


def first_colour(value: str):
    """The first colour among the words of a background, past a picture's address."""
    words = re.findall(r"#[0-9a-f]+|rgba?\([^)]*\)|[a-z]+", re.sub(r"url\([^)]*\)", "", value)) if "(" in value else value.split()
    return next((c for w in words if (c := colour(w))), None)


def over(front, back):
    """The colour seen where front lies over back."""
    a = front[3]
    return front if a >= 1 else (*(f * a + b * (1 - a) for f, b in zip(front[:3], back[:3], strict=True)), 1.0)


def luminance(c) -> float:
    """Relative luminance, from 0 for black to 1 for white."""
    r, g, b = (x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in c[:3])
    return 0.2126 * r + 0.7152 * g + 0.0722 * b
