"""Grey images as numpy arrays: binarising, finding lines, cutting glyphs.

An image is a (height, width) array of uint8.  After ``binarised`` it is a boolean array in which ink is True.  The work is
done on whole arrays, with integral images, run lengths and a disjoint-set over runs.

Fixed values: the thresholds and merge rules below decide what is recognised, so the numbers in them (92 % of pixels near
black or white, windows of 15 pixels and k = 0.5, lines of 4 rows and gaps of 8, pages over 200 rows, parts of an 200th or a
250th of the height squared, cuts at 1.8 times the median width, lines of 250 pixels, and so on) are those of the survey.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Glyph:
    """A cut-out: place in its line, and ink."""

    x: int
    y: int
    w: int
    h: int
    ink: np.ndarray

    @property
    def right(self) -> int:
        return self.x + self.w

    @property
    def bottom(self) -> int:
        return self.y + self.h


def grey(data: bytes, width: int, height: int, channels: int, order: str = "RGB") -> np.ndarray:
    """Luminance, cut off to whole numbers; one or two channels: the first; an alpha channel is ignored."""
    a = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width, channels)
    if channels < 3:
        return a[:, :, 0].copy()
    r, g, b = (a[:, :, order.index(c)].astype(np.float32) for c in "RGB")
    return (np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b).astype(np.uint8)


def blurred(a: np.ndarray, radius: int = 1) -> np.ndarray:
    """A triangular kernel along each axis, with whole division after each and edges repeated."""
    kernel = np.concatenate([np.arange(1, radius + 2), np.arange(radius, 0, -1)])
    out = a.astype(np.int64)
    for axis in (1, 0):
        wide = np.pad(out, [(radius, radius) if i == axis else (0, 0) for i in range(2)], mode="edge")
        out = sum(k * np.take(wide, np.arange(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel)) // kernel.sum()
    return out.astype(np.uint8)


def otsu_threshold(histogram: np.ndarray) -> int:
    """The first threshold with the largest variance between the classes; 128 if there is none."""
    n, levels = histogram.astype(np.float64), np.arange(256)
    below, total = np.cumsum(n), n.sum()
    mass, whole = np.cumsum(levels * n), (levels * n).sum()
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((below > 0) & (above > 0), below * above * (mass / below - (whole - mass) / above) ** 2, 0)
    return int(between.argmax()) if between.max() > 0 else 128


def sauvola(a: np.ndarray, window: int = 15, k: float = 0.5, r: float = 128.0) -> np.ndarray:
    """Pixels not below the threshold of their window, from integral images with the edges repeated."""
    half = max(1, window // 2)
    wide = np.pad(a.astype(np.float64), half, mode="edge")
    size = 2 * half + 1

    def window_sum(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]

    mean = window_sum(wide) / size**2
    deviation = np.sqrt(np.maximum(window_sum(wide * wide) / size**2 - mean * mean, 0))
    return a >= np.clip(mean * (1 + k * (deviation / r - 1)), 0, 255).astype(np.uint8)


def rotated(a: np.ndarray, radians: float) -> np.ndarray:
    """Turned about the centre, nearest pixel, same size, white outside."""
    if abs(radians) < 1e-4:
        return a
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    cx, cy, c, s = np.float32((w - 1) / 2), np.float32((h - 1) / 2), np.float32(np.cos(radians)), np.float32(np.sin(radians))
    half_up = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    ix, iy = half_up(c * (x - cx) + s * (y - cy) + cx), half_up(-s * (x - cx) + c * (y - cy) + cy)
    inside = (ix >= 0) & (iy >= 0) & (ix < w) & (iy < h)
    return np.where(inside, a[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)], 255).astype(np.uint8)


def deskewed(a: np.ndarray, most_degrees: float = 15.0) -> np.ndarray:
    """Turned by the angle of the dark pixels' main axis, at most so far; left alone below 0.02 radians."""
    y, x = np.nonzero(a < 200)
    if min(a.shape) < 8 or len(x) < 32:
        return a
    dx, dy = x - x.mean(), y - y.mean()
    cross, spread = (dx * dy).sum(), (dx * dx).sum() - (dy * dy).sum()
    if abs(cross) < 1e-6 and abs(spread) < 1e-6:
        return a
    limit = np.radians(most_degrees)
    angle = float(np.clip(0.5 * np.arctan2(2 * cross, spread), -limit, limit))
    return a if abs(angle) < 0.02 else rotated(a, -angle)


def binarised(a: np.ndarray, deskew: bool = False) -> np.ndarray:
    """Ink.  Images that are nearly black and white already are not blurred; where Otsu's threshold leaves next to nothing or
    over half of the pixels bright, the local threshold decides; the rarer colour is ink.  Bright is what lies above Otsu's
    threshold, so that an image of two values keeps both."""
    if not a.size:
        return a > 0
    if ((a < 20) | (a > 235)).mean() <= 0.92:
        a = blurred(a)
    if deskew:
        a = deskewed(a)
    bright = a > otsu_threshold(np.bincount(a.ravel(), minlength=256))
    if not 0.001 <= bright.mean() <= 0.5:
        bright = sauvola(a)
    return ~bright if bright.mean() * 255 > 127 else bright


def runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


Box = tuple[int, int, int, int]


def text_lines(ink: np.ndarray) -> list[Box]:
    """(x, y, w, h) of bands of rows with enough ink, at least 4 rows high and 2 columns wide."""
    rows = ink.sum(axis=1)
    out = []
    for y0, y1 in runs(rows >= max(1, int(rows.max(initial=0)) // 20)):
        if y1 - y0 >= 4:
            x = np.flatnonzero(ink[y0:y1].any(axis=0))
            if len(x) and x[-1] > x[0]:
                out.append((int(x[0]), int(y0), int(x[-1] - x[0] + 1), int(y1 - y0)))
    return out


def merged_lines(lines: list[Box], most_gap: int) -> list[Box]:
    out: list[Box] = []
    for x, y, w, h in lines:
        if out and y - (out[-1][1] + out[-1][3]) <= most_gap:
            px, py, pw, ph = out[-1]
            left = min(px, x)
            out[-1] = (left, py, max(px + pw, x + w) - left, max(py + ph, y + h) - py)
        else:
            out.append((x, y, w, h))
    return out


def page_lines(ink: np.ndarray) -> list[Box]:
    """The lines of a page: near ones joined, and on pages over 200 pixels tall those that got too tall cut again."""
    tall = ink.shape[0] > 200
    lines = merged_lines(text_lines(ink), 8 if tall else max(8, ink.shape[0] // 12))
    if not tall:
        return lines
    out = []
    for x, y, w, h in lines:
        again = text_lines(ink[y : y + h, x : x + w]) if h > max(48, ink.shape[0] // 10) else []
        out += [(x + sx, y + sy, sw, sh) for sx, sy, sw, sh in again] or [(x, y, w, h)]
    return out


def components(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, pixels) of the 4-connected parts: runs of a row are joined with the runs that they touch above."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    every, above = [], []
    for y in range(ink.shape[0]):
        own = []
        k = 0
        for s, e in runs(ink[y]).tolist():
            i = len(parent)
            parent.append(i)
            every.append((s, e, y))
            while k < len(above) and above[k][1] <= s:
                k += 1
            j = k
            while j < len(above) and above[j][0] < e:
                a, b = root(above[j][2]), root(i)
                parent[max(a, b)] = min(a, b)
                j += 1
            own.append((s, e, i))
        above = own
    boxes: dict[int, list[int]] = {}
    for i, (s, e, y) in enumerate(every):
        r = root(i)
        if r in boxes:
            b = boxes[r]
            b[0], b[2], b[3], b[4] = min(b[0], s), max(b[2], e), y + 1, b[4] + e - s
        else:
            boxes[r] = [s, y, e, y + 1, e - s]
    return [(x0, y0, x1 - x0, y1 - y0, n) for x0, y0, x1, y1, n in boxes.values()]


def cut(ink: np.ndarray, x: int, y: int, w: int, h: int) -> Glyph:
    return Glyph(x, y, w, h, ink[y : y + h, x : x + w].copy())


def joined(a: Glyph, b: Glyph) -> Glyph:
    """The two in one box."""
    x, y = min(a.x, b.x), min(a.y, b.y)
    out = np.zeros((max(a.bottom, b.bottom) - y, max(a.right, b.right) - x), bool)
    for g in (a, b):
        out[g.y - y : g.bottom - y, g.x - x : g.right - x] |= g.ink
    return Glyph(x, y, out.shape[1], out.shape[0], out)


def fold(glyphs: list[Glyph], together: Callable[[Glyph, Glyph, int, int], bool]) -> list[Glyph]:
    """Left to right, join each glyph to the one before it, as grown so far, if together(before, glyph, gap, overlap)."""
    out: list[Glyph] = []
    for g in glyphs:
        if out:
            p = out[-1]
            if together(p, g, g.x - p.right, min(p.right, g.right) - max(p.x, g.x)):
                out[-1] = joined(p, g)
                continue
        out.append(g)
    return out


def _upper_median(values) -> int:
    ordered = sorted(values)
    return ordered[len(ordered) // 2]


def _by_columns(ink: np.ndarray) -> list[Glyph]:
    """Runs of columns with ink, as high as the line's ink; narrow ones go if others stay."""
    spans = [(s, e) for s, e in runs(ink.any(axis=0)).tolist() if e - s >= 2]
    if not spans:
        return []
    least = max(6, _upper_median(e - s for s, e in spans) // 2)
    spans = [(s, e) for s, e in spans if e - s >= least] or spans
    rows = np.flatnonzero(ink.any(axis=1))
    return [cut(ink, s, int(rows[0]), e - s, int(rows[-1] - rows[0] + 1)) for s, e in spans]


def _by_parts(ink: np.ndarray) -> list[Glyph]:
    """Connected parts, joined with neighbours that touch or stand above each other."""
    h, w = ink.shape
    found = [cut(ink, x, y, pw, ph) for x, y, pw, ph, n in components(ink) if n >= max(4, h * h // 200) and pw >= 2 and ph >= 4 and pw <= w * 9 // 10]
    found.sort(key=lambda g: (g.y, g.x))

    def near(p: Glyph, g: Glyph, gap: int, overlap: int) -> bool:
        mean_h, mean_w = (p.h + g.h) // 2, (p.w + g.w) // 2
        beside = gap <= max(2, mean_w // 8) and abs(p.y - g.y) <= mean_h // 2
        return beside or overlap > max(1, mean_w // 3) and abs(p.bottom - g.y) <= max(2, mean_h // 4)

    for _ in range(4):
        again = fold(found, near)
        if len(again) == len(found):
            break
        found = again
    return found


def segment(ink: np.ndarray) -> list[Glyph]:
    """Glyphs of a line in a script of separate letters."""
    if not ink.size:
        return []
    found = _by_columns(ink)
    h, w = ink.shape
    alone = h > 60 and len(found) == 1 and found[0].w > w * 6 // 10
    return found if found and not alone else _by_parts(ink)


def _fixed_width(glyphs: list[Glyph]) -> bool:
    if len(glyphs) < 2:
        return True
    width = _upper_median(g.w for g in glyphs)
    gap = _upper_median(b.x - a.right for a, b in zip(glyphs, glyphs[1:], strict=False))
    return width // 4 <= gap <= 2 * width


def _parts(ink: np.ndarray, least_h: int, by_row: bool) -> list[Glyph]:
    h, w = ink.shape
    found = [cut(ink, x, y, pw, ph) for x, y, pw, ph, n in components(ink) if n >= max(4, h * h // 250) and pw >= 2 and ph >= least_h and pw <= w * 9 // 10]
    return sorted(found, key=lambda g: (g.x, g.y) if by_row else g.x)


def headline(ink: np.ndarray) -> tuple[int, int]:
    """First and last row of the band about the densest row of the upper third."""
    h = ink.shape[0]
    top = int(ink[: min(h, max(4, h // 3))].sum(axis=1).argmax())
    return max(0, top - 1), min(h - 1, top + max(2, h // 16))


def segment_indic(ink: np.ndarray) -> list[Glyph]:
    """Glyphs of a line whose letters may hang from a headline: parts joined into syllables, wide ones cut at a thin place."""
    if not ink.size:
        return []
    plain = segment(ink)
    if plain and _fixed_width(plain):
        return plain
    found = _parts(ink, 3, True)
    if not found:
        return []
    top, bottom = headline(ink)
    line_h = max(g.h for g in found)

    def syllable(p: Glyph, g: Glyph, gap: int, overlap: int) -> bool:
        touches = p.y <= bottom and p.bottom > top and g.y <= bottom and g.bottom > top
        hangs = touches and (gap <= max(6, p.w // 3) or overlap > 0)
        mark = (g.h <= max(4, line_h // 4) or g.w <= max(3, g.h // 2)) and (gap <= 4 or overlap > 0) and abs(p.y - g.y) <= max(p.h, g.h)
        return hangs or mark or gap <= max(2, p.w // 8) and abs(p.y - g.y) <= max(p.h, line_h) // 2

    found = fold(found, syllable)
    if len(found) < 2:
        return found
    wide = int(np.floor(1.8 * max(8, _upper_median(g.w for g in found)) + 0.5))
    out = []
    for g in found:
        columns, m = g.ink.sum(axis=0), max(2, g.w // 8)
        if g.w >= wide and g.w > 2 * m:
            at = m + int(columns[m : g.w - m].argmin())
            if columns[at] <= g.h // 3:
                halves = [Glyph(g.x + a, g.y, b - a, g.h, g.ink[:, a:b].copy()) for a, b in ((0, at), (at, g.w)) if b - a >= 3]
                out += halves or [g]
                continue
        out.append(g)
    return out


def segment_arabic(ink: np.ndarray) -> list[Glyph]:
    """Glyphs of a line of joined letters: what touches is joined, short lines are one glyph, else words along the baseline."""
    if not ink.size:
        return []

    def touching(p: Glyph, g: Glyph, gap: int, overlap: int) -> bool:
        return abs(p.y - g.y) <= max(4, (p.h + g.h) // 2 // 2) and (gap <= max(6, p.w // 4) or overlap > 0)

    plain = fold(segment(ink), touching)
    if len(plain) > 1:
        span = max(g.right for g in plain) - min(g.x for g in plain)
        if ink.shape[1] <= 250 or span <= ink.shape[1] * 3 // 4:
            whole = plain[0]
            for g in plain[1:]:
                whole = joined(whole, g)
            plain = [whole]
    if plain and _fixed_width(plain):
        return plain
    found = _parts(ink, 4, False)
    if len(found) < 2:
        return found or plain
    line_h = max(g.h for g in found)
    base, slack = _upper_median(g.bottom - 1 for g in found), max(4, line_h // 6)
    width = max(6, _upper_median(g.w for g in found))
    space = max(width, line_h // 2)

    def word(p: Glyph, g: Glyph, gap: int, overlap: int) -> bool:
        level = abs(p.bottom - 1 - base) <= slack and abs(g.bottom - 1 - base) <= slack
        return level and gap < space and (gap <= max(2, width // 6) or overlap > 0)

    return fold(found, word)


def attach_marks(glyphs: list[Glyph]) -> list[Glyph]:
    """Marks above, below or beside a letter, as in Thai and Lao, become part of it."""
    if len(glyphs) < 2:
        return glyphs
    line_h = max(max(g.bottom for g in glyphs), max(g.h for g in glyphs))

    def mark(p: Glyph, g: Glyph, gap: int, overlap: int) -> bool:
        small = g.h <= max(4, line_h // 3) or g.w <= max(3, g.h // 2)
        return small and (gap <= 4 or overlap > 0) and abs(p.y - g.y) <= max(p.h, g.h)

    return fold(glyphs, mark)


def on_grid(g: Glyph, width: int, height: int) -> np.ndarray:
    """Scaled evenly to fit, nearest pixel, centred."""
    out = np.zeros((height, width), bool)
    if g.w <= 0 or g.h <= 0:
        return out
    scale = min(np.float32(width) / np.float32(g.w), np.float32(height) / np.float32(g.h))
    nw, nh = max(1, int(np.float32(g.w) * scale)), max(1, int(np.float32(g.h) * scale))
    x = np.minimum(g.w - 1, (np.arange(nw, dtype=np.float32) / scale).astype(np.int64))
    y = np.minimum(g.h - 1, (np.arange(nh, dtype=np.float32) / scale).astype(np.int64))
    ox, oy = (width - nw) // 2, (height - nh) // 2
    out[oy : oy + nh, ox : ox + nw] = g.ink[np.ix_(y, x)]
    return out


def holes(ink: np.ndarray) -> int:
    """Parts of the background that don't reach the edge."""
    return min(255, len(components(~np.pad(ink, 1))) - 1)


def _neighbours(ink: np.ndarray) -> np.ndarray:
    """How many of the eight neighbours of each pixel are ink, for a stack of shapes."""
    p = np.pad(ink.astype(np.int8), ((0, 0), (1, 1), (1, 1)))
    rows = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return rows[:, :, :-2] + rows[:, :, 1:-1] + rows[:, :, 2:] - ink


def thinned(ink: np.ndarray, passes: int = 32) -> np.ndarray:
    """A stack of shapes of one size, thinned: in each pass pixels inside the frame go that have fewer than two neighbours, then
    those that have four."""
    out, live = ink.copy(), np.arange(len(ink))
    for _ in range(passes):
        before = thin = out[live]
        for gone in (lambda n: n < 2, lambda n: n == 4):
            drop = gone(_neighbours(thin))
            drop[:, [0, -1]] = drop[:, :, [0, -1]] = False
            thin = thin & ~drop
        out[live] = thin
        live = live[(thin != before).any(axis=(1, 2))]
        if not len(live):
            break
    return out


def ends_and_forks(ink: np.ndarray) -> list[tuple[int, int]]:
    """Of each thinned shape of a stack the pixels with at most one neighbour, and those with three or more."""
    thin = thinned(ink)
    n = np.where(thin, _neighbours(thin), 2)
    return list(zip(np.minimum(255, (n <= 1).sum(axis=(1, 2))).tolist(), np.minimum(255, (n >= 3).sum(axis=(1, 2))).tolist(), strict=True))


def features_of(shapes: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """(holes, ends, forks, width over height of the ink) of shapes of one size; of no ink (0, 0, 0, 1)."""
    if not shapes:
        return []
    out = []
    for ink, (ends, forks) in zip(shapes, ends_and_forks(np.array(shapes)), strict=True):
        y, x = np.nonzero(ink)
        out.append((holes(ink), ends, forks, float(np.float32(x.max() - x.min() + 1) / np.float32(max(y.max() - y.min() + 1, 1)))) if len(x) else (0, 0, 0, 1.0))
    return out


def features(ink: np.ndarray) -> tuple[int, int, int, float]:
    return features_of([ink])[0]
