"""Text from images of text by comparing glyphs with prototypes.

A page goes through one narrow Arrow stage: binarise, find lines, cut glyphs, choose each line's script, compare with the
prototypes of its pack (and of the others where it is unsure), calibrate, and put the text together.  Prototypes are a
broadcast of well under a megabyte whatever the corpus; a batch of glyphs is compared with a pack by one matrix product, and
a glyph's grid and features are made once for each of the four grid sizes that packs have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import font, pixels, registry

UNKNOWN = ord("?")
#: Lines are routed by so many of their first glyphs.
SAMPLE = 5


@dataclass
class Pack:
    """Prototypes of a script, and how scores are made from them."""

    id: str
    grid_w: int
    grid_h: int
    threshold: float
    weights: tuple[float, float, float]
    calibration: tuple[float, float] = (1.0, 0.0)
    rtl: bool = False
    points: list[int] = field(default_factory=list)
    shapes: list[tuple[int, int, int, float]] = field(default_factory=list)
    bitmaps: list[np.ndarray] = field(default_factory=list)
    looks: set[bytes] = field(default_factory=set)

    def add(self, cp: int, ink: np.ndarray, shape: tuple | None = None) -> None:
        """A prototype; one that looks like an earlier one is left out."""
        if (look := ink.tobytes()) not in self.looks:
            self.looks.add(look)
            self.points.append(cp)
            self.bitmaps.append(ink)
            self.shapes.append(shape or pixels.features(ink))

    def ready(self) -> Pack:
        """Prototypes by code point, so that of equal scores the lowest code point wins."""
        order = sorted(range(len(self.points)), key=lambda i: (self.points[i], i))
        self.cp = np.array([self.points[i] for i in order], np.int64)
        self.flat = np.array([self.bitmaps[i].ravel() for i in order], np.float32).reshape(len(order), -1)
        self.size = self.flat.sum(axis=1)
        self.shape = np.array([self.shapes[i] for i in order], np.float64).reshape(len(order), 4)
        return self

    def match(self, flat: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code point or ?, score, overlap, likeness of structure) of the best prototype for each glyph."""
        both = flat @ self.flat.T
        either = flat.sum(axis=1)[:, None] + self.size - both
        overlap = np.divide(both, either, out=np.zeros_like(both), where=either > 0).astype(np.float64)
        off = np.abs(shape[:, None, :] - self.shape)
        like = np.maximum(0, 1 - 0.25 * (off[:, :, 0] / 4 + off[:, :, 1] / 8 + off[:, :, 2] / 8 + off[:, :, 3] / 2))
        if self.weights[1] <= 0:  # then features aren't made, and the aspect is 1
            like = np.maximum(0, 1 - 0.25 * np.abs(self.shape @ np.array([0.25, 0.125, 0.125, 0.5])))[None].repeat(len(flat), 0)
        score = self.weights[0] * overlap + self.weights[1] * like + self.weights[2] * np.maximum(0, 1 - off[:, :, 3])
        best = score.argmax(axis=1)
        row = np.arange(len(flat))
        top = score[row, best]
        return np.where(top < self.threshold, UNKNOWN, self.cp[best]), top, overlap[row, best], like[row, best]


def pack(pack_id: str) -> Pack:
    """A pack of the registry, without prototypes."""
    _, w, h, threshold, a, b, c, x, y, rtl = next(p for p in registry.PACKS if p[0] == pack_id)
    return Pack(pack_id, w, h, threshold, (a, b, c), (x, y), rtl)


def latin_pack() -> Pack:
    """ASCII in the terminal font, each character's whole cell."""
    out = pack("latin")
    for i, cell in enumerate(font.CELLS):
        if cell.any():
            out.add(32 + i, np.kron(cell, np.ones((4, 4), bool)))
    return out.ready()


def drawn_pack(spark: SparkSession, pack_id: str, paths: str | list[str] | None = None, ligatures: bool = True) -> Pack | None:
    """A pack with the letters of a script as installed fonts draw them, those of the first font first; none if there is no
    font, or none has the letters.  Letters that look alike in two fonts, or alike to another, count once."""
    paths = [paths] if isinstance(paths, str) else paths or [p for p in [font.find_font()] if p]
    out = pack(pack_id)
    ranges = next(x[4] for x in registry.LANGUAGES if x[0] == registry.LANGUAGE_OF_PACK[pack_id])
    letters = [cp for lo, hi in ranges for cp in range(lo, hi + 1) if unicodedata.category(chr(cp))[0] == "L"]
    if pack_id == "arabic" and ligatures:
        letters += sorted({x[2] for x in registry.LIGATURES})
    for path in paths:
        made = font.JvmFont(spark, path)
        known = [cp for cp in letters if made.has(chr(cp))]
        for lo in range(0, len(known), 64):
            for cp, page in zip(known[lo : lo + 64], made.draw_all([chr(cp) for cp in known[lo : lo + 64]]), strict=True):
                ink = pixels.binarised(page)
                y, x = np.nonzero(ink)
                if len(x):
                    g = pixels.cut(ink, int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1))
                    out.add(cp, pixels.on_grid(g, out.grid_w, out.grid_h))
    return out.ready() if out.points else None


def packs_from(prototypes: DataFrame) -> list[Pack]:
    """Packs from rows as the pack source gives them; the registry adds calibration and direction."""
    out: dict[str, Pack] = {}
    for r in prototypes.orderBy("pack_id", "proto_no").collect():  # prototypes: at most a few thousand small rows
        known = {p[0]: p for p in registry.PACKS}.get(r["pack_id"])
        p = out.setdefault(r["pack_id"], Pack(r["pack_id"], r["grid_w"], r["grid_h"], r["threshold"], (r["w_ncc"], r["w_struct"], r["w_aspect"]), known[7:9] if known else (1.0, 0.0), bool(known and known[9])))
        p.add(r["codepoint"], (np.frombuffer(r["bitmap"], np.uint8) > 127).reshape(p.grid_h, p.grid_w), (r["holes"], r["endpoints"], r["junctions"], r["aspect"]))
    order = [p[0] for p in registry.PACKS]
    return [p.ready() for p in sorted(out.values(), key=lambda p: (order.index(p.id) if p.id in order else len(order), p.id))]


class Recogniser:
    """Packs in the order in which scripts are tried."""

    def __init__(self, packs: list[Pack], mixed: bool = True, reverse_rtl: bool = False, deskew: bool = False):
        self.packs = {p.id: p for p in packs}
        self.mixed, self.reverse_rtl, self.deskew = mixed, reverse_rtl, deskew
        self.met: dict = {}

    def _prepared(self, glyphs: list[pixels.Glyph], made: dict, p: Pack) -> tuple[np.ndarray, np.ndarray]:
        key = (p.grid_w, p.grid_h)
        if key not in made:
            grids = [pixels.on_grid(g, *key) for g in glyphs]
            made[key] = (np.array([g.ravel() for g in grids], np.float32).reshape(len(grids), -1), self._features(grids))
        return made[key]

    def _features(self, grids: list[np.ndarray]) -> np.ndarray:
        """Features of glyphs; those of a shape that was met before are looked up."""
        names = [(g.shape, g.tobytes()) for g in grids]
        new = {n: g for n, g in zip(names, grids, strict=True) if n not in self.met}
        if new:
            if len(self.met) > 50_000:
                self.met.clear()
                new = dict(zip(names, grids, strict=True))
            self.met.update(zip(new, pixels.features_of(list(new.values())), strict=True))
        return np.array([self.met[n] for n in names], np.float64).reshape(len(grids), 4)

    def scores(self, glyphs: list[pixels.Glyph]) -> dict[str, np.ndarray]:
        """The best score of each glyph in each pack."""
        made: dict = {}
        return {p.id: p.match(*self._prepared(glyphs, made, p))[1] for p in self.packs.values()}

    def route(self, ink: np.ndarray, hint: str | None = None) -> str:
        """The pack of a line."""
        if hint:
            return hint
        glyphs = (pixels.segment_indic(ink) or pixels.segment(ink))[:SAMPLE]
        if not glyphs:
            return "latin"
        mean = {k: float(v.mean()) for k, v in self.scores(glyphs).items()}
        latin = mean.pop("latin", -1.0)
        best = max(mean, key=mean.get, default=None)
        if best is not None and mean[best] >= 0.20 and mean[best] > latin + 0.10:
            return best
        return "latin" if latin >= 0.15 else best or "cyrillic"

    def line(self, ink: np.ndarray, hint: str | None = None) -> list[dict]:
        """The glyphs of a line, recognised."""
        chosen = self.route(ink, hint)
        glyphs = pixels.segment(ink)
        if chosen in registry.INDIC_PACKS:
            glyphs = pixels.segment_indic(ink) or glyphs
        elif chosen == "arabic":
            glyphs = pixels.segment_arabic(ink) or glyphs
        if chosen in ("thai", "lao"):
            glyphs = pixels.attach_marks(glyphs)
        own = self.packs.get(chosen)
        if own is None:
            raise LookupError(f"no pack {chosen}")
        if self.reverse_rtl and own.rtl:
            glyphs = glyphs[::-1]
        out = self._recognised(glyphs, own)
        return merge_ligatures(out) if chosen == "arabic" else out

    def _recognised(self, glyphs: list[pixels.Glyph], own: Pack) -> list[dict]:
        if not glyphs:
            return []
        made: dict = {}
        cp, score, overlap, like = own.match(*self._prepared(glyphs, made, own))
        who = np.full(len(glyphs), own.id, object)
        unsure = np.flatnonzero(score < own.threshold) if self.mixed else []
        if len(unsure):
            best = np.zeros(len(unsure))
            for p in self.packs.values():
                if p.id != own.id:
                    flat, shape = self._prepared(glyphs, made, p)
                    other = p.match(flat[unsure], shape[unsure])
                    better = (other[1] > best) & (other[1] > score[unsure])
                    best = np.maximum(best, other[1])
                    at = unsure[better]
                    for mine, theirs in zip((cp, score, overlap, like), other, strict=True):
                        mine[at] = theirs[better]
                    who[at] = p.id
        out = []
        for i, g in enumerate(glyphs):
            row = {"x": g.x, "y": g.y, "w": g.w, "h": g.h, "codepoint": int(cp[i]), "raw": float(score[i]), "ncc_score": float(overlap[i]), "struct_score": float(like[i]), "pack_id": str(who[i])}
            if g.w > 120 and g.w > 2 * g.h:  # not a letter
                row |= {"codepoint": 0, "raw": 0.0, "confidence": 0.0, "ncc_score": 0.0, "struct_score": 0.0, "pack_id": own.id}
            else:
                a, b = self.packs[row["pack_id"]].calibration
                row["confidence"] = min(1.0, max(0.0, a * row["raw"] + b))
            out.append(row)
        return out

    def page(self, image: np.ndarray, hint: str | None = None) -> list[dict]:
        """The glyphs of a page, with line_no and glyph_no; boxes are relative to the line, page_x and page_y are not."""
        ink = pixels.binarised(image, self.deskew)
        out = []
        for k, (x, y, w, h) in enumerate(pixels.page_lines(ink)):
            out += [g | {"line_no": k, "glyph_no": i, "page_x": x + g["x"], "page_y": y + g["y"]} for i, g in enumerate(self.line(ink[y : y + h, x : x + w], hint))]
        return out or [g | {"line_no": 0, "glyph_no": i, "page_x": g["x"], "page_y": g["y"]} for i, g in enumerate(self.line(ink, hint))]


def merge_ligatures(glyphs: list[dict]) -> list[dict]:
    """Pairs that form a ligature become one glyph, from left to right; a merged glyph pairs no more."""
    known = {(a, b): c for a, b, c in registry.LIGATURES}
    out, i = [], 0
    while i < len(glyphs):
        g = glyphs[i]
        if i + 1 < len(glyphs) and (c := known.get((g["codepoint"], glyphs[i + 1]["codepoint"]))):
            n = glyphs[i + 1]
            x, y = min(g["x"], n["x"]), min(g["y"], n["y"])
            g = g | {"x": x, "y": y, "w": max(g["x"] + g["w"], n["x"] + n["w"]) - x, "h": max(g["y"] + g["h"], n["y"] + n["h"]) - y, "codepoint": c, "confidence": max(g["confidence"], n["confidence"])}
            i += 1
        out.append(g)
        i += 1
    return out


def spelt(glyphs: list[dict]) -> str:
    """The text of a page's glyphs: a space where the gap is wider than the narrower of two, and wider than 4."""
    out, last = "", None
    for g in glyphs:
        if last is not None and g["x"] - (last["x"] + last["w"]) > max(min(last["w"], g["w"]), 4):
            out += " "
        if g["codepoint"] not in (0, UNKNOWN):
            out += chr(g["codepoint"])
        last = g
    return out


_GLYPH = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("line_no", "glyph_no", "x", "y", "w", "h", "page_x", "page_y", "codepoint")), *((c, pa.float64()) for c in ("raw", "confidence", "ncc_score", "struct_score")), ("pack_id", pa.string())])
GLYPH_SCHEMA = "image_id long, line_no int, glyph_no int, x int, y int, w int, h int, page_x int, page_y int, codepoint int, raw double, confidence double, ncc_score double, struct_score double, pack_id string"
_PAGE = pa.schema([("image_id", pa.int64()), ("ocr_text", pa.string()), ("mean_confidence", pa.float64()), ("glyph_count", pa.int32()), ("error", pa.string()), ("code", pa.int32())])
PAGE_SCHEMA = "image_id long, ocr_text string, mean_confidence double, glyph_count int, error string, code int"


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray | str, str | None]]:
    for b in batches:
        for key, w, h, data, hint in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height", "pixels", "pack_hint")), strict=True):
            if data is None or not w or not h or w <= 0 or h <= 0 or len(data) < w * h:
                yield key, "no image", hint
            else:
                yield key, np.frombuffer(data, np.uint8)[: w * h].reshape(h, w), hint


def _prepared(images: DataFrame) -> DataFrame:
    hint = F.col("pack_hint") if "pack_hint" in images.columns else F.lit(None)
    return images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels", hint.cast("string").alias("pack_hint"))


def read_glyphs(images: DataFrame, packs: list[Pack], **options) -> DataFrame:
    """A row per glyph of grey images (image_id, width, height, pixels, and if there is one pack_hint)."""
    shared = images.sparkSession.sparkContext.broadcast(Recogniser(packs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, image, hint in _images(batches):
            if isinstance(image, str):
                continue
            try:
                rows = [g | {"image_id": key} for g in shared.value.page(image, hint)]
            except LookupError:
                continue
            yield pa.RecordBatch.from_pylist(rows, _GLYPH)

    return _prepared(images).mapInArrow(run, GLYPH_SCHEMA)


def read_text(images: DataFrame, packs: list[Pack], keep: tuple[str, ...] = (), **options) -> DataFrame:
    """image_id, ocr_text, mean_confidence, glyph_count, error, code: one row per image, also of one that can't be read; with
    the columns of ``keep`` carried along.  What an image source says (``error``, ``code``) is passed on."""
    shared = images.sparkSession.sparkContext.broadcast(Recogniser(packs, **options))
    hint = F.col("pack_hint") if "pack_hint" in images.columns else F.lit(None)
    said = [F.col(c).alias(f"source_{c}") if c in images.columns else F.lit(None).cast(kind).alias(f"source_{c}") for c, kind in (("error", "string"), ("code", "int"))]
    rows = images.select(*keep, *said, F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels", hint.cast("string").alias("pack_hint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, made = b.slice(lo, 256), []
                said = zip(part.column("source_error").to_pylist(), part.column("source_code").to_pylist(), strict=True)
                for (key, image, pack_hint), (error, code) in zip(_images(iter([part])), said, strict=True):
                    row = {"image_id": key, "ocr_text": "", "mean_confidence": 0.0, "glyph_count": 0, "error": None, "code": registry.OK}
                    if isinstance(image, str):
                        row |= {"error": error or image, "code": registry.NOTHING if code is None else code}
                    else:
                        try:
                            glyphs = shared.value.page(image, pack_hint)
                            row |= {"ocr_text": spelt(glyphs), "glyph_count": len(glyphs), "mean_confidence": float(np.mean([g["confidence"] for g in glyphs])) if glyphs else 0.0}
                        except LookupError as e:
                            row |= {"error": str(e), "code": registry.NOT_PROCESSED}
                    made.append(row)
                out = pa.RecordBatch.from_pylist(made, _PAGE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out.columns], [*keep, *out.schema.names])

    schema = rows.select(*keep).schema
    for name, kind in (x.split() for x in PAGE_SCHEMA.split(", ")):
        schema = schema.add(name, "integer" if kind == "int" else kind)
    return rows.mapInArrow(run, schema)


def draw_terminal(df: DataFrame, text_col: str = "text", id_col: str = "image_id") -> DataFrame:
    """image_id, width, height, pixels: texts in the terminal font."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [font.drawn(t or "") for t in b.column("text").to_pylist()]
            for lo in range(0, len(made), 256):
                part = made[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([b.column("image_id").slice(lo, len(part)), pa.array([a.shape[1] for a in part], pa.int32()), pa.array([a.shape[0] for a in part], pa.int32()), pa.array([a.tobytes() for a in part], pa.binary())], ["image_id", "width", "height", "pixels"])

    return df.select(F.col(id_col).cast("long").alias("image_id"), F.col(text_col).alias("text")).mapInArrow(run, "image_id long, width int, height int, pixels binary")


def draw_lines(df: DataFrame, lines_col: str, gaps: list[int], id_col: str = "image_id") -> DataFrame:
    """image_id, width, height, pixels: arrays of lines as pages in the terminal font."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, lines in zip(b.column("image_id").to_pylist(), b.column("lines").to_pylist(), strict=True):
                a = font.drawn_lines([x or "" for x in lines or []], gaps)
                yield pa.RecordBatch.from_pylist([{"image_id": key, "width": a.shape[1], "height": a.shape[0], "pixels": a.tobytes()}], _GREY)

    return df.select(F.col(id_col).cast("long").alias("image_id"), F.col(lines_col).alias("lines")).mapInArrow(run, "image_id long, width int, height int, pixels binary")


_GREY = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])


def processed(images: DataFrame, step: str, **options) -> DataFrame:
    """image_id, width, height, pixels after one of the steps before recognition: blurred, rotated, deskewed, sauvola or
    binarised; of the last two bright pixels and ink are 255, the others 0.  Images without pixels are left out."""
    make = getattr(pixels, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, image, _ in _images(batches):
            if not isinstance(image, str):
                a = make(image, **options)
                a = np.where(a, 255, 0).astype(np.uint8) if a.dtype == bool else a
                yield pa.RecordBatch.from_pylist([{"image_id": key, "width": a.shape[1], "height": a.shape[0], "pixels": a.tobytes()}], _GREY)

    return _prepared(images).mapInArrow(run, "image_id long, width int, height int, pixels binary")


_LINE = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("line_no", "x", "y", "w", "h"))])


def read_lines(images: DataFrame, deskew: bool = False) -> DataFrame:
    """image_id, line_no, x, y, w, h of the lines of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, image, _ in _images(batches):
            if not isinstance(image, str):
                found = pixels.page_lines(pixels.binarised(image, deskew))
                yield pa.RecordBatch.from_pylist([{"image_id": key, "line_no": k, "x": x, "y": y, "w": w, "h": h} for k, (x, y, w, h) in enumerate(found)], _LINE)

    return _prepared(images).mapInArrow(run, "image_id long, line_no int, x int, y int, w int, h int")


#: Ways to cut a line into glyphs: plain, and plain with marks as part of their letters, and those of joined scripts.
SEGMENTERS = {"plain": pixels.segment, "marks": lambda ink: pixels.attach_marks(pixels.segment(ink)), "indic": pixels.segment_indic, "arabic": pixels.segment_arabic}


def segment_lines(images: DataFrame, *hows: str) -> DataFrame:
    """how, image_id, line_no, glyph_no, x, w of the glyphs that each of some segmenters cuts lines into."""
    schema = pa.schema([("how", pa.string()), ("image_id", pa.int64()), *((c, pa.int32()) for c in ("line_no", "glyph_no", "x", "w"))])

    def cut(key: int, image: np.ndarray) -> Iterator[dict]:
        ink = pixels.binarised(image)
        for k, (x, y, w, h) in enumerate(pixels.page_lines(ink)):
            for how in hows:
                yield from ({"how": how, "image_id": key, "line_no": k, "glyph_no": i, "x": g.x, "w": g.w} for i, g in enumerate(SEGMENTERS[how](ink[y : y + h, x : x + w])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                yield pa.RecordBatch.from_pylist([row for key, image, _ in _images(iter([b.slice(lo, 256)])) if not isinstance(image, str) for row in cut(key, image)], schema)

    return _prepared(images).mapInArrow(run, "how string, image_id long, line_no int, glyph_no int, x int, w int")


def read_parts(images: DataFrame, below: int = 128) -> DataFrame:
    """image_id, x, y, w, h, n of the connected parts of the pixels darker than ``below``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("x", "y", "w", "h", "n"))])
        for key, image, _ in _images(batches):
            if not isinstance(image, str):
                yield pa.RecordBatch.from_pylist([{"image_id": key, **dict(zip(("x", "y", "w", "h", "n"), x, strict=True))} for x in pixels.components(image < below)], schema)

    return _prepared(images).mapInArrow(run, "image_id long, x int, y int, w int, h int, n int")


def bit_set(ink: np.ndarray) -> list[int]:
    """A shape as 64-bit numbers, row by row, the lowest bit first."""
    return np.packbits(np.pad(ink.ravel(), (0, -ink.size % 64)), bitorder="little").view(np.int64).tolist()


_SHAPE = "bits array<long>, holes int, endpoints int, junctions int, aspect double"
_CUT = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("line_no", "glyph_no", "x", "y", "w", "h")), ("pack_id", pa.string()), ("bits", pa.list_(pa.int64())), *((c, pa.int32()) for c in ("holes", "endpoints", "junctions")), ("aspect", pa.float64())])


def cut_glyphs(images: DataFrame, of: Pack) -> DataFrame:
    """A row per glyph of pages in a script of separate letters: place in its line, and on the pack's grid its bits and
    features, as ``matching.match_prototypes`` takes them."""
    name, size = of.id, (of.grid_w, of.grid_h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recogniser([])
        for key, image, _ in _images(batches):
            if isinstance(image, str):
                continue
            ink, rows = pixels.binarised(image), []
            for k, (x, y, w, h) in enumerate(pixels.page_lines(ink)):
                glyphs = pixels.segment(ink[y : y + h, x : x + w])
                grids = [pixels.on_grid(g, *size) for g in glyphs]
                shapes = known._features(grids).tolist()
                rows += [{"image_id": key, "line_no": k, "glyph_no": i, "x": g.x, "y": g.y, "w": g.w, "h": g.h, "pack_id": name, "bits": bit_set(grid), "holes": int(f[0]), "endpoints": int(f[1]), "junctions": int(f[2]), "aspect": f[3]} for i, (g, grid, f) in enumerate(zip(glyphs, grids, shapes, strict=True))]
            yield pa.RecordBatch.from_pylist(rows, _CUT)

    return _prepared(images).mapInArrow(run, f"image_id long, line_no int, glyph_no int, x int, y int, w int, h int, pack_id string, {_SHAPE}")


def prototype_table(spark: SparkSession, packs: list[Pack]) -> DataFrame:
    """pack_id, codepoint, bits and features of the prototypes of packs."""
    rows = [(p.id, int(cp), bit_set(b), *map(int, s[:3]), float(s[3])) for p in packs for cp, b, s in zip(p.points, p.bitmaps, p.shapes, strict=True)]
    return spark.createDataFrame(rows, f"pack_id string, codepoint long, {_SHAPE}")
