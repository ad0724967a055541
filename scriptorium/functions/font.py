"""A 5 by 7 terminal font, text drawn in it, and text drawn by the JVM in an installed font."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import SparkSession

# The 5 by 7 font of character LCDs, of each character from space to tilde the five columns, bit 0 on top.
COLUMNS = """
0000000000 00005F0000 0007000700 147F147F14 242A7F2A12 2313086462 3649562050 0008070300 001C224100 0041221C00 2A1C7F1C2A 08083E0808
0050300000 0808080808 0060600000 2010080402 3E5149453E 00427F4000 4261514946 2141454B31 1814127F10 2745454539 3C4A494930 0171090503
3649494936 064949291E 0036360000 0056360000 0814224100 1414141414 0041221408 0201510906 324979413E 7E1111117E 7F49494936 3E41414122
7F4141221C 7F49494941 7F09090901 3E4149497A 7F0808087F 00417F4100 2040413F01 7F08142241 7F40404040 7F020C027F 7F0408107F 3E4141413E
7F09090906 3E4151215E 7F09192946 4649494931 01017F0101 3F4040403F 1F2040201F 3F4038403F 6314081463 0708700807 6151494543 007F414100
0204081020 0041417F00 0402010204 4040404040 0001020400 2054545478 7F48444438 3844444420 384444487F 3854545418 087E090102 0C5252523E
7F08040478 00447D4000 2040443D00 7F10284400 00417F4000 7C04180478 7C08040478 3844444438 7C14141408 081414187C 7C08040408 4854545420
043F444020 3C4040207C 1C2040201C 3C4030403C 4428102844 0C5050503C 4464544C44 0008364100 00007F0000 0041360800 1008081008
"""
CELLS = np.array([[[b >> y & 1 for b in bytes.fromhex(c)] for y in range(7)] for c in COLUMNS.split()], bool)
SCALE, MARGIN = 4, 16


def drawn(text: str, scale: int = SCALE, margin: int = MARGIN) -> np.ndarray:
    """Black on white, one cell of 7 by 9 dots a character; others than ASCII are left out but have their share of width."""
    step = 7 * scale
    out = np.full((2 * margin + 7 * scale, 2 * margin + len(text) * step), 255, np.uint8)
    x = margin
    for c in text:
        if 32 <= ord(c) <= 126:
            cell = np.kron(CELLS[ord(c) - 32], np.ones((scale, scale), bool))
            out[margin : margin + 7 * scale, x : x + 5 * scale][cell] = 0
            x += step
    return out


def as_pgm(a: np.ndarray) -> bytes:
    return f"P5\n{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.tobytes()


def drawn_lines(lines: list[str], gaps: list[int], scale: int = SCALE, margin: int = MARGIN) -> np.ndarray:
    """Lines one below the other, the gap before the i-th being ``gaps[i % len(gaps)]`` rows; the first has none."""
    pages = [drawn(t, scale, margin)[margin : margin + 7 * scale] for t in lines]
    width = max([2 * margin, *(a.shape[1] for a in pages)])
    out = [np.full((margin, width), 255, np.uint8)]
    for i, a in enumerate(pages):
        out.append(np.full((gaps[i % len(gaps)] if i else 0, width), 255, np.uint8))
        out.append(np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=255))
    return np.concatenate([*out, out[0]])


def as_png(a: np.ndarray) -> bytes:
    """A grey PNG."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.pad(a, ((0, 0), (1, 0)))  # each row's filter: none
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def as_bmp(a: np.ndarray) -> bytes:
    """A BMP of 24 bits, all three channels alike."""
    height, width = a.shape
    rows = np.pad(np.repeat(a[::-1, :, None], 3, axis=2).reshape(height, -1), ((0, 0), (0, -3 * width % 4)))
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def find_font(name: str = "DejaVuSans.ttf") -> str | None:
    """The file of an installed font."""
    return next((os.path.join(d, name) for top in ("/usr/share/fonts", "/usr/local/share/fonts") for d, _, files in os.walk(top) if name in files), None)


class JvmFont:
    """An installed font, drawn by the driver's JVM."""

    def __init__(self, spark: SparkSession, path: str, points: float = 56.0):
        self.j = spark._jvm
        self.j.java.lang.System.setProperty("java.awt.headless", "true")
        self.j.javax.imageio.ImageIO.setUseCache(False)
        font = self.j.java.awt.Font.createFont(self.j.java.awt.Font.TRUETYPE_FONT, self.j.java.io.File(path))
        self.font = font.deriveFont(float(points))

    def has(self, text: str) -> bool:
        return self.font.canDisplayUpTo(text) < 0

    def draw(self, text: str, advance: int = 70, margin: int = 24, height: int = 56 + 14, rtl: bool = False) -> np.ndarray:
        """Each character in a cell of the same width, black on white, made hard at 180."""
        return self.draw_all([text], advance, margin, height, rtl)[0]

    def draw_all(self, texts: list[str], advance: int = 70, margin: int = 24, height: int = 56 + 14, rtl: bool = False) -> list[np.ndarray]:
        """Texts as ``draw`` makes them, one below the other in one image, as fetching an image from the JVM takes its time."""
        width, tall = 2 * margin + advance * max(1, *map(len, texts), 1), height + 2 * margin
        image = self.j.java.awt.image.BufferedImage(width, tall * len(texts), 10)  # grey bytes
        g = image.createGraphics()
        g.setColor(self.j.java.awt.Color.WHITE)
        g.fillRect(0, 0, width, tall * len(texts))
        g.setColor(self.j.java.awt.Color.BLACK)
        g.setFont(self.font)
        for row, text in enumerate(texts):
            g.setClip(0, row * tall, width, tall)
            for i, c in enumerate(text):
                k = len(text) - 1 - i if rtl else i
                g.drawString(c, margin + k * advance, row * tall + margin + 56)
        g.dispose()
        grey = np.frombuffer(bytes(image.getRaster().getDataBuffer().getData()), np.uint8).reshape(len(texts), tall, width)
        hard = np.where(grey < 180, 0, 255).astype(np.uint8)
        return [np.ascontiguousarray(a[:, : 2 * margin + advance * max(1, len(t))]) for a, t in zip(hard, texts, strict=True)]

    def _bytes(self, image, kind: str) -> bytes:
        out = self.j.java.io.ByteArrayOutputStream()
        self.j.javax.imageio.ImageIO.write(image, kind, out)
        return bytes(out.toByteArray())

    def draw_free(self, text: str, margin: int = 24, least: tuple[int, int] = (160, 80), kind: str = "png") -> bytes:
        """A line of any text as the font spaces it, black on white, as the bytes of an image file."""
        probe = self.j.java.awt.image.BufferedImage(1, 1, 10).createGraphics()
        metrics = probe.getFontMetrics(self.font)
        width, height = max(least[0], metrics.stringWidth(text) + 2 * margin), max(least[1], metrics.getHeight() + 2 * margin)
        image = self.j.java.awt.image.BufferedImage(width, height, 10)
        g = image.createGraphics()
        g.setColor(self.j.java.awt.Color.WHITE)
        g.fillRect(0, 0, width, height)
        g.setColor(self.j.java.awt.Color.BLACK)
        g.setFont(self.font)
        g.drawString(text, margin, margin + metrics.getAscent())
        g.dispose()
        return self._bytes(image, kind)
