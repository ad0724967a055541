import hashlib
import os
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import tiff as T


@pytest.mark.parametrize("how", [T.NONE, T.LZW, T.DEFLATE, T.OLD_DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(how, predictor, tile):
    r = random.Random(how)
    for rows in (1, 7, 300):
        data = bytes(r.choice(b"ab cde\n") if r.random() < 0.9 else r.randrange(256) for _ in range(T.ROW * rows))
        pages = list(T.pages(T.write(data, compression=how, predictor=predictor, tile=tile, page_rows=128)))
        assert b"".join(p.data for p in pages) == data and len(pages) == -(-rows // 128)


def test_codecs():
    r = random.Random(1)
    for i in range(200):
        d = bytes(r.choice(b"ab") for _ in range(r.randrange(9000))) if i % 2 else os.urandom(r.randrange(9000))
        assert T.unpack_bits(T.pack_bits(d), len(d)) == d
        assert T.lzw_unpack(T.lzw_pack(d), len(d)) == d
    assert T.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


def image(order, fields, data):
    """A file of one directory; fields: tag, type, values."""
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 8)
    n, behind = len(fields), 8 + 2 + 12 * len(fields) + 4
    head, tail = struct.pack(f"{order}H", n), b""
    for tag, kind, values in fields:
        if tag == 273:
            values = [behind + 64]
        raw = b"".join(struct.pack(f"{order}{T._TYPES[kind]}", v) for v in values)
        if len(raw) > 4:
            raw, tail = struct.pack(f"{order}I", behind + len(tail)), tail + raw
        head += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return out + head + bytes(4) + tail.ljust(64, b"\0") + data


@pytest.mark.parametrize("order", ["<", ">"])
def test_deep_samples_and_byte_orders(order):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4) * 1000
    diff = np.concatenate([a[:, :1], np.diff(a, axis=1)], axis=1).astype(f"{order}u2").tobytes()
    fields = [(256, 3, [4]), (257, 3, [3]), (258, 3, [16]), (259, 3, [1]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [3]), (279, 4, [len(diff)]), (317, 3, [2])]
    (page,) = T.pages(image(order, fields, diff))
    assert np.array_equal(np.frombuffer(page.data, "<u2").reshape(3, 4), a)
    f = np.array([[1.5, -2.25, 3e9, 0.0]], np.float32)
    planes = np.frombuffer(f.astype(">f4").tobytes(), np.uint8).reshape(4, 4).T.reshape(1, -1)
    coded = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    fields = [(256, 3, [4]), (257, 3, [1]), (258, 3, [32]), (259, 3, [1]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [1]), (279, 4, [16]), (317, 3, [3])]
    (page,) = T.pages(image(order, fields, coded))
    assert np.array_equal(np.frombuffer(page.data, "<f4"), f[0])
    fields = [(256, 3, [10]), (257, 3, [2]), (258, 3, [1]), (259, 3, [1]), (262, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 3, [2]), (279, 4, [4])]
    (page,) = T.pages(image(order, fields, bytes([0b10101010, 0b11000000, 0xFF, 0])))
    assert list(page.data) == [1, 0] * 4 + [1, 1] + [1] * 8 + [0, 0]


def test_damage():
    good = T.write(b"x" * T.ROW * 3)
    assert list(T.pages(b"")) == ["not a TIFF"] and list(T.pages(b"II*\0\xff\xff\xff\x7f")) == ["the directory is cut off"]
    bad = bytearray(good)
    bad[8:14] = b"\xff" * 6
    assert all(isinstance(p, str) for p in T.pages(bytes(bad)))
    loop = bytearray(good)
    at = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", loop, at)[0], at)
    assert len(list(T.pages(bytes(loop)))) == 1


def test_tables(spark, edge, empty):
    pages = T.read_pages(T.write_media(edge))
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in T.image_digests(pages).collect())
    want = []
    for r in edge.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert got == Counter(want)
    assert T.image_digests(T.read_pages(T.write_media(empty))).count() == 0
    assert T.read_pages(spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "id long, media binary")).first().error == "not a TIFF"


def test_damaged_files_give_rows_with_errors():
    """Bytes changed, cut off, or counts blown up: always pages or errors, and never more memory than the file is worth."""
    import resource

    r = random.Random(12)
    sound = [T.write(os.urandom(T.ROW * 40), compression=how, tile=tile, page_rows=16, strip_rows=8) for how in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS) for tile in (0, 16)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    wrong = 0
    for i in range(2400):
        data = bytearray(sound[i % len(sound)])
        at = struct.unpack_from("<I", data, 4)[0]
        for _ in range(r.randint(1, 4)):
            where = at + r.randrange(120) if r.random() < 0.8 else r.randrange(len(data))
            if r.random() < 0.5:
                data[min(where, len(data) - 1)] = r.randrange(256)
            elif where + 4 <= len(data):
                struct.pack_into("<I", data, where, r.choice((2**31, 2**32 - 1, 0, 1, 2**16, at)))
        data = data[: r.randrange(len(data))] if i % 5 == 0 else data
        wrong += any(isinstance(p, str) for p in T.pages(bytes(data)))
    assert wrong > 1000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_huge_claims():
    plain = [(256, 4, [4]), (257, 4, [2**31]), (258, 3, [8]), (259, 3, [1]), (273, 4, [0]), (277, 3, [1]), (278, 4, [2**31]), (279, 4, [12])]
    (page,) = T.pages(image("<", plain, bytes(12)))
    assert page == "ValueError: a strip or tile is cut off"
    assert list(T.pages(image("<", [(256, 4, [2**32 - 1]), *plain[1:]], bytes(12)))) == [page]
    blown = bytearray(image("<", plain, bytes(12)))
    struct.pack_into("<I", blown, 8 + 2 + 4, 2**32 - 1)  # the first field's count
    assert list(T.pages(bytes(blown))) == ["the directory is cut off"]


@pytest.mark.parametrize("how", ["", "PackBits", "LZW", "ZLib", "Deflate"])
def test_files_of_another_writer(spark, how):
    """Files that the Java runtime's own TIFF writer makes."""
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    r = random.Random(3)
    for kind, samples in ((5, 3), (10, 1)):  # BGR and grey
        picture = jvm.java.awt.image.BufferedImage(37, 23, kind)
        want = np.zeros((23, 37, samples), np.uint8)
        for y in range(23):
            for x in range(37):
                want[y, x] = [r.choice((0, 0, 255, r.randrange(256))) for _ in range(samples)]
                for s in range(samples):
                    picture.getRaster().setSample(x, y, s, int(want[y, x, s]))
        writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
        param = writer.getDefaultWriteParam()
        if how:
            param.setCompressionMode(2)
            param.setCompressionType(how)
        out = jvm.java.io.ByteArrayOutputStream()
        stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
        writer.setOutput(stream)
        writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), param)
        stream.flush()
        (page,) = T.pages(bytes(out.toByteArray()))
        assert not isinstance(page, str), page
        assert (page.width, page.height, page.samples) == (37, 23, samples)
        assert page.data == want.tobytes()


def test_digests_by_hand(spark):
    """Every column of the digests, from the stored bytes alone, and ids of any type."""
    texts = {"a-1": "hello", "a-2": None, "a-3": "ü" * 500, "a-4": "hello", None: "x" * 192}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    media = T.write_media(df)
    stored = {r.id: bytes(r.media) for r in media.collect()}
    rows = {r.doc_id: r for r in T.image_digests(T.read_pages(media)).collect()}
    assert stored["a-1"] == stored["a-4"] and rows["a-1"][1:] == rows["a-4"][1:] and set(rows) == set(texts)
    for key, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        flat = np.frombuffer(payload, np.uint8)
        sums = flat.reshape(-1, 3).sum(axis=0, dtype=int).tolist()
        row = rows[key]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (row.media_bytes, row.media_sha256) == (len(stored[key]), hashlib.sha256(stored[key]).hexdigest())
        assert row.feature == f"pages=1;size=64x{len(payload) // 192};sums={sums[0]},{sums[1]},{sums[2]};edges={sum(a != b for a, b in zip(payload, payload[1:], strict=False))}"
