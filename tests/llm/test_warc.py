import base64
import gzip
import hashlib

from scriptorium.llm import warc as W

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (3, "http://a/3", "same"), (4, "http://b/ x\r\ny", "other é"), (5, "u", None), (6, "u", ""), (None, "u", "same"), (None, "u", "lonely"), (7, "u", "z" * 200000)]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string")
    archives = W.write_archives(pages)
    found = [r for r in W.read_archives(archives).collect() if r.record_type != "warcinfo"]
    assert len(found) == len(ROWS) and all(r.digest_ok and r.error is None for r in found)
    best = {}
    for i, _, t in ROWS:
        if i is not None:
            best[t or ""] = max(i, best.get(t or "", i))
    want = sorted((f"urn:page:{i}", "response" if i == best.get(t or "") else "revisit", len((t or "").encode()), b32(t), None if i == best.get(t or "") else f"urn:page:{best[t or '']}") for i, _, t in ROWS)
    assert sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in found) == want
    bodies = {r.record_id: r.payload for r in found if r.record_type == "response"}
    assert bodies["urn:page:4"].decode() == "other é" and len(bodies["urn:page:7"]) == 200000


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    kinds = {r.record_id[9:]: r.record_type for r in W.read_archives(W.write_archives(pages, min_bytes=3)).collect()}
    assert [kinds[str(i)] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_one_member_per_record(spark):
    member = W.response("urn:page:1", "u", b"hello", None)
    assert b"WARC-Type: response" in gzip.decompress(member)
    both = member + W.response("urn:page:2", "u", b"hello", "urn:page:1")
    assert [r["record_type"] for r in W.records(both)] == ["response", "revisit"]


def test_damage():
    a, b = W.response("urn:page:1", "u", b"hello", None), W.response("urn:page:2", "u", b"x" * 100, None)
    assert [r["error"] is None for r in W.records(a + b"junk" + b)] == [True, False, True]
    assert [r["error"] is None for r in W.records(a + b[:-10])] == [True, False]
    broken = gzip.compress(gzip.decompress(a).replace(b"hello", b"jello"))
    assert [r["digest_ok"] for r in W.records(broken)] == [False]
    assert [r["error"] for r in W.records(gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n"))] == ["bad framing"]
    assert list(W.records(b"")) == []


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    W.save(W.write_archives(pages), f"file://{tmp_path}/w")
    back = W.read_archives(spark.read.format("binaryFile").load(f"{tmp_path}/w"), name_col="path")
    assert back.where("record_type <> 'warcinfo' and digest_ok").count() == 3
    assert W.read_archives(W.write_archives(pages.limit(0))).count() == 0


def test_reading_in_pieces(monkeypatch):
    """Whatever the size of a piece, the same records, errors and places; damage between and within members is skipped."""
    import random

    r = random.Random(4)
    members = [W.response(f"urn:page:{i}", "http://x/", bytes(r.randrange(256) for _ in range(r.randint(0, 3000))), None) for i in range(12)]
    sound = b"".join(members)
    broken = bytearray(sound)
    at = len(b"".join(members[:4])) + 60
    broken[at : at + 20] = bytes(20)
    for data in (sound, b"", sound[:-30], b"junk" * 50 + sound, bytes(broken), members[0] + b"\x1f\x8b" + members[1], b"\x1f", sound + b"\x1f\x8b\x08"):
        seen = []
        for size in (7, 100, 64 << 10):
            monkeypatch.setattr(W, "PIECE", size)
            seen.append([{k: v for k, v in x.items()} for x in W.records(data)])
        assert seen[0] == seen[1] == seen[2]
        offsets = [x["offset"] for x in seen[0]]
        assert offsets == sorted(offsets) and all(o <= len(data) for o in offsets)
    assert sum(x["error"] is None for x in W.records(bytes(broken))) == 11 and len(list(W.records(sound))) == 12


def test_files_are_read_in_pieces(spark, edge, tmp_path):
    pages = edge.selectExpr("doc_id as page_id", "source as url", "text as html")
    archives = W.write_archives(pages)
    W.save(archives, f"file://{tmp_path}/w")
    strip = lambda df: sorted((str(r.record_id), r.record_type, r.payload_digest, r.refers_to or "", r.error or "") for r in df.where("record_type <> 'warcinfo'").collect())
    got = strip(W.read_files(spark, f"file://{tmp_path}/w"))
    assert len(got) == edge.count() and not any(x[4] for x in got)
    import gzip

    blob = next((tmp_path / "w").iterdir())
    assert gzip.open(blob).read().startswith(b"WARC/1.0")
