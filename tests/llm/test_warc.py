import gzip
import hashlib

import pytest

from tessera.llm import warc as W


def brute(pages):
    first = {}
    for i, h in sorted(((i, h or "") for i, h in pages if i is not None)):
        if len(h.encode()) >= 100:
            first.setdefault(h, i)
    out = []
    for i, h in pages:
        b = (h or "").encode()
        ref = first.get(h or "")
        ref = None if ref == i or i is None else ref
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def test_round_trip(spark, write_sf):
    big = "é\r\n\r\nWARC/1.1\r\n0\r\n" * 9000
    pages = [(5, big), (2, big), (3, "x" * 99), (1, "x" * 99), (4, None), (6, ""), (7, "\U0001f600" * 40), (8, "\U0001f600" * 40), (9, big + "!"), (2, big)]
    sf = write_sf(pages=spark.createDataFrame([(i, "u", h, "clash") for i, h in pages], "page_id long, url string, html string, digest string"))
    assert sorted(map(tuple, W.op4(spark, sf).collect()), key=str) == brute(pages)


def test_files_are_archives_and_segments_are_verified(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc" * 2000), (2, "d")], "page_id long, html string")
    W.write(df.coalesce(1), str(tmp_path / "w"), segment_chars=1000)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    kinds = [h["warc-type"] for h, _ in W.parse(data)]
    assert kinds.count("response") == 2 and kinds.count("continuation") >= 6
    got = W.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == 2 and all(r.verified for r in got)
    records = list(W.parse(data))
    lost = [r for r in records if r[0].get("warc-segment-number") != "3"]
    (tmp_path / "x").mkdir()
    blob = b"".join(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in h.items()) + b"\r\n" + b + b"\r\n\r\n" for h, b in lost)
    (tmp_path / "x" / "a.warc.gz").write_bytes(gzip.compress(blob))
    with pytest.raises(Exception, match="Malformed"):
        W.read(spark, str(tmp_path / "x")).collect()


def test_chunked_framing():
    assert W.dechunk(b"3;ext=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"3\r\nab\r\n0\r\n\r\n", b"5\r\nabc\r\n"):
        with pytest.raises(W.Malformed):
            W.dechunk(bad)


def test_empty_table(spark, write_sf):
    sf = write_sf(pages=spark.createDataFrame([], "page_id long, url string, html string"))
    assert W.op4(spark, sf).count() == 0


def blob(records):
    return b"".join(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in h.items()) + b"\r\n" + b + b"\r\n\r\n" for h, b in records)


def archive(spark, folder, pages, change):
    """Records of a written archive, changed, one gzip member for each."""
    W.write(spark.createDataFrame(pages, "page_id long, html string").coalesce(1), str(folder / "w"), segment_chars=1000)
    records = list(W.parse(b"".join(gzip.decompress(p.read_bytes()) for p in sorted((folder / "w").glob("*.gz")))))
    (folder / "x").mkdir()
    (folder / "x" / "a.warc.gz").write_bytes(b"".join(gzip.compress(blob([r])) for r in change(records)))
    return str(folder / "x")


PAGES = [(1, "abc" * 2000), (2, "abc" * 2000), (3, "d" * 50), (4, "e" * 200)]


def test_archives_of_many_gzip_members(spark, tmp_path):
    got = W.read(spark, archive(spark, tmp_path, PAGES, lambda r: r)).collect()
    assert sorted((r.uri, r.payload_bytes, r.record_type, r.verified) for r in got) == [("urn:page:1", 6000, "response", True), ("urn:page:2", 6000, "revisit", True), ("urn:page:3", 50, "response", True), ("urn:page:4", 200, "response", True)]


def wrong_total(records):
    return [({**h, **({"warc-segment-total-length": "7"} if "warc-segment-total-length" in h else {})}, b) for h, b in records]


def wrong_digest(records):
    return [({**h, **({"warc-payload-digest": "sha256:00"} if h["warc-target-uri"] == "urn:page:3" else {})}, b) for h, b in records]


def no_response(records):
    return [({**h, **({"warc-refers-to-target-uri": "urn:page:9"} if h["warc-type"] == "revisit" else {})}, b) for h, b in records]


def other_length(records):
    return [(h, b.replace(b"X-Payload-Bytes: 6000", b"X-Payload-Bytes: 5999") if h["warc-type"] == "revisit" else b) for h, b in records]


@pytest.mark.parametrize(("change", "page"), [(wrong_total, 1), (wrong_digest, 3), (no_response, 2), (other_length, 2)])
def test_what_does_not_agree_is_an_error_or_marked(spark, tmp_path, change, page):
    path = archive(spark, tmp_path, PAGES, change)
    with pytest.raises(W.Malformed, match="differ"):
        W.read(spark, path)
    assert [r.uri for r in W.read(spark, path, strict=False).collect() if not r.verified] == [f"urn:page:{page}"]


def test_a_file_that_breaks_off(spark, tmp_path):
    path = archive(spark, tmp_path, PAGES, lambda r: r)
    data = (tmp_path / "x" / "a.warc.gz").read_bytes()
    with pytest.raises(W.Malformed, match="gzip member"):
        list(W.unpacked(data[:-3]))
    assert b"".join(W.unpacked(data, 7)) == gzip.decompress(data)


def test_revisits_by_shuffle(spark, write_sf, monkeypatch):
    monkeypatch.setattr(W, "MOST_BROADCAST", 0)
    pages = [(i, f"page {i % 5} " * 30) for i in range(40)] + [(None, "page 1 " * 30), (0, "page 1 " * 30)]
    sf = write_sf(pages=spark.createDataFrame(pages, "page_id long, html string"))
    assert sorted(map(tuple, W.op4(spark, sf).collect()), key=str) == brute(pages)
