import hashlib
import random
import zlib

import pytest

from tessera.llm import matroska as M


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 576 * 8 * 16 * 3 + 5])
@pytest.mark.parametrize("lacing", [("fixed",), ("xiph",), ("ebml",), ("fixed", "xiph", "ebml")])
def test_round_trip_and_packet_table(n, lacing):
    text = random.Random(n).randbytes(n)
    payload = M.payload_of(text)
    assert len(payload) % M.FRAME == 0 and len(payload) >= M.FRAME and payload.startswith(text)
    data = M.write(payload, lacing)
    media = M.read(data)
    assert b"".join(data[a:b] for _, _, a, b, _ in media.packets) == payload
    assert [p[1] for p in media.packets] == [i * M.FRAME_MS * 1_000_000 for i in range(len(media.packets))]
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert all(media.clusters[c] == t for t, _, c in media.cues) and len(media.cues) == len(media.clusters)


@pytest.mark.parametrize("lacing", ["xiph", "ebml"])
def test_laces_of_unequal_frames_in_a_block_group_of_unknown_size(lacing):
    r = random.Random(2)
    frames = [r.randbytes(k) for k in (700, 3, 255, 256, 0, 5000, 1)]
    flags, body = M.lace(frames, lacing)
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, b"\x81\x00\x05" + bytes([flags]) + body) + M.element(0xFB, 1))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.element(M.TIMESTAMP, 10) + group
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska")) + M.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + M.element(M.CUES, b"")
    media = M.read(data)
    assert [data[a:b] for _, _, a, b, _ in media.packets] == frames
    assert {p[1] for p in media.packets} == {15_000_000} and not media.packets[0][4]


def test_broken_files_are_refused():
    data = M.write(M.payload_of(b"x" * 2000))
    for bad in (b"", data[:-5], data[10:], b"\x00" * 50):
        with pytest.raises(M.Malformed):
            M.read(bad)


def test_query_on_odd_rows(spark, odd_docs, write_sf):
    sf = write_sf(documents=odd_docs)
    got = M.op9(spark, sf).collect()
    text = {(r.doc_id): (r.text or "").encode() for r in odd_docs.collect()}
    assert len(got) == 10
    for r in got:
        p = M.payload_of(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    full = M.media_columns(odd_docs).select("r.media", "r.packets").first()
    assert full.packets[0].track == 1 and full.media


def walk(data, at, end):
    """Elements by definition: (identifier, first byte, end), all sizes known."""
    while at < end:
        w = next(k for k in range(8) if data[at] << k & 128) + 1
        ident, at = data[at : at + w].hex(), at + w
        w = next(k for k in range(8) if data[at] << k & 128) + 1
        size, at = int.from_bytes(data[at : at + w], "big") & (1 << 7 * w) - 1, at + w
        yield ident, at, at + size
        at += size


def frames_of(block):
    """Frames of a block with track 1, by lacing, from the text of the format."""
    kind, body = block[3] >> 1 & 3, block[4:]
    if not kind:
        return [body]
    n, body, sizes = body[0] + 1, body[1:], []
    if kind == 2:
        sizes = [len(body) // n] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while body[0] == 255:
                size, body = size + 255, body[1:]
            sizes.append(size + body[0])
            body = body[1:]
    else:
        for k in range(n - 1):
            w = next(x for x in range(8) if body[0] << x & 128) + 1
            v, body = int.from_bytes(body[:w], "big") & (1 << 7 * w) - 1, body[w:]
            sizes.append(v if not k else sizes[-1] + v - (2 ** (7 * w - 1) - 1))
    sizes = sizes[: n - 1] + [len(body) - sum(sizes[: n - 1])]
    return [body[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(n)]


def test_query_on_a_whole_table_against_another_reader(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = {r.doc_id: (r.text, bytes(r.media)) for r in M.media_columns(docs, carry=["doc_id", "text"]).select("c.*", "r.media").collect()}
    got = {r.doc_id: r for r in M.op9(spark, sf).collect()}
    assert got.keys() == files.keys()
    for i, (text, data) in files.items():
        text, r = (text or "").encode(), got[i]
        want = text + b"\xff" * (max(-(-len(text) // 576), 1) * 576 - len(text))
        frames, clusters, cues = [], {}, []
        (_, a, b) = next(x for x in walk(data, 0, len(data)) if x[0] == "18538067")
        place = a
        for ident, p, q in walk(data, a, b):
            if ident == "1f43b675":
                kids = list(walk(data, p, q))
                clusters[place - a] = next(int.from_bytes(data[x:y], "big") for k, x, y in kids if k == "e7")
                frames += [f for k, x, y in kids if k == "a3" for f in frames_of(data[x:y])]
            elif ident == "1c53bb6b":
                for _, x, y in walk(data, p, q):
                    point = {k: (u, v) for k, u, v in walk(data, x, y)}
                    where = {k: int.from_bytes(data[u:v], "big") for k, u, v in walk(data, *point["b7"])}
                    cues.append((int.from_bytes(data[slice(*point["b3"])], "big"), where["f1"]))
            place = q
        stored = b"".join(frames)
        assert stored == want and [(t, c) for c, t in clusters.items()] == cues
        steps = sum(abs(x - y) for x, y in zip(stored, stored[1:], strict=False))
        feature = f"packets={len(frames)};clusters={len(clusters)};cues={len(cues)};ms={len(frames) * M.FRAME_MS};sum={sum(stored)};steps={steps};half={sum(frames[len(frames) // 2])}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(data), hashlib.sha256(data).hexdigest(), feature)


def test_seeking_parses_one_cluster():
    payload = random.Random(3).randbytes(576 * 8 * 16 * 5)
    data = M.write(payload)
    media = M.read(data)
    for t in (0, 1, media.packets[300][1], media.packets[-1][1] + 5):
        got = M.seek(data, t)
        assert len(got) <= 128 and got[0][1] <= t
        assert max(x for x in got if x[1] <= t) == max(x for x in media.packets if x[1] <= t)
