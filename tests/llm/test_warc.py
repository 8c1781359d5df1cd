"""WARC: exact round trip, revisits, damage."""

import hashlib
import io
import zlib

import pytest

from fluxprint.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def test_round_trip(spark, frame):
    long = "é" * 300_000
    rows = [(1, "http://a/ü?x=1%20 y\r\nz", "short"), (2, None, "short"), (3, "u", "same " * 30), (9, "u", "same " * 30), (7, "v", "same " * 30),
            (4, "u", None), (5, "u", ""), (6, "u", long), (8, "u", long), (None, "n", "same " * 30), (3, "u", "same " * 30)]
    manifest = warc.write(warc.planned(frame(rows, SCHEMA)))
    got = warc.read(manifest).collect()
    assert all(r.digest_ok for r in got) and len(got) == len(rows)
    first = {"same " * 30: 3, long: 6}
    for page, url, html in rows:
        raw = (html or "").encode()
        mine = [r for r in got if r.page_id == page]
        refers = first.get(html) if page is not None and html in first and page > first[html] else None
        assert all((r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (
            url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers) for r in mine)
        assert all((r.payload is None) if refers else bytes(r.payload) == raw for r in mine)


def test_empty_table(spark, frame):
    assert warc.round_trip(frame([], SCHEMA)).count() == 0


def record(payload=b"hello", **change):
    return warc.frame(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_members_are_read_piece_by_piece(piece):
    raws = [record(b"x" * n) for n in (0, 5, 100_000)]
    stream = io.BytesIO(b"".join(zlib.compress(r, wbits=31) for r in raws))
    assert [warc.record(*warc.parse(p), "f")["payload"] for p in warc.members(stream, piece)] == [b"", b"x" * 5, b"x" * 100_000]


def test_damage_is_seen():
    bad = record().replace(b"hello", b"hellO")
    assert not warc.record(*warc.parse(iter([bad])), "f")["digest_ok"]
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(iter([record()[:-1]]))
    with pytest.raises(ValueError, match="within a record"):
        [list(p) for p in warc.members(io.BytesIO(zlib.compress(record(), wbits=31)[:-12]), 16)]
