"""Archives are written, damaged and read again."""

import base64
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter

import pytest

from lineagrid.llm import warc

PAGES = "page_id long, url string, html string, sha1 string, payload string, owner int, salt int, n int, size long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "p", 1, 2, 3, 4) for r in rows], PAGES)


def written(spark, pages, tmp_path, **how):
    return warc.write_archives(warc.marked(frame(spark, pages), **how), f"file:{tmp_path}/w")


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def want(pages, least=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    owner = {}
    data = [(p, (h or "").encode()) for p, _, h in pages]
    for p, d in data:
        owner[d] = max(owner.get(d, -(2**63)), -(2**63) if p is None else p)
    seen, out = set(), []
    for p, d in data:
        own = owner[d] if owner[d] > -(2**63) else None
        first = len(d) < least or (p == own and d not in seen)
        if first and len(d) >= least:
            seen.add(d)
        out.append((p, len(d), digest(d), "response" if first else "revisit", None if first else own))
    return Counter(out)


def read(df):
    rows = [r for r in df.collect() if r.record_type in ("response", "revisit")]
    num = lambda r, k: int(r.headers[k]) if k in r.headers else None
    return Counter((num(r, "page-id"), r.payload_bytes, r.payload_digest, r.record_type, num(r, "refers-to-page-id")) for r in rows), rows


PAGES_ = [(i, f"http://x/{i}", f"<p>{'é😀'[i % 2] * (i % 50)} {i // 3}</p>") for i in range(120)] + [
    (200, None, None), (201, "http://y z\r\nX: 1/ü", ""), (7, "http://x/7", "<p>é 2</p>"), (300, "a", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (301, "b", "\x1f\x00 nul"),
    (302, "long", "word " * 300_000), (None, "n", "null id"), (None, "m", "null id"), (5, "twice", "dup"), (5, "twice", "dup"), (5, None, "dup"), (4, "less", "dup"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, tmp_path, least):
    files = written(spark, PAGES_, tmp_path, least=least)
    got, rows = read(warc.read_archives(files))
    assert got == want(PAGES_, least)
    at = {r.record_id: r for r in rows if r.record_type == "response"}
    for r in rows:
        if r.record_type == "revisit":  # it says which record it repeats
            assert at[r.headers["warc-refers-to"].strip("<>")].payload_digest == r.payload_digest
        else:
            assert r.block.endswith(b"\r\n\r\n" + r.block.split(b"\r\n\r\n", 1)[1]) and digest(r.block.split(b"\r\n\r\n", 1)[1]) == r.payload_digest
    for f in files.collect():
        with open(f.path.removeprefix("file:"), "rb") as h:
            assert h.read(3) == b"\x1f\x8b\x08" and f.bytes == os.path.getsize(f.path.removeprefix("file:"))
    assert warc.read_archives(written(spark, [], tmp_path)).count() == 0


def test_only_listed_files_are_read(spark, tmp_path):
    files = written(spark, PAGES_, tmp_path)
    (tmp_path / "w" / "left-over.warc.gz").write_bytes(b"of a lost task")
    assert warc.read_archives(files).filter("gap is not null").count() == 0


def test_files_are_rolled(spark, tmp_path):
    files = warc.write_archives(warc.marked(frame(spark, PAGES_)).coalesce(1), f"{tmp_path}/r", roll=2000)
    assert files.count() > 5
    assert read(warc.read_archives(files))[0] == want(PAGES_)


def _archive(packed, n=12):
    r = random.Random(4)
    out, at = [], []
    for i in range(n):
        html = bytes(r.choice(b"abcdef \n") for _ in range(r.randint(0, 900)))
        x = warc.page_record(i, f"http://x/{i}", hashlib.sha1(html).hexdigest(), len(html), html, None, "2020-01-01T00:00:00Z")
        at.append(sum(map(len, out)))
        out.append(warc.member(x) if packed else x)
    return b"".join(out), [*at, sum(map(len, out))]


def _salvaged(tmp_path, data):
    p = tmp_path / "x.warc"
    p.write_bytes(data)
    rows = list(warc.salvage_file(str(p)))
    assert [r["offset"] for r in rows] == [0, *(r["offset"] + r["length"] for r in rows)][:-1]  # nothing is left out, nothing read twice
    assert sum(r["length"] for r in rows) == len(data)
    return [int(r["headers"]["page-id"]) for r in rows if r["gap"] is None], [(r["offset"], r["length"]) for r in rows if r["gap"] is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(tmp_path, packed):
    data, at = _archive(packed)
    every = list(range(12))
    assert _salvaged(tmp_path, data) == (every, [])
    for k in (0, 4, 11):  # a flipped byte loses its record alone (a plain record's fields have no checksum)
        span = at[k + 1] - at[k]
        for i in (0, 1, span // 3, span // 2, span - 6) if packed else (0, 1, span - 6, span - 5, span - 1):
            bad = bytearray(data)
            bad[at[k] + i] ^= 0x55
            got, gaps = _salvaged(tmp_path, bytes(bad))
            assert got in (every, [x for x in every if x != k]) and (gaps == [(at[k], span)] or got == every)
    # cut off, bytes missing, garbage between, in front and behind
    assert _salvaged(tmp_path, data[: at[9] + 20]) == (every[:9], [(at[9], 20)])
    assert _salvaged(tmp_path, data[: at[3] + 30] + data[at[4] :]) == ([x for x in every if x != 3], [(at[3], 30)])
    noise = random.Random(1).randbytes(1 << 19) + b"\x1f\x8b\x08\x00WARC/1.0\r\n"
    assert _salvaged(tmp_path, data[: at[6]] + noise + data[at[6] :]) == (every, [(at[6], len(noise))])
    assert _salvaged(tmp_path, noise + data + noise)[0] == every
    assert _salvaged(tmp_path, noise) == ([], [(0, len(noise))])
    assert _salvaged(tmp_path, b"") == ([], [])


def test_a_bad_length_and_a_record_inside(tmp_path):
    data, at = _archive(False)
    one = data[at[2] : at[3]]
    n = one.split(b"Content-Length: ")[1].split(b"\r\n")[0]
    long_ = data[: at[2]] + one.replace(b"Content-Length: " + n, b"Content-Length: 9" + n, 1) + data[at[3] :]
    got, gaps = _salvaged(tmp_path, long_)
    assert got == [x for x in range(12) if x != 2] and len(gaps) == 1
    # a sound record's payload may hold a record; one whose digest fails is left as a whole
    inner = data[at[5] : at[6]]
    outer = warc.page_record(99, None, hashlib.sha1(inner).hexdigest(), len(inner), inner, None, "2020-01-01T00:00:00Z")
    assert _salvaged(tmp_path, outer + data)[0] == [99, *range(12)]
    broken = outer.replace(b"HTTP/1.1 200 OK", b"HTTP/1.1 201 OK", 1)
    assert _salvaged(tmp_path, broken + data) == (list(range(12)), [(0, len(broken))])


def test_members_with_several_records_and_foreign_fields(tmp_path):
    data, _ = _archive(False)
    (tmp_path / "x.warc").write_bytes(gzip.compress(data))
    assert [r["headers"]["page-id"] for r in warc.salvage_file(str(tmp_path / "x.warc"))] == [str(i) for i in range(12)]
    plain = b"WARC/1.0\nwarc-type: resource\nX-Folded: a\n b\nContent-Length: 3\n\nabc\r\n\r\n"
    (tmp_path / "y.warc").write_bytes(plain)
    (r,) = warc.salvage_file(str(tmp_path / "y.warc"))
    assert r["record_type"] == "resource" and r["headers"]["x-folded"] == "a b" and r["payload_bytes"] == 3
    (tmp_path / "z.warc").write_bytes(plain[:-4] + zlib.compress(b"no"))
    (g,) = warc.salvage_file(str(tmp_path / "z.warc"))
    assert g["gap"] == "record is cut off" or g["gap"].startswith("no line breaks")
