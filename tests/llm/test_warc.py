import base64
import gzip
import hashlib
import io
import json

import pytest

from loomery.llm.shared import file_system
from loomery.llm.warc import read_archive, read_warc, record_bytes, write_warc


def brute(pages, revisit_from=0):
    first = {}
    for i, _, html in pages:
        b = (html or "").encode()
        if i is not None:
            first[b] = min(i, first.get(b, i))
    seen, out = set(), []
    for i, url, html in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        b = (html or "").encode()
        lead = i is None or len(b) < revisit_from or (first[b] == i and (i, b) not in seen)
        seen.add((i, b))
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if lead else "revisit", None if lead else first[b]))
    return sorted(out, key=str)


PAGES = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" + "z" * (i % 3) * 1000) for i in range(5, 60)] + [
    (1, None, None), (3, "http://a\r\nInjected: 1", ""), (4, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n"), (70, "u", "é" * 300_000), (71, "u", "é" * 300_000),
    (80, "b", "same"), (80, "a", "same"), (80, "c", "other"), (None, "n", "same"), (None, "n", "same"),
]


@pytest.mark.parametrize(("revisit_from", "roll"), [(0, 1 << 20), (10, 200)])
def test_round_trip(spark, tmp_path, revisit_from, roll):
    frame = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    write_warc(frame, f"file://{tmp_path}/w", revisit_from=revisit_from, roll_bytes=roll, shards=3)
    rows = read_warc(spark, f"file://{tmp_path}/w").collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == brute(PAGES, revisit_from)
    by_id = {r.page_id: r for r in rows}
    assert bytes(by_id[4].payload).decode() == PAGES[57][2] and bytes(by_id[70].payload).decode() == "é" * 300_000
    files = json.load(open(tmp_path / "w" / "manifest.json"))["files"]
    assert {f["name"] for f in files} | {"manifest.json"} == {p.name for p in (tmp_path / "w").iterdir()}
    assert all(hashlib.sha256((tmp_path / "w" / f["name"]).read_bytes()).hexdigest() == f["sha256"] for f in files)
    if roll == 200:
        assert len(files) > 10
    ids = [int(h["X-Page-ID"]) for f in files for h, _ in read_archive(open(tmp_path / "w" / f["name"], "rb")) if "X-Page-ID" in h]
    assert ids == sorted(ids)


def test_same_bytes_again(spark, tmp_path):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    shas = []
    for k in "ab":
        write_warc(frame, f"file://{tmp_path}/{k}", shards=2)
        fs, folder = file_system(f"file://{tmp_path}/{k}")
        shas.append([f["sha256"] for f in json.loads(fs.open_input_stream(f"{folder}/manifest.json").read())["files"]])
    assert shas[0] == shas[1]


def test_damage_is_seen():
    data = record_bytes(1, 0, "u", b"payload", None)
    assert [p for _, p in read_archive(io.BytesIO(gzip.compress(data)))] == [b"payload"]
    for bad in (data.replace(b"payload\r\n", b"paYload\r\n"), data[:-3], b"x" + data):
        with pytest.raises(ValueError):
            list(read_archive(io.BytesIO(gzip.compress(bad))))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(none, f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0
