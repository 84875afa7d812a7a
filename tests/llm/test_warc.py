"""Archives: exact round trips, offsets, and what isn't whole."""

import glob
import gzip
import hashlib
import io
import uuid

import pytest
from lacuna.llm import warc
from lacuna.llm.common import new_folder
from pyspark.errors import PythonException
from pyspark.sql import functions as F

LONG = "é" * 80
ROWS = [
    (5, "http://a.org/x y", LONG),
    (3, "http://b.org/\r\nX: 1", LONG),
    (9, None, LONG),
    (1, "http://c.org/", "short"),
    (2, "http://c.org/", "short"),
    (7, "http://d.org/", None),
    (8, "http://d.org/", ""),
    (None, "http://e.org/", LONG),
    (11, "http://f.org/", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9),
    (12, "http://f.org/", "\n\n" + "y" * 3_000_000 + "\r\n\r\n"),
    (12, "http://f.org/", "another text of the same page"),
    (3, "http://b.org/", LONG),
    (-4, "http://g.org/", "z" * 99),
    (-5, "http://g.org/", "z" * 99),
    (-6, "http://g.org/", "z" * 100),
    (-7, "http://g.org/", "z" * 100),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "value": F.lit("y"), "_n": F.lit(1)})


def plain(rows):
    first = {}
    for key, _, text in rows:
        if key is not None and len((text or "").encode()) >= 100:
            first[text] = min(key, first.get(text, key))
    out = []
    for key, _, text in rows:
        data = (text or "").encode()
        to = first.get(text)
        again = to is not None and key != to
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ROWS, ROWS[7:8] * 3, []], ids=["all", "null keys", "empty"])
def test_round_trip(spark, rows):
    got = warc.archive_pages(frame(spark, rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_members_stand_alone(spark):
    written, folder = new_folder(spark), new_folder(spark)
    warc.write_archives(frame(spark, ROWS).repartition(2), written)
    index = warc.normalise(spark, written, folder)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(index).where("record_type = 'response' and payload_bytes > 100").collect()}
    assert payloads["<urn:page:11>"] == ROWS[8][2].encode()
    assert payloads["<urn:page:12>"] == ROWS[9][2].encode()
    assert payloads["<urn:page:3>"] == LONG.encode()
    for part in glob.glob(f"{written.removeprefix('file:')}/*.gz"):
        raw = open(part, "rb").read()
        name = part.rpartition("/")[2].split(".")[0]
        places = index.where(F.col("archive").contains(name)).orderBy("offset").collect()
        whole = open(f"{folder.removeprefix('file:')}/{name}.warc.gz", "rb").read()
        members = [gzip.decompress(whole[r["offset"] : r["offset"] + r["length"]]) for r in places]
        assert sum(r["length"] for r in places) == len(whole)
        assert b"".join(members) == gzip.decompress(raw)
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in members)


RECORD = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, lambda x: b"".join(gzip.compress(x[i : i + 50]) for i in range(0, len(x), 50))], ids=["plain", "one", "several"])
def test_any_packing(pack):
    sink = io.BytesIO()
    rows = list(warc.rewrite(io.BytesIO(pack(b"".join(RECORD % i for i in range(20)))), sink))
    assert [r[2] for r in rows] == [f"<urn:x:{i}>" for i in range(20)]
    for i, (offset, length, _, kind) in enumerate(rows):
        stream = io.BufferedReader(warc.Member(io.BytesIO(sink.getvalue()[offset:]), length))
        assert warc.parsed(stream, True) == (f"<urn:x:{i}>", "resource", None, None, 5, hashlib.sha256(b"ab\r\nc").hexdigest(), b"ab\r\nc")


@pytest.mark.parametrize("cut", [20, 70, 82])
def test_cut_archives(cut):
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.rewrite(io.BytesIO((RECORD % 1 + RECORD % 2)[: len(RECORD) - 1 + cut]), io.BytesIO()))


def test_wrong_payload(spark, tmp_path):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (folder / "a.warc.gz").write_bytes(gzip.compress(head % b"00"))
    index = warc.normalise(spark, str(folder), f"{folder}/out")
    with pytest.raises(PythonException, match="isn't what its record says"):
        warc.read_records(index).collect()
