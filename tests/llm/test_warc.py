import gzip
import hashlib
import os
import random
import zlib

import duckdb
import pytest

from hardwood.llm.warc import SQL, archive_pages, list_archives, member, read_warc, record_index, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string"


def stored(*parts: bytes) -> bytes:
    """A member whose bytes stand in the file as they are."""
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    block = b"".join(parts)
    return pack.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:outer>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + pack.flush()


def files(spark, path):
    return list_archives(spark, str(path))


def test_table_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = warc_round_trip(pages.unionByName(pages.where("page_id % 3 = 0").selectExpr("page_id + 1000 as page_id", "url", "html")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 1000, url, html FROM '{sf}/pages.parquet' WHERE page_id % 3 = 0")
    want = con.execute(SQL)
    cols = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(rows, key=str)
    assert any(r[3] == "revisit" for r in rows)


def test_payloads_come_back_whole_at_every_split(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", "é\r\n\r\n\x1f", "x" * 99, "y" * 100, "y" * 100, "z" * 400_000] + ["".join(chr(rnd.randrange(32, 0x2FF)) for _ in range(rnd.randrange(3000))) for _ in range(30)]
    df = spark.createDataFrame([(k, None if k == 3 else f"http://h/{k}\nX: y", t) for k, t in enumerate(texts)], SCHEMA).coalesce(2)
    made = archive_pages(df, str(tmp_path / "a"))
    assert made.agg({"records": "sum"}).first()[0] == len(texts)
    for split in (37, 1000, 1 << 24):
        back = read_warc(made.select("file", "bytes"), split).collect()
        assert len(back) == len(texts)
        got = {int(r.record_id.split(":")[2]): r for r in back}
        for k, t in enumerate(texts):
            assert bytes(got[k].payload) == (b"" if k == 5 else (t or "").encode()) and got[k].digest == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[5].record_type == "revisit" and got[5].refers_to == got[4].record_id and got[3].target_uri is None and got[4].target_uri == "http://h/4%0AX: y"
    for name in os.listdir(tmp_path / "a"):
        with gzip.open(tmp_path / "a" / name) as f:  # any other reader can open them
            assert f.read(8) == b"WARC/1.1"


def test_archives_inside_a_payload_are_no_records(spark, tmp_path):
    inner = [member(f"urn:inner{k}", "response", os.urandom(300), None) for k in range(20)]
    plain = gzip.compress(b"no archive " * 50)
    first, last = member("urn:first", "response", b"a" * 500, None), member("urn:last", "response", b"b", None)
    whole = first + stored(b"text", *inner, plain) + b"junk \x1f\x8b\x08 junk" + plain + last
    (tmp_path / "n.warc.gz").write_bytes(whole)
    (tmp_path / "cut.warc.gz").write_bytes((first + last)[:-9])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "text.warc").write_bytes(b"WARC/1.0 plain")
    for split in (64, 701, 1 << 20):
        rows = sorted((os.path.basename(r.file), r.start, r.end) for r in record_index(files(spark, tmp_path), split).collect())
        at = len(first)
        assert rows == [("cut.warc.gz", 0, at), ("n.warc.gz", 0, at), ("n.warc.gz", at, whole.index(b"junk ")), ("n.warc.gz", len(whole) - len(last), len(whole))]
    assert sorted(r.record_id for r in read_warc(files(spark, tmp_path)).collect()) == ["urn:first", "urn:first", "urn:last", "urn:outer"]


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rows = [(None, None, "q" * 200), (7, "u", "q" * 200), (7, "u", "q" * 200), (8, "u", "q" * 200), (7, "u", "other"), (None, None, None), (3, None, "w" * 300), (None, "n", "v" * 300), (None, "n", "v" * 300)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", digest int, payload string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=str)
    assert got == sorted([(None, 200, "revisit", 7), (7, 200, "response", None), (7, 200, "response", None), (8, 200, "revisit", 7), (7, 5, "response", None),
                          (None, 0, "response", None), (3, 300, "response", None), (None, 300, "response", None), (None, 300, "response", None)], key=str)
    assert warc_round_trip(df.where("false")).collect() == []


def test_changed_payload_is_noticed(spark, tmp_path):
    from hardwood.llm.warc import archived_pages

    records = spark.createDataFrame([("urn:page:1:" + "0" * 64, "response", bytearray(b"x"), "0" * 64, None, None)], "record_id string, record_type string, payload binary, digest string, target_uri string, refers_to string")
    made = write_warc(records, str(tmp_path / "w"))
    with pytest.raises(Exception, match="differs from its digest"):
        archived_pages(made.select("file", "bytes")).collect()
