import base64
import gzip
import hashlib

import pytest

from timeloom.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [(1, "http://a/ü\r\nX: y", "same"), (9, "http://b", "same"), (4, None, "same"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n é😀" * 2000), (8, "u", "single\r\n\r\nbody")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    got = {r["page_id"]: r for r in warc.round_trip(frame(spark)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        body = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(body), digest(body))
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if i in (1, 4, 9, 5, 6)} == {1: ("revisit", 9), 4: ("revisit", 9), 9: ("response", None), 5: ("revisit", 6), 6: ("response", None)}
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(frame(spark), min_bytes=1).collect()}
    assert small[5] == "response" and small[1] == "revisit"


def test_predicates_are_decided_on_headers(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_pages(frame(spark), path)
    df = warc.read(spark, path)
    few = df.filter("record_type = 'revisit'")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    # what the reader decides is left out of Spark's own filters
    assert few.count() == 3 and "Filter (" not in plan(few) and "Filter (" in plan(df.filter("content_length > 3"))
    both = warc.records(spark, path)
    assert "Filter (" not in plan(both) and sorted(map(tuple, both.drop("payload").collect())) == sorted(map(tuple, df.drop("payload").collect()))
    assert df.filter(df.payload_digest.isin(digest(b"same"))).count() == 3
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 3)]))
    assert len(kept) == 1 and reader.wanted == [("warc-type", {"response"})]
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 4
    assert warc.read(spark, path, payload=False).filter("payload is not null").count() == 0


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_pages(frame(spark), str(path))
    (path / "part-lost.warc").write_bytes(warc.record("response", "<urn:x-page:77>", "u", "D", 1, b"x", None))
    assert warc.read(spark, str(path)).count() == len(PAGES)
    other = tmp_path / "v"
    other.mkdir()
    (other / "x.warc").write_bytes(warc.record("response", "<urn:x-page:77>", "u", "D", 1, b"x", None)[:-10])
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, str(other)).collect()


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_records_that_end_with_a_read(spark):
    pages = [(k, "u", "x" * n) for k, n in enumerate(range(65_000, 65_300, 3))]
    got = {r["page_id"]: r for r in warc.round_trip(frame(spark, pages)).collect()}
    assert {k: r["payload_bytes"] for k, r in got.items()} == {k: len(h) for k, _, h in pages}
    assert all(got[k]["payload_digest"] == digest(h.encode()) for k, _, h in pages)
    blocks = [warc.record("response", "<urn:x-page:1>", "u", "D", n, b"y" * n, None) for n in range(65_000, 65_300)]

    class File:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            self.at, out = self.at + n, self.data[self.at : self.at + n]
            return out

        def seek(self, at):
            self.at = at

        def tell(self):
            return min(self.at, len(self.data))

    for wanted in (True, False):
        seen = [len(block()) if wanted else 1 for _, block in warc.Records(File(b"".join(blocks)))]
        assert len(seen) == len(blocks)


def test_a_second_write_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "w")
    ids = lambda: sorted(r["record_id"] for r in warc.read(spark, path).select("record_id").collect())
    warc.write_pages(frame(spark, [(1, "u", "a")]), path)
    warc.write_pages(frame(spark, [(2, "u", "b")]), path)
    assert ids() == ["<urn:x-page:1>", "<urn:x-page:2>"]
    warc.records_of(frame(spark, [(3, "u", "c")])).write.format("warc").mode("overwrite").save(path)
    assert ids() == ["<urn:x-page:3>"]


def test_compressed_archives(spark, tmp_path):
    rows = [(1, b"a"), (2, b"b" * 200_000), (3, b"c")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(warc.record("response", f"<urn:x-page:{k}>", "u", "D", len(b), b, None)) for k, b in rows))
    assert {(r["record_id"], bytes(r["payload"])) for r in warc.read(spark, str(tmp_path)).collect()} == {(f"<urn:x-page:{k}>", b) for k, b in rows}
    assert warc.read(spark, str(tmp_path), payload=False).count() == 3
