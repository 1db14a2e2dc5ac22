import base64
import hashlib
import io

import pytest
import zstandard

from opinaria.llm.warc import Bundle, bundle_folder, fetch, page_of, parse_record, read_bundles, record_bytes, seek_table, write_bundles

HTML = ["<p>a</p>", "", None, "é😀" * 300, "x\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "y" * 70_000]
URLS = ["http://a.de/x", None, "http://b.fr/\r\nWARC-Type: fake", "", "http://ü.de/%20 ?q=1#f"]


def pages(spark):
    rows = [(k, URLS[k % len(URLS)], HTML[k % len(HTML)], "x", k) for k in range(60)]
    rows += [(3, None, "<p>a</p>", "x", 1), (None, "u", "<p>a</p>", "y", 2), (None, None, "only here", None, 3), (None, None, "only here", None, 3), (70, "u", "lone", "z", 4), (70, "u", "lone", "z", 4)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string, row int").repartition(5)


def expected(rows, least=0):
    """(page_id, size, digest, type, refers_to) by the definition."""
    first, out = {}, []
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page, _, html, *_ in ordered:
        data = (html or "").encode()
        known = data in first and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if known else "response", first[data] if known else None))
        first.setdefault(data, page)
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    rows, df = pages(spark)
    index = write_bundles(df, bundle_folder(df), min_revisit_bytes=least, frame_bytes=500, bundle_bytes=600)
    got = read_bundles(index).collect()
    digests = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(digests, key=key) == sorted(expected(rows, least), key=key)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert (r.page_id, bytes(r.payload)) in {(x[0], (x[2] or "").encode()) for x in rows}
    assert {(r.page_id, r.target_uri) for r in got} == {(x[0], x[1]) for x in rows}
    assert index.select("bundle").distinct().count() > 5


def test_frames_are_independent_and_files_are_plain_zstandard(spark):
    rows, df = pages(spark)
    index = write_bundles(df, bundle_folder(df), frame_bytes=2000)
    places = index.collect()
    assert len(places) == len(rows) and max(p.frame for p in places) > 1
    for path in {p.bundle for p in places}:
        bundle = Bundle(path)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path.removeprefix("file://"), "rb").read()), read_across_frames=True).read()
        assert whole == b"".join(bundle.frame(k) for k in range(len(bundle.sizes)))
        for p in places:
            if p.bundle == path:
                record, _, end = parse_record(bundle.frame(p.frame), p.offset)
                assert record["warc-record-id"] == p.record_id and end == p.offset + p.length and page_of(p.record_id) == p.page_id
        bundle.close()


def test_fetch_by_id(spark):
    rows, df = pages(spark)
    index = write_bundles(df, bundle_folder(df), frame_bytes=2000)
    got = fetch(index, spark.createDataFrame([(6,), (4,), (4,), (999,), (None,)], "page_id long")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(4, HTML[4].encode()), (6, HTML[6].encode())]


def test_empty_table_and_faults(spark, tmp_path):
    _, df = pages(spark)
    index = write_bundles(df.limit(0), bundle_folder(df))
    assert index.collect() == [] and read_bundles(index).collect() == [] and fetch(index, df).collect() == []
    record = record_bytes(0, 1, None, b"abc", 3, hashlib.sha1(b"abd").digest(), None, "1970-01-01T00:00:00Z")
    packed = zstandard.ZstdCompressor().compress(record)
    (tmp_path / "x.warc.zst").write_bytes(packed + seek_table([(len(packed), len(record))]))
    broken = spark.createDataFrame([(str(tmp_path / "x.warc.zst"),)], "bundle string")
    with pytest.raises(Exception, match="does not have its digest"):
        read_bundles(broken).collect()
    with pytest.raises(ValueError, match="cut off"):
        parse_record(record[:-5])
    (tmp_path / "y").write_bytes(packed)
    with pytest.raises(ValueError, match="no seek table"):
        Bundle(str(tmp_path / "y"))
