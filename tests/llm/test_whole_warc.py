"""Records of long headers."""

import numpy as np
import pytest

from driftlake.llm import warc
from driftlake.llm.common import prepare, shared_folder


def test_records_with_very_long_urls_are_read(spark):
    prepare(spark)
    url = "http://x/" + np.random.default_rng(4).bytes(100_000).hex()
    rows = [(1, url, "one"), (2, "http://x/2", "two"), (3, url + "3", "one")]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared_folder(spark, "warc"))
    for step in (50_000, 1 << 22):
        got = warc.read_archives(files, range_bytes=step).collect()
        assert sorted((int(r.record_id), r.url) for r in got) == [(i, u) for i, u, _ in rows]


def archive(spark, tmp_path, payloads):
    prepare(spark)
    rows = spark.createDataFrame([(i, f"http://x/{i}", p) for i, p in payloads], "page_id long, url string, html string")
    files = warc.write_archives(rows.coalesce(1), f"file://{tmp_path}/archives")
    (path, size), = [tuple(r) for r in files.collect()]
    return path, size


def test_damaged_archives_raise_or_are_skipped(spark, tmp_path):
    path, size = archive(spark, tmp_path, [(i, np.random.default_rng(i).bytes(3000).hex()) for i in range(6)])
    local = path.removeprefix("file://")
    whole = open(local, "rb").read()
    places = sorted(r.place for r in warc.read_archives(spark.createDataFrame([(path, size)], "path string, bytes long")).collect())
    broken = bytearray(whole)
    broken[places[2] + 2000 : places[2] + 2100] = bytes(100)
    for name, data, left in (("cut", whole[: places[5] + 1500], 5), ("broken", bytes(broken), 5)):
        open(f"{local}.{name}", "wb").write(data)
        files = spark.createDataFrame([(f"{path}.{name}", len(data))], "path string, bytes long")
        with pytest.raises(Exception, match="the record at byte"):
            warc.read_archives(files).collect()
        got = warc.read_archives(files, skip_damaged=True).collect()
        assert len(got) == left and all(r.payload_bytes == 6000 for r in got)


def test_missing_and_repeated_ids(spark, tmp_path):
    path, size = archive(spark, tmp_path, [(None, "same"), (3, "same"), (3, "same"), (1, "same"), (None, "other"), (2, None)])
    got = warc.read_archives(spark.createDataFrame([(path, size)], "path string, bytes long")).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got) == [
        ("", "response", None), ("", "response", None), ("1", "revisit", "3"), ("2", "response", None), ("3", "response", None), ("3", "response", None),
    ]
