import base64
import hashlib
import re
import zlib

import pytest

from roadpulse.llm import warc as W
from roadpulse.llm.common import file_system, open_input, shared_folder

ROWS = [(i, f"http://x/{i}", f"<p>{i % 7}</p>") for i in range(40)] + [
    (50, None, None),
    (51, "http://x/a b\r\nX: y", ""),
    (52, "u", "é\U0001f600" * 50_000),
    (None, "u", "<p>3</p>"),
    (None, "u", "only without ids"),
    (None, "u", "only without ids"),
    (39, "http://x/39", "<p>4</p>"),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("roll", [500, W.ROLL_BYTES])
def test_round_trip(spark, roll):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, response string")
    folder = shared_folder(spark, "warc")
    manifest = W.write_archives(pages, folder, roll)
    got = W.read_archives(spark, folder, manifest).collect()
    want, first = [], set()
    for page, _, html in ROWS:
        ids = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        top = max(ids, default=None)
        response = top is None or (page == top and page not in first)
        if page == top:
            first.add(page)
        want.append((page, len((html or "").encode()), sha(html), "response" if response else "revisit", None if response else top))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    # What stands in the folder is what the manifest names, each file a run of ids.
    fs, root = file_system(folder)
    from pyarrow.fs import FileSelector

    names = {f.base_name for f in fs.get_file_info(FileSelector(root))}
    files = manifest.orderBy("file").collect()
    assert names == {r["file"] for r in files} and sum(r["n"] for r in files) == len(ROWS)
    order = []
    for r in files:
        with open_input(folder, r["file"]) as f:
            order += [int(h["X-Page-Id"] or -1) for h, _ in W.read_records(f, 64) if h["WARC-Type"] != "warcinfo"]
    assert order == sorted(order)


def test_archives_are_the_same_in_every_setting(spark):
    from pyarrow.fs import FileSelector

    written = []
    for partitions, shuffle in ((1, "2"), (7, "9")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        try:
            rows = ROWS if partitions == 1 else ROWS[::-1]
            pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
            folder = shared_folder(spark, "warc")
            W.write_archives(pages, folder, 2000, 8).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        fs, root = file_system(folder)
        written.append({f.base_name: fs.open_input_file(f.path).read() for f in fs.get_file_info(FileSelector(root))})
    assert written[0] == written[1] and len(written[0]) > 6


def test_a_range_of_ids_in_many_tasks(spark):
    """Tasks that share a range of ids lose nothing, and write nothing twice."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = {k: spark.conf.get(k) for k in (coalesce, "spark.sql.shuffle.partitions")}
    spark.conf.set(coalesce, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
        got = W.archive(pages.repartition(4)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["page_id"] for r in got) == list(range(300))


def test_ids_beyond_doubles(spark):
    low, top = 2**62 + 1, 2**62 + 3
    rows = [(low, "u", "same"), (top, "u", "same"), (None, "u", "same"), (-top, "u", "other")]
    got = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert got == {low: ("revisit", top), top: ("response", None), None: ("revisit", top), -top: ("response", None)}


def test_record_format():
    data = zlib.decompress(W.page_record(5, "http://x/", b"<p>", None), 31)
    head, _, block = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
    assert block.endswith(b"\r\n\r\n<p>\r\n\r\n")
    assert W.page_record(5, "u", b"x", None) == W.page_record(5, "u", b"x", None)


def test_torn_archive(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(W.page_record(1, "u", b"abc", None)[:-5])
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(W.read_records(f))


def test_empty(spark):
    assert W.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
