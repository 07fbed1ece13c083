"""What bounds the memory of a Python worker: wide rows come in small batches, and few of them are Python objects at once."""

import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest

from harrow.operators import extract
from harrow.plans import catalogue
from harrow.session import ARROW_ROWS
from harrow.sources import warc


@pytest.mark.parametrize("asked, used", [("10000", "500"), ("777", "777")])
def test_pages_come_in_small_batches(spark, folder, asked, used):
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, asked)
    try:
        catalogue.page_titles(spark, folder)
        assert spark.conf.get(ARROW_ROWS) == used
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_pages_of_a_large_batch_are_read_in_slices(monkeypatch):
    seen = []
    read = extract._read_some
    monkeypatch.setattr(extract, "_read_some", lambda pages: seen.append(len(pages)) or read(pages))
    html = pa.array([None if n % 7 == 3 else f"<title>t{n}</title>" for n in range(450)])
    found = extract._read_pages.func(html).to_pylist()
    assert max(seen) <= 100 and sum(seen) == 450
    assert [None if row is None else row["title"] for row in found] == [None if n % 7 == 3 else f"t{n}" for n in range(450)]
    assert len(extract._read_pages.func(html.slice(0, 0))) == 0


class _Counted:
    """A batch that notes how many of its rows become Python objects at once."""

    def __init__(self, batch, seen):
        self.batch, self.seen, self.num_rows = batch, seen, batch.num_rows

    def slice(self, at, rows):
        return _Counted(self.batch.slice(at, rows), self.seen)

    def to_pylist(self):
        self.seen.append(self.num_rows)
        return self.batch.to_pylist()


def test_records_of_a_large_batch_are_written_in_slices(tmp_path):
    seen = []
    batch = pa.RecordBatch.from_pylist([{"doc_id": n, "url": f"u{n}", "record": b"r" * n} for n in range(450)])
    written = warc._ArchiveWriter(str(tmp_path), 10 ** 9).write(iter([_Counted(batch, seen)]))
    assert max(seen) <= 100 and sum(seen) == 450
    rows = pa.parquet.read_table(f"{tmp_path}/manifest/{written.manifest}").to_pylist()
    assert [row["doc_id"] for row in rows] == list(range(450))
