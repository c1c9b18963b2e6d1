"""The stored index of decontamination: how wide its lists are, and how much of it stands in memory at once."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest

from roadflow.llm import decontamination as dc
from roadflow.llm.common import Scratch, map_batches, settings


@pytest.mark.parametrize("n, unit", [(0, 2), (1, 2), (65_535, 2), (65_536, 4), (70_000, 4)])
def test_lists_are_as_wide_as_the_segment_needs(n, unit):
    rng = np.random.default_rng(n)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, m)).encode() for m in (n // 3, n - n // 3)]
    segment = dc.Segment.of(texts)
    terms, starts, positions, ends = segment.packed()
    assert len(positions) == unit * n and len(starts) == unit * (len(segment.terms) + 1)
    again = dc.Segment.unpacked(terms, starts, positions, ends)
    for name in ("terms", "starts", "positions", "ends"):
        assert np.array_equal(getattr(again, name), getattr(segment, name))


def test_index_is_written_and_read_in_small_buffers(spark):
    """40 long rows went into one row group, and to Python in one batch."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    rows = []
    for k in range(40):
        text = letters[rng.integers(0, 26, dc.SEGMENT_BYTES)]
        text[5::6] = 32
        rows.append((k, -k, text.tobytes().decode()))
    own = {k: spark.conf.get(k, None) for k in dc.PASSED | dc.WRITTEN | dc.READ}
    index = dc.build_index(spark.createDataFrame(rows, "one long, two long, text string").coalesce(1), Scratch(spark, "test"))
    (part,) = glob.glob(f"{index._scratch_path.removeprefix('file:')}/*.parquet")
    meta = pq.read_metadata(part)
    assert meta.num_rows == 40 and meta.num_row_groups > 1
    assert max(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)) < 2 * dc.WRITTEN["parquet.block.size"]

    def sizes(batch):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    with settings(spark, dc.PASSED | dc.READ):
        seen = [r["n"] for r in map_batches(index.coalesce(1), sizes, "n long").collect()]
    assert len(seen) > 1 and max(seen) < 2 * dc.PASSED["spark.sql.execution.arrow.maxBytesPerBatch"]
    assert own == {k: spark.conf.get(k, None) for k in own}
