"""What tasks leave in a Python worker, and lines found by Arrow."""

import pathlib
import random
import re

import numpy as np
import pyarrow as pa

from gridstride.llm import common, lines


def own_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_tasks_give_memory_back():
    """After a task's last row a worker holds none of the memory that the task took."""

    @common.released
    def run(batches):
        for batch in batches:
            held = [pa.array(np.arange(k, k + 500)) for k in range(20_000)] + [bytes(5_000) for _ in range(20_000)]  # 180 MB
            yield batch.slice(0, len(held) and 1)

    @common.released_group
    def group(table):
        return table.slice(0, len([pa.array(np.arange(k, k + 500)) for k in range(20_000)]) and 1)

    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    list(run([batch]))
    common.release()
    before = own_mb()
    assert [b.num_rows for b in run([batch, batch])] == [1, 1]
    assert group(pa.table({"a": [1, 2]})).num_rows == 1
    assert own_mb() - before < 30


def test_lines_by_arrow():
    """Lines, their numbers and distinct ones are those of plain loops, for nulls, empty texts, slices and other line ends."""
    r = random.Random(8)
    texts = [None, "", "\n", "a\n\na", "\n\n b", "a\r\nb\x0bc\x85d e", " \xa0\n\t", None, *["\n".join(r.choice(["x", "", "y z", "é", "\x1c"]) for _ in range(r.randrange(9))) for _ in range(300)]]
    for some in (pa.array(texts, pa.string()), pa.array([None, *texts, "q"], pa.string()).slice(1, len(texts)), pa.array([], pa.string()), pa.array([None], pa.string())):
        plain = some.to_pylist()
        counts, found = lines._split(some)
        assert counts.tolist() == [len(t.split("\n")) if t is not None else 0 for t in plain]
        assert found.to_pylist() == [x for t in plain if t is not None for x in t.split("\n")]
        assert lines._distinct_lines(some) == {lines._line_hash(x): x for t in plain for x in lines.lines_of(t) if x and not x.isspace()}
