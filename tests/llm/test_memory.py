"""What a worker process holds between its tasks."""

import re
from pathlib import Path

from sqlatlas.llm import common


def test_workers_give_back_what_a_task_freed():
    """Small blocks with a kept one on top stay with the allocator until it is told."""

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10

    kept = []

    @common.tidy
    def run(batches):
        blocks = [b"x" * 100_000 for _ in range(2_000)]
        kept.append(bytes(2_000))
        peaks.append(held())
        del blocks
        yield from batches

    peaks = []
    before = held()
    assert list(run(iter([1, 2]))) == [1, 2]
    assert peaks[0] - before > 150 and held() - before < 50
