"""The shared read: rows equal those of separate reads, and a failing tap drops itself alone."""

import sys

import images
import oracle
import pytest
from blockwright.operators import carve
from blockwright.sources import facts, taps
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers know no test modules


def image(tmp_path):
    disk = images.camera_disk()[0] + images.program_stream([(90_000, 60)]) + bytes(9000) + b"\0\0\1\x65" * 50
    path = tmp_path / "disk.img"
    path.write_bytes(disk)
    return str(path), disk


@pytest.mark.parametrize("block,per_task", [(4096, 3), (1 << 16, 1), (8 << 20, 8)])
def test_one_read_equals_separate_reads(spark, tmp_path, block, per_task):
    path, disk = image(tmp_path)
    scan = taps.shared_scan(spark, path, block=block, per_task=per_task)
    for got, want in (
        (scan.block_map(), facts.block_map(spark, path, block)), (scan.frames(), facts.frames(spark, path, block)), (scan.packs(), facts.packs(spark, path, block)),
    ):
        assert oracle.rows(got.toPandas()) == oracle.rows(want.toPandas()) and not got.isEmpty()
    assert sorted(tuple(r)[1:] for r in scan.units().collect()) == sorted(carve.units_in(disk, 0, len(disk)))
    assert scan.failures().isEmpty() and scan.frames().count() == len(carve.frames_in(disk, 0, len(disk)))


class Counting(taps.Tap):
    """Bytes that this task saw, told at its end."""

    name, schema = "seen", "bytes long, blocks long"

    def begin(self, image):
        return [0, 0]

    def update(self, state, base, data, own, bad):
        state[0] += own
        state[1] += 1
        return []

    def finish(self, state):
        return [[x] for x in state]


class Failing(taps.Tap):
    name, schema = "failing", "offset long"

    def update(self, state, base, data, own, bad):
        if base >= 32_768:
            raise RuntimeError("no good")
        return [[base]]


def test_a_failing_tap_is_dropped_alone(spark, tmp_path):
    path, disk = image(tmp_path)
    scan = taps.shared_scan(spark, path, [Failing(), Counting(), taps.BlockFacts(4096)], block=4096, per_task=4)
    assert scan.rows("seen").agg({"bytes": "sum"}).first()[0] == len(disk)
    assert scan.block_map().count() == -(-len(disk) // 4096)
    failed = scan.failures().orderBy("failed_at").collect()
    assert failed[0]["failed_at"] == 32_768 and failed[0]["reason"] == "RuntimeError: no good" and {r["tap"] for r in failed} == {"failing"}
    assert len(failed) == -(-(len(disk) - 32_768) // (4 * 4096))  # one row for each task that dropped it
    with pytest.raises(ValueError, match="failing failed at 32768"):
        scan.rows("failing")
    assert [r[0] for r in scan.rows("failing", partial=True).orderBy("offset").collect()] == list(range(0, 32_768, 4096))


def test_taps_need_names_of_their_own(spark, tmp_path):
    with pytest.raises(ValueError):
        taps.shared_scan(spark, image(tmp_path)[0], [Counting(), Counting()])
