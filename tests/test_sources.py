"""Byte ranges of float files."""

from __future__ import annotations

import numpy as np
import pytest

from gamelode.sources import files as S


def test_a_file_with_a_header_is_many_tasks(spark, tmp_path):
    m = np.arange(3000, dtype="<f4").reshape(1000, 3) / 7
    path = tmp_path / "m.npy"
    path.write_bytes(b"header of some bytes" + m.tobytes())
    df = S.read_f32_matrix(spark, str(path), 3, rows=1000, range_bytes=12 * 250)
    assert df.rdd.getNumPartitions() == 4
    got = {r.vector_index: r.vector for r in df.collect()}
    assert sorted(got) == list(range(1000)) and all(np.array_equal(np.array(got[k], dtype="<f4"), m[k]) for k in range(1000))
    bare = tmp_path / "bare.f32"
    bare.write_bytes(m.tobytes())
    assert S.read_f32_matrix(spark, str(bare), 3, range_bytes=1).rdd.getNumPartitions() == 1000
    assert S.read_f32_matrix(spark, str(bare), 3).count() == 1000
    with pytest.raises(ValueError):
        S.read_f32_matrix(spark, str(path), 3)


def test_a_folder_of_files_and_none(spark, tmp_path):
    for k, n in enumerate((5, 0, 7)):
        (tmp_path / f"part-{k}.f32").write_bytes(np.full((n, 2), k, dtype="<f4").tobytes())
    got = [(r.vector_index, r.vector[0]) for r in S.read_f32_matrix(spark, str(tmp_path), 2, range_bytes=24).orderBy("vector_index").collect()]
    assert got == [(k, 0.0 if k < 5 else 2.0) for k in range(12)]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.f32").write_bytes(b"")
    assert S.read_f32_matrix(spark, str(tmp_path / "none"), 2).count() == 0
