"""Mapped arrays: open files, copies where the shared folder isn't mounted, and applications side by side."""

import os
import shutil

import numpy as np
import pytest

from epochlake.llm import hash_arrays


def test_maps_hold_no_descriptors(tmp_path, monkeypatch):
    monkeypatch.setattr(hash_arrays, "OPEN_SHARDS", 300)
    shards = 5_000
    for s in range(shards):
        np.array([s], "<u8").tofile(tmp_path / f"{s:06d}.key")
        np.array([s / 2], "<f4").tofile(tmp_path / f"{s:06d}.val")
    table, before = hash_arrays.HashTable(str(tmp_path), shards, 1), len(os.listdir("/proc/self/fd"))
    for s in range(shards):
        keys, values = table.shard(s)
        assert (int(keys[0]), float(values[0, 0])) == (s, s / 2)
    assert len(os.listdir("/proc/self/fd")) < before + 100 and len(table.open) == 300
    assert int(table.shard(3)[0][0]) == 3  # mapped anew
    np.zeros(0, "<u8").tofile(tmp_path / "empty")
    assert len(hash_arrays.map_file(str(tmp_path / "empty"), "<u8")) == 0


@pytest.fixture()
def unmounted(tmp_path, monkeypatch):
    """Shared folders of two applications that workers can only copy from."""
    monkeypatch.setattr(hash_arrays, "_mounted", lambda uri: None)
    monkeypatch.setattr(hash_arrays.tempfile, "gettempdir", lambda: str(tmp_path / "host"))
    monkeypatch.setattr(hash_arrays, "_CACHE", {})
    uris = []
    for app in ("epochlake-app-1", "epochlake-app-2"):
        for t in ("first", "second"):
            (tmp_path / app / t).mkdir(parents=True)
            np.arange(4, dtype="<u8").tofile(tmp_path / app / t / "x")
            uris.append(f"file://{tmp_path}/{app}/{t}/x")
    return uris


def test_copies_of_other_applications_stay(unmounted):
    one, two, other, _ = unmounted
    folder = lambda uri: hash_arrays._copy_folder(uri.rpartition("/")[0])
    hash_arrays.map_file(other, "<u8")  # by a worker of the other application
    own = hash_arrays.worker_cache(one.rpartition("/")[0], lambda: hash_arrays.map_file(one, "<u8"))
    assert os.path.isdir(folder(one)) and os.path.isdir(folder(other))
    hash_arrays.worker_cache(two.rpartition("/")[0], lambda: hash_arrays.map_file(two, "<u8"))
    assert not os.path.isdir(folder(one)) and os.path.isdir(folder(two)) and os.path.isdir(folder(other))
    assert own.tolist() == [0, 1, 2, 3]  # still readable where it is mapped


def test_a_copy_that_is_cleared_meanwhile_is_made_again(unmounted, monkeypatch):
    one, cleared, replace = unmounted[0], [], os.replace

    def raced(a, b):
        if not cleared:
            cleared.append(b)
            shutil.rmtree(os.path.dirname(b))  # another worker has turned to another table
        replace(a, b)

    monkeypatch.setattr(hash_arrays.os, "replace", raced)
    assert hash_arrays.map_file(one, "<u8").tolist() == [0, 1, 2, 3] and cleared
