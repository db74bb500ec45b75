"""Damage inside gzip members of several records."""

import gzip
import random

import pyarrow as pa
import pytest

from clinspark.llm.warc import Salvage, WarcOptions, digest, record


def one(k):
    payload = random.Random(k).randbytes(3000)
    return record(k, "u", payload, None, digest(payload), WarcOptions(compress=False))


def read(path, data):
    path.write_bytes(data)
    rows = list(Salvage(pa.OSFile(str(path)), len(data)).rows())
    return [r["page_id"] for r in rows if r["kind"] == "record"], [r for r in rows if r["kind"] == "gap"]


def test_broken_record_in_the_middle_of_a_member(tmp_path):
    middle = bytearray(one(1))
    middle[len(middle) // 2] ^= 0x55
    first = gzip.compress(one(0) + bytes(middle) + one(2), mtime=0)
    ids, gaps = read(tmp_path / "a", first + gzip.compress(one(3), mtime=0))
    assert ids == [0, 2, 3]
    assert [(g["at"], g["size"]) for g in gaps] == [(0, len(first))]
    assert f"bytes {len(one(0))} to {len(one(0)) + len(middle)}" in gaps[0]["reason"]


@pytest.mark.parametrize("level", [0, 6])
def test_truncated_and_flipped_members_keep_whole_records(tmp_path, level):
    whole = gzip.compress(b"".join(map(one, range(3))), level, mtime=0)
    after = gzip.compress(one(3), mtime=0)
    ids, gaps = read(tmp_path / "cut", whole[:-500])
    assert ids == [0, 1] and [(g["at"], g["size"]) for g in gaps] == [(0, len(whole) - 500)]
    ids, gaps = read(tmp_path / "crc", whole[:-8] + bytes(8) + after)
    assert ids == [0, 1, 2, 3] and [(g["at"], g["size"]) for g in gaps] == [(0, len(whole))]
