"""Block gzip: ranges of any size give each line once, in order."""

import gzip
import io
import random

import pytest

from readsieve.sources import blocks, read_alignments, readers
from tests.test_files import lines


def packed(text: bytes, sizes) -> bytes:
    """Members of the given sizes of text, over and over."""
    out, at, i = [], 0, 0
    while at < len(text):
        n = sizes[i % len(sizes)]
        out.append(blocks.member(text[at : at + n]))
        at, i = at + n, i + 1
    return b"".join(out) + blocks.END


@pytest.mark.parametrize("seed", range(6))
def test_every_line_once(seed):
    rng = random.Random(seed)
    text = b"\n".join(bytes(rng.choice(b"abc\x1f\x8b") for _ in range(rng.choice([0, 1, 5, 40, 700]))) for _ in range(60))
    text += rng.choice([b"", b"\n"])
    data = packed(text, rng.choice([[1, 0, 3], [10], [50, 2000], [17, 1, 0, 90]]))
    assert gzip.decompress(data) == text
    for step in (1, 7, 40, 333, 5000, len(data), 10**9):
        if step < 40 and len(data) > 8000:
            continue
        found = [x for at in range(0, len(data), step) for x in blocks.lines_of_range(io.BytesIO(data), at, at + step, len(data))]
        assert found == text.splitlines()


def test_members_of_any_text():
    rng = random.Random(1)
    text = rng.randbytes(200_000)  # does not pack
    data = b"".join(blocks.members([text[:5], text[5:150_000], b"", text[150_000:]]))
    assert gzip.decompress(data) == text and data.endswith(blocks.END)
    # text that holds whole members, stored as it is: only the real ones are found
    inner = blocks.member(b"x" * 50)
    for at in range(1, 40):
        assert blocks.first_member(io.BytesIO(inner + inner + blocks.END), at, 2 * len(inner) + len(blocks.END)) == len(inner) if at <= len(inner) else True


def test_broken_members():
    data = bytearray(packed(b"a\nb\n" * 100, [100]))
    data[-60] ^= 1  # in the last member but the empty one
    with pytest.raises(ValueError, match="broken|no block"):
        list(blocks.lines_of_range(io.BytesIO(bytes(data)), 0, len(data), len(data)))


def test_alignments_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "LEAST_PARTITION", 500)
    text = "".join(x + "\n" for x in lines(2000)).encode()
    folder = tmp_path / "hits"
    folder.mkdir()
    (folder / "a.m8.gz").write_bytes(packed(text, [700, 3, 64_000]))
    (folder / "b.m8.gz").write_bytes(packed(b"\n" + lines(3)[2].encode(), [11]))
    df = read_alignments(spark, str(folder))
    assert df.rdd.getNumPartitions() > 1
    got = df.orderBy("ordinal").collect()
    (tmp_path / "plain.m8").write_bytes(text)
    plain = read_alignments(spark, str(tmp_path / "plain.m8"))
    assert [r[:-1] for r in got[:-1]] == [r[:-1] for r in plain.orderBy("ordinal").collect()] and got[-1]["queryId"] == "q2"
    assert len({r["ordinal"] for r in got}) == 2001 and df.schema == plain.schema


def test_errors_and_other_gzip(spark, tmp_path):
    (tmp_path / "bad.m8.gz").write_bytes(packed((lines(1)[0] + "\nq1\ts1\n").encode(), [20]))
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        read_alignments(spark, str(tmp_path / "bad.m8.gz")).collect()
    with gzip.open(tmp_path / "usual.m8.gz", "wt") as f:
        f.write("\n".join(lines(5)))
    assert blocks.read_lines(spark, [(f"file://{tmp_path}/usual.m8.gz", 10)], 100) is None
    assert blocks.read_lines(spark, [("unknown-store://x/usual.m8.gz", 10)], 100) is None
    assert read_alignments(spark, str(tmp_path / "usual.m8.gz")).count() == 5
