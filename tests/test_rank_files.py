"""Rank files that go on in a next file."""

from evalweave.plans import preparation as P
from evalweave.sources.growing import sizes


def test_a_rank_writes_bounded_files(spark, sf, tmp_path):
    lines = [(r["file_no"], r["line_no"], r["line"]) for r in P.q(spark, sf, P.RANK_LINES).collect()]
    folder = str(tmp_path / "ranks")
    P._write_rank_files(spark, sf, folder, 0.5, segment=7)
    half = {p.name: p.read_bytes() for p in (tmp_path / "ranks").iterdir()}
    P._write_rank_files(spark, sf, folder, 1.0, segment=7)
    whole = {p: (tmp_path / "ranks" / p).read_bytes() for p in sizes(folder, "*.jsonl")}
    assert all(len(b.splitlines()) <= 7 for b in whole.values())
    assert all(whole[p].startswith(b) for p, b in half.items()) and len(half) < len(whole)
    for rank in {f for f, _, _ in lines}:
        text = b"".join(b for p, b in whole.items() if p.startswith(f"rank{rank:05d}-")).decode()
        assert text == "".join(f"{x}\n" for f, n, x in sorted(lines) if f == rank)
