import datetime

from claimloom import queries
from claimloom.operators import sections


def text(first, n):
    return " ".join(f"w{i}" for i in range(first, first + n))


def test_a_section_cut_by_an_earlier_run_is_windowed_whole(spark, rows, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    table = rows(
        "point_id long, paper_id int, window_index int, window_count int, text string, loaded_at timestamp",
        (2003000, 2, 0, 9, text(0, 400), at), (2003001, 2, 1, 9, text(320, 400), at), (2003002, 2, 2, 9, text(640, 300), at), (2004000, 2, 0, 1, text(0, 900), at), (2005000, 2, 0, 1, None, at), (2006000, 2, 0, 2, text(0, 400), at), (2006001, 2, 1, 2, text(5000, 30), at),
    )
    table.write.parquet(str(tmp_path / "vector_chunks.parquet"))
    whole = {(r["paper_id"], r["chunk_idx"]): r["text"] for r in sections.whole_sections(table).collect()}
    assert whole == {(2, 3): text(0, 940), (2, 4): text(0, 900), (2, 5): "", (2, 6): text(0, 400) + " " + text(5000, 30)}
    got = {tuple(r) for r in queries.QUERIES["whole_window_ids"](spark, str(tmp_path)).collect()}
    counts = {3: 3, 4: 3, 5: 1, 6: 2}
    assert got == {(2000000 + c * 1000 + i, i, n) for c, n in counts.items() for i in range(n)}
    assert {r[0] for r in queries.QUERIES["whole_skip_existing"](spark, str(tmp_path)).collect()} == {2004001, 2004002}
