from claimloom.llm import splitting as S


def words(first, n):
    return " ".join(f"w{i}" for i in range(first, first + n))


def test_an_early_line_break_goes_before_a_late_comma():
    text = words(0, 15) + "\n" + words(15, 15) + ", " + words(30, 40)
    assert [p[2:] for p in S.split_plan(text, 40, 8)][0] == (0, 15)
    late = words(0, 15) + "\n" + words(15, 15) + ". W" + words(30, 40)
    assert S.split_plan(late, 40, 8)[0][3] == 30  # a sentence end in the later half stays
    early = words(0, 8) + "\n" + words(8, 60)
    assert S.split_plan(early, 40, 8)[0][3] == 40  # a piece must be longer than the overlap
