"""The limit on the longest repeat holds for long texts too."""

from rulecast.llm import quality_rules


def test_long_text_fails_by_its_longest_repeat():
    def verdict(repeated, n=20_000):
        words = [f"w{i}" for i in range(n - repeated)]
        row = quality_rules.judge_texts([" ".join([*words, *words[:repeated]])])[0]
        return row[4], *row[5:]

    assert verdict(1900) == (3800, False, False, 1900)
    assert verdict(101) == (202, False, False, 101)
    assert verdict(100) == (200, False, True, 100)
