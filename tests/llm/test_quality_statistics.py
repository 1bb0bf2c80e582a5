from arborlake.llm import quality


def test_distinct_share_of_blocks_is_of_the_whole_text():
    at = quality.NAMES.index("block_distinct")
    words = [f"w{i}" for i in range(200)]
    assert quality.statistics(" ".join(words))[at] == 1
    assert quality.statistics(" ".join(words + ["same"] * 200 + ["same"] * 100))[at] == (1 + 1 / 200 + 1 / 100) / 3
