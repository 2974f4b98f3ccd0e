"""Items at the edges of texts that are read in one batch."""

import numpy as np

from cohortlab.llm.decontaminate import Finder


def test_item_without_its_first_characters_behind_short_texts():
    item = bytes(97 + (i * i + i // 7) % 26 for i in range(100))
    for before in ([b""], [b"x" * 100, b""], [b"ab", b"", b"c"]):
        said = [*before, item[3:] + b" and more", b"", item[:-4]]
        off = np.concatenate([[0], np.cumsum([len(x) for x in said])])
        finder = Finder([(7, item)], 0.08)
        rows = {row: (start, distance) for row, _, start, _, distance in finder.find(np.frombuffer(b"".join(said), np.uint8), off)}
        assert rows == {len(before): (0, 3), len(before) + 2: (0, 4)}
