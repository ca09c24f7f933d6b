"""A tag's value of any length makes a pair."""

import random

from ledgerlens.llm import secret_scan


def test_long_tag_value():
    rng = random.Random(5)
    body = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(9000))
    text = f"x <privateKey>{body}</privateKey> " + "<a>" * 20000
    assert [text[s.start:s.end] for s in secret_scan.scan_text(text.encode()) if s.kind == 3] == [body]
