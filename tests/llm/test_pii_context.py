"""Personal data that needs context beyond the last match, or is written in groups."""

import pytest
from samples import frame

from needledrop.llm import pii

CASES = [
    ("SSNs: 123-45-6789, 234-56-7890", ["123-45-6789", "234-56-7890"]),
    ("SSN list: " + ", ".join(["123-45-6789"] * 12), ["123-45-6789"] * 12),
    ("SSN issued 2001-02-03 123-45-6789", ["123-45-6789"]),
    ("123-45-6789 is my social security number", ["123-45-6789"]),
    ("123-45-6789 and 234-56-7890 are social security numbers", ["123-45-6789", "234-56-7890"]),
    ("part 123-45-6789, " + "far from any word that tells what it is " * 2 + "ssn", []),
    ("pay to DE89 3704 0044 0532 0130 00 now", ["DE89 3704 0044 0532 0130 00"]),
    ("BE68 5390 0754 7034 IS MINE", ["BE68 5390 0754 7034"]),
    ("DE89370400440532013000 AND BE68 5390 0754 7034.", ["DE89370400440532013000", "BE68 5390 0754 7034"]),
    ("DE88 3704 0044 0532 0130 00", []),
]


@pytest.mark.parametrize("clash", [False, True])
def test_context_and_groups(spark, clash):
    data = [(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(CASES)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, data, clash)).collect()}
    for i, (t, want) in enumerate(CASES):
        assert [t[s["start"] : s["end"]] for s in got[i] if s["kind"] in ("ssn", "iban")] == want, t
