"""The README's tables, the labels and the code agree, in both directions."""

import re
from pathlib import Path

from needledrop import labels, oracles
from needledrop.queries import queries
from needledrop.rules import Rules

ROOT = Path(__file__).parent.parent
TEXT = (ROOT / "README.md").read_text(encoding="utf-8")


def table(first):
    """The cells of the rows of the README's table with this first heading."""
    lines = TEXT.split("\n")
    at = next(i for i, x in enumerate(lines) if x.startswith(f"| {first} |"))
    rows = []
    for line in lines[at + 2 :]:
        if not line.startswith("|"):
            break
        rows.append([c.strip().strip("`") for c in line.strip("|").split("|")])
    return rows


def test_every_sub_case_is_in_the_readme():
    rows = table("type")
    assert {(t, "" if s == "–" else s) for t, s, *_ in rows} == set(labels.SUBTYPES)
    for t, s, label, action, work in rows:
        assert label == labels.SUBTYPES[t, "" if s == "–" else s]
        assert action in labels.ACTIONS and work == ("look" if action in labels.ADVISORY else "work")
    assert [t for t in dict.fromkeys(r[0] for r in rows)] == list(labels.TYPES)


def test_every_action_has_its_label_and_template():
    assert set(labels.ACTIONS) == set(labels.HOW_TO) and set(labels.ADVISORY) < set(labels.ACTIONS)
    assert oracles.TYPES == labels.TYPES and oracles.ACTIONS == labels.ACTIONS


def test_every_rule_is_in_the_readme():
    rows = {r[0]: r[1] for r in table("rule")}
    from dataclasses import asdict

    assert rows == {k: str(v) for k, v in asdict(Rules()).items()}


def test_no_detector_reports_a_kind_without_a_label():
    source = "".join(p.read_text() for p in (ROOT / "needledrop" / "operators").glob("*.py"))
    kinds = set(re.findall(r'finding\(\s*\w+(?:\.\w+\([^)]*\))?, \d+, "(\w+)"', source))
    assert kinds == set(labels.TYPES)


def test_every_query_that_the_readme_names_is_there():
    named = {n for n in re.findall(r"`([a-g]_\w+)`", TEXT)}
    assert named <= set(queries())
