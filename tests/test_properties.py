"""Properties that hold for any input."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import globs
from millrace.operators import diff

LINES = st.lists(st.sampled_from(["a", "b", "c", "", "a b"]), max_size=12)


@given(LINES, LINES)
def test_diff_replays_both_sides(old, new):
    script = diff.line_diff(old, new)
    assert [x for k, x in script if k != "+"] == old and [x for k, x in script if k != "-"] == new


@given(LINES)
def test_diff_of_equal_texts_changes_nothing(lines):
    assert all(k == " " for k, _ in diff.line_diff(lines, lines))


@given(LINES, LINES)
@settings(max_examples=30)
def test_small_tables_still_replay(old, new):
    before = diff.MOST_CELLS
    diff.MOST_CELLS = 4
    try:
        script = diff.line_diff(old, new)
    finally:
        diff.MOST_CELLS = before
    assert [x for k, x in script if k != "+"] == old and [x for k, x in script if k != "-"] == new


SEGMENT = st.text("abAB.+_-", min_size=1, max_size=5)


@given(st.lists(SEGMENT, min_size=1, max_size=4))
def test_a_path_is_its_own_glob(parts):
    path = "/".join(parts)
    assert re.match(globs.pattern(path), path.swapcase())


@given(st.lists(SEGMENT, min_size=1, max_size=4), SEGMENT)
def test_star_stays_in_its_segment(parts, last):
    assert re.match(globs.pattern("/".join(["*"] * len(parts)) + "/" + last), "/".join([*parts, last]))
    assert not re.match(globs.pattern("/".join(["*"] * (len(parts) + 1)) + "/" + last), "/".join([*parts, last]))
    assert re.match(globs.pattern("**/" + last), "/".join([*parts, last])) and re.match(globs.pattern("**/" + last), last)
