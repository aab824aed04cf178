"""What Python workers hold from task to task."""

import sys

import pytest

from tidewatch.llm import common
from tidewatch.llm.near_join import Shingler


@pytest.fixture(autouse=True)
def worker(monkeypatch):
    monkeypatch.delitem(sys.modules, "tidewatch_worker_state", raising=False)
    yield
    sys.modules.pop("tidewatch_worker_state", None)


def test_a_worker_holds_one_object():
    made = []
    for kind, key in (("a", 1), ("a", 1), ("b", 1), ("a", 2)):
        common.kept(kind, key, lambda: made.append((kind, key)) or made[-1])
    assert made == [("a", 1), ("b", 1), ("a", 2)]
    state = vars(sys.modules["tidewatch_worker_state"])
    assert {k: v for k, v in state.items() if not k.startswith("__")} == {"a": (2, ("a", 2))}


def test_full_caches_go_at_the_end_of_a_task(monkeypatch):
    monkeypatch.setattr(common, "REST", 3)
    for text, left in (("one two", 2), ("one two three four", 0), ("five", 1)):
        with common.remembering("shingler", 2, lambda: Shingler(2)) as known:
            assert len(known.shingles(text)) == max(1, len(text.split()) - 1)
        assert len(known) == left
    with pytest.raises(ValueError), common.remembering("shingler", 2, lambda: Shingler(2)) as known:
        known.shingles("a b c d e f")
        raise ValueError
    assert len(known) == 0
