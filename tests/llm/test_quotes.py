import pytest

from tidewatch.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string, lines string, thread string"


def link(spark, rows):
    out = link_quotes(spark.createDataFrame([(*r, "l", "t") for r in rows], SCHEMA))
    return sorted(out.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["turn"] is None, r["turn"]))


@pytest.fixture(scope="module")
def linked(spark):
    rows = [
        (1, 0, "user", "Where is the boat?\nIt was here."),
        (1, 1, "user", "Something else entirely"),
        (1, 2, "assistant", "On Monday, Ann wrote:\n> where  IS the boat?\n\nIn the harbour."),
        (1, 3, "user", "> > Where is the boat?\n> In the harbour.\nThanks"),
        (1, 4, "user", "> something else entirely\nYes\n> Thanks"),
        (1, 5, "user", "> never said\nNo"),
        (2, 0, "user", "> Where is the boat?\nother conversation"),
    ]
    return link(spark, rows)


def test_parents_and_threads(linked):
    assert [(r["reply_to"], r["thread"]) for r in linked] == [(None, 0), (None, 1), (0, 0), (2, 0), (1, 1), (None, 5), (None, 0)]


def test_texts_lose_quotes(linked):
    texts = ["Where is the boat?\nIt was here.", "Something else entirely", "In the harbour.", "Thanks", "Yes", "No", "other conversation"]
    assert [r["text"] for r in linked] == texts
    assert [r["n_quoted"] for r in linked] == [0, 0, 2, 2, 2, 1, 1] and [r["depth"] for r in linked] == [0, 0, 1, 2, 1, 1, 1]


def test_odd_rows(spark):
    rows = [(None, 0, None, "a"), (1, None, "user", "> a"), (1, 0, "user", None), (1, 1, "user", ""), (1, 1, "user", "> b"), (1, 1, "user", ""), (2, 0, "u", "x " * 50_000)]
    got = link(spark, rows)
    assert len(got) == len(rows) and all(r["reply_to"] is None for r in got)
    assert link(spark, []) == []


def test_long_chain_is_one_thread(spark):
    rows = [(1, t, "u", f"line {t}\n> line {t - 1}") for t in range(60)]
    assert [(r["reply_to"], r["thread"]) for r in link(spark, rows)] == [(None, 0)] + [(t - 1, 0) for t in range(1, 60)]


LONG = "The boat left the harbour at nine in the morning, with all of the crew on board"


def test_deeper_quotes_rewrapped_quotes_and_latest_owners_link(spark):
    rows = [
        (1, 0, "u", f"Hello there.\n{LONG} and nobody ashore."),
        (1, 1, "u", "> > Hello there.\nagain"),  # level 2 alone
        (1, 2, "u", "> The boat left the harbour\n> at nine in the\n> morning, with all of the crew\nreally"),  # wrapped anew
        (1, 3, "u", "> Hello\n> there.\nshort"),
        (1, 4, "u", "Hello there."),
        (1, 5, "u", "> Hello there.\nlatest owner"),
        (1, 6, "u", "Hello there.\n> hello there."),  # not itself
        (1, 7, "u", f"> > {LONG}\n> latest owner\nlevel 1 first"),
        (1, 8, "u", "> yes, we said there. was no boat\nno"),  # short own lines within an unknown quote
        (1, 9, "u", f"> Hello there.\n> {LONG}\nmost words"),
    ]
    assert [r["reply_to"] for r in link(spark, rows)] == [None, 0, 0, 0, None, 4, 4, 5, None, 0]


def test_many_lines_take_time_in_proportion(spark):
    """A message of 20,000 lines, every second one quoted, and the one it answers."""
    import time

    def took(n):
        said = "\n".join(f"line {k} says w{k} and w{k * 7} to you" for k in range(n // 2))
        answer = "\n".join(f"> line {k} says w{k} and w{k * 7} to you\nyes {k}" for k in range(n // 2))
        start = time.time()
        got = link(spark, [(1, 0, "a", said), (1, 1, "b", answer)])
        assert got[1]["reply_to"] == 0 and got[1]["n_quoted"] == n // 2 and got[1]["text"].count("\n") == n // 2 - 1
        return time.time() - start

    took(100)
    assert took(20_000) < 8 * took(5_000) + 5


def test_an_introduction_of_any_length(spark):
    who = "x" * 500
    got = link(spark, [(1, 0, "a", "Where is the boat now?"), (1, 1, "b", f"On Monday, {who} wrote{' ' * 100}:\n> Where is the boat now?\nHere")])
    assert got[1]["text"] == "Here" and got[1]["n_quoted"] == 2
