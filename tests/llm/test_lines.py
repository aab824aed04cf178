import random

from conftest import odd_rows, prose

from tidewatch.llm.lines import dedup_lines


def brute(rows, min_words):
    """Lines in a run of min_words that begins earlier too, by comparing every pair of places."""
    lines = []
    for order, (_, text) in enumerate(rows):
        own = [(p, " ".join(x.split())) for p, x in enumerate((text or "").split("\n"))]
        lines.append([(order, p, x) for p, x in own if x])
    flat = [x for doc in lines for x in doc]
    gone = {order: set() for order in range(len(rows))}
    for doc in lines:
        for a in range(len(doc)):
            for b in range(a, len(doc)):
                run = [x[2] for x in doc[a : b + 1]]
                if sum(len(x.split()) for x in run) < min_words:
                    continue
                first = next(
                    i for i in range(len(flat)) if [x[2] for x in flat[i : i + len(run)]] == run and len({x[0] for x in flat[i : i + len(run)]}) == 1
                )
                if flat[first][:2] < doc[a][:2]:
                    gone[doc[a][0]].update(x[1] for x in doc[a : b + 1])
        for (order, a, _), (_, b, _) in zip(doc, doc[1:], strict=False):
            if {a, b} <= gone[order]:
                gone[order].update(range(a, b))
    out = []
    for order, (i, text) in enumerate(rows):
        kept = "\n".join(x for p, x in enumerate((text or "").split("\n")) if p not in gone[order])
        out.append((i, kept if gone[order] else text))
    return out


def test_equals_brute_force(docs):
    r = random.Random(11)
    pool = [prose(k, r.choice([1, 3, 6, 12]), 50) for k in range(12)] + ["", "  "]
    for case in range(3):
        rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 14)))) for i in range(25)]
        got = {x["doc_id"]: x["text"] for x in dedup_lines(docs(rows), min_words=10).collect()}
        assert got == dict(brute(rows, 10)), case


def test_long_single_line_and_context(docs):
    passage = prose(1, 55)
    rows = [(1, f"one\n{passage}\ntwo"), (2, f"three\n  {passage.replace(' ', '   ')} \nfour"), (3, passage), (4, "five\nfive")]
    got = {x["doc_id"]: x["text"] for x in dedup_lines(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "three\nfour", 3: "", 4: "five\nfive"}


def test_odd_rows(docs):
    rows = odd_rows()
    out = dedup_lines(docs(rows))
    got = [(x["doc_id"], x["text"]) for x in out.collect()]
    assert out.columns == [*docs(rows).columns, "__runs"] and len(got) == len(rows)
    by = dict(got)
    assert by[4] == dict((r[0], r[1]) for r in rows)[4] and by[5] == ""
    assert sorted(t for i, t in got if i == 1) == ["alpha beta gamma"] * 2
    assert by[2] is None and by[3] == ""
    assert dedup_lines(docs([])).count() == 0
