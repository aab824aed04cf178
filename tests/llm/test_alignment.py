import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tidewatch.llm import alignment
from tidewatch.llm.alignment import Aligner, align, byte_alphabet, merged, op12_alignment
from tidewatch.llm.common import table

from conftest import odd_rows  # isort: skip

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Texts tokenised whole and compared token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = byte_alphabet()
    strings = {i: t for t, i in a.get_vocab().items()}

    def spread(ids, sizes):
        at, out = 0, []
        for i, n in zip(ids, sizes, strict=True):
            out.append((i, at, at + n))
            at += n
        return out

    def of(text):
        if not text:
            return None
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(alphabet[c] for c in strings[i]) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        left, right = spread(a_ids, map(len, a_bytes)), spread(b_ids, map(len, b_bytes))
        links, j = [], 0
        for i, s, e in left:
            while right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        shared, groups, waiting = {x[2] for x in left} & {x[2] for x in right}, [], list(right)[::-1]
        own: list[str] = []
        for i, _, e in left:
            own.append(str(i))
            if e in shared:
                other = []
                while waiting and waiting[-1][2] <= e:
                    other.append(str(waiting.pop()[0]))
                groups.append(f"{','.join(own)}|{','.join(other)}")
                own = []
        return len(left), len(right), links, groups

    def corpus(rows):
        found = [(i, of(t)) for i, t in rows]
        counts = Counter(x for _, f in found if f for x in f[2])
        highest = {}
        for (_, b_id), n in counts.items():
            highest[b_id] = max(highest.get(b_id, 0), n)
        out = []
        for i, f in found:
            if f is None:
                out.append((i, 0, 0, 0, 0, 0, 0, ""))
                continue
            best = sum(counts[x] == highest[x[1]] for x in f[2])
            digest = hashlib.sha256(";".join(f[3]).encode()).hexdigest()
            out.append((i, f[0], f[1], len(f[3]), len(f[2]), best, sum(counts[x] for x in f[2]), digest))
        return out, counts, highest

    return corpus


def in_order(rows):
    return sorted(rows, key=repr)


ODD = [
    "a  b   c ", " lead", "trail ", "  ", " ", "\n", "\n\nThe end\n", "tab\there\t", "tab\t \n x", "x\r\ny \r\n z", " hard  blank", "wide　blank 　x",
    "<|endoftext|> and <s> </s> <0x41>", "low ▁ line", "▁", "nul\x00l \x00", "don't we'll 'tis 's", "\x1c \x1d\n\x1ex", "日本語 テキスト\nです", "é ﬁ ​ x", "👩‍👩‍👧 🇩🇪\n🙂", "1234567 12 3", "###   $$$\n\n\n---",
    "  line  x\u0085y", "x" * 3000, " ".join(["the"] * 500), "﻿ bom", "a\tb\t\tc\n\td",
]


def test_equals_whole_texts(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(alignment, "SPILL", 200)
    monkeypatch.setattr(alignment, "RUN", 64)
    monkeypatch.setattr(alignment, "UNIT", 500)
    r = random.Random(5)
    pieces = [" ", " ", " ", "\n", "\t", "  ", "▁", "the", "token", "izer", "über", "日", "!", "'s", "12", "\r", "　", "É", "#", "\x1c"]
    texts = ODD + ["".join(r.choice(pieces[:6] + pieces[7:]) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += ["".join(r.choice(pieces) for _ in range(20)) for _ in range(20)]
    rows = [(k % 190, t) for k, t in enumerate(texts)]
    documents, pairs = align(docs(rows), A, B)
    expected, counts, highest = plain(rows)
    assert documents.columns == COLUMNS
    assert in_order(tuple(x) for x in documents.collect()) == in_order(expected)
    found = {(x.a_id, x.b_id): (x.n_links, x.best) for x in pairs.collect()}
    assert found == {(a, b): (n, n == highest[b]) for (a, b), n in counts.items()}


def test_odd_rows(docs, plain):
    rows = odd_rows()
    documents, _ = align(docs(rows), A, B)
    assert in_order(tuple(x) for x in documents.collect()) == in_order(plain([r[:2] for r in rows])[0])


def test_empty_table(docs):
    documents, pairs = align(docs([]), A, B)
    assert documents.collect() == [] and pairs.collect() == []


def test_a_pair_that_most_links_share_makes_more_units(docs, plain, monkeypatch):
    monkeypatch.setattr(alignment, "SPILL", 40)
    monkeypatch.setattr(alignment, "UNIT", 20)
    rows = [(k, "the the the" if k % 3 else f"word {k}") for k in range(300)]
    documents, _ = align(docs(rows), A, B)
    assert in_order(tuple(x) for x in documents.collect()) == in_order(plain(rows)[0])


def test_counts_of_a_radix_from_many_tasks(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(alignment, "RADIX", 2)
    rows = [(k, t) for k, t in enumerate(ODD)]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(was, ("23", "false"), strict=True):
            spark.conf.set(k, v)
        documents, _ = align(docs(rows), A, B)
        assert in_order(tuple(x) for x in documents.collect()) == in_order(plain(rows)[0])
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_forgetting_changes_nothing(monkeypatch):
    whole = Aligner(A, B).batch(ODD)
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 3)
    short = Aligner(A, B)
    assert [short.batch([t])[0][1:] for t in ODD] == [w[1:] for w in whole]


def test_merge_of_runs(monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 4)
    rng = np.random.default_rng(1)
    runs, plain = [], Counter()
    for n in (0, 1, 5, 40, 41):
        keys = np.unique(rng.integers(0, 60, n))
        counts = rng.integers(1, 9, len(keys))
        runs.append((keys, counts))
        plain.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    found = list(merged(runs))
    keys, counts = (np.concatenate([f[i] for f in found]).tolist() for i in (0, 1))
    assert keys == sorted(plain) and dict(zip(keys, counts, strict=True)) == dict(plain)


def test_query_equals_whole_texts(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert in_order(tuple(x) for x in op12_alignment(spark, sf).collect()) == in_order(plain(rows)[0])
