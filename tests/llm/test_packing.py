import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import odd_rows

from tidewatch.llm import packing

WEIRD = ["", "  ", "a\x1cb c", "ΑΣ Σ", "İx", "<|endoftext|> hi", "e\u0301 x", "it's DON'T 12a3 ½ ² ǅ ß ﬁ x_y 日本 a b", "ǅungla Ⅷ ①", "we'll 're's ''s", "\u2003a\u00a0b", "ﷺ 𝔘𝔫𝔦 😀!!"]


@pytest.mark.parametrize("n", [0, 1, 60, 4000])
def test_schedule_uses_up_the_histogram(n):
    r = random.Random(n)
    counts = defaultdict(int)
    for _ in range(n):
        counts[min(2048, int(r.lognormvariate(6, 1)) + 1)] += 1
    runs = packing.schedule(dict(counts))
    used = defaultdict(int)
    for times, pattern in runs:
        assert times > 0 and 0 < sum(a * b for a, b in pattern) <= 2048
        for length, k in pattern:
            used[length] += times * k
    assert used == counts
    least = -(-sum(a * b for a, b in counts.items()) // 2048)
    assert sum(t for t, _ in runs) <= 1.01 * least + 1


def test_large_lengths_alone_come_close_to_the_best_mix():
    counts = {700: 300, 650: 300, 680: 300}  # three of a kind fill a sequence
    assert sum(t for t, _ in packing.schedule(counts)) == 300


def test_groups_have_equal_cardinality():
    groups = packing.linear_groups({5: 7, 3: 5, 9: 4, 2: 2, 1: 2}, 4)
    assert [sum(n for _, n in g) for g in groups] == [5, 5, 5, 5] and groups[0] == [[9, 4], [5, 1]]
    assert packing.linear_groups({5: 7, 9: 4}, 4) == [[[9, 4]], [[5, 7]]]


def test_words_one_by_one_equal_the_tokenizer():
    encoder = packing.Encoder(packing.default_tokenizer())
    r = random.Random(4)
    texts = WEIRD + ["".join(r.choice("abz' .9éßñ\n!#-_’ЖΩ中") for _ in range(60)) for _ in range(500)]
    for text in texts * 2:
        want = np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert encoder.encode(text) == want, text
    assert encoder.encode(None) == bytes(4)


def test_round_trip_of_documents(spark, docs):
    rows = [*odd_rows(), *[(100 + k, t) for k, t in enumerate(WEIRD)], *[(200 + k, "word " * (37 * k)) for k in range(80)]]
    got = packing.pack_documents(docs(rows)).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    want = defaultdict(int)
    for row in rows:
        ids = encoder.encode(row[1])
        for k, s in enumerate(range(0, len(ids), 8192)):
            part = ids[s : s + 8192]
            want[row[0], k, s // 4, len(part) // 4, zlib.crc32(part)] += 1
    have, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack_documents(docs([])).count() == 0


def plain_best_fit(counts, capacity):
    """Sequences that best fit needs, longest first, one piece at a time."""
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= length]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_never_more_sequences_than_plain_best_fit(seed):
    r = random.Random(seed)
    counts = defaultdict(int)
    for _ in range(600):
        counts[min(2048, int(r.choice([r.uniform(1, 2048), r.uniform(500, 900), r.lognormvariate(6, 1)])) + 1)] += 1
    assert sum(t for t, _ in packing.schedule(dict(counts))) <= plain_best_fit(counts, 2048)
