"""Packing of tokenised documents into sequences by a linear grouping scheme.

Spark tokenises, counts the pieces of every length and numbers them. The driver
sees the histogram alone: at most ``capacity`` lengths, however many pieces. It

1. sorts the large lengths and cuts them into groups of equal cardinality, each
   rounded up to its longest member, so that few sizes remain;
2. finds the best mix of configurations (multisets of sizes that fit a sequence)
   by column generation, and takes the whole parts of it;
3. puts the actual lengths in place of the rounded ones;
4. best-fits everything left, longest first, into the tightest room.

The result is a list of runs (a multiset of lengths, used so many times), which
number the sequences; a piece finds its place from its length and its number.
"""

from __future__ import annotations

import bisect
import json
import os
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, numbered, remembering, small_batches, source, table

CAPACITY = 2048
GROUPS = 16
#: Lengths above a share of the capacity are grouped, the others best-fitted; the scheme
#: is worked out for each share, and the one with the fewest sequences is used.
LARGE = (1 / 4, 1 / 3, 1 / 2)
END_ID = 0
#: Words a worker remembers, about 200 bytes each; then it starts afresh.
CACHE_WORDS = 800_000


class Encoder(dict):
    """Ids of whole texts, little-endian unsigned 32-bit, the end id last.

    The vocabulary puts texts in NFC, folds case, splits at white space, then into
    letters, single digits and other signs, and merges within those parts. So a
    text's ids are those of its words, and this maps a lower-case word to its ids.
    Texts in which Python's steps could differ are encoded whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.part = regex.compile(json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    forget = dict.clear

    def __missing__(self, word: str) -> bytes:
        parts = [word] if word.isascii() and word.isalpha() else self.part.findall(word)
        if parts == [word]:
            mapped = word if word.isascii() else self.as_bytes.pre_tokenize_str(word)[0][0]
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        else:
            found = b"".join(map(self.__getitem__, parts))
        self[word] = found
        return found

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        """Whether lower-casing and str.split() do what the vocabulary's own steps do."""
        odd = "\x1c\x1d\x1e\x1f" if text.isascii() else "\x1c\x1d\x1e\x1fΣİ"
        return not any(s in text for s in [*odd, *self.special]) and unicodedata.is_normalized("NFC", text)

    def encode(self, text: str | None) -> bytes:
        if len(self) > CACHE_WORDS:
            self.forget()
        text = text or ""
        ids = b"".join(map(self.__getitem__, text.lower().split())) if self.plain(text) else self.whole(text)
        return ids + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length and ids_crc32 of every piece of every document.

    ``tokenizer`` is a path that every executor can open. A null or empty text is
    its end id alone. Only a document of more than ``capacity`` ids is cut.
    """
    small_batches(docs.sparkSession)
    rows = source(docs, doc_id=doc_id, text=text).withColumn("uid", F.monotonically_increasing_id())
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        with remembering("encoder", tokenizer, lambda: Encoder(tokenizer)) as encoder:
            for b in batches:
                at, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(map(encoder.encode, b["text"].to_pylist())):
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        at.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                own = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b["uid"].take(own),
                        b["doc_id"].take(own),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, f"uid long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


# -- the schedule, from a histogram -------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths in falling order, cut into ``groups`` of equal cardinality: [length, count] lists.

    No more lengths than groups need no rounding: each is a group.
    """
    if len(counts) <= groups:
        return [[[n, counts[n]]] for n in sorted(counts, reverse=True)]
    total = sum(counts.values())
    share = -(-total // groups) if total else 1
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            n = min(left, room)
            out[-1].append([length, n])
            left -= n
            room -= n
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 3000) -> list[tuple[float, np.ndarray]]:
    """The linear programme over all configurations, solved by column generation.

    Returns (how often, items of each size). ``sizes`` is short, so the basis is a
    small dense matrix; the next configuration comes from a knapsack over the
    capacity.
    """
    m = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, float)
    for _ in range(steps):
        worth = np.linalg.solve(basis.T, np.ones(m))
        best = np.zeros(capacity + 1)
        choice = np.full(capacity + 1, -1)
        for c in range(min(sizes), capacity + 1):
            best[c] = best[c - 1]
            for g, s in enumerate(sizes):
                if s <= c and best[c - s] + worth[g] > best[c] + 1e-12:
                    best[c] = best[c - s] + worth[g]
                    choice[c] = g
        if best[capacity] <= 1 + 1e-7:
            break
        column = np.zeros(m)
        c = capacity
        while c > 0:
            if choice[c] >= 0:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
            else:
                c -= 1
        used = np.linalg.solve(basis, need)
        change = np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratios.argmin())] = column
    used = np.linalg.solve(basis, need)
    return [(max(0.0, float(x)), basis[:, i].copy()) for i, x in enumerate(used)]


def schedule(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (times, [(length, items)]) that use up ``counts``: the best of the shares in ``LARGE``."""
    return min((_scheme(counts, capacity, groups, share) for share in LARGE), key=lambda runs: sum(n for n, _ in runs))


def _scheme(counts: dict[int, int], capacity: int, groups: int, share: float) -> list[tuple[int, list[tuple[int, int]]]]:
    left = {n: c for n, c in counts.items() if c}
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    if capacity in left:
        rooms[0].append((left.pop(capacity), [(capacity, 1)]))
    large = {n: c for n, c in left.items() if n > capacity * share}
    grouped = linear_groups(large, groups)
    # Groups that share their longest length have one size; each keeps its own members.
    by_size: dict[int, list[list[int]]] = {}
    for g in grouped:
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = list(by_size)
    if sizes:
        demand = [sum(n for _, n in by_size[s]) for s in sizes]
        for times, column in sorted(configurations(sizes, demand, capacity), key=lambda t: -t[0]):
            members = [(by_size[sizes[g]], int(a)) for g, a in enumerate(column) if a]
            _substitute(int(times + 1e-9), members, capacity, rooms)
    for n in large:
        del left[n]
    for segments in by_size.values():
        for n, c in segments:
            if c:
                left[n] = left.get(n, 0) + c
    _best_fit(left, capacity, rooms)
    return [run for room in sorted(rooms) for run in rooms[room]]


def _substitute(times: int, members: list[tuple[list[list[int]], int]], capacity: int, rooms: dict) -> None:
    """Fill a configuration ``times`` times with the longest actual lengths left of each size."""
    while times:
        for segments, _ in members:
            while segments and not segments[0][1]:
                segments.pop(0)
        live = [(s, a) for s, a in members if s]
        if not live:
            return
        step = min(times, *(s[0][1] // a for s, a in live))
        pattern: dict[int, int] = defaultdict(int)
        for segments, a in live:
            if step:
                pattern[segments[0][0]] += a
                segments[0][1] -= step * a
                continue
            for _ in range(a):
                while segments and not segments[0][1]:
                    segments.pop(0)
                if segments:
                    pattern[segments[0][0]] += 1
                    segments[0][1] -= 1
        rooms[capacity - sum(n * k for n, k in pattern.items())].append((max(step, 1), list(pattern.items())))
        times -= max(step, 1)


def _best_fit(left: dict[int, int], capacity: int, rooms: dict) -> None:
    """Put every length, longest first, into the tightest room; many alike at once.

    A sequence that has just taken an item is the tightest one that can take
    another of the same length, so it takes as many as fit.
    """
    open_rooms = sorted(r for r in rooms if rooms[r])
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(open_rooms, length)
            if at == len(open_rooms):
                room, (times, pattern) = capacity, (count, [])
            else:
                room = open_rooms[at]
                times, pattern = rooms[room].pop()
                if not rooms[room]:
                    open_rooms.pop(at)
            fit = room // length
            filled = min(times, count // fit)
            parts = [(filled, fit)] if filled else []
            count -= filled * fit
            if filled < times and 0 < count < fit:
                parts.append((1, count))
                filled, count = filled + 1, 0
            if pattern and filled < times:
                parts.append((times - filled, 0))
            for n, k in parts:
                rest = room - k * length
                if not rooms[rest]:
                    bisect.insort(open_rooms, rest)
                rooms[rest].append((n, [*pattern, (length, k)] if k else pattern))


def placement(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Sorted chunks: the pieces of a length from a number on, and where they go."""
    rows, used, first = [], defaultdict(int), 0
    for times, pattern in runs:
        offset = 0
        for length, k in pattern:
            rows.append((length, used[length], k, first, offset))
            used[length] += times * k
            offset += length * k
        first += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "number", "items", "sequence", "offset"), columns, strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``cut`` (:func:`pieces`, already written) with sequence_id and offset for every row.

    offset counts the ids before a piece in its sequence; the pieces of a sequence
    follow each other without gaps. No rows give no sequences.
    """
    counts = {n: c for n, c in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    plan = cut.sparkSession.sparkContext.broadcast(placement(schedule(counts, capacity, groups)))
    ranked = numbered(cut, ["length"], ["uid", "piece"], "__number")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)

    columns = cut.columns

    def place(batches):
        p = plan.value
        keys = (p["length"] << 44) + p["number"]
        for b in batches:
            length, number = b["length"].to_numpy(zero_copy_only=False), b["__number"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            since, items = number - p["number"][at], p["items"][at]
            found = [pa.array(p["sequence"][at] + since // items), pa.array(p["offset"][at] + since % items * length)]
            yield pa.RecordBatch.from_arrays([b[c] for c in columns] + found, [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), capacity=capacity), "pieces")
    return pack(cut, capacity).drop("uid")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
