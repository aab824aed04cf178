"""Alignment of two tokenizers, with link counts by external spill runs.

Both tokenizers cut the same bytes. Tokens whose byte ranges overlap are linked, and
a pair of ids counts its links in the whole corpus.

1. Tasks tokenise and align. What a document links, as (pair, document, links)
   records, gathers in a buffer; a full buffer is sorted by (B id, A id, document),
   radix-partitioned by B id and spilled as zstd runs, which are rows of a table.
2. The runs of a radix go to units of bounded size. A unit merges its runs with a
   heap and counts each pair; counts of units are added up by Spark.
3. The counts in B-major order yield each B id's highest count as they stream by,
   and leave as runs too.
4. Each unit streams its runs past the counts of its radix, and what every document
   gets back is added up.

A pair or a B id that a third of all links share makes more units, not larger ones.
A vocabulary bounds the pairs of one B id. Texts never leave the first step.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, remembering, small_batches, source, table

#: Partitions by B id; records of a buffer, of a run, of a unit; keys that a merge takes from a run at once.
RADIX, SPILL, RUN, UNIT, PIECE = 8, 1 << 20, 1 << 16, 1 << 22, 1 << 13
#: A key is the B id and then this many bits of the A id.
A_BITS = 17
#: Segments and characters of segments that a worker remembers before it starts afresh.
CACHE_SEGMENTS, CACHE_CHARS = 600_000, 30_000_000
#: Segments that are tokenised at once; the tokenizers' own objects take about a kilobyte each.
LEARN = 8192
#: Where white space starts with a blank or a line end, both tokenizers cut. Other white space stays inside.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for their own, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes: which range each place is in, and its number there."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Growing:
    """An array that grows at its end; ``width`` columns, or none."""

    def __init__(self, kind: str, width: int = 0):
        self.held, self.n = np.zeros((1024, width) if width else 1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            more = max(len(self.held), len(values))
            self.held = np.concatenate([self.held, np.zeros((more, *self.held.shape[1:]), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Aligns texts by segments it remembers: both tokenizers cut at a segment's ends and see nothing beyond them.

    A segment starts with a blank or a line end after something that is not white
    space. Byte-level patterns never join the two, and no piece of the other
    vocabulary holds a blank or a line end behind another character.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if any(c == "\n" or c == "▁" and piece[k - 1] != "▁" for k, c in enumerate(piece) if k):
                raise ValueError(f"piece {i} joins a blank or a line end to what precedes it")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.forget()

    def __len__(self) -> int:
        return len(self.known)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.facts = Growing("i4", 4)  # A tokens, B tokens, groups, whether the bytes differ
        self.links = Growing("i8")
        self.ends = Growing("i8")

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B puts a blank before each: one that is there goes, one that was not there has its id taken off."""
        starts = [s[0] == " " for s in segments]
        found = self.b.encode([s[1:] if own else s for s, own in zip(segments, starts, strict=True)], num_threads=1)
        for k, own in enumerate(starts):
            if not own:
                found[k] = found[k][1:] if found[k][:1] == [self.blank] else []
            elif not found[k]:
                found[k] = [self.blank]
        return found

    def learn(self, new: list[str]) -> None:
        """Align segments that are not known yet, all in one row of bytes."""
        raw = [s.encode("utf-8", "replace") for s in new]
        a_ids = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        b_ids = self.b_ids(new)
        whole = b"".join(raw)
        flat = [list(itertools.chain.from_iterable(side)) for side in (a_ids, b_ids)]
        same = np.ones(len(new), bool)
        if any(b"".join(map(t.__getitem__, ids)) != whole for t, ids in zip((self.a_bytes, self.b_bytes), flat, strict=True)):
            spelled = ([b"".join(map(t.__getitem__, x)) for x in side] for t, side in ((self.a_bytes, a_ids), (self.b_bytes, b_ids)))
            same = np.array([r == x == y for r, x, y in zip(raw, *spelled, strict=True)])
            a_ids, b_ids = ([x if ok else [] for x, ok in zip(side, same, strict=True)] for side in (a_ids, b_ids))
            flat = [list(itertools.chain.from_iterable(side)) for side in (a_ids, b_ids)]
        a_counts, b_counts = (np.fromiter(map(len, side), np.int64, len(side)) for side in (a_ids, b_ids))
        a, b = (np.array(ids, np.int64) for ids in flat)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Every overlap of an A and a B token is one stretch between two neighbouring ends of either side.
        ends = np.union1d(a_ends, b_ends)
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        keys = (b[np.searchsorted(b_ends, ends)] << A_BITS) | a[np.searchsorted(a_ends, ends)]
        sizes = np.where(same, np.fromiter(map(len, raw), np.int64, len(raw)), 0)
        upto = np.cumsum(sizes)
        last = np.searchsorted(ends, upto, side="right")
        cuts = np.searchsorted(both, upto, side="right")
        n_groups = np.diff(cuts, prepend=0)
        # The text of a group: the A ids up to its end, then the B ids.
        a_to, b_to = np.searchsorted(a_ends, both) + 1, np.searchsorted(b_ends, both) + 1
        a_text, b_text = (list(map(str, ids)) for ids in flat)
        texts, i, j = [], 0, 0
        for x, y in zip(a_to.tolist(), b_to.tolist(), strict=True):
            texts.append(f"{a_text[i] if x - i == 1 else ','.join(a_text[i:x])}|{b_text[j] if y - j == 1 else ','.join(b_text[j:y])}")
            i, j = x, y
        at = 0
        for c in cuts.tolist():
            self.groups.append(";".join(texts[at:c]))
            at = c
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.facts.extend(np.stack([a_counts, b_counts, n_groups, ~same], axis=1))
        self.ends.extend(self.links.n + last)
        self.links.extend(keys)

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, tuple[int, int, int, int], str]]:
        """For each text its segments' numbers, (A tokens, B tokens, groups, links) and the digest of its groups."""
        if len(self.known) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self.forget()
        split = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.known))
        for k in range(0, len(new), LEARN):
            self.learn(new[k : k + LEARN])
        facts, ends, out = self.facts.values, self.ends.values, []
        sizes = np.diff(ends, prepend=0)
        for segments in split:
            ids = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
            own = facts[ids]
            if not len(ids) or own[:, 3].any():
                out.append((ids[:0], (0, 0, 0, 0), ""))
                continue
            n_a, n_b, n_groups, _ = own.sum(axis=0, dtype=np.int64).tolist()
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, ids.tolist())).encode()).hexdigest()
            out.append((ids, (n_a, n_b, n_groups, int(sizes[ids].sum())), digest))
        return out

    def records(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, links) of a text from its segments, in parts of at most about ``SPILL``; a key may come again."""
        segments, counts = np.unique(ids, return_counts=True)
        ends, links = self.ends.values, self.links.values
        starts = np.concatenate([[0], ends])[segments]
        sizes = ends[segments] - starts
        upto = np.cumsum(sizes)
        for part in np.split(np.arange(len(segments)), np.flatnonzero(np.diff(upto // SPILL)) + 1):
            which, place = spans(sizes[part])
            yield links[starts[part][which] + place], counts[part][which]


# -- runs -----------------------------------------------------------------------


def packed(**arrays: np.ndarray) -> bytes:
    """Whole numbers in the smallest kinds that hold them, in one zstd frame."""
    import zstandard

    small = {k: v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0)) for k, v in arrays.items()}
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(small, 5))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    return {k: v.astype(np.int64) for k, v in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items()}


class Spill:
    """The record buffer of a task."""

    def __init__(self) -> None:
        self.empty()

    def empty(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.uids: list[int] = []
        self.n = 0

    def add(self, uid: int, keys: np.ndarray, links: np.ndarray) -> None:
        if not self.uids or self.uids[-1] != uid:
            self.uids.append(uid)
        self.parts.append((keys, links, len(self.uids) - 1))
        self.n += len(keys)

    def runs(self) -> Iterator[tuple[int, int, bytes]]:
        """(radix, records, blob) of sorted runs, and an empty buffer."""
        if self.n:
            keys, links = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            docs = np.repeat(np.array([p[2] for p in self.parts], np.int64), [len(p[0]) for p in self.parts])
            uids = np.array(self.uids, np.int64)
            self.empty()
            # 21 bits for the documents of a buffer, which holds no more documents than records; 42 for the key.
            whole = keys << 21 | docs
            order = np.argsort(whole, kind="stable")
            whole, links = whole[order], links[order]
            new = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            whole, links = whole[new], np.add.reduceat(links, new)
            keys, docs = whole >> 21, whole & ((1 << 21) - 1)
            radix = (keys >> A_BITS) % RADIX
            for r in range(RADIX):
                own = np.flatnonzero(radix == r)
                for k in range(0, len(own), RUN):
                    at = own[k : k + RUN]
                    distinct, first, sizes = np.unique(keys[at], return_index=True, return_counts=True)
                    members, doc = np.unique(docs[at], return_inverse=True)
                    links_of = np.add.reduceat(links[at], first)
                    steps = np.diff(distinct, prepend=0)
                    yield (
                        r,
                        len(at),
                        packed(steps=steps, sizes=sizes, totals=links_of, doc=doc, links=links[at], uids=np.diff(uids[members], prepend=0)),
                    )


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (keys, counts) runs as one, each key once, in pieces.

    The heap holds the last key of every run's current piece. All runs hand over
    what lies up to the smallest of them; the run it belongs to opens its next piece.
    """
    at = [0] * len(runs)
    heap = [(int(keys[min(PIECE, len(keys)) - 1]), i) for i, (keys, _) in enumerate(runs) if len(keys)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for i, (k, c) in enumerate(runs):
            to = at[i] + int(np.searchsorted(k[at[i] : at[i] + PIECE], bound, side="right"))
            if to > at[i]:
                keys.append(k[at[i] : to])
                counts.append(c[at[i] : to])
                at[i] = to
        while heap and heap[0][0] <= bound:
            _, i = heapq.heappop(heap)
            if at[i] < len(runs[i][0]):
                heapq.heappush(heap, (int(runs[i][0][min(at[i] + PIECE, len(runs[i][0])) - 1]), i))
        together, counts_together = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(together, kind="stable")
        together, counts_together = together[order], counts_together[order]
        first = np.flatnonzero(np.concatenate([[True], together[1:] != together[:-1]]))
        yield together[first], np.add.reduceat(counts_together, first)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for every document (uid, doc_id, its counts and digest) and for every run (radix, n, blob)."""
    small_batches(docs.sparkSession)
    rows = docs.withColumn("uid", F.monotonically_increasing_id())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    facts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"uid long, doc_id {id_type}, {', '.join(f'{c} long' for c in facts)}, groups_sha256 string, radix int, n long, blob binary"
    names = ["uid", "doc_id", *facts, "groups_sha256", "radix", "n", "blob"]

    def cut(batches):
        spill, doc_kind = Spill(), None

        def full():
            for radix, n, blob in spill.runs():
                empty = [pa.nulls(1, pa.int64()), pa.nulls(1, doc_kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string())]
                columns = [*empty, pa.array([radix], pa.int32()), pa.array([n], pa.int64()), pa.array([blob], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

        with remembering("aligner", (a_path, b_path), lambda: Aligner(a_path, b_path)) as aligner:
            for b in batches:
                doc_kind = b.column("doc_id").type
                found = aligner.batch(b["text"].to_pylist())
                for uid, (ids, _, _) in zip(b["uid"].to_pylist(), found, strict=True):
                    for keys, links in aligner.records(ids) if len(ids) else ():
                        spill.add(uid, keys, links)
                        if spill.n >= SPILL:
                            yield from full()
                counts = [pa.array([f[1][k] for f in found], pa.int64()) for k in range(4)]
                n = b.num_rows
                rest = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([b["uid"], b["doc_id"], *counts, pa.array([f[2] for f in found], pa.string()), *rest], names)
            yield from full()

    return rows.select("uid", "doc_id", "text").mapInArrow(cut, schema)


def units(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of one (radix, slice) in one task, one unit after the other."""
    return rows.repartition("radix", "slice").sortWithinPartitions("radix", "slice", *order)


def each_unit(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """((radix, slice), its rows) as they stream by."""

    def rows():
        for b in batches:
            yield from zip(b["radix"].to_pylist(), b["slice"].to_pylist(), *(b[c].to_pylist() for c in columns), strict=True)

    for key, own in itertools.groupby(rows(), key=lambda r: r[:2]):
        yield key, (r[2:] for r in own)


def pair_runs(runs: DataFrame) -> DataFrame:
    """(radix, blob): the counts of all pairs in B-major order, and whether each is its B id's highest."""

    def count(batches):
        for _, own in each_unit(batches, ["blob"]):
            found = []
            for (blob,) in own:
                run = unpacked(blob)
                found.append((np.cumsum(run["steps"]), run["totals"]))
            for keys, counts in merged(found):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    counts = units(runs, []).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    by_b = counts.withColumn("b", F.shiftright("key", A_BITS)).repartition("b").sortWithinPartitions("key")

    def blocks(keys, counts):
        """Whole B ids only."""
        b = keys >> A_BITS
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(b)))
        radix = b % RADIX
        for r in np.unique(radix).tolist():
            at = np.flatnonzero(radix == r)
            blob = packed(steps=np.diff(keys[at], prepend=0), counts=counts[at], best=best[at])
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob])], ["radix", "blob"])

    def maxima(batches):
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy()])
            counts = np.concatenate([counts, batch["n"].to_numpy()])
            if len(keys) >= RUN:
                done = int(np.searchsorted(keys, keys[-1] >> A_BITS << A_BITS))  # the last B id may go on
                if done:
                    yield from blocks(keys[:done], counts[:done])
                    keys, counts = keys[done:], counts[done:]
        if len(keys):
            yield from blocks(keys, counts)

    return by_b.mapInArrow(maxima, "radix int, blob binary")


def given_back(runs: DataFrame, pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """uid, n_best and count_sum of the documents of every run."""
    every = pairs.join(slices, "radix").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = every.select("radix", "slice", F.lit(False).alias("run"), "blob").unionByName(
        runs.select("radix", "slice", F.lit(True).alias("run"), "blob")
    )

    def look_up(batches):
        for _, own in each_unit(batches, ["run", "blob"]):
            known, held = [], None
            for is_run, blob in own:
                if not is_run:
                    part = unpacked(blob)
                    known.append((np.cumsum(part["steps"]), part["counts"], part["best"]))
                    continue
                if held is None:  # the B ids of a radix come from many tasks
                    held = tuple(np.concatenate(x) for x in zip(*known, strict=True))
                    order = np.argsort(held[0])
                    held, known = tuple(x[order] for x in held), []
                run = unpacked(blob)
                at = np.repeat(np.searchsorted(held[0], np.cumsum(run["steps"])), run["sizes"])
                uids = np.cumsum(run["uids"])
                total, best = np.zeros(len(uids), np.int64), np.zeros(len(uids), np.int64)
                np.add.at(total, run["doc"], run["links"] * held[1][at])
                np.add.at(best, run["doc"], run["links"] * held[2][at])
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(best), pa.array(total)], ["uid", "n_best", "count_sum"])

    return units(both, ["run"]).mapInArrow(look_up, "uid long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents' alignments, and the counts of all linked id pairs.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256; pairs: a_id, b_id, n_links and best (highest count of its B id,
    ties included). A is a byte-level vocabulary, B a piece model with byte pieces that
    puts a blank before a text; both paths must open on every executor.

    Null and empty texts, and texts whose tokens don't spell them, have no tokens:
    zeros and an empty digest. Every row is aligned on its own, also where ids or whole
    rows repeat; null ids stay. Other columns are dropped.
    """
    rows = materialize(aligned(source(docs, doc_id=doc_id, text=text), a_path, b_path), "alignments")
    runs = rows.filter("radix IS NOT NULL").select("radix", "n", "blob")
    slices = runs.groupBy("radix").agg(F.ceil(F.sum("n") / UNIT).cast("int").alias("slices"))
    slices = materialize(slices, "align-slices")  # RADIX rows
    runs = runs.join(F.broadcast(slices), "radix")
    runs = runs.withColumn("slice", F.pmod(F.xxhash64("blob"), F.col("slices")).cast("int")).select("radix", "slice", "blob")
    pairs = materialize(pair_runs(runs), "align-pairs")
    back = given_back(runs, pairs, slices).groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    documents = rows.filter("radix IS NULL").select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    documents = documents.join(back, "uid", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256",
    )

    def listed(batches):
        for b in batches:
            for blob in b["blob"].to_pylist():
                part = unpacked(blob)
                keys = np.cumsum(part["steps"])
                columns = [keys & ((1 << A_BITS) - 1), keys >> A_BITS, part["counts"], part["best"] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a_id", "b_id", "n_links", "best"])

    return documents, pairs.select("blob").mapInArrow(listed, "a_id long, b_id long, n_links long, best boolean")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token alignment between a byte-level and a piece vocabulary, with corpus counts of its links."""
    import public_tokenizers

    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(table(spark, sf_dir, "documents"), *paths)[0]
