"""Removal of repeated passages by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. Which strings of
that length are equal is read from the merged order of the suffixes of many texts. The suffixes of each shard, some ``SHARD``
bytes of text, are sorted once; the byte before each is the shard's transform. The suffixes of all shards together are
never sorted: their interleave starts with one shard after the other, and each round deals it out stably by the two bytes that the
transforms give, which turns the order by h bytes into that by h + 2. Neighbours between which a round first makes a
border have h or h + 1 bytes in common, which is recorded. After the rounds of ``LENGTH`` bytes the neighbours without a border share at least
so many bytes, so the runs of these are the repeated intervals, and the smallest doc_id of a run decides for the rest.

A transform of the whole corpus fits no task, so only what can share a string meets, and all that can does. Every string of
``LENGTH`` bytes has a seed, the least by hash of its ``SEED`` byte substrings (the leftmost of equal ones). Equal strings have equal
seeds, so a seed found in one document alone ends there, and the neighbourhoods of the others are dealt to tasks by seed:
each distinct neighbourhood once, with just the strings of that seed. Where a seed has one neighbourhood, that is one interval
without any rounds.

Seeds that occur very often are found first, by counts that are summed before the shuffle. The ``MOST_HOT`` commonest of those with
more than ``HOT`` occurrences are broadcast (a bounded 8 MB) and never gathered: their strings become rows, of which the smallest
doc_id is taken before the shuffle, and the strings that very many rows have get it by a second bounded broadcast.

Exact copies of a document with a smaller doc_id go as a whole and are left out above, as that document has all their strings.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all; a null doc_id neither loses bytes nor makes others lose
them; rows with the same doc_id don't either among each other; an empty table gives an empty table; further columns
are ignored. Texts are treated whole, in overlapping pieces of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scope, stash

LENGTH, SEED, HOT = 50, 20, 50_000
#: Seeds that occur so often in a task are counted; how many hot seeds, and how many common strings, are broadcast at most.
OFTEN, MOST_HOT, MOST_COMMON = 4, 1 << 20, 1 << 16
#: Seeds that a task sorts together, and how many it goes on counting; buckets of a partition.
SORTED, COUNTED, TOGETHER = 1 << 20, 1 << 18, 4
#: Bytes of text a task works on at once, (about) bytes of text whose seeds share a bucket, bytes of a shard, bytes merged together.
PIECE, BUCKET, SHARD, MERGE = 400_000, 3_000_000, 1 << 14, 56_000
#: Ends a neighbourhood; no byte of UTF-8.
STOP = 0xFF
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)
_TABLES: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES["up"]) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
        _TABLES["byte"] = _mix(np.arange(1, 257, dtype=np.uint64))
    return _TABLES["up"][:n], _TABLES["down"][:n]


class Seeds:
    """Seeds of the strings in some pieces of text: runs of neighbouring strings with the same seed."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n, width = len(data), LENGTH - SEED + 1
        self.data = data
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES["byte"][data] * up[:-1], out=self.sums[1:])
        key = _mix((self.sums[SEED:] - self.sums[:-SEED]) * self.down[: n - SEED + 1])
        # The upper half of the hash, then the place: the least is the same for equal strings wherever they stand.
        least = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        seed = (least & _LOW).astype(np.int64)
        inside = np.ones(n - LENGTH + 1, bool)
        for b in bounds[1:-1].tolist():
            inside[max(b - LENGTH + 1, 0) : b] = False
        same = seed[1:] == seed[:-1]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~(same & inside[:-1])
        last[:-1] &= ~(same & inside[1:])
        self.start = np.flatnonzero(first)
        self.count = np.flatnonzero(last) - self.start + 1
        self.off = seed[self.start] - self.start
        self.key = key[seed[self.start]]
        self.piece = np.searchsorted(bounds, self.start, "right") - 1

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of runs: a hash of all bytes of their strings, and these bytes, joined."""
        start, size = self.start[at], self.count[at] + LENGTH - 1
        name = _mix((self.sums[start + size] - self.sums[start]) * self.down[start]) ^ _mix((self.off[at] * 64 + self.count[at]).astype(np.uint64))
        ends = np.cumsum(size)
        joined = self.data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return name, joined


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, bounds, text, place): some pieces, joined; which text each is of, and where in it it starts."""
    parts, text, place, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            # Strings that start in the piece end in it.
            part = t[at : at + PIECE + LENGTH - 1]
            parts.append(part)
            text.append(i)
            place.append(at)
            size += len(part)
            if size >= PIECE:
                yield _joined(parts, text, place)
                parts, text, place, size = [], [], [], 0
    if parts:
        yield _joined(parts, text, place)


def _joined(parts, text, place):
    bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
    return np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(text), np.array(place)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that what a task holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _texts(column: pa.Array) -> list[bytes]:
    """The bytes of texts as they are in the column; they need not become strings first."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _blob(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[bytes]]]:
    """For each bucket, the binary columns of its rows, from batches sorted by bucket."""
    last, held = None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
        for j, b in enumerate(batch.column(0).to_pylist()):
            if b != last:
                if held:
                    yield held
                last, held = b, [[] for _ in columns]
            for h, c in zip(held, columns):
                h.append(c[j])
    if held:
        yield held


def _join(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


class Often:
    """Counts of the commonest keys that pass: what is more than a ``COUNTED``-th of all keys is never lost, and counts are too low by no more.

    Where there are too many keys, all counts are lowered by that of the first key that doesn't fit, which takes as many away from each of those that stay.
    """

    def __init__(self) -> None:
        self.key, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, key: np.ndarray) -> None:
        self.held.append(key)
        self.size += len(key)
        if self.size >= SORTED:
            self.settle()

    def settle(self) -> None:
        key, n = np.unique(np.concatenate([np.empty(0, np.uint64), *self.held]), return_counts=True)
        self.held, self.size = [], 0
        if len(self.key):
            key, at = np.unique(np.concatenate([self.key, key]), return_inverse=True)
            n = np.bincount(at, np.concatenate([self.n, n]), len(key)).astype(np.int64)
        if len(key) > COUNTED:
            n = n - np.partition(n, len(n) - COUNTED - 1)[len(n) - COUNTED - 1]
            key, n = key[n > 0], n[n > 0]
        self.key, self.n = key, n


def _often_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds that occur often in the rows of a task, and how often."""
    often = Often()
    for batch in _slices(batches):
        for data, bounds, _, _ in _pieces(_texts(batch.column(1))):
            often.add(Seeds(data, bounds).key)
    often.settle()
    many = often.n >= OFTEN
    yield pa.RecordBatch.from_arrays([pa.array(often.key[many].view(np.int64)), pa.array(often.n[many])], ["seed", "n"])


def _is_in(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some, sorted ones."""
    if not len(some):
        return np.zeros(len(key), bool)
    return some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key


def _seed_rows(n_buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, keys, docs = batch.column(0).to_numpy(), [], []
            for data, bounds, text, _ in _pieces(_texts(batch.column(1))):
                seeds = Seeds(data, bounds)
                rest = ~_is_in(seeds.key, hot.value)
                keys.append(seeds.key[rest])
                docs.append(ids[text[seeds.piece[rest]]])
            if not keys:
                continue
            key, doc = np.concatenate(keys), np.concatenate(docs)
            rows = [(b, _blob(key[at], np.uint64), _blob(doc[at], np.int64)) for b, at in _by_bucket((key % np.uint64(n_buckets)).astype(np.int64))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "keys", "docs"])

    return run


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, by document, the seeds that other documents have too."""
    for keys, docs in _gathered(batches):
        key, doc = _join(keys, np.uint64), _join(docs, np.int64)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        keep_ = np.repeat(shared, np.diff(np.r_[first, len(key)]))
        key, doc = key[keep_], doc[keep_]
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        ends = np.r_[cuts[1:], len(doc)]
        for at in range(0, len(cuts), 10000):
            some = list(zip(cuts[at : at + 10000].tolist(), ends[at : at + 10000].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[[s for s, _ in some]]), pa.array([_blob(key[s:e], np.uint64) for s, e in some], pa.binary())], ["shared_id", "seeds"])


_CONTEXT = (("key", np.uint64), ("name", np.uint64), ("doc", np.int64), ("print", np.int32), ("start", np.int64), ("count", np.uint8), ("bytes", np.uint8))


def _context_rows(n_buckets: int):
    """doc_id, text, wanted (seeds, as a list of blobs), copies (prints of texts to leave out) -> rows of contexts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            prints = np.array([text_print(t) for t in texts], np.int32)
            for i, copies in enumerate(batch.column(3).to_pylist()):
                if prints[i] in (copies or ()):
                    texts[i] = b""
            wanted = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column(2).to_pylist()]
            tags = [_mix(w + np.uint64(i)) for i, w in enumerate(wanted)]
            tags = np.unique(np.concatenate(tags)) if tags else np.empty(0, np.uint64)
            found: list[list[np.ndarray]] = []
            for data, bounds, text, place in _pieces(texts):
                seeds = Seeds(data, bounds)
                tag = _mix(seeds.key + text[seeds.piece].astype(np.uint64))
                spot = np.minimum(np.searchsorted(tags, tag), max(len(tags) - 1, 0))
                at = np.flatnonzero(tags[spot] == tag) if len(tags) else np.empty(0, np.int64)
                name, joined = seeds.contexts(at)
                piece = seeds.piece[at]
                start = seeds.start[at] - bounds[piece] + place[piece]
                found.append([seeds.key[at], name, ids[text[piece]], prints[text[piece]], start, seeds.count[at].astype(np.uint8), joined])
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found)]
            size = columns[5].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            rows = []
            for b, at in _by_bucket((columns[0] % np.uint64(n_buckets)).astype(np.int64)):
                n = size[at]
                inner = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((b, *(_blob(x[at], kind) for x, (_, kind) in zip(columns[:6], _CONTEXT)), columns[6][inner].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int64()) for i, x in enumerate(zip(*rows))], ["bucket", *(c for c, _ in _CONTEXT)])

    return run


def text_print(text: bytes) -> int:
    """Tells rows apart that have the same doc_id but another text."""
    return zlib.crc32(text) - (1 << 31)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text that goes round, in their order by at least ``LENGTH`` bytes."""
    n, known = len(text), 8
    wide = np.concatenate([text, np.resize(text, known)]).astype(np.uint64)
    key = wide[:n].copy()
    for i in range(1, known):
        key = (key << np.uint64(8)) | wide[i : i + n]
    while True:
        order = np.argsort(key)
        if known >= LENGTH:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        # Ranks of two neighbouring parts together are a rank of twice the length.
        key = rank * np.uint64(n) + np.roll(rank, -(known % n))
        known *= 2


class Shard:
    """The suffix order of a text, its transform, and where in the order the suffix one byte longer stands."""

    def __init__(self, text: np.ndarray):
        self.order = suffix_order(text)
        self.transform = text[self.order - 1]
        self.longer = np.empty(len(text), np.int32)
        self.longer[np.argsort(self.transform, kind="stable")] = np.arange(len(text), dtype=np.int32)


def interleave(shards: list[Shard], exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(at, common): the suffixes of all shards, numbered shard by shard in order, merged; bytes in common with the one before.

    Common prefixes are counted up to ``LENGTH``, and if they need not be ``exact``, by twos; suffixes that share so many bytes stand together in any
    order. A round takes two bytes of the transforms: that before a suffix, and that before the suffix one byte longer.
    """
    begin = np.cumsum([0] + [len(x.order) for x in shards])
    total = int(begin[-1])
    # What 16 bits can number takes little more than half the time.
    number = np.uint16 if total <= 1 << 16 else np.int32
    transform = np.concatenate([x.transform for x in shards])
    longer = np.concatenate([x.longer + np.int32(b) for x, b in zip(shards, begin)]).astype(number)
    two, twice = transform.take(longer).astype(np.uint16) << 8 | transform, longer.take(longer)
    at, block, rounds = np.arange(total, dtype=number), np.zeros(total, number), np.zeros(total, np.uint8)
    for _ in range(LENGTH // 2):
        symbol = two.take(at)
        stable = np.argsort(symbol, kind="stable")
        symbol, of = symbol.take(stable), block.take(stable)
        border = symbol[1:] != symbol[:-1]
        border |= of[1:] != of[:-1]
        # Borders never go, so the rounds without one say how many bytes neighbours share.
        rounds[1:] += ~border
        np.cumsum(border, out=block[1:], dtype=number)
        at = twice.take(at.take(stable))
    common = 2 * rounds
    if exact:
        shorter = np.empty(total, np.int64)
        shorter[longer] = np.arange(total)
        x, y = at[:-1].astype(np.int64), at[1:].astype(np.int64)
        for h in range(0, LENGTH, 2):
            # Neighbours of which only the first of two bytes is equal share one byte more; a suffix begins with the byte before the next.
            x, y = shorter[x], shorter[y]
            common[1:][(common[1:] == h) & (transform[x] == transform[y])] += 1
            x, y = shorter[x], shorter[y]
    return at, common


def least_documents(data: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string of each neighbourhood, in order, the smallest doc of the neighbourhoods that hold an equal one.

    Neighbourhood i is data[begin[i] : begin[i] + count[i] + LENGTH - 1], has the strings that start at its first count[i] bytes,
    and belongs to doc[i].
    """
    size = count + LENGTH
    ends = np.cumsum(size)
    inside = np.arange(ends[-1], dtype=np.int32) - np.repeat((ends - size).astype(np.int32), size)
    text = data[np.minimum(np.repeat(begin, size) + inside, len(data) - 1)]
    text[ends - 1] = STOP
    # Shards are whole neighbourhoods.
    cuts = np.r_[0, ends[np.flatnonzero(np.diff(ends // SHARD))], ends[-1]]
    cuts = np.unique(cuts)
    shards = [Shard(text[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
    at, common = interleave(shards, exact=False)
    place = np.concatenate([x.order + s for x, s in zip(shards, cuts)])[at]
    first = np.flatnonzero(common < LENGTH)
    starts = inside < np.repeat(count, size)
    # The documents of a repeated interval; what starts no string is later than any.
    of = np.where(starts, np.repeat(doc, size), np.iinfo(np.int64).max)[place]
    least = np.empty(ends[-1], np.int64)
    least[place] = np.repeat(np.minimum.reduceat(of, first), np.diff(np.r_[first, len(of)]))
    return least[starts]


def _removed_rows(merge: int = MERGE):
    """Contexts by bucket -> for each row of documents, the starts of strings that a smaller doc_id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _gathered(batches):
            key, name, doc, print_, start, count, data = (_join(x, kind) for x, (_, kind) in zip(columns, _CONTEXT))
            size = count.astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((doc, name, key))
            key, name = key[order], name[order]
            new_key = np.r_[True, key[1:] != key[:-1]]
            new = new_key | np.r_[True, name[1:] != name[:-1]]
            shard = np.cumsum(new) - 1  # of each occurrence; its first occurrence has the smallest doc
            at = order[new]
            s_doc, s_count, s_begin = doc[at], count[at].astype(np.int64), begin[at]
            group = np.cumsum(new_key)[new] - 1
            several = np.bincount(group)[group] > 1
            offs = np.cumsum(s_count) - s_count
            least = np.repeat(s_doc, s_count)
            many = np.flatnonzero(several)
            # Some seeds with all their neighbourhoods at a time.
            last = np.flatnonzero(np.r_[group[many][1:] != group[many][:-1], True]) + 1 if len(many) else np.empty(0, np.int64)
            upto = np.r_[0, np.cumsum(s_count[many] + LENGTH)]
            cut = 0
            while cut < len(many):
                stop = int(last[min(np.searchsorted(upto[last], upto[cut] + merge), len(last) - 1)])
                some = many[cut:stop]
                n = s_count[some]
                least[np.repeat(offs[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = least_documents(data, s_begin[some], n, s_doc[some])
                cut = stop
            n = s_count[shard]
            of = np.repeat(np.arange(len(order)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = least[offs[shard][of] + within] < doc[order][of]
            bits = np.bincount(of, gone * (2.0**within), len(order)).astype(np.int64)
            hit = np.flatnonzero(bits)
            hit = hit[np.lexsort((start[order][hit], print_[order][hit], doc[order][hit]))]
            rows = order[hit]
            yield from _removed_batches(doc[rows], print_[rows], start[rows], bits[hit])

    return run


def _removed_batches(doc, print_, start, bits) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (print_[1:] != print_[:-1])])
    ends = np.r_[cuts[1:], len(doc)]
    both = np.stack([start, bits], 1)
    for at in range(0, len(cuts), 10000):
        s, e = cuts[at : at + 10000], ends[at : at + 10000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(print_[s]), pa.array([_blob(both[i:j], np.int64) for i, j in zip(s, e)], pa.binary())], ["gone_id", "gone_print", "gone"])


_GONE = "gone_id long, gone_print int, gone binary"


def _hot_strings(hot):
    """doc_id, text -> a row for each string of a hot seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts = batch.column(0).to_numpy(), _texts(batch.column(1))
            prints = np.array([text_print(t) for t in texts], np.int32)
            for data, bounds, text, place in _pieces(texts):
                seeds = Seeds(data, bounds)
                at = np.flatnonzero(_is_in(seeds.key, hot.value))
                n = seeds.count[at]
                of = np.repeat(at, n)
                begin = seeds.start[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                raw, piece = data.tobytes(), seeds.piece[of]
                start = begin - bounds[piece] + place[piece]
                for a in range(0, len(of), 50000):
                    some = slice(a, a + 50000)
                    row = text[piece[some]]
                    yield pa.RecordBatch.from_arrays([pa.array([raw[b : b + LENGTH] for b in begin[some].tolist()], pa.binary()), pa.array(ids[row]), pa.array(prints[row]), pa.array(start[some])], ["string", "gone_id", "gone_print", "start"])

    return run


def _late(strings: DataFrame) -> DataFrame:
    """The rows of strings that a smaller doc_id has too."""
    spark = strings.sparkSession
    smallest = stash(strings.groupBy("string").agg(F.min("gone_id").alias("smallest"), F.max("gone_id").alias("largest"), F.count("*").alias("rows")).filter("smallest < largest").drop("largest"), "smallest")
    # The strings with most rows, a bounded number, go to where the rows are; of any other, few rows meet in a task.
    common = smallest.orderBy(F.desc("rows"), "string").limit(MOST_COMMON).select("string", "smallest")
    common = stash(common, "common")
    known = strings.join(F.broadcast(common), "string", "left")
    rest = strings.join(F.broadcast(common), "string", "left_anti").join(smallest.select("string", "smallest"), "string") if smallest.count() > MOST_COMMON else spark.createDataFrame([], known.schema)
    return known.unionByName(rest).filter("gone_id > smallest").select("gone_id", "gone_print", "start")


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, parts (print and blob), copies (prints of texts that go whole) -> what is left of each text."""
    for batch in _slices(batches):
        out: list[list] = [[], [], [], []]
        for text, parts, copies in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            n, kept, removed, spans = len(text), text, 0, 0
            own = text_print(text) if parts or copies else 0
            gone = [x["gone"] for x in parts or () if x["print"] == own]
            if own in (copies or ()) and n >= LENGTH:
                kept, removed, spans = b"", n, 1
            elif gone:
                mask = removed_mask(n, np.frombuffer(b"".join(gone), np.int64).reshape(-1, 2))
                kept, removed = np.frombuffer(text, np.uint8)[~mask].tobytes(), int(mask.sum())
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            for x, v in zip(out, (n, removed, spans, kept)):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def removed_mask(n: int, gone: np.ndarray) -> np.ndarray:
    """Bytes covered by strings at gone[:, 0] + i for each bit i of gone[:, 1]."""
    starts, bits = np.zeros(n + 1, bool), np.arange(LENGTH - SEED + 1)
    for at in range(0, len(gone), 1 << 14):
        some = gone[at : at + (1 << 14)]
        row, bit = np.nonzero((some[:, 1:] >> bits) & 1)
        starts[some[row, 0] + bit] = True
    # A byte is covered if a string starts at it or at one of the 49 before.
    so_far = np.cumsum(starts[:n], dtype=np.int64)
    so_far[LENGTH:] -= so_far[:-LENGTH].copy()
    return so_far > 0


def hot_seeds(named: DataFrame, hot: int = HOT) -> np.ndarray:
    """The commonest seeds with more than ``hot`` occurrences in tasks where they are frequent, at most ``MOST_HOT``, sorted."""
    counted = named.mapInArrow(_often_rows, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter(F.col("n") > hot)
    found = counted.orderBy(F.desc("n"), "seed").limit(MOST_HOT).select("seed").toArrow()["seed"].to_numpy()
    return np.sort(found.view(np.uint64))


def remove_repeats(docs: DataFrame, hot: int = HOT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    spark = docs.sparkSession
    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    named = read.filter("doc_id IS NOT NULL")
    with scope(spark):
        # A text's first document; later ones go whole. Only ids and digests are shuffled.
        digests = named.select("doc_id", F.unhex(F.md5("text")).alias("digest"), (F.crc32("text") - (1 << 31)).cast("int").alias("print"), F.octet_length("text").alias("size"))
        digests = stash(digests, "digests")
        if buckets is None:
            buckets = max(32, (digests.agg(F.sum("size").alias("n")).first()["n"] or 0) // BUCKET)
        # Buckets are of a bounded size, so partitions are too, however large the input.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // TOGETHER)
        least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1")
        copies = digests.join(least, "digest").filter("doc_id > least").groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set("print").alias("copies"))
        copies = keep(stash(copies, "copies"))
    with scope(spark):
        common = hot_seeds(named, hot)
        shared_hot = spark.sparkContext.broadcast(common)
        seeds = named.mapInArrow(_seed_rows(buckets, shared_hot), "bucket long, keys binary, docs binary")
        shared = stash(seeds.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_rows, "shared_id long, seeds binary"), "shared")
        wanted = shared.groupBy("shared_id").agg(F.collect_list("seeds").alias("wanted"))
        # One join takes the texts, by doc_id: what belongs to a document is put together before.
        wanted = wanted.join(copies, F.col("shared_id") == F.col("copy_id"), "left").select("shared_id", "wanted", "copies")
        joined = named.join(wanted, F.col("doc_id") == F.col("shared_id")).select("doc_id", "text", "wanted", "copies")
        rows = joined.mapInArrow(_context_rows(buckets), "bucket long, " + ", ".join(f"`{c}` binary" for c, _ in _CONTEXT))
        gone = stash(rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_removed_rows(), _GONE), "gone")
        if len(common):
            own = copies.select("copy_id", F.explode("copies").alias("copy_print"))
            first = named.join(own, (F.col("doc_id") == F.col("copy_id")) & ((F.crc32("text") - (1 << 31)).cast("int") == F.col("copy_print")), "left_anti")
            strings = stash(first.mapInArrow(_hot_strings(shared_hot), "string binary, gone_id long, gone_print int, start long"), "strings")
            pairs = "gone_id", "gone_print", F.concat(_little_endian("start"), F.unhex(F.lit("0100000000000000"))).alias("gone")
            gone = gone.unionByName(_late(strings).select(*pairs))
        by_id = gone.groupBy("gone_id").agg(F.collect_list(F.struct(F.col("gone_print").alias("print"), "gone")).alias("parts"))
        by_id = by_id.join(copies, F.col("gone_id") == F.col("copy_id"), "full").select(F.coalesce("gone_id", "copy_id").alias("gone_id"), "parts", "copies")
        by_id = keep(stash(by_id, "by_id"))
    out = read.join(by_id, F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "parts", "copies")
    return out.mapInArrow(_cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _little_endian(column: str):
    """The 8 bytes of a long, least first."""
    text = F.lpad(F.hex(column), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)]))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
