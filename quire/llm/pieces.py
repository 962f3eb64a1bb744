"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and lossless decoding.

A text is read as a lattice of pieces. Forward filtering sums, for each position, the weights of all ways to reach it;
backward sampling then draws the last piece, the one before it, and so on, each with its share of that sum, which draws
a segmentation with exactly its probability under the product of piece weights. Draws are seeded by the row key, the
place in the text and the seed, so a row is segmented alike however rows are dealt to tasks.

The vocabulary used here was made by merging pairs: its scores are ranks of merges, no probabilities. A piece of rank r
weighs 1 / (r + 3) ** SHARPNESS, as word frequencies fall with rank; a vocabulary whose scores are log-probabilities
can be used as it is (``by_rank=False``). Pieces hold the mark of a space only at their start, and no piece
holds a character that has none itself, so a lattice falls apart between words: equal words of a batch share one
forward pass. Where a vocabulary has a mark inside a piece, a text is one lattice.

Characters without a piece, and a literal U+2581, become the byte pieces of their UTF-8. Encoding puts one space before a
text, decoding removes it, and nothing else is changed: decoding gives the text back.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; repeated rows are segmented
alike; a null key is a key; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, SHARPNESS = 17, 1.0
MARK = 0x2581
#: Stands for a literal U+2581, beyond Unicode so that no piece holds it.
LITERAL = 0x110000
#: Characters and rows segmented together. Longer parts share more words, but take more memory.
PART, ROWS = 100_000, 200
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLOT = np.uint64(46)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of a well-known 64-bit generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Vocabulary:
    """Pieces as UTF-8 with spaces for marks, their weights, and tables that find a piece by the hash of its characters."""

    pieces: list[bytes]
    weights: np.ndarray
    byte_ids: np.ndarray
    longest: int
    splits: bool
    held: np.ndarray
    tables: list
    #: The k-th characters of all pieces, by id.
    spelled: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL, sharpness: float = SHARPNESS, by_rank: bool = True) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = [(sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i), sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(sp.get_piece_size())]
        return cls.of(rows, sharpness, by_rank)

    @classmethod
    def of(cls, rows: list[tuple[str, float, bool, bool]], sharpness: float = SHARPNESS, by_rank: bool = True) -> Vocabulary:
        """rows: (piece, score, whether it is a byte, whether it is never used), by id."""
        byte_ids, weights, pieces, usable = np.full(256, -1, np.int32), np.zeros(len(rows)), [], []
        for i, (piece, score, is_byte, unused) in enumerate(rows):
            if is_byte:
                byte_ids[int(piece[3:5], 16)] = i
                pieces.append(bytes([int(piece[3:5], 16)]))
                continue
            pieces.append(b"" if unused else piece.replace(chr(MARK), " ").encode())
            if not unused and piece:
                usable.append(i)
                weights[i] = (min(max(-score, 0), len(rows)) + 3) ** -sharpness if by_rank else np.exp(score)
        codes = {i: np.frombuffer(rows[i][0].encode("utf-32-le"), np.uint32) for i in usable}
        held = np.zeros(LITERAL + 1, bool)
        for c in codes.values():
            held[c] = True
        inside = any(chr(MARK) in rows[i][0].lstrip(chr(MARK)) for i in usable)
        longest = max((len(c) for c in codes.values()), default=1)
        found = np.array(usable, np.int32)
        hashes = np.array([_hash(codes[i]) for i in usable], np.uint64)
        spelled = np.full((longest, len(rows)), 0xFFFFFFFF, np.uint32)
        for i, c in codes.items():
            spelled[: len(c), i] = c
        return cls(pieces, weights, byte_ids, longest, not inside, held, _tables(hashes, found), spelled)

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """Ids of the pieces that are the k characters from each start on, -1 where there is none.

        The hash of these characters says where to look, the characters themselves decide.
        """
        out = np.full(len(hashes), -1, np.int32)
        for factor, keys, ids in self.tables:
            at = (hashes * factor) >> _SLOT
            hit = np.flatnonzero(keys[at] == hashes)
            found, begin = ids[at[hit]], starts[hit]
            right = found >= 0
            for i in range(k):
                right &= self.spelled[i][found] == codes[begin + i]
            out[hit[right]] = found[right]
        return out


def _prefix_sums(codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])


def _hash(codes: np.ndarray) -> np.uint64:
    return _prefix_sums(codes, _powers(_P, len(codes)))[-1]


def _tables(hashes: np.ndarray, ids: np.ndarray) -> list:
    """Tables of 2**18 slots; what meets a taken slot goes to the next table."""
    out, rng = [], np.random.default_rng(1)
    while len(hashes):
        factor = rng.integers(1 << 62, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at, first = np.unique((hashes * factor) >> _SLOT, return_index=True)
        keys, found = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32)
        keys[at], found[at] = hashes[first], ids[first]
        out.append((factor, keys, found))
        rest = np.ones(len(hashes), bool)
        rest[first] = False
        hashes, ids = hashes[rest], ids[rest]
    return out


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32).copy()
    literal = codes == MARK
    codes[codes == 0x20] = MARK
    codes[literal] = LITERAL
    return codes


def _forward(vocabulary: Vocabulary, codes: np.ndarray, off: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For units at off in codes: (shares, ids, level, rank). Position p of a unit is row level[p] + rank[unit].

    A row of shares has the cumulative shares, by length, of the pieces that end there; a row of ids the pieces that
    start there (-1: none; length 1 always may be taken, as bytes). Units are laid out longest first and position by
    position, so that each step of the sums below works on neighbouring rows.
    """
    n, width = len(codes), vocabulary.longest
    order = np.argsort(-lens, kind="stable")
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    deepest = int(lens.max())
    active = len(lens) - np.searchsorted(np.sort(lens), np.arange(deepest), "right")
    level = np.r_[0, np.cumsum(active)[:-1]]
    inside = np.arange(n) - np.repeat(off, lens)
    row = level[inside] + np.repeat(rank, lens)
    up, down = _powers(_P, n), _powers(_P_INVERSE, n)
    sums = _prefix_sums(codes, up)
    left = np.repeat(lens, lens) - inside
    ids, weight = np.full((n, width), -1, np.int32), np.zeros((width, n))
    at = np.arange(n)
    for k in range(1, width + 1):
        at = at[left[at] >= k]
        found = vocabulary.find((sums[at + k] - sums[at]) * down[at], codes, at, k)
        hit = found >= 0
        starts, found = at[hit], found[hit]
        ids[row[starts], k - 1] = found
        # A constant factor for each character changes no share and keeps sums in range.
        weight[k - 1, row[starts + k - 1]] = vocabulary.weights[found] * 100.0**k
        if k == 1:
            weight[0, row[at[~hit]]] = 1e-6
    shares = np.empty((width, n), np.float32)
    sums_at = [np.ones(len(lens))]  # of the last positions, the nearest first
    for t in range(deepest):
        rows = slice(level[t], level[t] + active[t])
        total, k = np.zeros(active[t]), len(sums_at)
        for i, before in enumerate(sums_at):
            total = total + before[: active[t]] * weight[i, rows]
            shares[i, rows] = total
        shares[:k, rows] /= total
        shares[k - 1 :, rows] = 1.0
        sums_at = [total, *(x[: active[t]] for x in sums_at[: width - 1])]
        if t % 16 == 15:
            sums_at = [x / total for x in sums_at]
    return np.ascontiguousarray(shares.T), ids, level, rank


def _equal_units(codes: np.ndarray, at: np.ndarray, lens: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, unit): an index of each different unit, and which of these every unit equals.

    Names only say which units to compare; a unit that differs from the first of its name is one of its own.
    """
    _, first, unit = np.unique(name, return_index=True, return_inverse=True)
    like = first[unit]
    other = np.minimum(np.repeat(at[like] - at, lens) + np.arange(len(codes)), len(codes) - 1)
    differs = np.logical_or.reduceat(codes != codes[other], at) | (lens != lens[like])
    own = np.flatnonzero(differs)
    unit[own] = len(first) + np.arange(len(own))
    return np.r_[first, own], unit


def _segment(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    parts = [_codes(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes, doc_at = np.concatenate(parts), np.r_[0, np.cumsum(sizes)]
    n = len(codes)
    starts = np.zeros(n, bool)
    if vocabulary.splits:
        mark = codes == MARK
        alone = ~vocabulary.held[codes]
        starts[1:] = (mark[1:] & ~mark[:-1]) | alone[1:] | alone[:-1]
    starts[doc_at[:-1]] = True
    at = np.flatnonzero(starts)
    lens = np.diff(np.r_[at, n])
    up, down = _powers(_P, n), _powers(_P_INVERSE, n)
    sums = _prefix_sums(codes, up)
    name = _mix((sums[at + lens] - sums[at]) * down[at]) ^ lens.astype(np.uint64)
    first, unit = _equal_units(codes, at, lens, name)
    u_lens = lens[first]
    u_off = np.r_[0, np.cumsum(u_lens)[:-1]]
    u_codes = codes[np.repeat(at[first] - u_off, u_lens) + np.arange(u_lens.sum())]
    shares, ids, level, rank = _forward(vocabulary, u_codes, u_off, u_lens)
    # Backward: every unit draws the piece that ends at its open position, from the end of the unit to its start.
    chosen = np.full(n, -2, np.int32)
    salt = np.repeat(keys, np.diff(np.searchsorted(at, doc_at)))
    place = (at - np.repeat(doc_at[:-1], np.diff(np.searchsorted(at, doc_at)))).astype(np.uint64)
    base, open_, source = rank[unit], lens.copy(), at
    while len(open_):
        draw = _mix(salt + (place + open_.astype(np.uint64)) * _P)
        r = (draw >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        length = 1 + (r[:, None] >= shares[level[open_ - 1] + base]).sum(1)
        open_ = open_ - length
        chosen[source + open_] = ids[level[open_] + base, length - 1]
        go = open_ > 0
        base, open_, source, salt, place = base[go], open_[go], source[go], salt[go], place[go]
    # Characters without a piece become bytes.
    taken = np.flatnonzero(chosen != -2)
    found = chosen[taken]
    counts = np.ones(len(taken), np.int64)
    as_bytes = found == -1
    if as_bytes.any():
        chars = codes[taken[as_bytes]]
        chars = np.where(chars == LITERAL, MARK, chars)
        # A mark that stands for a space and has no piece is a space again.
        chars = np.where((codes[taken[as_bytes]] == MARK), 0x20, chars)
        raw = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        counts[as_bytes] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        out = np.repeat(found, counts)
        out[np.repeat(as_bytes, counts)] = vocabulary.byte_ids[raw]
    else:
        out = found
    ends = np.r_[0, np.cumsum(counts)][np.searchsorted(taken, doc_at)]
    return [out[s:e] for s, e in zip(ends[:-1], ends[1:])]


def encode(vocabulary: Vocabulary, texts: list[str | None], keys: list, seed: int = SEED) -> list[np.ndarray | None]:
    """Sampled ids of each text; null for null."""
    out: list[np.ndarray | None] = [None if t is None else np.empty(0, np.int32) for t in texts]
    part: list[int] = []
    size = 0

    def flush() -> None:
        hashed = np.array([xxhash.xxh64_intdigest(str(keys[i]).encode(), seed) for i in part], np.uint64)
        for i, ids in zip(part, _segment(vocabulary, [texts[i] for i in part], hashed)):
            out[i] = ids

    for i, t in enumerate(texts):
        if t:
            part.append(i)
            size += len(t)
            if size >= PART:
                flush()
                part, size = [], 0
    if part:
        flush()
    return out


def decode(vocabulary: Vocabulary, rows: list[np.ndarray | None]) -> list[str | None]:
    """Texts of rows of ids; bytes that are no UTF-8, which encoding never gives, become replacement characters."""
    if not hasattr(vocabulary, "_blob"):
        lens = np.array([len(p) for p in vocabulary.pieces], np.int64)
        vocabulary._blob = (np.frombuffer(b"".join(vocabulary.pieces), np.uint8), lens, np.r_[0, np.cumsum(lens)[:-1]])
    blob, lens, offs = vocabulary._blob
    out: list[str | None] = []
    for ids in rows:
        if ids is None or not len(ids):
            out.append(None if ids is None else "")
            continue
        n = lens[ids]
        ends = np.cumsum(n)
        raw = blob[np.repeat(offs[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
    return out


def encode_documents(docs: DataFrame, path: str = MODEL, key: str = "doc_id", seed: int = SEED, sharpness: float = SHARPNESS, keep: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """key, ids, n_tokens, lossless (whether decoding the ids gave the text back), the columns of keep, and the decoded text if asked for.

    The vocabulary has a fixed size and is broadcast, so executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, sharpness))
    read = docs.select(docs[key].alias("own_key"), docs["text"].cast("string").alias("own_text"), *[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts = rows.column(1).to_pylist()
                ids = encode(vocabulary, texts, rows.column(0).to_pylist(), seed)
                back = decode(vocabulary, ids)
                offsets = np.r_[0, np.cumsum([0 if x is None else len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
                columns = [rows.column(0), column, pa.array([0 if x is None else len(x) for x in ids], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])]
                columns += [rows.column(2 + i) for i in range(len(keep))] + ([pa.array(back, pa.string())] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    kinds = [f"`{key}` {read.schema['own_key'].dataType.simpleString()}", "ids array<int>", "n_tokens long", "lossless boolean"]
    kinds += [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["text string"] * decoded
    schema = docs.sparkSession.createDataFrame([], ", ".join(kinds)).schema
    return read.mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
