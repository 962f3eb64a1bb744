"""Byte-level BPE with the tiktoken library and a local file of ranks: encoding of whole texts, and decoding to raw bytes.

The library splits a text by a pattern and merges the bytes of each match. Long texts are cut first, so that it works on parts of
some ten thousand characters. A cut is safe only where no match can span it and no match before it looks past it: before white space after
a letter or digit, and between a letter or digit and a digit or mark that can't continue it. The part that follows then begins a match, as
it does in the whole text. What has no such place stays one part. Long runs of white space, on which the library's pattern
matching runs out of stack, are no match for a cut either: the pattern takes such a run as one piece, all but the last
character where more text follows, and this piece goes to the merges without the pattern. So the ids are those of the whole text.

Decoding joins the bytes of the ids; a token may be part of a character, so text is made of them only at the end, where all are together.

Defined results: a null text has the ids of an empty one, none; bytes that are no UTF-8 are read as U+FFFD; text that looks like a special token is
ordinary text; null ids decode to null; repeated rows and null keys stay as they are; an empty table gives an empty table; further columns are
carried along.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Characters of a part after which the next safe place is taken; the longest run of white space that goes through the pattern.
PART, RUN = 32768, 10000
#: Rows and characters (or ids) of a batch that a task passes on.
ROWS, HELD = 512, 1 << 21
#: The characters that the library's pattern takes for white space.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = regex.compile(f"[{_SPACES}]{{{RUN + 1},}}")
#: Safe places: letters and digits before a blank, letters before a digit or a plain mark, digits before a letter or a plain mark.
_SAFE = regex.compile(r"[0-9\p{L}](?=[ \n\t])|[A-Za-z\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF](?=[0-9.,;:!?()\u3001\u3002])|[0-9](?=[A-Za-z.,;:!?()])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """The text in parts whose ids can be joined, and whether a part is a single piece that the pattern must not see."""
    start = 0
    while start < len(text):
        run = _LONG_RUN.search(text, start) if len(text) - start > RUN else None
        end = run.start() if run else len(text)
        while end - start > size:
            cut = _SAFE.search(text, start + size, end)
            if not cut or cut.end() >= end:
                break
            yield text[start : cut.end()], False
            start = cut.end()
        if end > start:
            yield text[start:end], False
        if run is None:
            return
        # Followed by more text, the last character of the run belongs to what follows.
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : start], True


class Coder:
    """The library's encoding for a pattern and ranks."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, size: int = PART) -> list[int]:
        if len(text) <= RUN:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for part, piece in parts(text, size):
            out += self.encoding._encode_single_piece(part) if piece else self.encoding.encode_ordinary(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some rows, and fewer where values are long, so that no batch of results grows very large."""
    values = batch.column(column)
    lengths = (pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > HELD or i - start >= ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(table: DataFrame, source: str, target: str, kind, of, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """The table with ``target`` instead of a column of that name: of(coder, value of the column ``source``)."""
    shared = table.sparkSession.sparkContext.broadcast((pattern, ranks))
    names = [c for c in table.columns if c not in (target, source)]
    held = table.select(*names, source)
    schema = StructType([*held.select(*names).schema.fields, StructField(target, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        as_arrow = pa.binary() if isinstance(kind, BinaryType) else pa.list_(pa.int32())
        for batch in batches:
            for some in _slices(batch, source):
                out = pa.array([of(coder, x.as_py()) for x in some.column(source)], as_arrow)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), out], [*names, target])

    return held.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of docs but text, and ids: those of the text. The vocabulary has a fixed size and is broadcast."""
    raw = docs.withColumn("text", docs["text"].cast("string").cast("binary"))
    return _mapped(raw, "text", "ids", ArrayType(IntegerType()), lambda coder, x: coder.encode((x or b"").decode("utf-8", "replace")), pattern, ranks)


def decode_documents(coded: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of coded but ids, and raw: the bytes of the ids."""
    return _mapped(coded, "ids", "raw", BinaryType(), lambda coder, x: None if x is None else coder.decode(x), pattern, ranks)


def op12_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = public_tokenizers.PATTERN, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), *coder)
    listed = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    counted = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), listed.alias("ids_sha256"), "ids")
    return decode_documents(counted, *coder).select("doc_id", "n_tokens", "ids_sha256", F.sha2("raw", 256).alias("decoded_sha256"))
