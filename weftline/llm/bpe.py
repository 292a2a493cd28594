"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every match of the pattern is encoded by itself and without special tokens, as ``Encoding.encode_ordinary`` does; the
ids of a batch are decoded through a table of raw bytes, so that tokens that hold parts of a character need no care.

Null and empty texts have no ids. Repeated rows and repeated ids are encoded row by row. Very long texts are cut at safe
boundaries. Columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_pieces import PieceEncoder
from .common import pieces, ranges, text_columns

RANKS = "byte_bpe_50k.tiktoken"


def load_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


class ByteTable:
    """Raw bytes of runs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks, key=ranks.get)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[ranks[x] for x in order]] = [len(x) for x in order]
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(order), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.at[ids], self.size[ids])]


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 16-bit integers), and decoded (the bytes of those ids) with ``texts``.

    ``path`` is the rank file's place on every executor; None means that of the public_tokenizers package. Ranks must be
    below 65536.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as P

        encoding, ranks = load_encoding(path or P.path(RANKS), pattern or P.PATTERN)
        encode, decode = PieceEncoder(lambda xs: [encoding.encode_ordinary(x) for x in xs]), ByteTable(ranks)
        for doc, data, offsets in pieces(batches):
            ids, cut = encode(data, offsets)
            raw = ids.astype("<u2").tobytes()
            columns = [pa.array(doc), pa.array(np.diff(cut)), pa.array([raw[2 * a : 2 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())]
            if texts:
                back, ends = decode(ids).tobytes(), np.concatenate(([0], np.cumsum(decode.size[ids])))[cut]
                columns.append(pa.array([back[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * texts)


def digests(tokens: DataFrame) -> DataFrame:
    """ids_sha256 (of decimal ids with one space between) and decoded_sha256 of what ``encoded`` returns with texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = np.array([b"%d " % i for i in range(1 << 16)], "S6")
        for batch in batches:
            ids = [hashlib.sha256(decimal[np.frombuffer(x.as_buffer(), "<u2")].tobytes().translate(None, b"\0")[:-1]).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
