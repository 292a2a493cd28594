"""Token ids in compressed binary files: canonical length-limited Huffman coding from global counts.

Four tables in a folder: ``ids`` (each document's ids as encoded), ``codes`` (one row: the code lengths and the
format's parameters), ``blocks`` and ``parts`` (a row a file of blocks: the ids in all files before it). A block holds the codes of
consecutive documents in ascending doc_id order, their ids and lengths, the number of ids before it in its file, and the bit offset of
every ``CHECKPOINT``-th code. A block can be decoded without any other, and within it all checkpoints are decoded side by side
through one table of 2 ** MOST_BITS entries.

Null and empty texts hold the end id alone. Rows with equal ids keep one place each, in an order by their ids' bytes.
An empty table has no blocks. Columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_pieces import PieceEncoder, kept_encoder
from .common import pieces, shared_dir, text_columns, written

VOCABULARY = "byte_bpe_50k.json"
END = 0
MOST_BITS = 16
CHECKPOINT = 256
#: Ids in a block, at least; a document is never split.
BLOCK_IDS = 500_000
SYMBOLS = 1 << 16
#: Pieces that the library gets in one string.
TOGETHER = 100
BLOCKS = "part int, docs array<long>, sizes array<long>, ahead long, n long, bits binary, points binary"


def flat(column: pa.Array) -> np.ndarray:
    """The 16-bit ids of all rows of a binary column, without a copy."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, "<u2")
    cut = np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[1]].view("<u2")


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Code lengths of at most ``most`` bits for all symbols that occur: Huffman's, then Kraft's sum restored by
    lengthening the rarest of the codes that are still shorter than the limit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    heap = [(int(counts[s]), i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(used) - 1, np.int64)
    for node in range(len(used), 2 * len(used) - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(2 * len(used) - 1, np.int64)
    for node in range(2 * len(used) - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    depth = np.minimum(depth[: len(used)], most)
    order = np.lexsort((used, counts[used]))
    over = int((1 << (most - depth)).sum()) - (1 << most)
    for i in order:
        while over > 0 and depth[i] < most:
            over -= 1 << (most - depth[i] - 1)
            depth[i] += 1
        if over <= 0:
            break
    for i in order[::-1]:  # what was saved too much goes to the most frequent
        while depth[i] > 1 and over + (1 << (most - depth[i])) <= 0:
            over += 1 << (most - depth[i])
            depth[i] -= 1
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    for bits in range(1, MOST_BITS + 1):
        own = np.flatnonzero(lengths == bits)
        codes[own] = code + np.arange(len(own))
        code = (code + len(own)) << 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """(the codes' bits, their number, the bit offset of every CHECKPOINT-th code)."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    bits = int(size.sum())
    words = np.zeros(bits // 64 + 2, np.uint64)
    if not len(ids):
        return b"", 0, at
    word, room = at >> 6, 64 - (at & 63)
    spill = size - room
    code = codes[ids].astype(np.uint64)
    here = np.where(spill <= 0, code << np.maximum(-spill, 0).astype(np.uint64), code >> np.maximum(spill, 0).astype(np.uint64))
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[heads]] = np.bitwise_or.reduceat(here, heads)
    over = np.flatnonzero(spill > 0)
    words[word[over] + 1] |= code[over] << (64 - spill[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (bits + 7) // 8], bits, at[::CHECKPOINT]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) for each value of the next MOST_BITS bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MOST_BITS - lengths[order].astype(np.int64))
    symbols, sizes = np.repeat(order, span), np.repeat(lengths[order], span)
    rest = (1 << MOST_BITS) - len(symbols)
    return np.pad(symbols, (0, rest)).astype(np.uint16), np.pad(sizes, (0, rest), constant_values=1)


def unpack(bits: bytes, n: int, points: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block: step k decodes the k-th id after each checkpoint."""
    symbols, widths = table
    data = np.frombuffer(bits + bytes(8), np.uint8)
    window = data[:-3].astype(np.uint32) << 24 | data[1:-2].astype(np.uint32) << 16 | data[2:-1].astype(np.uint32) << 8 | data[3:]
    out = np.zeros((CHECKPOINT, len(points)), np.uint16)
    at, last = points.astype(np.int64), n - (len(points) - 1) * CHECKPOINT
    for k in range(CHECKPOINT):
        if k == last:
            at = at[:-1]
        look = window[at >> 3] >> (32 - MOST_BITS - (at & 7)).astype(np.uint32) & np.uint32(SYMBOLS - 1)
        out[k, : len(at)] = symbols[look]
        at = at + widths[look]
    return out.T.reshape(-1)[:n]


def library_encoder(place: str) -> PieceEncoder:
    """The tokenizers library's encoder of a byte-level BPE file.

    The pattern's matches go to the file's model as the file's pre-tokenizer would hand them over: each byte as the character that
    byte-level vocabularies write for it, matches apart by a space, which is no such character.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole, model = Tokenizer.from_file(place), Tokenizer.from_file(place)
    whole.encode_special_tokens = model.encode_special_tokens = True
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = np.zeros(256, np.uint32)
    letter[shown] = shown
    letter[np.setdiff1d(np.arange(256), shown)] = np.arange(256, 512 - len(shown))
    size = np.zeros(SYMBOLS, np.int64)
    for token, i in whole.get_vocab().items():
        size[i] = len(token)

    def encode_many(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        spaced = np.full(len(data) + len(sizes), ord(" "), np.uint32)
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = letter[data]
        text, cut = spaced.astype("<u4").tobytes().decode("utf-32-le"), (ends + np.arange(1, len(sizes) + 1)).tolist()
        lines = [text[a : b - 1] for a, b in zip([0, *cut[TOGETHER - 1 : -1 : TOGETHER]], [*cut[TOGETHER - 1 : -1 : TOGETHER], cut[-1]], strict=True)]
        ids = np.concatenate([np.array(x, np.uint16) for x in (e.ids for e in model.encode_batch_fast(lines, add_special_tokens=False))])
        # A piece's ids are those whose bytes end within it.
        last = np.searchsorted(np.cumsum(size[ids]), ends)
        return ids, np.diff(last + 1, prepend=0)

    return PieceEncoder(encode_many, encode_pieces)


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, each followed by ``end``, and write the three tables into ``folder``.

    Ids must be below 65536. ``path`` is the vocabulary's place on every executor; None: that of public_tokenizers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as P

        place = path or P.path(VOCABULARY)
        own = kept_encoder(("tokenizers", place), lambda: library_encoder(place))
        for doc, data, offsets in pieces(batches):
            ids, cut = own(data, offsets)
            ids = np.insert(ids, cut[1:], np.uint16(end))
            cut = cut + np.arange(len(cut))
            raw = ids.astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.diff(cut)), pa.array([raw[2 * a : 2 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "n", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0)), minlength=SYMBOLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    ids = written(text_columns(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n long, ids binary"), folder, "ids")
    counts = np.zeros(SYMBOLS, np.int64)
    for symbol, n in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).toLocalIterator():
        counts[symbol] = n
    lengths = code_lengths(counts)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()), MOST_BITS, CHECKPOINT, end)], "lengths binary, most_bits int, checkpoint int, end_id int").write.parquet(f"{folder}/codes")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, codes = TaskContext.get().partitionId(), canonical(lengths)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = ahead = 0

        def out() -> pa.RecordBatch:
            docs, sizes, own = (np.concatenate(x) for x in zip(*held, strict=True))
            bits, _, points = pack(own, lengths, codes)
            values = [part, docs, sizes, ahead, len(own), bits, points.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "docs", "sizes", "ahead", "n", "bits", "points"])

        for batch in batches:
            docs, sizes, own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat(batch.column(2))
            cut, at = np.concatenate(([0], np.cumsum(sizes))), 0
            while at < len(docs):  # up to the first document that fills the block
                to = min(int(np.searchsorted(cut, cut[at] + BLOCK_IDS - n)), len(docs))
                held.append((docs[at:to], sizes[at:to], own[cut[at] : cut[to]].copy()))
                n, at = n + int(cut[to] - cut[at]), to
                if n >= BLOCK_IDS:
                    yield out()
                    held, ahead, n = [], ahead + n, 0
        if held:
            yield out()

    # Ranges are sampled from the ids of documents alone; rows with one doc_id stay together.
    in_order = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    in_order.mapInArrow(to_blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    # One row a file: the ids in all files before it.
    rows = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, bases = 0, []
    for part, n in sorted(rows):
        bases.append((part, base))
        base += n
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit), from the files."""
    codes = spark.read.parquet(f"{folder}/codes").first()
    lengths = np.frombuffer(bytes(codes["lengths"]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    placed = blocks.join(F.broadcast(spark.read.schema("part int, base long").parquet(f"{folder}/parts")), "part").select("docs", "sizes", "bits", "points", (F.col("base") + F.col("ahead")).alias("start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for docs, sizes, bits, points, start in zip(*batch.columns, strict=True):
                n = sizes.values.to_numpy()
                cut = np.concatenate(([0], np.cumsum(n)))
                ids = unpack(bits.as_py(), int(cut[-1]), np.frombuffer(points.as_buffer(), "<i8"), table)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(cut[:-1] + start.as_py()), pa.array(n), pa.array([raw[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_back.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``write`` into a new folder of the shared ones, then ``read``."""
    folder = shared_dir(docs.sparkSession)
    write(docs, folder, path)
    return read(docs.sparkSession, folder)
