"""FASTA and FASTQ files as Python data sources that read byte ranges side by side.

``fasta_pieces`` gives sequences in pieces with their places, for genomes: no sequence is ever one value. Without an index a task reads
the records whose header starts in its range, to their ends. With the offset index that ``write_index`` makes, every range is a task of its own,
even in the middle of a one-line chromosome: the index holds, for each range, the sequence that goes on there and how many of its characters
come before. Filters on seq_id and at skip the ranges, and the pieces within them, that can't match.
``fasta_records`` and ``fastq_records`` give whole records, for reads.

Paths are local or of a store that pyarrow opens; a folder's files are read in order of name, those starting with '.' or '_' aside.
Names end at the first white space and have at most NAME_BYTES; a header without one names ''. Lines before the first header, empty lines and
carriage returns are no sequence. Records without sequence give no piece, but a whole record. A FASTQ record has four lines.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Characters of a piece, which starts at a multiple of it, plus 1.
PIECE = 1 << 14
#: Bytes of a task's range.
BLOCK = 32 << 20
BUFFER = 1 << 20
NAME_BYTES = 1 << 16
#: A range with more names than this is never skipped by name.
LISTED_NAMES = 256
_WHITE = b" \t\r\n\v\f"


@dataclass(frozen=True)
class State:
    """Where a scan stands: in a header of which ``header`` is known, or ``base`` characters into the sequence seq_id."""

    seq_id: str | None = None
    base: int = 0
    header: bytes | None = None
    line_start: bool = True


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    state: State | None = None


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path within its store, bytes) of a file or of a folder's files."""
    from pyarrow import fs

    home, root = store(path)
    info = home.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = home.get_file_info(fs.FileSelector(root))
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[0] not in "._")


def ranges(path: str, block: int) -> list[Range]:
    return [Range(name, a, min(a + block, size)) for name, size in files(path) for a in range(0, size, block)]


def buffers(stream, start: int, end: int | None = None) -> Iterator[bytes]:
    stream.seek(start)
    while end is None or start < end:
        got = stream.read(BUFFER if end is None else min(BUFFER, end - start))
        if not got:
            return
        start += len(got)
        yield got


def name_of(header: bytes) -> str:
    return re.match(rb"\S*", header)[0].decode(errors="replace")


class Scan:
    """Reads FASTA text buffer by buffer. ``feed`` gives (state before, characters) of stretches of one sequence, and (state, None) at each header's end."""

    def __init__(self, state: State):
        self.state = state

    def feed(self, text: bytes) -> Iterator[tuple[State, bytes | None]]:
        at, now = 0, self.state
        while at < len(text):
            if now.header is not None:
                end = text.find(b"\n", at)
                known = (now.header + text[at : end if end >= 0 else len(text)])[:NAME_BYTES]
                if end < 0:
                    now, at = replace(now, header=known), len(text)
                    continue
                now, at = State(name_of(known)), end + 1
                yield now, None
            elif now.line_start and text[at] == 62:
                now, at = State(header=b""), at + 1
            else:
                end = text.find(b"\n>", at)
                end = end + 1 if end >= 0 else len(text)
                part = text[at:end].translate(None, _WHITE)
                if part:
                    yield now, part
                now, at = replace(now, base=now.base + len(part), line_start=text[end - 1] == 10), end
        self.state = now


def after(summary: dict, state: State) -> State:
    """The state at a range's end from that at its start and the range's ``summary``."""
    if state.header is not None and summary["line"] is not None:
        known = (state.header + summary["line"])[:NAME_BYTES]
        state = replace(state, header=known) if summary["open"] else State(name_of(known))
    else:
        state = replace(state, base=state.base + summary["in_line"], line_start=not summary["open"])
    if summary["ended"] is not None:
        return State(**summary["ended"])
    return replace(state, base=state.base + summary["more"], line_start=summary["line_start"]) if not summary["open"] else state


def summary(home, where: Range) -> dict:
    """What a range does to a state that is not known yet.

    line and in_line: the rest of the line that goes on at its start, as a name's bytes and as a number of characters; open: that line goes on at its
    end; ended: the state at its end if a header starts in it; more: characters after the first line, before any header; names: of its headers.
    """
    with home.open_input_file(where.path) as stream:
        first = where.start == 0
        if not first:
            stream.seek(where.start - 1)
            first = stream.read(1) == b"\n"
        out = {"line": None if first else b"", "in_line": 0, "open": not first, "ended": None, "more": 0, "line_start": True, "names": [], "n_names": 0}
        scan, seen = Scan(State()), False
        for text in buffers(stream, where.start, where.end):
            if out["open"]:
                end = text.find(b"\n")
                head = text[: end if end >= 0 else len(text)]
                out["line"], out["in_line"] = (out["line"] + head)[:NAME_BYTES], out["in_line"] + len(head.translate(None, _WHITE))
                if end < 0:
                    continue
                out["open"], text = False, text[end + 1 :]
            for state, part in scan.feed(text):
                if part is None:
                    seen, out["n_names"] = True, out["n_names"] + 1
                    if len(out["names"]) <= LISTED_NAMES:
                        out["names"].append(state.seq_id)
                elif not seen:
                    out["more"] += len(part)
        now = scan.state
        if seen or now.header is not None:
            out["ended"] = {"seq_id": now.seq_id, "base": now.base, "header": now.header, "line_start": now.line_start}
        out["line_start"] = now.line_start
        return out


INDEX = "path string, start long, end long, seq_id string, base long, header binary, line_start boolean, names array<string>, last long"


def write_index(spark: SparkSession, path: str, index: str, block: int = BLOCK) -> None:
    """Writes a row a range of the file: the state at its start, the names in it (null if too many) and, in a range of one sequence, its last place.

    The ranges are summed up side by side; the driver gets a summary of each, whose size doesn't grow with the file's records.
    """
    home, _ = store(path)
    cut = ranges(path, block)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            for n, name, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict({"n": [n], "summary": [pickle.dumps(summary(home, Range(name, start, end)))]})

    rows = [(n, x.path, x.start, x.end) for n, x in enumerate(cut)]
    asked = spark.createDataFrame(rows, "n long, path string, start long, end long").repartition(max(1, min(len(rows), 10_000)), "n")
    import pickle

    found = {r.n: pickle.loads(r.summary) for r in asked.mapInArrow(summed, "n long, summary binary").toLocalIterator()}
    out, state = [], State()
    for n, x in enumerate(cut):
        state = State() if x.start == 0 else state
        end = after(found[n], state)
        names = {*found[n]["names"], *([state.seq_id] if state.seq_id is not None else [])}
        if state.header is not None and found[n]["line"] is not None and not found[n]["open"]:
            names.add(name_of((state.header + found[n]["line"])[:NAME_BYTES]))
        few = found[n]["n_names"] <= LISTED_NAMES
        alone = found[n]["n_names"] <= (state.seq_id is None) and state.header is None and end.header is None
        out.append((x.path, x.start, x.end, state.seq_id, state.base, state.header, state.line_start, sorted(names) if few else None, end.base if alone else None))
        state = end
    spark.createDataFrame(out, INDEX).coalesce(1).write.mode("overwrite").parquet(index)


def indexed(index: str, names: set[str] | None, low: int, high: int) -> list[Range]:
    """The index's ranges that may hold a piece of one of the names between the places low and high."""
    import pyarrow.parquet as pq

    home, root = store(index)
    rows = [r for name, _ in files(index) for r in pq.read_table(name, filesystem=home).to_pylist()]
    out = []
    for r in sorted(rows, key=lambda r: (r["path"], r["start"])):
        fits = names is None or r["names"] is None or bool(names & set(r["names"]))
        if r["last"] is not None and (r["last"] < low or r["base"] >= high):
            fits = False
        if fits:
            out.append(Range(r["path"], r["start"], r["end"], State(r["seq_id"], r["base"], r["header"], r["line_start"])))
    return out


class PiecesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index, self.piece, self.block = options["path"], options.get("index"), int(options.get("piece", PIECE)), int(options.get("block", BLOCK))
        self.names: set[str] | None = None
        self.low, self.high = 1, 1 << 62

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        """Names are tested here; places only narrow what is read, as a piece covers many."""
        for f in filters:
            column = tuple(getattr(f, "attribute", ()))
            if column == ("seq_id",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
                continue
            if column == ("at",):
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            yield f

    def partitions(self):
        found = indexed(self.index, self.names, self.low, self.high) if self.index else ranges(self.path, self.block)
        return found or [Range("", 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        home, _ = store(self.path)
        with home.open_input_file(partition.path) as stream:
            yield from self.known(stream, partition) if partition.state else self.by_header(stream, partition)

    def known(self, stream, part: Range) -> Iterator[pa.RecordBatch]:
        scan = Scan(part.state)
        for text in buffers(stream, part.start, part.end):
            yield from self.batches(scan.feed(text))

    def by_header(self, stream, part: Range) -> Iterator[pa.RecordBatch]:
        """The records whose header starts in the range."""
        for start, end in self.records(stream, part):
            scan = Scan(State())
            for text in buffers(stream, start, end):
                yield from self.batches(scan.feed(text))

    def records(self, stream, part: Range) -> Iterator[tuple[int, int | None]]:
        """One byte range: from the first header in the range to the first header behind it."""
        start = next_header(stream, part.start)
        if start is not None and start < part.end:
            yield start, next_header(stream, part.end)

    def batches(self, found) -> Iterator[pa.RecordBatch]:
        ids, ats, parts = [], [], []
        for state, text in found:
            if text is None or state.seq_id is None or self.names is not None and state.seq_id not in self.names:
                continue
            at = state.base
            while at < state.base + len(text):
                to = min((at // self.piece + 1) * self.piece, state.base + len(text))
                if self.low <= at + 1 <= self.high:
                    ids.append(state.seq_id)
                    ats.append(at + 1)
                    parts.append(text[at - state.base : to - state.base])
                at = to
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ats, pa.int64()), pa.array(parts, pa.binary()).cast(pa.string())], ["seq_id", "at", "part"])


def next_header(stream, start: int) -> int | None:
    """The place of the first '>' at a line's start, at or behind ``start``; None if there is none."""
    at = max(start - 1, 0)
    if start == 0:
        stream.seek(0)
        if stream.read(1) == b">":
            return 0
    held = b""
    for text in buffers(stream, at):
        look = held + text
        found = look.find(b"\n>")
        if found >= 0:
            return at - len(held) + found + 1
        at, held = at + len(text), look[-1:]
    return None


class FastaPieces(DataSource):
    """Options: path, index (a folder that write_index made), piece, block."""

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "seq_id string, at bigint, part string"

    def reader(self, schema) -> PiecesReader:
        return PiecesReader(self.options)


class RecordsReader(PiecesReader):
    """Whole FASTA records."""

    def pushFilters(self, filters):  # noqa: N802
        return filters

    def by_header(self, stream, part: Range) -> Iterator[pa.RecordBatch]:
        for start, end in self.records(stream, part):
            scan, name, held, ids, seqs, size = Scan(State()), None, [], [], [], 0
            for text in buffers(stream, start, end):
                for state, got in scan.feed(text):
                    if got is not None:
                        held.append(got)
                        size += len(got)
                        continue
                    if name is not None:
                        ids.append(name)
                        seqs.append(b"".join(held))
                    name, held = state.seq_id, []
                    if size > BUFFER:
                        yield self.batch(ids, seqs)
                        ids, seqs, size = [], [], 0
            rest = [] if name is None else [(name, b"".join(held))]
            if scan.state.header is not None:  # the file ends in a header
                rest.append((name_of(scan.state.header), b""))
            if ids or rest:
                yield self.batch([*ids, *(x for x, _ in rest)], [*seqs, *(x for _, x in rest)])

    @staticmethod
    def batch(ids: list[str], seqs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(seqs, pa.binary()).cast(pa.string())], ["seq_id", "seq"])


class FastaRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_records"

    def schema(self) -> str:
        return "seq_id string, seq string"

    def reader(self, schema) -> RecordsReader:
        return RecordsReader(self.options)


def text_lines(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that start at or behind ``start``, a line's start."""
    held, at = b"", start
    for text in buffers(stream, start):
        parts = (held + text).split(b"\n")
        held = parts.pop()
        for x in parts:
            yield at, x.removesuffix(b"\r")
            at += len(x) + 1
    if held:
        yield at, held.removesuffix(b"\r")


class FastqReader(RecordsReader):
    """A record starts at a line with '@' whose next but one starts with '+': a quality line can't be taken for it, as the line after the next
    is then a sequence."""

    def by_header(self, stream, part: Range) -> Iterator[pa.RecordBatch]:
        start = 0
        if part.start:
            start = next((at + len(x) for at, x in text_lines(stream, part.start - 1)), None)
            # The first of these lines is the rest of the line before, and its end may have two bytes.
            stream.seek(start)
            start += 1 + (stream.read(1) == b"\r")
        ahead, rows, size, synced = [], [], 0, False
        for at, line in text_lines(stream, start):
            ahead.append((at, line))
            if not synced and len(ahead) == 3:
                synced = ahead[0][1].startswith(b"@") and ahead[2][1].startswith(b"+")
                if not synced:
                    ahead.pop(0)
                    if ahead[0][0] >= part.end:
                        break
            if synced and ahead[0][0] >= part.end:
                break
            if synced and len(ahead) == 4:
                rows.append(tuple(x for _, x in ahead))
                size, ahead = size + sum(len(x) for _, x in ahead), []
                if size > BUFFER:
                    yield self.rows(rows)
                    rows, size = [], 0
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        names, seqs, _, quals = zip(*rows, strict=True)
        columns = [pa.array([name_of(x[1:]) for x in names], pa.string()), *(pa.array(list(x), pa.binary()).cast(pa.string()) for x in (seqs, quals))]
        return pa.RecordBatch.from_arrays(columns, ["seq_id", "seq", "qual"])


class FastqRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_records"

    def schema(self) -> str:
        return "seq_id string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def load(spark: SparkSession, kind: type[DataSource], path: str, **options: str | int | None) -> DataFrame:
    spark.dataSource.register(kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(kind.name()).options(path=path, **given).load()


def fasta_pieces(spark: SparkSession, path: str, index: str | None = None, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(seq_id, at, part): pieces of sequences and the 1-based place of their first character; no piece crosses a multiple of ``piece``."""
    return load(spark, FastaPieces, path, index=index, piece=piece, block=block)


#: Endings of file names, in lower case.
FASTQ_ENDINGS, FASTA_ENDINGS = (".fq", ".fastq"), (".fa", ".fasta", ".fna")


def file_type(path: str) -> str:
    """fastq or fasta by the file's ending; any other ending is warned about and read as fasta."""
    if path.lower().endswith(FASTQ_ENDINGS):
        return "fastq"
    if not path.lower().endswith(FASTA_ENDINGS):
        warnings.warn(f"{path}: the ending is not known; it is read as FASTA", stacklevel=2)
    return "fasta"


def reads(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(seq_id, seq) of a file of reads."""
    kind = FastqRecords if file_type(path) == "fastq" else FastaRecords
    return load(spark, kind, path, block=block).select("seq_id", "seq")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
