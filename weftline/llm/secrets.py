"""Secret scans: three regular expressions, and character Markov models that tell random strings from identifiers.

The models are two first-order chains over characters, of random strings and of ordinary identifiers, trained from
labelled samples. A candidate (a longest run of A-Z a-z 0-9 + / _ -, optional = at its end, of bounded length) is a
secret if the log-likelihood ratio per character reaches a threshold and it holds digits and letters.
The models only add spans.

Null and empty texts have no spans. Repeated rows are scanned row by row. Very long texts and runs are scanned whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: Added to each count of a pair of characters.
SMOOTHING = 0.5
#: Nats a character that a random string must gain over an identifier.
THRESHOLD = 0.6
#: Words that identifiers of the default sample are made of.
IDENTIFIER_WORDS = """account action address amount array batch buffer build cache channel client close code column
connection content context count create current data date default delete device document error event factory field file
filter format group handler header height history identifier image index input instance integer interface internal item
job key label language length level list loader local location manager message method model module name network node
number object offset option order output page parameter parent parse password path pattern payload pixel process
product property provider query queue read record region register release remote request reset response result return
row schema score search secret section select send sequence server service session setting size source stack start state
status stream string system table target task template text thread time title token total transform type update user
utility validate value vector version view widget width window worker write""".split()


def default_samples(seed: int = 7, n: int = 4000) -> list[tuple[str, int]]:
    """Labelled strings by rule: 1 for random characters of usual alphabets, 0 for identifiers, numbers and words in four styles."""
    pick, out = random.Random(seed), []
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + digits, lower + digits, digits + "abcdef", digits + "ABCDEF", upper + lower + digits + "_-"]
    for i in range(n):
        out.append(("".join(pick.choices(alphabets[i % len(alphabets)], k=pick.randint(20, 48))), 1))
        words = pick.choices(IDENTIFIER_WORDS, k=pick.randint(2, 6))
        style = i % 5
        name = "_".join(words) if style == 0 else "-".join(words) if style == 1 else words[0] + "".join(w.title() for w in words[1:]) if style == 2 else "_".join(words).upper() if style == 3 else "/".join(words)
        out.append((name + (str(pick.randint(0, 9999)) if pick.random() < 0.3 else ""), 0))
    return out


def fit(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each pair of byte values; 0 stands before the first character."""
    counts = np.zeros((2, 128, 128))
    for text, label in samples:
        codes = np.frombuffer(b"\0" + text.encode("ascii", "replace"), np.uint8)
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1)
    seen = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]
    counts[:, :, seen] += SMOOTHING
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
        return np.nan_to_num(logs[1] - logs[0], nan=0.0, posinf=0.0, neginf=0.0)


def ratio(model: np.ndarray, text: str) -> float:
    """Nats a character; unknown characters count nothing."""
    codes = np.frombuffer(b"\0" + text.encode("ascii", "replace"), np.uint8)
    return float(model[codes[:-1], codes[1:]].sum()) / max(1, len(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), in this order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, model: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        value = m.group()
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and ratio(model, value) >= threshold:
            out.append((m.start(), 3, m.end()))
    return out


def scan(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end), by start and then kind, in code points; one row a document."""
    model = fit(default_samples() if samples is None else samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py()
                found = sorted(base_spans(text) + random_spans(text, model, threshold))
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(spans: DataFrame) -> DataFrame:
    """The counts of the three kinds, base_sha256 over their spans, and all spans as text."""
    from pyspark.sql import functions as F

    def text(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return spans.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", samples: Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of ``scan`` in the text column replaced by ``mark``; overlapping spans by one. Null texts stay null."""
    model = fit(default_samples() if samples is None else samples)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for a, _, b in sorted(base_spans(text) + random_spans(text, model, threshold)):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if end else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(at).type
            yield batch.set_column(at, batch.schema.field(at).name, pa.array([clean(x.as_py()) for x in batch.column(at)], kind))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["base_spans", "default_samples", "digests", "fit", "random_spans", "ratio", "redact", "scan"]
