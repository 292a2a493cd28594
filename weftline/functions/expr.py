"""Scalar expressions over alignment records; every function takes and returns columns, so all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = "bigint"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def attribute_map(attributes: Column | str) -> Column:
    """key=value items split at ';'. Items without '=' are dropped; the last of a repeated key wins."""
    parts = F.transform(F.filter(F.split(c(attributes), ";"), lambda x: x.contains("=")), lambda x: F.split(x, "="))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.get(p, 0)).alias("key"), F.trim(F.get(p, 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def dbxref_map(value: Column | str) -> Column:
    """name:id items split at ','; items that don't have two parts are dropped."""
    parts = F.filter(F.transform(F.split(c(value), ","), lambda x: F.split(x, ":")), lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).alias("value"))))


def tag_map(columns: Column, first: int = 13) -> Column:
    """Third parts of k:t:v fields from the 13th column on."""
    parts = F.filter(F.transform(F.slice(columns, first, F.greatest(F.size(columns), F.lit(1))), lambda x: F.split(x, ":")), lambda p: F.size(p) >= 3)
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 2).alias("value"))))


def path_items(raw: Column | str) -> Column:
    """Segment names of a path; only the sign that it begins with separates them."""
    raw = c(raw)
    return F.when(raw.startswith("<"), F.split(F.regexp_replace(raw, "^<+", ""), "<")).otherwise(F.split(F.regexp_replace(raw, "^>+", ""), ">"))


def item_genes(item: Column) -> Column:
    """Genes of a segment name: none if the second part is missing or a pure range, two for A--B."""
    gene = F.get(F.split(item, ":"), 1)
    none = F.array().cast("array<string>")
    return F.when(gene.isNull() | F.replace(gene, F.lit("-"), F.lit("")).rlike("^[0-9]+$"), none).otherwise(F.split(gene, "--"))


def item_position(item: Column) -> Column:
    """chrom:start-end of a segment name; without ':' the name itself."""
    parts = F.split(item, ":")
    return F.when(item.contains(":"), F.concat(F.get(parts, 0), F.lit(":"), F.element_at(parts, -1))).otherwise(item)


def item_start(item: Column) -> Column:
    return F.get(F.split(F.element_at(F.split(item, ":"), -1), "-"), 0).try_cast(LONG)


def item_end(item: Column) -> Column:
    return F.get(F.split(F.element_at(F.split(item, ":"), -1), "-"), 1).try_cast(LONG)


def normal_path(raw: Column | str) -> Column:
    """Positions of the path's items, reversed for a path that begins with '<'."""
    at = F.transform(path_items(raw), item_position)
    return F.when(c(raw).startswith("<"), F.reverse(at)).otherwise(at)


def breakpoint(raw: Column | str, upper: bool) -> Column:
    """The last item's far end for the upper record, the first item's near end for the lower."""
    item = F.element_at(path_items(raw), -1 if upper else 1)
    forward = ~c(raw).startswith("<")
    return F.when(forward == upper, item_end(item)).otherwise(item_start(item))


def corrected_breakpoint(raw: Column | str, ref_len: Column, ref_start: Column, ref_end: Column, upper: bool, tolerance: int = 20) -> Column:
    """The breakpoint moved inward by the part of the path that isn't aligned, if that exceeds the tolerance."""
    plain, forward = breakpoint(raw, upper), ~c(raw).startswith("<")
    if upper:
        rest = ref_len - ref_end + 1
        return F.when(rest <= tolerance, plain).when(forward, plain - rest).otherwise(plain + rest)
    return F.when(ref_start <= tolerance, plain).when(forward, plain + ref_start).otherwise(plain - ref_start)


def genome_breakpoint(start: Column, end: Column, reverse: Column, upper: bool) -> Column:
    return F.when(reverse, start if upper else end).otherwise(end if upper else start)


def extent(raw: Column | str) -> tuple[Column, Column]:
    """(smallest, largest) position of a node."""
    items, forward = path_items(raw), ~c(raw).startswith("<")
    first, last = F.element_at(items, 1), F.element_at(items, -1)
    return F.when(forward, item_start(first)).otherwise(item_start(last)), F.when(forward, item_end(last)).otherwise(item_end(first))


def quality_weight(quality: Column) -> Column:
    q = quality.cast("double")
    return F.when(quality >= 30, 10 + q * 0.15).when(quality >= 10, F.floor(q / 10) * 3.5).otherwise(q * 0.2)


def pair_score(upper_quality: Column, lower_quality: Column, upper_items: Column, lower_items: Column) -> Column:
    both = lambda least: (upper_quality >= least) & (lower_quality >= least)
    bonus = F.when(both(30), 1.5).when(both(10), 1.2).otherwise(0.8)
    return F.sqrt(quality_weight(upper_quality) + quality_weight(lower_quality)) * 0.5 * (1 + F.log1p((upper_items + lower_items).cast("double"))) * bonus


def similar_genes(a: Column, b: Column) -> Column:
    named = ~(a.startswith("ENSG") | b.startswith("ENSG") | (a == "") | (b == ""))
    return named & ((a == b) | ((a.contains(b) | b.contains(a)) & (F.least(F.length(a), F.length(b)) >= 3)))


def same_direction(strand_1: Column, sign_1: Column, strand_2: Column, sign_2: Column) -> Column:
    return ((strand_1 == "+") == (sign_1 == ">")) == ((strand_2 == "+") == (sign_2 == ">"))


def near(a: Column, b: Column, distance: int) -> Column:
    return F.coalesce(F.abs(a - b) <= distance, F.lit(False))


def nearest_boundary(at: Column, boundaries: Column, tolerance: int) -> Column:
    """The boundary nearest to ``at`` within the tolerance; of equally near ones the first in the list."""
    found = F.transform(boundaries, lambda b, i: F.struct(F.abs(at - b).alias("d"), i.alias("i"), b.alias("b")))
    return F.array_min(F.filter(found, lambda x: x["d"] <= tolerance))["b"]


def flag_bits(flag: Column) -> dict[str, Column]:
    on = lambda bit: flag.bitwiseAND(bit) != 0
    return {"is_mapped": ~on(4), "is_secondary": on(256), "is_supplementary": on(2048), "is_reverse": on(16), "is_primary": ~on(256) & ~on(2048)}


def cigar_metrics(cigar: Column | str) -> dict[str, Column]:
    """Lengths and clips of a CIGAR string; all 0 where it holds no operation."""
    cigar = c(cigar)
    n = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda x: x.cast(LONG))
    op = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    ops = F.zip_with(n, op, lambda a, b: F.struct(a.alias("n"), b.alias("op")))
    total = lambda kinds: F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0).cast(LONG), lambda s, o: s + o["n"])
    end = lambda place, letter: F.when(F.try_element_at(ops, F.lit(place))["op"] == letter, F.try_element_at(ops, F.lit(place))["n"])
    zero = F.lit(0).cast(LONG)
    hard_1, hard_2 = F.coalesce(end(1, "H"), zero), F.coalesce(F.when(F.size(ops) > 1, end(-1, "H")), zero)
    inner = F.filter(ops, lambda o: o["op"] != "H")
    soft = lambda place: F.when(F.try_element_at(inner, F.lit(place))["op"] == "S", F.try_element_at(inner, F.lit(place))["n"])
    soft_1, soft_2 = F.coalesce(soft(1), zero), F.coalesce(F.when(F.size(inner) > 1, soft(-1)), zero)
    q_len, r_len, core = total("MIS=X"), total("MDN=X"), total("MI=X")
    return {"q_len": q_len, "r_len": r_len, "q_start": soft_1, "q_end": F.when(core == 0, soft_1).otherwise(q_len - soft_2), "soft_start": soft_1, "soft_end": soft_2, "core": core, "hard_start": hard_1, "hard_end": hard_2}


def sam_end(start: Column, r_len: Column) -> Column:
    return F.when((start != -1) & (r_len > 0), start + r_len - 1).otherwise(F.lit(-1))


#: The report's texts for the levels.
LEVEL_TEXT = {
    -1: "ERROR Fusion",
    0: "ERROR Fusion",
    1: "Impossible Fusion",
    2: "Potential Artifacts / Read-through",
    3: "Low Confidence Fusion",
    4: "Medium Confidence Fusion",
    5: "High Confidence Fusion",
}


def level_text(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, text in LEVEL_TEXT.items():
        out = F.when(level == value, text).otherwise(out)
    return out
