"""FASTA and FASTQ data sources: every way of cutting a file gives the same sequences."""

import random

import pytest

from weftline.sources import sequence_files as S

FASTA = [
    ">a first\nACGTA\nCGT\n\nAC\n>b\n>c c\r\nGGG\r\nTT\r\n>long\n" + "ACGTTGCA" * 40 + "\n> \nAA\n>d>e\nC\n>last\nTTT",
    "junk\n;more\n>x\nAC>GT\nAC\n",
    "",
    ">only",
    ">a_quite_long_name_that_spans_blocks and text\nA\n>b_also_a_name_longer_than_a_block\nCC\n",
]


def expected(text):
    out, name = [], None
    for line in text.replace("\r", "").split("\n"):
        if line.startswith(">"):
            out.append([(line[1:].split(" ")[0]), ""])
            name = out[-1]
        elif name is not None:
            name[1] += line
    return [tuple(x) for x in out]


def joined(rows):
    """Sequences from pieces; two records of one name are told apart by their first piece."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.seq_id, r.at)):
        assert r.at == len(out.get(r.seq_id, "")) + 1
        out[r.seq_id] = out.get(r.seq_id, "") + r.part
    return out


@pytest.mark.parametrize("block", [1, 7, 13, 64, 10_000])
def test_summaries_compose(tmp_path, block):
    """The state before each range, from the ranges' summaries, is that of one scan of the file."""
    for text in FASTA:
        (tmp_path / "x.fa").write_text(text, newline="")
        home, _ = S.store(f"file://{tmp_path}")
        whole, state, pieces = S.Scan(S.State()), S.State(), []
        for x in S.ranges(f"file://{tmp_path}/x.fa", block):
            assert state == whole.state
            mine, one = S.Scan(state), text.encode()[x.start : x.end]
            pieces += [(s.seq_id, p) for s, p in mine.feed(one) if p]
            list(whole.feed(one))
            state = S.after(S.summary(home, x), state)
        assert state == whole.state
        got = {}
        for name, part in pieces:
            if name is not None:
                got[name] = got.get(name, b"") + part
        assert {k: v.decode() for k, v in got.items()} == {k: v for k, v in expected(text) if v}


@pytest.mark.parametrize("block", [5, 37, 10_000])
def test_pieces(spark, tmp_path, block):
    for n, text in enumerate(FASTA):
        path, index = f"file://{tmp_path}/{n}.fa", f"file://{tmp_path}/{n}.index"
        (tmp_path / f"{n}.fa").write_text(text, newline="")
        want = {k: v for k, v in expected(text) if v}
        assert joined(S.fasta_pieces(spark, path, piece=6, block=block).collect()) == want
        S.write_index(spark, path, index, block)
        by_index = S.fasta_pieces(spark, path, index, piece=6)
        assert joined(by_index.collect()) == want
        for name in [*want, "none"]:
            assert joined(by_index.where(by_index.seq_id == name).collect()) == {k: v for k, v in want.items() if k == name}
        assert sorted(tuple(r) for r in S.load(spark, S.FastaRecords, path, block=block).collect()) == sorted(expected(text))


def test_one_line_chromosome_is_read_in_parts(spark, tmp_path):
    pick = random.Random(1)
    seq = "".join(pick.choices("ACGT", k=3_000_000))
    path, index = f"file://{tmp_path}/g.fa", f"file://{tmp_path}/g.index"
    (tmp_path / "g.fa").write_text(f">chr1\n{seq}\n>chr2\n{seq[:1000]}\n")
    S.write_index(spark, path, index, 100_000)
    all_ = S.fasta_pieces(spark, path, index)
    assert all_.rdd.getNumPartitions() == 31
    assert joined(all_.collect()) == {"chr1": seq, "chr2": seq[:1000]}
    some = all_.where("seq_id = 'chr1' and at >= 1500001 and at <= 1700000")
    assert some.rdd.getNumPartitions() <= 4
    got = some.collect()
    assert min(r.at for r in got) <= 1500001 + S.PIECE and all(r.part == seq[r.at - 1 : r.at - 1 + len(r.part)] for r in got)
    assert sum(len(r.part) for r in got) >= 180_000
    assert all_.where("seq_id in ('chr2', 'chrX')").rdd.getNumPartitions() == 1
    assert S.indexed(index, {"nowhere"}, 1, 10) == []


@pytest.mark.parametrize("block", [3, 11, 50, 10_000])
def test_fastq(spark, tmp_path, block):
    pick, rows = random.Random(block), []
    for i in range(40):
        n = pick.randint(0, 9)
        rows.append((f"r{i}", "".join(pick.choices("ACGT", k=n)), "".join(pick.choices("@+!I", k=n))))
    for end in ("\n", "\r\n"):
        (tmp_path / "r.fastq").write_text("".join(f"@{a} x{end}{b}{end}+{a}{end}{c}{end}" for a, b, c in rows), newline="")
        got = S.load(spark, S.FastqRecords, f"file://{tmp_path}/r.fastq", block=block).collect()
        assert sorted(map(tuple, got)) == sorted(rows)
    assert sorted(map(tuple, S.reads(spark, f"file://{tmp_path}/r.fastq", block).collect())) == sorted(x[:2] for x in rows)


def test_folders_and_endings(spark, tmp_path):
    folder = tmp_path / "many.fa"
    folder.mkdir()
    for n, text in (("part-1", ">a\nAC\n"), ("part-0", ">b\nGT"), ("_SUCCESS", ""), (".x.crc", ">no\nA")):
        (folder / n).write_text(text)
    assert joined(S.fasta_pieces(spark, f"file://{folder}").collect()) == {"a": "AC", "b": "GT"}
    S.write_index(spark, f"file://{folder}", f"file://{tmp_path}/i")
    assert joined(S.fasta_pieces(spark, f"file://{folder}", f"file://{tmp_path}/i").collect()) == {"a": "AC", "b": "GT"}
    assert (S.file_type("x.FQ"), S.file_type("x.fna")) == ("fastq", "fasta")
    with pytest.warns(UserWarning, match="not known"):
        assert S.file_type("x.fa.gz") == "fasta"
    with pytest.raises(Exception, match="nothing"):
        S.fasta_pieces(spark, f"file://{tmp_path}/nothing").collect()
