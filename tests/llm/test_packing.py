"""Packing: pieces as the library's ids, sequences without gaps or overlaps, and how near their number comes to the least."""

import zlib

import numpy as np
import pytest

pytest.importorskip("weftline.llm")


def library_ids(texts, end):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from weftline.llm import packing as K

    library = Tokenizer.from_file(P.path(K.VOCABULARY))
    library.encode_special_tokens = True
    return [[*library.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def fills(got, size):
    """Tokens of each sequence, whose pieces must stand one after the other."""
    by_sequence = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0)
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(0 < x <= size for x in by_sequence.values())
    return list(by_sequence.values())


@pytest.mark.parametrize("rows_a_task", [20, 10_000])
def test_pieces_and_sequences(spark, rows_a_task):
    from weftline.llm import packing as K

    pick = np.random.default_rng(2)
    words = ["the", "word", " of", "\n", "été", "12", "<|endoftext|>", "日本"]
    rows = [(i, " ".join(pick.choice(words, int(pick.integers(0, 120))))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "long text " * 4000), (5, rows[5][1]), (5, rows[5][1]), (6, "another")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows] + [(None, "lost", 1, 2, "x")], "key long, body string, piece long, length long, uid string")
    size = 64
    packed = K.packed(docs.repartition(5), size, id_col="key", text_col="body", rows=rows_a_task)
    got = packed.collect()
    fills(got, size)
    want = []
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows], K.END)):
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        want += [(i, k, a, ids[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in got) == sorted(want)
    assert all(r.length == len(r.ids) // 2 and r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in got)
    total = sum(r.length for r in got)
    if rows_a_task > len(rows):
        assert len(fills(got, size)) <= 1.01 * total / size + 1  # no packing needs fewer than total / size
    whole = {r.sequence_id: r for r in K.sequences(packed).collect()}
    assert sum(r.n for r in whole.values()) == total
    for r in got:
        own = np.frombuffer(whole[r.sequence_id].ids, "<u2")
        assert own[r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u2").tolist()


def squares(sizes, bins):
    return int((np.bincount(bins, sizes).astype(np.int64) ** 2).sum())


@pytest.mark.parametrize("seed", range(6))
def test_search_improves(seed):
    from weftline.llm import packing as K

    pick, size = np.random.default_rng(seed), 100
    sizes = pick.integers(1, 1 + [20, 50, 70, 99, 99, 40][seed], 400)
    start = K.best_fit(sizes, np.arange(400), size)
    assert np.bincount(start, sizes).max() <= size
    end = K.improved(sizes, start, size)
    assert np.bincount(end, sizes).max() <= size and squares(sizes, end) >= squares(sizes, start)
    assert len(set(end)) <= len(set(start))
    # Each kind of change is tried: no move, swap, or two-for-one swap between bins that aren't full makes the squares larger,
    # unless the number of bins is least already.
    if len(set(end)) > -(-sizes.sum() // size):
        fill = np.bincount(end, sizes).astype(int)
        open_ = [b for b in set(end.tolist()) if fill[b] < size]
        for a in open_:
            own = sizes[end == a]
            offers = {int(x) for x in own} | {int(own[i] + own[j]) for i in range(len(own)) for j in range(i)}
            for b in open_:
                if a != b:
                    for back in {0, *map(int, sizes[end == b])}:
                        assert not any(0 < (d := x - back) <= size - fill[b] and fill[b] + d > fill[a] for x in offers)


def test_least_where_it_is_known():
    from weftline.llm import packing as K

    pick, size = np.random.default_rng(1), 1024
    cuts = [np.sort(pick.choice(np.arange(1, size), 3, replace=False)) for _ in range(200)]
    sizes = pick.permutation(np.concatenate([np.diff(np.concatenate(([0], c, [size]))) for c in cuts]))
    assert K.arranged(sizes, None, size).max() + 1 <= 202  # 200 full bins hold them
    same = np.full(100, 600)
    assert K.arranged(same, None, size).max() + 1 == 100


def test_rounds_end(spark):
    """Pieces over half a sequence can't share one: rounds stop without a gain, and no piece is lost."""
    from weftline.llm import packing as K

    docs = spark.createDataFrame([(i, "the " * 40) for i in range(200)], "doc_id long, text string")
    got = K.packed(docs, 64, rows=10).collect()
    assert len(got) == 200 == len(fills(got, 64))
    assert K.packed(docs.limit(0), 64).count() == 0
