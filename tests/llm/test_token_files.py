"""Code lengths at their limit, blocks and checkpoints, and pieces encoded without the file's pre-tokenizer."""

import numpy as np
import pytest

pytest.importorskip("weftline.llm")


@pytest.mark.parametrize("n", [1, 2, 30, 400])
def test_limited_codes(n):
    from weftline.llm import token_files as T

    counts = np.zeros(T.SYMBOLS, np.int64)
    counts[np.arange(n) * 5] = np.minimum(2.0 ** np.arange(n), 2.0**60).astype(np.int64)  # Huffman's code would have n - 1 bits
    lengths = T.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= T.MOST_BITS
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    pick = np.random.default_rng(n)
    table = T.decode_table(lengths)
    for size in (1, T.CHECKPOINT - 1, T.CHECKPOINT, T.CHECKPOINT + 1, 5000):
        ids = (pick.integers(0, n, size) * 5).astype(np.uint16)
        bits, total, points = T.pack(ids, lengths, T.canonical(lengths))
        assert total == lengths[ids].sum() and len(points) == -(-size // T.CHECKPOINT)
        assert (T.unpack(bits, size, points, table) == ids).all()


def test_many_blocks(spark, monkeypatch):
    from weftline.llm import token_files as T

    monkeypatch.setattr(T, "BLOCK_IDS", 50)
    rows = [(i, "word " * (i % 37) + "été ''s 12" * (i % 3)) for i in range(300)]
    got = {r.doc_id: r for r in T.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path(T.VOCABULARY)), 0
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, T.END]
        assert (got[i].start, np.frombuffer(got[i].ids, "<u4").tolist()) == (start, ids)
        start += len(ids)


def test_pieces_as_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from weftline.llm import token_files as T

    whole = Tokenizer.from_file(P.path(T.VOCABULARY))
    whole.encode_special_tokens = True
    pick = np.random.default_rng(5)
    alphabet = list("aabcdeéßñ  \n\t09!?-_<|>Ā'\x00\x7f ") + ["<|endoftext|>", " the", "ing"]
    texts = ["".join(pick.choice(alphabet, pick.integers(0, 400))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    encode = T.library_encoder(P.path(T.VOCABULARY))
    for _ in range(2):  # learnt, then known
        ids, cut = encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
