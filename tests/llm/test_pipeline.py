"""The pipeline's stages against brute force on a small folder, each on the rows that its predecessor kept."""

import base64
import hashlib
import random
import re

import pytest

pytest.importorskip("weftline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pick = random.Random(8)
    words = [f"calm{i}" for i in range(3000)]
    make = lambda n: pick.choices(words, k=n)
    insults, texts, toxic = ["wretch", "vileness", "blighter"], [], []
    for i in range(120):
        bad = i % 4 == 0
        texts.append(" ".join(make(60) + pick.sample(insults, 2) * bad))
        toxic.append(int(bad))
    base, item = make(80), make(40)
    for i in range(6):
        own = base[:]
        own[10 * i] = f"edit{i}"
        texts.append(" ".join(own))
    texts += [" ".join(make(20) + item + make(20)), " ".join(make(5) + item[:20] + ["other"] + item[21:] + make(5)), 'key token = "aB3xK9pQ7zR1mN5vT8wY2" ' + " ".join(make(30)), "wretch vileness " + " ".join(make(30)), None, "", texts[1]]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality long, toxic long").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, " ".join(make(30)))], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, {i: t for i, t, *_ in rows}, insults, item


def test_stages(spark, folder):
    place, texts, insults, item = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept, state = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = f"{place}/out-{name}"
        stage(spark, state, place).write.parquet(out)
        state = spark.read.parquet(out)
        kept[name] = {r.doc_id: r for r in state.collect()}
        if name != "bpe":
            assert state.columns == docs.columns
    clean = {i for i, t in texts.items() if not any(w in (t or "") for w in insults)}
    assert set(kept["toxicity"]) == clean
    label = {i: i for i in clean}
    sets = {i: shingles(texts[i]) for i in clean}
    for _ in range(5):
        for a in clean:
            for b in clean:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    single = {i for i in clean if label[i] == i}
    assert set(kept["jaccard"]) == single and len(clean) - len(single) == 6
    own = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}

    def leaks(text):
        w = WORD.findall((text or "").lower())
        wins = [{tuple(w[at + i : at + i + 5]) for i in range(len(item) - 4)} for at in range(max(0, len(w) - len(item) + 1))]
        return any(len(x & own) >= 0.8 * len(x | own) for x in wins)

    safe = {i for i in single if not leaks(texts[i])}
    assert set(kept["decontamination"]) == safe and len(safe) < len(single)
    secret = next(i for i, t in texts.items() if t and "aB3x" in t)
    for i in safe:
        text = kept["secrets"][i].text
        assert text == texts[i] if i != secret else "aB3x" not in text and "[SECRET]" in text
        assert kept["secrets"][i].n_chars == (len(text) if text is not None else None)
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in kept["bpe"].items():
        text = kept["secrets"][i].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert set(kept["bpe"]) == set(kept["secrets"]) == safe


def test_empty_tables(spark, folder, tmp_path):
    place = folder[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{place}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
