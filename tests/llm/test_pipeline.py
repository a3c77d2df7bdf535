"""The pipeline, stage by stage, against plain Python."""

import random
import struct
import zlib
from collections import Counter

import corpus_pipeline
from lattica.llm import tokenization

rnd = random.Random(21)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(1500)]


def words(n):
    return [rnd.choice(VOCAB) for _ in range(n)]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, tmp_path):
    items = [" ".join(words(20)) for _ in range(5)]
    texts = [" ".join(words(rnd.randint(40, 120))) for _ in range(40)]
    texts += [texts[0], texts[1] + " more"]  # near duplicates
    texts += [f"{' '.join(words(30))} {items[2].upper()} {' '.join(words(10))}"]  # leak
    texts += [" ".join(words(10)), " ".join(words(12) * 5), "", None]  # too short, repetitive, empty
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = {i: t for i, t in enumerate(texts[:43])}
    got, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = got = corpus_pipeline.materialize(stage(spark, got, str(tmp_path)), name)
    assert all(frames[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])

    assert {r.doc_id: r.text for r in frames["quality_rules"].collect()} == want
    sets = {i: shingles(t) for i, t in want.items()}
    gone = {i for i in want for j in want if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert gone == {40, 41}
    want = {i: t for i, t in want.items() if i not in gone}
    assert {r.doc_id: r.text for r in frames["ngram_jaccard_join"].collect()} == want
    want = {i: t for i, t in want.items() if not any(x in t.lower() for x in items)}
    assert {r.doc_id for r in frames["benchmark_decontamination"].collect()} == set(want) == set(range(40))

    mix = Counter(r.doc_id for r in frames["source_mixing"].collect())
    size = {s: sum(len(t.split()) for i, t in want.items() if i % 3 == s) for s in range(3)}
    assert max(mix.values()) <= 2 and set(mix) <= set(want)
    total, weight, left, target = 1.5 * sum(size.values()), {0: 3, 1: 1, 2: 2}, {0, 1, 2}, {}
    while over := [s for s in left if (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) > 2 * size[s]]:
        target |= {s: 2 * size[s] for s in over}
        left -= set(over)
    rest = total - sum(target.values())
    target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    for s in range(3):
        taken = sum(n * len(want[i].split()) for i, n in mix.items() if i % 3 == s)
        assert abs(taken - target[s]) <= max(len(t.split()) for t in want.values())

    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokenization.default_tokenizer()), 0
    for r, i in zip(frames["token_output"].orderBy("start").collect(), sorted(mix.elements()), strict=True):
        ids = tok.encode(want[i], add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
