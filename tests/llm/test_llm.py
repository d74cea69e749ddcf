"""The training-data operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import public_tokenizers as tokenizers
from pyspark.sql import functions as F

from seqprism.llm import bagminhash, bpe, gru_language, hilbert, multi_index, packing, risk_rules, rule_ensemble, segment_toxicity

from .rows import DOCS, words


def test_hilbert_curve_is_one(spark):
    for dims, bits in ((2, 4), (3, 3)):
        digits, following = hilbert.curve_states(dims)
        place = {}
        for cell in itertools.product(range(1 << bits), repeat=dims):
            state = index = 0
            for b in reversed(range(bits)):
                q = state * (1 << dims) + sum((c >> b & 1) << (dims - 1 - i) for i, c in enumerate(cell))
                index, state = index * (1 << dims) + digits[q], following[q]
            place[index] = cell
        steps = [sum(abs(a - b) for a, b in zip(place[i], place[i + 1], strict=True)) for i in range(len(place) - 1)]
        assert len(place) == 1 << bits * dims and set(steps) == {1}


def test_shards(docs, nothing):
    rows = hilbert.hilbert_shards(docs, 4, ["lang", "source"]).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == 15 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows)
    assert hilbert.hilbert_shards(nothing, 4, ["lang", "source"]).count() == 0


def test_bpe_equals_the_libraries(docs, nothing):
    import tiktoken
    from tokenizers import Tokenizer

    own = bpe.BacktrackingBPE(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    fast = packing.DocumentTokenizer(tokenizers.path("byte_bpe_50k.json"))
    rust = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    draw = random.Random(4)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "é", "中", "1", "!!", "\t", "😀", "<|endoftext|>"]
    texts = ["", "a" * 3000, " " * 999, "aA1!" * 300, *("".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(3000))]
    for t in texts:
        ids = own.encode(t)
        assert ids == rust.encode_ordinary(t) and own.decode(ids) == t.encode()
        assert np.frombuffer(fast.pack(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids == ids
    rows = bpe.round_trip_digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == 15 and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)
    assert bpe.round_trip_digests(nothing, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == 0


def test_packing(docs, nothing):
    file = tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, file, size=64).collect()
    assert {r.doc_id for r in rows} == {None, *range(13)}
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and sum(x[1] for x in own) <= 64
    total = sum(r.length for r in rows)
    assert len(fill) <= -(-total // 64) + 1
    assert packing.cut_points(130, 64) == [(0, 2), (2, 64), (66, 64)] and packing.cut_points(128, 64) == [(0, 64), (64, 64)]
    assert packing.pack_documents(nothing, file).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(60, 8))
    near = base[:20] + draw.normal(scale=0.05, size=(20, 8))
    group = base[0] + draw.normal(scale=0.08, size=(40, 8))
    vectors = [*base.tolist(), *near.tolist(), *group.tolist(), base[1].tolist(), None, [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0, None] * 4, [], [1.0] * 3]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in multi_index.near_vectors(df).collect()}
    x = np.array([v for v in vectors[:121]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    component = np.arange(121)
    while True:
        new = np.where(linked, component, 999).min(axis=1)
        if (new == component).all():
            break
        component = new
    assert [got[i].n_links for i in range(121)] == (linked.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(121)] == component.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(121, len(vectors)))
    assert multi_index.near_vectors(df.where("false")).count() == 0


def brute_statistics(text):
    import re

    t = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(t[i : i + 8]) for i in range(len(t) - 7))
    hit = {i + k for i in range(len(t) - 7) if grams[tuple(t[i : i + 8])] > 1 for k in range(8)}
    return len(t), sum(map(len, t)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(100, "a b c d e f g h i " * 5 + "\nx\nx\n#$ é", "en", "s", 1, "k", 7)], DOCS)
    rows = risk_rules.judge(docs.unionByName(extra), labels).collect()
    text = {r.doc_id: r.text for r in docs.unionByName(extra).collect()}
    assert len(rows) == 16
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert risk_rules.judge(nothing, labels).count() == 0 and risk_rules.keep_good(nothing, labels).columns == nothing.columns


def test_rule_ensemble(spark, nothing):
    rows = [(i, words(60, i).upper() + "!!" if i % 3 == 0 else words(60, i)) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("score"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rule_ensemble.judge(df, labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 302
    x = np.random.default_rng(0).random((50, len(rule_ensemble.FEATURES)))
    model = rule_ensemble.fit_rules(x, (x[:, 0] > 0.5).astype(float))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], rule_ensemble.FEATURES).select(F.struct("*").alias("f"))
    assert [r[0] for r in frame.select(model.column(F.col("f"))).collect()] == pytest.approx(model.predict(x).tolist())
    assert rule_ensemble.judge(nothing, labels).count() == 0


def test_gru_gradients_and_languages(spark, nothing):
    model = gru_language.ByteTagger.new(["a", "b", "c"], 4, dtype=np.float64)
    draw = np.random.default_rng(0)
    codes, mask, target = draw.integers(0, 256, (7, 5)).astype(np.uint8), np.arange(7)[:, None] < np.array([7, 3, 5, 1, 7]), np.array([0, 1, 2, 1, 0])
    _, gradients = model.loss_gradients(codes, mask, target)
    for p, g in zip(model.parameters(), gradients, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, values = p[at], []
        for step in (1e-6, -1e-6):
            p[at] = old + step
            values.append(model.loss_gradients(codes, mask, target)[0])
        p[at] = old
        assert (values[0] - values[1]) / 2e-6 == pytest.approx(g[at], rel=1e-5, abs=1e-9)
    logits = model.states(codes, mask) @ model.output + model.bias
    plain = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    assert np.abs((plain.transpose(0, 2, 1) - model.byte_probabilities(codes, mask)) * mask[:, None, :]).max() < 1e-12
    rows = [(i, " ".join(random.Random(i).choices(["der", "und", "ist"] if i % 2 else ["the", "and", "was"], k=30)), "de" if i % 2 else "en") for i in range(120)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", None), (None, "the and", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in gru_language.identify(df).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(120)) and got[900].lang_pred == got[901].lang_pred == "und"
    assert gru_language.identify(nothing).count() == 0


def test_bagminhash_is_unbiased_and_finds_components(docs, nothing):
    draw = np.random.default_rng(0)
    hashes = draw.integers(0, 2**63, 50).astype(np.uint64)
    a, b = draw.integers(0, 6, 50), draw.integers(0, 6, 50)
    b[:30] = a[:30]
    sign = lambda w: bagminhash.signatures(hashes[w > 0], np.zeros((w > 0).sum(), int), w[w > 0], 1, 4096)[0]
    assert (sign(a) == sign(b)).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    rows = bagminhash.near_duplicates(docs).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.class_id, r.component_id, r.kept))
    assert len(rows) == 15
    assert got[0] == {(0, 0, True)} and got[1] == {(0, 0, False)} and got[2] == {(2, 0, False)} and got[3] == {(3, 3, True)}
    assert got[5] == {(5, 5, True)} and got[6] == {(6, 6, True)} and got[None] == {(None, None, True)}
    kept = bagminhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert bagminhash.near_duplicates(nothing).count() == 0


def brute_segments(values):
    """All maximal scoring segments by their definition: the best one, then what is left and right of it."""
    best = max(((sum(values[a:b]), -(b - a), -a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [(x, y) for x, y in brute_segments(values[:a])] + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(values[b:])]


def test_maximal_segments():
    draw = random.Random(7)
    for _ in range(300):
        odds = [draw.choice([0.0, 0.0, 0.0, 1.13, 0.37, -1.71, 2.09]) + draw.random() * 1e-3 for _ in range(draw.randint(0, 14))]
        kept = [(i, o) for i, o in enumerate(odds) if abs(o) > 2e-3]
        values = [(o if abs(o) > 2e-3 else 0.0) - segment_toxicity.DRIFT for o in odds]
        assert [(a, b) for a, b, _ in segment_toxicity.maximal_segments(kept)] == brute_segments(values)


def test_pipeline_keeps_columns(spark, docs):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
