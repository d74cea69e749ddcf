"""The pipeline's stages in a row on planted documents, each held against a plain version; awkward rows."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqprism.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
DRAW = random.Random(11)
LEXICON = ["".join(DRAW.choices("abcdefghijklmnopqrstuvwxyz", k=DRAW.randint(3, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(DRAW.choices(LEXICON, k=n))


@pytest.fixture(scope="module")
def planted():
    """(texts by id, ids of junk, copies to their originals, near copies, label rows)."""
    texts = {i: prose(DRAW.randint(90, 130)) for i in range(400)}
    junk = set(range(400, 480))
    texts |= {i: " ".join(f"{w} ### $$$ {w.upper()} |||" for w in DRAW.choices(LEXICON, k=30)) for i in junk}
    copies = {500 + i: i for i in range(20)}
    texts |= {i: texts[of] for i, of in copies.items()}
    near = {600 + i: 30 + i for i in range(20)}
    texts |= {i: " ".join("changed" if k == 60 else w for k, w in enumerate(texts[of].split())) for i, of in near.items()}
    passage = prose(40)
    texts |= {i: f"{prose(60)} {passage} {prose(60)}" for i in (700, 701, 702)}
    labels = [(i, 0 if i in junk else 1, 0) for i in [*range(400), *junk]]
    return texts, junk, copies, near, passage, labels


def without_passages(texts):
    """Plain: bytes within 50-byte strings of a smaller id go."""
    seen, out = set(), {}
    for i in sorted(texts):
        body = texts[i].encode()
        own = [body[k : k + 50] for k in range(len(body) - 49)]
        gone = {k + j for k, s in enumerate(own) if s in seen for j in range(50)}
        seen |= set(own)
        out[i] = bytes(b for k, b in enumerate(body) if k not in gone).decode()
    return out


def test_stages_on_planted_documents(spark, planted, tmp_path):
    texts, junk, copies, near, passage, labels = planted
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in texts.items()]
    rows += [(800, None, "en", "s", None), (801, "", "de", "s", 0), (802, "too few words", "en", None, 13), rows[5], rows[5], (None, prose(100), "en", "s", 1), (803, prose(100), None, "s", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.createDataFrame(rows, COLUMNS).repartition(4), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: {i for i, _ in own} for name, own in kept.items()}
    clean = set(texts) - junk
    # Rules and classifier: junk and short texts go, clean ones stay, repeated rows share their fate.
    assert not ids["quality_rules"] & {800, 801, 802} and None in ids["quality_rules"] and 803 in ids["quality_rules"]
    assert not ids["quality_classifier"] & junk and len(ids["quality_classifier"] & clean) >= 0.97 * len(clean)
    assert sum(i == 5 for i, _ in kept["quality_classifier"]) in (0, 3)
    # Near-duplicates: of each group the smallest id that the classifier left.
    left = ids["quality_classifier"]
    gone = {i for i, of in {**copies, **near}.items() if i in left and of in left}
    assert ids["minhash_near_dedup"] == left - gone and len(kept["minhash_near_dedup"]) == len(left - gone)
    # Passages: every byte as by the plain version.
    before = {i: t for i, t in kept["minhash_near_dedup"] if i is not None}
    after = {i: t for i, t in kept["suffix_array_dedup"] if i is not None}
    assert after == without_passages(before)
    assert sum(passage in t for t in after.values()) == 1
    # Packing: each document's tokens, in sequences without gaps.
    name, stage = corpus_pipeline.STAGES[4]
    pieces = stage(spark, docs, str(tmp_path)).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = pieces[pieces["doc_id"].notna()].groupby("doc_id")["length"].sum().to_dict()
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
