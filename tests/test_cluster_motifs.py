"""Motifs come from every cluster, by the production widths and least area."""

import random

from seqprism.config import AnalysisConfig
from seqprism.operators import motifs


def test_each_cluster_is_searched_on_its_own(spark):
    draw = random.Random(4)
    sites, hills = [], []
    words = {0: "TGACTCATGCAAG", 1: "CACGTGGATAACT", 2: ""}
    for c, word in words.items():
        for i in range(90):
            seq = list("".join(draw.choices("ACGT", k=60)))
            seq[23 : 23 + len(word)] = [x if draw.random() < 0.75 else draw.choice("ACGT") for x in word]
            # The hill is shorter than the word: its middle is what the search looks around.
            text = "".join(seq)
            sites.append((100 * c + i, text.lower() if c == 1 and i >= 80 else text))
            hills.append(("m", c, 100 * c + i, 27, 6, 10.0 - c))
    tables = spark.createDataFrame(hills, "model string, cluster int, site_id long, start int, len int, score double"), spark.createDataFrame(sites, "site_id long, seq string")
    windows = {r.site_id: r.window for r in motifs.search_windows(*tables, 16).collect()}
    assert all(windows[i] == s[21:38] for i, s in sites)
    rows = motifs.cluster_motifs(*tables, AnalysisConfig()).collect()
    first = {c: sorted((r for r in rows if r.motif == f"m_c{c}_0"), key=lambda r: r.pos) for c in words}
    # Loose words of 13 letters: more than 8 of them tell them best from shuffled sequences.
    assert len(first[0]) > 8 and len(first[1]) > 8, {c: len(f) for c, f in first.items()}
    assert all(r.roc > 0.7 for r in rows)
    assert motifs.lower_share("aCGT") == 0.25
