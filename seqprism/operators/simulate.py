"""Synthetic labelled sequences: a Markov background with motifs put in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order in which a draw goes through the bases of a matrix (columns A, C, G, T).
DRAW = [0, 2, 1, 3]
BASES = np.array(list("ACGT"))


def class_sizes(n: int, parts: tuple[float, ...] = (0.75, 0.25), main: tuple[str, ...] = ("X", "Y"), side: tuple[str, ...] = ("A", "B")) -> dict[str, int]:
    """Sizes of the classes `X;A`, ...: each main label has n sites, the k-th one with its k-th side
    label most often; the last part takes what rounding leaves."""
    out = {}
    for k, label in enumerate(main):
        sizes = [round(p * n) for p in parts[:-1]]
        sizes.append(n - sum(sizes))
        for j, size in enumerate(sizes):
            out[f"{label};{side[(k + j) % len(side)]}"] = size
    return out


def simulate(spark: SparkSession, sizes: dict[str, int], motifs: dict[str, np.ndarray], background: dict[str, list[float]], length: int = 150, insert_rate: float = 0.7, seed: int = 42) -> DataFrame:
    """(site_id, annotation, seq). background: context (possibly empty) to the chances of A, C, G, T.

    Each of a site's labels with a motif puts it in with the insert rate: the i-th of m motifs at
    i * (length // m) + 15, over what stands there. Everything follows from (seed, site_id), however
    the sites are dealt.
    """
    names = list(sizes)
    ends = np.cumsum([sizes[n] for n in names])
    order = max(map(len, background))
    even = np.cumsum(background[""]) if order == 0 else None

    def run(batches):
        for batch in batches:
            out = []
            for site in batch["id"]:
                random = np.random.default_rng([seed, site])
                name = names[int(np.searchsorted(ends, site, side="right"))]
                drawn = random.random(length)
                if order == 0:
                    # Without a context a letter follows from its own draw.
                    text = "".join(BASES[np.minimum(3, np.searchsorted(even, drawn, side="right"))])
                else:
                    text = ""
                    for u in drawn:
                        for k in range(min(order, len(text)), -1, -1):
                            if (chances := background.get(text[len(text) - k :] if k else "")) is not None:
                                break
                        text += BASES[min(3, int(np.searchsorted(np.cumsum(chances), u, side="right")))]
                chosen = [m for label in name.split(";") if (m := motifs.get(label)) is not None and random.random() < insert_rate]
                letters = list(text)
                for i, matrix in enumerate(chosen):
                    at = i * (length // len(chosen)) + 15
                    for j, row in enumerate(matrix):
                        pick = int(np.searchsorted(np.cumsum(row[DRAW]), random.random(), side="right"))
                        if at + j < length:
                            letters[at + j] = BASES[DRAW[min(3, pick)]]
                out.append((site, name, "".join(letters)))
            yield pd.DataFrame(out, columns=["site_id", "annotation", "seq"])

    return spark.range(int(ends[-1]) if len(ends) else 0).mapInPandas(run, "site_id long, annotation string, seq string")


def sweep(overlaps: list[float], rates: list[float]) -> list[dict[str, float]]:
    """Scenarios: every overlap with every insert rate; one of each alone is a list of one."""
    return [{"overlap": o, "insert_rate": r} for o in overlaps for r in rates]


def class_balance(sites: DataFrame) -> DataFrame:
    return sites.groupBy("annotation").agg(F.count("*").alias("n"))
