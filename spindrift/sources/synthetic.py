"""Synthetic vectors: a Gaussian mixture in a latent space with heavy-tailed weights, mapped to more dimensions and quantised."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def mixture(spark: SparkSession, n: int, dim: int = 128, latent: int = 24, clusters: int = 2000, noise: float = 0.15, dtype: str = "uint8", seed: int = 42, parts: int = 0) -> DataFrame:
    """vec_id, embedding. A row depends on its id and the seed only, so a lost task draws the same rows again."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, latent))
    weight = rng.pareto(1.5, clusters) + 1
    weight /= weight.sum()
    lift = rng.normal(size=(latent, dim)) / np.sqrt(latent)
    probe = (centre[rng.choice(clusters, 4096, p=weight)] + noise * rng.normal(size=(4096, latent))) @ lift
    low, high = np.percentile(probe, [0.1, 99.9])

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i in pdf["id"]:
                own = np.random.default_rng([seed, int(i)])
                x = (centre[own.choice(clusters, p=weight)] + noise * own.normal(size=latent)) @ lift
                if dtype != "float32":
                    x = np.clip(np.rint((x - low) / (high - low) * 255), 0, 255) - (128 if dtype == "int8" else 0)
                out.append(x.astype("float32"))
            yield pd.DataFrame({"vec_id": pdf["id"], "embedding": out})

    ids = spark.range(0, n, 1, parts) if parts else spark.range(n)
    return ids.mapInPandas(draw, "vec_id long, embedding array<float>")
