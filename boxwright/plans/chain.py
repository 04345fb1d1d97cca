"""Ingest, embed, cluster and export as one resumable chain."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import labels
from boxwright.operators import clustering, naming, vectors
from boxwright.store import Store

STEPS = ("ingest", "embed", "cluster", "export")


def run(store: Store, detections: DataFrame | None, scorer: Callable[[pd.DataFrame], list], inputs: list[str], sizes: DataFrame, first: str = "ingest", last: str = "export", **how) -> dict[str, DataFrame]:
    """Steps from ``first`` to ``last``; each starts from the stored table of the one before.

    Vectors and cluster names are changes to the table, not a new one. Only verified rows are exported;
    noise is left out of the annotations, not of the gallery.
    """
    a, b = STEPS.index(first), STEPS.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    if first != "ingest" and not store.exists("predictions"):
        raise FileNotFoundError("there is no table to go on from")
    out: dict[str, DataFrame] = {}
    for step in STEPS[a : b + 1]:
        if step == "ingest":
            store.write(predictions=detections)
        elif step == "embed":
            vectors.fill_store(store, scorer, inputs)
        elif step == "cluster":
            table = store.read("predictions", "vectors")
            found = clustering.clusters(table, **how)
            if found is not None:
                store.add_column("predictions", "evoc_clust", "int")
                ids = table.select("id", "roi_index")
                named = clustering.named_clusters(table, found).join(ids, "roi_index")
                store.change("predictions", named.select("id", F.col("cluster").alias("evoc_clust"), F.col("name").alias("new_label")))
        else:
            table = store.read("predictions")
            rows, shown = table.filter(labels.curated()), table.filter(labels.curated(exclude_noise=False))
            names = naming.check_unique(naming.stem_map(rows))
            out["voc"] = naming.voc_files(naming.voc_objects(rows, sizes), names)
            out["html"] = naming.gallery_pages(naming.gallery_rows(shown))
    return out
