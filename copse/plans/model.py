"""Saving and loading fitted forests: a folder of Parquet tables and one JSON line of settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from copse.operators.forest import GrowParams

FORMAT, VERSION = "copse-forest", 1
TABLES = ("nodes", "bag", "rows", "leaves", "labels")


@dataclass
class Model:
    """A fitted forest: settings, and tables by name (see TABLES)."""

    params: GrowParams
    features: list[str]
    kind: str  # classify, regress or unsupervised
    tables: dict[str, DataFrame]

    def save(self, path: str) -> None:
        """Write all tables and the settings below ``path``, which must not exist."""
        spark = self.tables["nodes"].sparkSession
        for name in TABLES:
            if name in self.tables:
                self.tables[name].write.parquet(f"{path}/{name}")
        meta = {"format": FORMAT, "version": VERSION, "params": asdict(self.params), "features": self.features, "kind": self.kind, "tables": [t for t in TABLES if t in self.tables]}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Model:
    """A model that :meth:`Model.save` wrote; another format or version is an error."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise ValueError(f"{path} holds {meta.get('format')} {meta.get('version')}, not {FORMAT} {VERSION}")
    params = GrowParams(**(meta["params"] | {"categorical": tuple(meta["params"]["categorical"])}))
    return Model(params, meta["features"], meta["kind"], {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]})
