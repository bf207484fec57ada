"""Dataset registry: named sources with column and tag mappings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Where a dataset may come from, first found wins. Hubs need a network and are named but not read here.
ORDER = ("hf_hub_url", "ms_hub_url", "om_hub_url", "script_url", "cloud_file_name", "file_name")


@dataclass
class Dataset:
    name: str
    kind: str
    location: str
    formatting: str = "alpaca"
    ranking: bool = False
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    split: str = "train"


def parse(name: str, entry: dict, *, hub: str = "hf") -> Dataset:
    """One registry entry. The chosen hub comes before the others; local files come last. A weight or size under
    the older name ``size`` is read as ``num_samples``."""
    order = sorted(ORDER, key=lambda k: (k != f"{hub}_hub_url", ORDER.index(k)))
    kind = next((k for k in order if k in entry), None)
    if kind is None:
        raise ValueError(f"dataset {name!r} names no source")
    return Dataset(name, kind, entry[kind], entry.get("formatting", "alpaca"), bool(entry.get("ranking", False)), entry.get("num_samples", entry.get("size")), dict(entry.get("columns", {})), dict(entry.get("tags", {})), entry.get("split", "train"))


def load_registry(text: str, names: list[str] | None = None, **settings) -> dict[str, Dataset]:
    entries = json.loads(text)
    absent = [n for n in names or [] if n not in entries]
    if absent:
        raise KeyError(f"not in the registry: {absent}")
    return {n: parse(n, entries[n], **settings) for n in (names or entries)}


def read(spark: SparkSession, dataset: Dataset, root: str) -> DataFrame:
    if dataset.kind == "file_name":
        return files.read_files(spark, f"{root}/{dataset.location}")
    if dataset.kind == "cloud_file_name":
        return read_cloud(spark, dataset.location)
    if dataset.kind == "script_url":
        from ..functions.registry import load_function

        return load_function(f"{root}/{dataset.location}", "load")(spark)
    raise NotImplementedError(f"{dataset.kind} needs a network")


#: Hadoop settings of an anonymous reader of an object store.
ANONYMOUS = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider", "fs.gs.auth.type": "UNAUTHENTICATED"}


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """JSON files below a path of an object store, one behind the other: without credentials first, then with those of the
    session. Spark opens the paths by itself, whatever their scheme."""
    reader = lambda options: spark.read.options(**options).option("recursiveFileLookup", True).json(path)
    try:
        return reader(ANONYMOUS)
    except Exception as e:  # noqa: BLE001  stores differ in what they raise for a refused reader
        if "denied" not in str(e).lower() and "forbidden" not in str(e).lower() and "401" not in str(e) and "403" not in str(e):
            raise
        return reader({})


def check_stage(dataset: Dataset, stage: str) -> None:
    """Ranking data fits the reward stage only, and the reward stage only ranking data."""
    if (stage == "rm") != dataset.ranking and stage != "ppo":
        raise ValueError(f"dataset {dataset.name!r} does not fit stage {stage!r}")


def tag_map(dataset: Dataset) -> dict[str, str]:
    """Role tags of the data to the engine's roles, with the usual ones as defaults."""
    default = {"user_tag": "human", "assistant_tag": "gpt", "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system"}
    return {dataset.tags.get(k, v): k.removesuffix("_tag") for k, v in default.items()}
