"""Names under which a model's options ask for its parts, in any case and with any package path before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lexaris.functions.vectors import DISTANCES
from lexaris.operators import classify, lsi
from lexaris.operators.lemmatize import NAMES as LEMMATIZERS
from lexaris.sources import readers

# fixed values: kinds of documents and of mappers, with the spellings in use
DOCUMENTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "default": readers.vzxml, "xml": readers.vzxml, "vzxml": readers.vzxml, "vz": readers.vzxml,
    "cabxml": readers.cabxml, "cab": readers.cabxml, "cabcsv1g": readers.csv1g, "csv1g": readers.csv1g, "1g": readers.csv1g,
    "ddctabs": readers.ddctabs, "ddc": readers.ddctabs, "tabs": readers.ddctabs,
}
MAPPERS: dict[str, Callable] = {
    "bylemma": classify.raw_distances, "raw": classify.raw_distances, "default": lsi.distances, "lsi": lsi.distances,
    "bycat": lsi.distances, "lsibycat": lsi.distances, "knn": classify.neighbour_votes, "lsiknn": classify.neighbour_votes,
}
KINDS: dict[str, dict] = {"document": DOCUMENTS, "mapper": MAPPERS, "lemmatizer": LEMMATIZERS, "distance": DISTANCES}


def register(kind: str, name: str, part: object) -> None:
    """Adds a part of one's own, or replaces one."""
    KINDS[kind][name.lower()] = part


def resolve(kind: str, name: str | None):
    """The part of ``kind`` that ``name`` asks for; none asks for the default."""
    key = (name or "default").lower().rpartition("::")[2].replace("-", "").replace("_", "")
    if key not in KINDS[kind]:
        raise ValueError(f"unknown {kind} {name!r}")
    return KINDS[kind][key]


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Mappers applied one after the other."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run
