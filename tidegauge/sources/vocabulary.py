"""Namespaces of the registry vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.schema import WireNames

# Public vocabularies used by the registry.
PUBLIC_PREFIXES = {
    "ssn": "http://purl.oclc.org/NET/ssnx/ssn#",
    "iot-lite": "http://purl.oclc.org/NET/UNIS/fiware/iot-lite#",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dul": "http://www.ontologydesignpatterns.org/ont/dul/DUL.owl#",
    "qu": "http://purl.org/NET/ssnx/qu/qu#",
    "m3-lite": "http://purl.org/iot/vocab/m3-lite#",
}


def prefixes(wire: WireNames = WireNames()) -> dict[str, str]:
    return {"qoo": wire.base_iri, **PUBLIC_PREFIXES}


def iri(curie: str, wire: WireNames = WireNames()) -> str:
    """Full IRI of ``prefix:name``."""
    prefix, _, name = curie.partition(":")
    return prefixes(wire)[prefix] + name


def iri_for_prefix(prefix: str, with_last_char: bool = True, wire: WireNames = WireNames()) -> str | None:
    full = prefixes(wire).get(prefix)
    return full if full is None or with_last_char else full[:-1]


def prefix_table(spark: SparkSession, wire: WireNames = WireNames()) -> DataFrame:
    rows = [(p, full, full[:-1]) for p, full in prefixes(wire).items()]
    return spark.createDataFrame(rows, "prefix string, iri string, namespace string")


def expand(curie: Column, wire: WireNames = WireNames()) -> Column:
    """``prefix:name`` to the full IRI; text with an unknown prefix stays."""

    def step(rest: Column, item: tuple[str, str]) -> Column:
        prefix, full = item
        hit = curie.startswith(prefix + ":")
        return F.when(hit, F.concat(F.lit(full), F.substr(curie, F.lit(len(prefix) + 2)))).otherwise(rest)

    return reduce(step, prefixes(wire).items(), curie)


def shorten(full: Column, wire: WireNames = WireNames()) -> Column:
    """Full IRI to ``prefix:name``; other text stays."""

    def step(rest: Column, item: tuple[str, str]) -> Column:
        prefix, start = item
        short = F.concat(F.lit(prefix + ":"), F.substr(full, F.lit(len(start) + 1)))
        return F.when(full.startswith(start), short).otherwise(rest)

    return reduce(step, prefixes(wire).items(), full)
