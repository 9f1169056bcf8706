"""Tables that an office maintains, as parameters: taxonomy, entity aliases, blocklist, sites.

A folder named by ``DOCKETRY_CONFIG`` (or the argument) holds them as YAML or
JSON: ``taxonomy`` (categories: keywords, subcategories), ``entities`` (aliases,
entities), ``defendant_blocklist`` (exact_matches, patterns), ``states``.  What
is missing is empty, or for the taxonomy the one of ``functions.text``.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read(name: str, folder: str | None = None) -> dict:
    """The table ``name``; {} where there is none."""
    root = folder or os.environ.get("DOCKETRY_CONFIG")
    if not root:
        return {}
    for ending in (".json", ".yaml", ".yml"):
        path = Path(root) / (name + ending)
        if path.exists():
            text = path.read_text("utf-8")
            if ending == ".json":
                return json.loads(text) or {}
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: YAML can't be read here, give it as JSON") from e
            return yaml.safe_load(text) or {}
    return {}


def taxonomy(folder: str | None = None) -> tuple[dict[str, tuple], dict[str, tuple]]:
    """(keywords, subcategories) by category, in order."""
    from docketry.functions.text import SUBCATEGORIES, TAXONOMY

    cats = read("taxonomy", folder).get("categories")
    if not cats:
        return TAXONOMY, SUBCATEGORIES
    cats = {k: v or {} for k, v in cats.items() if k != "other"}
    return {k: tuple(w.lower() for w in v.get("keywords") or ()) for k, v in cats.items()}, {k: tuple(v.get("subcategories") or ()) for k, v in cats.items()}


def blocklist(folder: str | None = None) -> tuple[frozenset[str], tuple[str, ...]]:
    """(lower-cased names, patterns) that are no parties."""
    b = read("defendant_blocklist", folder)
    return frozenset(str(x).lower().strip() for x in b.get("exact_matches") or ()), tuple(b.get("patterns") or ())


def aliases(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(alias, name), each canonical name its own alias, too."""
    known = read("entities", folder).get("aliases") or {}
    rows = sorted({(str(a).strip(), str(n)) for a, n in known.items()} | {(str(n).strip(), str(n)) for n in known.values()})
    return spark.createDataFrame(rows, "alias string, name string")


def metadata(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(name, entity_type, industry, sec_cik) of known entities."""
    known = read("entities", folder).get("entities") or {}
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([(str(n), text(v.get("entity_type")), text(v.get("industry")), text(v.get("sec_cik"))) for n, v in known.items() if isinstance(v, dict)], "name string, entity_type string, industry string, sec_cik string")


SITE = "key string, state string, name string, office string, base_url string, listing_url string, pagination string, param string, start int, selectors map<string,string>, date_format string, active boolean"


def sites(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The registry of sites, one row each; ``active`` where it says nothing else."""
    rows = []
    for key, v in read("states", folder).items():
        if isinstance(v, dict):
            p = v.get("pagination") or {}
            rows.append((key, v.get("code"), v.get("name"), v.get("ag_office"), v.get("base_url"), v.get("press_release_url"), p.get("type", "none"), p.get("param"), int(p.get("start", 0)), {k: str(s) for k, s in (v.get("selectors") or {}).items() if s}, v.get("date_format"), bool(v.get("active", True))))
    return spark.createDataFrame(rows, SITE)
