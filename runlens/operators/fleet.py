"""Model availability, size look-up and sweep routing over a served-model manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.text import size_text


def name_prefixes(name) -> Column:
    """Every key a requested model may match: the full name and each prefix that
    ends just before a ``:`` (``a:b:c`` -> ``a``, ``a:b``, ``a:b:c``)."""
    c = F.col(name) if isinstance(name, str) else name
    parts = F.split(c, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))


def _match_keys(manifest: DataFrame, name: str = "name") -> DataFrame:
    return manifest.select(F.explode(name_prefixes(name)).alias("_key")).distinct()


def available(requested: DataFrame, manifest: DataFrame, model: str = "model", name: str = "name") -> DataFrame:
    """[JN1, SO1] Requested models that are served: some manifest name equals it or starts
    with ``model + ':'``.  The prefix condition becomes an equi semi-join on the
    exploded colon prefixes, so neither side needs a nested-loop join."""
    keys = _match_keys(manifest, name)
    return requested.join(keys, requested[model] == keys["_key"], "left_semi")


def missing(requested: DataFrame, manifest: DataFrame, model: str = "model", name: str = "name") -> DataFrame:
    """[JN2, SO1] Requested models with no matching manifest name."""
    keys = _match_keys(manifest, name)
    return requested.join(keys, requested[model] == keys["_key"], "left_anti")


def size_lookup(requested: DataFrame, manifest: DataFrame, model: str = "model", name: str = "name",
                size_bytes: str = "size_bytes", default: str = schemas.UNKNOWN_SIZE) -> DataFrame:
    """[JN3, SRC9] Exact-name size look-up, ``'%.1f GB'``; no exact name (even if a prefix
    matches) -> ``default``."""
    sizes = manifest.select(F.col(name).alias("_n"), size_text(size_bytes).alias("size"))
    j = requested.join(sizes, requested[model] == sizes["_n"], "left").drop("_n")
    return j.withColumn("size", F.coalesce(F.col("size"), F.lit(default)))


def route(models: DataFrame, model: str, excluded: Sequence[str], reasoning: Sequence[str],
          prefix_match: bool = True) -> DataFrame:
    """[SO4] Sweep routing: drop an excluded model set and send reasoning models to the
    chat variant of a task (base name before ``:`` is compared when
    ``prefix_match``)."""
    base = F.split(F.col(model), ":", 2)[0] if prefix_match else F.col(model)
    return (models.filter(~base.isin(*excluded) if excluded else F.lit(True))
            .withColumn("variant", F.when(base.isin(*reasoning), F.lit("chat")).otherwise(F.lit("default"))))
