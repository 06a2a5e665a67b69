"""Named SQL transformations per layer.

The files under ``ingot/sql/{bronze,silver,gold}/`` are Spark SQL and are
*run*, not just listed: :func:`run_layer` executes every file of a layer and
registers its result as the temp view ``{layer}_{name}``; :func:`run_all`
runs the layers in medallion order. They agree with the DataFrame functions
of :mod:`ingot.plans.silver` / :mod:`ingot.plans.gold` (a test checks it).
"""

from __future__ import annotations

import re
import uuid
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from ingot.session import configure

LAYERS = ("bronze", "silver", "gold")

# Session functions the SQL files use: Python truthiness on VARIANT values
# and ``str(a or b or "")``; same definitions as ingot.functions.expr.
_FUNCTIONS = (
    # falsy(x, t): x is a VARIANT value, t its str() (try_variant_get(x, '$', 'string')).
    # to_json runs only for the ambiguous renderings, to tell "0" from 0. A JSON number that is zero is rendered as 0... or -0...;
    # other texts aren't cast, as each failed cast costs an exception.
    """CREATE OR REPLACE TEMPORARY FUNCTION falsy(x VARIANT, t STRING) RETURNS BOOLEAN
RETURN t IS NULL OR t = ''
  OR ((t IN ('false', '[]', '{}') OR CASE WHEN startswith(t, '0') OR startswith(t, '-0') THEN coalesce(try_cast(t AS DOUBLE) = 0, false) ELSE false END)
      AND NOT startswith(to_json(x), '"'))""",
)


def _texts(layer: str) -> dict[str, str]:
    """The layer's transformations: name -> SQL text."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer: {layer!r}")
    found = resources.files("ingot").joinpath("sql", layer).iterdir()
    return {p.name.removesuffix(".sql"): p.read_text(encoding="utf-8") for p in sorted(found, key=lambda p: p.name) if p.name.endswith(".sql")}


def register_functions(spark: SparkSession) -> None:
    for stmt in _FUNCTIONS:
        spark.sql(stmt)


def run_sql(spark: SparkSession, layer: str, name: str, views: dict[str, str] | None = None, **args) -> DataFrame:
    """Run one transformation.

    ``views`` maps the input names its text uses to the temp views to read; named parameters
    (``:league_id``) come from ``args``.
    """
    configure(spark)
    register_functions(spark)
    texts = _texts(layer)
    if name not in texts:
        raise FileNotFoundError(f"transformation not found: {layer}/{name}")
    text = texts[name]
    for short, view in (views or {}).items():
        text = re.sub(rf"\b{re.escape(short)}\b", view, text)
    used = set(re.findall(r":([a-z_]+)\b", re.sub(r"--[^\n]*", "", text)))
    return spark.sql(text, args={k: v for k, v in args.items() if k in used})


def run_layer(
    spark: SparkSession, layer: str, names: list[str] | None = None, views: dict[str, str] | None = None,
    store: str | None = None, **args,
) -> dict[str, DataFrame]:
    """Run the transformations of a layer; each result becomes a temp view, entered in ``views`` as ``{layer}_{name}``.

    Without ``views`` the temp view has that name itself, for use from SQL. With a ``store`` folder results are
    written there and read back: the next layer then reads columns, and its filters reach the scan.
    """
    out = {}
    for name in names or list(_texts(layer)):
        df = run_sql(spark, layer, name, views, **args)
        if store is not None:
            path = f"{store.rstrip('/')}/{layer}_{name}_{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = spark.read.parquet(path)
        view = f"{layer}_{name}"
        if views is not None:
            views[view] = f"{view}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view if views is None else views[view])
        out[name] = df
    return out


def run_all(
    spark: SparkSession, views: dict[str, str] | None = None, store: str | None = None, **args
) -> dict[str, DataFrame]:
    """Q5: bronze -> silver -> gold. ``views`` names the ``*_raw`` input views (by default: as in the texts).

    Every run has views of its own, so two runs in one session don't meet. ``store``: where silver is written.
    """
    views, out = dict(views or {}), {}
    for layer in LAYERS:
        for name, df in run_layer(spark, layer, views=views, store=store if layer == "silver" else None, **args).items():
            out[f"{layer}_{name}"] = df
    return out
