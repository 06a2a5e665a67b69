"""ingot: a medallion analytics engine on PySpark.

Raw JSON records land in an append-only *bronze* layer that keeps an explicit
arrival sequence; *silver* conforms them to fixed schemas with lenient casts,
falsy-aware fallbacks and latest-wins deduplication; *gold* answers the
business questions (available players, injury report, league validation,
waiver recommendations) plus a catalog, samples and a run log.

Layout:
  session      session settings every query relies on
  schema       bronze / silver / gold StructTypes
  functions/   scalar Column builders (falsy-coalesce, lenient casts, ...)
  operators/   generic relational operators (latest-wins, bounded anti-join, first-n)
  sources/     bronze store, generic ingest, landed payload readers
  plans/       silver and gold datasets, catalog, SQL files, pipeline
  streaming/   Structured Streaming bronze ingest and incremental silver
"""

__version__ = "0.1.0"
