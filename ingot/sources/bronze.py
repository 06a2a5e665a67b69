"""Bronze store: append-only raw records with an explicit arrival sequence.

At rest bronze is Parquet under ``{root}/bronze``, a folder for each commit, source and table. The commit log
(:mod:`ingot.sources.commits`) says which folders are live: reading one table opens no other's, writers never touch each
other's folders, and a reader keeps its snapshot while others append or compact. A row holds one JSON record as text plus the
sequence columns ``(_batch_id, _writer, _file, _block, _pos)``: ``_batch_id`` is allocated by the store per append,
``_writer`` parts two appends that came by one number, ``_file``/``_block`` name the landed file and split, and ``_pos`` is a
``monotonically_increasing_id()`` assigned directly above the scan and then
*persisted* - it is never recomputed by a query. Comparing the fields in
order reproduces arrival order, which is what "latest wins" means.

Bad input is kept, not dropped: a malformed line is stored with
``is_malformed = true`` and read back through :func:`quarantine`.
"""

from __future__ import annotations

import time
import uuid
from math import ceil
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, VariantType

from ingot.functions.expr import json_fields
from ingot.operators.dedup import SEQ
from ingot.schema import BRONZE as BRONZE_SCHEMA
from ingot.schema import SEQ_FIELDS
from ingot.sources import commits, files

BRONZE_DIR = "bronze"
TABLES_DIR = "_tables"
BATCHES_DIR = "_batches"
KEYS_DIR = "keys"
TARGET_BYTES = 128 << 20  # of a compacted file, at most, about
TASK_ROWS = 1 << 19  # that one task of a compaction sorts, about: records that compress well make a file of many rows
RETENTION = 7 * 24 * 3600  # seconds that vacuum leaves what is no longer live

# Lines made of whitespace only are skipped, as the reference strips lines (fixed pattern).
_BLANK = r"^\s*$"
# {root}/{source_id}/{table}.jsonl, a file or a folder of files (fixed ending for JSON Lines trees).
_JSONL = ".jsonl"
# Timestamps keep microseconds in JSON records (Spark's default drops them).
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def allocate_batch(spark: SparkSession, root: str, key: str | None = None) -> int:
    """The store's next batch id, whichever driver asks: the number whose file this call created.

    A ``key`` (of a stream's micro-batch, say) always gets the same number.
    """
    folder = f"{root.rstrip('/')}/{BATCHES_DIR}"
    while True:
        known = [n.rpartition("=") for n in files.names(spark, folder)]
        mine = [int(n) for k, _, n in known if key and k == key]
        if mine:
            return min(mine)
        number = 1 + max([0, *(int(n) for _, _, n in known)])
        if files.create(spark, f"{folder}/{number:012d}"):
            if key:
                files.create(spark, f"{folder}/{key}={number:012d}")
            return number


def _with_file_metadata(df: DataFrame) -> DataFrame:
    """Add ``_file``/``_block`` from a file scan's metadata, or constants for other sources."""
    try:
        return df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    except AnalysisException:
        return df.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"))


def _bronze_row(record: Column, is_malformed: Column, source_id: str | Column, tbl: str | Column, batch_id: int) -> list[Column]:
    return [
        F.lit(batch_id).cast("long").alias("_batch_id"),
        F.lit("").alias("_writer"),
        F.col("_file"),
        F.col("_block").cast("long").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        record.alias("record"),
        is_malformed.alias("is_malformed"),
        (F.lit(source_id) if isinstance(source_id, str) else source_id).alias("source_id"),
        (F.lit(tbl) if isinstance(tbl, str) else tbl).alias("tbl"),
    ]


def records_from_dataframe(df: DataFrame, source_id: str, tbl: str, batch_id: int = 0) -> DataFrame:
    """Bronze rows from any DataFrame, one JSON record per row.

    Must be applied to the DataFrame as read (file metadata and the position id
    are taken directly above the scan).
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    base = _with_file_metadata(df)
    return base.select(
        *_bronze_row(F.to_json(F.struct(*cols), JSON_OPTIONS), F.lit(False), source_id, tbl, batch_id)
    )


def records_from_json_column(
    df: DataFrame, json_col: str, source_id: str, tbl: str, batch_id: int = 0, variant: bool = False
) -> DataFrame:
    """Bronze rows from a column that already holds one JSON record per row; ``variant``: with ``record_v``, for an append that keeps it."""
    base = df if "_file" in df.columns else _with_file_metadata(df)
    rec = F.col(json_col)
    if not variant:
        return base.select(*_bronze_row(rec, F.try_parse_json(rec).isNull(), source_id, tbl, batch_id))
    v = F.col("record_v")
    return base.withColumn("record_v", F.try_parse_json(rec)).select(*_bronze_row(rec, v.isNull(), source_id, tbl, batch_id), v)


def read_jsonl(spark: SparkSession, paths: str | list[str], source_id: str, tbl: str, batch_id: int = 0) -> DataFrame:
    """Bronze rows from JSON Lines files; blank lines skipped, bad lines flagged."""
    text = spark.read.text(paths)
    base = _with_file_metadata(text).where(~F.col("value").rlike(_BLANK))
    rec = F.col("value")
    return base.select(*_bronze_row(rec, F.try_parse_json(rec).isNull(), source_id, tbl, batch_id))


def _tree_names(file: Column) -> tuple[Column, Column]:
    """(source, table) from the path of a table's file, or of a file in a table's folder.

    By plain searches for "/" from the end: a pattern would be tried at each character of each row's path.
    """
    last = lambda n: F.substring_index(file, "/", -n)
    folder = F.substring_index(last(2), "/", 1)
    in_folder = folder.endswith(_JSONL) & (F.length(folder) > len(_JSONL)) & (last(3) != last(2)) & (last(1) != "")
    part = lambda n: F.when(in_folder, F.substring_index(last(n + 1), "/", 1)).otherwise(F.substring_index(last(n), "/", 1))
    name = part(1)
    found = name.endswith(_JSONL) & (F.length(name) > len(_JSONL))
    return F.when(found, part(2)).otherwise(""), F.when(found, name.substr(F.lit(1), F.length(name) - len(_JSONL))).otherwise("")


def read_jsonl_tree(spark: SparkSession, root: str, batch_id: int = 0) -> DataFrame:
    """Every ``{root}/{source_id}/{table}.jsonl`` in one distributed scan.

    Source and table come from the file path, so all tables load in one job.
    """
    text = spark.read.text(f"{root.rstrip('/')}/*/*.jsonl")
    base = _with_file_metadata(text).where(~F.col("value").rlike(_BLANK))
    rec = F.col("value")
    src, tbl = _tree_names(F.col("_file"))
    return base.select(*_bronze_row(rec, F.try_parse_json(rec).isNull(), src, tbl, batch_id))


# --------------------------------------------------------------------------- sink
def _read(spark: SparkSession, root: str, paths: list[str], variant: bool = False) -> DataFrame:
    """The rows of some commits' folders; with ``variant`` also ``record_v``."""
    base = f"{root}/{BRONZE_DIR}"
    schema = StructType([*BRONZE_SCHEMA.fields, StructField("commit", StringType()), *([StructField("record_v", VariantType())] if variant else [])])
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" for p in paths]).drop("commit")


def _write(rows: DataFrame, root: str, index: dict[str, str], variant: bool = False) -> list[commits.Folder]:
    """Write rows to a new folder; its tables, with their counts. ``index``: the field whose values are kept as a table's keys.

    ``variant``: keep each parsed record beside its text. Spark shreds the column: fields that the records share become Parquet columns.
    """
    spark, commit = rows.sparkSession, f"commit={uuid.uuid4().hex}"
    path = f"{root}/{BRONZE_DIR}/{commit}"
    if not variant:
        rows = rows.drop("record_v")
    elif "record_v" not in rows.columns:
        rows = rows.withColumn("record_v", F.try_parse_json("record"))
    rows.write.partitionBy("source_id", "tbl").parquet(path)
    found = [f"{commit}/{s}/{t}" for s in files.names(spark, path) if "=" in s for t in files.names(spark, f"{path}/{s}") if "=" in t]
    if not found:
        return []
    written = _read(spark, root, found, variant)
    count = {(r["source_id"], r["tbl"]): r for r in written.groupBy("source_id", "tbl").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_malformed").alias("malformed"), F.min("_batch_id").alias("first")
    ).collect()}  # a row for each table of the commit
    if index:
        field = F.coalesce(*[F.when(F.col("tbl") == t, json_fields()(f).text()) for t, f in index.items()])
        keyed = written.where(F.col("tbl").isin(*index) & ~F.col("is_malformed"))
        if not variant:  # else the scan reads just that field
            keyed = keyed.withColumn("record_v", F.try_parse_json("record"))
        keys = keyed.select("source_id", "tbl", field.alias("key")).where("key IS NOT NULL").distinct()
        keys.repartition("source_id", "tbl").sortWithinPartitions("key").write.partitionBy("source_id", "tbl").parquet(f"{root}/{KEYS_DIR}/{commit}")
    out = []
    for p in found:
        source_id, tbl = (unquote(x.partition("=")[2]) for x in p.split("/")[1:])
        held, (size, n) = count[source_id, tbl], files.size(spark, f"{root}/{BRONZE_DIR}/{p}")
        out.append(commits.Folder(p, source_id, tbl, held["rows"], held["malformed"], size, n, held["first"], tbl in index, variant))
    return out


def append(
    rows: DataFrame, root: str, tables: list[tuple[str, str]] | None = None, key: str | None = None,
    index: dict[str, str] | None = None, variant: bool = False,
) -> int:
    """Append bronze rows as one batch; returns its id.

    The rows go to a folder of their own, which the commit log then names: any number of writers may append
    at once, and a reader sees all of a batch or nothing. An append whose ``key`` is in the log already changes nothing, so a
    replayed micro-batch counts once. Spark's commit protocol makes the write safe against task retries.
    ``tables`` names those that may get no rows: they are listed with count 0. ``index`` maps tables to the
    field whose values are kept beside them, see :func:`keys`; with ``variant`` the parsed records are, see :func:`parsed_at`.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    before = commits.snapshot(spark, root)
    if key is not None and key in before.keys:
        return before.keys[key][1]
    number = allocate_batch(spark, root, key)
    rows = rows.withColumns({"_batch_id": F.lit(number).cast("long"), "_writer": F.lit(key or uuid.uuid4().hex)})
    commits.commit(spark, root, "append", before, _write(rows, root, index or {}, variant), number=number, key=key)
    for source_id, tbl in tables or []:
        register_table(spark, root, source_id, tbl)
    return number


def register_table(spark: SparkSession, root: str, source_id: str, tbl: str) -> None:
    """List a (possibly empty) table: one marker file for each table, however often it is appended to."""
    files.create(spark, f"{root.rstrip('/')}/{TABLES_DIR}/{_escaped(source_id)}={_escaped(tbl)}")


# --------------------------------------------------------------------------- upkeep
def compact(spark: SparkSession, root: str, target: int = TARGET_BYTES) -> int:
    """Rewrite the folders that are below ``target`` bytes, of tables with two or more of them; returns how many were replaced.

    Rows keep their sequence. The old folders stay readable until :func:`vacuum`; appends may run meanwhile, and of two
    compactions of the same folders one counts.
    """
    root = root.rstrip("/")
    now = commits.snapshot(spark, root)
    small: dict[tuple[str, str], list[commits.Folder]] = {}
    for f in now.of():
        if f.bytes < target:
            small.setdefault((f.source_id, f.tbl), []).append(f)
    old = [f for group in small.values() if len(group) > 1 for f in group]
    if not old:
        return 0
    parts = ceil(max(sum(f.bytes for f in old) / target, sum(f.rows for f in old) / TASK_ROWS))
    order = ["source_id", "tbl", *SEQ_FIELDS]
    rows = _read(spark, root, [f.path for f in old])
    rows = (rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    index = {t: _KEY_FIELDS[t] for t in {f.tbl for f in old} if t in _KEY_FIELDS and all(f.index for f in old if f.tbl == t)}
    new = _write(rows, root, index, any(f.variant for f in old))
    commits.commit(spark, root, "compact", now, new, [f.path for f in old])
    return len(old)


def vacuum(spark: SparkSession, root: str, older_than: float = RETENTION) -> int:
    """Delete what is no longer live and was last changed ``older_than`` seconds ago or more; returns the number of folders and files.

    That are folders that no commit names any longer (or never did: of failed writes and repeated attempts), log entries that a summary
    covers, batch numbers below the last, and temporary files. A read that began before, or a stream that lags more than that, may lose its files.
    """
    root, cut, gone = root.rstrip("/"), time.time() - older_than, 0
    commits.summarise(spark, root)
    now = commits.snapshot(spark, root)
    live = {f.path.partition("/")[0] for f in now.live.values()}
    for place in (BRONZE_DIR, KEYS_DIR):
        for name, changed in files.aged(spark, f"{root}/{place}"):
            if name not in live and changed <= cut:
                files.remove(spark, f"{root}/{place}/{name}")
                gone += 1
    for name, changed in files.aged(spark, f"{root}/{commits.LOG_DIR}"):
        if name in now.covered and changed <= cut:
            files.remove(spark, f"{root}/{commits.LOG_DIR}/{name}")
            gone += 1
    numbers = files.aged(spark, f"{root}/{BATCHES_DIR}")
    last = max((n.rpartition("=")[2] for n, _ in numbers), default="")
    for name, changed in numbers:
        if name.rpartition("=")[2] < last and changed <= cut:
            files.remove(spark, f"{root}/{BATCHES_DIR}/{name}")
            gone += 1
    return gone


def _escaped(name: str) -> str:
    return quote(name, safe="")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, tbl) of the listed tables."""
    found = [n.split("=") for n in files.names(spark, f"{root.rstrip('/')}/{TABLES_DIR}")]
    return spark.createDataFrame([(unquote(s), unquote(t)) for s, t in found], "source_id string, tbl string")


def export_jsonl(rows: DataFrame, path: str) -> None:
    """Optional JSON Lines copy of bronze, one directory per source and table."""
    rows.select("source_id", "tbl", F.col("record").alias("value")).write.mode("append").partitionBy(
        "source_id", "tbl"
    ).text(path)


# --------------------------------------------------------------------------- scan
def scan(spark: SparkSession, root: str, source_id: str | None = None, tbl: str | None = None, as_of: int | None = None) -> DataFrame:
    """Bronze rows, optionally of one source/table (no other folder is opened) or up to a batch id."""
    root = root.rstrip("/")
    live = commits.snapshot(spark, root).of(source_id, tbl)
    if as_of is not None:
        live = [f for f in live if f.first <= as_of]
    if not live:
        return spark.createDataFrame([], BRONZE_SCHEMA)
    rows = _read(spark, root, [f.path for f in live])
    return rows if as_of is None else rows.where(F.col("_batch_id") <= as_of)


def parsed_commits(spark: SparkSession, root: str, adds: list[dict], source_id: str, tbl: str) -> DataFrame | None:
    """The table's well-formed rows in folders that some commits added (as the log has them), parsed; None if one of them is gone by now."""
    root = root.rstrip("/")
    if not all(files.matches(spark, f"{root}/{BRONZE_DIR}/{a['path']}") for a in adds):
        return None
    rows = _parsed_folders(spark, root, [(a["path"], a.get("variant", False)) for a in adds])
    return rows.where((F.col("source_id") == source_id) & (F.col("tbl") == tbl))


# The field whose values identify what a table's records are about (fixed values: the reference's lazy ingest asks by league).
_KEY_FIELDS = {"league": "league_id", "rosters": "league_id"}


def keys(spark: SparkSession, root: str, source_id: str, tbl: str) -> DataFrame:
    """(key) the distinct values of a table's key field, from the sorted key files written at each append: no record is read.

    Folders that were appended without an index are read whole.
    """
    root = root.rstrip("/")
    live = commits.snapshot(spark, root).of(source_id, tbl)
    out = spark.createDataFrame([], "key string")
    held = [f"{root}/{KEYS_DIR}/{f.path}" for f in live if f.index]
    held = [p for p in held if files.matches(spark, p)]  # a table without any key has no folder
    if held:
        out = spark.read.schema("key string").parquet(*held)
    bare = [f.path for f in live if not f.index]
    if bare:
        field = json_fields()(_KEY_FIELDS.get(tbl, "id")).text()
        rows = _read(spark, root, bare).where(~F.col("is_malformed")).withColumn("record_v", F.try_parse_json("record"))
        out = out.unionByName(rows.select(field.alias("key")).where("key IS NOT NULL"))
    return out.distinct()


def seq_col() -> Column:
    return F.struct(*[F.col(c) for c in SEQ_FIELDS])


def parsed(rows: DataFrame) -> DataFrame:
    """Well-formed bronze rows as ``(source_id, tbl, record_v VARIANT, _seq)``."""
    return rows.where(~F.col("is_malformed")).select(
        "source_id", "tbl", F.try_parse_json("record").alias("record_v"), seq_col().alias(SEQ)
    )


def _parsed_folders(spark: SparkSession, root: str, folders: list[tuple[str, bool]]) -> DataFrame:
    """The well-formed rows of some commits' folders, each with whether it holds parsed records."""
    out = None
    for variant in (True, False):
        paths = [path for path, held in folders if held == variant]
        if paths:
            rows = _read(spark, root, paths, variant)
            if variant:
                rows = rows.where(~F.col("is_malformed")).select("source_id", "tbl", "record_v", seq_col().alias(SEQ))
            else:
                rows = parsed(rows)
            out = rows if out is None else out.unionByName(rows)
    return parsed(spark.createDataFrame([], BRONZE_SCHEMA)) if out is None else out


def parsed_at(spark: SparkSession, root: str, source_id: str, tbl: str) -> DataFrame:
    """A table's well-formed rows as :func:`parsed` gives them.

    Of folders with parsed records the scan reads only the fields that are asked for, as columns, and no text; the others' texts are parsed.
    """
    root = root.rstrip("/")
    return _parsed_folders(spark, root, [(f.path, f.variant) for f in commits.snapshot(spark, root).of(source_id, tbl)])


def typed(rows: DataFrame, schema) -> DataFrame:
    """Well-formed bronze rows parsed into a fixed schema (e.g. for round trips)."""
    s = schema if isinstance(schema, str) else schema.simpleString()
    return rows.where(~F.col("is_malformed")).select(F.from_json("record", s, JSON_OPTIONS).alias("r"), seq_col().alias(SEQ)).select(
        "r.*", SEQ
    )


def quarantine(rows: DataFrame) -> DataFrame:
    """Malformed rows, kept with their position for inspection."""
    return rows.where(F.col("is_malformed")).select("source_id", "tbl", "_file", "_block", "_pos", "record")


def quarantine_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_id", "tbl").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.col("is_malformed").cast("long")).alias("malformed_count"),
    )


def first_rows(rows: DataFrame, n: int = 100) -> DataFrame:
    """L2 for bronze: the first ``n`` records in arrival order."""
    return rows.orderBy(*[F.col(c) for c in SEQ_FIELDS]).limit(n)


# --------------------------------------------------------------------------- catalog
def catalog(rows: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(layer, source_id, name, row_count) per bronze table.

    Counting is a partial+final aggregate on two low-cardinality columns, so the
    shuffle carries one row per table per task. With a listing, tables that
    were appended empty show up with 0.
    """
    counts = rows.groupBy("source_id", "tbl").agg(F.count(F.lit(1)).alias("row_count"))
    if listing is not None:
        named = listing.select("source_id", "tbl", F.lit(0).cast("long").alias("row_count"))
        counts = counts.unionByName(named).groupBy("source_id", "tbl").agg(F.sum("row_count").alias("row_count"))
    return counts.select(
        F.lit("bronze").alias("layer"), "source_id", F.col("tbl").alias("name"), F.col("row_count").cast("long").alias("row_count")
    )


def catalog_at(spark: SparkSession, root: str) -> DataFrame:
    """A5/S13 of a store, from the counts that each commit carries: no row is read, however many there are."""
    now = commits.snapshot(spark, root.rstrip("/"))
    counts = {(f.source_id, f.tbl): 0 for f in now.of()}
    for f in now.of():
        counts[f.source_id, f.tbl] += f.rows
    rows = spark.createDataFrame([("bronze", s, t, n) for (s, t), n in counts.items()], "layer string, source_id string, name string, row_count long")
    named = listing(spark, root).select(F.lit("bronze").alias("layer"), "source_id", F.col("tbl").alias("name"), F.lit(0).cast("long").alias("row_count"))
    return rows.unionByName(named).groupBy("layer", "source_id", "name").agg(F.sum("row_count").alias("row_count"))


def quarantine_at(spark: SparkSession, root: str) -> DataFrame:
    """X5's counts of a store, from the commits."""
    held: dict[tuple[str, str], list[int]] = {}
    for f in commits.snapshot(spark, root.rstrip("/")).of():
        n = held.setdefault((f.source_id, f.tbl), [0, 0])
        n[0], n[1] = n[0] + f.rows, n[1] + f.malformed
    return spark.createDataFrame([(s, t, *n) for (s, t), n in held.items()], "source_id string, tbl string, row_count long, malformed_count long")
