"""Structured Streaming ingest and incremental silver.

X1 ``stream_to_bronze``: JSON Lines files landing in a directory are picked
up by a file stream and appended to bronze by ``foreachBatch``; positions are
taken directly above the micro-batch scan, as for batch ingest. The checkpoint
lies in the store by default, so a restarted query resumes where it stopped. A
micro-batch has one key in the store's commit log, so a replay changes nothing. The parsed records are kept
beside the texts, so that silver reads the fields it needs as columns and parses nothing again.

X2 ``incremental_silver``: the stream reads the commit log itself. Entries appear whole, have names of their own
and are never replaced, so Spark's file stream keeps the offsets, and what a micro-batch merges are the folders that
its entries add; folders of failed or repeated attempts are in no entry that counts, and compactions add no rows.

Silver is kept as sorted runs in buckets by key hash. A micro-batch is conformed, deduplicated and written as one run
of the buckets it touches; a bucket with more than MAX_RUNS runs has them merged into one. So what is written follows the
batch, each row being rewritten once for some MAX_RUNS batches, and never the table. Readers deduplicate over the runs
(latest wins is associative: the winner over runs equals the winner over all rows). Runs go to folders of their own, and a
new manifest (a line for each run) is published afterwards; nothing that a reader may hold is overwritten, and a crash
at any point leaves the last manifest. A replay adds the same rows again, which changes nothing.

The manifest also holds the table's counts (A6, G5). A batch changes them by what its keys were before and are now: a key that
was not there adds one, a record that replaces another takes back what that one counted for. Only the buckets the batch touches are
read for it, and of those only the columns that decide; merging runs changes no count.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ingot.functions.expr import json_fields
from ingot.operators.dedup import FIRST_SEQ, SEQ, latest_wins
from ingot.plans import silver as sv
from ingot.schema import SILVER_LEAGUE_KEYS, SILVER_PLAYER_KEYS, SILVER_ROSTER_KEYS
from ingot.session import configure, shuffles_dropped
from ingot.sources import bronze, commits, files

_BLANK = r"^\s*$"
BUCKETS = 64
MAX_RUNS = 4  # of a bucket, before they are merged
SMALL = 8  # a run that is this many times smaller than the earlier ones of its buckets is joined with them before its changes are counted


def stream_to_bronze(
    spark: SparkSession,
    landing_dir: str,
    root: str,
    source_id: str,
    tbl: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Land ``*.jsonl`` files from ``landing_dir`` into bronze ``(source_id, tbl)``."""
    configure(spark)
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(landing_dir).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    place = hashlib.sha256(landing_dir.encode()).hexdigest()[:12]
    checkpoint = checkpoint or f"{root.rstrip('/')}/_streams/{source_id}-{tbl}-{place}"
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(~F.col("value").rlike(_BLANK)).withColumn("record_v", F.try_parse_json("value")).select(
            F.lit(0).cast("long").alias("_batch_id"),
            F.lit("").alias("_writer"),
            "_file",
            F.col("_block").cast("long").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
            F.col("value").alias("record"),
            F.col("record_v").isNull().alias("is_malformed"),
            F.lit(source_id).alias("source_id"),
            F.lit(tbl).alias("tbl"),
            "record_v",
        )
        with shuffles_dropped(spark):
            bronze.append(rows, root, [(source_id, tbl)], key=f"{stream}-{batch_id}", variant=True)

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# --------------------------------------------------------------------------- X2
@dataclass(frozen=True)
class Kind:
    """A silver table that X2 can keep: how records conform, what a key is, and which rows each of its counts is of."""

    conform: Callable[..., DataFrame]
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    counted: dict[str, Callable[[], Column]]


def _every() -> Column:
    return F.lit(True)


KINDS = {
    "players": Kind(sv.conform_players, ("player_id",), SILVER_PLAYER_KEYS, {"players": _every, "injuries": sv.is_injured}),
    "league": Kind(sv.conform_leagues, ("league_id",), SILVER_LEAGUE_KEYS, {"league": _every}),
    "rosters": Kind(sv.conform_rosters, ("league_id", "roster_id"), SILVER_ROSTER_KEYS, {"rosters": _every}),
}
_COUNTS = "counts"  # the manifest's line that is no run


def _manifest(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """bucket -> the folders of its runs."""
    out: dict[int, list[str]] = {}
    for line in files.current(spark, f"{path.rstrip('/')}/_versions"):
        bucket, folder = line.split("\t")
        if bucket != _COUNTS:
            out.setdefault(int(bucket), []).append(folder)
    return out


def _latest(rows: DataFrame, kind: Kind) -> DataFrame:
    """One row per key: the latest winner, with the first of all first-seen sequences."""
    values = [c for c in kind.columns if c not in kind.keys]
    return rows.groupBy(*kind.keys).agg(
        F.max_by(F.struct(*values, SEQ), F.col(SEQ)).alias("_w"), F.min(FIRST_SEQ).alias(FIRST_SEQ)
    ).select(*kind.keys, "_w.*", FIRST_SEQ).select(*kind.columns, SEQ, FIRST_SEQ)


def _read_runs(spark: SparkSession, folders: list[str], kind: Kind) -> DataFrame:
    return spark.read.parquet(*folders).select(*kind.columns, SEQ, FIRST_SEQ)


def read_current(spark: SparkSession, path: str, table: str = "players") -> DataFrame | None:
    """Silver as last published, or None before the first version."""
    held = _manifest(spark, path)
    return _latest(_read_runs(spark, sorted(f for runs in held.values() for f in runs), KINDS[table]), KINDS[table]) if held else None


def recount(spark: SparkSession, path: str, table: str = "players") -> dict[str, int]:
    """A silver table's counts, from its rows."""
    kind, rows = KINDS[table], read_current(spark, path, table)
    if rows is None:
        return dict.fromkeys(kind.counted, 0)
    return rows.agg(*[F.count_if(c()).alias(n) for n, c in kind.counted.items()]).first().asDict()


def counts(spark: SparkSession, path: str, table: str = "players") -> dict[str, int]:
    """A silver table's counts as its manifest has them: no row is read, but for one that was published without them."""
    lines = files.current(spark, f"{path.rstrip('/')}/_versions")
    held = [line.partition("\t")[2] for line in lines if line.startswith(_COUNTS)]
    return json.loads(held[0]) if held else recount(spark, path, table)


def _changes(spark: SparkSession, kind: Kind, added: list[str], before: list[str]) -> dict[str, int]:
    """What a run's rows change in the counts, given the earlier runs of its buckets."""
    marks = [c().alias(n) for n, c in kind.counted.items()]
    new = _read_runs(spark, added, kind).select(*kind.keys, SEQ, F.struct(*marks).alias("_c"), F.lit(None).cast("boolean").alias("_old"))
    rows = new
    if before:
        old = _read_runs(spark, before, kind).select(*kind.keys, SEQ, F.struct(*marks).alias("_c"), F.lit(True).alias("_old"))
        size = lambda folders: sum(files.size(spark, f)[0] for f in folders)
        if size(added) * SMALL < size(before):  # else what the join drops costs less than the join; a key without a new row changes no count
            old = old.join(new.select(*kind.keys), list(kind.keys), "left_semi")
        rows = new.unionByName(old)
    keyed = rows.groupBy(*kind.keys).agg(
        F.max_by("_c", SEQ).alias("now"), F.max_by("_c", F.when(F.col("_old"), F.col(SEQ))).alias("was")  # a null order never wins
    )
    change = [(F.count_if(F.col("now")[n]) - F.count_if(F.coalesce(F.col("was")[n], F.lit(False)))).alias(n) for n in kind.counted]
    return keyed.agg(*change).first().asDict()


def _write_run(spark: SparkSession, path: str, rows: DataFrame, kind: Kind) -> dict[int, str]:
    """Write silver rows as one run for each bucket that has any; bucket -> folder."""
    bucket = F.pmod(F.xxhash64(*kind.keys), F.lit(BUCKETS)).cast("int")
    version = f"{path}/v={uuid.uuid4().hex}"
    rows = rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket")  # few files for a small run, several for a large bucket
    rows.sortWithinPartitions("_bucket", *kind.keys).write.partitionBy("_bucket").parquet(version)
    return {int(n.partition("=")[2]): f"{version}/{n}" for n in files.names(spark, version) if n.startswith("_bucket=")}


def merge(spark: SparkSession, path: str, new_records: DataFrame, table: str = "players") -> DataFrame | None:
    """One X2 step: the conformed new records become a run, buckets with too many runs are merged, and both are published with the counts."""
    path, kind = path.rstrip("/"), KINDS[table]
    new = latest_wins(kind.conform(new_records, json_fields()), kind.keys).select(*kind.columns, SEQ, FIRST_SEQ)
    held = _manifest(spark, path)
    added = _write_run(spark, path, new, kind)
    if not added:
        return read_current(spark, path, table)
    change = _changes(spark, kind, list(added.values()), [f for b in added for f in held.get(b, [])])
    now = {n: c + change[n] for n, c in counts(spark, path, table).items()}
    for b, folder in added.items():
        held.setdefault(b, []).append(folder)
    full = {b: runs for b, runs in held.items() if len(runs) > MAX_RUNS}
    if full:
        rows = _latest(_read_runs(spark, [f for runs in full.values() for f in runs], kind), kind)
        held |= {b: [f] for b, f in _write_run(spark, path, rows, kind).items()}
    lines = [f"{b}\t{f}" for b, runs in sorted(held.items()) for f in runs]
    files.publish(spark, f"{path}/_versions", "\n".join([*lines, f"{_COUNTS}\t{json.dumps(now)}"]))
    return read_current(spark, path, table)


def merge_players(spark: SparkSession, path: str, new_records: DataFrame) -> DataFrame | None:
    return merge(spark, path, new_records, "players")


def vacuum_silver(spark: SparkSession, path: str, older_than: float = bronze.RETENTION) -> int:
    """Delete runs that the current manifest doesn't name, and older manifests, changed ``older_than`` seconds ago or more."""
    path, cut, gone = path.rstrip("/"), time.time() - older_than, 0
    live = {f.removeprefix(f"{path}/").partition("/")[0] for runs in _manifest(spark, path).values() for f in runs}
    for name, changed in files.aged(spark, path):
        if name.startswith("v=") and name not in live and changed <= cut:
            files.remove(spark, f"{path}/{name}")
            gone += 1
    for name, changed in sorted(files.aged(spark, f"{path}/_versions"))[:-1]:
        if changed <= cut:
            files.remove(spark, f"{path}/_versions/{name}")
            gone += 1
    return gone


def incremental_silver(
    spark: SparkSession, root: str, silver_path: str, source_id: str = "league_api", tbl: str = "players",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Keep ``silver_path`` up to date with new bronze rows of players, leagues or rosters."""
    configure(spark)
    log = f"{root.rstrip('/')}/{commits.LOG_DIR}"
    entries = spark.readStream.format("text").option("wholetext", True).load(log)

    def step(batch: DataFrame, batch_id: int) -> None:
        found = [json.loads(r["value"]) for r in batch.collect()]  # a line for each commit
        now = commits.snapshot(spark, root)
        counts = lambda e: e.get("key") is None or now.keys.get(e["key"], [e["writer"]])[0] == e["writer"]
        adds = [a for e in found if e.get("kind") == "append" and counts(e) for a in e["adds"]]
        ours = [a for a in adds if (a["source_id"], a["tbl"]) == (source_id, tbl)]
        if not ours:
            return
        rows = bronze.parsed_commits(spark, root, ours, source_id, tbl)
        if rows is None:  # compacted and vacuumed by now: their rows are among those of the table
            rows = bronze.parsed_at(spark, root, source_id, tbl)
        with shuffles_dropped(spark):
            merge(spark, silver_path, rows, tbl)

    return (
        entries.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint or f"{silver_path.rstrip('/')}/_stream")
        .trigger(availableNow=True)
        .start()
    )
