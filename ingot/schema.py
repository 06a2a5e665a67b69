"""Bronze, silver and gold schemas.

Bronze is schema-free: one JSON record per row plus the columns that pin down
arrival order. Silver has fixed shapes.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Bronze rows at rest (Parquet, a folder for each commit, source_id and tbl).
BRONZE = StructType(
    [
        StructField("_batch_id", LongType(), False),  # monotone per ingest call
        StructField("_writer", StringType(), False),  # of the append: parts two that came by one number
        StructField("_file", StringType(), False),  # landed file, '' for payload ingest
        StructField("_block", LongType(), False),  # split start inside _file
        StructField("_pos", LongType(), False),  # position inside the split / payload
        StructField("record", StringType(), True),  # one JSON record, as text
        StructField("is_malformed", BooleanType(), False),
        StructField("source_id", StringType(), False),
        StructField("tbl", StringType(), False),
    ]
)

# The arrival sequence: the order of bronze rows. Unique per row.
SEQ_FIELDS = ("_batch_id", "_writer", "_file", "_block", "_pos")

SILVER_PLAYERS = StructType(
    [
        StructField("player_id", StringType(), False),
        StructField("name", StringType(), False),
        StructField("position", StringType(), False),
        StructField("team", StringType(), False),
        StructField("status", StringType(), False),
        StructField("injury_status", StringType(), False),
        StructField("age", LongType(), True),
        StructField("trending", DoubleType(), True),
        StructField("updated_at", StringType(), True),
    ]
)
SILVER_PLAYER_KEYS = tuple(f.name for f in SILVER_PLAYERS.fields)

SILVER_LEAGUES = StructType(
    [StructField("league_id", StringType(), False), StructField("name", StringType(), False)]
)
SILVER_LEAGUE_KEYS = tuple(f.name for f in SILVER_LEAGUES.fields)

SILVER_ROSTERS = StructType(
    [
        StructField("league_id", StringType(), False),
        StructField("roster_id", StringType(), False),
        StructField("players", ArrayType(StringType(), containsNull=False), False),
    ]
)
SILVER_ROSTER_KEYS = tuple(f.name for f in SILVER_ROSTERS.fields)

SILVER_MATCHUPS = StructType(
    [
        StructField("league_id", StringType(), False),
        StructField("week", LongType(), False),
        StructField("matchup_id", StringType(), True),
        StructField("roster_id", StringType(), False),
        StructField("points", DoubleType(), True),
    ]
)
SILVER_MATCHUP_KEYS = tuple(f.name for f in SILVER_MATCHUPS.fields)

SILVER_INJURIES = StructType(
    [
        StructField("player_id", StringType(), False),
        StructField("status", StringType(), False),
        StructField("updated_at", StringType(), True),
    ]
)
SILVER_INJURY_KEYS = tuple(f.name for f in SILVER_INJURIES.fields)

RUNS = StructType(
    [
        StructField("kind", StringType(), False),
        StructField("league_id", StringType(), True),
        StructField("ts", TimestampType(), False),
        StructField("seq", LongType(), False),
    ]
)
