-- Silver: conformed rosters, latest record per (league_id, roster_id) wins.
WITH conformed AS (
  SELECT
    try_variant_get(league_id, '$', 'string') AS league_id,
    try_variant_get(roster_id, '$', 'string') AS roster_id,
    coalesce(filter(try_variant_get(players, '$', 'array<string>'), x -> x IS NOT NULL), array()) AS players,
    _seq
  FROM bronze_rosters
)
SELECT league_id, roster_id, w.players AS players, w._seq AS _seq, _first_seq
FROM (
  SELECT league_id, roster_id, max_by(struct(players, _seq), _seq) AS w, min(_seq) AS _first_seq
  FROM conformed
  WHERE league_id IS NOT NULL AND roster_id IS NOT NULL
  GROUP BY league_id, roster_id
)
