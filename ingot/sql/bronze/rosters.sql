-- Bronze: raw roster records -> VARIANT fields.
-- Input view: bronze_rosters_raw(record_v VARIANT, _seq).
SELECT
  try_variant_get(record_v, '$.league_id', 'variant') AS league_id,
  try_variant_get(record_v, '$.roster_id', 'variant') AS roster_id,
  try_variant_get(record_v, '$.players', 'variant') AS players,
  _seq
FROM bronze_rosters_raw
