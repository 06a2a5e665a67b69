-- Bronze: raw player records -> every field the silver layer reads, as VARIANT
-- (the JSON value) and as text (its str(), t_*). Input view: bronze_players_raw(record_v VARIANT, _seq).
-- Two struct-typed extractions per record instead of one call per field; an absent field is NULL.
WITH x AS (
  SELECT
    try_variant_get(record_v, '$', 'struct<player_id: variant, id: variant, display_name: variant, name: variant, position: variant, team: variant, status: variant, injury_status: variant, age: variant, trending: variant, updated_at: variant, injury_updated: variant, number: variant>') AS f,
    try_variant_get(record_v, '$', 'struct<player_id: string, id: string, display_name: string, name: string, position: string, team: string, status: string, injury_status: string, age: string, trending: string, updated_at: string, injury_updated: string, number: string>') AS t,
    record_v AS raw,
    _seq
  FROM bronze_players_raw
)
SELECT
  f.player_id AS player_id,
  f.id AS id,
  f.display_name AS display_name,
  f.name AS name,
  f.position AS position,
  f.team AS team,
  f.status AS status,
  f.injury_status AS injury_status,
  f.age AS age,
  f.trending AS trending,
  f.updated_at AS updated_at,
  f.injury_updated AS injury_updated,
  f.number AS number,
  t.player_id AS t_player_id,
  t.id AS t_id,
  t.display_name AS t_display_name,
  t.name AS t_name,
  t.position AS t_position,
  t.team AS t_team,
  t.status AS t_status,
  t.injury_status AS t_injury_status,
  t.age AS t_age,
  t.trending AS t_trending,
  t.updated_at AS t_updated_at,
  t.injury_updated AS t_injury_updated,
  t.number AS t_number,
  raw,
  _seq
FROM x
