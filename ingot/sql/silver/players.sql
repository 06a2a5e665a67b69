-- Silver: conformed players, latest record per player_id wins.
-- falsy(x, t) is the session function registered by ingot.plans.sqlfiles
-- (Python truthiness of a JSON value x whose str() is t); t_* come from the bronze view.
WITH conformed AS (
  SELECT
    CASE WHEN NOT falsy(player_id, t_player_id) THEN t_player_id ELSE t_id END AS player_id,
    CASE WHEN NOT falsy(display_name, t_display_name) THEN t_display_name
         WHEN NOT falsy(name, t_name) THEN t_name ELSE '' END AS name,
    CASE WHEN NOT falsy(position, t_position) THEN t_position ELSE '' END AS position,
    CASE WHEN NOT falsy(team, t_team) THEN t_team ELSE '' END AS team,
    CASE WHEN NOT falsy(status, t_status) THEN t_status ELSE '' END AS status,
    CASE WHEN NOT falsy(injury_status, t_injury_status) THEN t_injury_status ELSE '' END AS injury_status,
    try_variant_get(age, '$', 'bigint') AS age,
    CASE WHEN NOT t_trending RLIKE '(?i)[0-9.][df]\\s*$' THEN try_variant_get(trending, '$', 'double') END AS trending,
    CASE WHEN NOT falsy(updated_at, t_updated_at) THEN t_updated_at ELSE t_injury_updated END AS updated_at,
    _seq
  FROM bronze_players
),
latest AS (
  SELECT
    player_id,
    max_by(struct(name, position, team, status, injury_status, age, trending, updated_at, _seq), _seq) AS w,
    min(_seq) AS _first_seq
  FROM conformed
  WHERE player_id IS NOT NULL
  GROUP BY player_id
)
SELECT
  player_id, w.name, w.position, w.team, w.status, w.injury_status, w.age, w.trending, w.updated_at,
  w._seq AS _seq, _first_seq
FROM latest
