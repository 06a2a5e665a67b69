-- Gold: players on no roster of :league_id (all players when :league_id is NULL or '').
-- The exploded roster ids are the small side of a left anti join; with AQE on, the
-- planner switches to a broadcast once the real size of that side is known.
SELECT
  p.player_id AS id,
  p.player_id,
  p.name,
  p.position,
  p.team,
  p.status,
  p.age,
  p.trending
FROM silver_players p
LEFT ANTI JOIN (
  SELECT explode(players) AS player_id
  FROM silver_rosters
  WHERE league_id = :league_id AND coalesce(:league_id, '') <> ''
) r
ON p.player_id = r.player_id
