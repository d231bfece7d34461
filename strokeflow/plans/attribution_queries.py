"""Queries over attribution with observed serves and the service-line rule (G10 to G12). The oracles walk a run rally by rally."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import attribution as A
from .session_queries import per_rally, rally_hits


def tracked(spark, sf):
    track = F.when(F.col("start_frame") % 3 == 0, F.when(F.col("start_frame") % 2 == 0, "A").otherwise("B"))
    return A.observed_chain(per_rally(spark, sf).withColumn("track", track))


WALK = """WITH RECURSIVE r AS (SELECT *, CASE WHEN start_frame % 3 = 0 THEN CASE WHEN start_frame % 2 = 0 THEN 'A' ELSE 'B' END END AS track FROM rallies),
  s AS (SELECT run_id, 0::BIGINT AS k, 1 AS nxt, NULL::VARCHAR AS a_is, NULL::INT AS server, NULL::VARCHAR AS src, NULL::INT AS winner, NULL::VARCHAR AS why, NULL::INT AS last_player FROM (SELECT DISTINCT run_id FROM r)
    UNION ALL SELECT run_id, k, coalesce(winner, nxt), a_is, server, src, winner, why, last_player FROM (
      SELECT *, CASE WHEN serve_call = 'OUT' THEN 3 - server WHEN last_call = 'OUT' THEN 3 - last_player WHEN last_call = 'IN' THEN last_player END AS winner,
        CASE WHEN serve_call = 'OUT' THEN 'serve_out' WHEN last_call = 'OUT' THEN 'last_front_wall_hit_out' WHEN last_call = 'IN' THEN 'last_front_wall_hit_in_winner' ELSE 'last_front_wall_hit_unjudged' END AS why FROM (
      SELECT *, CASE WHEN n_hits % 2 = 1 THEN server ELSE 3 - server END AS last_player FROM (
      SELECT b.*, CASE WHEN track IS NULL THEN nxt WHEN track = 'A' THEN CAST(b.a_is AS INT) ELSE 3 - CAST(b.a_is AS INT) END AS server, CASE WHEN track IS NULL THEN 'propagated' ELSE 'observed' END AS src FROM (
      SELECT r.run_id, r.rally_number AS k, s.nxt, r.track, r.n_hits, r.serve_call, r.last_call, CASE WHEN s.a_is IS NOT NULL THEN s.a_is WHEN r.track = 'A' THEN CAST(s.nxt AS VARCHAR) WHEN r.track = 'B' THEN CAST(3 - s.nxt AS VARCHAR) END AS a_is
      FROM s JOIN r ON r.run_id = s.run_id AND r.rally_number = s.k + 1) b)))),
  c AS (SELECT run_id, k AS rally_number, server, src AS server_source, winner, why AS winner_reason, last_player FROM s WHERE k > 0)"""


@register("g10_observed_chain", f"{WALK} SELECT * FROM c")
def g10_observed(spark, sf):
    return tracked(spark, sf).select("run_id", "rally_number", "server", "server_source", "winner", "winner_reason", "last_player")


@register(
    "g11_backfilled",
    f"""{WALK}, n AS (SELECT *, lead(CASE WHEN server_source = 'observed' THEN server END) OVER (PARTITION BY run_id ORDER BY rally_number) AS nx FROM c)
      SELECT run_id, rally_number, CASE WHEN nx <> winner AND server_source = 'propagated' THEN 3 - server ELSE server END AS server, coalesce(nx, winner) AS winner, CASE WHEN nx IS NOT NULL THEN 'next_serve' WHEN winner IS NOT NULL THEN 'est' END AS winner_source,
      nx = winner AS agrees, CASE WHEN nx <> winner THEN CASE WHEN server_source = 'propagated' THEN 'repaired' ELSE 'conflict' END WHEN server_source = 'observed' THEN 'observed' ELSE 'assumed' END AS state,
      CASE WHEN nx <> winner AND server_source = 'propagated' THEN 3 - last_player ELSE last_player END AS last_player FROM n""",
)
def g11_backfilled(spark, sf):
    return A.backfilled(tracked(spark, sf)).select("run_id", "rally_number", "server", "winner", "winner_source", "agrees", "state", "last_player")


@register(
    "g12_serve_rule",
    """WITH RECURSIVE h AS (SELECT run_id, frame, rally_number, call, CASE WHEN k % 3 = 0 THEN 'OUT' ELSE 'IN' END AS sc, row_number() OVER (PARTITION BY run_id ORDER BY frame) AS i FROM rally_hits),
      s AS (SELECT run_id, i, frame, rally_number, 1::BIGINT AS n, true AS serve, sc AS call, sc = 'OUT' AS open_ FROM h WHERE i = 1
        UNION ALL SELECT run_id, i, frame, rally_number, n + CASE WHEN serve THEN 1 ELSE 0 END, serve, CASE WHEN serve THEN sc ELSE call END, serve AND sc = 'OUT' FROM (
          SELECT h.*, s.n, h.rally_number <> s.rally_number OR s.open_ AS serve FROM s JOIN h ON h.run_id = s.run_id AND h.i = s.i + 1))
      SELECT run_id, frame, serve AS is_serve, call, n AS rally_number_split FROM s""",
)
def g12(spark, sf):
    h = rally_hits(spark, sf).withColumn("serve_call", F.when(F.col("k") % 3 == 0, "OUT").otherwise("IN"))
    return A.serve_rule(h).select("run_id", "frame", "is_serve", "call", "rally_number_split")
