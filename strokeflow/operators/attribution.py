"""Who served and who won, with observed serves, and the service-line rule (G10 to G12). Windows over a run's rallies, no folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id"]


def observed_chain(per_rally: DataFrame) -> DataFrame:
    """``per_rally`` (run_id, rally_number, n_hits, serve_call, last_call, and track: the observed server's, A or B, or null) with server, server_source, winner, winner_reason and last_player.

    Player 1 serves first, the winner of a rally serves next, and an undecided
    rally changes nothing. The first observed serve binds its track to whoever
    serves then; every later one says who serves, whatever the chain holds.
    """
    odd = F.col("n_hits") % 2 == 1
    serve_out = F.coalesce(F.col("serve_call") == "OUT", F.lit(False))
    flip = serve_out | F.coalesce((F.col("last_call") == "OUT") & odd, F.lit(False)) | F.coalesce((F.col("last_call") == "IN") & ~odd, F.lit(False))
    w = Window.partitionBy(*KEY).orderBy("rally_number")
    rows = per_rally.withColumn("_flip", flip.cast("int"))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    observed, decided = F.coalesce(F.col("track").isin("A", "B"), F.lit(False)), serve_out | F.coalesce(F.col("last_call").isin("IN", "OUT"), F.lit(False))
    place = F.struct("track", "_before")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The chain begins anew after an observed rally that is decided; an undecided one leaves it as it was.
    anew = F.last(F.when(observed & decided, place), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_first": F.first(F.when(observed, place), ignorenulls=True).over(whole), "_anew": anew})
    holds = lambda track: F.col("_first._before") + (track != F.col("_first.track")).cast("int")
    chain = F.when(F.col("_anew").isNull(), F.col("_before")).otherwise(holds(F.col("_anew.track")) + F.col("_before") - F.col("_anew._before"))
    server = F.when(observed, holds(F.col("track"))).otherwise(chain) % 2
    rows = rows.withColumn("server", (server + 1).cast("int")).withColumn("server_source", F.when(observed, "observed").otherwise("propagated"))
    winner = F.when(decided, F.when(F.col("_flip") == 1, 3 - F.col("server")).otherwise(F.col("server")))
    reason = F.when(serve_out, "serve_out").when(F.col("last_call") == "OUT", "last_front_wall_hit_out").when(F.col("last_call") == "IN", "last_front_wall_hit_in_winner").otherwise("last_front_wall_hit_unjudged")
    last = F.when(odd, F.col("server")).otherwise(3 - F.col("server"))
    return rows.withColumns({"winner": winner, "winner_reason": reason, "last_player": last}).drop("_flip", "_before", "_first", "_anew")


def backfilled(chained: DataFrame) -> DataFrame:
    """:func:`observed_chain` with winners taken from the next observed serve, and what that says of the rally itself.

    Where the estimate disagrees, a propagated server is flipped with its whole
    rally (repaired), an observed one is kept and flagged (conflict). Nothing
    cascades, as the next serve is observed.
    """
    w = Window.partitionBy(*KEY).orderBy("rally_number")
    rows = chained.withColumn("_next", F.lead(F.when(F.col("server_source") == "observed", F.col("server"))).over(w))
    known = F.col("_next").isNotNull()
    agrees = F.when(known, F.col("winner") == F.col("_next"))
    wrong = F.coalesce(~agrees, F.lit(False))
    seen = F.col("server_source") == "observed"
    repair = wrong & ~seen
    state = F.when(repair, "repaired").when(wrong, "conflict").when(seen, "observed").otherwise("assumed")
    return rows.withColumns({
        "winner_source": F.when(known, "next_serve").when(F.col("winner").isNotNull(), "est"), "agrees": agrees, "state": state,
        "winner": F.coalesce("_next", "winner"), "winner_reason": F.when(known, "next_rally_serve_observed").otherwise(F.col("winner_reason")),
        "server": F.when(repair, 3 - F.col("server")).otherwise(F.col("server")), "last_player": F.when(repair, 3 - F.col("last_player")).otherwise(F.col("last_player")),
    }).drop("_next")


def serve_rule(hits: DataFrame) -> DataFrame:
    """Hits (run_id, frame, rally_number by gaps, call, serve_call: its call were it a serve) with is_serve, the call that counts and rally_number_split, where boundaries settle.

    The first hit of a rally is a serve and is judged against the service line;
    a serve that is OUT ends its rally, so that the next hit of the stretch is
    the serve of a rally of its own, and so on. Settled, the serves of a stretch
    are its leading faults and the hit after them.
    """
    w = Window.partitionBy(*KEY, "rally_number").orderBy("frame")
    fault = F.coalesce(F.col("serve_call") == "OUT", F.lit(False))
    rows = hits.withColumn("_good", F.coalesce(F.sum((~fault).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("is_serve", F.col("_good") == 0).withColumn("call", F.when(F.col("is_serve"), F.col("serve_call")).otherwise(F.col("call"))).drop("_good")
    return rows.withColumn("rally_number_split", F.sum(F.col("is_serve").cast("long")).over(Window.partitionBy(*KEY).orderBy("frame")))
