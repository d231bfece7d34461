"""Queries over documents and label lists (A, B, C14 to C16, C20, D17, H08, H09): each renders the driver's tables as the format and reads it back by the engine's rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import columns as C
from ..sources import documents as S
from . import bindings as B


def hits(spark, sf):
    return B.hits(spark, sf)


@register(
    "a02_feature_rows",
    "SELECT run_id, frame, isnan(fx) AS no_x, CASE WHEN isnan(fx) THEN 0 ELSE round(fx, 6) END AS x, w, h FROM (SELECT run_id, frame, CASE WHEN detected THEN x ELSE 'nan'::DOUBLE END AS fx, CASE WHEN detected THEN width ELSE 0 END AS w, CASE WHEN detected THEN height ELSE 0 END AS h FROM track)",
)
def a02_features(spark, sf):
    r = S.feature_rows(B.track(spark, sf))
    return r.select("run_id", "frame", F.isnan("x").alias("no_x"), F.when(F.isnan("x"), 0.0).otherwise(F.round("x", 6)).alias("x"), F.col("width").alias("w"), F.col("height").alias("h"))


@register(
    "a03_position_lookup",
    """SELECT h.run_id, h.frame, CASE WHEN t.detected THEN round(t.x, 6) END AS x, CASE WHEN t.detected THEN 'ok' WHEN t.run_id IS NOT NULL THEN 'undetected' ELSE 'absent' END AS status FROM (SELECT run_id, frame FROM hits) h LEFT JOIN track t ON t.run_id = h.run_id AND t.frame = h.frame""",
)
def a03(spark, sf):
    return S.lookup_positions(B.track(spark, sf), hits(spark, sf).select("run_id", "frame")).select("run_id", "frame", F.round("x", 6).alias("x"), "status")


def label_files(spark, sf):
    """A label file per run, in five kinds: three headers, none, and one without frames."""
    w = Window.partitionBy("run_id").orderBy("event_id")
    kind = F.when(F.col("k") % 5 == 0, "").when(F.col("event_type") == "side_wall", " SideWall").when(F.col("k") % 11 == 0, "bogus").otherwise(F.upper("event_type"))
    frame = F.when(F.col("k") % 13 == 0, "x1").otherwise(F.floor(F.col("frame") / 2).cast("string"))
    which = F.col("run_id") % 5
    body = F.when(which == 1, F.concat_ws(",", kind, frame)).when(which == 2, frame).otherwise(F.concat_ws(",", frame, kind))
    rows = hits(spark, sf).withColumn("n", F.row_number().over(w))
    lines = rows.select(F.col("run_id").alias("name"), F.when(which == 3, F.col("n") - 1).otherwise(F.col("n")).alias("line_no"), body.alias("value"))
    heads = rows.select("run_id").distinct().filter(which != 3).select(F.col("run_id").alias("name"), F.lit(0).alias("line_no"), F.when(which == 0, "hit_frame,event_type").when(which == 1, "type, frame").when(which == 2, "Source_Frame").otherwise("when,what").alias("value"))
    return lines.unionByName(heads)


@register(
    "a05_label_files",
    """WITH l AS (SELECT run_id AS name, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n, k % 13 <> 0 AS whole, frame // 2 AS frame,
        CASE WHEN run_id % 5 = 2 OR k % 5 = 0 THEN 'wall' WHEN event_type = 'side_wall' THEN 'side_wall' WHEN k % 11 = 0 THEN 'bogus' ELSE event_type END AS type FROM hits WHERE run_id % 5 <> 4)
      SELECT name, frame, arg_max(type, n) AS type FROM l WHERE whole AND type IN ('wall', 'side_wall', 'floor', 'racket') GROUP BY name, frame""",
)
def a05(spark, sf):
    """Files without a header have a number in front of their first line's kind, so a letter alone does not make a header: they begin with a row of digits."""
    lines = label_files(spark, sf)
    digits = lines.filter("name % 5 = 3").select("name").distinct().select("name", F.lit(-1).alias("line_no"), F.lit("-1").alias("value"))
    shifted = lines.unionByName(digits).withColumn("line_no", F.when(F.col("name") % 5 == 3, F.col("line_no") + 1).otherwise(F.col("line_no")))
    return S.label_lines(shifted).filter("frame >= 0")


def sidecars(spark, sf):
    k = F.col("s_suppkey")
    version = F.when(k % 4 == 0, "label-run-v0").otherwise("label-run-v1")
    body = F.to_json(F.struct(version.alias("schema_version"), F.sha2(k.cast("string"), 256).alias("video_sha"), (k + 0.5).alias("fps")))
    return B.read(spark, sf, "supplier").select(F.concat(F.lit("labels/run"), k, F.when(k % 7 == 0, ".json").otherwise(".meta.json")).alias("path"), F.when(k % 9 == 0, "{broken").otherwise(body).alias("body"))


@register("a06_label_sidecars", "SELECT 'run' || k AS stem, sha256(CAST(k AS VARCHAR)) AS video_sha, k + 0.5::DOUBLE AS fps FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 4 <> 0 AND k % 7 <> 0 AND k % 9 <> 0")
def a06(spark, sf):
    return S.label_sidecars(sidecars(spark, sf)).select("stem", "video_sha", "fps")


def run_documents(spark, sf):
    """job.json, detected_hits.json and ground_truth.json per run, some unreadable, some absent."""
    h = hits(spark, sf)
    lists = h.groupBy("run_id").agg(F.collect_list(F.struct(F.when(F.col("k") % 5 > 0, F.col("frame")).alias("frame"), "event_type")).alias("hits"))
    path = lambda name: F.concat(F.lit("runs/"), "run_id", F.lit(f"/{name}.json"))
    job = lists.filter("run_id % 10 <> 7").select(path("job").alias("path"), F.to_json(F.struct(F.concat(F.lit("/v/"), F.when(F.col("run_id") % 3 > 0, F.sha2(F.col("run_id").cast("string"), 256)).otherwise("clip"), F.lit(".mp4")).alias("video_path"), F.lit(59.94).alias("fps"), F.lit(4).alias("frame_stride"))).alias("body"))
    found = lists.filter("run_id % 4 <> 1").select(path("detected_hits").alias("path"), F.when(F.col("run_id") % 4 == 3, "{").otherwise(F.to_json(F.struct("hits"))).alias("body"))
    truth = lists.filter("run_id % 2 = 0").select(path("ground_truth").alias("path"), F.when(F.col("run_id") % 6 == 0, "{}").otherwise(F.to_json(F.struct(F.col("hits").alias("events")))).alias("body"))
    return job.unionByName(found).unionByName(truth)


@register(
    "a07_run_index",
    """SELECT run_id AS run, CASE WHEN run_id % 3 > 0 THEN sha256(CAST(run_id AS VARCHAR)) END AS video_sha, 59.94::DOUBLE AS fps, CASE WHEN run_id % 4 IN (0, 2) THEN count(*) FILTER (WHERE k % 5 > 0) END AS n_hits,
      CASE WHEN run_id % 6 = 0 THEN 0 WHEN run_id % 2 = 0 THEN count(*) END AS n_truth FROM hits WHERE run_id % 10 <> 7 GROUP BY run_id""",
)
def a07(spark, sf):
    return S.run_index(run_documents(spark, sf)).select(F.col("run_id").cast("long").alias("run"), "video_sha", "fps", F.col("n_hits").cast("long").alias("n_hits"), F.col("n_truth").cast("long").alias("n_truth"))


def calibration_files(spark, sf):
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("cam"), k % 5).alias("camera_id"))))
    return B.read(spark, sf, "orders").select(F.concat(F.lit("runs/"), F.format_string("%012d", k), F.lit("/calibration.json")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("modified"), body.alias("body"))


@register("a08_latest_calibration", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, o_orderkey % 3 <> 0 AS ok FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def a08(spark, sf):
    return S.latest_calibration(calibration_files(spark, sf)).select("run_id", "ok")


@register("a08_latest_of_camera", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id, true AS ok FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def a08_camera(spark, sf):
    return S.latest_calibration(calibration_files(spark, sf), "cam2").select("run_id", "ok")


@register(
    "a10_audio_candidates",
    """WITH c AS (SELECT run_id, event_id, frame, CASE WHEN k % 2 = 0 THEN frame - 3 ELSE frame END AS low, CASE WHEN k % 2 = 0 THEN frame + 4 ELSE frame END AS high, round(y, 6) AS score FROM hits WHERE k % 7 > 0)
      SELECT run_id, least(40, greatest(5, frame)) AS frame, greatest(5, low) AS window_start, least(40, high) AS window_end, score FROM c WHERE high >= 5 AND low <= 40""",
)
def a10(spark, sf):
    h, even = hits(spark, sf), F.col("k") % 2 == 0
    item = F.struct(F.when(F.col("k") % 7 > 0, F.col("frame")).alias("frame"), F.when(even, F.col("frame") - 3).alias("window_start_frame"), F.when(even, F.col("frame") + 4).alias("window_end_frame"), F.round("y", 6).alias("score"))
    lists = h.groupBy("run_id").agg(F.collect_list(item).alias("candidates"))
    body = F.when(F.col("run_id") % 2 == 0, F.to_json("candidates")).otherwise(F.to_json(F.struct("candidates")))
    got = S.audio_candidates(lists.select("run_id", body.alias("body"), F.lit(5).cast("long").alias("start"), F.lit(40).cast("long").alias("end")))
    return got.select("run_id", "frame", "window_start", "window_end", "score")


@register(
    "a11_coco_export",
    """SELECT 'clip' || run_id AS clip, frame // 4 AS frame, count(*) FILTER (WHERE detected AND (k2 = 0 OR height > 3)) AS n_balls,
      round(coalesce(sum(CASE WHEN k2 = 0 THEN width * height ELSE (width + 1) * (height - 3) END) FILTER (WHERE detected AND (k2 = 0 OR height > 3)), 0), 6) AS area FROM (SELECT *, frame % 2 AS k2 FROM track) GROUP BY run_id, frame // 4""",
)
def a11(spark, sf):
    """An export per run: an image per four frames; boxes of even frames, polygons of odd ones, some of them flat."""
    image = F.floor(F.col("frame") / 4).cast("long")
    t = B.track(spark, sf).withColumn("image", image)
    w, h = F.col("width") + 1, F.greatest(F.col("height") - 3, F.lit(0.0))
    zero = F.lit(0.0)
    ring = F.array(F.array(zero, zero, w, zero, w, h, zero, h))
    even = F.col("frame") % 2 == 0
    ann = F.struct(F.col("image").alias("image_id"), F.when(even, F.array(zero, zero, "width", "height")).alias("bbox"), F.when(~even, ring).alias("segmentation"))
    img = t.select("run_id", "image").distinct().groupBy("run_id").agg(F.collect_list(F.struct(F.col("image").alias("id"), F.format_string("clip%d_frame_%d.rf.ab.jpg", "run_id", "image").alias("file_name"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))).alias("images"))
    ann = t.groupBy("run_id").agg(F.collect_list(F.when(F.col("detected"), ann)).alias("annotations"))
    docs = img.join(ann, "run_id").select(F.col("run_id").cast("string").alias("path"), F.to_json(F.struct("images", "annotations")).alias("body"))
    return S.coco_export(docs).select("clip", "frame", "n_balls", F.round("area", 6).alias("area"))


@register("a12_tagged_union", "SELECT 'a' AS source_video, run_id, frame, round(y, 6) AS y, NULL::DOUBLE AS confidence FROM hits UNION ALL SELECT 'b', run_id, frame, round(y, 6), confidence FROM track WHERE detected")
def a12(spark, sf):
    tables = {"a": hits(spark, sf).select("run_id", "frame", F.round("y", 6).alias("y")), "b": B.track(spark, sf).filter("detected").select("run_id", "frame", F.round("y", 6).alias("y"), "confidence")}
    out = None
    for name, t in tables.items():
        t = t.withColumn("source_video", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


@register("a13_frame_map", "SELECT run_id AS name, frame, max(event_id) AS target FROM hits GROUP BY run_id, frame")
def a13(spark, sf):
    h = hits(spark, sf).groupBy(F.col("run_id").alias("name")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.col("event_id").cast("string"))))).alias("body"))
    return S.frame_map(h)


@register("a18_stereo_times", "SELECT run_id, frame, round(CASE WHEN frame % 3 = 0 THEN frame / 50.0::DOUBLE ELSE t END + run_id / 8.0::DOUBLE, 6) AS t FROM track")
def a18(spark, sf):
    t = B.track(spark, sf).select("run_id", "frame", F.when(F.col("frame") % 3 == 0, "").otherwise(F.col("t").cast("string")).alias("t"), F.lit(50.0).alias("fps"))
    return S.stereo_track(t, F.col("run_id") / 8.0).select("run_id", "frame", F.round("t", 6).alias("t"))


def machine_types(spark, sf):
    k = F.col("p_partkey")
    region = lambda n: F.struct(n.alias("name"))
    regions = F.when(k % 4 == 0, F.array().cast("array<struct<name:string>>")).when(k % 4 == 1, F.array(region(F.lit("eu-west")))).otherwise(F.array(region(F.concat(F.lit("us-"), k % 3)), region(F.lit("eu-west"))))
    entry = F.struct(F.struct(F.round(F.col("p_retailprice")).cast("long").alias("price_cents_per_hour")).alias("instance_type"), regions.alias("regions_with_capacity_available"))
    data = B.read(spark, sf, "part").groupBy((k % 8).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("type"), k), entry))).alias("data"))
    return S.capacity(data.select(F.to_json(F.struct("data")).alias("body")))


@register("a20_capacity", "SELECT 'type' || p_partkey AS name, CAST(round(p_retailprice) AS BIGINT) AS price_cents, CASE WHEN p_partkey % 4 IN (2, 3) THEN 'us-' || (p_partkey % 3) ELSE '' END AS regions FROM part")
def a20(spark, sf):
    return machine_types(spark, sf).select("name", "price_cents", F.array_join("regions", ",").alias("regions"))


@register(
    "h08_preferred_type",
    "SELECT 'type' || p_partkey AS name, 'us-' || (p_partkey % 3) AS region FROM part WHERE p_partkey IN (8, 5, 11, 14, 6) AND p_partkey % 4 IN (2, 3) AND round(p_retailprice) <= 100000 ORDER BY list_position([8, 5, 11, 14, 6], p_partkey) LIMIT 1",
)
def h08(spark, sf):
    return S.pick_type(machine_types(spark, sf), ["type8", "type5", "type11", "type14", "type6"], 100_000)


@register(
    "a17_manifests",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'schema' WHEN p_partkey % 7 = 0 THEN 'sha256' WHEN p_size > 40 THEN 'confidence' WHEN p_size % 6 = 0 THEN 'stride' END AS error FROM part",
)
def a17(spark, sf):
    k = F.col("p_partkey")
    content = F.concat(F.lit("model"), k.cast("string")).cast("binary")
    made = B.read(spark, sf, "part").select("p_partkey", F.when(k % 5 == 0, None).otherwise(F.concat(F.lit("ball-model-v"), k % 2 + 1)).alias("schema"), F.when(k % 7 == 0, "0").otherwise(F.sha2(content, 256)).alias("sha256"), content.alias("content"), (F.col("p_size") / 40).alias("confidence"), (F.col("p_size") % 6).alias("stride"))
    return S.valid_manifest(made).select("p_partkey", "error")


@register("a22_raw_rows", "SELECT run_id, frame, CASE WHEN detected THEN 'True' ELSE 'False' END || ',' || CAST(CAST(width AS INT) AS VARCHAR) AS line FROM track QUALIFY row_number() OVER (PARTITION BY run_id, frame ORDER BY frame) = 1")
def a22(spark, sf):
    from ..sources.files import last_per_frame

    t = B.track(spark, sf).select("run_id", "frame", F.col("frame").alias("seq"), F.concat_ws(",", F.when(F.col("detected"), "True").otherwise("False"), F.col("width").cast("int").cast("string")).alias("line"))
    return last_per_frame(t).select("run_id", "frame", "line")


@register(
    "c14_corrections",
    """WITH c AS (SELECT event_id, CASE WHEN k % 17 = 0 THEN 'none' WHEN k % 19 = 0 THEN 'smash' ELSE event_type END AS type, CASE WHEN event_type = 'wall' AND k % 17 > 0 AND k % 19 > 0 AND k % 11 > 0 THEN coalesce(call, 'in') WHEN k % 23 = 0 THEN 'IN' END AS call,
        CASE WHEN k % 17 = 0 THEN NULL ELSE x END AS x, CASE WHEN k % 29 = 0 THEN NULL ELSE k % 3 = 0 END AS fb, CASE WHEN k % 3 <> 0 OR k % 9 = 0 THEN frame END AS frame, CASE WHEN k % 4 > 0 THEN event_type END AS pt, CASE WHEN k % 6 = 0 THEN 'UNKNOWN' WHEN k % 6 < 4 THEN 'IN' END AS pc FROM hits),
      e AS (SELECT *, CASE WHEN type NOT IN ('wall', 'side_wall', 'floor', 'racket', 'none') THEN 'type' WHEN type = 'wall' AND coalesce(upper(call), '') NOT IN ('IN', 'OUT') THEN 'call' WHEN type <> 'wall' AND call IS NOT NULL THEN 'call' WHEN type <> 'none' AND x IS NULL THEN 'ball'
        WHEN type <> 'none' AND fb IS NULL THEN 'frame_is_bounce' WHEN type <> 'none' AND fb AND frame IS NOT NULL THEN 'frame' WHEN type <> 'none' AND NOT fb AND frame IS NULL THEN 'frame' END AS error FROM c)
      SELECT event_id, error, CASE WHEN error IS NULL THEN pt = type END AS agrees_type, CASE WHEN error IS NULL AND type = 'wall' AND pc IN ('IN', 'OUT') THEN pc = upper(call) END AS agrees_call, CASE WHEN error IS NULL AND type <> 'none' THEN fb END AS agrees_frame FROM e""",
)
def c14(spark, sf):
    k, kind = F.col("k"), F.col("event_type")
    none, odd = k % 17 == 0, k % 19 == 0
    made = hits(spark, sf).select(
        "event_id", F.when(none, "none").when(odd, "smash").otherwise(kind).alias("type"), F.when((kind == "wall") & ~none & ~odd & (k % 11 > 0), F.coalesce("call", F.lit("in"))).when(k % 23 == 0, "IN").alias("call"),
        F.when(~none, F.col("x")).alias("x"), F.when(~none, F.col("y")).alias("y"), F.when(k % 29 > 0, k % 3 == 0).alias("frame_is_bounce"), F.when((k % 3 != 0) | (k % 9 == 0), F.col("frame")).alias("frame"),
        F.when(k % 4 > 0, kind).alias("predicted_type"), F.when(k % 6 == 0, "UNKNOWN").when(k % 6 < 4, "IN").alias("predicted_call"),
    )
    return S.checked_corrections(made).select("event_id", "error", "agrees_type", "agrees_call", "agrees_frame")


@register("c15_kept_fields", """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS body FROM events""")
def c15(spark, sf):
    return B.read(spark, sf, "events").select("event_id", S.kept_fields(F.col("props"), ("k", "absent")).alias("body"))


@register("c16_floor_or_warning", "SELECT s_suppkey AS run_id, s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 2 = 0) AS warned, s_suppkey % 3 <> 2 AND NOT (s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 2 = 0)) AS kept FROM supplier")
def c16(spark, sf):
    """Runs with three points, with four on one line or not, and without a floor."""
    k = F.col("s_suppkey")
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    four = F.array(p(0, F.lit(0)), p(1, F.lit(1)), p(2, F.lit(2)), p(3, F.when(k % 2 == 0, 3).otherwise(5)))
    floor = F.when(k % 3 == 0, F.slice(four, 1, 3)).when(k % 3 == 1, four)
    rows = S.floor_or_warning(B.read(spark, sf, "supplier").select(k.alias("run_id"), floor.alias("floor")))
    return rows.select("run_id", F.col("warning").isNotNull().alias("warned"), F.col("floor").isNotNull().alias("kept"))


@register("c20_provenance", "SELECT s_suppkey AS run_id, 'ball-model-v2' AS model_id, 'cpu' AS device FROM supplier")
def c20(spark, sf):
    rows = S.with_provenance(B.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id")), model_id="ball-model-v2", device="cpu")
    return rows.select("run_id", "provenance.*")


@register("b02_hit_lines", "SELECT run_id, frame, printf('%d,%.6f,%.3f,%s', frame, round_even(t, 6), round_even(y, 3), coalesce(event_type, '')) AS line FROM hits")
def b02(spark, sf):
    t, y = C.round_even(F.col("t"), 6), C.round_even(F.col("y"), 3)
    line = F.format_string("%d,%.6f,%.3f,%s", "frame", t, y, F.coalesce("event_type", F.lit("")))
    return hits(spark, sf).select("run_id", "frame", F.when(t.isNotNull() & y.isNotNull(), line).alias("line"))


@register(
    "b03_payload",
    """WITH h AS (SELECT run_id, count(*) AS hit_count, count(*) FILTER (WHERE call = 'OUT') AS outs, max(frame) AS last_frame FROM hits GROUP BY run_id), r AS (SELECT run_id, count(*) AS n, sum(n_hits) AS m FROM rallies GROUP BY run_id)
      SELECT h.run_id, hit_count, outs, last_frame, coalesce(n, 0) AS rallies, CAST(coalesce(m, 0) AS BIGINT) AS rally_hits FROM h LEFT JOIN r ON r.run_id = h.run_id""",
)
def b03(spark, sf):
    """The payload written as JSON and read back."""
    from .session_queries import per_rally

    body = S.payload(hits(spark, sf).select("run_id", "frame", "event_type", "call"), per_rally(spark, sf).select("run_id", "rally_number", "n_hits"))
    got = body.select("run_id", F.from_json("body", "hits array<struct<frame:bigint,call:string>>, rallies array<struct<rally_number:bigint,n_hits:bigint>>, hit_count bigint").alias("p"))
    return got.select(
        "run_id", "p.hit_count", F.size(F.filter("p.hits", lambda h: h["call"] == "OUT")).cast("long").alias("outs"), F.array_max(F.transform("p.hits", lambda h: h["frame"])).alias("last_frame"),
        F.size("p.rallies").cast("long").alias("rallies"), F.aggregate("p.rallies", F.lit(0).cast("long"), lambda a, r: a + r["n_hits"]).alias("rally_hits"),
    )


@register("b04_merged_jobs", "SELECT s_suppkey AS run_id, CASE WHEN s_suppkey % 3 = 0 THEN 'done' WHEN s_suppkey % 3 = 1 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'judge' ELSE 'new' END AS stage FROM supplier")
def b04(spark, sf):
    """Jobs queued; some began and some ended since; what runs at a restart has failed."""
    s = B.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"))
    none = F.lit(None).cast("string")
    ups = [s.filter("run_id % 3 < 2").select("run_id", F.lit(1).alias("seq"), F.lit("running").alias("status"), none.alias("stage")), s.filter("run_id % 2 = 0").select("run_id", F.lit(2).alias("seq"), none.alias("status"), F.lit("judge").alias("stage")), s.filter("run_id % 3 = 0").select("run_id", F.lit(3).alias("seq"), F.lit("done").alias("status"), none.alias("stage"))]
    return S.merged_jobs(s.select("run_id", F.lit("queued").alias("status"), F.lit("new").alias("stage")), ups[0].unionByName(ups[1]).unionByName(ups[2]), restarted=True)


@register("b06_case_lines", """SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY run, frame) AS line_no, '{"frame":' || frame || ',"kind":"' || kind || '","run_id":' || run_id || '}' AS line FROM (SELECT coalesce(event_type, 'none') AS kind, CAST(run_id AS VARCHAR) AS run, run_id, frame FROM hits)""")
def b06(spark, sf):
    return S.sorted_lines(hits(spark, sf).select(F.coalesce("event_type", F.lit("none")).alias("kind"), "run_id", "frame")).withColumn("line_no", F.col("line_no").cast("long"))


@register("b08_replaced_truth", "SELECT run_id, frame, event_type AS type FROM hits WHERE run_id % 3 > 0 AND event_type IS NOT NULL UNION ALL SELECT run_id, frame * 2, event_type FROM hits WHERE run_id % 3 = 0 AND event_type IN ('wall', 'side_wall', 'floor', 'racket')")
def b08(spark, sf):
    h = hits(spark, sf).filter("event_type IS NOT NULL")
    new = h.filter("run_id % 3 = 0").select("run_id", (F.col("frame") * 2).alias("frame"), F.upper("event_type").alias("type"))
    return S.replaced_truth(h.select("run_id", "frame", F.col("event_type").alias("type")), new)


@register("b09_label_sidecar", "SELECT run_id AS name, count(*) AS n_labels, min(frame) AS min_frame, max(frame) AS max_frame, count(*) FILTER (WHERE event_type = 'wall') AS walls FROM hits WHERE event_type IS NOT NULL GROUP BY run_id")
def b09(spark, sf):
    labels = hits(spark, sf).filter("event_type IS NOT NULL").select(F.col("run_id").alias("name"), "frame", F.col("event_type").alias("type"))
    return S.label_sidecar(labels).select("name", "n_labels", "min_frame", "max_frame", F.coalesce(F.try_element_at("by_type", F.lit("wall")), F.lit(0)).alias("walls"))


@register("b09_toggled_labels", "SELECT run_id AS name, frame, CASE WHEN k % 3 = 1 THEN 'floor' ELSE event_type END AS type FROM hits WHERE event_type IS NOT NULL AND NOT (k % 3 = 0 OR (k % 3 = 1 AND event_type = 'floor'))")
def b09_toggle(spark, sf):
    h = hits(spark, sf).filter("event_type IS NOT NULL").withColumnRenamed("run_id", "name")
    marks = h.filter("k % 3 < 2").select("name", "frame", F.when(F.col("k") % 3 == 0, F.col("event_type")).otherwise("floor").alias("type"))
    return S.toggled(h.select("name", "frame", F.col("event_type").alias("type")), marks)


@register("b14_colliding_names", "SELECT md5(slug) AS name, count(DISTINCT url) AS sources FROM (SELECT url, regexp_replace(url, '[^a-z]+', '', 'g') AS slug FROM pages) GROUP BY slug HAVING count(DISTINCT url) > 1")
def b14(spark, sf):
    pages = B.read(spark, sf, "pages").withColumnRenamed("url", "source")
    return S.colliding_names(pages, F.md5(F.regexp_replace("source", "[^a-z]+", ""))).select("name", "sources")


@register("b17_reports", "SELECT run_id, '| metric | value |' || chr(10) || '|---|---|' || chr(10) || printf('| hits | %.3f |', n) || chr(10) || printf('| best | %.3f |', m) AS report FROM (SELECT run_id, count(*)::DOUBLE AS n, max(k)::DOUBLE AS m FROM hits GROUP BY run_id)")
def b17(spark, sf):
    h = hits(spark, sf).groupBy("run_id").agg(F.count("*").cast("double").alias("n"), F.max("k").cast("double").alias("m"))
    rows = h.select("run_id", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.lit("hits").alias("name"), F.coalesce("n", F.lit(0.0)).alias("value")), F.struct(F.lit(1).alias("place"), F.lit("best").alias("name"), F.coalesce("m", F.lit(0.0)).alias("value")))))
    return S.report(rows)
