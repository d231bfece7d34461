"""JSON documents and label lists of runs: readers, parsers, validators and writers.

Parsers take DataFrames of text (path or name, body), so that the same rules
serve files of any store; ``read_*`` make those DataFrames. A document that
does not parse gives nulls or no row, as each docstring says, and never fails
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIT_TYPES = ("wall", "side_wall", "floor", "racket")
CALLS = ("IN", "OUT")


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """path, body, modified of whole text files; nothing below a folder called uploads."""
    raw = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("modified"))
    return raw.filter(~F.col("path").rlike("/uploads/"))


def write_documents(rows: DataFrame, path: str) -> None:
    """``rows`` (run_id, body) as one JSON line each, in a folder per run."""
    rows.select("run_id", F.col("body").alias("value")).write.mode("overwrite").partitionBy("run_id").text(path)


def lookup_positions(track: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (run_id, frame) with x, y and status: ok, undetected (a row without a detection) or absent (no row)."""
    rows = track.select("run_id", "frame", "detected", "x", "y")
    got = wanted.join(rows, ["run_id", "frame"], "left")
    seen = F.coalesce(F.col("detected") & F.col("x").isNotNull(), F.lit(False))
    status = F.when(seen, "ok").when(F.col("detected").isNotNull(), "undetected").otherwise("absent")
    return got.select("run_id", "frame", F.when(seen, F.col("x")).alias("x"), F.when(seen, F.col("y")).alias("y"), status.alias("status"))


def feature_rows(track: DataFrame) -> DataFrame:
    """Rows as features: undetected ones have NaN for x and y and 0 for width and height."""
    seen = F.col("detected")
    nan, zero = F.lit(float("nan")), F.lit(0.0)
    return track.withColumns({c: F.when(seen, F.coalesce(c, nan)).otherwise(nan) for c in ("x", "y")} | {c: F.when(seen, F.coalesce(c, zero)).otherwise(zero) for c in ("width", "height")})


def label_lines(lines: DataFrame) -> DataFrame:
    """Name, frame, type of label files given as lines (name, line_no from 0, value).

    A first line with a letter is a header; of hit_frame, source_frame and frame
    the first that it has names the frames, of event_type and type the kinds; a
    header without a frame column gives nothing. Without a header the first
    field is the frame, the second the kind. An absent or empty kind is wall,
    sidewall is side_wall; other kinds and lines without a number are skipped;
    of a frame's lines the last counts.
    """
    head = lines.filter("line_no = 0").select("name", F.when(F.col("value").rlike("[A-Za-z_]"), F.transform(F.split("value", ","), lambda c: F.lower(F.trim(c)))).alias("head"))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("head", n), F.lit(0)) for n in names])
    rows = lines.join(head, "name").filter("head IS NULL OR line_no > 0").withColumn("cells", F.split("value", ","))
    at_frame = F.when(F.col("head").isNull(), F.lit(1).cast("long")).otherwise(place(("hit_frame", "source_frame", "frame")))
    at_type = F.when(F.col("head").isNull(), F.lit(2).cast("long")).otherwise(place(("event_type", "type")))
    rows = rows.withColumns({"f": at_frame, "k": at_type}).filter("f IS NOT NULL")
    cell = lambda i: F.trim(F.get("cells", (F.col(i) - 1).cast("int")))
    kind = F.lower(F.coalesce(F.nullif(cell("k"), F.lit("")), F.lit("wall")))
    rows = rows.select("name", "line_no", F.expr("try_cast(trim(get(cells, cast(f - 1 AS int))) AS bigint)").alias("frame"), F.when(kind == "sidewall", "side_wall").otherwise(kind).alias("type"))
    good = rows.filter(F.col("frame").isNotNull() & F.col("type").isin(*HIT_TYPES))
    return good.groupBy("name", "frame").agg(F.max_by("type", "line_no").alias("type"))


def label_sidecars(documents: DataFrame) -> DataFrame:
    """Stem, video_sha, video_path and fps of sidecars (path, body) of the known schema; others are skipped."""
    doc = F.from_json("body", "schema_version string, video_sha string, video_path string, fps double")
    rows = documents.select(F.regexp_extract("path", r"([^/]+)\.meta\.json$", 1).alias("stem"), doc.alias("d"))
    return rows.filter("stem <> '' AND d.schema_version = 'label-run-v1'").select("stem", "d.video_sha", "d.video_path", "d.fps")


def run_index(documents: DataFrame) -> DataFrame:
    """One row per run folder with a readable or unreadable job.json (path, body): run_id, video_sha, fps, frame_stride, n_hits, n_corrections, n_truth.

    ``video_sha`` is the stem of the video's file where that is a digest. A
    missing or unreadable document has a null count, a readable one without a
    list has 0; hits without a whole frame number do not count.
    """
    run, kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = documents.select(run.alias("run_id"), kind.alias("kind"), F.try_parse_json("body").alias("v")).filter("run_id NOT IN ('', 'uploads')")
    get = lambda path, t: F.try_variant_get("v", path, t)
    of = lambda k, value: F.max(F.when((F.col("kind") == k) & F.col("v").isNotNull(), value))
    count = lambda path, t: F.coalesce(F.size(get(path, t)), F.lit(0))
    hits = F.coalesce(F.size(F.filter(get("$.hits", "array<struct<frame:bigint>>"), lambda h: h["frame"].isNotNull())), F.lit(0))
    sha = F.regexp_extract(get("$.video_path", "string"), r"(?:^|/)([0-9a-f]{64})\.[^./]*$", 1)
    found = rows.groupBy("run_id").agg(
        F.max(F.col("kind") == "job").alias("has_job"), of("job", F.nullif(sha, F.lit(""))).alias("video_sha"), of("job", get("$.fps", "double")).alias("fps"), of("job", get("$.frame_stride", "int")).alias("frame_stride"),
        of("detected_hits", hits).alias("n_hits"), of("corrections", count("$.corrections", "array<variant>")).alias("n_corrections"), of("ground_truth", count("$.events", "array<variant>")).alias("n_truth"),
    )
    return found.filter("has_job").drop("has_job")


def latest_calibration(documents: DataFrame, camera_id: str | None = None) -> DataFrame:
    """The newest calibration (path, body, modified; ties by run): run_id, body, and ok, which is false where it cannot be read.

    With a camera, unreadable ones and other cameras' are passed over.
    """
    run = F.regexp_extract("path", r"([^/]+)/calibration\.json$", 1)
    rows = documents.select(run.alias("run_id"), "modified", "body", F.try_parse_json("body").alias("v")).filter("run_id <> ''")
    if camera_id:
        rows = rows.filter(F.try_variant_get("v", "$.camera_id", "string") == camera_id)
    newest = rows.agg(F.max_by(F.struct("run_id", "body", F.col("v").isNotNull().alias("ok")), F.struct("modified", "run_id")).alias("b"))
    return newest.filter("b IS NOT NULL").select("b.*")


def audio_candidates(documents: DataFrame) -> DataFrame:
    """A10: run_id, frame, window_start, window_end, score, rms of documents (run_id, body, start, end): a list, or an object with one under candidates.

    Entries without a whole frame number are dropped, and those whose window
    misses the clip; the others are clamped to it. Absent windows are the frame.
    """
    item = "array<struct<frame:bigint,window_start_frame:bigint,window_end_frame:bigint,score:double,rms:double>>"
    v = F.try_parse_json("body")
    items = F.coalesce(F.try_variant_get(v, "$", item), F.try_variant_get(v, "$.candidates", item))
    rows = documents.select("run_id", "start", "end", F.explode(items).alias("c")).filter("c.frame IS NOT NULL")
    low, high = F.coalesce("c.window_start_frame", "c.frame"), F.coalesce("c.window_end_frame", "c.frame")
    rows = rows.filter((high >= F.col("start")) & (low <= F.col("end")))
    clamp = lambda x: F.least("end", F.greatest("start", x))
    return rows.select("run_id", clamp(F.col("c.frame")).alias("frame"), F.greatest("start", low).alias("window_start"), F.least("end", high).alias("window_end"), F.coalesce("c.score", F.lit(0.0)).alias("score"), F.coalesce("c.rms", F.lit(0.0)).alias("rms"))


def coco_export(documents: DataFrame) -> DataFrame:
    """Clip, frame, file_name, width, height, n_balls, area of the images of exports (path, body), joined to their annotations by image.

    A ball's box is that around its polygon, or else its bbox; boxes without an
    area are dropped, images without a ball stay.
    """
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<image_id:bigint,bbox:array<double>,segmentation:array<array<double>>>>"
    doc = documents.select("path", F.from_json("body", schema).alias("d")).filter("d IS NOT NULL")
    images = doc.select("path", F.explode("d.images").alias("i")).select("path", "i.*")
    ann = doc.select("path", F.explode("d.annotations").alias("a"))
    flat = F.get("a.segmentation", F.lit(0))
    pick = lambda r: F.filter(flat, lambda _, i: i % 2 == r)
    polygon = F.size(flat) >= 2
    side = lambda r, k: F.when(polygon, F.array_max(pick(r)) - F.array_min(pick(r))).otherwise(F.get("a.bbox", F.lit(k)))
    balls = ann.select("path", F.col("a.image_id").alias("id"), side(0, 2).alias("w"), side(1, 3).alias("h")).filter("w > 0 AND h > 0")
    per = balls.groupBy("path", "id").agg(F.count("*").alias("n_balls"), F.sum(F.col("w") * F.col("h")).alias("area"))
    clip, frame = F.regexp_extract("file_name", r"^(.+)_frame_?(\d+)", 1), F.expr(r"try_cast(regexp_extract(file_name, '^(.+)_frame_?(\\d+)', 2) AS bigint)")
    rows = images.join(per, ["path", "id"], "left")
    return rows.select(F.when(clip != "", clip).otherwise(F.regexp_replace("file_name", r"(\.rf\..*|\.[^.]*)$", "")).alias("clip"), frame.alias("frame"), "file_name", "width", "height", F.coalesce("n_balls", F.lit(0)).alias("n_balls"), F.coalesce("area", F.lit(0.0)).alias("area"))


def frame_map(documents: DataFrame) -> DataFrame:
    """Name, frame, target of documents (name, body) that map frame numbers, as text, to numbers; fails on any other key or value."""
    rows = documents.select("name", F.explode(F.from_json("body", "map<string,string>")).alias("k", "v"))
    whole = F.col("k").rlike(r"^-?\d+$") & F.col("v").rlike(r"^-?\d+$")
    checked = F.when(whole, F.col("k")).otherwise(F.raise_error(F.concat(F.lit("malformed frame map: "), "name")))
    return rows.select("name", checked.cast("bigint").alias("frame"), F.expr("try_cast(v AS bigint)").alias("target"))


def stereo_track(rows: DataFrame, offset: Column) -> DataFrame:
    """``rows`` (run_id, frame, t as text, fps) with t as seconds plus an offset; without a time it is frame over fps."""
    return rows.withColumn("t", F.coalesce(F.expr("try_cast(t AS double)"), F.col("frame") / F.col("fps")) + offset)


def capacity(documents: DataFrame, region_prefix: str = "us-") -> DataFrame:
    """Name, price_cents and sorted regions (of a prefix) of the machine types of a capacity document (body)."""
    schema = "data map<string,struct<instance_type:struct<price_cents_per_hour:bigint>,regions_with_capacity_available:array<struct<name:string>>>>"
    rows = documents.select(F.explode(F.from_json("body", schema)["data"]).alias("name", "e"))
    regions = F.filter(F.transform("e.regions_with_capacity_available", lambda r: r["name"]), lambda r: r.startswith(region_prefix))
    return rows.select("name", F.col("e.instance_type.price_cents_per_hour").alias("price_cents"), F.coalesce(regions, F.array().cast("array<string>")).alias("regions"))


def pick_type(types: DataFrame, preferences: list[str], cap_cents: int) -> DataFrame:
    """Of the preferred types (name, price_cents, regions) the first with a region, not over the cap: name and its first region."""
    order = F.array_position(F.array(*map(F.lit, preferences)), F.col("name"))
    ok = types.filter((order > 0) & (F.coalesce("price_cents", F.lit(1 << 30)) <= cap_cents) & (F.size("regions") > 0))
    return ok.agg(F.min_by(F.struct("name", F.get("regions", F.lit(0)).alias("region")), order).alias("b")).filter("b IS NOT NULL").select("b.*")


def valid_manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (schema, sha256, content, confidence, stride) with error: the first rule that a model's manifest breaks, or null."""
    error = (
        F.when(~F.coalesce(F.col("schema").isin("ball-model-v1", "ball-model-v2"), F.lit(False)), "schema").when(~F.col("sha256").eqNullSafe(F.sha2("content", 256)), "sha256")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence").when(~F.coalesce(F.col("stride") >= 1, F.lit(False)), "stride")
    )
    return rows.withColumn("error", error)


def checked_corrections(rows: DataFrame) -> DataFrame:
    """C14: corrections (type, call, x, y, frame_is_bounce, frame, predicted_type, predicted_call) with the first error and the flags of agreement, null where undefined.

    A call belongs to wall hits only; a none has neither place nor time; a hit
    that is not at its bounce names the frame of it.
    """
    kind, call = F.lower(F.coalesce("type", F.lit(""))), F.upper("call")
    no_ball = F.col("x").isNull() | F.col("y").isNull()
    bounce = F.col("frame_is_bounce")
    error = (
        F.when(~kind.isin(*HIT_TYPES, "none"), "type").when((kind == "wall") & ~F.coalesce(call.isin(*CALLS), F.lit(False)), "call").when((kind != "wall") & call.isNotNull(), "call")
        .when((kind == "none") & (F.col("x").isNotNull() | F.col("y").isNotNull()), "ball").when((kind != "none") & no_ball, "ball").when((kind != "none") & bounce.isNull(), "frame_is_bounce")
        .when((kind != "none") & bounce & F.col("frame").isNotNull(), "frame").when((kind != "none") & ~bounce & F.col("frame").isNull(), "frame")
    )
    good = error.isNull()
    same_call = F.when((kind == "wall") & F.upper("predicted_call").isin(*CALLS), F.upper("predicted_call") == call)
    return rows.withColumns({"error": error, "agrees_type": F.when(good, F.lower("predicted_type") == kind), "agrees_call": F.when(good, same_call), "agrees_frame": F.when(good & (kind != "none"), bounce)})


def kept_fields(body: Column, names: tuple[str, ...]) -> Column:
    """A JSON object of no more than the fields ``names``, in their order; absent ones stay absent."""
    fields = F.from_json(body, "map<string,string>")
    return F.to_json(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.try_element_at(fields, F.lit(n)) for n in names])), lambda _, v: v.isNotNull()))


def floor_or_warning(rows: DataFrame) -> DataFrame:
    """``rows`` (floor: an array of corresponding points, or null) with the floor dropped and a warning where it has fewer than four points that are not all on one line."""
    p = F.col("floor")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    off = F.exists(p, lambda c: F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) > 1e-6)
    valid = (F.size(p) >= 4) & F.coalesce(off, F.lit(False))
    bad = p.isNotNull() & ~valid
    return rows.withColumns({"warning": F.when(bad, "invalid floor calibration ignored"), "floor": F.when(~bad, p)})


def with_provenance(rows: DataFrame, **facts: str) -> DataFrame:
    """C20: ``rows`` stamped with what made them."""
    return rows.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in facts.items()]))


def payload(hits: DataFrame, rallies: DataFrame) -> DataFrame:
    """run_id and body, a JSON document of a run's hits (in the order of frames) and rallies; a run without rallies has an empty list."""
    list_of = lambda df, order, name: df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("run_id", order)]))).alias(name))
    both = list_of(hits, "frame", "hits").join(list_of(rallies, "rally_number", "rallies"), "run_id", "left")
    return both.select("run_id", F.to_json(F.struct("hits", F.coalesce("rallies", F.filter("rallies", lambda r: F.lit(False))).alias("rallies"), F.size("hits").alias("hit_count"))).alias("body"))


def sorted_lines(cases: DataFrame) -> DataFrame:
    """``cases`` as JSON lines, keys in alphabetical order, rows by kind, run and frame."""
    line = F.to_json(F.struct(*sorted(cases.columns)))
    order = Window.partitionBy("kind").orderBy(F.coalesce(F.col("run_id").cast("string"), F.lit("")), "frame")
    return cases.select("kind", F.row_number().over(order).alias("line_no"), line.alias("line"))


def label_sidecar(labels: DataFrame) -> DataFrame:
    """Per name the sidecar of its labels (name, frame, type): their number, by kind, first and last frame."""
    kinds = labels.groupBy("name", "type").agg(F.count("*").alias("n")).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    return labels.groupBy("name").agg(F.count("*").alias("n_labels"), F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame")).join(kinds, "name")


def toggled(labels: DataFrame, marks: DataFrame) -> DataFrame:
    """``labels`` (name, frame, type) after ``marks`` (name, frame, type): the same kind again takes a label away, another one replaces it."""
    both = labels.join(marks.withColumnRenamed("type", "mark"), ["name", "frame"], "full")
    kind = F.when(F.col("mark").isNull(), F.col("type")).when(F.col("type").eqNullSafe(F.col("mark")), None).otherwise(F.col("mark"))
    return both.select("name", "frame", kind.alias("type")).filter("type IS NOT NULL")


def replaced_truth(old: DataFrame, new: DataFrame) -> DataFrame:
    """The events (run_id, frame, type) of the runs in ``new`` replace those in ``old``; unknown kinds and missing frames are refused."""
    good = new.select("run_id", "frame", F.lower("type").alias("type")).filter(F.col("type").isin(*HIT_TYPES) & F.col("frame").isNotNull())
    return old.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(good)


def report(rows: DataFrame) -> DataFrame:
    """Per run a Markdown table of metrics (run_id, place, name, value)."""
    line = F.format_string("| %s | %.3f |", "name", "value")
    return rows.groupBy("run_id").agg(F.concat(F.lit("| metric | value |\n|---|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda s: s["l"]), "\n")).alias("report"))


def merged_jobs(jobs: DataFrame, updates: DataFrame, restarted: bool = False) -> DataFrame:
    """``jobs`` (run_id, status, stage) after ``updates`` (run_id, seq, status, stage): each field takes its latest value that is not null; after a restart a running job has failed."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    new = updates.groupBy("run_id").agg(last("status").alias("s"), last("stage").alias("g"))
    both = jobs.join(new, "run_id", "full")
    status = F.coalesce("s", "status")
    if restarted:
        status = F.when(status == "running", "failed").otherwise(status)
    return both.select("run_id", status.alias("status"), F.coalesce("g", "stage").alias("stage"))


def colliding_names(rows: DataFrame, slug: Column) -> DataFrame:
    """Names that different sources (column source) would be written under, with their number; a writer refuses if there are any."""
    return rows.select(slug.alias("name"), "source").distinct().groupBy("name").agg(F.count("*").alias("sources")).filter("sources > 1")


def without_runs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without those of the runs in ``wanted`` (run_id, status) that are not running."""
    return rows.join(wanted.filter("status IS NULL OR status <> 'running'").select("run_id").distinct(), "run_id", "left_anti")


def collected_cases(corrections: DataFrame, truth: DataFrame, detected: DataFrame, labels: DataFrame) -> DataFrame:
    """Kind and case_id of the cases of three sources: corrections (run_id, frame, type) of a known type, truth events (the same) of runs that were ``detected`` (run_id), and labels (name, frame)."""
    case = lambda kind, prefix, of: (F.lit(kind).alias("kind"), F.concat(F.lit(prefix + ":"), of, F.lit(":"), "frame").alias("case_id"))
    known = corrections.filter(F.col("type").isin(*HIT_TYPES, "none") & F.col("frame").isNotNull())
    events = truth.filter(F.lower("type").isin(*HIT_TYPES)).join(detected.select("run_id").distinct(), "run_id", "left_semi")
    return known.select(*case("correction", "corr", "run_id")).unionByName(events.select(*case("ground_truth_event", "gt", "run_id"))).unionByName(labels.select(*case("label_csv_event", "lbl", "name")))
