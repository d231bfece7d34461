"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Native: DataFrame functions only. Per text a few counts are taken, transformed
and rounded to integers. Per group of texts a minimum-covariance-determinant
estimate of location and scatter is found by concentration steps from several
starts (medians with absolute deviations, and the moments of all texts): keep
the texts with the smallest Mahalanobis distances and re-estimate, until the
determinant of the scatter falls no further. The start that ends with the
smallest determinant wins. Texts far outside its reweighted estimate are rejected.

Medians and the concentration quantile come from histograms, and moments from
sums of integers: everything combines before a shuffle, no task holds a
group's rows, and the outcome does not depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .storage import materialize, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Transformed statistics are held in thousandths.
UNIT = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repetition(words: Column, size: int = WINDOW) -> Column:
    """Of an array of words, as a struct: ``repeat``, those in windows of ``size`` words found twice or more, and ``distinct`` ones."""

    def covered(hashes: Column) -> Column:
        places = let(
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))),
                    lambda e: e["i"],
                )
            ),
        )
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, i: F.struct((i + size).alias("end"), (acc["n"] + i + size - F.greatest(i, acc["end"])).alias("n")),
        )["n"]

    def count(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        repeat = F.when(F.size(words) > size, found).otherwise(F.lit(0))
        return F.struct(repeat.cast("long").alias("repeat"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))

    return let(words, count)


def statistics(text: Column) -> dict[str, Column]:
    """The base counts of a text (null: none), and further ones for the method. Two come from ``_repetition``, its words' repetition()."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    spaces = F.octet_length(text) - F.octet_length(without(text, SPACES))
    return {
        "n_words": word_count(text),
        "word_chars": (F.length(text) - spaces).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_repetition")["repeat"],
        "n_distinct_words": F.col("_repetition")["distinct"],
        "n_lines": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_upper": (F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def transforms() -> list[tuple[Column, float]]:
    """Each statistic on a scale where texts of one kind are about normal, and the least standard deviation it is granted.

    Added constants draw short texts, whose shares are noisy, towards the usual.
    """
    n = F.col("n_words")
    return [
        (F.log((F.col("word_chars") + 165) / (n + 30)), 0.08),
        (F.log(F.col("n_symbols") / (n + 20) + 0.01), 0.5),
        (F.log(F.col("n_dup_lines") / (F.col("n_lines") + 5) + 0.05), 0.4),
        (F.log(F.col("n_repeat_words") / (n + 20) + 0.03), 0.45),
        (F.log(F.col("n_distinct_words")) / F.log(n), 0.04),
        (F.log((F.col("n_upper") + 3) / (F.col("word_chars") + 60)), 0.35),
    ]


def chi2_cdf(x: float, d: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, d: float) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def _moments(d: int) -> list[Column]:
    cross = [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"s{i}_{j}") for i in range(d) for j in range(i + 1)]
    return [F.count("*").alias("m"), *[F.sum(F.col(f"x{i}")).alias(f"s{i}") for i in range(d)], *cross]


def _estimate(sums: DataFrame, floors: list[float], factor: float) -> DataFrame:
    """Keys (grp, and start if there is one), means (m0..), the Cholesky factor (l0_0..) of scatter times ``factor``, plus the squared floors on its diagonal, and the log of its determinant."""
    d = len(floors)
    keys = [c for c in ("grp", "start") if c in sums.columns]
    s = lambda c: F.col(c).cast("double")
    out = sums.select(*keys, *[(s(f"s{i}") / s("m")).alias(f"m{i}") for i in range(d)], "m", *[f"s{i}_{j}" for i in range(d) for j in range(i + 1)])
    cov = {
        (i, j): (s(f"s{i}_{j}") / s("m") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (F.lit((floors[i] * UNIT) ** 2) if i == j else F.lit(0.0))
        for i in range(d) for j in range(i + 1)
    }
    for j in range(d):
        for i in range(j, d):
            rest = cov[i, j] - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
            low = F.lit((floors[i] * UNIT) ** 2 / 100)
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, low)) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.select(*keys, *_parts(d), _log_det(d))


def _parts(d: int) -> list[str]:
    return [*[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i in range(d) for j in range(i + 1)]]


def _log_det(d: int) -> Column:
    return sum((2 * F.log(F.col(f"l{i}_{i}")) for i in range(1, d)), 2 * F.log(F.col("l0_0"))).alias("log_det")


def _distance(rows: DataFrame, estimate: DataFrame, d: int, how: str = "inner") -> DataFrame:
    """``rows`` (of which only grp and x0.. are looked at by name) with ``d2``, the squared Mahalanobis distance; a row for each start, if there are several."""
    out = rows.join(estimate.select(*[c for c in ("grp", "start") if c in estimate.columns], *_parts(d)), "grp", how)
    for i in range(d):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}_{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    keys = [c for c in ("start",) if c in estimate.columns]
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, d)), F.col("y0") * F.col("y0"))).select(*rows.columns, *keys, "d2")


def _quantile_bin(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per key the first bin that, with those before it, holds ``share`` of the rows."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    upto = counts.select(*keys, "bin", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return upto.filter(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _centres(rows: DataFrame, d: int) -> DataFrame:
    """grp, m0.. (medians) and w0.. (1.4826 times the median absolute deviation)."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("x")) for i in range(d)])).alias("c")).select("grp", "c.dim", "c.x")
    step = 10
    median = _quantile_bin(long.select("grp", "dim", F.floor(F.col("x") / step).alias("bin")), ["grp", "dim"], 0.5).withColumnRenamed("bin", "centre")
    off = long.join(median, ["grp", "dim"]).select("grp", "dim", F.abs(F.floor(F.col("x") / step) - F.col("centre")).alias("bin"))
    spread = _quantile_bin(off, ["grp", "dim"], 0.5)
    both = median.join(spread, ["grp", "dim"])
    return both.groupBy("grp").agg(
        *[F.max(F.when(F.col("dim") == i, (F.col("centre") + 0.5) * step)).alias(f"m{i}") for i in range(d)],
        *[F.max(F.when(F.col("dim") == i, (F.col("bin") + 0.5) * step * 1.4826)).alias(f"w{i}") for i in range(d)],
    )


def mcd(rows: DataFrame, floors: list[float], share: float = 0.75, steps: int = 8, tolerance: float = 1e-3, reweight: float = 0.975) -> DataFrame:
    """The reweighted MCD estimate of each grp of ``rows`` (grp, and x0.. as long, in UNITs): see _estimate().

    Concentration steps go on from every start, for all groups at once, until
    no log determinant falls by ``tolerance`` any more, or for ``steps`` steps.
    The step keeps the rows up to the bin of squared distances (32 a doubling)
    in which ``share`` of the rows is reached.
    """
    d = len(floors)
    centres = _centres(rows, d)
    zero = [F.lit(0.0).alias(f"l{i}_{j}") for i in range(d) for j in range(i)]
    medians = centres.select("grp", *[f"m{i}" for i in range(d)], *zero, *[F.sqrt(F.pow(F.col(f"w{i}"), 2) + (floors[i] * UNIT) ** 2).alias(f"l{i}_{i}") for i in range(d)])
    moments = _estimate(rows.groupBy("grp").agg(*_moments(d)), floors, 1.0)
    starts = [x.select("grp", F.lit(i).alias("start"), *_parts(d)) for i, x in enumerate((medians, moments))]
    estimate = materialize(starts[0].union(starts[1]).withColumn("log_det", F.lit(None).cast("double")), "mcd-estimate")
    factor = share / chi2_cdf(chi2_quantile(share, d), d + 2)
    for _ in range(steps):
        far = _distance(rows, _small(estimate), d).withColumn("bin", F.floor(F.log2(F.col("d2") + 0.01) * 32))
        edge = materialize(_quantile_bin(far.select("grp", "start", "bin"), ["grp", "start"], share).withColumnRenamed("bin", "edge"), "mcd-edge")
        core = far.join(_small(edge), ["grp", "start"]).filter("bin <= edge")
        before = estimate.select("grp", "start", F.col("log_det").alias("before"))
        estimate = materialize(_estimate(core.groupBy("grp", "start").agg(*_moments(d)), floors, factor).join(before, ["grp", "start"]), "mcd-estimate")
        if estimate.filter(F.col("before").isNull() | (F.col("log_det") < F.col("before") - tolerance)).limit(1).count() == 0:
            break
        estimate = estimate.drop("before")
    best = estimate.groupBy("grp").agg(F.min_by(F.struct(*_parts(d)), F.struct("log_det", "start")).alias("best")).select("grp", "best.*")
    best = materialize(best, "mcd-estimate")
    near = _distance(rows, _small(best), d).filter(F.col("d2") <= chi2_quantile(reweight, d))
    factor = reweight / chi2_cdf(chi2_quantile(reweight, d), d + 2)
    return materialize(_estimate(near.groupBy("grp").agg(*_moments(d)), floors, factor), "mcd-estimate")


def _counted(docs: DataFrame, min_words: int, max_repeat_percent: int, with_text: bool) -> DataFrame:
    """The columns of ``docs`` in ``rest`` (with or without the text), the counts, ``base_failed``, and the names of language and source."""
    text = F.col("rest.text").cast("string")
    made = statistics(text)
    words = words_of(F.coalesce(text, F.lit("")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"rest.{c}").cast("string")), F.lit("-"))
    counted = docs.select(F.struct("*").alias("rest")).withColumn("_repetition", repetition(words)).withColumns(made).drop("_repetition")
    counted = counted.withColumns({"base_failed": failed, "_lang": name("lang"), "_source": name("source")})
    dropped = [c for c in docs.columns if c in made or c in VERDICT or (c == "text" and not with_text)]
    return counted.withColumn("rest", F.col("rest").dropFields(*[f"`{c}`" for c in dropped])) if dropped else counted


#: Columns of rate() besides the counts, and all of them.
VERDICT = ("base_failed", "d2", "kept")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", *VERDICT)


def _transformed(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.round(c * UNIT)).cast("long") for i, (c, _) in enumerate(transforms())})


def _small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df``, marked for broadcast if it has few rows; else it is joined by a shuffle. ``df`` is a written table, so counting is cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rate(
    docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, least_group: int = 100, confidence: float = 1 - 1e-7, with_text: bool = False
) -> DataFrame:
    """``docs`` (text, lang, source and anything else) with the counts of :func:`statistics`, ``base_failed``, ``d2`` and ``kept``.

    Base rules: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of them in repeated windows, fails. Estimates are
    made from the other texts of a language and source; a group of fewer than
    ``least_group`` of them joins the other small sources of its language, and
    small languages join each other. Null languages and sources are values of
    their own. A text is kept if its squared distance is within the chi-square
    quantile of ``confidence``. ``d2`` is null where base rules failed. Null
    and empty texts have no words and fail. Equal texts of a group have equal
    verdicts. No rows give no rows. Columns named as a count, ``base_failed``,
    ``d2`` or ``kept`` are replaced; all others stay, whatever their names.

    Counts are taken once and written, beside the texts only ``with_text``.
    """
    kinds = transforms()
    floors = [f for _, f in kinds]
    counted = materialize(_counted(docs, min_words, max_repeat_percent, with_text), "quality-counts")
    ok = counted.filter("NOT base_failed")
    sizes = ok.groupBy("_lang", "_source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < least_group)
    sizes = sizes.withColumn("n_small", F.sum(F.when(F.col("small"), F.col("n"))).over(Window.partitionBy("_lang")))
    grp = F.when(~F.col("small"), F.concat_ws("\x01", "_lang", "_source")).when(F.col("n_small") >= least_group, F.concat(F.col("_lang"), F.lit("\x01*"))).otherwise("*")
    groups = materialize(sizes.select("_lang", "_source", grp.alias("grp")), "quality-groups")
    named = lambda df: df.join(_small(groups), ["_lang", "_source"], "left")
    xs = [f"x{i}" for i in range(len(kinds))]
    facts = [c for c in counted.columns if c not in ("rest", "_lang", "_source")]
    slim = materialize(named(_transformed(ok.drop("rest"))).select("grp", *xs), "quality-points")
    estimate = mcd(slim, floors)
    limit = chi2_quantile(confidence, len(floors))
    judged = _distance(named(_transformed(counted)), _small(estimate), len(floors), "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False)))
    return judged.select("rest.*", *facts, "d2", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
