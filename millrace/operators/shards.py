"""Gates of parallel shards: template collapse, selection after scoring, verified joins, removed and corrected rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.checkpoints import ensure
from .audit import rate
from .select import seeded, unique_matching


@dataclass(frozen=True)
class Thresholds:
    """Limits of ``generated_audit``, shares of 0 to 1: ``least_*`` must be reached, ``most_*`` not passed."""

    least_skeleton_ttr: float = 0.50
    least_quoted_ttr: float = 0.05
    most_duplicate_source: float = 0.10
    most_conflicting_source: float = 0.02
    most_foreign_target: float = 0.02
    most_skeleton_leak: float = 0.10

    def __post_init__(self):
        for name, value in asdict(self).items():
            if not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} must be a share; got {value!r}")


def generated_audit(
    rows: DataFrame, source: str, target: str, source_scripts=(), target_scripts=(), limits: Thresholds | None = None,
    validation: float = 0.005, test: float = 0.005, normal: bool = True,
) -> DataFrame:
    """One row: how varied a generated shard is, and ``violations`` of the limits.

    Frames (``skeleton_ttr``), quoted spans (1 without any), repeated and
    conflicting sources, scripts that a side may not use, and the share of
    held-out rows whose frame a train row has. Every part is an aggregate of one
    key, so a frame of most rows is reduced before the shuffle.
    """
    limits = limits or Thresholds()
    base = rows.select(X.canonical_text(F.col(source), normal).alias("s"), X.canonical_text(F.col(target), normal).alias("t"))
    readable = (F.coalesce("s", F.lit("")) != "") & (F.coalesce("t", F.lit("")) != "")
    good = base.filter(readable)
    foreign = lambda c, allowed: F.count_if(F.size(X.foreign_scripts(F.col(c), allowed)) > 0)
    whole = base.agg(F.count("*").alias("rows"), F.count_if(~readable).alias("unreadable"))
    sides = good.agg(F.count("*").alias("usable"), foreign("s", source_scripts).alias("foreign_source"), foreign("t", target_scripts).alias("foreign_target"))
    pairs = good.groupBy("s", "t").agg(F.count("*").alias("n"))
    sources = pairs.groupBy("s").agg(F.count("*").alias("targets"))
    sources = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("targets") > 1).alias("conflicting"), F.max("targets").alias("max_targets"))
    held = X.split_of(X.split_key(F.col("s"), normal), validation, test) != "train"
    frames = good.select(X.skeleton(F.col("s")).alias("k"), held.alias("held")).groupBy("k")
    frames = frames.agg(F.count("*").alias("n"), F.count_if("held").alias("held"))
    frames = frames.agg(
        F.count("*").alias("skeletons"), F.sum("held").alias("held_out"), F.sum(F.when(F.col("n") > F.col("held"), F.col("held")).otherwise(0)).alias("leaked")
    )
    quoted = good.select(F.explode(X.quoted_spans(F.col("s"))).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    quoted = quoted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("quoted"), F.count("*").alias("quoted_unique"))
    one = whole.crossJoin(sides).crossJoin(sources).crossJoin(frames).crossJoin(quoted)  # five single rows
    n = F.col("usable")
    out = one.select(
        "rows", "unreadable", "sources", "skeletons", "quoted", "quoted_unique", F.coalesce("max_targets", F.lit(0)).alias("max_targets"),
        F.coalesce("held_out", F.lit(0)).alias("held_out"),
        rate(F.col("skeletons"), n).alias("skeleton_ttr"),
        F.when(F.col("quoted") > 0, F.round(F.col("quoted_unique") / F.col("quoted"), 8)).otherwise(F.lit(1.0)).alias("quoted_ttr"),
        rate(n - F.col("sources"), n).alias("duplicate_source"),
        rate(F.col("conflicting"), F.col("sources")).alias("conflicting_source"),
        rate(F.col("foreign_source"), n).alias("foreign_source"), rate(F.col("foreign_target"), n).alias("foreign_target"),
        rate(F.coalesce("leaked", F.lit(0)), F.coalesce("held_out", F.lit(0))).alias("skeleton_leak"),
    )
    bad = [F.when(n_ok, F.lit(k)) for k, n_ok in _broken(limits)]
    some = F.col("rows") > F.col("unreadable")
    return out.withColumn("violations", F.when(some, F.array_compact(F.array(*bad))).otherwise(F.array(F.lit("usable_rows"))))


def _broken(limits: Thresholds) -> list[tuple[str, Column]]:
    out = []
    for name, value in asdict(limits).items():
        kind, measure = name.split("_", 1)
        out.append((measure, F.col(measure) < value if kind == "least" else F.col(measure) > value))
    return out


def recovery_select(
    rows: DataFrame, source: str, target: str, score: str, least: float, most_targets: int | None = None,
    unique_source: bool = True, unique_target: bool = True, seed: str = "recover", normal: bool = True,
) -> DataFrame:
    """``rows`` with ``drop_reason``, null for those that stay.

    In this order: no score; a source with more than ``most_targets`` rows, which
    goes whole; a score under ``least``; a source or target that a better row
    took. The best row of both its ends comes first, ties by a seeded hash.
    """
    ensure(rows.sparkSession)
    value = F.col(score).cast("double")
    known = rows.withColumns({"_s": X.canonical_text(F.col(source), normal), "_t": X.canonical_text(F.col(target), normal), "_score": value})
    known = known.withColumn("_scored", F.col("_score").isNotNull() & ~F.isnan("_score"))
    many = known.filter("_scored").groupBy("_s").agg(F.count("*").alias("_n")).filter(F.col("_n") > (most_targets or 2**62))
    known = known.join(many, "_s", "left")
    early = F.when(~F.col("_scored"), "missing_score").when(F.col("_n").isNotNull(), "fan_out").when(F.col("_score") < least, "below_threshold")
    known = known.withColumns({"_early": early, "_row": F.expr("uuid()")}).checkpoint()  # ids must not change between uses
    left = known.filter("_early IS NULL")
    ends = [F.col("_s") if unique_source else F.col("_row"), F.col("_t") if unique_target else F.col("_row")]
    tie = F.concat(seeded(seed, F.col("_s"), F.col("_t")), F.col("_row"))
    edges = left.select(ends[0].alias("_from"), ends[1].alias("_to"), "_score", "_row", tie.alias("_order"))
    kept = unique_matching(edges, "_from", "_to", "_score", F.col("_order")).select("_row", F.lit(True).alias("_kept"))
    taken = left.join(kept, "_row", "left_semi").select("_s").distinct().withColumn("_taken", F.lit(True))
    out = known.join(kept, "_row", "left").join(taken, "_s", "left")
    lost = F.when(F.col("_taken").isNotNull() & F.lit(unique_source), "duplicate_source").otherwise("duplicate_target")
    reason = F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_kept").isNull(), lost)
    return out.withColumn("drop_reason", reason).select(*rows.columns, "drop_reason")


def same_groups(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """Groups whose key sets are the same on both sides, by count and two order-free hashes of the keys."""
    of = lambda t: t.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(key)).alias("_x"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("_y"))
    return of(a).join(of(b), [group, "_n", "_x", "_y"], "left_semi").select(group)


def aligned(a: DataFrame, b: DataFrame, group: str, key: str, text: str = "text", excluded: Column | None = None) -> DataFrame:
    """(group, key, a, b): rows of one key, joined only inside groups that number their rows alike."""
    good = same_groups(a, b, group, key)
    if excluded is not None:
        good = good.filter(~excluded)
    left = a.select(group, key, F.col(text).alias("a")).join(good, group, "left_semi")
    return left.join(b.select(group, key, F.col(text).alias("b")), [group, key])


def one_sided(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys that only one side has."""
    x, y = (t.select(key).distinct() for t in (a, b))
    return x.join(y, key, "left_anti").agg(F.count("*").alias("only_a")).crossJoin(y.join(x, key, "left_anti").agg(F.count("*").alias("only_b")))


def judged(judgments: Column, labelled: Column) -> Column:
    """Whether an array of judgments lets a record pass: two at least, most of them for it, and medians that suffice.

    A judgment has ``intent_score``, ``grammar_score``, ``spelling_score``,
    ``slots_score`` and ``language_identification``; a missing score is 0.
    """
    good = F.filter(judgments, lambda j: j.isNotNull())
    votes = lambda f: F.size(F.filter(good, f))

    def median(field: str) -> Column:
        x = F.array_sort(F.transform(good, lambda j: F.coalesce(j[field].cast("double"), F.lit(0.0))))
        n = F.size(x)
        at = lambda i: F.get(x, i.cast("int"))
        return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2

    passed = (
        (votes(lambda j: j["intent_score"].isin(1, 2)) >= 2) & (median("grammar_score") >= 3) & (median("spelling_score") >= 1)
        & (votes(lambda j: j["language_identification"] == "target") >= 2) & (~labelled | (votes(lambda j: j["slots_score"].isin(1, 2)) >= 2))
    )
    return F.when(F.coalesce(F.size(good), F.lit(0)) >= 2, F.coalesce(passed, F.lit(False))).otherwise(F.lit(False))


def still_there(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows that were to be removed; none may be left."""
    return rows.join(removed.select(key).distinct(), key, "left_semi")


def corrected(rows: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the corrections of their key; a key that is corrected twice is an error."""
    new = corrections.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_new_{c}") for c in columns])
    sure = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("corrected twice: "), F.col(key).cast("string")))).otherwise(F.col("_n"))
    out = rows.join(new.withColumn("_n", sure), key, "left")
    pick = {c: F.when(F.col("_n") == 1, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return out.select(*[pick.get(c, F.col(c)).alias(c) for c in rows.columns], F.col("_n").isNotNull().alias("was_corrected"))


def first_per_direction(rows: DataFrame, direction: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each direction, as they stand in their files."""
    from .dedup import capped

    return capped(rows, direction, [F.col(c) for c in order], most, "_rank").drop("_rank")


def presence(configured: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): configured languages without data, and data that no configuration names."""
    a, b = configured.select(key).distinct(), present.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("state", F.lit("without_data"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("not_configured")))
