"""Evaluation roll-ups: chrF, number preservation, coverage checks, adherence, reports, rewards."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def _stats(orders: int):
    names = [f"{c}{n}" for n in range(1, orders + 1) for c in "mhr"]

    @F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in names]))
    def stats(output: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(output, reference, strict=True):
            x, y = ("".join((t or "").split()) for t in (x, y))
            row: list[int] = []
            for n in range(1, orders + 1):
                h, r = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
                less, more = (h, r) if len(h) < len(r) else (r, h)
                row += [sum(min(c, more[g]) for g, c in less.items() if g in more), max(len(x) - n + 1, 0), max(len(y) - n + 1, 0)]
            rows.append(row)
        return pd.DataFrame(rows, columns=names, dtype="int64")

    return stats


def chrf(rows: DataFrame, output: str, reference: str, by: list[str], orders: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF of each group: statistics of character n-grams without blanks are summed, the score is taken once.

    The n-grams of a pair are counted by one function over Arrow batches: (m,
    h, r) matches, output and reference n-grams of each order.
    """
    out = rows.withColumn("_s", _stats(orders)(F.col(output), F.col(reference)))
    sums = [F.sum(f"_s.{c}{n}").alias(f"{c}{n}") for n in range(1, orders + 1) for c in "mhr"]
    agg = out.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    valid = [(F.col(f"h{n}") > 0) & (F.col(f"r{n}") > 0) for n in range(1, orders + 1)]
    k = sum((v.cast("int") for v in valid), F.lit(0))
    p = sum((F.when(v, F.col(f"m{n}") / F.col(f"h{n}")).otherwise(F.lit(0.0)) for n, v in enumerate(valid, 1)), F.lit(0.0)) / F.greatest(k, F.lit(1))
    r = sum((F.when(v, F.col(f"m{n}") / F.col(f"r{n}")).otherwise(F.lit(0.0)) for n, v in enumerate(valid, 1)), F.lit(0.0)) / F.greatest(k, F.lit(1))
    b = beta * beta
    score = F.when(p + r > 0, 100 * (1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-16))).otherwise(F.lit(0.0))
    return agg.select(*by, "n", F.round(score, 6).alias("chrf"))


_TOKENS_13A = (
    # The tokenisation rules of the usual BLEU, in order.
    (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
)


def bleu_tokens(text: str, characters: bool) -> list[str]:
    """Words by the usual rules, or single characters for languages that write no blanks."""
    if characters:
        return [c for c in text if not c.isspace()]
    text = text.rstrip()
    for i, (pattern, new) in enumerate(_TOKENS_13A):
        text = re.sub(pattern, new, f" {text} " if i == 7 else text)
    return text.split()


def bleu(rows: DataFrame, output: str, reference: str, by: list[str], characters: bool = False) -> DataFrame:
    """Corpus BLEU of each group: n-grams up to 4, brevity penalty, exponential smoothing of orders without a match."""
    names = [f"{c}{n}" for n in range(1, 5) for c in "mt"] + ["h", "r"]

    @F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in names]))
    def stats(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(hyp, ref, strict=True):
            x, y = (bleu_tokens(t or "", characters) for t in (x, y))
            row = []
            for n in range(1, 5):
                h, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
                row += [sum(min(c, r[g]) for g, c in h.items() if g in r), max(len(x) - n + 1, 0)]
            out.append([*row, len(x), len(y)])
        return pd.DataFrame(out, columns=names, dtype="int64")

    agg = rows.withColumn("_s", stats(F.col(output), F.col(reference))).groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"_s.{x}").alias(x) for x in names])
    log, smooth = F.lit(0.0), F.lit(1.0)
    for k in range(1, 5):
        m, t = F.col(f"m{k}"), F.col(f"t{k}")
        smooth = F.when((m == 0) & (t > 0), smooth * 2).otherwise(smooth)
        log = log + F.log(F.when(m > 0, m / t).when(t > 0, 1 / (smooth * t)).otherwise(F.lit(0.0)))
    brevity = F.when(F.col("h") < F.col("r"), F.exp(1 - F.col("r") / F.col("h"))).otherwise(F.lit(1.0))
    some = (F.col("m1") + F.col("m2") + F.col("m3") + F.col("m4") > 0) & (F.col("t4") > 0)
    return agg.select(*by, "n", F.when(some, F.round(100 * brevity * F.exp(log / 4), 6)).otherwise(F.lit(0.0)).alias("bleu"))


def deltas(scores: DataFrame, system: str, baseline: str, by: list[str], metric: str) -> DataFrame:
    """Each system's score, the baseline's for the same group and the difference; null where the baseline has none."""
    base = scores.filter(F.col(system) == baseline).select(*by, F.col(metric).alias("baseline"))
    return scores.filter(F.col(system) != baseline).join(base, by, "left").withColumn("delta", F.round(F.col(metric) - F.col("baseline"), 6))


def number_preservation(rows: DataFrame, reference: str, output: str, by: list[str], normal: bool = True) -> DataFrame:
    """Mean number F1 times 100 over rows whose reference has numbers; 100 without any."""
    a, b = X.numeric_tokens(F.col(reference), normal), X.numeric_tokens(F.col(output), normal)
    return rows.withColumn("_f", F.when(F.size(a) > 0, X.bag_f1(a, b))).groupBy(*by).agg(F.count("_f").alias("with_numbers"), F.coalesce(F.round(F.avg("_f") * 100, 6), F.lit(100.0)).alias("number_f1"))


def coverage(cases: DataFrame, outputs: DataFrame, key: str = "id") -> DataFrame:
    """One row per problem of a system's outputs: duplicate, missing or extra ids."""
    dup = outputs.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate").alias("problem"))
    missing = cases.select(key).join(outputs.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = outputs.select(key).join(cases.select(key), key, "left_anti").distinct().select(key, F.lit("extra").alias("problem"))
    return dup.unionByName(missing).unionByName(extra)


def macro(scores: DataFrame, by: str, metric: str) -> DataFrame:
    """The mean over groups and the worst group, sums and counts carried apart."""
    per = scores.groupBy(by).agg(F.sum(metric).alias("s"), F.count(metric).alias("n")).withColumn("mean", F.col("s") / F.col("n"))
    return per.agg(F.avg("mean").alias("macro"), F.min("mean").alias("worst"), F.sum("s").alias("total"), F.sum("n").alias("rows"))


def adherence(rows: DataFrame, output: str, terms: str) -> DataFrame:
    """Share of demanded terms found and of sentences with all of theirs; 1 without demands."""
    hit = F.size(F.filter(F.col(terms), lambda t: F.contains(F.col(output), t)))
    out = rows.select(F.size(terms).alias("n"), hit.alias("h")).filter("n > 0").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.count("*").alias("s"), F.count_if(F.col("n") == F.col("h")).alias("a"))
    return out.select(F.coalesce(F.col("h") / F.col("n"), F.lit(1.0)).alias("term_rate"), F.when(F.col("s") > 0, F.col("a") / F.col("s")).otherwise(F.lit(1.0)).alias("sentence_rate"))


def roundtrip_score(chrf: Column, spans: Column, numbers: Column, length: Column, exact: Column, critical: Column) -> Column:
    """Weighted parts, halved where critical spans differ."""
    score = 0.50 * chrf + 0.20 * spans + 0.15 * numbers + 0.10 * length + 0.05 * exact
    return F.when(critical, score * 0.5).otherwise(score)


def refine(state: DataFrame, revise, score, accept: float, least_gain: float, rounds: int) -> DataFrame:
    """Rows are revised while their score is under ``accept`` and gains enough; none ever gets worse.

    ``state`` has (id, text, score). Each round works on what is still open and
    is checkpointed; ``revise`` and ``score`` map a frame to a frame.
    """
    done = None
    left = state.withColumn("revisions", F.lit(0))
    for i in range(rounds):
        open_ = left.filter(F.col("score") < accept)
        ready = left.filter(F.col("score") >= accept).withColumn("stop_reason", F.lit("accepted"))
        done = ready if done is None else done.unionByName(ready)
        if open_.isEmpty():
            left = open_
            break
        new = score(revise(open_.withColumns({"_old": F.col("score"), "_text": F.col("text")})))
        better = F.col("score") >= F.col("_old") + least_gain
        kept = new.withColumns({"text": F.when(better, F.col("text")).otherwise(F.col("_text")), "score": F.when(better, F.col("score")).otherwise(F.col("_old")), "revisions": F.col("revisions") + better.cast("int"), "_better": better}).checkpoint()
        done = done.unionByName(kept.filter("NOT _better").withColumn("stop_reason", F.lit("no_gain")).drop("_better", "_old", "_text"))
        left = kept.filter("_better").drop("_better", "_old", "_text")
    rest = left.withColumn("stop_reason", F.when(F.col("score") >= accept, F.lit("accepted")).otherwise(F.lit("max_rounds")))
    return rest if done is None else done.unionByName(rest)


def refinement_summary(done: DataFrame) -> DataFrame:
    """One row: sentences, revisions in all and each, untouched sentences, and sentences by stop reason."""
    per = done.groupBy("stop_reason").agg(F.count("*").alias("n"), F.sum("revisions").alias("r"), F.count_if(F.col("revisions") == 0).alias("z"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stop_reason", "n"))))  # a few reasons
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), F.coalesce(F.sum("r"), F.lit(0)).alias("revisions_total"), F.coalesce(F.sum("z"), F.lit(0)).alias("unrevised_sentences"), pairs.alias("stop_reasons"))
    return out.withColumn("revisions_per_sentence", F.when(F.col("sentences") > 0, F.col("revisions_total") / F.col("sentences")).otherwise(F.lit(0.0)))


def by_category(rows: DataFrame, output: str, reference: str, system: str, direction: str, category: str) -> DataFrame:
    """chrF of each system and direction, and of each category within (null: all of them)."""
    whole = chrf(rows, output, reference, [system, direction]).withColumn(category, F.lit(None).cast("string"))
    return chrf(rows, output, reference, [system, direction, category]).unionByName(whole)


def markdown(report: DataFrame, most: int = 200) -> str:
    """A small report as a Markdown table; more than ``most`` rows are an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report has at most a few hundred rows")
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
