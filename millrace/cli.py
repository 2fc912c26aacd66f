"""Commands over JSON-lines files: prepare, audit, preservation, holdout, templates, compare, mine, monolingual.

Gates say by their exit code what they found: 0 passed, 1 failed, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import audit, evaluate, leakage, quality, select
from .plans import prepare
from .session import session
from .sources import readers, sinks


def _fields(df: DataFrame, *names: str) -> DataFrame:
    """String fields of well-formed lines."""
    v = F.try_parse_json("value")
    return df.filter("status = 'ok'").select("file", *[F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in names])


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():  # whole, a partition at a time
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def prepare_data(a, spark) -> int:
    rows = prepare.records(spark, a.paths, [tuple(a.languages)])
    out = prepare.prepared(rows, tuple(a.languages), validation=a.validation, test=a.test, approximate=not a.exact_split, filter_quality=not a.no_quality)
    sinks.publish(out.drop("file", "digest", "n_pairs", "ordinal", "issue", "end_a", "end_b"), a.out, ["split"])
    done = spark.read.parquet(a.out)
    print(json.dumps(sinks.manifest(done, "split", languages=a.languages, validation=a.validation, test=a.test)))
    return 0 if not done.isEmpty() else 2


def audit_data(a, spark) -> int:
    raw = readers.json_lines(spark, *a.paths)
    pairs = _fields(raw, *a.languages).dropna()
    q = quality.assess(pairs, *a.languages, tuple(a.languages))
    _show(audit.with_total(raw, "file", F.count("*").alias("lines"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "blank", "invalid_json", "invalid_utf8")]))
    _show(audit.with_total(q, "file", F.count("*").alias("pairs"), audit.rate(F.count_if("accepted"), F.count("*")).alias("pass_rate"), F.round(F.avg("score"), 8).alias("mean_score")))
    _show(q.select(F.explode("rejections").alias("reason")).groupBy("reason").count().orderBy("reason"))
    return 0


def check_preservation(a, spark) -> int:
    rows = _fields(readers.json_lines(spark, *a.paths), "source", "translation").dropna()
    got = audit.preservation(rows, "source", "translation", a.scripts).first()
    if not got["sentences"]:
        return 2
    print(json.dumps(got.asDict()))
    return int(any(got[f"{k}_violations"] for k in a.checks))


def audit_holdout(a, spark) -> int:
    cases = _fields(readers.json_lines(spark, a.cases), "id", "category", "source_language", "target_language", "source", "reference")
    rows = readers.lines(spark, *a.paths).select(F.sha2("value", 256).alias("row"), F.col("value").alias("text"))
    items = leakage.holdout_items(cases)
    found = leakage.leaks(items, rows.dropDuplicates(["row"]), row="row", least=a.least)
    report = leakage.leak_summary(items, found, "item_id", F.coalesce("category", F.lit("none")))
    _show(report)
    return 0 if a.allow_leaks or report.filter("failed").isEmpty() else 1


def audit_templates(a, spark) -> int:
    rows = _fields(readers.json_lines(spark, *a.paths), *a.languages).dropna()
    got = audit.template_audit(rows, *a.languages).first()
    print(json.dumps(got.asDict()))
    if not got["rows"]:
        return 2
    return int(got["skeleton_ttr"] < a.least_ttr or got["duplicate_rate"] > a.most_duplicates)


def compare(a, spark) -> int:
    cases = _fields(readers.json_lines(spark, a.cases), "id", "source_language", "target_language", "source", "reference").drop("file")
    for path in a.systems:
        out = _fields(readers.json_lines(spark, path), "id", "translation").drop("file")
        bad = evaluate.coverage(cases, out)
        if not bad.isEmpty():
            _show(bad)
            return 2
        both = cases.join(out, "id").withColumn("direction", F.concat_ws("-", "source_language", "target_language"))
        print(f"## {path}\n\n{evaluate.markdown(evaluate.chrf(both, 'translation', 'reference', ['direction']).orderBy('direction'))}\n")
    return 0


def mine_terms(a, spark) -> int:
    rows = _fields(readers.json_lines(spark, *a.paths), *a.languages).dropna()
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= a.least_length)
    pairs = select.term_pairs(rows.select(words(F.col(a.languages[0])).alias("a"), words(F.col(a.languages[1])).alias("b")), "a", "b", a.least, a.dice)
    _show(select.mutual_best(pairs).orderBy(F.desc("dice"), "s"))
    return 0


def prepare_foundation(a, spark) -> int:
    out = prepare.foundation(readers.monolingual(spark, a.root))
    sinks.publish(out, a.out, ["split"])
    _show(audit.sampling_weights(spark.read.parquet(a.out).groupBy("language").agg(F.count("*").alias("n")), "n"))
    return 0


def top_characters(a, spark) -> int:
    rows = readers.lines(spark, *a.paths)
    _show(audit.required_characters(rows, X.tokenizer_text(F.col("value")), a.least).orderBy(F.desc("n")))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *flags):
        c = sub.add_parser(f.__name__.replace("_", "-"))
        c.set_defaults(run=f)
        for names, kw in flags:
            c.add_argument(*names.split(), **kw)

    paths = ("paths", {"nargs": "+"})
    langs = ("--languages", {"nargs": 2, "default": ["ko", "ja"]})
    add(prepare_data, paths, langs, ("--out", {"required": True}), ("--validation", {"type": float, "default": 0.005}), ("--test", {"type": float, "default": 0.005}), ("--exact-split", {"action": "store_true"}), ("--no-quality", {"action": "store_true"}))
    add(audit_data, paths, langs)
    add(check_preservation, paths, ("--scripts", {"nargs": "*", "default": []}), ("--checks", {"nargs": "+", "default": ["sign", "unit", "number", "script"]}))
    add(audit_holdout, paths, ("--cases", {"required": True}), ("--least", {"type": float, "default": 0.6}), ("--allow-leaks", {"action": "store_true"}))
    add(audit_templates, paths, langs, ("--least-ttr", {"type": float, "default": 0.2}), ("--most-duplicates", {"type": float, "default": 0.05}))
    add(compare, ("--cases", {"required": True}), ("systems", {"nargs": "+"}))
    add(mine_terms, paths, langs, ("--least", {"type": int, "default": 3}), ("--dice", {"type": float, "default": 0.3}), ("--least-length", {"type": int, "default": 2}))
    add(prepare_foundation, ("root", {}), ("--out", {"required": True}))
    add(top_characters, paths, ("--least", {"type": int, "default": 25}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a, session())


if __name__ == "__main__":
    sys.exit(main())
