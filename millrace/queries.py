"""The operators applied to the driver's tables, each with its DuckDB SQL where SQL can express it.

Pairs are consecutive turns of a conversation. Texts of these tables are in
NFKC already, which SQL has no function for, so the normalising functions run
and change nothing; tests have texts that they change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import spans as S
from .functions import text as X
from .operators import audit, dedup, evaluate, leakage, quality, select, shards, tokens
from .session import spread
from .sources import readers
from .streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, source, target) of consecutive turns."""
    t = spread(table(spark, d, "conversations"))
    later = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return t.select("conv_id", "turn", F.col("text").alias("source")).join(later, ["conv_id", "turn"])


TURNS = "turns AS (SELECT a.conv_id, a.turn, a.text AS source, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def words(t):
    return F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")


WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}]+'), lambda w: w <> '')"


# splits and dedup ------------------------------------------------------------------


@query(rf"""
WITH c AS (SELECT doc_id, lang, {SQUEEZED} AS k FROM documents),
d AS (SELECT lang, k FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1),
u AS (SELECT lang, ('0x' || substr(sha256(k), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM d)
SELECT lang, CASE WHEN u < 0.005 THEN 'test' WHEN u < 0.01 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM u GROUP BY ALL""")
def dataset_split(spark, d):
    """Canonical text, one owner per text, a split by its hash: rows by language and split."""
    docs = spread(table(spark, d, "documents"))
    k = X.canonical_text(F.col("text"))
    one = dedup.first_owner(docs.select("doc_id", "lang", k.alias("k")), F.col("k"), ["doc_id"])
    return one.groupBy("lang", X.split_of(F.col("k")).alias("split")).agg(F.count("*").alias("n"))


@query(rf"SELECT min(doc_id) AS doc_id, {SQUEEZED.replace('text', 'any_value(text)')} IS NOT NULL AS kept FROM documents GROUP BY {SQUEEZED}")
def exact_dedup(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", "text")
    return dedup.first_owner(docs, X.dedup_key(F.col("text")), ["doc_id"]).select("doc_id", F.lit(True).alias("kept"))


@query(rf"""
SELECT doc_id, ('0x' || substr(sha256({SQUEEZED}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM documents""")
def split_fraction(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", X.unit_fraction(X.split_key(F.col("text"))).alias("u"))


@query(rf"""
WITH {TURNS}, k AS (SELECT conv_id, turn, sha256('a' || chr(0) || trim(regexp_replace(source, '\s+', ' ', 'g'))) AS ea, sha256('b' || chr(0) || trim(regexp_replace(target, '\s+', ' ', 'g'))) AS eb FROM turns),
s AS (SELECT *, ('0x' || substr(sha256(ea), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM k),
p AS (SELECT *, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'validation' ELSE 'train' END AS split FROM s),
o AS (SELECT e, arg_min(split, (conv_id, turn)) AS owner FROM (SELECT ea AS e, conv_id, turn, split FROM p UNION ALL SELECT eb, conv_id, turn, split FROM p) GROUP BY e)
SELECT split, count(*) AS n FROM p JOIN o x ON x.e = p.ea JOIN o y ON y.e = p.eb WHERE x.owner = split AND y.owner = split GROUP BY split""")
def split_guard(spark, d):
    """No endpoint on two sides of a split."""
    p = turns(spark, d)
    p = p.withColumns({"ea": dedup.endpoint(F.lit("a"), F.col("source"), False), "eb": dedup.endpoint(F.lit("b"), F.col("target"), False)})
    p = p.withColumn("split", X.split_of(F.col("ea"), 0.1, 0.1)).drop("source", "target")
    return dedup.guarded(p, "split", ["ea", "eb"], ["conv_id", "turn"]).groupBy("split").agg(F.count("*").alias("n"))


@query(rf"""
WITH c AS (SELECT doc_id, replace({SQUEEZED}, ' ', '') AS c, {SQUEEZED} AS n FROM documents),
k AS (SELECT doc_id, CASE WHEN len(c) <= 5 THEN 'exact' || chr(0) || n ELSE 'minhash' || chr(0) || list_min(list_transform(range(1, len(c) - 3), lambda i: substr(sha256(substr(c, i, 5)), 1, 16))) END AS k FROM c)
SELECT min(doc_id) AS first_doc, count(*) AS n FROM k GROUP BY k""")
def approximate_split_groups(spark, d):
    docs = spread(table(spark, d, "documents"))
    return docs.groupBy(dedup.approximate_key(F.col("text"), False).alias("k")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).drop("k")


@query(r"""SELECT doc_id FROM documents x WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM documents y WHERE y.source = 'src0' AND y.text = x.text)""")
def new_against_corpus(spark, d):
    """Candidates whose text the corpus does not have."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return dedup.not_in(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), F.col("text"), F.col("text")).select("doc_id")


# text functions ------------------------------------------------------------------------


@query(rf"SELECT doc_id, md5({SQUEEZED.replace('text', 'nfc_normalize(text)')}) AS digest, len({SQUEEZED.replace('text', 'nfc_normalize(text)')}) AS n FROM documents")
def canonical_text(spark, d):
    k = X.canonical_text(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(k).alias("digest"), F.length(k).cast("long").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\p{P}\p{S}\p{Z}\p{C}]', '', 'g')) AS digest FROM documents")
def comparison_keys(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(X.comparison_key(F.col("text"))).alias("digest"))


@query(r"""
SELECT doc_id, len(regexp_replace(text, '\s', '', 'g')) AS visible, len(regexp_extract_all(text, '\p{L}')) AS letters,
       round(len(regexp_extract_all(text, '[\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]')) / greatest(len(regexp_extract_all(text, '\p{L}')), 1), 8) AS latin_share,
       regexp_matches(text, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]') AS control
FROM documents""")
def surface_measures(spark, d):
    t = F.col("text")
    letters = X.letter_count(t)
    return spread(table(spark, d, "documents")).select("doc_id", X.visible_length(t).cast("long").alias("visible"), letters.cast("long").alias("letters"), F.round(X.script_count(t, "latin") / F.greatest(letters, F.lit(1)), 8).alias("latin_share"), X.has_control(t).alias("control"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS s FROM documents)
SELECT doc_id, round(coalesce(list_max(list_transform(list_distinct(string_split(s, '')), lambda c: len(s) - len(replace(s, c, '')))) / nullif(len(s), 0), 0), 8) AS top_share FROM s""")
def repetition_share(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.round(X.top_share(F.col("text")), 8).alias("top_share"))


@query(r"""
SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[\x{600}-\x{6FF}\x{750}-\x{77F}]') THEN 'arabic' END, CASE WHEN regexp_matches(text, '[\x{400}-\x{52F}]') THEN 'cyrillic' END, CASE WHEN regexp_matches(text, '[\x{900}-\x{97F}]') THEN 'devanagari' END,
  CASE WHEN regexp_matches(text, '[\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]') THEN 'greek' END, CASE WHEN regexp_matches(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]') THEN 'han' END,
  CASE WHEN regexp_matches(text, '[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}]') THEN 'hangul' END, CASE WHEN regexp_matches(text, '[\x{590}-\x{5FF}]') THEN 'hebrew' END,
  CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}]') THEN 'kana' END, CASE WHEN regexp_matches(text, '[A-Za-z\x{C0}-\x{24F}]') THEN 'latin' END, CASE WHEN regexp_matches(text, '[\x{E00}-\x{E7F}]') THEN 'thai' END) AS scripts FROM documents""")
def scripts_present(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(X.scripts_in(F.col("text")), ",").alias("scripts"))


@query(rf"""
WITH {TURNS} SELECT conv_id, turn, round(exp(-abs(ln((len(regexp_replace(target, '\s', '', 'g')) + 1) / (len(regexp_replace(source, '\s', '', 'g')) + 1)))), 8) AS score FROM turns""")
def length_scores(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.round(X.length_score(F.col("source"), F.col("target")), 8).alias("score"))


_BAG = "list_sum(list_transform(list_distinct(a), lambda v: least(len(list_filter(a, lambda x: x = v)), len(list_filter(b, lambda x: x = v)))))"


@query(rf"""
WITH {TURNS}, w AS (SELECT conv_id, turn, {WORDS.format('source')} AS a, {WORDS.format('target')} AS b FROM turns), o AS (SELECT *, coalesce({_BAG}, 0)::DOUBLE AS o FROM w)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * (o / len(b)) * (o / len(a)) / greatest(o / len(b) + o / len(a), 1e-12) END, 8) AS f1,
       round(CASE WHEN len(a) + len(b) - o > 0 THEN o / (len(a) + len(b) - o) ELSE 1 END, 8) AS jaccard FROM o""")
def bag_scores(spark, d):
    """Multiset F1 and Jaccard of the words of consecutive turns."""
    a, b = words(F.col("source")), words(F.col("target"))
    return turns(spark, d).select("conv_id", "turn", F.round(X.bag_f1(a, b), 8).alias("f1"), F.round(X.bag_jaccard(a, b), 8).alias("jaccard"))


@query()
def numeric_values(spark, d):
    t = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", F.size(X.numeric_tokens(t, False)).alias("numbers"), F.size(X.sign_markers(t, False)).alias("signs"), F.size(S.unit_tokens(t)).alias("units"))


@query()
def structured_spans(spark, d):
    """Span kinds of every document, and the masked text's digest."""
    s = S.spans(F.col("text"))
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(F.array_sort(F.transform(s, lambda x: x["kind"])), ",").alias("kinds"), F.md5(S.mask(F.col("text"))["text"]).alias("masked"))


_BODY = "regexp_replace(text, '[ \\t\\r\\n.!?。！？\"''“”‘’]+$', '')"


def _level(language: str) -> str:
    """SQL of the politeness of a sentence's end."""
    return "CASE " + " ".join(f"WHEN regexp_matches(e, '({x})$') THEN {n}" for n, x in X.REGISTERS[language]) + " ELSE 0 END"


@query(f"SELECT {_level('ko')} AS ko, {_level('ja')} AS ja, count(*) AS n FROM (SELECT {_BODY} AS e FROM conversations) GROUP BY ALL")
def registers(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy(X.register(F.col("text"), "ko").alias("ko"), X.register(F.col("text"), "ja").alias("ja")).agg(F.count("*").alias("n"))


@query()
def degenerate_turns(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(X.degeneration_reasons(F.col("source"), F.col("target")), ",").alias("reasons"))


# quality ------------------------------------------------------------------------------------


@query(rf"""
WITH {TURNS}, c AS (SELECT conv_id, turn, trim(regexp_replace(source, '\s+', ' ', 'g')) AS a, trim(regexp_replace(target, '\s+', ' ', 'g')) AS b FROM turns),
v AS (SELECT *, regexp_replace(a, '\s', '', 'g') AS va, regexp_replace(b, '\s', '', 'g') AS vb, lower(regexp_replace(a, '[^\p{{L}}\p{{N}}]', '', 'g')) AS ka, lower(regexp_replace(b, '[^\p{{L}}\p{{N}}]', '', 'g')) AS kb FROM c),
m AS (SELECT *, greatest(len(va), len(vb)) / greatest(1, least(len(va), len(vb))) AS ratio,
  len(va) >= 12 AND list_max(list_transform(list_distinct(string_split(va, '')), lambda x: len(va) - len(replace(va, x, '')))) / nullif(len(va), 0) >= 0.7 AS ra,
  len(vb) >= 12 AND list_max(list_transform(list_distinct(string_split(vb, '')), lambda x: len(vb) - len(replace(vb, x, '')))) / nullif(len(vb), 0) >= 0.7 AS rb FROM v),
r AS (SELECT conv_id, turn, len(va) < 2 OR len(vb) < 2 AS short, ratio > 5 AS far, ratio > 2.5 AND ratio <= 5 AS wide, ka <> '' AND ka = kb AS same,
  regexp_matches(a || b, '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}]') AS ctl, ra OR rb AS rep FROM m)
SELECT conv_id, turn, concat_ws(',', CASE WHEN short THEN 'too_short' END, CASE WHEN far THEN 'length_ratio' END, CASE WHEN same THEN 'identical_text' END, CASE WHEN ctl THEN 'control_characters' END, CASE WHEN rep THEN 'excessive_repetition' END) AS rejections,
  greatest(0, 100 - 45 * short::INT - 25 * far::INT - 25 * wide::INT - 50 * same::INT - 40 * ctl::INT - 40 * rep::INT) AS score, NOT (short OR far OR same OR ctl OR rep) AS accepted FROM r""")
def pair_quality(spark, d):
    p = quality.Policy(phrases=False, normal=False, spans=False)
    out = quality.assess(turns(spark, d), "source", "target", ("en", "en"), p)
    return out.select("conv_id", "turn", F.array_join("rejections", ",").alias("rejections"), "score", "accepted")


@query()
def pair_quality_full(spark, d):
    """All rules, spans and normal forms included, counted by reason."""
    out = quality.assess(turns(spark, d), "source", "target", ("en", "en"))
    return out.select(F.explode(F.concat("rejections", F.transform("warnings", lambda w: F.concat(F.lit("warn:"), w)))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_UI = r"""\{\s*[$-]?[A-Za-z_][A-Za-z0-9_.:-]*\s*\}|\{\d+\}|%(?:\d+\$)?[A-Za-z]|\$\{[A-Za-z_][A-Za-z0-9_.:-]*\}|</?[A-Za-z][^>]*>|&[A-Za-z][A-Za-z0-9]+;"""
_TAG = "'<' || lower(regexp_extract(x, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) || '>'"
_SLOTS = {c: f"list_sort(list_transform(regexp_extract_all({c}, '{_UI}'), lambda x: replace(CASE WHEN x[1] = '<' THEN {_TAG} ELSE x END, ' ', '')))" for c in "ab"}


@query(rf"""
WITH {TURNS}, m AS (SELECT conv_id, turn, role AS resource, source AS a, target AS b FROM turns JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn)),
r AS (SELECT *, len(a) / greatest(len(b), 1) AS ratio FROM m)
SELECT CASE WHEN a = '' OR b = '' THEN 'empty' WHEN len(a) > 800 OR len(b) > 800 THEN 'too_long' WHEN NOT regexp_matches(a, '[A-Za-z]') OR NOT regexp_matches(b, '[A-Za-z]') THEN 'missing_expected_script'
  WHEN least(len(regexp_replace(a, '[^\p{{L}}\p{{N}}_]', '', 'g')), len(regexp_replace(b, '[^\p{{L}}\p{{N}}_]', '', 'g'))) < 2 THEN 'too_short' WHEN ratio < 0.2 OR ratio > 5 THEN 'length_ratio'
  WHEN {_SLOTS['a']} <> {_SLOTS['b']} THEN 'placeholder_mismatch' WHEN list_sort(regexp_extract_all(a, '\p{{Nd}}+')) <> list_sort(regexp_extract_all(b, '\p{{Nd}}+')) THEN 'number_mismatch'
  WHEN contains(lower(resource), '.key') AND greatest(len(a), len(b)) <= 3 THEN 'access_key' WHEN lower(trim(regexp_replace(a, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(b, '\s+', ' ', 'g'))) THEN 'identical' ELSE 'ok' END AS reason, count(*) AS n
FROM r GROUP BY 1""")
def ui_reasons(spark, d):
    """The first rule of user-interface strings that consecutive turns break; both sides must hold Latin letters here."""
    t = turns(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    reason = quality.ui_reason(F.col("source"), F.col("target"), F.col("role"), ("[A-Za-z]", "[A-Za-z]"))
    return t.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


# leakage ------------------------------------------------------------------------------------------


_GRAMS = """
k AS (SELECT doc_id, regexp_replace(text, '[\\p{P}\\p{S}\\p{Z}\\p{C}]', '', 'g') AS k FROM documents), ik AS (SELECT item_id, regexp_replace(text, '[\\p{P}\\p{S}\\p{Z}\\p{C}]', '', 'g') AS k FROM benchmark),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(k) - 1, 2)), lambda i: substr(k, i, 3)))) AS g FROM k),
ig AS (SELECT item_id, len(gs) AS n, unnest(gs) AS g FROM (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(k) - 1, 2)), lambda i: substr(k, i, 3))) AS gs FROM ik WHERE k <> '')),
h AS (SELECT item_id, doc_id, count(*) AS shared, max(n) AS item_shingles FROM g JOIN ig USING (g) GROUP BY ALL),
l AS (SELECT h.*, shared / item_shingles AS containment, coalesce(contains(k.k, ik.k), false) AS exact FROM h JOIN k USING (doc_id) JOIN ik USING (item_id) WHERE shared / item_shingles >= 0.9)"""


def _found(spark, d):
    return leakage.leaks(table(spark, d, "benchmark"), spread(table(spark, d, "documents")).select("doc_id", "text"), least=0.9, normal=False)


@query(f"WITH {_GRAMS} SELECT item_id, doc_id, shared, item_shingles, round(containment, 8) AS containment, exact FROM l")
def holdout_leaks(spark, d):
    return _found(spark, d).select("item_id", "doc_id", "shared", F.col("item_shingles").cast("long").alias("item_shingles"), F.round("containment", 8).alias("containment"), "exact")


@query(f"WITH {_GRAMS} SELECT item_id, doc_id, rank::BIGINT AS rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY containment DESC, doc_id) AS rank FROM l) WHERE rank <= 5")
def worst_leaks(spark, d):
    return leakage.worst(_found(spark, d), "item_id", "doc_id").select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_GRAMS}, x AS (SELECT DISTINCT item_id FROM l WHERE exact) SELECT (item_id % 4)::VARCHAR AS category, count(*) AS items, count(x.item_id) AS leaked, round(count(x.item_id) / count(*), 8) AS rate, count(x.item_id) > 0 AS failed FROM benchmark LEFT JOIN x USING (item_id) GROUP BY ALL")
def leak_gate(spark, d):
    items = table(spark, d, "benchmark")
    return leakage.leak_summary(items, _found(spark, d).filter("exact"), "item_id", (F.col("item_id") % 4).cast("string"))


@query()
def contamination_rules(spark, d):
    f = leakage.contamination(F.col("source"), F.col("target"), ("ko", "ja"), normal=False)
    return turns(spark, d).select("conv_id", "turn", F.size(f).alias("findings"), leakage.strongest(f)["rule"].alias("rule"))


@query(r"""SELECT doc_id, CASE WHEN (contains(lower(text), 'idiot') OR contains(lower(text), 'clown')) AND (contains(lower(text), 'the') OR contains(lower(text), 'and')) THEN 'flagged' ELSE 'clear' END AS state FROM documents""")
def term_screen(spark, d):
    return table(spark, d, "documents").select("doc_id", leakage.screen(F.col("text"), ("idiot", "clown"), ("the", "and")).alias("state"))


@query(r"""WITH f AS (SELECT lower(text) AS t FROM documents WHERE (contains(lower(text), 'idiot') OR contains(lower(text), 'clown')) AND (contains(lower(text), 'the') OR contains(lower(text), 'and'))),
m AS (SELECT unnest([{'list': 'first', 'marker': 'idiot'}, {'list': 'first', 'marker': 'clown'}, {'list': 'second', 'marker': 'the'}, {'list': 'second', 'marker': 'and'}], recursive := true))
SELECT list, marker, count(*) AS n FROM f JOIN m ON contains(t, marker) GROUP BY ALL""")
def screen_markers(spark, d):
    """How often each marker stands in a flagged document."""
    return leakage.screen_counts(table(spark, d, "documents"), F.col("text"), ("idiot", "clown"), ("the", "and"))


# audits ---------------------------------------------------------------------------------------------


@query(r"""
SELECT source, grouping(source)::INT AS is_total, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 8) AS mean_chars, count_if(len(text) < 100) AS short, CASE WHEN count(DISTINCT lang) <= 3 THEN count(DISTINCT lang) END AS languages
FROM documents GROUP BY GROUPING SETS ((source), ())""")
def stream_audit(spark, d):
    """Counters by source and over all, in one pass."""
    return audit.with_total(table(spark, d, "documents"), "source", F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 8).alias("mean_chars"), F.count_if(F.length("text") < 100).alias("short"), audit.distinct_up_to(F.col("lang"), 3).alias("languages"))


@query("SELECT source, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 8) AS share FROM documents GROUP BY source")
def source_shares(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return per.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(W.partitionBy(F.lit(0))), 8))


@query("SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY lang")
def length_percentiles(spark, d):
    out = table(spark, d, "documents").groupBy("lang").agg(*audit.nearest_rank("n_chars", 0.5, 0.95, 0.99))
    return out.select("lang", *[F.col(c).cast("bigint").alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT lang, a[round_even((n - 1) * 0.1, 0)::INT + 1] AS p10, a[round_even((n - 1) * 0.5, 0)::INT + 1] AS p50, a[round_even((n - 1) * 0.9, 0)::INT + 1] AS p90 FROM (SELECT lang, list_sort(list(n_chars)) AS a, count(*) AS n FROM documents GROUP BY lang)")
def index_percentiles(spark, d):
    return audit.index_percentiles(table(spark, d, "documents"), "n_chars", [0.1, 0.5, 0.9], ["lang"])


@query("SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.1), 6) AS p10 FROM documents GROUP BY lang")
def interpolated_percentiles(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.round(F.percentile("n_chars", 0.1), 6).alias("p10"))


@query()
def approximate_distinct(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.hll_sketch_estimate(F.hll_sketch_agg("text", 14)).alias("texts"))


@query(rf"""
WITH {TURNS}, b AS (SELECT regexp_replace(source, '[0-9]', '#', 'g') AS k, source AS s, target AS t FROM turns), s AS (SELECT s, count(DISTINCT t) AS targets FROM b GROUP BY s)
SELECT count(*) AS rows, count(DISTINCT k) AS skeletons, (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY k)) AS largest, round(count(DISTINCT k) / count(*), 8) AS skeleton_ttr, round((count(*) - count(DISTINCT (s, t))) / count(*), 8) AS duplicate_rate,
  (SELECT round(count_if(targets > 1) / count(*), 8) FROM s) AS conflict_rate, (SELECT max(targets) FROM s) AS max_fan_out FROM b""")
def template_audit(spark, d):
    return audit.template_audit(turns(spark, d), "source", "target")


@query("SELECT skeleton, n FROM (SELECT regexp_replace(url, '[0-9]', '#', 'g') AS skeleton, count(*) AS n FROM pages GROUP BY 1) ORDER BY n DESC, skeleton LIMIT 20")
def top_skeletons(spark, d):
    return audit.top(table(spark, d, "pages"), X.skeleton(F.col("url")), 20, "skeleton")


@query(r"SELECT character, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\s', '', 'g'), '')) AS character FROM documents) WHERE character <> '' GROUP BY 1 HAVING count(*) >= 25")
def required_characters(spark, d):
    return audit.required_characters(spread(table(spark, d, "documents")), F.col("text"))


_TOKENS = f"t AS (SELECT lang, unnest({WORDS.format('text')}) AS token FROM documents), s AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL), voc AS (SELECT DISTINCT token FROM s)"


def _seen(spark, d):
    docs = spread(table(spark, d, "documents"))
    return audit.exposure(docs.withColumn("w", words(F.col("text"))), "w", ["lang"])


@query(f"WITH {_TOKENS}, f AS (SELECT l.lang, v.token, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang FROM s) l CROSS JOIN voc v LEFT JOIN s ON s.lang = l.lang AND s.token = v.token) SELECT lang, sum(n)::BIGINT AS tokens, count_if(n = 0) AS unseen, count_if(n = 1) AS once, count_if(n BETWEEN 1 AND 9) AS under_10, count_if(n BETWEEN 1 AND 24) AS under_25 FROM f GROUP BY lang")
def token_exposure(spark, d):
    """How well each language covers the corpus vocabulary; counts that are absent are zeros, counted not built."""
    seen = _seen(spark, d)
    size = seen.select("token").distinct().agg(F.count("*").alias("vocabulary"))
    n = F.col("n")
    per = seen.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count_if(n == 1).alias("once"), F.count_if(n <= 9).alias("under_10"), F.count_if(n <= 24).alias("under_25"))
    return per.crossJoin(size).select("lang", "tokens", (F.col("vocabulary") - F.col("types")).alias("unseen"), "once", "under_10", "under_25")


@query(f"WITH {_TOKENS} SELECT token, sum(n)::BIGINT AS n FROM s GROUP BY token ORDER BY n, token LIMIT 100")
def lowest_exposure(spark, d):
    return _seen(spark, d).groupBy("token").agg(F.sum("n").alias("n")).orderBy("n", "token").limit(100)


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 8) AS weight, round(n / sum(n) OVER (), 8) AS share, n * 20 < max(n) OVER () AS scarce FROM c")
def language_weights(spark, d):
    out = audit.sampling_weights(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), "n")
    return out.withColumns({"weight": F.round("weight", 8), "share": F.round("share", 8)})


@query("SELECT count_if(source <> 'src0') AS real, count_if(source = 'src0') AS synthetic, greatest(0, floor(count_if(source <> 'src0') * 0.25)::BIGINT - count_if(source = 'src0')) AS budget FROM documents")
def synthetic_budget(spark, d):
    return audit.synthetic_budget(table(spark, d, "documents"), F.col("source") == "src0", 0.25)


@query("WITH p AS (SELECT lang, count(*) AS n FROM documents WHERE source <> 'src0' AND lang <> 'es' GROUP BY lang), l AS (SELECT DISTINCT lang FROM documents) SELECT l.lang, floor(coalesce(p.n, (SELECT avg(n) FROM p)) * 0.5)::BIGINT AS budget FROM l LEFT JOIN p ON p.lang = l.lang")
def monolingual_budgets(spark, d):
    docs = table(spark, d, "documents")
    par = docs.filter("source <> 'src0' AND lang <> 'es'").groupBy("lang").agg(F.count("*").alias("n"))
    return audit.budgets(par, "lang", "n", 0.5, docs.select("lang").distinct())


@query()
def preservation_report(spark, d):
    return audit.preservation(turns(spark, d), "source", "target", ["latin"], normal=False)


# selection --------------------------------------------------------------------------------------------


@query(r"""
WITH r AS (SELECT doc_id, lang, source, sha256('caps' || chr(0) || doc_id::VARCHAR) AS rank FROM documents),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY rank) <= 5)
SELECT doc_id, lang, source FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY rank) <= 60""")
def template_caps(spark, d):
    """At most five rows of a frame, sixty of a style, in seeded order."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return select.frame_caps(docs, ["lang"], ["source"], 60, 5, select.seeded("caps", F.col("doc_id").cast("string")))


@query()
def greedy_span_caps(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.length("text").alias("n"))
    return select.greedy_caps(docs.withColumn("size", F.floor(F.log2(F.col("n") + 1))), ["size"], 2, select.seeded("greedy", F.col("doc_id").cast("string")), ["lang", "source"])


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def best_per_source(spark, d):
    return select.best_of(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")])


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 10)")
def fan_out_filter(spark, d):
    return dedup.low_fan_out(table(spark, d, "events").select("event_id", "user_id"), "user_id", 10)


@query("SELECT lang, source, doc_id, rank::BIGINT AS rank FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3")
def report_examples(spark, d):
    return select.examples(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], [F.col("doc_id")]).withColumn("rank", F.col("rank").cast("long"))


_MINED = rf"""{TURNS}, w AS (SELECT list_distinct(list_filter({WORDS.format('source')}, lambda x: len(x) >= 7)) AS a, list_distinct(list_filter({WORDS.format('target')}, lambda x: len(x) >= 7)) AS b FROM turns),
ns AS (SELECT s, count(*) AS n_s FROM (SELECT unnest(a) AS s FROM w) GROUP BY s), nt AS (SELECT t, count(*) AS n_t FROM (SELECT unnest(b) AS t FROM w) GROUP BY t),
j AS (SELECT s, t, count(*) AS together FROM (SELECT s, unnest(b) AS t FROM (SELECT unnest(a) AS s, b FROM w)) GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT s, t, j.together, n_s, n_t, 2.0 * j.together / (n_s + n_t) AS dice FROM j JOIN ns USING (s) JOIN nt USING (t))"""


def _mined(spark, d):
    long = lambda c: F.filter(words(F.col(c)), lambda x: F.length(x) >= 7)
    return select.term_pairs(turns(spark, d).select(long("source").alias("a"), long("target").alias("b")), "a", "b")


@query(f"WITH {_MINED} SELECT s, t, together, n_s, n_t, round(dice, 8) AS dice FROM m")
def term_mining(spark, d):
    return _mined(spark, d).withColumn("dice", F.round("dice", 8))


@query(f"WITH {_MINED}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY dice DESC, together DESC, t) AS x, row_number() OVER (PARTITION BY t ORDER BY dice DESC, together DESC, s) AS y, lead(dice) OVER (PARTITION BY s ORDER BY dice DESC, together DESC, t) AS nxt FROM m) SELECT s, t, round(dice, 8) AS dice FROM r WHERE x = 1 AND y = 1 AND dice - coalesce(nxt, -1.0) > 0")
def mutual_best_terms(spark, d):
    return select.mutual_best(_mined(spark, d)).select("s", "t", F.round("dice", 8).alias("dice"))


@query(r"""
WITH c AS (SELECT conv_id, turn, len(regexp_replace(text, '\s', '', 'g')) AS n, first_value(len(regexp_replace(text, '\s', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations),
s AS (SELECT conv_id, turn, exp(-abs(ln((n + 1) / (f + 1)))) AS score FROM c WHERE turn > 0)
SELECT conv_id, turn, round(score, 8) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 10) DESC, turn) = 1""")
def rerank_turns(spark, d):
    """Of the later turns of a conversation the one whose length is nearest to the first's."""
    t = table(spark, d, "conversations")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    out = select.rerank(t.filter("turn > 0").join(first, "conv_id"), "conv_id", F.round(X.length_score(F.col("first"), F.col("text")), 10), "turn")
    return out.select("conv_id", "turn", F.round("score", 8).alias("score"))


@query()
def greedy_matching(spark, d):
    """Terms of turns matched one to one by their Dice scores, ties by a seeded hash."""
    from .sources.checkpoints import ensure

    ensure(spark)
    return select.unique_matching(_mined(spark, d).select("s", "t", "dice"), "s", "t", "dice", select.seeded("matching", F.col("s"), F.col("t")))


@query()
def budget_sample(spark, d):
    return select.sample_to_budget(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), 100, "budget").select("doc_id")


@query(r"""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
s AS (SELECT vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id)
SELECT vec_id, round(cosine, 6) AS cosine, cosine >= 0.1 AS kept FROM s""")
def semantic_filter(spark, d):
    """Cosine with the mean vector of its label; rows under a threshold go."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    s = e.join(mean, ["label", "i"]).groupBy("vec_id").agg((F.sum(F.col("x") * F.col("m")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("m") * F.col("m"))))).alias("c"))
    return s.select("vec_id", F.round("c", 6).alias("cosine"), (F.col("c") >= 0.1).alias("kept"))


# joins, coverage, reports ----------------------------------------------------------------------------------


@query("SELECT d.lang, l.quality, count(*) AS n, sum(l.toxic)::BIGINT AS toxic FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def id_join(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("toxic"))


@query("SELECT doc_id AS id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1")
def system_coverage(spark, d):
    return evaluate.coverage(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("WITH p AS (SELECT event_type, sum(value) AS s, count(value) AS n FROM events GROUP BY 1) SELECT round(avg(s / n), 6) AS macro, round(min(s / n), 6) AS worst, round(sum(s), 4) AS total, sum(n)::BIGINT AS rows FROM p")
def macro_scores(spark, d):
    out = evaluate.macro(table(spark, d, "events"), "event_type", "value")
    return out.select(F.round("macro", 6).alias("macro"), F.round("worst", 6).alias("worst"), F.round("total", 4).alias("total"), "rows")


@query()
def chrf_scores(spark, d):
    return evaluate.chrf(turns(spark, d), "target", "source", [])


@query(rf"""
WITH {TURNS}, w AS (SELECT list_slice(list_sort(list_distinct(list_filter({WORDS.format('source')}, lambda x: len(x) >= 9))), 1, 3) AS terms, target FROM turns), h AS (SELECT len(terms) AS n, len(list_filter(terms, lambda t: contains(target, t))) AS h FROM w WHERE len(terms) > 0)
SELECT round(sum(h) / sum(n), 8) AS term_rate, round(count_if(n = h) / count(*), 8) AS sentence_rate FROM h""")
def glossary_adherence(spark, d):
    terms = F.slice(F.array_sort(F.array_distinct(F.filter(words(F.col("source")), lambda x: F.length(x) >= 9))), 1, 3)
    out = evaluate.adherence(turns(spark, d).withColumn("terms", terms), "target", "terms")
    return out.select(F.round("term_rate", 8).alias("term_rate"), F.round("sentence_rate", 8).alias("sentence_rate"))


# sources and queue -----------------------------------------------------------------------------------------------


@query("SELECT 'ok' AS status, count(*) AS n, count(DISTINCT json_keys(props)) AS shapes FROM events WHERE json_valid(props)")
def json_status(spark, d):
    e = table(spark, d, "events").filter("props IS NOT NULL")
    return e.groupBy(readers.status(F.col("props")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct(F.json_object_keys("props")).alias("shapes"))


@query()
def record_expansion(spark, d):
    """JSON records of consecutive turns, expanded to pairs again."""
    line = F.to_json(F.struct(F.col("source").alias("en"), F.col("target").alias("de"), F.struct(F.lit("chat").alias("domain")).alias("metadata")))
    x = turns(spark, d).select(readers.pairs_of(line, [("en", "de")]).alias("x"))
    return x.select(F.inline("x.pairs")).groupBy("lang_a", "lang_b", "metadata").agg(F.count("*").alias("n"))


@query()
def page_text(spark, d):
    p = table(spark, d, "pages").select("page_id", readers.visible_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query()
def text_segments(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(readers.segments(F.col("text"))).alias("i", "segment"))
    return s.groupBy("doc_id").agg(F.count("*").alias("segments"), F.max(F.length("segment")).alias("longest"))


@query("""
SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'error' WHEN role = 'system' THEN 'skipped_existing' WHEN len(text) <= 400 THEN 'accepted' ELSE 'rejected' END AS result_status, count(*) AS n FROM conversations GROUP BY 1""")
def queue_outcomes(spark, d):
    """The queue's step on a batch: parse, skip what is done, gate the rest."""
    c = table(spark, d, "conversations")
    line = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("en").alias("source_lang"), F.lit("de").alias("target_lang"), F.col("text").alias("source"), F.when(F.col("role") == "system", F.col("text")).alias("translation")))
    gate = lambda df: df.withColumn("reasons", F.array_compact(F.array(F.when(F.length("source") > 400, F.lit("too_long")))))
    return queue.outcome(queue.parsed(c.select(line.alias("value"))), gate).groupBy("result_status").agg(F.count("*").alias("n"))


# shards: gates and verified joins ---------------------------------------------------------------------------------


_QUOTE = "[\"“‘''][^\"”’'']{1,120}[\"”’'']"


@query(rf"""
WITH {TURNS}, c AS (SELECT trim(regexp_replace(source, '\s+', ' ', 'g')) AS s, trim(regexp_replace(target, '\s+', ' ', 'g')) AS t FROM turns),
g AS (SELECT *, regexp_replace(regexp_replace(s, '{_QUOTE}', '<Q>', 'g'), '\p{{Nd}}', '#', 'g') AS k, ('0x' || substr(sha256(s), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.2 AS held,
      regexp_matches(s, '[\x{{400}}-\x{{52F}}\x{{370}}-\x{{3FF}}\x{{600}}-\x{{6FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7A3}}]') AS fs, regexp_matches(t, '[\x{{400}}-\x{{52F}}\x{{370}}-\x{{3FF}}\x{{600}}-\x{{6FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7A3}}]') AS ft FROM c WHERE s <> '' AND t <> ''),
w AS (SELECT count(*) AS usable, count(DISTINCT s) AS sources, count(DISTINCT k) AS skeletons, count_if(held) AS held_out, count_if(held AND k IN (SELECT k FROM g WHERE NOT held)) AS leaked, count_if(fs) AS fs, count_if(ft) AS ft FROM g),
q AS (SELECT count(*) AS quoted, count(DISTINCT q) AS quoted_unique FROM (SELECT unnest(regexp_extract_all(s, '{_QUOTE}')) AS q FROM g)), d AS (SELECT count_if(n > 1) AS conflicting, max(n) AS max_targets FROM (SELECT count(DISTINCT t) AS n FROM g GROUP BY s)),
r AS (SELECT (SELECT count(*) FROM c) AS rows, (SELECT count(*) FROM c) - usable AS unreadable, sources, skeletons, quoted, quoted_unique, max_targets, held_out, round(skeletons / usable, 8) AS skeleton_ttr, CASE WHEN quoted > 0 THEN round(quoted_unique / quoted, 8) ELSE 1.0 END AS quoted_ttr,
      round((usable - sources) / usable, 8) AS duplicate_source, round(conflicting / sources, 8) AS conflicting_source, round(fs / usable, 8) AS foreign_source, round(ft / usable, 8) AS foreign_target, CASE WHEN held_out > 0 THEN round(leaked / held_out, 8) ELSE 0.0 END AS skeleton_leak FROM w, q, d)
SELECT *, concat_ws(',', CASE WHEN skeleton_ttr < 0.5 THEN 'skeleton_ttr' END, CASE WHEN quoted_ttr < 0.05 THEN 'quoted_ttr' END, CASE WHEN duplicate_source > 0.1 THEN 'duplicate_source' END, CASE WHEN conflicting_source > 0.02 THEN 'conflicting_source' END,
  CASE WHEN foreign_target > 0.02 THEN 'foreign_target' END, CASE WHEN skeleton_leak > 0.1 THEN 'skeleton_leak' END) AS violations FROM r""")
def generated_audit(spark, d):
    """Consecutive turns judged as a generated shard: frames, quotes, repeats, scripts, frames on both sides of a split."""
    out = shards.generated_audit(turns(spark, d), "source", "target", ["latin"], ["latin"], validation=0.1, test=0.1)
    return out.withColumn("violations", F.array_join("violations", ","))


@query(rf"""
WITH {TURNS}, c AS (SELECT conv_id, turn, trim(regexp_replace(source, '\s+', ' ', 'g')) AS s, trim(regexp_replace(target, '\s+', ' ', 'g')) AS t,
  CASE WHEN (conv_id + turn) % 17 <> 0 THEN round(exp(-abs(ln((len(regexp_replace(target, '\s', '', 'g')) + 1) / (len(regexp_replace(source, '\s', '', 'g')) + 1)))), 8) END AS score FROM turns),
n AS (SELECT s, count(*) AS n FROM c WHERE score IS NOT NULL GROUP BY s), e AS (SELECT c.*, CASE WHEN score IS NULL THEN 'missing_score' WHEN n > 3 THEN 'fan_out' WHEN score < 0.3 THEN 'below_threshold' END AS early FROM c LEFT JOIN n USING (s)),
r AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY early IS NULL, s ORDER BY score DESC, sha256('recover' || chr(0) || s || chr(0) || t)) END AS k FROM e)
SELECT coalesce(early, CASE WHEN k > 1 THEN 'duplicate_source' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def recovery_select(spark, d):
    """The best-scored target of each source; every other row with its reason."""
    t = turns(spark, d).withColumn("score", F.when((F.col("conv_id") + F.col("turn")) % 17 != 0, F.round(X.length_score(F.col("source"), F.col("target")), 8)))
    out = shards.recovery_select(t, "source", "target", "score", 0.3, most_targets=3, unique_target=False)
    return out.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT conv_id, turn // 2 AS k, text FROM conversations WHERE role <> 'assistant'), b AS (SELECT conv_id, turn // 2 AS k, text FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id FROM (SELECT conv_id, list_sort(list(DISTINCT k)) AS ks FROM a GROUP BY conv_id) x JOIN (SELECT conv_id, list_sort(list(DISTINCT k)) AS ks FROM b GROUP BY conv_id) y USING (conv_id, ks))
SELECT conv_id, k, md5(a.text) AS a, md5(b.text) AS b FROM a JOIN b USING (conv_id, k) WHERE conv_id IN (SELECT conv_id FROM g) AND conv_id % 10 <> 0""")
def aligned_turns(spark, d):
    """Turns joined by number, only in conversations that number both sides alike; some conversations are left out."""
    c = table(spark, d, "conversations").withColumn("k", F.floor(F.col("turn") / 2))
    out = shards.aligned(c.filter("role <> 'assistant'"), c.filter("role = 'assistant'"), "conv_id", "k", excluded=F.col("conv_id") % 10 == 0)
    return out.select("conv_id", "k", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query("""
WITH j AS (SELECT l_orderkey AS k, list({'i': l_linenumber % 3, 'g': l_quantity::INT % 6, 's': l_suppkey % 3, 'x': l_partkey % 3, 't': CASE WHEN l_returnflag = 'N' THEN 'target' ELSE 'other' END}) AS j FROM lineitem GROUP BY 1)
SELECT count_if(ok) AS passed, count(*) AS n FROM (SELECT len(j) >= 2 AND len(list_filter(j, lambda x: x.i IN (1, 2))) >= 2 AND list_median(list_transform(j, lambda x: x.g)) >= 3 AND list_median(list_transform(j, lambda x: x.s)) >= 1
  AND len(list_filter(j, lambda x: x.t = 'target')) >= 2 AND (k % 2 = 0 OR len(list_filter(j, lambda x: x.x IN (1, 2))) >= 2) AS ok FROM j)""")
def judgment_gate(spark, d):
    """Records that most judgments let pass, medians included."""
    li = table(spark, d, "lineitem")
    one = F.struct(
        (F.col("l_linenumber") % 3).alias("intent_score"), (F.col("l_quantity").cast("int") % 6).alias("grammar_score"), (F.col("l_suppkey") % 3).alias("spelling_score"), (F.col("l_partkey") % 3).alias("slots_score"),
        F.when(F.col("l_returnflag") == "N", "target").otherwise("other").alias("language_identification"),
    )
    j = li.groupBy("l_orderkey").agg(F.collect_list(one).alias("j"))  # a few lines an order
    return j.select(shards.judged(F.col("j"), F.col("l_orderkey") % 2 == 1).alias("ok")).agg(F.count_if("ok").alias("passed"), F.count("*").alias("n"))


@query("SELECT lang, 'not_configured' AS state FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) WHERE lang NOT IN ('en', 'de', 'ko') UNION ALL SELECT x, 'without_data' FROM (VALUES ('en'), ('de'), ('ko')) t(x) WHERE x NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def language_presence(spark, d):
    """Configured languages without data, and languages of the data that are not configured."""
    have = table(spark, d, "documents").filter("lang IS NOT NULL").select("lang")
    return shards.presence(spark.createDataFrame([("en",), ("de",), ("ko",)], "lang string"), have, "lang")


@query("SELECT doc_id, lang, CASE WHEN l.quality = 0 THEN 'low' ELSE source END AS source, l.doc_id IS NOT NULL AND l.quality = 0 AS was_corrected FROM documents LEFT JOIN (SELECT * FROM labels WHERE quality = 0) l USING (doc_id)")
def corrected_rows(spark, d):
    """Rows with the corrections of their id."""
    new = table(spark, d, "labels").filter("quality = 0").select("doc_id", F.lit("low").alias("source"))
    return shards.corrected(table(spark, d, "documents").select("doc_id", "lang", "source"), new, "doc_id", ["source"])


@query("SELECT count(*) AS left_over FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def removed_ids(spark, d):
    """How many rows are still there that were to be removed."""
    gone = table(spark, d, "labels").filter("toxic = 1")
    return shards.still_there(table(spark, d, "documents"), gone, "doc_id").agg(F.count("*").alias("left_over"))


@query("SELECT lang, source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 4")
def first_per_direction(spark, d):
    return shards.first_per_direction(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], ["doc_id"], 4)


# pieces ----------------------------------------------------------------------------------------------------------


def _pieces(c):
    """Words as pieces; a word of one ASCII letter stands as its byte."""
    return F.transform(words(c), lambda w: F.when(w.rlike("^[a-z]$"), F.concat(F.lit("<0x"), F.hex(w), F.lit(">"))).otherwise(w))


_PIECES = "list_transform(" + WORDS + ", lambda w: CASE WHEN regexp_matches(w, '^[a-z]$') THEN '<0x' || hex(w) || '>' ELSE w END)"
_SEEN = f"""{TURNS}, p AS (SELECT turn % 2 = 0 AS e, {_PIECES.format('source')} AS a, {_PIECES.format('target')} AS b FROM turns), d AS (SELECT CASE WHEN e THEN 'user-reply' ELSE 'reply-user' END AS direction, unnest(b) AS token FROM p
  UNION ALL SELECT CASE WHEN e THEN 'reply-user' ELSE 'user-reply' END, unnest(a) FROM p)"""


def _directions(spark, d):
    even = F.col("turn") % 2 == 0
    t = turns(spark, d).select(F.when(even, "user").otherwise("reply").alias("a"), F.when(even, "reply").otherwise("user").alias("b"), _pieces(F.col("source")).alias("x"), _pieces(F.col("target")).alias("y"))
    return tokens.by_direction(t, "a", "b", "x", "y")


@query(f"WITH {_SEEN} SELECT direction, token, count(*) AS n FROM d GROUP BY ALL")
def direction_exposure(spark, d):
    """How often each piece is a target, by direction."""
    return _directions(spark, d)


@query(f"WITH {_SEEN} SELECT direction, count(*) AS tokens, count_if(token LIKE '<0x__>') AS byte_tokens, round(count_if(token LIKE '<0x__>') / count(*), 8) AS byte_rate, round(count_if(token LIKE '<0x__>') / count(*), 8) <= 0.02 AS passed FROM d GROUP BY direction")
def byte_fallback(spark, d):
    return tokens.byte_fallback(_directions(spark, d), ["direction"], most=0.02)


@query(f"""
WITH {_SEEN}, a AS (SELECT token, count(*) AS n FROM d GROUP BY token), m AS (SELECT token, count(*) AS n FROM (SELECT unnest({_PIECES.format('text')}) AS token FROM documents WHERE lang = 'en') GROUP BY token),
f AS (SELECT coalesce(a.n, 0) AS p, coalesce(a.n, 0) + coalesce(m.n, 0) AS t FROM a FULL JOIN m USING (token))
SELECT count(*) AS pieces, count_if(p < 25 AND t >= 25) AS rescued, count_if(t < 25) AS rare, sum(t)::BIGINT AS total FROM f""")
def stage_exposure(spark, d):
    """Pieces over parallel and monolingual text: rescued by the second, still rare with both."""
    par = _directions(spark, d).groupBy("token").agg(F.sum("n").alias("n"))
    mono = table(spark, d, "documents").filter("lang = 'en'").select(F.explode(_pieces(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.both_stages(par, mono).agg(F.count("*").alias("pieces"), F.count_if("rescued").alias("rescued"), F.count_if("rare").alias("rare"), F.sum("total").alias("total"))


@query(f"WITH {TURNS} SELECT conv_id, turn FROM turns WHERE len({WORDS.format('source')}) <= 60 AND len({WORDS.format('target')}) <= 60")
def token_length_gate(spark, d):
    t = turns(spark, d).select("conv_id", "turn", words(F.col("source")).alias("a"), words(F.col("target")).alias("b"))
    return tokens.within_length(t, ["a", "b"], 60).select("conv_id", "turn")


@query(rf"""
WITH p AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS piece FROM documents),
c AS (SELECT piece, regexp_matches(piece, '\p{{Latin}}')::INT AS l, regexp_matches(piece, '\p{{Nd}}')::INT AS d, regexp_matches(piece, '[^\p{{Latin}}\p{{Nd}}]')::INT AS o FROM p WHERE NOT regexp_matches(piece, '[\x{{AC00}}-\x{{D7A3}}\x{{1100}}-\x{{11FF}}\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{3040}}-\x{{30FF}}\x{{31F0}}-\x{{31FF}}]'))
SELECT CASE WHEN piece = '' OR (piece[1] = '<' AND piece[-1] = '>') THEN 'special' WHEN l + d + o > 1 THEN 'mixed' WHEN l = 1 THEN 'latin' WHEN d = 1 THEN 'digit' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY 1""")
def piece_classes(spark, d):
    p = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("piece")).distinct()
    return p.groupBy(tokens.piece_class(F.col("piece")).alias("class")).agg(F.count("*").alias("n"))


@query()
def bleu_scores(spark, d):
    """Corpus BLEU of consecutive turns by turn, and by characters."""
    t = turns(spark, d).withColumn("late", F.col("turn") >= 4)
    a = evaluate.bleu(t, "target", "source", ["late"])
    return a.join(evaluate.bleu(t, "target", "source", ["late"], characters=True).select("late", F.col("bleu").alias("by_character")), "late")


@query()
def queue_forward_gate(spark, d):
    """Reasons for which a queue would reject the reply to a turn as its translation, counted."""
    t = turns(spark, d).withColumnRenamed("target", "translation")
    out = queue.forward_reasons(t, ("en", "en"))
    return out.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


# extensions: the plain DataFrame surface ----------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_hourly(spark, d):
    return queue.windowed(table(spark, d, "events")).withColumn("value", F.round("value", 4))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_orders(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
