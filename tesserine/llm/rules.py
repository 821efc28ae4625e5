"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules reject a text outright. Beyond them, each rule compares one measure with a cutoff from
a fixed grid. Cutoffs are learnt for each stratum (language) from labelled documents that pass
the base rules: on the good ones, the number of false rejections at a cutoff is binomial, and a
cutoff is certified if its exact binomial tail P(Bin(n, alpha / rules) <= k) is at most
delta / (strata * rules). Within a rule the grid is tested in a fixed order, loosest first, and
testing stops at the first failure (fixed-sequence testing, which needs no further correction);
across rules and strata the level is divided (Bonferroni). With probability 1 - delta, no stratum
then loses more than a share ``alpha`` of its good documents to these rules. Of the certified
cutoffs, a rule takes the one with most rejected bad documents less ten times its rejected good
ones, the loosest on ties, and none if no cutoff gains anything. A stratum with too few labels to
certify anything rejects by the base rules only. The bound counts independent trials, so exact copies of
a text in a stratum are one trial, good if any label of any copy says so.

Only sums by stratum reach the driver: one row for each stratum that has enough labels to certify a
cutoff at all, which is some 1,400 texts each.

Nulls and edge cases: a null text has no words and fails the base rules; a null language is the
stratum of the empty string; a document with several labels counts as good if any says so; labels
without quality do not count; repeated rows are judged alike; an empty table gives no rows, and
empty labels give the base rules; only the named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import WS, WS_CHARS, scratch, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ALPHA, DELTA = 0.02, 0.05
#: Rejected bad documents that outweigh one rejected good document.
GOOD_WEIGHT = 10

#: name: (expression over the measures, whether it rejects above the cutoff, cutoffs loosest first)
RULES: dict[str, tuple[str, bool, list[float]]] = {
    "symbols": ("1000.0 * n_symbols / greatest(word_chars, 1)", True, [400, 300, 200, 150, 100, 70, 50, 35, 25, 15, 10]),
    "dup_lines": ("1000.0 * n_dup_lines / greatest(n_words, 1)", True, [150, 100, 70, 50, 35, 25, 15, 10, 5]),
    "repeats": ("1000.0 * n_repeat_words / greatest(n_words, 1)", True, [480, 450, 400, 350, 300, 250, 200, 150, 100]),
    "bangs": ("1000.0 * n_bangs / greatest(n_words, 1)", True, [1000, 700, 500, 300, 200, 100, 50]),
    "long_words": ("1.0 * word_chars / greatest(n_words, 1)", True, [40, 30, 20, 16, 13, 11, 10]),
    "short_words": ("1.0 * word_chars / greatest(n_words, 1)", False, [1.2, 1.5, 2, 2.5, 3, 3.5, 4]),
}


def _count(text: Column, sign: str) -> Column:
    """Occurrences of an ASCII sign: bytes lost when it is taken out."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the measures of every whole text.

    Three-word windows are compared by 64-bit hashes within one text. Only texts with an equal
    pair of windows sort them; covered words are then summed from the windows' sorted places.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("_t"))
    trimmed = F.btrim("_t", F.lit(WS_CHARS))
    df = df.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS)))
    df = df.withColumn("text_key", F.xxhash64("_t")).withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, n = F.col("_w"), F.size("_w")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_h", F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>")))

    def same(s, e, i):
        return F.coalesce(F.get(s, i)["h"] == e["h"], F.lit(False))

    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    again = F.transform(F.array(placed), lambda s: F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)))[0]
    places = F.sort_array(F.transform(again, lambda e: e["p"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
    )["n"]
    repeats = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0)).otherwise(covered)
    return df.select(
        "doc_id",
        "stratum",
        "text_key",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        reduce(lambda a, b: a + b, [_count(F.col("_t"), s) for s in SYMBOLS]).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        _count(F.col("_t"), "!").cast("long").alias("n_bangs"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from the largest term down."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(min(k, n), -1, -1)))


def rejects(rule: str, cutoff: float) -> Column:
    """Whether a row of measures fails a rule at a cutoff."""
    value, above, _ = RULES[rule]
    return F.expr(value) > F.lit(float(cutoff)) if above else F.expr(value) < F.lit(float(cutoff))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """{rule: {stratum: cutoff}} of the certified and useful cutoffs; labels: doc_id, quality."""
    share = alpha / len(RULES)
    least = math.ceil(math.log(delta / len(RULES)) / math.log1p(-share))  # labels below which nothing can be certified
    quality = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = measured.filter(~F.col("base_failed")).join(quality, "doc_id")
    one = [c for c in measured.columns if c not in ("doc_id", "stratum", "text_key", "base_failed")]
    known = known.groupBy("stratum", "text_key").agg(F.max("quality").alias("quality"), *[F.max(c).alias(c) for c in one])
    good = (F.col("quality") > 0).cast("long")
    sums = [F.sum(good).alias("n")]
    for rule, (_, _, grid) in RULES.items():
        for j, cut in enumerate(grid):
            hit = rejects(rule, cut).cast("long")
            sums += [F.sum(hit * good).alias(f"{rule}_g{j}"), F.sum(hit * (1 - good)).alias(f"{rule}_b{j}")]
    rows = known.groupBy("stratum").agg(*sums).filter(F.col("n") >= least).collect()
    level = delta / (max(1, len(rows)) * len(RULES))
    found: dict[str, dict[str, float]] = {r: {} for r in RULES}
    for row in rows:
        for rule, (_, _, grid) in RULES.items():
            best = 0
            for j, cut in enumerate(grid):
                k = row[f"{rule}_g{j}"]
                if tail(k, row["n"], share) > level:
                    break
                gain = row[f"{rule}_b{j}"] - GOOD_WEIGHT * k
                if gain > best:
                    best, found[rule][row["stratum"]] = gain, float(cut)
    return found


def verdict(found: dict[str, dict[str, float]]) -> Column:
    """Whether any learnt cutoff rejects a row of measures."""
    out = F.lit(False)
    for rule, by in found.items():
        if by:
            cut = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col("stratum")]
            value, above, _ = RULES[rule]
            out = out | F.coalesce(F.expr(value) > cut if above else F.expr(value) < cut, F.lit(False))
    return out


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    measured = scratch(measures(table(spark, sf_dir, "documents")), "measures")
    found = cutoffs(measured, table(spark, sf_dir, "labels"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~verdict(found)).alias("kept"),
    )


def _oracle() -> str:
    """DuckDB SQL for op1's rows, with the rules spelled out."""
    ws = r"[^\x20\x09-\x0D]"
    rules = " UNION ALL ".join(
        f"SELECT rid, tid, stratum, quality, '{r}' rule, {j} j, CAST({float(c)} AS DOUBLE) cut, ({v} {'>' if up else '<'} {float(c)}) hit, {v} val FROM m LEFT JOIN q USING (doc_id) WHERE NOT base_failed"
        for r, (v, up, grid) in RULES.items() for j, c in enumerate(grid)
    )
    n, share = len(RULES), ALPHA / len(RULES)
    least = math.ceil(math.log(DELTA / n) / math.log1p(-share))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, coalesce(lang, '') stratum, coalesce(text, '') t,
  regexp_extract_all(coalesce(text, ''), '{ws}+') w FROM documents),
x AS (SELECT rid, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) c FROM x),
p AS (SELECT rid, count(DISTINCT pos) n FROM (SELECT rid, unnest([i, i + 1, i + 2]) pos FROM g WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{ws}')) ls FROM d),
m0 AS (SELECT d.rid, min(d.rid) OVER (PARTITION BY stratum, t) tid, doc_id, stratum, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars,
  CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) n_repeat_words,
  length(t) - length(replace(t, '!', '')) n_bangs
  FROM d JOIN l USING (rid) LEFT JOIN p USING (rid)),
m AS MATERIALIZED (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) base_failed FROM m0),
q AS (SELECT doc_id, max(quality) quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
r AS MATERIALIZED ({rules}),
o AS (SELECT stratum, tid, rule, j, cut, bool_or(hit) hit, max(quality) quality FROM r WHERE quality IS NOT NULL GROUP BY ALL),
s AS (SELECT stratum, rule, j, cut, count(*) FILTER (quality > 0) n, count(*) FILTER (quality > 0 AND hit) k,
  count(*) FILTER (quality <= 0 AND hit) b FROM o GROUP BY ALL),
e AS (SELECT *, {DELTA} / ({n} * (SELECT count(DISTINCT stratum) FROM s WHERE n >= {least})) lvl,
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) tail
  FROM s WHERE n >= {least}),
c AS (SELECT *, bool_and(tail <= lvl) OVER (PARTITION BY stratum, rule ORDER BY j) ok FROM e),
b AS (SELECT stratum, rule, arg_max(j, (b - {GOOD_WEIGHT} * k) * 1000 - j) j FROM c WHERE ok AND b - {GOOD_WEIGHT} * k > 0 GROUP BY ALL),
h AS (SELECT rid, bool_or(hit) bad FROM r JOIN b USING (stratum, rule, j) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, false) kept FROM m LEFT JOIN h USING (rid)
"""


ORACLE_SQL = {"op1_risk_controlled_rules": _oracle()}
