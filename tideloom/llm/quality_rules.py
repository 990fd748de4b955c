"""Quality rules with risk-controlled thresholds, native SQL only.

Features are computed in each row (no explode, no shuffle of text). Cutoffs come from labelled holdouts. All rules tighten together
along one fixed path of levels; at a level a document is rejected if any rule is over its cutoff there, so the union of the rules
is what is tested. For every stratum the levels are tested from the most lenient one on, by the exact binomial tail
P(X <= k | n, eps) of the clean documents that the level would reject; testing stops at the first level that isn't
shown to reject less than ``eps`` of them (fixed-sequence testing), and alpha is divided by the number of strata
(Bonferroni). So with probability 1 - alpha no stratum loses more than ``eps`` of its clean documents to all rules together. A
stratum needs ln(alpha / strata) / ln(1 - eps) clean labels, 217 for four strata, before even a level that rejects none of them
passes; with fewer it has no level and only the base rule rejects.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows of three words are compared by a 64-bit hash inside one document.

Defined results: null or empty text counts no words and fails the base rule; a null stratum is a stratum of its own, apart from ''; repeated
rows are all returned; unlabelled tables reject by the base rule only; input columns stay, equal names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_side

WS = r"[\\x20\\x09-\\x0D]+"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rule: (expression over the features, cutoffs from lenient to strict, one a level). A document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.5, 0.45, 0.4, 0.35, 0.3, 0.275, 0.25]),
    "long_words": ("word_chars / greatest(n_words, 1)", [20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
}
EPS, ALPHA = 0.02, 0.05


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word), all long."""
    d = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    d = d.withColumn("_qr_t", F.expr(f"coalesce(`{text}`, '')"))
    d = d.withColumn("_qr_trim", F.expr(r"trim(BOTH ' \t\n\u000B\u000C\r' FROM _qr_t)"))
    d = d.withColumn("_qr_w", F.expr(f"CASE WHEN _qr_trim = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(_qr_trim, '{WS}') END"))
    d = d.withColumn("_qr_lines", F.expr("filter(split(_qr_t, '\n'), l -> trim(BOTH ' \\t\\u000B\\u000C\\r' FROM l) <> '')"))
    d = d.withColumn("_qr_h", F.expr("CASE WHEN size(_qr_w) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_qr_w) - 3), i -> xxhash64(_qr_w[i], _qr_w[i + 1], _qr_w[i + 2])) END"))
    keep = [c for c in df.columns if c not in (*FEATURES, "n_lines")]
    d = d.select(
        *[F.col(f"`{c}`") for c in keep],
        F.expr("CAST(size(_qr_w) AS BIGINT)").alias("n_words"),
        F.expr("CAST(length(array_join(_qr_w, '')) AS BIGINT)").alias("word_chars"),
        F.expr("CAST(length(_qr_t) - length(regexp_replace(_qr_t, '[#*$%&|<>]+', '')) AS BIGINT)").alias("n_symbols"),
        F.expr("CAST(size(_qr_lines) - size(array_distinct(_qr_lines)) AS BIGINT)").alias("n_dup_lines"),
        F.expr("CAST(size(_qr_lines) AS BIGINT)").alias("n_lines"),
        # sorted (hash, place) pairs of documents in which some window repeats
        F.expr("CASE WHEN size(_qr_h) > size(array_distinct(_qr_h)) THEN sort_array(transform(_qr_h, (h, i) -> struct(h AS h, i AS i))) END").alias("_qr_s"),
    )
    d = d.withColumn("_qr_p", F.expr("sort_array(transform(filter(_qr_s, (x, k) -> x.h = get(_qr_s, k - 1).h OR x.h = get(_qr_s, k + 1).h), x -> x.i))"))
    # windows at places p cover [p, p + 2]; each adds what the next one doesn't
    d = d.withColumn("n_repeat_words", F.expr("CAST(coalesce(aggregate(transform(_qr_p, (x, k) -> least(3, coalesce(get(_qr_p, k + 1), x + 3) - x)), 0, (a, x) -> a + x), 0) AS BIGINT)"))
    return d.drop("_qr_s", "_qr_p").select(*keep, *FEATURES, "n_lines")


def base_failed():
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def within(rules: dict = RULES):
    """How many levels, from the most lenient one, a document is within: cutoffs fall, so the next ones reject it."""
    per = [F.expr(f"size(filter(array({','.join(map(str, cuts))}), c -> {e} <= c))") for e, cuts in rules.values()]
    return F.least(*per) if len(per) > 1 else per[0]


def select_cutoffs(features: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", stratum: str = "lang", rules: dict = RULES, eps: float = EPS, alpha: float = ALPHA) -> DataFrame:
    """One row (stratum, level, n, k, cutoffs) for each stratum that has a level; k of its n clean documents are rejected there."""
    lab = features.join(labels.where(F.col(good) == 1).select(key).distinct(), key, "left_semi")
    hist = lab.select(F.col(stratum).cast("string").alias("stratum"), within(rules).alias("within")).groupBy("stratum", "within").agg(F.count("*").alias("c"))
    per = materialize(hist.groupBy("stratum").agg(F.sum("c").alias("n"), F.collect_list(F.struct("within", "c")).alias("hs")), "strata")
    tests = max(1, per.count())
    levels = min(len(cuts) for _, cuts in rules.values())
    t = per.select("stratum", "n", "hs", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    t = t.withColumn("k", F.expr("aggregate(filter(hs, x -> x.within <= level), 0L, (a, x) -> a + x.c)")).drop("hs")
    # exact lower tail of the binomial by its recurrence in logs; k above the mean can't pass
    tail = f"""CASE WHEN k > n * {eps} THEN 1D ELSE aggregate(sequence(0L, k), named_struct('l', n * ln(1D - {eps}), 'p', 0D),
        (a, i) -> named_struct('l', a.l + CASE WHEN i < n THEN ln(CAST(n - i AS DOUBLE) / (i + 1)) ELSE 0D END + ln({eps} / (1D - {eps})), 'p', a.p + exp(a.l)), a -> a.p) END"""
    t = t.withColumn("ok", F.expr(f"{tail} <= {alpha / tests}D"))
    best = t.groupBy("stratum").agg(F.expr("coalesce(min(CASE WHEN NOT ok THEN level END), 1000000)").alias("bad"), F.collect_list(F.struct("level", "n", "k")).alias("all"))
    best = best.withColumn("pick", F.expr("array_max(filter(all, x -> x.level < bad))")).where("pick IS NOT NULL")
    grid = F.array(*[F.array(*[F.lit(float(cuts[j])) for _, cuts in rules.values()]) for j in range(levels)])
    return best.select("stratum", "pick.level", "pick.n", "pick.k", F.map_from_arrays(F.array(*map(F.lit, rules)), grid[F.col("pick.level")]).alias("cutoffs"))


def apply_rules(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang", rules: dict = RULES) -> DataFrame:
    """Adds base_failed, rejected_by (names of the rules that reject, sorted) and kept. ``cutoffs``: of select_cutoffs, written."""
    own = cutoffs.select(F.col("stratum").alias("_st"), F.col("cutoffs").alias("_cuts"))
    d = features.drop("base_failed", "rejected_by", "kept")
    d = d.join(small_side(own, 256), F.col(stratum).cast("string").eqNullSafe(F.col("_st")), "left")
    hits = F.array_compact(F.array(*[F.when(F.expr(f"{e} > _cuts['{r}']"), F.lit(r)) for r, (e, _) in rules.items()]))
    d = d.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_sort(hits)).withColumn("kept", F.expr("NOT base_failed AND size(rejected_by) = 0"))
    return d.drop("_st", "_cuts")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Features, cutoffs and verdicts for ``docs``; ``carry``: columns to keep (key and stratum by default).

    Features are written once to the shared folder (a few numbers a document), as both the cutoffs and the verdicts read them.
    """
    cols = list(dict.fromkeys([key, stratum, *(carry or [])]))
    feats = materialize(with_features(docs.select(*cols, *([text] if text not in cols else [])), text).drop(*([] if text in cols else [text])), "quality")
    return apply_rules(feats, materialize(select_cutoffs(feats, labels, key, stratum=stratum), "cutoffs"), stratum)


def keep_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Features are computed once and written with each row's key and text hash; the rejected rows are taken out by an anti-join
    on both (broadcast only if they are counted to be few).
    """
    th = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    slim = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{stratum}`").alias("lang"), F.col(f"`{text}`").alias("text"), th.alias("text_hash"))
    feats = materialize(with_features(slim, "text").drop("text"), "quality")
    judged = apply_rules(feats, materialize(select_cutoffs(feats, labels, key), "cutoffs"))
    gone = materialize(judged.where("NOT kept").select(F.col(key).alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "rejected")
    return docs.join(small_side(gone, 24), F.col(f"`{key}`").eqNullSafe(F.col("_gone")) & (th == F.col("_hash")), "left_anti")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs.select("doc_id", "lang", "text"), labels)
    return out.select("doc_id", *FEATURES, "base_failed", "kept")
