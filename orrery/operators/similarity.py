"""Near-duplicate search over token windows: windows, shingles, signatures, bands, exact similarity, evaluation.

A frame of windows has file, start, tokens and window_id; one of sets adds
the shingle hashes ``h``. Pairs are (a, b, ...) with a < b by window id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.shingles import band_keys, estimate, hash_params, jaccard, lsh_probability, minhash_batches, minhash_expression, permuted, stable_hash
from orrery.functions.text import excerpt, f1_words
from orrery.runtime import stage


def window_starts(n: Column, size: int, stride: int) -> Column:
    """Starts of windows over n tokens: every stride, and one that ends on the last token; none for n = 0."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    last = F.greatest(n - size, F.lit(0))
    return F.when(n > 0, F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))).otherwise(F.array().cast("array<int>"))


def token_windows(docs: DataFrame, file: Column, text: str, size: int = 50, stride: int = 25) -> DataFrame:
    """(window_id, file, start, tokens); a text without words has no window."""
    words = docs.select(file.alias("file"), f1_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = words.select("file", "w", F.explode(window_starts(F.size("w"), size, stride)).alias("start"))
    return starts.select(F.format_string("%s:%06d", "file", "start").alias("window_id"), "file", "start", F.slice("w", F.col("start") + 1, F.lit(size)).alias("tokens"))


def hashed_sets(windows: DataFrame, shingles: Column) -> DataFrame:
    """Windows with their distinct shingle hashes ``h``; those without a shingle are dropped."""
    return windows.select("window_id", "file", "start", F.array_distinct(F.transform(shingles, stable_hash)).alias("h")).where(F.size("h") > 0)


def signatures(sets: DataFrame, n: int = 100, seed: int = 4099, method: str = "numpy") -> DataFrame:
    """(window_id, file, start, sig). All methods agree: 'numpy' (vectorised), 'expression' (higher-order), 'aggregate' (explode and n minima)."""
    params = hash_params(n, seed)
    keys = ["window_id", "file", "start"]
    if method == "aggregate":
        mins = sets.select(*keys, F.explode("h").alias("x")).groupBy(*keys).agg(*[F.min(permuted(F.col("x"), a, b)).alias(f"m{i}") for i, (a, b) in enumerate(params)])
        return mins.select(*keys, F.array(*[f"m{i}" for i in range(n)]).alias("sig"))
    if method == "numpy":
        kinds = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
        return sets.select(*keys, "h").mapInArrow(minhash_batches(params), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sig array<bigint>")
    return sets.select(*keys, minhash_expression(F.col("h"), params).alias("sig"))


def buckets(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, window_id, file, start): a row per window and band."""
    return sigs.select(F.explode(band_keys(F.col("sig"), bands, rows)).alias("bucket"), "window_id", "file", "start")


def candidate_pairs(bucket_rows: DataFrame) -> DataFrame:
    """(a, b, bands, trivial info): pairs that share a bucket and in how many bands.

    The self-join is on the bucket; adaptive skew handling splits hot ones.
    """
    x, y = (bucket_rows.select("bucket", F.col("window_id").alias(i), F.col("file").alias(f"file_{i}"), F.col("start").alias(f"start_{i}")) for i in "ab")
    return x.join(y, "bucket").where("a < b").groupBy("a", "b", "file_a", "file_b", "start_a", "start_b").agg(F.count("*").alias("bands"))


def trivial(size: int) -> Column:
    """Whether the two windows of a pair lie in one file and overlap."""
    return (F.col("file_a") == F.col("file_b")) & (F.abs(F.col("start_a") - F.col("start_b")) < size)


def cross() -> Column:
    return F.col("file_a") != F.col("file_b")


def numbered(sets: DataFrame) -> DataFrame:
    """Sets as a stage table with a number ``wid`` each, so that pairs can travel as numbers."""
    return stage(sets.withColumn("wid", F.monotonically_increasing_id()), "numbered-sets")


def exact_pair_ids(sets: DataFrame, size: int) -> DataFrame:
    """(wa, wb, j): exact similarity of every non-trivial pair of numbered sets that shares a shingle.

    The inverted index is a self-join on the shingle hash over fixed-width
    columns; pairs are counted on the map side before they are shuffled.
    """
    rows = sets.select("wid", F.xxhash64("file").alias("fh"), "start", F.size("h").alias("n"), F.explode("h").alias("x"))
    one, two = (rows.select("x", F.col("wid").alias(f"w{i}"), F.col("fh").alias(f"file_{i}"), F.col("start").alias(f"start_{i}"), F.col("n").alias(f"n_{i}")) for i in "ab")
    shared = one.join(two, "x").where((F.col("wa") < F.col("wb")) & ~trivial(size)).groupBy("wa", "wb", (F.col("n_a") + F.col("n_b")).alias("n")).agg(F.count("*").alias("both"))
    return shared.select("wa", "wb", (F.col("both") / (F.col("n") - F.col("both"))).alias("j"))


def named_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, files, starts, j) of numbered pairs, a < b by window id."""
    one, two = (sets.select(F.col("wid").alias(f"w{i}"), F.struct("window_id", "file", "start").alias(i)) for i in "ab")
    both = pairs.join(one, "wa").join(two, "wb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "j")
    return both.select(F.col("a.window_id").alias("a"), F.col("b.window_id").alias("b"), F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b"), F.col("a.start").alias("start_a"), F.col("b.start").alias("start_b"), "j")


def exact_pairs(sets: DataFrame, size: int, keep_from: float = 0.0) -> DataFrame:
    """(a, b, files, starts, j) of the non-trivial pairs that share a shingle, from a similarity of ``keep_from`` on."""
    sets = sets if "wid" in sets.columns else numbered(sets)
    return named_pairs(exact_pair_ids(sets, size).where(F.col("j") >= keep_from), sets)


def bin_of(j: Column, bins: int) -> Column:
    return F.least(F.floor(j * bins).cast("int"), F.lit(bins - 1))


def histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    return pairs.groupBy(bin_of(F.col("j"), bins).alias("bin")).agg(F.count("*").alias("pairs"))


def similarity(both: Column, n: Column) -> Column:
    """Of sets that share ``both`` and have ``n`` together."""
    return both / (n - both)


def _mean(c: Column, weight: str | None) -> Column:
    return F.sum(c * F.col(weight)) / F.sum(weight) if weight else F.avg(c)


def _rows(weight: str | None) -> Column:
    return F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count("*")


def with_estimates(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs with the signature estimate ``est``."""
    one, two = (sigs.select(F.col("window_id").alias(i), F.col("sig").alias(f"sig_{i}")) for i in "ab")
    return pairs.join(one, "a").join(two, "b").withColumn("est", estimate(F.col("sig_a"), F.col("sig_b"))).drop("sig_a", "sig_b")


def error_bins(estimated: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    """Errors of the estimate by 0.1 of exact similarity; ``weight`` names a column with the pairs that a row stands for."""
    e = F.col("est") - F.col("j")
    mid = (F.col("bin") + 0.5) / 10
    rows = estimated.groupBy(bin_of(F.col("j"), 10).alias("bin")).agg(_rows(weight).alias("pairs"), _mean(e, weight).alias("mean_error"), _mean(F.abs(e), weight).alias("mean_abs_error"), F.sqrt(_mean(e * e, weight)).alias("rmse"))
    return rows.withColumn("theory_sd_at_mid", F.sqrt(mid * (1 - mid) / n)).select("bin", "pairs", *[F.round(c, 4).alias(c) for c in ("mean_error", "mean_abs_error", "rmse", "theory_sd_at_mid")])


def error_summary(estimated: DataFrame, n: int, weight: str | None = None) -> DataFrame:
    e = F.col("est") - F.col("j")
    within = _mean((F.abs(e) <= F.lit(n**-0.5)).cast("double"), weight)
    return estimated.agg(_rows(weight).alias("pairs"), F.round(_mean(F.abs(e), weight), 4).alias("mean_abs_error"), F.round(F.sqrt(_mean(e * e, weight)), 4).alias("rmse"), F.round(F.lit(n**-0.5), 4).alias("one_over_sqrt_n"), F.round(within, 4).alias("within_one_over_sqrt_n"))


def with_exact(cands: DataFrame, kept: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates (a, b) with their exact similarity ``j``: from ``kept`` where it has the pair, else computed from the sets."""
    left = cands.select("a", "b").join(kept.select("a", "b", "j"), ["a", "b"], "left")
    known, below = left.where("j is not null"), left.where("j is null").select("a", "b")
    one, two = (sets.select(F.col("window_id").alias(i), F.col("h").alias(f"h_{i}")) for i in "ab")
    return known.unionByName(below.join(one, "a").join(two, "b").select("a", "b", jaccard(F.col("h_a"), F.col("h_b")).alias("j")))


def evaluation(cands: DataFrame, truth: DataFrame, sigs: DataFrame, size: int, threshold: float, only_cross: bool) -> DataFrame:
    """Recall and precision of non-trivial candidates, plain and verified by estimate; null on empty denominators.

    ``truth`` holds every pair whose similarity reaches ``threshold``; a
    candidate that isn't there lies below it.
    """
    pick = (lambda df: df.where(cross())) if only_cross else (lambda df: df)
    c = with_estimates(pick(cands.where(~trivial(size))).select("a", "b"), sigs)
    t = pick(truth).select("a", "b", "j")
    both = c.withColumn("cand", F.lit(True)).join(t, ["a", "b"], "full").select(F.coalesce("cand", F.lit(False)).alias("cand"), (F.coalesce("j", F.lit(0.0)) >= threshold).alias("true"), (F.coalesce("est", F.lit(0.0)) >= threshold).alias("sure"))
    n = both.agg(
        F.count_if("true").alias("true_pairs"),
        F.count_if("cand").alias("candidates"),
        F.count_if(F.col("cand") & F.col("true")).alias("hits"),
        F.count_if(F.col("cand") & F.col("sure")).alias("verified_candidates"),
        F.count_if(F.col("cand") & F.col("sure") & F.col("true")).alias("verified_hits"),
    )
    return rates(n)


def rates(n: DataFrame, *keep: str) -> DataFrame:
    """Recall and precision from the five counts of evaluation(); ``keep`` are columns that stay."""
    rate = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), 4)
    return n.select(*keep, "true_pairs", "candidates", rate("hits", "true_pairs").alias("recall"), rate("hits", "candidates").alias("precision"), "verified_candidates", rate("verified_hits", "true_pairs").alias("verified_recall"), rate("verified_hits", "verified_candidates").alias("verified_precision"))


def s_curve(kept: DataFrame, counts: DataFrame, cands: DataFrame, bands: int, rows: int) -> DataFrame:
    """Candidate rate per 0.05 of similarity beside theory, for bins of which ``kept`` holds every pair that ``counts`` (a histogram) has."""
    marked = kept.join(cands.select("a", "b", F.lit(1.0).alias("hit")), ["a", "b"], "left")
    per = marked.groupBy(bin_of(F.col("j"), 20).alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("measured"), F.round(F.avg(lsh_probability(F.col("j"), bands, rows)), 4).alias("theory"))
    return per.join(counts, ["bin", "pairs"])


def s_curve_counted(counts: DataFrame, cands: DataFrame, bands: int, rows: int, least: float) -> DataFrame:
    """The rows of s_curve() from (both, n, pairs) of all pairs and the candidates' similarities ``j``, for bins that begin at ``least`` or above."""
    b = bin_of(F.col("j"), 20).alias("bin")
    j = counts.select(similarity(F.col("both"), F.col("n")).alias("j"), "pairs")
    per = j.groupBy(b).agg(F.sum("pairs").alias("pairs"), F.min("j").alias("from"), F.round(_mean(lsh_probability(F.col("j"), bands, rows), "pairs"), 4).alias("theory")).where(F.col("from") >= least)
    hits = cands.groupBy(b).agg(F.count("*").alias("hits"))
    return per.join(hits, "bin", "left").select("bin", "pairs", F.round(F.coalesce("hits", F.lit(0)) / F.col("pairs"), 4).alias("measured"), "theory")


def coverage(truth: DataFrame, files: DataFrame, size: int, threshold: float) -> DataFrame:
    """(file, covered): distinct word places of each file in windows with a similar window of another file; 0 for the rest."""
    hit = truth.where(cross() & (F.col("j") >= threshold)).select(F.explode(F.array(F.struct(F.col("file_a").alias("file"), F.col("start_a").alias("start")), F.struct(F.col("file_b").alias("file"), F.col("start_b").alias("start")))).alias("w")).select("w.file", "w.start").distinct()
    places = hit.select("file", F.explode(F.sequence(F.col("start"), F.col("start") + size - 1)).alias("p")).groupBy("file").agg(F.count_distinct("p").alias("covered"))
    return files.select("file").distinct().join(places, "file", "left").select("file", F.coalesce("covered", F.lit(0)).alias("covered"))


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("file").agg(F.count("*").alias("windows"), F.max(F.col("start") + F.size("tokens")).cast("bigint").alias("words"))


def top_pairs(truth: DataFrame, windows: DataFrame, size: int, limit: int = 10) -> DataFrame:
    """The pairs of best_pairs() with the first words of either window."""
    return with_texts(best_pairs(truth, size, limit), windows)


def with_texts(top: DataFrame, windows: DataFrame) -> DataFrame:
    """A few pairs (a, b, j) with the first words of either window, the most similar first."""
    one, two = (windows.select(F.col("window_id").alias(i), excerpt(F.col("tokens")).alias(f"{i}_text")) for i in "ab")
    return one.join(F.broadcast(two.join(F.broadcast(top), "b")), "a").orderBy(F.desc("j"), "a", "b").select("a", "b", F.round("j", 4).alias("jaccard"), "a_text", "b_text")


def best_pairs(truth: DataFrame, size: int, limit: int = 10) -> DataFrame:
    """(a, b, j) of the most similar pairs across files, without those that overlap a pair already taken on both sides.

    The greedy choice is local to two files: a pair is only ever set aside
    for a better pair of the same two files. Pairs are thus chosen per pair
    of files, then cut to ``limit`` overall; ties go by (a, b). A taken pair
    can set aside no more than the (2 * size - 1)**2 pairs of starts around
    it, so that ``limit`` times as many of the best are all that two files
    need to hand over.
    """

    def greedy(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["j", "a", "b"], ascending=[False, True, True], kind="stable")
        taken: list[int] = []
        for i, (x, y) in enumerate(zip(g["start_a"], g["start_b"])):
            if len(taken) < limit and not any(abs(x - g["start_a"].iat[k]) < size and abs(y - g["start_b"].iat[k]) < size for k in taken):
                taken.append(i)
        return g.iloc[taken][["a", "b", "j"]]

    # the best pairs of the first ``limit`` pairs of files are all taken, so nothing behind the last of them can be
    rank = F.struct((-F.col("j")).alias("s"), F.col("a").alias("a"), F.col("b").alias("b"))
    fronts = truth.where(cross()).groupBy("file_a", "file_b").agg(F.min(rank).alias("r")).orderBy("r").limit(limit).agg(F.count("*").alias("n"), F.max("r").alias("r")).first()
    if fronts["n"] == limit:
        truth = truth.where(rank <= F.struct(F.lit(fronts["r"]["s"]).alias("s"), F.lit(fronts["r"]["a"]).alias("a"), F.lit(fronts["r"]["b"]).alias("b")))
    within = Window.partitionBy("file_a", "file_b").orderBy(F.desc("j"), "a", "b")
    near = truth.where(cross()).select("file_a", "file_b", "a", "b", "start_a", "start_b", "j", F.row_number().over(within).alias("rn")).where(F.col("rn") <= limit * (2 * size - 1) ** 2).drop("rn")
    best = near.groupBy("file_a", "file_b").applyInPandas(greedy, "a string, b string, j double")
    return best.orderBy(F.desc("j"), "a", "b").limit(limit)
