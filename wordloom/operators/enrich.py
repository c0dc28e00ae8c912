"""Enrichment of word sets across models, and significance of a set in one model.

Similarities are a long table (word, header, model, cos) with null for a missing cell;
a cell's key is "word-header".  Contrasts are rows, (contrast, key, score), so that all
of them run as one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gsea import SetTest, set_test
from .lineage import sent, settled
from .ranks import number_within
from .vectors import control_sample, cosines, except_set, nearest, union_sets, words_table


def similarity(models: DataFrame, words: DataFrame, headers: DataFrame) -> DataFrame:
    """(word, header, model, cos) for all words, headers and models; null where a model lacks either."""
    names = models.select("model").distinct()
    grid = words.select("word").distinct().crossJoin(sent(headers.select(F.col("word").alias("header")).distinct())).crossJoin(sent(names))
    return grid.join(cosines(models, headers), ["word", "header", "model"], "left")


def filtered(sims: DataFrame, most_missing: int = 1) -> DataFrame:
    """The keys with at most so many missing cells."""
    few = sims.groupBy("word", "header").agg(F.count_if(F.col("cos").isNull()).alias("missing")).filter(F.col("missing") <= most_missing)
    return sims.join(few.drop("missing"), ["word", "header"])


def imputed(sims: DataFrame) -> DataFrame:
    """Missing cells filled with the mean of the key's others."""
    return sims.withColumn("cos", F.coalesce("cos", F.avg("cos").over(Window.partitionBy("word", "header"))))


def quantile_normalized(sims: DataFrame) -> DataFrame:
    """(key, model, norm): each model's values replaced by the mean over models of the values of their rank; ties by key.  A model is dealt out over many tasks."""
    keyed = sims.select(F.concat_ws("-", "word", "header").alias("key"), "model", "cos")
    ranked = number_within(keyed, "rank", "model", F.asc("cos"), F.asc("key"))
    means = ranked.groupBy("rank").agg(F.avg("cos").alias("norm"))
    return ranked.join(means, "rank").select("key", "model", "norm")


def _standard(scores: DataFrame) -> DataFrame:
    """Scores less their mean, by their standard deviation, for each contrast."""
    sums = scores.groupBy("contrast").agg(F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"))
    return scores.join(sent(sums), "contrast").select("contrast", "key", ((F.col("score") - F.col("mu")) / F.col("sd")).alias("score"))


def _against(normed: DataFrame, condition) -> DataFrame:
    return normed.alias("a").join(normed.alias("b"), (F.col("a.key") == F.col("b.key")) & condition)


def one_v_one(normed: DataFrame) -> DataFrame:
    """Every model less every one before it in the order of names."""
    both = _against(normed, F.col("a.model") > F.col("b.model"))
    return both.select(F.concat(F.lit("1v1: "), F.col("a.model"), F.lit("-"), F.col("b.model")).alias("contrast"), F.col("a.key").alias("key"), (F.col("a.norm") - F.col("b.norm")).alias("score"))


def one_v_all(normed: DataFrame) -> DataFrame:
    """The least excess of a model over the others, standardised."""
    both = _against(normed, F.col("a.model") != F.col("b.model"))
    least = both.groupBy(F.concat(F.lit("1v-all: "), F.col("a.model")).alias("contrast"), F.col("a.key").alias("key")).agg(F.min(F.col("a.norm") - F.col("b.norm")).alias("score"))
    return _standard(least)


def group_contrasts(normed: DataFrame, groups: DataFrame) -> DataFrame:
    """The least excess of a group's models (group_id, model) over those outside it, standardised."""
    members = sent(groups.select("group_id", "model").distinct())
    inside = normed.join(members, "model").select("group_id", "key", F.col("norm").alias("inside"))
    outside = normed.crossJoin(sent(groups.select("group_id").distinct())).join(members, ["group_id", "model"], "left_anti").select("group_id", "key", F.col("norm").alias("outside"))
    # min over pairs of (inside - outside) = least inside - greatest outside
    low = inside.groupBy("group_id", "key").agg(F.min("inside").alias("low"))
    high = outside.groupBy("group_id", "key").agg(F.max("outside").alias("high"))
    return _standard(low.join(high, ["group_id", "key"]).select(F.concat(F.lit("group: "), "group_id").alias("contrast"), "key", (F.col("low") - F.col("high")).alias("score")))


def pathways(sets: DataFrame, headers: DataFrame) -> DataFrame:
    """(pathway, key): each set's words with every header."""
    return sets.crossJoin(sent(headers.select(F.col("word").alias("header")).distinct())).select(F.col("set_id").alias("pathway"), F.concat_ws("-", "word", "header").alias("key")).distinct()


def pooled(models: DataFrame, listed: DataFrame, numwords: int) -> DataFrame:
    """(word): the listed words and the numwords nearest of each in any model.  Where every word of the models is listed, neighbours can add none and are not looked for."""
    if not except_set(models, listed).limit(1).count():
        return union_sets(listed)
    return union_sets(listed, nearest(models, listed, numwords))


def wsea(models: DataFrame, sets: DataFrame, headers: list[str], groups: DataFrame | None = None, numwords: int = 1000, test: SetTest | None = None) -> dict[str, DataFrame]:
    """Word-set enrichment: {"wsea": set tests of every contrast, "matrix": normalised similarities}.

    models: (model, word, vec), at least two models; sets: (set_id, word).  Fewer models,
    no sets or no headers are a ValueError.
    """
    spark = models.sparkSession
    if not headers:
        raise ValueError("header words are missing")
    if not sets.limit(1).count():
        raise ValueError("word sets are missing")
    names = [r[0] for r in models.select("model").distinct().limit(2).collect()]
    if len(names) < 2:
        raise ValueError("two models or more are compared")
    heads = words_table(spark, headers)
    listed = union_sets(sets, heads)
    pool = settled(pooled(models, listed, numwords))
    normed = settled(quantile_normalized(settled(imputed(filtered(similarity(models, pool, heads))))))
    contrasts = one_v_one(normed).unionByName(one_v_all(normed))
    if groups is not None:
        contrasts = contrasts.unionByName(group_contrasts(normed, groups))
    return {"wsea": set_test(contrasts, pathways(sets, heads), test or SetTest()), "matrix": normed}


def wssa_scores(models: DataFrame, words: DataFrame, headers: DataFrame) -> DataFrame:
    """(model, word, score): the mean cosine of each word with the headers."""
    near = cosines(models, headers).join(sent(words.select("word").distinct()), "word", "left_semi")
    return near.groupBy("model", "word").agg(F.avg("cos").alias("score"))


def wssa_boot_scores(models: DataFrame, original: str, words: DataFrame, headers: DataFrame) -> DataFrame:
    """(word, score): the original model's mean cosine over its standard deviation over all models; no row where that is null or 0."""
    every = wssa_scores(models, words, headers)
    sums = every.groupBy("word").agg(F.max(F.when(F.col("model") == original, F.col("score"))).alias("own"), F.stddev_samp("score").alias("sd"))
    return sums.filter("own IS NOT NULL AND sd > 0").select("word", (F.col("own") / F.col("sd")).alias("score"))


def control_pool(model: DataFrame, own: DataFrame, heads: DataFrame, control_set: DataFrame | None = None, num_controls: int = 5000, seed: int = 1, drop_headers: bool = False) -> DataFrame:
    """(word): a set's words and its controls; without a control set, so many of the model's other words."""
    if control_set is None:
        # Controls are asked for by number; a smaller vocabulary gives all that it has.
        others = except_set(model, union_sets(own, heads) if drop_headers else own)
        control_set = control_sample(others, num_controls, seed)
    return union_sets(own, except_set(control_set, own))


def wssa(model: DataFrame, word_set: list[str] | DataFrame, headers: list[str], control_set: DataFrame | None = None, boot: DataFrame | None = None, num_controls: int = 5000, seed: int = 1, test: SetTest | None = None, drop_headers: bool = False) -> DataFrame:
    """Significance of a word set, a list or a table (word), in one model (model, word, vec); boot: replicates of it as further models.

    An empty word set, or no header words, is a ValueError.
    """
    spark = model.sparkSession
    own = word_set.select("word").distinct() if isinstance(word_set, DataFrame) else words_table(spark, word_set)
    if not headers or not own.limit(1).count():
        raise ValueError("a word set and header words are needed")
    heads = words_table(spark, headers)
    pool = control_pool(model, own, heads, control_set, num_controls, seed, drop_headers)
    if boot is None:
        scored = wssa_scores(model, pool, heads).select(F.lit("wssa").alias("contrast"), F.col("word").alias("key"), "score")
    else:
        name = model.select("model").head()[0]
        scored = wssa_boot_scores(model.unionByName(boot), name, pool, heads).select(F.lit("wssa").alias("contrast"), F.col("word").alias("key"), "score")
    return set_test(scored, own.select(F.lit("word_set").alias("pathway"), F.col("word").alias("key")), test or SetTest())
