"""Accuracy of predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions.numbers import absolute_error, half_even, ratio, relative_error


def compare_pages(
    truth: DataFrame, pred: DataFrame, ambiguous: DataFrame | None, keys: list[str]
) -> DataFrame:
    """One row per judged truth page: hit at rank 1 and within rank 2.

    ``truth`` has keys, truth_type; ``pred`` has keys, primary_type, secondary_type, at most
    one row per page. Ambiguous pages are not judged.
    """
    judged = truth if ambiguous is None else truth.join(ambiguous, keys, "left_anti")
    joined = judged.join(pred, keys, "left")
    top1 = F.coalesce(F.col("primary_type") == F.col("truth_type"), F.lit(False))
    second = F.coalesce(F.col("secondary_type") == F.col("truth_type"), F.lit(False))
    return joined.withColumn("top1", top1).withColumn("top2", top1 | second)


def page_accuracy(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return judged.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("top1").alias("top1_correct"),
        F.count_if("top2").alias("top2_correct"),
    )


def per_type_counts(judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """True positives, false positives and false negatives per type."""
    keys = keys or []
    marks = F.array(
        F.struct(
            F.col("truth_type").alias("type"), F.col("top1").cast("int").alias("tp"),
            F.lit(0).alias("fp"), (~F.col("top1")).cast("int").alias("fn"),
        ),
        F.when(
            ~F.col("top1") & F.col("primary_type").isNotNull(),
            F.struct(F.col("primary_type").alias("type"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")),
        ),
    )
    return (
        judged.select(*keys, F.inline(F.filter(marks, lambda m: m.isNotNull())))
        .groupBy(*keys, "type")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def per_type_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1, 0 where undefined."""
    zero = F.lit(0.0)
    precision = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), zero)
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.coalesce(ratio(2 * p * r, p + r), zero))


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean of the per-type F1 values, each rounded to three digits first."""
    return scores.agg(F.coalesce(F.avg(half_even("f1", 3)), F.lit(0.0)).alias("macro_f1"))


def misclassified(judged: DataFrame) -> DataFrame:
    return judged.filter(~F.col("top1"))


def compare_values(
    truth: DataFrame, pred: DataFrame, keys: list[str], tolerance: dict | None = None
) -> DataFrame:
    """Numeric fields: match if the absolute or the relative tolerance is met.

    ``truth`` has keys, field, truth, present (NULL: present when the field is listed);
    ``pred`` has keys, field, pred. Only fields the truth lists are judged.
    """
    tolerance = tolerance or fixed.EVALUATION_TOLERANCE
    abs_tol = _tolerance(tolerance, 0)
    rel_tol = _tolerance(tolerance, 1)
    joined = truth.join(pred, [*keys, "field"], "left")
    abs_err, rel_err = absolute_error("pred", "truth"), relative_error("pred", "truth")
    match = (abs_err <= abs_tol) | ((rel_tol > 0) & (rel_err <= rel_tol))
    present = F.coalesce(F.col("present"), F.lit(True))
    stated = F.col("pred").isNotNull()
    return joined.select(
        *keys, "field", "pred", "truth",
        F.when(stated & F.col("truth").isNotNull(), match).alias("match"),
        half_even(abs_err, 3).alias("abs_err"),
        F.when(rel_err.isNotNull(), F.when(rel_err == float("inf"), rel_err).otherwise(half_even(rel_err, 4))).alias("rel_err"),
        present.alias("gt_present"),
        stated.alias("pred_present"),
        (present & stated).alias("completion"),
        (~present & stated).alias("fp"),
    )


def _tolerance(table: dict, which: int) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for field, pair in table.items():
        out = out.when(F.col("field") == field, F.lit(float(pair[which])))
    return out.otherwise(F.lit(0.0))


def normalised(c) -> Column:
    t = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", "")
    return F.lower(F.regexp_replace(t, r"(?U)[^\w가-힣]", ""))


def word_bag(c) -> Column:
    """Normalised distinct entries of a list written as text."""
    parts = F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"[,·\s/]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), normalised))


def _alias_match(pred: Column, truth: Column) -> Column:
    p, t = normalised(pred), normalised(truth)
    out = F.when(F.lit(False), F.lit(False))
    for aliases in fixed.STRUCTURE_ALIASES.values():
        names = [normalised(F.lit(a)) for a in aliases]
        in_truth, in_pred = F.lit(False), F.lit(False)
        for n in names:
            in_truth, in_pred = in_truth | F.contains(t, n), in_pred | F.contains(p, n)
        out = out.when(in_truth, in_pred)
    return out.otherwise(p == t)


def compare_categories(truth: DataFrame, pred: DataFrame, keys: list[str], methods: dict | None = None) -> DataFrame:
    """Categorical fields by the method set for each: exact, keyword or word overlap."""
    methods = methods or fixed.EVALUATION_METHOD
    joined = truth.filter(F.col("truth").isNotNull()).join(pred, [*keys, "field"], "left")
    p, t = F.col("pred"), F.col("truth")
    same = normalised(p) == normalised(t)
    a, b = word_bag(p), word_bag(t)
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    overlap = F.when(union == 0, F.lit(1.0)).otherwise(common / F.greatest(union, F.lit(1)))
    match, similarity = same, same.cast("double")
    for field, (method, threshold) in methods.items():
        here = F.col("field") == field
        if method == "keyword":
            hit = _alias_match(p, t)
            match = F.when(here, hit).otherwise(match)
            similarity = F.when(here, hit.cast("double")).otherwise(similarity)
        elif method == "jaccard":
            match = F.when(here, overlap >= threshold).otherwise(match)
            similarity = F.when(here, overlap).otherwise(similarity)
    return joined.select(
        *keys, "field", "pred", "truth",
        F.when(p.isNotNull(), match).alias("match"),
        F.when(p.isNotNull(), half_even(similarity, 3)).alias("similarity"),
    )


def field_summary(values: DataFrame) -> DataFrame:
    """Completion, match rate and relative errors per numeric field."""
    finite = F.when(F.col("rel_err") < float("inf"), F.col("rel_err"))
    present = F.col("gt_present")
    return values.groupBy("field").agg(
        ratio(F.count_if(present & F.col("pred_present")), F.count_if(present)).alias("completion"),
        ratio(F.count_if("match"), F.count("match")).alias("match_rate"),
        (F.avg(finite) * 100).alias("mean_rel_err_pct"),
        (F.max(finite) * 100).alias("max_rel_err_pct"),
        F.count_if(~present).alias("absent"),
        F.count_if("fp").alias("false_positives"),
    )


def category_summary(categories: DataFrame) -> DataFrame:
    return categories.groupBy("field").agg(
        ratio(F.count_if("match"), F.count("match")).alias("match_rate")
    )


def quality_accuracy(judged: DataFrame, samples: DataFrame, sample: list[str]) -> DataFrame:
    """Mean of the per-sample accuracy by document quality."""
    per = page_accuracy(judged, sample).withColumn("accuracy", ratio("top1_correct", "total"))
    return per.join(samples, sample).groupBy("quality").agg(
        F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("samples")
    )


def overall(judged: DataFrame, values: DataFrame, sample: list[str]) -> DataFrame:
    """Headline rates over all samples, one row."""
    pages = judged.agg(
        F.struct(
            F.count(F.lit(1)).alias("pages"),
            ratio(F.count_if("top1"), F.count(F.lit(1))).alias("top1"),
            ratio(F.count_if("top2"), F.count(F.lit(1))).alias("top2"),
            ratio(
                F.count_if(~F.col("top1") & F.col("primary_type").isNotNull()), F.count(F.lit(1))
            ).alias("page_fp_rate"),
        ).alias("p")
    )
    macro = macro_f1(per_type_scores(per_type_counts(judged)))
    fields = values.agg(
        ratio(F.count_if("completion"), F.count_if("gt_present")).alias("field_completion_rate"),
        F.coalesce(ratio(F.count_if("fp"), F.count_if(~F.col("gt_present"))), F.lit(0.0)).alias("field_fp_rate"),
    )
    return fields.withColumn("_p", pages.scalar()).withColumn("macro_f1", macro.scalar()).select(
        F.col("_p.pages").alias("pages"), F.col("_p.top1").alias("top1"), F.col("_p.top2").alias("top2"),
        F.col("_p.page_fp_rate").alias("page_fp_rate"), "macro_f1", "field_completion_rate", "field_fp_rate",
    )
