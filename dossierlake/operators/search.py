"""Full-text search over record collections: documents, trigram postings, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake import fixed
from dossierlake.functions import text as T

K1, B = 1.2, 0.75
MIN_PHRASE = 3
SMALLEST_IDF = 1e-6


def _terms(key: str, table: dict[str, list[str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, words in table.items():
        out = out.when(F.col(key) == name, F.lit(" ".join(words)))
    return out


def facility_text(key: str = "facility_type") -> Column:
    """Key, label and everyday names of a facility type."""
    from dossierlake.functions.labels import lookup

    label = lookup(key, fixed.FACILITY_LABELS, F.col(key))
    return F.concat_ws(" ", F.col(key), label, _terms(key, fixed.FACILITY_SYNONYMS))


def extra_meta_text(fields: list[str], tags: str | None = None) -> Column:
    """Procurement and phase with their synonyms, then free fields and tags."""
    parts = [
        T.blank_to_null("procurement_type"), _terms("procurement_type", fixed.PROCUREMENT_SYNONYMS),
        T.blank_to_null("project_phase"), _terms("project_phase", fixed.PHASE_SYNONYMS),
        *[T.blank_to_null(F.col(f).cast("string")) for f in fields],
    ]
    if tags:
        parts.append(F.array_join(F.filter(tags, lambda t: t != ""), " "))
    return F.concat_ws(" ", *parts)


def deep_text(deep: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Narrative, intent and list fields of all deep records of a competition, in order."""
    return deep.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(ordinal).alias("o"),
                    F.concat_ws(
                        " ", T.blank_to_null("concept_narrative"), T.blank_to_null("design_intent"),
                        "key_differentiators", "search_keywords", "improvement_points",
                    ).alias("t"),
                )
            )
        ).alias("_d")
    ).select(*keys, F.array_join(F.transform("_d", lambda d: d.t), " ").alias("deep_text"))


def search_documents(
    projects: DataFrame, insights: DataFrame, deep: DataFrame, meta_fields: list[str]
) -> DataFrame:
    """One row of eight text columns per competition.

    ``insights`` has competition_id, ranking, differentiators, strengths (arrays) and
    alignment. Winner strengths serve twice, as patterns and as keywords.
    """
    joined = projects.join(insights, "competition_id", "left").join(deep, "competition_id", "left")
    return joined.select(
        F.col("competition_id").cast("string").alias("competition_id"),
        facility_text().alias("facility_text"),
        F.concat_ws(" ", "ranking").alias("ranking"),
        F.concat_ws(" ", "differentiators").alias("differentiators"),
        F.concat_ws(" ", "strengths").alias("winner_patterns"),
        F.concat_ws(" ", "strengths").alias("concept_keywords"),
        F.coalesce("alignment", F.lit("")).alias("alignment"),
        F.trim(F.concat_ws(" ", extra_meta_text(meta_fields), "deep_text")).alias("extra_meta"),
    )


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Distinct trigrams per document. Written once, partitioned by a trigram bucket."""
    grams = F.flatten(
        F.array(*[T.ngrams(F.lower(F.coalesce(c, F.lit(""))), 3) for c in columns])
    )
    return docs.select(key, F.explode(F.array_distinct(grams)).alias("gram")).withColumn(
        "bucket", F.pmod(F.xxhash64("gram"), F.lit(64)).cast("int")
    )


def phrase_candidates(index: DataFrame, phrase: str, key: str) -> DataFrame:
    """Documents that hold every trigram of a phrase; a superset of the matches.

    Buckets and trigrams become literal filters, so only matching partitions are read.
    """
    text = phrase.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    if not grams:
        return index.select(key).limit(0)
    pruned = None
    for g in grams:
        one = F.col("bucket") == F.pmod(F.xxhash64(F.lit(g)), F.lit(64)).cast("int")
        pruned = one if pruned is None else pruned | one
    hits = index.filter(pruned & F.col("gram").isin(grams))
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(grams)).select(key)


def phrase_matches(docs: DataFrame, phrase: str, columns: list[str]) -> DataFrame:
    """Documents with the phrase in any column; phrases under three characters match nothing."""
    if len(phrase) < MIN_PHRASE:
        return docs.filter(F.lit(False))
    found = None
    for c in columns:
        hit = F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(phrase.lower()))
        found = hit if found is None else found | hit
    return docs.filter(found)


def bm25(docs: DataFrame, key: str, phrases: list[str], weights: dict[str, float]) -> DataFrame:
    """Negative BM25 of an OR query; smaller is better. One scan for all phrases.

    A phrase scores like one term: its weighted, overlapping occurrences, against document
    length in trigrams. Collection totals are scalar subqueries, one row each.
    """
    phrases = [p for p in dict.fromkeys(phrases) if len(p) >= MIN_PHRASE]
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    lowered = {c: F.lower(F.coalesce(c, F.lit(""))) for c in weights}
    length = sum(
        (F.greatest(F.length(t) - 2, F.lit(0)) for t in lowered.values()), F.lit(0)
    ).cast("double")
    weighted = [
        sum((T.overlapping_count(t, p.lower()) * F.lit(w) for (c, w), t in
             zip(weights.items(), lowered.values())), F.lit(0.0))
        for p in phrases
    ]
    measured = docs.select(
        key, length.alias("_len"), *[w.alias(f"_f{i}") for i, w in enumerate(weighted)]
    )
    totals = measured.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("docs"),
            F.avg("_len").alias("mean_len"),
            *[F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(phrases))],
        ).alias("t")
    ).scalar()
    any_hit = None
    for i in range(len(phrases)):
        hit = F.col(f"_f{i}") > 0
        any_hit = hit if any_hit is None else any_hit | hit
    found = measured.withColumn("_t", totals).filter(any_hit)
    norm = K1 * (F.lit(1 - B) + B * F.col("_len") / F.col("_t.mean_len"))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        n = F.col(f"_t.n{i}")
        idf = F.ln((F.col("_t.docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(SMALLEST_IDF)).otherwise(idf)
        f = F.col(f"_f{i}")
        score = score - idf * f * (K1 + 1) / (f + norm)
    return found.select(key, score.alias("score"))


def search(
    docs: DataFrame, key: str, phrases: list[str], weights: dict[str, float] | None = None, limit: int | None = None
) -> DataFrame:
    """Best documents first, all or the first ``limit``."""
    best = bm25(docs, key, phrases, weights or fixed.SEARCH_WEIGHTS).orderBy("score", key)
    return best if limit is None else best.limit(limit)


def routed_search(
    docs: DataFrame, cards: DataFrame, query: str, key: str = "competition_id",
    facility: str | None = None, result: str | None = None, keywords: list[str] | None = None,
    limit: int | None = None, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Short queries list all cards, longer ones search. Filters apply first, then the best
    ``limit`` of what they leave (all without one); scores are those of the whole collection.

    Without ``keywords`` the whole query is one phrase.
    """
    from dossierlake.operators.comparison import card_filter

    text = (query or "").strip()
    wanted = card_filter(cards, facility, result)
    if len(text) <= 2:
        return wanted
    hits = wanted.join(bm25(docs, key, keywords or [text], weights or fixed.SEARCH_WEIGHTS), key)
    return hits if limit is None else hits.orderBy("score", key).limit(limit)
