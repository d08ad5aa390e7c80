"""One query per operator, over whole tables, with the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from dossierlake.llm import (
    common,
    decontamination,
    fingerprints,
    packing,
    page_text,
    private_data,
    quality,
    secrets,
    sharding,
    similarity_join,
    spelling,
    toxicity,
    url_rules,
    vector_codes,
)
from dossierlake.llm.registry import query, table


def _words_sql(text: str) -> str:
    """DuckDB: lower-cased words of ASCII letters and digits and of all characters beyond ASCII."""
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op1_decontamination",
    sql=rf"""
    WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
    b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    grams AS (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
    hits AS (SELECT doc_id, n, i, item_id FROM grams JOIN windows USING (n, g)),
    covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT DISTINCT doc_id, n, i FROM hits), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
    met AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
    """,
)
def op1_decontamination(spark, folder):
    """Benchmark windows found in every document."""
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_sharding")
def op3_sharding(spark, folder):
    """Documents dealt into 24 shards of nearly equal bytes; equal texts share a shard."""
    dealt = sharding.contiguous_shards(table(spark, folder, "documents"), shards=24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Vocabulary of the packed sequences.
TOKENIZER = "word_bpe_49k.json"

#: The contract's rules: verdict, host, path.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _rule_sql(verdict: str, host: str, path: str) -> str:
    return f"SELECT '{verdict}' AS verdict, '{host}' AS rule_host, '{path}' AS rule_path"


@query(
    "op4_url_rules",
    sql=rf"""
    WITH cut AS (
        SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    urls AS (
        SELECT row_number() OVER () AS row_no, page_id,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules AS ({" UNION ALL ".join(_rule_sql(*r) for r in URL_RULES)}),
    best AS (
        SELECT row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no)
    SELECT page_id, host, path, rule, coalesce(verdict,
        CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(url_rules.BLOCKED_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
    FROM urls LEFT JOIN best USING (row_no)
    """,
)
def op4_url_rules(spark, folder):
    """Every URL judged by its longest rule, else by the words of its host."""
    rules = url_rules.path_rules(spark, URL_RULES).unionByName(url_rules.word_rules(spark))
    judged = url_rules.judge_urls(table(spark, folder, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict")


@query("op5_packing")
def op5_packing(spark, folder):
    """Documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query("op2_fingerprints")
def op2_fingerprints(spark, folder):
    """Fingerprints of every text and of its edited form, and how near they are."""
    return fingerprints.neighbour_fingerprints(table(spark, folder, "documents"))


@query("op10_similarity_join")
def op10_similarity_join(spark, folder):
    """Components of documents whose 3-word shingle sets have a Jaccard index of 0.9 or more."""
    linked = similarity_join.link_documents(table(spark, folder, "documents"), n=3, percent=90)
    return linked.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "n_links")


def _judged(scored, threshold: float):
    return scored.select(
        "doc_id",
        (common.id_crc_bucket("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op6_toxicity")
def op6_toxicity(spark, folder):
    """Toxicity of every text, learned from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return _judged(toxicity.score_documents(docs, model), 0.5)


@query("op9_quality")
def op9_quality(spark, folder):
    """Quality of every text, learned from the labels outside the held-out fold."""
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return _judged(quality.score_documents(docs, model), 0.3)


@query("op8_page_text")
def op8_page_text(spark, folder):
    """Main text of every page, blocks labelled by a network trained on a sample of the pages."""
    pages = table(spark, folder, "pages")
    return page_text.extract_main_text(pages, page_text.train(pages))


def _listed(spans):
    """kind:start:end, by kind and start, comma-joined, of flat triples."""
    triple = lambda i: F.struct(*[F.get(spans, (3 * i + j).cast("int")).alias(n) for j, n in enumerate(("kind", "start", "end"))])
    count = (F.size(spans) / 3).cast("int")
    triples = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), triple))
    names = F.array(*[F.lit(k) for k in private_data.KINDS])
    text = F.transform(
        F.array_sort(triples), lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.coalesce(F.array_join(text, ","), F.lit(""))


@query("op7_private_data")
def op7_private_data(spark, folder):
    """Spans of personal data: the fixed patterns, and what a skip-chain field adds to them."""
    docs = table(spark, folder, "documents")
    found = private_data.find_private_data(docs, private_data.train(docs))
    kinds = F.filter("base", lambda x, i: i % 3 == 0)
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(private_data.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
    )


def _codes_sql(rounds: int, parts: int, entries: int) -> str:
    """DuckDB: the codebooks round by round, every distance computed."""
    near = """
    near{r} AS MATERIALIZED (
        SELECT rid, part, min(d)::BIGINT AS d, arg_min(i, d * 256 + i) AS i
        FROM (SELECT rid, x.part, i, x.norm - 2 * list_dot_product(x.v, b.v) + b.norm AS d FROM parts x JOIN book{r} b ON x.part = b.part)
        GROUP BY rid, part)"""
    move = """
    moved{r} AS (
        SELECT part, i, k, floor(sum(x) / count(*)) AS m
        FROM (SELECT part, i, unnest(v) AS x, unnest(range(len(v))) AS k FROM parts JOIN near{r} USING (rid, part)) GROUP BY part, i, k),
    book{s} AS MATERIALIZED (
        SELECT part, i, coalesce(w, v) AS v, list_dot_product(coalesce(w, v), coalesce(w, v)) AS norm
        FROM book{r} LEFT JOIN (SELECT part, i, list(m ORDER BY k) AS w FROM moved{r} GROUP BY part, i) USING (part, i))"""
    steps = ",".join(near.format(r=r) + "," + move.format(r=r, s=r + 1) for r in range(rounds)) + "," + near.format(r=rounds)
    return f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label,
               list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cut AS (SELECT rid, p::INT AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) AS r(p)),
    parts AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS norm FROM cut),
    book0 AS MATERIALIZED (SELECT part, rid::INT AS i, v, norm FROM parts WHERE rid < {entries}),{steps},
    coded AS (
        SELECT rid, string_agg(format('{{:02x}}', i), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY rid),
    digest AS (
        SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, i, k)) AS codebooks_sha256
        FROM (SELECT part, i, unnest(v) AS x, unnest(range(len(v))) AS k FROM book{rounds}))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (rid), digest
    """


@query("op11_vector_codes", sql=_codes_sql(vector_codes.ROUNDS, vector_codes.PARTS, vector_codes.ENTRIES))
def op11_vector_codes(spark, folder):
    """Codes of all vectors in four parts of 256 entries, and the errors summed by label."""
    coded, book = vector_codes.encode_vectors(table(spark, folder, "embeddings"), keep=["label"])
    digest = F.lit(book.digest() if book else None).cast("string").alias("codebooks_sha256")
    return vector_codes.label_errors(common.stored(coded, "codes")).select("vec_id", "code", "error", "label_error", digest)


_CRC_SQL = """
    crc_table AS (
        SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
        FROM range(256) AS r(b))"""


@query(
    "op12_spelling",
    sql=rf"""
    WITH RECURSIVE {_CRC_SQL},
    runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
        WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (
        SELECT *, flatten(list_transform(string_split(id || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END)) AS b
        FROM runs),
    hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS h
        FROM bytes, crc_table),
    edited AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    dropped AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
    shorter AS (SELECT DISTINCT d.word, d.n, w.word AS other, w.n AS other_n FROM dropped d JOIN words w ON d.rest = w.word),
    near AS (
        SELECT word, n, other, other_n FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
        UNION ALL SELECT a.word, a.n, b.word, b.n FROM dropped a JOIN dropped b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    formed AS MATERIALIZED (
        SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
               CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (
        SELECT word, form AS at FROM formed WHERE form IS NOT NULL
        UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL),
    roots AS (SELECT c.word, c.at FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(r.at, f.word) AS root FROM formed f LEFT JOIN roots r ON f.word = r.word
    """,
)
def op12_spelling(spark, folder):
    """Every word of the documents with its accepted form and the last form of the chain."""
    return spelling.group_variants(spelling.corpus_words(table(spark, folder, "documents")))


def _placed_sql(kind: int, pattern: str, kept: str) -> str:
    """DuckDB: matches of one kind with their places, from the gaps between them."""
    return rf"""
    SELECT row_no, start, {kind} AS kind, start + length(m) AS stop, m FROM (
        SELECT row_no, m, sum(length(gap) + length(m)) OVER (PARTITION BY row_no ORDER BY k) - length(m) AS start FROM (
            SELECT row_no, unnest(f) AS m, unnest(string_split_regex(text, $${pattern}$$)[1:len(f)]) AS gap, unnest(range(len(f))) AS k
            FROM (SELECT row_no, text, regexp_extract_all(text, $${pattern}$$) AS f FROM d) WHERE len(f) > 0)) WHERE {kept}"""


def _secrets_sql() -> str:
    base = []
    for kind, (pattern, least, group) in enumerate(secrets.BASE.values()):
        measured = f"regexp_extract(m, $${pattern}$$, {group})" if group else "m"
        base.append(_placed_sql(kind, pattern, f"length({measured}) >= {least}"))
    allowed = " OR ".join(f"regexp_full_match(m, $${p}$$)" for p in secrets.ALLOWED if "\\1" not in p)
    kinds = len(secrets.BASE)
    kind = " ".join(f"WHEN regexp_full_match(m, $${p}$$) THEN {kinds + i}" for i, (_, p, _, _) in enumerate(secrets.CLASSES))
    window = secrets.CLASSES[0][2]
    limits = " ".join(f"WHEN {kinds + i} THEN {secrets.most_weight(w, bits)}" for i, (_, _, w, bits) in enumerate(secrets.CLASSES))
    names = [*secrets.BASE, *(c[0] for c in secrets.CLASSES)]
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
    base AS MATERIALIZED ({" UNION ALL ".join(base)}),
    strings AS (SELECT *, CASE {kind} END AS class FROM ({_placed_sql(-1, secrets.CANDIDATE, "true")})
        WHERE NOT ({allowed} OR length(replace(m, m[1], '')) = 0)),
    counts AS (
        SELECT row_no, start, class, stop, w, c, count(*) AS n
        FROM (SELECT row_no, start, class, stop, w, unnest(string_split(substr(m, w, {window}), '')) AS c
              FROM strings, unnest(range(1, length(m) - {window} + 2)) AS r(w)) GROUP BY ALL),
    weighed AS (
        SELECT row_no, start, class, stop, w, sum(({secrets.weights(window)})[n + 1]) AS weight FROM counts GROUP BY ALL),
    added AS (
        SELECT row_no, start, class AS kind, stop FROM weighed GROUP BY row_no, start, class, stop HAVING min(weight) <= CASE class {limits} END),
    spans AS (
        SELECT row_no, start, kind, ({names})[kind + 1] || ':' || start || ':' || stop AS span
        FROM (SELECT row_no, start, kind, stop FROM base UNION ALL SELECT * FROM added)),
    listed AS (
        SELECT row_no, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {kinds}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
        FROM spans GROUP BY row_no)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN listed USING (row_no)
    """


@query("op13_secrets", sql=_secrets_sql())
def op13_secrets(spark, folder):
    """Secrets of every text: the fixed patterns, and strings of high entropy."""
    found = secrets.find_secrets(table(spark, folder, "documents"))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
