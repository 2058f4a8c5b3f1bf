"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.llm import align, bpe, chat, html_text, langid, maxscore, packing, quality, sharding, simhash, sortmeans, treebpe, warc
from medloom.llm.common import table
from medloom.session import spread


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.  Null or empty html, and pages without text, give an empty text; odd
    markup is skipped; repeated rows stay.  No SQL: it needs a parser and smoothing; tests compare with
    texts cut out by the pages' own structure, and the measures with numpy."""
    return html_text.extract_pages(spread(table(spark, sf_dir, "pages")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive that is read back.  Null html is an empty payload; rows that
    repeat a page_id have a record each; an empty table gives no rows."""
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("uri")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdicts from the stored ledger.  Null texts have no words, so they
    fail; repeated rows have a row each."""
    return quality.quality_report(spread(table(spark, sf_dir, "documents"))).drop("failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policy versions does, from one ledger of all documents."""
    return quality.ablation(quality.ledger(spread(table(spark, sf_dir, "documents"))), "v1", "v2")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places.  Null texts are the end mark alone; repeated rows are
    packed each.  No SQL: it needs the tokenizer; tests unpack the sequences and compare ids and fill."""
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language.  Null texts and texts without letters are ``und``; a table without
    labels learns nothing, and all of it is ``und``.  No SQL: it is trained by gradient descent; tests
    train and predict again with plain loops, and measure held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(spread(docs), langid.fit(docs)).drop("rejected")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector.  Vectors that are null or hold null or non-finite
    numbers take no part, ties rank by id, equal query rows are one query."""
    return maxscore.top_k(spread(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the probe, read back from the formatted text.  Null texts are empty, null
    roles have a header of their own; turns of one number are ordered by their rendered text."""
    return chat.format_digest(spread(table(spark, sf_dir, "conversations")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded.  Null texts have no ids.  No SQL: it needs the merge list; tests
    compare with the tokenizers library on documents and random texts."""
    return bpe.encode_digest(spread(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of equal bytes, in the order of doc_id.  Null texts count one byte; rows that
    repeat a doc_id stand side by side; an empty table gives no rows."""
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component.  Null and blank texts have the fingerprint zero; repeated
    rows have a row each.  No SQL: the hash is not there; tests compare with all pairs."""
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), budget=3, shingle=3)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens in two vocabularies, aligned by bytes.  Null and empty texts, and texts that the tokens do not
    spell, have zeros; repeated rows have a row each.  No SQL: it needs the tokenizers; tests align whole texts."""
    return align.align(spread(table(spark, sf_dir, "documents")))


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by a tree of halves.  Null texts have no ids; repeated rows have a row each.
    No SQL: it needs the ranks; tests compare with the library on documents and random texts."""
    return treebpe.encode_digest(spread(table(spark, sf_dir, "documents")))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds of 40 centroids.  Vectors that are null, of another width or with
    null or non-finite components take no part; repeated rows are vectors each; an empty table gives no rows."""
    return sortmeans.cluster(spread(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, quality, near duplicates, packing; see ``corpus_pipeline``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_warc, op3_quality_rules, quality_ablation, op4_packing, op5_language_id, op6_top_k, op7_chat_format, op8_bpe, op9_sharding, op10_simhash, op11_token_alignment, op12_tree_bpe, op13_sort_means, pipeline)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_MEASURED = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
        w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
        t AS (SELECT doc_id, i, w || chr(10) || lead(w) OVER o || chr(10) || lead(w, 2) OVER o AS win FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM t WHERE win IS NOT NULL),
        r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
        m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words,
                     length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                     length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
                     length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks
              FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))"""
#: The rules of the ledger as SQL over the measurements of m, by name.
_RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "upper_case": "100 * n_upper > 50 * word_chars",
    "marks": "100 * n_marks > 60 * n_words",
    "word_length": "word_chars > 16 * n_words OR 2 * word_chars < 3 * n_words",
    "no_words": "n_words = 0",
    "long_repeated_windows": "n_words >= 50 AND 100 * n_repeat_words > 50 * n_words",
}


def _sort_means_sql(k: int, rounds: int) -> str:
    """Plain rounds: every vector against every centroid."""
    nearest = """a{r} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, c := c)) AS b
              FROM v, c{r} GROUP BY i)"""
    moved = """s{r} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{r}) GROUP BY c, p),
        c{q} AS MATERIALIZED (SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS m FROM s{r} GROUP BY c) AS n USING (c))"""
    steps = [nearest.format(r=r) + ", " + moved.format(r=r, q=r + 1) for r in range(rounds)] + [nearest.format(r=rounds)]
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v AS m FROM (SELECT v, sha256('2:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL) QUALIFY c < {k}),
        {", ".join(steps)}
        SELECT vec_id, b.c AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON c = b.c"""


_POLICY_ROWS = ", ".join(f"('{p}', '{r}')" for p in ("v1", "v2") for r in quality.POLICIES[p])

ORACLES = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT page_id, strlen(h) AS b, d, max(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, b::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN b >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN b >= 1000 AND page_id < first THEN first END AS refers_to
        FROM q""",
    "op3_quality_rules": f"""
        WITH {_MEASURED},
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines)
                    OR 100 * n_upper > 50 * word_chars OR 100 * n_marks > 60 * n_words
                    OR word_chars > 16 * n_words OR 2 * word_chars < 3 * n_words) AS kept
        FROM b""",
    "quality_ablation": f"""
        WITH {_MEASURED},
        p(policy, rule) AS (VALUES {_POLICY_ROWS}),
        f AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM m WHERE {x}" for n, x in _RULES.items())}),
        n AS (SELECT policy, doc_id, count(*) AS n, min(rule) AS one FROM f JOIN p USING (rule) GROUP BY policy, doc_id)
        SELECT policy, rule,
               (SELECT count(*) FROM f WHERE f.rule = p.rule) AS fails,
               (SELECT count(*) FROM n WHERE n.policy = p.policy AND n.n = 1 AND n.one = p.rule) AS only_it,
               (SELECT count(*) FROM m) - (SELECT count(DISTINCT f.doc_id) FROM f JOIN p AS q ON f.rule = q.rule WHERE q.policy = p.policy AND q.rule <> p.rule) AS kept_without
        FROM p""",
    "op7_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS r(i))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + length(role) + 15 + len(regexp_extract_all(text, '### (?:System|User|Assistant|Tool):|### Role\[|</turn>')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op9_sharding": """
        WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
        d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        s AS (SELECT doc_id, octet_length(b) + 1 AS size,
                     xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM d, k),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM s),
        c AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INTEGER AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM c""",
    "op13_sort_means": _sort_means_sql(40, 5),
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
