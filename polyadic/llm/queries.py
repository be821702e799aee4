"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents; of equal texts the largest doc_id stays."""
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    from .bpe import byte_bpe
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), end_id=1), size=2048)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.95 or more."""
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; learned where crc32(doc_id) mod 5 is not 0."""
    from .quality import quality_scores

    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_remainder(5) != 0)
    return scores.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; learned where crc32(doc_id) mod 4 is not 2."""
    from .toxicity import toxicity_scores

    scores = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_remainder(4) != 2)
    return scores.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a SentencePiece model and decoded again."""
    import public_tokenizers

    from .wfst import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    from .html_layout import extract

    return extract(_table(spark, sf_dir, "pages"))


CONTROL_CONVERSATION = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -1, read back from their formatted texts."""
    from .chat_template import digest, format_conversations

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CONVERSATION).alias("text"))
    return digest(format_conversations(turns.unionByName(more)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned where crc32(doc_id) mod 3 is not 1."""
    from .lang_id import identify

    found = identify(_table(spark, sf_dir, "documents"), learn=_remainder(3) != 1)
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two to five words of each language, by how strongly their parts attract one another."""
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh one's label is shifted by one."""
    from .hard_negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, anchors=F.col("vec_id") % 100 == 0)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    from .fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extraction": op5_html_extraction,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_document_fingerprints": op13_document_fingerprints,
}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE list_count(embedding) = len(embedding)),
        s AS (SELECT vec_id, x, len(x) AS d FROM e WHERE list_inner_product(x, x) > 0 AND isfinite(list_inner_product(x, x))),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        c(v, r) AS (SELECT a, b FROM l UNION SELECT c.v, l.b FROM c JOIN l ON c.r = l.a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), m AS (SELECT v AS vec_id, min(r) AS m FROM c GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
        FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)""",
    "op6_chat_formatting": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
                     + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
                     + (length(text) - length(replace(text, '[/INST]', ''))) // 7 + (length(text) - length(replace(text, '<|', ''))) // 2
                     + (length(text) - length(replace(text, '|>', ''))) // 2 + (length(text) - length(replace(text, '<s>', ''))) // 3
                     + length(role) + 13 AS size FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(size) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_collocations": f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_NORM}, '[.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents),
        p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM d),
        o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
              FROM p CROSS JOIN (SELECT unnest(range(1, 6)) AS k)),
        g AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
        t AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
        u AS (SELECT *, unnest(range(1, words)) AS cut FROM c),
        s AS (SELECT u.lang, u.phrase, u.a, x.f AS l, y.f AS r, t.n, cut,
                     CAST(1000 AS HUGEINT) * CAST(u.a AS HUGEINT) * CAST(t.n AS HUGEINT) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
              FROM u JOIN t ON u.lang = t.lang
              JOIN g x ON x.lang = u.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
              JOIN g y ON y.lang = u.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, words), ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT DISTINCT long.lang, array_to_string(list_slice(long.w, pos, pos + m.k - 1), ' ') AS phrase, long.a
              FROM (SELECT *, unnest(range(1, words + 1)) AS pos FROM c) long CROSS JOIN (SELECT unnest(range(2, 5)) AS k) m
              WHERE m.k < long.words AND pos + m.k - 1 <= long.words),
        z AS (SELECT b.* FROM b ANTI JOIN i ON b.lang = i.lang AND b.phrase = i.phrase AND 100 * i.a >= 100 * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM z QUALIFY rank <= 2000""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS q
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
                     AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
                     row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS k
              FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
        SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
        FROM n WHERE k <= 5""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
