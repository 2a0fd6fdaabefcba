"""The queries of the text operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import ann, backoff_lm, fingerprint, gam, jaccard_join, langid, mixing, packing, pii, secrets

PIECES_FILE, TOKENIZER_FILE = "piece_bpe_32k.model", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`: counts and digest of the strict patterns' spans, and all spans, also those that patterns add. A null text has none."""
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text of `documents` and of its edited text, and their likeness. A null text is empty; ids that repeat are ordered by text."""
    return fingerprint.edited_likeness(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it. A null text has no words; a null source is a source, the last one."""
    mixed = mixing.mix_copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of four-word shingles and its component of links at 0.85 or more. Texts without words link with nothing."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` scored by the model of those that are not held out. A null text has its end alone."""
    return backoff_lm.train_and_score(_table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str, pieces_path: str | None = None) -> DataFrame:
    """The language of every whole text of `documents`, learned from those that are not held out; `und` for a null text or one without a letter."""
    pieces = langid.read_pieces(pieces_path or tokenizer_path(PIECES_FILE))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, pieces).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`: counts and digest of the strict patterns' spans, and all spans, also literals of sensitive names. A null text has none."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20, among all others. Vectors null, zero or not finite take no part."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of `documents`, learned from labels of those that are not held out. A null text is scored as an empty one."""
    return gam.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all `documents` in sequences of at most 4096 tokens. A null text has its end alone."""
    with open(tokenizer or tokenizer_path(TOKENIZER_FILE), encoding="utf-8") as f:
        model = f.read()
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_fingerprint, op3_mixing, op4_jaccard, op5_lm, op6_langid, op7_secrets, op8_ann, op9_quality, op10_packing)}


#: Word shingles of whole texts, links by exact set sizes, components by recursion; copies of a set are one node.
_OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w
), sets AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS node, g FROM s),
nodes AS (SELECT node, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM sets WHERE n > 0 GROUP BY node),
tokens AS (SELECT rep, n, unnest(g) AS t FROM nodes),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rep, rep FROM nodes UNION SELECT r.x, b.y FROM reach r JOIN edges b ON b.x = r.y),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(coalesce(l.c, s.doc_id) AS BIGINT) AS component_id
FROM sets s LEFT JOIN nodes n ON n.node = s.node AND s.n > 0 LEFT JOIN least l ON l.x = n.rep
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express: the shingle join. The other operators are held against brute force in tests."""
    return {"op4_jaccard": _OP4_SQL}
