"""Stupid-backoff language-model scores from n-gram counts over the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depdelver.llm.ngram_counts import KEPT, Block, with_totals
from depdelver.llm.textops import SPACES, U, grams, word_blocks
from depdelver.session import cut

ORDER = 3
BACKOFF = 0.4

_SCORE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("partial", pa.float64()), ("n_unigrams", pa.int64())])
SCORE = "doc_id long, n_words long, partial double, n_unigrams long"


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a block, and the document of each."""
    hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for first, end, h, offs in word_blocks(texts, SPACES):
        hashes.append(h)
        docs.append(np.repeat(np.arange(first, end), np.diff(offs)))
    return np.concatenate(hashes), np.concatenate(docs)


def starts(doc: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` words in a row begin that are of one document."""
    return np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.empty(0, np.int64)


def ngrams(order: int):
    """All n-grams of 1 to ``order`` words, those of one word first."""

    def run(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        h, doc = words(texts)
        at = [starts(doc, n) for n in range(1, order + 1)]
        return np.concatenate([grams(h, n)[a] >> U(64 - KEPT) for n, a in enumerate(at, 1)]), np.concatenate([doc[a] for a in at])

    return run


def _score(order: int, backoff: float):
    """The scores of a block's documents, but for the size of the corpus."""

    def run(block: Block) -> pa.Table:
        others = np.empty(len(block.gram))
        others[block.order] = block.total - block.own()  # of each n-gram, its count in the other documents
        doc = words(block.texts)[1]
        m, size = len(doc), len(block.ids)
        # Of every word, by n: the count of the n-gram that ends there, 0 if it would begin before the document.
        seen, past = [], 0
        for n in range(1, order + 1):
            at = starts(doc, n)
            c = np.zeros(m)
            c[at + n - 1] = others[past : past + len(at)]
            past += len(at)
            seen.append(c)
        room = np.minimum(np.arange(m) - np.searchsorted(doc, np.arange(size))[doc], order - 1)
        score = np.log(np.maximum(seen[0], 1)) + np.log(backoff) * (room + (seen[0] == 0))
        level = np.ones(m, np.int64)
        for n in range(2, order + 1):
            use = np.flatnonzero(seen[n - 1] > 0)
            score[use] = np.log(seen[n - 1][use] / seen[n - 2][use - 1]) + np.log(backoff) * (room[use] - n + 1)
            level[use] = n
        sums = [np.bincount(doc, minlength=size), np.bincount(doc, score, minlength=size), np.bincount(doc[level == 1], minlength=size)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((block.ids, *sums), _SCORE, strict=True)], schema=_SCORE)

    return run


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, score (a word) and log_sum (of the document) of every document.

    log_sum is the sum over the words (runs of anything but ASCII white space, A-Z lower-cased)
    of log S: the count of the longest n-gram of up to ``order`` words that ends there and is
    in another document, over the count of its first n - 1 words (of all words for n = 1), times
    ``backoff`` for each longer n-gram of the document that was passed over. A word of no other
    document is passed over too, and counts as one. Counts are those of all other documents: a
    document's own are taken out, so that it is not likely by itself. score is log_sum / n_words.

    Null and empty texts have 0 words, a log_sum of 0 and a null score; null and repeated ids are
    kept row by row, and equal rows are documents that know each other; other columns are not
    read; an empty table gives no rows. ``docs`` should be a table or another deterministic plan.

    The count tables are partitioned by hash and joined to the blocks' exploded n-grams (see
    ``ngram_counts``), which are summed by document. N-grams are told apart by 58 bits of hash.
    """
    n_grams = order / 6  # a word has about six bytes
    partial = cut(with_totals(docs, doc_id, text, ngrams(order), n_grams, _score(order, backoff), SCORE))
    n = partial.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0]
    total = F.col("partial") - F.col("n_unigrams") * F.log(F.greatest(F.lit(n) - F.col("n_words"), F.lit(1)))
    return partial.select("doc_id", "n_words", F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("score"), total.alias("log_sum"))


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    scores = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.withColumns({"score": F.round("score", 6), "log_sum": F.round("log_sum", 3)})


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (
  SELECT doc_id, i, least(i - 1, 2) AS room, w[i] AS g1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3,
         CASE WHEN i > 1 THEN w[i - 1] END AS b1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS b2 FROM i
), own AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest([g1, g2, g3]) AS g FROM p) WHERE g IS NOT NULL GROUP BY ALL),
total AS (SELECT g, sum(c) AS c FROM own GROUP BY g),
o AS MATERIALIZED (SELECT own.doc_id, own.g, total.c - own.c AS c FROM own JOIN total USING (g)),
n AS (SELECT doc_id, len(w) AS n, (SELECT sum(len(w)) FROM d) - len(w) AS rest FROM d),
s AS (
  SELECT p.doc_id, CASE WHEN o3.c > 0 THEN ln(o3.c / c2.c) WHEN o2.c > 0 THEN ln(o2.c / c1.c) + (room - 1) * ln(0.4)
         WHEN o1.c > 0 THEN ln(o1.c / greatest(n.rest, 1)) + room * ln(0.4) ELSE ln(1 / greatest(n.rest, 1)) + (room + 1) * ln(0.4) END AS s
  FROM p JOIN n ON n.doc_id = p.doc_id JOIN o o1 ON o1.doc_id = p.doc_id AND o1.g = p.g1
  LEFT JOIN o o2 ON o2.doc_id = p.doc_id AND o2.g = p.g2 LEFT JOIN o o3 ON o3.doc_id = p.doc_id AND o3.g = p.g3
  LEFT JOIN o c1 ON c1.doc_id = p.doc_id AND c1.g = p.b1 LEFT JOIN o c2 ON c2.doc_id = p.doc_id AND c2.g = p.b2
), t AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, round(t.s / n.n, 6) AS score, round(coalesce(t.s, 0.0), 3) AS log_sum FROM n LEFT JOIN t USING (doc_id)
"""
