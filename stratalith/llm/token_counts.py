"""Token counts: exact lengths of all texts and the histogram that answers questions about context limits.

Texts are encoded with a public byte-level vocabulary.  The histogram has a row
for each length that occurs; its suffix sums give, for that length as the
context limit, the documents and tokens that fit, the tokens left when longer
documents are cut, and whether the length is a quantile.  The histogram has as
many rows as there are lengths, not documents: at most as many as the longest
document has tokens, and they pass through one task for the suffix sums.

Edge cases: a null text has no tokens; repeated rows count each; a text of any
length is encoded as a whole; an empty table gives an empty
histogram.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters that are encoded at once; a longer text is cut before a blank that has a letter on either side, where no token crosses.
PIECE = 1 << 16
QUANTILES = (0.5, 0.9, 0.99)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """The text in parts that have the same tokens apart as together."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or vocabulary_path(VOCABULARY)).encode_ordinary
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            sizes = np.fromiter((sum(len(encode(p)) for p in parts(t)) for t in texts), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """A row for each length: context_limit, n_docs, docs_within, docs_over, tokens_within, tokens_truncated, tokens_lost, quantiles."""
    counts = lengths.groupBy(F.col(column).alias("context_limit")).agg(F.count("*").alias("n_docs"))
    down = Window.orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_docs") * F.col("context_limit")
    out = counts.select(
        "context_limit", "n_docs", (F.sum("n_docs").over(down) - F.col("n_docs")).alias("docs_over"), (F.sum(tokens).over(down) - tokens).alias("tokens_over"),
        F.sum("n_docs").over(every).alias("docs"), F.sum(tokens).over(every).alias("tokens"))
    within = F.col("docs") - F.col("docs_over")
    truncated = F.col("tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")
    is_quantile = [F.when((within >= F.ceil(F.col("docs") * q)) & (within - F.col("n_docs") < F.ceil(F.col("docs") * q)), F.lit(q)) for q in QUANTILES]
    return out.select(
        "context_limit", "n_docs", within.alias("docs_within"), "docs_over", (F.col("tokens") - F.col("tokens_over")).alias("tokens_within"),
        truncated.alias("tokens_truncated"), (F.col("tokens") - truncated).alias("tokens_lost"), F.col("tokens").alias("tokens_total"), F.array_compact(F.array(*is_quantile)).alias("quantiles"))
