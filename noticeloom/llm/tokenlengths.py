"""Operator 6: token counts of whole texts with a sentencepiece model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.common import sliced, table

#: Bytes of text encoded in one call, and segments whose length a worker remembers.
CALL_BYTES, MEMO = 1 << 20, 200_000

#: The library's own mark for a blank.
BLANK = "▁"
_SAFE = re.compile(rf"(?<=[^ {BLANK}]) (?=[^ {BLANK}])")

_models: dict[str, tuple] = {}


def safe_segments(text: str) -> list[str]:
    """Cut at single blanks between other characters; the blank goes.

    No piece of the vocabulary has the blank's mark after another character, so no merge
    crosses such a place, and the mark that the encoder puts before every text is the one
    that the dropped blank would have been.
    """
    if "  " in text or BLANK in text or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    return text.split(" ")


def _model(path: str):
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        separable = not any(BLANK in p.lstrip(BLANK) for p in pieces) and model.encode("a a") == model.encode("a") * 2
        _models[path] = model, separable, {}
    return _models[path]


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """The number of tokens of each text, in calls of about ``CALL_BYTES``."""
    model, separable, memo = _model(path)
    cut_up = [safe_segments(t) if separable and t else [t] if t else [] for t in texts]
    if len(memo) > MEMO:
        memo.clear()
    new = list({s for segments in cut_up for s in segments if s not in memo})
    local = {}
    for part in balanced([len(s.encode()) for s in new], CALL_BYTES):
        local.update(zip(new[part], map(len, model.encode(new[part], num_threads=1)), strict=True))
    memo.update((s, n) for s, n in local.items() if len(s) <= 64)
    return [sum(memo[s] if s in memo else local[s] for s in segments) for segments in cut_up]


def balanced(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices whose sizes sum to ``most`` at most; a larger one stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; only lengths leave the Arrow function.

    Batches are balanced by the bytes of their texts, whatever the script. Null and empty texts have no
    tokens. Long texts are split at blanks where no token can span, so the sum is the library's own
    count; a text without such a place is encoded whole. Repeated rows and ids are counted each, a null id
    stays; other columns play no part, whatever their names; an empty table gives no rows.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_bytes").to_pylist()
            counts = [n for part in balanced(sizes, 4 * CALL_BYTES) for n in count_batch(texts[part], model_path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
