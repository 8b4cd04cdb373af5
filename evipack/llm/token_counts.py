"""Token counts: batches of about equal bytes are encoded in Arrow functions that return lengths only.

Long texts are split where no token can cross: before a blank that follows another character. The library puts
a blank before each text it encodes, which stands for the blank left out at the split.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES, PIECE_CHARS, LIMIT = 1 << 18, 1 << 14, 4096
#: The blank, and the sign that the vocabulary writes for it.
BLANKS = " ▁"


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of about `size` characters whose counts add up to the count of the whole text."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut >= 0 and text[cut - 1] in BLANKS:
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 >= len(text):
            break
        out.append(text[start:cut])
        start = cut + 1
    return [*out, text[start:]]


def _counter(model_path: str, batch_bytes: int, piece_chars: int):
    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            counts, pieces, owners, held = [0] * batch.num_rows, [], [], 0

            def flush():
                for owner, ids in zip(owners, model.encode(pieces, num_threads=1), strict=True):
                    counts[owner] += len(ids)
                pieces.clear()
                owners.clear()

            for row, text in enumerate(batch.column(1)):
                for piece in safe_pieces(text.as_py(), piece_chars):
                    pieces.append(piece)
                    owners.append(row)
                    held += len(piece.encode("utf-8"))
                    if held >= batch_bytes:
                        flush()
                        held = 0
            if pieces:
                flush()
            size = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_bytes, n_tokens, over_limit.

    `model_path` is a sentencepiece model without white-space removal, at the same place on every machine. A null
    text counts as empty, which has no tokens. Rows never move between tasks; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counter(model_path, batch_bytes, piece_chars), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
