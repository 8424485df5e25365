"""Token counts by sentencepiece or tokenizers, lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.encoding import Pieces, encoded, piece_starts
from labelscope.llm.text import as_bytes, runs

SPACE = "▁"


@lru_cache(maxsize=4)
def sentence_pieces(path: str) -> tuple[Pieces, bool]:
    """A sentencepiece model, and whether texts may be cut at spaces for it.

    They may if the model leaves characters and spaces as they are and none of
    its pieces has a space after another character: no merge reaches over such
    a place.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    same = model.normalize("Ａ  ① ") == f"{SPACE}Ａ{SPACE * 2}①{SPACE}"
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    local = same and not any(SPACE in n.lstrip(SPACE) for n in names)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in pieces]
        # an empty piece is a space that ends a text
        lone = [len(model.encode("x ")) - len(model.encode("x"))] if "" in texts else [0]
        found = model.encode(texts, num_threads=1) if texts else []
        return [lone if not t else [len(ids)] for t, ids in zip(texts, found, strict=True)]

    return Pieces(encode), local


def sentence_counts(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The number of tokens of each text, run by run."""
    pieces, local = sentence_pieces(path)
    for low, high in runs(column):
        data, bounds = as_bytes(column.slice(low, high - low))
        starts = piece_starts(data, bounds, b" " if local else b"")
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, bounds)
        # the model puts a space in front, which stands for the one where a text was cut
        inner = ~np.isin(starts, bounds[:-1])
        a, _, pool = pieces.of(starts + inner, ends, data)
        yield np.diff(np.concatenate([[0], np.cumsum(pool[a].astype(np.int64))])[first])


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            if path.endswith(".model"):
                numbers = list(sentence_counts(text, path))
            else:
                numbers = [np.diff(total) for _, _, _, total in encoded(text, path)]
            n = np.concatenate([np.zeros(0, np.int64), *numbers])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                names=["id", "n_bytes", "n_tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes, n_tokens, over_limit``.

    ``path`` is a tokenizer file (.json) or a sentencepiece model (.model) that
    every executor can read. Texts are taken in runs of equal bytes and split
    before spaces where no token can reach over; each distinct piece of a run
    is encoded once and only lengths come back. A null or empty text has no
    bytes and no tokens. Repeated rows and null ids are counted like others;
    other columns may have any name. An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), size.alias("n_bytes"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_counter(path), f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
