"""Text sizes in tokens of a public tokenizer. The vocabulary's folder is a parameter; nothing is copied or trained."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionframe.session import spread

FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"
_LOADED: dict[str, object] = {}


def tokenizer(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer, read once in each worker."""
    import tiktoken

    path = str(Path(folder) / vocabulary)
    if path not in _LOADED:
        if folder not in sys.path:
            sys.path.append(str(Path(folder).resolve().parent))
        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
        _LOADED[path] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_token_counts(df: DataFrame, text: str, keep: list[Column], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of every row whose text isn't null or blank; the text itself is left behind."""
    rows = df.filter(F.col(text).isNotNull() & (F.length(F.trim(text)) > 0)).select(*keep, F.col(text).alias("text_"))
    names = [c for c in rows.columns if c != "text_"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(folder, vocabulary)
        for b in batches:
            yield b[names].assign(n_tokens=[len(t.encode_ordinary(x)) for x in b["text_"]])

    schema = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "text_")
    return spread(rows, names[0]).mapInPandas(count, schema + ", n_tokens bigint").filter("n_tokens > 0")
