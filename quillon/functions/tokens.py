"""Token lengths and loss masks by the user's own tokenizer.

A tokenizer is a file: ``.json`` of the ``tokenizers`` library or ``.model`` of
``sentencepiece``.  The driver reads it once and broadcasts its bytes (at most
``MOST_BYTES``), so no executor needs the file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import ship

MOST_BYTES = 64 << 20
#: How a message is rendered, what comes before the content and after.
HEAD, TAIL = ("<|im_start|>", "\n"), "<|im_end|>\n"


@lru_cache(maxsize=4)
def _encode(kind: str, content: bytes) -> Callable[[str], list[int]]:
    if kind == "model":
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=content).encode
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content.decode())
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Tokens:
    """Token columns of one tokenizer; null is encoded as an empty text."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        ship(spark)
        if "://" in path:
            content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        else:
            with open(path, "rb") as f:
                content = f.read()
        if len(content) > MOST_BYTES:
            raise ValueError(f"{path} has {len(content)} bytes, more than {MOST_BYTES}")
        self.kind, self.content = path.rsplit(".", 1)[-1], spark.sparkContext.broadcast(content)

    def _udf(self, each: Callable, returns: str):
        kind, content = self.kind, self.content

        def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = _encode(kind, content.value)
            for column in columns:
                yield pd.Series([each(encode, x) for x in column], dtype=object)

        run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, returns)

    def length(self, text: Column) -> Column:
        return self._udf(lambda encode, x: len(encode(x or "")), "int")(text)

    def ids(self, text: Column) -> Column:
        return self._udf(lambda encode, x: encode(x or ""), "array<int>")(text)

    def ids_of_parts(self, parts: Column) -> Column:
        """Ids of each text of an array, which are encoded apart."""
        return self._udf(lambda encode, x: [encode(y or "") for y in (() if x is None else x)], "array<array<int>>")(parts)


def with_length(df: DataFrame, text: Column, tokens: Tokens, name: str = "token_len") -> DataFrame:
    """The rows with their token count.  Written as a table, a limit on it is a
    comparison that the scan can use."""
    return df.withColumn(name, tokens.length(text))


def rendered(messages: Column) -> Column:
    """Two parts for each message (``role``, ``content``): what leads to the content,
    and the content with its end.  All of a chat joined are its rendering, and the
    parts of the first n messages are that of the first n."""
    none = F.lit("")
    head = lambda m: F.concat(F.lit(HEAD[0]), F.coalesce(m["role"], none), F.lit(HEAD[1]))
    return F.flatten(F.transform(messages, lambda m: F.array(head(m), F.concat(F.coalesce(m["content"], none), F.lit(TAIL)))))


def multi_turn(df: DataFrame, messages: str, tokens: Tokens, learned: str = "assistant") -> DataFrame:
    """``input_ids`` of a chat and ``loss_mask``: what each message adds to the
    rendering of those before it is encoded apart, and 1 stands on the tokens of the
    learned role's contents and their ends, 0 on all others.  A chat without messages
    has no tokens."""
    chat = F.coalesce(F.col(messages), F.array().cast(df.schema[messages].dataType))
    parts = df.withColumn("_parts", tokens.ids_of_parts(rendered(chat)))
    said = F.flatten(F.transform(chat, lambda m: F.array(F.lit(0), m["role"].eqNullSafe(learned).cast("int"))))
    mask = F.flatten(F.zip_with("_parts", said, lambda ids, bit: F.array_repeat(bit, F.size(ids))))
    return parts.withColumn("input_ids", F.flatten("_parts")).withColumn("loss_mask", mask).drop("_parts")
