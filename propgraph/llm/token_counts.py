"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone; those that come back as their own single
id are *proven whole*.  At run time a pre-token found in that set counts one without any merging,
and only the others are merged (each distinct one once per worker).  A stretch with characters whose
class the libraries might see otherwise is one piece here, cut and merged by the library.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from propgraph.llm.common import unused, whole_text
from propgraph.llm.pretokens import Memo, as_shown, byte_of_char, compiled, exotic, pretokens


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def proven_whole(path: str) -> frozenset[str]:
    """The pieces that are one token: vocabulary strings that the pattern leaves whole and that encode alone as their own id."""
    tok, back, find = _tokenizer(path), byte_of_char(), compiled(public_tokenizers.PATTERN).findall
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings: dict[str, int] = {}
    for shown, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            s = bytes(back[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character, or no byte-level string
        if s not in special and (exotic(s) or find(s) == [s]):
            strings[s] = i
    found = tok.encode_batch(list(strings), add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(strings.items(), found, strict=True) if e.ids == [i])


@functools.cache
def _counter(path: str, whole: frozenset[str]):
    tok = _tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = compiled("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
    find = compiled(public_tokenizers.PATTERN).findall
    merge = tok.model.tokenize  # the merges alone: the piece is cut already

    def merged(piece: str) -> int:
        return len(tok.encode(piece, add_special_tokens=False).ids) if exotic(piece) else len(merge(as_shown(piece)))

    value = Memo(merged, dict.fromkeys(whole, 1)).__getitem__

    def count(text: str) -> int:
        parts = cut.split(text) if "<" in text else [text]
        return len(parts) - 1 + sum(sum(map(value, pretokens(p, find))) for p in parts)

    return count


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df's columns but the text, plus n_bytes, n_tokens and over_limit (more than `limit` tokens).

    Null text: the empty text, no tokens.  Strings of special tokens inside a text count as one token
    each, as the tokenizer's default has it.  Rows are independent: repeated rows repeat, an empty
    table gives none, and other columns pass through (one named like a result column is replaced).
    """
    spark = df.sparkSession
    made = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in df.columns if c not in (text, *made)]
    whole = spark.sparkContext.broadcast(proven_whole(tokenizer))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer, whole.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[*rest, *made],
            )

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), "n_bytes long", "n_tokens long", "over_limit boolean"])
    return df.select(*(df[f"`{c}`"] for c in rest), whole_text(df[f"`{text}`"]).alias(unused(df, "body"))).mapInArrow(run, schema)
