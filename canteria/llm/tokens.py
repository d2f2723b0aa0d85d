"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files, and the byte-level vocabulary for many languages.
TOKENIZER_DIR = os.environ.get("CANTERIA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

# Fixed value: how this family of vocabularies cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from this length on are cut out of the text first, where that pattern cuts them: its look-ahead overflows on very long ones.
SPACE_RUN = 1000


@lru_cache(maxsize=2)
def _encoding(name: str, vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(folder: str, name: str) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def encoding(folder: str, name: str):
    return _encoding(name, read_vocabulary(folder, name))


_SPACES = regex.compile(r"\p{White_Space}{%d,}" % SPACE_RUN)


def count(text: str | None, enc) -> int:
    """Tokens of a whole text, as ``enc.encode_ordinary`` gives them; null has none."""
    if not text:
        return 0
    n, at = 0, 0
    for m in _SPACES.finditer(text) if len(text) >= SPACE_RUN else ():
        # One piece, but for the last character where more text follows: that one belongs to what follows.
        end = m.end() - (m.end() < len(text))
        n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end].encode()))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def with_lengths(docs: DataFrame, *keep: str, text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``tokens``, the length of the text; null and empty texts have 0.

    The vocabulary file is read by the driver and sent to the workers (about a
    megabyte, whatever the data), which need not have the folder.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (docs.schema[k] for k in keep)) + ", tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocabulary, sent.value)
        for b in batches:
            lengths = [count(t.as_py(), enc) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lengths, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, text).mapInArrow(run, schema)
