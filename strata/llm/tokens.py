"""Encoding and decoding of a whole corpus with a public byte-level tokenizer.

The vocabulary file is a parameter. The driver reads it once and broadcasts its text, a fixed-size
file of a few MB; each Python worker builds the tokenizer once. Texts pass as Arrow batches and are
never cut.

Defined results: a null or an empty text has no tokens; strings that look like special tokens are
ordinary text. Tables without rows give none. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.layout import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters handed to the tokenizer at once; bounds the memory for its results, cuts no text.
CHARS_AT_ONCE = 2_000_000

_built: dict[int, object] = {}


def _tokenizer(text: str):
    """The worker's tokenizer for a vocabulary; built once per process."""
    key = hash(text)
    if key not in _built:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.encode_special_tokens = True
        _built[key] = t
    return _built[key]


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, for the characters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(vocabulary_text: str) -> dict[int, bytes]:
    """The bytes of each token id; added tokens stand for their own text."""
    table, spec = byte_of_character(), json.loads(vocabulary_text)
    out = {i: bytes(table[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    return out | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def _vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > CHARS_AT_ONCE:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def _lists(lengths: list[int], flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, id: str, text: str, *, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids), with ``offsets`` also begins and ends: the characters that each token covers.

    A token may hold only some bytes of a character; it then covers that whole character, as do its
    neighbours that hold the rest.
    """
    content = _vocabulary(df, vocabulary)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(content.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lengths, ids, spans = [], [], []
            for chunk in _chunks(texts):
                for e in (t.encode_batch if offsets else t.encode_batch_fast)(chunk, add_special_tokens=False):
                    lengths.append(len(e.ids))
                    ids.append(np.asarray(e.ids, np.int32))
                    if offsets:
                        spans.append(np.asarray(e.offsets, np.int32).reshape(-1, 2))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            cols, names = [batch.column(0), _lists(lengths, flat)], [id, "ids"]
            if offsets:
                both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
                cols += [_lists(lengths, both[:, 0]), _lists(lengths, both[:, 1])]
                names += ["begins", "ends"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id}` {kind}, ids array<int>" + (", begins array<int>, ends array<int>" if offsets else "")
    return spread(df.select(id, text), id).mapInArrow(run, schema)


def count(df: DataFrame, id: str, text: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens)."""
    content = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(content.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [len(e.ids) for chunk in _chunks(texts) for e in t.encode_batch_fast(chunk, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id, "n_tokens"])

    return spread(df.select(id, text), id).mapInArrow(run, f"`{id}` {df.schema[id].dataType.simpleString()}, n_tokens bigint")


def decode(df: DataFrame, id: str, ids: str, *, vocabulary: str = VOCABULARY, pieces: bool = False) -> DataFrame:
    """(id, text), with ``pieces`` also what each token adds to the text of a list of ids.

    A character whose bytes are split over tokens is added by the token that completes it. Bytes
    that never complete a character, as where a list was cut, and ids that the vocabulary lacks
    come out as U+FFFD. A null list gives the empty text.
    """
    content = _vocabulary(df, vocabulary)

    def parts(table: dict[int, bytes], tokens: list[int]) -> list[str]:
        part = codecs.getincrementaldecoder("utf-8")("replace")
        own = [part.decode(table.get(i, b"\xff")) for i in tokens]
        if rest := part.decode(b"", final=True):
            own[-1] += rest
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(content.value)
        for batch in batches:
            lists = [x or () for x in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([b"".join([table.get(i, b"\xff") for i in x]).decode("utf-8", "replace") for x in lists], pa.string())]
            if pieces:
                cols.append(pa.array([parts(table, x) for x in lists], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, [id, "text", "pieces"][: len(cols)])

    schema = f"`{id}` {df.schema[id].dataType.simpleString()}, text string" + (", pieces array<string>" if pieces else "")
    return df.select(id, ids).mapInArrow(run, schema)
