"""Token counts and token ids of whole texts with a public tokenizer file.

Texts go to the encoder in Arrow batches that are balanced by bytes; a long
text is cut at safe boundaries only, so the ids of its parts, joined, are the
ids of the whole.  Only lengths (or packed ids) leave the function.

Safe boundaries of the word-level tokenizer: a space or a line feed.  Its
pre-tokenizer always breaks there, its normaliser composes nothing with them and
none of its special strings contains one.  Between two boundaries the
ids of a chunk do not depend on its neighbours, so they are kept in a bounded
dictionary for each worker.  New chunks made of Latin letters,
digits and plain punctuation are merged by the byte-pair engine of ``tiktoken``
over the same vocabulary (equal ids, an eighth of the time); all other new chunks of a slice
go to ``tokenizers`` as one batch.

Defined results: null text counts as empty and has no tokens; repeated rows are
counted each; ids keep their type; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from roadflow.llm.common import by_bytes, map_batches, texts

TOKENIZER = "word_bpe_49k.json"
#: Chunks kept by a worker; some 200 bytes each.
CACHE_CHUNKS = 200_000
#: Text bytes handed to the encoder at once.
BATCH_BYTES = 1 << 20
#: Characters of a text that are looked at together.
SLICE_CHARS = 1 << 18


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Chunks that the byte-pair engine may encode: no apostrophe (contractions), no "<" (special strings).
_PLAIN = re.compile(r"(?:[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=>?@\[-`{-~]+)+")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=>?@\[-`{-~]+")
_WIDE = re.compile(r"[^\x00-\xff]")


class WordEncoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # printable stand-ins for bytes, as byte-level vocabularies write them
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, i in vocab.items():
            end = token.endswith("</w>")
            ranks[bytes(byte_of[c] for c in token[: -4 if end else None]) + b"\xff" * end] = i  # 255 is no byte of UTF-8
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, chunk: str) -> list[int] | None:
        """The ids of a chunk that the byte-pair engine may encode."""
        word = chunk.rstrip(".,;:!?")
        if word.isalpha() and max(word) <= "\xff":  # a word, maybe with plain punctuation behind it
            ids = self.merge(word.lower().encode() + b"\xff")
            if len(word) < len(chunk):
                ids = ids + self.merge(chunk[len(word) :].encode() + b"\xff")
        else:
            low = chunk if _WIDE.search(chunk) else chunk.lower()
            if not _PLAIN.fullmatch(low) or "<" in chunk:
                return None
            ids = [i for piece in _PIECES.findall(low) for i in self.merge(piece.encode() + b"\xff")]
        return ids

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Encode new chunks; those too long to keep are returned."""
        found = {c: self._plain(c) for c in chunks}
        rest = [c for c, ids in found.items() if ids is None]
        if rest:
            found.update(zip(rest, (e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False))))
        packed = {c: array("I", ids).tobytes() for c, ids in found.items()}
        self.update((c, x) for c, x in packed.items() if len(c) <= 64)
        return {c: x for c, x in packed.items() if len(c) > 64}

    def packed(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, in parts."""
        lower = "<|" not in text and not _WIDE.search(text)
        for part in slices(text):
            if len(self) > CACHE_CHUNKS:
                self.clear()
            chunks = (part.lower() if lower else part).replace("\n", " ").split(" ")
            long = self._learn(new) if (new := [c for c in dict.fromkeys(chunks) if c not in self]) else {}
            yield b"".join([long[c] if c in long else self[c] for c in chunks] if long else map(self.__getitem__, chunks))


def slices(text: str, limit: int | None = None) -> Iterator[str]:
    """Parts of a text that end at safe boundaries; without one, a part grows until the next."""
    limit = limit or SLICE_CHARS
    at = 0
    while len(text) - at > limit:
        cut = text.rfind(" ", at + 1, at + limit)
        if cut < 0:
            ends = [i for i in (text.find(" ", at + limit), text.find("\n", at + limit)) if i >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def _other_encoder(path: str):
    """Any other public tokenizer file; whole texts, as its library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    return lambda batch: [len(e) for e in lib.encode_batch_fast(batch, add_special_tokens=False)]


def _count(batch: pa.RecordBatch, name: str):
    path = tokenizer_path(name)
    column = batch.column(1)
    sizes = pc.binary_length(column)
    counts: list[int] = []
    for a, b in by_bytes(column, BATCH_BYTES):
        part = column.slice(a, b - a).to_pylist()
        if name == TOKENIZER:
            encoder = word_encoder(path)
            counts += [sum(map(len, encoder.packed(t))) // 4 for t in part]
        else:
            counts += _other_encoder(path)(part)
    yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text; no shuffle, no ids leave the worker."""
    return map_batches(texts(df, id_col, text_col), _count, f"doc_id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long", tokenizer)
