"""Token counts of whole texts. Huge ones are encoded in overlapping chunks, which are spliced where both encodings must go on alike.

The tokens kept so far are always those of the text up to the end of the last chunk. A next chunk begins ``overlap`` bytes before
that end, at any character, so its first tokens may be wrong. Two kinds of place are proven stable:

* A boundary of pre-tokens in both chunks, so far from the end of the first that neither its look-ahead nor a special token cut
  there can matter. The pre-tokenizer's scan has no memory, so from a common boundary both scans are the same.
* A token that both have at the same bytes, where one pre-token covers the whole overlap in both. Such a pre-token is a run of
  one character class, so it ends at the same place for both. A sequence of tokens is the byte-pair encoding of its bytes if each
  two neighbours are the encoding of theirs, and in a splice at a common token each two neighbours come from one of the chunks.

Where the overlap has neither it is doubled; when it reaches the chunk's start, the chunk is doubled, from the last boundary of
pre-tokens. In the end that is the text in one go.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import pieces, table, texts

#: Texts of more bytes are cut into chunks of so many, which overlap by OVERLAP at first.
CHUNK, OVERLAP = 256 << 10, 1 << 10
#: A run of one class is longer than this; what looks ahead or ends early (a contraction) is shorter.
LEAST_RUN = 16


class Piece:
    """One chunk's tokens: where they begin in the text (bytes), their ids, and which of them begin a pre-token."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, first: np.ndarray, since: int, until: int) -> None:
        self.at, self.ids, self.first, self.since, self.until = at, ids, first, since, until

    def end(self, i: int) -> int:
        return int(self.at[i + 1]) if i + 1 < len(self.at) else self.until


class Counter:
    """Counts tokens as the tokenizer at ``path`` gives them: ``tokenizers`` for .json, ``sentencepiece`` for .model; special
    strings in texts are what the library takes them for, and none are added."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.chunk, self.overlap, self.spliced, self.widened = chunk, overlap, 0, 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole, self.resyncs = (lambda bodies: [len(x) for x in model.encode(bodies, num_threads=1)]), False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda bodies: list(map(len, self.tokenizer.encode_batch_fast(bodies, add_special_tokens=False)))
        self.resyncs = self._byte_level(json.loads(Path(path).read_text()))

    def _byte_level(self, spec: dict) -> bool:
        """Whether the proofs hold: byte-pair merges over the bytes of a memoryless pre-tokenizer's runs, special tokens as they
        stand. Notes the bytes of each token, and how close to a chunk's end nothing is sure."""
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        merges = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk"))
        if not plain or not merges or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            return False
        self.width = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in added)]), np.int64)
        for token, i in model["vocab"].items():
            self.width[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        for t in added:
            self.width[t["id"]] = len(t["content"].encode())
        self.margin = 8 + max((len(t["content"].encode()) for t in added), default=0)
        return True

    def count(self, bodies: list[bytes]) -> list[int]:
        """Numbers of tokens. Short texts go to the library together, huge ones alone in chunks."""
        out = [0] * len(bodies)
        short = [i for i, x in enumerate(bodies) if not self.resyncs or len(x) <= self.chunk]
        for i, n in zip(short, self.whole([bodies[i].decode("utf-8", "replace") for i in short]), strict=True):
            out[i] = n
        for i in set(range(len(bodies))).difference(short):
            out[i] = self.huge(bodies[i].decode("utf-8", "replace").encode())
        return out

    def _encode(self, data: bytes, since: int, until: int) -> Piece:
        found = self.tokenizer.encode(data[since:until].decode(), add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        word = np.array(found.word_ids, np.int64)
        ends = np.cumsum(self.width[ids])
        return Piece(since + ends - self.width[ids], ids, np.concatenate([[True], word[1:] != word[:-1]]), since, until)

    def huge(self, data: bytes) -> int:
        """The tokens of one text, with the memory of one chunk."""

        def place(i: int) -> int:
            """The last place up to ``i`` at which a character begins."""
            while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
                i -= 1
            return min(i, len(data))

        before, sure, length = 0, 0, self.chunk  # tokens before ``sure``, the last known boundary of pre-tokens
        while True:
            kept, i0, now = before, 0, self._encode(data, sure, place(sure + length))
            while now.until < len(data):
                overlap = self.overlap
                while (since := place(now.until - overlap)) > now.since:
                    after = self._encode(data, since, place(since + max(length, 2 * overlap)))
                    if (met := self._meet(now, after, i0)) is not None:
                        break
                    overlap *= 2
                    self.widened += 1
                else:
                    break  # the chunk holds no stable place
                i, j, boundary = met
                kept, i0, now = kept + i - i0, j, after
                self.spliced += 1
                if boundary:
                    before, sure, length = kept, int(now.at[j]), self.chunk
            else:
                return kept + len(now.ids) - i0
            length *= 2

    def _meet(self, a: Piece, b: Piece, i0: int) -> tuple[int, int, bool] | None:
        """Places of tokens in ``a`` (from ``i0`` on) and ``b`` at which ``b`` may take over, and whether pre-tokens begin there."""
        here = np.flatnonzero(a.first & (a.at > b.since) & (a.at <= a.until - self.margin))
        here = here[here >= i0]
        there = np.flatnonzero(b.first)
        _, i, j = np.intersect1d(a.at[here], b.at[there], return_indices=True)
        if len(i):
            return int(here[i[-1]]), int(there[j[-1]]), True
        run = a.until - b.since >= LEAST_RUN + self.margin and not (a.first & (a.at > b.since)).any()
        if not run or (b.first & (b.at > b.since) & (b.at < a.until)).any():
            return None
        inside = np.flatnonzero((a.at > b.since) & (np.arange(len(a.at)) >= i0))
        _, i, j = np.intersect1d(a.at[inside], b.at, return_indices=True)
        for x, y in zip(inside[i][::-1].tolist(), j[::-1].tolist(), strict=True):
            if a.ids[x] == b.ids[y] and a.end(x) < a.until:
                return x, y, False
        return None


@lru_cache(4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One for all tasks of a worker: reading a vocabulary takes about as long as a megabyte of text."""
    return Counter(path, chunk, overlap)


def counted(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each text of ``docs(doc_id, text)``.

    Null is the empty text: no bytes, no tokens. Each row is counted by itself: repeated rows and ids, null ids and other columns
    change nothing. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer_path, chunk, overlap)
        for batch in batches:
            bodies = [x or b"" for x in texts(batch)]
            n = [x for i, j in pieces(bodies, 1 << 20) for x in of.count(bodies[i:j])]
            size, many = pa.array(list(map(len, bodies)), pa.int64()), pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, many, pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
