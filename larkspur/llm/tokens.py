"""Exact token counts and ids of a public tokenizer, by batches in Arrow functions.

A text is taken apart at boundaries that its pre-tokenizer never crosses (before
a single ASCII space or line feed between characters that are not white space),
the distinct parts of a batch are encoded together by the library, and the
results are kept for later texts in a bounded cache of the worker. Parts of plain
Latin characters are merged by ``tiktoken`` with the file's own vocabulary, which
gives the same ids faster; a test compares both libraries. A text that
has other white space, or white space beside white space, is encoded as a whole,
in pieces at boundaries of the first kind only.

Defined cases: a null text counts as empty (0 tokens). Texts can be of any
length and none is cut short. Repeated rows give repeated rows. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, thrifty

#: Parts that a worker remembers at most.
CACHE_PARTS = 100_000
#: Characters of texts that are taken apart together, about.
GROUP_CHARS = 1 << 19
#: Bytes of text in one call of the library, about.
CALL_BYTES = 1 << 20
#: Characters beyond which a text is taken in pieces.
PIECE_CHARS = 1 << 16
_PLAIN_BREAK = re.compile(r"[^\S \n]|[ \n][ \n]")
_LATIN = re.compile(r"[!-;=-~\u00a1-\u00ac\u00ae-\u017f]+")
# Fixed value: the word pattern of byte-level BPE files.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(r"(?<=[^\s])(?= [^\s])")


def safe_pieces(text: str, chars: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``chars``, cut only before a single space
    between characters that are not white space; where there is none for long,
    a piece is longer."""
    pieces, at = [], 0
    while len(text) - at > chars:
        cut = _SAFE.search(text, at + chars)
        if cut is None:
            break
        pieces.append(text[at : cut.start()])
        at = cut.start()
    pieces.append(text[at:])
    return pieces


def byte_batches(texts: Iterable[str], size: int = CALL_BYTES) -> Iterator[list[str]]:
    """The texts in lists of about ``size`` characters, however long each is."""
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += len(t)
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def _ranked(head: dict) -> object | None:
    """The same vocabulary as ranks for ``tiktoken``, whose merging is some
    three times as fast, or None unless its ids follow the order of merges.
    It only gets parts of ``_LATIN``, on which both libraries' word patterns
    agree; all other parts, and special strings, go to the file's library."""
    import tiktoken

    model = head["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    if model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or model.get("dropout") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # a byte is shown as itself where printable, else as the next free character from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {a["content"] for a in head.get("added_tokens") or []}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``path`` names a file of the ``tokenizers`` library (.json) or of
    ``sentencepiece`` (.model). Only byte-level files of the first have safe
    boundaries, so all others take whole texts.
    """

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.cache_parts, self.parts, self.ranked = cache_parts, False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            import json

            with open(path) as f:
                head = json.load(f)
            pre = head.get("pre_tokenizer") or {}
            added = head.get("added_tokens") or []
            self.parts = head.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
            if self.parts:
                self.ranked = _ranked(head)
                self.feed = self.encode(["\n"])[0][0]
        self.kept: dict[str, bytes] = {}

    def _ids(self, texts: Sequence[str]) -> list[bytes]:
        out = []
        for batch in byte_batches(texts):
            out += [np.asarray(ids, "<u4").tobytes() for ids in self.encode(batch)]
        return out

    def _learn(self, parts: Iterable[str]) -> None:
        new = list(dict.fromkeys(parts))
        if self.ranked is not None:
            latin, rest = [], []
            for p in new:
                (latin if _LATIN.fullmatch(p) else rest).append(p)
            for at in range(0, len(latin), 2_000):
                some = latin[at : at + 2_000]
                ids = np.asarray(self.ranked.encode_ordinary(" " + "\n ".join(some)), "<u4")
                cuts = [0, *(4 * (np.flatnonzero(ids == self.feed) + 1)).tolist(), 4 * len(ids) + 4]
                raw = ids.tobytes()
                self.kept.update(zip(some, [raw[s : e - 4] for s, e in zip(cuts, cuts[1:])]))
            new = rest
        self.kept.update(zip(new, self._ids([p if p[:1] == "\n" else " " + p for p in new])))

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; null: none. Texts are taken in groups of about
        ``GROUP_CHARS``, so that the parts of a batch are not all held at once."""
        out: list[bytes] = []
        group, held = [], 0
        for t in texts:
            group.append(t)
            held += len(t or "")
            if held >= GROUP_CHARS:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    def _group(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        missing: list[str] = []
        kept = self.kept
        if len(kept) > self.cache_parts:
            kept.clear()
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.parts:
                out[i] = self._ids([text])[0]
            elif _PLAIN_BREAK.search(text):
                out[i] = b"".join(self._ids(safe_pieces(text)))
            else:
                # every part but the first comes after a space or starts with a line feed
                parts = text.replace("\n", " \n").split(" ")
                plain.append((i, parts))
                missing += [p for p in parts[1:] if p not in kept]
        if missing:
            # the parts that a batch lacks are encoded together
            self._learn(missing)
        if plain:
            get = kept.__getitem__
            for (i, parts), first in zip(plain, self._ids([parts[0] for _, parts in plain])):
                parts[0] = first
                out[i] = first + b"".join(map(get, parts[1:]))
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which keeps its cache from one task to the next."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Of each row: its id, ``n_bytes`` of UTF-8, ``n_tokens`` and ``over_limit``,
    whether these are more than ``limit``. ``tokenizer`` is the path of a file
    that every executor can read."""
    arrow_rows(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.array([len(x) // 4 for x in encode(texts)], dtype="int64")
            sizes = np.array([len(t.encode()) if t else 0 for t in texts], dtype="int64")
            del texts
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
