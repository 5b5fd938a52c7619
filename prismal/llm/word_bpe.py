"""Encoding by a tokenizers file: a batch's distinct words are encoded once, and its texts put together from them."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

DEFAULT_FILE = "word_bpe_49k.json"
#: Bytes of the texts that are encoded together (a longer text is encoded alone), and parts of words that the library is given at a time.
BATCH_BYTES, PARTS = 4 << 20, 20_000
#: Signs, letters, signs. Below U+0130 letters have no combining forms, and lower case maps each to itself or to one letter.
_SIGNS, _LETTERS = "!-&(-/:;=>?@\\[-`{-~", "A-Za-zªµºÀ-ÖØ-öø-į"
_PLAIN = f"^(?P<before>[{_SIGNS}]*)(?P<letters>[{_LETTERS}]*)(?P<after>[{_SIGNS}]*)$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _taken(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ids that start at `starts` and are `counts` long, one after the other."""
    at = np.repeat(starts - (counts.cumsum() - counts), counts)
    at += np.arange(len(at))
    return ids[at]


class WordEncoder:
    """texts -> their ids.

    Holds for a file whose splits never cross ASCII white space and that drops it, as DEFAULT_FILE does: a text's ids
    are those of its words. A word of signs, letters and signs is split there too, as the file's own pattern
    does; the library's model encodes the parts, each of which ends with an id of the model's suffix. The library encodes
    every other word as a whole; "<", with which added tokens begin, is none of the signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, and how many each has; an empty part has none."""
        there = pc.not_equal(parts, "")
        some, counts = parts.filter(there), np.zeros(len(parts), np.int64)
        if not len(some):
            return np.zeros(0, np.uint32), counts
        steps = [*range(0, len(some), PARTS), len(some)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(steps, pa.int32()), some), " ")
        # Without offsets.
        ids = np.concatenate([np.array(self.parts.encode_batch_fast([x.as_py()], add_special_tokens=False)[0].ids, np.uint32) for x in joined])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(some):
            raise ValueError("the model doesn't end each word with its suffix")
        counts[there.to_numpy(zero_copy_only=False)] = np.diff(ends, prepend=0)
        return ids, counts

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where and how many those of each word are."""
        split = pc.extract_regex(words, _PLAIN)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        before, letters, after = [pc.fill_null(c, "") for c in split.flatten()]
        parts = pa.concat_arrays([before, pc.utf8_lower(letters), after]).dictionary_encode()
        part_ids, part_counts = self._part_ids(parts.dictionary)
        order = parts.indices.to_numpy().reshape(3, -1).T  # the three parts of a word side by side
        ids = _taken(part_ids, (part_counts.cumsum() - part_counts)[order.ravel()], part_counts[order.ravel()])
        counts = part_counts[order].sum(1)
        starts = counts.cumsum() - counts
        if not plain.all():
            rest = np.flatnonzero(~plain)
            whole = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in words.take(pa.array(rest)).to_pylist()]
            counts[rest] = [len(x) for x in whole]
            starts[rest] = len(ids) + counts[rest].cumsum() - counts[rest]
            ids = np.concatenate([ids, *whole])
        return ids, starts, counts

    def _encode(self, texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        ids, starts, counts = self._word_ids(words.dictionary)
        at = words.indices.to_numpy()
        data = memoryview(_taken(ids, starts[at], counts[at]).astype("<u4").tobytes())
        after = np.append(0, counts[at].cumsum())[np.append(0, lists.value_lengths().to_numpy().cumsum())] * 4
        return [bytes(data[a:b]) for a, b in zip(after[:-1].tolist(), after[1:].tolist(), strict=True)]

    def encode_all(self, texts: pa.Array, size: int | None = None) -> Iterator[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers; null counts as empty. size: bytes of texts at a time, instead of BATCH_BYTES."""
        size = size or BATCH_BYTES
        ends = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64).cumsum()
        at = 0
        while at < len(texts):
            sent = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, sent + size, side="right")))
            yield from self._encode(texts.slice(at, to - at))
            at = to

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))


def encoder(path: str) -> WordEncoder:
    """One for each worker, of the file used last."""
    return remembered(f"word_bpe {path}", lambda: WordEncoder(path))
