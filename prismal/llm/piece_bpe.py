"""SentencePiece (BPE) encoding by a table of each prefix's last piece, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DEFAULT_FILE = "piece_bpe_32k.model"
SPACE = "▁"
#: Each byte that isn't part of a character decodes to a replacement character of its own.
codecs.register_error("prismal-each-byte", lambda e: ("\ufffd", e.start + 1))
#: Parts of texts that a worker remembers in each of two generations, and pairs whose compatibility it remembers.
CACHE, PAIRS = 400_000, 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class PieceEncoder:
    """Encodes and decodes as the library does with a BPE model with byte fallback and identity normalization.

    BPE merges the pair of neighbours whose piece has the best score, the leftmost first. Then each prefix of a text
    has one last piece: the only one that ends there and whose pair with the last piece of what stands before it
    is compatible, that is, merging both spelled together gives this very pair. An automaton finds the pieces that end at each
    place; the ids are read from the end backwards. No candidate merges are queued and no scores compared on the way.

    Pieces of equal score break the rule of one order. Where these are runs of spaces, which merge after everything
    else, runs are merged by the leftmost rule itself. A model with other ties, with pieces that hold a
    space after another character, or of another kind is refused.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(len(self.pieces)) if i not in self.bytes and i not in self.silent and not sp.is_unknown(i) and not sp.is_unused(i)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        runs = {i for i in plain if set(self.pieces[i]) == {SPACE} and len(self.pieces[i]) > 1}
        scores = [self.score[i] for i in plain if i not in runs and len(self.pieces[i]) > 1]
        if len(set(scores)) < len(scores) or any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]", self.pieces[i]) for i in plain):
            raise ValueError("pieces with equal scores, or with a space after another character")
        if runs and max(self.score[i] for i in runs) >= min(scores, default=0.0):
            raise ValueError("runs of spaces must merge last")
        if len(self.byte_ids) != 256 or sp.normalize("a  ﬁ") != f"{SPACE}a{SPACE}{SPACE}ﬁ":
            raise ValueError("a model with byte fallback and without normalization is asked for")
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(set(self.ids) - {self.pieces[i] for i in runs}, key=len):
            merged = self.merge(piece)
            if len(merged) > 1:
                continue  # no sequence of merges makes this piece
            i = self.ids[piece]
            if len(piece) > 1:
                self.halves[i] = self._last[0], self._last[1]
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = {c for p in self.ids for c in p}
        # Texts are cut where no piece reaches across: before spaces and around new lines.
        cut = "" if "\n" in self.known else "\n"
        self.parts = re.compile(f"{cut or '(?!)'}|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+")
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older = self.cache
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Plain BPE of known characters, for pieces and short runs; _last is the last merged pair."""
        symbols = [self.ids[c] for c in text]
        while len(symbols) > 1:
            pairs = [(-self.score[m], at) for at in range(len(symbols) - 1) if (m := self.ids.get(self.pieces[symbols[at]] + self.pieces[symbols[at + 1]])) is not None]
            if not pairs:
                break
            at = min(pairs)[1]
            self._last = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [self.ids[self.pieces[symbols[at]] + self.pieces[symbols[at + 1]]]]
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of both, spelled together, leaves them as this pair.

        Goes back in time: undoes the later of the two merges that made the pieces beside the boundary. If, at
        some time, the piece over the boundary would have been merged before those still to come, they are not
        a pair. Time is the score, downwards; at equal scores the left one comes first.
        """
        pieces, score, ids, halves = self.pieces, self.score, self.ids, self.halves
        until = float("-inf"), 1
        while True:
            over = ids.get(pieces[left] + pieces[right])
            if over is not None and (score[over], 0) > until:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and score[left] < score[right]:
                until, left = (score[left], 0), a[1]
            else:
                until, right = (score[right], -1), b[0]

    def _known(self, text: str) -> list[int]:
        last, lengths, pairs = [-1] * (len(text) + 1), [0] * (len(text) + 1), self.pairs
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    pair = before << 32 | piece
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(before, piece)
                    if not fits:
                        continue
                last[end], lengths[end] = piece, length
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= lengths[at]
        return out[::-1]

    def _part(self, part: str) -> list[int]:
        """Ids of spaces followed by other characters, or of either alone."""
        rest = part.lstrip(SPACE)
        spaces = len(part) - len(rest)
        if spaces > 1 or not rest:
            tail = self._part(SPACE + rest) if rest else []
            if tail and tail[0] != self.ids[SPACE]:
                return [*self.merge(SPACE * (spaces - 1)), *tail]
            return [*self.merge(SPACE * spaces), *tail[1:]]
        out, run = [], ""
        for c in part:
            if c in self.known:
                run += c
                continue
            out += self._known(run) if run else []
            out += [self.byte_ids[b] for b in c.encode()]
            run = ""
        return out + (self._known(run) if run else [])

    def _look(self, part: str) -> tuple[int, str, str]:
        """Number of ids, their decimals with a comma before each, and what they decode to, for a part that isn't in the cache."""
        found = self.older.get(part)
        if found is None:
            ids = self._part(part) if part != "\n" or "\n" in self.known else [self.byte_ids[10]]
            found = len(ids), "".join([f",{i}" for i in ids]), self._spell(ids)
        if len(self.cache) >= CACHE:
            self.older, self.cache = self.cache, {}
        self.cache[part] = found
        return found

    def _parts(self, text: str | None) -> list[tuple[int, str, str]]:
        if not text:
            return []
        return [self.cache.get(p) or self._look(p) for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self._parts(text) for i in ids[1:].split(",")]

    def _spell(self, ids: list[int]) -> str:
        """Pieces with their spaces, runs of byte pieces as UTF-8."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(bytes(held).decode("utf-8", "prismal-each-byte"))
                held.clear()
            if i >= 0 and i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._spell(ids)
        return text[1:] if text[:1] == " " and next((i for i in ids if i not in self.silent), -1) in self.ids.values() else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimals joined by commas, and SHA-256 of decode(ids)."""
        parts = self._parts(text)
        ids = "".join([p[1] for p in parts])[1:]
        spelled = "".join([p[2] for p in parts])
        decoded = spelled[1:]  # every text begins with the space that encoding put before it
        return sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with piece_ids, the ids of every whole text, added; null and empty texts have none. Repeated rows repeat, an
    empty table gives an empty one, and a column of that name is replaced."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encoder(path).encode(t) for t in texts], index=texts.index)

    return docs.withColumn("piece_ids", ids("text"))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with decoded, the text of piece_ids, added; null and empty ids give an empty text, ids that the file lacks are an
    error. Repeated rows repeat, an empty table gives an empty one, and a column of that name is replaced."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([encoder(path).decode([] if i is None else [int(x) for x in i]) for i in ids], index=ids.index)

    return rows.withColumn("decoded", text("piece_ids"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the same encoding and decoding, without the ids themselves."""
    path = path or default_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([encoder(path).digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
