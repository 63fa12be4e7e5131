"""Byte-pair encoding and decoding with a published merge list, as a stream.

Encoding is a transducer with bounded lookahead. Two facts carry it. First, neighbours decide: a row of tokens is
what the merges make of its text if and only if every two neighbours are (`fits`). So each prefix of a word has
exactly one last token, found by trying the tokens that end there against the last token of the prefix before.
Second, no token is longer than `lookahead` bytes, which the merge list tells: whatever follows, one of the last
`lookahead` places is the end of a token. Tokens on which the encodings up to all these places agree are stable
and are put out; what must be remembered is only what comes after them.

Decoding is a state machine over bytes. `Written` reads ids in any cuts and puts out the tokens as the vocabulary writes
them, with blanks between, which is what the tokenizers library's decode() gives for a file without a decoder; its state
is an unfinished id of up to three bytes, and whether a token came before. `Decoder` gives the text itself: each token adds
its bytes, characters come out when complete, and the state between two tokens is an unfinished character of up to three bytes.

A text is encoded in pieces of about PIECE characters, cut at blanks and line ends (where no word, special token or
normal form goes across), and decoded piece by piece, so that neither its normal form nor its ids are held as a whole; a
stretch without either is one piece. The normal form, the pattern of words and the special tokens are read from the
tokenizer's file, whose path is a parameter; nothing is trained. Words that came lately are remembered, up to CACHE of them.

Defined results: null and empty texts have no tokens; a special token's string in a text is that token, as the file
says; a lone surrogate can't be in a Spark string.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE, CACHED_LENGTH, PIECE = 300_000, 40, 1 << 16
_NEVER = 1 << 60
_SHORT = (3, 2, 1)


def _byte_letters() -> dict[int, str]:
    """The printable character for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _sizes(tokens: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
    """The lengths of the tokens that end with the same four bytes, longest first; those up to three are always among them."""
    found: dict[bytes, set[int]] = {}
    for raw in tokens:
        if len(raw) > 3:
            found.setdefault(raw[-4:], {1, 2, 3}).add(len(raw))
    return {end: tuple(sorted(sizes, reverse=True)) for end, sizes in found.items()}


class Bpe:
    """A vocabulary with word ends and ranked merges, read from a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, vocab = told["model"], told["model"]["vocab"]
        end, letters = model["end_of_word_suffix"], _byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.shown: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner: dict[bytes, int] = {}  # tokens inside a word
        self.final: dict[bytes, int] = {}  # tokens at its end
        self.bytes: dict[int, tuple[bytes, bool]] = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            is_end = token.endswith(end)
            raw = bytes(back[c] for c in (token[: -len(end)] if is_end else token))
            (self.final if is_end else self.inner)[raw] = i
            self.bytes[i] = raw, is_end
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left part, right part
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.made[c] = r, a, b
        #: Sufficient: every `lookahead` bytes a token ends.
        self.lookahead = max(len(raw) for raw, _ in self.bytes.values())
        self._inner_sizes, self._final_sizes = _sizes(self.inner), _sizes(self.final)
        #: The most bytes that a word's stream has held so far.
        self.most_held = 0
        self._cuts = not any(set(t) & {" ", "\n"} for t in self.special)
        self._fits: dict[int, bool] = {}
        split = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        #: \s of the file's pattern language is Unicode's White_Space, which here leaves U+001C to U+001F out.
        self._words = regex.compile(split.replace("[^\\s", "[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._seen = _Memory(self._chunk)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between these two tokens alone.

        Undoing the later merge of the two each time shows which parts met at the border, and until when; they would
        have merged if their rank comes first (at the same rank, the pair further left does).
        """
        key = a << 20 | b
        if (known := self._fits.get(key)) is not None:
            return known
        left_until, right_until, good = _NEVER, _NEVER, True
        while True:
            r = self.rank.get((a, b), _NEVER)
            if r < left_until and r <= right_until and r != _NEVER:
                good = False
                break
            by_left, by_right = self.made.get(a), self.made.get(b)
            if by_left is None and by_right is None:
                break
            if by_right is None or by_left is not None and by_left[0] > by_right[0]:
                left_until, _, a = by_left
            else:
                right_until, b, _ = by_right
        if len(self._fits) >= 2 * CACHE:
            self._fits.clear()
        self._fits[key] = good
        return good

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word, given in blocks of bytes, each as soon as it is stable."""
        held = b""  # since the last stable place
        last: dict[int, tuple[int, int]] = {0: (-1, 0)}  # by place in `held`, where asked for: the token that ends there, and its length; at 0 the token put out last
        blocks = iter(blocks)
        block = next(blocks, b"")
        while block:
            held += block
            block, n = next(blocks, b""), len(held)
            if not block:
                self._ending(held, last, n, self.final, self._final_sizes)
                yield from self._back(last, n)
            elif n >= 4 * self.lookahead:
                self.most_held = max(self.most_held, n)
                for place in range(n - self.lookahead + 1, n + 1):
                    if place not in last:
                        self._ending(held, last, place, self.inner, self._inner_sizes)
                if stable := self._agreed(last, n):
                    yield from self._back(last, stable)
                    held = held[stable:]
                    last = {p - stable: x for p, x in last.items() if p > stable} | {0: (last[stable][0], 0)}

    def _ending(self, held: bytes, last: dict[int, tuple[int, int]], n: int, known: dict[bytes, int], sizes: dict[bytes, tuple[int, ...]]) -> tuple[int, int]:
        """The token that ends at place n: the one that fits the token before it."""
        for size in sizes.get(held[n - 4 : n], _SHORT) if n > 3 else range(n, 0, -1):
            if size <= n and (token := known.get(held[n - size : n])) is not None:
                before = (last.get(n - size) or self._ending(held, last, n - size, self.inner, self._inner_sizes))[0]
                good = before < 0 or self._fits.get(before << 20 | token)
                if good or good is None and self.fits(before, token):
                    last[n] = found = token, size
                    return found
        raise ValueError("a byte without a token")

    def _agreed(self, last: dict[int, tuple[int, int]], n: int) -> int:
        """The furthest place where a token ends in the encodings up to each of the last places."""
        places = set(range(n - self.lookahead + 1, n + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - last[top][1])
        return places.pop()

    @staticmethod
    def _back(last: dict[int, tuple[int, int]], n: int) -> list[int]:
        out = []
        while n:
            token, size = last[n]
            out.append(token)
            n -= size
        return out[::-1]

    def _word(self, word: str) -> bytes:
        raw, step = word.encode("utf-8", "replace"), self.lookahead
        ids = list(self.stream((raw,) if len(raw) <= step else (raw[i : i + step] for i in range(0, len(raw), step))))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """A stretch without white space."""
        if chunk.isalpha() or (first := self._words.match(chunk)) and first.end() == len(chunk):
            return self._word(chunk)
        return b"".join(self._seen[m[0]] for m in self._words.finditer(chunk))

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self._cuts and len(text) - at > PIECE:
            cut = min((p for p in (text.find(c, at + PIECE) for c in " \n") if p >= 0), default=-1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encoded(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, piece by piece."""
        for piece in self._pieces(text or ""):
            out = []
            for part in self._special.split(piece) if self._special else [piece]:
                if part in self.special:
                    out.append(struct.pack("<I", self.special[part]))
                elif part:
                    plain = part if part.isascii() else unicodedata.normalize("NFC", part)
                    plain = plain.replace("Σ", "σ").lower()  # each letter by itself: no final sigma
                    odd = any(c in plain for c in "\x1c\x1d\x1e\x1f")  # white space for split() alone
                    out.extend(map(self._seen.__getitem__, [plain] if odd else plain.split()))
            yield b"".join(out)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.encoded(text))

    def written(self) -> Written:
        return Written(self)

    def decoder(self) -> Decoder:
        return Decoder(self)


class _Memory(dict):
    """Results by key, up to CACHE of them; when full, the older half goes. Long keys aren't kept."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> bytes:
        made = self._make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                for old in list(self)[: CACHE // 2]:
                    del self[old]
            self[key] = made
        return made


class Written:
    """The vocabulary's tokens with blanks between, from the bytes of ids, in any cuts."""

    def __init__(self, bpe: Bpe):
        self._shown, self._rest, self._blank = bpe.shown, b"", ""

    def push(self, raw: bytes) -> str:
        raw = self._rest + raw if self._rest else raw
        whole = len(raw) & ~3
        self._rest = raw[whole:]
        if not whole:
            return ""
        text = self._blank + " ".join(map(self._shown.__getitem__, np.frombuffer(raw[:whole], "<u4").tolist()))
        self._blank = " "
        return text


class Decoder:
    """Text from ids, in any cuts: words end with a blank; bytes that are no character become U+FFFD."""

    def __init__(self, bpe: Bpe):
        self._bpe, self._state = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            raw, is_end = self._bpe.bytes.get(i) or (self._bpe.shown[i].encode(), False)
            out.append(self._state.decode(raw))
            if is_end:
                out.append(self._state.decode(b"", final=True) + " ")
        return "".join(out)

    def close(self) -> str:
        return self._state.decode(b"", final=True)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """Once for each Python worker."""
    return Bpe(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, slots: bool = False) -> DataFrame:
    """doc_id and the ids of every row's text, with the row's slot between them if asked for."""
    kept = ["doc_id", "slot"] if slots else ["doc_id"]
    path = path or vocabulary()

    def work(batches):
        bpe = load(path)
        for b in batches:
            ids = [np.frombuffer(bpe.encode(t), "<i4") for t in b.column(len(kept)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.record_batch([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], names=[*kept, "ids"])

    return common.map_batches(docs.select(*kept, "text"), work, "".join(f"{c} bigint, " for c in kept) + "ids array<int>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    path = path or vocabulary()

    def digest(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
        n, ids, decoded, state = 0, hashlib.sha256(), hashlib.sha256(), bpe.written()
        for raw in bpe.encoded(text):
            n += len(raw) // 4
            ids.update(raw)
            decoded.update(state.push(raw).encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def work(batches):
        bpe = load(path)
        for b in batches:
            found = [digest(bpe, t) for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))


def _as_written(docs: DataFrame) -> DataFrame:
    """Documents read from files, in the order of the files and of the rows in them, which a scan doesn't keep; others as they come."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no files, or of a kind without row numbers
        return docs
    return placed.repartitionByRange("file", "row").sortWithinPartitions("file", "row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the token ids of every document, in the order that the mix gave them: with a column `slot`, by slots, which
    stand before the ids then; without one, as the documents were written.
    """
    if "slot" not in docs.columns:
        return encode(_as_written(docs))
    return encode(docs.select("doc_id", "slot", "text").repartitionByRange("slot", "doc_id").sortWithinPartitions("slot", "doc_id"), slots=True)
