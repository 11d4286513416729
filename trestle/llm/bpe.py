"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash cuts every text where its content says so; a chunk that documents
share is encoded once and its tokens are used again. Then each join of two chunks
is repaired: the bytes around it are encoded anew, from an anchor in the left chunk
to one in the right. The tokens up to the left chunk's next anchor and those from
the right chunk's anchor before must be the very tokens of the chunks; until they
agree, the stretch grows by an anchor on either side, up to both whole chunks. The
result is exactly that of encoding the text in one piece.

An anchor is a place between a visible ASCII character and a space or line end, or
between a Han character or kana and one of ``、。，！？``. The splitting pattern
joins neither, looks ahead only across white space and never back, so a text may be
cut there. Another pattern than :data:`PATTERN` is an error.

Chunks are kept in each worker process, ``KEPT_BYTES`` of them; what is kept
changes the time, never the result.

Defined results: a null text has null tokens, an empty one none; texts of any
length are encoded whole; special tokens are ordinary text; repeated rows are
encoded each; an unknown id, or ids that aren't UTF-8 together, decode to null;
other columns are left alone.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_bytes, worker_cache

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW_STEPS, MASK, LEAST_CHUNK, KEPT_BYTES = 4, 0xFFC00000, 256, 32 << 20


def vocabulary_path() -> str:
    """The byte-level vocabulary of the package ``public_tokenizers``; where that isn't installed, give :func:`encode_documents` a path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a file of ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes byte strings chunk by chunk, keeping the chunks' tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, kept_bytes: int = KEPT_BYTES):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError("anchors are known for the pattern of this module alone")
        self.plain = tiktoken.Encoding("trestle", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.kept: dict[bytes, tuple] = {}
        self.kept_bytes, self.room = kept_bytes, kept_bytes
        self.reused = self.encoded = self.widened = 0
        rng = np.random.default_rng(9)
        self.gear = rng.integers(0, 2**32, 256, dtype=np.uint32)

    def cuts(self, b: np.ndarray) -> list[int]:
        """Where chunks of a text end; at least ``LEAST_CHUNK`` bytes apart and never inside a character."""
        n = len(b)
        if n <= LEAST_CHUNK:
            return [n]
        h = self.gear[b]
        for s in range(WINDOW_STEPS):  # h[i] covers 2, 4, 8, 16 bytes up to i
            w = 1 << s
            h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        found = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
        out, at = [], 0
        while True:
            k = int(np.searchsorted(found, at + LEAST_CHUNK))
            if k >= len(found):
                return [*out, n]
            at = int(found[k])
            while at < n and 0x80 <= b[at] < 0xC0:
                at += 1
            if at >= n:
                return [*out, n]
            out.append(at)

    def chunk(self, raw: bytes) -> tuple:
        """Tokens, anchors, and the number of tokens before each anchor."""
        have = self.kept.pop(raw, None)
        if have is None:
            tokens = np.array(self.plain(raw.decode()), np.int32)
            border = np.concatenate([[0], np.cumsum(self.size[tokens])])
            found = anchors(np.frombuffer(raw, np.uint8))
            place = np.searchsorted(border, found)
            agreed = border[place] == found
            have = (tokens, found[agreed].astype(np.int32), place[agreed].astype(np.int32))
            self.encoded += 1
            self.room -= _kept_size(raw)
            while self.room < 0 and self.kept:
                old = next(iter(self.kept))
                self.kept.pop(old)
                self.room += _kept_size(old)
        else:
            self.reused += 1
        self.kept[raw] = have
        return have

    def join(self, raw: bytes, left: tuple, right: tuple) -> tuple[int, np.ndarray, int] | None:
        """Tokens between the two chunks ``(start, tokens, anchors, places)``: how many of the left one's stay, the new ones, and how many of the right one's go.

        None where no stretch with an anchor at either end agrees.
        """
        (l_start, l_tokens, l_at, l_place), (r_start, r_tokens, r_at, r_place) = left, right
        for k in range(1, max(len(l_at), len(r_at))):
            # one anchor more than is needed on either side, whose tokens must come out again
            a, b = max(len(l_at) - 1 - k, 0), min(k, len(r_at) - 1)
            if b < 1 or len(l_at) < 2:
                break
            new = np.array(self.plain(raw[l_start + l_at[a] : r_start + r_at[b]].decode()), np.int32)
            before, after = l_tokens[l_place[a] : l_place[a + 1]], r_tokens[r_place[b - 1] : r_place[b]]
            if len(new) >= len(before) + len(after) and (new[: len(before)] == before).all() and (new[len(new) - len(after) :] == after).all():
                return int(l_place[a]), new, int(r_place[b])
            self.widened += 1
        return None

    def encode(self, b: np.ndarray) -> np.ndarray:
        """Tokens of one text."""
        raw = b.tobytes()
        cuts = self.cuts(b)
        if len(cuts) == 1:
            return self.chunk(raw)[0] if raw else np.zeros(0, np.int32)
        parts: list[np.ndarray] = []
        start = 0
        held = None  # the chunk, or stretch of chunks encoded as one, that the next is joined to; and how many of its tokens are gone
        for end in cuts:
            piece = (start, *self.chunk(raw[start:end]))
            if held is None:
                held, gone = piece, 0
            else:
                joined = self.join(raw, held, piece)
                if joined and joined[0] >= gone:
                    parts += [held[1][gone : joined[0]], joined[1]]
                    held, gone = piece, joined[2]
                else:  # no agreement: both are encoded as one, from the last place that is settled
                    begin = held[0] + int(self.size[held[1][:gone]].sum())
                    held, gone = (begin, *self._whole(raw[begin:end])), 0
            start = end
        return np.concatenate([*parts, held[1][gone:]])

    def _whole(self, raw: bytes) -> tuple:
        """:meth:`chunk` without keeping it."""
        tokens = np.array(self.plain(raw.decode()), np.int32)
        border = np.concatenate([[0], np.cumsum(self.size[tokens])])
        found = anchors(np.frombuffer(raw, np.uint8))
        place = np.searchsorted(border, found)
        agreed = border[place] == found
        return tokens, found[agreed].astype(np.int32), place[agreed].astype(np.int32)


def _kept_size(raw: bytes) -> int:
    return 8 * len(raw) + 300


def anchors(b: np.ndarray) -> np.ndarray:
    """Places where the bytes of a text may be cut."""
    plain = np.flatnonzero(((b[1:] == 32) | (b[1:] == 10)) & (b[:-1] > 32) & (b[:-1] < 127)) + 1
    if len(b) < 6 or not (b >= 0xE3).any():
        return plain
    lead = np.flatnonzero((b[3:-2] == 0xE3) | (b[3:-2] == 0xEF)) + 3
    code = (b[lead].astype(np.int32) << 16) | (b[lead + 1].astype(np.int32) << 8) | b[lead + 2]
    lead = lead[np.isin(code, _STOPS)]
    x, y, z = (b[lead - k].astype(np.int32) for k in (3, 2, 1))
    letter = (x & 0x0F) << 12 | (y & 0x3F) << 6 | z & 0x3F
    ok = (x >= 0xE3) & (x <= 0xE9) & (((letter >= 0x4E00) & (letter <= 0x9FA5)) | ((letter >= 0x3041) & (letter <= 0x3096)) | ((letter >= 0x30A1) & (letter <= 0x30FA)))
    return np.sort(np.concatenate([plain, lead[ok]]))


_STOPS = [int.from_bytes(c.encode(), "big") for c in "、。，！？"]


def _list_array(parts: list[np.ndarray], valid: list[bool]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()), mask=pa.array([not v for v in valid], pa.bool_()))


def encoder(spark: SparkSession, ranks: dict[bytes, int], pattern: str = PATTERN):
    """A function from a text column to a struct of ``tokens`` and ``exact``, whether they decode to the very text; the vocabulary is what is sent to the workers."""
    shipped = ship(spark, (ranks, pattern))

    def run(column: pa.Array) -> pa.Array:
        cache = worker_cache()
        key = shipped()
        if cache.get("bpe", (None,))[0] is not key:
            machine = Encoder(*key)
            by_id = sorted(key[0].items(), key=lambda x: x[1])
            cache["bpe"] = key, machine, np.frombuffer(b"".join(t for t, _ in by_id), np.uint8), np.cumsum(machine.size) - machine.size
        _, machine, letters, begins = cache["bpe"]

        def same(tokens: np.ndarray, raw: np.ndarray) -> bool:
            size = machine.size[tokens]
            if size.sum() != len(raw):
                return False
            shift = begins[tokens] - (np.cumsum(size) - size)
            return bool((letters[np.repeat(shift, size) + np.arange(len(raw))] == raw).all())

        buf, starts, ends = text_bytes(column)
        valid = column.is_valid().to_pylist()
        parts = [machine.encode(buf[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
        exact = [same(p, buf[s:e]) for p, s, e in zip(parts, starts.tolist(), ends.tolist())]
        return pa.StructArray.from_arrays([_list_array(parts, valid), pa.array(exact, pa.bool_())], names=["tokens", "exact"])

    return F.arrow_udf(run, T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("exact", T.BooleanType())]))


def decoder(spark: SparkSession, ranks: dict[bytes, int]):
    """A function from a column of token ids to text."""
    shipped = ship(spark, {i: t for t, i in ranks.items()})

    def run(column: pa.Array) -> pa.Array:
        table, out = shipped(), []
        for ids in column.to_numpy(zero_copy_only=False):
            try:
                out.append(None if ids is None else b"".join([table[i] for i in ids.tolist()]).decode())
            except (KeyError, UnicodeDecodeError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, T.StringType())


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Id, token ids, their number, and whether they decode to the very text."""
    coded = docs.select(F.col(id_col), encoder(docs.sparkSession, load_ranks(path or vocabulary_path()))(F.col(text_col)).alias("_coded"))
    return coded.select(id_col, F.col("_coded.tokens").alias("tokens"), F.size("_coded.tokens").alias("n_tokens"), F.col("_coded.exact").alias("exact"))
