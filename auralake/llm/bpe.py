"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last of the prefix's encoding. Two
neighbouring tokens are compatible if their bytes together encode to just these two; a row of tokens is the
encoding of its bytes if and only if every token encodes to itself and all neighbours are compatible. So
the last token of a prefix is the one that ends there, and whose predecessor, the last token of the
shorter prefix, is compatible with it. The table of last tokens allows exact appends (only new entries are
computed) and re-encoding near edits (entries before the edit stay, and those after it are taken over
as soon as the tables run alike for as long as the longest token).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, take_over, text_bytes

#: Unicode's White_Space, as the public library's \\s; fixed values.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"

#: Pairs of tokens whose compatibility is remembered.
PAIRS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """The merges of a rank file. ``ranks``: token bytes to rank, the rank being the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Every end of a token to its id, or to -1 if it is no token.
        self.ends = {b[i:]: -1 for b in ranks for i in range(1, len(b))} | ranks
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}

    @classmethod
    def from_file(cls, path: str) -> PrefixBPE:
        return cls(read_ranks(path))

    def merge(self, piece: bytes) -> list[int]:
        """By repeated merges of the pair of lowest rank: the definition, for short pieces."""
        ranks, cut = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(cut) > 1:
            best, at = min((ranks.get(cut[i] + cut[i + 1], 1 << 60), i) for i in range(len(cut) - 1))
            if best == 1 << 60:
                break
            cut[at : at + 2] = [cut[at] + cut[at + 1]]
        return [ranks[c] for c in cut]

    def _stands(self, t: int) -> bool:
        if (ok := self._own.get(t)) is None:
            ok = self._own[t] = self.merge(self.bytes_of[t]) == [t]
        return ok

    def _edge(self, t: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts of t that lie at its end (or front) in turn, while t is merged: (bytes, when it appears, when it is merged away)."""
        memo = self._right if right else self._left
        if (got := memo.get(t)) is None:
            ranks, piece = self.ranks, self.bytes_of[t]
            cut, steps, since = [piece[i : i + 1] for i in range(len(piece))], [], -1
            now = -1
            while len(cut) > 1:
                r, at = min((ranks.get(cut[i] + cut[i + 1], 1 << 60), i) for i in range(len(cut) - 1))
                now = max(now, r)
                if at == (len(cut) - 2 if right else 0):
                    steps.append((cut[-1] if right else cut[0], since, now))
                    since = now
                cut[at : at + 2] = [cut[at] + cut[at + 1]]
            steps.append((cut[-1] if right else cut[0], since, 1 << 60))
            got = memo[t] = steps
        return got

    def _compatible(self, u: int, t: int) -> bool:
        """Whether no merge crosses the border of u and t: none of the parts that meet there is a pair of a lower rank than what merges either of them away."""
        key = u << 32 | t
        if (ok := self._pairs.get(key)) is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            ok, get = self._stands(u) and self._stands(t), self.ranks.get
            if ok:
                xs, ys = self._edge(u, True), self._edge(t, False)
                i = j = 0
                while i < len(xs) and j < len(ys):
                    (x, _, x_end), (y, _, y_end) = xs[i], ys[j]
                    r = get(x + y)
                    if r is not None and r <= min(x_end, y_end):
                        # A tie is decided by the place: leave it to the definition.
                        ok = r == min(x_end, y_end) and self.merge(self.bytes_of[u] + self.bytes_of[t]) == [u, t]
                        break
                    if x_end <= y_end:
                        i += 1
                    if y_end <= x_end:
                        j += 1
            self._pairs[key] = ok
        return ok

    def extend(self, piece: bytes, last: list[int]) -> None:
        """Adds to ``last`` the entries of the prefixes of piece that it lacks; last[i] ends the first i bytes, last[0] is -1."""
        ends, pairs = self.ends.get, self._pairs
        for i in range(len(last), len(piece) + 1):
            a = i - 1
            while a >= 0 and (t := ends(piece[a:i])) is not None:
                if t >= 0:
                    if a:
                        ok = pairs.get(last[a] << 32 | t)
                        if ok if ok is not None else self._compatible(last[a], t):
                            break
                    elif self._stands(t):
                        break
                a -= 1
            else:
                raise ValueError(f"no token ends byte {i} of a piece: the rank file lacks a byte")
            last.append(t)

    def walk(self, last: list[int]) -> list[int]:
        ids, i = [], len(last) - 1
        while i:
            ids.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (t := self.ranks.get(piece)) is not None and self._stands(t):
            return [t]
        last = [-1]
        self.extend(piece, last)
        return self.walk(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class EditablePiece:
    """A piece with its table of last tokens: appends and edits cost what they change, not the piece's length."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, [-1]
        bpe.extend(piece, self.last)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end by new; returns the number of entries that had to be computed."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        last, alike, settled = old[: start + 1], 0, start + len(new)
        while len(last) <= len(self.piece):
            i = len(last)
            self.bpe.extend(self.piece[:i], last)
            # An entry depends on the bytes and entries of the longest token before it.
            alike = alike + 1 if i > settled and last[i] == old[i - shift] else 0
            if alike >= self.bpe.longest:
                made = i - start
                last += old[i - shift + 1 :]
                self.last = last
                return made
        self.last = last
        return len(last) - 1 - start

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


def pattern(source: str):
    """The splitting pattern, with \\s as White_Space: what the public library's engine takes it for."""
    cls = f"[{_SPACE}]"
    source = source.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s", cls)
    return regex.compile(source)


class TextEncoder:
    """Whole texts to ids. Pieces are the pattern's matches; what a piece, or a word with its spaces, encodes to is kept in bounded caches.

    In a text without two neighbouring spaces, a space always opens a match: a match can hold a space only at
    its front or in a run of white space, which gives its last space to a following word. So the text falls
    into words, each with its space, that split independently of one another.
    """

    #: Words of a cache, and pieces.
    HELD = 50_000

    def __init__(self, bpe: PrefixBPE, source: str, held: int | None = None):
        self.bpe, self.split, self.held = bpe, pattern(source).findall, held or self.HELD
        self.pieces: dict[str, list[int]] = {}
        #: Of words, two caches: when one is full, the other begins anew and takes over what is met again.
        self.words: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def pack(self, ids: list[int]):
        """What is kept of a word's ids."""
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encodes new pieces in byte order: a piece starts from what its table shares with the piece before."""
        bpe, held, before, last = self.bpe, self.pieces, b"", [-1]
        if len(held) + len(pieces) > self.held:
            held.clear()
        for piece, text in sorted((p.encode("utf-8"), p) for p in pieces):
            same = 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            bpe.extend(piece, last)
            before = piece
            held[text] = bpe.walk(last)

    def ids_of(self, text: str) -> list[int]:
        parts = self.split(text)
        get = self.pieces.get
        found = [get(m) for m in parts]
        if None in found:
            self.learn({m for m, ids in zip(parts, found, strict=True) if ids is None})
            get = self.pieces.get
            found = [get(m) or self.bpe.encode_piece(m.encode()) for m in parts]
        return [i for ids in found for i in ids]

    def packs(self, texts: list[str]) -> Iterator[list]:
        """The packed ids of each text's words, in order."""
        cut = [t.split(" ") if "  " not in t else [t] for t in texts]
        new = set()
        for units in cut:
            new.update(units[1:])
        if len(self.words) + len(new) > self.held:
            self.older, self.words = self.words, {}
        words, older, pack = self.words, self.older, self.pack
        new.difference_update(words.keys())
        again = older.keys() & new if len(new) > len(older) else [w for w in new if w in older]
        for w in again:  # what is still in use stays
            words[w] = older[w]
        new.difference_update(again)
        split = self.split
        parts = {w: split(" " + w) for w in new}
        fresh = {m for ms in parts.values() for m in ms}
        fresh.difference_update(self.pieces.keys())
        if len(self.pieces) + len(fresh) > self.held:
            fresh = {m for ms in parts.values() for m in ms}
        self.learn(fresh)
        pieces = self.pieces
        for w, ms in parts.items():
            words[w] = pack(pieces[ms[0]] if len(ms) == 1 else [i for m in ms for i in pieces[m]])
        if max(map(len, new), default=0) > 100:
            long = {w: words.pop(w) for w in new if len(w) > 100}
        else:
            long = {}
        for units in cut:
            head = self.ids_of(units[0]) if units[0] else None
            body = [words[w] for w in units[1:]] if not long else [words[w] if w in words else long[w] for w in units[1:]]
            yield [pack(head), *body] if head else body


class _DigestEncoder(TextEncoder):
    HELD = 250_000  # it has the worker for itself, unlike those in the pipeline

    def pack(self, ids):
        return ",".join(map(str, ids)), len(ids), self.bpe.decode(ids)


class _PackedEncoder(TextEncoder):
    def pack(self, ids):
        return struct.pack(f"<{len(ids)}I", *ids)


def chunks(column, size: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of an Arrow column, null as the empty text, in lists of about so many bytes.

    Each list's results leave the worker as a batch of their own: ids take more bytes than their text.
    """
    texts, n = [], 0
    for b in text_bytes(column):
        texts.append(b.decode())
        n += len(b)
        if n >= size:
            yield texts
            texts, n = [], 0
    if texts:
        yield texts


@kept("bpe")
def coder(kind: type, vocabulary: str) -> TextEncoder:
    """One coder for each Python worker: its caches last from task to task, until another operator's task runs there."""
    import gc

    import public_tokenizers

    gc.set_threshold(200_000, 50, 1000)
    return kind(PrefixBPE.from_file(_vocabulary(vocabulary) if "/" not in vocabulary else vocabulary), public_tokenizers.PATTERN)


def encode(text: str, bpe: PrefixBPE, source: str) -> list[int]:
    """One text's ids, every match of the pattern by itself, no special tokens."""
    return TextEncoder(bpe, source).ids_of(text)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """df's rows as (id, n_tokens, ids array<int>, decoded binary).

    A null text is the empty text and has no tokens. Every row, repeated ones and such with a null id too,
    gives a row; other columns are not read. ``vocabulary`` names a file of the installed vocabularies, or is a path.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("bpe")
        enc = coder(TextEncoder, vocabulary)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                ids = [[i for p in packs for i in p] for packs in enc.packs(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(ids)), pa.array(map(len, ids), pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())), pa.array([enc.bpe.decode(x) for x in ids], pa.binary()),
                    ],
                    names=[id_col, "n_tokens", "ids", "decoded"],
                )
                at += len(ids)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids array<int>, decoded binary")


def encode_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """As encode_column, but with the digests of ids and decoded bytes in place of them: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("bpe")
        enc = coder(_DigestEncoder, vocabulary)
        for batch in batches:
            counts, ids_sha, out_sha = [], [], []
            for texts in chunks(batch.column(1)):
                for packs in enc.packs(texts):
                    counts.append(sum([p[1] for p in packs]))
                    ids_sha.append(hashlib.sha256(",".join([p[0] for p in packs]).encode()).hexdigest())
                    out_sha.append(hashlib.sha256(b"".join([p[2] for p in packs])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """As encode_column, with the ids as 32-bit little-endian numbers in a row: (id, n_tokens, token_ids binary)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        take_over("bpe")
        enc = coder(_PackedEncoder, vocabulary)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                packed = [b"".join(packs) for packs in enc.packs(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(packed)), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())],
                    names=[id_col, "n_tokens", "token_ids"],
                )
                at += len(packed)

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, token_ids binary")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
