"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model is compiled into three machines, which are composed with each input arc by arc:

* ``Normaliser`` reads the text and writes normalised characters: rules of the character map by the
  longest match, user-defined pieces as they are, spaces as the space sign, with a leading one, and
  squeezed where the model says so.
* ``Lexicon`` reads normalised characters and writes ids: a trie of the pieces whose closing arcs lead
  back to its root, and at the root one arc for every other character, which writes its bytes or
  the unknown id.
* ``Boundary``, for BPE only, reads pieces and lets two follow each other only if merging would not
  have joined across their boundary.  Of the paths it accepts there is exactly one, the result of the
  merges (compare Berglund and van der Merwe, 2023), so its and the lexicon's arcs weigh nothing.

A unigram model's arcs weigh minus their scores.  The ids are those of the shortest path in the
tropical semiring, whose sums are kept in single precision from a text's start, as the library keeps
them: it is their rounding that decides between paths of the same pieces in another order.  Of paths
still equal, the one whose last piece starts first is taken.
"""

from __future__ import annotations

import codecs
import ctypes
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordwise import WordCoder

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed values of the library: what an unknown character costs beyond the worst piece, and the bonus
#: of a user-defined piece for each byte after its first.
UNKNOWN_PENALTY, USER_BONUS = 10.0, 0.1
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def _trie(entries: dict) -> dict:
    """Nested states by character; under "" the value of the entry that ends there."""
    root: dict = {}
    for key, value in entries.items():
        node = root
        for c in key:
            node = node.setdefault(c, {})
        node[""] = value
    return root


def _longest(root: dict, text: str, at: int) -> tuple[int, str] | None:
    """Where the longest entry of ``text`` from ``at`` ends, and its value."""
    found, node = None, root
    while at < len(text) and (node := node.get(text[at])) is not None:
        at += 1
        if "" in node:
            found = (at, node[""])
    return found


@cache
def character_map(blob: bytes) -> dict[str, str]:
    """Replacements by what they replace, read off a model's double-array trie of UTF-8 bytes."""
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64)
    values = blob[4 + size :]
    labels = np.arange(1, 256)
    out, todo = {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        unit = int(units[at])
        base = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if key and unit >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = values[start : values.index(0, start)].decode()
        to = base ^ labels
        inside = to < len(units)
        inside[inside] &= (units[to[inside]] & 0x800000FF) == labels[inside]
        todo += [(int(t), key + bytes([c])) for t, c in zip(to[inside], labels[inside].tolist(), strict=True)]
    return out


class Normaliser:
    """The machine from texts to normalised characters."""

    def __init__(self, rules: dict[str, str], users: list[str], prefix: bool, squeeze: bool):
        self.rules, self.users = _trie(rules), _trie({u: u for u in users})
        self.prefix, self.squeeze = prefix, squeeze
        #: Each arc then reads one character and writes one.
        self.plain = not rules and not squeeze

    def __call__(self, text: str) -> str:
        if self.plain:
            return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)
        out: list[str] = []
        # Space signs are held back until something else is written, as trailing ones are not kept.
        held = 1 if self.prefix and text else 0
        gap, at = True, 0
        while at < len(text):
            at, written = _longest(self.users, text, at) or _longest(self.rules, text, at) or (at + 1, text[at])
            if self.squeeze:
                written = written.lstrip(" ") if gap else written
                gap = written.endswith(" ") if written else gap
            shown = written.replace(" ", SPACE)
            kept = shown.rstrip(SPACE)
            if kept:
                out.append(SPACE * held + kept)
                held = 0
            held += len(shown) - len(kept)
        return "".join(out) + ("" if self.squeeze else SPACE * held)


class Boundary:
    """The machine over pieces of a BPE model: which may follow which."""

    def __init__(self, rank: dict[str, float]):
        #: The order in which merges are done, by what they make.
        self.rank = rank
        #: The last merge of each piece that merging its own characters ends with.
        self.halves: dict[str, tuple[str, str]] = {}
        self.known: dict[tuple[str, str], bool] = {}
        for p in rank:
            parts, last = list(p), None
            while len(parts) > 1:
                found = [(rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
                if not found:
                    break
                k = min(found)[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                self.halves[p] = last

    def __call__(self, a: str, b: str) -> bool:
        """Whether merging leaves a boundary between pieces ``a`` and ``b``.

        Undo the later of the merges at the boundary again and again: whatever stood there until then
        must not have been joined before.  Among equal merges the left one is first.
        """
        key = (a, b)
        known = self.known.get(key)
        if known is None:
            rank, halves = self.rank, self.halves
            until, also = float("inf"), False
            known = True
            while True:
                joined = rank.get(a + b)
                if joined is not None and (joined < until or (also and joined == until)):
                    known = False
                    break
                ra, rb = (rank[a] if a in halves else 0), (rank[b] if b in halves else 0)
                if not ra and not rb:
                    break
                if ra > rb:
                    until, also, a = ra, False, halves[a][1]
                else:
                    until, also, b = rb, True, halves[b][0]
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[key] = known
        return known


class Lexicon:
    """The machine from normalised characters to ids, with byte fallback."""

    def __init__(self, arcs: dict[str, tuple[tuple[int, ...], float]], other: Callable[[str], tuple[tuple[int, ...], float]]):
        #: At a piece's last state the closing arc: the piece, the ids it writes and its weight.
        self.root = _trie({p: (p, *arc) for p, arc in arcs.items()})
        self.other = other

    def arcs(self, text: str, at: int) -> list[tuple[int, tuple[str, tuple[int, ...], float]]]:
        """The arcs of the lattice from position ``at``: where each ends, and its piece, ids and weight."""
        node, end, n = self.root.get(text[at]), at + 1, len(text)
        out = []
        if node is None or "" not in node:
            out.append((end, (text[at], *self.other(text[at]))))
        while node is not None:
            closing = node.get("")
            if closing is not None:
                out.append((end, closing))
            if end == n:
                break
            node = node.get(text[end])
            end += 1
        return out


class Transducer:
    """A compiled model: ``encode`` and ``decode`` are its two directions."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, spec = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        if trainer.get(24) or not spec.get(5, 1):
            raise ValueError("models with spaces as suffixes or without a space sign are not supported")
        if kind == BPE and UNUSED in self.kinds:
            raise ValueError("BPE models with unused pieces are not supported")
        of_kind = {k: [(i, p) for i, (p, of) in enumerate(zip(self.pieces, self.kinds, strict=True)) if of == k] for k in range(1, 7)}
        self.byte_fallback, self.unknown = bool(trainer.get(35, 0)), of_kind[UNKNOWN][0][0]
        self.bytes = {int(p[1:-1], 16): i for i, p in of_kind[BYTE]}
        self.ids = {p: i for k in (NORMAL, USER) for i, p in of_kind[k]}
        self.users = [p for _, p in of_kind[USER]]
        self.chars = {c for p in self.ids for c in p}
        self.spaced = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.normaliser = Normaliser(character_map(spec[2]) if spec.get(2) else {}, self.users, bool(spec.get(3, 1)), bool(spec.get(4, 1)))
        normal = [self.scores[i] for i, _ in of_kind[NORMAL]] or [0.0]
        self.boundary, unknown_weight = None, UNKNOWN_PENALTY - min(normal)
        if kind == BPE:
            self.boundary = Boundary({p: 1 - self.scores[i] for i, p in of_kind[NORMAL] if len(p) > 1})
            arcs = {p: ((i,), 0.0) for i, p in of_kind[NORMAL] if len(p) == 1 or p in self.boundary.halves}
        else:
            arcs = {p: ((i,), -self.scores[i]) for i, p in of_kind[NORMAL]}
            arcs |= {p: ((i,), USER_BONUS * (1 - len(p.encode()))) for i, p in of_kind[USER]}

        def other(c: str) -> tuple[tuple[int, ...], float]:
            ids = tuple(self.bytes[b] for b in c.encode()) if self.byte_fallback else (self.unknown,)
            return ids, 0.0 if kind == BPE else unknown_weight

        self.lexicon = Lexicon(arcs, other)
        #: A BPE model sets its user-defined pieces apart before it merges.
        self.apart = _trie({u: u for u in self.users}) if kind == BPE and self.users else None
        self.surface = trainer.get(44, " ⁇ ".encode())
        self.shown = [self._bytes_of(i) for i in range(len(self.pieces))]

    def _shortest(self, text: str) -> list[int]:
        """Ids of the shortest path through the lattice of normalised characters."""
        n, arcs, boundary, single = len(text), self.lexicon.arcs, self.boundary, ctypes.c_float
        # By position: the least weight, where its last arc starts, and that arc's piece and ids.  With a
        # boundary machine only one path leads to a position, so there too one state is enough.
        best: list[tuple[float, int, str, tuple[int, ...]] | None] = [None] * (n + 1)
        best[0] = (0.0, 0, "", ())
        known = boundary.known if boundary else {}
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            weight, _, before, _ = here
            for end, (piece, ids, more) in arcs(text, at):
                if boundary is None:
                    total = single(weight + more).value
                    if best[end] is None or total < best[end][0]:
                        best[end] = (total, at, piece, ids)
                elif best[end] is None:
                    meets = known.get((before, piece)) if at else True
                    if meets or (meets is None and boundary(before, piece)):
                        best[end] = (0.0, at, piece, ids)
        out, at = [], n
        while at:
            _, at, _, ids = best[at]
            out.append(ids)
        return [i for ids in reversed(out) for i in ids]

    def ids_of(self, text: str) -> list[int]:
        """Ids of normalised characters; unknown ones are not yet drawn together."""
        if self.apart is None:
            return self._shortest(text)
        out, start, at = [], 0, 0
        while at < len(text):
            found = _longest(self.apart, text, at)
            if found is None:
                at += 1
                continue
            out += [*self._shortest(text[start:at]), self.ids[found[1]]]
            start = at = found[0]
        return out + self._shortest(text[start:])

    def drawn_together(self, ids: np.ndarray) -> np.ndarray:
        """Ids with one unknown id for each run of them."""
        unknown = ids == self.unknown
        return np.delete(ids, np.flatnonzero(unknown[1:] & unknown[:-1]) + 1)

    def encode(self, text: str) -> list[int]:
        return self.drawn_together(np.array(self.ids_of(self.normaliser(text)), dtype=np.int64)).tolist()

    def _bytes_of(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if kind == CONTROL else self.surface if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become one replacement character each."""
        parts = list(map(self.shown.__getitem__, ids))
        prefix, squeeze = self.normaliser.prefix, self.normaliser.squeeze
        if prefix or squeeze:
            for k, i in enumerate(ids):
                if parts[k][:1] == b" " and self.kinds[i] not in (BYTE, UNKNOWN):
                    parts[k] = parts[k][1:]
                    if not squeeze:
                        break
                if parts[k]:
                    break
        return b"".join(parts).decode("utf-8", "each-byte")

    def splitter(self):
        """Starts of stretches of normalised characters whose ids do not depend on each other.

        A BPE model's are at characters of no piece, and at spaces unless pieces have some inside; a
        unigram model's are whole texts, since sums of weights go on.
        """
        if self.boundary is None:
            return lambda points, doc_starts: doc_starts
        alone = np.ones(0x110000, dtype=bool)
        alone[[ord(c) for c in self.chars]] = False
        alone[ord(SPACE)] = False
        gap = ord(SPACE) if not self.spaced else -1

        def split(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
            start = np.zeros(len(points), dtype=bool)
            lone, space = alone[points], points == gap
            start[doc_starts] = True
            start[1:] |= (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
            return np.flatnonzero(start)

        return split


@cache
def _coder(path: str) -> tuple[Transducer, WordCoder]:
    with open(path, "rb") as f:
        machine = Transducer(f.read())
    return machine, WordCoder(machine.splitter(), lambda words: [machine.ids_of(w) for w in words])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_crc32, decoded_sha256, round_trip, and ids if wanted.

    ``path`` is a SentencePiece model on every executor.  Null counts as empty, which has no ids.
    ids_crc32 is over little-endian unsigned 32-bit ids; decoded_sha256 is of the text that the ids
    give back, and round_trip says whether that is the text itself (the space sign reads as a space).
    Rows with one identifier or text are coded one by one, an empty table gives no rows, and other
    columns are not read.  Each distinct stretch of a text goes through the machine once as long as
    it is remembered; a very long text takes memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, coder = _coder(path)
        for batch in batches:
            n, crc, sha, same, kept = [], [], [], [], []
            texts = batch["text"].to_pylist()
            normal = pa.array(map(machine.normaliser, texts), pa.large_string())
            for text, ids in zip(texts, coder(normal), strict=True):
                ids = ids if machine.byte_fallback else machine.drawn_together(ids)
                back = machine.decode(ids.tolist())
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text.replace(SPACE, " "))
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch["doc"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return texts.mapInArrow(run, schema).withColumnRenamed("doc", id_col)
