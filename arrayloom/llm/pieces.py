"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model compiles to machines whose states are dictionaries of arcs:

* the normaliser, from characters to characters: the model's table of spellings (a tree over UTF-8 bytes, walked as
  it is stored), a space mark for each space, a dummy space in front, and extra spaces left out where the model says so;
* the pieces, from characters to piece numbers: a tree whose last states give out a piece at the piece's weight;
* byte fallback, an arc for each character that is no piece, which gives out the bytes' pieces.

An input is a chain of characters. Composed with the normaliser it is a chain again; composed with pieces and
fallback it is a lattice, whose states are positions and whose arcs are pieces. The encoding is the
lattice's shortest path in the tropical semiring (minimum, plus).

Unigram models weigh a piece by its negative log-probability. A byte-pair model is no
sum of weights by piece; there one more machine is composed: an acceptor over pairs of
neighbouring pieces that weighs 0 if the merges, in order of their ranks, leave the border
between the two standing, and infinity otherwise. Exactly one path of finite weight is then
left in any lattice, and also in the lattice of any beginning of the text, so that one state
for each position is enough.

No piece but runs of spaces goes on past a space, and none holds a newline; so a text falls
into units that are composed one by one, and equal units share one result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import map_arrow, packed, unpacked
from arrayloom.llm.wordhash import portions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
NEVER = float("inf")
#: Bytes of units with their pieces, and pairs of pieces, that a worker remembers before it starts anew; results don't depend on it.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 96 << 20, 500_000
HISTORIES = 10_000
#: What a remembered unit takes beside its characters and pieces, about.
UNIT_BYTES = 220
# Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
#: Cost of a character that no piece has, over that of the worst piece (unigram models).
FALLBACK_COST = 10.0
#: The key under which a state of the pieces' machine keeps what it gives out; no character.
GIVES = 0


def _model(raw: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(raw)
    return m


class Speller:
    """The inverse machine: what each id is written as, and the normaliser's spaces backwards."""

    def __init__(self, model: bytes):
        m = _model(model)
        self.dummy = m.normalizer_spec.add_dummy_prefix
        self.written = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE_MARK, " ").encode() if p.type == NORMAL else b" \xe2\x81\x87 " if p.type == UNKNOWN else b"" for p in m.pieces]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.written.__getitem__, ids.tolist()))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Normaliser:
    """From characters to characters.

    Without a table of spellings there is one state, whose arcs read a character and write it, or the space mark for a space.
    With one, the states are the nodes of its tree over bytes: the longest entry that begins at a character is
    rewritten, and any other character is copied. Where extra spaces go there are two states more, after a space and after another character.
    """

    def __init__(self, spec):
        self.dummy, self.strip = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        table = spec.precompiled_charsmap
        self.nodes = self.spellings = None
        if table:
            size = int.from_bytes(table[:4], "little")
            self.nodes, self.spellings = np.frombuffer(table, "<u4", size // 4, 4).tolist(), table[4 + size :]
        self.known: dict[str, tuple[int, str]] = {}

    def _step(self, raw: bytes, at: int) -> tuple[int, str]:
        """(bytes read, what is written for them) from a character's first byte on."""
        nodes = self.nodes
        # A node holds its label (8 bits), a mark that an entry ends here (bit 8), and the distance to its children.
        ahead = lambda node: (node >> 10) << ((node & 0x200) >> 6)
        place, found, read = ahead(nodes[0]), -1, 0
        for i in range(at, len(raw)):
            place ^= raw[i]
            node = nodes[place] if place < len(nodes) else 0
            if node & 0x800000FF != raw[i]:
                break
            place ^= ahead(node)
            if node & 0x100:
                found, read = nodes[place] & 0x7FFFFFFF, i + 1 - at
        if found < 0:
            read = next(n for n, least in ((4, 0xF0), (3, 0xE0), (2, 0xC0), (1, 0)) if raw[at] >= least)
            return read, raw[at : at + read].decode("utf-8", "replace")
        return read, self.spellings[found : self.spellings.index(b"\0", found)].decode("utf-8", "replace")

    def _spelled(self, text: str) -> str:
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            read, written = self._step(raw, at)
            out.append(written)
            at += read
        return "".join(out)

    def compose(self, text: str) -> str:
        """The chain that the text's chain and this machine make."""
        if self.nodes is not None:
            text = self._spelled(text)
        if self.strip:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE_MARK if self.dummy else "") + text.replace(" ", SPACE_MARK) if text else ""


class Transducer:
    def __init__(self, model: bytes):
        m = _model(model)
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"model type {m.trainer_spec.model_type}")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces can't be compiled")
        if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("models that write spaces otherwise than as marks in front can't be compiled")
        self.bpe = m.trainer_spec.model_type == BPE
        self.normaliser = Normaliser(m.normalizer_spec)
        self.cost = {p.piece: -p.score for p in m.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.worst = max(self.cost.values(), default=0.0) + FALLBACK_COST
        # A unit may end before a space mark only if no piece has one after another character.
        by_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.cost)
        by_line = not any("\n" in p and len(p) > 1 for p in self.cost)
        # Without bytes neighbouring characters that no piece has are one unknown piece, which may go on past any border.
        by_space, by_line = by_space and bool(self.bytes), by_line and bool(self.bytes)
        mark = re.escape(SPACE_MARK)
        word = rf"{mark}*[^{mark}\n]+|{mark}+" if by_line else rf"{mark}*[^{mark}]+|{mark}+"
        self.units = re.compile((r"\n|" if by_line else "") + (word if by_space else r"[^\n]+" if by_line else r"(?s:.+)"))
        self.histories: dict[str, tuple] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0
        self._compile()

    # The machine of the pieces, and byte fallback.

    def _compile(self) -> None:
        """The pieces' tree, from their last character to their first, so that a walk meets all arcs that end at a position.

        Of a byte-pair model only the pieces that merges can make.
        """
        self.names: list[str] = []
        self.weights: list[float] = []
        self.given: list[bytes] = []
        self.start: dict = {}
        self.borders: dict[int, float] = {}
        for p, c in self.cost.items():
            if not self.bpe:
                self._arc(p, c, [self.ids[p]])
            elif self.history(p) is not None:
                self._arc(p, 0.0, [self.ids[p]])
        self.histories.clear()

    def _arc(self, piece: str, weight: float, ids: list[int]) -> int:
        """A path through the tree that reads the piece and gives out a number; that number."""
        state = self.start
        for c in reversed(piece):
            state = state.setdefault(c, {})
        state[GIVES] = len(self.names)
        self.names.append(piece)
        self.weights.append(weight)
        self.given.append(array("i", ids).tobytes())
        return state[GIVES]

    def _fallback(self, character: str) -> int:
        """The arc of a character that is no piece: its bytes, or the unknown piece."""
        ids = [self.bytes[b] for b in character.encode("utf-8", "replace")] if self.bytes else [self.unknown]
        return self._arc(character, 0.0 if self.bpe else self.worst, ids)

    # The acceptor of pairs.

    def history(self, piece: str) -> tuple | None:
        """How the merges make this piece: for its last and its first symbol, the symbol and what the merges turn it into.

        Each is (symbol at that end, [(rank of a merge, symbol at that end after it), ...]) in the order of
        the merges. None if the merges of the piece's characters don't end in the piece.
        """
        if (known := self.histories.get(piece)) is not None:
            return known
        parts, merges = list(piece), []
        while len(parts) > 1:
            rank, at = min(((self.cost.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append((rank, parts[-1], parts[0]))
        right = (piece[-1], [(r, last) for r, last, _ in merges])
        left = (piece[0], [(r, first) for r, _, first in merges])
        if len(parts) > 1:
            return None
        if len(self.histories) >= HISTORIES:
            self.histories.clear()
        self.histories[piece] = right, left
        return right, left

    def border(self, a: int, b: int) -> float:
        """0 if the border between two pieces is never merged over, else infinity. Merges go by rank, from the left among equals."""
        (x, left), (y, right) = self.history(self.names[a])[0], self.history(self.names[b])[1]
        i = j = 0
        while True:
            over = self.cost.get(x + y, NEVER)
            one = left[i][0] if i < len(left) else NEVER
            two = right[j][0] if j < len(right) else NEVER
            if over < one and over <= two:
                return NEVER
            if one == NEVER and two == NEVER:
                return 0.0
            if one <= two:
                x, i = left[i][1], i + 1
            else:
                y, j = right[j][1], j + 1

    # Composition and shortest path.

    def shortest(self, units: list[str]) -> Iterator[list[int]]:
        """The pieces' numbers on each unit's shortest path.

        The lattice of a unit is made position by position, and with it the least weight of a path to each.
        States of a beginning that a unit shares with the one before stay; so sorted units are cheapest.
        """
        start, borders, weights, paired = self.start, self.borders, self.weights, self.bpe
        least, last, back, before = [0.0], [0], [0], ""
        for unit in units:
            same, most = 0, min(len(unit), len(before))
            while same < most and unit[same] == before[same]:
                same += 1
            before, n = unit, len(unit)
            del least[same + 1 :], last[same + 1 :], back[same + 1 :]
            for end in range(same + 1, n + 1):
                state, at, arcs = start, end, []
                while at:
                    at -= 1
                    if (state := state.get(unit[at])) is None:
                        break
                    if GIVES in state:
                        arcs.append((at, state[GIVES]))
                if not arcs or arcs[0][0] != end - 1:
                    arcs.insert(0, (end - 1, self._fallback(unit[end - 1])))
                best = NEVER
                for at, piece in reversed(arcs):
                    weight = least[at] + weights[piece]
                    if paired and at:
                        key = last[at] << 32 | piece
                        if (between := borders.get(key)) is None:
                            if len(borders) >= REMEMBERED_PAIRS:
                                borders.clear()
                            between = borders[key] = self.border(last[at], piece)
                        weight += between
                    if weight < best:
                        best, by, origin = weight, piece, at
                        if not weight:  # no weight is negative: no path is shorter
                            break
                least.append(best)
                last.append(by)
                back.append(origin)
            path = []
            while n:
                path.append(last[n])
                n = back[n]
            yield path[::-1]

    def _given(self, path: list[int]) -> bytes:
        if self.bytes:
            return b"".join(map(self.given.__getitem__, path))
        ids = np.frombuffer(b"".join(map(self.given.__getitem__, path)), "<i4")
        repeated = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate([[True], ~repeated])[: len(ids)]].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of 32 bits each, for each text."""
        known, out = self.known, []
        for lo, hi in portions(texts):
            cut = [self.units.findall(self.normaliser.compose(t)) for t in texts[lo:hi]]
            asked = set().union(*cut)
            new = sorted(asked.difference(known))
            if self.held > REMEMBERED_BYTES:
                known.clear()
                self.held, new = 0, sorted(asked)
            for unit, path in zip(new, self.shortest(new), strict=True):
                known[unit] = ids = self._given(path)
                self.held += UNIT_BYTES + len(unit) + len(ids)
            out += [b"".join(map(known.__getitem__, units)) for units in cut]
        return out


_MACHINES: dict[tuple, Transducer | Speller] = {}


def machine_of(model: bytes, kind: type = Transducer) -> Transducer | Speller:
    """One machine of a kind for each worker process, whatever the number of its tasks."""
    key = kind, hashlib.sha256(model).digest()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = kind(model)
    return _MACHINES[key]


def _read(model: str) -> bytes:
    with open(model, "rb") as f:  # on the driver; the workers get the bytes
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """All columns and tokens (array of int) and n_tokens; these replace input columns of their names.

    Null text: null tokens and 0. Empty text: no tokens. Equal texts get equal tokens; whole texts are
    encoded, of any length. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine_of(shared.value)
        for b in batches:
            texts = b.column("__text").to_pylist()
            made = iter(m.encode([t for t in texts if t is not None]))
            got = [None if t is None else next(made) for t in texts]
            sizes = np.array([0 if g is None else len(g) // 4 for g in got], "<i8")
            flat = pa.array(np.frombuffer(b"".join(g for g in got if g), "<i4"))
            missing = np.array([g is None for g in got])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("<i4"))
            tokens = pa.ListArray.from_arrays(offsets, flat, mask=pa.array(missing)) if missing.any() else pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([b.column("__row"), tokens, pa.array(sizes)], names=["__row", "__tokens", "__n"])

    df = packed(docs, __text=F.col(text_col))
    df = map_arrow(df, run, f"__row {df.schema['__row'].dataType.simpleString()}, __tokens array<int>, __n long")
    return unpacked(df, docs.columns, tokens=F.col("__tokens"), n_tokens=F.col("__n"))


def decode(rows: DataFrame, model: str = MODEL, tokens_col: str = "tokens") -> DataFrame:
    """All columns and decoded. Null tokens: null. Null ids in an array are left out; an id outside the model is an error."""
    shared = rows.sparkSession.sparkContext.broadcast(_read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine_of(shared.value, Speller)
        for b in batches:
            column = b.column("__ids")
            texts = [m.decode(column[i].values.drop_null().to_numpy(zero_copy_only=False)) if column[i].is_valid else None for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(texts, pa.string())], names=["__row", "__decoded"])

    df = packed(rows, __ids=F.col(tokens_col))
    df = map_arrow(df, run, f"__row {df.schema['__row'].dataType.simpleString()}, __decoded string")
    return unpacked(df, rows.columns, decoded=F.col("__decoded"))


def round_trip(texts: list[str], model: bytes) -> list[tuple[list[int], str]]:
    m = machine_of(model)
    ids, speller = [np.frombuffer(e, "<i4") for e in m.encode(texts)], Speller(model)
    return [(i.tolist(), speller.decode(i)) for i in ids]


__all__ = ["Normaliser", "Speller", "Transducer", "decode", "encode", "machine_of", "round_trip"]
