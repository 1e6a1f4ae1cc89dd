"""SentencePiece (BPE) encoding by a prefix table, and decoding.

The model merges, time and again, the adjacent pair whose joined text is the piece of
the highest score, the leftmost of equal ones. Two pieces are compatible if this, run
on their joined text, gives just the two. A sequence of pieces is the encoding of its
text exactly if all its neighbours are compatible: a merge across a border would be
the best one within the two neighbours as well. So every prefix of a text has one
last piece: the one that ends there and is compatible with the last piece of the
prefix before it. An Aho-Corasick automaton gives the pieces that end at each place,
pair tests (kept in a table) choose among them, and the ids are read off backwards.

Only pieces that encode to themselves enter the automaton. Characters that no piece
contains end one stretch and become byte pieces (or the unknown id). Where no piece
has a space mark behind another character, no merge crosses such a place: texts are
cut there, and short stretches are remembered. Both tables are bounded and emptied
when full; results do not depend on them. Work is linear in the text, however long
its words are.

The model file is read on the driver and sent as a plain table, whose size is that of
the vocabulary; tasks need no local file.

Defined cases: a null or empty text has no tokens and decodes to an empty text; very
long texts are processed whole; strings of control pieces inside texts are ordinary
text; the space mark itself reads as a space; repeated rows are encoded each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rowtrace.llm.common import Batches, in_arrow, slices, table

SPACE = "▁"  # fixed value: how the model writes a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
BATCH_BYTES = 2 << 20
REMEMBERED = 64  # characters of a stretch, at most
STRETCHES = 400_000  # in each of two tables
PAIRS = 2_000_000
NEVER = float("-inf")


@dataclass
class Model:
    """The pieces of a model file, and what the driver derived from them."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unknown: int
    unknown_surface: str
    dummy_prefix: bool
    byte_fallback: bool
    whole: dict[str, int] = field(default_factory=dict)  # pieces that encode to themselves, and single characters

    def __post_init__(self) -> None:
        self.ranked = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k == NORMAL}
        ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        if not self.whole:
            self.whole = {p: ids[p] for p in ids if self.merge(p) == [len(p)]}
            # characters known inside longer pieces only: ids beyond the vocabulary, resolved on the way out
            lone = sorted(set("".join(ids)) - set(ids))
            self.whole |= {c: len(self.pieces) + i for i, c in enumerate(lone)}
        self.bytes = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.start()

    def __getstate__(self) -> dict:
        kept = ("pieces", "scores", "kinds", "unknown", "unknown_surface", "dummy_prefix", "byte_fallback", "whole")
        return {name: getattr(self, name) for name in kept}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def start(self) -> None:
        """Tables that tasks fill."""
        self.text_of = {i: p for p, i in self.whole.items()}
        self.length_of = {i: len(p) for p, i in self.whole.items()}
        self.span = max([len(self.pieces), *(i + 1 for i in self.text_of)])  # ids that the tables know
        self.automaton = ahocorasick.Automaton()
        for piece, number in self.whole.items():
            self.automaton.add_word(piece, (number, len(piece)))
        if self.whole:
            self.automaton.make_automaton()
        letters = "".join(c for c in map(re.escape, sorted(set("".join(self.whole)))))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ranked)
        mark = re.escape(SPACE)
        self.stretches = re.compile(r"(?s:.+)" if inner else rf"{mark}*[^{mark}]+|{mark}+")
        self.known = re.compile(rf"[{letters}]+") if letters else re.compile(r"(?!)")
        self.names = [str(i) for i in range(len(self.pieces))]
        self.surfaces = [self._surface(i) for i in range(len(self.pieces))]
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple[list[float], list[str], list[str]]] = {}  # one for each piece, at most
        self.seen: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    # -- encoding -----------------------------------------------------------------

    def merge(self, text: str) -> list[int]:
        """Lengths of the pieces of a short text, by merging."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.ranked.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [len(p) for p in parts]

    def history(self, number: int) -> tuple[list[float], list[str], list[str]]:
        """How a piece grows by itself: scores of its merges, and its first and last part before each of them and after."""
        parts = list(self.text_of[number])
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = max((self.ranked.get(parts[i] + parts[i + 1], NEVER), -i) for i in range(len(parts) - 1))
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        scores.append(NEVER)
        self.histories[number] = scores, firsts, lasts
        return self.histories[number]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side stay as they are.

        Until a merge crosses their border, both grow as they do alone, the better merge of the two first and the left
        one of equal ones; a pair across the border is merged when neither is better (the right one not even equal).
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        one, _, ends = self.histories.get(left) or self.history(left)
        two, starts, _ = self.histories.get(right) or self.history(right)
        ranked = self.ranked.get
        i = j = 0
        while True:
            a, b = one[i], two[j]
            across = ranked(ends[i] + starts[j], NEVER)
            if across > a and across >= b and across > NEVER:
                fits = False
                break
            if a == b == NEVER:
                fits = True
                break
            if a >= b:
                i += 1
            else:
                j += 1
        self.pairs[left * self.span + right] = fits
        return fits

    def last_pieces(self, text: str) -> list[int]:
        """For each prefix of a text of known characters, the last piece of its encoding."""
        last = [-1] * (len(text) + 1)
        span, known = self.span, self.pairs.get
        for end, (piece, length) in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = known(before * span + piece)
                    if fits or (fits is None and self.compatible(before, piece)):
                        last[end + 1] = piece
                else:
                    last[end + 1] = piece
        return last

    def known_ids(self, text: str) -> list[int]:
        last, at, found = self.last_pieces(text), len(text), []
        length = self.length_of
        while at > 0:
            piece = last[at]
            if piece < 0:
                raise ValueError(f"no piece ends at character {at} of {text[:100]!r}")
            found.append(piece)
            at -= length[piece]
        found.reverse()
        if self.span > len(self.pieces):
            found = [i for p in found for i in ((p,) if p < len(self.pieces) else self._as_bytes(self.text_of[p]))]
        return found

    def _as_bytes(self, character: str) -> list[int]:
        if not self.byte_fallback:
            return [self.unknown]
        return [self.bytes[f"<0x{b:02X}>"] for b in character.encode("utf-8")]

    def stretch_ids(self, stretch: str) -> list[int]:
        if self.known.fullmatch(stretch):
            return self.known_ids(stretch)
        found: list[int] = []
        at = 0
        for match in self.known.finditer(stretch):
            for character in stretch[at : match.start()]:
                found += self._as_bytes(character)
            found += self.known_ids(match.group())
            at = match.end()
        for character in stretch[at:]:
            found += self._as_bytes(character)
        return found

    def recalled(self, stretch: str) -> list[int]:
        """Ids of a stretch that the younger table lacks. Full, it becomes the older one: what is in use comes back."""
        ids = self.older.get(stretch) or self.stretch_ids(stretch)
        if len(stretch) <= REMEMBERED:
            if len(self.seen) >= STRETCHES:
                self.older = dict(self.seen)
                self.seen.clear()
            self.seen[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if self.dummy_prefix:
            marked = SPACE + marked
        found: list[int] = []
        known = self.seen.get
        for stretch in self.stretches.findall(marked):
            found += known(stretch) or self.recalled(stretch)
        if not self.byte_fallback:  # unknown characters side by side are one unknown piece
            found = [i for k, i in enumerate(found) if i != self.unknown or k == 0 or found[k - 1] != self.unknown]
        return found

    # -- decoding -----------------------------------------------------------------

    def _surface(self, number: int) -> bytes:
        kind, piece = self.kinds[number], self.pieces[number]
        if kind == CONTROL:
            return b"\xff"  # in no text: `decode` takes the long way
        if kind == UNKNOWN:
            return self.unknown_surface.encode("utf-8")
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode("utf-8")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; each byte that belongs to no character reads as U+FFFD."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return self._decode_parts(ids)
        return text[1:] if self.dummy_prefix and ids and text[0] == " " and self.kinds[ids[0]] == NORMAL else text

    def _decode_parts(self, ids: list[int]) -> str:
        """With control pieces, which are not seen, though bytes on their two sides do not meet, or broken characters."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        parts = [
            tolerant(b"".join([self.surfaces[i] for i in run])) for control, run in groupby(ids, lambda i: self.kinds[i] == CONTROL) if not control
        ]
        text = "".join(parts)
        return text.removeprefix(" ") if self.dummy_prefix and first is not None and self.kinds[first] == NORMAL else text


def tolerant(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    parts: list[str] = []
    while data:
        try:
            parts.append(data.decode("utf-8"))
            break
        except UnicodeDecodeError as error:
            parts.append(data[: error.start].decode("utf-8") + "�")
            data = data[error.start + 1 :]
    return "".join(parts)


def read_model(path: str) -> Model:
    """A model file of kind BPE with an identity normaliser that keeps all white space."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
    kinds = [p.type for p in proto.pieces]
    if trainer.model_type != trainer.BPE or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models without user-defined or unused pieces")
    if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
        raise ValueError("only models with an identity normaliser")
    if trainer.treat_whitespace_as_suffix:
        raise ValueError("only models that mark spaces in front of words")
    return Model(
        [p.piece for p in proto.pieces],
        [p.score for p in proto.pieces],
        kinds,
        kinds.index(UNKNOWN),
        trainer.unk_surface,
        normalizer.add_dummy_prefix,
        trainer.byte_fallback,
    )


def _texts(batches: Batches):
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            yield batch, [t or "" for t in batch.column("text").to_pylist()]


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the ids of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches: Batches) -> Batches:
        for batch, texts in _texts(batches):
            ids = pa.array([shared.value.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text of every row of ids; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = pa.array([shared.value.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return in_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text that they decode to; ids do not leave the task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for batch, texts in _texts(batches):
            here = shared.value
            counts, ids_digests, text_digests = [], [], []
            for text in texts:
                ids = here.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(here.names.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(here.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return in_arrow(docs.select("doc_id", "text"), run, schema)


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return digests(table(spark, folder, "documents"), model)
