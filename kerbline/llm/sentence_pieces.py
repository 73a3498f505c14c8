"""SentencePiece encoding and decoding of whole texts, exact for merge-type models with byte fallback.

A model of this type repeats one step: merge the two neighbours whose joint piece has the best score, the leftmost of equals.
The result has a local test: a row of pieces is what merging yields if and only if merging any two adjacent ones afresh
(``compatible``) gives these two back. So encoding is a search: at each place take the longest piece that an Aho-Corasick
automaton finds there (built over reversed pieces and run from the end, so that it reports matches by where they start), go on
to its next shorter prefix where it does not go with the piece before, and step back where none does. A bitfield keeps the
places from which no way led on, so each is left but once and the search is linear.

Texts are worked through in stretches and these in chunks, both cut only where no piece of the vocabulary can lie across:
before a space that follows something else, at characters without a piece, and between letters and other characters if the
vocabulary keeps these apart, which is looked up. Chunks up to 48 characters are remembered in a table of bounded size.

Defined cases: null text is empty; an empty text has begin and end only; a line feed and whatever else has no piece becomes
its UTF-8 bytes; U+2581 is a space, as the library has it. Repeated rows are encoded as often as they occur. Decoding takes
null for no ids; ids outside the vocabulary are an error, as in the library; bytes that are no UTF-8 become U+FFFD one by one.
An empty table gives no rows. Columns besides doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
STRETCH = 1 << 20  # characters worked through at a time


class Model:
    """The vocabulary of a merge-type model file, its automaton and its tables."""

    def __init__(self, path: str, room: int = 700_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is not a merge-type model with byte fallback and leading spaces")
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path} normalises texts")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.unk_surface = trainer.unk_surface
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE)]
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        letters = {c for p in self.ids for c in p}
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        if not letters <= self.ids.keys() or "\n" in letters or any(b == SPACE != a for a, b in pairs):
            raise ValueError(f"{path} has pieces across spaces or line feeds, or of characters that are no pieces")
        apart = re.compile(r"[^\W\d_]")
        mixed = any(a != SPACE and bool(apart.match(a)) != bool(apart.match(b)) for a, b in pairs)
        other = rf"{SPACE}*[^{SPACE}\n]+"
        fine = rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:(?![{SPACE}\n])[\W\d_])+"
        self.chunks = re.compile(rf"{other if mixed else fine}|{SPACE}+|\n").findall
        sound = {p for p in self.ids if self.merge(p) == [p]}  # what merging can make at all
        self.length = [len(p) for p in self.pieces]
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in sound), -1) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p in sound:
                self.automaton.add_word(p[::-1], i)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.room = room
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    def _surface(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unk_surface.encode()
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """What merging makes of a short text: the rule itself, step by step."""
        row = list(text)
        while True:
            best, at = None, -1
            for k in range(len(row) - 1):
                i = self.ids.get(row[k] + row[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return row
            row[at : at + 2] = [row[at] + row[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging pieces a and b afresh gives them back; remembered."""
        key = a * len(self.pieces) + b
        found = self.pairs.get(key)
        if found is None:
            one, two = self.pieces[a], self.pieces[b]
            if len(self.pairs) >= 4 * self.room:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(one + two) == [one, two]
        return found

    def longest(self, text: str) -> list[int]:
        """The longest piece that starts at each place, -1 where none does."""
        out, last = [-1] * len(text), len(text) - 1
        for end, piece in self.automaton.iter(text[::-1]):  # longest first among those that end (start) at one place
            if out[last - end] < 0:
                out[last - end] = piece
        return out

    def walk(self, longest: list[int], start: int, stop: int) -> list[int]:
        """The pieces of a stretch [start, stop) all of whose characters are pieces."""
        length, shorter, known, many = self.length, self.shorter, self.pairs, len(self.pieces)
        failed = None  # the bitfield, made when the first place has failed
        row: list[int] = []
        at, piece, last = start, longest[start], -1
        while True:
            while piece >= 0:
                to = at + length[piece]
                if to <= stop and not (failed and failed[to - start >> 3] >> (to - start & 7) & 1):
                    if last < 0:
                        break
                    fits = known.get(last * many + piece)
                    if fits or fits is None and self.compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                row.append(piece)
                if to == stop:
                    return row
                at, last, piece = to, piece, longest[to]
                continue
            if last < 0:
                raise ValueError("no row of pieces is stable")
            failed = failed or bytearray((stop - start >> 3) + 1)  # no piece leads on from here: the one before has to be a shorter one
            failed[at - start >> 3] |= 1 << (at - start & 7)
            row.pop()
            at -= length[last]
            piece, last = shorter[last], row[-1] if row else -1

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks, none of which any piece can leave; the automaton runs once over all of them."""
        longest = self.longest("\n".join(chunks))
        ids: list[int] = []
        ends, base = [], 0
        for chunk in chunks:
            at, stop = base, base + len(chunk)
            while at < stop:
                if longest[at] < 0:
                    ids += [self.bytes[b] for b in chunk[at - base].encode()]
                    at += 1
                    continue
                try:
                    to = longest.index(-1, at, stop)
                except ValueError:
                    to = stop
                ids += self.walk(longest, at, to)
                at = to
            ends.append(4 * len(ids))
            base = stop + 1
        data = np.array(ids, "<u4").tobytes()
        return [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts, without begin and end."""
        out: list[list[bytes]] = [[] for _ in texts]
        for group in grouped(texts):
            split = [(n, self.chunks(part)) for n, part in group]
            known = self.known
            missing = list({c for _, chunks in split for c in chunks if c not in known})
            fresh: dict[str, bytes] = {}
            for a in range(0, len(missing), 4096):
                fresh.update(zip(missing[a : a + 4096], self.encode_chunks(missing[a : a + 4096]), strict=True))
            short = {c: ids for c, ids in fresh.items() if len(c) <= 48}
            if len(known) + len(short) <= self.room:
                known |= short
            for n, chunks in split:
                if fresh:
                    out[n].append(b"".join([fresh[c] if c in fresh else known[c] for c in chunks]))
                else:
                    out[n].append(b"".join(map(known.__getitem__, chunks)))
        return [b"".join(parts) for parts in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces for U+2581 but for the one that the encoder puts first, runs of byte pieces as UTF-8."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        cut = self._first(ids)
        try:
            return data.decode()[cut:]
        except UnicodeDecodeError:
            return self._mend(ids)[cut:]

    def _first(self, ids: np.ndarray) -> int:
        """1 if the first piece that shows is one that begins with a space."""
        for i in ids.tolist():
            if self.kinds[i] != CONTROL:
                return int(self.kinds[i] == NORMAL and self.pieces[i].startswith(SPACE))
        return 0

    def _mend(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()
        for i in [*ids.tolist(), self.end]:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                del run[:n]
            out.append(self.surface[i].decode())
        return "".join(out)


def stretches(text: str) -> Iterator[str]:
    """The text with its spaces escaped and the first one added, in parts that no piece can lie across."""
    if not text:
        return
    text = SPACE + text.replace(" ", SPACE)
    at = 0
    while len(text) - at > STRETCH:
        cut = _CUT.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


_CUT = re.compile(rf"\n|[^{SPACE}](?={SPACE})")


def grouped(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Numbered stretches of all texts, together as long as one stretch."""
    group: list[tuple[int, str]] = []
    size = 0
    for n, text in enumerate(texts):
        for part in stretches(text):
            group.append((n, part))
            size += len(part)
            if size >= STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


_MODELS: dict[str, Model] = {}


def _model(path: str | None) -> Model:
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _each(df: DataFrame, column: str, schema: str, work: Callable[[list], pa.Array], name: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), work(part.column(column).to_pylist())], ["doc_id", name])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column)).mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text; model: a file that executors can open too."""

    def work(texts: list[str]) -> pa.Array:
        m = _model(model)
        first = np.array([m.begin], "<u4").tobytes() if begin else b""
        last = np.array([m.end], "<u4").tobytes() if end else b""
        return pa.array([first + ids + last for ids in m.encode(texts)], pa.binary())

    return _each(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, ids binary", work, "ids")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""

    def work(ids: list[bytes | None]) -> pa.Array:
        m = _model(model)
        return pa.array([m.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.string())

    return _each(rows, "ids", "doc_id long, text string", work, "text")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and decoded: both ways in one pass over the texts, so that no row has to find its partner again."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = _model(model)
        first, last = (np.array([i], "<u4").tobytes() for i in (m.begin, m.end))
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                ids = [first + x + last for x in m.encode(part.column("text").to_pylist())]
                texts = [m.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
