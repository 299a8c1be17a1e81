"""SentencePiece encoding and decoding as a max-plus parallel scan.

A byte-pair encoding is the one path through the lattice of pieces on which
every two neighbouring pieces are compatible: encoding the two together gives
just the two. With weight 0 for a compatible step and minus infinity for any
other (max-plus numbers), a stretch of text maps the states at its start to the
states at its end by a matrix, and matrices of neighbouring stretches multiply
associatively. A state is the piece that ends last and the characters by which
it reaches past the boundary. Matrices are sparse: they are kept as the exit
states that each entry state can lead to.

- Texts longer than CHUNK characters are cut every CHUNK characters, wherever
  that falls. Each chunk yields its matrix over all states that the characters
  around its start allow, independently of the other chunks.
- The matrices of a text are multiplied in order; the one path that reaches the
  end fixes the state at every boundary, and each chunk is then traced back
  from its own states, independently of the others.
- Nothing merges across some places: before a space mark that follows another
  character (if no piece holds such a pair), and around characters that occur in
  no longer piece. There the state is one and the same ("free"), so a matrix is
  the product of its stretch up to the first such place and the one from the
  last. What lies between the two has one entry and one exit, and its only path
  is the plain encoding of that stretch: the sentencepiece library traces it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .arrow import list_values, short_batches
from .text import whole

MARK = "▁"
CHUNK = 1 << 15
PAIRS = 1 << 16         # compatibility answers per Python worker
DECODED_AT_ONCE = 1 << 19  # ids
FAN = 64                # neighbouring matrices combined at a time
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


class State(NamedTuple):
    """The last piece and its reach past the boundary; ("", 0) where nothing merges across."""

    piece: str
    reach: int


FREE = State("", 0)
Matrix = dict[State, list[State]]


class Pieces:
    """A vocabulary with its lattice, encoding and decoding."""

    def __init__(self, ids: dict[str, int], score: dict[str, float], byte_ids: list[int], unk: int, plain=None):
        """``plain``: text -> ids of the text with the dummy prefix, for free stretches."""
        self.plain = plain
        self.ids, self.score, self.byte_ids, self.unk = ids, score, byte_ids, unk
        self.longest = max((len(p) for p in ids), default=1)
        raw = {i: p.replace(MARK, " ").encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        by_id = [raw.get(i, b"") for i in range(max(raw, default=0) + 2)]  # the last one, empty, stands for unknown ids
        self.piece_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.piece_ends = np.cumsum([0, *map(len, by_id)])
        self.joiners = set("".join(p for p in ids if len(p) > 1)) - {MARK}
        self.mark_resets = not any(MARK in p.lstrip(MARK) for p in ids)
        inside = "".join(map(re.escape, sorted(self.joiners)))
        body = f"[{inside}]" if self.mark_resets else f"[{inside}{MARK}]"
        self.words = re.compile(f"{MARK}*{body}+|{MARK}+|." if inside else ".", re.DOTALL).findall
        self.tree: dict = {}  # character -> (piece that ends here or None, onward)
        for piece in score:
            at = self.tree
            for c in piece[:-1]:
                at = at.setdefault(c, [None, {}])[1]
            at.setdefault(piece[-1], [None, {}])[0] = piece
        self.meets = lru_cache(PAIRS)(self._meets)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _meets(self, left: str, right: str) -> bool:
        """Is the step's weight 0? Otherwise it is minus infinity."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def resets(self, before: str, after: str) -> bool:
        """Does nothing merge across the place between two characters?"""
        if not before or not after:
            return True
        alone = lambda c: c != MARK and c not in self.joiners
        return alone(before) or alone(after) or (self.mark_resets and before != MARK and after == MARK)

    def forward(self, text: str, entry: State, like: list | None = None) -> list:
        """For each position the piece that ends there on the live path from
        ``entry`` (None: weight minus infinity); a state and a position have at
        most one such path.

        ``like`` is the answer for another entry; once both agree over the
        longest piece they agree for good and the rest is copied.
        """
        n, longest, meets, branches = len(text), self.longest, self.meets, self.tree.get
        live: list[str | None] = [None] * (n + 1)
        if entry.reach <= n:
            live[entry.reach] = entry.piece
        same = 0
        for i in range(entry.reach, n + 1):
            before = live[i]
            if like is not None:
                same = same + 1 if before == like[i] else 0
                if same > longest:
                    live[i + 1:] = like[i + 1:]
                    break
            if before is None or i == n:
                continue
            node = branches(text[i])
            if node is None or node[0] is None:  # a single character is always a piece
                if live[i + 1] is None and meets(before, text[i]):
                    live[i + 1] = text[i]
            end = i
            while node is not None:
                end += 1
                piece, onward = node
                if piece is not None and live[end] is None and meets(before, piece):
                    live[end] = piece
                if end == n:
                    break
                node = onward.get(text[end])
        return live

    def ids_between(self, live: list, begin: int, end: int) -> bytes:
        """Trace the path back from ``end`` to ``begin``."""
        found: list[str] = []
        while end > begin:
            found.append(live[end])
            end -= len(live[end])
        return self.packed(found[::-1])

    def numbers(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unk]

    def path(self, text: str) -> list[str]:
        """The live path over a whole stretch from the free state.

        Depth first, longest piece first. A position is reached by one path at
        most, so one that leads nowhere is never visited again.
        """
        n, meets, tree, reach, dead = len(text), self.meets, self.tree.get, self.longest, set()
        found: list[str] = []
        at, before = 0, ""
        while at < n:
            ways = [text[at]]
            node = tree(text[at])
            if node is not None:
                onward = node[1]
                for c in text[at + 1:at + reach]:
                    node = onward.get(c)
                    if node is None:
                        break
                    piece, onward = node
                    if piece is not None:
                        ways.append(piece)
            for piece in reversed(ways):
                if at + len(piece) not in dead and meets(before, piece):
                    found.append(piece)
                    at, before = at + len(piece), piece
                    break
            else:
                dead.add(at)
                at -= len(found.pop())
                before = found[-1] if found else ""
        return found

    def packed(self, pieces: list[str]) -> bytes:
        return np.array([i for p in pieces for i in self.numbers(p)], np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids (int32) of a normalised stretch between two free places."""
        at = text.find(MARK) if self.plain and self.mark_resets else -1
        if at < 0 or len(text) == at + 1:
            return b"".join([self.packed(self.path(w)) for w in self.words(text)])
        first = self.encode(text[:at]) if at else b""
        return first + np.array(self.plain(text[at + 1:]), np.int32).tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of rows of ids: byte pieces are UTF-8, the dummy prefix goes,
        unknown ids are empty, broken UTF-8 becomes replacement characters."""
        ids = np.where((ids >= 0) & (ids < len(self.piece_ends) - 2), ids, len(self.piece_ends) - 2)
        size = np.diff(self.piece_ends)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_bytes[np.repeat(self.piece_ends[ids] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[offsets]
        full = cuts[1:] > cuts[:-1]
        begins = cuts[:-1][full]
        keep = np.ones(len(data), bool)
        keep[begins[data[begins] == 32]] = False
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole_bytes = data[keep].tobytes()
            out = pa.array([whole_bytes[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)], pa.large_string())
        return out


class Chunk(NamedTuple):
    """A stretch of normalised text with up to ``longest`` characters on both sides."""

    behind: str
    body: str
    ahead: str


def normalise(text: str) -> str:
    """The identity rule with the dummy prefix; the empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def cut(text: str, size: int, margin: int) -> Iterator[Chunk]:
    for at in range(0, len(text), size):
        yield Chunk(text[max(0, at - margin):at], text[at:at + size], text[at + size:at + size + margin])


def _ends(p: Pieces, c: Chunk) -> tuple[int, int] | None:
    """First and last place of the chunk, its boundaries included, where nothing merges across."""
    n = len(c.body)
    at = lambda i: p.resets(c.body[i - 1] if i else c.behind[-1:], c.body[i] if i < n else c.ahead[:1])
    first = next((i for i in range(n + 1) if at(i)), None)
    return None if first is None else (first, next(i for i in range(n, -1, -1) if at(i)))


def entries(p: Pieces, c: Chunk) -> list[State]:
    """All states that the characters around the chunk's start allow."""
    if p.resets(c.behind[-1:], c.body[:1]):
        return [FREE]
    text, n = c.behind + c.body + c.ahead, len(c.behind)
    found = [State(text[s:e], e - n) for s in range(max(0, n - p.longest), n) for e in range(n, min(len(text), s + p.longest) + 1)]
    return [x for x in found if x.piece in p.score or len(x.piece) == 1]


def _exits(live: list, n: int) -> list[State]:
    return [State(live[e], e - n) for e in range(n, len(live)) if live[e] and e - len(live[e]) < n]


def transfer(p: Pieces, c: Chunk) -> Matrix:
    """The chunk's matrix."""
    n, ends, known = len(c.body), _ends(p, c), None
    out: Matrix = {}
    if ends is None:
        for e in entries(p, c):
            if e.reach > n:
                out[e] = [State(e.piece, e.reach - n)]
                continue
            live = p.forward(c.body + c.ahead, e, known)
            known = known or live
            passes = [State(e.piece, 0)] if e.reach == n else []
            out[e] = passes + _exits(live, n)
        return {e: x for e, x in out.items() if x}
    first, last = ends
    tail = p.forward(c.body[last:] + c.ahead, FREE)
    leave = [FREE] if last == n else _exits(tail, n - last)
    for e in entries(p, c):
        if e.reach <= first and (first == 0 or p.forward(c.body[:first], e)[first] is not None):
            out[e] = leave
    return out


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbouring stretches; associative."""
    return {e: x for e, mids in a.items() if (x := list(dict.fromkeys(y for m in mids for y in b.get(m, []))))}


def boundary_states(matrices: list[Matrix], entry: State = FREE, leave: State | None = None) -> list[State]:
    """The states before, between and after neighbouring stretches, given those at both
    ends; without ``leave`` the last stretch ends the text."""
    reached = [{entry: [entry]}]
    for m in matrices:
        reached.append(compose(reached[-1], m))
    state = next(s for s in reached[-1][entry] if s.reach == 0) if leave is None else leave
    states = [state]
    for m, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        state = next(s for s in before[entry] if state in m.get(s, ()))
        states.append(state)
    return states[::-1]


def trace(p: Pieces, c: Chunk, entry: State, leave: State) -> bytes:
    """Ids of the pieces that begin in the chunk, given the states at both ends."""
    n, ends = len(c.body), _ends(p, c)
    if ends is None:
        return p.ids_between(p.forward(c.body + c.ahead, entry), entry.reach, n + leave.reach) if entry.reach < n else b""
    first, last = ends
    out = p.ids_between(p.forward(c.body[:first], entry), entry.reach, first) + p.encode(c.body[first:last])
    tail = c.body[last:] + c.ahead
    return out + (p.ids_between(p.forward(tail, FREE), 0, n - last + leave.reach) if last < n else b"")


@lru_cache(2)
def parse_model(raw: bytes) -> Pieces:
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(raw)
    if m.trainer_spec.model_type != pb.TrainerSpec.BPE or m.normalizer_spec.name != "identity":
        raise ValueError("a BPE model with the identity normaliser is needed")
    kinds = pb.ModelProto.SentencePiece
    normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
    return Pieces({p: i for p, (i, _) in normal.items()}, {p: s for p, (_, s) in normal.items()},
                  [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], m.trainer_spec.unk_id,
                  SentencePieceProcessor(model_proto=raw).encode)


def read_model(path: str = MODEL_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id", chunk: int = CHUNK,
                     carry: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """(doc_id, ``carry`` columns, text_sha256, ids): the ids of every row's whole text.

    Null and empty texts have no ids. Characters outside the vocabulary become
    byte pieces. Repeated rows and null keys are rows of their own; an empty
    table gives no rows; only the named columns are read. ``model`` (half a
    megabyte) travels with the tasks.
    """
    short_batches(docs.sparkSession)
    names = ["doc_id", *carry, "text_sha256"]
    rows = docs.select(F.col(key).alias("doc_id"), *carry, F.sha2(whole(text), 256).alias("text_sha256"), whole(text).alias("_t"))
    margin = parse_model(model).longest

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parse_model(model)
        for b in batches:
            ids = [trace(p, Chunk("", normalise(t.as_py()), ""), FREE, FREE) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids)], names=[*names, "ids"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0), b.column(1), strict=True):
                held = []
                for no, c in enumerate(cut(normalise(t.as_py()), chunk, margin)):
                    held.append((row.as_py(), no, *c))
                    if len(held) == 64:
                        yield _batch(held, _CHUNK)
                        held = []
                yield _batch(held, _CHUNK)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parse_model(model)
        for b in batches:
            for row, no, *c in _rows(b):
                yield _batch(_matrix_rows(row, no, transfer(p, Chunk(*c))), _STATES)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parse_model(model)
        for b in batches:
            for row, no, behind, body, ahead, p0, r0, p1, r1 in _rows(b):
                ids = trace(p, Chunk(behind, body, ahead), State(p0, r0), State(p1, r1))
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([no], pa.int32()), _lists([ids])], names=["row", "no", "part"])

    shape = rows.select(*names, F.array().cast("array<int>").alias("ids")).schema
    small = rows.filter(F.length("_t") < chunk).mapInArrow(short, shape)
    giant = cut_lineage(rows.filter(F.length("_t") >= chunk).select(
        F.monotonically_increasing_id().alias("row"), *names, F.col("_t").alias("t")), "giant-texts")
    table = cut_lineage(giant.select("row", "t").mapInArrow(chunks, _ddl(_CHUNK)), "chunks")
    states = _scan(table.mapInArrow(matrices, _ddl(_STATES)), fan)
    parts = table.join(states, ["row", "no"]).select(*_CHUNK, *list(_STATES)[2:]).mapInArrow(traced, "row bigint, no int, part array<int>")
    whole_ids = parts.groupBy("row").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("no", "part"))), lambda x: x["part"])).alias("ids"))
    large = giant.select("row", *names).join(whole_ids, "row").select(*names, "ids")
    return small.unionByName(large)


_CHUNK = {"row": pa.int64(), "no": pa.int32(), "behind": pa.string(), "body": pa.string(), "ahead": pa.string()}
_STATES = {"row": pa.int64(), "no": pa.int32(), "p0": pa.string(), "r0": pa.int32(), "p1": pa.string(), "r1": pa.int32()}
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in columns.items())


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, columns.values(), strict=True)], names=list(columns))


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _matrix_rows(row: int, no: int, m: Matrix) -> list[tuple]:
    return [(row, no, *e, *x) for e, xs in m.items() for x in xs]


def _chain(table: pa.Table) -> tuple[int, dict[int, Matrix]]:
    """The row and the matrices, by their number, of a group."""
    row, chain = 0, {}
    for row, no, p0, r0, p1, r1 in _rows(table.select(list(_STATES))):
        chain.setdefault(no, {}).setdefault(State(p0, r0), []).append(State(p1, r1))
    return row, dict(sorted(chain.items()))


def _combined(table: pa.Table, fan: int) -> pa.Table:
    """The matrix of ``fan`` neighbours."""
    row, chain = _chain(table)
    return pa.Table.from_batches([_batch(_matrix_rows(row, next(iter(chain)) // fan, reduce(compose, chain.values())), _STATES)])


def _state_rows(row: int, chain: dict[int, Matrix], states: list[State]) -> pa.Table:
    return pa.Table.from_batches([_batch([(row, no, *a, *b) for no, a, b in zip(chain, states, states[1:], strict=False)], _STATES)])


def _solved(table: pa.Table) -> pa.Table:
    """The states around each of the last matrices of a text."""
    row, chain = _chain(table)
    return _state_rows(row, chain, boundary_states(list(chain.values())))


def _resolved(table: pa.Table, around: pa.Table) -> pa.Table:
    """The states around each of some neighbours, given those around all of them."""
    row, chain = _chain(table)
    _row, _no, p0, r0, p1, r1 = next(_rows(around.select(list(_STATES))))
    return _state_rows(row, chain, boundary_states(list(chain.values()), State(p0, r0), State(p1, r1)))


def _scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(row, no, p0, r0, p1, r1): the states before and after every chunk.

    Matrices are combined ``fan`` at a time, level upon level, until ``fan`` or fewer are
    left of any text; these fix the states between them, which are then handed down
    level by level. A group holds ``fan`` matrices, whatever the length of a text.
    """
    n = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.floor(F.col("no") / fan).cast("int").alias("group")
    dealt = lambda df, by: df.withColumn("group", by).repartition(n, "row", "group")
    levels = [cut_lineage(matrices, "matrices")]
    while (levels[-1].agg(F.max("no")).first()[0] or 0) >= fan:
        levels.append(cut_lineage(dealt(levels[-1], group).groupBy("row", "group").applyInArrow(lambda t: _combined(t, fan), _ddl(_STATES)), "matrices"))
    states = dealt(levels[-1], F.lit(0)).groupBy("row", "group").applyInArrow(_solved, _ddl(_STATES))
    for level in reversed(levels[:-1]):
        around = dealt(states, F.col("no")).groupBy("row", "group")
        states = dealt(level, group).groupBy("row", "group").cogroup(around).applyInArrow(_resolved, _ddl(_STATES))
    return states


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` (with ``ids``) and its column ``decoded``; null ids give a null text."""
    from pyspark.sql.types import StringType, StructField, StructType

    short_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parse_model(model)
        for b in batches:
            column = b.column(b.schema.get_field_index("ids"))
            values, offsets = list_values(column)
            texts = []
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + DECODED_AT_ONCE, side="right")) - 1)
                texts.append(p.decode(values[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
                lo = hi
            decoded = pa.concat_arrays(texts) if texts else pa.array([], pa.large_string())
            decoded = pc.if_else(column.is_valid(), decoded, pa.scalar(None, pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, decoded], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def _lists(rows: list[bytes]) -> pa.Array:
    """Rows of packed ids as one list column."""
    ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
