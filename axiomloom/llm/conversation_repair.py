"""The cheapest repair of a conversation's turns, with an audit of its edits.

A turn is kept (K, 0), its role set to user or assistant (R, 2), or deleted (D,
3); an empty user or assistant turn may be inserted anywhere (I, 2). Blank and
repeated turns have to go; a truncated one that stays adds 1. The initials of the
roles left have to read ``(s?(ua)+)?``. Among the cheapest repairs the one with the
ASCII-least audit string is taken; equal audits mean equal repairs.

Method: dynamic programming over (turns read, last role). An audit is a node of a
tree of edit letters, so prefixes are shared and a new edit is one node. Nodes know
their ancestors 1, 2, 4, ... steps up and a rolling hash of their string. Two
audits of equal cost are compared at the end of their longest common prefix, found
by lifting both past unequal hashes; that the prefixes are equal is then verified
along the letters, up to a shared or already verified node. If hashes collided,
the strings are compared letter by letter.

A conversation is a sorted stream in one task, since its repair and digest are
sequential. A role that can no longer win is dropped (a bound on how much dearer
another role's rest can be), and edits that all remaining audits share leave with
their turns, so a task holds the undecided turns, 16 bytes per turn to know
repeats, and one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LEGAL_PAIRS = ("su", "ua", "au")
EMPTY, S, U, A = range(4)  # nothing yet, and the last role
NAMED = {U: "user", A: "assistant"}
#: By state: where a role's initial leads, and the role that may be inserted or set.
MOVES = {EMPTY: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
OPEN = {EMPTY: U, S: U, U: A, A: U}
#: DEARER[q][p]: whatever follows state q can follow state p for so much more at most: delete the system turn
#: that only EMPTY can take, insert what p lacks, or both.
DEARER = {EMPTY: {S: 4, U: 5, A: 3}, S: {EMPTY: 0, U: 2, A: 0}, U: {EMPTY: 2, S: 2, A: 2}, A: {EMPTY: 0, S: 4, U: 2}}

_BLANKS = " \t\n\x0b\x0c\r"
SETTLE_AT = 128


class Audits:
    """A tree of edit letters; node 0 is the empty audit."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus, self.base = modulus, 1_000_003 % modulus
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... up, as many as the depth allows
        self.same_as = [0]

    def add(self, node: int, letter: str) -> int:
        new, ups = len(self.parent), [node]
        while len(self.up[ups[-1]]) >= len(ups):
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        self.up.append(ups)
        self.same_as.append(new)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        climb, k = self.depth[node] - depth, 0
        while climb:
            if climb & 1:
                node = self.up[node][k]
            climb, k = climb >> 1, k + 1
        return node

    def _known(self, node: int) -> int:
        same = self.same_as
        while same[node] != node:
            same[node] = same[same[node]]
            node = same[node]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same string, by its letters."""
        walked, x, y = [], a, b
        while (x := self._known(x)) != (y := self._known(y)):
            if self.letter[x] != self.letter[y]:
                return False
            walked.append((x, y))
            x, y = self.parent[x], self.parent[y]
        for x, y in walked:
            self.same_as[self._known(y)] = self._known(x)
        return True

    def spell(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        d = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, d), self.ancestor(b, d)
        if self.hash[x] == self.hash[y]:
            if self.equal(x, y):
                return self.depth[a] < self.depth[b]
        else:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]):
                    p, q = self.up[x][k], self.up[y][k]
                    if self.hash[p] != self.hash[q]:
                        x, y = p, q
            if self.letter[x] != self.letter[y] and self.equal(self.parent[x], self.parent[y]):
                return self.letter[x] < self.letter[y]
        return self.spell(a) < self.spell(b)  # hashes collided

    def shared(self, nodes: list[int]) -> int:
        """The deepest node that all of them descend from."""
        live = set(nodes)
        while len(live) > 1:
            deepest = max(live, key=self.depth.__getitem__)
            live.remove(deepest)
            live.add(self.parent[deepest])
        return live.pop()

    def regrown(self, root: int, nodes: list[int]) -> tuple[Audits, list[int]]:
        """A tree of what lies between ``root`` and the nodes, and the nodes in it."""
        new = Audits(self.modulus)
        place = {root: 0}
        for node in nodes:
            way = []
            while node not in place:
                way.append(node)
                node = self.parent[node]
            for n in reversed(way):
                place[n] = new.add(place[self.parent[n]], self.letter[n])
        return new, [place[n] for n in nodes]


class Repair:
    """Reads one conversation's turns in order; ``turn`` and ``close`` return the edits decided so far as
    (edit, fault, turn, was, role, text)."""

    def __init__(self, modulus: int = (1 << 61) - 1, settle_at: int = SETTLE_AT):
        self.audits = Audits(modulus)
        self.best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}  # state: cost, audit
        self.state = EMPTY  # after the edits returned
        self.rows: list[tuple] = []
        self.seen: set[bytes] = set()
        self.settle_at = self.limit = settle_at

    def fault(self, role: str, text: str) -> str | None:
        mark = blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        end = text.rstrip(_BLANKS)
        repeated = mark in self.seen
        self.seen.add(mark)
        return BLANK if not end else DUPLICATE if repeated else TRUNCATED if end[-1] not in ".!?" else None

    def _choose(self, options: dict[int, list[tuple[int, int, str]]]) -> dict[int, tuple[int, int]]:
        """The cheapest option (cost, audit so far, edit or "") of each state; ties by audit."""
        out = {}
        for state, ways in options.items():
            cost = min(w[0] for w in ways)
            nodes = [self.audits.add(n, e) if e else n for c, n, e in ways if c == cost]
            least = nodes[0]
            for node in nodes[1:]:
                if self.audits.less(node, least):
                    least = node
            out[state] = cost, least
        return out

    def _insert(self) -> None:
        """Turns inserted here: into U from all others, then into A from U."""
        for into in (U, A):
            ways = {into: [(*self.best[into], "")] if into in self.best else []}
            ways[into] += [(c + INSERT_COST, n, INSERT) for q, (c, n) in self.best.items() if OPEN[q] == into]
            if ways[into]:
                self.best |= self._choose(ways)

    def turn(self, turn, role: str, text: str) -> list[tuple]:
        fault = self.fault(role, text)
        self._insert()
        options: dict[int, list] = {}
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for q, (cost, node) in self.best.items():
            options.setdefault(q, []).append((cost + DELETE_COST, node, DELETE))
            if fault in (BLANK, DUPLICATE):
                continue
            if (to := MOVES[q].get(role[:1])) is not None:
                options.setdefault(to, []).append((cost + extra, node, KEEP))
            options.setdefault(OPEN[q], []).append((cost + REROLE_COST + extra, node, REROLE))
        best = self._choose(options)
        self.best = {q: (c, n) for q, (c, n) in best.items()
                     if not any(p != q and best[p][0] + DEARER[q][p] < c for p in best)}
        self.rows.append((turn, role, text, fault))
        return self._settle() if len(self.audits.parent) > 8 * self.limit else []

    def _settle(self) -> list[tuple]:
        states = list(self.best)
        nodes = [self.best[q][1] for q in states]
        root = self.audits.shared(nodes)
        out = self._edits(root)
        self.audits, nodes = self.audits.regrown(root, nodes)
        self.best = {q: (self.best[q][0], n) for q, n in zip(states, nodes, strict=True)}
        self.limit = max(self.settle_at, len(self.audits.parent) // 4)
        return out

    def _edits(self, node: int) -> list[tuple]:
        out, used = [], 0
        for edit in self.audits.spell(node):
            row = None
            if edit != INSERT:
                row, used = self.rows[used], used + 1
            if edit == KEEP:
                self.state = MOVES[self.state][row[1][:1]]
            elif edit != DELETE:
                self.state = OPEN[self.state]
            if edit == INSERT:
                out.append((edit, None, None, None, NAMED[self.state], ""))
            else:
                role = None if edit == DELETE else row[1] if edit == KEEP else NAMED[self.state]
                out.append((edit, row[3], row[0], row[1], role, None if edit == DELETE else row[2]))
        del self.rows[:used]
        return out

    def close(self) -> list[tuple]:
        self._insert()
        return self._edits(self._choose({0: [(*self.best[q], "") for q in (EMPTY, A) if q in self.best]})[0][1])


_FIELDS = ("edit", "fault", "turn", "was", "role", "text")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           present: Column | None = None) -> DataFrame:
    """(conv_id, edit, fault, turn, was, role, text): the edits of each conversation, in order within it.

    ``was`` is the role before the edit; an inserted turn has none and no turn,
    a deleted one has no role and text after it. Null roles and texts are one
    space, so such a turn is blank; null turns come first, ties in ``turn`` are
    ordered by role and text; null conversations are one more conversation. Rows
    for which ``present`` is false only name their conversation: one that has no
    other gives a row without an edit. An empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("r"), blank(text).alias("t"),
                        (F.lit(True) if present is None else present).alias("p"))
    kinds = dict(rows.dtypes)
    streamed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "r", "t")  # Spark sorts nulls first

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, conv_now, none_yet, done = None, None, None, True, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[] for _ in schema]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def put(edits: list[tuple]) -> None:
            done.extend((conv_now, *e) for e in edits)

        def end() -> None:
            put([(None,) * len(_FIELDS)] if none_yet else now.close())

        for b in batches:
            schema = pa.schema([b.schema.field(0), *[pa.field(f, b.schema.field(1).type if f == "turn" else pa.string()) for f in _FIELDS]])
            for conv_id, at, r, t, there in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if now is None or conv_id != conv_now:
                    if now is not None:
                        end()
                    now, conv_now, none_yet = Repair(), conv_id, True
                if there:
                    none_yet = False
                    put(now.turn(at, r, t))
            if len(done) > 1_000:
                yield out()
        if now is not None:
            end()
            yield out()

    return streamed.mapInArrow(mend, f"conv_id {kinds['conv_id']}, edit string, fault string, turn {kinds['turn']}, was string, role string, text string")


class _Digest:
    def __init__(self, conv):
        self.conv, self.audit, self.hash, self.lines = conv, [], hashlib.sha256(), 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0

    def add(self, edit, fault, turn, was, role, text) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
        if fault:
            self.faults[fault] += 1
            self.cost += TRUNCATED_COST if fault == TRUNCATED and edit != DELETE else 0
        if edit != INSERT:
            if turn is not None:
                self.turns += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
            self.illegal += self.before is not None and self.before + was[:1] not in LEGAL_PAIRS
            self.before = was[:1]
        if role is not None:
            self.hash.update(f"{'' if not self.lines else chr(10)}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """What the edits of each conversation say, read in the order ``repair`` gave them, without a shuffle."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, now, done = None, None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[] for _ in names]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv, *edit in zip(*[b.column(i).to_pylist() for i in range(7)], strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(*edit)
            if len(done) > 5_000:
                yield out()
        if now is not None:
            done.append(now.row())
            yield out()

    kind = dict(edits.dtypes)["conv_id"]
    return edits.mapInArrow(digest, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn (``there`` is
    false), 1 empties it, 2 takes its full stops away, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"),
                        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (kind != 0).alias("there"), F.explode(times).alias("copy")).drop("copy")


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """(cost, audit, repaired turns) of a short conversation by trying every edit sequence; for tests."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(_BLANKS)
        faults.append(BLANK if not end else DUPLICATE if (role, text) in seen else TRUNCATED if end[-1] not in ".!?" else None)
        seen.add((role, text))
    best: list = []

    def go(i: int, cost: int, audit: str, made: tuple, inserts: int) -> None:
        if best and cost > best[0][0]:
            return
        initials = "".join(r[:1] or "-" for r, _ in made)
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            if not best or (cost, audit) < best[0][:2]:
                best[:] = [(cost, audit, list(made))]
        if inserts < 3:
            for r in NAMED.values():
                go(i, cost + INSERT_COST, audit + INSERT, (*made, (r, "")), inserts + 1)
        if i < len(rows):
            (role, text), extra = rows[i], TRUNCATED_COST if faults[i] == TRUNCATED else 0
            if faults[i] not in (BLANK, DUPLICATE):
                go(i + 1, cost + extra, audit + KEEP, (*made, (role, text)), 0)
                for r in NAMED.values():
                    go(i + 1, cost + REROLE_COST + extra, audit + REROLE, (*made, (r, text)), 0)
            go(i + 1, cost + DELETE_COST, audit + DELETE, made, 0)

    go(0, 0, "", (), 0)
    return best[0]
