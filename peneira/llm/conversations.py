"""Conversation repair: cheapest edits by a grammar-compressed dynamic program.

A conversation is a sequence of symbols, one per row: what its role begins with and what is
wrong with it. Edits must turn the roles into ``(s?(ua)+)?``, which four states accept; a
symbol is a min-plus matrix over them. Re-Pair replaces the pairs most frequent over all
conversations by rules, and a rule's matrix is the product of its two parts' matrices, so
that what conversations share is worked out once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import partitions_for, spread_join
from peneira.session import stage

# Costs of the edits, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_CLOSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"

# Rules of the grammar and how often a pair must occur; what no rule covers is folded symbol by symbol.
MAX_RULES = 512
MAX_ROUNDS = 24
LEAST_PAIRS = 4
_FIRST_RULE = 0x4E00
FRAGMENT_ROWS = 1 << 14
# Sequences a worker keeps with their repairs, and the rows of the longest of them.
MEMO, MEMO_ROWS = 20_000, 200

# Ropes: a string, or the two ropes it is made of.
Rope = str | tuple["Rope", "Rope"]
# By target state: cost, rank and audit; None where no edits lead there. Ranks order the audits of one row.
Entry = tuple[int, int, Rope]
Row = list[Entry | None]


def _ranked(row: list[tuple[int, object, Rope] | None]) -> Row:
    """Entries with their order keys replaced by ranks."""
    order = {key: k for k, key in enumerate(sorted(e[1] for e in row if e))}
    return [e and (e[0], order[e[1]], e[2]) for e in row]


def _terminal(symbol: str) -> list[Row]:
    """Matrix of one row: inserted turns, then what happens to the row itself.

    ``d`` must be deleted; s, u, a and o say what the role begins with (o: anything else),
    capitals that the row is truncated.
    """
    extra = TRUNCATED if symbol.isupper() else 0
    matrix = []
    for state in range(STATES):
        best: list[tuple[int, str] | None] = [None] * STATES
        for inserts in range(STATES):
            cost, audit = INSERT * inserts, "I" * inserts
            options = [(DELETE, "D", state)]
            if symbol != "d":
                options.append((REROLE + extra, "R", _NEXT_TURN[state]))
                kept = _NEXT.get(symbol.lower(), {}).get(state)
                if kept is not None:
                    options.append((extra, "K", kept))
            for more, edit, to in options:
                entry = (cost + more, audit + edit)
                if best[to] is None or entry < best[to]:
                    best[to] = entry
            state = _NEXT_TURN[state]
        matrix.append(_ranked([e and (e[0], e[1], e[1]) for e in best]))
    return matrix


def _step(row: Row, matrix: list[Row]) -> Row:
    """One row of the min-plus product.

    Audits of one row of a matrix end in different states. Each of them says where it ends, and each ends
    with the edit of the last row, so none begins another: two of them differ before either
    ends, and their order is that of whatever follows them too. So ranks decide all ties and
    no audit is ever spelt out.
    """
    out: list[tuple[int, object, Rope] | None] = [None] * STATES
    for via, first in enumerate(row):
        if first is None:
            continue
        cost, rank, rope = first
        for to, second in enumerate(matrix[via]):
            if second is not None:
                old = out[to]
                total = cost + second[0]
                if old is None or total < old[0] or total == old[0] and rank < old[1][0]:
                    out[to] = (total, (rank, second[1]), (rope, second[2]))
    return _ranked(out)


def spell(rope: Rope) -> str:
    parts, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            parts.append(r)
        else:
            todo += (r[1], r[0])
    return "".join(parts)


@dataclass
class Grammar:
    """Rules in the order they were made: the pair of symbols each stands for."""

    pairs: list[str] = field(default_factory=list)

    def symbol(self, k: int) -> str:
        return chr(_FIRST_RULE + k)

    def compressed(self, text: str, first: int = 0) -> str:
        """``text`` with the rules from ``first`` on applied, each from the left."""
        for k in range(first, len(self.pairs)):
            if self.pairs[k] in text:
                text = text.replace(self.pairs[k], self.symbol(k))
        return text

    def matrices(self) -> dict[str, list[Row]]:
        """Bottom-up: one matrix per symbol and rule."""
        known = {s: _terminal(s) for s in "dsuaoSUAO"}
        for k, (left, right) in enumerate(self.pairs):
            known[self.symbol(k)] = [_step(row, known[right]) for row in known[left]]
        return known


class Repairer:
    """Cheapest edits of symbol sequences, by the matrices of a grammar."""

    def __init__(self, pairs: tuple[str, ...]) -> None:
        self.grammar = Grammar(list(pairs))
        self.matrix = self.grammar.matrices()
        self.known = lru_cache(MEMO)(self._repair)

    def repair(self, symbols: str) -> tuple[int, str]:
        """Cost and audit; short sequences, which recur, are kept."""
        return self.known(symbols) if len(symbols) <= MEMO_ROWS else self._repair(symbols)

    def _repair(self, symbols: str) -> tuple[int, str]:
        row: Row = [(0, 0, ""), None, None, None]
        for s in self.grammar.compressed(symbols):
            row = _step(row, self.matrix[s])
        ends = [(e[0] + INSERT * _CLOSING[k], e[1], k, e[2]) for k, e in enumerate(row) if e]
        cost, _, state, rope = min(ends)[:4]
        return cost, spell(rope) + "I" * _CLOSING[state]


@lru_cache(maxsize=2)
def _repairer(pairs: tuple[str, ...]) -> Repairer:
    return Repairer(pairs)


def learn_grammar(sequences: DataFrame) -> Grammar:
    """Rules from the sequences ``symbols`` with their number ``n``.

    Each round counts neighbouring pairs over all sequences, takes the most frequent ones that
    share no symbol, as Re-Pair would one after the other, and goes on with the sequences
    shortened by them. Only counts of pairs, at most the square of the symbols, reach the
    driver. Rules decide the work, not the result.
    """
    grammar = Grammar()
    for _ in range(MAX_ROUNDS):
        pairs = tuple(grammar.pairs)

        def count(batches: Iterator[pa.RecordBatch], pairs: tuple[str, ...] = pairs) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            so_far = Grammar(list(pairs))
            for batch in batches:
                for text, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    text = so_far.compressed(text)
                    for pair, often in Counter(map("".join, zip(text, text[1:], strict=False))).items():
                        found[pair] += often * n
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pair", "n"])

        counts = sequences.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        best = counts.where(F.col("n") >= LEAST_PAIRS).orderBy(F.desc("n"), "pair").limit(MAX_RULES).collect()
        taken: set[str] = set()
        for r in best:
            if not taken & set(r["pair"]) and len(grammar.pairs) < MAX_RULES:
                taken |= set(r["pair"])
                grammar.pairs.append(r["pair"])
        if len(grammar.pairs) == len(pairs):
            break
    return grammar


def _text(c: str) -> Column:
    """Null counts as one blank."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _rows(conversations: DataFrame, times: str | None) -> DataFrame:
    """``conv_id, turn, role, text, times, content``: the rows, and what makes two of them the same."""
    many = F.lit(1) if times is None else F.coalesce(F.col(times), F.lit(1))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"),
        _text("text").alias("text"), many.cast("long").alias("times"),
    ).withColumn("content", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))


def _marked(rows: DataFrame) -> DataFrame:
    """One narrow row per conversation, turn and content: how many rows stand there and what is wrong with them.

    Rows are summed up per task before they move, and texts don't move at all. Only contents
    that a conversation holds in several turns are looked up, spread where there are many.
    """
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    start = F.substring("role", 1, 1)
    initial = F.when(start.isin("s", "u", "a"), start).otherwise("o")
    marks = rows.select("conv_id", "turn", "content", "times", initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    placed = stage(
        marks.groupBy("conv_id", "turn", "content").agg(
            F.sum("times").alias("times"), F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
        ),
        "turns",
    )
    there = placed.where("times > 0")
    several = (
        there.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "content")
        .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("several"))
        .where("several > 1")
    )
    keyed = placed.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    joined = spread_join(keyed, several, ["conv", "content"], F.col("turn"), "several", "left")
    earlier = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return joined.select("conv_id", "turn", "content", "times", "initial", "blank", "cut", earlier.alias("earlier"))


# One piece of a conversation whose rows follow each other in one task.
_PIECE = (
    "conv_id long, part int, piece int, symbols string, initials string, blank long, duplicate long, truncated long, "
    "least long, most long, turns long, last long"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols and counts of the pieces of FRAGMENT_ROWS rows, from rows in order."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = {c.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in _PIECE.split(", ")}
    done: list[tuple] = []
    now: dict | None = None
    number = 0

    def closed(p: dict) -> tuple:
        p["symbols"], p["initials"] = "".join(p["symbols"]), "".join(p["initials"])
        return tuple(p[c] for c in names)

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"] or now["rows"] >= FRAGMENT_ROWS:
                if now is not None:
                    done.append(closed(now))
                number += 1
                now = {
                    "conv_id": r["conv_id"], "part": r["part"], "piece": number, "symbols": [], "initials": [], "blank": 0, "duplicate": 0,
                    "truncated": 0, "least": None, "most": None, "turns": 0, "last": None, "rows": 0,
                }
            n = r["times"]
            now["rows"] += n
            if not n:
                continue
            now["initials"].append(r["initial"] * n)
            turn = r["turn"]
            if turn is not None:
                now["turns"] += turn != now["last"]
                now["least"] = turn if now["least"] is None else now["least"]
                now["most"] = now["last"] = turn
            if r["blank"]:
                now["blank"] += n
                now["symbols"].append("d" * n)
            else:
                again = n if r["earlier"] else n - 1
                now["duplicate"] += again
                if again < n:
                    now["truncated"] += r["cut"]
                    now["symbols"].append(r["initial"].upper() if r["cut"] else r["initial"])
                now["symbols"].append("d" * again)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=pa.schema(kinds.items()))
            done = []
    if now is not None:
        done.append(closed(now))
    yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=pa.schema(kinds.items()))


def _joined(pieces: list[dict]) -> dict:
    """A conversation from its pieces in order."""
    first = pieces[0]
    out = {"conv_id": first["conv_id"], "symbols": "".join(p["symbols"] for p in pieces)}
    out |= {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated")}
    initials = "".join(p["initials"] for p in pieces)
    legal = initials.count("su") + initials.count("ua") + initials.count("au")
    out["illegal"] = max(0, len(initials) - 1) - legal
    dated = [p for p in pieces if p["least"] is not None]
    turns = sum(p["turns"] for p in dated) - sum(a["last"] == b["least"] for a, b in zip(dated, dated[1:], strict=False))
    out["gaps"] = min(dated[-1]["most"] - dated[0]["least"] + 1 - turns, 2**63 - 1) if dated else 0
    return out


_SEQUENCE = "conv_id long, symbols string, blank long, duplicate long, truncated long, illegal long, gaps long"


def _sequences(pieces: DataFrame) -> DataFrame:
    """One row per conversation: its symbols, one letter per row, and its counts."""
    names = [c.split()[0] for c in _SEQUENCE.split(", ")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = pa.schema([(c, pa.string() if c == "symbols" else pa.int64()) for c in names])
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if held and held[0]["conv_id"] != p["conv_id"]:
                    out.append(_joined(held))
                    held = []
                held.append(p)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([_joined(held)], schema=schema)

    n = partitions_for(pieces.count(), 20_000)
    return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(join, _SEQUENCE)


def repairs(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation.

    Rows of a conversation are taken by turn, nulls first; rows of one turn by the hash of
    role and text, equal rows side by side. ``times`` names a column that says how often a row
    stands there; with 0 it is gone, but its conversation is listed. A row's first fault
    counts: blank, duplicate of an earlier row, truncated. ``audit`` is the first letters of
    the cheapest edits that give roles beginning ``(s?(ua)+)?``, the least in ASCII of equal ones.

    A null role or text counts as one blank, a null ``conv_id`` is a conversation of its own; empty texts are
    blank; repeated rows are duplicates; an empty table gives no rows and other columns are
    ignored. Only hashes and marks of rows are sorted. A conversation is cut into pieces of
    at most about FRAGMENT_ROWS rows wherever tasks end, so one that holds a third of all rows is many
    tasks' work until its sequence, a letter per row as in the result, is put together.
    """
    marked = stage(_marked(_rows(conversations, times)), "marked")
    n = partitions_for(marked.count(), 4 * FRAGMENT_ROWS)
    n = max(n, conversations.sparkSession.sparkContext.defaultParallelism)
    order = ["conv_id", F.asc_nulls_first("turn"), "content"]
    sorted_rows = marked.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    pieces = stage(sorted_rows.mapInArrow(_pieces, _PIECE), "pieces")
    sequences = stage(_sequences(pieces), "sequences")
    pairs = tuple(learn_grammar(stage(sequences.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "distinct")).pairs)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = _repairer(pairs).repair
        for batch in batches:
            found = [repair(s) for s in batch.column("symbols").to_pylist()]
            more = [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cost", "audit"])

    solved = sequences.mapInArrow(solve, f"{_SEQUENCE}, cost long, audit string")
    return solved.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_LINE = "conv_id long, place long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversations: each conversation's edits come first, then its rows in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    audit, at, state, place, conv = "", 0, START, 0, None
    out: list[tuple] = []

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = _NEXT_TURN[state]
            yield conv, place, "I", ROLES[state], ""
            at, place = at + 1, place + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times")]
        for conv_id, edits, role, text, times in zip(*columns, strict=True):
            if edits is not None:
                out += inserted()
                audit, at, state, place, conv = edits, 0, START, 0, conv_id
                continue
            for _ in range(times):
                out += inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = _NEXT_TURN[state] if edit == "R" else _NEXT[role[0]][state]
                out.append((conv, place, edit, ROLES[state] if edit == "R" else role, text))
                place += 1
            # Inserts after the last row belong to it; before another row they come first there too.
            out += inserted()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        out = []


def repaired(conversations: DataFrame, found: DataFrame, times: str | None = None) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of the conversations after the edits of ``repairs``.

    Texts move once, beside each conversation's edits, and are read in order. The rows of a conversation come
    together and by ``place`` in one partition: its digest needs them one after the other, and
    no task holds more than a batch of them.
    """
    rows = _rows(conversations, times).where("times > 0")
    edits = found.select("conv_id", "audit")
    both = rows.withColumns({"audit": F.lit(None).cast("string"), "kind": F.lit(1)}).unionByName(edits.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "content")
    return ordered.select("conv_id", "audit", "role", "text", "times").mapInArrow(_edited, _LINE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, read in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    digest, conv = None, None
    for batch in batches:
        out = []
        for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if not place:
                if digest is not None:
                    out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                digest, conv = hashlib.sha256(), conv_id
            digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of id and turn; ``times`` says how often a row stands there afterwards."""
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    role = F.when(kind == 4, "user").otherwise(_text("role"))
    many = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), many.alias("times"))


def repair_report(damaged: DataFrame) -> DataFrame:
    """Faults, cost and edits of every damaged conversation, and the digest of what repair leaves."""
    found = stage(repairs(damaged, "times"), "repairs")
    digests = repaired(damaged, found, "times").mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    same = found["conv_id"].eqNullSafe(digests["conv_id"])
    return found.join(digests, same, "left").select(found["conv_id"], *[c for c in found.columns if c != "conv_id"], digest)
