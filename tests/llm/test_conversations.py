"""Cheapest repairs against all edit sequences, and the query against a plain walk over each conversation."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from corpus_fixtures import found
from pyspark.sql import functions as F

from peneira.llm import conversations, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = r"[\x20\x09-\x0D]"


def allowed(symbol):
    if symbol == "d":
        return ["D"]
    return ["K", "R", "D"] if symbol.lower() in "sua" else ["R", "D"]


def roles_of(symbols, audit):
    """Role initials an audit leaves; None where an edit does not fit."""
    out, rows = [], iter(symbols)
    for edit in audit:
        row = "" if edit == "I" else next(rows)
        if edit == "D":
            continue
        out.append(row.lower() if edit == "K" else "a" if out and out[-1] == "u" else "u")
    return "".join(out)


def cost_of(symbols, audit):
    total, rows = 0, iter(symbols)
    for edit in audit:
        if edit == "I":
            total += 5
            continue
        row = next(rows)
        total += {"K": 0, "R": 1, "D": 2}[edit] + (5 if edit != "D" and row.isupper() else 0)
    return total


def by_enumeration(symbols):
    best = None
    gaps = itertools.product(range(3), repeat=len(symbols) + 1)
    inserts = [g for g in gaps if sum(g) <= 3]
    for edits in itertools.product(*map(allowed, symbols)):
        for g in inserts:
            audit = "".join("I" * k + e for k, e in zip(g, (*edits, ""), strict=True))
            if re.fullmatch("(s?(ua)+)?", roles_of(symbols, audit)):
                candidate = (cost_of(symbols, audit), audit)
                best = candidate if best is None else min(best, candidate)
    return best


def by_suffixes(symbols):
    """Cheapest completions from the end on: whole strings are compared."""
    n, rest = len(symbols), {}
    for k in range(n, -1, -1):
        for inserts in range(3, -1, -1):
            for last in ("", "s", "u", "a"):
                turn = "a" if last == "u" else "u"
                options = [(0, "", (0, ""))] if k == n and last in ("", "a") else []
                if inserts < 3:
                    options.append((5, "I", rest[k, turn, inserts + 1]))
                if k < n:
                    row, more = symbols[k], 5 if symbols[k].isupper() else 0
                    options.append((2, "D", rest[k + 1, last, 0]))
                    if row != "d":
                        options.append((1 + more, "R", rest[k + 1, turn, 0]))
                        if row.lower() == turn or row.lower() == "s" and last == "":
                            options.append((more, "K", rest[k + 1, row.lower(), 0]))
                rest[k, last, inserts] = min(((c + r[0], e + r[1]) for c, e, r in options if r), default=None)
    return rest[0, "", 0]


PLAIN = conversations.Repairer(())
SHARED = conversations.Repairer(("ua", "一一", "dd", "su", "丁一", "AU", "ao"))


@pytest.mark.parametrize("repairer", [PLAIN, SHARED])
def test_cheapest_edits(repairer):
    for n in range(4):
        for symbols in map("".join, itertools.product("dsuaoSUAO", repeat=n)):
            want = by_suffixes(symbols)
            assert repairer.repair(symbols) == want, symbols
            if n < 3:
                assert by_enumeration(symbols) == want
    for symbols in ("uauasuauua", "Uaddu", "ooouaAUaSsu" * 3, "suauauauauau", "aaaaauuuuu", "saUAuaua" * 5):
        assert repairer.repair(symbols) == by_suffixes(symbols)


def damaged(rows):
    """Rows per conversation after damage, in order."""
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
        out[conv_id] += [(turn is not None, turn or 0, digest, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: [r[3:] for r in sorted(v, key=lambda r: r[:3])] for k, v in out.items()}


def report(rows):
    """What the query returns for one conversation."""
    seen, symbols, counts = set(), "", defaultdict(int)
    for _, role, text in rows:
        visible = re.sub(BLANK, "", text)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not visible:
            counts["blank"] += 1
            symbols += "d"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            symbols += "d"
        elif visible[-1] not in ".!?":
            counts["truncated"] += 1
            symbols += initial.upper()
        else:
            symbols += initial
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = by_suffixes(symbols)
    lines, last, left = [], "", iter(rows)
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        last = role[0] if edit == "K" else "a" if last == "u" else "u"
        lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(spark, rows, table=None):
    table = spark.createDataFrame(rows, SCHEMA) if table is None else table
    got = conversations.repair_report(conversations.damage(table))
    assert [t for c, t in got.dtypes if c not in ("audit", "repaired_sha256")] == ["bigint"] * 7
    want = sorted(((k, *report(v)) for k, v in damaged(rows).items()), key=repr)
    assert found(got.select(*COLUMNS)) == want


def test_query_over_the_whole_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op11_conversation_repair"](spark, SF)
    want = sorted(((k, *report(v)) for k, v in damaged(rows).items()), key=repr)
    assert found(got.select(*COLUMNS)) == want
    assert len({r[7] for r in want}) > 10


AWKWARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 2, "assistant", "So."), (1, 5, "user", None),
    (1, None, "user", "When?"), (1, None, None, "x"), (1, 7, "tool", "\t\r\n "), (1, 8, "", "Cut off"), (1, 9, "User", "Yes!\x0b "),
    (None, 1, "user", "No id."), (None, None, "assistant", "None either."), (2, 3, "usr", "A. "), (2, 3, "assistant", "B."),
    (2, 3, "assistant", "C."), (2, -4, "system", "late."), (3, None, None, None), (4, 1, "assistant", "word " * 50_000 + "."),
    *((5, t, "user" if t % 2 else "assistant", f"{t % 3}.") for t in range(60)), *((6, 1, "user", "Again."),) * 40,
]


def test_awkward_rows(spark):
    check(spark, AWKWARD)
    check(spark, AWKWARD[::-1])
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair_report(conversations.damage(empty)).count() == 0
    clashing = spark.createDataFrame(AWKWARD, SCHEMA)
    names = ("times", "content", "initial", "blank", "part", "piece", "symbols", "audit", "kind", "place", "edit", "conv", "n", "cost")
    check(spark, AWKWARD, clashing.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)]))


def test_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "FRAGMENT_ROWS", 16)
    rows = [(k % 3 and k, k, ("user", "assistant", "system")[k * k % 7 % 3], f"{k % 40}" + ".?! "[k % 4]) for k in range(1500)]
    check(spark, rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Cut"), (1, 2, "assistant", "Yes."), (2, 0, "user", "Only me.")]
    table = spark.createDataFrame(rows, SCHEMA)
    edits = conversations.repairs(table)
    assert found(edits.select("conv_id", "cost", "audit")) == [(1, *by_suffixes("aUa")), (2, *by_suffixes("u"))]
    lines = conversations.repaired(table, edits).collect()
    for conv_id in (1, 2):
        own = sorted((r for r in lines if r["conv_id"] == conv_id), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))


def test_grammar_counts_all_conversations(spark):
    rows = [("uauaua", 10), ("suaua", 5), ("ddddd", 3), ("o", 100)]
    grammar = conversations.learn_grammar(spark.createDataFrame(rows, "symbols string, n long"))
    assert grammar.pairs[0] == "ua"
    for text, _ in rows:
        spelt = grammar.compressed(text)
        for k in reversed(range(len(grammar.pairs))):
            spelt = spelt.replace(grammar.symbol(k), grammar.pairs[k])
        assert spelt == text
    assert len(grammar.compressed("uauaua")) <= 2
