"""Conversation repair against the enumeration of all edits."""

import binascii
import hashlib
import random
import re

import pytest

from vectrail.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, symbol string, audit string"
LINES = ["Yes.", "No", "", " \t", "Really?  ", "Well!\n", "Go on.", "é"]


def all_repairs(symbols):
    """Every audit and its cost, with at most two insertions in a row; more never pay."""
    found = []

    def go(k, before, cost, audit, inserted):
        if k == len(symbols) and before in ("", "a"):
            found.append((cost, audit))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[before]
        turn = allowed[-1]
        if inserted < 2:
            go(k, turn, cost + 3, audit + "I", inserted + 1)
        if k < len(symbols):
            go(k + 1, before, cost + 4, audit + "D", 0)
            initial, extra = symbols[k].lower(), 3 * symbols[k].isupper()
            if symbols[k] != "D":
                go(k + 1, turn, cost + 3 + extra, audit + "R", 0)
                if initial in allowed:
                    go(k + 1, initial, cost + extra, audit + "K", 0)

    go(0, "", 0, "", 0)
    return min(found)


def plain(rows):
    """Damage, faults and repair of each conversation without Spark."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            name = ":".join(" " if x is None else str(x) for x in (conv, turn))
            fate = binascii.crc32(name.encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
            kept += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in kept:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = ""
            if not solid:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif solid[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = {t for t, *_ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = all_repairs(symbols)
        lines, at, said = [], 0, 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else ("user", "assistant")[said % 2]
                said += role[:1] != "s"
                lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, sha)
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    return {r["conv_id"]: tuple(r)[1:] for r in tr.repair_conversations(tr.damage(df)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_enumeration(spark, seed, monkeypatch):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "admin", "tool", "", None]
    rows = [
        (conv, draw.choice([None, -3, 0, 1, 2, 3, 9]), draw.choice(roles), draw.choice([*LINES, None]))
        for conv in [None, *range(40), 1 << 60]
        for _ in range(draw.randint(1, 6))
    ]
    rows += rows[:20]
    assert repaired(spark, rows) == plain(rows)


def test_pieces_join_to_the_same_repair(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(7, i // 2, draw.choice(["user", "assistant"]), draw.choice(LINES)) for i in range(400)]
    rows += [(8, None, "user", "Same.")] * 300
    whole = repaired(spark, rows)

    def short(batches):
        import vectrail.llm.turn_repair as module

        # The tasks import the module anew, so shorter pieces must be set there.
        module.PIECE, usual = 3, module.PIECE
        try:
            yield from module._cut_pieces(batches)
        finally:
            module.PIECE = usual

    monkeypatch.setattr(tr, "_cut_pieces", short)
    assert repaired(spark, rows) == whole
    copies = whole[8]
    assert copies[2] in (299, 599) and copies[4] == copies[2] and copies[6].count("D") == copies[2]


def test_compressed_sequences_equal_the_plain_product():
    draw = random.Random(3)
    sequences = ["".join(draw.choices(tr.SYMBOLS, k=draw.randint(1, 60))) for _ in range(60)]
    sequences += ["ua" * 500, "D" * 333, "u" * 64, "", "s"]
    matrices = [tr.symbol_matrix(s) for s in tr.SYMBOLS]
    for sequence, matrix in zip(sequences, tr.solve(sequences)):
        row = tr.INSERTIONS[tr.START]
        for symbol in sequence:
            row = tr._times(row, matrices[tr.SYMBOLS.index(symbol)])
        assert tr.finish(tr._times(tr.INSERTIONS[tr.START], matrix)) == tr.finish(row)


def test_rules_spell_their_sequences():
    sequences = ["uauauaua", "uaua", "DDDDD", "sua", ""]
    rules, left = tr.compress(sequences)
    spelled = list(tr.SYMBOLS)
    for a, b in rules:
        spelled.append(spelled[a] + spelled[b])
    assert ["".join(spelled[s] for s in symbols) for symbols in left] == sequences
    assert rules and len(left[0]) < 8


def test_ropes_compare_like_their_strings():
    draw = random.Random(9)
    texts, ropes = [], []
    for _ in range(60):
        text, rope = "", tr.Rope()
        for _ in range(draw.randint(0, 12)):
            part = draw.choice(["K" * 40, "D", "KI", "R" * 33, ""])
            text, rope = text + part, rope + tr.Rope(part)
        texts.append(text)
        ropes.append(rope)
    for s, a in zip(texts, ropes):
        assert str(a) == s
        for t, b in zip(texts, ropes):
            assert (a < b) == (s < t)


def test_no_rows_and_a_dropped_conversation(spark):
    assert repaired(spark, []) == {}
    dropped = next(i for i in range(1000) if binascii.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert repaired(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_a_long_text_and_a_hot_conversation(spark):
    rows = [(1, 0, "user", "x" * 5_000_000), (1, 1, "assistant", "Done.")]
    rows += [(2, i, ("user", "assistant")[i % 2], f"Line {i}.") for i in range(6000)]
    found = repaired(spark, rows)
    assert len(found) == 2 and len(found[2][6]) > 5500
