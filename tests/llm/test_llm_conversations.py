"""Operator 11 against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from careflow.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, id long, found string, letters string, same string, has boolean, hit int"
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
EMPTY = hashlib.sha256().hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", "x", True, 7) for r in rows], SCHEMA)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        role = "user" if hit == 4 else role
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out


def in_order(rows):
    same = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, same(r)))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by recursion over every edit at every place; the initials are checked by the pattern itself."""

    @functools.cache
    def best(i, initials, inserts):
        options = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                options.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            edits = [("D", 2, None)]
            if found[i] not in ("blank", "duplicate"):
                extra = 5 if found[i] == "truncated" else 0
                edits += [("K", extra, (role, text)), *(("R", 1 + extra, (r, text)) for r in ("user", "assistant"))]
            for letter, cost, line in edits:
                after = initials + (line[0][:1] or " ") if line else initials
                if re.fullmatch("s?(ua)*u?", after):
                    # what matters from here on is the last initial and whether there is one
                    options.append((letter, cost, line, best(i + 1, after[-1:] if after[-1:] != "a" else "ua", 0)))
            options = [(c + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]) for letter, c, line, rest in options if rest]
        if inserts < 3:
            for r in ("user", "assistant"):
                after = initials + r[0]
                if re.fullmatch("s?(ua)*u?", after) and (rest := best(i, after[-1:] if after[-1:] != "a" else "ua", inserts + 1)):
                    options.append((5 + rest[0], "I" + rest[1], ((r, ""), *rest[2])))
        return min(options, key=lambda o: o[:2]) if options else None

    return best(0, "", 0)


def plain(rows, damaged):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = in_order([r for r in damaged if r[0] == conv])
        found = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, found)
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(seed, convs, longest=9):
    rnd = random.Random(seed)
    texts = ["Hi.", "Yes!", "No?", "so it goes", "", " \t\n", "wait.\n", "ends with mark ?  ", " ", None, "Hi.", "line\nbreak."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "System", "useful", "\U0001f600"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randrange(longest + 1)):
            rows.append((conv, rnd.choice([turn, turn, turn, 2 * turn, turn // 2, None]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_equal_the_plain_search(spark, seed):
    rows = random_rows(seed, 60)
    given = conversations(spark, rows)
    got = {r[0]: tuple(r) for r in cr.digests(given).collect()}
    undamaged = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == plain(rows, undamaged)
    hurt = cr.damage(given)
    assert sorted(map(repr, (tuple(r) for r in hurt.collect()))) == sorted(map(repr, plain_damage(rows)))
    after = {r[0]: tuple(r) for r in cr.digests(hurt).collect()}
    assert after == {c: r for c, r in plain(rows, plain_damage(rows)).items() if c in {d[0] for d in plain_damage(rows)}}


def test_query_returns_every_conversation(spark, tmp_path):
    rows = random_rows(5, 80) + [(1000 + i, 0, "user", "Only turn.") for i in range(60)] + [(1000, 0, "user", "Only turn.")] * 3
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = cr.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == COLS
    want = plain(rows, plain_damage(rows))
    assert {r[0]: tuple(r) for r in got.collect()} == want
    gone = [r for r in want.values() if r[1:8] == (0, 0, 0, 0, 0, 0, "") and r[8] == EMPTY]
    assert gone  # some of the one-turn conversations lose it


def test_worked_example_and_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "user", "Are you there?"), (1, 2, "user", "Are you there?"),
            (1, 4, "assistant", "Yes and"), (1, 5, "assistant", "Yes."), (1, 6, "user", " ")]
    d = cr.digests(conversations(spark, rows)).first()
    # one question goes (the first: D is before K), the copy, the torn answer (cheaper than keeping it) and the blank
    assert tuple(d)[1:8] == (1, 1, 1, 1, 3, 8, "KDKDDKD")
    lines = cr.repaired(conversations(spark, rows)).orderBy("position").collect()
    assert [tuple(r)[1:] for r in lines] == [(0, "K", "system", "Be kind."), (1, "K", "user", "Are you there?"), (2, "K", "assistant", "Yes.")]
    one = cr.repaired(conversations(spark, [(2, 0, "user", "Hello?")])).collect()
    assert one == []  # deleting costs 2, an answer 5
    kept = cr.repaired(conversations(spark, [(3, i, "assistant", f"{i}.") for i in range(4)])).orderBy("position").collect()
    assert [(r["edit"], r["role"]) for r in kept] == [("R", "user"), ("K", "assistant"), ("R", "user"), ("K", "assistant")]


def test_nodes_are_shared_by_common_ends(monkeypatch):
    met = []
    before = cr.Nodes.before
    monkeypatch.setattr(cr.Nodes, "before", lambda self, letter, after: met.append(letter) or before(self, letter, after))
    signatures = sorted(s[::-1] for s in ["aei" * 50, "eaei" + "aei" * 49, "ei" + "aei" * 49, "aei" * 50])
    found = list(cr.suffix_audits(iter(signatures)))
    assert len(met) < 160 and len(found) == 4  # not four times 150 nodes


def test_one_long_conversation_is_cut_and_joined(spark):
    """All turns in one conversation: parts of many tasks, duplicates far apart, turns on both sides of a border."""
    rows = [(9, i // 2, "user" if i % 2 else "assistant", f"t{i % 1500}{'.' if i % 7 else ''}") for i in range(4000)]
    turns = cr._turns(conversations(spark, rows), "conv_id", "turn", "role", "text")
    got = cr.signatures(turns).first()
    mine = in_order(rows)
    letters = "".join("ei"[r[2] == "assistant"] if f == "" else "fj"[r[2] == "assistant"] if f == "truncated" else "hl"[r[2] == "assistant"] for r, f in zip(mine, faults(mine)))
    assert (got["signature"], got["gaps"]) == (letters, 0)


def test_empty_and_very_long(spark):
    assert cr.digests(conversations(spark, [])).count() == 0
    long = "word " * 400_000
    got = cr.digests(conversations(spark, [(1, 0, "user", long + "."), (1, 1, "assistant", long)])).first()
    assert got["audit"] == "DD" and got["truncated"] == 1
