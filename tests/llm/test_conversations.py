"""Conversation repair against an enumeration of all edits, and against plain Python over the whole table."""

import random
import re
from functools import cache
from hashlib import sha256
from zlib import crc32

from tessera.llm import conversations as C

NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def fits(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def cheapest(rows):
    """Least (cost, edits) and the lines, over all edits with a full search from every prefix (memory by place and what the grammar needs)."""

    @cache
    def best(i, before):
        # before: the initials so far, cut to what decides how they may go on
        out = []
        if i == len(rows) and fits(before):
            out.append((0, "", ()))
        for a in "ua":
            if len(before) < 40 and open_(before + a) and extra_ok(before + a):
                c, e, lines = best_after_insert(i, before + a)
                out.append((c + 2, "I" + e, ((f"{NAMES[a]}:"), *lines)))
        if i < len(rows):
            role, text, must, cut = rows[i]
            c, e, lines = best(i + 1, short(before))
            out.append((c + 3, "D" + e, lines))
            if not must:
                for letter, r, price in [("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)]:
                    if r and open_(before + r[0]):
                        c, e, lines = best(i + 1, short(before + r[0]))
                        out.append((c + price + cut, letter + e, (f"{r}:{text}", *lines)))
        return min(out) if out else (10**9, "", ())

    def best_after_insert(i, before):
        return best(i, short(before, inserted=True))

    def short(initials, inserted=False):
        # two pairs say as much as one; a mark counts inserts in a row
        head = initials.rstrip("+")
        marks = initials.count("+") + 1 if inserted else 0
        head = head.replace("+", "")
        head = re.sub("(ua)+$", "ua", head)
        head = re.sub("(ua)+u$", "uau", head)
        return head + "+" * marks

    def open_(initials):
        plain = initials.replace("+", "")
        return any(fits(plain + more) for more in ("", "a", "ua"))

    def extra_ok(initials):
        return initials.count("+") < 4

    def fits(initials):
        return re.fullmatch("(s?(ua)+)?", initials.replace("+", "")) is not None

    return best(0, "")


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, work, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in mine:
            left = re.sub("[ \t-\r]", "", text)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            work.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit, lines = cheapest(work)
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        firsts = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \t\n", "Why? ", "a.b", "Oh!\n", None, f"t{turn}.", f"t{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + rng.randint(0, 3), None]), role, text))
    return rows


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def test_repair_is_the_cheapest_and_least(spark):
    rows = random_rows(1, 150, 7)
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA))) == expected(plain(rows))


def test_blocks_of_long_conversations_agree(spark):
    rows = random_rows(2, 4, 60) + [(9, k % 5, "user", "same.") for k in range(90)] + [(None, k, "assistant", f"{k}.") for k in range(30)]
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA), block=4)) == expected(plain(rows))


def test_pieces_of_long_texts(spark, monkeypatch):
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k} " * 50 + ".") for k in range(40)]
    want = expected(rows)
    monkeypatch.setattr(C, "PIECE_BYTES", 500)
    assert got(C.repair(spark.createDataFrame(rows, SCHEMA), block=16)) == want
    assert want[1][:6] == (0, 0, 0, 0, 0, 0)


def test_known_repairs(spark):
    said = lambda *turns: [(1, k, *t) for k, t in enumerate(turns)]
    one = lambda rows: got(C.repair(spark.createDataFrame(rows, SCHEMA)))[1]
    assert one(said(("user", "Hi."), ("assistant", "Yes.")))[5:7] == (0, "KK")
    assert one(said(("user", "Hi."), ("user", "More."), ("assistant", "Yes.")))[5:7] == (2, "KIKK")
    assert one(said(("system", "Be."),))[5:7] == (3, "D")
    assert one(said(("assistant", "Yes."),))[5:7] == (2, "IK")
    assert one([(1, None, "user", "Hi."), (1, 5, "assistant", "x"), (1, 9, "user", "")])[:7] == (3, 1, 0, 1, 0, 4, "KKD")


def test_empty_tables_and_clashing_columns(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "Hi.", 7, "x"), (1, 1, "assistant", "Yes.", 8, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", block long, initial string")
    assert got(C.repair(df))[1][6] == "KK"


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(damaged(rows))
    none = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert got(C.query(spark, sf)) == {c: want.get(c, none) for c in {r[0] for r in rows}}
