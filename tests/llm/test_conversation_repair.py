import hashlib
import itertools
import random
import zlib

from millrace.llm import conversation_repair as op

SPACE = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string, fault int, hash string, cost int, earlier int, dropped int"


def cheapest(rows, doomed, cut):
    """(cost, audit) by a memoised recursion over all edits."""
    follow, memo = {"": "su", "s": "u", "u": "a", "a": "u"}, {}

    def best(i, state, inserts):
        if (i, state, inserts) not in memo:
            ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
            if inserts < 3:
                cost, audit = best(i, "a" if state == "u" else "u", inserts + 1)
                ways.append((cost + 5, "I" + audit))
            if i < len(rows):
                cost, audit = best(i + 1, state, 0)
                ways.append((cost + 2, "D" + audit))
                for role, letter, price in [(rows[i][:1], "K", 0), ("u", "R", 1), ("a", "R", 1)]:
                    if not doomed[i] and role and role in follow[state]:
                        cost, audit = best(i + 1, role, 0)
                        ways.append((cost + price + 5 * cut[i], letter + audit))
            memo[i, state, inserts] = min(ways, default=(10 ** 9, ""))
        return memo[i, state, inserts]

    for i, state in itertools.product(range(len(rows), -1, -1), follow):  # from the end, so that calls stay shallow
        best(i, state, 0)
    return best(0, "", 0)


def brute(table):
    damaged = {}
    for conv, turn, role, text in table:
        rows = damaged.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            plain = text.strip(SPACE)
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen
                          else "truncated" if plain[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = cheapest([r[1] for r in rows], [f in ("blank", "duplicate") for f in faults],
                               [f == "truncated" for f in faults])
        repaired, left, state = [], iter(rows), ""
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            state = row[1][0] if letter == "K" else "a" if state == "u" else "u"
            role = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[state]
            repaired.append(f"{role}:{'' if row is None else row[2]}")
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted(map(tuple, op.repair(op.damaged(frame), **options).collect()), key=str)


def test_matches_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert run(table) == brute(map(tuple, table.collect()))


def test_odd_conversations(spark):
    """Nulls everywhere, odd roles, repeated turns, rows of one conversation beyond a segment, clashing columns."""
    rng = random.Random(4)
    roles = ["user", "user", "assistant", "assistant", "system", "", None, "tool", "ulysses", "Àb"]
    texts = ["Yes.", "No?", "cut off", "", " \t", None, "…", "Straße!  ", "end.\x85", "x" * 50_000 + "."]
    rows = [(rng.choice([*range(40), None]), rng.choice([None, 0, 1, 2, 3, 4, 7, -3]), rng.choice(roles), rng.choice(texts))
            for _ in range(500)]
    rows += [(99, i, rng.choice(roles[:5]), f"turn {i}{rng.choice(['.', ''])}") for i in range(400)]
    rows += [(100, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)]
    frame = spark.createDataFrame([(*r, 1, "a", 2, 3, 4) for r in rows], KIND)
    want = brute(rows)
    assert run(frame) == want
    assert run(frame, segment=3, partitions=3) == want
    assert run(frame.limit(0)) == []


def test_conversation_of_dropped_rows_is_named(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert run(frame) == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_proves_the_optimum():
    """Random role sequences, in one run and in pieces, against the recursion."""
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randrange(14)
        turns = [op.Turn(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), f"t{i}",
                         rng.random() < 0.2, False) for i in range(n)]
        for turn in turns:
            turn.truncated = not turn.doomed and rng.random() < 0.2
        want = cheapest([t.role for t in turns], [t.doomed for t in turns], [t.truncated for t in turns])
        for segment in (1, 3, 64):
            case = op.Conversation(1, segment)
            for t in turns:
                case.add(0, t.role, t.text, "blank" if t.doomed else "truncated" if t.truncated else None)
            got = case.result()
            assert (got["cost"], got["audit"]) == want


def test_one_exchange(spark, sf_dir):
    plan = op.repair(op.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))._jdf.queryExecution(
        ).executedPlan().toString()
    assert plan.count("Exchange") == 1
