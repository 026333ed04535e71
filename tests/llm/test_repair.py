"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from sluice.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, present2 string, seen int, piece string, i double"
END = re.compile(r"[^\x20\x09-\x0D]")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)


def could_go_on(roles):
    return re.fullmatch(r"(s?(ua)*u?)?", roles)


def search(rows):
    """rows: (role, text, fault). The cheapest edits, ASCII-least among equal ones, by trying them in that order."""
    heap, tick = [(0, "", 0, 0, "", ())], 0
    while heap:
        cost, audit, _, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        steps = []
        if not audit.endswith("III"):
            steps += [(3, "I", at, r[0], (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            steps.append((4, "D", at + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps.append((more, "K", at + 1, role[:1] or "?", (role, text)))
                steps += [(3 + more, "R", at + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for c, e, to, r, o in steps:
            if could_go_on(roles + r):
                tick += 1
                heapq.heappush(heap, (cost + c, audit + e, tick, to, roles + r, out + ((o,) if o else ())))


def plain(rows, damage=True):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept = by.setdefault(conv, [])
        kept.extend([] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in kept:
            chars = END.findall(text)
            faulty.append((role, text, "blank" if not chars else "duplicate" if (role, text) in seen else "" if chars[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        faults = [f for *_, f in faulty]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, text = search(faulty)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(spark, rows, damage=True):
    turns = frame(spark, rows)
    got = repair.repair(repair.damaged(turns), repair.F.col("present")) if damage else repair.repair(turns)
    found = {r[0]: tuple(r)[1:] for r in got.collect()}
    want = plain(rows, damage)
    assert found == want
    return found


def made(seed, conversations=60, most=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "u", "apprentice"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "why?", "open", "open end", " ", "", None, "a. \n", "b ", "　", "Same."])
            rows.append((conv if conv else None, rng.choice([turn, turn * 2, None, 3]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    check(spark, made(seed), damage=seed > 0)


@pytest.mark.parametrize("size", [1, 3])
def test_conversations_cut_by_batches(spark, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        check(spark, made(11, 40))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_one_long_conversation(spark):
    """Its middle is whole and costs nothing; ends and a repeated row do."""
    rows = [(5, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3001)] + [(5, 3001, "user", "Turn 0.")]
    (row,) = repair.repair(frame(spark, rows)).collect()
    assert (row["cost"], row["duplicate"], row["audit"]) == (7, 1, "K" * 3001 + "DI")
    assert row["repaired_sha256"] == hashlib.sha256("\n".join([*(f"{r}:{t}" for _, _, r, t in rows[:-1]), "assistant:"]).encode()).hexdigest()


def test_odd_tables(spark):
    assert repair.repair(repair.damaged(frame(spark, [])), repair.F.col("present")).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    got = check(spark, [(77, dropped, "user", "Hello.")])
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    check(spark, [(1, None, None, None), (1, None, None, None), (None, None, "user", "Hi."), (2, 5, "user", "Hi. é!"), (2, -3, "assistant", "x" * 100000)])


def test_query_and_sql(spark, tmp_path):
    import duckdb

    frame(spark, made(21) + made(22)).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_conversation_repair"])
    names = [d[0] for d in want.description]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
