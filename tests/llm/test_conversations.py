"""Conversation repair against a plain search over whole audits, for all layouts of rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair as repair
from quillspark.llm import queries
from quillspark.llm.common import table

from ..oracle import connect

LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """(audit, repaired): least (cost, audit) for each state after each row, with whole strings."""
    best = {"": (0, "", ())}  # what has been read: nothing, s, u or a
    found = faults(rows)
    for k in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for q, (cost, audit, turns) in list(best.items()):
                new = "a" if q == "u" else "u"
                way = (cost + 2, audit + "I", (*turns, ("user" if new == "u" else "assistant", "")))
                best[new] = min(best.get(new, way), way)
        if k == len(rows):
            break
        _, role, text = rows[k]
        after = {}

        def offer(q, way, after=after):
            after[q] = min(after.get(q, way), way)

        for q, (cost, audit, turns) in best.items():
            offer(q, (cost + 3, audit + "D", turns))
            if found[k] in "t":
                more, new = int(found[k] == "t"), "a" if q == "u" else "u"
                offer(new, (cost + 2 + more, audit + "R", (*turns, ("user" if new == "u" else "assistant", text))))
                if role[:1] == new or role[:1] == "s" and q == "":
                    offer(role[:1], (cost + more, audit + "K", (*turns, (role, text))))
        best = after
    return min(best[q] for q in ("", "a") if q in best)


def expected(rows):
    """The report of one conversation's rows (turn, role, text), in order."""
    cost, audit, turns = plain(rows)
    known, found = [r[0] for r in rows if r[0] is not None], faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in turns))
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        found.count("b"), found.count("d"), found.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    )


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))


def invented(rng, n, length):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "under"]
    texts = ["Yes.", "No", "", " \t", "Why?", "so.. ", "Well!\n", "a", "b.", "c.", "d", "é中."]
    out = []
    for c in range(n):
        conv = [(rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(rng.random()) + "."])) for _ in range(rng.randint(0, length))]
        out += [(c if c else None, *r) for r in conv]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def by_conversation(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, r if r is not None else " ", x if x is not None else " "))
    return {c: expected(in_order(g)) for c, g in groups.items()}


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_nodes_fold_to_the_same_audits():
    rng = random.Random(4)
    for _ in range(300):
        rows = in_order([r[1:] for r in invented(rng, 1, 14)])
        kinds = [{"": 0, "b": 1, "d": 2, "t": 3}[f] for f in faults(rows)]
        own = [(*r, k) for r, k in zip(rows, kinds, strict=True)]
        nodes = repair.nodes_of(own)
        end = repair.last_state(repair.run_forward(nodes, 0, len(nodes), 0)[1])
        audit, turns = repair.replay(own, 0, repair.crossings(nodes, 0, end))
        more, added = repair.tail_of(end)
        cost, want, out = plain(rows)
        assert (audit + more, turns + added) == (want, list(out))
        assert repair.audit_cost(audit, repair.kept_truncated(own, audit)) + 2 * len(more) == cost
        cut = rng.randint(0, len(rows))
        both = repair.fold([repair.fold(nodes[:cut]) if cut else repair.NOTHING, repair.fold(nodes[cut:]) if cut < len(rows) else repair.NOTHING])
        assert not nodes or both == repair.fold(nodes)


@pytest.mark.parametrize("block,parts", [(4096, 1), (4096, 9), (3, 5), (1, 2)])
def test_reports_and_turns(spark, block, parts):
    rng = random.Random(block + parts)
    rows = invented(rng, 25, 9) + [(77, i, rng.choice(["user", "assistant"]), f"{i % 50} x.") for i in range(150)] + [(78, 5, "user", "same.")] * 60 + [(79, None, None, None)]
    rows = [(c, *r) for c, *r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"at": F.lit("x"), "key": F.lit(1), "audit": F.lit("y"), "conv": F.lit(2)})
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        want = by_conversation(rows)
        report = repair.repair_reports(df, block=block)
        assert report.count() == len(want) and got(report) == want
        turns = {}
        for r in sorted(repair.repaired_turns(df, block=block).collect(), key=lambda r: (r.block, r.place)):
            turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_rows_and_dropped_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_reports(none).count() == repair.repaired_turns(none).count() == 0
    d = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "b.")], SCHEMA)
    out = got(repair.repair_reports(d, alive=F.col("conv_id") == 2))
    assert out[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and out[2][-2] == "KI"


def test_long_texts_and_ids_of_any_kind(spark):
    d = spark.createDataFrame([("x", 0, "user", "a " * 500_000 + "."), ("x", 1, "assistant", "a " * 500_000)], "conv_id string, turn int, role string, text string")
    assert got(repair.repair_reports(d))["x"][:-1] == (0, 0, 0, 1, 0, 1, "KK")


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        own = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        own += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: expected(in_order(g)) for c, g in out.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_plain_search(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, folder)) == damage(rows)


def test_sql_equals_plain_search():
    """On the given rows, and on invented ones with nulls, ties and odd roles."""
    con = connect("/root/testdata/sf0.01")
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    sql = repair.oracle()
    assert {r[0]: r[1:] for r in con.execute(sql).fetchall()} == damage(rows)
    rng = random.Random(11)
    rows = [(None if c == 3 else c, t, None if rng.random() < 0.05 else r, None if rng.random() < 0.05 else x) for c, t, r, x in invented(rng, 60, 9)]
    own = duckdb.connect()
    own.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    own.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in own.execute(sql).fetchall()} == damage(rows)


def test_damage_of_nulls(spark):
    rows = [(None, None, None, None), (None, 3, "user", None), (4, None, None, "x."), (4, 7, "user", "y.")]
    rows += [(c, t, "user", "Hm. Yes!") for c in range(30) for t in range(4)]
    df = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    assert got(repair.repair_reports(df, alive=F.col("alive"))) == damage(rows)
