"""Operator 12: the cheapest repair of conversations to a legal order of roles, by Hirschberg's divide and conquer.

Legal are role initials `(s?(ua)+)?`. Reading them has four states: nothing yet, after s, after u, after a. Rows are kept (0), given the role that the
state asks for (2), or deleted (3, a must for blank rows and repeats); a row with that role and no text is inserted for 2; a truncated row that isn't deleted costs 1 more. As
each letter of an audit leads from a state to one state, an audit alone says what comes out.

A row is a table of four by four costs, each with the order of its audits among those that begin in the same state; so is a run of rows. A run is solved in linear space:
cost vectors go forward from its start to the middle and backward from its end, the states where they meet at least cost are the crossings, and the one with the ASCII-least
audit on the left is taken (audits end with a row's letter there, so none is the beginning of another); then each half is solved between known states.

Rows are sorted by ranges of (conversation, turn, role, text). A conversation that lies inside one range and has at most `block` rows is solved where it lies. Others (two at most for
each range, and long ones) are cut in blocks of `block` rows: a block is folded into one such table, the tables of a range into one more, and crossings are chosen from
the top down: between ranges, between a range's blocks, then inside all blocks side by side. So one conversation may hold any share of the rows. Only its SHA-256, which
can't be cut, and its audit, one letter a row, are put together by one task, which streams the blocks' texts.

Defined cases: rows stand in order of turn, nulls first; of one turn, by role, then the first 64 code points of the text, then a hash of it, so the order never depends on the layout of files.
A null role or text is one space (so such a text is blank). Repeated rows are repeats of the first. A null conversation id is a conversation. Rows whose `alive` is
false only name their conversation. A conversation without other rows has zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, give_back, join_by_size, materialise

BLANKS = " \t\n\x0b\x0c\r"
NO = 1 << 40  # the cost of what can't be
#: The state after a row that the state itself asks for: u from nothing, s and a; a from u.
ASKED = (2, 2, 3, 2)
#: What the end of a conversation costs in a state, in inserts.
TAIL = (0, 2, 1, 0)
NAMES = {2: "user", 3: "assistant"}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
#: Faults of a row; the first that applies counts.
FINE, BLANK, REPEAT, TRUNCATED = range(4)

Node = tuple  # (costs, orders), each 4 x 4


@cache
def moves(initial: str, fault: int) -> list[dict[int, tuple[int, str]]]:
    """For each state: end state -> (cost, audit) of the best way to take one row, inserts first."""
    out = []
    for start in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = start
        for k in range(3):
            ways = [(3, "D", state)]
            if fault not in (BLANK, REPEAT):
                more = fault == TRUNCATED
                ways.append((2 + more, "R", ASKED[state]))
                if initial in "ua" and initial and NAMES[ASKED[state]][0] == initial:
                    ways.append((0 + more, "K", ASKED[state]))
                if initial == "s" and state == 0:
                    ways.append((0 + more, "K", 1))
            for cost, letter, end in ways:
                way = (cost + 2 * k, "I" * k + letter)
                best[end] = min(best.get(end, way), way)
            state = ASKED[state]
        out.append(best)
    return out


@cache
def row_node(initial: str, fault: int) -> Node:
    costs, orders = [], []
    for best in moves(initial, fault):
        ranked = sorted(best, key=lambda q: best[q][1])
        costs.append(tuple(best[q][0] if q in best else NO for q in range(4)))
        orders.append(tuple(ranked.index(q) if q in best else 9 for q in range(4)))
    return tuple(costs), tuple(orders)


NOTHING: Node = (tuple(tuple(0 if q == p else NO for q in range(4)) for p in range(4)), tuple(tuple(0 if q == p else 9 for q in range(4)) for p in range(4)))
Vector = tuple  # (costs, orders) of the four states


def forward(v: Vector, node: Node) -> tuple[int, Vector]:
    """One node further: the least cost, and the vector less it."""
    ways = []
    for q in range(4):
        best = min((v[0][p] + node[0][p][q], v[1][p], node[1][p][q]) for p in range(4))
        ways.append(best if best[0] < NO else (NO, 9, 9))
    least = min(w[0] for w in ways)
    ranked = sorted({w[1:] for w in ways if w[0] < NO})
    return least, (tuple(w[0] - least if w[0] < NO else NO for w in ways), tuple(ranked.index(w[1:]) if w[0] < NO else 9 for w in ways))


def backward(v: tuple, node: Node) -> tuple:
    out = [min(node[0][p][q] + v[q] for q in range(4)) for p in range(4)]
    least = min(out)
    return tuple(c - least if c < NO else NO for c in out)


class Steps(dict):
    """Remembered steps. Vectors less their least cost are few, and so are the kinds of rows."""

    limit = 200_000

    def __init__(self, step):
        self.step = step

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        out = self[key] = self.step(*key)
        return out


FORWARD, BACKWARD = Steps(forward), Steps(backward)


def at_state(q: int) -> Vector:
    return tuple(0 if p == q else NO for p in range(4)), tuple(0 if p == q else 9 for p in range(4))


def run_forward(nodes: list[Node], lo: int, hi: int, start: int) -> tuple[int, Vector]:
    total, v = 0, at_state(start)
    for i in range(lo, hi):
        more, v = FORWARD[v, nodes[i]]
        total += more
    return total, v


def last_state(v: Vector) -> int:
    """The state in which the least audit of least cost ends, before the inserts that the end asks for."""
    return min(range(4), key=lambda q: (v[0][q] + 2 * TAIL[q], v[1][q]))


def crossings(nodes: list[Node], start: int, end: int) -> list[int]:
    """The state after each node, on the least audit of least cost from `start` to `end`."""
    out = [end] * len(nodes)
    todo = [(0, len(nodes), start, end)]
    while todo:
        lo, hi, p, q = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = run_forward(nodes, lo, mid, p)[1]
        back = at_state(q)[0]
        for i in range(hi - 1, mid - 1, -1):
            back = BACKWARD[back, nodes[i]]
        cross = min(range(4), key=lambda s: (ahead[0][s] + back[s], ahead[1][s]))
        out[mid - 1] = cross
        todo += [(lo, mid, p, cross), (mid, hi, cross, q)]
    return out


def fold(nodes: list[Node]) -> Node:
    """The node of a run of nodes."""
    costs, orders = [], []
    for q in range(4):
        total, (c, o) = run_forward(nodes, 0, len(nodes), q)
        costs.append(tuple(x + total if x < NO else NO for x in c))
        orders.append(o)
    return tuple(costs), tuple(orders)


# --- one run of rows -------------------------------------------------------------------------------------------------
# A row is (turn, role, text, fault).


def nodes_of(rows: list[tuple]) -> list[Node]:
    return [row_node(r[1][:1] if r[1][:1] in INITIALS else "", r[3]) for r in rows]


def replay(rows: list[tuple], start: int, ends: list[int]) -> tuple[str, list[tuple[str, str]]]:
    """Audit and repaired (role, text) of rows between known states."""
    audit, out, state = [], [], start
    for (_, role, text, fault), end in zip(rows, ends, strict=True):
        letters = moves(role[:1] if role[:1] in INITIALS else "", fault)[state][end][1]
        audit.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            state = 1 if letter == "K" and role[:1] == "s" else ASKED[state]
            out.append((NAMES[state], "") if letter == "I" else (NAMES[state] if letter == "R" else role, text))
    return "".join(audit), out


def tail_of(state: int) -> tuple[str, list[tuple[str, str]]]:
    out = []
    for _ in range(TAIL[state]):
        state = ASKED[state]
        out.append((NAMES[state], ""))
    return "I" * len(out), out


def written(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in turns)


def counts_of(rows: list[tuple]) -> dict:
    """What a run of rows adds to its conversation's report; `first` and `last` are initials, `low` and `high` turns."""
    turns = [r[0] for r in rows if r[0] is not None]
    first = [r[1][:1] for r in rows]
    faults = [r[3] for r in rows]
    return {
        "n_rows": len(rows),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(REPEAT),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:])),
        "first": first[0] if rows else None,
        "last": first[-1] if rows else None,
        "low": turns[0] if turns else None,
        "high": turns[-1] if turns else None,
        "n_turns": len(set(turns)),
    }


def joined_counts(a: dict | None, b: dict) -> dict:
    if a is None or not a["n_rows"]:
        return b
    if not b["n_rows"]:
        return a
    out = {k: a[k] + b[k] for k in ("n_rows", "blank", "duplicate", "truncated", "illegal", "n_turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["n_turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def gaps(c: dict) -> int:
    return 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["n_turns"]


def audit_cost(audit: str, kept_truncated: int) -> int:
    return 2 * (audit.count("I") + audit.count("R")) + 3 * audit.count("D") + kept_truncated


def kept_truncated(rows: list[tuple], audit: str) -> int:
    return sum(r[3] == TRUNCATED and x != "D" for r, x in zip(rows, audit.replace("I", ""), strict=True))


# --- Spark -----------------------------------------------------------------------------------------------------------

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "array<struct<role:string,text:string>>"
COUNTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long"


def _table(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(ddl_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_schema)


def _sorted(df: DataFrame, conv: str, turn: str, role: str, text: str, alive: Column) -> DataFrame:
    """(conv, alive, turn, role, text, blank, cut, at): rows dealt and sorted by ranges; `at` is a row's place. A salt lets equal rows be dealt to several ranges."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.coalesce(alive, F.lit(True)).alias("alive"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"))
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"), "head": F.substring("text", 1, 64), "h": F.xxhash64("text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "head", "h", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.withColumn("at", F.monotonically_increasing_id()).drop("head", "h", "salt")


def _solve_inside(placed: DataFrame, block: int, keep_turns: bool) -> DataFrame:
    """Reports of the conversations that surely lie inside a range, and the rows of all others (`open`)."""
    kind = placed.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, open boolean, at long, alive boolean, turn long, role string, text string, is_blank boolean, is_cut boolean, {REPORT}, turns {TURNS}"
    spark = placed.sparkSession
    out_schema = spark.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterator:
        arrow = _arrow_schema(out_schema)
        none, empty_row = (None,) * 9, (None,) * 7
        out: list[tuple] = []
        held: list[tuple] = []
        sure, size, current = False, 0, object()

        def closed() -> tuple:
            rows, seen = [], set()
            for _, _, alive, turn, role, text, blank, cut in held:
                if alive:
                    fault = BLANK if blank else REPEAT if (role, text) in seen else TRUNCATED if cut else FINE
                    seen.add((role, text))
                    rows.append((turn, role, text, fault))
            nodes = nodes_of(rows)
            end = last_state(run_forward(nodes, 0, len(nodes), 0)[1])
            audit, turns = replay(rows, 0, crossings(nodes, 0, end))
            cost = audit_cost(audit, kept_truncated(rows, audit))
            more, added = tail_of(end)
            c = counts_of(rows)
            sha = hashlib.sha256(written(turns + added).encode()).hexdigest()
            report = (gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost + 2 * len(more), audit + more, sha)
            return (held[0][1], False, *empty_row, *report, turns + added if keep_turns else None)

        def opened() -> None:
            out.extend((r[1], True, r[0], *r[2:], *none) for r in held)
            held.clear()

        give_back()
        for b in batches:
            columns = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("at", "conv", "alive", "turn", "role", "text", "blank", "cut"))
            for r in zip(*columns):
                if r[1] != current or not size:
                    if held:
                        if sure and size == len(held):
                            out.append(closed())
                            held.clear()
                        else:
                            opened()
                    sure, size, current = size > 0, 0, r[1]  # the first conversation of a range may have begun before it
                held.append(r)
                size += 1
                if len(held) > block:
                    opened()
                if len(out) >= 2048:
                    yield _table([tuple(x) for x in out], arrow)
                    out.clear()
        opened()  # the last may go on in the next range
        if out:
            yield _table(out, arrow)
        give_back()

    return placed.mapInArrow(run, schema)


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows of open conversations with `key` and `fault`; repeats are found by groups of equal (conversation, role, text), counted first."""
    key = F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv").cast("string")))
    rows = rows.select(key.alias("key"), "conv", "at", "alive", "turn", "role", "text", "is_blank", "is_cut")
    first = rows.where("alive and not is_blank").groupBy("key", "role", "text").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = join_by_size(rows, first, ["key", "role", "text"], "n", "left")
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("at") > F.col("first"), REPEAT).when(F.col("is_cut"), TRUNCATED).otherwise(FINE)
    return marked.withColumn("fault", fault).drop("first", "n")


def _as_lists(node: Node) -> list[int]:
    return [x for part in node for row in part for x in row]


def _as_node(flat) -> Node:
    four = [tuple(int(x) for x in flat[i : i + 4]) for i in range(0, 32, 4)]
    return tuple(four[:4]), tuple(four[4:])


def _segments(rows: DataFrame, block: int) -> DataFrame:
    """One row per block of an open conversation: its rows in order, its node and counts."""
    # Places are range number * 2^33 + place in the range, so a block never spans two ranges.
    seg = rows.withColumns({"part": F.shiftright("at", 33), "seg": F.floor(F.col("at") / block)})
    packed = F.array_sort(F.collect_list(F.struct("at", "alive", "turn", "role", "text", F.col("fault").cast("int").alias("fault"))))
    seg = seg.groupBy("key", "conv", "part", "seg").agg(packed.alias("rows"))
    kind = rows.schema["conv"].dataType.simpleString()
    packed_kind = seg.schema["rows"].dataType.simpleString()
    schema = f"key string, conv {kind}, part long, seg long, rows {packed_kind}, node array<long>, {COUNTS}"
    out_schema = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterator:
        arrow = _arrow_schema(out_schema)
        for big in batches:
            for i in range(big.num_rows):
                b = big.slice(i, 1)
                own = alive_rows(b.column(4)[0].as_py())
                line = [c[0].as_py() for c in b.columns] + [_as_lists(fold(nodes_of(own)) if own else NOTHING), *counts_of(own).values()]
                yield _table([tuple(line)], arrow)

    return seg.select("key", "conv", "part", "seg", "rows").mapInArrow(run, schema)


def alive_rows(packed: list[dict]) -> list[tuple]:
    return [(r["turn"], r["role"], r["text"], r["fault"]) for r in packed if r["alive"]]


def _states(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, start, end): the states around each node of a run, which goes from `start` to `end` where they're given, else from nothing to an end of least cost."""

    def run(g):
        import pandas as pd

        g = g.sort_values(order)
        own = [_as_node(x) for x in g["node"]]
        if "start" in g:
            start, end = int(g["start"].iloc[0]), int(g["end"].iloc[0])
        else:
            start = 0
            end = last_state(run_forward(own, 0, len(own), 0)[1])
        ends = crossings(own, start, end)
        return pd.DataFrame({**{c: g[c] for c in by}, order: g[order], "start": [start, *ends[:-1]], "end": ends})

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in [*by, order])
    return nodes.groupBy(*by).applyInPandas(run, f"{kinds}, start int, end int")


def _folded(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    def run(g):
        import pandas as pd

        own = [_as_node(x) for x in g.sort_values(order)["node"]]
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "node": [_as_lists(fold(own))]})

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in by)
    return nodes.groupBy(*by).applyInPandas(run, f"{kinds}, node array<long>")


def _solve_segments(segments: DataFrame, keep_turns: bool) -> DataFrame:
    """Segments with start, end, audit, cost and the text that goes into the hash (or the turns)."""
    thin = segments.select("key", "part", "seg", "node")
    # A conversation has at most one node per range at the top; a range has as many blocks as it has rows for.
    top = _states(_folded(thin, ["key", "part"], "seg"), ["key"], "part")
    inner = _states(thin.join(top, ["key", "part"]), ["key", "part"], "seg")
    both = segments.join(inner, ["key", "part", "seg"]).select("key", "conv", "seg", "rows", "start", "end", *[c.split(" ")[0] for c in COUNTS.split(", ")])
    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"key string, conv {kind}, seg long, audit string, cost long, chunk string, turns {TURNS}, end int, {COUNTS}"
    out_schema = segments.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator) -> Iterator:
        arrow = _arrow_schema(out_schema)
        for big in batches:
            for i in range(big.num_rows):
                key, conv, seg, packed, start, end, *counts = (c[i].as_py() for c in big.columns)
                rows = alive_rows(packed)
                audit, turns = replay(rows, start, crossings(nodes_of(rows), start, end))
                chunk = written(turns) if turns and not keep_turns else None
                yield _table([(key, conv, seg, audit, audit_cost(audit, kept_truncated(rows, audit)), chunk, turns if keep_turns else None, end, *counts)], arrow)

    return both.mapInArrow(run, schema)


def _stitch(solved: DataFrame) -> DataFrame:
    """Reports of open conversations: their blocks' texts run through the hash in order, so a task holds one block at a time."""
    kind = solved.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {REPORT}"
    out_schema = solved.sparkSession.createDataFrame([], schema).schema
    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def run(batches: Iterator) -> Iterator:
        arrow = _arrow_schema(out_schema)
        now, conv, audit, cost, sha, some, state, c = None, None, [], 0, hashlib.sha256(), False, 0, None

        def add(chunk: str) -> None:
            nonlocal some
            sha.update(("\n" + chunk if some else chunk).encode())
            some = True

        def report() -> tuple:
            letters, added = tail_of(state)
            if added:
                add(written(added))
            return (conv, gaps(c), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost + 2 * len(letters), "".join(audit) + letters, sha.hexdigest())

        for big in batches:
            for i in range(big.num_rows):
                key, own, letters, price, chunk, end, *counts = (col[i].as_py() for col in big.columns)
                if key != now:
                    if now is not None:
                        yield _table([report()], arrow)
                    now, conv, audit, cost, sha, some, c = key, own, [], 0, hashlib.sha256(), False, None
                audit.append(letters)
                cost, state, c = cost + price, end, joined_counts(c, dict(zip(names, counts, strict=True)))
                if chunk is not None:
                    add(chunk)
        if now is not None:
            yield _table([report()], arrow)

    rows = solved.repartition("key").sortWithinPartitions("key", "seg")
    return rows.select("key", "conv", "audit", "cost", "chunk", "end", *names).mapInArrow(run, schema)


def _solved(df: DataFrame, conv: str, turn: str, role: str, text: str, alive: Column | None, block: int, keep_turns: bool) -> tuple[DataFrame, DataFrame]:
    placed = _sorted(df, conv, turn, role, text, F.lit(True) if alive is None else alive)
    first = materialise(_solve_inside(placed, block, keep_turns), "conversations")
    segments = materialise(_segments(_with_faults(first.where("open")), block), "conversation-blocks")
    return first.where("not open"), _solve_segments(segments, keep_turns)


def repair_reports(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: Column | None = None, block: int = 4096) -> DataFrame:
    """One row per conversation: `conv`, gaps, counts of faulty rows, illegal pairs, cost, audit, and the hash of the repaired conversation."""
    inside, solved = _solved(df, conv, turn, role, text, alive, block, False)
    names = [c.split(" ")[0] for c in REPORT.split(", ")]
    return inside.select(F.col("conv").alias(conv), *names).unionByName(_stitch(solved).select(F.col("conv").alias(conv), *names))


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: Column | None = None, block: int = 4096) -> DataFrame:
    """The repaired conversations: `conv`, block, place (from 0 in each block), role, text, to be read in this order."""
    inside, solved = _solved(df, conv, turn, role, text, alive, block, True)
    last = solved.groupBy("key").agg(F.max_by(F.struct("conv", "end", "seg"), "seg").alias("x"))
    lists = [(q, [{"role": r, "text": t} for r, t in tail_of(q)[1]]) for q in range(4)]
    tails = F.create_map(*[c for q, own in lists for c in (F.lit(q), F.array(*[F.struct(F.lit(x["role"]).alias("role"), F.lit(x["text"]).alias("text")) for x in own]).cast(TURNS))])
    ends = last.select(F.col("x.conv").alias("conv"), (F.col("x.seg") + 1).alias("seg"), tails[F.col("x.end")].alias("turns"))
    parts = inside.select("conv", F.lit(0).cast("long").alias("seg"), "turns").unionByName(solved.select("conv", "seg", "turns")).unionByName(ends)
    out = parts.select(F.col("conv").alias(conv), F.col("seg").alias("block"), F.posexplode("turns").alias("place", "t"))
    return out.select(conv, "block", "place", "t.role", "t.text")


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(`conv:turn`) % 20, nulls as one space: 0 drops a row (`alive` is false), 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes it the user's."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(conv), F.lit(":"), some(turn)).cast("binary")) % 20
    rows = df.select(conv, turn, some(role).alias(role), some(text).alias(text), kind.cast("int").alias("damage"))
    is_ = lambda k: F.col("damage") == k
    rows = rows.withColumns(
        {role: F.when(is_(4), F.lit("user")).otherwise(F.col(role)), text: F.when(is_(1), F.lit("")).when(is_(2), F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)), "alive": ~is_(0)}
    )
    return rows.withColumn("copy", F.explode(F.when(is_(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "damage")


assert SPACE == r"\x20\x09-\x0D" and set(BLANKS) == set(" \t\n\x0b\x0c\r")


def oracle() -> str:
    """The report of `damaged` conversations in DuckDB's SQL: a recursion over each conversation's rows, which carries the best (cost, audit, repaired) of the four states."""
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"
    way = lambda e, cost, letter, line=None: (
        f"CASE WHEN {e} IS NOT NULL THEN {{'c': {e}.c + {cost}, 'a': {e}.a || '{letter}', 't': {f'list_append({e}.t, {line})' if line else f'{e}.t'}}} END"
    )
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    inserted_user = least("e2", *(way(e, 2, "I", "'user:'") for e in ("e0", "e1", "e3")))
    inserted_assistant = least("e3", way("f2", 2, "I", "'assistant:'"))
    keep = lambda e, initial: when(f"NOT gone AND first = '{initial}'", way(e, "cut", "K", "role || ':' || text"))
    rerole = lambda e, role: when("NOT gone", way(e, "2 + cut", "R", f"'{role}:' || text"))
    after = {
        "e0": way("e0", 3, "D"),
        "e1": least(way("e1", 3, "D"), keep("e0", "s")),
        "e2": least(way("f2", 3, "D"), *(x for e in ("e0", "e1", "f3") for x in (keep(e, "u"), rerole(e, "user")))),
        "e3": least(way("f3", 3, "D"), keep("f2", "a"), rerole("f2", "assistant")),
    }
    crc = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda b: CAST((ascii(k[i]) >> b) & 1 AS BIGINT)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    white = r"\x20\x09-\x0D"
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
g AS (SELECT *, {crc} % 20 AS g FROM o),
x AS (SELECT conv_id, turn, CASE WHEN g = 4 THEN 'user' ELSE role END AS role, CASE g WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN g = 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE g <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
             regexp_replace(text, '[{white}]+$', '') AS bare FROM x),
r AS MATERIALIZED (SELECT *, role[1] AS first, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
p AS MATERIALIZED (SELECT *, fault IN ('b', 'd') AS gone, CAST(fault = 't' AS INT) AS cut, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r),
d AS (
  SELECT conv_id, 0 AS i, CAST({{'c': 0, 'a': '', 't': []}} AS {kind}) AS e0, CAST(NULL AS {kind}) AS e1, CAST(NULL AS {kind}) AS e2, CAST(NULL AS {kind}) AS e3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {", ".join(f"CAST({v} AS {kind}) AS {k}" for k, v in after.items())}
  FROM (SELECT *, {inserted_assistant} AS f3 FROM (SELECT d.conv_id, p.i, role, text, first, gone, cut, e0, e1, e2, e3, {inserted_user} AS f2 FROM d JOIN p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i + 1))),
m AS (SELECT conv_id, e0, {inserted_assistant} AS f3 FROM (SELECT *, {inserted_user} AS f2 FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
b AS (SELECT conv_id, {least("e0", "f3")} AS w FROM m),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || first NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       w.c AS cost, w.a AS audit, sha256(array_to_string(w.t, chr(10))) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
