"""Conversation structure repair: the cheapest edits that give a conversation the role order ``(system? (user assistant)+)?``.

A row is kept, given the role user or assistant, or deleted; empty rows may be inserted. An edit path walks a lattice of (rows
passed, grammar state). ``cheapest`` searches it by bidirectional Dijkstra: a forward and a reverse heap grow until their least costs
together exceed the best meeting, so that every crossing of equal cost is settled, and the least concatenated audit of
them wins. The audit is the edits' initials in order (D, I, K, R). A path's cost follows from its audit, hence audits of equal cost
between the same two nodes never are prefixes of each other, and the least whole audit is made of least parts.

Rows are dealt by ranges of (conversation, turn), so that one conversation may span any number of tasks. A conversation that lies inside a task's
range and has at most WHOLE rows and WHOLE_BYTES of text is repaired while it streams by. The rows of others are cut into blocks
of BLOCK rows; each block's lattice gives the cheapest audit between every entry and exit state, and blocks are
combined, FAN at a time, as a (min, concatenate) product. Both ways give the same answer. The digest of a repaired conversation is one chain over
its text; a long one is streamed in order through one task that holds a batch and the audit.

Order inside a conversation: turn (null first), then role and an MD5 of role and text. A null conv_id is a conversation of its own; null role or text reads
as one space. Repeated rows are duplicates and deleted. Texts of any length are streamed, never cut. Extra columns are not read. An empty
table gives no rows; a conversation whose rows are all marked ``gone`` gives zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import cut, drop
from ..ordered import global_index
from ..shipping import ship
from .common import Memo, slices

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
UNFINISHED = 5  # for a truncated row that is not deleted
#: State after a role's initial: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
START, ENDS = 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
WHOLE, WHOLE_BYTES, BLOCK, FAN = 512, 4_000_000, 128, 16
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAULTS = ("blank", "duplicate", "truncated")


def code(initial: str, fault: int) -> str:
    """One character for all that the lattice needs to know of a row."""
    return chr(65 + 4 * ("sua".find(initial) % 4 if initial else 3) + fault)


def parts(c: str) -> tuple[str, int]:
    return "sua-"[(ord(c) - 65) // 4], (ord(c) - 65) % 4


def row_edits(c: str) -> list[tuple[int, str, int, int]]:
    """(state before, initial, state after, cost) of the edits that pass a row."""
    initial, fault = parts(c)
    out = [(q, DELETE, q, COST[DELETE]) for q in STATES]
    if fault in (CLEAN, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        out += [(q, KEEP, t, COST[KEEP] + extra) for (q, r), t in STEP.items() if r == initial]
        out += [(q, REROLE, t, COST[REROLE] + extra) for (q, r), t in STEP.items() if r in ROLES]
    return out


INSERTS = [(q, INSERT, t, COST[INSERT]) for (q, r), t in STEP.items() if r in ROLES]
_ROW_EDITS = Memo(row_edits)


def _around(pattern: str, node: tuple[int, int], side: int) -> Iterator[tuple[tuple[int, int], str, int]]:
    """(neighbour, initial, cost) after a node (side 0) or before it (side 1)."""
    i, q = node
    for new, edits in ((i, INSERTS), (i + 1, _ROW_EDITS[pattern[i]] if i < len(pattern) else ())) if side == 0 else ((i, INSERTS), (i - 1, _ROW_EDITS[pattern[i - 1]] if i else ())):
        for before, e, after, cost in edits:
            if (before if side == 0 else after) == q:
                yield (new, after if side == 0 else before), e, cost


def cheapest(pattern: str, entry: int = START, exits: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path through the lattice of ``pattern``, the least audit among equals; None if there is none.

    Each side settles nodes by cost and, among equals, by the rows passed: only passing a row can be free, so a settled label is final.
    Whenever a label gets better, it is joined with the other side's label of that node. Once both sides have settled more than the best cost
    between them, the last node of the best path that the forward side settled has a successor settled by the reverse side, so the best path was joined.
    """
    n = len(pattern)
    labels: tuple[dict, dict] = ({(0, entry): (0, "")}, {(n, q): (0, "") for q in exits})
    heaps = [[(0, i, (i, q)) for i, q in labels[0]], [(0, -i, (i, q)) for i, q in labels[1]]]
    done: tuple[set, set] = (set(), set())
    level = [0, 0]
    best = (0, "") if not n and entry in exits else None
    while heaps[0] and heaps[1] and (best is None or level[0] + level[1] <= best[0]):
        side = 0 if level[0] <= level[1] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side].add(node)
        level[side] = cost
        audit = labels[side][node][1]
        for new, e, w in _around(pattern, node, side):
            found = (cost + w, e + audit if side else audit + e)
            old = labels[side].get(new)
            if old is not None and old <= found:
                continue
            labels[side][new] = found
            heapq.heappush(heaps[side], (found[0], -new[0] if side else new[0], new))
            met = labels[1 - side].get(new)
            if met is not None:
                whole = (found[0] + met[0], met[1] + found[1] if side else found[1] + met[1])
                best = whole if best is None else min(best, whole)
    return best


def lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation, for an audit and the rows it speaks of."""
    q = START
    for e in audit:
        if e == INSERT:
            role, text = ("assistant" if q == 2 else "user"), ""
        else:
            role, text = next(rows)
            if e == DELETE:
                continue
            if e == REROLE:
                role = "assistant" if q == 2 else "user"
        q = STEP[q, role[:1]]
        yield role, text


class Digest:
    """SHA-256 over newline-joined ``role:text``."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + role.encode() + b":" + text.encode())
        self.first = False


# --- summaries that combine -----------------------------------------------------------------------------------------

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


PART = (
    "ck string, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, costs array<long>, audits array<string>"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
PART_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in PART.split(", "))])


def _illegal(pattern: str) -> int:
    initials = [parts(c)[0] for c in pattern]
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:]))  # noqa: B905


def _faults(pattern: str) -> dict[str, int]:
    faults = [parts(c)[1] for c in pattern]
    return {name: faults.count(k) for k, name in enumerate(FAULTS, BLANK)}


def summary(pattern: str, turns: list[int | None]) -> dict:
    """What a block contributes: counts, both ends, and the cheapest audit from every entry to every exit state (null if none)."""
    known = [t for t in turns if t is not None]
    paths = [cheapest(pattern, q, (t,)) for q in STATES for t in STATES]
    return _faults(pattern) | {
        "illegal": _illegal(pattern), "first": parts(pattern[0])[0], "last": parts(pattern[-1])[0], "low": known[0] if known else None, "high": known[-1] if known else None,
        "turns": len(set(known)), "costs": [p and p[0] for p in paths], "audits": [p and p[1] for p in paths],
    }


def combine(a: dict, b: dict) -> dict:
    """Summary of two neighbouring runs of rows."""
    paths = []
    for q in STATES:
        for t in STATES:
            ways = [
                (a["costs"][4 * q + m] + b["costs"][4 * m + t], a["audits"][4 * q + m] + b["audits"][4 * m + t])
                for m in STATES if a["audits"][4 * q + m] is not None and b["audits"][4 * m + t] is not None
            ]
            paths.append(min(ways) if ways else None)
    return {k: a[k] + b[k] for k in FAULTS} | {
        "illegal": a["illegal"] + b["illegal"] + ((a["last"], b["first"]) not in LEGAL), "first": a["first"], "last": b["last"],
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
        "turns": a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"]),
        "costs": [p and p[0] for p in paths], "audits": [p and p[1] for p in paths],
    }


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


# --- over Spark -----------------------------------------------------------------------------------------------------


def damage(convs: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as the test of this operator damages them; dropped ones stay as ``gone``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = convs.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("_times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("_times").alias("_copy")).drop("_copy")


def _staged(rows: DataFrame) -> DataFrame:
    """Rows in order over range partitions, with what the lattice needs; identical rows are told apart by where they were read."""
    text = F.coalesce("text", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    ready = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.coalesce(F.col("gone"), F.lit(False)).alias("gone"), last.alias("tail"),
    ).withColumn("h", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))).withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("tie")]
    return ready.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())


_LOOSE = "at long, turn long, role string, text string, h binary, bare string"


def _fault(tail: str, again: bool) -> int:
    return BLANK if not tail else DUPLICATE if again else CLEAN if tail in ".!?" else TRUNCATED


def _whole(rows: list[tuple], solve: Callable[[str], tuple[int, str]]) -> dict:
    """Result of one conversation whose (turn, role, text, h, tail) rows are at hand."""
    seen: set[bytes] = set()
    pattern, turns = [], set()
    for turn, role, _, h, tail in rows:
        pattern.append(code(role[:1], _fault(tail, h in seen)))
        seen.add(h)
        if turn is not None:
            turns.add(turn)
    pattern = "".join(pattern)
    cost, audit = solve(pattern)
    digest = Digest()
    for role, text in lines(audit, iter([r[1:3] for r in rows])):
        digest.add(role, text)
    gaps = _gaps(min(turns), max(turns), len(turns)) if turns else 0
    return {"gaps": gaps, **_faults(pattern), "illegal": _illegal(pattern), "cost": cost, "audit": audit, "sha": digest.sha.hexdigest()}


def _streamed(staged: DataFrame, whole: int, whole_bytes: int) -> DataFrame:
    """Finished conversations (``at`` null) and the rows of those that a task cannot finish alone."""
    key = staged.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("ck", T.StringType()), T.StructField("conv_id", key)])
    for part in (f"{COUNTS}, cost long, audit string, sha string", _LOOSE):
        schema = T.StructType(schema.fields + T._parse_datatype_string(part).fields)
    target = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def run(batches):
        solve = Memo(cheapest, 20_000).__getitem__
        out: dict[str, list] = {n: [] for n in names}
        held: list[tuple] = []
        size, now, conv, first, long = 0, None, None, True, False

        def put(**values):
            for n in names:
                out[n].append(values.get(n))

        def loose():
            for at, gone, turn, role, text, h, tail in held:
                if gone:
                    put(ck=now, conv_id=conv, at=at)
                else:
                    put(ck=now, conv_id=conv, at=at, turn=turn, role=role, text=text, h=h, bare=tail)
            held.clear()

        def close(last):
            # The first and the last conversation of a range may go on in a neighbouring one.
            if long or first or last:
                loose()
            else:
                put(ck=now, conv_id=conv, **_whole([r[2:] for r in held if not r[1]], solve))
                held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = batch.slice(start, 1024).to_pydict()
                fields = zip(*(rows[c] for c in ("ck", "conv_id", "at", "gone", "turn", "role", "text", "h", "tail")), strict=True)
                for ck, cid, *row in fields:
                    if ck != now:
                        if now is not None:
                            close(False)
                            first = False
                        now, conv, size, long = ck, cid, 0, False
                    held.append(tuple(row))
                    size += len(row[4])
                    if long or len(held) > whole or size > whole_bytes:
                        long = True
                        loose()
                if out["ck"]:
                    yield pa.RecordBatch.from_pydict(out, schema=target)
                    for n in names:
                        out[n].clear()
        if now is not None:
            close(True)
        if out["ck"]:
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return staged.mapInArrow(run, schema)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """PART rows of blocks of neighbouring rows; a row repeats if an earlier one of its conversation has the same role and text."""
    narrow = rows.select("ck", "at", "turn", "h", F.substring("role", 1, 1).alias("initial"), "bare")
    firsts = narrow.groupBy("ck", "h").agg(F.min("at").alias("seen"))
    marked = narrow.join(firsts, ["ck", "h"]).select("ck", "at", "turn", "initial", "bare", (F.col("at") > F.col("seen")).alias("again"))
    grouped = marked.groupBy("ck", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "turn", "initial", "bare", "again"))).alias("rows"))

    def run(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                pattern = "".join(code(r["initial"], _fault(r["bare"], r["again"])) for r in row["rows"])
                made.append({"ck": row["ck"], "block": row["block"]} | summary(pattern, [r["turn"] for r in row["rows"]]))
            yield pa.RecordBatch.from_pylist(made, schema=PART_SCHEMA)

    return grouped.mapInArrow(run, PART)


def _combined(blocks: DataFrame, fan: int) -> DataFrame:
    """One PART row a conversation, by rounds that combine ``fan`` neighbours."""
    numbered = global_index(blocks, ["ck", "block"], "place")
    start = numbered.groupBy("ck").agg(F.min("place").alias("start"))
    now = cut(numbered.join(start, "ck").withColumn("block", F.col("place") - F.col("start")).drop("place", "start"), "blocks")

    def run(table):
        rows = table.sort_by("block").to_pylist()
        total = rows[0]
        for row in rows[1:]:
            total = combine(total, row)
        return pa.Table.from_pylist([total | {"ck": rows[0]["ck"], "block": rows[0]["block"] // fan}], schema=PART_SCHEMA)

    while (now.agg(F.max("block")).first()[0] or 0) > 0:
        nxt = cut(now.groupBy("ck", F.floor(F.col("block") / fan).alias("group")).applyInArrow(lambda t: run(t), PART), "blocks")
        drop(now)
        now = nxt
    return now


def _digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(ck, sha) of long conversations: rows stream in order behind their audit."""
    none = F.lit(None).cast("string")
    stream = audits.select("ck", F.lit(-1).cast("long").alias("at"), none.alias("role"), none.alias("text"), "audit").union(rows.select("ck", "at", "role", "text", none))

    def run(batches):
        done: list[tuple[str, str]] = []
        now, audit, place, q, digest = None, "", 0, START, Digest()

        def inserts():
            nonlocal place, q
            while place < len(audit) and audit[place] == INSERT:
                role = "assistant" if q == 2 else "user"
                digest.add(role, "")
                q, place = STEP[q, role[:1]], place + 1

        for batch in batches:
            for row in (r for rows_ in slices(batch) for r in rows_.to_pylist()):
                if row["at"] < 0:
                    if now is not None:
                        done.append((now, digest.sha.hexdigest()))
                    now, audit, place, q, digest = row["ck"], row["audit"], 0, START, Digest()
                else:
                    e, place = audit[place], place + 1
                    if e != DELETE:
                        role = row["role"] if e == KEEP else "assistant" if q == 2 else "user"
                        digest.add(role, row["text"])
                        q = STEP[q, role[:1]]
                inserts()
            if done:
                yield pa.RecordBatch.from_pydict({"ck": [d[0] for d in done], "sha": [d[1] for d in done]})
                done.clear()
        if now is not None:
            yield pa.RecordBatch.from_pydict({"ck": [now], "sha": [digest.sha.hexdigest()]})

    return stream.repartition("ck").sortWithinPartitions("ck", "at").mapInArrow(run, "ck string, sha string")


def repair(rows: DataFrame, whole: int = WHOLE, whole_bytes: int = WHOLE_BYTES, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of rows
    (conv_id, turn, role, text) and, if there, a boolean ``gone`` for rows that only name their conversation."""
    ship(rows.sparkSession)
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    seen = cut(_streamed(_staged(rows), whole, whole_bytes), "streamed")
    result = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
    finished = seen.filter("at is null").select("conv_id", *result)
    left = seen.filter("at is not null")
    # Conversations without any row left but a marked one still count.
    names = left.groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    present = left.filter("role is not null").select("ck", *[f.split()[0] for f in _LOOSE.split(", ")])
    solved = _combined(_blocks(present, block), fan)
    at = lambda c, q: F.get(c, F.lit(q))
    ends = [F.when(at("audits", q).isNotNull(), F.struct(at("costs", q).alias("cost"), at("audits", q).alias("audit"))) for q in ENDS]
    best = F.least(*ends)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    solved = cut(solved.select("ck", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.cost.alias("cost"), best.audit.alias("audit")), "solved")
    told = solved.join(_digests(present, solved), "ck")
    zero = {c: F.lit(0) for c in result[:-2]} | {"audit": F.lit(""), "sha": F.lit(hashlib.sha256().hexdigest())}
    loose = names.join(told, "ck", "left").select("conv_id", *[F.coalesce(F.col(c), zero[c]).alias(c) for c in result])
    return finished.union(loose).withColumnRenamed("sha", "repaired_sha256")
