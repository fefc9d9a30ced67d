"""Repair of the structure of conversations: a Viterbi search that gives edits out as soon as all survivors agree on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.common import small, table
from cladeworks.llm.conversations import CRC_SQL, DIGEST_SQL, digest, turns

#: States: nothing yet, after system, after user, after assistant; what may follow each, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)
#: Costs of edits, and what a row that is cut short adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Most insertions in a row: from any state these lead to all that insertions can lead to.
INSERTS = 3
#: (state, other, margin): a survivor of a state that costs over so much more than that of the other can't win any more,
#: as what may follow in the first may follow in the other, at the cost of that many units.
BEATEN = ((SYSTEM, START, 0), (ASSISTANT, START, 0), (SYSTEM, ASSISTANT, 0), (START, ASSISTANT, DELETE), (SYSTEM, USER, INSERT), (ASSISTANT, USER, INSERT), (USER, ASSISTANT, INSERT), (USER, START, INSERT), (USER, SYSTEM, INSERT), (START, USER, INSERT + DELETE))
#: Most repeated texts of conversations that are broadcast.
MOST_REPEATED = 500_000

EDITS = "conv_id long, place long, edit string, turn long, was string, role string, text string, fault string"


def _inserted(state: int) -> list[tuple[int, str]]:
    """States that so many insertions lead to, with the edits."""
    out = [(state, "")]
    for _ in range(INSERTS):
        state, edits = out[-1]
        out.append((USER if state != USER else ASSISTANT, edits + "I"))
    return out


def _moves(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    """For each state after a row the ways to it: state before, cost and edits, one for each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        for state, edits in _inserted(before):
            ways = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED * (fault == "truncated")
                if initial in FOLLOWS[state]:
                    ways.append((FOLLOWS[state][initial], KEEP + more, "K"))
                ways += [(FOLLOWS[state][r], REROLE + more, "R") for r in "ua" if r in FOLLOWS[state]]
            for after, cost, edit in ways:
                way = (cost + INSERT * len(edits), edits + edit)
                best[before, after] = min(best.get((before, after), way), way)
    return [[(before, *best[before, after]) for before in range(4) if (before, after) in best] for after in range(4)]


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


class _Step:
    """Edits up to and with one row, after those of ``before``; ``used`` counts the steps and survivors that follow."""

    __slots__ = ("before", "edits", "row", "used")

    def __init__(self, before, edits: str, row):
        self.before, self.edits, self.row, self.used = before, edits, row, 0


class Repair:
    """The cheapest edits of a conversation whose rows come one by one; of equal costs the least edits, as ASCII text.

    A survivor is the best way to a state: its cost, its rank among the survivors by their whole edits, and its last
    step. Steps form a tree by ``before``. Two ways to a state that cost the same are compared by the whole edits that
    are not given out yet: no survivor's edits begin another's (the same edits lead to the same state, and further ones
    only insert, which costs), so ranks of the ways' survivors, then the last edits, compare them. When only one step
    follows the last one given out, all survivors share it, and it is given out and forgotten.
    """

    def __init__(self):
        self.trunk, self.state = _Step(None, "", None), START
        self.alive = {START: (0, 0, self.trunk)}
        self.trunk.used = 1

    def add(self, row, initial: str, fault: str) -> list[tuple[str, object]]:
        """Takes the next row; the steps (edits, row) that are certain now."""
        found = {}
        for after, ways in enumerate(MOVES[initial, fault]):
            options = [(self.alive[b][0] + cost, self.alive[b][1], edits, b) for b, cost, edits in ways if b in self.alive]
            if options:
                found[after] = min(options)
        for state, other, margin in BEATEN:
            if state in found and other in found and found[state][0] > found[other][0] + margin:
                del found[state]
        ranks = {q: i for i, q in enumerate(sorted(found, key=lambda q: found[q][1:3]))}
        alive = {}
        for q, (cost, _, edits, b) in found.items():
            step = _Step(self.alive[b][2], edits, row)
            step.before.used += 1
            step.used = 1
            alive[q] = (cost, ranks[q], step)
        gone, self.alive = self.alive, alive
        for *_, step in gone.values():
            self._drop(step)
        return self._shared()

    def _drop(self, step) -> None:
        step.used -= 1
        while not step.used and step is not self.trunk:
            step = step.before
            step.used -= 1

    def _shared(self) -> list[tuple[str, object]]:
        if self.trunk.used > 1:
            return []
        step, path = next(iter(self.alive.values()))[2], []
        while step is not self.trunk:
            path.append(step)
            step = step.before
        out = []
        while path and self.trunk.used == 1:
            step = path.pop()
            out.append((step.edits, step.row))
            step.before, self.trunk = None, step
        return out

    def end(self) -> list[tuple[str, object]]:
        """The steps that are left; the last one, of insertions only, has no row."""
        ways = [(cost + INSERT * len(edits), rank, edits, q) for q, (cost, rank, _) in self.alive.items() for state, edits in _inserted(q) if state in ENDS]
        _, _, edits, q = min(ways)
        step, out = self.alive[q][2], [(edits, None)]
        while step is not self.trunk:
            out.append((step.edits, step.row))
            step = step.before
        return out[::-1]


def _kind(turn, role: str, key: str, text: str, first, last) -> str:
    """The fault of a row; ``last`` is the row before it, ``first`` the first turn with its role and text, if known."""
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if last == (turn, role, key) or (first is not None and (turn is not None and turn > first)):
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def _repair(batches):
    """Edits of the conversations of a partition, which is sorted by conversation and turn."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 1, pa.int64(), *[pa.string()] * 4]
    names = ["conv_id", "place", "edit", "turn", "was", "role", "text", "fault"]
    rows, size, now, search, last = [], 0, (), None, None
    place = state = 0

    def edits(steps):
        nonlocal place, state, size
        for marks, row in steps:
            for edit in marks:
                place += 1
                turn, was, text, fault = row if edit != "I" else (None, None, "", None)
                role = None
                if edit == "K":
                    role, state = was, FOLLOWS[state][was[0]]
                elif edit != "D":
                    initial = next(r for r in FOLLOWS[state] if r != "s")
                    role, state = NAMES[initial], FOLLOWS[state][initial]
                rows.append((now[0], place, edit, turn, was, role, text, fault))
                size += len(text)

    def out():
        nonlocal size
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        rows.clear()
        size = 0
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for conv, turn, role, key, text, times, first in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "d", "text", "times", "first_turn")), strict=True):
            if now != (conv,):
                if search:
                    edits(search.end())
                now, search, last, place, state = (conv,), Repair(), None, 0, START
            for _ in range(times):
                fault = _kind(turn, role, key, text, first, last)
                last = (turn, role, key)
                edits(search.add((turn, role, text, fault), role[:1] if role[:1] in ("s", "u", "a") else "", fault))
            if len(rows) >= 1000 or size >= 1 << 22:
                yield out()
    if search:
        edits(search.end())
    yield out()


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of each conversation in order, as EDITS tells, for rows (conv_id, turn, role, text).

    Roles are to begin like (s?(ua)+)?. Faults are blank texts, rows whose role and text came before in the
    conversation, and texts that do not end in one of .!? (the first of these counts). Keep costs 0, Rerole to user or
    assistant 1, Delete 2, Insert of an empty user or assistant row 5; blank and duplicate rows must be deleted, others
    that are truncated cost 5 unless they are. Of the cheapest edits the least in ASCII are taken. edit is the initial;
    turn, was (the role before), text and fault are those of the row (an inserted one has text alone); role is the one
    after it, null for deleted rows.

    Rows are taken by turn (null first), role and hash of the text; a column ``times`` tells how often a row stands
    there. A null role or text is one space, a null conv_id a conversation of its own; a repeated row is a duplicate; an
    empty table gives no edits. A task holds the rows that survivors do not agree on yet, not conversations, and knows
    of texts that came in earlier turns from a table of those that do.
    """
    rows = turns(conversations, " ") if "times" not in conversations.columns else conversations.select("conv_id", "turn", "role", "text", "times")
    rows = rows.withColumn("times", F.lit(1)) if "times" not in rows.columns else rows
    rows = rows.withColumn("d", digest())
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    again = rows.groupBy("conv_id", "d").agg(first, F.max("turn").alias("last"), F.bool_or(F.col("turn").isNull()).alias("some")).where("last > first.turn or (some and last is not null)")
    again = small(again.select(F.col("conv_id").alias("c"), F.col("d").alias("e"), F.coalesce("first.turn", F.lit(-(2**63)).cast("long")).alias("first_turn")), MOST_REPEATED, "repeated")
    marked = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d") == F.col("e")), "left").drop("c", "e")
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "d")
    return dealt.select("conv_id", "turn", "role", "d", "text", "times", "first_turn").mapInArrow(_repair, EDITS)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches):
    """A row of REPORT for each conversation of a partition of edits, in order."""
    import hashlib

    import pyarrow as pa

    done, now = [], None
    costs = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    def close():
        if now:
            lost = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            done.append((now["conv"], lost, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()))

    def out():
        columns = list(zip(*done, strict=True)) or [()] * 9
        done.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 7 + [pa.string()] * 2, strict=True)], names=[x.split()[0] for x in REPORT.split(", ")])

    for b in batches:
        for conv, place, edit, turn, was, role, text, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "edit", "turn", "was", "role", "text", "fault")), strict=True):
            if place == 1:
                close()
                now = {"conv": conv, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "was": None, "empty": True}
            now["audit"].append(edit)
            now["cost"] += costs[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
            if edit != "I":
                if turn is not None and turn != now["last"]:
                    now["first"] = turn if now["first"] is None else now["first"]
                    now["last"] = turn
                    now["turns"] += 1
                if fault:
                    now[fault] += 1
                now["illegal"] += now["was"] is not None and now["was"][:1] + was[:1] not in ("su", "ua", "au")
                now["was"] = was
            if edit != "D":
                now["hash"].update(f"{'' if now['empty'] else '\n'}{role}:{text}".encode())
                now["empty"] = False
        yield out()
    close()
    yield out()


def reports(edits: DataFrame) -> DataFrame:
    """A row of REPORT for each conversation of ``edits``, which must come as ``repair`` returns them."""
    return edits.mapInArrow(_reports, REPORT)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of rows that are dropped (times 0), emptied, cut, repeated or made user's, by crc32 of their number."""
    rows = turns(conversations, " ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("hit", F.crc32(key.cast("binary")) % 20)
    hit = lambda n: F.col("hit") == n
    text = F.when(F.col("hit").isin(0, 1), "").when(hit(2), F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(hit(4), "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(hit(0), 0).when(hit(3), 2).otherwise(1).alias("times"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each conversation after damage and repair; one that has lost all rows has zeros. Cases as in ``repair``."""
    damaged = damage(table(spark, sf_dir, "conversations"))
    found = reports(repair(damaged.where("times > 0")))
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = damaged.groupBy("conv_id").agg(F.sum("times").alias("n")).where("n = 0").select("conv_id", *zero, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return found.unionByName(none)


OP12_SQL = f"""
WITH RECURSIVE plain AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hits AS (SELECT *, {CRC_SQL.format('name')} % 20 AS hit FROM plain),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hits, (SELECT unnest([1, 2]) AS k) WHERE k <= CASE WHEN hit = 0 THEN 0 WHEN hit = 3 THEN 2 ELSE 1 END),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {DIGEST_SQL}) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS bare FROM damaged),
kind AS (SELECT conv_id, turn, i, role, text, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM kind GROUP BY 1),
follows AS (SELECT unnest([0, 0, 1, 2, 3]) AS q, unnest(['s', 'u', 'u', 'a', 'u']) AS r, unnest([1, 2, 2, 3, 2]) AS q2),
named AS (SELECT q, q2, CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END AS role FROM follows WHERE r <> 's'),
put1 AS (SELECT q, q2, 'I' AS edits, chr(10) || role || ':' AS put FROM named),
put2 AS (SELECT a.q, b.q2, 'II' AS edits, a.put || b.put AS put FROM put1 a JOIN put1 b ON b.q = a.q2),
put3 AS (SELECT a.q, b.q2, 'III' AS edits, a.put || b.put AS put FROM put2 a JOIN put1 b ON b.q = a.q2),
puts AS (SELECT unnest([0, 1, 2, 3]) AS q, unnest([0, 1, 2, 3]) AS q2, '' AS edits, '' AS put UNION ALL FROM put1 UNION ALL FROM put2 UNION ALL FROM put3),
search AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'put': ''}} AS best FROM counts
  UNION ALL SELECT * FROM (SELECT conv_id, i, q, min(way) AS best FROM (
    SELECT s.conv_id, k.i, p.q2 AS q, {{'cost': s.best.cost + 5 * length(p.edits) + 2, 'audit': s.best.audit || p.edits || 'D', 'put': s.best.put || p.put}} AS way
      FROM search s JOIN kind k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i + 1 JOIN puts p ON p.q = s.q
    UNION ALL SELECT s.conv_id, k.i, f.q2, {{'cost': s.best.cost + 5 * length(p.edits) + 5 * (k.fault = 'truncated')::BIGINT, 'audit': s.best.audit || p.edits || 'K', 'put': s.best.put || p.put || chr(10) || k.role || ':' || k.text}}
      FROM search s JOIN kind k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i + 1 JOIN puts p ON p.q = s.q JOIN follows f ON f.q = p.q2 AND f.r = left(k.role, 1) WHERE k.fault IN ('', 'truncated')
    UNION ALL SELECT s.conv_id, k.i, f.q2, {{'cost': s.best.cost + 5 * length(p.edits) + 5 * (k.fault = 'truncated')::BIGINT + 1, 'audit': s.best.audit || p.edits || 'R', 'put': s.best.put || p.put || chr(10) || f.role || ':' || k.text}}
      FROM search s JOIN kind k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i + 1 JOIN puts p ON p.q = s.q JOIN named f ON f.q = p.q2 WHERE k.fault IN ('', 'truncated')) GROUP BY 1, 2, 3)),
final AS (SELECT c.conv_id, min({{'cost': s.best.cost + 5 * length(p.edits), 'audit': s.best.audit || p.edits, 'put': s.best.put || p.put}}) AS best
  FROM counts c JOIN search s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n JOIN puts p ON p.q = s.q AND p.q2 IN (0, 3) GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(f.best.cost, 0) AS cost, coalesce(f.best.audit, '') AS audit, sha256(coalesce(substr(f.best.put, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM plain) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id"""
