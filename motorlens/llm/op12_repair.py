"""Conversation structure repair: the cheapest edits that make roles alternate, for each conversation, through a trie of signatures.

``damaged`` makes the faulty rows. A row's first fault counts: blank (nothing but white space), duplicate (its role and text came
earlier), truncated (it doesn't end in ``.``, ``!`` or ``?``). ``signatures`` makes one letter of each row, in
order: ``D`` for what must go, else the role's class, large where truncated. Everything about edits depends on that
string alone, so the different ones are solved once each.

``solved``: the strings, read from their ends, are sorted, dealt in ranges and inserted into a prefix trie, of which a task holds
the branch it is on. A layer of the dynamic program holds, for each state of ``(s?(ua)+)?``, the cheapest edits of the rows below and,
among equally cheap ones, the least text of their initials; a layer is made once for each prefix that strings share and the
answer is emitted where a string ends. Going from the last row to the first, texts grow in front, so their order is kept:
a layer needs their ranks only. Layers that differ by a cost for all states are one, so there are few kinds, and a node of the
branch is a number and a cost.

``repaired``: the edits travel to the rows of their conversation, ahead of them, and the repaired rows are hashed as they pass.

Defined results: null roles and texts are one blank; a null conv_id is a conversation; null turns come first and don't count as gaps;
rows that share a turn are in order of role and the MD5 of the text; equal rows are counted as often as they come (all but one duplicates);
an empty table gives no rows; extra columns are ignored. Very long conversations pass through one task in order, batch by batch (their
edits are one text and their hash one sequence); it holds a byte or two for each row of the conversation at hand, not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, small_batches, table

INSERT = REROLE = 2
DELETE = 3
TRUNCATED = 1
#: White space of the contract, and the ends of a whole sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States of (s?(ua)+)?: nothing yet, after s, after u, after a.
NONE, S, U, A = range(4)
#: From each state: where one user or assistant leads, whichever may come.
TURN = {NONE: U, S: U, U: A, A: U}
#: Where a row of that class leads, if it may come at all.
KEEP = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}, "o": {}}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): different rows after damage by crc32 of ``conv_id:turn``."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(as_text("text"), ENDS, "")).otherwise(as_text("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(as_text("role"))
    hurt = rows.select("conv_id", "turn", "role", "text", kind.alias("_k")).where("_k <> 0")
    hurt = hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_k") == 3, 2).otherwise(1).alias("copies"))
    return hurt.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def judged(rows: DataFrame) -> DataFrame:
    """Rows of ``damaged`` with what a signature needs: ``h`` (order within a turn), ``initial``, ``letter`` of the first copy and ``gone``, copies that
    must go; counts of faults."""
    rows = rows.withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))
    earlier = Window.partitionBy("conv_id", "role", "h").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("fresh", F.row_number().over(earlier) == 1)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    blank, cut = bare == "", ~F.right(bare, F.lit(1)).isin(*ENDS)
    first = F.col("fresh") & ~blank
    gone = F.col("copies") - first.cast("long")
    letter = F.when(cut, F.upper(_initial())).otherwise(_initial())
    return rows.select("conv_id", "turn", "role", "h", "text", "copies", _initial().alias("initial"), letter.alias("letter"), gone.alias("gone"), F.when(blank, F.col("copies")).otherwise(0).alias("blank"), F.when(blank, 0).otherwise(F.col("gone")).alias("duplicate"), F.when(first & cut, 1).otherwise(0).alias("truncated"))


_ORDER = ["conv_id", "turn", "role", "h"]  # ascending, nulls first
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


class _Conversation:
    """What is known of the conversation that is being read, run of rows by run of rows."""

    def __init__(self, conv_id):
        self.conv_id, self.letters, self.counts = conv_id, [], np.zeros(3, np.int64)
        self.illegal, self.last, self.low, self.high, self.turns = 0, None, None, None, 0

    def add(self, letters: bytes, initials: np.ndarray, turns: np.ndarray, counts: np.ndarray) -> None:
        self.letters.append(letters)
        self.counts += counts
        if self.last is not None:
            initials = np.concatenate([[self.last], initials])
        pair = initials[:-1].astype(np.int64) << 8 | initials[1:]
        self.illegal += int((~np.isin(pair, _LEGAL)).sum())
        self.last = initials[-1]
        if len(turns):
            self.turns += int((turns[1:] != turns[:-1]).sum()) + (self.high is None or turns[0] != self.high)
            self.low = int(turns[0]) if self.low is None else self.low
            self.high = int(turns[-1])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, b"".join(self.letters).decode(), gaps, *self.counts.tolist(), self.illegal)


#: Neighbours that may stand together.
_LEGAL = [a << 8 | b for a, b in (b"su", b"ua", b"au")]


def _codes(column: pa.Array) -> np.ndarray:
    """The one ASCII letter of each row."""
    return np.frombuffer(b"".join(x.encode() for x in column.to_pylist()), np.uint8)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation of ``judged``."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def out(done: list[_Conversation], like: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*(c.row() for c in done)))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], like), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["conv_id", "signature", *_FACTS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, like = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, like, done = batch.column("conv_id"), batch.schema.field("conv_id").type, []
            key = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
            start = np.flatnonzero(np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]))
            copies, gone = batch.column("copies").to_numpy(), batch.column("gone").to_numpy()
            letters, initials = _codes(batch.column("letter")), _codes(batch.column("initial"))
            turn, no_turn = np.asarray(batch.column("turn").fill_null(0)), np.asarray(batch.column("turn").is_null())
            counts = np.stack([batch.column(c).to_numpy() for c in _FACTS[1:4]], 1)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), batch.num_rows]):
                conv_id = ids[a].as_py()
                if now is None or now.conv_id != conv_id:
                    done += [now] if now else []
                    now = _Conversation(conv_id)
                run = np.stack([letters[a:b], np.full(b - a, ord("D"), np.uint8)], 1).ravel()
                run = np.repeat(run, np.stack([copies[a:b] - gone[a:b], gone[a:b]], 1).ravel())
                now.add(run.tobytes(), np.repeat(initials[a:b], copies[a:b]), turn[a:b][~no_turn[a:b]], counts[a:b].sum(0))
            if done:
                yield out(done, like)
        if now:
            yield out([now], like)

    light = rows.drop("text").repartition("conv_id").sortWithinPartitions(*_ORDER)
    return light.mapInArrow(read, f"conv_id {kind}, signature string, " + ", ".join(f"{c} long" for c in _FACTS))


# ---------------------------------------------------------------- trie of signatures


class Layers:
    """The kinds of layers. A layer: for each state the cost beyond the least one, and the rank of the text of initials."""

    def __init__(self):
        self.kinds: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        ends = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]  # of NONE, S, U, A: a last user or assistant, or both
        self.ends = [text for _, text in ends]
        self.last, _ = self._kind([cost for cost, _ in ends], [(text, 0) for _, text in ends])

    def _kind(self, costs: list[int], texts: list[tuple[str, int]]) -> tuple[int, int]:
        ranks = {t: i for i, t in enumerate(sorted(set(texts)))}
        kind = tuple((c - min(costs), ranks[t]) for c, t in zip(costs, texts))
        if kind not in self.number:
            self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        return self.number[kind], min(costs)

    def step(self, below: int, letter: str) -> tuple[int, int, tuple]:
        """The layer with one more row in front: its kind, the cost it adds, and for each state (initials, next state)."""
        if (below, letter) not in self.steps:
            kind, more = self.kinds[below], TRUNCATED if letter in "SUAO" else 0
            found = []
            for state in (NONE, S, U, A):
                ways, at = [], state
                for inserts in range(3):  # a third would lead where the first did
                    edits = [(DELETE, "D", at)]
                    if letter != "D":
                        edits.append((REROLE + more, "R", TURN[at]))
                        if at in KEEP[letter.lower()]:
                            edits.append((more, "K", KEEP[letter.lower()][at]))
                    ways += [(INSERT * inserts + cost + kind[to][0], "I" * inserts + edit, kind[to][1], to) for cost, edit, to in edits]
                    at = TURN[at]
                found.append(min(ways))
            number, added = self._kind([w[0] for w in found], [w[1:3] for w in found])
            self.steps[below, letter] = number, added, tuple((w[1], w[3]) for w in found)
        return self.steps[below, letter]


class Branch:
    """The branch of the trie that leads to the string at hand; strings come sorted, and read from their ends."""

    def __init__(self, layers: Layers | None = None):
        self.layers = layers or Layers()
        self.letters, self.kinds, self.costs = "", [self.layers.last], [0]
        self.made = 0

    def solve(self, word: str) -> tuple[int, str]:
        """Cost and initials of the cheapest edits of the rows that ``word`` (last row first) stands for."""
        shared = _common(self.letters, word)
        del self.kinds[shared + 1 :], self.costs[shared + 1 :]
        for letter in word[shared:]:
            kind, added, _ = self.layers.step(self.kinds[-1], letter)
            self.kinds.append(kind)
            self.costs.append(self.costs[-1] + added)
            self.made += 1
        self.letters = word
        state, out = NONE, []
        for i in range(len(word), 0, -1):
            text, state = self.layers.step(self.kinds[i - 1], word[i - 1])[2][state]
            out.append(text)
        return self.costs[-1] + self.layers.kinds[self.kinds[-1]][NONE][0], "".join(out) + self.layers.ends[state]


def _common(a: str, b: str) -> int:
    """Length of the longest shared prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 1:
        mid = (low + most) // 2
        low, most = (mid, most) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def solved(words: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each different signature."""

    def answer(batches):
        branch = Branch()
        for batch in batches:
            found = [(w[::-1], *branch.solve(w)) for w in batch.column("word").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], names=["signature", "cost", "audit"])

    dealt = words.select(F.reverse("signature").alias("word")).distinct().repartitionByRange("word").sortWithinPartitions("word")
    return dealt.mapInArrow(answer, "signature string, cost long, audit string")


# ---------------------------------------------------------------- repaired conversations


class _Repair:
    """Hash of a conversation's repaired rows, as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.some = audit, 0, NONE, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode())
        self.some = True

    def _turned(self) -> str:
        role = "assistant" if self.state == U else "user"
        self.state = TURN[self.state]
        return role

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(self._turned(), "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self._put(role, text)
                self.state = KEEP[role[:1]][self.state]
            elif edit == "R":
                self._put(self._turned(), text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repaired(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` (a row for each conversation, with ``audit``) and the hash of its repaired rows."""
    names = heads.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, repair = None, None
        for batch in batches:
            done, marks = [], np.asarray(batch.column("mark"))
            role, text, copies = (batch.column(c).to_pylist() for c in ("role", "text", "copies"))
            for i, mark in enumerate(marks.tolist()):
                if mark:
                    repair.row(role[i], text[i], copies[i])
                    continue
                if head is not None:
                    done.append((head, repair.digest()))
                head = batch.column("head").slice(i, 1)
                repair = _Repair(head.field("audit")[0].as_py())
            if done:
                yield out(done)
        if head is not None:
            yield out([(head, repair.digest())])

    def out(done: list) -> pa.RecordBatch:
        whole = pa.concat_arrays([h for h, _ in done])
        return pa.RecordBatch.from_arrays([*(whole.field(c) for c in names), pa.array([d for _, d in done])], names=[*names, "repaired_sha256"])

    tops = heads.select("conv_id", F.lit(0).alias("mark"), F.struct(*names).alias("head"))
    both = tops.unionByName(rows.select("conv_id", F.lit(1).alias("mark"), "turn", "role", "h", "text", "copies"), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "mark", *_ORDER[1:])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads.schema)
    return both.select("mark", "head", "role", "text", "copies").mapInArrow(read, f"{fields}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``: its faults, the cost and initials of its edits, and the hash of what they give."""
    small_batches(conversations.sparkSession, 1024)
    rows = saved(judged(damaged(conversations)), "rows")
    facts = saved(signatures(rows), "signatures")
    found = facts.join(solved(facts), "signature").select("conv_id", *_FACTS, "cost", "audit")
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    heads = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    heads = heads.select(F.col("_conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*_FACTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    return repaired(rows, heads)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------- DuckDB text


def _oracle() -> str:
    """The dynamic program stated apart: from the last row to the first, the cheapest (cost, initials, repaired text) of each state."""
    lines = {NONE: "user:", S: "user:", U: "assistant:", A: "user:"}

    def option(cost: str, text: str, out: str, to: int, when: str = "true") -> str:
        return f"{{'c': CASE WHEN {when} THEN {cost} + f[{to + 1}].c ELSE 1000000000 END, 's': {text} || f[{to + 1}].s, 'r': {out} || f[{to + 1}].r}}"

    states = []
    for state in (NONE, S, U, A):
        ways, at, out = [], state, ""
        for n in range(3):
            front, put = f"'{'I' * n}", f"'{out}' || "
            ways.append(option(f"{2 * n + 3}", f"{front}D'", f"'{out}'", at))
            ways.append(option(f"{2 * n + 2} + cut", f"{front}R'", f"{put}'{lines[at]}' || text || chr(10)", TURN[at], "NOT gone"))
            ways += [option(f"{2 * n} + cut", f"{front}K'", f"{put}role || ':' || text || chr(10)", to, f"NOT gone AND role[1] = '{letter}'") for letter, way in KEEP.items() if at in way for to in [way[at]]]
            out += lines[at] + "\n"
            at = TURN[at]
        states.append(f"list_min([{', '.join(ways)}])")
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS k FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, k, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS role_before FROM placed),
rows_ AS (SELECT *, bare = '' OR again AS gone, CASE WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut, max(pos) OVER (PARTITION BY conv_id) AS n FROM seen),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (bare = '') AS blank, count(*) FILTER (bare <> '' AND again) AS duplicate, count(*) FILTER (bare <> '' AND NOT again AND cut = 1) AS truncated, count(*) FILTER (pos > 1 AND role_before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, n + 1 AS pos, [{{'c': 0, 's': '', 'r': ''}}, {{'c': 4, 's': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}}, {{'c': 2, 's': 'I', 'r': 'assistant:' || chr(10)}}, {{'c': 0, 's': '', 'r': ''}}] AS f FROM rows_ WHERE pos = n
  UNION ALL
  SELECT w.conv_id, r.pos, [{', '.join(states)}] FROM walk w JOIN rows_ r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.pos - 1)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f[1].c, 0)::BIGINT AS cost, coalesce(f[1].s, '') AS audit, sha256(coalesce(left(f[1].r, greatest(length(f[1].r) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN facts x ON e.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN walk w ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = 1
"""


ORACLE = _oracle()
