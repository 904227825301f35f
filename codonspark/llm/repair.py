"""Conversation structure repair: cheapest edits that give a conversation the form ``(s?(ua)+)?``, by a DP shared along a trie.

1. Rows get their faults: blank, duplicate (role and text seen earlier in the conversation) or truncated. What was seen earlier is
   known from one row for each repeated (conversation, role, text), counted with partial aggregation.
2. Each conversation is read in order, as a stream: its rows become a signature, one letter a row for the class of its role and
   fault, and its figures.
3. The distinct signatures are sorted and dealt out by range. A task inserts them in order into a prefix trie, of which it holds the
   path to the present signature only: at each node the DP's layer, computed once for all signatures that share the prefix. A
   terminal node gives cost and audit.
4. Answers join their conversations by signature; the repaired texts are hashed as a stream of rows that follow their answer.

A layer holds for each state of the form (E: nothing yet, S: after the system's row, U: a reply is due, A: complete) the cheapest
cost and the ASCII-least audit that reaches it right after a row's own edit. Such audits of one layer have as many row edits and end in
one, so none of two different ones begins with the other, and their order doesn't change by what follows: an order number and a
link to the layer before stand for the audit, which is spelled at terminal nodes only.

A task holds one letter for each row of the conversation (two references for each node of the path) it works on, never its texts. The
hash of a conversation is one SHA-256 and its audit one string, so a conversation's rows pass through one task in order.

Null roles and texts read as one space; null turns come first; a null conv_id is a conversation of its own. Rows of equal turn are
taken by role and text. An empty table gives no rows, other columns aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, Workspace, join_beside, small_batches, split_limit, spread_join

#: Letters of a signature: must be deleted; then role class system, user, assistant, other, sound in lower case and truncated in upper.
MUST_DELETE = "d"
ROLES = "suao"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Output letters that each state takes, and where they lead.
STEPS = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
DONE = ("E", "A")
#: Rows before a row that inserts can usefully fill: from nothing to a whole exchange.
MOST_INSERTS = 2
#: Bytes of answers that may be broadcast.
BROADCAST_BYTES = 16_000_000
ORDER = ("turn", "role", "text")


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the contract's damage: copies is 0 for dropped rows and 2 for repeated ones."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")) % 20
    role, text = as_text("role"), as_text("text")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _seen_key() -> Column:
    """A key of (conversation, role, text) without what it says."""
    return F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)


def with_faults(rows: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): blank, duplicate, truncated or '' of the first copy of each row.

    Second copies, and rows equal in turn, role and text to the one before, are duplicates too; the stream sees to these.
    """
    keyed = rows.withColumn("seen", _seen_key())
    met = keyed.where("copies > 0").groupBy("seen").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("early"), F.count("*").alias("n"))
    repeated = work.keep(met.where("n > 1").drop("n"), "repeated")
    inner = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(inner == "", "blank").when(F.col("turn").isNotNull() & (F.col("early") | (F.col("turn") > F.col("first"))), "duplicate")
    fault = fault.when(~F.right(inner, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return join_beside(keyed, repeated, "seen", "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _best_moves() -> dict[tuple[str, str], list[tuple[str, int, str]]]:
    """(state, letter) -> [(next state, cost, edits)]: for each next state the cheapest edits, ties ASCII-least."""
    out = {}
    for letter in MUST_DELETE + ROLES + ROLES.upper():
        for state in STEPS:
            best: dict[str, tuple[int, str]] = {}
            at, spent, edits = state, 0, ""
            for _ in range(MOST_INSERTS + 1):
                found = [(at, DELETE_COST, DELETE)]
                if letter != MUST_DELETE:
                    more = TRUNCATED_COST if letter.isupper() else 0
                    if letter.lower() in STEPS[at]:
                        found.append((STEPS[at][letter.lower()], more, KEEP))
                    found += [(to, REROLE_COST + more, REROLE) for role, to in STEPS[at].items() if role != "s"]
                for to, cost, edit in found:
                    best[to] = min(best.get(to, (1 << 60, "")), (spent + cost, edits + edit))
                at, spent, edits = next(to for role, to in STEPS[at].items() if role != "s"), spent + INSERT_COST, edits + INSERT
            out[state, letter] = [(to, cost, edit) for to, (cost, edit) in best.items()]
    return out


MOVES = _best_moves()
#: A layer: (state, cost over the layer's least, order number, state before, edits since) of each state that can be reached.
Layer = tuple[tuple[str, int, int, str, str], ...]
ROOT: Layer = (("E", 0, 0, "", ""),)


@cache
def next_layer(layer: Layer, letter: str) -> tuple[int, Layer]:
    """What the least cost rises by, and the next layer. There are few different layers, so each is worked out and held once."""
    best: dict[str, tuple[int, int, str, str]] = {}
    for state, cost, order, _, _ in layer:
        for to, more, edits in MOVES[state, letter]:
            found = (cost + more, order, edits, state)
            if to not in best or found < best[to]:
                best[to] = found
    least = min(cost for cost, _, _, _ in best.values())
    places = {x: k for k, x in enumerate(sorted({(order, edits) for _, order, edits, _ in best.values()}))}
    return least, tuple((to, cost - least, places[order, edits], state, edits) for to, (cost, order, edits, state) in sorted(best.items()))


def answer(layers: list[Layer], base: int) -> tuple[int, str]:
    """Cost and audit at a terminal node, from the layers on the path to it and the least cost of the last."""
    ends = []
    for state, cost, order, _, _ in layers[-1]:
        at, inserts = state, 0
        while at not in DONE:
            at, inserts = next(to for role, to in STEPS[at].items() if role != "s"), inserts + 1
        ends.append((base + cost + INSERT_COST * inserts, order, INSERT * inserts, state))
    cost, _, tail, state = min(ends)
    edits = [tail]
    for layer in reversed(layers[1:]):
        _, _, _, before, own = next(x for x in layer if x[0] == state)
        edits.append(own)
        state = before
    return cost, "".join(reversed(edits))


class Trie:
    """The path of a prefix trie to the signature that was inserted last; signatures come in sorted order.

    ``computed`` counts the layers that were made: nodes of the trie, not letters of the signatures.
    """

    def __init__(self) -> None:
        self.path, self.layers, self.costs, self.computed = "", [ROOT], array("q", [0]), 0

    def insert(self, signature: str) -> tuple[int, str]:
        shared = len(commonprefix((self.path, signature)))
        del self.layers[shared + 1:], self.costs[shared + 1:]
        for letter in signature[shared:]:
            more, layer = next_layer(self.layers[-1], letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + more)
            self.computed += 1
        self.path = signature
        return answer(self.layers, self.costs[-1])


def repair_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of a table of distinct signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [trie.insert(s) for s in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "cost", "audit"])

    rows = signatures.select("signature").repartitionByRange("signature").sortWithinPartitions("signature")
    return rows.mapInArrow(run, "signature string, cost long, audit string")


LEGAL = {"su", "ua", "au"}


def _letter(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return MUST_DELETE
    at = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return at.upper() if fault == "truncated" else at


def outline(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation, read in order as a stream."""
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
    names = ["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        letters: list[str] = []
        counts: dict[str, int] = {}
        low = high = previous = initial = None
        turns = illegal = 0

        def close() -> tuple:
            gaps = high - low + 1 - turns if turns else 0
            return now, "".join(letters), gaps, counts.get("blank", 0), counts.get("duplicate", 0), counts.get("truncated", 0), illegal

        for batch in batches:
            out = []
            for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or conv != now:
                    if started:
                        out.append(close())
                    now, started = conv, True
                    letters, counts, low, high, previous, initial, turns, illegal = [], {}, None, None, None, None, 0, 0
                for copy in range(copies):
                    own = "duplicate" if fault not in ("blank",) and (copy or previous == (turn, role, text)) else fault
                    counts[own] = counts.get(own, 0) + 1
                    letters.append(_letter(role, own))
                    if initial is not None and initial + role[:1] not in LEGAL:
                        illegal += 1
                    initial = role[:1]
                    if turn is not None and turn != high:
                        turns, low, high = turns + 1, turn if low is None else low, turn
                    previous = (turn, role, text)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(close(), kinds, strict=True)], names)

    ordered = rows.select("conv_id", *ORDER, "copies", "fault").repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return ordered.mapInArrow(run, "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def repaired_rows(edits: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[bytes]:
    """``role:text`` of each output row, given the audit's letters and the damaged rows in order."""
    due = "user"
    for role, text in rows:
        for edit in edits:
            if edit != DELETE:
                own = role if edit == KEEP else due
                yield (own + ":" + ("" if edit == INSERT else text)).encode()
                due = "assistant" if own[:1] == "u" else "user"
            if edit != INSERT:
                break
    for _ in edits:
        yield (due + ":").encode()
        due = "assistant" if due == "user" else "user"


def repaired_hashes(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): each conversation's rows are hashed as a stream that follows its audit."""
    names = ["conv_id", "audit", "repaired_sha256"]
    kinds = [pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        stream, out = flat(), []
        head = next(stream, None)
        while head is not None:
            conv, audit = head[0], head[5]
            head = None

            def own(conv=conv) -> Iterator[tuple[str, str]]:
                nonlocal head
                for row in stream:
                    if row[5] is not None:  # the next conversation's audit
                        head = row
                        return
                    for _ in range(row[4]):
                        yield row[2], row[3]

            digest, first = hashlib.sha256(), True
            for part in repaired_rows(iter(audit), own()):
                digest.update(part if first else b"\n" + part)
                first = False
            out.append((conv, audit, digest.hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    heads = answers.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), "audit", F.lit(0).alias("part"))
    body = rows.select("conv_id", *ORDER, "copies", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("part"))
    ordered = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER)
    return ordered.select("conv_id", *ORDER, "copies", "audit").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def repair(damaged: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``damaged``: (conv_id, turn, role, text, copies), copies being how often the row stands there; a conversation whose rows have
    0 copies only gets zeros, an empty audit and the hash of an empty string.
    """
    work = work or Workspace(damaged.sparkSession, "repair")
    small_batches(damaged.sparkSession)
    found = work.keep(outline(with_faults(damaged, work)), "outline")
    answers = work.keep(repair_signatures(found.select("signature").distinct()), "answers")
    n, held = answers.agg(F.count("*"), F.coalesce(F.sum(F.length("signature") + F.length("audit")), F.lit(0))).first()
    figures = found.join(F.broadcast(answers), "signature") if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else spread_join(found, answers, "signature", split_limit(found.count()))
    figures = work.keep(figures.drop("signature"), "figures")
    hashes = repaired_hashes(damaged, figures).select(F.struct("conv_id").alias("own"), "repaired_sha256")
    rows = figures.join(hashes, F.struct("conv_id") == F.col("own"))
    return rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
