"""Conversation structure repair by one integer minimum.

The turns of a conversation, in order of ``turn`` (nulls first; ties by role, then by
SHA-256 of the text), are edited until the first letters of their roles read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn. Edits are Keep (0), Rerole to
user or assistant (2), Delete (3) and Insert of an empty user or assistant turn (2).
Blank turns and those whose role and text were seen before must be deleted, and a
truncated turn that stays adds 1. The cheapest edits win, and of those the one whose
initials, written in order (the audit), come first in ASCII.

**Method.** The edits are paths through a graph without cycles, whose nodes are a turn
and one of four states (start, after s, after u, after a). Each edge has one integer
weight: its cost in the high digits, and below them the audit letters of its turn, at
the turn's fixed place. A turn has two octal digits, D=1 I=2 K=3 R=4: a letter and a
zero, or I and a letter. Zeros only stand at the end of a place, and a place that
begins with I begins with no other letter, so integers compare as costs and, where
those are equal, as audits do. So the minimum of plain integer sums decides
everything, and dropping the zeros of its low digits gives the audit.

Of a run of edits only those that can be cheapest are edges. Two inserts in a row
lead where none lead, and cost 4 more; from start or after s they lead where a
deletion for 3, or nothing, leads as well. An insert before a deleted turn is also
possible behind it, where its letter comes later, and D is smaller than I.

**Scale.** Conversations of up to ``long_rows`` rows are streamed, sorted, through one
pass. Longer ones are cut into segments of that many rows, wherever they lie in the
table: each segment gives a matrix of least weights between states, and as places are
fixed, matrices combine by comparing their costs, their digits and then the rank of
what follows. So a combination holds one segment at a time, and a conversation with a
third of all rows is spread over as many tasks as it has segments. What grows with a
conversation is its row of the result, which has its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage
from clusterloom.operators.ordered import global_row_number, quoted

#: Rows of a conversation that one step holds in memory.
LONG_ROWS = 4096
#: Long conversations whose keys are shipped to all tasks; more are joined.
SHIPPED_KEYS = 50_000
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR", "0")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the letter of a kept role leads from each state.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
        (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted turn, or one with a new role, leads from each state.
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}

Turn = tuple[str, bool, bool, int]  # initial, must go, truncated, further copies (which must go)


def edges(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """``(from, to, cost, place)`` of all edits of one turn that can be cheapest."""
    found = [(state, state, 3, DELETE << 3) for state in range(4)]
    if must_go:
        return found
    for state in range(4):
        for at, cost, lead in ((state, 0, 0), (GIVEN[state], 2, INSERT)):
            for letter, to, more in (
                (KEEP, KEPT.get((at, initial)), 0), (REROLE, GIVEN[at], 2)
            ):
                if to is not None:
                    place = lead << 3 | letter if lead else letter << 3
                    found.append((state, to, cost + more + truncated, place))
    return found


def n_places(turns: list[Turn]) -> int:
    return sum(1 + copies for *_, copies in turns)


def least_weights(turns: list[Turn], ends: dict[int, int], width: int) -> dict[int, int]:
    """Least weight from each state before ``turns`` to an end; ``ends``: weights there.

    ``width`` is the number of bits below the cost. The last turn's place lies above
    the lowest three bits times two, which are those of the end.
    """
    known: dict[tuple, list] = {}
    best, shift = ends, 6
    for initial, must_go, truncated, copies in reversed(turns):
        if copies:  # equal turns behind their first one: deletions without another way
            repeated = (DELETE << 3) * (((1 << 6 * copies) - 1) // 63)
            best = {p: v + (3 * copies << width) + (repeated << shift) for p, v in best.items()}
            shift += 6 * copies
        kind = (initial, must_go, truncated)
        if kind not in known:
            known[kind] = edges(*kind)
        before: dict[int, int] = {}
        for p, q, cost, place in known[kind]:
            if q in best:
                weight = best[q] + (cost << width) + (place << shift)
                if p not in before or weight < before[p]:
                    before[p] = weight
        best, shift = before, shift + 6
    return best


def end_weights(width: int) -> dict[int, int]:
    """At the end: nothing to add, or one inserted assistant."""
    return {START: 0, ASSISTANT: 0, USER: (2 << width) + (INSERT << 3)}


def places_of(weight: int, n: int, width: int) -> str:
    """The low digits as two octal digits for each of ``n`` turns, and two for the end."""
    return format(weight & ((1 << width) - 1), "o").zfill(2 * n + 2)


def cheapest(turns: list[Turn]) -> tuple[int, str]:
    """``(cost, places)`` of a whole conversation."""
    n = n_places(turns)
    width = 6 * n + 6
    weight = least_weights(turns, end_weights(width), width)[START]
    return weight >> width, places_of(weight, n, width)


def edited(rows: list[tuple[bytes, bytes, int]], places: str, state: int) -> tuple[list, int]:
    """``(edit, role, text)`` of all turns that ``places`` leave, and the state after them.

    ``rows`` are role, text and copies. Places beyond the rows are those of the end.
    """
    turns, at = [], 0

    def put(digit: str, role: bytes, text: bytes) -> None:
        nonlocal state
        if digit == "2":
            state = GIVEN[state]
            turns.append(("I", ROLES[state], b""))
        elif digit == "3":
            state = KEPT[state, role[:1].decode("latin-1")]
            turns.append(("K", role, text))
        elif digit == "4":
            state = GIVEN[state]
            turns.append(("R", ROLES[state], text))

    for role, text, copies in rows:
        for digit in places[at:at + 2]:
            put(digit, role, text)
        at += 2 * copies
    for digit in places[at:]:
        put(digit, b"", b"")
    return turns, state


# --- rows ------------------------------------------------------------------


def _faults(rows: list[tuple[bytes, bytes, int, bool]]) -> tuple[list[Turn], dict[str, int]]:
    """Turns to be repaired, and counts. ``rows``: role, text, copies, seen before."""
    counts = dict.fromkeys(FAULTS, 0)
    turns, last = [], None
    for role, text, copies, seen in rows:
        said = text.rstrip(WHITE)
        truncated = bool(said) and not seen and said[-1:] not in (b".", b"!", b"?")
        counts["blank"] += 0 if said else copies
        counts["duplicate"] += (copies if seen else copies - 1) if said else 0
        counts["truncated"] += truncated
        initial = role[:1].decode("latin-1")
        if last is not None:
            counts["illegal"] += last + initial not in LEGAL
        counts["illegal"] += copies - 1  # no letter may follow itself
        last = initial
        turns.append((initial, seen or not said, truncated, copies - 1))
    return turns, counts


FAULTS = ("blank", "duplicate", "truncated", "illegal")
NUMBERS = ("gaps", *FAULTS, "cost", "audit")
TURNS = "array<struct<edit:string,role:binary,text:binary>>"
_LONGS = ", ".join(f"{c} bigint" for c in FAULTS)
RESULT = (
    f"key string, segment bigint, n_segments bigint, gaps bigint, {_LONGS}, cost bigint, audit string, turns {TURNS}"
)
MATRIX = (
    f"key string, segment bigint, n bigint, first string, last string, {_LONGS}, ends array<int>, weights array<binary>"
)
CHOICE = f"key string, segment bigint, state int, places string, cost bigint, {_LONGS}"
SEGMENT = f"key string, segment bigint, turns {TURNS}"


_TURN = pa.struct([("edit", pa.string()), ("role", pa.binary()), ("text", pa.binary())])
ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()),
    "array<binary>": pa.list_(pa.binary()), TURNS: pa.list_(_TURN),
}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(", "))])


ROWS_PER_BATCH, BYTES_PER_BATCH = 2048, 16 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; the last column of a row says its bytes."""
    held, size = [], 0
    for *row, n_bytes in rows:
        held.append(row)
        size += n_bytes
        if len(held) >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _as_turns(turns: list[tuple]) -> list[dict]:
    return [{"edit": e, "role": r, "text": t} for e, r, t in turns]


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations whose rows ``(key, turn, role, text, copies)`` come sorted."""

    def repaired() -> Iterator[tuple]:
        for key, group in groupby(_rows(batches), key=lambda r: r[0]):
            rows, numbers, seen = [], set(), set()
            for _, turn, role, text, copies in group:
                if copies:
                    rows.append((role, text, copies, (role, text) in seen))
                    seen.add((role, text))
                    if turn is not None:
                        numbers.add(turn)
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            turns, counts = _faults(rows)
            cost, places = cheapest(turns)
            left, _ = edited([r[:3] for r in rows], places, START)
            yield (
                key, 0, 1, gaps, *counts.values(), cost, places.translate(LETTERS), _as_turns(left),
                sum(len(text) for _, _, text in left),
            )

    return _batches(repaired(), _arrow(RESULT))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least weights between states for each segment of sorted rows.

    Rows are ``(key, segment, initial, blank, truncated, seen, copies)``. Entry ``4 p + q``
    is for the way from state p to state q.
    """

    def matrices() -> Iterator[tuple]:
        for (key, segment), group in groupby(_rows(batches), key=lambda r: r[:2]):
            turns, counts, last = [], [0, 0, 0, 0], None
            for _, _, initial, blank, cut, seen, copies in group:
                cut = cut and not seen
                counts[0] += copies if blank else 0
                counts[1] += 0 if blank else copies if seen else copies - 1
                counts[2] += cut
                counts[3] += copies - 1 + (last is not None and last + initial not in LEGAL)
                first, last = turns[0][0] if turns else initial, initial
                turns.append((initial, blank or seen, cut, copies - 1))
            n = n_places(turns)
            width = 6 * n + 6
            ends, weights = [], []
            for q in range(4):
                for p, weight in sorted(least_weights(turns, {q: 0}, width).items()):
                    ends.append(4 * p + q)
                    weights.append(weight.to_bytes((weight.bit_length() + 7) // 8, "big"))
            yield key, segment, n, first, last, *counts, ends, weights, sum(map(len, weights))

    return _batches(matrices(), _arrow(MATRIX))


def _best_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chooses each segment's states, from segments sorted by key and downwards.

    From the end backwards, a state before a segment takes the smallest of cost, the
    segment's digits and the rank of the state behind it, again as one integer. For
    each segment four such choices are kept until its conversation is done.
    """

    def ways() -> Iterator[tuple]:
        for key, group in groupby(_rows(batches), key=lambda r: r[0]):
            # of a state: cost and rank of all that follows; at the end they are those of the last place
            ends = end_weights(6)
            costs = {p: w >> 6 for p, w in ends.items()}
            ranks = {p: bool(w & 63) for p, w in ends.items()}
            kept, following = [], None
            for _, segment, n, first, last, *counts, at, weights in group:
                counts[3] += following is not None and last + following not in LEGAL
                following, width = first, 6 * n + 6
                best: dict[int, tuple[int, int, int]] = {}
                for entry, packed in zip(at, weights):
                    p, q = divmod(entry, 4)
                    if q in costs:
                        own = int.from_bytes(packed, "big")
                        # the six bits of the end are free here: the rank goes there
                        weight = own + (costs[q] << width) + ranks[q]
                        if p not in best or weight < best[p][0]:
                            best[p] = weight, q, own
                costs = {p: weight >> width for p, (weight, _, _) in best.items()}
                lows = {p: weight & ((1 << width) - 1) for p, (weight, _, _) in best.items()}
                order = sorted(set(lows.values()))
                ranks = {p: order.index(low) for p, low in lows.items()}
                kept.append((segment, n, counts, {
                    p: (q, places_of(own, n, width)[:-2], own >> width) for p, (_, q, own) in best.items()}))
            state = START
            for segment, n, counts, ways_on in reversed(kept):
                behind, places, cost = ways_on[state]
                if segment == kept[0][0]:  # the last segment also has the place of the end
                    weight = ends[behind]
                    places, cost = places + format(weight & 63, "o").zfill(2), cost + (weight >> 6)
                yield key, segment, state, places, cost, *counts, len(places)
                state = behind

    return _batches(ways(), _arrow(CHOICE))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits segments whose places come as the first row of each."""

    def done() -> Iterator[tuple]:
        for (key, segment), group in groupby(_rows(batches), key=lambda r: r[:2]):
            _, _, _, state, places, *_ = next(group)
            turns, _ = edited([(role, text, copies) for *_, role, text, copies in group], places, state)
            yield key, segment, _as_turns(turns), sum(len(t) for _, _, t in turns)

    return _batches(done(), _arrow(SEGMENT))


def _prepared(turns: DataFrame, copies: Column | None) -> DataFrame:
    """Own columns only; the key tells a null id from any other."""
    conv = quoted("conv_id")
    return turns.select(
        F.when(conv.isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), conv.cast("string"))).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).cast("binary").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).cast("binary").alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )


def _long_conversations(rows: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame]:
    """Conversations beyond ``long_rows``: their numbers, and the turns of each segment."""
    once = rows.filter("copies > 0").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = once.withColumn("digest", F.sha2("text", 256))
    firsts = said.groupBy("key", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    end = F.rtrim(F.col("text").cast("string"), F.lit(WHITE.decode()))
    closed = F.endswith(end, F.lit(".")) | F.endswith(end, F.lit("!")) | F.endswith(end, F.lit("?"))
    blank = F.octet_length(end) == 0
    narrow = said.select("key", "turn", "role", "digest", "copies", blank.alias("blank"), (~closed & ~blank).alias("cut"))
    narrow = narrow.join(firsts, ["key", "role", "digest"]).select(
        "key", "turn", "role", "digest", "copies", "blank", "cut",
        (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("seen"),
    )
    numbered = cut_lineage(
        global_row_number(narrow, ["key", "turn", "role", "digest"], "n").withColumn(
            "segment", F.floor((F.col("n") - 1) / long_rows)
        )
    )
    initial = F.decode(F.substring("role", 1, 1), "ISO-8859-1")
    dealt = numbered.repartition("key", "segment").sortWithinPartitions("key", "segment", "n")
    matrices = dealt.select("key", "segment", initial, "blank", "cut", "seen", "copies").mapInArrow(_matrices, MATRIX)
    downwards = matrices.repartition("key").sortWithinPartitions("key", F.desc("segment"))
    choices = cut_lineage(downwards.mapInArrow(_best_ways, CHOICE))
    same = (
        (F.col("s.key") == F.col("n.key")) & F.col("s.turn").eqNullSafe(F.col("n.turn"))
        & (F.col("s.role") == F.col("n.role")) & (F.col("s.digest") == F.col("n.digest"))
    )
    placed = said.alias("s").join(numbered.alias("n"), same).select(
        "s.key", "segment", F.col("n.n").alias("n"), F.lit(None).cast("int").alias("state"),
        F.lit(None).cast("string").alias("places"), "s.role", "text", "s.copies",
    )
    nothing = F.lit(b"")
    heads = choices.select(
        "key", "segment", F.lit(0).cast("long").alias("n"), "state", "places",
        nothing.alias("role"), nothing.alias("text"), F.lit(0).cast("long").alias("copies"),
    )
    parts = placed.unionByName(heads).repartition("key", "segment").sortWithinPartitions("key", "segment", "n")
    segments = parts.mapInArrow(_segments, SEGMENT)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.filter("copies > 0").groupBy("key").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    in_order = F.array_sort(F.collect_list(F.struct("segment", "places")))
    audit = F.array_join(F.transform(in_order, lambda s: F.translate(s["places"], "12340", "DIKR")), "")
    sums = choices.groupBy("key").agg(
        F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n_segments"),
        *[F.sum(c).alias(c) for c in FAULTS], F.sum("cost").alias("cost"), audit.alias("audit"),
    )
    return sums.join(gaps, "key").select("key", "segment", "n_segments", *NUMBERS), segments


def _both_kinds(turns: DataFrame, copies: Column | None, long_rows: int):
    """Short conversations with all columns; numbers and segments of long ones, if any."""
    rows = _prepared(turns, copies)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    long_keys = cut_lineage(sizes.filter(F.col("n") > long_rows).select("key"))
    n_long = long_keys.count()
    short = rows
    keys = F.broadcast(long_keys) if n_long <= SHIPPED_KEYS else long_keys
    if n_long:
        short = rows.join(keys, "key", "left_anti")
    ordered = short.repartition("key").sortWithinPartitions("key", "turn", "role", F.sha2("text", 256))
    whole = ordered.mapInArrow(_whole_conversations, RESULT)
    return whole, _long_conversations(rows.join(keys, "key"), long_rows) if n_long else None


def _with_id(result: DataFrame, kind: str) -> DataFrame:
    conv = F.when(F.startswith("key", F.lit("i")), F.expr("substring(key, 2)").cast(kind))
    return result.select(conv.alias("conv_id"), *[c for c in result.columns if c != "key"])


def repair_conversations(
    turns: DataFrame, copies: Column | None = None, long_rows: int = LONG_ROWS
) -> DataFrame:
    """Repaired conversations of ``turns (conv_id, turn, role, text)``.

    Returns ``(conv_id, segment, n_segments, gaps, blank, duplicate, truncated, illegal,
    cost, audit, turns)``, where ``turns`` are the repaired ``(edit, role, text)`` in order;
    edits are K, R and I. A conversation of more than ``long_rows`` rows has its turns in
    ``n_segments`` rows, by ascending ``segment``; the other columns stand in the first and
    are null in the rest. ``gaps`` is how many numbers are missing between its turn numbers,
    ``illegal`` how many neighbours have role letters other than su, ua and au. Each row
    counts for its first fault of blank, duplicate and truncated.

    ``copies`` says how often a row occurs; with 0, a row only names its conversation. A
    conversation without rows gives zeros, an empty audit and no turns. Null roles and
    texts are one space, a null ``conv_id`` is a conversation of its own and null turns
    come first. A role that is empty or begins otherwise than s, u or a cannot be kept.
    Rows equal in all columns are a turn and its duplicates. Bytes that are no UTF-8 stay
    as they are. Empty tables give empty results; further columns are not looked at.
    """
    whole, long = _both_kinds(turns, copies, long_rows)
    if long:
        numbers, segments = long
        later = segments.join(numbers, ["key", "segment"], "left")
        whole = whole.unionByName(later.select(*whole.columns))
    text = F.transform("turns", lambda t: F.struct(
        t["edit"].alias("edit"), t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text")
    ))
    return _with_id(whole.withColumn("turns", text), dict(turns.dtypes)["conv_id"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of pieces ``(key, piece)`` that come sorted, with a line feed between them."""

    def digests() -> Iterator[tuple]:
        for key, group in groupby(_rows(batches), key=lambda r: r[0]):
            state, begun = hashlib.sha256(), False
            for _, piece in group:
                if piece is not None:
                    state.update(b"\n" * begun + piece)
                    begun = True
            yield key, state.hexdigest(), 0

    return _batches(digests(), _arrow("key string, repaired_sha256 string"))


def repair_digests(
    turns: DataFrame, copies: Column | None = None, long_rows: int = LONG_ROWS
) -> DataFrame:
    """One row for each conversation: its numbers, its audit and ``repaired_sha256``.

    As :func:`repair_conversations`, but with the digest of the repaired ``role:text``,
    joined by line feeds, instead of the turns. That of a long conversation is taken from
    its segments as a sorted stream, since a digest has to read its text in order.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"].cast("string"), F.lit(":"), t["text"].cast("string"))), "\n")
    whole, long = _both_kinds(turns, copies, long_rows)
    result = whole.select("key", *NUMBERS, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    if long:
        numbers, segments = long
        pieces = segments.select("key", "segment", F.when(F.size("turns") > 0, lines.cast("binary")).alias("piece"))
        ordered = pieces.repartition("key").sortWithinPartitions("key", "segment").select("key", "piece")
        digests = ordered.mapInArrow(_hashed, "key string, repaired_sha256 string")
        result = result.unionByName(numbers.join(digests, "key").select(*result.columns))
    return _with_id(result, dict(turns.dtypes)["conv_id"])


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """``conversations`` with planted faults, and how often each row then occurs.

    By crc32 of ``conv_id:turn`` modulo 20 a row goes (0), loses its text (1) or its
    sentence marks (2), occurs twice (3) or becomes the user's (4); nulls are one space.
    """

    def text(name: str) -> Column:
        return F.coalesce(quoted(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(code == 4, "user").otherwise(text("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    ), F.col("copies")
