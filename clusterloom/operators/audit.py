"""Process trees from audit-log records.

A record is one text line.  Lines of one event share the ``audit(time:serial)``
stamp, which also gives the order of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import stored
from clusterloom.operators.tree import preorder

# The two system calls by architecture (x86-64, x86, arm64), which
# alone says what a number means; logs that were interpreted have names instead.
EXIT_CALLS = {"c000003e": "231", "40000003": "252", "c00000b7": "94"}
EXEC_CALLS = {"c000003e": "59", "40000003": "11", "c00000b7": "221"}
EXIT_NAME, EXEC_NAME = "exit_group", "execve"

# The fields read from a record.
PATTERNS = {
    "type": r"^type=([A-Z_]+) ",
    "event_time": r" msg=audit\(([0-9]+\.[0-9]+):[0-9]+\)",
    "serial": r" msg=audit\([0-9]+\.[0-9]+:([0-9]+)\)",
    "arch": r" arch=([^ ]+)",
    "syscall": r" syscall=([^ ]+)",
    "ppid": r" ppid=([0-9]+)",
    "pid": r" pid=([0-9]+)",
    "auid": r" auid=([0-9]+)",
    "euid": r" euid=([0-9]+)",
    "exe": r' exe="([^"]+)"',
    "domain": r" subj=[^: ]+:[^: ]+:([^: ]+)",
    "argc": r" argc=([0-9]+)",
}
# One argument: its number, and a text in quotes or, if it has blanks, quotes or
# bytes beyond ASCII, its bytes as hexadecimal digits.
ARGUMENT = r' a([0-9]+)=("[^"]*"|[0-9A-F]+)(?= |$)'

# The same, or a piece of a long argument: its number, the piece's, and the text.
PIECE = r' a([0-9]+)(?:\[([0-9]+)\])?=("[^"]*"|[0-9A-F]+)(?= |$)'

_NUMBERS = {"serial": "bigint", "ppid": "bigint", "pid": "bigint", "auid": "bigint",
            "euid": "bigint", "argc": "int", "event_time": "decimal(18,3)"}


def audit_parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed columns of every line; ``malformed`` marks lines without type or stamp.

    A field that a record does not have is null.  ``args`` are the arguments after
    the program name in quotes, by number, empty when there are none; those that
    the log has as hexadecimal digits are decoded.
    """
    def found(name: str) -> Column:
        text = F.regexp_extract(value, PATTERNS[name], 1)
        if name not in ("type", "event_time", "serial"):
            # a search that finds nothing reads the whole line: skip what cannot be there
            text = F.when(F.col("type") == "EXECVE" if name == "argc" else ~F.col("type").isin("", "EXECVE"), text)
        return text.alias(name)

    def field(name: str) -> Column:
        # what was searched is a column here, so that no search is made twice
        return (F.col(name).try_cast(_NUMBERS[name]) if name in _NUMBERS else F.nullif(name, F.lit(""))).alias(name)

    texts = lines.select(value, found("type")).select(
        "type", *[found(n) for n in PATTERNS if n != "type"],
        F.when(F.col("type") == "EXECVE", arguments(F.col(value))).alias("args"),
    )
    return texts.select(
        *map(field, PATTERNS), "args",
        (F.nullif("type", F.lit("")).isNull() | field("serial").isNull()).alias("malformed"),
    )


def arguments(line: Column) -> Column:
    """The arguments of an EXECVE line from number 1 on, each in quotes."""
    numbers = F.regexp_extract_all(line, F.lit(ARGUMENT), F.lit(1))
    texts = F.regexp_extract_all(line, F.lit(ARGUMENT), F.lit(2))
    found = F.zip_with(numbers, texts, lambda n, t: F.struct(n.cast("int").alias("n"), t.alias("t")))

    def shown(argument: Column) -> Column:
        decoded = F.make_valid_utf8(F.unhex(argument["t"]).cast("string"))
        return F.when(F.startswith(argument["t"], F.lit('"')), argument["t"]).otherwise(
            F.concat(F.lit('"'), decoded, F.lit('"'))
        )

    after_program = F.array_sort(F.filter(found, lambda a: a["n"] >= 1))
    return F.array_join(F.transform(after_program, shown), " ")


def event_arguments(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(event_time, serial, args)`` of every event that has EXECVE records.

    A long argument is logged in pieces, ``a1[0]=… a1[1]=…``, and these may be spread over
    several records of one event, which need not be neighbours in the log: pieces are
    brought together by event and number, joined in order and decoded as a whole, since a
    character may be cut between two of them. ``args`` are the arguments after the program
    name in quotes, by number, as :func:`audit_parse` gives them for one record.
    """
    def found(group: int) -> Column:
        return F.regexp_extract_all(F.col(value), F.lit(PIECE), F.lit(group))

    stamp = [
        F.regexp_extract(value, PATTERNS[name], 1).cast(_NUMBERS[name]).alias(name) for name in ("event_time", "serial")
    ]
    records = lines.filter(F.col(value).rlike(r"^type=EXECVE msg=audit\([0-9]+\.[0-9]+:[0-9]+\)"))
    found_in = records.select(*stamp, found(1).alias("number"), found(2).alias("piece"), found(3).alias("text"))
    each = found_in.select(
        "event_time", "serial", F.explode_outer(F.arrays_zip("number", "piece", "text")).alias("p")
    ).select(
        "event_time", "serial", F.col("p.number").cast("int").alias("number"),
        F.when(F.col("p.piece") != "", F.col("p.piece")).otherwise("0").cast("int").alias("piece"), "p.text",
    )
    quoted = F.startswith("text", F.lit('"'))
    as_bytes = F.when(quoted, F.expr("cast(substring(text, 2, length(text) - 2) AS binary)")).otherwise(F.unhex("text"))
    arguments = each.select("event_time", "serial", "number", "piece", as_bytes.alias("bytes")).groupBy(
        "event_time", "serial", "number"
    ).agg(F.array_sort(F.collect_set(F.struct("piece", F.hex("bytes").alias("digits")))).alias("pieces"))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.col("pieces.digits"), "")).cast("string"))
    shown = arguments.select("event_time", "serial", "number", F.concat(F.lit('"'), text, F.lit('"')).alias("shown"))
    after_program = F.array_sort(F.collect_list(F.when(F.col("number") >= 1, F.struct("number", "shown"))))
    return shown.groupBy("event_time", "serial").agg(
        F.array_join(F.transform(after_program, lambda a: a["shown"]), " ").alias("args")
    )


def _is_call(calls: dict[str, str], name: str) -> Column:
    numbered = F.concat_ws(":", "arch", "syscall").isin(*[f"{a}:{n}" for a, n in calls.items()])
    return (F.col("type") == "SYSCALL") & ((F.col("syscall") == name) | numbered)


def is_exit() -> Column:
    return F.coalesce(_is_call(EXIT_CALLS, EXIT_NAME), F.lit(False))


def is_exec() -> Column:
    return F.coalesce(_is_call(EXEC_CALLS, EXEC_NAME), F.lit(False))


def line_counts(records: DataFrame) -> DataFrame:
    """One row ``(n_lines, n_malformed, n_session)``: what the tree is, and is not, built from."""
    return records.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("malformed").alias("n_malformed"),
        F.count_if(~F.col("malformed") & (is_exit() | is_exec() | F.col("type").isin("EXECVE", "LOGIN"))).alias("n_session"),
    )


def session_records(records: DataFrame) -> DataFrame:
    """The well-formed records the tree is built from, with only the columns it needs.

    :func:`line_counts` tells how many lines are left out.
    """
    columns = ["type", "event_time", "serial", "arch", "syscall", "ppid", "pid", "euid", "exe", "domain", "args"]
    wanted = is_exit() | is_exec() | F.col("type").isin("EXECVE", "LOGIN")
    # Spark moves a filter below the columns it reads, and would search each line again wherever
    # the filter names one of them; it moves none below a generator
    parsed = records.select(F.inline(F.array(F.struct(*columns, "malformed"))))
    return parsed.filter(~F.col("malformed") & wanted).select(*columns)


def process_table(records: DataFrame, arguments: DataFrame | None = None) -> DataFrame:
    """One row per exited pid: its last exit record, with its last exec arguments.

    ``arguments`` are those of :func:`event_arguments`, for logs that may have long ones
    in pieces; by default the arguments are taken from whole records.

    Arguments are a record of their own that lacks the pid, so exec records are
    first brought together per event.  Both sides of the final join are grouped
    by pid already, so it moves no row again.
    """
    order = ["event_time", "serial"]
    exits = records.filter(is_exit() & F.col("pid").isNotNull())
    processes = exits.groupBy("pid").agg(
        F.max(F.struct(*order, "ppid", "exe", "euid", "domain")).alias("last")
    ).select("pid", "last.*")
    is_text = F.col("type") == "EXECVE"
    execs = records.filter(is_exec() | is_text).groupBy(*order).agg(
        F.max(F.when(~is_text, F.col("pid"))).alias("pid"),
        F.max(F.when(is_text, F.col("args"))).alias("args"),
    )
    if arguments is not None:
        execs = execs.drop("args").join(arguments, order)
    execs = execs.filter(F.col("pid").isNotNull() & F.col("args").isNotNull())
    arguments = execs.groupBy("pid").agg(F.max(F.struct(*order, "args")).alias("last")).select(
        "pid", "last.args"
    )
    return processes.join(arguments, "pid", "left")


def login_pid(records: DataFrame) -> int | None:
    """Pid of the session's last LOGIN record."""
    logins = records.filter((F.col("type") == "LOGIN") & F.col("pid").isNotNull())
    last = logins.agg(F.max(F.struct("event_time", "serial", "pid")).alias("r")).first()["r"]
    return None if last is None else last["pid"]


def link_to_root(
    edges: DataFrame, root: int, rank: Sequence[str], with_path: bool = False, with_pids: bool = False
) -> DataFrame:
    """``(pid, root, depth)`` of every node below ``root``, and ``path`` or ``pids`` if wanted.

    ``edges`` has one row per pid: ``pid``, ``ppid`` and the columns in ``rank``,
    which order siblings.  ``root`` of a row is its topmost ancestor.  A path holds
    all ancestors, so paths are as long as the tree is deep; without them a row
    keeps its size.  ``pids`` are a path's pids alone, a sixth of its bytes in every round.

    Every round moves the pointer of each open node to where the node it points
    at has got, which doubles the distance covered: the number of joins grows
    with the logarithm of the depth.  Nodes that reach the root are set aside; later
    rounds join with them, but do not write them again.  Both sides of that join
    are plain tables, so that a parent of very many processes can be split.  A round
    that brings none to the root ends the loop; what is left then hangs on a cycle.
    Pointers that leave the table end nowhere and are dropped.
    """
    at_root = F.col("up") == root
    steps = {"path": F.struct(*rank, "pid")} if with_path else {}
    steps |= {"pids": F.col("pid")} if with_pids else {}
    state = stored(edges.select(
        "pid", F.col("ppid").alias("up"), F.col("pid").alias("root"), F.lit(0).alias("depth"),
        *[F.array(step).alias(name) for name, step in steps.items()],
    ))
    linked, still_open = state.filter(at_root), state.filter(~at_root)
    while True:
        reached = linked.unionByName(still_open).select(
            F.col("pid").alias("up"), F.col("up").alias("next_up"), F.col("root").alias("upper_root"),
            F.col("depth").alias("upper_depth"), *[F.col(name).alias(f"upper_{name}") for name in steps],
        )
        moved = stored(still_open.join(reached, "up").select(
            "pid", F.col("next_up").alias("up"), F.col("upper_root").alias("root"),
            (F.col("depth") + F.col("upper_depth") + 1).alias("depth"),
            *[F.concat(f"upper_{name}", name).alias(name) for name in steps],
        ))
        counts = moved.agg(
            F.count_if(at_root).alias("linked"), F.count_if(~at_root).alias("open")
        ).first()
        if counts["linked"]:
            linked = linked.unionByName(moved.filter(at_root))
        if not (counts["linked"] and counts["open"]):
            break
        still_open = moved.filter(~at_root)
    return linked.select("pid", "root", "depth", *steps)


def process_tree(
    records: DataFrame, users: DataFrame, root: int | None = None, with_path: bool = False,
    with_position: bool = False, with_pids: bool = False,
) -> DataFrame:
    """The process tree of a login session, one row per process.

    ``users`` maps ``uid`` to ``name``.  ``line`` is the printed form, indented by
    depth.  With ``with_position`` there are columns ``size`` (processes of the tree
    below, itself included) and ``position``, the number of the line in pre-order.
    With ``with_path`` there is a column ``path`` (sibling order and pid of every
    ancestor), as long as the tree is deep; sorting by it gives the same order.  With
    ``with_pids`` there is a column ``pids``, the path's pids alone.
    """
    session = stored(session_records(records))  # the log is read and parsed once
    processes = stored(process_table(session))
    if root is None:
        root = login_pid(session)
        if root is None:
            raise ValueError("the session has no LOGIN record")
    edges = processes.filter(F.col("ppid").isNotNull() & (F.col("pid") != F.col("ppid"))).select(
        "pid", "ppid", "event_time", "serial"
    )
    rank = ["event_time", "serial"]
    ways = [c for c, wanted in (("path", with_path), ("pids", with_pids)) if wanted]
    more = [*(["size", "position"] if with_position else []), *ways]
    if with_position:
        tree = preorder(edges, root, rank)
        if ways:
            tree = tree.join(link_to_root(edges, root, rank, with_path, with_pids).select("pid", *ways), "pid")
    else:
        tree = link_to_root(edges, root, rank, with_path, with_pids)
    named = processes.join(
        users.select(F.col("uid").alias("euid"), F.col("name").alias("user")), "euid", "left"
    ).select("pid", "exe", "args", "user", "domain")

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    line = F.concat(
        F.expr("repeat('  ', depth)"), F.lit('- "'), shown("exe"), F.lit('" '), shown("args"),
        F.lit(" (pid="), F.col("pid"), F.lit(", user="), shown("user"),
        F.lit(", domain="), shown("domain"), F.lit(")"),
    )
    return tree.join(named, "pid").select(
        "root", "depth", *more, "pid", "exe", "args", "user", "domain", line.alias("line")
    )


def print_order(tree: DataFrame) -> DataFrame:
    """The printed lines in pre-order, of a tree that has its positions or its paths."""
    return tree.orderBy("position" if "position" in tree.columns else "path").select("line")
