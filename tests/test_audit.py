import pytest
from pyspark.sql import functions as F

from clusterloom.operators import audit
from clusterloom.sources import read_audit_log


def exit_line(serial, pid, ppid, exe="/bin/sh", euid=0, domain="user_t", time="100.000"):
    return (
        f"type=SYSCALL msg=audit({time}:{serial}): arch=c000003e syscall=231 a0=0 ppid={ppid} pid={pid} "
        f'auid=42 uid=5 euid={euid} comm="x" exe="{exe}" subj=system_u:system_r:{domain}:s0-s0:c0.c1023'
    )


def exec_lines(serial, pid, arguments, time="100.000"):
    named = " ".join(f'a{i}="{a}"' for i, a in enumerate(arguments))
    return [
        f'type=SYSCALL msg=audit({time}:{serial}): arch=c000003e syscall=59 ppid=0 pid={pid} auid=42 euid=0 exe="/bin/sh" subj=u:r:t:s0',
        f"type=EXECVE msg=audit({time}:{serial}): argc={len(arguments)} {named}",
    ]


def login(serial, pid, time="100.000"):
    return f"type=LOGIN msg=audit({time}:{serial}): pid={pid} uid=0 old-auid=4294967295 auid=42"


def tree(spark, lines, root=None):
    records = audit.audit_parse(spark.createDataFrame([(line,) for line in lines], "value string"))
    users = spark.createDataFrame([(0, "root"), (5, "five")], "uid bigint, name string")
    return audit.process_tree(records, users, root, with_path=True)


def test_parse(spark):
    lines = [exit_line(7, 12, 3), *exec_lines(8, 12, ["ls", "-l", "a b"]), login(9, 3), "garbage", ""]
    rows = audit.audit_parse(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [r["malformed"] for r in rows] == [False, False, False, False, True, True]
    assert (rows[0]["pid"], rows[0]["ppid"], rows[0]["euid"], rows[0]["exe"], rows[0]["domain"]) == (
        12, 3, 0, "/bin/sh", "user_t")
    assert rows[2]["args"] == '"-l" "a b"' and rows[2]["pid"] is None
    assert (rows[3]["type"], rows[3]["pid"], rows[3]["auid"]) == ("LOGIN", 3, 42)


def test_no_line_is_searched_twice_for_a_field(spark):
    lines = spark.createDataFrame([(login(1, 1),)], "value string").repartition(2)
    plan = audit.session_records(audit.audit_parse(lines))._jdf.queryExecution().optimizedPlan().toString()
    for name in set(audit.PATTERNS) - {"auid", "argc"}:
        assert plan.count(audit.PATTERNS[name]) == 1, name


def test_fields_of_lines_without_a_type_are_null(spark):
    lines = ["node=a msg=audit(1.5:2): arch=c000003e syscall=231 ppid=1 pid=5 exe=\"/x\" argc=1", " pid=3", None]
    rows = audit.audit_parse(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [(str(r["event_time"]), r["serial"], r["malformed"]) for r in rows] == [
        ("1.500", 2, True), ("None", None, True), ("None", None, True)]
    assert {r[c] for r in rows for c in r.asDict() if c not in ("event_time", "serial", "malformed")} == {None}


def test_arguments_one_by_one(spark):
    head = "type=EXECVE msg=audit(1.0:2): argc=3 "
    cases = {
        'a0="x" a1="--data1=5" a2="z"': '"--data1=5" "z"',
        'a0="x" a1=2D6C2061 a2="z"': '"-l a" "z"',
        'a0=612061313D4142 a1="a2=FF" a10="ten" a2="two"': '"a2=FF" "two" "ten"',
        'a0="x"': "", 'a0="x" a1=C3A9FF': '"é\ufffd"', 'a0="a1=00 a2=00" a1=""': '""',
    }
    lines = spark.createDataFrame([(head + c,) for c in cases], "value string")
    assert [r["args"] for r in audit.audit_parse(lines).collect()] == list(cases.values())


def test_numbers_mean_what_the_architecture_says(spark):
    def call(serial, pid, arch, number):
        return f'type=SYSCALL msg=audit(1.0:{serial}): arch={arch} syscall={number} ppid=1 pid={pid} euid=0 exe="/x"'

    lines = [
        login(1, 1, "0.5"), call(2, 20, "c000003e", 231), call(3, 30, "c000003e", 252), call(4, 40, "40000003", 252),
        call(5, 50, "c00000b7", 94), call(6, 60, "c00000b7", 231), call(7, 70, "x86_64", "exit_group"), "junk",
    ]
    assert sorted(r["pid"] for r in tree(spark, lines).collect()) == [20, 40, 50, 70]
    records = audit.audit_parse(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert tuple(audit.line_counts(records).first()) == (8, 1, 5)


def test_tree_golden(spark):
    lines = [login(1, 1), exit_line(2, 2, 1), exit_line(3, 3, 2), exit_line(4, 4, 2)]
    rows = tree(spark, lines).orderBy("path").collect()
    assert [(r["pid"], r["depth"], r["root"]) for r in rows] == [(2, 0, 2), (3, 1, 2), (4, 1, 2)]


def test_siblings_are_listed_in_log_order(spark):
    lines = [login(1, 1), exit_line(5, 9, 2), exit_line(6, 3, 2), exit_line(10, 2, 1), exit_line(11, 4, 9)]
    assert [r["pid"] for r in tree(spark, lines).orderBy("path").collect()] == [2, 9, 4, 3]


def test_last_record_and_last_login_win(spark):
    lines = [
        login(1, 77), login(2, 1), exit_line(3, 2, 1, exe="/old"), exit_line(9, 2, 1, exe="/new"),
        exit_line(4, 2, 55, exe="/older"), *exec_lines(5, 2, ["a", "first"]), *exec_lines(6, 2, ["a", "last"]),
    ]
    rows = tree(spark, lines).collect()
    assert [(r["pid"], r["exe"], r["args"]) for r in rows] == [(2, "/new", '"last"')]


def test_printed_lines(spark):
    lines = [
        login(1, 1), exit_line(2, 2, 1, "/a", euid=5), *exec_lines(3, 2, ["a", "-x"]),
        exit_line(4, 3, 2, "/b", euid=99), *exec_lines(5, 4, ["c"]), exit_line(6, 4, 3, "/c"),
    ]
    assert [r["line"] for r in audit.print_order(tree(spark, lines)).collect()] == [
        '- "/a" "-x" (pid=2, user=five, domain=user_t)',
        '  - "/b"  (pid=3, user=, domain=user_t)',
        '    - "/c"  (pid=4, user=root, domain=user_t)',
    ]


def test_missing_arguments_are_null_and_none_are_empty(spark):
    lines = [login(1, 1), exit_line(2, 2, 1), exit_line(4, 3, 1), *exec_lines(3, 3, [])]
    args = {r["pid"]: r["args"] for r in tree(spark, lines).collect()}
    assert args == {2: None, 3: ""}


def test_cycles_and_orphans_end(spark):
    lines = [login(1, 1), exit_line(2, 2, 1), exit_line(3, 1, 2)]
    rows = tree(spark, lines).collect()
    assert sorted(r["pid"] for r in rows) == [1, 2]
    lines = [
        login(1, 1), exit_line(2, 2, 1), exit_line(3, 10, 11), exit_line(4, 11, 12), exit_line(5, 12, 10),
        exit_line(6, 13, 12), exit_line(7, 20, 999), exit_line(8, 21, 20), exit_line(9, 30, 30),
    ]
    assert [r["pid"] for r in tree(spark, lines).collect()] == [2]


def test_records_without_a_stamp_do_not_mix(spark):
    broken = [line.replace("msg=audit(100.000:3): ", "") for line in exec_lines(3, 2, ["a", "wrong"])]
    rows = tree(spark, [login(1, 1), exit_line(2, 2, 1), *broken]).collect()
    assert [(r["pid"], r["args"]) for r in rows] == [(2, None)]


def test_hot_parent_is_split(spark):
    """Adaptive execution splits the join partition of a parent with most of the nodes."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        edges = spark.range(2, 40002, 1, 8).select(
            F.col("id").alias("pid"),
            F.when(F.col("id") == 2, 1).when(F.col("id") % 3 > 0, 2).otherwise(F.col("id") - 1).alias("ppid"),
            F.col("id").alias("rank"),
        )
        open_nodes = edges.filter("ppid != 1").select("pid", F.col("ppid").alias("up"))
        reached = edges.select(F.col("pid").alias("up"), F.col("ppid").alias("next_up"))
        joined = open_nodes.join(reached, "up")
        assert len(joined.collect()) == 39999
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert audit.link_to_root(edges, 1, ["rank"]).count() == 40000
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_no_login(spark):
    with pytest.raises(ValueError):
        tree(spark, [exit_line(2, 2, 1)])
    assert tree(spark, [exit_line(2, 2, 1)], root=1).count() == 1


@pytest.mark.parametrize("n, parent", [
    (70, lambda i: i - 1),                      # one chain, deeper than 64
    (300, lambda i: 1 if i % 3 else 2),         # two thirds under one parent
    (200, lambda i: max(1, (i * 7) // 10)),
])
def test_link_to_root_against_a_walk(spark, n, parent):
    parents = {i: parent(i) for i in range(2, n + 2)}
    parents[2] = 1
    edges = spark.createDataFrame([(i, p, i) for i, p in parents.items()], "pid bigint, ppid bigint, rank bigint")
    got = {r["pid"]: [p["pid"] for p in r["path"]] for r in audit.link_to_root(edges, 1, ["rank"], with_path=True).collect()}

    def walk(i):
        return [] if i == 1 else [*walk(parents[i]), i]

    assert got == {i: walk(i) for i in parents}


def test_pids_are_those_of_the_path(spark):
    edges = spark.createDataFrame([(i, i // 2, -i) for i in range(2, 200)], "pid bigint, ppid bigint, rank bigint")
    linked = audit.link_to_root(edges, 1, ["rank"], with_path=True, with_pids=True)
    assert all(r["pids"] == [p["pid"] for p in r["path"]] and len(r["pids"]) == r["depth"] + 1 for r in linked.collect())
    alone = audit.link_to_root(edges, 1, ["rank"], with_pids=True)
    assert dict(alone.dtypes)["pids"] == "array<bigint>"  # the ranks of ancestors are not carried along
    assert sorted(alone.collect()) == sorted(linked.select("pid", "root", "depth", "pids").collect())
    lines = [login(1, 1), exit_line(2, 2, 1), exit_line(3, 3, 2), exit_line(4, 9, 3)]
    records = audit.audit_parse(spark.createDataFrame([(line,) for line in lines], "value string"))
    users = spark.createDataFrame([(0, "root")], "uid bigint, name string")
    for position in (False, True):
        rows = audit.process_tree(records, users, with_pids=True, with_position=position).collect()
        assert {r["pid"]: r["pids"] for r in rows} == {2: [2], 3: [2, 3], 9: [2, 3, 9]}


def test_a_long_chain_keeps_rows_small(spark):
    edges = spark.range(2, 5002).selectExpr("id AS pid", "id - 1 AS ppid", "id AS rank")
    linked = audit.link_to_root(edges, 1, ["rank"])
    assert linked.columns == ["pid", "root", "depth"]
    got = linked.agg(F.count("*"), F.min("root"), F.max("root"), F.sum("depth"), F.max("depth")).first()
    assert tuple(got) == (5000, 2, 2, 5000 * 4999 // 2, 4999)


def test_session_by_login_user(spark, tmp_path):
    lines = [login(1, 1), exit_line(2, 2, 1), *exec_lines(3, 2, ["a", "b"]),
             exit_line(4, 9, 1).replace("auid=42", "auid=421"), "type=EXECVE msg=audit(100.000:5): argc=0"]
    (tmp_path / "audit.log").write_text("\n".join(lines))
    kept = {r["value"] for r in read_audit_log(spark, str(tmp_path / "audit.log"), auid=42).collect()}
    assert kept == set(lines[:4])


def test_arguments_in_pieces_over_split_ends(spark, tmp_path):
    def record(serial, rest):
        return f"type=EXECVE msg=audit(1500000000.250:{serial}): {rest}"

    long = "größer als ein Stück"
    digits = long.encode().hex().upper()
    lines = [
        record(1, f'argc=3 a0="run" a1_len={len(digits)} a1[0]={digits[:6]}'), record(2, 'argc=2 a0="ls" a1="a1=x"'),
        record(1, f'a1[2]={digits[20:]} a2="last"'), "no audit line", record(3, 'argc=1 a0="alone"'),
        "type=EXECVE garbage a1=\"x\"", record(1, f"a1[1]={digits[6:20]}"),
        record(4, 'argc=2 a0="cat" a1[1]="def" a1[0]="abc"'), record(1, f"a1[1]={digits[6:20]}"),
    ]
    (tmp_path / "audit.log").write_text("\n".join(lines * 1 + [f"filler {i}" * 9 for i in range(50)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (37, 200, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            log = spark.read.text(str(tmp_path))
            got = {r["serial"]: r["args"] for r in audit.event_arguments(log).collect()}
            assert got == {1: f'"{long}" "last"', 2: '"a1=x"', 3: "", 4: '"abcdef"'}
            assert log.rdd.getNumPartitions() > 1 or size > 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_processes_with_arguments_in_pieces(spark):
    def stamp(serial):
        return f"msg=audit(1500000000.000:{serial}):"

    lines = [
        f"type=SYSCALL {stamp(1)} arch=c000003e syscall=59 ppid=1 pid=7 exe=\"/bin/a\"",
        f"type=EXECVE {stamp(1)} argc=2 a0=\"a\" a1[0]=\"one \"", f"type=EXECVE {stamp(1)} a1[1]=\"two\"",
        f"type=SYSCALL {stamp(2)} arch=c000003e syscall=231 ppid=1 pid=7 exe=\"/bin/a\"",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    table = audit.process_table(audit.session_records(audit.audit_parse(df)), audit.event_arguments(df))
    assert [(r["pid"], r["args"]) for r in table.collect()] == [(7, '"one two"')]
