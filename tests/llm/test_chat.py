from clusterloom.llm.chat import perspectives

SCHEMA = "conv_id long, turn long, role string, text string, segment string, speaker string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute(rows, segment_turns=64):
    """Text and spans by dialogue, segment and perspective."""
    def key(t):
        return (t[1] is not None, t[1] or 0, t[2], t[3])

    rows = {(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows}
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        for me in {r[2] for r in own} - {"system"}:
            for segment in {None if r[1] is None else r[1] // segment_turns for r in own}:
                text, spans = "", []
                part = [r for r in own if (None if r[1] is None else r[1] // segment_turns) == segment]
                for _, _, who, said in sorted(part, key=key):
                    text += "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == me else f"<|user|>{who}\n"
                    start = len(text)
                    text += said + "<|end|>"
                    if who == me:
                        spans.append((start, len(text)))
                    text += "\n"
                out[conv, segment, me] = (text, spans, len(part), len(spans))
    return out


def result(df):
    rows = df.collect()
    got = {(r.conv_id, r.segment, r.perspective): (r.text, [tuple(s) for s in r.spans], r.n_turns, r.n_own) for r in rows}
    assert len(got) == len(rows)
    return got


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi 😀"), (1, 2, "Bob", None), (1, 2, "Ann", "again"), (1, 3, None, "who?"),
    (1, 3, None, "who?"), (1, 70, "Bob", "late"), (1, None, "Ann", "no number"), (2, 0, "system", "alone"),
    (None, 0, "Ann", "no dialogue"), (None, 1, "Cy", ""), (3, -1, "Ann", "before"), (3, 5, "Ann", "x" * 100_000), (4, 0, "", "blank"),
]


def test_matches_brute_force(spark):
    got = result(perspectives(turns(spark, ROWS)))
    assert got == brute(ROWS)
    text, spans, _, _ = got[1, 0, "Ann"]
    assert [text[a:b] for a, b in spans] == ["Hi 😀<|end|>", "again<|end|>"]
    assert text.startswith("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi")


def test_a_crowded_segment_is_parted_and_stays_whole(spark):
    rows = [(7, i % 3, f"p{i % 2}", f"turn {i}") for i in range(400)] + [(7, 0, "p0", "same")] * 500
    found = perspectives(turns(spark, rows), segment_rows=50).orderBy("segment", "part").collect()
    assert max(r.n_turns for r in found) < 60
    for me in ("p0", "p1"):
        joined = "".join(r.text for r in found if r.perspective == me)
        assert sorted(joined.split("\n")) == sorted(brute(rows)[7, 0, me][0].split("\n"))
        order = [int(line.split()[1].removesuffix("<|end|>")) % 3 for line in joined.split("\n") if line.startswith("turn")]
        assert order == sorted(order)


def test_empty_table(spark):
    assert perspectives(turns(spark, [])).collect() == []
