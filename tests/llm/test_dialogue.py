"""Perspective rotation: agreement with DuckDB and with a plain rendering, edge rows, long and hot conversations."""

import duckdb

from tidewright.llm import dialogue
from tidewright.llm.dialogue import ORACLE_SQL, rotate

ROWS = [
    (1, 0, "system", "be kind", ""), (1, 1, "ann", "hi", ""), (1, 2, "bob", None, ""), (1, 3, "cy", "é😀", ""), (1, 3, "cy", "é😀", ""),
    (1, 3, "ann", "two at once", ""), (1, 600, "ann", "late <|end|>", ""), (2, 0, None, "who?", ""), (2, 1, "", "empty", ""),
    (None, None, "ann", "lost", ""), (None, 4, "ann", "found", ""), (3, 0, "system", "alone", ""), (4, 0, "x", "y" * 100_000, None),
]
SCHEMA = "conv_id long, turn long, role string, text string, RENDERED string"


def plain(rows):
    """(conv_id, perspective) -> whole rendering and spans, message by message."""
    talks, out = {}, {}
    for c, turn, role, text, *_ in rows:
        talks.setdefault(c, set()).add((turn is not None, turn or 0, role is not None, role or "", text or ""))
    for c, said in talks.items():
        for who in {r for _, _, known, r, _ in said if known and r not in ("", "system")}:
            whole, spans = "", []
            for _, _, known, role, text in sorted(said, key=lambda m: (*m[:3], m[3].encode(), m[4].encode())):
                own = known and role == who
                whole += "<|assistant|>\n" if own else "<|system|>\n" if known and role == "system" else f"<|user name={role if known else 'unknown'}|>\n"
                spans += [f"{len(whole)}-{len(whole) + len(text) + 7}"] if own else []
                whole += text + "<|end|>\n"
            out[c, who] = whole, ",".join(spans)
    return out


def joined(out):
    """The parts of each perspective put together; spans and starts are checked on the way."""
    parts = {}
    for r in sorted(out, key=lambda r: r.part):
        parts.setdefault((r.conv_id, r.perspective), []).append(r)
    whole = {}
    for key, rows in parts.items():
        assert [r.part for r in rows] == list(range(len(rows)))
        text = ""
        for r in rows:
            assert r.start == len(text)
            text += r.rendered
            spans = [tuple(map(int, s.split("-"))) for s in r.mask_spans.split(",") if s]
            assert len(spans) == r.n_own and sum(e - b for b, e in spans) == r.n_trained
            for b, e in spans:
                assert text[:b].endswith("<|assistant|>\n") and text[b:e].endswith("<|end|>")
        whole[key] = text, ",".join(r.mask_spans for r in rows if r.mask_spans)
    return whole


def oracle(con, part_rows=512):
    sql = ORACLE_SQL.replace("// 512", f"// {part_rows}")
    names = "conv_id, part, perspective, start, n_turns, n_own, rendered, mask_spans, n_trained"
    return sorted(map(repr, con.sql(f"SELECT {names} FROM ({sql})").fetchall()))


def test_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, extra VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", ROWS)
    for part_rows in (1, 2, 512):
        out = rotate(df, part_rows).collect()
        assert joined(out) == plain(ROWS)
        assert sorted(repr(tuple(r)) for r in out) == oracle(con, part_rows)
    assert sorted((str(r.conv_id), r.part, r.perspective, r.n_turns) for r in out) == [
        ("1", 0, "ann", 6), ("1", 0, "bob", 6), ("1", 0, "cy", 6), ("4", 0, "x", 1), ("None", 0, "ann", 2),
    ]
    assert rotate(df.limit(0)).count() == 0


def test_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = rotate(turns).collect()
    assert joined(out) == plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Its messages spread over many ranges and chunks; participants who speak once, at one end, get the whole."""
    monkeypatch.setattr(dialogue, "CHUNK", 3)
    rows = [(7, i // 3, ("early" if i == 0 else "late" if i == 2999 else f"p{i % 2}"), f"m{i}" * (i % 5), "") for i in range(3000)]
    rows += [(c, t, f"q{t % 2}", f"{c}/{t}", "") for c in range(100, 140) for t in range(5)] + [(None, None, "z", str(i), "") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        out = rotate(spark.createDataFrame(rows, SCHEMA).repartition(9), 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert joined(out) == plain(rows) and max(r.n_turns for r in out) == 100
    assert sum(r.conv_id == 7 and r.perspective == "early" for r in out) == 30
