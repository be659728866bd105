from conftest import rows
from pyspark.sql import functions as F

from stratalith.operators import chunker, layers, render, segment, surface
from stratalith.config import Config

EVENT = "session_id string, workspace_id string, seq bigint, event_time timestamp_ntz, ingested_at timestamp_ntz, event_type string, turn bigint, source struct<kind:string,plugin:string,purpose:string>, content string, block_kinds array<string>, call_id string, tool_name string"


def log(spark, items):
    return spark.createDataFrame([("s", "w", seq, None, None, kind, turn, None, content, None, call, None) for seq, kind, turn, content, call in items], EVENT)


def test_replayed_turn_keeps_the_latest_window(spark):
    events = log(spark, [(1, "turn/start", 1, None, None), (2, "user/message", 1, "old", None), (3, "turn/start", 1, None, None), (4, "user/message", 1, "new", None), (5, "assistant/message", 1, '[{"type":"text","text":"a"},{"type":"text","text":"b"}]', "c1"), (6, "turn/end", 1, None, None)])
    assert rows(segment.segments(events), "first_seq", "last_seq", "n_records") == [(4, 5, 2)]
    assert [r["text"] for r in segment.records(events).orderBy("seq").collect()] == ["old", "new", "a\nb"]
    assert rows(segment.unpaired_calls(events), "call_id", "side") == [("c1", "call")]
    replaced = spark.createDataFrame([("s", 3, 1, 2)], "session_id string, seq bigint, start bigint, end bigint")
    assert [r[0] for r in segment.visible(events, replaced).select("seq").orderBy("seq").collect()] == [3, 4, 5, 6]


def test_current_view(spark):
    ranges = "array<struct<start_offset:int,end_offset:int>>"
    view = lambda t, r: spark.createDataFrame([(t, r)], f"t string, r {ranges}").select(layers.current_view(F.col("t"), F.col("r"))).collect()[0][0]
    assert view("keep OLD rest", [(5, 8)]) == "keep \n rest"
    assert view("abcdefgh", [(4, 6), (-3, 2), (1, 3)]) == "d\ngh"
    assert view("  same  ", []) == "  same  " and view("gone", [(0, 99)]) == ""


def test_supersession_takes_the_earliest_later_update(spark):
    shape = "session_id string, position int, parent_id string, child_id string, core_text string, text string, vector array<float>, vector_model string"
    data = [("s", i, f"p{i}", f"c{i}", t, t, None, None) for i, t in enumerate(["gateway port value is 8443", "gateway port value changed to 9000", "gateway port value changed to 9100", "gateway port value unrelated"])]
    got = layers.superseded(spark.createDataFrame(data + [("z", 9, "q", "d", "gateway port value changed to 1", "gateway port value changed to 1", None, None)], shape))
    assert rows(got, "old_child_id", "new_child_id") == [("c0", "c1"), ("c1", "c2")]


def test_budgets(spark):
    items = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 70, 20, 5])], "g string, i int, n int")
    taken = lambda df: [r["accepted"] for r in df.orderBy("i").collect()]
    assert taken(surface.skipping(items, ["g"], ["i"], F.col("n"), F.lit(80))) == [True, False, True, True]
    assert taken(surface.stopping(items, ["g"], [F.col("i")], F.col("n"), F.lit(80))) == [True, False, False, False]
    b = spark.range(1).select(surface.budget(F.lit(68), F.lit(0), F.lit(0), F.lit(100)).alias("b")).collect()[0]["b"]
    assert (b["pressure"], b["triggered"], b["threshold"], b["target"]) == (0.68, True, 65, 55)


def test_eviction_stops_at_the_target(spark):
    segs = spark.createDataFrame([("s", t, 100, t * 10) for t in range(1, 11)], "session_id string, turn bigint, tokens bigint, first_seq bigint")
    got = surface.eviction(segs, F.lit(1200), F.lit(10), Config(), checkpoint_tokens=0)
    assert [r["turn"] for r in got.filter("evicted").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_manifest(spark):
    segs = spark.createDataFrame([("s", f"g{i:02d}", i, i, f"l{i}") for i in range(9)], "session_id string, segment_id string, first_seq bigint, last_seq bigint, label string")
    got = surface.manifest(segs)
    assert rows(got.filter("level = 1"), "node", "first_seq", "last_seq") == [(0, 0, 3), (1, 4, 7), (2, 8, 8)]
    assert got.filter("level = 2").collect()[0]["labels"] == ["l0", "l1"]


def test_catalog_round_trip(spark):
    picks = spark.createDataFrame([(1, 0, "a", "sensory", 3, 4, "text a"), (1, 1, "b", "bank", None, None, "text b")], "query_id int, pick int, parent_id string, layer string, first_seq int, last_seq int, view string")
    entries = render.parse_catalog(render.catalog(picks))
    assert rows(entries, "name", "layer", "seq") == [("chunk:a", "sensory", "3-4"), ("chunk:b", "bank", "?-?")]
    assert [e["name"] for e in render.parse_catalog(render.catalog(picks, budget=30)).collect()] == ["chunk:a"]


def test_snapshot_fits_its_budget(spark):
    row = "array<struct<priority int, seq bigint, label string, text string>>"
    data = [("s", "a", 1, [(1, 5, "user", "y" * 30), (0, 1, "user", "x" * 4000), (2, 7, "tool", "t" * 60)]), ("s", "b", 2, [(0, 2, "user", "字" * 10), (0, 3, "user", "z" * 900), (1, 4, "tool", "short")]), ("t", "c", 1, [(0, 1, "user", "x" * 9000)])]
    got = {r["session_id"]: r["snapshot"] for r in render.snapshot(spark.createDataFrame(data, f"session_id string, record_id string, activated_at int, rows {row}"), 100).collect()}
    a, b = got["s"].split("\n\n")
    room = 50 * 3
    assert a == f"## a\n[seq 1] user: {'x' * int(room * 0.65)}\n… omitted {4000 - int(room * 0.65) - int(room * 0.25)} chars …\n{'x' * int(room * 0.25)}"
    assert b == "## b\n[seq 2] user: 字字字字字字字字字字\n[seq 4] tool: short"
    assert got["t"].startswith("## c\n[seq 1] user: xxx") and len(got["t"]) < 320
    parts = ["ab", "字c", "", "défg", "hi" * 9]
    state = (0, 0)
    for p in parts:
        state = render.grown(state, p)
    assert state[0] + (state[1] + 3) // 4 == render.tokens("".join(parts))


def test_forget_cascade(spark):
    bank = spark.createDataFrame([("b1", "Deploy on Friday", None), ("b2", "other", None)], "id string, core_text string, tombstoned_at timestamp")
    semi = spark.createDataFrame([("m1", "b1"), ("m2", "b2")], "id string, bank_record_id string")
    sensory = spark.createDataFrame([("c1", "m1"), ("c2", "m2")], "id string, segment_id string")
    gone = layers.forget(bank, semi, sensory, "deploy on")
    assert [rows(gone[k], "id") for k in ("bank", "semi", "sensory")] == [[("b1",)], [("m1",)], [("c1",)]]


def test_marked_documents():
    text = "# A | x\n\none\ntwo | 2\n| h | i |\n|---|---|\n| 1 | 2 |\n# B | c\n```\ncode\n```py\n```\n\n| q | r |\n|---|---|\n\n```sql\nopen"
    got = [(b.form, text[b.start : b.end], b.headings, b.rows) for b in chunker.markdown_blocks(text, 0, len(text))]
    assert got == [
        ("markdown", "one\ntwo | 2", ("A | x",), 0), ("markdown-table", "| 1 | 2 |", ("A | x",), 1), ("markdown-table", "# B | c", ("A | x",), 1),
        ("code", "code\n```py", ("A | x",), 0), ("markdown-table", "", ("A | x",), 0), ("code", "open", ("A | x",), 0),
    ]


def test_chunker(spark):
    parts = chunker.chunk("# A\n\nintro\n\n## B\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n```python\ndef f():\n  pass\nclass G: pass\n```\n", "k")
    assert [(p["format"], p["heading_path"]) for p in parts] == [("markdown", ["A"]), ("markdown-table", ["A", "B"]), ("code", ["A", "B"]), ("code", ["A", "B"])]
    text = " ".join(f"Sentence number {i} holds a fact." for i in range(400))
    small = Config(parent_target_tokens=300, parent_max_tokens=400, child_target_tokens=48, child_max_tokens=64, child_overlap_tokens=8)
    out = chunker.chunk(text, "k", config=small)
    assert len(out) > 5 and all(p["token_count"] <= 400 for p in out)
    for p in out:
        for c in p["children"]:
            assert c["token_count"] <= 64 and p["core_text"][c["start_offset"] : c["end_offset"]] in c["embedding_text"]
    joined = "".join(p["core_text"] for p in out)
    assert all(f"number {i} holds" in joined for i in range(400))
    marked = chunker.chunk("lost\n--- One ---\nalpha\n--- Two ---\nbeta", "k")
    assert [(p["document_title"], p["core_text"]) for p in marked] == [("One", "alpha"), ("Two", "beta")]
    docs = spark.createDataFrame([("1", None, "hello there", None, None), ("2", None, " ", None, None), ("3", None, None, None, None)], "source_id string, title string, text string, format string, language string")
    assert rows(chunker.children(chunker.chunk_table(docs)), "source_id", "start_offset", "end_offset") == [("1", 0, 11)]
    assert chunker.chunk("中" * 5000, "k")[0]["token_count"] <= 3072


def test_replacements_and_injections(spark):
    segs = spark.createDataFrame([("s", "a", 1, 1, 3), ("s", "b", 2, 4, 6)], "session_id string, segment_id string, revision int, first_seq bigint, last_seq bigint")
    asked = spark.createDataFrame([("s", "a", 1, "x"), ("s", "b", 1, "y")], "session_id string, segment_id string, revision int, text string")
    none = spark.createDataFrame([], "session_id string, start bigint, end bigint")
    assert rows(surface.replacements(asked, segs, none), "segment_id", "seq", "start", "end") == [("a", 7, 1, 3)]
    assert surface.replacements(asked, segs, spark.createDataFrame([("s", 1, 3)], "session_id string, start bigint, end bigint")).count() == 0
    messages = spark.createDataFrame([("s", 1, "user", "user", "q"), ("s", 2, "assistant", None, "a")], "session_id string, seq bigint, role string, source_kind string, text string")
    extra = spark.createDataFrame([("s", "sensory-catalog", "C"), ("s", "sensory-root-manifest", "M"), ("s", "semipersistent-snapshot", None)], "session_id string, purpose string, text string")
    assert [r["text"] for r in surface.with_injections(messages, extra).collect()] == ["M", "C", "q", "a"]
    items = spark.createDataFrame([(1, 0, "a" * 400), (1, 1, "b" * 40)], "query_id int, pick int, view string")
    assert rows(surface.injected_evidence(items, F.lit(120), F.lit("x" * 40)), "evidence") == [("b" * 40,)]
