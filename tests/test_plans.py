from conftest import rows

from stratalith.plans import retrieval, state, tables

PARENT = "parent_no bigint, parent_id string, session_id string, workspace_id string, document_id string, document_title string, core_text string, evidence_quality double, temporal_current boolean, updated_at timestamp"
CHILD = "child_no bigint, child_id string, parent_id string, start_offset int, end_offset int, embedding_text_preview string, vector array<float>, vector_model string, vector_state string"


def folder(spark, path, parents, children):
    """``parents``: number, text; ``children``: number, number of the parent, offsets, preview, vector."""
    spark.createDataFrame([(p, f"p{p}", "s", "w", None, None, core, 1.0, True, None) for p, core in parents], PARENT).write.parquet(f"{path}/parent_chunks.parquet")
    kids = [(c, f"c{c}", f"p{p}", a, b, preview, v, "m" if v else None, "active") for c, p, a, b, preview, v in children]
    spark.createDataFrame(kids, CHILD).write.parquet(f"{path}/child_spans.parquet")
    return str(path)


def test_child_text_is_the_whole_slice(spark, tmp_path):
    core = "head " + "a" * 300 + " needle tail"
    d = folder(spark, tmp_path, [(1, core), (2, None)], [(20, 1, 5, 312, core[5:245], None), (40, 1, 5, 312, None, None), (3, 1, None, None, "cut", None), (4, 1, 7, 7, "only here", None), (5, 2, 0, 4, "no core", None), (6, 1, 300, 9999, None, None), (7, 1, -4, 4, None, None)])
    got = {r["child_no"]: r["text"] for r in tables.match_children(spark, d).collect()}
    assert got == {20: core[5:312], 40: core[5:312], 3: core, 4: "only here", 5: "no core", 6: core[300:], 7: "head"}
    assert {r["text"] for r in tables.match_queries(spark, d).collect()} == {core[5:312]}


def test_supersede_reads_vectors_and_whole_slices(spark, tmp_path):
    x, y, pad = [1.0, 0.0], [0.0, 1.0], "x " * 200
    texts = ["gateway port: 8443", "gateway port limit: 8443", pad + "billing quota owner", "gateway port limit changed to 9", pad + "billing quota owner changed to 5"]
    vectors = [x, y, None, x, None]
    kids = [(i, i, 0, len(t), t[:240] if i != 2 else None, v) for i, (t, v) in enumerate(zip(texts, vectors))]
    d = folder(spark, tmp_path, list(enumerate(texts)), kids + [(9, 0, None, None, "gateway port: 8443", x)])
    assert rows(state.supersede(spark, d), "old_child_id", "new_child_id") == [("c0", "c3"), ("c2", "c4")]


def test_reference_sync_reads_the_journal(spark, tmp_path):
    base = "scope_kind string, scope_id string, collection string, id string, mutation_seq bigint, value_json string"
    line = "ledger_version int, mutation_seq bigint, scope_kind string, scope_id string, collection string, op string, id string, value_json string, logged_at timestamp"
    record = lambda n, id, op="upsert", value="{}": (2, n, "workspace", "w", "semipersistentRecords", op, id, value, None)
    made = lambda n, id, op="upsert", value="{}": (2, n, "session", "s", "semipersistentProjections", op, f"{id}@s", value, None)
    old = [r[2:5] + (r[6], r[1], r[7]) for r in (record(1, "gone"), record(2, "kept"), record(3, "soft"), made(4, "gone"), made(5, "kept"), made(6, "soft"), made(7, "late"))]
    dead = '{"tombstonedAt": 1}'
    new = [record(8, "gone", "delete", None), record(9, "made"), record(10, "soft", value=dead), made(11, "kept", "delete", None), made(12, "late", value=dead), record(13, "full"), made(14, "full")]
    spark.createDataFrame(old, base).write.parquet(f"{tmp_path}/ledger_snapshot.parquet")
    spark.createDataFrame(new, line).write.parquet(f"{tmp_path}/ledger_journal.parquet")
    spark.createDataFrame([("w", "s")], "workspace_id string, session_id string").write.parquet(f"{tmp_path}/session_events.parquet")
    assert rows(state.reference_sync(spark, str(tmp_path)), "record_id", "action") == [("gone", "delete"), ("kept", "create"), ("made", "create"), ("soft", "delete")]


def test_feature_hash_reads_the_texts(spark, tmp_path):
    d = folder(spark, tmp_path, [(1, "alpha beta alpha " + "gamma " * 90), (2, None)], [])
    got = retrieval.feature_hash_slots(spark, d).collect()
    want = {}
    for token, n in (("alpha", 2), ("beta", 1), ("gamma", 90)):
        h = 2166136261
        for c in token:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        want[h % 64] = want.get(h % 64, 0) + (-n if h >> 31 else n)
    assert {(r["parent_no"], r["slot"]): r["weight"] for r in got} == {(1, s): w for s, w in want.items()}
