from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import splitting


def tokens(s):
    total = run = 0
    for ch in s:
        if ord(ch) < 128:
            run += 1
        else:
            total, run = total + (run + 3) // 4 + 1, 0
    return total + (run + 3) // 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!,中文é", max_size=400), st.integers(3, 40), st.integers(0, 12))
def test_round_trip_and_limits(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    out = splitting.split_points(text, limit, overlap)
    assert "".join(text[a:b] for _, a, b in out) == text
    if tokens(text) <= limit:
        assert len(out) == 1
    for s, a, b in out:
        assert tokens(text[s:b]) <= limit and tokens(text[s:a]) <= overlap


def test_natural_boundaries():
    text = "\n\n".join(" ".join(f"Sentence {i} of part {p}." for i in range(12)) for p in range(8))
    ends = [b for _, _, b in splitting.split_points(text, 200, 16)]
    assert all(text[:b].endswith((". ", "\n\n", ".")) for b in ends)


def test_cuts_and_overlaps_keep_to_boundaries():
    # the only boundaries lie far from the midpoints
    text = "a" * 60 + " " + "b" * 400 + " " + "c" * 60
    ends = [b for _, _, b in splitting.split_points(text, 100, 8)]
    assert 61 in ends and 462 in ends
    words = " ".join(f"word{i}" for i in range(900))
    out = splitting.split_points(words, 200, 32)
    assert all(words[:s].endswith(" ") or not s for s, _, _ in out) and all(s < a for s, a, _ in out[1:])


def test_table(spark):
    long = "word " * 800
    data = [(1, "Title", long, 1), (1, "Title", long, 1), (2, None, "short", 1), (3, None, None, 1), (4, "", "", 1), (5, None, "中" * 900, 1), (None, None, long, 1), (6, None, "x" * 300_000, 1)]
    out = splitting.pieces(spark.createDataFrame(data, "id bigint, title string, text string, piece_no int"))
    got = out.collect()
    assert {r["id"] for r in got} == {1, 5, 6, None} and all(r["token_count"] <= 512 and r["overlap_tokens"] <= 64 and len(r["embedding_text_preview"]) <= 240 for r in got)
    six = sorted((r["start_offset"], r["end_offset"]) for r in got if r["id"] == 6)
    assert six[0][0] == 0 and six[-1][1] == 300_000 and all(a[1] == b[0] for a, b in zip(six, six[1:]))
    whole = splitting.pieces(spark.createDataFrame(data[2:5], "id bigint, title string, text string, piece_no int"), whole=True)
    assert rows(whole, "id", "n_pieces") == [(2, 1)]
