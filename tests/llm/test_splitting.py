import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparloom.llm import q_splitting
from sparloom.llm.splitting import oversized_items, split_items, split_text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#1é́，。", max_size=400), st.integers(1, 60), st.integers(-5, 80))
def test_pieces_join_to_the_text(text, limit, overlap):
    p = split_text(text, limit, overlap)
    assert all(0 <= e - a <= limit for a, e, _ in p)
    if len(text) > limit:
        o = max(0, min(overlap, limit - 1))
        assert len(p) > 1 and p[0][0] == 0 and p[-1][1] == len(text)
        body = text[: p[0][1]]
        for (_, e0, _), (a, e, _) in zip(p, p[1:]):
            assert a == max(0, e0 - o) and e > e0
            body += text[e0:e]
        assert body == text


def test_hierarchy():
    t = "# A\nfirst part. more\n\nsecond part here\n# B\nthird one, longer than the rest of them"
    names = [n for _, _, n in split_text(t, 48, 0)]
    assert names[0] == "section" and "character" not in names
    assert [n for _, _, n in split_text("x" * 25, 10, 2)][:2] == ["character", "character"]


def test_very_long_text():
    p = split_text("word " * 400_000, 1000, 100)
    assert p[-1][1] == 2_000_000 and all(n in ("word", "end") for _, _, n in p)


def test_items_nulls_copies_clashing_columns(spark):
    b = spark.createDataFrame([(1, "x" * 30, "text", 5), (1, "x" * 30, "text", 5), (2, None, "text", 5), (3, "y" * 30, "other", 5), (4, "short", "text", 5), (None, "z" * 30, "text", 5)], "block_id bigint, content string, block_type string, max_chars int")
    c = spark.createDataFrame([("a", [1, 4, 1, 9], " \n"), ("b", None, None), ("c", [2], None), ("d", [], "w" * 41), ("e", [1], "ok")], "chunk_id string, source_block_ids array<bigint>, content_snapshot string")
    lim = spark.createDataFrame([("text", 20, 4), ("chunk", 40, 5)], "item_kind string, max_chars int, overlap_chars int")
    items = oversized_items(b, c, lim)
    got = {(r.table_name, r.item_key, len(r.text)) for r in items.collect()}
    assert got == {("blocks", "1", 30), ("blocks", None, 30), ("chunks", "a", 67), ("chunks", "d", 41)}
    assert split_items(items).where("length(text) > 40").count() == 0
    assert split_items(oversized_items(b.limit(0), c.limit(0), lim)).count() == 0
    assert split_items(oversized_items(b, c, lim.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(q_splitting.QUERIES))
def test_queries_run(spark, small, name):
    assert q_splitting.QUERIES[name](spark, small).count() > 0
