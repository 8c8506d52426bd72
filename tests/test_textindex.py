import numpy as np
import pytest

from fieldloom.operators import text
from fieldloom.sources.textindex import BLOCK, TextIndex, pack_ids, unpack_ids
from tests.conftest import plan_of, rows


@pytest.mark.parametrize("ids", [[5], [-(2**63), 2**63 - 1], [0, 1, 2, 300], [-7, 70_000, 2**40], list(range(0, 9000, 3))])
def test_ids_round_trip(ids):
    a = np.array(ids, np.int64)
    assert unpack_ids(ids[0], pack_ids(a)).tolist() == ids
    assert len(pack_ids(np.arange(1000))) == 1000  # a byte a step


def test_index_finds_what_the_scan_finds(spark, tables, tmp_path):
    docs = tables.documents
    index = TextIndex(spark, str(tmp_path / "i"), 16).add(docs.where("doc_id % 3 > 0"), "doc_id", "text").add(docs.where("doc_id % 3 = 0"), "doc_id", "text")
    for words in (["license"], ["license", "heon", "Thanat"], ["nosuchword"], []):
        want = rows(text.search_any(docs, "text", words), "doc_id") if words else []
        assert rows(index.search_any(words)) == want
        assert rows(index.rows(docs, "doc_id", index.search_any(words)), "doc_id") == want


def test_words_everywhere_odd_rows_and_bounds(spark, tmp_path):
    n = 3 * BLOCK + 5
    every = [(k, "Hot " + ("rare" if k % 1000 == 7 else "x") + " hot") for k in range(n)]
    odd = [(None, "hot"), (-5, None), (-6, ""), (-7, "Rare-hot"), (-7, "rare hot"), (2**62, "hot")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in every + odd], "id long, t string, word int").repartition(5)
    index = TextIndex(spark, str(tmp_path / "i"), 4).add(docs, "id", "t")
    assert sorted(r[0] for r in index.search_any(["HOT"]).collect()) == sorted([*range(n), -7, 2**62])
    rare = [-7, *range(7, n, 1000)]
    assert sorted(r[0] for r in index.search_all(["hot", "rare"]).collect()) == rare
    assert index.search_all(["hot", "nosuch"]).collect() == []
    assert sorted(r[0] for r in index.search_any(["hot"], 100, 107).collect()) == list(range(100, 108))
    assert rows(index.frequencies(["hot", "rare", "no"])) == [("hot", n + 2), ("rare", len(rare))]
    blocks = index.blocks(["hot"]).collect()
    assert len(blocks) > 3 and max(b.n for b in blocks) <= BLOCK
    assert index.blocks(["hot"]).where("first > 4000 AND last < 6000").count() < len(blocks)


def test_only_the_buckets_asked_for_are_read(spark, tables, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 32).add(tables.documents, "doc_id", "text")
    found = index.blocks(["license"])
    assert "PartitionFilters: [" in plan_of(found) and len({f.split("bucket=")[1].split("/")[0] for f in (r[0] for r in found.selectExpr("input_file_name()").distinct().collect())}) == 1
    assert TextIndex(spark, str(tmp_path / "none")).search_any(["a"]).collect() == []


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, t string")
    assert TextIndex(spark, str(tmp_path / "e")).add(docs, "id", "t").search_any(["a"]).collect() == []


def test_lists_of_slots_make_the_blocks_of_each_word(monkeypatch):
    import pyarrow as pa

    from fieldloom.sources import textindex

    monkeypatch.setattr(textindex, "PENDING", 7)
    monkeypatch.setattr(textindex, "SLOT_BITS", 4)
    monkeypatch.setattr(textindex, "BLOCK", 10)
    rng = np.random.default_rng(3)
    ids = [*map(int, rng.permutation(np.arange(-50, 150))), *range(20, 40), 2**62, -(2**62)]
    posts = pa.table({"word": [w for k in ids for w in ("all", f"w{k % 3}")], "id": pa.array([k for k in ids for _ in "ab"], pa.int64())})
    lists = [r for b in textindex._lists(iter(posts.to_batches(5))) for r in b.to_pylist()]
    assert len(lists) < posts.num_rows and all(r["ids"] == sorted(set(r["ids"])) and {k >> 4 for k in r["ids"]} == {r["slot"]} for r in lists)
    rows_ = sorted(({"bucket": 1, **r} for r in lists), key=lambda r: (r["word"], r["slot"]))
    schema = pa.schema([("bucket", pa.int32()), ("word", pa.string()), ("slot", pa.int64()), ("ids", pa.list_(pa.int64()))])
    blocks = [r for b in textindex._blocks(iter(pa.Table.from_pylist(rows_, schema).to_batches(4))) for r in b.to_pylist()]
    for word in ("all", "w0", "w1", "w2"):
        mine = [r for r in blocks if r["word"] == word]
        assert max(r["n"] for r in mine) <= 10
        found = [int(k) for r in mine for k in unpack_ids(r["first"], r["deltas"])]
        assert found == sorted({k for k in ids if word in ("all", f"w{k % 3}")}) and sum(r["n"] for r in mine) == len(found)
