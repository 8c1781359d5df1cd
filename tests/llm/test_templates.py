"""Decontamination: whole, re-parameterised and inconsistent copies of an item."""

from fluxprint.llm import templates

ITEM = "The train leaves the old station at 9 hours and carries 250 kg of coal to Alice who pays 12 euros for it near the river"
BENCH = [(1, ITEM), (2, "a b"), (3, None), (4, ""), (None, "some words that no document will ever hold in this order at all")]


def found(frame, docs, bench=BENCH, **options):
    rows = templates.leaks(frame(docs, "doc_id bigint, text string"), frame(bench, "item_id bigint, text string"), **options).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_copies_and_clean_documents(spark, frame):
    other = ITEM.replace("9", "17").replace("250", "31").replace("Alice", "Bob Miller").replace("12", "1,000")
    docs = [(1, "Some words before. " + ITEM + " And after."), (2, "words before " + other), (3, ITEM[:60]), (4, None), (5, ""), (6, "The river is near the old station and the train is late"),
            (7, "pad " * 50_000 + ITEM), (8, ITEM.upper()), (None, ITEM), (9, ITEM), (9, ITEM)]
    got = found(frame, docs)
    assert set(got) == {(1, 1), (2, 1), (7, 1), (9, 1), (None, 1)}
    assert got[2, 1].reparameterised and not got[1, 1].reparameterised and got[9, 1].coverage <= 1
    kept = templates.clean(frame(docs, "doc_id bigint, text string"), frame(BENCH, "item_id bigint, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 8]
    assert kept.columns == ["doc_id", "text", "block", "shard", "score", "kind", "n"]


def test_slots_must_agree(spark, frame):
    item = "if Ann has 3 apples and gives 3 apples to her brother then how many apples does Ann have left in the end"
    docs = [(1, item.replace("3", "5").replace("Ann", "Eve")), (2, item.replace("has 3", "has 5")), (3, item.replace("Ann have", "Eve have"))]
    assert set(found(frame, docs, [(1, item)])) == {(1, 1)}


def test_slices_of_the_benchmark_and_empty_tables(spark, frame):
    docs = [(1, ITEM)]
    assert found(frame, docs, most_windows=3).keys() == found(frame, docs).keys() == {(1, 1)}
    assert found(frame, docs, []) == {} and found(frame, [], BENCH) == {}


def test_all_planted_items_are_found(spark):
    from fluxprint.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    true = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_template_decontamination"](spark, sf).collect()}
    assert true and got == true
