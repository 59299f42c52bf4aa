from massloom.llm import decontaminate as d

from .conftest import prose

ITEM = "A train leaves the station at 40 km per hour and Alice walks 3 km to meet Bob before he rides the same 40 km home"
CASES = {
    ITEM: True,
    "noise before. " + ITEM.lower().replace(" ", "  \n") + " and after": True,
    ITEM.replace("40", "95").replace("Alice", "Maria").replace("3 km", "7 miles").replace("km", "miles"): True,
    ITEM.replace("Alice", "Carla"): True,
    ITEM.upper(): True,
    "leaves the station at 40 km per hour and 3 walks Alice km to meet Bob before": False,
    "A train leaves the station at 40 km per hour": False,
    prose(4, 200): False,
    "": False,
}


def brute(text, items):
    ws = d.words_of(text or "")
    tmpl, slots = d.canonical(ws)
    low = [x.strip(d.SIGNS).lower() for x in ws]
    for item in items:
        iw = d.words_of(item or "")
        it, isl = d.canonical(iw)
        ilow = [x.strip(d.SIGNS).lower() for x in iw]
        w = min(d.WINDOW, len(iw))
        for i in range(len(iw) - w + 1):
            fixed = sum(s is None for s in isl[i : i + w]) >= d.MIN_FIXED
            if w >= d.SHORTEST or fixed:
                for j in range(len(ws) - w + 1):
                    if low[j] == ilow[i] and low[j : j + w] == ilow[i : i + w]:
                        return True
                    if fixed and tmpl[j] == it[i] and tmpl[j : j + w] == it[i : i + w] and d.consistent(isl[i : i + w], slots[j : j + w]):
                        return True
    return False


def test_cases_and_both_forms(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "only a few words here")], "item_id long, text string")
    want = {i: v for i, v in enumerate(CASES.values())}
    assert {r.doc_id: r.dec__hit for r in d.mark(docs, bench).collect()} == want
    assert {r.doc_id: r.dec__hit for r in d.mark(docs, bench, carry=["doc_id"]).collect()} == want
    assert {r.doc_id for r in d.remove(docs, bench).collect()} == {i for i, v in want.items() if not v}
    assert d.mark(docs, bench.where("false")).where("dec__hit").count() == 0


def test_matches_brute_force_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [r.text for r in bench.collect()]
    want = {r.doc_id: brute(r.text, items) for r in docs.collect()}
    assert {r.doc_id: r.dec__hit for r in d.mark(docs, bench).collect()} == want and any(want.values())


def test_slots():
    assert d.consistent([("<num>", "3"), None, ("<num>", "3")], [("<num>", "5"), None, ("<num>", "5")])
    assert not d.consistent([("<num>", "3"), ("<num>", "3")], [("<num>", "5"), ("<num>", "6")])
    assert not d.consistent([("<num>", "3"), ("<num>", "4")], [("<num>", "5"), ("<num>", "5")])
    assert d.canonical("Take 5 kg to Paris. Then rest".split())[0] == ["take", "<num>", "<unit>", "to", "<name>", "then", "rest"]


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(d, "MARKS", 64)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "seven 7 8 9 Bob 10 11 12"), (3, prose(77, 400))], "item_id long, text string")
    assert {r.doc_id: r.dec__hit for r in d.mark(docs, bench).collect()} == dict(enumerate(CASES.values()))
    short = spark.createDataFrame([(1, "so seven 7 8 9 BOB 10 11 12 it is")], "doc_id long, text string")
    assert [r.dec__hit for r in d.mark(short, bench).collect()] == [True]
